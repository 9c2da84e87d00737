"""Mixing sources to target weights.

Tokens are summed per source, targets are shared out by weight with a cap on repetition, and each document is emitted
``floor(rate)`` times plus one Bernoulli copy, drawn by a hash of its id, with probability equal to the fraction of its
source's rate.  A source's taken tokens are its target on average; their standard deviation is the root of the sum of
p(1 - p) size^2 over its documents, so they come near the target as documents are many and none outweighs the others.

Only the table of sources (one row each) is ever regrouped; documents are read where they lie and meet their source's
row by broadcast, up to ``MOST_SOURCES`` sources.  The targets come from a Newton iteration over that table (one aggregate
a round), so neither documents nor sources are collected.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import with_rank, written

#: Rows of the table of sources that are broadcast; a larger table is joined by a shuffle.
MOST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of an MD5, the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":0"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """``target`` for a table (source, source_size): ``share`` of all sizes by weight, each at most ``most`` x its size.

    ``weights`` repeat over the sources in code-point order, null last.  What a capped source leaves is shared again by
    weight among the others until none is above its cap.
    """
    ranked = with_rank(sizes, [F.col("source").isNull(), F.col("source")], "rank", 1 + sizes.count() // 10_000)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = written(ranked.withColumn("weight", pick.cast("long")).withColumn("cap", F.col("source_size") * most), "sources")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    goal = float(Fraction(total) * share)
    level = -1.0
    while True:
        capped = F.col("weight") * F.lit(level) >= F.col("cap")
        full, open_weight = table.agg(F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        higher = (goal - full) / open_weight if open_weight else level
        if higher <= level or not open_weight:
            break
        level = higher
    return table.select("source", "source_size", F.when(F.col("weight") * F.lit(level) >= F.col("cap"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def rates(thin: DataFrame, weights: tuple[int, ...], share: Fraction, most: int) -> DataFrame:
    """(__source, __source_size, __target, __whole, __part) for the sources of ``thin`` (source, size), broadcast if few."""
    sizes = written(thin.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    table = source_targets(sizes, weights, share, most).withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    table = written(table.select(*[F.col(c).alias(f"__{c}") for c in table.columns]), "rates")
    return F.broadcast(table) if table.count() <= MOST_SOURCES else table


def _copies() -> Column:
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    return F.col("__whole") + (draw(key) < F.col("__part")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for each row of ``docs`` (doc_id, text, source).

    Null texts have size 0; a null source is a source of its own, the last.  Repeated rows are decided alike.  A source
    of size 0 gets target 0 and no copies.  An empty table gives an empty result.  Other columns of ``docs`` are ignored.
    """
    thin = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")), "sizes")
    rows = thin.join(rates(thin, weights, share, most), F.col("source").eqNullSafe(F.col("__source")))
    return rows.select("doc_id", "size", "source", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), _copies().alias("copies"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; same columns as ``docs``, whatever their names.

    The decision depends on (doc_id, source) alone, so rows that repeat a document get that document's number of copies.
    Documents aren't shuffled: sizes are summed in one pass, and copies made in another.
    """
    table = rates(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, most)
    rows = docs.join(table, docs["source"].eqNullSafe(F.col("__source"))).withColumn("__copies", _copies()).where("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
