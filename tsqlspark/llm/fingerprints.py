"""SpotSigs document fingerprints, in DataFrame functions throughout.

A spot is an anchor right before a content word.  Anchors are the common words, the beginning of the text and the
beginnings of its sentences and lines, so every text with a content word has a spot.  A spot's signature is the anchor
with the chain of the next ``CHAIN`` content words, anchors in between passed over; the end of the text counts as a last
content word.  A fingerprint is the set of a text's signatures, hashed to 32 bits and sorted.  Likeness is the Jaccard
similarity of two sets.

For joins, sets are partitioned by length so that two sets of at least the wanted similarity share a partition, and a set
is put only under its first signatures, rarest first, of which two such sets must have one in common.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_counted, with_rank, written
from .near_dedup import linked_roots

CHAIN = 2
#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he her his i in is it its my not of on or our she so that the their they this to was we were which will with you "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour que qui sa se ses son sur un une vous "
    "aber als am auch auf aus bei das dem den der die ein eine einen er es für ich im ist mit nicht oder sich sie sind um und von war wie wir zu zum zur "
    "al como con del el era esta ha las lo los más no o para pero por su sus te uno y ya"
).split()
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows of neighbouring ids handled together.
NEIGHBOURS, SEGMENTS = 1000, 2048


def _trie(words: list[str]) -> str:
    """A regular expression for exactly these words that branches on one character at a time."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [h + (_trie(rest) if any(rest) else "") for h, rest in heads.items()]
    return f"(?:{'|'.join(parts)}){'?+' if '' in words else ''}"


#: Tokens in capitals, which no lower-cased text has: a beginning and the end of the text.
BEGIN, END = "B", "E"
ANCHOR = _trie([*ANCHORS, BEGIN])
#: A trailing space makes an anchor a whole word.
SPOT = rf"(?<= )(?=({ANCHOR} (?!{ANCHOR} )[^ ]++(?: (?:{ANCHOR} )*+[^ ]++){{{CHAIN - 1}}}) )"


def with_signatures(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``, the sorted distinct 32-bit signatures of the texts in ``column`` (without nulls).

    A text without a content word has one signature, of its anchors; one without words that of the text itself.  The steps
    are columns of their own, each named more than once after, so that the optimizer doesn't repeat a step by inlining it.
    """
    keep = rows.columns
    begun = F.regexp_replace(F.lower(column), r"[.!?\n]", f" {BEGIN} ")
    rows = rows.withColumn("__plain", F.concat(F.lit(f" {BEGIN} "), F.regexp_replace(begun, GAP, " "), F.lit(f" {END} ")))
    rows = rows.withColumn("__spots", F.regexp_extract_all("__plain", F.lit(SPOT), F.lit(1)))
    inner = f" (?:{ANCHOR} )++"
    hashed = F.transform("__spots", lambda s: F.hash(F.regexp_replace(s, inner, " ")))
    rows = rows.withColumn("__hashed", F.sort_array(F.array_distinct(hashed)))
    whole = F.hash(F.when(F.regexp_like("__plain", F.lit(rf"^[ {BEGIN}]*{END} $")), F.col(column)).otherwise(F.col("__plain")))
    return rows.select(*keep, F.when(F.size("__hashed") > 0, F.col("__hashed")).otherwise(F.array(whole)).alias(name))


def fingerprint(signatures: Column) -> Column:
    """The signatures as eight hexadecimal digits each."""
    return F.array_join(F.transform(signatures, lambda h: F.right(F.hex(h.cast("long") + F.lit(1 << 36)), F.lit(8))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets; below ``least`` it may be given as 0, told by the sizes alone."""
    common = F.size(F.array_intersect(a, b))
    pruned = F.least(F.size(a), F.size(b)) < F.lit(least) * F.greatest(F.size(a), F.size(b))
    return F.when(pruned, F.lit(0.0)).otherwise(common / (F.size(a) + F.size(b) - common).cast("double"))


def _places(rows: DataFrame) -> list[Column]:
    """``bucket`` and ``part``: numbers that grow with (doc_id, h) and are shared by about ``NEIGHBOURS`` rows.

    Ids are cut into at most ``SEGMENTS`` segments of about equal numbers of rows, and each segment evenly.  An id that
    fills a segment or more, and the null id, which comes before all others, are cut by h, a number below 2^31.
    """
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    parts = max(1, min(SEGMENTS, n // NEIGHBOURS))
    cuts = rows.select(F.percentile_approx("doc_id", [i / parts for i in range(parts + 1)], 10 * parts).alias("c")).first()["c"] or [0]
    bounds = sorted(set(cuts))
    within = max(1, n // (NEIGHBOURS * parts))
    table, times = F.lit(bounds), F.lit([within * max(0, cuts.count(b) - 1) for b in bounds])
    id_ = F.greatest(F.least(F.coalesce("doc_id", F.lit(bounds[0])), F.lit(bounds[-1])), F.lit(bounds[0]))
    # binary search for the last bound that isn't above the id; one lambda, so the expression doesn't grow with the bounds
    steps = [1 << i for i in reversed(range((len(bounds) - 1).bit_length()))] or [0]
    low = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step) <= id_, F.lit(False)), at + step).otherwise(at))

    def number(at: Column) -> Column:
        start, end = F.get(table, at), F.coalesce(F.get(table, at + 1), F.lit(bounds[-1] + 1))
        return at.cast("long") * within + F.floor((id_ - start) / (end - start) * within).cast("long")

    def cut(at: Column) -> Column:
        # the rows of the bound itself come before all others of its bucket
        k = F.get(times, at).cast("long")
        return F.when(F.col("doc_id") == F.get(table, at), F.shiftright(F.col("h") * k, 31)).otherwise(k)

    null_parts = F.lit(nulls // NEIGHBOURS + 1).cast("long")
    null = F.col("doc_id").isNull()
    return [
        F.when(null, F.lit(-1).cast("long")).otherwise(F.transform(F.array(low), number)[0]).alias("bucket"),
        F.when(null, F.shiftright(F.col("h") * null_parts, 31)).otherwise(F.transform(F.array(low), cut)[0]).alias("part"),
    ]


def _compared(rows: DataFrame) -> DataFrame:
    """``rows`` (text, sigs, next_text, next_sigs and others) with n, edited_sha256, edited_sigs, near_edited and near_next."""
    n = F.length("text")
    keep = rows.columns
    rows = rows.select(*keep, n.alias("n"), (n - F.floor(n / 3).cast("int")).alias("__kept"))
    edited = F.concat(F.expr("substring(text, 1, __kept)"), F.expr("substring(next_text, 1, n - __kept)"))
    rows = with_signatures(rows.select(*keep, "n", edited.alias("__edited")), "__edited", "edited_sigs")
    return rows.select(*keep, "n", F.sha2("__edited", 256).alias("edited_sha256"), "edited_sigs", likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row (doc_id, text).

    The edited text is the text with its last third replaced by the beginning of the next document by descending doc_id,
    after the last the first.  Null ids come last; rows of equal doc_id follow one another by a hash of the text.  Null
    texts are empty; other columns are ignored; an empty table gives an empty result.

    Rows of neighbouring ids meet in one exchange of the texts, after which signatures are computed and all but the last
    row of each run of neighbours are done.  The texts of the first and last row of each run are written with the results;
    runs are numbered, and the last row of each meets the first of the next.
    """
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    thin = thin.withColumn("h", F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1)))
    moved = with_signatures(thin.select("*", *_places(thin.select("doc_id"))).repartition("bucket", "part"), "text", "sigs")
    run = Window.partitionBy("bucket", "part").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc(), "text")
    near = moved.select("*", F.lead("text").over(run).alias("next_text"), F.lead("sigs").over(run).alias("next_sigs"), F.lag(F.lit(1)).over(run).alias("before"))
    results = ["doc_id", "n", "sigs", "edited_sha256", "edited_sigs", "near_edited", "near_next"]
    done = _compared(near).select("bucket", "part", *results, F.when(F.col("before").isNull(), F.col("text")).alias("first_text"), F.when(F.col("next_text").isNull(), F.col("text")).alias("last_text"))
    done = written(done, "neighbours")
    firsts = done.where("first_text is not null").select("bucket", "part", F.col("first_text").alias("next_text"), F.col("sigs").alias("next_sigs"))
    runs = firsts.count()
    numbers = written(with_rank(firsts.select("bucket", "part"), [F.col("bucket").desc(), F.col("part").desc()], "number", 1 + runs // 10_000), "runs")
    heads = firsts.join(numbers, ["bucket", "part"]).select(F.col("number").alias("head"), "next_text", "next_sigs")
    lasts = done.where("last_text is not null").select("bucket", "part", "doc_id", F.col("last_text").alias("text"), "sigs").join(numbers, ["bucket", "part"])
    lasts = lasts.join(heads, (F.col("number") + 1) % max(1, runs) == F.col("head")).select("doc_id", "text", "sigs", "next_text", "next_sigs")
    rows = done.where("last_text is null").select(*results).union(_compared(lasts).select(*results))
    return rows.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), "edited_sha256",
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def near_duplicate_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id) for each row (doc_id, text): class_id is the smallest doc_id of the row's class.

    Documents of equal fingerprints are of one class; different ones are linked where their likeness is at least
    ``similarity``.  Rows with a null doc_id get the class of an equal fingerprint, else null.  Null texts are empty; other
    columns are ignored; an empty table gives an empty result.
    """
    rows = with_signatures(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")), "text", "sigs").drop("text")
    rows = written(rows.withColumn("digest", F.md5(fingerprint(F.col("sigs")))), "spots")
    texts = written(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sigs").alias("sigs"), F.count("*").alias("rows")), "sets")
    sets = texts.where("id is not null").select("id", "sigs")
    spots = written(sets.select("id", F.size("sigs").alias("size"), F.explode("sigs").alias("sig")), "signatures")
    counted = spots.groupBy("sig").agg(F.count("*").alias("rows")).withColumn("seen", F.col("rows"))
    rarest = join_counted(spots, counted, "sig").groupBy("id", "size").agg(F.array_sort(F.collect_list(F.struct("seen", "sig"))).alias("sigs"))
    size = F.col("size")
    part = F.floor(F.log(size.cast("double")) / math.log(1 / similarity) + 1e-9)
    first = F.slice("sigs", 1, size - F.ceil(F.lit(similarity) * size - 1e-9).cast("int") + 1)
    spread = rarest.select("id", F.explode(F.array(part, part + 1)).alias("part"), first.alias("first")).select("id", "part", F.explode("first.sig").alias("sig"))
    members = written(spread.select(F.xxhash64("part", "sig").alias("bucket"), "id").distinct(), "members")
    roots = linked_roots(members, sets.withColumnRenamed("sigs", "shingles"), similarity)
    final = texts.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("class_id"), "rows")
    return join_counted(rows.select("doc_id", "digest"), final, "digest").select("doc_id", "class_id")
