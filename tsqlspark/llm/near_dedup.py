"""Near-duplicate detection with ProbMinHash.

A text's five-word shingles, weighted by 1 + ln(count), arrive as Poisson processes whose rates are the weights: each
arrival of a shingle falls on one component of the signature, each component keeps its earliest arrival, and the process
of a shingle ends once its next arrival is later than the latest component.  Two signatures agree in a component with
probability equal to the probability Jaccard similarity of the texts.  Signatures are banded; pairs from one bucket are
verified by the Jaccard similarity of their shingle sets, and classes are the connected components of the links.

Where two texts repeat their shingles unequally, the probability Jaccard similarity is far below that of the sets.  So a
text with repeats is banded by a second signature too, of the same processes at unit rates, which agrees with probability
equal to the similarity that is verified.  Without repeats both signatures are the same.

Exact copies are reduced to one text first.  A bucket of up to ``SMALL`` texts is compared pair by pair.  In a larger one
every text is compared with the smallest; then every text outside the bucket's largest class is compared with the whole
bucket, block against block within a task, and only links come out.  So of any two classes of a bucket at least one has
been compared with all of it: no link between classes is missed that the buckets hold, no pairs are emitted, and a group
of thousands of near copies costs about one comparison a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, components, join_counted, mix64, scan_words, shingle_hashes, written

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 shares a bucket by the signatures at unit rates with probability 1 - (1 - 0.8^4)^16 = 0.9998.
BANDS, ROWS = 16, 4
SMALL = 8
#: Texts outside a large bucket's largest class, and texts of the bucket, that one task compares.
OUTSIDERS, OTHERS = 256, 2048


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes per text: (hashes, text of each in ascending order, count of each)."""
    _, _, words, first = scan_words(data, bounds)
    hashes, doc = shingle_hashes(words, first, width)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return hashes[at], doc[at], np.diff(np.append(at, len(hashes)))


def prob_min_hash(hashes: np.ndarray, doc: np.ndarray, weights: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures (docs x size): for each component the element that arrived first; 0 for texts without elements."""
    earliest = np.full(docs * size, np.inf)
    winner = np.zeros(docs * size, np.uint64)
    time = np.zeros(len(hashes))
    turn = 0
    while len(hashes):
        turn += 1
        bits = mix64(hashes + np.uint64(turn * 0xD1B54A32D192ED03 % 2**64))
        time = time - np.log((bits >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weights
        component = (mix64(bits) % np.uint64(size)).astype(np.int64)
        at = doc * size + component
        np.minimum.at(earliest, at, time)
        first = earliest[at] == time
        winner[at[first]] = hashes[first]
        latest = earliest.reshape(docs, size).max(axis=1)
        alive = time < latest[doc]
        hashes, doc, weights, time = hashes[alive], doc[alive], weights[alive], time[alive]
    return winner.reshape(docs, size)


def band_keys(hashes: np.ndarray, doc: np.ndarray, weights: np.ndarray, docs: int) -> np.ndarray:
    """Keys (docs x BANDS) of the bands of the texts' signatures."""
    signature = prob_min_hash(hashes, doc, weights, docs, BANDS * ROWS).reshape(docs, BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        keys = mix64(keys + signature[:, :, r])
    return keys


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(2)
        for lo, hi, data, bounds in chunks(column, 1 << 20):
            hashes, doc, counts = shingle_sets(data, bounds, SHINGLE)
            some = np.bincount(doc, minlength=hi - lo) > 0
            repeats = np.bincount(doc[counts > 1], minlength=hi - lo) > 0
            own = repeats[doc]
            weighted = band_keys(hashes[own], (np.cumsum(repeats) - 1)[doc[own]], 1 + np.log(counts[own]), int(repeats.sum()))
            offsets = np.concatenate(([0], np.cumsum((some.astype(np.int64) + repeats) * BANDS)))
            keys = np.empty(int(offsets[-1]), np.uint64)
            keys[offsets[:-1][some][:, None] + np.arange(BANDS)] = band_keys(hashes, doc, np.ones(len(hashes)), hi - lo)[some]
            keys[offsets[:-1][repeats][:, None] + BANDS + np.arange(BANDS)] = weighted
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), lists], names=["doc_id", "digest", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, bounds in chunks(batch.column(1), 1 << 20):
            hashes, doc, _ = shingle_sets(data, bounds, SHINGLE)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["id", "shingles"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the given Jaccard similarity."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    sized = (F.size("sa") >= similarity * F.size("sb")) & (F.size("sb") >= similarity * F.size("sa"))
    return both.where(sized & (common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common))).select("a", "b")


def linked_roots(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(id, root): the smallest id of the class of each id that has a link.

    ``members`` (bucket, id) must be written and without repeats; ids of one bucket are compared by their ``sets``
    (id, shingles), as the module's head says.
    """
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1").withColumn("rows", F.col("n"))
    members = written(join_counted(members, shared, "bucket"), "buckets")
    small, large = members.where(F.col("n") <= SMALL), members.where(F.col("n") > SMALL)
    other = small.select("bucket", F.col("id").alias("b"))
    pairs = small.select("bucket", F.col("id").alias("a")).join(other, "bucket").where("a < b").select("a", "b")
    pairs = pairs.union(large.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))).distinct()
    links = written(_verified(pairs, sets, similarity), "links")
    roots = components(links)
    rooted = written(large.join(roots, "id", "left").select("bucket", "id", "n", "first", F.coalesce("root", "id").alias("root")), "rooted")
    sizes = rooted.groupBy("bucket", "root").count()
    biggest = sizes.groupBy("bucket").agg(F.max(F.struct("count", "root"))["root"].alias("top"), F.count("*").alias("classes"), F.sum("count").alias("rows")).where("classes > 1").select("bucket", "top", "rows")
    outside = written(join_counted(rooted, biggest, "bucket").where("root <> top and id <> first").select("bucket", "id", "root", "n"), "outside")
    if outside.limit(1).count() == 0:
        return roots
    parts = outside.groupBy("bucket").agg(F.ceil(F.count("*") / OUTSIDERS).alias("os"), F.ceil(F.first("n") / OTHERS).alias("ms"))
    part = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
    few = outside.join(parts, "bucket").withColumn("o", part(1, "os")).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ms") - 1)))
    many = rooted.join(parts, "bucket").withColumn("m", part(2, "ms")).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("os") - 1)))
    block = F.xxhash64("bucket", "o", "m").alias("block")
    rows = few.select(block, F.lit(True).alias("outside"), "id", "root").union(many.select(block, F.lit(False), "id", "root")).join(sets, "id")

    def crossed(table: pa.Table) -> pa.Table:
        return _across(table, similarity)

    more = rows.select("block", "outside", "id", "root", "shingles").groupBy("block").applyInArrow(crossed, "a long, b long").distinct()
    return components(links.union(written(more, "links")))


def _across(table: pa.Table, similarity: float) -> pa.Table:
    """Links between the outsiders and the other texts of a block: for each outsider one for each class it is linked to."""
    out = table.column("outside").to_numpy().astype(bool)
    ids, roots = table.column("id").to_numpy(), table.column("root").to_numpy()
    lists = table.column("shingles").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    links = []
    left, right = np.flatnonzero(out), np.flatnonzero(~out)
    for lo in range(0, len(left), 64):
        some = left[lo : lo + 64]
        known, place = np.unique(np.concatenate([values[ends[i] : ends[i + 1]] for i in some]), return_inverse=True)
        has = np.zeros((len(known) + 1, len(some)), np.int32)
        has[place, np.repeat(np.arange(len(some)), sizes[some])] = 1
        for at in range(0, len(right), 64):
            others = right[at : at + 64]
            theirs = np.concatenate([values[ends[i] : ends[i + 1]] for i in others])
            found = np.minimum(np.searchsorted(known, theirs), len(known) - 1)
            found[known[found] != theirs] = len(known)
            starts = np.concatenate(([0], np.cumsum(sizes[others])[:-1]))
            common = np.add.reduceat(has[found], starts, axis=0)
            j, i = np.nonzero((common >= similarity * (sizes[others][:, None] + sizes[some][None, :] - common)) & (roots[others][:, None] != roots[some][None, :]))
            links += [(ids[some[x]], ids[others[y]], roots[others[y]]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]
    one = {(a, root): b for a, b, root in reversed(links)}
    return pa.table({"a": pa.array([int(a) for a, _ in one], pa.int64()), "b": pa.array([int(b) for b in one.values()], pa.int64())})


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id) for each row of ``docs`` (doc_id, text): class_id is the smallest doc_id of the row's class.

    Null texts are empty.  Equal texts are of one class; a text without words is like no different text; one with fewer
    than five words has one shingle, of all of them.  Rows with a null doc_id get the class of an equal text, else null.
    Rows that share a doc_id are one document.  Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))
    signed = written(rows.mapInArrow(_signatures, "doc_id long, digest string, bands array<long>"), "signatures")
    # a key of a third of all rows is reduced to one row by each task before the exchange
    texts = written(signed.groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.count("*").alias("rows")), "texts")
    placed = texts.where("id is not null").select("id", F.posexplode("bands").alias("band", "key"))
    placed = placed.select(F.xxhash64(F.pmod("band", F.lit(BANDS)), "key").alias("bucket"), "id").distinct()
    shared = placed.groupBy("bucket").count().where("count > 1").select("bucket")
    members = written(placed.join(shared, "bucket", "left_semi"), "members")
    involved = texts.join(members.select("id").distinct(), "id").select(F.col("id").alias("doc_id"), "digest")
    found = rows.join(involved, ["doc_id", "digest"], "left_semi")
    sets = written(found.select(F.col("doc_id").alias("id"), "text").mapInArrow(_sets, "id long, shingles array<long>"), "sets").dropDuplicates(["id"])
    roots = linked_roots(members, sets, similarity)
    final = texts.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("class_id"), "rows")
    return join_counted(signed.select("doc_id", "digest"), final, "digest").select("doc_id", "class_id")


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; same columns as ``docs``.

    Of rows that share a doc_id one stays.  Rows with a null doc_id stay, one for each text that no other document has.
    """
    ids = near_duplicate_classes(docs, similarity).where("class_id is not null").select(F.col("class_id").alias("__kept")).distinct()
    kept = docs.join(ids, docs["doc_id"].cast("long") == F.col("__kept"), "left_semi").dropDuplicates(["doc_id"])
    unnamed = docs.where("doc_id is null")
    if unnamed.limit(1).count():
        text = F.md5(F.coalesce(F.col("text"), F.lit("")))
        others = docs.where("doc_id is not null").select(text.alias("__digest")).distinct()
        rest = unnamed.withColumn("__own", text).join(others, F.col("__own") == F.col("__digest"), "left_anti").dropDuplicates(["__own"]).drop("__own")
        kept = kept.unionByName(rest)
    return kept
