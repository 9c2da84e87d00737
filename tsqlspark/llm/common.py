"""Pieces that several corpus operators share: scratch tables, byte-level word scanning, ranks and components.

Word scanning works on whole Arrow batches: the bytes of all texts of a batch are classified with one table look-up, so
no Python loop runs per document or per word.  Because every byte of a multi-byte UTF-8 sequence is 0x80 or above, the
byte classes below are exactly the word class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or that of the context.

    Only where both are unset and everything runs in one machine is a temporary folder made; on a cluster that would lose
    rows, so it raises RuntimeError.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="corpus-scratch-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}-{label}"
    # the shuffle files of this write are of no use once it is done
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------------------------------------------------------------
# Byte-level words

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = True
_IS_WORD[97:123] = True
_IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_LOW_POWERS = _powers(4097)
_HIGH_STEP = _LOW_POWERS[4096]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    x = x + _BASE
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string or binary column and the n + 1 offsets into them; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds.astype(np.int64)


def chunks(column: pa.Array, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of at most ``max_bytes`` (or one longer row): (first row, end row, bytes, offsets from 0)."""
    data, bounds = text_buffers(column)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo]
        lo = hi


#: Bytes of one text that are scanned at a time; working memory is about 30 times as much.
SCAN_BYTES = 1 << 22


def scan_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts: start bytes, end bytes, 64-bit hashes, and for each text the index of its first word (n + 1).

    A text of more than ``SCAN_BYTES``, alone in its run, is scanned in parts that end between words.
    """
    if len(data) <= SCAN_BYTES or len(bounds) > 2:
        return _scan(data, bounds)
    parts, lo = [], 0
    while lo < len(data):
        hi = min(lo + SCAN_BYTES, len(data))
        gaps = np.flatnonzero(~_IS_WORD[_LOWER[data[lo:hi]]])
        if len(gaps):
            hi = hi if hi == len(data) else lo + int(gaps[-1]) + 1
        else:
            # one word fills the part: on to its end
            while hi < len(data) and not len(gaps):
                gaps = np.flatnonzero(~_IS_WORD[_LOWER[data[hi : hi + SCAN_BYTES]]])
                hi = hi + int(gaps[0]) if len(gaps) else min(hi + SCAN_BYTES, len(data))
        starts, ends, words, _ = _scan(data[lo:hi], np.array([0, hi - lo]))
        parts.append((starts + lo, ends + lo, words))
        lo = hi
    starts, ends, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    return starts, ends, words, np.array([0, len(starts)])


def _scan(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[data]
    inside = _IS_WORD[low]
    n = len(low)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    edges = bounds[(bounds > 0) & (bounds < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), first
    lengths = ends - starts
    at = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    place = np.arange(int(at[-1] + lengths[-1]), dtype=np.int64) - np.repeat(at, lengths)
    weight = _LOW_POWERS[place & 4095]
    if (longest := int(lengths.max())) > 4096:
        high = np.full((longest >> 12) + 1, _HIGH_STEP, dtype=np.uint64)
        high[0] = 1
        weight = weight * np.multiply.accumulate(high)[place >> 12]
    sums = np.add.reduceat((low[inside].astype(np.uint64) + np.uint64(1)) * weight, at)
    return starts, ends, mix64(sums), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words and the text each belongs to; a text with fewer words has one, of all of them."""
    counts = np.diff(first)
    n = len(words)
    doc = np.repeat(np.arange(len(counts)), counts)
    acc = np.zeros(n, np.uint64)
    take = np.minimum(np.repeat(first[1:], counts) - np.arange(n), width)
    for i in range(width):
        shifted = np.zeros(n, np.uint64)
        shifted[: max(0, n - i)] = words[i:]
        acc = np.where(take > i, mix64(acc * np.uint64(3) + shifted), acc)
    begins = np.arange(n) == np.repeat(first[:-1], counts)
    keep = (take == width) | (begins & (np.repeat(counts, counts) < width))
    return acc[keep], doc[keep]


# ---------------------------------------------------------------------------------------------------------------------
# Distributed ranks and components


def with_rank(df: DataFrame, order: list, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` with a gapless 0-based rank by ``order``, without a single-task sort.

    Rows are dealt out by range and written; a row's place in its partition plus the number of rows in the partitions
    before it is its rank.  Only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "rank")
    part = F.shiftright("__at", 33)
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    total, offsets = 0, {}
    for p in sorted(sizes):
        offsets[p] = total
        total += sizes[p]
    table = spark.createDataFrame([(int(k), v) for k, v in offsets.items()] or [(0, 0)], "__p long, __before long")
    return placed.join(F.broadcast(table), part == F.col("__p")).withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__p", "__before")


#: A key with more than this share of all rows is joined by broadcast; there are at most as many such keys as its inverse.
HOT_SHARE = 1 / 1024


def join_counted(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The inner join of ``rows`` with ``table`` (key, rows: how many ``rows`` have it, and others), the count left out.

    ``rows`` should be written, as it is read three times.  Keys of more than ``HOT_SHARE`` of all rows, of which there
    can't be more than 1 / ``HOT_SHARE``, meet their rows by broadcast, so that no task gets all rows of a key; the others
    are shuffled.
    """
    table = written(table, "counted")
    most = int(rows.count() * HOT_SHARE)
    few = table.where(F.col("rows") > most).drop("rows")
    others = table.where(F.col("rows") <= most).drop("rows")
    if few.limit(1).count() == 0:
        return rows.join(others, key)
    # a hot key's rows meet none of the others; the left join tells them before the shuffle
    names = few.select(F.col(key).alias("__hot"))
    cold = rows.join(F.broadcast(names), F.col(key) == F.col("__hot"), "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(cold.join(others, key))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): for each id in ``edges`` the smallest id of its connected component.

    Each round gives every id the smallest root among its neighbours, then replaces roots by their own roots; rounds end
    when nothing changes.  Every round's table is written to the shared folder.
    """
    both = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).where("u <> v").distinct(), "edges")
    roots = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).withColumnRenamed("u", "id"), "roots")
    while True:
        seen = both.join(roots.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("root").alias("near"))
        nearer = roots.join(seen, "id").select("id", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = nearer.alias("x").join(roots.alias("y"), F.col("x.root") == F.col("y.id")).select("x.id", "x.was", F.least(F.col("x.root"), F.col("y.root")).alias("root"))
        moved = written(jump, "roots")
        roots = moved.select("id", "root")
        if moved.where("was <> root").limit(1).count() == 0:
            return roots


