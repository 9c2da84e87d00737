"""Sharding by histogram sort.

Documents are keyed by (hash of the text, doc_id), so copies of a text lie side by side and the keys spread evenly.
Splitters that cut the keys into shards of equal bytes are found by counting: each round counts, over all partitions, the
exact bytes in the cells of a grid laid into every unsettled splitter's interval, and the interval shrinks to the cell
that holds the goal.  A splitter is settled once it is within tolerance.  An interval of one hash value (a hot group of
copies) is refined along doc_id.  Rows are then exchanged once, by range.  A round brings ``(shards - 1) * probes``
counts at most to the driver, whatever the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Cells of a grid; more bring an interval down faster and send more counts to the driver.
PROBES = 512


def _axis() -> Column:
    """doc_id as the second part of the key: null as -1, and kept within 62 bits so that differences can't overflow."""
    return F.greatest(F.least(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit(1 << 61)), F.lit(-(1 << 61)))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, h): UTF-8 bytes plus 1 (null text: none, plus 1), CRC-32 and key of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    # 62 bits: interval arithmetic in signed 64-bit numbers can't overflow
    key = F.shiftrightunsigned(F.xxhash64(text), 2)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), key.alias("h"))


def _below(h: Column, i: Column, at: tuple[int, int]) -> Column:
    return (h < F.lit(at[0])) | ((h == F.lit(at[0])) & (i < F.lit(at[1])))


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.002, probes: int = PROBES) -> list[tuple[int, int]]:
    """``shards - 1`` keys (h, id): shard k holds the rows from splitter k - 1 up to, not including, splitter k.

    Each cuts off k/shards of the bytes, within ``tolerance`` of a shard's share or as near as whole rows of one key
    allow.  Null ids count as -1.
    """
    low_id, high_id, total = rows.agg(F.coalesce(F.min("id"), F.lit(0)), F.coalesce(F.max("id"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    goals = [total * k // shards for k in range(1, shards)]
    slack = int(tolerance * total / shards)
    # an interval: [low, high) along h, or along id within one h; the bytes below its low end
    state = [{"h": None, "low": 0, "high": 1 << 62, "below": 0} for _ in goals]
    done: list[tuple[int, int] | None] = [None] * len(goals)
    while any(d is None for d in done):
        cells: dict[tuple, int] = {}
        for k, s in enumerate(state):
            if done[k] is None:
                cells.setdefault((s["h"], s["low"], s["high"]), len(cells))
        where, probe = F.lit(None).cast("int"), F.lit(None).cast("long")
        for (h, low, high), n in cells.items():
            axis = F.col("h") if h is None else F.col("id")
            inside = (axis >= F.lit(low)) & (axis < F.lit(high)) & (F.lit(True) if h is None else F.col("h") == F.lit(h))
            step = -(-(high - low) // probes)
            where = F.when(inside, F.lit(n)).otherwise(where)
            probe = F.when(inside, F.expr(f"({'h' if h is None else 'id'} - ({low})) div {step}L")).otherwise(probe)
        counts: dict[int, dict[int, int]] = {}
        # intervals of one axis never partly overlap: they are equal or apart; those of one h lie within no open interval along h
        for n, p, b in rows.select(where.alias("n"), probe.alias("p"), "size").where("n is not null").groupBy("n", "p").agg(F.sum("size")).collect():
            counts.setdefault(n, {})[p] = b
        for k, s in enumerate(state):
            if done[k] is not None:
                continue
            mine = counts.get(cells[(s["h"], s["low"], s["high"])], {})
            step = -(-(s["high"] - s["low"]) // probes)
            below, goal = s["below"], goals[k]
            best, cell = (abs(below - goal), s["low"]), None
            for p in sorted(mine):
                if below + mine[p] >= goal and cell is None:
                    cell = (p, below)
                below += mine[p]
                edge = min(s["low"] + (p + 1) * step, s["high"])
                best = min(best, (abs(below - goal), edge))
            pack = (lambda v, s=s: (v, low_id) if s["h"] is None else (s["h"], v))
            if best[0] <= slack or cell is None:
                done[k] = pack(best[1])
                continue
            p, under = cell
            low, high = s["low"] + p * step, min(s["low"] + (p + 1) * step, s["high"])
            if high - low > 1:
                state[k] = {"h": s["h"], "low": low, "high": high, "below": under}
            elif s["h"] is None:
                state[k] = {"h": low, "low": low_id, "high": high_id + 1, "below": under}
            else:
                done[k] = pack(best[1])
    return sorted(done)


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs`` (doc_id, text).

    Shards have near-equal bytes; slots count from 0 without gaps in key order, rows of one text and id in any order.
    Copies of a text lie side by side and in one shard, but for those that a splitter cuts through: one group of copies
    for each of the ``shards - 1`` splitters at most.  Null texts count 1 byte; null ids count as -1; rows that repeat a
    document are rows of their own.  Fewer rows than shards leave some shards empty.  Other columns are ignored.
    """
    thin = written(keyed(docs).withColumn("id", _axis()), "keys")
    cuts = splitters(thin.select("h", F.col("id"), "size"), shards, tolerance)
    number = F.lit(0)
    for cut in cuts:
        number = number + (~_below(F.col("h"), F.col("id"), cut)).cast("int")
    placed = _placed(thin.withColumn("shard", number), ["shard", "h", "id", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """The one exchange: ``rows`` by range of ``order`` (its first column is the shard), written, with ``slot``.

    A row's slot is its place in its partition plus the number of its shard's rows in the partitions before it; the
    driver gets one count for each partition and shard that meet, partitions + shards at most.
    """
    spark, name = rows.sparkSession, order[0]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "shards")
    part = F.shiftright("__at", 33)
    seen: dict[int, int] = {}
    offsets = []
    for p, k, first, count in sorted(tuple(r) for r in placed.groupBy(part.alias("p"), name).agg(F.min("__at"), F.count("*")).collect()):
        offsets.append((p, k, seen.get(k, 0) - first))
        seen[k] = seen.get(k, 0) + count
    table = spark.createDataFrame(offsets or [(0, 0, 0)], "__p long, __k int, __shift long")
    joined = placed.join(F.broadcast(table), (part == F.col("__p")) & (F.col(name) == F.col("__k")))
    return joined.withColumn("slot", F.col("__at") + F.col("__shift")).drop("__at", "__p", "__k", "__shift")


def sharded_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The documents (all columns of ``docs``) with ``shard`` and ``slot``: one exchange by range of whole rows.

    Columns of those two names are replaced.  Null texts count 1 byte, null ids as -1; an empty table gives an empty result.
    """
    docs = docs.drop("shard", "slot")
    rows = docs.withColumn("__id", _axis()).withColumn("__h", F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), 2))
    thin = written(rows.select(F.col("__h").alias("h"), F.col("__id").alias("id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")), "keys")
    number = F.lit(0)
    for cut in splitters(thin, shards):
        number = number + (~_below(F.col("__h"), F.col("__id"), cut)).cast("int")
    placed = _placed(rows.withColumn("__shard", number), ["__shard", "__h", "__id"])
    return placed.select(*docs.columns, F.col("__shard").alias("shard"), "slot")
