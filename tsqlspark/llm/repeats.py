"""Removal of repeated passages with suffix arrays and longest previous factors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id.  The suffixes of
the whole corpus are never sorted in one place.  Every window of ``LENGTH`` bytes has a minimizer, the smallest hash of
its ``GRAM``-byte strings, so equal windows have equal minimizers:

1. Each document's minimizers are dealt out by value; those that two documents have are reported back to them.
2. Documents cut out the stretches of windows around reported minimizers; equal stretches are reduced to one, with the
   smallest and largest document that has it.  Of a minimizer with more than ``MOST`` different stretches each window
   becomes a stretch of its own, under its own hash, so that no task holds all of a minimizer.
3. The stretches of one minimizer meet in one task, which builds the suffix array of the windows of a run of minimizers.
   Over it go the arrays of previous and next smaller positions (the nearest suffixes on both sides of a smaller
   document); the longer common prefix with either is the longest previous factor.  Where it has ``LENGTH`` bytes or more
   the suffix's beginning is a later copy.
4. Documents take back what was found for their stretches and drop the bytes.

Texts that are equal as wholes are told apart by digest before step 2 and cost nothing more.  Texts longer than ``CHUNK``
are worked through in overlapping parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, join_counted, mix64, text_buffers, written

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: Bytes that are hashed at a time, and bytes of stretches that one suffix array holds.
CHUNK, STRETCHES = 1 << 18, 1 << 21
#: Different stretches of one minimizer that one task takes, and such minimizers that are broadcast.
MOST, FEW_KEYS = 1 << 14, 1 << 18
#: Bytes of a suffix (the longest stretch, in whole words), and of the room for one stretch, the zeros after it included.
WIDTH = -(-(LENGTH + SPAN - 1) // 8) * 8
ROOM = LENGTH + SPAN - 1 + WIDTH
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(63)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = [_powers(_BASE, CHUNK + LENGTH + 1), _powers(pow(_BASE, -1, 2**64), CHUNK + LENGTH + 1)]


def parts(column: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of at most ``CHUNK`` bytes together: (first row, end row, offset, bytes, offsets from 0).

    A longer text comes in parts of its own that begin ``offset`` bytes into it and overlap, so that every window is in
    exactly one.
    """
    for lo, hi, data, bounds in chunks(column, CHUNK):
        if len(data) <= CHUNK:
            yield lo, hi, 0, data, bounds
            continue
        for at in range(0, len(data) - LENGTH + 1, CHUNK):
            part = data[at : at + CHUNK + LENGTH - 1]
            yield lo, hi, at, part, np.array([0, len(part)])


def minimizers(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within one text, in order: start byte, minimizer, and text.  Last the running sums of all bytes."""
    n = len(data)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], out=sums[1:])
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * _POWERS[1][: n + 1 - GRAM])
    # the place of a gram, modulo 64, stands in its low bits
    low = (grams & ~_LOW) | (np.arange(len(grams), dtype=np.uint64) & _LOW)
    width = 1
    while width * 2 <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    sizes = np.maximum(np.diff(bounds) - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    starts = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes) + bounds[text]
    return starts, low[starts], text, sums


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (minimizer, row) pairs of a column of texts, by minimizer."""
    keys, rows = [], []
    for lo, _, _, data, bounds in parts(column):
        _, low, text, _ = minimizers(data, bounds)
        if not len(low):
            continue
        new = np.ones(len(low), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
        keys.append(low[new] & ~_LOW)
        rows.append(text[new] + lo)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return key[new], row[new]


def _packed(bucket: np.ndarray, known: np.ndarray, key: np.ndarray, row: np.ndarray, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Per bucket one value: number of documents, their (id, text key), pairs of each, number already known, minimizers."""
    order = np.lexsort((row, known, bucket))
    bucket, known, key, row = bucket[order], known[order], key[order], row[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    out, which = [], []
    for b in range(buckets):
        lo, hi = cuts[b], cuts[b + 1]
        if lo == hi:
            continue
        group = known[lo:hi] * len(ids) + row[lo:hi]
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        counts = np.diff(np.append(at, hi - lo)).astype(np.int32)
        head = np.array([len(at), int((known[lo:hi] == 0).sum())], np.int64)
        out.append(head.tobytes() + ids[row[lo:hi][at]].tobytes() + counts.tobytes() + key[lo:hi].tobytes())
        which.append(b)
    return np.array(which, np.int32), out


def _asked(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, row = _pairs(batch.column(2))
            if not len(key):
                continue
            ids = np.stack([np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1)], axis=1)
            # of a minimizer that many documents of this batch have, two are enough for the others to hear of it; the
            # rest know already and are dealt out by document, so that no bucket fills up
            new = np.concatenate(([True], key[1:] != key[:-1]))
            place = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            known = (place >= 2).astype(np.int64)
            spread = np.where(known == 1, mix64(ids[row, 1].view(np.uint64)), mix64(key))
            which, packed = _packed((spread % np.uint64(buckets)).astype(np.int64), known, key, row, ids, buckets)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(packed, pa.binary())], names=["bucket", "packed"])

    return ask


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, owners, told = [], [], []
    for batch in batches:
        for value in batch.column(1):
            data = value.as_py()
            docs, open_ = np.frombuffer(data, np.int64, 2)
            ids = np.frombuffer(data, np.int64, 2 * docs, 16).reshape(-1, 2)
            counts = np.frombuffer(data, np.int32, docs, 16 + 16 * docs)
            key = np.frombuffer(data, np.uint64, -1, 16 + 20 * docs)
            owner = np.repeat(ids, counts, axis=0)
            keys.append(key[:open_])
            owners.append(owner[:open_])
            told.append((key[open_:], owner[open_:]))
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    key, owner = key[order], owner[order]
    same = key[1:] == key[:-1]
    shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
    key = np.concatenate([key[shared], *(k for k, _ in told)])
    owner = np.concatenate([owner[shared], *(o for _, o in told)])
    for lo in range(0, len(key), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(owner[part, 0]), pa.array(owner[part, 1]), pa.array(key[part].view(np.int64))], names=["doc_id", "t", "key"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, t, text, keys): the stretches of windows around the given minimizers.

    Of the equal stretches of a batch the first has the bytes, and the smallest and largest document of them all.
    """
    for batch in batches:
        lists = batch.column(3)
        list_ends = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        found, texts = [], []
        for lo, hi, offset, data, bounds in parts(batch.column(2)):
            starts, low, text, sums = minimizers(data, bounds)
            own = values[list_ends[lo] : list_ends[hi]]
            owner = np.repeat(np.arange(hi - lo), np.diff(list_ends[lo : hi + 1]))
            if not len(starts) or not len(own):
                continue
            salt = mix64(np.arange(hi - lo, dtype=np.uint64))
            wanted = np.unique(own ^ salt[owner])
            edge = np.ones(len(low) + 1, dtype=bool)
            edge[1:-1] = (low[1:] != low[:-1]) | (text[1:] != text[:-1])
            cuts = np.flatnonzero(edge)
            first, last = cuts[:-1], cuts[1:] - 1
            asked = (low[first] & ~_LOW) ^ salt[text[first]]
            at = np.minimum(np.searchsorted(wanted, asked), len(wanted) - 1)
            keep = wanted[at] == asked
            first, last = first[keep], last[keep]
            if not len(first):
                continue
            begin, end = starts[first], starts[last] + LENGTH
            of = text[first]
            piece = mix64((sums[end] - sums[begin]) * _POWERS[1][begin] + (end - begin).astype(np.uint64))
            found.append((of + lo, begin - bounds[of] + offset, low[first] & ~_LOW, piece, begin, end, np.full(len(of), len(texts))))
            texts.append(data)
        if not found:
            continue
        row, at, key, piece, begin, end, part = (np.concatenate(x) for x in zip(*found, strict=True))
        doc = ids[row]
        order = np.lexsort((doc, piece, key))
        new = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (piece[order][1:] != piece[order][:-1])))
        heads = np.flatnonzero(new)
        carrier = order[heads]
        low_doc, high_doc = doc[carrier], doc[order[np.append(heads[1:], len(order)) - 1]]
        lows, highs = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        lows[carrier], highs[carrier] = low_doc, high_doc
        carries = np.zeros(len(row), dtype=bool)
        carries[carrier] = True
        pieces = [texts[p][a:b].tobytes() if c else None for p, a, b, c in zip(part.tolist(), begin.tolist(), end.tolist(), carries.tolist(), strict=True)]
        columns = [
            batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(at.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)),
            pa.array(lows, mask=~carries), pa.array(highs, mask=~carries), pa.array(pieces, pa.binary()),
        ]
        whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "t", "at", "key", "piece_id", "low", "high", "piece"])
        for lo in range(0, len(row), 1 << 15):
            yield whole.slice(lo, 1 << 15)


def suffix_order(data: np.ndarray, bounds: np.ndarray, of: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of the suffixes at ``offset`` of the stretches ``of``, and the suffixes in its order as words."""
    sizes = np.diff(bounds)
    room = np.zeros(len(sizes) * ROOM, np.uint8)
    room[np.arange(len(data)) + np.repeat(np.arange(len(sizes)) * ROOM - bounds[:-1], sizes)] = data
    suffixes = np.lib.stride_tricks.sliding_window_view(room, WIDTH)[of * ROOM + offset]
    order = np.argsort(suffixes.view(f"S{WIDTH}").ravel(), kind="stable")
    return order, suffixes.view(">u8")[order].astype(np.uint64)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 without one.

    A place that points to a value not smaller takes over that place's pointer, all at once, until none is left.
    """
    at = np.arange(len(values)) - 1
    left = np.flatnonzero(at >= 0)
    while len(left):
        left = left[values[at[left]] >= values[left]]
        at[left] = at[at[left]]
        left = left[at[left] >= 0]
    return at


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The same to the other side, the number of values without one."""
    return len(values) - 1 - previous_smaller(values[::-1])[::-1]


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes ``a`` and ``b`` have in common from their beginnings."""
    differ = words[a] ^ words[b]
    word = np.argmax(differ != 0, axis=1)
    rest = differ[np.arange(len(differ)), word]
    zeros = np.zeros(len(rest), np.int64)
    for bits in (32, 16, 8):
        none = (rest >> np.uint64(64 - bits)) == 0
        zeros += none * (bits // 8)
        rest = np.where(none, rest << np.uint64(bits), rest)
    return np.where(rest == 0, WIDTH, word * 8 + zeros)


def longest_previous(words: np.ndarray, docs: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of suffixes in order: the longest previous factor, where it is ``LENGTH`` or more, else 0; and a document with it.

    ``docs``: each suffix's smallest document; ``length``: its bytes.
    """
    n = len(docs)
    factor, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole, rest = LENGTH // 8, np.uint64(64 - LENGTH % 8 * 8)
    same = (words[1:, :whole] == words[:-1, :whole]).all(axis=1) & ((words[1:, whole] ^ words[:-1, whole]) >> rest == 0)
    run = np.concatenate(([0], np.cumsum(~same)))
    for side in (previous_smaller(docs), next_smaller(docs)):
        # beyond a run of suffixes that begin alike the common prefix is below LENGTH
        mine = np.flatnonzero((side >= 0) & (side < n))
        mine = mine[run[side[mine]] == run[mine]]
        other = side[mine]
        common = np.minimum(common_prefix(words, mine, other), np.minimum(length[mine], length[other]))
        better = common > factor[mine]
        factor[mine[better]], source[mine[better]] = common[better], docs[other[better]]
    return factor, source


_REPEAT = pa.schema([("key", pa.int64()), ("piece_id", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("first", pa.int64())])


def _resolve(keys: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Repeated parts of stretches, sorted by key: (key, piece_id, a, b, first), first being an earlier document with it."""
    sizes = np.diff(bounds)
    # a stretch that several documents have is a copy as a whole in all but the first
    several = np.flatnonzero(low < high)
    yield pa.RecordBatch.from_arrays([pa.array(keys[several]), pa.array(ids[several]), pa.array(np.zeros(len(several), np.int32)), pa.array(sizes[several].astype(np.int32)), pa.array(low[several])], schema=_REPEAT)
    # the only stretch of its minimizer has no other to be compared with
    same = keys[1:] == keys[:-1]
    rows = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    if not len(rows):
        return
    take = np.arange(int(sizes[rows].sum())) + np.repeat(bounds[rows] - np.concatenate(([0], np.cumsum(sizes[rows])[:-1])), sizes[rows])
    data, sizes = data[take], sizes[rows]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    windows = sizes - LENGTH + 1
    of = np.repeat(np.arange(len(rows)), windows)
    stops = np.cumsum(windows)
    offset = np.arange(int(stops[-1])) - np.repeat(stops - windows, windows)
    order, words = suffix_order(data, bounds, of, offset)
    factor, first = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
    factor[order], first[order] = longest_previous(words, low[rows][of[order]], (sizes[of] - offset)[order])
    # neighbouring windows with an earlier copy each make one part
    hit = factor > 0
    edge = np.ones(len(of) + 1, dtype=bool)
    edge[1:-1] = (of[1:] != of[:-1]) | (hit[1:] != hit[:-1]) | (first[1:] != first[:-1])
    cuts = np.flatnonzero(edge)
    a, b = cuts[:-1], cuts[1:] - 1
    a, b = a[hit[a]], b[hit[a]]
    owner = rows[of[a]]
    yield pa.RecordBatch.from_arrays([pa.array(keys[owner]), pa.array(ids[owner]), pa.array(offset[a].astype(np.int32)), pa.array((offset[b] + factor[b]).astype(np.int32)), pa.array(first[a])], schema=_REPEAT)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct stretches (key, piece_id, low, high, piece), sorted by key: their repeated parts.

    A suffix array is closed at the first new key after ``STRETCHES`` bytes.
    """
    held: list[tuple] = []
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*held, strict=True)]
        yield from _resolve(*columns[:4], columns[4], np.concatenate(([0], np.cumsum(columns[5]))))

    for batch in batches:
        columns = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in range(4)]
        data, bounds = text_buffers(batch.column(4))
        key, at = columns[0], 0
        while at < batch.num_rows:
            full = int(np.searchsorted(bounds[at + 1 :] - bounds[at] + size, STRETCHES)) + at
            # the first row of another key than the row that fills the array
            last = held[-1][0][-1] if size >= STRETCHES else key[full] if full < batch.num_rows else None
            begin = at if size >= STRETCHES else full
            new = begin + int(np.argmax(key[begin:] != last)) if last is not None and key[-1] != last else None
            end = batch.num_rows if new is None else new
            if end > at:
                held.append((*[c[at:end] for c in columns], data[bounds[at] : bounds[end]], np.diff(bounds[at : end + 1])))
                size += int(bounds[end] - bounds[at])
            at = end
            if new is not None:
                yield from close()
                held, size = [], 0
    if held:
        yield from close()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text, copy, cuts): bytes, removed bytes and runs, digest of the rest, and the spans."""
    for batch in batches:
        data, bounds = text_buffers(batch.column(1))
        rows: list[tuple] = []
        for i, (copy, cuts) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            text = data[bounds[i] : bounds[i + 1]]
            spans = []
            if copy:
                spans = [(0, len(text))] if len(text) >= LENGTH else []
            else:
                for c in sorted(cuts or [], key=lambda c: (c["a"], c["b"])):
                    if spans and c["a"] <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], c["b"]))
                    else:
                        spans.append((c["a"], c["b"]))
            digest, at = hashlib.sha256(), 0
            for a, b in spans:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            rows.append((len(text), sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans) for each row of ``docs`` (doc_id, text).

    ``spans``: the maximal removed runs as UTF-8 byte offsets.  Null texts are empty; texts under ``LENGTH`` bytes lose
    nothing; rows of one doc_id don't count as repeats of each other; rows with a null doc_id neither lose bytes nor take
    them from others.  Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
    digests = written(rows.select("doc_id", "t", F.md5("text").alias("digest")).where("doc_id is not null"), "digests")
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("rows")).where("last > first").drop("last")
    copies = written(join_counted(digests, firsts, "digest").where("doc_id > first").select("doc_id", "t", F.lit(True).alias("copy")).distinct(), "copies")
    asked = rows.where("doc_id is not null").mapInArrow(_asked(4 * n), "bucket int, packed binary")
    shared = asked.repartition(n, "bucket").mapInArrow(_answered, "doc_id long, t long, key long")
    keys = written(shared.groupBy("doc_id", "t").agg(F.collect_list("key").alias("keys")), "minimizers")
    flagged = rows.join(keys.join(copies, ["doc_id", "t"], "left_anti"), ["doc_id", "t"])
    pieces = flagged.select("doc_id", "t", "text", "keys").mapInArrow(_stretches, "doc_id long, t long, at int, key long, piece_id long, low long, high long, piece binary")
    pieces = written(pieces, "pieces")
    found = written(_found(pieces, n), "repeats")
    cuts = pieces.select("key", "piece_id", "doc_id", "t", "at").join(found, ["key", "piece_id"]).where("doc_id > first")
    cuts = written(cuts.groupBy("doc_id", "t").agg(F.collect_list(F.struct((F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))).alias("cuts")), "cuts")
    marks = cuts.join(copies, ["doc_id", "t"], "full_outer")
    joined = rows.join(marks, ["doc_id", "t"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "cuts")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")


def _found(pieces: DataFrame, n: int) -> DataFrame:
    """The repeated parts of ``pieces``, by (key, piece_id), as ``_resolve`` gives them."""
    columns = ["key", "piece_id", "low", "high", "piece"]
    parts = "key long, piece_id long, a int, b int, first long"
    near = pieces.where("piece is not null").select(*columns)

    def resolved(rows: DataFrame) -> DataFrame:
        # equal stretches have come together by batch; here they do by minimizer, in the exchange that the suffix arrays need
        distinct = rows.repartition(n, "key").groupBy("key", "piece_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("piece").alias("piece"))
        return distinct.select(*columns).sortWithinPartitions("key").mapInArrow(_resolved, parts)

    hot = written(near.groupBy(F.col("key").alias("hot")).count().where(F.col("count") > MOST).select("hot"), "hot")
    count = hot.count()
    if not count:
        return resolved(near)
    hot = F.broadcast(hot) if count <= FEW_KEYS else hot
    cold = resolved(near.join(hot, F.col("key") == F.col("hot"), "left_anti"))
    most = near.join(hot, F.col("key") == F.col("hot"), "left_semi")
    most = written(most.groupBy("key", "piece_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("piece").alias("piece")), "hot-pieces")
    window = F.expr(f"substring(piece, at + 1, {LENGTH})")
    each = most.withColumn("at", F.explode(F.sequence(F.lit(0), F.octet_length("piece") - LENGTH))).withColumn("window", window).withColumn("own", F.xxhash64("window"))
    alone = each.select(F.col("own").alias("key"), F.col("own").alias("piece_id"), "low", "high", F.col("window").alias("piece"))
    # windows are spread as evenly as their hashes, and equal ones are one row after the tasks' own reduction
    alone = alone.groupBy("key", "piece_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("piece").alias("piece"))
    windows = alone.select(*columns).sortWithinPartitions("key").mapInArrow(_resolved, parts)
    # what a stretch is cut into is many times larger than the estimate by the table of stretches, so nothing is broadcast
    back = each.select("key", "piece_id", "at", "own").join(windows.select(F.col("key").alias("own"), "first").hint("merge"), "own")
    return cold.unionByName(back.select("key", "piece_id", F.col("at").alias("a"), (F.col("at") + LENGTH).alias("b"), "first"))
