"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents that one task has read (bounded by ``SHARD_SYMBOLS``).  Its words become symbols of the
benchmark's vocabulary; a word outside that vocabulary can't be part of a match, so only runs of in-vocabulary words
that are at least as long as the shortest window are indexed, apart by separators.  The index is the Burrows-Wheeler
transform of that sequence with ranks in a wavelet matrix; all windows of the benchmark are searched backwards at once,
and occurrences are located by walking to the nearest sampled suffix position.  Overlapping occurrences merge into the
spans to remove.  Documents are neither shuffled nor collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, scan_words, written

WINDOW = 8
#: Indexed symbols and text bytes after which a shard is closed.
SHARD_SYMBOLS, SHARD_BYTES = 1 << 21, 1 << 25
#: Every so manieth suffix position is kept.
SAMPLE = 8
#: Benchmark text that is sent to the tasks at a time; a larger benchmark is searched in blocks, one pass each.  The
#: patterns of a block take about ten times its bytes, in the driver and in each task.
BLOCK_BYTES = 1 << 22

END, BREAK = 0, 1  # the smallest symbols; vocabulary follows


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the last symbol must be the single smallest."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        key = rank * np.int64(n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector a level."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int64))))
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate((now[bit == 0], now[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each ``symbol`` before position ``upto``."""
        low = np.zeros_like(upto)
        for i, level in enumerate(range(self.depth - 1, -1, -1)):
            ones, one = self.ones[i], ((symbol >> level) & 1).astype(bool)
            upto = np.where(one, self.zeros[i] + ones[upto], upto - ones[upto])
            low = np.where(one, self.zeros[i] + ones[low], low - ones[low])
        return upto - low


class FMIndex:
    def __init__(self, symbols: np.ndarray, size: int):
        order = suffix_array(symbols)
        self.bwt = symbols[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(symbols, minlength=size))))
        self.tree = WaveletMatrix(self.bwt, size)
        self.sampled = order % SAMPLE == 0
        self.sample_rank = np.concatenate(([0], np.cumsum(self.sampled)))
        self.samples = order[self.sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffix array that begin with each pattern (a row of ``patterns``)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), len(self.bwt), np.int64)
        live = np.arange(len(patterns))
        for i in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, i]
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.sampled[at])
        while len(open_):
            c = self.bwt[at[open_]]
            at[open_] = self.before[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
            open_ = open_[~self.sampled[at[open_]]]
        return self.samples[self.sample_rank[at]] + steps


class Windows:
    """The windows of a block of benchmark items as symbol sequences, and the items that each belongs to."""

    def __init__(self, ids: list[int], texts: list[str], width: int):
        column = pa.array(texts, pa.large_string())
        hashes, counts = [], []
        for _, _, data, bounds in chunks(column):
            _, _, words, first = scan_words(data, bounds)
            hashes.append(words)
            counts.append(np.diff(first))
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        symbols = symbols.astype(np.int64) + 2
        self.ids = np.array(sorted(set(ids)), np.int64)
        item = np.searchsorted(self.ids, np.array(ids, np.int64))
        first = np.concatenate(([0], np.cumsum(counts)))
        of_word = np.repeat(np.arange(len(counts)), counts)
        begins = np.arange(len(symbols))
        length = np.minimum(counts, width)[of_word]
        ok = begins + length <= first[1:][of_word]
        self.groups = []  # (patterns, index of each pattern's items, items)
        for size in np.unique(length[ok]):
            mine = begins[ok & (length == size)]
            patterns, of = np.unique(symbols[mine[:, None] + np.arange(size)], axis=0, return_inverse=True)
            pairs = np.unique(np.stack((of.ravel(), item[of_word[mine]]), axis=1), axis=0)
            self.groups.append((patterns, np.searchsorted(pairs[:, 0], np.arange(len(patterns) + 1)), pairs[:, 1]))
        self.shortest = min((g[0].shape[1] for g in self.groups), default=0)
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """Symbols of word hashes; ``BREAK`` outside the vocabulary."""
        out = np.full(len(words), BREAK, np.int64)
        maybe = np.flatnonzero(self.filter[(words & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, words[maybe])
        at[at == len(self.vocabulary)] = 0
        found = self.vocabulary[at] == words[maybe] if len(self.vocabulary) else np.zeros(0, bool)
        out[maybe[found]] = at[found] + 2
        return out


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and the range each is of."""
    sizes = high - low
    of = np.repeat(np.arange(len(low)), sizes)
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + low[of], of


class Shard:
    """Documents read so far, reduced to the runs that may hold a window."""

    def __init__(self, windows: Windows):
        self.windows, self.docs, self.n_words = windows, 0, []
        self.parts, self.size = [], 0

    def add(self, column: pa.Array) -> None:
        w = self.windows
        for _, _, data, bounds in chunks(column):
            starts, ends, words, first = scan_words(data, bounds)
            counts = np.diff(first)
            symbols = w.symbols(words)
            doc = np.repeat(np.arange(len(counts)), counts)
            # runs of in-vocabulary words of one document
            known = symbols != BREAK
            edge = np.ones(len(symbols) + 1, dtype=bool)
            if len(symbols):
                edge[1:-1] = (known[1:] != known[:-1]) | (doc[1:] != doc[:-1])
            cuts = np.flatnonzero(edge)
            long = known[cuts[:-1]] & (np.diff(cuts) >= max(1, w.shortest)) if len(symbols) else np.zeros(0, bool)
            at, of = _expand(cuts[:-1][long], cuts[1:][long])
            # a separator before each run
            begins = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
            self.parts.append((np.insert(symbols[at], begins, BREAK), np.insert(doc[at] + self.docs, begins, -1), np.insert(starts[at] - bounds[doc[at]], begins, -1), np.insert(ends[at] - bounds[doc[at]], begins, -1)))
            self.size += len(self.parts[-1][0])
            self.docs += len(counts)
            self.n_words.append(counts)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_words and n_hit per document; (document, item id) pairs; (document, start, end) spans in bytes."""
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        symbols, doc, start, end = (np.concatenate(x) if self.parts else np.zeros(0, np.int64) for x in (zip(*self.parts) if self.parts else [()] * 4))
        none = np.zeros((0, 2), np.int64)
        if not self.size or not self.windows.groups:
            return n_words, np.zeros(self.docs, np.int64), none, np.zeros((0, 3), np.int64)
        index = FMIndex(np.append(symbols, END), len(self.windows.vocabulary) + 2)
        cover = np.zeros(len(symbols) + 1, np.int64)
        pairs = [none]
        for patterns, offsets, items in self.windows.groups:
            rows, of = _expand(*index.search(patterns))
            if not len(rows):
                continue
            at = index.locate(rows)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + patterns.shape[1], -1)
            seen = np.unique(np.stack((doc[at], of), axis=1), axis=0)
            at, of = _expand(offsets[seen[:, 1]], offsets[seen[:, 1] + 1])
            pairs.append(np.unique(np.stack((seen[of, 0], self.windows.ids[items[at]]), axis=1), axis=0))
        hit = np.cumsum(cover[:-1]) > 0
        n_hit = np.bincount(doc[hit], minlength=self.docs)
        # spans never cross a separator, which is never hit
        edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
        return n_words, n_hit, np.unique(np.concatenate(pairs), axis=0), np.stack((doc[a], start[a], end[b]), axis=1)


def _lists(docs: int, keys: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(keys, np.arange(docs + 1)), pa.int32()), values)


_FOUND = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int>>"


def _pass(docs: DataFrame, windows: Windows) -> DataFrame:
    """``docs`` (all columns) with what one block of the benchmark finds in ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)  # its text is BLOCK_BYTES at most, or one longer item

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, shard = [], 0, Shard(shared.value)

        def close() -> Iterator[pa.RecordBatch]:
            n_words, n_hit, pairs, spans = shard.found()
            k = shard.docs
            spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
            ends = pa.StructArray.from_arrays([pa.array(spans[:, 1], pa.int32()), pa.array(spans[:, 2], pa.int32())], names=["start", "end"])
            out = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), _lists(k, pairs[:, 0], pa.array(pairs[:, 1], pa.int64())), _lists(k, spans[:, 0], ends)]
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns, *[c.slice(at, b.num_rows) for c in out]], names=[*b.schema.names, "n_words", "n_hit", "items", "spans"])
                at += b.num_rows

        for batch in batches:
            shard.add(batch.column(batch.schema.get_field_index("text")))
            held.append(batch)
            size += batch.nbytes
            if shard.size >= SHARD_SYMBOLS or size >= SHARD_BYTES:
                yield from close()
                held, size, shard = [], 0, Shard(shared.value)
        if held:
            yield from close()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(search, f"{fields}, {_FOUND}")


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    ids, texts, size = [], [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    for item, text in rows.toLocalIterator():
        ids.append(item)
        texts.append(text)
        size += len(text.encode())
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items and spans.

    ``items``: ids of the benchmark items of which a window occurs, in ascending order.  ``spans``: merged removal spans
    as UTF-8 byte offsets into the text.  Null texts have no words; null item ids and texts are passed over; items that
    repeat an id count once; an item of fewer than ``width`` words is one window.  Rows that repeat a document are rows
    of their own.  ``docs`` may have any other columns but the four added ones; an empty table on either side is fine.
    """
    taken = {"n_words", "n_hit", "items", "spans"} & set(docs.columns)
    docs = docs.drop(*taken)
    blocks = _blocks(benchmark, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _pass(docs, Windows(*block, width))
    # one pass a block over the distinct texts, each written before the next block is built; then spans are merged per text
    texts = written(docs.select("text").where("text is not null").distinct(), "texts")
    found = None
    while block is not None:
        one = written(_pass(texts, Windows(*block, width)).where("n_hit > 0").select(F.md5("text").alias("__key"), "items", "spans"), "block")
        found = one if found is None else found.unionByName(one)
        block, following = following, next(blocks, None)
    flat = found.groupBy("__key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    merged = F.expr("aggregate(spans, cast(array() as array<struct<start:int,end:int>>), (a, s) -> if(size(a) > 0 and s.start <= element_at(a, -1).end, concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, s.end) as end))), concat(a, array(s))))")
    flat = flat.withColumn("spans", merged)
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    joined = docs.withColumn("__own", F.md5("text")).join(flat, F.col("__own") == F.col("__key"), "left")
    inside = "aggregate(spans, 0L, (n, s) -> n + regexp_count(decode(substring(encode(text, 'UTF-8'), s.start + 1, s.end - s.start), 'UTF-8'), r'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return joined.select(*docs.columns, F.coalesce(F.regexp_count("text", F.lit(word)), F.lit(0)).cast("long").alias("n_words"), F.coalesce(F.expr(inside), F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.expr("cast(array() as array<long>)")).alias("items"), F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_items: int = 1, width: int = WINDOW) -> DataFrame:
    """The documents that hold windows of at most ``most_items`` items, with the spans of those windows cut out.

    Documents without a hit come back as they are; a cut text gets its new length in ``n_chars``, if there is that column.
    Same columns as ``docs`` (doc_id, text and any others, whatever their names).  Null texts stay; repeated rows are rows
    of their own; an empty table on either side is fine.
    """
    found = contamination(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), benchmark, width).where(F.size("items") <= most_items)
    kept = F.expr("decode(aggregate(reverse(spans), encode(text, 'UTF-8'), (b, s) -> concat(substring(b, 1, s.start), substring(b, s.end + 1))), 'UTF-8')")
    cut = found.select("row", F.when(F.size("spans") > 0, kept).alias("cut"))

    def column(c: str) -> F.Column:
        own = F.col("row")[c]
        if c == "text":
            own = F.coalesce("cut", own)
        elif c == "n_chars":
            own = F.when(F.col("cut").isNotNull(), F.length("cut").cast(docs.schema[c].dataType)).otherwise(own)
        return own.alias(c)

    return cut.select(*[column(c) for c in docs.columns])
