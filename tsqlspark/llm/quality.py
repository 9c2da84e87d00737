"""Quality classifier by co-training two views of a document.

The content view is a logistic regression on what the text says: hashed words, and shares of capitals, digits, symbols
and distinct words.  The metadata view is one on what is known about the page: language, source, lengths and lines.  They
share no feature.  Both start from the labelled rows.  In each round a view labels those rows of an unlabelled pool on
which it is confident - beyond a threshold at which its labels are right for at least ``PRECISION`` of a held-out fold -
and the other view learns from them.  At the end the views are calibrated and combined by a logistic regression on that
fold, and all documents are scored where they lie.  A second fold takes no part in any of this; ``CoTrained.accuracy`` is
the share of its labels that the model gives.

Fitting uses a bounded sample of the rows (``max_labelled`` and ``max_pool`` documents); scoring covers every document
and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, mix64, scan_words

BUCKETS = 1 << 18
LANGS, SOURCES, FIGURES = 16, 32, 12
#: Places of the figures that belong to each view.
OF_CONTENT, OF_PAGE = [0, 1, 2, 3, 5, 6, 9, 10, 11], [4, 7, 8]
META = LANGS + SOURCES + FIGURES
ROUNDS, PRECISION, RIDGE = 3, 0.98, 0.3
TARGETS = ("quality", "toxic")


def _class_table(kind: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    codes = {"upper": range(65, 91), "digit": range(48, 58), "symbol": [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'"], "bang": [33], "line": [10], "space": [32, 9], "high": range(128, 256)}[kind]
    table[list(codes)] = 1
    return table


_CLASSES = [_class_table(k) for k in ("upper", "digit", "symbol", "bang", "line", "space", "high")]


def _hash_name(values: pa.Array, size: int) -> np.ndarray:
    """Each value's bucket by its bytes; null is a value of its own."""
    known: dict = {}
    out = np.zeros(len(values), np.int64)
    for i, v in enumerate(values.to_pylist()):
        if v not in known:
            h = 7
            for b in (str(v) if v is not None else "\0null").encode():
                h = (h * 1099511628211 + b) % 2**64
            known[v] = int(mix64(np.array([h], np.uint64))[0] % np.uint64(size))
        out[i] = known[v]
    return out


def features(data: np.ndarray, bounds: np.ndarray, lang: pa.Array, source: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed distinct words (buckets, offsets per text) and the metadata matrix of a run of texts."""
    docs = len(bounds) - 1
    starts, ends, words, first = scan_words(data, bounds)
    counts = np.diff(first)
    doc = np.repeat(np.arange(docs), counts)
    keys = np.unique(doc * BUCKETS + (words & np.uint64(BUCKETS - 1)).astype(np.int64))
    offsets = np.searchsorted(keys, np.arange(docs + 1) * BUCKETS)
    meta = np.zeros((docs, META), np.float32)
    rows = np.arange(docs)
    meta[rows, _hash_name(lang, LANGS)] = 1
    meta[rows, LANGS + _hash_name(source, SOURCES)] = 1
    size = np.diff(bounds)
    some = np.maximum(size, 1)
    figures = meta[:, LANGS + SOURCES :]
    if docs == 1:  # perhaps a very long text
        seen = np.bincount(data, minlength=256)
        figures[0, : len(_CLASSES)] = [np.sqrt(seen @ table / some[0]) for table in _CLASSES]
    else:
        for i, table in enumerate(_CLASSES):
            total = np.concatenate(([0], np.cumsum(table[data])))
            figures[:, i] = np.sqrt((total[bounds[1:]] - total[bounds[:-1]]) / some)
    chars = np.concatenate(([0], np.cumsum(ends - starts)))
    figures[:, 7] = np.log1p(size) / 10
    figures[:, 8] = np.log1p(counts) / 10
    figures[:, 9] = (chars[first[1:]] - chars[first[:-1]]) / np.maximum(counts, 1) / 10
    figures[:, 10] = np.diff(offsets) / np.maximum(counts, 1)
    figures[:, 11] = counts > 0
    return keys % BUCKETS, offsets, meta


@dataclass
class Rows:
    """Feature rows: ``words`` concatenated with offsets ``at``; ``meta``."""

    words: np.ndarray
    at: np.ndarray
    meta: np.ndarray

    def __len__(self) -> int:
        return len(self.meta)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.at[rows + 1] - self.at[rows]
        ends = np.cumsum(sizes)
        pick = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(self.at[rows], sizes)
        return Rows(self.words[pick], np.concatenate(([0], ends)), self.meta[rows])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[at[1:]] - total[at[:-1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class ContentView:
    """Logistic regression on distinct hashed words.

    A word's weight starts from its smoothed log-odds, damped for rare words; scales and a bias are then fitted: the sum of
    weights over the square root of the number of words, the sum of the clearly telling weights alone, and the figures.
    """

    def __init__(self, rows: Rows, y: np.ndarray):
        doc = np.repeat(np.arange(len(rows)), np.diff(rows.at))
        pos = np.bincount(rows.words, weights=y[doc], minlength=BUCKETS)
        neg = np.bincount(rows.words, weights=1 - y[doc], minlength=BUCKETS)
        n_pos, n_neg = max(1.0, y.sum()), max(1.0, (1 - y).sum())
        odds = np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1))
        # deviation from chance in standard errors: words that appear in few rows say little
        share = n_pos / (n_pos + n_neg)
        seen = pos + neg
        z = (pos - seen * share) / np.sqrt(np.maximum(seen * share * (1 - share), 1e-9) + 1)
        self.weight = (odds * (np.abs(z) > 2)).astype(np.float32)
        self.telling = (odds * (np.abs(z) > 6)).astype(np.float32)
        self.head = Logistic(self.inputs(rows), y, ridge=RIDGE)

    def inputs(self, rows: Rows) -> np.ndarray:
        n = np.maximum(np.diff(rows.at), 1)
        figures = rows.meta[:, [LANGS + SOURCES + f for f in OF_CONTENT]].astype(np.float64)
        return np.column_stack((_sums(self.weight[rows.words], rows.at) / np.sqrt(n), np.clip(_sums(self.telling[rows.words], rows.at), -30, 30) / 10, figures))

    def logit(self, rows: Rows) -> np.ndarray:
        return self.head.logit(self.inputs(rows))


class Logistic:
    """Dense logistic regression by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25):
        self.mean = x.mean(axis=0)
        self.scale = x.std(axis=0) + 1e-6
        z = np.column_stack(((x - self.mean) / self.scale, np.ones(len(x))))
        w = np.zeros(z.shape[1])
        for _ in range(steps):
            p = _sigmoid(z @ w)
            penalty = np.full(len(w), ridge * len(x) ** 0.5)
            penalty[-1] = 1e-6
            grad = z.T @ (p - y) + penalty * w
            hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hess, grad)
            w -= step
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


class PageView:
    """Logistic regression on language, source, lengths and lines."""

    def __init__(self, rows: Rows, y: np.ndarray):
        self.head = Logistic(self.inputs(rows), y, ridge=RIDGE)

    def inputs(self, rows: Rows) -> np.ndarray:
        figures = rows.meta[:, [LANGS + SOURCES + f for f in OF_PAGE]].astype(np.float64)
        return np.column_stack((rows.meta[:, : LANGS + SOURCES], figures, figures**2))

    def logit(self, rows: Rows) -> np.ndarray:
        return self.head.logit(self.inputs(rows))


def _confident(logit: np.ndarray, y: np.ndarray, positive: bool, least: int = 10) -> float:
    """The loosest logit beyond which held-out labels of the given sign are right for ``PRECISION``; inf if none is."""
    sign = 1 if positive else -1
    order = np.argsort(-sign * logit)
    right = np.cumsum(y[order] == (1 if positive else 0)) / np.arange(1, len(y) + 1)
    ok = np.flatnonzero(right >= PRECISION)
    ok = ok[ok >= least - 1]
    return sign * logit[order[ok[-1]]] if len(ok) else np.inf


class CoTrained:
    """The two views of one target and their combination."""

    def __init__(self, rows: Rows, y: np.ndarray, fold: np.ndarray, pool: Rows, rounds: int = ROUNDS):
        """``fold``: 0 for rows to learn from, 1 for those that thresholds and the combination are fitted on, 2 for the test."""
        fit, test = np.flatnonzero(fold == 0), np.flatnonzero(fold == 1)
        train, check = rows.take(fit), rows.take(test)
        y_fit, y_test = y[fit].astype(np.float64), y[test].astype(np.float64)
        views = [ContentView(train, y_fit), PageView(train, y_fit)]
        self.exchanged = [0, 0]
        for _ in range(rounds):
            lent = []
            for view in views:
                score, own = view.logit(pool), view.logit(check)
                high, low = _confident(own, y_test, True), _confident(own, y_test, False)
                lent.append((np.flatnonzero((score >= high) | (-score >= low)), score >= high))
            learned = []
            for kind, (picked, label), k in ((ContentView, lent[1], 0), (PageView, lent[0], 1)):
                more = pool.take(picked)
                both = Rows(np.concatenate((train.words, more.words)), np.concatenate((train.at, more.at[1:] + train.at[-1])), np.concatenate((train.meta, more.meta)))
                learned.append(kind(both, np.concatenate((y_fit, label[picked].astype(np.float64)))))
                self.exchanged[k] = len(picked)
            views = learned
        self.views = views
        self.combined = Logistic(self._pair(check), y_test)
        last = np.flatnonzero(fold == 2)
        self.tested = len(last)
        self.accuracy = float(np.mean((self.probability(rows.take(last)) >= 0.5) == y[last])) if len(last) else None

    def _pair(self, rows: Rows) -> np.ndarray:
        return np.stack([v.logit(rows) for v in self.views], axis=1)

    def probability(self, rows: Rows) -> np.ndarray:
        return _sigmoid(self.combined.logit(self._pair(rows)))


_FEATURES = "key long, label_quality int, label_toxic int, words array<int>, meta array<float>"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, lang, source = (batch.column(i) for i in (3, 4, 5))
        for lo, hi, data, bounds in chunks(text):
            words, at, meta = features(data, bounds, lang.slice(lo, hi - lo), source.slice(lo, hi - lo))
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(words, pa.int32())), pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * META, pa.int32()), pa.array(meta.ravel(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(lo, hi - lo) for i in range(3)], *lists], names=["key", "label_quality", "label_toxic", "words", "meta"])


def _collected(df: DataFrame) -> tuple[np.ndarray, Rows]:
    t = df.mapInArrow(_featured, _FEATURES).orderBy("key").toArrow().combine_chunks()
    words = t["words"].combine_chunks() if t.num_rows else None
    if words is None:
        return np.zeros((0, 3), np.int64), Rows(np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros((0, META), np.float32))
    keys = np.stack([np.asarray(t[c].to_numpy(), np.int64) for c in ("key", "label_quality", "label_toxic")], axis=1)
    sizes = np.diff(words.offsets.to_numpy().astype(np.int64))
    return keys, Rows(words.flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(sizes))), t["meta"].combine_chunks().flatten().to_numpy().reshape(-1, META))


def _pick(share: float) -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 8000, max_pool: int = 4000) -> dict[str, CoTrained]:
    """Co-trained models by target, from at most about ``max_labelled`` labelled and ``max_pool`` unlabelled documents.

    Rows are taken by the hash of their id, so reruns agree.  Labels of a document that disagree are averaged and
    rounded; null labels are passed over.  A target with one class only, or with fewer than 20 rows, gets no model.
    """
    ids = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("int").alias("label_quality"), F.round(F.avg("toxic")).cast("int").alias("label_toxic"))
    base = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    # labels of ids outside the documents count for neither
    there = base.select("doc_id").distinct().join(ids.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    n_docs, n_labels = there.agg(F.count("*"), F.count("known")).first()
    some = ids.where(_pick(min(1.0, max_labelled / max(1, n_labels))))
    columns = ["doc_id", "label_quality", "label_toxic", "text", "lang", "source"]
    known = base.where(_pick(min(1.0, max_labelled / max(1, n_labels)))).join(some, "doc_id").dropDuplicates(["doc_id"]).select(*columns)
    share = min(1.0, max_pool / max(1, n_docs - n_labels))
    open_ = base.where(_pick(share)).join(ids.where(_pick(share)), "doc_id", "left_anti").dropDuplicates(["doc_id"])
    keys, rows = _collected(known)
    _, pool = _collected(open_.withColumn("label_quality", F.lit(0)).withColumn("label_toxic", F.lit(0)).select(*columns))
    # twelve, three and one of sixteen
    fold = np.array([1, 0, 0, 0] * 3 + [2, 0, 0, 0])[(mix64(keys[:, 0].astype(np.uint64) + np.uint64(17)) % np.uint64(16)).astype(np.int64)]
    models = {}
    for i, target in enumerate(TARGETS, 1):
        y = keys[:, i]
        if len(y) >= 20 and all(0 < y[part].sum() < part.sum() for part in (fold == 0, fold == 1)):
            models[target] = CoTrained(rows, y, fold, pool)
    return models


def scored(docs: DataFrame, models: dict[str, CoTrained]) -> DataFrame:
    """``docs`` (all columns; doc_id, text, lang, source among them) with ``quality_score`` and ``toxic_score``.

    Scores are probabilities; without a model a document's quality is 1 and its toxicity 0.  Null texts, languages and
    sources are values of their own.
    """
    docs = docs.drop("quality_score", "toxic_score")
    names = docs.columns
    where = [names.index(c) for c in ("text", "lang", "source")]
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a few arrays of BUCKETS numbers

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lang, source = (batch.column(i) for i in where)
            for lo, hi, data, bounds in chunks(text):
                rows = Rows(*features(data, bounds, lang.slice(lo, hi - lo), source.slice(lo, hi - lo)))
                out = []
                for target, default in zip(TARGETS, (1.0, 0.0), strict=True):
                    model = shared.value.get(target)
                    out.append(pa.array(model.probability(rows) if model else np.full(hi - lo, default)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns], *out], names=[*names, "quality_score", "toxic_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{fields}, quality_score double, toxic_score double")


def classified(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.5, **bounds: int) -> DataFrame:
    """``docs`` with quality_score, toxic_score and ``keep``."""
    return scored(docs, fit(docs, labels, **bounds)).withColumn("keep", (F.col("quality_score") >= least_quality) & (F.col("toxic_score") < most_toxic))
