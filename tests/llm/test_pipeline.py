"""The pipeline on the smallest tables: each stage's rows against plain Python, stage by stage."""

import hashlib
import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from tsqlspark.llm import quality
from tsqlspark.llm.common import written

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))


def classes(texts):
    """Of (doc_id, text) rows: each document's class by all pairs."""
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i, _ in texts}
    for n, (i, a) in enumerate(texts):
        for j, b in texts[:n]:
            if a == b or sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def without_windows(text, windows):
    """The text without the hit spans, None if two items or more are hit."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    w, hit, items = words(text), set(), set()
    for k in range(len(w)):
        for size in {len(x) for x in windows}:
            found = windows.get(tuple(w[k : k + size]))
            if found:
                items |= found
                hit |= set(range(k, k + size))
    if len(items) >= 2:
        return None
    out, at = "", 0
    for k in range(len(w)):
        if k in hit and k - 1 not in hit:
            out += text[at : spans[k][0]]
        if k in hit:
            at = spans[k][1]
    return out + (text or "")[at:] if hit else text


def copies(rows):
    """How often each of (doc_id, text, source) is taken."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    total = Counter()
    for i, _, s in rows:
        total[s] += size[i]
    order = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, capped = 1.5 * sum(total.values()), set()
    while True:
        level = (goal - sum(2 * total[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * level >= 2 * total[s]}
        if not over:
            break
        capped |= over
    out = {}
    for i, _, s in rows:
        rate = (2 * total[s] if s in capped else weight[s] * level) / total[s] if total[s] else 0
        out[i] = int(rate) + (int(hashlib.md5(f"{i}:0".encode()).hexdigest()[:8], 16) / 2**32 < rate % 1)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        kept[name] = docs
        if name != "sharding":
            assert docs.columns == columns
    rows = {k: v.collect() for k, v in kept.items()}
    text = {k: {r.doc_id: r.text for r in v} for k, v in rows.items()}

    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    # a few toxic documents among so few labels are too few to learn from
    right = [(i in text["quality_classifier"]) == (good == 1) for i, (good, toxic) in labels.items() if i in text["documents"] and not toxic]
    assert sum(right) >= 0.95 * len(right)
    model = quality.fit(kept["documents"], spark.read.parquet(f"{SF}/labels.parquet"))
    scores = quality.scored(kept["documents"], model).collect()
    assert {r.doc_id for r in scores if r.quality_score >= 0.5 and r.toxic_score < 0.5} == set(text["quality_classifier"])
    assert all(t == text["documents"][i] for i, t in text["quality_classifier"].items())

    root = classes(sorted(text["quality_classifier"].items()))
    assert text["near_dedup"] == {i: text["documents"][i] for i in set(root.values())}

    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = words(r.text)
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(r.item_id)
    cut = {i: without_windows(t, windows) for i, t in text["near_dedup"].items()}
    assert text["decontamination"] == {i: t for i, t in cut.items() if t is not None}
    assert all(r.n_chars == len(r.text) for r in rows["decontamination"])

    want = copies([(r.doc_id, r.text, r.source) for r in rows["decontamination"]])
    assert Counter(r.doc_id for r in rows["mixing"]) == Counter({i: n for i, n in want.items() if n})
    assert text["mixing"] == {i: text["decontamination"][i] for i, n in want.items() if n}

    last = rows["sharding"]
    assert kept["sharding"].columns == [*columns, "shard", "slot"]
    assert Counter((r.doc_id, r.text) for r in last) == Counter((r.doc_id, r.text) for r in rows["mixing"])
    size = Counter()
    for k in range(8):
        assert sorted(r.slot for r in last if r.shard == k) == list(range(sum(r.shard == k for r in last)))
        size[k] = sum(len(r.text.encode()) + 1 for r in last if r.shard == k)
    share = sum(size.values()) / 8
    assert max(abs(v - share) for v in size.values()) <= 0.01 * share + 2 * max(len(r.text.encode()) for r in last)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert docs.count() == 0


def test_nulls_and_repeats(spark):
    """Null texts, languages, sources and ids, and repeated rows pass every stage."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(900001, None, None, None, None), (None, "no id at all", "en", "a", 12), (None, None, None, None, None), (900002, "", "", "", 0)], base.schema)
    docs = base.unionByName(odd).unionByName(base.limit(5))
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
    assert docs.count() > 100
