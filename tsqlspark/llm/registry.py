"""The ``opN_<name>`` queries: thin contracts over the operators of this subpackage, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fingerprints, licenses, mixing, near_dedup, pii, quality, repeats, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op3_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    names = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archive_pages(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.classified(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality_score", "toxic_score", "keep")


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_spans": op1_pii_spans,
    "op2_license_scan": op2_license_scan,
    "op3_prob_minhash": op3_prob_minhash,
    "op4_suffix_repeats": op4_suffix_repeats,
    "op5_source_mixing": op5_source_mixing,
    "op6_fm_decontamination": op6_fm_decontamination,
    "op7_spotsigs": op7_spotsigs,
    "op8_arc_to_warc": op8_arc_to_warc,
    "op9_co_training": op9_co_training,
    "op10_histogram_sharding": op10_histogram_sharding,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op3_prob_minhash": f"""
with recursive t as (select coalesce(text, '') as text, min(doc_id) as id from documents group by 1),
w as (select id, {WORDS} as w from t),
s as (select distinct id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w] else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as x from w),
n as (select id, count(*) as n from s group by id),
c as (select a.id as a, b.id as b, count(*) as c from s a join s b on a.x = b.x and a.id < b.id group by 1, 2),
l as (select a, b from c join n na on na.id = a join n nb on nb.id = b where c >= 0.8 * (na.n + nb.n - c)),
e as (select a, b from l union all select b, a from l),
r as (select id, id as root from t union select e.b, r.root from r join e on e.a = r.id),
m as (select id, min(root) as class_id from r group by id)
select doc_id, class_id from documents d join t on t.text = coalesce(d.text, '') join m using (id)""",
    "op4_suffix_repeats": """
with d as (select doc_id, encode(coalesce(text, '')) as b from documents),
h as (select doc_id, octet_length(b)::bigint as n, b, hex(b) as x from d),
g as (select doc_id, i, substr(x, i * 2 + 1, 100) as g from (select doc_id, x, unnest(range(0, greatest(0, n - 49))) as i from h)),
f as (select g, min(doc_id) as first from g group by g),
hit as (select doc_id, i from g join f using (g) where first < doc_id),
edge as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from hit),
run as (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from edge),
span as (select doc_id, k, min(i) as a, max(i) + 50 as b from run group by doc_id, k),
cut as (select doc_id, k, b as kept_from, lead(a) over (partition by doc_id order by k) as kept_to from span
  union all select doc_id, 0, 0, min(a) from span group by doc_id),
kept as (select doc_id, string_agg(substr(x, kept_from * 2 + 1, (coalesce(kept_to, n) - kept_from) * 2), '' order by k) as x from cut join h using (doc_id) group by doc_id),
total as (select doc_id, sum(b - a)::bigint as n_removed, count(*) as n_spans from span group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.x, h.x))) as kept_sha256
from h left join total using (doc_id) left join kept using (doc_id)""",
    "op5_source_mixing": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [3, 1, 2][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight, 2 * source_size as cap from s),
o as (select *, cap / weight as ratio, (select sum(source_size) from s) * 1.5::double as goal from w),
v as (select ratio, (goal - coalesce(sum(cap) over (order by ratio rows between unbounded preceding and 1 preceding), 0)::double)
  / sum(weight) over (order by ratio rows between current row and unbounded following)::double as level from o),
l as (select coalesce((select min(level) from (select level, ratio from v where level < ratio order by ratio limit 1)), 1e300) as level),
t as (select source, source_size, case when weight * level >= cap then cap::double else weight * level end as target from o, l),
r as (select *, case when source_size > 0 then target / source_size else 0 end as rate from t)
select doc_id, size, source_size, target,
  ((floor(rate) + (('0x' || substr(md5(doc_id || ':0'), 1, 8))::bigint / 4294967296.0::double < rate - floor(rate))::int) * size)::bigint as taken
from d join r on d.source is not distinct from r.source""",
    "op6_fm_decontamination": f"""
with d as (select doc_id, {WORDS} as w from documents),
b as (select item_id, {WORDS} as w from benchmark),
bw as (select distinct item_id, len(x) as k, x from (
  select item_id, unnest(case when len(w) = 0 then [] when len(w) < 8 then [w] else list_transform(range(1, len(w) - 6), lambda i: w[i:i + 7]) end) as x from b)),
sizes as (select distinct k from bw),
dw as (select doc_id, k, i, w[i:i + k - 1] as x from (
  select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, sizes)),
hits as (select doc_id, item_id, i, dw.k as k from dw join bw on dw.k = bw.k and dw.x = bw.x),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hits) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join n using (doc_id) left join t using (doc_id)""",
    "op8_arc_to_warc": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b)::bigint as payload_bytes, sha1(b) as h from p),
f as (select *, min(page_id) over (partition by h) as first from d)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, (i // 4 * 5 + 1)::int, 5))::int >> ((3 - i % 4) * 5)::int) & 31) + 1, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from f""",
}
