"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, itq, langid, lm, mixing, secrets, simhash, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.perplexities(_table(spark, sf_dir, "documents"), folds=5, fold=1)


def op2_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"), folds=3, fold=1)


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op4_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), distance=3, shingle=3)
    return found.select("doc_id", simhash.hex16().alias("fingerprint"), "component_id")


def op5_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq.near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op6_toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, spans = secrets.with_spans(docs)
    base = secrets.of_kinds(F.col(spans), [r.kind for r in secrets.BASE_RULES])
    count = lambda kind: F.size(secrets.of_kinds(F.col(spans), [kind])).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(r.kind) for r in secrets.BASE_RULES],
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"),
        secrets.spans_text(F.col(spans)).alias("spans"),
    )


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, hits = decontaminate.with_hits(docs, _table(spark, sf_dir, "benchmark"), window=8)
    h = F.col(hits)
    return found.select(
        "doc_id",
        h["n_words"].alias("n_words"),
        h["n_hit"].alias("n_hit"),
        F.size(h["items"]).cast("long").alias("n_items"),
        decontaminate.items_digest(h["items"]).alias("items_sha256"),
        decontaminate.contaminated(h, least_items=2).alias("contaminated"),
    )


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("s")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kneser_ney_scoring": op1_kneser_ney_scoring,
    "op2_crf_language_id": op2_crf_language_id,
    "op3_warc_archive": op3_warc_archive,
    "op4_simhash_near_duplicates": op4_simhash_near_duplicates,
    "op5_itq_near_duplicates": op5_itq_near_duplicates,
    "op6_toxicity_severity": op6_toxicity_severity,
    "op7_secret_scan": op7_secret_scan,
    "op8_suffix_decontamination": op8_suffix_decontamination,
    "op9_source_mixing": op9_source_mixing,
    "op10_url_filter": op10_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_archive": """
    with p as (
      select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, coalesce(html, '') as html from pages
    ), o as (select *, max(page_id) over (partition by html) as owner from p)
    select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
           case when payload_bytes >= 1000 and page_id is distinct from owner then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= 1000 and page_id is distinct from owner then owner end as refers_to
    from o
    """,
    "op8_suffix_decontamination": """
    with b as (
      select item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w from benchmark where text is not null
    ), windows as (
      select distinct item_id, array_to_string(w[k : k + least(8, len(w)) - 1], ' ') as g, least(8, len(w)) as n
      from b, unnest(range(1, greatest(1, len(w) - 7) + 1)) as t(k) where len(w) > 0
    ), d as (
      select doc_id, coalesce(regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+'), []::varchar[]) as w from documents
    ), sizes as (select distinct n from windows), grams as (
      select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as g from d, sizes, unnest(range(1, len(w) - n + 2)) as t(k) where len(w) >= n
    ), hits as (
      select doc_id, k, n, item_id from grams join windows using (g, n)
    ), covered as (
      select doc_id, count(distinct k + j) as n_hit from hits, unnest(range(0, n)) as u(j) group by doc_id
    ), found as (
      select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by doc_id
    )
    select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
    from d left join covered using (doc_id) left join found using (doc_id)
    """,
    "op9_source_mixing": """
    with labelled as (select doc_id as l, avg(quality::double) as q from labels where doc_id is not null and quality is not null group by 1),
    sized as (
      select d.doc_id, case when source is null then 'b' else 'a' || source end as s,
             coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
             -ln((('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / coalesce(0.5 + 1.5 * q, 1.0) as key
      from documents d left join labelled on doc_id = l
    ), sources as (
      select s, sum(size)::double as source_size, [5.0::double, 2.0, 1.0][1 + (row_number() over (order by s) - 1) % 3] as w from sized group by s
    ), levels as (
      select *, 3 * source_size as cap, 3 * source_size / w as ratio,
             (sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / w, s rows between unbounded preceding and 1 preceding), 0))
             / sum(w) over (order by 3 * source_size / w, s rows between current row and unbounded following) as level
      from sources
    ), targets as (
      select s, source_size, least(cap, coalesce(max(case when level <= ratio then level end) over (), 0) * w) as target from levels
    ), plan as (
      select *, least(case when source_size > 0 then floor(target / source_size + 1e-9) else 0 end, 3) as epochs from targets
    ), first as (
      select *, greatest(target - epochs * source_size, 0) as rest, sum(size) over (partition by s order by key, doc_id, size range between unbounded preceding and current row) as upto
      from sized join plan using (s)
    ), gaps as (
      select *, rest - sum(case when upto <= rest then size else 0 end) over (partition by s) as gap from first
    ), fits as (select *, upto > rest and size > 0 and size <= gap as fit from gaps),
    tried as (
      select *, sum(case when fit then size else 0 end) over (partition by s order by key, doc_id, size range between unbounded preceding and current row) as more from fits
    )
    , chosen as (
      select *, upto <= rest or (fit and more <= gap) as chosen from tried
    ), ends as (
      select *, rest - sum(case when chosen then size else 0 end) over (partition by s) as remains from chosen
    ), nearest as (
      select s, key, doc_id, size from (select * from ends where not chosen and size > 0 and size < 2 * remains)
      qualify rank() over (partition by s order by abs(size - remains), key, doc_id, size) = 1
    )
    select e.doc_id, e.size, source_size::bigint as source_size, target,
           (e.size * least(epochs + case when chosen or n.s is not null then 1 else 0 end, 3))::bigint as taken
    from ends e left join (select distinct * from nearest) n on e.s = n.s and e.key = n.key and e.doc_id is not distinct from n.doc_id and e.size = n.size
    """,
    "op10_url_filter": urls.duckdb_sql(),
}
