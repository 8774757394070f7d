"""The operators bound to the driver's tables, next to the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (debruijn, exact_dedup, imatch, langid, mixing, packing, rtree, secrets, simhash, suffix_dedup, tokenizers, vector_codes,
               voronoi, warc)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_documents(spark, sf_dir))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_fingerprints(_documents(spark, sf_dir))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_columns(secrets.scan_versions(_documents(spark, sf_dir), secrets.Ledger(spark)))


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_documents(spark, sf_dir))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizers.path())


def op9_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.repeated_words(_documents(spark, sf_dir))[0]


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(_documents(spark, sf_dir))


def op11_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_k(_embeddings(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(_embeddings(spark, sf_dir))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rtree.hard_negatives(_embeddings(spark, sf_dir))


SQL_WARC = r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes,
                  sha256(coalesce(html, '')) as payload_digest from pages),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id > first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id > first_id then first_id end as refers_to from f
"""

SQL_EXACT_DEDUP = r"""
with d as (select doc_id, length(coalesce(text, '')) as chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as text_sha256 from documents),
ranked as (select *, row_number() over w as place, first_value(doc_id) over w as keep_id,
                  count(*) over (partition by text_sha256) as group_size
           from d window w as (partition by text_sha256 order by chars desc, doc_id))
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from ranked
"""

SQL_MIX_SOURCES = r"""
with light as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                      md5(coalesce(cast(doc_id as varchar), '')) as shuffled from documents),
sizes as (select source, cast(sum(size) as bigint) as source_size,
                 row_number() over (order by source nulls last) as sid from light group by source),
caps as (select *, [3, 1, 2][(sid - 1) % 3 + 1] as weight, 2 * source_size as cap,
                cast(sum(source_size) over () as double) * 1.5e0 as budget from sizes),
ratios as (select *, cast(cap as double) / weight as ratio from caps),
levels as (select *, (budget - cast(coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0)
                      as double)) / cast(sum(weight) over (w rows between current row and unbounded following) as double)
                     as level from ratios window w as (order by ratio, sid)),
targets as (select source, sid, source_size, budget, case when ratio > level then weight *
                   (select min_by(level, ratio * 1e6 + sid) from levels where ratio > level) else cast(cap as double) end
                   as target from levels),
entries as (select doc_id, size, source_size, target, budget, t.sid, shuffled, epoch, epoch * source_size
                   + sum(size) over (partition by t.sid, epoch order by shuffled, doc_id) as finish_words
            from light l join targets t on l.source is not distinct from t.source, (values (0), (1)) e(epoch)),
shares as (select *, cast(finish_words as double) / nullif(target, 0) as finish,
                  greatest(0, least(size, ceil(target) - (finish_words - size))) as share from entries),
places as (select *, sum(share) over (order by finish nulls last, sid, epoch, shuffled, doc_id) - share as position
           from shares)
select doc_id, size, source_size, target,
       cast(sum(greatest(0, least(share, floor(budget) - position))) as bigint) as taken
from places group by doc_id, size, source_size, target
"""

_FLOORED = """select vec_id, label, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0"""
_SCORE = "cast(list_inner_product(cast({a} as double[]), cast({b} as double[])) as bigint)"

SQL_TOP_K = f"""
with e as ({_FLOORED.format(scale=256)}),
s as (select q.vec_id as query_id, d.vec_id, {_SCORE.format(a="q.v", b="d.v")} as score
      from e q join e d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

SQL_HARD_NEGATIVES = f"""
with f as ({_FLOORED.format(scale=256)}),
e as (select vec_id, v, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label from f where label is not null),
s as (select a.vec_id as anchor_id, a.label = d.label as same, d.vec_id, {_SCORE.format(a="a.v", b="d.v")} as score
      from e a join e d on a.vec_id <> d.vec_id where a.vec_id % 50 = 0),
p as (select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from s where same),
n as (select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
             row_number() over (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) as rank
      from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score
      where p.place <= 5)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


def _sql_codes() -> str:
    """Six rounds and the last assignment, one after the other."""
    nearest = """a{k} as materialized (select row, part, arg_min(entry, d * 16 + entry) as entry, min(d) as d from
        (select w.row, w.part, b.entry, list_sum(list_transform(list_zip(w.w, b.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
         from w join b{k} b using (part)) group by row, part)"""
    moved = """b{n} as materialized (select b.part, b.entry, coalesce(m.w, b.w) as w from b{k} b left join
        (select part, entry, list(cast(floor(total / n) as bigint) order by pos) as w from
           (select part, entry, pos, cast(sum(x) as bigint) as total, count(*) as n from
              (select a.part, a.entry, unnest(w.w) as x, unnest(range(len(w.w))) as pos from a{k} a join w using (row, part))
            group by part, entry, pos) group by part, entry) m on b.part = m.part and b.entry = m.entry)"""
    steps = [f"e as materialized (select *, row_number() over (order by vec_id) - 1 as row from ({_FLOORED.format(scale=4096)}))",
             "w as materialized (select row, part, v[part * len(v) // 8 + 1 : (part + 1) * len(v) // 8] as w from e, range(8) p(part))",
             "b0 as materialized (select part, row as entry, w from w where row < 16)"]
    for k in range(6):
        steps += [nearest.format(k=k), moved.format(k=k, n=k + 1)]
    return "with " + ", ".join([*steps, nearest.format(k=6)]) + """,
books as (select sha256(string_agg(array_to_string(w, ','), ',' order by part, entry)) as codebooks_sha256 from b6),
coded as (select row, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a6 group by row)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256
from coded join e using (row), books
"""


QUERIES = {
    "op1_simhash": (op1_simhash, None),
    "op2_warc": (op2_warc, SQL_WARC),
    "op3_langid": (op3_langid, None),
    "op4_imatch": (op4_imatch, None),
    "op5_exact_dedup": (op5_exact_dedup, SQL_EXACT_DEDUP),
    "op6_secrets": (op6_secrets, None),
    "op7_repeated_bytes": (op7_repeated_bytes, None),
    "op8_pack": (op8_pack, None),
    "op9_repeated_words": (op9_repeated_words, None),
    "op10_mix_sources": (op10_mix_sources, SQL_MIX_SOURCES),
    "op11_voronoi_topk": (op11_voronoi_topk, SQL_TOP_K),
    "op12_vector_codes": (op12_vector_codes, _sql_codes()),
    "op13_hard_negatives": (op13_hard_negatives, SQL_HARD_NEGATIVES),
}


def queries() -> dict:
    return {name: run for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
