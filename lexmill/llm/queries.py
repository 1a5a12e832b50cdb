"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import spread
from . import decontaminate, embeddings, hardneg, htmlwrap, langid, minhash, packing, quality, secretscan, tokenfiles, urlfilter, veccodes, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def remainder(n: int):
    """crc32 of doc_id as text, modulo n; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As many segments as tokens: that limit isn't asked for here, and would pad sequences of very short texts.
    return piece_digests(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), kind="word", end_id=1, capacity=2048, max_segments=2048))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tiles")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), percent=75)


SQL4 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) end) as sh from w
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), r as (
  select a as doc_id, a as other from l union select r.doc_id, l.b from r join l on l.a = r.other
), m as (
  select doc_id, min(other) as component_id from r group by doc_id
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.component_id, d.doc_id)) as component_id,
  d.doc_id = least(d.doc_id, coalesce(m.component_id, d.doc_id)) as kept
from documents d left join n on n.doc_id = d.doc_id left join m on m.doc_id = d.doc_id
"""


URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), URL_RULES)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(table(spark, sf_dir, "embeddings"), least=0.98)


SQL6 = """
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null and embedding is not null
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98
), r as (
  select a as vec_id, b as other from l union select r.vec_id, l.b from r join l on l.a = r.other
), m as (
  select vec_id, min(other) as c from r group by vec_id
), n as (
  select a as vec_id, count(*) as n from l group by a
)
select d.vec_id, coalesce(n.n, 0) as n_links, least(d.vec_id, coalesce(m.c, d.vec_id)) as component_id, d.vec_id = least(d.vec_id, coalesce(m.c, d.vec_id)) as kept
from embeddings d left join n on n.vec_id = d.vec_id left join m on m.vec_id = d.vec_id
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenfiles.new_path(spark)
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), kind="byte", end_id=0)
    return tokenfiles.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    samples = langid.fit(docs, remainder(3) != 1)
    return langid.predict(docs, samples).select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlwrap.extract(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.new_path(spark)
    warc.write_warc(table(spark, sf_dir, "pages"), path, min_revisit=1000)
    return warc.read_warc(spark, path).drop("payload")


SQL9 = """
with p as (
  select page_id, url, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), g as (
  select *, max(page_id) over (partition by payload_digest) as top from p
)
select page_id, url, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
from g
"""
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


#: The matches of each pattern with their ends, from the lengths of what lies between them; the windows of the candidates that are left.
SQL11 = (
    """
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t from documents
), z as (
  select r, g, list_zip(string_split_regex(t, p), regexp_extract_all(t, p)) as z from d, (values """
    + ", ".join(f"({k}, {quoted(p)})" for k, p in enumerate((*secretscan.PATTERNS.values(), f"{secretscan.BASE}|{secretscan.CANDIDATE}")))
    + """) as patterns(g, p) where regexp_matches(t, p)
), u as (
  select r, g, unnest(range(len(z))) as pos, unnest(z) as cut from z
), m as (
  select * from (select r, g, cut[2] as match, sum(length(cut[1]) + coalesce(length(cut[2]), 0)) over (partition by r, g order by pos) as stop from u) where match is not null
), w as (
  select r, stop, k, substring(match, cast(k + 1 as bigint), 20) as w from (
    select r, stop, match, unnest(range(length(match) - 19)) as k from m where g = 3 and not ("""
    + " or ".join(f"regexp_matches(match, {quoted(p)})" for p in (secretscan.BASE, *secretscan.ALLOWED))
    + """))
), n as (
  select r, stop, k, any_value(w) as w, sum(round(n * log2(n) * 4294967296)) as total from (
    select r, stop, k, c, any_value(w) as w, count(*) as n from (select *, unnest(string_split(w, '')) as c from w) group by r, stop, k, c) group by r, stop, k
), e as (
  select r, stop, case when regexp_matches(w, '^[0-9a-fA-F]*$') then case when regexp_matches(w, '[0-9]') and regexp_matches(w, '[a-fA-F]') then 'entropy_hex' end
      when not regexp_matches(w, '[^0-9a-zA-Z]') and length(regexp_replace(w, '[^0-9]', '', 'g')) >= 3 and regexp_matches(w, '[a-z]') <> regexp_matches(w, '[A-Z]') then 'entropy_base36'
      when regexp_matches(w, '[0-9]') and regexp_matches(w, '[a-z]') and regexp_matches(w, '[A-Z]') then 'entropy_base64' end as class, total from n
), x as (
  select r, stop, min(case class when 'entropy_hex' then 4 when 'entropy_base36' then 5 else 6 end) as place from e
  where total <= floor(20 * (log2(20) - case class when 'entropy_hex' then """
    + f"{secretscan.THRESHOLDS['entropy_hex']} when 'entropy_base36' then {secretscan.THRESHOLDS['entropy_base36']} when 'entropy_base64' then {secretscan.THRESHOLDS['entropy_base64']}"
    + """ end) * 4294967296) group by r, stop
), s as (
  select m.r, m.stop - length(match) as start, m.stop, case when g = 3 then x.place else g + 1 end as place
  from m left join x on x.r = m.r and x.stop = m.stop and g = 3
  where case g when 0 then length(regexp_extract(match, """
    + quoted(secretscan.PATTERNS["assign"])
    + """, 1)) >= 6 when 1 then length(match) >= 20 when 2 then true else x.place is not null end
), o as (
  select r, start, place, (['assign', 'access', 'hex', 'entropy_hex', 'entropy_base36', 'entropy_base64'])[place] || ':' || cast(start as bigint) || ':' || cast(stop as bigint) as span from s
)
select d.doc_id, count(*) filter (place = 1) as n_assign, count(*) filter (place = 2) as n_access, count(*) filter (place = 3) as n_hex,
  sha256(coalesce(string_agg(span, ',' order by start, place) filter (place <= 3), '')) as base_sha256, coalesce(string_agg(span, ',' order by start, place), '') as spans
from d left join o on o.r = d.r group by d.r, d.doc_id
"""
)



def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL12 = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(cast(a.e as double[]), cast(b.e as double[])) as bigint) as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), p as (
  select anchor_id, id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over w as integer) as rank, s.id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.id)
qualify row_number() over w <= 10
"""


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.compress(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


#: A round: each part's nearest entry, then the entries' floored means.
ROUND13 = """, a{k} as (
  select p.vec_id, p.part, arg_min(b.entry, {{'d': list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'entry': b.entry}}) as entry,
    min(list_sum(list_transform(list_zip(p.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as d
  from p join b{j} b on b.part = p.part group by p.vec_id, p.part
)"""
MOVE13 = """, m{k} as (
  select part, entry, list(cast(floor(total / n) as bigint) order by place) as c from (
    select part, entry, place, cast(sum(component) as double) as total, count(*) as n
    from (select a.part, a.entry, unnest(p.x) as component, unnest(range(len(p.x))) as place from a{k} a join p on p.vec_id = a.vec_id and p.part = a.part) group by part, entry, place
  ) group by part, entry
), b{k} as (
  select b.part, b.entry, coalesce(m.c, b.c) as c from b{j} b left join m{k} m on m.part = b.part and m.entry = b.entry
)"""
SQL13 = (
    """
with v as (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), p as materialized (
  select vec_id, part, e[part * (len(e) // 16) + 1 : (part + 1) * (len(e) // 16)] as x from v, range(16) t(part)
), f as (
  select vec_id, row_number() over (order by vec_id) - 1 as entry from v order by vec_id limit 64
), b0 as (
  select p.part, f.entry, p.x as c from p join f on f.vec_id = p.vec_id
)"""
    + ROUND13.format(k=1, j=0)
    + MOVE13.format(k=1, j=0)
    + ROUND13.format(k=2, j=1)
    + MOVE13.format(k=2, j=1)
    + ROUND13.format(k=3, j=2)
    + """, o as (
  select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from a3 group by vec_id
), h as (
  select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) as codebooks_sha256 from b2
)
select o.vec_id, o.code, o.error, cast(sum(o.error) over (partition by v.label) as bigint) as label_error, h.codebooks_sha256 from o join v on v.vec_id = o.vec_id, h
"""
)



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_decontaminate": op2_decontaminate, "op3_quality": op3_quality, "op4_near_duplicates": op4_near_duplicates, "op5_url_filter": op5_url_filter, "op6_embeddings": op6_embeddings, "op7_token_files": op7_token_files, "op8_html": op8_html, "op9_warc": op9_warc, "op10_language_id": op10_language_id, "op11_secret_scan": op11_secret_scan, "op12_hard_negatives": op12_hard_negatives, "op13_vector_codes": op13_vector_codes}


def oracle_sql() -> dict[str, str]:
    return {"op4_near_duplicates": SQL4, "op6_embeddings": SQL6, "op9_warc": SQL9, "op11_secret_scan": SQL11, "op12_hard_negatives": SQL12, "op13_vector_codes": SQL13}
