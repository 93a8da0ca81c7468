"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm import ann, collocations, language_id, lm, mixing, near_dedup, ngram_join, sharding, subwords, topk, toxicity, url_filters, whitening
from vitalframe.llm.common import id_remainder, table

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.encode_documents(table(spark, sf_dir, "documents"))


def op4_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def op5_voronoi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_inner_products(vectors, vectors.filter("vec_id % 50 = 0"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, model = language_id.train(docs.filter(id_remainder(F.col("doc_id"), 4) != 2))
    found = language_id.identify(docs, names, model)
    return found.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms, weights = toxicity.train(docs, table(spark, sf_dir, "labels").filter(id_remainder(F.col("doc_id"), 5) != 0))
    found = toxicity.score(docs, terms, weights)
    return found.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "hits")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), near="lang")


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_minhash_dedup, op3_sentencepiece, op4_hnsw_search, op5_voronoi_topk, op6_url_filter, op7_language_id, op8_toxicity, op9_sharding, op10_lm_score, op11_ngram_join, op12_phrase_collocations, op13_embedding_whitening)}

ORACLE_SQL = {
    "op2_minhash_dedup": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from w),
e as materialized (select doc_id, unnest(s) as g, len(s) as n from s),
f as materialized (select * from e qualify count(*) over (partition by g) > 1),
links as materialized (
  select a.doc_id as a, b.doc_id as b from f a join f b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.b) as component_id, s.doc_id = min(r.b) as kept
from s join reach r on r.a = s.doc_id group by s.doc_id, s.s
""",
    "op5_voronoi_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 50 = 0),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5
""",
    "op11_ngram_join": r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) end as s from w),
e as materialized (select doc_id, unnest(s) as g, len(s) as n from s),
f as materialized (select * from e qualify count(*) over (partition by g) > 1),
links as materialized (
  select a.doc_id as a, b.doc_id as b from f a join f b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.b) as component_id
from s join reach r on r.a = s.doc_id group by s.doc_id, s.s
""",
    "op12_phrase_collocations": r"""
with p as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
g as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
  from w, (values (1), (2), (3), (4)) as sizes(k) where len(w) >= k),
f as materialized (select lang, k, phrase, count(*) as f from g group by all having count(*) >= 30),
n as (select lang, sum(len(w))::bigint as n from w group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1),
cuts as (select lang, phrase, a, k, w, unnest(range(1, k)) as cut from c),
scored as (
  select c.lang, c.phrase, c.a, x.f as l, y.f as r, ((2000000::hugeint * c.a) // (x.f + y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.cut], ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by (2000000::hugeint * c.a) // (x.f + y.f), c.cut) = 1),
inner_sizes as (select lang, w, a as f, k, unnest(range(2, k)) as m from c where k > 2),
inside as (
  select lang, phrase, max(f) as longer
  from (select lang, f, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) as phrase from inner_sizes) group by all),
ranked as (
  select s.*, row_number() over (partition by s.lang order by score desc, a desc, s.phrase) as rank
  from scored s left join inside i on i.lang = s.lang and i.phrase = s.phrase where longer is null or 100 * longer < 80 * a)
select r.lang, rank, phrase, a, l, r.r, n.n, score from ranked r join n on n.lang = r.lang where rank <= 2000
""",
    "op6_url_filter": r"""
with parts as (
  select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
u as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from (select page_id, coalesce(rest, '') as rest from parts)),
r(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m as (
  select page_id, host, path, h || p as rule, v, row_number() over (partition by page_id, host, path order by length(h || p) desc nulls last) as k
  from u left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where k = 1
""",
}
