"""Registered queries of the operators: name → (builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm import (ball_codes, bpe, decontaminate, fingerprints, hmm_lm, jaccard_join, periodic_runs, pieces, pii,
                         quality, resharding, url_rules, warc)
from verdant.llm.common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.digest(_table(spark, sf_dir, "documents", "doc_id", "text"),
                      public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


OP10_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p),
m as (select payload_digest, max(page_id) as keep, count(*) as n from d where payload_bytes >= 1000 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when m.n > 1 and d.page_id <> m.keep then 'revisit' else 'response' end as record_type,
       case when m.n > 1 and d.page_id <> m.keep then m.keep end as refers_to
from d left join m on m.payload_digest = d.payload_digest and d.payload_bytes >= 1000
"""


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad pages are those whose id is labelled of low quality or toxic."""
    labels = _table(spark, sf_dir, "labels", F.col("doc_id").alias("page_id"),
                    ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge(_table(spark, sf_dir, "pages", "page_id", "url"), labels)


# Every alignment of an item with a document that agrees in all but a sixth of
# the words of some window (items below 8 words: in all), from equal words alone.
OP8_SQL = """
with d as (select distinct doc_id, text, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> ''] as w
           from documents),
b as (select distinct item_id, [x for x in regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+') if x <> ''] as w
      from benchmark),
i as (select item_id, hash(w) as item, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) as j from b where len(w) > 0),
t as (select doc_id, hash(text) as doc, unnest(w) as word, generate_subscripts(w, 1) as p from d),
m as (select t.doc_id, t.doc, i.item_id, i.item, i.n, i.j, t.p - i.j as diagonal from t join i using (word)),
c as (select doc_id, item_id, n, count(*) over (partition by doc_id, doc, item_id, item, diagonal order by j
                                                range between current row and least(12, n) - 1 following) as matched from m)
select doc_id, item_id, max(matched) as matched from c
where matched >= case when n < 8 then n else least(12, n) - least(12, n) // 6 end group by doc_id, item_id
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_table(spark, sf_dir, "documents", "doc_id", "text"),
                                  _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.train(docs, _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return quality.judge(docs, model).drop("text")


_OP11_ROUND = """
k{r} as materialized (select p.vec_id, p.part, p.v, min(cast(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, b.v)
                             + list_inner_product(b.v, b.v) as bigint) * 256 + b.e) as best
        from p join b{r} b using (part) group by p.vec_id, p.part, p.v),
"""
_OP11_MEAN = """
u{r} as (select part, best % 256 as e, unnest(v) as x, unnest(range(len(v))) as place from k{r}),
m{r} as (select part, e, list(x order by place) as v
         from (select part, e, place, floor(sum(x) / count(*)) as x from u{r} group by part, e, place) group by part, e),
b{n} as materialized (select b.part, b.e, coalesce(m.v, b.v) as v from b{r} b left join m{r} m using (part, e)),
"""
OP11_SQL = """
with kept as (select * from embeddings where len(embedding) > 0 and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
p as materialized (select vec_id, t.part, [floor(1024 * cast(x as double)) for x in
                          embedding[t.part * len(embedding) // 4 + 1 : (t.part + 1) * len(embedding) // 4]] as v
      from kept, range(4) t(part)),
s as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept),
b0 as materialized (select part, e, v from p join s using (vec_id) where e < 256),
""" + "".join(_OP11_ROUND.format(r=r) + _OP11_MEAN.format(r=r, n=r + 1) for r in range(4)) + _OP11_ROUND.format(r=4) + """
c as (select vec_id, string_agg(printf('%02x', best % 256), '' order by part) as code, cast(sum(best // 256) as bigint) as error
      from k4 group by vec_id),
h as (select sha256(string_agg(array_to_string([cast(x as bigint) for x in v], ','), ',' order by part, e)) as codebooks_sha256 from b4)
select c.vec_id, c.code, c.error, cast(sum(c.error) over (partition by kept.label) as bigint) as label_error, h.codebooks_sha256
from c join kept using (vec_id), h
"""


def op11_ball_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_codes.digest(_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pieces.digest(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(_table(spark, sf_dir, "documents", "doc_id", "text"))


LLM_QUERIES = {
    "op1_pii": (op1_pii, None),
    "op2_fingerprints": (op2_fingerprints, None),
    "op8_decontamination": (op8_decontamination, OP8_SQL),
    "op9_quality": (op9_quality, None),
    "op10_warc": (op10_warc, OP10_SQL),
    "op7_url_rules": (op7_url_rules, None),
    "op5_hmm_lm": (op5_hmm_lm, None),
    "op6_flow_resharding": (op6_flow_resharding, None),
    "op3_jaccard_join": (op3_jaccard_join, None),
    "op4_byte_bpe": (op4_byte_bpe, None),
    "op11_ball_codes": (op11_ball_codes, OP11_SQL),
    "op12_sentencepiece": (op12_sentencepiece, None),
    "op13_periodic_runs": (op13_periodic_runs, None),
}
