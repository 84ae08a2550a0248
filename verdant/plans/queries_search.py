"""Registered queries for text and vector search (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdant.operators import query as Q
from verdant.operators import search as S
from verdant.plans.catalog import register
from verdant.plans.oracle import SYM, cte
from verdant.plans.queries_read import metrics_of
from verdant.session import checkpoint_dir
from verdant.sources.tables import symbol_of

_DOT = "list_reduce(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]), lambda x, y: x + y)"


def _dot(a: str, b: str) -> str:
    return _DOT.format(a=a, b=b)


def _pct_sql(c: str) -> str:
    return f"printf('%.2f%%', round({c} * 100, 2))"


def _part(c: str, text: str) -> str:
    return f"case when m.{c} is not null and m.{c} != 0 then {text} end"


@register("i1_profile_text", f"""
select c.symbol, concat_ws(' ',
  coalesce(c.name, '') || ' (' || c.symbol || ').',
  'Sector: ' || coalesce(c.sector, 'Unknown') || '.',
  case when length(coalesce(c.sub_industry, '')) > 0 then 'Industry: ' || c.sub_industry || '.' end,
  {_part('sharpe_252d', "'Sharpe ratio: ' || printf('%.2f', round(m.sharpe_252d, 2)) || '.'")},
  {_part('avg_esg_composite', "'ESG score: ' || printf('%.1f', round(m.avg_esg_composite, 1)) || '/100.'")},
  {_part('annual_volatility', "'Volatility: ' || " + _pct_sql('m.annual_volatility') + " || '.'")},
  {_part('annual_return', "'Annual return: ' || " + _pct_sql('m.annual_return') + " || '.'")},
  {_part('max_drawdown', "'Max drawdown: ' || " + _pct_sql('m.max_drawdown') + " || '.'")},
  {_part('avg_e_score', "'Environmental: ' || printf('%.1f', round(m.avg_e_score, 1)) || '.'")},
  {_part('avg_s_score', "'Social: ' || printf('%.1f', round(m.avg_s_score, 1)) || '.'")},
  {_part('avg_g_score', "'Governance: ' || printf('%.1f', round(m.avg_g_score, 1)) || '.'")}) as profile_text
from m_companies c left join m_metrics m on c.symbol = m.symbol""")
def i1_profile_text(t):
    """Profile sentence of every company."""
    return S.profile_text(t.companies(), metrics_of(t))


@register("i2_embedding_backlog", """
select d.doc_id, coalesce(p.url, '') || ': ' || d.text as embed_text
from documents d left join embeddings e on e.vec_id = d.doc_id left join pages p on p.page_id = d.doc_id
where e.embedding is null or list_max(list_transform(e.embedding, lambda x: abs(x))) = 0""")
def i2_embedding_backlog(t):
    """Knowledge entries (documents) still without a vector."""
    return S.embedding_backlog(_knowledge(t))


def _knowledge(t, vectors: bool = True):
    """Documents as knowledge entries, titled by the url of the page of their id."""
    titles = t.raw("pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("title"))
    return S.knowledge_base(t.raw("documents"), titles, t.raw("embeddings") if vectors else None)


def _company_vectors(t):
    e = t.raw("embeddings").select(symbol_of("vec_id").alias("symbol"), F.col("embedding").alias("vec"))
    return t.companies().select("symbol", "name", "sector").join(e, "symbol")


cte("m_company_vec", f"""
select c.symbol, c.name, c.sector, list_transform(e.embedding, lambda x: x::double) as v
from m_companies c join embeddings e on c.symbol = {SYM.format(k='e.vec_id')}
""")


@register("i3_similar_companies", f"""
with refs as (select m.symbol as ref_symbol from m_metrics m join m_companies c on m.symbol = c.symbol
              order by m.composite_score desc nulls last, m.symbol limit 10),
rv as (select r.ref_symbol, v.v as qv, sqrt({_dot('v.v', 'v.v')}) as qn from refs r join m_company_vec v on r.ref_symbol = v.symbol),
cand as (select v.*, m.sharpe_252d, m.avg_esg_composite, m.composite_score, sqrt({_dot('v.v', 'v.v')}) as n
         from m_company_vec v join m_metrics m on v.symbol = m.symbol),
pairs as (select rv.ref_symbol, cand.*, 1.0e0 - {_dot('cand.v', 'rv.qv')} / (cand.n * rv.qn) as distance
          from rv, cand where cand.symbol != rv.ref_symbol and cand.n > 0 and rv.qn > 0),
ranked as (select *, row_number() over (partition by ref_symbol order by distance, symbol) as rank from pairs)
select ref_symbol, rank, symbol, name, sector, round(coalesce(sharpe_252d, 0), 6) as sharpe,
  round(coalesce(avg_esg_composite, 0), 6) as esg, round(coalesce(composite_score, 0), 6) as composite_score,
  round(1 - distance, 3) as similarity
from ranked where rank <= 5""")
def i3_similar_companies(t):
    """The 5 most similar companies to each of the 10 best companies."""
    m = metrics_of(t)
    refs = Q.best_companies(m, t.companies(), top_n=10).select(F.col("symbol").alias("ref_symbol"))
    return S.similar(_company_vectors(t), refs, m, k=5)


def _label_centroids(t):
    e = t.raw("embeddings").select("label", F.col("embedding").alias("vec"))
    return S.centroids(e, "label").select(F.col("label").cast("bigint").alias("query_id"), "vec")


cte("m_centroids", """
select cast(label as bigint) as query_id, list(x order by i) as qv from (
  select label, i, avg(x) as x from (
    select label, unnest(range(len(embedding))) as i, unnest(list_transform(embedding, lambda y: y::double)) as x
    from embeddings) a group by 1, 2) b group by 1
""")


@register("i4_semantic_search", f"""
with kb as (select d.doc_id, p.url as title, d.source as topic,
              list_transform(e.embedding, lambda x: x::double) as v
            from documents d join embeddings e on e.vec_id = d.doc_id left join pages p on p.page_id = d.doc_id),
kbn as (select *, sqrt({_dot('v', 'v')}) as n from kb),
q as (select query_id, qv, sqrt({_dot('qv', 'qv')}) as qn from m_centroids),
pairs as (select q.query_id, kbn.doc_id, kbn.title, kbn.topic, 1.0e0 - {_dot('kbn.v', 'q.qv')} / (kbn.n * q.qn) as distance
          from q, kbn where kbn.n > 0 and q.qn > 0),
ranked as (select *, row_number() over (partition by query_id order by distance, doc_id) as rank from pairs)
select query_id, rank, doc_id, title, topic, round(distance, 6) as distance from ranked where rank <= 5""")
def i4_semantic_search(t):
    """I4: the 5 knowledge entries nearest to each label centroid."""
    return S.semantic_search(_knowledge(t), _label_centroids(t), 5)


@register("i5_keyword_search", """
with qw as (select query_id, w as word, count(*) as n from (
              select item_id as query_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+')) as w
              from benchmark) x where length(w) > 0 group by 1, 2),
dw as (select distinct word from qw),
kb as (select d.doc_id, lower(d.text) as c, lower(coalesce(p.url, '')) as tt
       from documents d left join pages p on p.page_id = d.doc_id),
m as (select dw.word, kb.doc_id, case when contains(kb.c, dw.word) then 1 else 0 end
                               + case when contains(kb.tt, dw.word) then 2 else 0 end as points
      from dw join kb on contains(kb.c, dw.word) or contains(kb.tt, dw.word)),
s as (select qw.query_id, m.doc_id, sum(qw.n * m.points) as score from qw join m on qw.word = m.word group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from s where score > 0)
select query_id, rank, doc_id, cast(score as bigint) as score from r where rank <= 5""")
def i5_keyword_search(t):
    """Keyword scoring of every benchmark passage against all documents."""
    kb = _knowledge(t, vectors=False)
    q = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return S.keyword_search(kb, q, 5)


def _hashed(t, dim: int = 256):
    docs = t.raw("documents").select("doc_id", "text", "source")
    kb = _knowledge(t, vectors=False).drop("vec").join(S.hash_embed(docs, "text", dim).select("doc_id", "vec"), "doc_id")
    bench = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    q = S.hash_embed(bench, "query_text", dim, fit_on=docs.select(F.col("text").alias("query_text")))
    return kb, q


@register("i6_search_with_fallback", None)
def i6_search_with_fallback(t):
    """Semantic search of benchmark passages over hashed TF-IDF document
    vectors, keyword search for passages without a usable vector."""
    kb, q = _hashed(t)
    return S.search(kb, q, 5)


@register("i7_ivf_search", None)
def i7_ivf_search(t):
    """Inverted-list search of label centroids over the document vectors."""
    checkpoint_dir(t.spark)
    kb = _knowledge(t).where(F.col("vec").isNotNull())
    return S.ivf_search(S.ivf_build(kb.select("doc_id", "vec"), "doc_id"), _label_centroids(t), "doc_id", k=5)


@register("i8_hash_embed", None)
def i8_hash_embed(t):
    """I8: hashed TF-IDF vectors of every document (dimension and norm)."""
    kb, _ = _hashed(t)
    return kb.select("doc_id", F.size("vec").cast("bigint").alias("dim"),
                     F.sqrt(S.dot(F.col("vec"), F.col("vec"))).alias("norm"))
