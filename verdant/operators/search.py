"""Text and vector search.

Exact nearest neighbours (I3, I4): packed blocks of queries meet packed blocks
of the corpus that could hold something near enough (``operators.vectors``); a
window over what they pass on ranks it exactly. The answer does not depend on
the number of queries, and no table of pairs is formed. The inverted lists (I7)
are an approximate index of their own, used only when asked for.

Keyword search (I5) keeps the substring semantics exactly without comparing
every word with every document: a query word (no whitespace) occurs in a text
exactly when it is a substring of one of the text's tokens, so a task looks the
substrings of each distinct token up among the query words. What leaves it is
one bit a word and entry; entries are scored where their bits meet, and only
the best of each partition go on: no table of (word, entry) or (query, entry).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdant.functions.numeric import fixed_round
from verdant.operators.inverted import InvertedLists, build_lists, probed
from verdant.operators.vectors import candidates
from verdant.session import checkpoint_dir

# Result caps and defaults.
SIMILAR_MAX = 50
SEARCH_K = 5
KEYWORD_CONTENT_POINTS = 1
KEYWORD_TITLE_POINTS = 2
IVF_LIST_ROWS = 32            # rows a list is meant for
IVF_SHARE = 0.6               # of the lists that a query looks into: enough for vectors that hardly cluster
LONG_TOKEN = 64               # characters; longer tokens are searched, not cut up
KNOWN_TOKENS = 200_000        # that a task remembers
SCORED_ROWS = 1024            # entries scored together,
QUERY_BLOCK = 512             # for so many queries at once
TEXT_BATCH_BYTES = 8 << 20    # of one Arrow batch of texts
WS_SPLIT = r"[ \t\n\x0B\f\r]+"


# ------------------------------------------------------------------ vectors

def as_double_array(c: Column | str) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.transform(col, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Σ a_i · b_i over two equal-length arrays (sequential, in double)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def with_norm(df: DataFrame, vec: str = "vec") -> DataFrame:
    """Double-typed vector plus its L2 norm (stored once, used by every
    comparison); NULL and all-zero vectors are dropped (cosine undefined)."""
    v = as_double_array(vec)
    out = df.withColumn(vec, v).withColumn("_norm", F.sqrt(dot(F.col(vec), F.col(vec))))
    return out.where(F.col(vec).isNotNull() & (F.col("_norm") > 0))


def _unit(vec: str, norm: str) -> Column:
    """The vector over its norm. The norm is an argument, not part of the
    lambda, where it would be worked out again for every component."""
    v = F.col(vec)
    return F.zip_with(v, F.array_repeat(F.col(norm), F.size(v)), lambda x, n: x / n).alias("unit")


def nearest(corpus: DataFrame, queries: DataFrame, k: int, corpus_key: str, query_key: str,
            vec: str = "vec", exclude_self: bool = False) -> DataFrame:
    """Exact top-k by cosine distance for each query, however many there are
    (``operators.vectors``): query_key, the other columns of ``corpus``,
    distance, rank (distance, then key). Keys are unique on both sides."""
    checkpoint_dir(corpus.sparkSession)
    c = with_norm(corpus.select(F.col(corpus_key).alias("_c"), F.col(vec).alias("_v")), "_v")
    q = with_norm(queries.select(F.col(query_key).alias("_q"), F.col(vec).alias("_qv")), "_qv").withColumnRenamed("_norm", "_qn")
    best = candidates(c.select(F.col("_c").alias("key"), _unit("_v", "_norm")),
                      q.select(F.col("_q").alias("key"), _unit("_qv", "_qn")), k, exclude_self)
    scored = (best.select(F.col("query").alias("_q"), F.col("key").alias("_c")).join(c, "_c").join(q, "_q")
              .withColumn("distance", F.lit(1.0) - dot(F.col("_v"), F.col("_qv")) / (F.col("_norm") * F.col("_qn"))))
    w = Window.partitionBy("_q").orderBy("distance", "_c")
    top = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("_q", "_c", "distance", "rank")
    rest = corpus.drop(vec)
    return (top.join(rest, F.col("_c") == F.col(corpus_key)).drop("_c").withColumnRenamed("_q", query_key))


# ------------------------------------------------------------- I1, I2

def _pct(c: str) -> Column:
    return F.format_string("%.2f%%", fixed_round(F.col(c) * 100, 2))


def profile_text(companies: DataFrame, metrics: DataFrame) -> DataFrame:
    """A profile sentence per company (companies without metrics kept):
    name (symbol). Sector. Industry. Sharpe, ESG, volatility, return,
    drawdown, E/S/G — a zero or missing measure is left out."""
    m = metrics.select("symbol", "sharpe_252d", "avg_esg_composite", "annual_volatility",
                       "annual_return", "max_drawdown", "avg_e_score", "avg_s_score", "avg_g_score")
    j = companies.select("symbol", "name", "sector", "sub_industry").join(m, "symbol", "left")

    def part(c, text):
        return F.when(F.col(c).isNotNull() & (F.col(c) != 0), text)

    def f(c, d):
        return F.format_string(f"%.{d}f", fixed_round(F.col(c), d))

    txt = F.concat_ws(
        " ",
        F.concat(F.coalesce(F.col("name"), F.lit("")), F.lit(" ("), F.col("symbol"), F.lit(").")),
        F.concat(F.lit("Sector: "), F.coalesce(F.col("sector"), F.lit("Unknown")), F.lit(".")),
        F.when(F.length(F.coalesce(F.col("sub_industry"), F.lit(""))) > 0,
               F.concat(F.lit("Industry: "), F.col("sub_industry"), F.lit("."))),
        part("sharpe_252d", F.concat(F.lit("Sharpe ratio: "), f("sharpe_252d", 2), F.lit("."))),
        part("avg_esg_composite", F.concat(F.lit("ESG score: "), f("avg_esg_composite", 1), F.lit("/100."))),
        part("annual_volatility", F.concat(F.lit("Volatility: "), _pct("annual_volatility"), F.lit("."))),
        part("annual_return", F.concat(F.lit("Annual return: "), _pct("annual_return"), F.lit("."))),
        part("max_drawdown", F.concat(F.lit("Max drawdown: "), _pct("max_drawdown"), F.lit("."))),
        part("avg_e_score", F.concat(F.lit("Environmental: "), f("avg_e_score", 1), F.lit("."))),
        part("avg_s_score", F.concat(F.lit("Social: "), f("avg_s_score", 1), F.lit("."))),
        part("avg_g_score", F.concat(F.lit("Governance: "), f("avg_g_score", 1), F.lit("."))),
    )
    return j.select("symbol", txt.alias("profile_text"))


def knowledge_base(documents: DataFrame, titles: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Knowledge entries from documents: content = the whole text, topic =
    source; title from ``titles`` (doc_id, title) where there is one; vector
    from ``embeddings`` where vec_id = doc_id (NULL otherwise)."""
    kb = (documents.select("doc_id", F.col("text").alias("content"), F.col("source").alias("topic"))
          .join(titles.select("doc_id", "title"), "doc_id", "left").select("doc_id", "title", "content", "topic"))
    if embeddings is None:
        return kb.withColumn("vec", F.lit(None).cast("array<float>"))
    e = embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return kb.join(e, "doc_id", "left")


def embedding_backlog(kb: DataFrame) -> DataFrame:
    """Entries still needing a vector (NULL or all-zero) with the text to
    embed, 'title: content'."""
    zero = F.coalesce(F.forall(F.col("vec"), lambda x: x == 0), F.lit(True))
    return kb.where(F.col("vec").isNull() | zero).select(
        "doc_id", F.concat(F.coalesce(F.col("title"), F.lit("")), F.lit(": "), F.col("content")).alias("embed_text"))


# ------------------------------------------------------------- I3, I4

def similar(corpus: DataFrame, refs: DataFrame, metrics: DataFrame, k: int = 5,
            min_esg: float | None = None, min_sharpe: float | None = None) -> DataFrame:
    """For each reference symbol, the k (1–50) closest other companies by
    cosine distance of their profile vectors, with optional ESG / Sharpe
    floors; similarity = 1 − distance (3 dp). ``corpus``: (symbol, vec, name,
    sector); ``refs``: (ref_symbol)."""
    k = max(1, min(int(k), SIMILAR_MAX))
    m = metrics.select("symbol", "sharpe_252d", "avg_esg_composite", "composite_score")
    cand = corpus.join(m, "symbol")
    if min_esg is not None:
        cand = cand.where(F.col("avg_esg_composite") >= min_esg)
    if min_sharpe is not None:
        cand = cand.where(F.col("sharpe_252d") >= min_sharpe)
    rv = refs.select(F.upper("ref_symbol").alias("ref_symbol")).join(
        corpus.select(F.col("symbol").alias("ref_symbol"), "vec"), "ref_symbol")
    top = nearest(cand, rv, k, "symbol", "ref_symbol", exclude_self=True)
    return top.select(
        "ref_symbol", F.col("rank").cast("bigint").alias("rank"), "symbol", "name", "sector",
        F.coalesce(F.col("sharpe_252d"), F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.col("avg_esg_composite"), F.lit(0.0)).alias("esg"),
        F.coalesce(F.col("composite_score"), F.lit(0.0)).alias("composite_score"),
        fixed_round(1 - F.col("distance"), 3).alias("similarity"))


def semantic_search(kb: DataFrame, queries: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """I4: k nearest knowledge entries per query vector (query_id, vec);
    entries and queries with NULL or zero vectors take no part."""
    top = nearest(kb.select("doc_id", "vec", "title", "topic"), queries, k, "doc_id", "query_id")
    return top.select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "title",
                      "topic", "distance")


def centroids(vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    """Element-wise mean vector per key (one posexplode + one aggregation)."""
    e = vectors.select(key, F.posexplode(as_double_array(vec)).alias("_i", "_x"))
    g = e.groupBy(key, "_i").agg(F.avg("_x").alias("_x"))
    return g.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))),
                                          lambda s: s["_x"]).alias(vec))


# ----------------------------------------------------------------- I5, I6

def _words_inside(words: list[str]) -> Callable[[str], Sequence[int]]:
    """Numbers of the ``words`` that a token contains: the token's substrings of
    the words' lengths are looked up; a token beyond ``LONG_TOKEN`` characters
    is searched for every word instead."""
    number = {w: i for i, w in enumerate(words)}
    lengths = sorted(set(map(len, words)))

    def inside(tok: str) -> Sequence[int]:
        if len(tok) > LONG_TOKEN:
            return [i for w, i in number.items() if w in tok]
        subs = {tok[i:i + n] for n in lengths if n <= len(tok) for i in range(len(tok) - n + 1)}
        return [number[x] for x in subs if x in number]

    return inside


def word_hits(kb: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, bits) of every entry whose content or title contains one of the
    ``words`` (no whitespace in them; lower-cased substring): a bit for each
    word met in the content, then one for each met in the title. A word occurs
    in a text exactly when it is a substring of one of the text's
    whitespace-delimited tokens, so a task looks at each distinct token once."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    shared = kb.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, width = _words_inside(shared.value), len(shared.value)
        tokens, known = re.compile(r"[^ \t\n\x0B\f\r]+").findall, {}
        for b in batches:
            met = np.zeros((b.num_rows, 2 * width), bool)
            for column, first in ((1, 0), (2, width)):
                for row, text in enumerate(b.column(column).to_pylist()):
                    found: set[int] = set()
                    for tok in set(tokens(text)):
                        at = known.get(tok)
                        if at is None:
                            at = inside(tok)
                            if len(tok) <= LONG_TOKEN:
                                if len(known) >= KNOWN_TOKENS:
                                    known.clear()
                                known[tok] = at
                        found.update(at)
                    met[row, [first + i for i in found]] = True
            some = np.flatnonzero(met.any(axis=1))
            bits = np.packbits(met[some], axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), pa.array([r.tobytes() for r in bits], pa.binary())],
                                             names=["doc_id", "bits"])

    kb.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BATCH_BYTES))
    return kb.select("doc_id", low("content"), low("title")).mapInArrow(
        run, T.StructType([T.StructField("doc_id", kb.schema["doc_id"].dataType), T.StructField("bits", T.BinaryType())]))


def best_entries(hits: DataFrame, words: list[str], asked: list[list[tuple[int, int]]], ids: list, id_type: T.DataType, k: int) -> DataFrame:
    """(query_id, doc_id, score): the ``k`` best entries of each partition for
    every query; ``asked`` holds a query's (word number, times asked). Rows of
    one entry are dealt to one partition and stand together in it, so that
    their bits are united before they are scored, and ties go to the smaller
    doc_id. Words below three characters count once a row of an entry that
    stands there several times, longer ones once an entry."""
    width = len(words)
    short = np.array([first + i for first in (0, width) for i, w in enumerate(words) if len(w) < 3], np.int64)
    shared = hits.sparkSession.sparkContext.broadcast((asked, ids))
    query_type, doc_type = to_arrow_type(id_type), to_arrow_type(hits.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, ids = shared.value
        best = np.zeros((0, len(ids)), np.int64)
        held = np.empty((0, len(ids)), object)

        def bits_of(row: np.ndarray) -> np.ndarray:
            return np.unpackbits(row, axis=-1, count=2 * width).astype(float)

        def score(docs: list, rows: list[np.ndarray], sums: dict[int, np.ndarray]) -> None:
            nonlocal best, held
            met = bits_of(np.stack(rows))
            for i, times_met in sums.items():
                met[i, short] = times_met
            points = met[:, :width] * KEYWORD_CONTENT_POINTS + met[:, width:] * KEYWORD_TITLE_POINTS
            scores, docs_of = np.empty((k, len(ids)), np.int64), np.empty((k, len(ids)), object)
            docs = np.array([*docs, None], object)[:-1]
            for first in range(0, len(ids), QUERY_BLOCK):                 # bounded memory, however many queries
                block = asked[first:first + QUERY_BLOCK]
                times = np.zeros((width, len(block)))
                for j, pairs in enumerate(block):
                    for i, n in pairs:
                        times[i, j] = n
                span = slice(first, first + len(block))
                new = np.rint(points @ times).astype(np.int64)
                every = np.concatenate([best[:, span], new])
                if len(every) < k:
                    every = np.concatenate([every, np.zeros((k - len(every), len(block)), np.int64)])
                top = np.argsort(-every, axis=0, kind="stable")[:k]
                scores[:, span] = np.take_along_axis(every, top, 0)
                names = np.concatenate([held[:, span], np.repeat(docs[:, None], len(block), 1)])
                if len(names) < len(every):
                    names = np.concatenate([names, np.empty((len(every) - len(names), len(block)), object)])
                docs_of[:, span] = np.take_along_axis(names, top, 0)
            best, held = scores, docs_of

        docs: list = []
        rows: list[np.ndarray] = []
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for doc, bits in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = np.frombuffer(bits, np.uint8)
                if docs and docs[-1] == doc:
                    at = len(docs) - 1
                    sums[at] = (sums[at] if at in sums else bits_of(rows[-1])[short]) + bits_of(row)[short]
                    rows[-1] = rows[-1] | row
                    continue
                if len(docs) >= SCORED_ROWS:
                    score(docs, rows, sums)
                    docs, rows, sums = [], [], {}
                docs.append(doc)
                rows.append(row)
        if docs:
            score(docs, rows, sums)
        at, query = np.nonzero(best > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[j] for j in query], query_type), pa.array(held[at, query].tolist(), doc_type), pa.array(best[at, query], pa.int64())],
            names=["query_id", "doc_id", "score"])

    together = hits.repartition("doc_id").sortWithinPartitions("doc_id")
    return together.mapInArrow(run, T.StructType([T.StructField("query_id", id_type), hits.schema["doc_id"], T.StructField("score", T.LongType())]))


def query_words(queries: DataFrame, text: str = "query_text") -> DataFrame:
    """(query_id, word, n): lower-cased whitespace-split words with their
    multiplicity (a repeated word counts each time)."""
    w = queries.select("query_id", F.explode(F.split(F.lower(F.col(text)), WS_SPLIT)).alias("word"))
    return w.where(F.length("word") > 0).groupBy("query_id", "word").agg(F.count(F.lit(1)).alias("n"))


def keyword_search(kb: DataFrame, queries: DataFrame, k: int = SEARCH_K, text: str = "query_text") -> DataFrame:
    """score = Σ over query words (+1 content contains it, +2 title
    contains it); score > 0; top k per query (score desc, doc_id). Scans the
    whole knowledge base once; the words of the queries, not of the entries,
    are gathered and sent to the tasks."""
    spark, id_type = kb.sparkSession, queries.schema["query_id"].dataType
    asked: dict = {}
    for r in query_words(queries, text).collect():
        asked.setdefault(r.query_id, []).append((r.word, r.n))
    words = sorted({w for pairs in asked.values() for w, _ in pairs})
    if not words:
        return spark.createDataFrame([], T.StructType([T.StructField("query_id", id_type), T.StructField("rank", T.LongType()),
                                                       T.StructField("doc_id", kb.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    number = {w: i for i, w in enumerate(words)}
    s = best_entries(word_hits(kb, words), words, [[(number[w], n) for w, n in pairs] for pairs in asked.values()],
                     list(asked), id_type, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return (s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
             .select("query_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", "score"))


def search(kb: DataFrame, queries: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """Semantic hits per query (query_id, vec, query_text); queries with
    none (no usable vector) fall back to keyword hits."""
    checkpoint_dir(kb.sparkSession)
    vectors = kb.select("doc_id", "vec", "title", "topic").checkpoint(eager=True)                      # looked at several times
    sem = semantic_search(vectors, queries.select("query_id", "vec"), k).select(
        "query_id", "rank", "doc_id", F.lit("semantic").alias("method")).checkpoint(eager=True)      # at most k a query
    rest = queries.join(sem.select("query_id").distinct(), "query_id", "left_anti")
    kw = keyword_search(kb, rest, k).select("query_id", "rank", "doc_id", F.lit("keyword").alias("method"))
    return sem.unionByName(kw)


# ----------------------------------------------------------------- I7, I8

def ivf_build(corpus: DataFrame, key: str, vec: str = "vec", lists: int | None = None, seed: int = 7) -> InvertedLists:
    """I7 build over unit vectors: one list for about ``IVF_LIST_ROWS`` rows
    (or ``lists``) by a two-level quantiser (``operators.inverted``); rows with
    NULL or zero vectors are in no list."""
    c = with_norm(corpus.select(key, vec), vec)
    unit = c.select(F.col(key).alias("key"), _unit(vec, "_norm"))
    return build_lists(unit, lists, IVF_LIST_ROWS, seed)


def ivf_search(index: InvertedLists, queries: DataFrame, key: str, k: int = SEARCH_K,
               probes: int | None = None, vec: str = "vec") -> DataFrame:
    """I7 search: the rows of each query's ``probes`` nearest lists (by default
    ``IVF_SHARE`` of all) ranked by their exact cosine distance."""
    probes = max(1, round(IVF_SHARE * index.lists)) if probes is None else probes
    q = with_norm(queries.select("query_id", vec), vec)
    unit = q.select(F.col("query_id").alias("key"), _unit(vec, "_norm"))
    pairs = probed(index, unit, probes).withColumn("distance", F.lit(1.0) - dot(F.col("unit"), F.col("q_unit")))
    w = Window.partitionBy("query").orderBy("distance", "key")
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), F.col("rank").cast("bigint").alias("rank"), F.col("key").alias(key), "distance"))


def hash_embed(df: DataFrame, text: str = "text", dim: int = 768, fit_on: DataFrame | None = None):
    """I8: deterministic text vectors — tokenise, hash term counts into
    ``dim`` buckets, weight by IDF (fitted on ``fit_on`` or ``df``),
    L2-normalise; returns ``df`` with ``vec`` (array<double>)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=r"[^\p{L}\p{N}_]+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    idf = IDF(inputCol="_tf", outputCol="_idf")
    norm = Normalizer(inputCol="_idf", outputCol="_v", p=2.0)
    model = Pipeline(stages=[tok, tf, idf, norm]).fit(fit_on if fit_on is not None else df)
    out = model.transform(df)
    return out.withColumn("vec", vector_to_array("_v")).drop("_tok", "_tf", "_idf", "_v")
