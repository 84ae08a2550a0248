"""Registered queries for conversations (J) and ingestion (A)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdant.operators import chatlog as J
from verdant.operators import ingest as A
from verdant.plans.catalog import register
from verdant.plans.oracle import cte

WS = "[ \\t\\n\\x0B\\f\\r]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


# ------------------------------------------------------------------ J

@register("j1_sessions", """
select conv_id, coalesce(substring(arg_min(text, turn) filter (where role = 'user'), 1, 80), 'Untitled Chat') as title,
  min(turn) as created_turn, max(turn) as last_turn, count(*) as n_turns
from conversations group by conv_id""")
def j1_sessions(t):
    """Session list with titles."""
    return J.sessions(t.raw("conversations"))


@register("j2_transcript", """
select conv_id, turn, case when role = 'user' then 'user' else 'assistant' end as role, text as content
from conversations where text is not null and length(text) > 0""")
def j2_transcript(t):
    """Transcripts with folded roles."""
    return J.transcript(t.raw("conversations"))


_PHRASES = "[" + ", ".join(f"'{p}'" for p in J.BLOCKED_PHRASES) + "]"


@register("j3_blocked_phrases", f"""
select conv_id, turn, len(h) as n_hits, array_to_string(h, ',') as phrases, len(h) > 0 as blocked
from (select conv_id, turn, list_filter({_PHRASES}, lambda p: contains(lower(text), p)) as h
      from conversations where role = 'user') x""")
def j3_blocked_phrases(t):
    """Guarded phrases in every user message."""
    return J.flag_blocked(t.raw("conversations"))


@register("j4_text_slices", """
select conv_id, turn, i as slice_no, substring(text, i * 50 + 1, 50) as slice
from (select conv_id, turn, text,
        unnest(range(cast(greatest(ceil(length(text) / 50), 1) as bigint))) as i
      from conversations) x""")
def j4_text_slices(t):
    """50-character slices of every message, whole texts."""
    return J.slice_text(t.raw("conversations"))


@register("j3_latest_guard", f"""
select conv_id, turn, len(h) as n_hits, array_to_string(h, ',') as phrases, len(h) > 0 as blocked
from (select conv_id, turn, list_filter({_PHRASES}, lambda p: contains(lower(text), p)) as h
      from (select conv_id, max(turn) as turn, arg_max(text, turn) as text from conversations
            where role = 'user' group by 1) u) x""")
def j3_latest_guard(t):
    """J3 as a request guard: the newest user message of every conversation."""
    return J.flag_blocked(t.raw("conversations"), latest_only=True)


@register("j2_transcript_parts", """
select conv_id, turn, case when role = 'user' then 'user' else 'assistant' end as role, text as content
from conversations where text is not null and length(text) > 0""")
def j2_transcript_parts(t):
    """Messages that come in parts (their 50-character slices), joined."""
    turns = t.raw("conversations")
    parts = J.slice_text(turns).join(turns.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    return J.transcript(parts.withColumnRenamed("slice", "text"), part="slice_no")


_AUTHORS = ["user", J.FORMATTER, *J.STEP_DETAIL, "Helper"]


@register("j5_step_trace", f"""
with e as (select conv_id, turn,
             case when role = 'user' then 'user' else {[*_AUTHORS]}[cast(turn * 5 % {len(_AUTHORS)} as integer) + 1] end as author,
             case when turn % 3 = 0 then 'search' end as tool from conversations)
select conv_id, turn, row_number() over (partition by conv_id order by turn) as step, author as agent, tool,
  case when tool is not null then 'calling' else 'processing' end as status,
  case when tool is not null then 'Calling ' || tool || '...'
       {' '.join(f"when author = '{k}' then '{v}'" for k, v in J.STEP_DETAIL.items())}
       else author || ' processing...' end as detail
from e where author not in ('user', '{J.FORMATTER}')""")
def j5_step_trace(t):
    """Steps of every conversation; authors dealt over the turns, every
    third turn a tool call."""
    at = (F.col("turn") * 5 % len(_AUTHORS)).cast("int")
    author = F.when(F.col("role") == "user", "user").otherwise(F.get(F.array(*map(F.lit, _AUTHORS)), at))
    return J.step_trace(t.raw("conversations").withColumns(
        {"author": author, "tool": F.when(F.col("turn") % 3 == 0, F.lit("search"))}))


# ------------------------------------------------------------------ A

def _doc_rows(t, sheet: bool = False):
    """Documents as decoded rows: one row per line, cells split on commas."""
    d = t.raw("documents").select("doc_id", "lang", "text")
    rows = d.select(F.col("doc_id").alias("file_id"), "lang",
                    F.posexplode(F.split("text", "\n")).alias("row_no", "line"))
    return rows.select("file_id", "lang", "row_no", F.split("line", ",").alias("cells"))


cte("m_doc_lines", """
select doc_id as file_id, lang, unnest(range(len(parts))) as row_no, unnest(parts) as line
from (select doc_id, lang, string_split(text, chr(10)) as parts from documents) d
""")


def _pages_sql(kind: str) -> str:
    hdr = 1 if kind == "csv" else 5
    keys = "file_id" if kind == "csv" else "file_id, lang"
    jk = "p.file_id = h.file_id" if kind == "csv" else "p.file_id = h.file_id and p.lang = h.lang"
    label = ("printf('[CSV, Rows %d-%d]', p.f, p.l)" if kind == "csv"
             else "printf('[Sheet: %s, Rows %d-%d]', p.lang, p.f, p.l)")
    lone = "h.header" if kind == "csv" else "'[Sheet: ' || h.lang || ']' || chr(10) || h.header"
    return f"""
with r as (
  select {keys}, row_number() over (partition by {keys} order by row_no) as rn, replace(line, ',', chr(9)) as line
  from m_doc_lines where length({_strip_sql("replace(line, ',', chr(9))")}) > 0),
h as (select {keys}, string_agg(line, chr(10) order by rn) as header from r where rn <= {hdr} group by {keys}),
d as (select *, cast(floor((rn - {hdr} - 1) / 100) as bigint) as page_no from r where rn > {hdr}),
p as (select {keys}, page_no, string_agg(line, chr(10) order by rn) as body, min(rn) as f, max(rn) as l
      from d group by {keys}, page_no)
select {', '.join('p.' + k.strip() for k in keys.split(','))}, p.page_no,
       {label} || chr(10) || h.header || chr(10) || p.body as page_text
from p join h on {jk}
union all
select {', '.join('h.' + k.strip() for k in keys.split(','))}, cast(0 as bigint) as page_no, {lone} as page_text
from h where not exists (select 1 from d where {jk.replace('p.', 'd.')})"""


@register("a3_csv_pages", _pages_sql("csv"))
def a3_csv_pages(t):
    """A3: documents as delimited files (one line = one row) → 100-row pages."""
    return A.rows_to_pages(_doc_rows(t).drop("lang"), kind="csv")


_PART_BYTES = 64 << 20        # of text in one part of a delimited file, about
_FILE_LINE = "concat_ws(chr(9), cast(doc_id as varchar), coalesce(lang, ''), coalesce(source, ''), coalesce(text, ''))"


@register("a3_delimited_file", f"""
with r as (select {_FILE_LINE} as line, row_number() over (order by doc_id) as rn from documents),
p as (select (rn - 1) // 100 as page_no, min(rn) + 1 as lo, max(rn) + 1 as hi, string_agg(line, chr(10) order by rn) as body
      from r group by 1)
select cast(page_no as bigint) as page_no,
  concat('[CSV, Rows ', lo, '-', hi, ']', chr(10), 'doc_id', chr(9), 'lang', chr(9), 'source', chr(9), 'text', chr(10), body) as page_text
from p""")
def a3_delimited_file(t):
    """A3: the documents as one delimited file in parts, texts with commas,
    quotes and line ends in quoted cells, read by splits and paged."""
    from verdant.sources.delimited import read_delimited
    from verdant.streaming.pipelines import scratch
    path = scratch(t.spark, "a3")
    names = ["doc_id", "lang", "source", "text"]
    docs = t.raw("documents").select(F.lit(1).alias("_line"), F.col("doc_id").alias("_at"), *[F.col(c).cast("string") for c in names])
    head = t.spark.range(1).select(F.lit(0).alias("_line"), F.lit(None).cast(docs.schema["_at"].dataType).alias("_at"), *[F.lit(c).alias(c) for c in names])
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // _PART_BYTES))
    (docs.unionByName(head).repartitionByRange(parts, "_line", "_at").sortWithinPartitions("_line", "_at").select(*names)
     .write.csv(path, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False))
    return A.rows_to_pages(read_delimited(t.spark, path, whole=True), kind="csv").select("page_no", "page_text")


@register("a4_sheet_pages", _pages_sql("sheet"))
def a4_sheet_pages(t):
    """A4: documents as sheets named by language → pages with 5 header rows."""
    return A.rows_to_pages(_doc_rows(t), kind="sheet", sheet="lang")


_TOKEN_SQL = A.TOKEN_PATTERN.replace("'", "''")


@register("a6_token_count", f"""
select doc_id, cast(len(regexp_extract_all(text, '{_TOKEN_SQL}')) as bigint) as n_tokens from documents""")
def a6_token_count(t):
    """Token count of every whole document."""
    return t.raw("documents").select("doc_id", A.token_count("text").alias("n_tokens"))


@register("a7_document_chunks", None)
def a7_document_chunks(t):
    """500–600-token chunks of every document, its lines as pages
    (rows-only check; invariants in the tests)."""
    d = t.raw("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "page_text"))
    return A.chunk_documents(d)


@register("a9_narrative_text", f"""
with pages as ({_pages_sql("csv")})
select file_id, page_no, {_strip_sql(
    "case when (starts_with(page_text, '[PDF Page') or starts_with(page_text, '[Sheet:') "
    "or starts_with(page_text, '[CSV,')) and strpos(page_text, chr(10)) > 1 "
    "then substring(page_text, strpos(page_text, chr(10)) + 1) else page_text end")} as content
from pages""")
def a9_narrative_text(t):
    """Page texts with their page label line removed."""
    p = A.rows_to_pages(_doc_rows(t).drop("lang"), kind="csv")
    return A.extract_text(p, "page_text").select("file_id", "page_no", "content")


# Price history written out as one delimited file per symbol, read back
# through pages, tabular extraction, cleaning and coercion.
_PRICE_FIELDS = ["symbol", "date", "low", "high", "close", "volume"]


def _price_files(t):
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("date")).cast("bigint")
    p = t.prices().withColumn("row_no", nth)
    header = F.struct(F.lit(0).cast("bigint").alias("row_no"), F.array(*[F.lit(f) for f in _PRICE_FIELDS]).alias("cells"))
    row = F.struct("row_no", F.array("symbol", *[F.col(f).cast("string") for f in _PRICE_FIELDS[1:]]).alias("cells"))
    # a file's header comes with its first row: the prices are worked out once
    lines = F.when(F.col("row_no") == 1, F.array(header, row)).otherwise(F.array(row))
    return p.select(F.col("symbol").alias("file_id"), F.explode(lines).alias("_l")).select("file_id", "_l.row_no", "_l.cells")


@register("a8_a13_price_file_roundtrip", """
select symbol, date, round(low, 6) as low, round(high, 6) as high, round(close, 6) as close, volume,
  cast(null as double) as open from m_prices""")
def a8_a13_price_file_roundtrip(t):
    """A3 → A8 → A10 → A11 → A13: the whole price table as delimited files,
    paged, extracted with a column mapping, cleaned and coerced back."""
    spark = t.spark
    pages = A.rows_to_pages(_price_files(t), kind="csv").withColumn(
        "chunk_id", F.concat_ws("#", "file_id", F.col("page_no").cast("string")))
    mapping = spark.createDataFrame([(i, f) for i, f in enumerate(_PRICE_FIELDS)], "col_idx int, field string")
    lines = A.extract_tabular(pages.select("chunk_id", F.col("page_text").alias("text")), mapping, long=False)
    rec = lines.select("chunk_id", "line_no", F.transform_values(
        "record", lambda field, value: F.when(field == "date", A.normalize_date(value))
                                        .when(field == "symbol", value)
                                        .otherwise(A.clean_numeric(value))).alias("record"))
    typed = A.coerce_prices(rec)
    return typed.select("symbol", F.col("date").cast("date").alias("date"), "low", "high", "close",
                        "volume", "open")


_DATE_SPARK = ["yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyy/MM/dd", "MM-dd-yyyy", "dd-MM-yyyy",
               "yyyyMMdd", "MMM dd, yyyy", "dd MMM yyyy", "MMMM dd, yyyy"]
_DATE_DUCK = ["%Y-%m-%d", "%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%m-%d-%Y", "%d-%m-%Y", "%Y%m%d",
              "%b %d, %Y", "%d %b %Y", "%B %d, %Y"]
_DATE_GUARD = [r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$",
               r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}-\d{1,2}-\d{4}$", r"^\d{1,2}-\d{1,2}-\d{4}$",
               r"^\d{8}$", r"^[A-Za-z]{3} \d{1,2}, \d{4}$", r"^\d{1,2} [A-Za-z]{3} \d{4}$",
               r"^[A-Za-z]+ \d{1,2}, \d{4}$"]


@register("a10_normalize_dates", f"""
with s as (
  select l_orderkey, l_linenumber,
    case l_linenumber % 10 {' '.join(f"when {i} then strftime(l_shipdate, '{f}')" for i, f in enumerate(_DATE_DUCK))} end
      as raw
  from lineitem)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, raw,
  coalesce({', '.join(f"case when regexp_matches(raw, '{g}') then strftime(try_strptime(raw, '{f}'), '%Y-%m-%d') end"
                      for f, g in zip(_DATE_DUCK, _DATE_GUARD))}, raw) as normalized
from s""")
def a10_normalize_dates(t):
    """A10: every ship date rendered in one of the ten formats, normalised."""
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    k = F.col("l_linenumber") % 10
    raw = F.lit(None).cast("string")
    for i, f in enumerate(_DATE_SPARK):
        raw = F.when(k == i, F.date_format("l_shipdate", f)).otherwise(raw)
    s = li.select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return s.withColumn("normalized", A.normalize_date("raw"))


@register("a11_clean_numeric", """
with s as (
  select l_orderkey, l_linenumber,
    case l_linenumber % 7
      when 0 then '$' || format('{:,.2f}', l_extendedprice)
      when 1 then cast(l_discount * 100 as varchar) || '%'
      when 2 then '#N/A'
      when 3 then '-'
      when 4 then cast(l_quantity as varchar) || 'x'
      when 5 then ' ' || cast(l_tax as varchar) || ' '
      else cast(cast(l_quantity as bigint) as varchar) || '_000' end as raw
  from lineitem),
c as (select *, regexp_replace(regexp_replace(raw, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'),
                               '[,$%]', '', 'g') as v0,
             regexp_replace(raw, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') as s from s)
select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, raw,
  case when s is null or s = '' then ''
       when s in ('#N/A', '#N/A N/A', 'N/A', '#VALUE!', '#REF!', '#DIV/0!', '-', '--', 'None', 'nan') then ''
       when regexp_matches(regexp_replace(v0, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g'),
            '^[+-]?((\\d(_?\\d)*)(\\.(\\d(_?\\d)*)?)?|\\.\\d(_?\\d)*)([eE][+-]?\\d(_?\\d)*)?$')
         then regexp_replace(v0, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')
       else '' end as cleaned
from c""")
def a11_clean_numeric(t):
    """Numeric strings with currency, thousands, percent, error markers
    and junk, cleaned."""
    li = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
                                  "l_quantity", "l_tax")
    k = F.col("l_linenumber") % 7
    raw = (F.when(k == 0, F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)))
            .when(k == 1, F.concat((F.col("l_discount") * 100).cast("string"), F.lit("%")))
            .when(k == 2, F.lit("#N/A")).when(k == 3, F.lit("-"))
            .when(k == 4, F.concat(F.col("l_quantity").cast("string"), F.lit("x")))
            .when(k == 5, F.concat(F.lit(" "), F.col("l_tax").cast("string"), F.lit(" ")))
            .otherwise(F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit("_000"))))
    s = li.select("l_orderkey", "l_linenumber", raw.alias("raw"))
    return s.withColumn("cleaned", A.clean_numeric("raw"))


def _price_payloads(t):
    """One JSON payload per symbol and year, in three shapes: a plain array,
    a fenced block, one object per line."""
    p = t.prices().select("symbol", "date", "close", "volume", F.year("date").alias("y"))
    g = p.groupBy("symbol", "y").agg(F.collect_list(F.struct(
        "symbol", F.col("date").cast("string").alias("date"), "close", "volume")).alias("recs"))
    arr = F.to_json("recs")
    lines = F.array_join(F.transform("recs", lambda x: F.to_json(x)), "\n")
    kind = F.col("y") % 3
    payload = (F.when(kind == 0, arr)
                .when(kind == 1, F.concat(F.lit("```json\n"), arr, F.lit("\n```")))
                .otherwise(lines))
    return g.select("symbol", "y", payload.alias("payload"))


@register("a12_a13_record_decode", """
select symbol, date, round(close, 6) as close, volume from m_prices""")
def a12_a13_record_decode(t):
    """A12 → A13: the price table as JSON payloads (plain, fenced, one object
    per line), decoded tolerantly and coerced."""
    recs, _ = A.decode_records(_price_payloads(t).drop("symbol"))
    typed = A.coerce_prices(recs)
    return typed.select("symbol", F.col("date").cast("date").alias("date"), "close", "volume")


@register("a14_esg_coercion", """
select symbol, date, provider, round(e_score, 6) as e_score, round(s_score, 6) as s_score,
  round(g_score, 6) as g_score, round(composite_score, 6) as composite_score from m_esg""")
def a14_esg_coercion(t):
    """ESG rows as records with the 'composite' key, coerced back."""
    e = t.esg()
    rec = e.select(F.create_map(
        F.lit("symbol"), F.col("symbol"), F.lit("date"), F.col("date").cast("string"),
        F.lit("provider"), F.col("provider"), F.lit("e_score"), F.col("e_score").cast("string"),
        F.lit("s_score"), F.col("s_score").cast("string"), F.lit("g_score"), F.col("g_score").cast("string"),
        F.lit("composite"), F.col("composite_score").cast("string"),
        F.lit("composite_score"), F.lit("-1")).alias("record"))
    return A.coerce_esg(rec)


@register("a15_company_coercion", "select * from m_companies")
def a15_company_coercion(t):
    """Company rows as records with string flags, coerced back."""
    c = t.companies()
    rec = c.select(F.create_map(
        F.lit("symbol"), F.concat(F.lit(" "), F.col("symbol")), F.lit("name"), F.col("name"),
        F.lit("sector"), F.col("sector"), F.lit("sub_industry"), F.col("sub_industry"),
        F.lit("restricted_business"), F.upper(F.col("restricted_business").cast("string")),
        F.lit("severe_controversy"), F.col("severe_controversy").cast("string")).alias("record"))
    return A.coerce_companies(rec)


@register("a16_melt_sheet", """
select symbol, date, provider, round(composite_score, 6) as composite_score from m_esg""")
def a16_melt_sheet(t):
    """Composite scores pivoted to one column per provider (a wide
    sheet), melted back to long rows."""
    e = t.esg().select("symbol", "date", "provider", "composite_score")
    wide = e.groupBy("symbol", "date").pivot("provider", ["A", "N", "R"]).agg(F.first("composite_score"))
    return A.melt(wide, ["symbol", "date"], "provider", "composite_score")


_TW = A.TYPE_WORDS


def _hits_sql(words):
    return " + ".join(
        f"cast(regexp_matches(lower(page_text), '(^|[^\\p{{L}}\\p{{N}}_]){w}($|[^\\p{{L}}\\p{{N}}_])') as integer)"
        for w in words)


@register("a17_classify_pages", f"""
with pages as ({_pages_sql("csv")}),
m as (select file_id, page_no, page_text,
        cast(length(regexp_replace(page_text, '[^0-9]', '', 'g')) as double) / greatest(length(page_text), 1) as digit_share,
        cast(length(regexp_replace(page_text, '[^\\p{{L}}]', '', 'g')) as double) / greatest(length(page_text), 1) as letter_share
      from pages)
select file_id, page_no,
  case when {_hits_sql(_TW['esg_scores'])} >= 2 then 'esg_scores'
       when {_hits_sql(_TW['price_data'])} >= 2 then 'price_data'
       when {_hits_sql(_TW['company_meta'])} >= 2 then 'company_meta'
       when letter_share >= 0.5 and digit_share < 0.1 then 'research_text' else 'unknown' end as chunk_type,
  case when strpos(lower(page_text), 'lseg') > 0 then 'lesg'
       when strpos(lower(page_text), 'bloomberg') > 0 then 'bloomberg' else 'unknown' end as provider,
  round(digit_share, 6) as digit_share
from m""")
def a17_classify_pages(t):
    """Rule-based type and provider of every document page."""
    p = A.rows_to_pages(_doc_rows(t).drop("lang"), kind="csv")
    c = A.classify_chunks(p, "page_text")
    return c.select("file_id", "page_no", "chunk_type", "provider", "digit_share")


@register("a18_validate_prices", """
select symbol, date,
  concat_ws(',', case when symbol is null or date is null or close is null then 'missing_field' end,
    case when low <= 0 or high <= 0 or close <= 0 then 'non_positive_price' end,
    case when low > close then 'low_above_close' end,
    case when volume < 0 then 'negative_volume' end,
    case when date > date '2024-01-01' then 'future_date' end) as errors,
  concat_ws(',', case when not regexp_matches(coalesce(symbol, ''), '^[A-Z]{1,5}$') then 'symbol_format' end,
    case when date < date '2000-01-01' then 'date_before_2000' end) as warnings,
  case when low <= 0 or high <= 0 or close <= 0 or low > close or volume < 0 or date > date '2024-01-01'
            or close is null then 'rejected' else 'valid' end as status
from m_prices""")
def a18_validate_prices(t):
    """Price rows checked (errors reject, warnings pass)."""
    v = A.validate_prices(t.prices().withColumn("open", F.lit(None).cast("double")), "2024-01-01")
    return v.select("symbol", "date", F.array_join("errors", ",").alias("errors"),
                    F.array_join("warnings", ",").alias("warnings"), "status")


@register("a18_validate_esg", """
select symbol, date, provider,
  concat_ws(',', case when e_score < 0 or e_score > hi then 'e_score_out_of_range' end,
    case when s_score < 0 or s_score > hi then 's_score_out_of_range' end,
    case when g_score < 0 or g_score > hi then 'g_score_out_of_range' end,
    case when composite_score < 0 or composite_score > hi then 'composite_score_out_of_range' end) as errors
from (select *, case when provider = 'bloomberg' then 10 else 100 end as hi
      from (select symbol, date, case when provider = 'A' then 'bloomberg' else provider end as provider,
              e_score, s_score, g_score * 1.5 as g_score, composite_score from m_esg) x) y""")
def a18_validate_esg(t):
    """A18 for ESG: provider A as the one with the 0–10 scale, and g scores
    half as high again, against the scales."""
    e = t.esg().withColumns({"provider": F.when(F.col("provider") == "A", "bloomberg").otherwise(F.col("provider")),
                             "g_score": F.col("g_score") * 1.5})
    return A.validate_esg(e).select("symbol", "date", "provider", F.array_join("errors", ",").alias("errors"))


@register("a20_upsert_prices", """
with tgt as (select symbol, date, low, high, close, volume from m_prices where date < date '1996-01-01'),
b as (select symbol, date, close * 1.01 as close, 1 as seq from m_prices where date >= date '1995-07-01'
      union all
      select symbol, date, close * 1.02 as close, 2 as seq from m_prices
      where date >= date '1995-12-01' and date < date '1996-01-01'),
bl as (select symbol, date, arg_max(close, seq) as close from b group by 1, 2)
select coalesce(bl.symbol, tgt.symbol) as symbol, coalesce(bl.date, tgt.date) as date,
  round(tgt.low, 6) as low, round(tgt.high, 6) as high,
  round(case when bl.symbol is not null then bl.close else tgt.close end, 6) as close, tgt.volume
from tgt full outer join bl on tgt.symbol = bl.symbol and tgt.date = bl.date""")
def a20_upsert_prices(t):
    """1995 price history upserted with a later batch that re-states
    half a year (last arrival wins for keys sent twice); columns the batch
    lacks keep their old values."""
    p = t.prices()
    tgt = p.where(F.col("date") < F.lit("1996-01-01").cast("date")).select(
        "symbol", "date", "low", "high", "close", "volume")
    b1 = p.where(F.col("date") >= F.lit("1995-07-01").cast("date")).select(
        "symbol", "date", (F.col("close") * 1.01).alias("close"), F.lit(1).alias("seq"))
    b2 = p.where((F.col("date") >= F.lit("1995-12-01").cast("date"))
                 & (F.col("date") < F.lit("1996-01-01").cast("date"))).select(
        "symbol", "date", (F.col("close") * 1.02).alias("close"), F.lit(2).alias("seq"))
    return A.upsert(tgt, b1.unionByName(b2), ["symbol", "date"])


@register("a21_orphan_prices", """
select p.symbol, p.date from m_prices p
where not exists (select 1 from m_companies c where c.symbol = p.symbol and ascii(right(c.symbol, 1)) % 5 <> 0)""")
def a21_orphan_prices(t):
    """Price rows whose symbol is not a listed company (quarantine);
    every fifth last letter is taken off the list."""
    listed = t.companies().where(F.ascii(F.expr("right(symbol, 1)")) % 5 != 0)
    _, orphans = A.quarantine_orphans(t.prices().select("symbol", "date"), listed)
    return orphans


cte("m_jobs", """
with r as (
  select user_id as job_id, ts, event_type != 'error' as ok,
    '{"type": "' || event_type || '", "records_stored": ' ||
      coalesce(nullif(regexp_extract(props, '"k"\\s*:\\s*(\\d+)', 1), ''), '0') || '}' as result_text
  from events),
x as (select job_id, ts, ok, nullif(regexp_extract(result_text, '"type"\\s*:\\s*"([^"]+)"', 1), '') as typ,
        coalesce(try_cast(nullif(regexp_extract(result_text, '"records_stored"\\s*:\\s*(\\d+)', 1), '') as bigint), 0) as n
      from r),
bt as (select job_id, typ, sum(n) as n from x where ok and typ is not null and n > 0 group by 1, 2),
rec as (select job_id, string_agg(typ || ':' || cast(n as varchar), ',' order by typ || ':' || cast(n as varchar))
          as records_stored, cast(sum(n) as bigint) as records_total from bt group by 1),
g as (select job_id, count(*) as total_chunks, count(*) filter (where ok) as chunks_processed,
        count(*) filter (where not ok) as errors, min(ts) as started_at, max(ts) as completed_at
      from x group by 1),
j as (select user_id as job_id from events union select c_custkey from customer)
select j.job_id, coalesce(total_chunks, 0) as total_chunks, coalesce(chunks_processed, 0) as chunks_processed,
  coalesce(errors, 0) as errors, started_at, completed_at, rec.records_stored, rec.records_total,
  case when total_chunks is null then 'failed' when errors = 0 then 'completed' else 'completed_with_errors' end
    as status
from j left join g on g.job_id = j.job_id left join rec on j.job_id = rec.job_id
""")


def _ledger(t):
    ev = t.raw("events")
    res = ev.select(
        F.col("user_id").alias("job_id"), "ts", (F.col("event_type") != "error").alias("ok"),
        F.concat(F.lit('{"type": "'), F.col("event_type"), F.lit('", "records_stored": '),
                 F.coalesce(F.nullif(F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1), F.lit("")), F.lit("0")),
                 F.lit("}")).alias("result_text"))
    # chunks come from the events, jobs also from the customers; those without events never got a chunk
    jobs = ev.select(F.col("user_id").alias("job_id")).unionByName(
        t.raw("customer").select(F.col("c_custkey").alias("job_id")))
    return A.job_ledger(res, chunk_ok=F.col("ok"), jobs=jobs)


@register("a22_job_ledger", "select * from m_jobs")
def a22_job_ledger(t):
    """Per-job ledger from chunk results (events as jobs' chunks)."""
    return _ledger(t).select("job_id", "total_chunks", "chunks_processed", "errors", "started_at",
                             "completed_at", "records_stored", "records_total", "status")


@register("a23_job_history", """
select * from m_jobs order by started_at desc, job_id desc limit 20""")
def a23_job_history(t):
    """The 20 newest jobs."""
    led = _ledger(t).select("job_id", "total_chunks", "chunks_processed", "errors", "started_at",
                            "completed_at", "records_stored", "records_total", "status")
    return A.job_history(led, 20)


# ------------------------------------------------ A1, A2, A5, A18, A19

@register("a1_a2_file_manifest", None)
def a1_a2_file_manifest(t):
    """A1 + A2: manifest (size, SHA-256, signature check, accept / reject)
    and reader routing for every file of the table folder."""
    m = A.file_manifest(t.spark, t.sf_dir)
    return A.route_by_format(m).select("file_name", "extension", "file_size", "file_sha256",
                                       "accepted", "reject_reason", "reader")


def _html_parts(t):
    """Decoded parts of the web pages: each page of a file is one paragraph
    block; list items are table rows, the tag-stripped paragraph is text."""
    p = t.raw("pages").select(F.col("page_id").alias("file_id"),
                              F.posexplode(F.split("html", "<p>")).alias("page_no", "seg"))
    rows = p.select("file_id", "page_no",
                    F.posexplode(F.regexp_extract_all("seg", F.lit("<li>(.*?)</li>"), 1)).alias("part_no", "cell"))
    rows = rows.select("file_id", "page_no", "part_no", F.lit("row").alias("kind"),
                       F.regexp_replace("cell", "<[^>]*>", "\t").alias("text"))
    text = p.select("file_id", "page_no", F.lit(0).alias("part_no"), F.lit("text").alias("kind"),
                    A.strip_ws(F.regexp_replace(F.regexp_replace("seg", "<[^>]*>", " "), " +", " ")).alias("text"))
    return rows.unionByName(text)


@register("a5_document_pages", """
with p as (select page_id as file_id, unnest(range(len(segs))) as page_no, unnest(segs) as seg
           from (select page_id, string_split(html, '<p>') as segs from pages) x),
r as (select file_id, page_no, unnest(range(len(cells))) as part_no, unnest(cells) as cell
      from (select file_id, page_no, regexp_extract_all(seg, '<li>(.*?)</li>', 1) as cells from p) y),
parts as (
  select file_id, page_no, 0 as o, part_no, regexp_replace(cell, '<[^>]*>', chr(9), 'g') as text from r
  union all
  select file_id, page_no, 1 as o, 0 as part_no,
    regexp_replace(regexp_replace(regexp_replace(seg, '<[^>]*>', ' ', 'g'), ' +', ' ', 'g'),
                   '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') as text from p),
g as (select file_id, page_no,
        regexp_replace(string_agg(text, chr(10) order by o, part_no, text),
                       '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') as body
      from parts where text is not null group by 1, 2)
select file_id, page_no, '[PDF Page ' || cast(page_no as varchar) || ']' || chr(10) || body as page_text
from g where length(body) > 0""")
def a5_document_pages(t):
    """A5: web pages decoded into table-row and text parts, assembled into
    '[PDF Page n]' pages."""
    return A.assemble_pages(_html_parts(t))


@register("a18_validation_stats", """
select count(*) as total,
  count(*) filter (where not (low <= 0 or high <= 0 or close <= 0 or low > close or volume < 0
                   or date > date '2024-01-01' or close is null)) as valid,
  count(*) filter (where low <= 0 or high <= 0 or close <= 0 or low > close or volume < 0
                   or date > date '2024-01-01' or close is null) as rejected,
  count(*) filter (where not regexp_matches(coalesce(symbol, ''), '^[A-Z]{1,5}$')
                   or date < date '2000-01-01') as with_warnings,
  'price_data' as kind
from m_prices""")
def a18_validation_stats(t):
    """A18 stats: totals of the price validation."""
    v = A.validate_prices(t.prices().withColumn("open", F.lit(None).cast("double")), "2024-01-01")
    return A.validation_stats(v, "price_data")


@register("a19_store_by_type", """
select 'price_data' as record_type, count(*) as records_found, count(*) as records_stored, 'ok' as status from m_prices
union all select 'esg_scores', count(*), count(*), 'ok' from m_esg
union all select 'company_meta', count(*), count(*), 'ok' from m_companies
union all select 'research_text', count(*), count(*), 'ok' from documents
union all select 'unknown', count(*), 0, 'no_target' from conversations""")
def a19_store_by_type(t):
    """One batch of typed records (prices, ESG, companies, knowledge
    texts, and messages of no known type) stored twice, one table per type;
    counts by type of what was found and stored."""
    from verdant.streaming.pipelines import scratch

    def rows(kind, df):
        return df.select(F.lit(kind).alias("record_type"), F.to_json(F.struct("*")).alias("payload"))

    batch = rows("unknown", t.raw("conversations"))
    for kind, df in (("price_data", t.prices()), ("esg_scores", t.esg()), ("company_meta", t.companies()),
                     ("research_text", t.raw("documents").select("doc_id", "source", "text"))):
        batch = batch.unionByName(rows(kind, df))
    root = scratch(t.spark, "a19")
    targets = {k: f"{root}/{k}" for k in ("price_data", "esg_scores", "company_meta", "research_text")}
    A.store_by_type(batch, targets, batch_id=1)
    return A.store_by_type(batch, targets, batch_id=1)


@register("a19_stored_prices", """
select symbol, date, round(close * case when date >= date '1996-01-01' then 2 else 1 end, 6) as close from m_prices""")
def a19_stored_prices(t):
    """A19 read side: prices stored in one batch, those from 1996 on restated
    in a second; the newest row of every key is read."""
    from verdant.streaming.pipelines import scratch
    p = t.prices().select(F.lit("price_data").alias("record_type"), "symbol", "date", "close")
    path = scratch(t.spark, "a19p")
    A.store_by_type(p, {"price_data": path}, batch_id=1)
    late = p.where(F.col("date") >= F.lit("1996-01-01").cast("date")).withColumn("close", F.col("close") * 2)
    A.store_by_type(late, {"price_data": path}, batch_id=2)
    return A.stored_table(t.spark, path, ["symbol", "date"])
