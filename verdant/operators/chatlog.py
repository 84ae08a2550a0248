"""Conversation tables (J1–J5): sessions, transcripts, blocked phrases, text
slices and step traces over ``turns(conv_id, turn, role, text)``.

All work is per conversation or per row; nothing is collected per session
beyond one value (``min_by`` / ``max_by`` keep a single text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Session title length and placeholder, guard phrases (matched as
# lower-cased substrings), slice width.
TITLE_CHARS = 80
UNTITLED = "Untitled Chat"
BLOCKED_PHRASES = [
    "crypto prediction", "guaranteed returns", "insider trading",
    "pump and dump", "get rich quick", "hack", "exploit",
]
SLICE_CHARS = 50
# The author whose events are the answer itself, and the detail
# text of the other authors' steps.
FORMATTER = "ResponseBeautifier"
STEP_DETAIL = {
    "InvestmentAdvisorRouter": "Routing to specialist...",
    "SectorAnalyst": "Analyzing sectors...",
    "CompanyAnalyst": "Analyzing companies...",
    "PortfolioOptimizer": "Optimizing portfolio...",
    "InvestmentEducator": "Searching knowledge base...",
    "QualityJudge": "Validating response...",
}


def sessions(turns: DataFrame) -> DataFrame:
    """Per conversation, title = first 80 characters of its first user
    message (else 'Untitled Chat'), first and last turn, turn count; newest
    first."""
    is_user = F.col("role") == "user"
    g = turns.groupBy("conv_id").agg(
        F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("_first_user"),
        F.min("turn").alias("created_turn"),
        F.max("turn").alias("last_turn"),
        F.count(F.lit(1)).alias("n_turns"),
    )
    title = F.coalesce(F.substring("_first_user", 1, TITLE_CHARS), F.lit(UNTITLED))
    return (g.select("conv_id", title.alias("title"), "created_turn", "last_turn", "n_turns")
             .orderBy(F.desc("last_turn"), F.desc("conv_id")))


def transcript(turns: DataFrame, part: str | None = None) -> DataFrame:
    """Messages in turn order with the role folded to user / assistant;
    empty texts dropped. Long form (one row per message). With ``part`` (the
    position column) a message's parts are joined in their order first."""
    if part is not None:
        texts = F.transform(F.array_sort(F.collect_list(F.struct(part, "text"))), lambda x: F.coalesce(x["text"], F.lit("")))
        turns = turns.groupBy("conv_id", "turn", "role").agg(F.array_join(texts, "").alias("text"))
    return (turns.where(F.col("text").isNotNull() & (F.length("text") > 0))
                 .select("conv_id", "turn",
                         F.when(F.col("role") == "user", F.lit("user")).otherwise(F.lit("assistant"))
                          .alias("role"),
                         F.col("text").alias("content")))


def _phrase_hits(text_col: str):
    low = F.lower(F.col(text_col))
    return F.filter(F.array(*[F.lit(p) for p in BLOCKED_PHRASES]), lambda p: F.contains(low, p))


def flag_blocked(turns: DataFrame, latest_only: bool = False) -> DataFrame:
    """User messages containing a guarded phrase (lower-cased substring,
    so 'hackathon' matches 'hack'). ``latest_only`` checks only each
    conversation's latest user message, as a request-time guard would."""
    u = turns.where(F.col("role") == "user")
    if latest_only:
        u = u.groupBy("conv_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("m")) \
             .select("conv_id", "m.turn", "m.text")
    hits = _phrase_hits("text")
    return u.select("conv_id", "turn", F.size(hits).cast("bigint").alias("n_hits"),
                    F.array_join(hits, ",").alias("phrases"),
                    (F.size(hits) > 0).alias("blocked"))


def slice_text(turns: DataFrame, width: int = SLICE_CHARS, text: str = "text") -> DataFrame:
    """Fixed-width slices of each whole text with their position."""
    n = F.greatest(F.ceil(F.length(text) / width), F.lit(1)).cast("int")
    starts = F.sequence(F.lit(0), n - 1)
    pieces = F.transform(starts, lambda i: F.substring(F.col(text), i * width + 1, width))
    return turns.select("conv_id", "turn", F.posexplode(pieces).alias("slice_no", "slice"))


def step_trace(events: DataFrame, author: str = "author", tool: str = "tool") -> DataFrame:
    """Numbered steps per conversation — every event with an author other
    than the user and the formatter; an event that calls a tool says so, the
    others show their author's detail text."""
    known = F.create_map(*[x for k, v in STEP_DETAIL.items() for x in (F.lit(k), F.lit(v))])
    name, called = F.col(author), F.col(tool).isNotNull()
    ev = events.where((F.coalesce(F.length(name), F.lit(0)) > 0) & ~name.isin("user", FORMATTER))
    w = Window.partitionBy("conv_id").orderBy("turn")
    return ev.select("conv_id", "turn", F.row_number().over(w).cast("bigint").alias("step"), name.alias("agent"),
                     F.col(tool).alias("tool"), F.when(called, "calling").otherwise("processing").alias("status"),
                     F.when(called, F.concat(F.lit("Calling "), F.col(tool), F.lit("...")))
                     .otherwise(F.coalesce(known[name], F.concat(name, F.lit(" processing...")))).alias("detail"))
