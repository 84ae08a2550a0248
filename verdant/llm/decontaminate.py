"""Operator 8 — benchmark decontamination by spaced seeds (DataFrame functions only).

Texts become words (runs of letters and digits, lower-cased), words become
hashes. A mask names the positions of a short stretch whose words count; the
hash of those words at every position is a seed, so a differing word at an
ignored position does not hide a match. Seeds of documents that occur among
the benchmark's seeds are joined with them on mask and hash, and around every
hit the aligned words are compared: a document is contaminated by an item if
some window of the item, ``WINDOW`` words long or the whole item if it is
shorter, agrees with the document in all but a sixth of its words. The masks
are chosen so that every such window holds a seed; nothing is missed. Items of
fewer than ``LEAST`` words have one seed, all their words in a row, and must
stand in the document word by word.

Documents are passed over once, whatever the size of the benchmark: a bit
filter of the benchmark's seeds (at most ``FILTER_WORDS`` longs, a constant of
the plan) picks the positions worth joining, so that positions are exploded
only where the filter says so; the join with the seeds decides. More seeds than
the filter tells apart cost rows, never a result.

Defined cases: null and empty texts and items have no words and match nothing;
repeated documents and items give one row a (doc_id, item_id); rows with a null
doc_id or item_id count under the null id; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import fresh, stored

WINDOW, LEAST = 12, 8
MASKS = ((0, 1, 2, 3, 5), (0, 1, 4, 5, 6))        # positions of a stretch that count
SHORT = {-n: tuple(range(n)) for n in range(1, LEAST)}      # masks of items of n words: all of them
BEFORE = WINDOW - 6                               # words before a seed that a window with it can reach
NEAR = BEFORE + WINDOW
FILTER_WORDS = 1 << 20                            # 8 MB at most
SALTS = 8


def word_array(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: tuple[int, ...]) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in mask])


def _places(words: Column, mask: tuple[int, ...]) -> Column:
    last = F.size(words) - (mask[-1] + 1)
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _around(words: Column, at: Column) -> Column:
    """The NEAR words around a seed, null outside the text."""
    return F.transform(F.sequence(at - BEFORE, at + WINDOW - 1), lambda i: F.get(words, i))


def item_seeds(items: DataFrame) -> DataFrame:
    """mask, seed, item_id, near (aligned words), window (its length) of every
    seed of every distinct item."""
    texts = items.select("item_id", word_array(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    parts = []
    for m, mask in [*enumerate(MASKS), *SHORT.items()]:
        mine = texts.where(F.size("words") >= LEAST if m >= 0 else F.size("words") == -m)
        placed = mine.select("item_id", "words", F.explode(_places(F.col("words"), mask)).alias("at"))
        parts.append(placed.select(F.lit(m).alias("mask"), _seed(F.col("words"), F.col("at"), mask).alias("seed"), "item_id",
                                   _around(F.col("words"), F.col("at")).alias("near"),
                                   F.least(F.lit(WINDOW), F.size("words")).alias("window")))
    return reduce(DataFrame.unionByName, parts)


def seed_filter(seeds: DataFrame, n: int) -> tuple[Column, int]:
    """A bit array (array<bigint>) of ``n`` distinct seeds (column seed), and its length."""
    size = 1 << 10
    while size < FILTER_WORDS and size < 4 * n:                       # 256 bits a seed where there is room
        size *= 2
    slot = F.pmod("seed", F.lit(64 * size))
    told = seeds.groupBy(F.shiftright(slot, 6).alias("id")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(pmod(seed, {64 * size}L) & 63 as int)))").alias("bits"))
    whole = (seeds.sparkSession.range(size).join(told, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("x"))
             .agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits")))
    return stored(whole, "seed-filter").select("bits").scalar(), size


def document_seeds(docs: DataFrame, masks: dict[int, tuple[int, ...]], bits: Column, size: int) -> DataFrame:
    """mask, seed, doc_id, near of the document seeds that the filter lets pass."""

    def passing(words: Column, filled: Column) -> Column:
        def passes(seed: Column) -> Column:
            slot = F.pmod(seed, F.lit(64 * size))
            return F.getbit(F.get(filled, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

        def of_mask(m: int) -> Column:
            return F.transform(
                F.filter(_places(words, masks[m]), lambda i: passes(_seed(words, i, masks[m]))),
                lambda i: F.struct(F.lit(m).alias("mask"), _seed(words, i, masks[m]).alias("seed"), _around(words, i).alias("near")))
        return F.concat(*map(of_mask, masks))

    # words and filter are bound once a text, and the filter is named once, so that it stays a constant of the
    # plan and is no column of any row
    bound = F.get(F.transform(F.array(word_array(F.col("text"))), lambda w: F.get(
        F.transform(F.array("bits"), lambda b: passing(w, b)), F.lit(0))), F.lit(0))
    hits = docs.select("doc_id", "text", bits.alias("bits")).select("doc_id", bound.alias("hits"))
    # the outer form: the plain one has the seeds looked up once more in a filter for texts without hits
    return (hits.select("doc_id", F.explode_outer("hits").alias("hit")).where(F.col("hit").isNotNull())
            .select("hit.mask", "hit.seed", "doc_id", "hit.near"))


def overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, matched: every contaminated document and item, with the
    most words that agree in one window."""
    seeds = stored(item_seeds(items), "item-seeds")
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    distinct = seeds.select("mask", "seed").distinct()
    by_mask = {r["mask"]: r["count"] for r in distinct.groupBy("mask").count().collect()}
    if not by_mask:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, matched bigint")
    bits, size = seed_filter(distinct, sum(by_mask.values()))
    masks = {m: mask for m, mask in [*enumerate(MASKS), *SHORT.items()] if m in by_mask}
    found = document_seeds(docs, masks, bits, size)
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    hits = (found.withColumnRenamed("near", "doc_near")
            .join(salted, ["mask", "seed", "salt"])
            .select("doc_id", "item_id", "doc_near", "near", "window").distinct())
    same = F.transform(F.sequence(F.lit(0), F.lit(NEAR - 1)), lambda i: F.when(
        F.get("near", i).isNotNull(), F.coalesce((F.get("doc_near", i) == F.get("near", i)).cast("int"), F.lit(0))))
    # windows inside the item: no null among them
    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.lit(NEAR) - F.col("window")),
        lambda s: F.aggregate(F.slice(F.col("same"), s + 1, F.col("window")), F.lit(0), lambda a, x: a + x)))
    judged = hits.withColumn("same", same).select("doc_id", "item_id", "window", best.alias("matched"))
    few = F.when(F.col("window") < LEAST, F.lit(0)).otherwise(F.floor(F.col("window") / 6))      # words that may differ
    return (judged.where(F.col("matched") >= F.col("window") - few)
            .groupBy("doc_id", "item_id").agg(F.max("matched").cast("bigint").alias("matched")))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones (by doc_id)."""
    bad, mark = overlaps(docs, items).select("doc_id").distinct(), fresh(docs.columns, "found")
    return (docs.join(bad.withColumn(mark, F.lit(True)), docs["doc_id"].eqNullSafe(bad["doc_id"]), "left_anti"))
