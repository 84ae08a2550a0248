"""Operator 7 — association-rule URL filter (DataFrame functions only).

A url becomes the set of its tokens. Tokens that the very same labelled urls
hold are one class, so that what always comes together is mined once. Spark's
FP-growth mines the classes of labelled pages, each with its label as one more
item; rules that conclude ``bad`` with enough support, confidence and lift
stay, less those implied by a shorter rule. Rules are matched by an inverted
index: page tokens join classes and these the rules, and a rule fires when a
token of each of its classes is met. Stated host/path rules are looked at
first; the longest that fits decides.

Left out before mining, as no minimal rule can hold them: tokens of every
labelled url (neither confidence nor lift change with them), tokens of too few
bad urls, and classes that are rules alone. The number of sets that FP-growth
looks at is bounded by the support threshold and the classes, not by the pages.

Defined cases: a null url or one without ``://`` has an empty host and path, no
tokens beyond those of its text, and falls to the mined rules; repeated rows are
judged alike; pages without label take no part in mining; with no labelled
page, or no rule that is sure enough, the method allows; other columns are
ignored.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdant.llm.common import stored

BAD = "label:bad"             # cannot be a token: tokens are letters and digits
SALTS = 16
MIN_URLS = 5                  # bad labelled urls behind a rule, unless the caller says otherwise


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, paths that start with ``path``."""
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


STATED = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
          Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(url, F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, F.substr(known, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), path


def stated_rule(host: Column, path: Column, rules: tuple[Rule, ...] = STATED) -> tuple[Column, Column]:
    """Text and verdict of the longest stated rule that fits (null: none)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """Distinct lower-case runs of letters and digits of a url."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(url, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def folded(seen: DataFrame, need: float) -> DataFrame:
    """token, class, n, n_bad of the tokens of ``seen`` (url, bad, tokens) that
    are in ``need`` bad urls or more but not in all urls. Tokens of the very
    same urls are one class, named after the first of them: no set that holds
    several of them says more than a set with one."""
    total = seen.select(F.count("*")).scalar()
    told = (seen.select("url", "bad", F.explode("tokens").alias("token"))
            .groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"),
                                  F.bit_xor(F.xxhash64("url", "bad")).alias("a"), F.bit_xor(F.xxhash64("bad", "url")).alias("b"))
            .where((F.col("n_bad") >= need) & (F.col("n") < total)))
    first = told.groupBy("n", "n_bad", "a", "b").agg(F.min("token").alias("class"))
    return told.join(first, ["n", "n_bad", "a", "b"]).select("token", "class", "n", "n_bad")


def mine_classes(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float,
                 min_urls: int = MIN_URLS) -> tuple[DataFrame, DataFrame]:
    """Minimal rules (rule bigint, classes array, confidence, support) from
    ``labelled`` (url, bad boolean), and the token, class of every class;
    repeated urls of one label count once. Classes that are sure alone are
    rules and not extended; all others are mined, however common, and a set
    that holds a shorter rule is dropped, looked up size by size. A rule needs
    a share of ``min_support`` and ``min_urls`` of the urls."""
    spark = labelled.sparkSession
    empty = (spark.createDataFrame([], "rule bigint, classes array<string>, confidence double, support double"),
             spark.createDataFrame([], "token string, class string"))
    seen = stored(labelled.select(tokens(F.col("url")).alias("tokens"), "url", "bad").distinct(), "url-tokens")
    total, bad = seen.agg(F.count("*"), F.count_if("bad")).first()
    if not bad:
        return empty
    need = max(min_support * total, min_urls)
    by_token = stored(folded(seen, need), "url-classes")
    classes = by_token.groupBy("class").agg(F.first("n").alias("n"), F.first("n_bad").alias("n_bad"))
    confidence = F.col("n_bad") / F.col("n")
    sure = (confidence >= min_confidence) & (confidence / (bad / total) >= min_lift)
    alone = classes.where(sure).select(F.array("class").alias("classes"), confidence.alias("confidence"),
                                       (F.col("n_bad") / total).alias("support"))
    open_ = classes.where(~sure).select("class")
    items = (seen.select("url", "bad", F.explode("tokens").alias("token"))
             .join(by_token.where("token = class").select("token"), "token").join(open_.withColumnRenamed("class", "token"), "token")
             .groupBy("url", "bad").agg(F.collect_list("token").alias("told")))
    items = items.select(F.when(F.col("bad"), F.concat("told", F.array(F.lit(BAD)))).otherwise(F.col("told")).alias("items"))
    met = items.count()
    if not met:
        return alone.withColumn("rule", F.xxhash64("classes")).select(*empty[0].columns), by_token.select("token", "class")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (need - 0.5) / met), minConfidence=0.0).fit(items)
    sets = (model.freqItemsets.where(F.array_contains("items", BAD) & (F.size("items") > 1))
            .select(F.array_sort(F.array_remove("items", BAD)).alias("classes"), F.col("freq").alias("n_bad")))
    whole = model.freqItemsets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("classes"), F.col("freq").alias("n"))
    sets = stored(sets.join(whole, "classes").select("classes", F.size("classes").alias("k"), F.xxhash64("classes").alias("rule"),
                                                     confidence.alias("confidence"), (F.col("n_bad") / total).alias("support"), sure.alias("sure")),
                  "url-sets")
    rules, longest = alone.withColumn("rule", F.xxhash64("classes")).select(*empty[0].columns), sets.agg(F.max("k")).first()[0] or 0
    done = sets.where("false").select("rule")                         # sets one shorter that are rules or hold one
    for k in range(1, longest + 1):
        now = sets.where(F.col("k") == k)
        less = now.select("rule", F.explode("classes").alias("out"), "classes").select(
            F.col("rule").alias("set"), F.xxhash64(F.array_remove("classes", F.col("out"))).alias("rule"))
        covered = less.join(done, "rule", "left_semi").select(F.col("set").alias("rule")).distinct()
        found = now.where("sure").join(covered, "rule", "left_anti")
        rules = rules.unionByName(found.select(*empty[0].columns))
        done = stored(found.select("rule").unionByName(covered), "url-covered")
    return rules, by_token.select("token", "class")


def mine(labelled: DataFrame, min_support: float, min_confidence: float, min_lift: float,
         min_urls: int = MIN_URLS) -> DataFrame:
    """The rules of ``mine_classes`` (rule bigint, tokens array, confidence,
    support) with every choice of one token a class written out."""
    rules, members = mine_classes(labelled, min_support, min_confidence, min_lift, min_urls)
    all_of = members.groupBy("class").agg(F.collect_list("token").alias("any"))
    choices = (rules.select("rule", F.explode("classes").alias("class")).join(all_of, "class")
               .groupBy("rule").agg(F.collect_list("any").alias("any")))
    product = F.reduce("any", F.array(F.array().cast("array<string>")), lambda done, more: F.flatten(
        F.transform(done, lambda d: F.transform(more, lambda t: F.concat(d, F.array(t))))))
    return (rules.join(choices, "rule").select(F.explode(product).alias("tokens"), "confidence", "support")
            .select(F.array_sort("tokens").alias("tokens"), "confidence", "support")
            .select(F.xxhash64("tokens").alias("rule"), "tokens", "confidence", "support"))


def fired(urls: DataFrame, rules: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct urls (column ``url``) that hold a token of every class of at
    least one rule, with the surest of them: url, mined_rule (its classes' names
    joined by a space)."""
    index = rules.select("rule", F.size("classes").alias("n"), "confidence", "classes", F.explode("classes").alias("class"))
    met = (urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
           .join(members, "token").select("url", "class").distinct()
           .join(index, "class")
           .groupBy("url", "rule").agg(F.count("*").alias("met"), F.first("n").alias("n"),
                                       F.first("confidence").alias("confidence"), F.first("classes").alias("classes"))
           .where("met = n"))
    name = F.array_join("classes", " ")
    return met.groupBy("url").agg(F.max_by(name, F.struct("confidence", name)).alias("mined_rule"))


def judge(pages: DataFrame, labels: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6,
          min_lift: float = 1.5, rules: tuple[Rule, ...] = STATED, min_urls: int = MIN_URLS) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule of every page. ``labels``
    (page_id, bad); several labels of a page all count as observations. A mined
    rule needs a share of ``min_support`` and ``min_urls`` of the labelled urls."""
    pages = pages.select("page_id", "url")
    labelled = pages.join(labels.where("bad is not null").select("page_id", "bad"), "page_id").select("url", "bad")
    mined, members = mine_classes(labelled, min_support, min_confidence, min_lift, min_urls)
    mined = stored(mined, "url-rules")
    host, path = host_and_path(F.col("url"))
    text, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    open_urls = (pages.withColumns({"host": host, "path": path}).where(text.isNull())
                 .select(F.coalesce("url", F.lit("")).alias("url")).distinct())
    blocked = fired(open_urls, mined, members).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("url", "key")
    keyed = pages.withColumns({"key": F.coalesce("url", F.lit("")),
                               "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    return (keyed.join(blocked, ["key", "salt"], "left")
            .withColumns({"host": host, "path": path})
            .withColumns({"rule": text, "stated": verdict})
            .select("page_id", "host", "path", "rule",
                    F.coalesce("stated", F.when(F.col("mined_rule").isNotNull(), "block").otherwise("allow")).alias("verdict"),
                    F.when(F.col("rule").isNull(), F.col("mined_rule")).alias("mined_rule")))
