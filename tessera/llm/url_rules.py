"""URL filters: listed rules first, mined association rules for the rest.

FP-growth mines combinations of URL tokens that go with a label. Tokens that occur in
exactly the same URLs are one item (their count and the sum of the URLs' hashes agree), so a
URL that makes up a third of the table cannot blow up the item sets. Rules
are pruned by support, by confidence, and when a shorter rule says the same with no less
confidence. Tokens of the listed rules are barred, as they only restate them, and a rule stays only if on labelled URLs
it was not learnt from it is right more often than its verdict is common. Matching goes through an inverted index: a rule is filed under its rarest token, a
URL looks up its tokens, and the rule's other tokens are verified.
"""

from __future__ import annotations

import re

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_table

# (host, path) -> verdict
ListedRules = list[tuple[str, str, str]]


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(h: Column, p: Column, rules: ListedRules) -> Column:
    """The longest rule (by host, then path) that fits, as a struct of ``rule`` and ``verdict``; else null."""
    out = F
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((h == rule_host) | F.endswith(h, F.lit(f".{rule_host}"))) & F.startswith(p, F.lit(rule_path))
        out = out.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict")))
    return out.otherwise(F.lit(None).cast("struct<rule:string,verdict:string>"))


def tokens(h: Column, p: Column) -> Column:
    """The distinct tokens of a URL: host labels with their hyphenated parts, path parts; numbers are one token."""
    parts = F.split(F.concat_ws(" ", F.lower(h), F.lower(p)), r"[^\p{L}\p{N}]+")
    shaped = F.transform(parts, lambda t: F.regexp_replace(t, r"\p{N}+", "0"))
    return F.array_distinct(F.array_remove(shaped, ""))


def restated(rules: ListedRules) -> list[str]:
    """The tokens of the listed rules."""
    parts = re.split(r"[\W_]+", " ".join(h + " " + p for h, p, _ in rules).lower())
    return sorted({re.sub(r"\d+", "0", t) for t in parts if t})


def mine(urls: DataFrame, label: str = "label", items: str = "tokens", min_support: float = 0.01,
         min_confidence: float = 0.9, barred: list[str] | None = None) -> DataFrame:
    """``(verdict, tokens, confidence, support)``: pruned rules tokens -> label, without the ``barred`` tokens.

    ``urls`` has an array of tokens and a label per labelled URL; rows
    without a label or tokens teach nothing; no labelled row gives no rules.
    """
    spark = urls.sparkSession
    data = urls.filter(F.col(label).isNotNull() & (F.size(items) > 0)).select(
        F.array_sort(items).alias("items"), F.col(label).alias("label"))
    data = shared_table(data, "labelled")
    n = data.count()
    empty = "verdict string, tokens array<string>, confidence double, support double"
    if not n:
        return spark.createDataFrame([], empty)
    single = data.select("items", F.explode("items").alias("token"))
    counts = single.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("items").cast("decimal(38,0)")).alias("where"))
    counts = counts.filter((F.col("n") >= n * min_support) & ~F.col("token").isin(*(barred or [""])))
    # tokens of the same URLs become one item, named by the smallest of them
    twins = counts.groupBy("n", "where").agg(F.min("token").alias("item"))
    named = shared_table(counts.join(twins, ["n", "where"]).select("token", "item", "n"), "items")
    basket = data.withColumn("row", F.monotonically_increasing_id())
    basket = shared_table(basket, "baskets")
    kept = basket.select("row", "label", F.explode("items").alias("token")).join(
        named.filter("token = item").select("token"), "token")
    baskets = kept.groupBy("row").agg(F.collect_set("token").alias("t"), F.first("label").alias("label"))
    baskets = shared_table(baskets.select(F.concat("t", F.array(F.concat(F.lit("="), "label"))).alias("items")), "baskets")
    # URLs without a frequent token are in no basket, but count for the support
    held = baskets.count()
    if not held:
        return spark.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=min(min_support * n / held, 1.0), minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.filter(
        F.startswith(F.element_at("consequent", 1), F.lit("="))
        & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))))
    rules = shared_table(rules.select(
        F.substring(F.element_at("consequent", 1), 2, 1 << 20).alias("verdict"),
        F.array_sort("antecedent").alias("tokens"), "confidence", (F.col("support") * held / n).alias("support")), "rules")
    # a rule goes if the same rule without one of its tokens is as sure; chains end at the shortest one
    shorter = rules.filter(F.size("tokens") > 1).select("verdict", "tokens", "confidence", F.explode("tokens").alias("t"))
    shorter = shorter.select("verdict", F.col("tokens").alias("long"), F.array_remove("tokens", F.col("t")).alias("tokens"),
                             F.col("confidence").alias("c"))
    useless = rules.join(shorter, ["verdict", "tokens"]).filter("confidence >= c").select(
        "verdict", F.col("long").alias("tokens")).distinct()
    rules = rules.join(useless, ["verdict", "tokens"], "left_anti").select("verdict", "tokens", "confidence", "support")
    return rules


def index(rules: DataFrame, urls: DataFrame, items: str = "tokens") -> DataFrame:
    """The inverted index: each rule under the token of it that fewest URLs have."""
    counts = urls.select(F.explode(items).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    each = rules.select(F.monotonically_increasing_id().alias("rule_id"), "*")
    each = shared_table(each, "rules").select("*", F.explode("tokens").alias("token"))
    rarest = each.join(counts, "token", "left").groupBy("rule_id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("k"), *[
            F.first(c).alias(c) for c in ("verdict", "tokens", "confidence", "support")])
    return shared_table(rarest.select(F.col("k.token").alias("token"), "verdict", "tokens", "confidence", "support"),
                        "rule_index")


def match(urls: DataFrame, rule_index: DataFrame, key: str, items: str = "tokens") -> DataFrame:
    """Per ``key`` of ``urls`` that some rule fits: ``verdict`` and ``confidence`` of the surest rule."""
    probes = urls.select(key, F.col(items).alias("own"), F.explode(items).alias("token"))
    hits = probes.join(rule_index, "token").filter(F.size(F.array_except("tokens", "own")) == 0)
    # surest, then best supported, then block before allow
    best = F.max(F.struct("confidence", "support", "verdict", "tokens")).alias("b")
    return hits.groupBy(key).agg(best).select(key, F.col("b.verdict").alias("verdict"),
                                              F.col("b.confidence").alias("confidence"),
                                              F.col("b.tokens").alias("tokens"))


def proven(rules: DataFrame, urls: DataFrame, label: str = "label", items: str = "tokens") -> DataFrame:
    """The rules that are right on ``urls`` more often than their verdict is common there, with ``fits`` (labelled
    URLs that the rule fits) and ``lift`` (share of right ones by share of the verdict).

    A rule that fits no labelled URL is out; so are all where the only label is theirs.
    """
    sets = urls.filter(F.col(label).isNotNull()).select(F.array_sort(items).alias("own"), F.col(label).alias("label"))
    sets = shared_table(sets.groupBy("own", "label").agg(F.count(F.lit(1)).alias("n")), "held_out")
    total = sets.agg(F.sum("n")).first()[0] or 0
    common = sets.groupBy(F.col("label").alias("verdict")).agg((F.sum("n") / F.lit(total)).alias("rate"))
    probes = sets.select("own", "label", "n", F.explode("own").alias("token"))
    hits = probes.join(index(rules, sets, "own"), "token").filter(F.size(F.array_except("tokens", "own")) == 0)
    fits = hits.groupBy("verdict", "tokens").agg(
        F.sum("n").alias("fits"), F.sum(F.when(F.col("label") == F.col("verdict"), F.col("n")).otherwise(0)).alias("right"))
    tried = rules.join(fits, ["verdict", "tokens"]).join(common, "verdict")
    lift = F.col("right") / F.col("fits") / F.col("rate")
    return tried.select("verdict", "tokens", "confidence", "support", "fits", lift.alias("lift")).filter("lift > 1")


def decided(judged: DataFrame) -> DataFrame:
    """How many rows of a ``judge`` result each listed or mined rule decides, and how many none does (both null)."""
    return judged.groupBy("rule", "tokens", "verdict").agg(F.count(F.lit(1)).alias("urls"))


def judge(pages: DataFrame, rules: ListedRules, page_id: str = "page_id", url: str = "url",
          default: str = "allow", min_support: float = 0.01, min_confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict, and confidence and tokens of a mined rule.

    The labels to learn from are the verdicts of the listed rules: a URL that
    one of them fits is labelled by it and keeps its verdict; any other URL
    takes the verdict of the surest mined rule, or ``default``. Rules are mined on four fifths of the different labelled
    URLs, by a hash of host and path, and held against the last fifth. A null url,
    or one without ``://``, has an empty host and path; repeated rows are all
    returned; an empty table gives no rows; other columns are not read.
    """
    u = F.col(url).cast("string")
    parsed = pages.select(page_id, host(u).alias("host"), path(u).alias("path"))
    parsed = shared_table(parsed.withColumn("l", listed(F.col("host"), F.col("path"), rules)), "urls")
    urls = parsed.select("host", "path", F.col("l.verdict").alias("label"), tokens(F.col("host"), F.col("path")).alias("tokens"))
    held = F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0
    learnt = mine(urls.filter(~held), min_support=min_support, min_confidence=min_confidence, barred=restated(rules))
    learnt = shared_table(proven(learnt, urls.filter(held)), "proven")
    open_ = urls.filter("label IS NULL").select(F.array_sort("tokens").alias("tokens"))
    # URLs with equal token sets are judged once
    sets = open_.select(F.array_join("tokens", " ").alias("set"), "tokens").groupBy("set").agg(F.first("tokens").alias("tokens"))
    sets = shared_table(sets, "token_sets")
    found = shared_table(match(sets, index(learnt, sets), "set"), "verdicts")
    own = F.when(F.col("l").isNull(), F.array_join(F.array_sort(tokens(F.col("host"), F.col("path"))), " "))
    out = parsed.withColumn("set", own).join(found, "set", "left")
    return out.select(page_id, "host", "path", F.col("l.rule").alias("rule"),
                      F.coalesce("l.verdict", "verdict", F.lit(default)).alias("verdict"), "confidence", "tokens")
