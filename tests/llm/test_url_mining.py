from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import queries, url_rules

SF = "/root/testdata/sf0.01"


def prepared(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    d = pages.select("page_id", url_rules.host(F.col("url")).alias("host"), url_rules.path(F.col("url")).alias("path"))
    d = d.withColumn("label", url_rules.listed(F.col("host"), F.col("path"), queries.URL_RULES)["verdict"])
    return d.withColumn("tokens", url_rules.tokens(F.col("host"), F.col("path")))


def test_restated_tokens_are_barred(spark):
    assert url_rules.restated(queries.URL_RULES) == ["com", "de", "en", "example", "fr", "net", "org"]
    rules = url_rules.mine(prepared(spark), min_support=0.01, min_confidence=0.5, barred=["com", "example", "de"]).collect()
    assert rules and not any({"com", "example", "de"} & set(r.tokens) for r in rules)
    n = prepared(spark).filter("label IS NOT NULL").collect()
    for r in rules:
        right = sum(set(r.tokens) <= set(x.tokens) and x.label == r.verdict for x in n)
        assert math.isclose(right / len(n), r.support) and r.support >= 0.01


def test_rules_that_do_not_beat_the_base_rate_go(spark):
    rows = [(["a", "x"], "block")] * 6 + [(["a", "y"], "allow")] * 2 + [(["b"], "allow")] * 8 + [(["c"], "block")] * 4 + \
        [(["c", "d"], None)] * 9
    urls = spark.createDataFrame(rows, "tokens array<string>, label string")
    rules = spark.createDataFrame([("block", ["a"], 0.9, 0.1), ("block", ["a", "x"], 0.9, 0.1), ("allow", ["a"], 0.9, 0.1),
                                   ("allow", ["b"], 0.9, 0.1), ("block", ["b"], 0.9, 0.1), ("block", ["never"], 1.0, 0.5),
                                   ("block", ["d"], 1.0, 0.5)],
                                  "verdict string, tokens array<string>, confidence double, support double")
    got = {(r.verdict, tuple(r.tokens)): (r.fits, round(r.lift, 9)) for r in url_rules.proven(rules, urls).collect()}
    assert got == {("block", ("a",)): (8, 1.5), ("block", ("a", "x")): (6, 2.0), ("allow", ("b",)): (8, 2.0)}
    assert url_rules.proven(rules, urls.filter("label = 'block'")).count() == 0
    assert url_rules.proven(rules, urls.limit(0)).count() == 0 and url_rules.proven(rules.limit(0), urls).count() == 0


def test_verdicts_follow_rules_that_hold_on_unseen_urls(spark):
    got = queries.op2_url_filter(spark, SF).collect()
    judged = url_rules.judge(spark.read.parquet(f"{SF}/pages.parquet"), queries.URL_RULES)
    counts = url_rules.decided(judged).collect()
    assert sum(r.urls for r in counts) == len(got)
    barred = set(url_rules.restated(queries.URL_RULES))
    mined = [r for r in counts if r.tokens]
    assert not any(barred & set(r.tokens) for r in mined)
    assert Counter(r.verdict for r in got) == sum((Counter({r.verdict: r.urls}) for r in counts), Counter())
    # an open URL that a mined rule decides has all of its tokens
    for r in judged.filter("tokens IS NOT NULL AND rule IS NULL").collect():
        own = {re.sub(r"\d+", "0", t) for t in re.split(r"[\W_]+", f"{r.host} {r.path}".lower())}
        assert set(r.tokens) <= own and r.confidence >= 0.9


def test_a_site_blocked_by_its_neighbours(spark):
    """URLs of a blocked site that no listed rule fits are blocked by its token; those of other sites are not."""
    rows = [(i, f"http://casino{'abc'[i % 3]}.example.com/de/{i}") for i in range(600)]
    rows += [(1000 + i, f"http://garden{'abc'[i % 3]}.org/fr/{i}") for i in range(600)]
    rows += [(2000, "http://casinoa.example.com/en/1"), (2001, "http://gardena.org/en/1"), (2002, "http://other.info/de/1")]
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r for r in url_rules.judge(d, queries.URL_RULES).collect()}
    assert got[2000].verdict == "block" and got[2000].tokens == ["casinoa"] and got[2000].rule is None
    assert got[2001].verdict == "allow" and got[2001].tokens == ["gardena"]
    assert got[2002].verdict == "allow" and got[2002].tokens is None


def test_very_long_urls(spark):
    many = "/".join(f"part{chr(97 + i % 26)}x{i % 977}y{i}" for i in range(60_000))
    rows = [(1, "http://a.example.com/de/" + many), (2, "http://" + "b" * 1_000_000 + ".net/"), (3, "http://c.info/" + many),
            (4, "http://a.example.com/en/?" + "q" * 1_000_000), (5, "x" * 1_000_000)] * 2
    d = spark.createDataFrame(rows, "page_id long, url string")
    got = url_rules.judge(d, queries.URL_RULES).collect()
    assert Counter((r.page_id, r.rule) for r in got) == Counter(
        {(1, "example.com/de/"): 2, (2, "net/"): 2, (3, None): 2, (4, None): 2, (5, None): 2})
    assert all(len(r.path) == len("/") + len(many) for r in got if r.page_id == 3)
    assert all((r.host, r.path) == ("", "") for r in got if r.page_id == 5)
