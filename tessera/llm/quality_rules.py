"""Quality rules as a short-circuit cascade.

A rule is a condition that rejects a text. On a bounded sample each rule's share of rejected
texts and its cost (the time of a run over the sample) are measured; rules are ordered by
rejection per cost and become the branches of one CASE expression, which Spark leaves at
the first branch that holds. The order changes the time a run takes and which rule
is named, never which texts are kept.
"""

from __future__ import annotations

import string
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import let, shared_table, words
from tessera.llm.text_stats import SYMBOLS, base_stats, count_of, repeated_lines, repeated_words, word_chars

# Distinct words grow slower than words, so they are counted in windows of so many words.
WINDOW = 32_768


def distinct_words(w: Column) -> Column:
    """Distinct words of each window, added up; in texts of one window the distinct words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(WINDOW))
    return F.aggregate(starts, F.lit(0), lambda n, at: n + F.size(F.array_distinct(F.slice(w, at, WINDOW))))


# name -> (text, its words) -> whether the text is rejected
Rules = dict[str, Callable[[Column, Column], Column]]

BASE_RULES: Rules = {
    "few_words": lambda t, w: F.size(w) < 20,
    "repeats": lambda t, w: 100 * repeated_words(w) > 30 * F.size(w),
}
METHOD_RULES: Rules = {
    "symbols": lambda t, w: 4 * count_of(t, SYMBOLS) > F.size(w),
    "shouting": lambda t, w: 2 * count_of(t, string.ascii_uppercase) > word_chars(w),
    "exclamations": lambda t, w: 4 * count_of(t, "!") > F.size(w),
    "short_words": lambda t, w: word_chars(w) < 2 * F.size(w),
    "long_words": lambda t, w: word_chars(w) > 20 * F.size(w),
    "few_different_words": lambda t, w: 20 * distinct_words(w) < F.size(w),
    "repeated_lines": lambda t, w: 2 * repeated_lines(t) > F.size(F.split(t, "\n")),
    "digits": lambda t, w: 2 * count_of(t, string.digits) > word_chars(w),
}


def _apply(text: Column, body: Callable[[Column, Column], Column]) -> Column:
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return let(whole, lambda t: let(words(t), lambda w: body(t, w)))


def measured(docs: DataFrame, rules: Rules, text: str = "text", sample_rows: int = 2000,
             seed: int = 7) -> list[tuple[str, float, float]]:
    """``(rule, share rejected, seconds)`` on a sample of about ``sample_rows`` rows,
    by rejection per second, best first."""
    texts = docs.select(F.col(text).cast("string").alias("t"))
    # the share that gives so many rows: each task keeps its own few, nothing moves
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = shared_table(texts.sample(share, seed) if share < 1 else texts, "rule_sample")
    total = F.count(F.lit(1))

    def run(column: Column) -> tuple[tuple, float]:
        began = time.perf_counter()
        row = sample.agg(total, F.sum(column.cast("int"))).first()
        return row, time.perf_counter() - began

    run(F.length("t") < 0)
    floor = min(run(F.length("t") < 0)[1] for _ in range(2))
    out = []
    for name, rule in rules.items():
        condition = _apply(F.col("t"), rule)
        runs = [run(condition) for _ in range(2)]
        n, hits = runs[0][0]
        out.append((name, (hits or 0) / n if n else 0.0, max(min(s for _, s in runs) - floor, 1e-4)))
    return sorted(out, key=lambda x: (-x[1] / x[2], x[2], x[0]))


def cascade(docs: DataFrame, rules: Rules, text: str = "text") -> Column:
    """The first rule, in the measured order, that rejects the text; null: kept."""
    order = [name for name, _, _ in measured(docs, rules, text)]

    def branches(t: Column, w: Column) -> Column:
        out = F
        for name in order:
            out = out.when(rules[name](t, w), name)
        return out.otherwise(F.lit(None).cast("string"))

    return _apply(F.col(text), branches)


def keep_good(docs: DataFrame, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged.

    A null or empty text has no words and is rejected as too short; repeated
    rows are judged alike; an empty table stays empty.
    """
    return docs.filter(cascade(docs, rules or BASE_RULES | METHOD_RULES, text).isNull())


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base statistics, ``base_failed`` and ``kept`` for every row."""
    verdict = cascade(docs, METHOD_RULES, text)
    s = docs.select(doc_id, base_stats(F.col(text)).alias("s"), verdict.isNull().alias("passed"))
    flat = s.select(doc_id, "s.*", "passed")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return flat.select(doc_id, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & F.col("passed")).alias("kept"))
