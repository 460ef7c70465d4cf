from __future__ import annotations

import re
import textwrap
from collections import Counter

import pytest

from tessera.llm import licenses

BY_NAME = {t[:2]: t[2] for t in licenses.TEMPLATES}
PROSE = "An ordinary opening sentence about rivers and towns that has nothing to do with any terms. "


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def slow_scan(rows, templates=licenses.TEMPLATES, t=0.8):
    """Every window from a start to an end that a bigram the template has once says, counted afresh."""
    out = Counter()
    for i, text in rows:
        w = split(text)
        own = list(zip(w, w[1:], strict=False))
        found = []
        for name, form, body in templates:
            tw = split(body)
            tb = list(zip(tw, tw[1:], strict=False))
            count = Counter(tb)
            # only for speed: what no window can do without
            if sum(b in count for b in own) < t / (2 - t) * len(tb) - 1e-9:
                continue
            once = {b: k for k, b in enumerate(tb) if count[b] == 1}
            shifts = {p - once[b] for p, b in enumerate(own) if b in once}
            for s in {max(x, 0) for x in shifts}:
                for e in {min(x + len(tb), len(own)) for x in shifts if -2 * len(tb) < x - s < 2 * len(tb)}:
                    if not t / (2 - t) * len(tb) - 1e-9 <= e - s <= (2 - t) / t * len(tb) + 1e-9:
                        continue
                    common = (Counter(own[s:e]) & count).total()
                    d = 2 * common / (e - s + len(tb))
                    if d >= t:
                        found.append((e - s - 2 * common, -d, s, e, name, form))
        found.sort()
        chosen = []
        for f in found:
            best = not any(o[2] <= f[3] and f[2] <= o[3] for o in chosen)
            if best:
                chosen.append(f)
            out[i, f[2], f[3] + 1, f[4], f[5], round(-f[1], 9), best] += 1
    return out


def fast_scan(d, **more):
    return Counter((r.doc_id, r.start, r.end, r.license, r.form, round(r.dice, 9), r.best)
                   for r in licenses.scan(d, **more).collect())


@pytest.mark.parametrize("data", ["docs", "small"])
def test_scan(data, request):
    d = request.getfixturevalue(data)
    got = fast_scan(d)
    assert got == slow_scan([(r.doc_id, r.text) for r in d.collect()]) and got


def test_nothing(no_docs):
    assert licenses.scan(no_docs).count() == 0


def commented(body, mark, width):
    return "\n".join(f"{mark} {line}" for line in textwrap.wrap(" ".join(body.split()), width, break_long_words=False))


def altered(body, every):
    """Every ``every``-th word replaced."""
    return " ".join("xyzzy" if k % every == every - 1 else w for k, w in enumerate(body.split()))


def cases():
    for k, ((name, form), body) in enumerate(sorted(BY_NAME.items())):
        # wrapped, as a comment, after and before other text
        yield 100 + k, PROSE + "\n" + commented(body, ["#", " *", "//", "--"][k % 4], [40, 60, 79][k % 3]) + "\n" + PROSE, name, form
        # on a line with a copyright
        yield 200 + k, "Copyright (c) 2020 Jane Doe. " + " ".join(body.split()) + " " + PROSE, name, form
        if len(body.split()) > 60:
            yield 300 + k, PROSE + altered(body, 25) + " " + PROSE, name, form
            half = body.split()
            middle = len(half) // 2
            yield 400 + k, " ".join(half[:middle] + ["some", "words", "put", "in", "between"] + half[middle:]), name, form


def test_known_texts_are_found_wrapped_prefixed_and_altered(spark):
    rows = list(cases())
    d = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id int, text string").repartition(3)
    got = [r for r in licenses.scan(d).filter("best").collect()]
    for i, _, name, form in rows:
        assert (name, form) in {(r.license, r.form) for r in got if r.doc_id == i}, (i, name, form)
    whole = {(r.doc_id, r.license, r.form): r.dice for r in got}
    assert all(whole[i, name, form] == 1 for i, _, name, form in rows if i < 300)
    assert fast_scan(d) == slow_scan([(i, t) for i, t, *_ in rows])


def test_edges(spark):
    mit, isc = BY_NAME["MIT", "text"], BY_NAME["ISC", "text"]
    rows = [(1, mit + mit), (2, altered(mit, 12) + " " + mit), (3, "All rights reserved. " * 3000), (4, mit + isc),
            (5, mit), (5, mit), (6, "MIT"), (7, None), (8, PROSE * 50), (9, mit[:len(mit) // 2]),
            (10, "all rights reserved"), (11, "ALL_RIGHTS_RESERVED"), (12, "rights reserved all")]
    d = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    got = fast_scan(d)
    assert got == slow_scan(rows)
    best = Counter((k[0], k[3], k[4]) for k in got.elements() if k[6])
    assert best[1, "MIT", "text"] == 2 and best[2, "MIT", "text"] == 2 and best[5, "MIT", "text"] == 2
    assert best[3, "all-rights-reserved", "notice"] == 3000
    assert best[4, "MIT", "text"] == 1 and best[4, "ISC", "text"] == 1
    assert {k[0] for k in got} == {1, 2, 3, 4, 5, 10, 11}


def test_other_templates_and_thresholds(spark):
    own = [("A", "x", "one two three four five six"), ("B", "x", "one two"), ("C", "x", "alone"),
           ("D", "x", "go go go stop")]
    rows = [(1, "one two three four five six"), (2, "one two three four nine five six"), (3, "go go stop"),
            (4, "go go go go stop"), (5, "alone"), (6, "five six one two three four")]
    d = spark.createDataFrame(rows, "doc_id int, text string")
    for t in (0.5, 0.6, 0.8, 1.0):
        assert fast_scan(d, templates=own, threshold=t) == slow_scan(rows, own, t), t
    for bad in ([], own + own):
        with pytest.raises(ValueError):
            licenses.Templates(spark, bad, 0.8)
    with pytest.raises(ValueError):
        licenses.Templates(spark, own, 0.0)
