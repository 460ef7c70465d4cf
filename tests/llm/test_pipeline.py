"""The corpus pipeline, stage by stage, against brute force on what each stage was given."""

from __future__ import annotations

import hashlib
import string
import time
import uuid
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_operators import WORD, expected_groups, slow_base, slow_fingerprint, slow_groups, slow_spans, slow_targets

from tessera.llm import secrets
from tessera.llm.common import shared_table

SF = "/root/testdata/sf0.001"


def rejected(text):
    """The quality rules in plain Python."""
    t = text or ""
    w = WORD.findall(t)
    n, chars, symbols, dup_lines, _, failed = slow_base(t)
    count = lambda among: sum(t.count(c) for c in among)
    different = sum(len(set(w[i:i + 32_768])) for i in range(0, n, 32_768))
    return (failed or 4 * symbols > n or 2 * count(string.ascii_uppercase) > chars or 4 * t.count("!") > n or chars < 2 * n
            or chars > 20 * n or 20 * different < n or 2 * dup_lines > t.count("\n") + 1 or 2 * count(string.digits) > chars)


def test_every_stage(spark, small):
    docs, seen = small, [small.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = shared_table(stage(spark, docs, SF), f"test-{name}-{uuid.uuid4().hex}")
        seen.append(docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == small.columns
    start, good, single, clean, mixed, packed = seen
    assert Counter(good) == Counter(r for r in start if not rejected(r.text))
    groups = expected_groups([(r.doc_id, r.text) for r in good])
    root = slow_groups({int(f, 16) for _, f, _ in groups})
    firsts = {}
    for r in sorted(good, key=lambda r: r.doc_id):
        firsts.setdefault(root[slow_fingerprint(r.text)], r)
    assert Counter(single) == Counter(firsts.values())
    assert [r.doc_id for r in sorted(clean)] == [r.doc_id for r in sorted(single)]
    after = {r.doc_id: r for r in clean}
    for r in single:
        gone = {i for _, a, b in slow_spans(r.text) for i in range(a, b)} | {
            i for _, a, b in secrets.find_spans(r.text) for i in range(a, b)}
        kept = "".join(c for i, c in enumerate(r.text) if i not in gone)
        marks = after[r.doc_id].text
        for kind, *_ in secrets.RULES:
            marks = marks.replace(f"[{kind}]", "")
        assert marks == kept and after[r.doc_id].n_chars == (len(after[r.doc_id].text) if gone else r.n_chars)
    sizes = Counter()
    for r in clean:
        sizes[r.source] += len(WORD.findall(r.text))
    target, taken, copies = slow_targets(sizes), Counter(), Counter(mixed)
    assert set(copies) <= set(clean) and max(copies.values()) <= 2
    for r, n in copies.items():
        taken[r.source] += n * len(WORD.findall(r.text))
    largest = {s: max(len(WORD.findall(r.text)) for r in clean if r.source == s) for s in sizes}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, whole, places = Tokenizer.from_file(P.path("byte_bpe_50k.json")), Counter(), defaultdict(list)
    for r in packed:
        whole[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for r in mixed:
        want[r.doc_id] += len(tok.encode(r.text, add_special_tokens=False).ids) + 1
    assert whole == want
    for held in places.values():
        ends = [0, *(o + n for o, n in sorted(held))]
        assert [o for o, _ in sorted(held)] == ends[:-1] and ends[-1] <= 1024


def test_the_pipeline_repeats(spark):
    a, b = (Counter(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
            for _ in range(2))
    assert a == b


@pytest.mark.parametrize("text", ["eyJ" * 350_000, "eyJ" * 300_000 + ".abc", "a.eyJ" * 200_000, "eyJabcdefgh." * 100_000])
def test_token_marks_cost_little(text):
    began = time.perf_counter()
    secrets.find_spans(text)
    assert time.perf_counter() - began < 2


def test_tokens_as_the_rule_has_them():
    import random
    import re

    rng = random.Random(2)
    rule = secrets.MORE_RULES[1][1]
    for _ in range(3000):
        text = "".join(rng.choice(["eyJ", "abcdefgh", "x", ".", ".", " ", "eyJabcdefgh", "é"]) for _ in range(rng.randrange(14)))
        assert secrets._jwt_spans(text) == [m.span() for m in re.finditer(rule, text)], text


def test_many_spans_are_cut_in_linear_time():
    text = "key " * 200_000
    spans = [{"kind": "k", "start": 4 * i, "end": 4 * i + 3} for i in range(200_000)]
    began = time.perf_counter()
    out = secrets.cut_spans(text, spans)
    assert out == "[k] " * 200_000 and time.perf_counter() - began < 2
    assert hashlib.sha256(secrets.cut_spans("ab", []).encode()).digest() == hashlib.sha256(b"ab").digest()
