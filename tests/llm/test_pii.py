"""Patterns against their definitions, the field against enumeration, and whole texts."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from ratewise.llm import pii, queries

from llm_data import frame, rows

NEEDLES = ["a.b@c.de", "x@y", "@@", "1.2.3.4", "256.1.1.1", "001.02.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-0123", "+12", " ", "-", ".", "7", "é", "at", "[at] b [dot] c", "\x00", "x" * 70]


def defined(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[\x20-]", "", m.group())
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1]))
        if 13 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(NEEDLES), st.text(alphabet="a1.@+- ()0é", max_size=6)), max_size=12))
def test_patterns_equal_their_definition(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == defined(text)


def test_patterns_on_long_runs():
    long = "a." * 200_000 + "1" * 300_000 + "@" * 50_000 + "+" * 50_000 + "1.2." * 50_000
    assert all(k == "ip" for k, _, _ in pii.base_spans(long))


def segmentations(n, segments):
    """All ways to cut n tokens into outside tokens and given segments."""
    if n == 0:
        yield []
        return
    for head in segmentations(n - 1, segments):
        yield head
    for m, (first, after, scores) in enumerate(segments):
        if after == n:
            for head in segmentations(first, segments):
                for k in range(len(scores)):
                    yield [*head, (m, k)]


def total(field, n, segments, chosen):
    out, state, last = 0.0, 0, 0
    for m, k in [*chosen, (None, None)]:
        first = n if m is None else segments[m][0]
        if first > last:
            out += field.moves[state, 0]
            state = 0
        if m is not None:
            out += field.moves[state, k + 1] + segments[m][2][k]
            state, last = k + 1, segments[m][1]
    return out if last < n else out


def field_of(seed):
    rng = np.random.default_rng(seed)
    moves = rng.normal(0, 1, (5, 5))
    moves[0, 0] = 0
    return pii.Field(rng.normal(0, 0.5, (4, pii.FEATURES)), moves)


@pytest.mark.parametrize("seed", range(6))
def test_the_chosen_segmentation_is_the_best_one(seed):
    field, rng = field_of(seed), random.Random(seed)
    segments = [(a, b, np.random.default_rng(a * 9 + b + seed).normal(-0.5, 2, 4)) for a in range(6) for b in range(a + 1, min(a + 3, 6) + 1) if rng.random() < 0.4]
    chosen = pii.choose(field, segments)
    named = {(a, b): m for m, (a, b, _) in enumerate(segments)}
    span = max((b for _, b, _ in segments), default=0)
    low = min((a for a, _, _ in segments), default=0)
    moved = [(a - low, b - low, s) for a, b, s in segments]

    def value(c):
        # An outside token follows, as it does in a text or at its end.
        return total(field, span - low + 1, moved, c)

    best = max(value(c) for c in segmentations(span - low, moved))
    assert value([(named[f, a], k) for f, a, k in chosen]) == pytest.approx(best)


def test_pruning_changes_nothing():
    texts = ["Call +1 (555) 555-0123 or 4111 1111 1111 1111 10.0.0.1 a.b@c.de now", "x 4111.1111.1111.1111 bob at mail dot com 12345"]
    for seed in range(4):
        field = field_of(seed)
        tokens = pii.Tokens(texts)
        first, after = tokens.candidates(0, tokens.n)
        scores = field.scores(tokens.features(first, after))
        every = pii.choose(field, list(zip(first.tolist(), after.tolist(), scores)))
        assert pii.decode(field, tokens) == every


def test_likelihood_is_normalised_and_its_gradient_right():
    made = [e for i, t in enumerate(["xy 1.2.3.44 z", "a +1 555 555 0123"]) for e in pii.examples(t, pii.base_spans(t), i)][:3]
    assert made
    batch, field = pii.Batch(made), field_of(3)
    loss, by_weight, by_move = batch.loss(field)
    # The definition, by enumeration.
    want = 0.0
    for e in made:
        tokens = pii.Tokens([e.text])
        first, after = tokens.candidates(0, tokens.n)
        segments = list(zip(first.tolist(), after.tolist(), field.scores(tokens.features(first, after))))
        named = {(a, b): m for m, (a, b, _) in enumerate(segments)}
        values = [total(field, tokens.n + 1, segments, c) for c in segmentations(tokens.n, segments)]
        gold = total(field, tokens.n + 1, segments, [(named[f, a], k) for f, a, k in e.entities])
        want += np.logaddexp.reduce(values) - gold
    assert loss == pytest.approx(want / len(made))
    rng = np.random.default_rng(0)
    for _ in range(12):
        k, f = rng.integers(4), int(rng.choice(np.flatnonzero(np.abs(by_weight).sum(axis=0))))
        for which, slope, at in (("weights", by_weight, (k, f)), ("moves", by_move, tuple(rng.integers(0, 5, 2)))):
            if which == "moves" and at == (0, 0):
                continue
            sides = []
            for step in (1e-5, -1e-5):
                weights, moves = field.weights.copy(), field.moves.copy()
                (weights if which == "weights" else moves)[at] += step
                sides.append(batch.loss(pii.Field(weights, moves))[0])
            assert slope[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_places_hold_all_candidates():
    rng = random.Random(5)
    for seed in range(30):
        text = "".join(rng.choice([*NEEDLES, "word ", "longerword" * 9, " bob at mail dot com "]) for _ in range(40))
        field = field_of(seed)
        whole = pii.Tokens([text])
        want = sorted((int(whole.starts[f]), int(whole.ends[a - 1]), k) for f, a, k in pii.decode(field, whole))
        got = sorted((a, b, pii.KINDS.index(k)) for k, a, b, _ in pii.find_in(field, [text], base=False)[0])
        # Context at the edge of a place may read as the edge of the text, so only reachable ranges are compared.
        first, after = whole.candidates(0, whole.n)
        reach = [(int(whole.starts[f]), int(whole.ends[a - 1])) for f, a in zip(first, after)]
        inside = pii.places(text)
        assert all(any(lo <= a and b <= hi for lo, hi in inside) for a, b in reach)
        assert {x[:2] for x in got} <= set(reach) and {x[:2] for x in want} <= set(reach)


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 0")
    return pii.train(docs, sample_places=400)


def test_held_out_accuracy_without_patterns(spark, trained):
    """The field alone finds the plain forms in documents it was not fitted on, and nothing else."""
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 2 = 1").select("text").collect()]
    got = [{s[:3] for s in spans} for spans in pii.find_in(trained, [t or "" for t in texts], base=False)]
    want = [set(pii.base_spans(t or "")) for t in texts]
    both = sum(len(a & b) for a, b in zip(got, want))
    assert both >= 0.97 * sum(map(len, want)) and both >= 0.97 * sum(map(len, got))


@pytest.mark.parametrize("text,span", [
    ("they call (509) 555-6973 then", ("phone", 10, 24)), ("they call 509-555-6973 then", ("phone", 10, 22)), ("of host 10[.]1[.]2[.]3 then", ("ip", 8, 22)),
    ("ask bob.smith at mail dot example dot com, or", ("email", 4, 41)), ("the 4111.1111.1111.1111 the", ("card", 4, 23)),
])
def test_respelled_forms_are_added(trained, text, span):
    assert (*span, False) in pii.find_in(trained, [text])[0]


@pytest.mark.parametrize("text", ["in 1999 and 2004", "number 5927243074273352 of", "version 300.400.500.600 of", "at the dot of 12", "look at 12 dots 345678", "1,234,567.89 or 12:30:45", "the 2024-11-05 day"])
def test_other_numbers_are_left_alone(trained, text):
    assert pii.find_in(trained, [text])[0] == []


def test_base_spans_stay_and_nothing_overlaps_them(trained):
    text = "é a@b.co +1 (826) 555-4081 190.137.223.204 4111 1111 1111 1111"
    spans = pii.find_in(trained, [text])[0]
    base = [s[:3] for s in spans if s[3]]
    assert base == pii.base_spans(text)
    for a, b in itertools.product(spans, spans):
        assert a is b or a[3] == b[3] or a[2] <= b[1] or b[2] <= a[1]
    assert pii.redacted("x a@b.co y", [("email", 2, 8)]) == "x [email] y"


def test_whole_table(spark, trained):
    data = rows(2)
    data[0] = (0, "mail a.b@c.de 1.2.3.4", *data[0][2:])
    data += [(None, "q a.b@c.de", *data[0][2:]), (0, "q a.b@c.de", *data[0][2:]), (7, "1 " * 30_000 + "a@b.cd", *data[0][2:])]
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, tuple(map(tuple, r["spans"]))) for r in pii.find(frame(spark, data), trained).collect()))
    texts = [r[1] or "" for r in data]
    want = sorted((r[0] if r[0] is not None else -1, tuple(s)) for r, s in zip(data, pii.find_in(trained, texts)))
    assert got == want
    assert pii.find(frame(spark, []), trained).collect() == []


def test_the_query_counts_and_digests_plain_forms(spark):
    got = {r["doc_id"]: r for r in queries.op12_pii(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        spans, r = defined(d["text"] or ""), got[d["doc_id"]]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        named = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r["spans"].split(",")) | {""}


def test_without_examples_nothing_is_added(spark):
    field = pii.train(frame(spark, []))
    assert pii.find_in(field, ["call 509-555-6973, 1.2.3.4"]) == [[("ip", 19, 26, True)]]
