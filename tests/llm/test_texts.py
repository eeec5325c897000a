"""Words, substring dedup, contamination and near duplicates against plain definitions."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from ratewise.llm import components, contamination, jaccard, substrings, words as W

from llm_data import alphanumeric, frame, rows, spaced


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é.1\n\t\x00\x1c　", max_size=30)), max_size=8))
def test_words_are_the_expression_s_matches(texts):
    for table, plain in ((W.spaced(), spaced), (W.alphanumeric(), alphanumeric)):
        split, got, hashes = W.Splitter(table), [], []
        for _, _, data, offsets in W.slices(pa.array(texts, pa.string()), 20):
            found = split(data, offsets)
            body = (data if table[65] == 65 else table[data]).tobytes()
            for a, b in zip(found.offsets[:-1], found.offsets[1:]):
                got.append([body[s:e].decode() for s, e in zip(found.starts[a:b], found.ends[a:b])])
                hashes += list(zip(got[-1], found.hashes[a:b].tolist()))
        assert got == [plain(t) for t in texts]
        assert len({h for _, h in hashes}) == len({w for w, _ in hashes}) == len(set(hashes))


def test_windows_differ_unless_words_do_not():
    split = W.Splitter(W.spaced())
    data = np.frombuffer(("a b c " * 40 + "b a c").encode(), np.uint8)
    found = split(data, np.array([0, len(data)]))
    w = data.tobytes().decode().split()
    for length in (1, 2, 3, 5, 20):
        got, want = W.windows(found.hashes, length), [tuple(w[i : i + length]) for i in range(len(w) - length + 1)]
        assert len(got) == len(want)
        assert len(set(zip(got.tolist(), want))) == len(set(got.tolist())) == len(set(want))


def removed(docs, window):
    """{row number: (words, kept words)}; ``docs``: (key, text), judged by ascending key."""
    first, out = {}, {}
    for i, (key, text) in enumerate(docs):
        for s in range(len(spaced(text)) - window + 1):
            k = tuple(spaced(text)[s : s + window])
            first[k] = min(first.get(k, key), key)
    for i, (key, text) in enumerate(docs):
        w, own, gone = spaced(text), set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first[k] < key or k in own:
                gone |= set(range(s, s + window))
            own.add(k)
        out[i] = (len(w), [x for j, x in enumerate(w) if j not in gone])
    return out


@pytest.mark.parametrize("window, start", [(20, None), (6, None), (20, 4), (7, 2)])
def test_substring_dedup(spark, window, start):
    data = rows(2)
    data += [(None, *data[3][1:]), data[9], data[9], (5_000, "la " * 70, *data[0][2:])]
    got = substrings.remove_repeats(frame(spark, data), window, keep=["n_words", "row"], start=start).toDF("doc_id", "text", "clash", "clash2", "n_words", "n_removed", "kept").collect()
    want = removed([(-1 if r[0] is None else r[0], r[1]) for r in data], window)
    want = sorted((repr(data[i][0]), repr(data[i][1]), "clash", n, n - len(kept), " ".join(kept)) for i, (n, kept) in want.items())
    assert sorted((repr(r.doc_id), repr(r.text), r.clash, r.n_words, r.n_removed, r.kept) for r in got) == want
    assert any(r.n_removed for r in got)


def test_passages_of_rows_without_or_with_a_shared_id(spark):
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage, other = some(25), some(25)
    texts = [(None, f"{some(5)} {passage} {some(5)}"), (None, f"{some(7)} {passage}"), (7, f"{some(3)} {other}"), (7, f"{other} {some(9)}"), (8, other)]
    texts += [(None, some(30))] * 3
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = substrings.remove_repeats(docs, 20).collect()
    assert len(got) == len(texts)
    # Exactly one row holds each passage, and one of the three copies stays.
    assert sorted(r.n_removed for r in got) == [0, 0, 0, 25, 25, 25, 30, 30]
    assert sum(passage in r.kept for r in got) == sum(other in r.kept for r in got) == 1
    assert next(r.n_removed for r in got if r.doc_id == 8) == 25


def test_substring_dedup_of_nothing(spark):
    assert substrings.remove_repeats(frame(spark, []), 20).count() == 0
    with pytest.raises(ValueError):
        substrings.remove_repeats(frame(spark, []), 7, start=7)


def contaminated(text, items, window):
    w, hit, found = alphanumeric(text), set(), set()
    for name, body in items:
        q = alphanumeric(body)
        for s in range(max(1, len(q) - window + 1) if q else 0):
            k = q[s : s + window]
            for p in range(len(w) - len(k) + 1):
                if w[p : p + len(k)] == k:
                    hit |= set(range(p, p + len(k)))
                    found.add(name)
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes,chunk", [(1 << 20, 1 << 16), (200, 3)])
def test_contamination(spark, monkeypatch, block_bytes, chunk):
    monkeypatch.setattr(contamination, "CHUNK_PHRASES", chunk)
    monkeypatch.setattr(contamination, "CHUNK_POSTINGS", 4 * chunk)
    data = rows(3)
    data += [(None, *data[1][1:]), data[5], data[5]]
    items = [(1, data[1][1]), (2, "A B! c D"), (10, "word"), (3, None), (4, "..."), (None, "word"), (5, " ".join(["la"] * 20)), (6, data[1][1]), (7, "not there at all")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = contamination.contamination(spark, frame(spark, data), bench, 13, block_bytes=block_bytes).collect()
    want = [(repr(r[0]), *contaminated(r[1], [(str(i), t) for i, t in items if i is not None], 13)) for r in data]
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, sorted(r["items"]), r.contaminated) for r in got) == sorted(want)
    assert any(w[-1] for w in want)
    empty = contamination.contamination(spark, frame(spark, data[:3]), bench.limit(0), 13).collect()
    assert sorted((r.doc_id, r.n_hit, r["items"]) for r in empty) == [(r[0], 0, []) for r in data[:3]]
    assert contamination.contamination(spark, frame(spark, []), bench, 13).count() == 0


def test_many_items(spark):
    """50,000 short items in blocks by bytes."""
    texts = ["w1 w2 w3 w4 w5", "w17 w18 nothing", "w49999 w50000 w50001", ""]
    items = spark.range(50_000).selectExpr("cast(id as string) as item_id", "concat('w', id, ' w', id + 1) as text")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in contamination.contamination(spark, docs, items, 13, block_bytes=200_000).collect()}
    assert [got[d]["items"] for d in range(4)] == [["1", "2", "3", "4"], ["17"], ["49999"], []]
    assert [got[d]["n_hit"] for d in range(4)] == [5, 2, 2, 0]


def test_phrases_and_proximity(spark, tmp_path):
    texts = ["one two three two one", "three two", "x one y two", None, "", "two one", "one " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    index = contamination.build_index(docs, str(tmp_path / "index"), shard_bytes=40)
    asked = [("a", "One two"), ("b", "two one"), ("c", "one one one"), ("d", "absent one"), ("e", "?!")]
    got = sorted((r["query"], r.doc, r.position) for r in contamination.phrase_matches(index, asked).collect())
    want = []
    for d, t in enumerate(texts):
        w = alphanumeric(t)
        for name, q in asked:
            q = alphanumeric(q)
            want += [(name, d, p) for p in range(len(w) - len(q) + 1) if q and w[p : p + len(q)] == q]
    assert got == sorted(want)
    near = sorted((r["query"], r.doc, r.position) for r in contamination.proximity_matches(index, [("p", "one two"), ("q", "three one")], 2).collect())
    # The rarer term is reported: "two" occurs less often than "one", "three" less than both.
    assert near == [("p", 0, 1), ("p", 0, 3), ("p", 2, 3), ("p", 5, 0), ("q", 0, 2)]


def shingles(text, size=5):
    w = alphanumeric(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def linked(data, threshold=0.8):
    sets = [shingles(r[1]) for r in data]
    links = [[j for j in range(len(data)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9] for i in range(len(data))]
    label = [-1 if r[0] is None else r[0] for r in data]
    while True:
        by_id = {}
        for i, r in enumerate(data):
            by_id[r[0]] = min(by_id.get(r[0], label[i]), label[i])
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(len(data))]
        if new == label:
            return label, [len(x) for x in links]
        label = new


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    data = rows(4, 80)
    long = data[2][1].split() + ["tail"] * 3
    data += [(1_000 + i, " ".join(long[:-1] + [f"end{i}"]), *data[0][2:]) for i in range(12)]
    data += [(None, *data[-1][1:])]
    got = {r.doc_id: r for r in jaccard.near_duplicates(frame(spark, data)).collect()}
    assert len(got) == len(data)
    label, n = linked(data)
    for i, r in enumerate(data):
        want = None if label[i] == -1 else label[i]
        assert (got[r[0]].class_id, got[r[0]].n_links) == (want, n[i]), r[:2]
    assert max(n) >= 11


def test_rows_without_ids_are_compared_by_their_own_texts(spark, monkeypatch):
    """A third of the ids null, copies and near copies among them, and a group of more than two blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:-1] + [f"end{i % 14}"]) for i in range(22)] + [" ".join(f"p{i // 2}x{k}" for k in range(30)) + (" tail" if i % 2 else "") for i in range(24)] + ["alone and apart"] * 5
    data = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t, *rows()[0][2:]) for i, t in enumerate(texts)]
    got = sorted((r.n_links for r in jaccard.near_duplicates(frame(spark, data).repartition(4)).collect()))
    label, n = linked(data)
    assert got == sorted(n)
    classes = jaccard.near_duplicates(frame(spark, [(i, *r[1:]) for i, r in enumerate(data)])).collect()
    assert [r.class_id for r in sorted(classes, key=lambda r: r.doc_id)] == linked([(i, *r[1:]) for i, r in enumerate(data)])[0]


def test_repeated_rows_share_a_class(spark):
    data = [(1, "a b c d e f g", *rows()[0][2:])] * 3 + [(2, "a b c d e f g", *rows()[0][2:]), (3, "q r s t u v", *rows()[0][2:])]
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(frame(spark, data)).collect())
    assert got == [(1, 1, 3)] * 3 + [(2, 1, 3), (3, 3, 0)]
    assert jaccard.near_duplicates(frame(spark, [])).count() == 0


def test_banding_meets_the_recall():
    for threshold, recall in ((0.8, 0.999), (0.8, 0.99999), (0.5, 0.9)):
        bands, size = jaccard.banding(threshold, recall)
        assert 1 - (1 - threshold**size) ** bands >= recall and bands * size <= 96
    with pytest.raises(ValueError):
        jaccard.banding(0.05, 0.999999)


def test_shared_counts_over_many_columns(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 80, 40).astype(np.uint64)) for _ in range(9)]
    got = jaccard.shared_counts(sets[:4], sets[4:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.label for r in components.connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 300: 300}


def test_kept_digest_of_empty_text(spark):
    row = substrings.remove_repeats(frame(spark, [rows()[-12]]), 20).collect()[0]
    assert row.text is None and row.kept == "" and hashlib.sha256(row.kept.encode()).hexdigest().startswith("e3b0c442")
