"""Token files, packing, fingerprints, scoring, counts, languages and URL lists against plain definitions."""

import datetime
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from ratewise.llm import counts, encoding, fingerprints, idfiles, language, packing, scoring, urls, words as W

from llm_data import alphanumeric, frame, rows

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["It's DON'T we'll.", "<|endoftext|> a<|startoftext|>.", "a.<|ENDOFTEXT|>b", "né̀ Ǆ İstanbul ﬁ K", "x1,2. 3.", "...", "a . b", "tab\tnbsp x　y", "😀ok. ok😀.", "ΑΣ. Σ,"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def encoder():
    return encoding.UnitEncoder(WORD)


def encoded(encoder, texts, limit):
    out = []
    for _, _, data, offsets in W.slices(pa.array(texts, pa.string()), limit):
        ids, ends = encoder.encode(data, offsets)
        assert encoder.lengths(data, offsets).tolist() == np.diff(ends).tolist()
        out += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aBcsdt'.,<|> \n1éÉ̀İΣ!"), st.characters(codec="utf-8")), max_size=25), max_size=5))
def test_units_give_the_tokenizer_s_ids(texts):
    from tokenizers import Tokenizer

    global _one
    if "_one" not in globals():
        _one = (Tokenizer.from_file(WORD), encoding.UnitEncoder(WORD))
    assert encoded(_one[1], texts, 1 << 20) == [_one[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_odd_texts_and_a_full_cache(tokenizer, encoder, monkeypatch):
    monkeypatch.setattr(encoding, "CACHE", 5)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in ODD * 2]
    assert encoded(encoder, ODD * 2, 1 << 20) == want
    assert encoded(encoder, ODD * 2, 10) == want


def test_id_files_round_trip(spark, tmp_path, tokenizer):
    data = rows(5) + [(1000 + i, t, *rows()[0][2:]) for i, t in enumerate(ODD)]
    data += [(None, *data[1][1:]), data[7], data[7]]
    root = str(tmp_path / "ids")
    manifest = idfiles.write_ids(frame(spark, data).repartition(5), root, WORD, end_id=1)
    assert manifest.agg(F.sum("docs")).first()[0] == len(data)
    got = idfiles.read_ids(spark, root).toPandas().sort_values("start")
    ordered = sorted(data, key=lambda r: (-1 if r[0] is None else r[0]))
    want = [[*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in ordered]
    assert [list(x) for x in got["ids"]] == want
    assert got["doc"].tolist() == [idfiles.NO_ID if r[0] is None else r[0] for r in ordered]
    assert got["start"].tolist() == np.cumsum([0, *[len(w) for w in want]])[:-1].tolist()
    assert got["ids_crc32"].tolist() == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]
    assert [x.tolist() for x in idfiles.find_document(spark, root, 1001)] == [want[[r[0] for r in ordered].index(1001)]]
    assert len(idfiles.find_document(spark, root, data[7][0])) == 3 and idfiles.find_document(spark, root, 1) == []


def test_id_files_of_nothing_and_a_wrong_dictionary(spark, tmp_path):
    idfiles.write_ids(frame(spark, []), str(tmp_path / "none"), WORD)
    assert idfiles.read_ids(spark, str(tmp_path / "none")).count() == 0
    root = str(tmp_path / "bad")
    manifest = idfiles.write_ids(frame(spark, rows(n=5)), root, WORD)
    next((tmp_path / "bad").glob("*.dict")).write_bytes(b"other")
    with pytest.raises(ValueError):
        idfiles.ShardReader(root, manifest.first()["name"])


def test_the_dictionary_helps_short_documents():
    rng = np.random.default_rng(1)
    phrases = [rng.integers(0, 49_000, 12).astype("<u2").tobytes() for _ in range(40)]
    docs = [b"".join(phrases[i] for i in rng.integers(0, 40, 6)) for _ in range(2_000)]
    import zstandard

    body = idfiles.train_dictionary(docs[:1_000], 8 << 10)
    with_it = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(body))
    assert sum(len(with_it.compress(d)) for d in docs[1_000:]) < 0.8 * sum(len(zstandard.compress(d)) for d in docs[1_000:])


def slow_fit(lengths, marks, capacity):
    left, held, used, out = [], [], [], []
    for n, m in zip(lengths, marks):
        fit = [(left[b], b) for b in range(len(left)) if left[b] >= n and not held[b] & m]
        b = min(fit)[1] if fit else len(left)
        if not fit:
            left.append(capacity)
            held.append(0)
        out.append((b, capacity - left[b]))
        left[b] -= n
        held[b] |= m
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 15)), max_size=60))
def test_best_fit_takes_the_tightest_bin(items):
    items = sorted(items, reverse=True)
    lengths, marks = [i[0] for i in items], [i[1] for i in items]
    assert packing.best_fit(lengths, marks, 12) == slow_fit(lengths, marks, 12)


@pytest.mark.parametrize("shard_docs", [4096, 20])
def test_packing_keeps_every_token_and_no_conflict(spark, shard_docs):
    given_rows = [(i, None if i % 17 == 4 else (i * 37) % 230, "hot" if i % 3 == 0 else f"s{i % 7}" if i % 5 else None, f"c{i // 4}") for i in range(150)]
    given_rows += [given_rows[9], given_rows[9], (None, 5, None, None)]
    frame_ = spark.createDataFrame(given_rows, "doc_id long, n_tokens long, source string, bin_id string")
    got = packing.pack(frame_, 100, ["source", "bin_id"], shard_docs=shard_docs).toPandas()
    assert got["length"].sum() == sum(r[1] or 0 for r in given_rows)
    assert len(got) == sum(max(1, math.ceil((r[1] or 0) / 100)) for r in given_rows)
    notes = {r[0]: r for r in given_rows}
    for _, group in got.groupby("bin_id"):
        group = group.sort_values(["start", "length"])
        assert group["start"].tolist() == np.concatenate([[0], group["length"].cumsum()[:-1]]).tolist() and group["length"].sum() <= 100
        for k in (2, 3):
            names = [notes[None if pd.isna(i) else int(i)][k] for i in group["doc_id"]]
            names = [x for x in names if x is not None]
            assert len(names) == len(set(names))
    assert packing.pack(frame_.limit(0), 100, ["source"]).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame_, 0, [])


def test_packing_documents(spark, tokenizer):
    data = rows(6, 30)
    got = packing.pack_documents(frame(spark, data), WORD, capacity=64).groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r[0]: r[1] for r in got} == {r[0]: len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in data}


@pytest.mark.parametrize("bucket_rows", [1000, 7])
def test_edited_texts_and_likeness(spark, bucket_rows, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(fingerprints.with_next, "__defaults__", (bucket_rows,))
    data = rows(7) + [(None, "first. one\ntwo", *rows()[0][2:])]
    got = {r.doc_id: r for r in fingerprints.fingerprints(frame(spark, data)).collect()}
    ordered = sorted(data, key=lambda r: -1 if r[0] is None else r[0])
    assert len(got) == len(data)
    for i, r in enumerate(ordered):
        text, after = r[1] or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        g = got[r[0]]
        assert (g.n_chars, g.edited) == (len(text), text[: len(text) - half] + after[:half])
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        assert (g.near_next == 1) == (got[ordered[(i + 1) % len(ordered)][0]].fingerprint == g.fingerprint)
    prints = defaultdict(set)
    for r in data:
        prints[r[1]].add(got[r[0]].fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_fingerprints_are_sums_of_paragraphs(spark):
    texts = ["a b. c\nd", "d\na b. c", "a b. c", "d", "a b.\nc\nd", "", None, "\n" * 5, "d\nd"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("v", fingerprints.vector("text"))
    v = {r.i: r for r in df.withColumn("f", fingerprints.digest(F.col("v"))).collect()}
    assert v[0].f == v[1].f and v[5].f == v[6].f == v[7].f == "0" * 448
    assert len({v[i].f for i in (0, 2, 3, 4, 5, 8)}) == 6
    pair = spark.createDataFrame([(v[2].v, v[3].v, v[0].v)], "a array<long>, b array<long>, c array<long>")
    made = pair.select(fingerprints.inserted("a", "b").alias("i"), fingerprints.deleted("c", "b").alias("d"), fingerprints.deleted("b", "c").alias("e")).first()
    assert made.i == v[0].v and made.d == v[2].v
    again = spark.createDataFrame([(made.e, v[0].v)], "a array<long>, b array<long>").select(fingerprints.inserted("a", "b").alias("x")).first()
    assert again.x == v[3].v


def test_fingerprints_of_few_and_repeated_rows(spark):
    other = rows()[0][2:]
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    one = fingerprints.fingerprints(frame(spark, [(4, "abcd", *other)])).first()
    assert one.edited == "abab" and one.near_next == 1
    many = fingerprints.fingerprints(frame(spark, [(4, "abcd", *other)] * 3 + [(4, "zz", *other)])).collect()
    assert len(many) == 4


def test_likeness_of_long_and_unpunctuated_texts(spark):
    rng = np.random.default_rng(6)
    some = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    lines, long, signs = "The same line again.\n" * 5_000, some(4_000), "".join(chr(0x4E00 + x) for x in rng.integers(0, 20_000, 3_000))
    pairs = [(lines, lines[: len(lines) // 2]), ("A line.\n" * 4_096, "A line.\n" * 2_048), (long, " ".join([*long.split()[:2_000], some(2_000)])), (signs, signs[:1_500] + signs[:1_500][::-1]), (long, some(4_000))]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    df = df.withColumn("va", fingerprints.vector("a")).withColumn("vb", fingerprints.vector("b"))
    got = df.select("i", fingerprints.likeness(F.col("va"), F.col("vb")).alias("x"), fingerprints.digest(F.col("va")).alias("f")).orderBy("i").collect()
    assert got[0].x == pytest.approx(1) and got[1].x == pytest.approx(1)
    assert all(0.3 < got[i].x < 0.75 for i in (2, 3)) and got[4].x < 0.3
    # Lanes beyond 12 bits are in the digest as well.
    assert len(got[0].f) == 448 + 128 * 5 and len(got[2].f) == 448


def plain_codes(texts, radius):
    for t in texts:
        b = [*([scoring.OUTSIDE] * radius), *(t or "").encode(), *([scoring.OUTSIDE] * radius)]
        yield [b[i : i + 2 * radius + 1] for i in range(len(b) - 2 * radius)]


def test_scoring_evaluates_equal_neighbours_once(monkeypatch):
    """Windows that differ in their token alone share one row of the network, whatever the size of the weights."""
    data = np.frombuffer(b"abcaacabcabbabc", np.uint8)
    codes = np.unique(scoring._token_last(scoring.windows(data, np.array([0, 5, 15])), scoring.RADIUS))
    codes = scoring._token_last(codes, scoring.RADIUS, back=True)
    assert sorted(codes) == sorted(set(scoring.windows(data, np.array([0, 5, 15]))))
    twins = np.sort(np.concatenate([codes, codes ^ (np.uint64(3) << np.uint64(9 * scoring.RADIUS))]))
    twins = scoring._token_last(np.sort(scoring._token_last(twins, scoring.RADIUS)), scoring.RADIUS, back=True)
    seen, unpack = [], scoring._unpack
    monkeypatch.setattr(scoring, "_unpack", lambda c, r: seen.append(len(c)) or unpack(c, r))
    for scale in (1, 1000):
        network = scoring.Network.fresh()
        network.w *= scale
        around, token = unpack(twins, scoring.RADIUS)
        _, logits = network._forward(around)
        want = logits[np.arange(len(token)), token] - np.log(np.exp(logits).sum(1))
        seen.clear()
        assert network.log_probability(twins, block=4) == pytest.approx(want, rel=1e-4, abs=1e-4)
        assert sum(seen) == len({tuple(a) for a in around}) < len(twins)


def test_scoring_evaluates_kept_windows_once(monkeypatch):
    """Windows of earlier slices are not evaluated again, and a table that most windows find taken changes no value."""
    data = np.frombuffer(b"abcaacabcabbabc", np.uint8)
    codes = scoring.windows(data, np.array([0, 5, 15]))
    network, seen = scoring.Network.fresh(), []
    known = dict(zip(codes, network.log_probability(codes)))
    plain = network.log_probability
    monkeypatch.setattr(network, "log_probability", lambda c: seen.append(len(c)) or plain(c))
    for bits in (16, 1):
        kept = scoring.Kept(np.float32, bits)
        for part in (codes[:9], codes, codes[::-1], codes[:0]):
            got = network.kept_log_probability(part, kept)
            assert got == pytest.approx(np.array([known[c] for c in part]), abs=1e-5)
        if bits == 16:
            assert sum(seen) == len(set(codes)) and seen[2:] == [0, 0]


def test_a_task_adds_up_its_windows():
    """One row per window of a task whatever the number of slices; where places are taken the counts still come out whole."""
    texts = [["abcabc", None, "", "x"], ["abcabc", "żó"], ["abcabc"] * 3]
    batches = [pa.RecordBatch.from_arrays([pa.array(t)], names=["text"]) for t in texts]
    want = Counter(tuple(p) for places in plain_codes([x for t in texts for x in t], scoring.RADIUS) for p in places)
    for bits in (16, 1):
        out = [r for b in scoring._count(iter(batches), scoring.RADIUS, bits) for r in b.to_pylist()]
        got = Counter()
        for r in out:
            got[tuple(r["code"] >> 9 * k & 511 for k in reversed(range(2 * scoring.RADIUS + 1)))] += r["n"]
        assert got == want
        assert len(out) == len(want) if bits == 16 else len(out) > len(want)


def test_windows_at_the_ends_of_texts():
    """Texts shorter than a window, empty ones and any radius against the plain definition."""
    rng = np.random.default_rng(3)
    for radius in (0, 1, 2, 3):
        texts = ["".join(rng.choice(list("ab"), n)) for n in [0, 1, 2, 0, 0, 3, 4, 7, 1, 0]]
        offsets = np.cumsum([0, *map(len, texts)])
        want = [sum(b << 9 * (2 * radius - k) for k, b in enumerate(p)) for places in plain_codes(texts, radius) for p in places]
        assert scoring.windows(np.frombuffer("".join(texts).encode(), np.uint8), offsets, radius).tolist() == want


def test_scoring_against_the_definition(spark):
    data = rows(8, 25)
    docs = frame(spark, data + [data[3], (None, *data[4][1:])])
    network = scoring.train(scoring.count_windows(docs), scoring.Network.fresh(), rounds=4, workers=3, batch=16, rate=0.05)
    got = scoring.score(docs, network).collect()
    assert len(got) == len(data) + 2
    by_id = {r.doc_id: r for r in got}
    for r, places in zip(data, plain_codes([r[1] for r in data], scoring.RADIUS)):
        want = 0.0
        for p in places:
            hidden = np.tanh(sum(network.e[k][c] for k, c in enumerate(p[: scoring.RADIUS] + p[scoring.RADIUS + 1 :])) + network.b)
            logits = (hidden @ network.w + network.c).astype(float)
            want += logits[p[scoring.RADIUS]] - np.log(np.exp(logits).sum())
        assert by_id[r[0]].n_tokens == len(places)
        assert by_id[r[0]].log_likelihood == pytest.approx(want, rel=1e-4, abs=1e-4)
        assert (by_id[r[0]].mean_log_likelihood is None) == (not places)
    fresh = scoring.score(docs, scoring.Network.fresh()).agg(F.sum("log_likelihood")).first()[0]
    assert sum(r.log_likelihood for r in got) > 0.6 * fresh


def test_window_counts_cover_every_byte(spark):
    data = rows(9, 20)
    got = {r.code: r.n for r in scoring.count_windows(frame(spark, data)).collect()}
    want = defaultdict(int)
    for places in plain_codes([r[1] for r in data], scoring.RADIUS):
        for p in places:
            code = 0
            for x in p:
                code = code << 9 | x
            want[code] += 1
    assert got == want


def test_windows_weigh_their_counts(spark):
    # One window in each batch: the rule of a common one and the rules of rare ones against it share a context.
    middle = scoring.RADIUS
    code = lambda token: sum(x << 9 * (2 * middle - k) for k, x in enumerate([97] * middle + [token] + [97] * middle))
    counted = spark.createDataFrame([(code(98), 100_000)] + [(code(t), 1) for t in range(99, 119)], "code long, n long")
    network = scoring.train(counted, scoring.Network.fresh(), rounds=8, workers=1, batch=1, rate=0.1)
    assert network.log_probability(np.array([code(98)], np.uint64))[0] > np.log(0.5)


def test_scoring_of_nothing(spark):
    empty = frame(spark, [])
    assert scoring.fit_and_score(empty).count() == 0
    shuffled = "".join(np.random.default_rng(2).permutation(list("abcdefgh " * 30)))
    docs = spark.createDataFrame([(i, "abcdefgh " * 30) for i in range(10)] + [(99, shuffled)], "doc_id long, text string")
    network = scoring.train(scoring.count_windows(docs), scoring.Network.fresh(), workers=2, batch=8, rate=0.1)
    got = {r.doc_id: r.mean_log_likelihood for r in scoring.score(docs, network).collect()}
    assert got[99] < got[0] - 0.5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab  \n\t▁<s>1é"), st.characters(codec="utf-8")), max_size=60), max_size=4))
def test_cut_texts_have_the_same_count(texts):
    import sentencepiece

    global _two
    if "_two" not in globals():
        _two = (sentencepiece.SentencePieceProcessor(model_file=PIECE), counts.PieceCounter(PIECE, part_chars=6))
    assert _two[1].counts(texts).tolist() == [len(_two[0].encode(t)) for t in texts]


def test_token_counts(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    data = rows(10) + [(900, "word pair " * 20_000, *rows()[0][2:]), (None, "x", *rows()[0][2:]), rows(10)[3]]
    got = counts.count_tokens(frame(spark, data), PIECE, limit=100).collect()
    want = [(repr(r[0]), len((r[1] or "").encode()), len(model.encode(r[1] or ""))) for r in data]
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert counts.count_tokens(frame(spark, []), PIECE).count() == 0
    assert counts.PieceCounter(PIECE).parts("word pair " * 20_000) != ["word pair " * 20_000]


def all_segmentations(word, p, pieces):
    if not word:
        return 1.0
    return sum(p[pieces[word[:m]]] * all_segmentations(word[m:], p, pieces) for m in range(1, len(word) + 1) if word[:m] in pieces)


def test_forward_pass_sums_all_segmentations():
    listed = sorted({bytes([b]) for b in range(256)} | {b" a", b"ab", b"abc", b"bc", b" ab", "é".encode()})
    lattice = language.Lattice(listed)
    rng = np.random.default_rng(5)
    p = np.vstack([rng.random((len(listed), 2)) * 0.1, np.zeros((1, 2))])
    model = language.Model(["x", "y"], listed, p)
    words = [b"abcabc", b"a", "é".encode(), b"zzz", b"bc" * 3, b"abcabc"]
    got = model.word_scores(lattice, words)
    number = {b: i for i, b in enumerate(listed)}
    for row, word in zip(got, words):
        for k in range(2):
            assert row[k] == pytest.approx(math.log(all_segmentations(b" " + word, p[:, k], number)))
    for long in (b"ab" * 100, b"abcz" * 300, "é".encode() * 21 + b"a"):
        body = b" " + long
        for k in range(2):
            logs = [0.0] + [-math.inf] * len(body)
            for t in range(1, len(body) + 1):
                ways = [logs[t - m] + math.log(p[number[body[t - m : t]], k]) for m in range(1, 5) if m <= t and body[t - m : t] in number]
                logs[t] = max(ways) + math.log(sum(math.exp(x - max(ways)) for x in ways))
            assert model.word_scores(lattice, [b"x", long])[1][k] == pytest.approx(logs[-1])


def test_a_rare_language_is_learned(spark):
    data = [(i, "the of and that this", "en") for i in range(400)] + [(1000 + i, "zug zeit zwei zahl", "zz") for i in range(3)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    fitted = language.train(docs, PIECE, sample_rows=20)
    assert fitted.languages == ["en", "zz"]
    asked = spark.createDataFrame([(1, "zeit zahl"), (2, "this that")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.text) for r in language.identify(asked, fitted, others={"text": F.col("text")}).collect()}
    assert got == {1: ("zz", "zeit zahl"), 2: ("en", "this that")}


def test_word_counts_are_plain_counts(spark):
    data = [r for r in rows(11) if r[1] is not None and r[2] is not None]
    got = {(r["lang"], bytes(r["word"]).decode()): r["n"] for r in language.word_counts(frame(spark, data), "text", "lang").collect()}
    want = defaultdict(int)
    for r in data:
        for w in alphanumeric(r[1]):
            want[r[2], w] += 1
    assert got == want


def test_languages_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(10_000, None, None), (10_001, "", "en"), (10_002, "12 !!", "de"), (10_003, "The", None), (None, "der die und nicht", None)]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    docs = docs.withColumn("letters", F.lit("clash")).withColumn("o0", F.lit("clash"))
    fitted = language.train(docs.filter(~language.held_out()), PIECE, rounds=2)
    got = language.identify(docs, fitted, others={"lang": F.col("lang"), "held_out": language.held_out()}).toPandas()
    assert len(got) == 205 and got["score"].between(0, 1).all()
    held = got[got["held_out"] & (got["doc_id"] < 10_000)]
    assert held["held_out"].sum() == sum(zlib.crc32(str(int(i)).encode()) % 5 == 0 for i in got["doc_id"].dropna() if i < 10_000)
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95
    none = got[got["doc_id"].between(10_000, 10_002)]
    assert (none["lang_pred"] == "und").all() and (none["score"] == 0).all()
    assert got[got["doc_id"].isna()]["lang_pred"].tolist() == ["de"]
    untrained = language.train(docs.limit(0), PIECE)
    assert {r.lang_pred for r in language.identify(docs.limit(5), untrained).collect()} == {"und"}
    assert language.identify(docs.limit(0), fitted).count() == 0


def plain_verdict(url, at, entries, segments=2):
    if url is None or at is None or "://" not in url:
        return None, None
    name = url.split("://", 1)[1]
    for c in "/?#":
        name = name.split(c)[0] if c == "/" else name
    name = name.split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = url.split("://", 1)[1].split("?")[0].split("#")[0]
    parts = [s for s in path.split("/")[1:] if s][:segments]
    labels = name.split(".")
    asked = {".".join(labels[i:]) for i in range(max(1, len(labels) - 1))} | {"/".join([name, *parts[:i]]) for i in range(1, len(parts) + 1)}
    best = None
    for pattern in {e[0] for e in entries if None not in e}:
        head, _, tail = pattern.partition("/")
        key = head.lower() + ("/" + tail if "/" in pattern else "")
        known = [(d, a) for p, a, d in entries if None not in (p, a, d) and d <= at and p.partition("/")[0].lower() + p[len(p.partition("/")[0]) :] == key]
        if key in asked and known and max(known)[1] != "remove":
            best = max(best or (0, "", ""), (len(key), key, max(known)[1]))
    return best[1:] if best else (None, None)


def test_url_lists_over_time(spark):
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [
        ("Example.com", "block", day(10)), ("example.com", "remove", day(20)), ("example.com", "allow", day(20)), ("example.com", "block", day(40)),
        ("a.example.com", "allow", day(15)), ("a.example.com/x", "block", day(12)), ("a.example.com/x", "block", day(12)), ("a.example.com/x/Y", "allow", day(30)),
        ("localhost", "block", day(0)), (None, "block", day(0)), ("b.org", None, day(0)), ("b.org", "block", None),
    ]
    links = ["http://example.com", "https://A.example.com:80/x/Y/z?q=/", "http://u@a.example.com/x#y", "http://b.a.example.com./x", "http://localhost/", "http://b.org/", "no url", "", None, "http://notexample.com/", "http://a.example.com//x"]
    shots = [(i * 100 + d, u, day(d)) for i, u in enumerate(links) for d in (0, 10, 12, 15, 19, 20, 35, 40)]
    shots += [(None, links[0], day(11)), (7, links[0], None), shots[3], shots[3]]
    schema = "page_id long, url string, fetched_on date"
    captures = spark.createDataFrame([(*s, "clash") for s in shots], schema + ", pattern string")
    listed = spark.createDataFrame([(*e, "clash") for e in entries], "pattern string, action string, listed_on date, url string")
    got = sorted((repr(r.page_id), repr(r.url), repr(r.fetched_on), r.pattern, r.action, r.blocked) for r in urls.evaluate(captures, listed).collect())
    want = [(repr(i), repr(u), repr(d), *plain_verdict(u, d, entries)) for i, u, d in shots]
    assert got == sorted(((*w, w[-1] == "block") for w in want), key=lambda w: tuple(map(str, w))) or sorted(got, key=str) == sorted(((*w, w[-1] == "block") for w in want), key=str)
    assert urls.evaluate(captures.limit(0), listed).count() == 0
    assert {r.blocked for r in urls.evaluate(captures, listed.limit(0)).collect()} == {False}


def test_url_patterns_of_any_depth_and_of_one_label(spark):
    day = datetime.date(2024, 1, 1)
    listed = spark.createDataFrame([("h.org/a/b/c", "block", day), ("org", "block", day), ("Good.org", "allow", day), ("localhost/x/y", "block", day)], "pattern string, action string, listed_on date")
    expected = {
        "http://h.org/a/b/c/d": "h.org/a/b/c", "http://h.org/a/b": "org", "http://x.good.org/a": "good.org", "http://localhost/x/y/z": "localhost/x/y", "http://localhost/x": None,
        "http://h.com/a/b/c": None, "http://org/": "org",
    }
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(expected)], "page_id int, url string, fetched_on date")
    assert {r.url: r.pattern for r in urls.evaluate(captures, listed).collect()} == expected
