"""Cross-tokenizer alignment against its definition."""

import hashlib
import random
from collections import Counter
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from ratewise.llm import alignment, queries, words as W

from llm_data import frame, rows

BYTE, PIECE, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken"))
ODD = ["a▁b", "▁", " ", "  x", "<|endoftext|> </s> <0x41>", "né̀ Ǆ ﬁ 😀ok", "\x00\x01", "tab\tnew\nline\r\n  ", "日本語のテキスト", "x" * 3000, " " * 3000 + "y", "don't DON'T we'll", "1234567 ½ ²", "a b\u0085c\u001cd", "﻿bom", " "]


@pytest.fixture(scope="module")
def models():
    first = Tokenizer.from_file(BYTE)
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=PIECE)


@cache
def byte_letters():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in keep}
    extra = 256
    for b in range(256):
        if b not in keep:
            letters[chr(extra)] = b
            extra += 1
    return letters


def byte_piece(piece):
    """A byte-level entry's bytes, by the letters of all single bytes."""
    letters = byte_letters()
    return bytes(letters[c] for c in piece)


def defined(texts, models):
    """Rows as the contract states them, token by token."""
    first, second = models
    made = []
    for text in texts:
        a, b = [], []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            bytes_a = [byte_piece(first.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
                a, b = [], []
        if not a:
            made.append(([], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        begins_a, begins_b = np.append(0, ends_a[:-1]), np.append(0, ends_b[:-1])
        links, j = [], 0
        for i in range(len(a)):
            while j and ends_b[j - 1] > begins_a[i]:
                j -= 1
            while ends_b[j] <= begins_a[i]:
                j += 1
            k = j
            while k < len(b) and begins_b[k] < ends_a[i]:
                links.append((a[i], b[k]))
                k += 1
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a.tolist()) & set(ends_b.tolist())):
            p, q = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        made.append((a, b, links, groups))
    count = Counter(p for _, _, links, _ in made for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for a, b, links, groups in made:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def listed(df):
    return sorted([tuple(r) for r in df.collect()], key=lambda r: (r[0] is not None, r))


@pytest.mark.parametrize("ranks,held", [(None, 1 << 20), (RANKS, 1 << 20), (RANKS, 2_500)])
def test_alignment_equals_its_definition(spark, models, monkeypatch, ranks, held):
    monkeypatch.setattr(alignment, "SLICE", 2_000)
    monkeypatch.setattr(alignment, "SLICE_TOKENS", 1_500)
    monkeypatch.setattr(alignment, "GROUP_LINKS", 3_000)
    data = rows(3, 40)
    data += [(None, data[1][1], *data[0][2:]), (None, None, *data[0][2:]), (3, data[2][1], *data[0][2:]), *[(1000 + i, t, *data[0][2:]) for i, t in enumerate(ODD)]]
    random.Random(1).shuffle(data)
    got = listed(alignment.align(frame(spark, data).repartition(3), BYTE, PIECE, ranks, public_tokenizers.PATTERN, range_pairs=2_000, held_pairs=held))
    want = sorted([(r[0], *x) for r, x in zip(data, defined([r[1] for r in data], models))], key=lambda r: (r[0] is not None, r))
    assert got == want


def test_empty_tables(spark):
    assert alignment.align(frame(spark, []), BYTE, PIECE).collect() == []
    lone = [(1, None, *rows(1, 1)[0][2:]), (None, "", *rows(1, 1)[0][2:])]
    assert {tuple(r)[1:] for r in alignment.align(frame(spark, lone), BYTE, PIECE).collect()} == {(0, 0, 0, 0, 0, 0, "")}


@pytest.fixture(scope="module")
def ranked():
    return alignment.ByteTokenizer(BYTE, RANKS, public_tokenizers.PATTERN)


def test_every_settled_character_is_encoded_alike(ranked, models):
    texts = [f" a{chr(c)}b {chr(c)}{chr(c)} 1{chr(c)}2{chr(c)}\n{chr(c)}'s" for c in range(0x250)]
    assert ranked.encode(texts) == [e.ids for e in models[0].encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aB'st1 \n\t é!<|>_"), st.characters(max_codepoint=0x24F))), max_size=6))
def test_ranks_give_the_file_s_ids(texts):
    global _pair
    if "_pair" not in globals():
        model = Tokenizer.from_file(BYTE)
        model.encode_special_tokens = True
        _pair = alignment.ByteTokenizer(BYTE, RANKS, public_tokenizers.PATTERN), model
    assert _pair[0].encode(texts) == [_pair[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_unsettled_texts_are_told_apart():
    texts = {"": True, "aé ɏ": True, "aɐ": False, "日本": False, "x" * 499: True, "x" * 500: False, " " * 600: False, "é" * 250: False, "a " * 900 + "z": True, "ok": True}
    apart = [t for text in texts for t in (text, "z")]
    _, _, data, offsets = next(W.slices(pa.array(apart, pa.string())))
    assert alignment.settled(*alignment.spaced(data, offsets))[::2].tolist() == list(texts.values())


def test_other_ranks_are_refused(tmp_path):
    lines = open(RANKS, "rb").read().splitlines()
    lines[300], lines[301] = lines[300].split()[0] + b" " + lines[301].split()[1], lines[301].split()[0] + b" " + lines[300].split()[1]
    (tmp_path / "ranks").write_bytes(b"\n".join(lines))
    with pytest.raises(ValueError):
        alignment.ByteTokenizer(BYTE, str(tmp_path / "ranks"), public_tokenizers.PATTERN)


def test_long_texts_are_cut_without_a_trace(models):
    text = "The cat, 42 cats.\n  and é " * 9_000
    assert alignment.PieceTokenizer(PIECE).encode([text, "a"]) == models[1].encode([text, "a"])


def test_links_are_all_overlaps():
    rng = random.Random(2)
    lengths = tuple(pa.array([1, 2, 3, 4], pa.int64()) for _ in range(2))
    for _ in range(50):
        sides = [[], []]
        for _ in range(3):
            size = rng.randint(0, 12)
            for s in sides:
                cut, left = [], size
                while left:
                    cut.append(rng.randint(1, min(4, left)) - 1)
                    left -= cut[-1] + 1
                s.append(cut)
        a, b = (pa.array(s, pa.list_(pa.int32())) for s in sides)
        _, _, linked = alignment.links(a, b, lengths)
        got = sorted(zip(*(linked.column(c).to_pylist() for c in ("doc", "x", "y"))))
        want, base = [], [0, 0]
        for d in range(3):
            spans = [[(sum(x + 1 for x in s[d][:i]), sum(x + 1 for x in s[d][: i + 1])) for i in range(len(s[d]))] for s in sides]
            want += [(d, base[0] + i, base[1] + j) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if p[0] < q[1] and q[0] < p[1]]
            base = [base[k] + len(spans[k]) for k in (0, 1)]
        assert got == sorted(want)


def test_the_query_equals_the_definition(spark, models):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d[0], *x) for d, x in zip(docs, defined([d[1] for d in docs], models)))
    assert listed(queries.op11_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001")) == want
