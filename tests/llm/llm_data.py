"""Small documents with the cases every operator must bear, and plain definitions to compare with."""

import random
import re

SPACED = re.compile("[^\x20\x09-\x0d]+")
ALPHANUMERIC = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Names that operators use inside; a table may have them too.
CLASHING = ["doc", "id", "row", "h", "n", "text2", "bucket", "shard", "class", "rep", "group", "part", "single", "n_words", "n_tokens", "items", "lang_pred", "score", "__copy"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


def spaced(text):
    return SPACED.findall(text or "")


def alphanumeric(text):
    return ALPHANUMERIC.findall((text or "").translate(LOWER))


def texts(seed=1, n=60):
    """Random texts over a small vocabulary with shared passages, near and exact copies, and odd ones."""
    rng = random.Random(seed)
    words = [a + b for a in ("lo", "ra", "Ti", "né", "ü", "so.") for b in ("ma", "pe", "", "x1", "da,")]
    passage = [rng.choice(words) for _ in range(45)]
    out = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        if i % 4 == 1:
            at = rng.randint(0, len(w))
            w[at:at] = passage[: rng.randint(15, 45)]
        if i % 7 == 3 and out:
            w = (out[rng.randrange(len(out))] or "x").split()
            if w and i % 2:
                w[rng.randrange(len(w))] = "changed"
        out.append("".join(x + rng.choice([" ", " ", "\n", "  ", "\t"]) for x in w))
    out += [None, "", "   ", "!!! ???", "word", "a b c d", "la " * 70, "x" * 300, "    a\x00b", " ".join(passage), " ".join(passage[5:30]), " ".join(rng.choice(words) for _ in range(3000))]
    return out


def rows(seed=1, n=60):
    out = []
    for i, t in enumerate(texts(seed, n)):
        source = None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}"
        out.append((i * 3, t, None if i % 13 == 5 else ("en", "de")[i % 2], source, None if t is None else len(t), *["clash"] * len(CLASHING)))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)
