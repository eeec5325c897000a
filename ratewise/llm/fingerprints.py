"""Homomorphic document fingerprints, in DataFrame functions only.

A fingerprint is the sum of one wide vector per paragraph, lane by lane modulo a power of two. The first lanes hold hashes of whole
paragraphs modulo 2^32: equal multisets of paragraphs have equal sums in any order. The other lanes hold +1 or -1 per sentence and
per three consecutive words of a paragraph, modulo 2^32: the cosine of two such sums estimates how much of the text two documents share. Sums can be
added and taken away, so inserting or deleting paragraphs needs only the paragraphs concerned.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

WHOLE_LANES, WHOLE_BITS = 8, 32
SIGN_LANES, SIGN_BITS = 128, 32
SHORT_BITS = 12  # of a sign lane in the digest, as long as all of them fit
CHUNK = 127  # hashes whose bits a byte counts without a sign overflow
BUCKET_ROWS = 1_000
MOST_BUCKETS = 1 << 16
NO_ID = -(1 << 63)

PARAGRAPHS = r"filter(split(coalesce(`{text}`, ''), '[\\r\\n]+'), p -> p <> '')"
SENTENCES = r"flatten(transform({paragraphs}, p -> split(p, '(?<=[.!?])[ \\t]+')))"
# In scripts without blanks (Thai to Khmer, kana, ideographs) every character is a word.
WORDS = r"split(p, '[ \\t]+|(?<=[\\u0e00-\\u0eff\\u1000-\\u109f\\u1780-\\u17ff\\u3000-\\u9fff\\uf900-\\ufaff])')"
SHINGLES = f"flatten(transform({{paragraphs}}, p -> transform(array({WORDS}), w -> transform(sequence(0, greatest(size(w) - 3, 0)), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))[0]))"
# Bits j of eight bytes are counted at once in chunks of ``CHUNK``, so that 64 lanes cost eight additions per hash.
COUNTED = "aggregate({chunk}, transform(sequence(1, 8), j -> 0L), (s, p) -> transform(s, (a, j) -> a + (shiftrightunsigned(p, j) & 72340172838076673L)))"


def vector(text_col: str) -> Column:
    """The lanes of a text: ``WHOLE_LANES`` sums of paragraph hashes, then ``SIGN_LANES`` sums of signs. A null text has no paragraphs."""
    paragraphs = PARAGRAPHS.format(text=text_col)
    sentences = SENTENCES.format(paragraphs=paragraphs)
    half, low = WHOLE_BITS, (1 << WHOLE_BITS) - 1
    # Two lanes from each 64-bit hash of a paragraph; each sum is brought back below 2^32 at once.
    lane = f"shiftrightunsigned(xxhash64(p, j div 2), {half} * (j % 2)) & {low}L"
    whole = f"aggregate({paragraphs}, transform(sequence(1, {WHOLE_LANES}), j -> 0L), (s, p) -> transform(s, (a, j) -> (a + ({lane})) & {low}L))"
    hashed = f"concat(transform({sentences}, p -> xxhash64(p, 1000)), {SHINGLES.format(paragraphs=paragraphs)})"
    signs = []
    for seed in range(SIGN_LANES // 64):
        seeded = f"transform(hs, h -> xxhash64(h, 1000 + {seed}))"
        chunks = f"transform(sequence(0, greatest(size(hs) - 1, 0) div {CHUNK}), c -> {COUNTED.format(chunk=f'slice(ks, int(c) * {CHUNK} + 1, {CHUNK})')})"
        ones = f"aggregate({chunks}, transform(sequence(1, 64), j -> 0L), (s, c) -> transform(s, (a, j) -> a + (shiftrightunsigned(c[j % 8], 8 * int(j div 8)) & 255L)))"
        signs.append(f"transform(array({seeded}), ks -> transform({ones}, a -> (2 * a - size(hs)) & {(1 << SIGN_BITS) - 1}L))[0]")
    return F.expr(f"concat({whole}, transform(array({hashed}), hs -> concat({', '.join(signs)}))[0])")


def _limits(lane: Column) -> Column:
    return F.when(lane < WHOLE_LANES, F.lit((1 << WHOLE_BITS) - 1)).otherwise(F.lit((1 << SIGN_BITS) - 1))


def _hex(lanes: Column, digits: int) -> Column:
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), digits, F.lit("0"))), ""))


def inserted(vector_a: Column, vector_b: Column) -> Column:
    """The fingerprint vector of the paragraphs of both."""
    total = F.zip_with(vector_a, vector_b, lambda a, b: a + b)
    return F.transform(total, lambda x, j: x.bitwiseAND(_limits(j)))


def deleted(vector_a: Column, vector_b: Column) -> Column:
    """The fingerprint vector of a without the paragraphs of b."""
    total = F.zip_with(vector_a, vector_b, lambda a, b: a - b)
    return F.transform(total, lambda x, j: x.bitwiseAND(_limits(j)))


def digest(lanes: Column) -> Column:
    """The lanes as lowercase hex: the sign lanes modulo 2^12 and, only where one of them does not fit, the upper bits of all after that."""
    whole, signs = F.slice(lanes, 1, WHOLE_LANES), F.slice(lanes, WHOLE_LANES + 1, SIGN_LANES)
    half, low = 1 << (SHORT_BITS - 1), (1 << SHORT_BITS) - 1
    wide = F.exists(signs, lambda x: (x >= half) & (x < (1 << SIGN_BITS) - half))
    upper = _hex(F.transform(signs, lambda x: F.shiftright(x, SHORT_BITS)), (SIGN_BITS - SHORT_BITS) // 4)
    short = _hex(F.transform(signs, lambda x: x.bitwiseAND(F.lit(low))), SHORT_BITS // 4)
    return F.concat(_hex(whole, WHOLE_BITS // 4), short, F.when(wide, upper).otherwise(""))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal vectors, else the cosine of their sign lanes, 0 where it is negative or one of them has no paragraphs."""
    signs = lambda v: F.transform(F.slice(v, WHOLE_LANES + 1, SIGN_LANES), lambda x: F.when(x >= 1 << (SIGN_BITS - 1), x - (1 << SIGN_BITS)).otherwise(x).cast("double"))
    dot = lambda v, w: F.aggregate(F.zip_with(signs(v), signs(w), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(a == b, 1.0).when(norm == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm)))


def _bucket(doc: Column, bounds: np.ndarray) -> Column:
    """Which range of ascending bounds an id falls into, by a coarse and a fine step."""
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.size(F.filter(F.lit(bounds[::step]), lambda b: b <= doc)) - 1
    fine = F.size(F.filter(F.slice(F.lit(bounds), coarse * step + 1, F.lit(step)), lambda b: b <= doc)) - 1
    return coarse * step + fine


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``doc``, ``text`` and ``next_text`` in ascending id order, first after last, plus ``bucket`` and order columns; ghosts included.

    Ids are cut into ranges of about ``bucket_rows`` rows at quantiles (at most ``MOST_BUCKETS``). The first row of each range is
    sent to the range before it too, as a ghost row that only serves as the next of its last row, so each text is shuffled once.
    """
    n = docs.count()
    buckets = min(MOST_BUCKETS, max(1, -(-n // bucket_rows)))
    shares = [i / buckets for i in range(buckets)]
    found = docs.agg(F.percentile_approx("doc", shares, 20 * buckets + 1000).alias("b"), F.min("doc").alias("least")).first()
    bounds = np.unique(np.array([found["least"], *(found["b"] or [])] if n else [NO_ID], np.int64))
    own = docs.withColumn("bucket", _bucket(F.col("doc"), bounds)).withColumn("h", F.xxhash64("text"))
    opens = F.element_at(F.lit(bounds), F.col("bucket") + 1) == F.col("doc")
    place = lambda bucket, wrap, ghost: F.struct(bucket.cast("int").alias("bucket"), F.lit(wrap).alias("wrap") if not isinstance(wrap, Column) else wrap.alias("wrap"), F.lit(ghost).alias("ghost"))
    first = F.col("bucket") == 0
    ghost = place(F.when(first, len(bounds) - 1).otherwise(F.col("bucket") - 1), first, True)
    here = place(F.col("bucket"), F.lit(False), False)
    placed = own.withColumn("at", F.explode(F.when(opens, F.array(here, ghost)).otherwise(F.array(here))))
    placed = placed.select("doc", "text", "h", F.col("at.bucket").alias("bucket"), F.col("at.wrap").alias("wrap"), F.col("at.ghost").alias("ghost"))
    return placed.withColumn("next_text", F.lead("text").over(order()))


def order() -> Window:
    return Window.partitionBy("bucket").orderBy("wrap", "doc", "h", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_chars``, ``vector``, ``fingerprint``, and the same for its edited text; likenesses.

    The edited text has the last half of the code points (rounded down) replaced by the first as many (or all) of the next document's;
    ``near_edited`` and ``near_next`` compare the fingerprint with the edited text's and the next document's. A null text is
    empty; empty texts have no paragraphs and equal fingerprints; a null id comes first; rows that share an id follow each other
    by their texts; the only row of a table is its own next. Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(texts).withColumn("edited", edited).withColumn("vector", vector("text")).withColumn("edited_vector", vector("edited"))
    rows = rows.withColumn("next_vector", F.lead("vector").over(order())).filter(~F.col("ghost"))
    return rows.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias(id_col), n.cast("long").alias("n_chars"), F.col("edited"), F.col("vector"), F.col("edited_vector"),
        digest(F.col("vector")).alias("fingerprint"), digest(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )
