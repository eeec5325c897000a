"""Personal data by patterns and by a semi-Markov conditional random field.

Patterns find the plain forms (``base_spans``). The field adds spans that patterns miss, such as numbers without a country code
or spelled-out addresses: a segmentation of a text's tokens into outside tokens and entities of at most ``MOST_TOKENS`` tokens
and ``MOST_CHARS`` characters is scored by features of whole candidate segments (digits in all, group lengths, checksum, separators,
what stands before and after) and of neighbouring types, and dynamic programming chooses boundaries and types together.

The field is trained here, by conditional likelihood, on the plain forms of a bounded sample, on the same forms respelled, and on
broken ones that are no entities. Only the surroundings of digits, at signs and spelled-out at signs can hold a candidate, so the
rest of a text is outside without being scored; nothing of a text is skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ratewise.llm import words as W

KINDS = ["email", "ip", "card", "phone"]
MOST_TOKENS = 24
MOST_CHARS = 64
SAMPLE_ROWS = 20_000
SAMPLE_PLACES = 900
TRAIN_TOKENS = 64
STEPS = 45
PENALTY = 1e-3
CHUNK = 1 << 14
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean>>"

# Patterns ---------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
DIALLED = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs: local parts and domains hold none."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        first = at
        while first > free and text[first - 1] in LOCAL:
            first -= 1
        match = DOMAIN.match(text, at + 1) if first < at else None
        if match:
            out.append((first, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain forms in a text, in code points, by kind and start."""
    out = [("email", a, b) for a, b in emails(text)]
    parts = lambda m: [p.lstrip("0") for p in m.group().split(".")]
    out += [("ip", *m.span()) for m in QUAD.finditer(text) if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts(m))]
    for m in CHAIN.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in DIALLED.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


# Tokens -----------------------------------------------------------------------------------------

OTHER, LETTER, DIGIT, SPACE, AT, DOT, DASH, PLUS, OPEN, CLOSE, SLASH, EDGE, AT_WORD, DOT_WORD, TYPES = range(15)
CLASS = np.zeros(128, np.int8)
for _kind, _chars in ((SPACE, " \t\n\v\f\r"), (AT, "@"), (DOT, "."), (DASH, "-_"), (PLUS, "+"), (OPEN, "([{"), (CLOSE, ")]}"), (SLASH, "/:")):
    CLASS[[ord(c) for c in _chars]] = _kind
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
ANCHOR = re.compile(r"[0-9@]+|(?<![A-Za-z])[Aa][Tt](?=[\])} ] ?[A-Za-z0-9-]{1,40} ?[\[({ ] ?[Dd][Oo][Tt](?![A-Za-z]))")


def places(text: str, spans: list[tuple[str, int, int]] = ()) -> list[tuple[int, int]]:
    """Ranges of a text outside which no candidate segment lies: the surroundings of anchors, widened to whole words."""
    out: list[tuple[int, int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - MOST_CHARS), min(len(text), m.end() + MOST_CHARS)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
            continue
        floor = out[-1][1] if out else 0
        while a > floor and text[a - 1].isalnum():
            a -= 1
        out.append((a, b))
    # A word that a range ends in belongs to it whole; ranges that then meet become one.
    whole: list[tuple[int, int]] = []
    for a, b in out:
        while b < len(text) and text[b].isalnum():
            b += 1
        if whole and a <= whole[-1][1]:
            whole[-1] = (whole[-1][0], max(b, whole[-1][1]))
        else:
            whole.append((a, b))
    return whole


class Tokens:
    """Tokens of some pieces of text in a row, an edge after each piece, with sums over tokens for features of ranges."""

    def __init__(self, pieces: list[str]):
        lengths = np.array([len(p) for p in pieces], np.int64)
        points = np.frombuffer("\x00".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(points < 128, CLASS[np.minimum(points, 127)], LETTER)
        self.piece_starts = np.cumsum(lengths + 1) - (lengths + 1)
        edges = self.piece_starts + lengths
        kind[edges] = EDGE
        new = np.ones(len(points), bool)
        new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] != LETTER) & (kind[1:] != DIGIT))
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(points)).astype(np.int64)
        self.kind = kind[self.starts].astype(np.int64)
        self.points, size = points, self.ends - self.starts
        low = lambda k: points[np.minimum(self.starts + k, len(points) - 1)] | 32
        word = self.kind == LETTER
        self.kind[word & (size == 2) & (low(0) == ord("a")) & (low(1) == ord("t"))] = AT_WORD
        self.kind[word & (size == 3) & (low(0) == ord("d")) & (low(1) == ord("o")) & (low(2) == ord("t"))] = DOT_WORD
        self.n = len(self.kind)
        one = np.zeros((TYPES, self.n + 1), np.int64)
        one[self.kind, np.arange(self.n) + 1] = 1
        self.count = np.cumsum(one, axis=1)
        self.digits = np.concatenate([[0], np.cumsum(np.where(self.kind == DIGIT, size, 0))])
        # Spaces that join two plain words can lie in no entity.
        plain, is_space = self.kind == LETTER, self.kind == SPACE
        loose = np.zeros(self.n, np.int64)
        loose[1:-1] = is_space[1:-1] & (plain[:-2] | is_space[:-2]) & (plain[2:] | is_space[2:])
        self.loose = np.concatenate([[0], np.cumsum(loose)])
        # Digit values in a row, their Luhn sums for either parity, numbers of digit groups.
        at = np.flatnonzero(kind == DIGIT)
        value = (points[at] - 48).astype(np.int64)
        twice = 2 * value - 9 * (value > 4)
        odd = np.arange(len(at)) % 2
        self.sums = [np.concatenate([[0], np.cumsum(np.where(odd == p, twice, value))]) for p in (0, 1)]
        self.group_sizes = size[self.kind == DIGIT]
        first = self.starts[self.kind == DIGIT]
        number = np.zeros(len(self.group_sizes), np.int64)
        for k in range(3):
            inside = self.group_sizes > k
            number[inside] = number[inside] * 10 + (points[first[inside] + k] - 48)
        small = np.where((self.group_sizes > 3) | (number > 255), 0, 1)
        self.small = np.concatenate([[0], np.cumsum(small)])

    def candidates(self, lo: int, hi: int, barred: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first token, token after the last) of all segments that may be entities and start at tokens lo to hi - 1."""
        first = np.repeat(np.arange(lo, hi), MOST_TOKENS)
        after = first + np.tile(np.arange(1, MOST_TOKENS + 1), hi - lo)
        keep = after <= self.n
        first, after = first[keep], after[keep]
        span = lambda sums: sums[after] - sums[first]
        ok = span(self.count[EDGE]) == 0
        ok &= (self.ends[after - 1] - self.starts[first]) <= MOST_CHARS
        ends = (SPACE, OTHER, DOT, DASH, SLASH)
        ok &= ~np.isin(self.kind[first], (*ends, CLOSE, AT)) & ~np.isin(self.kind[after - 1], (*ends, OPEN, AT, PLUS))
        ok &= (span(self.loose) == 0) & (span(self.count[OTHER]) <= 1)
        ok &= (span(self.digits) >= 4) | (span(self.count[AT]) + span(self.count[AT_WORD]) > 0)
        if barred is not None:
            ok &= span(np.concatenate([[0], np.cumsum(barred)])) == 0
        return first[ok], after[ok]

    def features(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """One active feature of every template for each segment."""
        span = lambda sums: sums[after] - sums[first]
        digits, groups = span(self.digits), span(self.count[DIGIT])
        a = self.digits[first]
        parity = (self.digits[after] - 1) % 2  # the last digit counts once, every second one before it twice
        total = np.where(parity == 0, self.sums[1][self.digits[after]] - self.sums[1][a], self.sums[0][self.digits[after]] - self.sums[0][a])
        checked = (digits >= 13) & (digits <= 19) & (total % 10 == 0)
        g = self.count[DIGIT][first]
        shape = np.zeros(len(first), np.int64)
        for k in range(5):
            inside = k < groups
            shape = shape * 7 + np.where(inside, np.minimum(self.group_sizes[np.where(inside, g + k, 0)], 6) if len(self.group_sizes) else 0, 0)
        quad = (groups == 4) & (self.small[g + groups] - self.small[g] == 4)
        letters, at = span(self.count[LETTER]), span(self.count[AT]) + span(self.count[AT_WORD])
        dots = span(self.count[DOT]) + span(self.count[DOT_WORD])
        before = np.where(first > 0, self.kind[np.maximum(first - 1, 0)], EDGE)
        behind = np.where(after < self.n, self.kind[np.minimum(after, self.n - 1)], EDGE)
        far = np.where(first > 1, self.kind[np.maximum(first - 2, 0)], EDGE)
        beyond = np.where(after + 1 < self.n, self.kind[np.minimum(after + 1, self.n - 1)], EDGE)
        separators = (span(self.count[SPACE]) > 0) + 2 * (span(self.count[DASH]) > 0) + 4 * (span(self.count[DOT]) > 0) + 8 * (span(self.count[SLASH]) > 0) + 16 * (span(self.count[OPEN]) > 0)
        columns = [
            np.zeros_like(digits), np.minimum(digits, 20), np.minimum(groups, 7) * 2 + (letters > 0), shape % 997 if len(shape) else shape,
            checked * 2 + (letters + at > 0), quad * 8 + np.minimum(dots, 4) + 0 * digits, np.minimum(at, 2) * 4 + np.minimum(dots, 3), np.minimum(letters, 5) * 3 + np.minimum(at, 2),
            self.kind[first] * TYPES + self.kind[after - 1], before, behind, before * TYPES + self.kind[first], self.kind[after - 1] * TYPES + behind,
            before * TYPES + far, behind * TYPES + beyond, separators, (span(self.count[OPEN]) - span(self.count[CLOSE]) != 0) * 2 + (span(self.count[OTHER]) > 0), np.minimum(digits, 20) * 2 + checked,
        ]
        return np.stack(columns, axis=1) + OFFSETS


SIZES = np.array([1, 21, 16, 997, 4, 16, 12, 18, TYPES**2, TYPES, TYPES, TYPES**2, TYPES**2, TYPES**2, TYPES**2, 32, 4, 42])
OFFSETS = np.cumsum(SIZES) - SIZES
FEATURES = int(SIZES.sum())


# The field --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """Weights of segment features per kind, and of neighbouring types (0: outside, then the kinds)."""

    weights: np.ndarray  # kinds x FEATURES
    moves: np.ndarray  # (kinds + 1) squared; outside to outside is 0

    def scores(self, features: np.ndarray) -> np.ndarray:
        return self.weights[:, features].sum(axis=2).T

    def margin(self) -> np.ndarray:
        """The most that neighbours can add to a segment's score over leaving its tokens outside, per kind."""
        m = self.moves
        into = (m[:, 1:] - m[:, :1]).max(axis=0)
        out_of = (m[1:, :] - m[0, :]).max(axis=1)
        return into + out_of


def choose(field: Field, segments: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """(first, after, kind) of the best segmentation over the tokens that the given scored segments cover, all else outside."""
    if not segments:
        return []
    moves, kinds = field.moves, len(KINDS)
    low, high = min(s[0] for s in segments), max(s[1] for s in segments)
    ending: dict[int, list[tuple[int, np.ndarray]]] = {}
    for first, after, score in segments:
        ending.setdefault(after, []).append((first, score))
    best = np.full((high - low + 1, kinds + 1), -np.inf)
    back: dict[tuple[int, int], tuple[int, int]] = {}
    best[0, 0] = 0.0
    for at in range(low + 1, high + 1):
        row = best[at - low - 1] + moves[:, 0]
        k = int(row.argmax())
        best[at - low, 0], back[at, 0] = row[k], (at - 1, k)
        for first, score in ending.get(at, ()):
            came = best[first - low][:, None] + moves[:, 1:]
            whence = came.argmax(axis=0)
            total = came[whence, np.arange(kinds)] + score
            for k in np.flatnonzero(total > best[at - low, 1:]):
                best[at - low, k + 1], back[at, k + 1] = total[k], (first, int(whence[k]))
    at, k, out = high, int((best[high - low] + moves[:, 0]).argmax()), []
    while at > low:
        first, whence = back[at, k]
        if k:
            out.append((first, at, k - 1))
        at, k = first, whence
    return out[::-1]


def decode(field: Field, tokens: Tokens, barred: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """The best segmentation's entities. A segment that loses against outside tokens whatever its neighbours are is not looked at again."""
    left, margin = [], field.margin()
    for lo in range(0, tokens.n, CHUNK):
        first, after = tokens.candidates(lo, min(tokens.n, lo + CHUNK), barred)
        if len(first):
            scores = field.scores(tokens.features(first, after))
            may = scores + margin > 0
            some = np.flatnonzero(may.any(axis=1))
            left += list(zip(first[some].tolist(), after[some].tolist(), np.where(may[some], scores[some], -np.inf)))
    left.sort(key=lambda s: s[:2])
    out, group, reach = [], [], -1
    for s in left:
        # An outside token between two groups cuts them apart.
        if s[0] > reach and group:
            out += choose(field, group)
            group = []
        group.append(s)
        reach = max(reach, s[1])
    return out + choose(field, group)


# Training ---------------------------------------------------------------------------------------


def respelled(kind: str, text: str, pick: int) -> list[tuple[str, bool]]:
    """Other spellings of a plain form (entities too) and broken forms (no entities)."""
    digits = re.sub("[^0-9]", "", text)
    if kind == "email":
        local, domain = text.split("@", 1)
        name = re.sub(r"\W*[0-9]+", "", local) or "name"
        name += ["", f".{name[::-1]}", f"_{name[:2]}", f"-{name}"][pick % 4]
        host = re.sub("[0-9]", "", domain)
        marks = [(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", ".")]
        spelled = lambda who, where, m: who + m[0] + where.replace(".", m[1])
        forms = [spelled(local, domain, marks[pick % 5]), spelled(name, host, marks[0]), spelled(name, host.split(".", 1)[-1], marks[(pick + 1) % 5])]
        return [*((f, True) for f in forms), (f"{local}@ {domain}", False)]
    if kind == "ip":
        parts = text.split(".")
        mark = ["[.]", "(.)", " dot ", "[dot]"][pick % 4]
        return [(mark.join(parts), True), (".".join(str(int(p) + 300) for p in parts), False), (".".join(parts[:3]), False)]
    if kind == "card":
        mark = [".", "/", " - ", "_"][pick % 4]
        broken = digits[:-1] + str((int(digits[-1]) + 1 + pick % 9) % 10)
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [(mark.join(groups), True), (broken, False), (" ".join(broken[i : i + 4] for i in range(0, len(broken), 4)), False)]
    area, rest = digits[-10:-7] or "555", digits[-7:]
    forms = [f"({area}) {rest[:3]}-{rest[3:]}", f"{area}-{rest[:3]}-{rest[3:]}", f"{area}.{rest[:3]}.{rest[3:]}", f"001 {area} {rest[:3]} {rest[3:]}"]
    return [(forms[pick % 4], True), (rest[:3] + "-" + rest[3:6], False), (digits, False)]


@dataclass
class Example:
    """A piece of text with its entities as token ranges."""

    text: str
    entities: list[tuple[int, int, int]]


def examples(piece: str, spans: list[tuple[str, int, int]], pick: int) -> list[Example]:
    """The piece itself and its respelled and broken versions, each if its entities are bounded, apart and made of whole tokens."""
    apart = sorted(spans, key=lambda s: s[1])
    if any(a[2] > b[1] for a, b in zip(apart, apart[1:])):
        return []
    versions = [(piece, apart)]
    for i, (kind, a, b) in enumerate(apart):
        for text, real in respelled(kind, piece[a:b], pick):
            grown = len(text) - (b - a)
            moved = [(k, x + grown * (x > a), y + grown * (x > a)) for k, x, y in apart[:i] + apart[i + 1 :]]
            versions.append((piece[:a] + text + piece[b:], moved + [(kind, a, a + len(text))] * real))
    out = []
    for text, wanted in versions:
        tokens = Tokens([text])
        if tokens.n > TRAIN_TOKENS:
            continue
        known = {(int(tokens.starts[f]), int(tokens.ends[e - 1])): (f, e) for f, e in zip(*(x.tolist() for x in tokens.candidates(0, tokens.n)))}
        # What patterns find in a respelled text counts as well.
        wanted = {(a, b): k for k, a, b in [*base_spans(text), *wanted]}
        if all(s in known for s in wanted):
            cut = sorted(known[s] + (KINDS.index(k),) for s, k in wanted.items())
            if all(x[1] <= y[0] for x, y in zip(cut, cut[1:])):
                out.append(Example(text, cut))
    return out


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis), -1e300)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


class Batch:
    """Training texts side by side: candidate segments, their features, and where each ends."""

    def __init__(self, given: list[Example]):
        tokens = [Tokens([e.text]) for e in given]
        self.sizes = np.array([t.n for t in tokens])
        self.width, self.texts = int(self.sizes.max()), len(given)
        parts, lines = [], []
        self.slot = np.full((self.texts, self.width, MOST_TOKENS), -1, np.int64)  # by first token and length - 1
        made = 0
        gold: list[tuple[int, int]] = []
        self.gold_moves = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        for i, (t, e) in enumerate(zip(tokens, given)):
            first, after = t.candidates(0, t.n)
            self.slot[i, first, after - first - 1] = made + np.arange(len(first))
            for f, a, k in e.entities:
                gold.append((int(self.slot[i, f, a - f - 1]), k))
            last, state = 0, 0
            for f, a, k in [*e.entities, (t.n, t.n, -1)]:
                if f > last:
                    self.gold_moves[state, 0] += 1
                    self.gold_moves[0, 0] += f - last - 1
                    state = 0
                if k >= 0:
                    self.gold_moves[state, k + 1] += 1
                    state = k + 1
                last = a
            parts.append(t.features(first, after))
            lines += [i] * len(first)
            made += len(first)
        self.features = np.concatenate(parts)
        self.made = made
        self.gold = np.zeros((made, len(KINDS)))
        for m, k in gold:
            self.gold[m, k] = 1

    def loss(self, field: Field) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood and its gradients, by the forward and backward sums over all segmentations."""
        kinds, n, width = len(KINDS), self.texts, self.width
        scores = np.vstack([field.scores(self.features), np.full((1, kinds), -np.inf)])
        moves = field.moves
        # Texts are aligned at their ends, so that all finish in the last column.
        lead = width - self.sizes
        place = np.arange(width)[None, :] - lead[:, None]
        slot = np.where((place >= 0)[:, :, None], self.slot[np.arange(n)[:, None], np.maximum(place, 0)], -1)
        seg = scores[slot]  # texts, first, length, kinds
        ahead = np.full((width + 1, n, kinds + 1), -np.inf)
        entered = np.full((width + 1, n, kinds), -np.inf)
        begin = lead[None, :] == np.arange(width + 1)[:, None]
        for t in range(width + 1):
            if t:
                rows = [entered[t - l] + seg[:, t - l, l - 1] for l in range(1, min(t, MOST_TOKENS) + 1)]
                ahead[t, :, 1:] = _lse(np.stack(rows), 0)
                ahead[t, :, 0] = _lse(ahead[t - 1] + moves[:, 0], 1)
            ahead[t][begin[t]] = [0.0] + [-np.inf] * kinds
            entered[t] = _lse(ahead[t][:, :, None] + moves[None, :, 1:], 1)
        # The end of a text follows like an outside token.
        total = _lse(ahead[width] + moves[:, 0], 1)
        behind = np.full((width + 1, n, kinds + 1), -np.inf)
        leaving = np.full((width + 1, n, kinds), -np.inf)
        behind[width] = moves[:, 0]
        for t in range(width - 1, -1, -1):
            rows = [seg[:, t, l - 1] + behind[t + l][:, 1:] for l in range(1, min(width - t, MOST_TOKENS) + 1)]
            leaving[t] = _lse(np.stack(rows), 0)
            to_kind = _lse(moves[None, :, 1:] + leaving[t][:, None, :], 2)
            behind[t] = np.logaddexp(moves[:, 0] + behind[t + 1][:, :1], to_kind)
        expected = np.zeros((self.made + 1, kinds))
        moved = np.zeros_like(moves)
        for t in range(width):
            live = (t >= lead)[:, None, None]
            steps = np.exp(ahead[t][:, :, None] + moves[None, :, 1:] + leaving[t][:, None, :] - total[:, None, None])
            moved[:, 1:] += np.where(live, steps, 0).sum(axis=0)
            outside = np.exp(ahead[t] + moves[:, 0] + behind[t + 1][:, :1] - total[:, None])
            moved[:, 0] += np.where(live[:, :, 0], outside, 0).sum(axis=0)
            for l in range(1, min(width - t, MOST_TOKENS) + 1):
                at = slot[:, t, l - 1]
                some = np.flatnonzero(at >= 0)
                expected[at[some]] = np.exp(entered[t][some] + seg[some, t, l - 1] + behind[t + l][some, 1:] - total[some, None])
        last = np.exp(ahead[width] + moves[:, 0] - total[:, None]).sum(axis=0)
        moved[:, 0] += last
        gold_moves = self.gold_moves.copy()
        ends = self.ends_in()
        gold_moves[:, 0] += ends
        over = expected[:-1] - self.gold
        gradient = np.stack([sum(np.bincount(self.features[:, c], over[:, k], FEATURES) for c in range(self.features.shape[1])) for k in range(kinds)])
        shift = moved - gold_moves
        shift[0, 0] = 0
        likelihood = (scores[:-1] * self.gold).sum() + (moves * gold_moves).sum() - total.sum()
        return -likelihood / n, gradient / n, shift / n

    def ends_in(self) -> np.ndarray:
        """How many texts end in each state."""
        out = np.zeros(len(KINDS) + 1)
        flows_out = self.gold_moves.sum(axis=1)
        flows_in = self.gold_moves.sum(axis=0)
        out[:] = flows_in - flows_out
        out[0] += self.texts
        return out


def empty_field() -> Field:
    weights = np.zeros((len(KINDS), FEATURES))
    weights[:, 0] = -4.0
    return Field(weights, np.zeros((len(KINDS) + 1, len(KINDS) + 1)))


def fit_field(given: list[Example], steps: int = STEPS, rate: float = 0.25) -> Field:
    """Weights by Adam steps on the penalised likelihood of all examples, sorted into two batches by length."""
    field = empty_field()
    if not given:
        return field
    given = sorted(given, key=lambda e: len(e.text))
    batches = [Batch(part) for part in (given[: len(given) // 2], given[len(given) // 2 :]) if part]
    start = field.weights.copy()
    weights, moves = field.weights.copy(), field.moves.copy()
    mean, square = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    for step in range(1, steps + 1):
        parts = [b.loss(Field(weights, moves))[1:] for b in batches]
        share = [b.texts / len(given) for b in batches]
        slopes = [sum(s * p[0] for s, p in zip(share, parts)) + PENALTY * (weights - start), sum(s * p[1] for s, p in zip(share, parts)) + PENALTY * moves]
        for i, x in enumerate((weights, moves)):
            mean[i] = 0.9 * mean[i] + 0.1 * slopes[i]
            square[i] = 0.99 * square[i] + 0.01 * slopes[i] ** 2
            x -= rate * (mean[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8) * (1 - 0.9 * step / steps)
        moves[0, 0] = 0.0
    return Field(weights, moves)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces around anchors with the plain forms inside them."""
    for batch in batches:
        for _, _, data, offsets in W.slices(batch.column("text")):
            body = data.tobytes()
            pieces, spans = [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                text = body[a:b].decode()
                found = base_spans(text)
                for lo, hi in places(text):
                    if hi - lo <= 4 * MOST_CHARS:
                        pieces.append(text[lo:hi])
                        spans.append(";".join(f"{k}:{x - lo}:{y - lo}" for k, x, y in found if lo <= x and y <= hi))
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), pa.array(spans, pa.string())], names=["piece", "spans"])


def train(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_places: int = SAMPLE_PLACES) -> Field:
    """The field, fitted on about ``sample_rows`` rows drawn by hash, and of these at most ``sample_places`` distinct pieces per set of
    kinds found in them (drawn by hash; half as many without any). Without examples it adds nothing."""
    chance = sample_rows / max(sample_rows, docs.count())
    texts = docs.select(F.col(text_col).alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(chance * (1 << 30)))
    pieces = texts.distinct().mapInArrow(_sampled, "piece string, spans string").distinct()
    order = (F.col("spans") == "", F.xxhash64("piece", F.lit(7)), "piece", "spans")
    some = pieces.filter("spans <> ''").orderBy(*order[1:]).limit(sample_places).collect()
    none = pieces.filter("spans = ''").orderBy(*order[1:]).limit(sample_places // 2).collect()
    given = []
    for i, row in enumerate([*some, *none]):
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row["spans"].split(";") if s)]
        given += examples(row["piece"], spans, i)
    return fit_field(given)


# Whole texts ------------------------------------------------------------------------------------


def find_in(field: Field, texts: list[str], base: bool = True) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, plain form or not) of every text, by kind and start; without ``base`` the field alone decides."""
    out, pieces, owners, barred_at = [], [], [], []
    made = 0
    for i, text in enumerate(texts):
        spans = base_spans(text) if base else []
        out.append([(*s, True) for s in spans])
        for lo, hi in places(text):
            owners.append((i, lo))
            pieces.append(text[lo:hi])
            barred_at += [(made + max(a, lo) - lo, made + min(b, hi) - lo) for _, a, b in spans if a < hi and b > lo]
            made += hi - lo + 1
    if pieces:
        tokens = Tokens(pieces)
        covered = np.zeros(made + 1, np.int64)
        for a, b in barred_at:
            covered[a] += 1
            covered[b] -= 1
        inside = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
        barred = inside[tokens.ends] > inside[tokens.starts]
        for first, after, kind in decode(field, tokens, barred):
            at = int(tokens.starts[first])
            piece = int(np.searchsorted(tokens.piece_starts, at, "right")) - 1
            i, lo = owners[piece]
            start = lo + at - int(tokens.piece_starts[piece])
            out[i].append((KINDS[kind], start, start + int(tokens.ends[after - 1]) - at, False))
    rank = {k: i for i, k in enumerate(KINDS)}
    return [sorted(spans, key=lambda s: (rank[s[0]], s[1], s[2])) for spans in out]


def find(docs: DataFrame, field: Field, base: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``spans`` (kind, start, end in code points, end exclusive, ``base``), by kind and start.

    All plain forms stay; the field adds entities that touch none of them. A null or empty text has no spans; ids are passed on
    as they are, null or repeated; other columns are not read.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            for lo, hi, data, offsets in W.slices(batch.column("text")):
                body = data.tobytes()
                found = find_in(field, [body[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])], base)
                listed = pa.array([[{"kind": k, "start": a, "end": b, "base": p} for k, a, b, p in spans] for spans in found], shape)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), listed], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(emit, f"id {id_type}, spans {SPANS}").withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands for all."""
    out, free = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= free:
            out += [text[free:a], f"[{kind}]"]
        free = max(free, b)
    return "".join([*out, text[free:]])
