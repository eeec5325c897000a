"""Token ids of whole texts with a tokenizers file, each distinct unit of a task encoded once.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its white-space units in a row.
One or two marks of ``.,;:!?`` after a letter at a unit's end are a unit of their own (letters and marks are never in one word of
the tokenizer), and ASCII case does not matter to a lower-casing tokenizer; both only make units repeat more often. Special strings keep their meaning: a slice of texts that holds
``<|`` is split at white space alone, case kept.
"""

from __future__ import annotations

import os

import numpy as np

from ratewise.llm import words as W

CACHE = 1_000_000  # units; about 25 bytes each
JOIN = 400


def worker_encoder(path: str) -> UnitEncoder:
    """The encoder of this Python worker, so that units seen by earlier tasks of the worker are not encoded again.

    Functions travel to the workers by value with globals of their own, so it is kept at a module that every worker has.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("_worker_encoders", {})
    if path not in held:
        held[path] = UnitEncoder(path)
    return held[path]


class UnitEncoder:
    """Ids of slices of texts; holds the ids of units seen so far, up to ``CACHE`` units."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.split = W.Splitter(W.spaced())
        lower = W.spaced()
        lower[65:91] += 32
        self.fold = W.Splitter(lower)
        self.letter, self.mark = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[65:91] = self.letter[97:123] = True
        self.mark[list(b".,;:!?")] = True
        # Second bytes of the letters U+00C0 to U+00FF, whose first byte is 0xC3.
        self.second = np.zeros(256, bool)
        self.second[0x80:0xC0] = True
        self.second[[0x97, 0xB7]] = False
        self._reset()

    def _reset(self) -> None:
        narrow = np.uint16 if len(self.closes) <= 1 << 16 else np.uint32
        self.keys, self.slots = np.empty(0, W.U), np.empty(0, np.int32)
        self.begins, self.counts, self.ids, self.used = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(1 << 16, narrow), 0

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        found = self.split(data, offsets)
        starts, ends = found.starts, found.ends
        if b"<|" in data.tobytes():
            return starts, ends, found.hashes, found.offsets
        cut = np.concatenate([ends[self._closed(data, starts, ends, k)] - k for k in (1, 2)])
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
        return starts, ends, self.fold.hashes(data, starts, ends), np.searchsorted(starts, offsets)

    def _closed(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: int) -> np.ndarray:
        """Units that end in exactly so many marks after a letter."""
        at = lambda k: data[np.maximum(ends - k, 0)]
        long = ends - starts > marks
        letter = self.letter[at(marks + 1)] | (self.second[at(marks + 1)] & (at(marks + 2) == 0xC3) & (ends - starts > marks + 1))
        return long & letter & np.logical_and.reduce([self.mark[at(k)] for k in range(1, marks + 1)])

    def _encode(self, units: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(units)
        plain = [i for i, u in enumerate(units) if u.isalpha()]
        odd = [i for i, u in enumerate(units) if not u.isalpha()]
        for first in range(0, len(plain), JOIN):
            part = plain[first : first + JOIN]
            ids = np.array(self.tokenizer.encode(" ".join(units[i] for i in part), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part):  # each unit is one word of the tokenizer, so its ids end where a word closes
                for i, a, b in zip(part, np.concatenate([[0], ends[:-1]]), ends):
                    out[i] = ids[a:b]
            else:
                odd += part
        if odd:
            for i, e in zip(odd, self.tokenizer.encode_batch([units[i] for i in odd], add_special_tokens=False)):
                out[i] = np.array(e.ids, np.uint32)
        return out

    def _learn(self, keys: np.ndarray, units: list[str]) -> None:
        ids = self._encode(units)
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        if self.used + len(flat) > len(self.ids):
            grown = np.empty((self.used + len(flat)) * 5 // 4, self.ids.dtype)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(flat)] = flat
        slots = (np.arange(len(keys)) + len(self.begins)).astype(np.int32)
        self.begins = np.concatenate([self.begins, (self.used + np.cumsum(counts) - counts).astype(np.uint32)])
        self.counts = np.concatenate([self.counts, counts.astype(np.uint32)])
        self.used += len(flat)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)

    def slots_of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The store's slot of each unit, and the range of units of each text."""
        if len(self.keys) > CACHE:
            self._reset()
        starts, ends, hashes, units = self._units(data, offsets)
        keys, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            body = data.tobytes()
            self._learn(keys[new], [body[starts[i] : ends[i]].decode("utf-8", "replace") for i in first[new]])
            at = np.searchsorted(self.keys, keys)
        return self.slots[at][which], units

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a slice in a row, and the range of ids of each text."""
        slots, units = self.slots_of(data, offsets)
        counts = self.counts[slots].astype(np.int64)
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.begins[slots].astype(np.int64) - (ends - counts), counts)
        return self.ids[at].astype(np.uint32), np.concatenate([[0], ends])[units]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each text of a slice has."""
        slots, units = self.slots_of(data, offsets)
        return np.diff(np.concatenate([[0], np.cumsum(self.counts[slots], dtype=np.int64)])[units])
