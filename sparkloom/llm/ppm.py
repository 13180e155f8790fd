"""Prediction by partial matching over bytes, as arrays: counts, the context trie's tables, and scores.

A text is its words in lower case with one space between them, an end mark last. The trie's nodes are contexts of up to
ORDER bytes with their counts. A symbol that follows a context has probability (count - DISCOUNT) / total there; what is
left is the probability of an escape to the context that is one byte shorter, in which the symbols of the longer context are
excluded. After the empty context all symbols that are left are alike.

Contexts and the symbol after them are bytes of one 64-bit number: the symbol is the highest byte, the bytes before it
follow. All positions of a text are looked up together.
"""

from __future__ import annotations

import numpy as np

ORDER, DISCOUNT = 6, 0.5
SPACE, END = 0x20, 0x0A
#: 256 bytes: the space ends words, the line break (never part of a word) ends texts.
SYMBOLS = 256
PAD = bytes([SPACE]) * 8
MIX = np.uint64(0x9E3779B97F4A7C15)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of the joined ``texts`` the eight bytes that end with it, and the number of symbols of each text.

    ``texts`` are normalised and without their end mark. Eight spaces stand before each text, so contexts don't reach into
    the text before; they aren't symbols.
    """
    joined = b"".join([part for text in texts for part in (PAD, text, b"\n")])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    if not texts:
        return np.zeros(0, np.uint64), sizes
    every = np.ndarray((len(joined) - 7,), "<u8", joined, strides=(1,))  # at i: bytes i to i + 7
    keep = np.ones(len(joined), bool)
    starts = np.cumsum(sizes + len(PAD)) - sizes - len(PAD)
    for i in range(len(PAD)):
        keep[starts + i] = False
    return every[keep[7:]], sizes


def entry_keys(found: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of context and the symbol."""
    return found >> np.uint64(8 * (7 - order))


def context_keys(found: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes of context, without the symbol."""
    return (found << np.uint64(8)) >> np.uint64(8 * (8 - order)) if order else np.zeros(len(found), np.uint64)


def count_keys(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs, or the sums of its weights."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if weights is None:
        keys = np.sort(keys)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.diff(np.r_[first, len(keys)])
    # keys often come as a few runs in order, which this sort merges
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(weights, first)


class Table:
    """An open-addressing hash table from 64-bit keys to places in arrays, for lookups of many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.places = np.full(1 << self.bits, -1, np.int32)
        left, slots = np.arange(len(keys), dtype=np.int32), self._slots(keys)
        while len(left):
            free = self.places[slots] < 0
            # of several keys for one free slot the last written stays
            self.places[slots[free]] = left[free]
            placed = self.places[slots] == left
            self.keys[slots[placed]] = keys[left[placed]]
            left, slots = left[~placed], (slots[~placed] + 1) & (len(self.keys) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't there."""
        slots = self._slots(keys)
        places = self.places[slots]
        missed = np.flatnonzero((places >= 0) & (self.keys[slots] != keys))
        slots, wanted = slots[missed], keys[missed]
        while len(missed):
            slots = (slots + 1) & (len(self.keys) - 1)
            now = self.places[slots]
            places[missed] = now
            again = (now >= 0) & (self.keys[slots] != wanted)
            missed, slots, wanted = missed[again], slots[again], wanted[again]
        return places


class Model:
    """The trie of entries (context and symbol) and contexts ready for lookups."""

    def __init__(self, entries: list[tuple[np.ndarray, np.ndarray]], totals: list[tuple[np.ndarray, np.ndarray]]):
        """``entries`` and ``totals`` by order: keys and counts of entries, keys and totals of contexts.

        What is there of one order must be there, one byte shorter, of the order below; each entry's context must be there.
        """
        self.order = len(entries) - 1
        self.entries = [Table(k) for k, _ in entries]
        self.contexts = [Table(k) for k, _ in totals]
        self.unseen = np.log10(max(1, SYMBOLS - len(entries[0][0])))
        homes = [table.find(keys & np.uint64((1 << 8 * k) - 1)) for k, (table, (keys, _)) in enumerate(zip(self.contexts, entries))]
        seen = [np.bincount(home, c - DISCOUNT, len(t)) for home, (_, c), (t, _) in zip(homes, entries, totals)]
        self.log_counts = [_log(c - DISCOUNT) for _, c in entries]
        # of an entry that is reached without exclusions
        self.log_alone = [_log((c - DISCOUNT) / t[home]) for home, (_, c), (_, t) in zip(homes, entries, totals)]
        self.log_escapes = [_log((t - x) / t) for x, (_, t) in zip(seen, totals)]
        # of a context: what is left of its parent, one byte shorter, without the symbols that the context has itself
        self.log_rests, self.log_rest_escapes = [_log(np.zeros(0))], [_log(np.zeros(0))]
        for k in range(1, self.order + 1):
            above = self.contexts[k - 1].find(totals[k][0] >> np.uint64(8))
            parent_counts = entries[k - 1][1][self.entries[k - 1].find(entries[k][0] >> np.uint64(8))]
            n = len(above)
            rest = totals[k - 1][1][above] - np.bincount(homes[k], parent_counts, n)
            rest_seen = seen[k - 1][above] - np.bincount(homes[k], parent_counts - DISCOUNT, n)
            some = rest > 0.5  # else nothing is left there, and the escape is certain
            self.log_rests.append(_log(rest))
            self.log_rest_escapes.append(np.where(some, _log((rest - rest_seen) / np.where(some, rest, 1)), np.float32(0)))

    def score(self, found: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte of each of ``found`` (windows of eight bytes) after the others."""
        out = np.zeros(len(found))
        left = np.arange(len(found))
        longer = np.full(len(found), -1, np.int32)  # the context one byte longer, -1 where the trie has none
        for k in range(self.order, -1, -1):
            entry = self.entries[k].find(entry_keys(found, k))
            hit, inside = entry >= 0, longer >= 0
            direct, excluded = hit & ~inside, hit & inside
            out[left[direct]] += self.log_alone[k][entry[direct]]
            if k < self.order:
                out[left[excluded]] += self.log_counts[k][entry[excluded]] - self.log_rests[k + 1][longer[excluded]]
            missed = np.flatnonzero(~hit)
            left, found, longer, inside = left[missed], found[missed], longer[missed], inside[missed]
            here = self.contexts[k].find(context_keys(found, k))
            fresh = ~inside & (here >= 0)
            out[left[fresh]] += self.log_escapes[k][here[fresh]]
            if k < self.order:
                out[left[inside]] += self.log_rest_escapes[k + 1][longer[inside]]
            longer = here
        out[left] -= self.unseen
        return out


def _log(x: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(x, 1e-30)).astype(np.float32)


def pair_counts(keys: np.ndarray, counts: np.ndarray, order: int) -> np.ndarray:
    """How often each byte (times 1) and symbol after it (times 256) occur in entries of ``order``."""
    return np.bincount((keys >> np.uint64(8 * (order - 1))).astype(np.int64), counts, minlength=1 << 16).astype(np.int64)


def low_orders(pairs: np.ndarray) -> list[tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """Entries and contexts of orders 0 and 1, from counts of pairs."""
    keys = np.flatnonzero(pairs)
    one = keys.astype(np.uint64), pairs[keys]
    zero = shorter(*one)
    return [(zero, context_totals(*zero, 0)), (one, context_totals(*one, 1))]


def shorter(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries, or contexts, of the order below."""
    return count_keys(keys >> np.uint64(8), counts)


def context_totals(keys: np.ndarray, counts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of entries of ``order``, and how often each occurs."""
    return count_keys(keys & np.uint64((1 << 8 * order) - 1), counts)
