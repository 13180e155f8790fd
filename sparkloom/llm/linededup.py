"""Line deduplication by an exact set-similarity join.

A line is its set of words (lower case for A-Z). Tokens are ordered by rarity, taken from word counts in a table of fixed
size, and then by hash. Two lines whose Jaccard similarity is THRESHOLD or more share one of each other's rarest tokens
(the prefix); a frequent token stands for the pair it makes with one of the next tokens, as the lines share a second one in
a prefix that is one token longer. Lines that share such a key become candidates if length, position and parities allow it, and the
Jaccard similarity of candidates is verified on their whole sets. A line goes if an earlier line, by doc_id and place in the
document, is similar; rows that share a doc_id are told apart by a hash of their text.

Equal sets are dealt with before: only the first line of each set takes part in the join. Lines that share a key are in order
of size, and each is held against those near it whose size fits. A line is first verified with its few likeliest candidates,
and only if it matches none of them with more, so that a large group of copies is not verified all against all; no candidate
is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, cut, documents, in_turn, packed_table, whole_row

#: Jaccard similarity as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: Bits of the table of word counts; tokens in places with more than FREQUENT words, and LOAD times as many as places have on average, are joined in pairs.
COUNT_BITS, FREQUENT, LOAD = 24, 1024, 8
#: Entries that a task collects before it sends them on, and words of all lines for each bucket of entries.
SENT_AT_ONCE, BUCKET_WORDS = 500_000, 1_000_000
#: In a key with more lines a line is at first tried with so many of its neighbours by size alone.
CROWDED, HEADS = 1024, 16
#: Candidates of a line for each key, the likeliest, that are tried at first; in each further round MORE times as many.
NEAREST, MORE = 3, 8
#: Pairs that are held before all but the likeliest of them go, and pairs and steps to neighbours that few lines take at once.
HELD, PAIRS_AT_ONCE, STEPS_AT_ONCE = 1_000_000, 8192, 32
#: Bits of an entry's number in its bucket, as far as numbers and distances are packed to be sorted.
ENTRY_BITS, APART_BITS = 28, 8
#: Sets of so many tokens do with half the parities.
FEW_TOKENS = 72
#: Lines that are sorted together, and the bits of a token: its rarity and its hash.
LINES, LINE_BITS, RARITY_BITS, HASH_BITS = 4096, 12, 6, 46
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are read together.
AT_ONCE = 200_000
#: Bits of the filters through which tokens of lines are fetched, for sets and for documents; they only save work.
FILTER_BITS, DOC_FILTER_BITS = 27, 24

#: Packed arrays of one bucket: keys of 32 bits, set ids, and compressed the lines' documents, rows, places, sizes, the keys' positions and the lines' parities.
ENTRIES = "bucket int, key binary, id binary, rest binary"
REST = (np.int64, np.int64, np.int32, np.int32, np.int32, np.uint64, np.uint64)
#: Stands for a null doc_id, before all others.
NO_DOC = np.iinfo(np.int64).min


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2^64; kept for the next call."""
    if len(_powers[0]) < n:
        for i, base in enumerate((int(BASE), pow(int(BASE), -1, 1 << 64))):
            _powers[i] = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text begin, and a 64-bit hash of each in lower case: a polynomial in its bytes, mixed with its length."""
    raw = np.frombuffer(data.lower(), np.uint8)
    word = (raw != 0x20) & (raw - np.uint8(0x09) > 4)
    edges = np.flatnonzero(np.diff(np.r_[False, word, False]))
    starts, ends = edges[::2], edges[1::2]
    powers, inverse = _powers_of_base(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * powers[:-1], out=sums[1:])
    found = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * BASE
    found = (found ^ found >> np.uint64(32)) * MIX
    found = (found ^ found >> np.uint64(29)) * MIX
    return starts, found ^ found >> np.uint64(32)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of up to LINES lines with words: documents, rows, places in them, numbers of words, and the hashes of all words."""
    for batch in batches:
        docs = np.array([NO_DOC if d is None else d for d in batch.column(0).to_pylist()], np.int64)
        rows = batch.column(2).to_numpy(zero_copy_only=False)
        texts, at = [t or b"" for t in as_bytes(batch.column(1))], 0
        for group in in_turn(texts, AT_ONCE):
            data = b"\n".join(group)
            of_doc = np.array([t.count(b"\n") + 1 for t in group], np.int64)
            starts, hashes = word_hashes(data)
            # there are far fewer line breaks than words
            breaks = np.searchsorted(starts, np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A))
            sizes = np.diff(np.r_[0, breaks, len(starts)])
            doc_of_line, row_of_line = (np.repeat(x[at : at + len(group)], of_doc) for x in (docs, rows))
            place = np.arange(len(sizes)) - np.repeat(np.cumsum(of_doc) - of_doc, of_doc)
            some, word = np.flatnonzero(sizes), 0
            for i in range(0, len(some), LINES):
                part = some[i : i + LINES]
                n = int(sizes[part].sum())
                yield doc_of_line[part], row_of_line[part], place[part].astype(np.int32), sizes[part], hashes[word : word + n]
                word += n
            at += len(group)


def word_classes(texts: DataFrame) -> tuple[np.ndarray, int]:
    """A class of rarity for each of 2^COUNT_BITS places into which the words of all texts (doc_id, text, row) fall, and the number of words."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for *_, found in _lines(batches):
            yield found >> np.uint64(64 - COUNT_BITS)

    n_words = 0
    classes = np.zeros(1 << COUNT_BITS, np.uint8)
    for at, part, n in packed_table(texts, places, COUNT_BITS, np.dtype(np.int64), rarity_classes):
        classes[at : at + len(part)] = part
        n_words += n
    return classes, n_words


def rarity_classes(table: np.ndarray) -> np.ndarray:
    """A class for each place of the table: 0 for a single word, then by half steps of the logarithm."""
    steps = np.floor(2 * np.log2(np.maximum(table, 1))).astype(np.int64) + (table > 1)
    return np.minimum(steps, (1 << RARITY_BITS) - 1).astype(np.uint8)


def line_sets(sizes: np.ndarray, hashes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines with ``sizes`` words: distinct tokens by line and rarity, the number of the line of each, and each line's set id and parities, two words.

    A token stands for one of 64 bits and, in sets of more than FEW_TOKENS, for one of 128; a bit of the parities tells whether
    the set has an odd number of its tokens. So the parities of two sets differ in no more bits than the sets differ in
    tokens. The second word has the odd half of the 128 bits, the first both halves added up.
    """
    line = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    rarity = classes[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)].astype(np.uint64)
    packed = line << np.uint64(64 - LINE_BITS) | rarity << np.uint64(HASH_BITS) | hashes & np.uint64((1 << HASH_BITS) - 1)
    packed.sort()
    packed = packed[np.r_[True, packed[1:] != packed[:-1]]]
    line, tokens = (packed >> np.uint64(64 - LINE_BITS)).astype(np.int64), packed & np.uint64((1 << 64 - LINE_BITS) - 1)
    mixed = (tokens ^ tokens >> np.uint64(29)) * MIX
    mixed = (mixed ^ mixed >> np.uint64(32)) * MIX
    mixed ^= mixed >> np.uint64(29)
    starts = np.searchsorted(line, np.arange(len(sizes)))
    bit, high = np.uint64(1) << (mixed & np.uint64(63)), mixed >> np.uint64(6) & np.uint64(1)
    parities = np.stack([np.bitwise_xor.reduceat(bit, starts), np.bitwise_xor.reduceat(bit * high, starts)])
    parities[1, np.diff(np.r_[starts, len(line)]) <= FEW_TOKENS] = 0
    return tokens, line, np.add.reduceat(mixed, starts), parities


def least_overlap(n: np.ndarray) -> np.ndarray:
    """Fewest tokens that a set of n tokens has in common with a similar one."""
    return -(-NUMERATOR * n // DENOMINATOR)


def pair_overlap(both: np.ndarray) -> np.ndarray:
    """Fewest common tokens of similar sets that have so many tokens together."""
    whole = NUMERATOR + DENOMINATOR
    return (NUMERATOR * both + (whole - 1)) // whole


def prefix_keys(tokens: np.ndarray, line: np.ndarray, frequent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of lines, the line of each, the position of its (first) token, and the lines' sizes. ``frequent`` is the least class joined in pairs."""
    n = np.bincount(line)
    at = np.arange(len(line)) - (np.cumsum(n) - n)[line]
    prefix = (n - least_overlap(n) + 1)[line]
    rarity = tokens >> np.uint64(HASH_BITS)
    # a token that is the only one in its place of the table has no other line
    single = (at < prefix) & (rarity > 0) & (rarity < frequent)
    keys, lines, places = [tokens[single]], [line[single]], [at[single]]
    first = np.flatnonzero((at < prefix) & (rarity >= frequent))
    step = 1
    while len(first):
        second = first + step
        inside = second < len(line)
        first, second = first[inside], second[inside]
        inside = (line[second] == line[first]) & (at[second] <= prefix[first])
        first, second = first[inside], second[inside]
        keys.append((tokens[first] * MIX ^ tokens[second]) * MIX)
        lines.append(line[first])
        places.append(at[first])
        step += 1
    return np.concatenate(keys), np.concatenate(lines), np.concatenate(places), n


def _packed(bucket: int, keys: np.ndarray, ids: np.ndarray, *rest: np.ndarray) -> dict:
    import zstandard

    data = b"".join(x.astype(t).tobytes() for x, t in zip(rest, REST))
    return {"bucket": bucket, "key": keys.astype(np.uint32).tobytes(), "id": ids.tobytes(), "rest": zstandard.ZstdCompressor(level=1).compress(data)}


def _read(parts: pa.Table) -> list[np.ndarray]:
    """Keys, set ids, documents, rows, places, sizes and positions of packed rows."""
    import zstandard

    columns: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in (np.uint32, np.uint64, *REST)]
    for key, id_, rest in zip(*(parts.column(c).to_pylist() for c in ("key", "id", "rest"))):
        data, at = zstandard.ZstdDecompressor().decompress(rest), 0
        columns[0].append(np.frombuffer(key, np.uint32))
        columns[1].append(np.frombuffer(id_, np.uint64))
        n = len(id_) // 8
        for column, t in zip(columns[2:], REST):
            column.append(np.frombuffer(data, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(c) for c in columns]


def _by_bucket(values: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    bucket = ((values * MIX) >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(starts)).tolist():
        yield b, order[starts[b] : starts[b + 1]]


def _in_order(ids: np.ndarray, docs: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The order of lines by set and then by document, row and place."""
    return np.lexsort((places, rows, docs, ids) if rows.any() else (places, docs, ids))


def line_entries(texts: DataFrame, classes, buckets: int, frequent: int) -> DataFrame:
    """ENTRIES of ``texts`` (doc_id, text, row). Classes from ``frequent`` on are joined in pairs.

    Buckets from 0 on hold prefix keys; bucket -1 - b holds lines without keys: the first of each set among those that a task
    sends together, by set, with position 0, and the other lines, which go, with position -1. A task holds SENT_AT_ONCE
    entries, whatever its input; rows are never more than entries.
    """
    schema = pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("id", pa.binary()), ("rest", pa.binary())])

    def packed(first_of: list[tuple], parts: list[tuple]) -> pa.RecordBatch:
        ids, docs, rows, places = (np.concatenate(x) for x in zip(*first_of))
        keys, lines, at, n, low, high = (np.concatenate(x) for x in zip(*parts))
        order = _in_order(ids, docs, rows, places)
        first = np.zeros(len(ids), bool)
        first[order[np.r_[True, ids[order][1:] != ids[order][:-1]]]] = True
        chosen = first[lines]
        keys, lines, at, n, low, high = (x[chosen] for x in (keys, lines, at, n, low, high))
        out = []
        for b, x in _by_bucket(keys, buckets):
            y = lines[x]
            out.append(_packed(b, (keys[x] * MIX) >> np.uint64(32), ids[y], docs[y], rows[y], places[y], n[x], at[x], low[x], high[x]))
        for b, x in _by_bucket(ids, buckets):
            none = np.zeros(len(x), np.int64)
            out.append(_packed(-1 - b, none, ids[x], docs[x], rows[x], places[x], none, first[x].astype(np.int32) - 1, none, none))
        return pa.RecordBatch.from_pylist(out, schema)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        first_of: list[tuple] = []
        base = waiting = 0
        for docs, rows, places, sizes, hashes in _lines(batches):
            tokens, line, ids, parities = line_sets(sizes, hashes, classes.value)
            keys, lines, at, n = prefix_keys(tokens, line, frequent)
            parts.append((keys, (lines + base).astype(np.int32), at.astype(np.int32), n[lines].astype(np.int32), *parities[:, lines]))
            first_of.append((ids, docs, rows, places))
            base, waiting = base + len(ids), waiting + len(keys)
            if waiting + base >= SENT_AT_ONCE:
                yield packed(first_of, parts)
                parts, first_of, base, waiting = [], [], 0, 0
        if base:
            yield packed(first_of, parts)

    return arrow_rows(texts, entries, ENTRIES)


def _later_copies(parts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, rows and places of all lines of a bucket but the first of each set."""
    _, ids, docs, rows, places, _, j, _, _ = _read(parts)
    gone = j < 0
    first = np.flatnonzero(~gone)
    order = first[_in_order(ids[first], docs[first], rows[first], places[first])]
    again = np.r_[False, ids[order][1:] == ids[order][:-1]]
    gone[order[again]] = True
    if rows.any():
        # equal rows are one: their lines at the first one's place are that line
        kept, gone = order[~again], np.flatnonzero(gone)
        of = kept[np.searchsorted(ids[kept], ids[gone])]
        gone = gone[(docs[of] != docs[gone]) | (rows[of] != rows[gone]) | (places[of] != places[gone])]
    return docs[gone], rows[gone], places[gone]


#: kind 0: a line that goes. kind 1: a candidate, sets a and b, b's first line. kind 2: entries of crowded keys.
TRIED = "kind int, a long, b long, a_doc long, doc_id long, row long, line int, more boolean, bucket int, key binary, id binary, rest binary, crowd_key long"


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which 32-bit keys occur more than once."""
    packed = keys.astype(np.uint64) << np.uint64(32) | np.arange(len(keys), dtype=np.uint64)
    packed.sort()
    same = packed[1:] >> np.uint64(32) == packed[:-1] >> np.uint64(32)
    out = np.zeros(len(keys), bool)
    if len(keys):
        out[(packed & np.uint64(0xFFFFFFFF)).astype(np.int64)[np.r_[False, same] | np.r_[same, False]]] = True
    return out


def _line_rank(docs: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Numbers that order lines by document, row and place: both packed where they fit, or else counted up."""
    if len(docs) and not rows.any():
        first, width = int(docs.min()), int(places.max()) + 1
        if (int(docs.max()) - first + 1) * width < 1 << 63:
            return ((docs - first) * width + places).astype(np.uint64)
    rank = np.empty(len(docs), np.uint64)
    rank[np.lexsort((places, rows, docs))] = np.arange(len(docs), dtype=np.uint64)
    return rank


def _repeats(keys: np.ndarray, ids: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which entries have the key and set of one with a smaller rank; of those of one rank all but the first are."""
    mixed = keys.astype(np.uint64) * MIX ^ ids
    order = np.argsort(mixed)
    same = mixed[order[1:]] == mixed[order[:-1]]
    # equal keys and sets are mixed to equal numbers: only among these can be repeats
    some = np.sort(order[np.r_[False, same] | np.r_[same, False]]) if len(order) else order
    some = some[np.lexsort((rank[some], ids[some], keys[some]))]
    out = np.zeros(len(keys), bool)
    out[some[1:][(keys[some[1:]] == keys[some[:-1]]) & (ids[some[1:]] == ids[some[:-1]])]] = True
    return out


def _by_size(keys: np.ndarray, n: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The order by key, size and rank."""
    if len(keys):
        bits = [int(x.max()).bit_length() for x in (keys, n, rank)]
        if sum(bits) <= 64:
            return np.argsort((keys.astype(np.uint64) << np.uint64(bits[1]) | n.astype(np.uint64)) << np.uint64(bits[2]) | rank)
    return np.lexsort((rank, n, keys))


def _nearest(a: np.ndarray, b: np.ndarray, d: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each b the ``most`` a with the least d; and whether b has as many."""
    at, low = np.uint64(ENTRY_BITS + APART_BITS), np.uint64(ENTRY_BITS)
    packed = b.astype(np.uint64) << at | d.astype(np.uint64) << low | a.astype(np.uint64)
    packed.sort()
    b = (packed >> at).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(b)])
    near = np.flatnonzero(np.arange(len(b)) - np.repeat(starts, sizes) < most)
    packed, full = packed[near], np.repeat(sizes >= most, sizes)[near]
    part = lambda shift, bits: (packed >> shift & np.uint64((1 << bits) - 1)).astype(np.int64)
    return part(np.uint64(0), ENTRY_BITS), b[near], part(low, APART_BITS), full


class Bucket:
    """The entries of a bucket whose key several sets share, the first line of each set, in the order of keys and lines."""

    def __init__(self, parts: pa.Table):
        keys, ids, docs, rows, places, *rest = _read(parts)
        shared = np.flatnonzero(_repeated(keys))
        if len(shared) >= 1 << ENTRY_BITS:
            raise ValueError("a bucket has more entries than can be numbered")
        rank = _line_rank(docs[shared], rows[shared], places[shared])
        # the first line of each set for each key, by key, size and line
        once = np.flatnonzero(~_repeats(keys[shared], ids[shared], rank))
        shared, rank = shared[once], rank[once]
        order = _by_size(keys[shared], rest[0][shared], rank)
        shared, self.rank = shared[order], rank[order]
        self.columns = [x[shared] for x in (keys, ids, docs, rows, places, *rest)]
        self.keys, self.ids, self.docs, self.rows, self.places, n, j, self.low, self.high = self.columns
        # tokens, and those from the key's on
        self.n, self.left = n, n - j
        starts = np.flatnonzero(np.r_[True, self.keys[1:] != self.keys[:-1]]) if len(self.keys) else np.zeros(0, np.int64)
        self.sizes = np.diff(np.r_[starts, len(self.keys)])
        self.starts, self.sizes_each = np.repeat(starts, self.sizes), np.repeat(self.sizes, self.sizes)
        self.ends = self.starts + self.sizes_each

    def possible(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pairs of lines of similar sizes that may be similar, and in how many parities each of them differs."""
        both = self.n[a] + self.n[b]
        need = pair_overlap(both)
        chosen = np.flatnonzero(np.minimum(self.left[a], self.left[b]) >= need)
        a, b, most = a[chosen], b[chosen], (both - 2 * need)[chosen]
        folded, high = self.low[a] ^ self.low[b], self.high[a] ^ self.high[b]
        many = np.minimum(self.n[a], self.n[b]) > FEW_TOKENS
        apart = np.where(many, np.bitwise_count(folded ^ high) + np.bitwise_count(high), np.bitwise_count(folded)).astype(np.int32)
        fits = np.flatnonzero(apart <= most)
        return chosen[fits], apart[fits]

    def _neighbours(self, members: np.ndarray, side: int, crowd: int | None, heads: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of ``members`` and entries of their key before (side -1) or after them (side 1) whose sizes fit."""
        step = 1
        while len(members):
            steps = np.arange(step, step + max(1, min(STEPS_AT_ONCE, PAIRS_AT_ONCE // len(members))))
            one, further = np.repeat(members, len(steps)), np.tile(steps, len(members))
            other = one + side * further
            inside = np.flatnonzero(other >= self.starts[one] if side < 0 else other < self.ends[one])
            one, other, further = one[inside], other[inside], further[inside]
            n, m = self.n[one], self.n[other]
            fits = DENOMINATOR * np.minimum(n, m) >= NUMERATOR * np.maximum(n, m)
            if crowd is not None and steps[-1] > heads:
                fits &= (further <= heads) | (self.sizes_each[one] <= crowd)
            one, other, further = one[fits], other[fits], further[fits]
            yield one, other
            # sizes are in order: who doesn't fit now won't further on
            members = one[further == steps[-1]]
            step += len(steps)

    def candidates(self, members: np.ndarray | None, most: int, crowd: int | None = None, heads: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (a, b) of entries, a the earlier, with b among ``members`` (all if None): the ``most`` likeliest of each b; and whether b may have others.

        In keys with more than ``crowd`` lines only ``heads`` neighbours by size are tried.
        """
        held: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(3))]
        n_held = 0
        asked = np.arange(len(self.keys)) if members is None else members
        for side in (-1,) if members is None else (-1, 1):
            for one, other in self._neighbours(asked, side, crowd, heads):
                later = self.rank[one] > self.rank[other]
                if members is not None:
                    one, other, later = one[later], other[later], later[later]
                a, b = np.where(later, other, one), np.where(later, one, other)
                good, apart = self.possible(a, b)
                held.append((a[good], b[good], apart.astype(np.int64)))
                n_held += len(good)
                if n_held > HELD:
                    held, n_held = [_nearest(*map(np.concatenate, zip(*held)), most)[:3]], 0
        a, b, _, full = _nearest(*map(np.concatenate, zip(*held)), most)
        if crowd is not None:
            hidden = np.flatnonzero(self.sizes_each > crowd)
            full |= self.sizes_each[b] > crowd
            # with none among those tried, a line stands for itself
            alone = np.setdiff1d(hidden, b)
            a, b, full = np.r_[a, alone], np.r_[b, alone], np.r_[full, np.ones(len(alone), bool)]
        return a, b, full

    def wanted(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The entries with such a key and set, perhaps a few more."""
        mixed = lambda k, i: k.astype(np.uint64) * MIX ^ i.view(np.uint64)
        return np.flatnonzero(np.isin(mixed(self.keys, self.ids), mixed(keys, ids)))


def _tried(table: pa.Table, crowd: int, heads: int, nearest: int) -> pa.Table:
    """TRIED of the rows of one bucket."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        docs, rows, places = _later_copies(table)
        return _rows(len(docs), {"kind": 0, "doc_id": docs, "row": rows, "line": places})
    x = Bucket(table)
    a, b, more = x.candidates(None, nearest, crowd, heads)
    signed = x.ids.view(np.int64)
    found = _rows(len(a), {"kind": 1, "a": signed[a], "b": signed[b], "a_doc": x.docs[a], "doc_id": x.docs[b], "row": x.rows[b], "line": x.places[b], "more": more, "bucket": bucket, "crowd_key": x.keys[b]})
    if not more.any():
        return found
    kept = np.flatnonzero(np.isin(x.starts, x.starts[b[more]]))
    return pa.concat_tables([found, _rows(1, {"kind": 2} | {k: v if k == "bucket" else [v] for k, v in _packed(bucket, *(c[kept] for c in x.columns)).items()})])


def _rows(n: int, columns: dict) -> pa.Table:
    """``n`` rows of TRIED; a single value holds for all of them, and what isn't there is null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrays = {}
    for name, kind in (c.split() for c in TRIED.split(", ")):
        value = columns.get(name)
        if value is None or isinstance(value, int):
            arrays[name] = pa.nulls(n, kinds[kind]) if value is None else pa.repeat(pa.scalar(value, kinds[kind]), n)
        else:
            arrays[name] = pa.array(value, kinds[kind])
    return pa.table(arrays)


OTHERS = "a long, b long, a_doc long, doc_id long, row long, line long, bucket long, crowd_key long, more boolean"


def _others(most: int):
    def find(parts: pa.Table, unresolved: pa.Table) -> pa.Table:
        """OTHERS of the unresolved lines of a bucket: ``most`` candidates for each key."""
        names = [c.split()[0] for c in OTHERS.split(", ")]
        if not len(parts) or not len(unresolved):
            return pa.table({c: pa.array([], pa.bool_() if c == "more" else pa.int64()) for c in names})
        x = Bucket(parts)
        a, b, more = x.candidates(x.wanted(*(unresolved.column(c).to_numpy() for c in ("crowd_key", "b"))), most)
        signed = x.ids.view(np.int64)
        columns = [pa.array(c, pa.int64()) for c in (signed[a], signed[b], x.docs[a], x.docs[b], x.rows[b], x.places[b], np.full(len(a), parts.column("bucket")[0].as_py()), x.keys[b])]
        return pa.table(dict(zip(names, [*columns, pa.array(more)])))

    return find


def _filters(wanted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Filters of 2^FILTER_BITS and 2^DOC_FILTER_BITS bits for the sets and documents ``wanted`` (id, doc), put together by executors."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            ids, docs = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            yield ids & np.uint64((1 << FILTER_BITS) - 1)
            yield (docs & np.uint64((1 << DOC_FILTER_BITS) - 1)) + np.uint64(1 << FILTER_BITS)

    bits = np.zeros((1 << FILTER_BITS) + (1 << DOC_FILTER_BITS) >> 3, np.uint8)
    for at, part, _ in packed_table(wanted, places, FILTER_BITS + 1, np.dtype(np.int8), np.packbits):
        bits[at >> 3 : (at >> 3) + len(part)] = part
    return bits[: 1 << FILTER_BITS - 3], bits[1 << FILTER_BITS - 3 :]


def _may_hold(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = values.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def live_tokens(texts: DataFrame, classes, wanted: DataFrame) -> DataFrame:
    """(id, tokens) of the sets ``wanted`` (id, doc: a document that has it), perhaps of a few more."""
    held = texts.sparkSession.sparkContext.broadcast(_filters(wanted))  # of a fixed size

    def chosen_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).fill_null(int(NO_DOC)).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(_may_hold(held.value[1], docs)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for *_, sizes, hashes in _lines(chosen_docs(batches)):
            tokens, line, ids, _ = line_sets(sizes, hashes, classes.value)
            signed = ids.view(np.int64)
            hit = _may_hold(held.value[0], signed)
            starts = np.searchsorted(line, np.arange(len(sizes) + 1))
            chosen = [i for i in np.flatnonzero(hit).tolist() if not (signed[i].item() in seen or seen.add(signed[i].item()))]
            if chosen:
                lists = [tokens[starts[i] : starts[i + 1]].view(np.int64) for i in chosen]
                yield pa.RecordBatch.from_arrays([pa.array(signed[chosen]), pa.array(lists, pa.list_(pa.int64()))], names=["id", "tokens"])

    return arrow_rows(texts, rows, "id long, tokens array<long>")


def removed_lines(texts: DataFrame, crowd: int = CROWDED, frequent: int = FREQUENT, heads: int = HEADS, nearest: int = NEAREST) -> DataFrame:
    """(doc_id, row, line): the lines of ``texts`` (doc_id, text, row) that an earlier similar line makes superfluous; NO_DOC is the null doc_id.

    Earlier is by doc_id, row and place; rows that agree in doc_id and ``row`` have equal texts and are one document.
    """
    spark = texts.sparkSession
    table, n_words = word_classes(texts)
    buckets = max(16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // BUCKET_WORDS)
    classes = spark.sparkContext.broadcast(table)  # of a fixed size
    least = int(rarity_classes(np.array([max(frequent, LOAD * n_words >> COUNT_BITS)]))[0])
    first = lambda table: _tried(table, crowd, heads, nearest)
    tried = cut(line_entries(texts, classes, buckets, least).groupBy("bucket").applyInArrow(first, TRIED))
    gone = tried.where("kind = 0").select("doc_id", "row", "line")
    at = (F.min("a_doc").alias("a_doc"), F.min("doc_id").alias("doc_id"), F.min("row").alias("row"), F.min("line").cast("int").alias("line"))
    pairs = cut(tried.where("kind = 1 and a <> b").groupBy("a", "b").agg(*at))
    matched = cut(_verified(texts, classes, pairs))
    gone = gone.union(matched.select("doc_id", "row", "line"))
    open_, most = cut(tried.where("kind = 1 and more").select("bucket", "crowd_key", "b").distinct().join(matched.select("b"), "b", "left_anti")), nearest
    kept = tried.where("kind = 2").select("bucket", "key", "id", "rest")
    while not open_.isEmpty():
        # more candidates of the lines that match none so far, until none has more
        most *= MORE
        found = cut(kept.groupBy("bucket").cogroup(open_.groupBy("bucket")).applyInArrow(_others(most), OTHERS))
        others = cut(found.groupBy("a", "b").agg(*at).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
        if not others.isEmpty():
            matched = cut(_verified(texts, classes, others))
            gone = gone.union(matched.select("doc_id", "row", "line"))
            pairs = pairs.select("a", "b").union(others.select("a", "b"))
        open_ = cut(found.where("more").select("bucket", "crowd_key", "b").distinct().join(matched.select("b"), "b", "left_anti"))
    return gone.distinct()


def _verified(texts: DataFrame, classes, pairs: DataFrame) -> DataFrame:
    """(b, doc_id, row, line) of the pairs (a, b, a_doc, doc_id, row, line) whose sets are similar."""
    sides = F.array(F.struct(F.col("a").alias("id"), F.col("a_doc").alias("doc")), F.struct(F.col("b").alias("id"), F.col("doc_id").alias("doc")))
    tokens = live_tokens(texts, classes, pairs.select(F.explode(sides).alias("x")).select("x.*"))
    tokens = tokens.groupBy("id").agg(F.first("tokens").alias("tokens"))
    left, right = tokens.toDF("a", "x"), tokens.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    similar = DENOMINATOR * both >= NUMERATOR * (F.size("x") + F.size("y") - both)
    return pairs.join(right, "b").join(left, "a").where(similar).select("b", "doc_id", "row", "line").distinct()


def dedup_lines(docs: DataFrame, **tuning) -> DataFrame:
    """``docs`` with its columns; lines of ``text`` that are similar to an earlier line are gone, and n_chars, if it is there, is the new length.

    Lines end at line breaks; earlier is by doc_id (null first) and then by place. Lines without words stay, and so do
    documents that lose all lines (their text is then empty); a null text stays null. Rows that share a doc_id, or have none,
    are documents of their own, ordered by a hash of the text. Only rows with equal doc_id and equal text are one document:
    each of them loses what it repeats of earlier documents, and they don't remove each other's lines. An empty table gives
    no row. Other columns are carried along.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    most = docs.groupBy(doc_id.alias("doc_id")).count().agg(F.max("count")).first()[0]
    own_row = lambda t: F.xxhash64(t) if (most or 0) > 1 else F.lit(0).cast("long")
    texts = docs.select(doc_id.alias("doc_id"), text.alias("text"), own_row(text).alias("row"))
    gone = removed_lines(texts, **tuning).groupBy("doc_id", "row").agg(F.collect_list("line").alias("gone")).select(F.col("doc_id").alias("gone_id"), F.col("row").alias("gone_row"), "gone")
    row = docs.select(whole_row(docs).alias("row"))
    held = lambda name: F.col("row").getField(name)
    same = F.coalesce(held("doc_id").cast("long"), F.lit(int(NO_DOC))) == F.col("gone_id")
    if (most or 0) > 1:
        same = same & (own_row(held("text").cast("string")) == F.col("gone_row"))
    joined = row.join(gone, same, "left")

    @F.pandas_udf("string")
    def without(text: pd.Series, gone: pd.Series) -> pd.Series:
        def kept(t, g):
            if t is None or g is None:
                return None
            lines, drop = t.split("\n"), set(g.tolist())
            return "\n".join([x for i, x in enumerate(lines) if i not in drop])

        return pd.Series([kept(t, g) for t, g in zip(text, gone)], dtype=object)

    # texts that stay whole don't go through Python
    cut_text = without(F.when(F.col("gone").isNotNull(), held("text").cast("string")), F.col("gone"))
    columns = {c: held(c) for c in docs.columns} | {"text": F.when(F.col("gone").isNull(), held("text")).otherwise(cut_text)}
    if "n_chars" in columns:
        columns["n_chars"] = F.length(columns["text"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(v.alias(k) for k, v in columns.items()))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    lines = lambda t: F.when(F.col(t).isNull(), 0).when(F.col(t) == "", 0).otherwise(F.size(F.split(t, "\n", -1)))
    before = docs.select("doc_id", "text", lines("text").cast("long").alias("n_lines"))
    after = dedup_lines(before)
    return after.select("doc_id", "n_lines", lines("text").cast("long").alias("n_kept"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
