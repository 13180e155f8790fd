"""Texts cut where no token of a byte-level vocabulary spans, so that what is found for a chunk counts wherever it occurs.

A chunk begins at a space that stands between two characters other than white space. The byte-level splitting rule ends a
token there whatever stands around, and so does a vocabulary of pieces that have no space after another character.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import runs
from .packing import vocabulary_path

#: White space of any kind, for both regular expression libraries: a superset of what a splitting rule takes for it.
SPACE = r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Texts with a space that isn't between two other characters.
ODD = f"^ | $| [{SPACE}]|[{SPACE}] "
CUT = re.compile(r"(?<=\S) (?=\S)")
LETTERS = "".join(map(chr, [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]))
#: ASCII punctuation but for the apostrophe, which may begin a token with letters.
SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
#: Bytes of text that are looked up together; units that a worker keeps, and bytes of one that it keeps.
AT_ONCE, CACHED_UNITS, LONG_UNIT = 16_000_000, 900_000, 64
#: Units that are encoded in one call.
AT_A_TIME = 1000


def gathered(batches: Iterator[pa.RecordBatch], text: int, at_once: int = AT_ONCE) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables with about ``at_once`` bytes in column ``text``, or one row more."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        n = batch.column(text).nbytes
        if waiting and size + n > at_once:
            yield pa.Table.from_batches(waiting).combine_chunks()
            waiting, size = [], 0
        waiting.append(batch)
        size += n
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def flat(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def pieces_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(number of each text's pieces, the pieces): the text at its cuts, each but the first without the space it begins with. An empty or null text has one empty piece."""
    texts = pc.fill_null(flat(texts).cast(pa.large_string()), "")
    odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False))
    plain = pc.split_pattern(texts, " ")
    if not len(odd):
        return np.diff(plain.offsets.to_numpy()), plain.values
    lists = plain.take(pa.array(np.setdiff1d(np.arange(len(texts)), odd)))
    found = [CUT.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
    # the odd ones follow the others, and an order puts all in place
    whole = pa.concat_arrays([lists, pa.array(found, lists.type)])
    order = np.empty(len(texts), np.int64)
    order[np.r_[np.setdiff1d(np.arange(len(texts)), odd), odd]] = np.arange(len(texts))
    placed = whole.take(pa.array(order))
    return pc.list_value_length(placed).to_numpy(zero_copy_only=False).astype(np.int64), placed.flatten()


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, kind: str):
        self._data, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self._data):
            self._data = np.concatenate([self._data[: self.n], np.zeros(max(len(self._data), len(values)), self._data.dtype)])
        self._data[self.n : self.n + len(values)] = values
        self.n += len(values)

    @property
    def data(self) -> np.ndarray:
        return self._data[: self.n]


class ByteEncoder:
    """Token ids of chunks by a byte-level vocabulary. A unit is a run of letters with the space before it, or what else stands in a chunk; the ids of each are found once."""

    def __init__(self, vocabulary: str, plain_special: bool = False, cached: int = CACHED_UNITS):
        # a task has one core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        path = vocabulary_path(vocabulary)
        self.cached = cached
        self.tokenizer = Tokenizer.from_file(path)
        #: Whether special tokens' strings in a text are plain text.
        self.tokenizer.encode_special_tokens = plain_special
        with open(path, encoding="utf-8") as file:
            rule = json.load(file)
        split = rule["pre_tokenizer"]
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or rule["normalizer"]:
            raise ValueError("the vocabulary isn't split as byte-level ones are, and chunks wouldn't hold")
        tokens = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(tokens.values()) + 1, bool)
        self.leads[[i for token, i in tokens.items() if token.startswith("Ġ")]] = True
        self.forget()

    def forget(self) -> None:
        """Unit 0 is empty."""
        self.spaced: dict[str, int] = {}
        self.bare: dict[str, int] = {"": 0}
        self.starts, self.sizes, self.ids = Grown("i8"), Grown("i8"), Grown("i4")
        self.add_unit([])

    def trim(self) -> None:
        """To be called between tables: what is kept doesn't grow with the input."""
        if len(self.spaced) + len(self.bare) > self.cached:
            self.forget()

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> int:
        """The number of the first of the units that have these ids."""
        first = self.sizes.n
        self.starts.add(self.ids.n + np.cumsum(sizes) - sizes)
        self.sizes.add(sizes)
        self.ids.add(ids)
        return first

    def add_unit(self, ids: list[int]) -> int:
        return self._add(np.array(ids, np.int32), np.array([len(ids)]))

    def _encoded(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def numbers(self, words: list[str], spaced: bool) -> np.ndarray:
        """Numbers of units: the words, each with a space before it if ``spaced``."""
        known = self.spaced if spaced else self.bare
        new = list(set(words).difference(known))
        once: dict[str, int] = {}
        if new:
            letters = [w for w in new if spaced and w.isalpha()]
            groups = [letters[i : i + AT_A_TIME] for i in range(0, len(letters), AT_A_TIME)]
            for group, ids in zip(groups, self._encoded([" " + " ".join(g) for g in groups])):
                ids = np.array(ids, np.int32)
                begins = np.flatnonzero(self.leads[ids])
                if len(begins) != len(group):
                    raise ValueError("the vocabulary's tokens don't end where words end")
                first = self._add(ids, np.diff(np.r_[begins, len(ids)]))
                known.update(zip(group, range(first, first + len(group))))
            rest = [w for w in new if w not in known] if len(letters) < len(new) else []
            found = self._encoded([f" {w}" if spaced else w for w in rest])
            first = self._add(np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found)))
            for number, word in enumerate(rest, first):
                (known if len(word) <= LONG_UNIT else once)[word] = number
        numbers = map(known.__getitem__, words) if not once else (known[w] if w in known else once[w] for w in words)
        return np.fromiter(numbers, np.int32, len(words))

    def units(self, pieces: pa.Array) -> np.ndarray:
        """Two unit numbers for each distinct piece with a space before it: letters and what follows them, or all of it and none."""
        stem, tail = pc.utf8_rtrim(pieces, characters=SIGNS), pc.utf8_ltrim(pieces, characters=LETTERS)
        size = lambda x: pc.binary_length(x).to_numpy(zero_copy_only=False)
        stems, tails = size(stem), size(tail)
        regular = pa.array((stems + tails == size(pieces)) & (stems > 0))
        del stems, tails
        out = np.empty((len(pieces), 2), np.int32)
        for i, (part, spaced) in enumerate([(pc.if_else(regular, stem, pieces), True), (pc.if_else(regular, tail, ""), False)]):
            coded = flat(part).dictionary_encode()
            out[:, i] = self.numbers(coded.dictionary.to_pylist(), spaced)[coded.indices.to_numpy()]
        return out

    def ids_of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units one after another, number of each unit's)."""
        sizes = self.sizes.data[units]
        return runs(self.ids.data, self.starts.data[units], sizes), sizes
