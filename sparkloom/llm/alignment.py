"""Alignment of two tokenizers' tokens over the same text, by a dangling-suffix transducer.

Tokens of both sides are read in turn, always one of the side that lags. The state is which side leads and the bytes by which
it leads; where none are left over, a group of tokens that cover the same bytes is closed. States are numbered, and the step
from a state by a token is found once.

Both tokenizers end a token at a chunk's end (see ``chunks``), so a chunk is encoded and aligned once by a worker and counts
wherever it occurs. The documents of a block write their links as places in the block's own list of linked pairs. Counts of
pairs are sums over blocks; each block gets the counts of its pairs back, not the other way round, so no table of all pairs
is held anywhere.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ByteEncoder, Grown, flat, gathered, pieces_of
from .common import arrow_rows, documents, runs
from .packing import vocabulary_path
from .tokencount import byte_of_character
from .tokenfiles import shared_folder

BYTE_VOCABULARY, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stands for a space in pieces.
PIECE_SPACE = "▁"
#: Steps, chunks and bytes of chunks that a worker keeps, and bytes of one that it keeps.
CACHED_STEPS, CACHED_CHUNKS, CACHED_BYTES, LONG_CHUNK = 500_000, 300_000, 12_000_000, 64
#: Units that the byte-level side keeps, bytes of a block's texts, and new chunks that are aligned together.
CACHED_UNITS, BLOCK_BYTES, NEW_AT_ONCE = 200_000, 6_000_000, 30_000
#: Bits of the number of a place where a step is looked up, and how few chunks are aligned one by one.
STEP_BITS, FEW_CHUNKS = 20, 32
MIX = np.uint64(0x9E3779B97F4A7C15)
#: One side's id is the upper half of a pair's number.
HALF = 32
STATS = "n_a long, n_b long, n_groups long, groups_sha256 string"
BLOCK = f"block long, doc_id long, {STATS}, links array<int>, place int, pair long, n long"


class Transducer:
    """``a`` and ``b``: the bytes of each side's tokens. State 0 is empty; others are (whether A leads, the bytes by which it leads)."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.bytes = (a, b)
        self._forget()

    def _forget(self) -> None:
        self.states: list[tuple[bool, bytes]] = [(False, b"")]
        self.numbers: dict[tuple[bool, bytes], int] = {(False, b""): 0}
        self.steps: dict[int, int] = {}
        #: By place: the step last looked up there and what it leads to, twice the state's number and 1 if A leads; -1 if nowhere.
        self.placed, self.after = np.full(1 << STEP_BITS, -1, np.int64), np.zeros(1 << STEP_BITS, np.int64)

    def _step(self, state: int, token: int) -> int:
        """The state after ``token`` of the side that lags; -1 if its bytes aren't those that it should cover."""
        a_leads, left = self.states[state]
        said = self.bytes[a_leads][token]
        if left.startswith(said):
            after = (a_leads, left[len(said) :])
        elif said.startswith(left):
            after = (not a_leads, said[len(left) :])
        else:
            return -1
        if not after[1]:
            return 0
        if after not in self.numbers:
            self.numbers[after] = len(self.states)
            self.states.append(after)
        return self.numbers[after]

    def groups(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """Where groups end, as numbers of tokens of A and B before; None if the two don't cover the same bytes."""
        if len(self.steps) > CACHED_STEPS:
            self._forget()
        steps, states, ends = self.steps, self.states, []
        i = j = state = 0
        while True:
            if not state and i == len(a) and j == len(b):
                return ends
            # B reads where A leads; from the empty state A goes first
            b_reads = states[state][0]
            if b_reads:
                if j == len(b):
                    return None
                token, j = b[j], j + 1
            else:
                if i == len(a):
                    return None
                token, i = a[i], i + 1
            key = token << 32 | state
            after = steps.get(key)
            if after is None:
                after = steps[key] = self._step(state, token) if state else self._start(token)
            if after < 0:
                return None
            state = after
            if not state:
                ends.append((i, j))

    def _steps(self, keys: np.ndarray) -> np.ndarray:
        """What ``after`` says of steps."""
        place = (keys.view(np.uint64) * MIX >> np.uint64(64 - STEP_BITS)).view(np.int64)
        after = self.after[place]
        other = np.flatnonzero(self.placed[place] != keys)
        if len(other):
            distinct, which = np.unique(keys[other], return_inverse=True)
            found = np.empty(len(distinct), np.int64)
            for n, key in enumerate(distinct.tolist()):
                to = self.steps.get(key)
                if to is None:
                    state, token = key & (1 << 32) - 1, key >> 32
                    to = self.steps[key] = self._step(state, token) if state else self._start(token)
                found[n] = to if to < 0 else to << 1 | self.states[to][0]
            after[other] = found[which]
            # of steps with one place, both columns keep the same one
            place = place[other]
            self.placed[place] = np.arange(len(other))
            last = self.placed[place]
            self.placed[place], self.after[place] = keys[other][last], after[other][last]
        return after

    def many(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``groups`` of chunks with ``n_a`` and ``n_b`` tokens, which go forward side by side: (whether a chunk's sides agree, the chunk of each group, where it ends)."""
        if len(self.steps) > CACHED_STEPS:
            self._forget()
        end_a, end_b = np.cumsum(n_a), np.cumsum(n_b)
        good, chunk = np.ones(len(n_a), bool), np.arange(len(n_a))
        i, j, to = end_a - n_a, end_b - n_b, np.zeros(len(n_a), np.int64)
        ends: list[tuple[np.ndarray, ...]] = []
        while len(chunk) > FEW_CHUNKS:
            b_reads = (to & 1).astype(bool)
            at_end_a, at_end_b = i == end_a[chunk], j == end_b[chunk]
            stuck = np.where(b_reads, at_end_b, at_end_a)
            if stuck.any():
                good[chunk[stuck & ~((to == 0) & at_end_b)]] = False
                chunk, i, j, to, b_reads = (x[~stuck] for x in (chunk, i, j, to, b_reads))
                if not len(chunk):
                    break
            tokens = np.empty(len(chunk), np.int64)
            tokens[b_reads], tokens[~b_reads] = b[j[b_reads]], a[i[~b_reads]]
            i, j = i + ~b_reads, j + b_reads
            to = self._steps(tokens << 32 | to >> 1)
            if (to < 0).any():
                good[chunk[to < 0]] = False
                chunk, i, j, to = (x[to >= 0] for x in (chunk, i, j, to))
            done = to == 0
            ends.append((chunk[done], i[done], j[done]))
        # the few that are left, mostly long ones, from their beginning
        going = good.copy()
        going[chunk] = False
        of, i, j = (np.concatenate(x) for x in zip(*ends)) if ends else (np.zeros(0, np.int64),) * 3
        ends = [(of[kept := going[of]], i[kept], j[kept])]
        for c in chunk.tolist():
            first_a, first_b = end_a[c] - n_a[c], end_b[c] - n_b[c]
            found = self.groups(a[first_a : end_a[c]].tolist(), b[first_b : end_b[c]].tolist())
            good[c] = found is not None
            x = np.array(found or [], np.int64).reshape(-1, 2)
            ends.append((np.full(len(x), c), first_a + x[:, 0], first_b + x[:, 1]))
        of, i, j = (np.concatenate(x) for x in zip(*ends))
        # each group has a token of A, and chunks lie in order
        order = np.argsort(i)
        return good, of[order], i[order], j[order]

    def _start(self, token: int) -> int:
        """From the empty state by a token of A, which then leads."""
        said = (True, self.bytes[0][token])
        if said not in self.numbers:
            self.numbers[said] = len(self.states)
            self.states.append(said)
        return self.numbers[said]


def byte_tokens(vocabulary: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary; of special tokens, which are never met, none."""
    with open(vocabulary_path(vocabulary), encoding="utf-8") as file:
        rule = json.load(file)
    special, byte = {t["content"] for t in rule["added_tokens"]}, byte_of_character()
    out = [b""] * (max(rule["model"]["vocab"].values()) + 1)
    for token, i in rule["model"]["vocab"].items():
        if token not in special:
            out[i] = bytes(byte[c] for c in token)
    return out


class Texts:
    """Texts one after another, each with a sign at its end that isn't shown."""

    def __init__(self) -> None:
        self.data, self.ends = Grown("u1"), Grown("i8")
        self.ends.add(np.zeros(1, np.int64))

    def __len__(self) -> int:
        return self.ends.n - 1

    def __getitem__(self, i: int) -> str:
        begin, end = self.ends.data[i : i + 2].tolist()
        return self.data.data[begin : max(begin, end - 1)].tobytes().decode()

    def add(self, data: np.ndarray, sizes: np.ndarray) -> None:
        self.ends.add(self.data.n + np.cumsum(sizes))
        self.data.add(data)

    def taken(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of these texts one after another, where they begin and the last ends)."""
        own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.ends.data), pa.py_buffer(self.data.data)])
        found = own.take(pa.array(numbers))
        return said_of(found)


def said_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of large texts, where they begin and the last ends)."""
    _, ends, data = texts.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(ends, np.int64, len(texts) + 1, 8 * texts.offset)


class Aligner:
    """Encodes and aligns chunks; each distinct one once, until it is forgotten. The commonest are kept."""

    def __init__(self, vocabulary: str, model: str):
        import sentencepiece

        self.a = ByteEncoder(vocabulary, plain_special=True, cached=CACHED_UNITS)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model))
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        if any(PIECE_SPACE in name.lstrip(PIECE_SPACE) for name in names):
            raise ValueError("the model has pieces over several words, and chunks wouldn't hold")
        said = [bytes([int(n[3:-1], 16)]) if self.pieces.is_byte(i) else b"" if self.pieces.is_control(i) else n.replace(PIECE_SPACE, " ").encode() for i, n in enumerate(names)]
        self.transducer = Transducer(byte_tokens(vocabulary), said)
        #: Each id with what can follow it: another of its side, the other side, or the next group.
        self.decimal = pa.array([f"{i}{sign}" for i in range(max(map(len, self.transducer.bytes))) for sign in ",|;"], pa.large_string())
        self.forget()

    def forget(self) -> None:
        #: Chunks that are kept, and the number of each.
        self.words, self.numbers = pa.array([], pa.large_string()), Grown("i8")
        self.bytes = 0
        #: By chunk: how often it was met, its numbers of tokens and groups (-1 if the sides differ), its groups as text, and where its pairs lie.
        self.met, self.n_a, self.n_b, self.n_groups = Grown("i8"), Grown("i8"), Grown("i8"), Grown("i8")
        self.starts, self.pairs, self.text = Grown("i8"), Grown("i8"), Texts()

    def trim(self) -> None:
        """To be called between blocks: half as much as can be kept stays, of the chunks that were met most often."""
        self.a.trim()
        if len(self.text) <= CACHED_CHUNKS and self.bytes <= CACHED_BYTES:
            return
        numbers, sizes = self.numbers.data, pc.binary_length(self.words).to_numpy(zero_copy_only=False)
        order = np.argsort(-self.met.data[numbers], kind="stable")[: CACHED_CHUNKS // 2]
        order = np.sort(order[np.cumsum(sizes[order]) <= CACHED_BYTES // 2])
        words, kept, old = self.words.take(pa.array(order)), numbers[order], self.__dict__.copy()
        self.forget()
        self._add(old["n_a"].data[kept], old["n_b"].data[kept], n := old["n_groups"].data[kept], runs(old["pairs"].data, old["starts"].data[kept], np.maximum(n, 0)), *_cut(old["text"].taken(kept)))
        self.met.data[:] = old["met"].data[kept] // 2
        self._keep(words, np.arange(len(kept)))
        self.bytes = int(sizes[order].sum())

    def _keep(self, words: pa.Array, numbers: np.ndarray) -> None:
        self.words = pa.concat_arrays([self.words, words])
        self.numbers.add(numbers)

    def _add(self, n_a: np.ndarray, n_b: np.ndarray, n_groups: np.ndarray, pairs: np.ndarray, text: np.ndarray, sizes: np.ndarray) -> None:
        each = np.maximum(n_groups, 0)
        self.starts.add(self.pairs.n + np.cumsum(each) - each)
        self.pairs.add(pairs)
        for column, values in ((self.met, np.zeros(len(n_a), np.int64)), (self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups)):
            column.add(values)
        self.text.add(text, sizes)

    def chunks(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of chunks: the pieces with a space before each."""
        distinct = distinct.cast(pa.large_string())
        known = pc.index_in(distinct, value_set=self.words)
        out = np.empty(len(distinct), np.int64)
        new = pc.is_null(known).to_numpy(zero_copy_only=False)
        out[~new] = self.numbers.data[known.drop_null().to_numpy()]
        new = np.flatnonzero(new)
        for part in (new[i : i + NEW_AT_ONCE] for i in range(0, len(new), NEW_AT_ONCE)):
            words = distinct.take(pa.array(part))
            out[part] = np.arange(len(self.text), len(self.text) + len(part))
            self._align(words)
            short = np.flatnonzero(pc.utf8_length(words).to_numpy(zero_copy_only=False) <= LONG_CHUNK)
            self._keep(words.take(pa.array(short)), out[part[short]])
            self.bytes += int(pc.sum(pc.binary_length(words)).as_py())
        return out

    def _align(self, words: pa.Array) -> None:
        a, sizes = self.a.ids_of(self.a.units(words).ravel())
        n_a = sizes.reshape(-1, 2).sum(axis=1)
        found = self.pieces.encode(words.to_pylist(), num_threads=1)
        n_b = np.fromiter(map(len, found), np.int64, len(found))
        a, b = a.astype(np.int64), np.fromiter(chain.from_iterable(found), np.int64, int(n_b.sum()))
        good, chunk, end_a, end_b = self.transducer.many(a, n_a, b, n_b)
        n_groups = np.bincount(chunk, minlength=len(words))
        # the tokens of a group, A's and then B's, with the sign after each
        pairs = a[end_a - 1] << HALF | b[end_b - 1]
        to_a, to_b = (end - np.cumsum(np.where(good, 0, n))[chunk] for end, n in ((end_a, n_a), (end_b, n_b)))
        in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], np.where(good, n_a, 0), np.where(good, n_b, 0)
        codes = np.empty(len(a) + len(b), np.int64)
        a *= 3
        b *= 3
        a[to_a - 1] += 1
        b[to_b - 1] += 2
        codes[np.arange(len(a)) + np.repeat(to_b - in_b, in_a)] = a
        codes[np.arange(len(b)) + np.repeat(to_a, in_b)] = b
        said, begins = said_of(self.decimal.take(pa.array(codes)))
        text, sizes = _cut((said, begins[np.r_[0, np.cumsum(n_a + n_b)]]))
        self._add(n_a, n_b, np.where(good, n_groups, -1), pairs, text, sizes)


def _cut(said: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of texts, their sizes) of the bytes and where texts begin and the last ends."""
    data, begins = said
    return data[begins[0] : begins[-1]], np.diff(begins)


@cache
def _aligner(vocabulary: str, model: str) -> Aligner:
    """One for each Python worker, kept from task to task."""
    return Aligner(vocabulary, model)


def _aligned(aligner: Aligner, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chunk numbers of all texts, how many each text has, whether the sides agree on it); a text on which they don't has no chunk."""
    n, pieces = pieces_of(texts)
    coded = pieces.dictionary_encode()
    numbers = aligner.chunks(coded.dictionary)[coded.indices.to_numpy()]
    owner = np.repeat(np.arange(len(n)), n)
    good = pc.binary_length(pc.fill_null(flat(texts), "")).to_numpy(zero_copy_only=False) > 0
    good[owner[aligner.n_groups.data[numbers] < 0]] = False
    aligner.met.data[:] += np.bincount(numbers, minlength=aligner.met.n)
    return numbers[good[owner]], np.where(good, n, 0), good


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``values`` in runs of ``sizes``, which may be 0."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def align_blocks(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, model: str = PIECE_MODEL) -> DataFrame:
    """Rows of two kinds, told apart by ``is_pair``.

    Documents: block, doc_id, STATS and links, each a place in the block's list of pairs. Pairs: block, place, pair (the ids of
    A and B, in the halves of a long) and n, its links in the block.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary, model)
        for k, table in enumerate(gathered(batches, 1, BLOCK_BYTES)):
            aligner.trim()
            block = TaskContext.get().partitionId() << HALF | k
            numbers, sizes, good = _aligned(aligner, flat(table.column(1)))
            groups = aligner.n_groups.data[numbers]
            # pairs of a chunk are counted once, as often as the chunk is there
            times = np.bincount(numbers, minlength=len(aligner.text))
            here = np.flatnonzero(times)
            sizes_here = aligner.n_groups.data[here]
            starts = np.zeros(len(times), np.int64)
            starts[here] = np.cumsum(sizes_here) - sizes_here
            distinct, which = np.unique(runs(aligner.pairs.data, aligner.starts.data[here], sizes_here), return_inverse=True)
            counts = np.bincount(which, np.repeat(times[here], sizes_here), len(distinct)).astype(np.int64)
            # the commonest pairs have the smallest places
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            n_groups = _sums(groups, sizes)
            (said, begins), ends = aligner.text.taken(numbers), np.cumsum(sizes)
            parts = zip(begins[ends - sizes].tolist(), begins[ends].tolist(), good.tolist())
            sha = [hashlib.sha256(said[i : j - 1]).hexdigest() if ok else "" for i, j, ok in parts]
            rest = {
                "is_pair": pa.array(np.zeros(len(sha), bool)), "block": pa.array(np.full(len(sha), block)), "doc_id": flat(table.column(0)),
                "n_a": pa.array(_sums(aligner.n_a.data[numbers], sizes)), "n_b": pa.array(_sums(aligner.n_b.data[numbers], sizes)), "n_groups": pa.array(n_groups),
                "groups_sha256": pa.array(sha, pa.string()), "links": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_groups)].astype(np.int32)), pa.array(runs(place[which], starts[numbers], groups))),
            }
            yield _batch(rest, _ARROW)
            m = len(order)
            yield _batch({"is_pair": pa.array(np.ones(m, bool)), "block": pa.array(np.full(m, block)), "place": pa.array(np.arange(m, dtype=np.int32)), "pair": pa.array(distinct[order]), "n": pa.array(counts[order])}, _ARROW)

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, f"is_pair boolean, {BLOCK}")


_ARROW = pa.schema([
    ("is_pair", pa.bool_()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()),
    ("links", pa.list_(pa.int32())), ("place", pa.int32()), ("pair", pa.int64()), ("n", pa.int64()),
])


def _batch(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch with nulls in the columns that aren't given."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, count, is_best) of pairs (pair, n): links in the whole corpus, and whether no pair with the same B id has more."""
    counts = pairs.groupBy("pair").agg(F.sum("n").alias("count"))
    b = F.col("pair").bitwiseAND(F.lit((1 << HALF) - 1)).alias("b")
    # at most as many rows for a B id as the other vocabulary has tokens
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.join(most, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def align_tokens(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, model: str = PIECE_MODEL, path: str | None = None) -> DataFrame:
    """(doc_id, STATS, n_links, n_best, count_sum) of each row of ``docs`` (doc_id, text).

    A reads a space and the text, B the text, to which it adds a space; special tokens' strings are plain text. Groups are cut
    where tokens of both end; a link is a token of A and one of B that end there together. A pair of ids counts the links of
    the whole corpus that hold it. Texts that are null or empty, or of which a side's bytes aren't a space and the text (as
    with the piece model's own sign for a space), have no tokens: zeros and an empty groups_sha256. Texts count whole, however
    long. Equal rows are rows of their own and count as often; a null doc_id is carried along; other columns are ignored; an
    empty table gives no rows. What is found of a block is written to ``path``, a new folder that all executors share, once.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark, "alignment")
    blocks = align_blocks(docs, vocabulary, model)
    blocks.write.option("compression", "zstd").partitionBy("is_pair").parquet(path)
    # two readers: a cogroup can't tell columns of one apart
    pairs, found = (spark.read.schema(f"{BLOCK}, is_pair boolean").parquet(path).where(F.col("is_pair") == kind).drop("is_pair") for kind in (True, False))
    pairs, found = pairs.select("block", "place", "pair", "n"), found.select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links")
    known = pairs.join(pair_counts(pairs), "pair").select("block", "place", "count", "is_best")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        # a block's list of pairs comes in any order
        counts, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right.column("place").to_numpy()
        counts[place], best[place] = right.column("count").to_numpy(), right.column("is_best").to_numpy(zero_copy_only=False)
        links = flat(left.column("links"))
        at, sizes = links.flatten().to_numpy(), pc.list_value_length(links).to_numpy(zero_copy_only=False).astype(np.int64)
        kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
        return kept.append_column("n_links", pa.array(sizes)).append_column("n_best", pa.array(_sums(best[at], sizes))).append_column("count_sum", pa.array(_sums(counts[at], sizes)))

    schema = f"doc_id long, {STATS}, n_links long, n_best long, count_sum long"
    return found.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(score, schema)


def alignment_groups(docs: DataFrame, vocabulary: str = BYTE_VOCABULARY, model: str = PIECE_MODEL) -> DataFrame:
    """(doc_id, group, start, end, a, b): each group's bytes in a space and the text, from 0, and its ids of both sides; the rules of align_tokens hold."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary, model)
        said = aligner.transducer.bytes[0]
        for table in gathered(batches, 1, BLOCK_BYTES):
            aligner.trim()
            numbers, sizes, _ = _aligned(aligner, flat(table.column(1)))
            at = 0
            for doc_id, size in zip(table.column(0).to_pylist(), sizes.tolist()):
                out, place = [], 0
                for number in numbers[at : at + size].tolist():
                    for group in aligner.text[number].split(";"):
                        a, b = ([int(i) for i in side.split(",")] for side in group.split("|"))
                        end = place + sum(len(said[i]) for i in a)
                        out.append({"doc_id": doc_id, "group": len(out), "start": place, "end": end, "a": a, "b": b})
                        place = end
                at += size
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema([*((c, pa.int64()) for c in ("doc_id", "group", "start", "end")), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, group long, start long, end long, a array<int>, b array<int>")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir))
