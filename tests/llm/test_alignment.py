"""Alignment against whole-text encodings and plain byte offsets."""

from __future__ import annotations

import hashlib
import os
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import alignment
from sparkloom.llm.packing import vocabulary_path

ROWS = [
    (1, "Hello  world, it's <|endoftext|> <s> <0x41> 12.\n\n naïve café 中文 x"), (2, None), (3, ""), (4, " "), (5, "a▁b"), (6, "the cat the cat"), (6, "the cat the cat"), (None, "the cat"),
    (7, " leading, trailing  "), (8, "long words " * 5_000 + "z" * 3_000), (9, "tab\tand\x1cseparator　wide"), (10, "ﬁ ① ­ soft \x00 nul"),
]


class Plain:
    """Groups by byte offsets at which tokens of both sides end, from whole texts."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary_path(alignment.BYTE_VOCABULARY))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(alignment.PIECE_MODEL))
        self.said = alignment.byte_tokens(alignment.BYTE_VOCABULARY)

    def byte(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def groups(self, text):
        """[(A ids, B ids)], or None if the text has no tokens."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        said_a, said_b = [self.said[i] for i in a], [self.byte(i) for i in b]
        if b"".join(said_a) != (" " + text).encode() or b"".join(said_b) != (" " + text).encode():
            return None
        ends = lambda said: [sum(map(len, said[: i + 1])) for i in range(len(said))] if len(said) < 500 else _running(said)
        ends_a, ends_b = ends(said_a), ends(said_b)
        out, i, j = [], 0, 0
        for end in sorted({*ends_a} & {*ends_b}):
            m, n = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            out.append((a[i:m], b[j:n]))
            i, j = m, n
        return out


def _running(said):
    out, at = [], 0
    for s in said:
        at += len(s)
        out.append(at)
    return out


def brute_force(rows):
    plain = Plain()
    found = [(doc_id, plain.groups(text)) for doc_id, text in rows]
    counts = Counter((a[-1], b[-1]) for _, groups in found for a, b in groups or [])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, groups in found:
        if groups is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def sorted_rows(rows):
    return sorted(rows, key=repr)


def test_against_brute_force(spark):
    got = alignment.align_tokens(spark.createDataFrame(ROWS, "doc_id long, text string")).select(*COLUMNS).collect()
    wanted = brute_force(ROWS)
    assert sorted_rows(map(tuple, got)) == sorted_rows(wanted)
    assert {r[0] for r in wanted if r[1] == 0} == {2, 3, 5}


def test_groups_cover_the_text(spark):
    got = alignment.alignment_groups(spark.createDataFrame(ROWS, "doc_id long, text string")).where("doc_id in (1, 7)").orderBy("doc_id", "group").collect()
    plain = Plain()
    for doc_id, text in ROWS:
        if doc_id in (1, 7):
            mine = [r for r in got if r["doc_id"] == doc_id]
            assert [(r["a"], r["b"]) for r in mine] == plain.groups(text)
            assert [r["start"] for r in mine] == [0, *[r["end"] for r in mine[:-1]]] and mine[-1]["end"] == len(text.encode()) + 1


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, block int, links string, `place.x` int, pair long"
    assert alignment.align_tokens(spark.createDataFrame([], schema)).count() == 0
    got = alignment.align_tokens(spark.createDataFrame([(1, "the cat", 3, "x", 4, 5)], schema)).collect()
    assert [(r["n_a"], r["n_b"], r["n_links"], r["count_sum"]) for r in got] == [(2, 2, 2, 2)]


def test_counts_are_of_all_blocks(spark):
    """Pairs of many blocks are added up, whatever blocks hold."""
    rows = [(i, "the cat sat on the mat" if i % 3 else "a dog, the cat") for i in range(40)]
    got = alignment.align_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).select(*COLUMNS).collect()
    assert sorted_rows(map(tuple, got)) == sorted_rows(brute_force(rows))


@settings(max_examples=30, deadline=None)
@given(st.text(st.sampled_from("ab é×Z9'.,-\n\t  \x1c\x85中s<|>▁ﬁ"), max_size=25))
def test_chunks_hold_in_any_text(text):
    mine = test_chunks_hold_in_any_text.__dict__
    aligner, plain = mine.setdefault("aligner", alignment.Aligner(alignment.BYTE_VOCABULARY, alignment.PIECE_MODEL)), mine.setdefault("plain", Plain())
    numbers, _, good = alignment._aligned(aligner, pa.array([text]))
    wanted = plain.groups(text)
    assert good[0] == (wanted is not None)
    if wanted is not None:
        assert ";".join(aligner.text[i] for i in numbers) == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in wanted)


def test_transducer_keeps_steps():
    t = alignment.Transducer([b"ab", b"c", b"abc"], [b"a", b"bc", b"abc", b"x"])
    assert t.groups([0, 1], [0, 1]) == [(2, 2)] and t.groups([2, 2], [2, 0, 1]) == [(1, 1), (2, 3)]
    known = len(t.steps)
    assert t.groups([2, 2], [2, 0, 1]) == [(1, 1), (2, 3)] and len(t.steps) == known
    assert t.groups([0], [3]) is None and t.groups([0], [0]) is None and t.groups([], []) == []


def test_whole_table(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted_rows(map(tuple, alignment.op13_alignment(spark, data).select(*COLUMNS).collect())) == sorted_rows(brute_force(rows))
