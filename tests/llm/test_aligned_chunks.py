"""Chunks that are aligned side by side, and those that a worker keeps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sparkloom.llm import alignment

A = [b"", b"a", b"b", b"ab", b"ba", b"aab", b"c"]
B = [b"a", b"b", b"abb", b"bab", b"aa", b"x"]


def spelled(text: bytes, tokens: list[bytes], rng: np.random.Generator) -> list[int]:
    out = []
    while text:
        token = int(rng.choice([i for i, t in enumerate(tokens) if t and text.startswith(t)]))
        out.append(token)
        text = text[len(tokens[token]) :]
    return out


def test_chunks_side_by_side_are_aligned_as_one_by_one(monkeypatch):
    monkeypatch.setattr(alignment, "STEP_BITS", 4)
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"ab"), rng.integers(0, 60 if i % 50 else 900)).tolist()) for i in range(300)]
    a, b = ([spelled(t, tokens, rng) for t in texts] for tokens in (A, B))
    # sides that differ, or of which one ends before the other
    for i in range(0, 300, 7):
        (a if i % 2 else b)[i] = [[5, 1], [5], [], a[i][:-1] if i % 2 else b[i][:-1]][i % 4]
    flat = lambda lists: (np.array([x for ids in lists for x in ids], np.int64), np.array([len(ids) for ids in lists]))
    for _ in range(2):
        t = alignment.Transducer(A, B)
        good, chunk, end_a, end_b = t.many(*flat(a), *flat(b))
        begin_a, begin_b = (np.r_[0, np.cumsum(n)] for n in (flat(a)[1], flat(b)[1]))
        for i in range(300):
            mine = chunk == i
            got = list(zip((end_a[mine] - begin_a[i]).tolist(), (end_b[mine] - begin_b[i]).tolist())) if good[i] else None
            assert got == t.groups(a[i], b[i])
        assert 0 < (~good).sum() < 60 and (np.diff(end_a) > 0).all()


def test_the_commonest_chunks_are_kept(monkeypatch):
    aligner = alignment.Aligner(alignment.BYTE_VOCABULARY, alignment.PIECE_MODEL)
    monkeypatch.setattr(alignment, "CACHED_CHUNKS", 8)
    rare = [f"rare{i}" for i in range(9)]
    alignment._aligned(aligner, pa.array(["the cat, the ca▁t the cat,", *rare, "l" * 100]))
    before = {w: aligner.text[n] for w, n in zip(aligner.words.to_pylist(), aligner.numbers.data.tolist())}
    aligner.trim()
    kept = aligner.words.to_pylist()
    assert len(kept) == len(aligner.text) == 4 and {"the", "cat,"} <= set(kept)
    assert all(aligner.text[n] == before[w] for w, n in zip(kept, aligner.numbers.data.tolist()))
    numbers, sizes, good = alignment._aligned(aligner, pa.array(["the cat, the", None, "", "the ca▁t"]))
    assert sizes.tolist() == [3, 0, 0, 0] and good.tolist() == [True, False, False, False]
    # encoded again are only those that had gone: at most the empty one and the one whose sides differ
    assert len(aligner.text) <= 6 and ";".join(aligner.text[n] for n in numbers) == f"{before['the']};{before['cat,']};{before['the']}"
    aligner.trim()
    aligner.forget()
    assert alignment._aligned(aligner, pa.array([], pa.string()))[0].tolist() == []
