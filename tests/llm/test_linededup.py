"""The order of entries and the search for candidates within a bucket of line deduplication."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import linededup
from sparkloom.llm.linededup import NO_DOC, Bucket, _by_size, _line_rank, _nearest, _packed, _repeats


def bucket(n_lines: int, n_keys: int = 1, n_rows: int = 1, seed: int = 1) -> Bucket:
    """Lines of 10 to 13 tokens without parities, some of them twice, dealt to the keys in turn."""
    rng = np.random.default_rng(seed)
    x = np.r_[rng.permutation(n_lines), rng.integers(0, n_lines, n_lines // 4)]
    none = np.zeros(len(x), np.int64)
    part = _packed(0, x % n_keys, (x // 2).astype(np.uint64), rng.permutation(len(x)), none + rng.integers(0, n_rows, len(x)), x, 10 + x // 2 % 4, none, none, none)
    return Bucket(pa.table({k: [part[k]] for k in ("bucket", "key", "id", "rest")}))


def test_few_lines_take_many_steps_at_once(monkeypatch):
    calls = []
    tried = Bucket.possible
    monkeypatch.setattr(Bucket, "possible", lambda self, a, b: calls.append(len(a)) or tried(self, a, b))
    x = bucket(600)
    a, b, _ = x.candidates(None, 10_000)
    # 300 sets of one key, of which each is a candidate of each later one whose size fits
    assert len(x.keys) == 300 and len(calls) <= 60
    fits = [(i, j) for i in range(300) for j in range(300) if x.rank[i] < x.rank[j] and 5 * min(x.n[i], x.n[j]) >= 4 * max(x.n[i], x.n[j]) and 9 * min(x.n[i], x.n[j]) >= 4 * (x.n[i] + x.n[j])]
    assert set(zip(a.tolist(), b.tolist())) == set(fits) and len(a) == len(fits)


@pytest.mark.parametrize("n_rows", [1, 3])
def test_a_bucket_has_the_first_line_of_each_set_by_key_and_size(n_rows):
    x = bucket(200, 7, n_rows)
    lines = list(zip(x.keys.tolist(), x.n.tolist(), x.docs.tolist(), x.rows.tolist(), x.places.tolist()))
    assert lines == sorted(lines)
    assert len(set(zip(x.keys.tolist(), x.ids.tolist()))) == len(lines)


@pytest.mark.parametrize("crowd, heads", [(None, 0), (20, 3), (20, 40)])
def test_steps_at_once_find_the_same_candidates(monkeypatch, crowd, heads):
    x = bucket(400, 3)
    found = [c.tolist() for c in x.candidates(None, 5, crowd, heads)]
    monkeypatch.setattr(linededup, "STEPS_AT_ONCE", 1)
    assert [c.tolist() for c in x.candidates(None, 5, crowd, heads)] == found


def test_orders_hold_where_numbers_do_not_fit_one_word():
    rng = np.random.default_rng(2)
    keys, n, rank = rng.integers(0, 9, 500).astype(np.uint32), rng.integers(1, 6, 500), rng.permutation(500).astype(np.uint64)
    for wide in (rank, rank << np.uint64(50)):
        assert _by_size(keys, n, wide).tolist() == np.lexsort((wide, n, keys)).tolist()
    docs, places, rows = rng.integers(-5, 5, 500), rng.permutation(500).astype(np.int32), np.zeros(500, np.int64)
    for far in (docs, np.where(docs < 0, NO_DOC, docs), np.where(docs < 0, NO_DOC, np.iinfo(np.int64).max)):
        assert np.argsort(_line_rank(far, rows, places)).tolist() == np.lexsort((places, rows, far)).tolist()
    ids = rng.integers(0, 20, 500).astype(np.uint64)
    first = {}
    for i in np.argsort(rank).tolist():
        first.setdefault((keys[i], ids[i]), i)
    assert np.flatnonzero(~_repeats(keys, ids, rank)).tolist() == sorted(first.values())


def test_nearest_by_distance_and_then_by_number():
    a, b, d = np.array([5, 4, 3, 2, 9]), np.array([7, 7, 7, 7, 8]), np.array([2, 1, 1, 128, 0])
    assert [x.tolist() for x in _nearest(a, b, d, 2)] == [[3, 4, 9], [7, 7, 8], [1, 1, 0], [True, True, False]]
    assert [len(x) for x in _nearest(*(np.zeros(0, np.int64),) * 3, 2)] == [0] * 4
