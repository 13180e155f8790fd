"""The operators against brute force on small tables, with nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import collections
import json
import math
import random
import re
import zlib

import numpy as np
import duckdb
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import licences, linededup, lmscore, mixing, nearcopies, packing, ppm, quality, rules, simhash, tokencount, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size long, row string, rank int, part int, gone string, n int, held boolean, m string, w string, id long"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def make(spark, rows):
    """A table of (doc_id, text, source) with columns whose names the operators use themselves."""
    full = [(i, t, "en", s, len(t) if t is not None else None, 7, 7, "x", 7, 7, "x", 7, True, "x", "x", 7) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def texts():
    rng = random.Random(3)
    vocabulary = ["the", "of", "and", "Übung", "straße", "naïve", "data", "x1", "don't", "a.b", "..", "THE", "end."] + [f"w{i}" for i in range(60)]
    make_line = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    base = "\n".join(make_line(14) for _ in range(6))
    rows = [(i, "\n".join(make_line(rng.randint(1, 16)) for _ in range(rng.randint(1, 6))), f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, base.replace("w1", f"z{i}", 1), "s1") for i in range(5)] + [(110, base, "s1"), (111, base, "s0")]
    rows += [(200, None, "s0"), (201, "", None), (202, " \t\n\x0b\x0c\r ", "s2"), (203, "one", None), (204, "one two", "s2"), (None, "null id text\nwith lines", "s3"), (205, base, "s2"), (205, base, "s2")]
    rows += [(300, " ".join(make_line(50) for _ in range(400)), "s9"), (301, "y" * 30_000, "s9"), (302, "|\n|\n" * 300, "s9")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, texts()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def key(doc_id):
    return -1 if doc_id is None or doc_id != doc_id else int(doc_id)


# ---- 1


def brute_fingerprint(text, k=3):
    w = words(text)
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("crowded", [256, 1])
def test_simhash(spark, docs, empty, crowded):
    rows = docs.select("doc_id", "text").collect()
    got = simhash.near_duplicate_components(docs, crowded=crowded).collect()
    assert len(got) == len(rows)
    prints = {r["text"]: brute_fingerprint(r["text"]) for r in rows}
    distinct = sorted(set(prints.values()))
    linked = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2]
    root = components(distinct, linked)
    least = collections.defaultdict(lambda: math.inf)
    for r in rows:
        if r["doc_id"] is not None:
            g = root[prints[r["text"]]]
            least[g] = min(least[g], r["doc_id"])
    expected = collections.Counter((r["doc_id"], prints[r["text"]], least[root[prints[r["text"]]]]) for r in rows)
    assert collections.Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"] if r["component_id"] is not None else math.inf) for r in got) == expected
    assert simhash.near_duplicate_components(empty).count() == 0


def test_grid_finds_all_links(spark):
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(6):
            fps.add(f ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    distinct = sorted(fps)
    expected = components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2])
    frame = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in distinct], "fp long")
    for crowded in (256, 3):
        links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.fingerprint_links(frame, crowded).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        assert components(distinct, links) == expected


def test_near_copies(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for w in (words(r["text"]) for r in rows):
        sets.append(frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    similar = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    root = components(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if similar(sets[i], sets[j])])
    for crowded in (48, 1):
        got = collections.defaultdict(set)
        for r in nearcopies.near_copy_groups(docs, crowded=crowded).collect():
            got[r["component_id"]].add(r["doc_id"])
        expected = collections.defaultdict(set)
        for i, r in enumerate(rows):
            expected[root[i]].add(r["doc_id"])
        assert sorted(map(lambda s: sorted(map(key, s)), got.values())) == sorted(map(lambda s: sorted(map(key, s)), expected.values()))
    kept = nearcopies.drop_near_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {min(g, key=lambda x: math.inf if x is None else x) for g in expected.values()}
    assert kept.count() == len(expected)
    assert nearcopies.drop_near_copies(empty).count() == 0


@pytest.mark.parametrize("crowded", [48, 1])
def test_one_row_of_each_group_of_near_copies_stays(spark, crowded):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a, "s1"), (None, a + " more", "s1"), (5, a, "s2"), (5, a, "s2"), (5, c, "s2"), (None, b, "s1"), (None, b, "s1"), (None, b + " x", None), (None, None, "s0"), (None, "", "s0")]
    kept = nearcopies.drop_near_copies(make(spark, rows), crowded=crowded).select("doc_id", "text").collect()
    assert len(kept) == 4
    assert {(r["doc_id"], (r["text"] or "")[:2]) for r in kept} == {(5, "a0"), (5, "c0"), (None, "b0"), (None, "")}
    again = nearcopies.drop_near_copies(make(spark, rows[::-1]), crowded=crowded).select("doc_id", "text").collect()
    assert collections.Counter(map(tuple, again)) == collections.Counter(map(tuple, kept))


# ---- 2


def test_licences(spark, empty):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE."
    half = mit[: mit.index("THE SOFTWARE IS")]
    rows = [(1, mit, None), (2, half, None), (3, "Some text.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0.", None), (4, "no end of line before\nReleased under the MIT License.", None), (5, None, None), (6, "", None), (7, "about a licence", None), (None, "All rights reserved", None), (8, "Released under\nthe MIT   license!", None)]
    got = {key(r["doc_id"]): (r["n_sentences"], r["licences"]) for r in licences.scan_licences(make(spark, rows)).collect()}
    assert got == {1: (3, "MIT"), 2: (1, ""), 3: (4, "CC-BY-NC-4.0,MIT"), 4: (1, "MIT"), 5: (0, ""), 6: (0, ""), 7: (0, ""), -1: (2, "proprietary"), 8: (1, "MIT")}
    assert licences.scan_licences(empty).count() == 0


def test_licence_anchors_hold_across_lines(spark):
    rows = [(1, "This is free and unencumbered software released into the public\ndomain.", "s"), (2, "All rights\nreserved.", "s"), (3, "All  rights - reserved", "s")]
    got = {r["doc_id"]: (r["n_sentences"], r["licences"]) for r in licences.scan_licences(make(spark, rows)).collect()}
    assert got == {1: (1, "Unlicense"), 2: (1, "proprietary"), 3: (2, "proprietary")}


HEADS = {
    "MIT": 'MIT License\n\nCopyright (c) 2020 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n',
    "BSD-2-Clause": "BSD 2-Clause License\n\nCopyright (c) 2020, Jane Doe\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n",
    "BSD-3-Clause": "BSD 3-Clause License\n\nCopyright (c) 2020, Jane Doe\nAll rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n",
    "Apache-2.0": "# Copyright 2020 Jane Doe\n#\n# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software\n# distributed under the License is distributed on an \"AS IS\" BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language governing permissions and\n# limitations under the License.\n",
    "GPL-3.0-only": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n",
    "GPL-3.0-or-later": "Copyright (C) 2020 Jane Doe\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.\n",
    "ISC": "ISC License\n\nCopyright (c) 2020, Jane Doe\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES\nWITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF\nMERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE\n",
    "MPL-2.0": "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n--------------\n",
}


def test_licence_files_and_the_same_rows_as_sql(spark):
    names = sorted(HEADS)
    texts = [HEADS[n] for n in names] + ["All  rights  reserved", "All rights\nreserved.", "This is free and unencumbered software released into the public\ndomain.", None, "", "Copyright 2019 A\nCopyright 2020 B\nAll rights reserved.", "\n \n\n"]
    texts += [HEADS["MIT"] + "\nAll rights reserved.\n", HEADS["BSD-2-Clause"] + "\n\n" + HEADS["BSD-3-Clause"]]
    rows = [(i, text, None) for i, text in enumerate(texts)]
    got = {r["doc_id"]: (r["n_sentences"], r["licences"]) for r in licences.scan_licences(make(spark, rows)).collect()}
    assert [got[i][1] for i in range(len(names))] == names
    assert [got[len(texts) - 2][1], got[len(texts) - 1][1]] == ["MIT", "BSD-2-Clause,BSD-3-Clause"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, text) for i, text, _ in rows])
    assert got == {i: (n, found) for i, n, found in con.execute(licences.ORACLE_LICENCES).fetchall()}
    # repeated and null ids are rows of their own in both
    again = [(1, HEADS["MIT"], None), (1, "All rights reserved", None), (None, HEADS["MPL-2.0"], None), (None, "none", None)]
    con.execute("DELETE FROM documents")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(i, text) for i, text, _ in again])
    both = [sorted(map(repr, map(tuple, x))) for x in (licences.scan_licences(make(spark, again)).collect(), con.execute(licences.ORACLE_LICENCES).fetchall())]
    assert both[0] == both[1] and len(both[0]) == 4


def test_licence_sentences_are_normal_and_anchored():
    for s in licences.SENTENCES:
        assert re.fullmatch(r"[a-z0-9]+( [a-z0-9]+)*", s) and re.search(licences.ANCHORS, s)
    assert all(0 <= i < len(licences.SENTENCES) for _, run in licences.RULES for i in run)


# ---- 3


def test_quality(spark, empty):
    rng = random.Random(2)
    good, bad = [f"g{i}" for i in range(50)], [f"b{i}" for i in range(50)]
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(30)), "s") for i in range(300)] + [(900, None, None), (901, "", None), (None, "g1 g2", None), (1, "g1 g2 g3 g4", None)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(0, None), (None, 1), (7, 1), (5000, 0)], "doc_id long, quality int")
    docs = make(spark, rows)
    got = quality.classify_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in held)
    assert sum(r["predicted"] == r["doc_id"] % 2 for r in held) >= 0.95 * len(held)
    blank = {r["doc_id"]: r["score"] for r in got}
    assert blank[900] == blank[901]
    assert {r["score"] for r in quality.classify_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify_quality(empty, labels).count() == 0


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, f"word{i} common", "s") for i in range(200)]
    labels = [(i, i % 2) for i in range(200)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q) for i, q in labels]
    docs = make(spark, rows)
    scores = [sorted((r["doc_id"], r["score"]) for r in quality.classify_quality(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


# ---- 4


@pytest.mark.parametrize("tuning", [{}, {"crowd": 1, "frequent": 0, "heads": 1}, {"crowd": 2, "frequent": 10, "heads": 1}])
def test_line_dedup(spark, docs, empty, tuning):
    rows = docs.select("doc_id", "text").collect()
    first, seen, gone = {}, [], set()
    for doc, text in sorted({(r["doc_id"], r["text"]) for r in rows if r["text"] is not None}, key=lambda x: (x[0] is not None, x)):
        for place, line in enumerate(text.split("\n")):
            tokens = frozenset(words(line))
            if not tokens:
                continue
            if tokens in first or any(5 * len(tokens & s) >= 4 * len(tokens | s) for s in seen):
                gone.add((doc, place))
            if tokens not in first:
                first[tokens] = (doc, place)
                seen.append(tokens)
    expected = collections.Counter((r["doc_id"], None if r["text"] is None else "\n".join(x for i, x in enumerate(r["text"].split("\n")) if (r["doc_id"], i) not in gone)) for r in rows)
    out = linededup.dedup_lines(docs, **tuning)
    assert out.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in out.collect()) == expected
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in out.collect())
    if not tuning:
        assert linededup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("tuning", [{}, {"crowd": 1, "frequent": 0, "heads": 1}])
def test_line_dedup_loses_no_line_of_repeated_rows_and_null_ids(spark, tuning):
    line = lambda name: " ".join(f"{name}{i}" for i in range(10))
    once, shared, near = line("u"), line("s"), line("s").replace("s9", "z")
    rows = [(7, f"{once}\n{line('v')}", "s")] * 5 + [(None, f"{shared}\n{line('p')}", "s"), (None, f"{shared}\n{line('q')}", "s")]
    rows += [(None, f"{near}\n{line('r')}", "s"), (8, f"{line('t')}\n{once}", "s"), (9, f"{line('x')}\n{line('y')}", "s"), (9, f"{line('t')}\n{line('w')}", "s")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in linededup.dedup_lines(make(spark, rows), **tuning).collect())
    # repeated rows are one document; a null id isn't, and one of its three like lines stays
    assert got[7, rows[0][1]] == 5 and got[8, line("t")] == 1 and got[9, rows[9][1]] == 1 and got[9, line("w")] == 1
    left = [text.split("\n") for doc, text in got.elements() if doc is None]
    assert sorted(x[-1] for x in left) == [line("p"), line("q"), line("r")]
    assert [x[0] for x in left if len(x) == 2] in ([shared], [near])


# ---- 5


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, target = set(), {}
    while True:
        left = max(0.0, share * sum(sizes.values()) - sum(most * sizes[s] for s in full))
        total = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] >= most * sizes[s]}
        if not over:
            return target
        full |= over
        if len(full) == len(names):
            return {s: most * sizes[s] for s in names}


def test_mixing(spark, docs, empty):
    rows = docs.select("doc_id", "text", "source").collect()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += len(words(r["text"]))
    target = brute_targets(dict(sizes), (5, 2, 1), 1.5, 2)
    taken = collections.Counter()
    for r in got:
        assert 0 <= r["copies"] <= 2 and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        taken[r["source"]] += r["copies"] * r["size"]
    # s9 has three documents, which fit no target to the word
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes if s != "s9")
    again = mixing.mix(docs).collect()
    assert collections.Counter((r["doc_id"], r["copies"]) for r in got) == collections.Counter((r["doc_id"], r["copies"]) for r in again)
    assert mixing.mix(empty).count() == 0
    whole = mixing.take_mix(docs)
    assert whole.columns == docs.columns and whole.where("doc_id = 300").count() == max(r["copies"] for r in got if r["doc_id"] == 300)


def test_the_mix_takes_rows_that_share_an_id_one_by_one(spark, empty):
    rows = [(1, "a b c", "s0"), (1, "d e f", "s0"), (1, "g h", "s1"), (1, "g h", "s1"), (None, "i j k", "s0"), (None, "l m n", "s0"), (None, None, None), (2, "o p q r", None)]
    rows += [(None, f"w{i} x", "s1") for i in range(20)]
    docs = make(spark, rows)
    taken, sizes = collections.Counter(), collections.Counter()
    for r in mixing.take_mix(docs).collect():
        taken[r["source"]] += len(words(r["text"]))
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = brute_targets(dict(sizes), (5, 2, 1), 1.5, 2)
    longest = {s: max(len(words(t)) for _, t, x in rows if x == s) for s in sizes}
    assert all(target[s] - longest[s] < taken[s] <= target[s] + 1 for s in sizes)
    n = collections.Counter(t for _, t, _ in rows)
    assert all(k <= 2 * n[t] for t, k in collections.Counter(r["text"] for r in mixing.take_mix(docs).collect()).items())
    assert mixing.take_mix(empty).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 6), min_size=1, max_size=8), st.integers(0, 400))
def test_fit_is_the_best_subset(counts, budget):
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    taken = mixing.fit(lengths, n, budget)
    assert (taken >= 0).all() and (taken <= n).all() and int(lengths @ taken) <= max(budget, 0) or budget >= int(lengths @ n)
    floor = [int(c) * min(budget, int(lengths @ n)) // int(lengths @ n) for c in n]
    reach = {0}
    for length, c, f in zip(lengths.tolist(), n.tolist(), floor):
        reach = {r + k * length for r in reach for k in range(f, c + 1)}
    assert int(lengths @ taken) == max(r for r in reach if r <= budget)


def test_sources_in_code_point_order(spark):
    names = ["b", "a", "Z", "ä", "😀", None, "ﬀ"]
    frame = spark.createDataFrame([(s, 1000) for s in names], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    assert got == pytest.approx(brute_targets({s: 1000 for s in names}, (5, 2, 1), 1.5, 2))


# ---- 6


def test_language_model(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    training = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 5 != 1]
    counts = collections.Counter(w for r in training for w in [*words(r["text"]), "\n"])
    total, kinds = sum(counts.values()), len(counts)
    base = lambda t: sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*words(t), "\n"])
    got = lmscore.score_documents(docs).collect()
    expected = collections.Counter((r["doc_id"], len(words(r["text"])) + 1, sum(w in counts for w in [*words(r["text"]), "\n"]), round(base(r["text"]), 5)) for r in rows)
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == expected
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 for r in got)
    assert lmscore.score_documents(empty).count() == 0


def brute_ppm(training, text, order):
    """Log probability of a text, by walking contexts from the longest to the shortest with exclusion."""
    seen = collections.defaultdict(collections.Counter)
    for t in training:
        s = b" " * 8 + t + b"\n"
        for i in range(8, len(s)):
            for k in range(order + 1):
                seen[s[i - k : i]][s[i]] += 1
    s, out = b" " * 8 + text + b"\n", 0.0
    for i in range(8, len(s)):
        excluded, symbol = set(), s[i]
        for k in range(order, -1, -1):
            found = seen.get(s[i - k : i])
            if not found:
                continue
            left = {x: c for x, c in found.items() if x not in excluded}
            total = sum(left.values())
            if symbol in left:
                out += math.log10((left[symbol] - ppm.DISCOUNT) / total)
                break
            if left:
                out += math.log10(ppm.DISCOUNT * len(left) / total)
            excluded |= set(found)
        else:
            out -= math.log10(ppm.SYMBOLS - len(excluded))
    return out


def test_prediction_by_partial_matching():
    training, order = [b"the cat sat on the mat", b"the dog", b"", b"banana bandana"], 4
    found, _ = ppm.windows(training)
    entries = [ppm.count_keys(ppm.entry_keys(found, order))]
    for _ in range(order):
        entries.insert(0, ppm.shorter(*entries[0]))
    model = ppm.Model([(k, c.astype(float)) for k, c in entries], [(k, c.astype(float)) for k, c in (ppm.context_totals(k, c, i) for i, (k, c) in enumerate(entries))])
    for text in (b"the cat", b"", b"bandit", b"zebra \xff", b"the the"):
        windows, sizes = ppm.windows([text])
        assert sizes.tolist() == [len(text) + 1]
        assert float(model.score(windows).sum()) == pytest.approx(brute_ppm(training, text, order), abs=1e-4)
    # all that can follow a context, escapes included, adds up to one
    follow = np.array([int.from_bytes(b"    the" + bytes([x]), "little") for x in range(256)], np.uint64)
    assert float((10 ** model.score(follow)).sum()) == pytest.approx(1, abs=1e-4)


def test_rare_contexts_of_large_corpora_are_kept(spark):
    rng = random.Random(4)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(400))
    rows = [(i, text(), "s") for i in range(1200)] + [(5000, "", "s"), (5001, None, "s"), (None, "a b", "s")]
    train = [b" ".join((t or "").encode().split()) for i, t, _ in rows if zlib.crc32(str(i).encode() if i is not None else b"") % 5 != 1]
    assert sum(map(len, train)) > 2**21  # where entries that occur once made up less than 1 in 2^20
    got = {key(r["doc_id"]): r["score"] for r in lmscore.score_documents(make(spark, rows)).collect()}
    assert len(got) == len(rows)
    entries = [ppm.count_keys(ppm.entry_keys(ppm.windows(train)[0], ppm.ORDER))]
    for _ in range(ppm.ORDER):
        entries.insert(0, ppm.shorter(*entries[0]))
    model = ppm.Model(entries, [ppm.context_totals(k, c, i) for i, (k, c) in enumerate(entries)])
    for i, t, _ in (*rows[:6], *rows[-3:]):
        windows = ppm.windows([b" ".join((t or "").encode().split())])[0]
        assert got[key(i)] == pytest.approx(float(model.score(windows).sum()), rel=1e-4)


def test_untrained_model_is_even():
    model = ppm.Model([(np.zeros(0, np.uint64), np.zeros(0))] * 3, [(np.zeros(0, np.uint64), np.zeros(0))] * 3)
    assert model.score(ppm.windows([b"ab"])[0]).tolist() == [-math.log10(256)] * 3


# ---- 7


def test_token_counts(spark, docs, empty):
    pieces = set(tokencount.read_pieces(packing.VOCABULARY))
    longest = max(map(len, pieces))

    def brute(word):
        s, i, n = (*word, tokencount.END), 0, 0
        while i < len(s):
            j = next((j for j in range(min(len(s), i + longest), i, -1) if s[i:j] in pieces), None)
            if j is None:
                return n if i == len(s) - 1 else 1
            n, i = n + 1, j
        return n

    rows = docs.select("doc_id", "text").collect()
    expected = collections.Counter((r["doc_id"], len(words(r["text"])), sum(brute(w.encode()) for w in words(r["text"]))) for r in rows)
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_tokens"]) for r in tokencount.count_tokens(docs).collect()) == expected
    assert tokencount.count_tokens(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abc", max_size=12))
def test_automaton_is_greedy(vocabulary, word):
    pieces = [tuple(p.encode()) for p in sorted(vocabulary | set("abc"))]
    i = n = 0
    while i < len(word):
        i += max(len(p) for p in vocabulary | set("abc") if word.startswith(p, i))
        n += 1
    assert tokencount.LongestMatch(pieces).count(word.encode()) == n


# ---- 8


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    extra = make(spark, [(400, "<|endoftext|> A<|ENDOFTEXT|>b It's 12 été ÉTÉ ... a.b, (c)! Ω ﬀ x\x85y\x1cz", None), (401, "<|startoftext|>", None)])
    every = docs.union(extra)
    rows = every.select("doc_id", "text").collect()
    ids = collections.defaultdict(list)
    for r in rows:
        ids[key(r["doc_id"])].append(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1])
    got = packing.pack_documents(every).collect()
    of = collections.defaultdict(list)
    for r in got:
        of[key(r["doc_id"])].append(r)
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
    for doc, wanted in ids.items():
        pieces = sorted(of[doc], key=lambda r: (r["start"], r["sequence_id"], r["offset"]))
        joined = collections.Counter((r["start"] + i, x) for r in pieces for i, x in enumerate(np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
        assert joined == collections.Counter((i, x) for w in wanted for i, x in enumerate(w))
        assert {r["doc_tokens"] for r in pieces} == {len(w) for w in wanted}
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0
    assert packing.pack_documents(empty).count() == 0


@given(st.integers(0, 10_000))
def test_window_ends(total):
    ends = packing.window_ends(total, 2048)
    sizes = np.diff([total - total % 2048, *ends]).tolist()
    assert sum(sizes) == total % 2048 and all(s & (s - 1) == 0 for s in sizes)


# ---- 9


def test_rules(spark, docs, empty):
    def brute(text):
        w = WORD.findall(text or "")
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        windows = collections.defaultdict(list)
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].append(i)
        repeated = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)

    rows = docs.select("doc_id", "text").collect()
    got = rules.assess_documents(docs).collect()
    measured = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert collections.Counter((r["doc_id"], *(r[m] for m in measured)) for r in got) == collections.Counter((r["doc_id"], *brute(r["text"])) for r in rows)
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in kept.collect()) == collections.Counter(r["doc_id"] for r in got if r["kept"])
    assert rules.assess_documents(empty).count() == rules.keep_good(empty).count() == 0


def test_expectation_maximisation(spark):
    """One step after another in plain Python gives the same model."""
    rng = random.Random(4)
    patterns = collections.Counter(tuple(rng.choice((-1, 1, 1, 1, 0)) for _ in rules.RULES) for _ in range(60))
    frame = spark.createDataFrame([(*p, n) for p, n in patterns.items()], ", ".join(f"{r} int" for r in rules.RULES) + ", n long")
    model = rules.fit_rules(frame)
    kinds, n_rules, total = len(rules.RULES) + 1, len(rules.RULES), sum(patterns.values())
    share = [rules.GOOD] + [(1 - rules.GOOD) / n_rules] * n_rules
    prior = [[rules._prior(k, j) for j in range(n_rules)] for k in range(kinds)]
    start, against = list(share), [list(p) for p in prior]
    for _ in range(rules.ROUNDS):
        dealt = []
        for p, n in patterns.items():
            like = [s * math.prod(a[j] if v == -1 else 1 - a[j] if v == 1 else 1 for j, v in enumerate(p)) for s, a in zip(share, against)]
            like = like if -1 in p else [like[0]] + [0.0] * (kinds - 1)
            dealt.append((p, [n * x / sum(like) for x in like]))
        share = [(sum(d[k] for _, d in dealt) + start[k] * rules.GOOD_WEIGHT * total) / (total * (1 + rules.GOOD_WEIGHT)) for k in range(kinds)]
        weight = [(rules.KIND_WEIGHT if k else rules.FALSE_ALARM_WEIGHT) * total for k in range(kinds)]
        against = [[(sum(d[k] for p, d in dealt if p[j] == -1) + prior[k][j] * weight[k]) / (sum(d[k] for p, d in dealt if p[j]) + weight[k]) for j in range(n_rules)] for k in range(kinds)]
    assert model.kinds == pytest.approx(share) and all(a == pytest.approx(b) for a, b in zip(model.against, against))


@pytest.mark.parametrize("accused", [0, 1, 20, 400])
def test_abstentions_speak_for_no_bad_kind(spark, accused):
    """Documents that no rule votes against are good in any corpus: tiny, skewed, or one in which most rules abstain."""
    for clean in ([0] * len(rules.RULES), [0, *[1] * (len(rules.RULES) - 1)], [1] * len(rules.RULES)):
        rows = [(*clean, 40)] + [(*(-1 if j == 0 else v for j, v in enumerate(clean)), accused)] * bool(accused)
        frame = spark.createDataFrame(rows, ", ".join(f"{r} int" for r in rules.RULES) + ", n long")
        got = frame.withColumn("posterior", rules.fit_rules(frame).posterior()).collect()
        assert all(r["posterior"] == 1.0 for r in got if r["n"] == 40 and -1 not in [r[x] for x in rules.RULES])


# ---- 10


def test_top_k(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(260)]
    vectors += [(300 + i, vectors[20][1]) for i in range(30)] + [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (None, [1.0] * 8), (404, []), (405, [1e12] * 8), (20, vectors[20][1])]
    frame = spark.createDataFrame([(i, v, 1, 2, "x") for i, v in vectors], "vec_id long, embedding array<float>, b int, rank int, v string")
    usable = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = [math.floor(64 * float(np.float32(x))) for x in v] + [0] * (8 - len(v))
    expected = set()
    for q in (i for i in usable if i % 20 == 0):
        scores = sorted((-sum(x * y for x, y in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
        expected |= {(q, k + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for k, (s, i) in enumerate(scores[:20])}
    from pyspark.sql import functions as F

    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, block=64, query_block=8)
    assert {tuple(r) for r in got.collect()} == expected
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = topk.top_k(frame.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 2


def test_search_misses_no_member():
    rng = np.random.default_rng(7)
    block, queries = np.floor(rng.normal(size=(300, 16)) * 20), np.floor(rng.normal(size=(5, 16)) * 20)
    own = np.zeros((5, 300), bool)
    mask = topk.search_block(queries, topk.Index(block), own, 10)
    scores = queries @ block.T
    for q in range(5):
        assert mask[q][scores[q] >= np.sort(scores[q])[-10]].all()


# ---- the pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        stage(spark, docs, source).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name in ("quality_rules", "simhash_near_dedup"):
            assert 0 < docs.count() <= before
        if name == "line_dedup":
            assert docs.count() == before
    assert corpus_pipeline.run(spark, source).count() == docs.count()
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])
