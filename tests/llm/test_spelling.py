"""Spelling variants against plain Python, with groups that are crowded and groups that aren't."""

from __future__ import annotations

import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import spelling


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_groups(words):
    near = {w: [] for w in words}
    ordered = sorted(words)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if abs(len(a) - len(b)) <= 1 and is_near(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def variants(rng, word, letters):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i:], word[:i] + rng.choice(letters) + word[i + 1 :]])


def some_words(seed, n, letters="abcdeé×ÿz"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randrange(6, 11))): rng.randrange(5, 4000) for _ in range(n)}
    for w in list(words):
        for _ in range(rng.randrange(3)):
            v = variants(rng, w, letters)
            if len(v) >= 6:
                words.setdefault(v, rng.randrange(5, 60))
    return words


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


@pytest.mark.parametrize("most_in_band", [spelling.MOST_IN_BAND, 8, 0])
def test_groups_equal_brute_force(spark, most_in_band):
    words = some_words(1, 350)
    got = spelling.group_spellings(spark.createDataFrame(list(words.items()), "word string, n long"), most_in_band=most_in_band)
    assert set(map(tuple, got.select(*COLUMNS).collect())) == brute_groups(words)


def test_crowded_bands_lose_nothing(spark):
    """Words of one length over two letters share few masks, so that nearly all are in crowded groups."""
    rng = random.Random(4)
    words = {"".join(rng.choice("ab") for _ in range(rng.choice([9, 10]))): rng.randrange(5, 500) for _ in range(600)}
    got = spelling.group_spellings(spark.createDataFrame(list(words.items()), "word string, n long"), most_in_band=20)
    assert set(map(tuple, got.select(*COLUMNS).collect())) == brute_groups(words)


def test_forms_are_followed_to_the_root(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "abbbbbb": 78125, "zzzzzz": 10}
    got = {r["word"]: r for r in spelling.group_spellings(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaaa"]["root"] == "abbbbbb" and got["aaaabb"]["root"] == "abbbbbb" and got["zzzzzz"]["root"] == "zzzzzz" and got["zzzzzz"]["form"] is None


def test_ties_go_to_the_least_word(spark):
    words = {"abcdef": 5, "abcdez": 25, "abcdea": 25, "ébcdef": 25}
    got = {r["word"]: (r["form"], r["n_near"], r["form_n"]) for r in spelling.group_spellings(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["abcdef"] == ("abcdea", 3, 25)


def test_one_edit_flips_two_bits_and_leaves_a_band(spark):
    rng = random.Random(9)
    letters = [*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))]
    pairs = [(w, variants(rng, w, letters)) for w in ("".join(rng.choice(letters) for _ in range(8)) for _ in range(400))]
    a, b = spelling.parity_mask(F.col("a")), spelling.parity_mask(F.col("b"))
    same = sum(((spelling._band(a, i) == spelling._band(b, i)).cast("int") for i in range(spelling.BANDS)), F.lit(0))
    got = spark.createDataFrame(pairs, "a string, b string").select(F.bit_count(a.bitwiseXOR(b)).alias("bits"), same.alias("same")).agg(F.max("bits"), F.min("same")).first()
    assert got[0] <= 2 and got[1] >= 1


ROWS = [
    (1, "Spelling spelling SPELLING spellin Ünder ünder naïve×naïve " * 3), (2, None), (3, ""), (None, "spelling 12 spelling_spelling " * 4), (None, "spelling 12 spelling_spelling " * 4), (7, "a" * 30_000), (8, "中spelling中" * 50),
]


def test_words_equal_brute_force(spark):
    rng = random.Random(2)
    more = [(i, " ".join(rng.choice(["wonder", "wonders", "Wonder", "élégant", "elegant", "plain"]) for _ in range(30))) for i in range(100, 160)]
    df = spark.createDataFrame([*ROWS, *more], "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(0)).withColumn("a.b", F.lit(1))
    got = {r["word"]: r["n"] for r in spelling.count_words(df.repartition(3)).collect()}
    assert got == brute_words([*ROWS, *more])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_spellings(spelling.count_words(empty)).count() == 0


def test_whole_table(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    words = brute_words([tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()])
    assert set(map(tuple, spelling.op11_spelling(spark, data).select(*COLUMNS).collect())) == brute_groups(words)
