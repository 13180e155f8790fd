"""Spelling variants: words that differ by one letter, found by bands of letter-parity bit masks.

A bit of a word's mask tells whether letters of one class occur in it an odd number of times. One edit flips at most two bits,
and so leaves one of three bands of the mask as it was. Words with an equal band and lengths that differ by one at most are
compared: by the bits that differ, then by edit distance. Where more words share a band than MOST_IN_BAND, they are joined by
what is left of them without one letter instead: equal remains at the same place prove an edit, or an insertion at any place,
so such a group is never larger than the alphabet times the word's length, and nothing is compared all against all.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, cut, documents

#: A run in UTF-8 in lower case: a-z and the code points from C0 to FF.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: A run of a document loses a letter if this divides its hash.
ONE_IN = 199
LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form has at least so many times the occurrences of its word.
TIMES = 5
#: Classes of letters: a bit each, in three bands by the class's remainder.
CLASSES, BANDS = 63, 3
#: Words of a length and band that are compared with each other.
MOST_IN_BAND = 256
#: Distinct words that a task counts before it hands on what it has.
COUNTED_AT_ONCE = 200_000


def count_words(docs: DataFrame, one_in: int = ONE_IN, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of ``docs`` (doc_id, text): runs of letters in lower case (A-Z), some without one letter, that occur often enough.

    A run loses the letter at place h % length if ``one_in`` divides h, the crc32 of doc_id, a colon and the run; a null
    doc_id counts as the empty text there. A null or empty text has no runs; long ones count whole. Equal rows count as often
    as they occur. Other columns are ignored; an empty table has no words.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                if not text:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for run, n in Counter(RUN.findall(text.lower())).items():
                    h = zlib.crc32(run, start)
                    if h % one_in == 0:
                        letters = run.decode()
                        place = h % len(letters)
                        run = (letters[:place] + letters[place + 1 :]).encode()
                    counts[run] = counts.get(run, 0) + n
                if len(counts) > COUNTED_AT_ONCE:
                    yield counted()
                    counts.clear()
        if counts:
            yield counted()

    parts = arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "word string, n long")
    return parts.where(F.length("word") >= least_length).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def parity_mask(word: Column) -> Column:
    """A bit for each class of letters that occurs an odd number of times; a-z have classes of their own."""
    place = lambda c: F.pmod(F.when(F.ascii(c) < 128, F.ascii(c) - 97).otherwise(F.ascii(c) - 166), F.lit(CLASSES))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda m, c: F.when(c == "", m).otherwise(m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), place(c)))))


def _band(mask: Column, band: int) -> Column:
    return mask.bitwiseAND(F.lit(sum(1 << i for i in range(band, CLASSES, BANDS))))


def near_words(words: DataFrame, most_in_band: int = MOST_IN_BAND) -> DataFrame:
    """(a, b), a before b: pairs of ``words`` (word, distinct) of which one edit, of one code point, makes one from the other. Null words have no part."""
    masked = words.where("word is not null").select("word", F.length("word").alias("size"), parity_mask(F.col("word")).alias("mask"))
    bands = F.array(*(F.struct(F.lit(i).alias("band"), _band(F.col("mask"), i).alias("bits")) for i in range(BANDS)))
    banded = cut(masked.select("*", F.explode(bands).alias("x")).select("word", "size", "mask", "x.band", "x.bits"))
    # a group's words are those of a length and the next one
    sized = banded.groupBy("band", "bits", "size").agg(F.count("*").alias("n"))
    groups = sized.select("band", "bits", F.explode(F.array("size", F.col("size") - 1)).alias("least"), "n").groupBy("band", "bits", "least").agg(F.sum("n").alias("n"))
    crowded = groups.where(F.col("n") > most_in_band).select("band", "bits", "least")
    short = banded.join(crowded.withColumnRenamed("least", "size"), ["band", "bits", "size"], "left_anti")
    a, b = (short.select("band", "bits", *(F.col(c).alias(f"{side}_{c}") for c in ("word", "size", "mask"))) for side in "ab")
    b = banded.select("band", "bits", F.col("word").alias("b_word"), F.col("size").alias("b_size"), F.col("mask").alias("b_mask"), F.explode(F.array("size", F.col("size") - 1)).alias("a_size"))
    close = F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2
    other = (F.col("b_size") > F.col("a_size")) | (F.col("a_word") < F.col("b_word"))
    met = a.join(b, ["band", "bits", "a_size"]).where(other & close & (F.levenshtein("a_word", "b_word", 1) == 1)).select(F.col("a_word").alias("a"), F.col("b_word").alias("b"))
    # words of crowded groups, each once
    dense = banded.join(crowded.select("band", "bits", F.explode(F.array("least", F.col("least") + 1)).alias("size")).distinct(), ["band", "bits", "size"], "left_semi").select("word", "size").distinct()
    return met.union(_by_remains(dense)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _by_remains(words: DataFrame) -> DataFrame:
    """(a, b): near pairs among ``words`` (word, size) by equal remains."""
    places = F.sequence(F.lit(1), F.col("size"))
    remains = words.select("word", F.posexplode(F.transform(places, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring("word", i + 1, F.col("size"))))).alias("place", "left"))
    a, b = remains.toDF("a", "place", "left"), remains.toDF("b", "place", "left")
    replaced = a.join(b, ["place", "left"]).where("a < b").select("a", "b")
    inserted = words.select(F.col("word").alias("a")).join(remains.select(F.col("left").alias("a"), F.col("word").alias("b")).distinct(), "a").select("a", "b")
    return replaced.union(inserted)


def group_spellings(words: DataFrame, times: int = TIMES, most_in_band: int = MOST_IN_BAND) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n; words are distinct).

    n_near counts the words at one edit. form is the near word with the largest n, the least one in order of code points if
    several have it, if that n is at least ``times`` the word's; else null, as form_n, its n. root follows forms to the last; a
    word without a form is its own. Forms grow at least ``times``-fold, so paths to roots have few steps.
    """
    words = cut(words.where("word is not null").select("word", F.col("n").cast("long")))
    pairs = cut(near_words(words, most_in_band))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("first"))
    near = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("first.other").alias("other"), (-F.col("first.less")).alias("other_n"))
    is_form = F.col("other_n") >= times * F.col("n")
    formed = cut(near.select("word", F.when(is_form, F.col("other")).alias("form"), "n", "n_near", F.when(is_form, F.col("other_n")).alias("form_n")))
    steps = formed.where("form is not null").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 1
    # each round doubles the steps that are covered
    for _ in range(math.ceil(math.log2(max(2.0, math.log(most, max(2, times)) + 1)))):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = cut(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(count_words(documents(spark, sf_dir)))
