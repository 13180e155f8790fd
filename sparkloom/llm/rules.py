"""Quality rules by weak supervision, with built-in functions only.

Each rule votes for a document (1), against it (-1) or abstains (0). A document is good, or bad in one of as many ways as
there are rules. Expectation-maximisation over the counts of vote patterns, at most 3 to the number of rules whatever the
corpus, estimates how common each kind is and how accurate each rule is on each kind; a document's posterior probability of
being good then takes the place of "all rules must pass". A document that no rule votes against is good: a bad kind shows in at
least one such vote, so abstentions alone never speak for one. The estimation is one expression over one row of counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, cut, documents, whole_row

#: Words of a window that may repeat, fewest words of a document, and largest share of repeated words in per cent.
WINDOW, FEWEST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
ROUNDS = 40
#: Beliefs before any document is seen: how often a rule votes against a good document, against one that is bad in its own
#: way, and against one that is bad in another; the share of good documents. Then what each weighs, as a share of all documents.
FALSE_ALARM, OWN_KIND, OTHER_KIND, GOOD = 0.01, 0.9, 0.1, 0.8
FALSE_ALARM_WEIGHT, KIND_WEIGHT, GOOD_WEIGHT = 0.5, 0.002, 0.01

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_letters", "n_capitals", "n_calls")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeated_words(hashes: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more; ``hashes`` are the words'."""
    starts = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))

    def covered(places: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(0), F.size(places) - 2), lambda j: F.least(F.lit(WINDOW), F.get(places, j + 1) - F.get(places, j)))
        many = F.aggregate(gaps, F.lit(0), lambda a, x: a + x) + WINDOW
        return F.when(F.size(places) > 1, many).otherwise(F.size(places) * WINDOW)

    def repeated(ordered: Column) -> Column:
        same = lambda a, b: F.get(ordered, a)["h"] == F.get(ordered, b)["h"]
        place = lambda j: F.when(F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)), F.get(ordered, j)["p"])
        places = F.array_compact(F.transform(F.sequence(F.lit(0), F.size(ordered) - 1), place))
        return let(F.sort_array(places), covered)

    def windows(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(found)) < F.size(found), let(ordered, repeated)).otherwise(0)

    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
    return F.when(F.size(hashes) > WINDOW, let(hashed, windows)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of whole numbers (MEASURES) of a text; a null text has none of anything."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    without = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))

    def of_words(words: Column) -> Column:
        return let(
            F.transform(words, lambda w: F.xxhash64(w)),
            lambda h: F.struct(F.size(h).alias("n_words"), _repeated_words(h).alias("n_repeat_words"), F.size(F.array_distinct(h)).alias("n_distinct")),
        )

    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.struct(
        let(F.regexp_extract_all(text, F.lit(WORD), 0), of_words).alias("w"),
        F.length(F.translate(text, SPACES, "")).alias("word_chars"),
        without(text, SYMBOLS).alias("n_symbols"),
        let(lines(text), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("l"),
        letters.alias("n_letters"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).alias("n_capitals"),
        without(text, "!").alias("n_calls"),
    )


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` of ``docs`` and, as longs, MEASURES."""
    # generated, so that no filter or projection above is merged with it and measures a text again for each column
    rows = docs.select(*keep, F.explode(F.array(measures(F.col("text")))).alias("m"))
    flat = {
        "n_words": "m.w.n_words", "word_chars": "m.word_chars", "n_symbols": "m.n_symbols", "n_repeat_words": "m.w.n_repeat_words", "n_lines": "m.l.n",
        "n_distinct": "m.w.n_distinct", "n_letters": "m.n_letters", "n_capitals": "m.n_capitals", "n_calls": "m.n_calls",
    }
    columns = {k: F.col(v) for k, v in flat.items()} | {"n_dup_lines": F.col("m.l.n") - F.col("m.l.d")}
    return rows.select(*keep, *(columns[k].cast("long").alias(k) for k in MEASURES))


def _rule(against: Column, in_favour: Column) -> Column:
    return F.when(against, -1).when(in_favour, 1).otherwise(0)


def _votes() -> dict[str, Column]:
    c, share = F.col, lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    length = share("word_chars", "n_words")
    return {
        "enough_words": _rule(c("n_words") < FEWEST_WORDS, c("n_words") >= 50),
        "word_length": _rule((length < 2.5) | (length > 12), (length >= 3) & (length <= 10)),
        "few_symbols": _rule(share("n_symbols", "n_words") > 0.1, share("n_symbols", "n_words") < 0.02),
        "new_lines": _rule(share("n_dup_lines", "n_lines") > 0.3, share("n_dup_lines", "n_lines") < 0.1),
        "new_windows": _rule(share("n_repeat_words", "n_words") > MOST_REPEATED / 100, share("n_repeat_words", "n_words") < 0.1),
        "rich_words": _rule((c("n_words") >= 50) & (share("n_distinct", "n_words") < 0.15), (c("n_words") >= 50) & (share("n_distinct", "n_words") > 0.3)),
        "lower_case": _rule(share("n_capitals", "n_letters") > 0.5, share("n_capitals", "n_letters") < 0.25),
        "few_calls": _rule(share("n_calls", "n_words") > 0.2, share("n_calls", "n_words") < 0.05),
        "letters": _rule(share("n_letters", "word_chars") < 0.6, share("n_letters", "word_chars") > 0.75),
    }


RULES = ("enough_words", "word_length", "few_symbols", "new_lines", "new_windows", "rich_words", "lower_case", "few_calls", "letters")


@dataclass(frozen=True)
class RuleModel:
    """The share of each kind of document, the good ones first, and for each kind how likely each rule, if it votes, votes against."""

    kinds: tuple[float, ...]
    against: tuple[tuple[float, ...], ...]

    def posterior(self) -> Column:
        """Probability that a document is good, from its vote columns."""
        votes, kinds = F.array(*(F.col(r) for r in RULES)), []
        for share, against in zip(self.kinds[1:], self.against[1:]):
            down = [log(bad) - log(good) for bad, good in zip(against, self.against[0])]
            up = [log(1 - bad) - log(1 - good) for bad, good in zip(against, self.against[0])]
            kinds.append(F.struct(F.lit(log(share) - log(self.kinds[0])).alias("base"), _doubles(down).alias("down"), _doubles(up).alias("up")))

        def total(terms: Column) -> Column:
            return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

        def odds(kind: Column) -> Column:
            """Of one kind against the good one."""
            down = total(F.zip_with(votes, kind["down"], lambda v, x: F.when(v == -1, x).otherwise(0.0)))
            return F.exp(kind["base"] + down + total(F.zip_with(votes, kind["up"], lambda v, x: F.when(v == 1, x).otherwise(0.0))))

        # constants in arrays: an expression for each rule and kind would be too long to compile
        accused = F.exists(votes, lambda v: v == -1)
        return F.when(accused, 1 / (1 + total(F.transform(F.array(*kinds), odds)))).otherwise(1.0)


def vote_patterns(measured_docs: DataFrame) -> DataFrame:
    """(one column for each rule, n): how many documents have each pattern of votes."""
    return measured_docs.select(*(v.alias(k) for k, v in _votes().items())).groupBy(*RULES).agg(F.count("*").alias("n"))


def _prior(kind: int, rule: int) -> float:
    return FALSE_ALARM if kind == 0 else OWN_KIND if kind == rule + 1 else OTHER_KIND


def _doubles(values: list) -> Column:
    return F.array(*(_doubles(v) if isinstance(v, list) else F.lit(float(v)) for v in values))


def fit_rules(patterns: DataFrame) -> RuleModel:
    """Expectation-maximisation over vote patterns: one row of at most 3 to the number of rules counts, folded ROUNDS times."""
    n_rules, n_kinds = len(RULES), len(RULES) + 1
    kind_prior = [GOOD] + [(1 - GOOD) / n_rules] * n_rules
    against_prior = [[_prior(k, j) for j in range(n_rules)] for k in range(n_kinds)]
    row = patterns.agg(
        F.collect_list(F.struct(F.col("n").cast("double").alias("n"), F.array(*(F.col(r) for r in RULES)).alias("v"))).alias("patterns"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("total"),
    )
    kinds = F.sequence(F.lit(0), F.lit(n_kinds - 1))
    weights = F.array(F.lit(FALSE_ALARM_WEIGHT), *(F.lit(KIND_WEIGHT) for _ in RULES))
    prior_share, prior_against = _doubles(kind_prior), _doubles(against_prior)

    def likelihoods(state: Column, votes: Column) -> Column:
        def of_kind(share: Column, k: Column) -> Column:
            p = F.get(state["against"], k)
            terms = F.zip_with(votes, p, lambda v, q: F.when(v == -1, F.log(q)).when(v == 1, F.log(1 - q)).otherwise(0.0))
            return F.exp(F.log(share) + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))

        accused = F.exists(votes, lambda v: v == -1)
        return let(accused, lambda some: F.transform(state["kinds"], lambda share, k: F.when(some | (k == 0), of_kind(share, k)).otherwise(0.0)))

    def shared(state: Column, pattern: Column) -> Column:
        """The pattern's count, dealt to the kinds."""
        total = lambda each: F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        dealt = let(likelihoods(state, pattern["v"]), lambda each: let(total(each), lambda t: F.transform(each, lambda x: pattern["n"] * x / t)))
        return F.struct(pattern["v"].alias("v"), dealt.alias("n"))

    def estimate(patterns: Column) -> Column:
        def of_kind(k: Column) -> Column:
            return F.aggregate(patterns, F.lit(0.0), lambda a, x: a + F.get(x["n"], k))

        def of_rule(k: Column, j: Column) -> Column:
            votes = lambda chosen: F.aggregate(patterns, F.lit(0.0), lambda a, x: a + F.when(chosen(F.get(x["v"], j)), F.get(x["n"], k)).otherwise(0.0))
            weight = F.get(weights, k) * F.col("total")
            return (votes(lambda v: v == -1) + F.get(F.get(prior_against, k), j) * weight) / (votes(lambda v: v != 0) + weight)

        share = lambda k: (of_kind(k) + F.get(prior_share, k) * GOOD_WEIGHT * F.col("total")) / (F.col("total") * (1 + GOOD_WEIGHT))
        rules = F.sequence(F.lit(0), F.lit(n_rules - 1))
        return F.struct(F.transform(kinds, share).alias("kinds"), F.transform(kinds, lambda k: F.transform(rules, lambda j: of_rule(k, j))).alias("against"))

    start = F.struct(prior_share.alias("kinds"), prior_against.alias("against"))
    step = lambda state, _: let(F.transform(F.col("patterns"), lambda p: shared(state, p)), estimate)
    folded = F.when(F.col("total") > 0, F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)).otherwise(start)
    state = row.select(folded.alias("state")).first()["state"]
    return RuleModel(tuple(state["kinds"]), tuple(map(tuple, state["against"])))


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judged(measured_docs: DataFrame, model: RuleModel) -> DataFrame:
    """``measured_docs`` with base_failed, posterior and kept (posterior of a half or more, and not base_failed)."""
    voted = measured_docs.withColumns(_votes()).withColumns({"posterior": model.posterior(), "base_failed": base_failed()}).drop(*RULES)
    return voted.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def assess_documents(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES, base_failed, posterior and kept of each row of ``docs``.

    A null or empty text has no words and fails. A null doc_id and repeated rows are judged like others, and equal texts
    alike. Texts are measured whole, however long, each in one task. An empty table gives no row. Other columns are ignored.
    """
    found = cut(measured(docs.select("doc_id", "text"), "doc_id"))
    return judged(found, fit_rules(vote_patterns(found)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that assess_documents keeps, with their columns. Each text is measured once; rows wait with their measures in the checkpoint folder."""
    found = cut(measured(docs.select(whole_row(docs).alias("row"), F.col("text").cast("string").alias("text")), "row"))
    return judged(found, fit_rules(vote_patterns(found))).where("kept").select("row.*")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = assess_documents(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
