"""Quality rules as weak supervision: rules vote or abstain, their accuracies are estimated, a posterior decides."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.lineage import stored
from tabscout.llm.words import words

#: Words of a window that counts as repeated within its text.
WINDOW = 8
#: Rounds of expectation-maximisation, and the share of good documents that it starts from.
ROUNDS, FIRST_PRIOR = 50, 0.9
#: What every rule starts from: how often it votes good and bad on good documents, and the same on bad ones.
FIRST_RATES = {"good_good": 0.8, "bad_good": 0.01, "good_bad": 0.6, "bad_bad": 0.25}
#: Documents that each rate starts with besides those counted, one of each vote, so that none becomes 0 or 1.
PSEUDO = 1.0
LEAST_PRIOR, MOST_PRIOR = 0.01, 0.99
#: A document stays if its probability of being good is at least this.
LEAST_QUALITY = 0.5

_SYMBOL = r"[#*$%&|<>]"
_LETTER = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x20\x09-\x0D]"
_ENDED = "[.!?:;\"'”»)][\\x20\\x09-\\x0D]*$"


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the measures of a document; where neither holds, the rule abstains. ``bad`` goes first."""

    name: str
    good: str
    bad: str


#: The production rules. All are ratios of whole numbers, so every engine decides alike.
RULES = (
    Rule("length", "n_words BETWEEN 50 AND 100000", "n_words < 20 OR n_words > 1000000"),
    Rule("word_length", "word_chars BETWEEN 3 * n_words AND 10 * n_words", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule("symbols", "100 * n_symbols <= 2 * n_words", "100 * n_symbols > 10 * n_words"),
    Rule("lines", "100 * n_dup_lines <= 10 * n_lines", "n_lines >= 8 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("repeats", "100 * n_repeat_words <= 10 * n_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("letters", "100 * n_bare_words <= 5 * n_words", "100 * n_bare_words > 20 * n_words"),
    Rule("variety", "100 * n_distinct_words >= 25 * least(n_words, 400)", "100 * n_distinct_words < 10 * least(n_words, 400)"),
    Rule("endings", "100 * n_ended_lines >= 50 * n_lines", "100 * n_ended_lines < 5 * n_lines"),
)


def repeated_words(tokens: Column, hashes: Column) -> tuple[Column, Column]:
    """Steps to the words in windows that a text has twice; the second refers to the first as column ``_sorted``.

    ``hashes`` are the hashes of all windows in order. Where none occurs twice
    nothing is sorted. Otherwise windows stand by hash and position, neighbours
    with one hash are compared word by word, and the lengths that the repeated
    ones cover are summed in order of position.
    """
    twice = F.size(F.array_distinct(hashes)) < F.size(hashes)
    by_hash = F.when(twice, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    ordered = F.col("_sorted")

    def same(x: Column, other: Column) -> Column:
        equal = (x["h"] == other["h"]) & (F.slice(tokens, x["i"] + 1, WINDOW) == F.slice(tokens, other["i"] + 1, WINDOW))
        return F.coalesce(equal, F.lit(False))

    found = F.filter(
        F.transform(ordered, lambda x, i: F.when(same(x, F.get(ordered, i - 1)) | same(x, F.get(ordered, i + 1)), x["i"])),
        lambda i: i.isNotNull(),
    )
    return by_hash, F.sort_array(found)


def covered(starts: Column) -> Column:
    """How many words windows from ascending starts cover."""
    lengths = F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW))))
    return F.coalesce(F.aggregate(lengths, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0).cast("bigint"))


def measure(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What the rules look at, for every whole text: ``<key>`` and counts, all bigint.

    Words are what ASCII white space separates. ``word_chars`` code points in
    words, ``n_symbols`` of ``#*$%&|<>``, ``n_lines`` lines with a word,
    ``n_dup_lines`` of them equal to an earlier line, ``n_ended_lines`` ending in
    punctuation, ``n_repeat_words`` words in 8-word windows that the text has
    twice, ``n_bare_words`` words without a letter, ``n_distinct_words``. A null
    or empty text has zeros. Nothing is shuffled: a text is measured where it is
    read, so no frequent word, line or passage gathers in one task.
    """
    name = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    split = docs.select(
        F.col(f"`{key}`").alias("_key"),
        name.alias("_text"),
        words(name).alias("_words"),
        F.filter(F.split(name, "\n"), lambda line: line.rlike(_WORD)).alias("_lines"),
    )
    tokens, lines = F.col("_words"), F.col("_lines")
    runs = F.sequence(F.lit(1), F.size(tokens) - (WINDOW - 1))
    hashed = split.select(
        "_key",
        "_words",
        F.size(tokens).cast("bigint").alias("n_words"),
        F.length(F.array_join(tokens, "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", _SYMBOL.replace("[", "[^") + "+", "")).cast("bigint").alias("n_symbols"),
        F.size(lines).cast("bigint").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda line: line.rlike(_ENDED))).cast("bigint").alias("n_ended_lines"),
        F.size(F.filter(tokens, lambda w: ~w.rlike(_LETTER))).cast("bigint").alias("n_bare_words"),
        F.size(F.array_distinct(tokens)).cast("bigint").alias("n_distinct_words"),
        F.when(F.size(tokens) >= WINDOW, F.transform(runs, lambda i: F.xxhash64(F.slice(tokens, i, WINDOW)))).alias("_hashes"),
    )
    by_hash, starts = repeated_words(tokens, F.col("_hashes"))
    found = hashed.withColumn("_sorted", by_hash).withColumn("_starts", starts)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_ended_lines", "n_bare_words", "n_distinct_words")
    return found.select(F.col("_key").alias(key), *counts, covered(F.col("_starts")).alias("n_repeat_words"))


def votes(rules: Sequence[Rule]) -> Column:
    """An array with 1 (good), -1 (bad) or 0 (abstains) of every rule; a text without words gets no vote."""
    cast = [F.when(F.expr(r.bad), F.lit(-1)).when(F.expr(r.good), F.lit(1)).otherwise(F.lit(0)) for r in rules]
    return F.array(*[F.when(F.col("n_words") > 0, vote).otherwise(F.lit(0)) for vote in cast])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _evidence(vote: Column, rates: Column) -> Column:
    """Log odds that a vote adds: how much likelier it is from a good document, never against the vote itself."""
    up = F.greatest(F.log(rates["good_good"] / rates["good_bad"]), F.lit(0.0))
    down = F.least(F.log(rates["bad_good"] / rates["bad_bad"]), F.lit(0.0))
    return F.when(vote > 0, up).when(vote < 0, down).otherwise(F.lit(0.0))


def _posterior(prior: Column, terms: Column) -> Column:
    """P(good) given the evidence of every rule."""
    odds = F.aggregate(terms, F.log(prior / (F.lit(1.0) - prior)), lambda s, x: s + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


@dataclass(frozen=True)
class Estimate:
    """The share of good documents, and the rates of every rule in the order of ``FIRST_RATES``."""

    prior: float
    rates: tuple[tuple[float, float, float, float], ...]

    def quality(self, cast: Column) -> Column:
        """P(good) of a document from its votes."""
        named = [F.struct(*[F.lit(x).alias(n) for n, x in zip(FIRST_RATES, r, strict=True)]) for r in self.rates]
        return _posterior(F.lit(self.prior), F.array(*[_evidence(F.get(cast, j), r) for j, r in enumerate(named)]))


def estimate(cast: DataFrame, rules: int, rounds: int = ROUNDS) -> Estimate:
    """Accuracies by expectation-maximisation over the votes (column ``votes``) of all documents.

    Documents with equal votes are counted together, at most 3 ** ``rules``
    patterns whatever the table, and one row holds them all. A round takes the
    posterior of every pattern (E) and then, under it, the share of good
    documents and how often each rule votes good and bad on good and on bad
    documents (M). Abstaining is no evidence, and a vote never speaks against
    itself, so good and bad cannot change places. An empty table keeps the
    first prior; a rule without votes says nothing.
    """
    patterns = cast.groupBy("votes").agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))

    def expected(state: Column) -> Column:
        def weigh(x: Column) -> Column:
            terms = F.transform(x["votes"], lambda v, j: _evidence(v, F.get(state["rates"], j)))
            quality = _posterior(state["prior"], terms)
            return F.struct(x["votes"].alias("v"), (x["n"] * quality).alias("good"), (x["n"] * (F.lit(1.0) - quality)).alias("bad"))

        return F.transform("p", weigh)

    def maximised(state: Column, seen: Column) -> Column:
        totals = {"good": _total(F.transform(seen, lambda x: x["good"])), "bad": _total(F.transform(seen, lambda x: x["bad"]))}
        prior = totals["good"] / F.nullif(totals["good"] + totals["bad"], F.lit(0.0))

        def rate(j: Column, vote: int, kind: str) -> Column:
            hits = _total(F.transform(seen, lambda x: F.when(F.get(x["v"], j) == vote, x[kind]).otherwise(0.0)))
            return (hits + F.lit(PSEUDO)) / (totals[kind] + F.lit(3 * PSEUDO))

        kinds = {n: (1 if n.startswith("good") else -1, n.rsplit("_", 1)[1]) for n in FIRST_RATES}
        return F.struct(
            F.coalesce(F.greatest(F.lit(LEAST_PRIOR), F.least(F.lit(MOST_PRIOR), prior)), state["prior"]).alias("prior"),
            F.transform(
                F.sequence(F.lit(0), F.lit(rules - 1)), lambda j: F.struct(*[rate(j, *kinds[n]).alias(n) for n in FIRST_RATES])
            ).alias("rates"),
        )

    def refined(state: Column, _: Column) -> Column:
        return F.aggregate(F.array(expected(state)), state, maximised)

    first = [F.lit(rate).alias(n) for n, rate in FIRST_RATES.items()]
    start = F.struct(F.lit(FIRST_PRIOR).alias("prior"), F.array_repeat(F.struct(*first), rules).alias("rates"))
    fitted = one.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, refined).alias("s")).select("s.*").first()
    return Estimate(fitted.prior, tuple(tuple(r) for r in fitted.rates))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The plain rule that no vote can outweigh: too short, or mostly repeats."""
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", least: float = LEAST_QUALITY) -> DataFrame:
    """Measures, votes, probability and verdict of every document.

    Returns ``<key>``, the columns of ``measure``, ``votes``, ``quality`` (the
    posterior probability of being good), ``base_failed`` and ``kept``. The
    measures are written once in the shared folder, so texts are read once and a
    lost executor costs its own part. Estimates use all documents. Repeated rows
    count and come back as often as they are there; a null text is empty and
    fails the base; no documents give no rows. Other columns are not read.
    """
    measured = stored(measure(docs, key, text))
    voted = measured.withColumn("votes", votes(rules))
    fitted = estimate(voted, len(rules))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return voted.withColumn("quality", fitted.quality(F.col("votes"))).withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= least)
    )
