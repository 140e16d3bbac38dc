"""Quality rules: measures by brute force, estimates against plain Python, planted accuracies."""

import random
import re
from collections import Counter
from math import exp, log

import pytest
from planted import make, prose

from tabscout.llm.rules import FIRST_PRIOR, FIRST_RATES, PSEUDO, RULES, Rule, estimate, judge, measure


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_bare_words": sum(all(c < "\x80" and not c.isalpha() for c in w) for w in words),
        "n_distinct_words": len(set(words)),
        "n_ended_lines": sum(bool(re.search("[.!?:;\"'”»)][\\x20\\x09-\\x0D]*$", x)) for x in lines),
    }


def expected(patterns, rules, rounds):
    """The same estimation with plain loops."""
    prior, rates = FIRST_PRIOR, [dict(FIRST_RATES) for _ in range(rules)]
    for _ in range(rounds):
        seen = []
        for votes, n in patterns.items():
            odds = log(prior / (1 - prior))
            for v, r in zip(votes, rates, strict=True):
                if v > 0:
                    odds += max(log(r["good_good"] / r["good_bad"]), 0)
                elif v < 0:
                    odds += min(log(r["bad_good"] / r["bad_bad"]), 0)
            q = 1 / (1 + exp(-odds))
            seen.append((votes, n * q, n * (1 - q)))
        good, bad = sum(s[1] for s in seen), sum(s[2] for s in seen)
        prior = max(0.01, min(0.99, good / (good + bad)))
        for j, r in enumerate(rates):
            for side, vote in (("good", 1), ("bad", -1)):
                r[f"{side}_good"] = (sum(s[1] for s in seen if s[0][j] == vote) + PSEUDO) / (good + 3 * PSEUDO)
                r[f"{side}_bad"] = (sum(s[2] for s in seen if s[0][j] == vote) + PSEUDO) / (bad + 3 * PSEUDO)
    return prior, [tuple(r[n] for n in FIRST_RATES) for r in rates]


def test_measures(spark, edge_texts):
    line = "the same line of eight words comes again"
    texts = [
        *edge_texts,
        "\n".join([line] * 30),
        " ".join(["word"] * 3000),
        f"{line} x {line} y {' '.join(line.split()[3:])} {line}",
        "a b c d e f g h a b c d e f g h",
        "### $$$ %% 12 34 | é ü\n\n \n end.\nend.\n“quoted”  ",
        prose(9, 60) + " " + prose(9, 60),
    ]
    rows = measure(make(spark, texts)).collect()
    got = Counter((r.doc_id, tuple(r[n] for n in sorted(brute("")))) for r in rows)
    pairs = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    assert got == Counter((k, tuple(v for _, v in sorted(brute(t).items()))) for k, t in pairs)


@pytest.mark.parametrize("rounds", [1, 12])
def test_estimate_matches_plain_loops(spark, rounds):
    rng = random.Random(4)
    rows = [tuple(rng.choice((1, 1, 0, -1)) for _ in range(4)) for _ in range(300)]
    fitted = estimate(spark.createDataFrame([(list(r),) for r in rows], "votes array<int>").repartition(5), 4, rounds)
    prior, rates = expected(Counter(rows), 4, rounds)
    assert fitted.prior == pytest.approx(prior, abs=1e-12)
    for got, want in zip(fitted.rates, rates, strict=True):
        assert got == pytest.approx(want, abs=1e-12)


def test_planted_accuracies_are_found(spark):
    """Six rules of known accuracy on documents of known quality; votes alone tell them apart."""
    rng = random.Random(7)
    right = (0.95, 0.9, 0.85, 0.8, 0.7, 0.6)
    truth, rows = [], []
    for i in range(4000):
        good = rng.random() < 0.8
        truth.append(good)
        rows.append((i, [0 if rng.random() < 0.2 else (1 if (rng.random() < a) == good else -1) for a in right]))
    df = spark.createDataFrame(rows, "k int, votes array<int>")
    fitted = estimate(df, 6)
    assert fitted.prior == pytest.approx(0.8, abs=0.05)
    assert [r[3] / (r[2] + r[3]) for r in fitted.rates] == pytest.approx(right, abs=0.1)
    kept = {r.k: r.q >= 0.5 for r in df.select("k", fitted.quality(df.votes).alias("q")).collect()}
    assert sum(kept[i] == g for i, g in enumerate(truth)) > 0.94 * 4000
    # Taking every document that no rule votes against would lose most good ones.
    assert sum(g and kept[i] for i, g in enumerate(truth)) > 2 * sum(g and min(rows[i][1]) >= 0 for i, g in enumerate(truth))


def test_verdicts(spark, edge_docs, no_docs):
    rows = judge(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and r.quality >= 0.5)
        assert len(r.votes) == len(RULES) and (r.n_words or not any(r.votes))
    assert judge(no_docs).count() == 0


def test_a_rule_that_never_votes_says_nothing(spark):
    silent = Rule("silent", "FALSE", "FALSE")
    docs = make(spark, [" ".join([prose(i, 90), "end."]) for i in range(20)])
    with_it, without = judge(docs, (*RULES, silent)), judge(docs)
    got = {r.doc_id: r.quality for r in with_it.collect()}
    assert got == pytest.approx({r.doc_id: r.quality for r in without.collect()}, abs=1e-12)
