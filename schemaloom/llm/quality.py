"""Quality rules as weak supervision: rules vote good, bad or abstain; expectation-maximisation estimates how accurate
each rule is; the posterior probability of good decides.

Votes are few, so the corpus shrinks to one row per vote pattern: at most 3 ** 8 = 6561 rows, whatever its size. The
iterations run on that table alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import SPACES, WORD, staged

#: rule: (votes bad if, votes good if) over the features below; neither: abstains.
RULES = {
    "symbols": ("n_symbols * 10 > n_words", "n_symbols * 50 <= n_words"),
    "capitals": ("n_upper * 10 > word_chars * 4", "n_upper * 10 <= word_chars * 2"),
    "exclaims": ("n_exclaims * 10 > n_words", "n_exclaims * 50 <= n_words"),
    "punctuation": ("n_odd * 5 > n_words", "n_odd * 20 <= n_words"),
    "sentences": ("n_sentences * 60 < n_words", "n_sentences * 30 >= n_words"),
    "word_length": ("word_chars < n_words * 3 OR word_chars > n_words * 10", "word_chars BETWEEN n_words * 4 AND n_words * 8"),
    "dup_lines": ("n_dup_lines * 10 > n_lines * 3", "n_dup_lines * 20 <= n_lines"),
    "repeats": ("n_repeat_words * 5 > n_words", "n_repeat_words * 20 <= n_words"),
}
#: Where the iterations start: the share of good texts, and the chance that a rule's vote is right on good and on bad ones.
#: Rules look for one kind of fault each, so on most bad texts most of them see none.
PRIOR, ON_GOOD, ON_BAD = 0.85, 0.97, 0.3
ITERATIONS = 30


def _words(text: Column) -> Column:
    spaced = text
    for c in SPACES[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def _let(value: Column, use) -> Column:
    """`use(value)` with `value` computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows found twice or more. Windows are sorted by hash, so equal ones are neighbours."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _let(placed, lambda s: F.filter(
        s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    # each start covers three words, less what the start before it covers already
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
                       lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
                       lambda a: a["n"])


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per row over the whole text; a null text counts as empty. Ids may repeat: there is one row per row."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), _words(t).alias("words"))
    n = F.size("words")
    # the last two elements lack words; they are cut off
    windows = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
                      F.lit(1), F.greatest(n - 2, F.lit(0)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    base = base.withColumns({"windows": windows, "lines": lines})
    long = lambda c: c.cast("long")
    return base.select(
        "doc_id", long(n).alias("n_words"), long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
        .otherwise(_repeat_words(F.col("windows"))).alias("n_repeat_words"),
        long(F.size("lines")).alias("n_lines"), long(F.regexp_count("text", F.lit(r"\p{Lu}"))).alias("n_upper"),
        long(F.regexp_count("text", F.lit("!"))).alias("n_exclaims"),
        # runs of ASCII punctuation, and such a mark between two spaces
        long(F.regexp_count("text", F.lit(r"[!-/:-@\[-`{-~]{2,}| [!-/:-@\[-`{-~] "))).alias("n_odd"),
        long(F.regexp_count("text", F.lit(r"[.?](?!\S)"))).alias("n_sentences"))


def votes(rules: dict[str, tuple[str, str]] = RULES) -> dict[str, Column]:
    return {f"vote_{k}": F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for k, (bad, good) in rules.items()}


def _log_odds(names: list[str], prior: float, good: dict[str, float], bad: dict[str, float]) -> Column:
    """Log odds of good. good, bad: the chance that a rule's vote is right where the text is good, or bad."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for k in names:
        odds = odds + (F.when(F.col(k) == 1, math.log(good[k] / (1 - bad[k])))
                       .when(F.col(k) == -1, math.log((1 - good[k]) / bad[k])).otherwise(0.0))
    return odds


def fit(patterns: list[tuple[tuple[int, ...], int]], names: list[str], iterations: int = ITERATIONS) -> tuple[float, dict, dict]:
    """Prior of good, and each rule's accuracies on good and on bad texts, from vote patterns and their counts.

    Estimates are smoothed by ten made-up votes at the start's accuracy. A vote for bad always stays at least twice as
    likely on bad texts as on good ones, so that no rule turns its meaning around. No pattern: the start.
    """
    prior, good, bad = PRIOR, [ON_GOOD] * len(names), [ON_BAD] * len(names)
    total = sum(n for _, n in patterns)
    for _ in range(iterations if total else 0):
        all_good, up, down = 0.0, [[0.0, 0.0] for _ in names], [[0.0, 0.0] for _ in names]  # [on bad, on good]
        for pattern, n in patterns:
            odds = math.log(prior / (1 - prior))
            for k, vote in enumerate(pattern):
                odds += math.log(good[k] / (1 - bad[k])) if vote > 0 else math.log((1 - good[k]) / bad[k]) if vote < 0 else 0.0
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            all_good += n * p
            for k, vote in enumerate(pattern):
                if vote:
                    side = (up if vote > 0 else down)[k]
                    side[0] += n * (1 - p)
                    side[1] += n * p
        prior = min(0.98, max(0.02, all_good / total))
        for k in range(len(names)):
            good[k] = min(0.998, max(0.55, (up[k][1] + 10 * ON_GOOD) / (up[k][1] + down[k][1] + 10)))
            bad[k] = min(0.99, max(2 * (1 - good[k]), (down[k][0] + 10 * ON_BAD) / (up[k][0] + down[k][0] + 10)))
    return prior, dict(zip(names, good)), dict(zip(names, bad))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: dict[str, tuple[str, str]] = RULES,
                  least: float = 0.5, iterations: int = ITERATIONS) -> DataFrame:
    """One row per row of `docs`: the counts, votes, `base_failed`, the posterior `p_good` and `kept`.

    base_failed: fewer than 50 words, or more than half the words in repeated 3-word windows. Such rows are not kept;
    of the others those with p_good >= `least` are. Null and empty texts fail the base rules.
    """
    names = list(votes(rules))
    judged = staged(features(docs, doc_id, text).withColumns(votes(rules)).withColumn(
        "base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    counted = judged.where(~F.col("base_failed")).groupBy(*names).agg(F.count("*").alias("n")).collect()
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in counted)  # sorted: sums come out alike in every run
    p_good = 1 / (1 + F.exp(-_log_odds(names, *fit(patterns, names, iterations))))
    return judged.withColumn("p_good", p_good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))
