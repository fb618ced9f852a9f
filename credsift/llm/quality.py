"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a whole text. Expectation-maximisation over the counts of all vote
patterns (at most 3 ** rules of them, a table that doesn't grow with the corpus) estimates the share of good texts and each
vote's chance, abstentions included, in good and in bad texts; the verdict is the posterior probability of "good" by
Bayes' rule, votes taken as independent within a class. Everything by row is built-in expressions.

Edge cases: null text is treated as empty; a text without words fails the base rule; very long texts are handled
by sorting their own five-word windows, nothing is cut; repeated rows get equal results; an empty table gives an empty
result; other columns are kept by ``filter_documents`` and ignored by ``assess``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

BLANK = r"[\x20\x09-\x0D]"
WINDOW = 5
ROUNDS = 500
#: What is believed before any text is seen, worth ``PSEUDO`` texts: the share of good ones, and each vote's chance in good and in bad ones.
PSEUDO, SHARE = 20.0, 0.8
START = {-1: (0.02, 0.20), 0: (0.90, 0.75), 1: (0.08, 0.05)}
RULES = ("symbols", "symbol_runs", "lone_symbols", "letters", "capitals", "shouting", "word_length", "repetition", "repeated_lines", "sentences")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words inside five-word windows that occur at least twice in the text."""
    n = F.size(words)
    grams = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))

    def covered(g: Column) -> Column:
        def positions(p: Column) -> Column:
            same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
            marked = F.transform(p, lambda x, i: F.when((same(x, F.get(p, i - 1))) | same(x, F.get(p, i + 1)), x["i"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda s, x: F.struct((s["n"] + x + WINDOW - F.greatest(s["end"], x)).alias("n"), (x + WINDOW).alias("end"))
        return F.aggregate(_let(pairs, positions), zero, step, lambda s: s["n"])

    return _let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g))).cast("long")


def measures(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the counts that the rules look at."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = documents.select(*keep, text.alias("_t"), F.array_remove(F.split(text, BLANK + "+"), "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c: c.cast("long")
    return split.select(
        *keep,
        long(F.size("_w")).alias("n_words"),
        long(F.char_length(F.array_join("_w", ""))).alias("word_chars"),
        long(F.char_length("_t") - F.char_length(F.translate("_t", "#*$%&|<>", ""))).alias("n_symbols"),
        _let(lines, lambda x: F.struct(long(F.size(x)).alias("n"), long(F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("_l"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        long(F.regexp_count("_t", F.lit(r"\p{Lu}"))).alias("_upper"),
        long(F.regexp_count("_t", F.lit("!"))).alias("_shouts"),
        long(F.regexp_count("_t", F.lit("[.!?。]"))).alias("_stops"),
        long(F.regexp_count("_t", F.lit("[#*$%&|<>]+"))).alias("_runs"),
        long(F.regexp_count("_t", F.lit(r"(?:^|[\x20\x09-\x0D])[#*$%&|<>]+(?![^\x20\x09-\x0D])"))).alias("_lone"),
        long(F.regexp_count("_t", F.lit(r"\p{L}"))).alias("_letters"),
    ).select("*", F.col("_l.n").alias("_lines"), F.col("_l.dup").alias("n_dup_lines"), ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed")).drop("_l")


def _votes() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))

    def vote(bad: Column, good: Column | None = None) -> Column:
        out = F.when(bad, -1)
        return (out if good is None else out.when(good, 1)).otherwise(0)

    per_word = lambda c: F.col(c) / words
    length = per_word("word_chars")
    return {
        "symbols": vote(per_word("n_symbols") > 0.1),
        "symbol_runs": vote(per_word("_runs") > 0.08),
        "lone_symbols": vote(per_word("_lone") > 0.08),
        "letters": vote(F.col("_letters") / chars < 0.75),
        "capitals": vote(F.col("_upper") / chars > 0.3),
        "shouting": vote(per_word("_shouts") > 0.3),
        "word_length": vote((length > 7.0) | (length < 2.5), length.between(3.5, 6.5)),
        "repetition": vote(per_word("n_repeat_words") > 0.3),
        "repeated_lines": vote(3 * F.col("n_dup_lines") > F.col("_lines")),
        "sentences": vote((per_word("_stops") > 0.5) | (100 * F.col("_stops") < F.col("n_words"))),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM over vote patterns and their counts: the share of good texts, and of each rule's votes the chances in good and in bad texts.

    Every vote, an abstention too, has its own chance in either class. A vote for bad is never held more likely in good texts
    than in bad ones, nor the reverse, which tells the classes apart.
    """
    rules, total = len(patterns[0][0]), sum(n for _, n in patterns)
    counts = [n for _, n in patterns]
    good = [0.05 if -1 in votes else 0.95 for votes, _ in patterns]
    for _ in range(ROUNDS):
        weight = [n * g for n, g in zip(counts, good)]
        all_good = sum(weight)
        share = (all_good + PSEUDO * SHARE) / (total + PSEUDO)
        chances = []
        for r in range(rules):
            own = {}
            for vote, (if_good, if_bad) in START.items():
                cast = sum(n for (votes, n) in patterns if votes[r] == vote)
                right = sum(w for (votes, _), w in zip(patterns, weight) if votes[r] == vote)
                x, y = (right + PSEUDO * if_good) / (all_good + PSEUDO), (cast - right + PSEUDO * if_bad) / (total - all_good + PSEUDO)
                own[vote] = (x, y) if not vote or (x - y) * vote >= 0 else ((x + y) / 2,) * 2
            chances.append(own)
        new = [posterior(votes, share, chances) for votes, _ in patterns]
        moved = max(abs(x - y) for x, y in zip(new, good))
        good = new
        if moved < 1e-9:
            break
    return share, chances


def posterior(votes: tuple[int, ...], share: float, chances: list[dict[int, tuple[float, float]]]) -> float:
    """The chance that a text with these votes is good, by Bayes' rule."""
    good, bad = share, 1 - share
    for vote, own in zip(votes, chances):
        good, bad = good * own[vote][0], bad * own[vote][1]
    return good / (good + bad)


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[dict[int, float]]]:
    """The log-odds of "good" before any vote, and what each rule's vote adds: the log-ratio of its chances in good and bad texts."""
    if not patterns:
        return 0.0, []
    share, chances = estimate(patterns)
    return math.log(share / (1 - share)), [{vote: math.log(x / y) for vote, (x, y) in own.items()} for own in chances]


def _odds(prior: float, weights: list[dict[int, float]]) -> Column:
    out = F.lit(float(prior))
    for rule, w in zip(RULES, weights):
        out = out + F.when(F.col(f"_v_{rule}") > 0, float(w[1])).when(F.col(f"_v_{rule}") < 0, float(w[-1])).otherwise(float(w[0]))
    return out


def _learn(votes: DataFrame) -> tuple[float, list[dict[int, float]]]:
    names = [f"_v_{k}" for k in RULES]
    seen = votes.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()  # at most 3 ** rules rows
    return fit([(tuple(r[k] for k in names), r["n"]) for r in seen])


def _voted(documents: DataFrame, keep: list[str]) -> DataFrame:
    return measures(documents, keep).select("*", *(v.alias(f"_v_{k}") for k, v in _votes().items()))


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def assess(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the base counts, base_failed, kept and posterior."""
    judged = staged(_voted(documents, [*keep]).select(*keep, *BASE, *(f"_v_{k}" for k in RULES)), "quality")
    odds = _odds(*_learn(judged))
    return judged.select(*keep, *BASE, (~F.col("base_failed") & (odds >= 0)).alias("kept"), (1 / (1 + F.exp(-odds))).alias("posterior"))


def filter_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that are kept, with all their columns.

    Rows are judged once and written with their votes to the shared folder; the verdict is then an expression on a row.
    """
    row = documents.select(F.struct(*documents.columns).alias("_row"), F.col("text"))
    judged = staged(_voted(row, ["_row"]).select("_row", "base_failed", *(f"_v_{k}" for k in RULES)), "quality-rows")
    return judged.filter(~F.col("base_failed") & (_odds(*_learn(judged)) >= 0)).select("_row.*")
