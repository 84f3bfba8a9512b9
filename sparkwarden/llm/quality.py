"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a few counts of a text and votes for keeping it (1), against it (-1) or abstains (0).
How far each rule can be trusted is not set by hand: the votes of all documents are counted by pattern, and
expectation-maximisation over those counts (a row for each pattern that occurs, at most 3 ** rules)
estimates each rule's accuracy.  A document's posterior probability of quality follows from its votes.  All estimation is one expression over one row of pattern counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import SPACES, stored, words

#: Words in a window whose repetition counts.
WINDOW = 5

#: rule -> (condition against, condition for), either may be missing; where none holds, the rule abstains.
#: Over the columns of ``measured``.  That a text lacks a fault is no vote for it: only the last two rules, which ask for all signs of prose at once, vote for.
RULES: dict[str, tuple[str | None, str | None]] = {
    "symbols": ("10 * n_symbols > n_words", None),
    "shouting": ("10 * n_capitals > 3 * word_chars or 10 * n_shouts > n_words", None),
    "repetition": ("4 * n_repeat_words > n_words or (10 * n_distinct < n_words and n_words <= 1000)", None),
    "lines": ("2 * n_dup_lines > n_lines", None),
    "word_length": ("word_chars > 20 * n_words or word_chars < 2 * n_words", None),
    "line_length": ("n_words < 2 * n_lines", None),
    "prose": (None, "50 * n_symbols <= n_words and 50 * n_shouts <= n_words and 20 * n_capitals <= 3 * word_chars and 10 * n_repeat_words <= n_words"),
    "plain": (None, "n_symbols = 0 and n_dup_lines = 0 and 100 * n_shouts <= n_words and word_chars between 3 * n_words and 12 * n_words"),
}

#: Accuracy that each rule starts from, and the votes' worth of it that stays in the estimate.
START_ACCURACY = 0.9
START_VOTES = 10
#: Share of good documents before any vote.
PRIOR_GOOD = 0.5
ROUNDS = 25


#: Columns that ``judged`` adds; it replaces columns of ``docs`` with these names.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_capitals", "n_shouts"]
MADE = [*COUNTS, "base_failed", "votes", "quality", "kept"]


def measured(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts of every document beside its own columns (prefix ``_m`` is taken).

    A null text counts as empty.  Windows are told apart by 64-bit hashes within one text.
    """
    docs = docs.drop(*MADE)
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("*", words(F.col("text")).alias("_mw"))
    df = df.withColumn("_mn", F.size("_mw").cast("long"))
    shifted = [F.slice("_mw", i + 1, F.greatest(F.size("_mw") - window + 1, F.lit(0))) for i in range(window)]
    hashes = F.transform(F.arrays_zip(*shifted), lambda s: F.xxhash64(s))
    df = df.withColumn("_mh", hashes)
    by_hash = F.sort_array(F.transform("_mh", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))
    # Sorted by hash, a window is repeated if it equals a neighbour: fold over the sorted list and keep those places.
    df = df.withColumn("_mr", F.size(F.array_distinct("_mh")) < F.size("_mh")).withColumn("_ms", F.when(F.col("_mr"), by_hash))
    df = df.withColumn("_mz", F.when(F.col("_mr"), F.arrays_zip(F.col("_ms").alias("a"), F.slice("_ms", 2, F.size("_ms")).alias("b"))))
    pairs = F.filter("_mz", lambda z: z["a"]["h"] == z["b"]["h"])
    places = F.sort_array(F.array_distinct(F.flatten(F.transform(pairs, lambda z: F.array(z["a"]["i"], z["b"]["i"])))))
    covered = F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).cast("long").alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(window).cast("long"), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.withColumn("_ml", lines)
    return df.select(
        *docs.columns,
        F.col("_mn").alias("n_words"),
        F.length(F.array_join("_mw", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_ml") - F.size(F.array_distinct("_ml"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_ml").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_mw")).cast("long").alias("n_distinct"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"),
    )


def base_failed() -> Column:
    """Too few words, or more than a fifth of them in repeated windows."""
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def votes(rules: dict[str, tuple[str | None, str | None]]) -> Column:
    """One vote per rule, in order."""
    return F.array(*[F.expr(f"case when {bad or 'false'} then -1 when {good or 'false'} then 1 else 0 end") for bad, good in rules.values()])


def estimated(counts: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """One row: ``weights`` array<double>, the log odds log(accuracy / (1 - accuracy)) of each rule.

    ``counts`` has a row for each pattern: votes array<int>, n long.  E-step: the posterior of a pattern from
    the accuracies of the rules that vote in it.  M-step: a rule's accuracy is the share of its votes that agree
    with the posterior.  Without documents the start stays.
    """
    one = counts.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("patterns"))
    posterior = f"transform(patterns, x -> struct(x.votes as votes, x.n as n, 1 / (1 + exp(-({_odds('w', 'x.votes')}))) as p))"
    right = "aggregate(q, 0D, (s, x) -> s + x.n * case x.votes[r] when 1 then x.p when -1 then 1 - x.p else 0D end)"
    wrong = "aggregate(q, 0D, (s, x) -> s + x.n * case x.votes[r] when 1 then 1 - x.p when -1 then x.p else 0D end)"
    weight = f"log(({right} + {START_VOTES * START_ACCURACY:.6f}D) / ({wrong} + {START_VOTES * (1 - START_ACCURACY):.6f}D))"
    step = f"transform(array({posterior}), q -> transform(sequence(0, {n_rules - 1}), r -> {weight}))[0]"
    start = f"array_repeat(log({START_ACCURACY}D / (1 - {START_ACCURACY}D)), {n_rules})"
    return one.select(F.expr(f"aggregate(sequence(1, {rounds}), {start}, (w, i) -> {step})").alias("weights"))


def _odds(weights: str, votes_of: str) -> str:
    return f"log({PRIOR_GOOD}D / (1 - {PRIOR_GOOD}D)) + aggregate(sequence(0, size({votes_of}) - 1), 0D, (s, r) -> s + {weights}[r] * {votes_of}[r])"


def judged(docs: DataFrame, rules: dict[str, tuple[str | None, str | None]] | None = None, least: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed``, ``votes``, ``quality`` (posterior, 0 to 1) and ``kept``.

    ``kept`` is false where ``base_failed``, else whether ``quality`` is at least ``least``.  Equal rows get equal
    results; an empty table gives an empty one.
    """
    rules = rules or RULES
    counted = stored(measured(docs).withColumn("base_failed", base_failed()).withColumn("votes", votes(rules)), "measured")
    patterns = counted.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    weights = estimated(patterns, len(rules), rounds)
    joined = counted.crossJoin(F.broadcast(weights))  # one row of numbers
    odds = F.expr(_odds("weights", "votes"))
    scored = joined.withColumn("quality", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least)).drop("weights")
