"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a document's statistics and votes good, votes bad or abstains.  How far a
rule can be trusted is not set by hand: expectation-maximisation estimates, from the votes of
all documents, how often each rule casts each vote on good and on bad documents, and a
document is kept if the posterior probability that it is good is at least one half.  A few
base limits still fail a document outright.

The votes of a corpus have at most 3**len(RULES) patterns.  Estimation runs on the counted
patterns of the documents that pass the base limits, as one SQL expression: a fold whose
state is the prior and the rates, and whose step is one round of expectation and
maximisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import staged

# White space, symbols and base limits as the contract states them.
WORD = r"[^ \t-\r]+"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

# (name, bad if, good if); neither: the rule abstains.  Both are SQL over the statistics.
RULES = [
    ("repeats", "n_repeat_words > 0.4 * n_words", "n_repeat_words < 0.2 * n_words"),
    ("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    ("lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines <= 0.1 * n_lines"),
    ("word_size", "word_chars < 2 * n_words OR word_chars > 15 * n_words",
     "word_chars BETWEEN 3 * n_words AND 12 * n_words"),
    ("marks", "n_symbols > 0.05 * word_chars", "n_symbols < 0.01 * word_chars"),
    ("letters", "n_letters < 0.75 * word_chars", "n_letters > 0.93 * word_chars"),
    ("capitals", "n_upper > 0.4 * n_letters", "n_upper < 0.2 * n_letters"),
]
STEPS = 40


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in the text."""
    def covered(h: Column) -> Column:
        # Windows in order of (hash, place): a repeated one stands beside an equal one.
        def places(s: Column) -> Column:
            twin = lambda e, j: F.coalesce(F.get(s, j)["h"] == e["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda e, j: twin(e, j - 1) | twin(e, j + 1)), lambda e: e["i"]))

        def reach(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_let(_let(pairs, places), reach))

    windows = lambda w: F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
                                    lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return _let(_let(words, windows), covered)


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of the whole ``text`` (null: none)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    only = lambda drop: F.length(F.regexp_replace(text, drop, "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda s: F.regexp_like(s, F.lit(WORD)))
    of_words = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("repeat")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("u")))
    return docs.select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"), only(r"[ \t-\r]+").alias("word_chars"), only(SYMBOLS).alias("n_symbols"),
        only(r"\P{L}+").alias("n_letters"), only(r"\P{Lu}+").alias("n_upper")).select(
        "doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", (F.col("l.n") - F.col("l.u")).alias("n_dup_lines"),
        F.col("w.repeat").alias("n_repeat_words"), F.col("l.n").alias("n_lines"), "n_letters", "n_upper")


def _votes() -> Column:
    """One vote per rule: 0 bad, 1 good, 2 abstains."""
    return F.array(*[F.expr(f"CASE WHEN {bad} THEN 0 WHEN {good} THEN 1 ELSE 2 END") for _, bad, good in RULES])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _posterior(votes: Column, model: Column) -> Column:
    """Probability that a document with these votes is good.  ``model`` is a struct of the
    ``prior`` and of the rates ``good`` and ``bad``, each by rule and vote."""
    at = lambda rates, x, j: F.get(model[rates], 3 * j + x)
    odds = F.log(model["prior"] / (1 - model["prior"])) + _total(
        F.transform(votes, lambda x, j: F.log(at("good", x, j) / at("bad", x, j))))
    return 1 / (1 + F.exp(-odds))


def _step(model: Column, patterns: Column) -> Column:
    """One round: weigh the patterns by their posterior, then count votes again, with one
    document of each kind added to every count."""
    def count(w: Column) -> Column:
        def rates(sums: Column) -> Column:
            def share(kind: str) -> Column:
                one = lambda k: _total(F.transform(w, lambda p: F.when(
                    F.get(p["v"], (k / 3).cast("int")) == k % 3, p[kind]).otherwise(0.0)))
                return F.transform(F.sequence(F.lit(0), F.lit(3 * len(RULES) - 1)), lambda k: (one(k) + 1) / (sums[kind] + 3))

            prior = (sums["g"] + 1) / (sums["g"] + sums["b"] + 2)
            return F.struct(prior.alias("prior"), share("g").alias("good"), share("b").alias("bad"))

        return _let(F.struct(_total(F.transform(w, lambda p: p["g"])).alias("g"),
                             _total(F.transform(w, lambda p: p["b"])).alias("b")), rates)

    def weigh(p: Column) -> Column:
        return _let(_posterior(p["v"], model), lambda good: F.struct(
            p["v"].alias("v"), (p["n"] * good).alias("g"), (p["n"] * (1 - good)).alias("b")))

    return _let(F.transform(patterns, weigh), count)


def estimate(judged: DataFrame) -> DataFrame:
    """One row ``model``: the share of good documents and each rule's rates, estimated from
    ``judged(votes)``.  Rules start as mostly right: a bad vote rare on good documents."""
    start = F.struct(F.lit(0.9).alias("prior"), F.array(*[F.lit(x) for _ in RULES for x in (0.02, 0.68, 0.3)]).alias("good"),
                     F.array(*[F.lit(x) for _ in RULES for x in (0.4, 0.3, 0.3)]).alias("bad"))
    counted = judged.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    return counted.agg(F.sort_array(F.collect_list(F.struct(F.col("votes").alias("v"), "n"))).alias("patterns")).select(
        F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda m, _: _step(m, F.col("patterns"))).alias("model"))


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, ``base_failed``, ``p_good`` and ``kept`` for every row of ``docs(doc_id, text)``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.
    ``kept`` is false there, else whether ``p_good``, the posterior, is 0.5 or more.  A null
    text has no words and fails.  Rows are judged one by one, so a repeated or null doc_id
    does no harm; other columns are ignored; an empty table gives no rows.
    """
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    stats = staged(statistics(docs).withColumn("votes", _votes()).withColumn("base_failed", failed), "rule-votes")
    model = estimate(stats.where("NOT base_failed")).first().model  # a dozen rates per kind
    given = F.struct(F.lit(model.prior).alias("prior"), F.array(*map(F.lit, model.good)).alias("good"),
                     F.array(*map(F.lit, model.bad)).alias("bad"))
    judged = stats.withColumn("p_good", _posterior(F.col("votes"), given))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5)).drop("votes")
