"""Quality rules as weak supervision (operator 9), in DataFrame functions only.

Each rule votes for good (+1), for bad (-1), or abstains (0).  Expectation-maximisation over the
counts of vote patterns estimates how often each rule votes what on good documents and on bad ones, and
the share of each; a document is kept if its posterior probability of being good is 0.5 or more.  Bad
documents form one class for each family of faults: faults mostly come alone, so one class for all of them would
contradict the independence that the estimation rests on, and a fault met alone would pass for good.
There are at most 3**7 = 2187 patterns however many documents there are.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.llm.common import op_query, table
from sharetide.session import stage

BLANK = r"[\x20\x09-\x0D]+"
EM_ROUNDS = 12
FAULTS = {"symbols": ["symbols"], "shouting": ["shouts", "capitals"], "repetition": ["repeats", "lines"], "shape": ["word_length", "length"]}
BELIEF = 0.9  # where the estimation starts: certainty that a document is bad if any rule objects, else good


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Words within 3-word windows that occur twice or more in the text.

    Windows are sorted by hash (64 bits), so equal ones meet; ``covered`` are word positions.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    windows = F.array_sort(F.transform(at, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))
    found = let(
        windows,
        lambda w: F.transform(
            F.filter(
                F.transform(w, lambda x, j: F.struct(x["i"].alias("i"), (F.get(w, j - 1)["h"].eqNullSafe(x["h"]) | F.get(w, j + 1)["h"].eqNullSafe(x["h"])).alias("twice"))),
                lambda x: x["twice"],
            ),
            lambda x: x["i"],
        ),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))
    return F.when(n >= 3, covered).otherwise(0)


def measures(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without its text, with the measured columns; a null text counts as empty."""
    text = F.coalesce(F.col(column), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    per_text = docs.select(
        *[c for c in docs.columns if c != column],
        let(
            F.filter(F.split(text, BLANK, -1), lambda x: x != ""),
            lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _repeated(w).alias("n_repeat_words")),
        ).alias("_w"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("_l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?]")).alias("n_shouts"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).alias("n_upper"),
    )
    long = lambda c: F.col(c).cast("bigint")
    return per_text.select(
        *[c for c in docs.columns if c != column],
        long("_w.n_words").alias("n_words"),
        long("_w.word_chars").alias("word_chars"),
        long("n_symbols").alias("n_symbols"),
        long("_l.n_dup_lines").alias("n_dup_lines"),
        long("_w.n_repeat_words").alias("n_repeat_words"),
        long("_l.n_lines").alias("n_lines"),
        long("n_shouts").alias("n_shouts"),
        long("n_upper").alias("n_upper"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def votes() -> dict[str, Column]:
    """The rules.  Most only object or abstain: that a text lacks one fault says nothing of the others."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))

    def objection(value: Column, limit: float) -> Column:
        return F.when(value > limit, -1).otherwise(0)

    mean = F.col("word_chars") / words
    return {
        "symbols": objection(F.col("n_symbols") / words, 0.15),
        "shouts": objection(F.col("n_shouts") / words, 0.30),
        "capitals": objection(F.col("n_upper") / chars, 0.25),
        "repeats": objection(F.col("n_repeat_words") / words, 0.40),
        "lines": objection(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), 0.30),
        "word_length": F.when((mean < 2) | (mean > 14), -1).when((mean >= 3) & (mean <= 10), 1).otherwise(0),
        "length": F.when(F.col("n_words") < 20, -1).when(F.col("n_words") >= 80, 1).otherwise(0),
    }


def _posteriors(model: dict) -> Column:
    """Probabilities of the classes, in their order, given the votes."""

    def log_joint(kind: str) -> Column:
        share, chances = model[kind]
        terms = [F.element_at(F.array(*[F.lit(log(p)) for p in ps]), F.col(f"v_{r}") + 2) for r, ps in chances.items()]
        return reduce(lambda x, y: x + y, terms, F.lit(log(share)))

    joint = F.array(*[log_joint(k) for k in model])
    parts = let(joint, lambda j: F.transform(j, lambda x: F.exp(x - F.array_max(j))))
    return let(parts, lambda p: F.transform(p, lambda x: x / F.aggregate(p, F.lit(0.0), lambda acc, y: acc + y)))


def _first_guess() -> Column:
    """A document is probably bad in the ways to which any rule objects, and good if none does."""
    objects = {k: reduce(lambda x, y: x | y, [F.col(f"v_{r}") == -1 for r in rules]).cast("double") for k, rules in FAULTS.items()}
    ways = reduce(lambda x, y: x + y, objects.values())
    bad = {k: F.when(ways > 0, BELIEF * o / ways).otherwise((1 - BELIEF) / len(FAULTS)) for k, o in objects.items()}
    return F.array(F.when(ways > 0, 1 - BELIEF).otherwise(BELIEF), *bad.values())


def fit(patterns: DataFrame, rules: list[str], rounds: int = EM_ROUNDS) -> dict:
    """Expectation-maximisation over ``patterns`` (v_<rule> columns and ``n``): one small aggregate a round.

    Returns, by class, its share and by rule the chances of the votes -1, 0, +1.
    """
    kinds, model = ["good", *FAULTS], None
    for _ in range(rounds):
        p = _posteriors(model) if model else _first_guess()
        votes_cast = F.posexplode(F.array(*[F.col(f"v_{r}") for r in rules])).alias("rule", "vote")
        sums = patterns.withColumn("p", p).select(votes_cast, *[(F.col("n") * F.col("p")[i]).alias(k) for i, k in enumerate(kinds)]).groupBy("rule", "vote").agg(*[F.sum(k).alias(k) for k in kinds]).collect()
        s = {f"{k}/{rules[r['rule']]}/{r['vote']}": r[k] for r in sums for k in kinds}
        s |= {k: sum(r[k] for r in sums if r["rule"] == 0) for k in kinds}
        total = sum(s[k] for k in kinds)
        model = {
            k: ((s[k] + 1) / (total + len(kinds)), {r: [(s.get(f"{k}/{r}/{v}", 0.0) + 0.1) / (s[k] + 0.3) for v in (-1, 0, 1)] for r in rules})
            for k in kinds
        }
    return model


def judge(docs: DataFrame, column: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs`` without its text, with its measures, ``p_good``, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail.  Repeated rows and ids are judged row by row.  An
    empty table gives an empty table.
    """
    measured = stage(measures(docs, column), "quality")
    rules = votes()
    voted = measured.select("*", *[c.alias(f"v_{r}") for r, c in rules.items()])
    patterns = stage(voted.groupBy(*[f"v_{r}" for r in rules]).agg(F.count("*").alias("n")), "patterns")
    model = fit(patterns, list(rules))
    return voted.withColumn("p_good", _posteriors(model)[0]).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).drop(*[f"v_{r}" for r in rules])


@op_query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
