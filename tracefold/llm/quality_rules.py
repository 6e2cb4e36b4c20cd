"""Quality rules (operator 7, native): weak supervision instead of all-must-pass filtering.

Each rule votes good (+1), bad (-1) or abstains (0). Documents enter the model only as counts of vote
patterns (at most 3 to the number of rules). Expectation-maximisation over these counts estimates each
rule's accuracy and the share of good documents, with no labels; a document's verdict is its posterior
probability of being good. Everything over documents is DataFrame and SQL functions, and so is each
step of the estimation, over a local relation of the patterns.

Defined cases: a null text has no words and fails the base check; texts of fewer than three words have
no windows; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
Windows are told apart by a 64-bit hash of their three words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.llm.common import materialise

#: Steps of the estimation, and its start: the share of good documents and what a vote means in either class.
STEPS, PRIOR_GOOD = 25, 0.85
START = {"good": {1: 0.75, 0: 0.24, -1: 0.01}, "bad": {1: 0.35, 0: 0.35, -1: 0.30}}
#: Pseudo-documents with the starting votes, as a share of all: small corpora stay near the start.
PSEUDO = 0.02
KEEP_AT = 0.5
#: Frequent function words of the languages at hand; a text of some length has one of them.
FUNCTION_WORDS = ("the of and to in is that for it as with was on be by der die und das den von zu mit ist ein "
                  "de la le les et des que en un une est los el las por con para").split()

#: Rule name -> (votes bad where, votes good where); else it abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 50", "n_words >= 80"),
    "repeats": ("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "lines": ("10 * n_dup_lines > 3 * n_lines", "n_lines >= 3 AND 20 * n_dup_lines <= n_lines"),
    "capitals": ("10 * n_capitals > 4 * word_chars", "10 * n_capitals <= word_chars"),
    "shouting": ("10 * n_marks > n_words", "50 * n_marks <= n_words"),
    "word_length": ("word_chars < 3 * n_words OR word_chars > 15 * n_words", "word_chars BETWEEN 4 * n_words AND 10 * n_words"),
    "variety": ("n_words >= 50 AND 10 * n_distinct < 2 * n_words", "10 * n_distinct >= 3 * n_words"),
    "function_words": ("n_words >= 50 AND n_function = 0", "n_function >= 3"),
}


def _in_row(df: DataFrame, name: str, sql: str) -> DataFrame:
    """A column evaluated once for each row: a Generate, which no later lambda can take the expression out of."""
    return df.select("*", F.explode(F.array(F.expr(sql))).alias(name))


def text_measures(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures and what else the rules look at. No shuffle: each row by itself."""
    df = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.select(
        "doc_id",
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit(r"[!?]{2,}|\.{3,}|\*{2,}")).cast("long").alias("n_marks"),
        F.explode(F.array(F.struct(
            F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')").alias("words"),
            F.expr(r"filter(split(text, '\\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        ))).alias("t"),
    )
    df = df.select(
        "doc_id", "n_symbols", "n_capitals", "n_marks",
        F.size("t.words").cast("long").alias("n_words"),
        F.length(F.array_join("t.words", "")).cast("long").alias("word_chars"),
        F.size("t.lines").cast("long").alias("n_lines"),
        (F.size("t.lines") - F.size(F.array_distinct("t.lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("t.words")).cast("long").alias("n_distinct"),
        F.size(F.array_intersect("t.words", F.array(*map(F.lit, FUNCTION_WORDS)))).cast("long").alias("n_function"),
        F.col("t.words").alias("words"),
    )
    # windows as (hash, place), sorted: equal ones become neighbours
    df = _in_row(df, "grams", "sort_array(IF(n_words < 3, CAST(array() AS array<struct<h:bigint,i:int>>), transform(sequence(0, int(n_words) - 3), i -> struct(xxhash64(words[i], words[i + 1], words[i + 2]) AS h, i AS i))))").drop("words")
    df = _in_row(df, "places", "sort_array(filter(transform(grams, (g, k) -> IF(coalesce(get(grams, k - 1).h = g.h, false) OR coalesce(get(grams, k + 1).h = g.h, false), g.i, NULL)), i -> i IS NOT NULL))").drop("grams")
    covered = "IF(size(places) = 0, 0, 3 + IF(size(places) = 1, 0, aggregate(sequence(1, size(places) - 1), 0, (n, k) -> n + least(3, places[k] - places[k - 1]))))"
    return df.withColumn("n_repeat_words", F.expr(covered).cast("long")).drop("places")


def votes(measures: DataFrame) -> DataFrame:
    """The measures with one TINYINT column for each rule."""
    return measures.select("*", *(F.expr(f"CAST(CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS tinyint)").alias(f"rule_{r}") for r, (bad, good) in RULES.items()))


def estimate(spark: SparkSession, patterns: list[tuple[tuple[int, ...], int]], steps: int = STEPS) -> dict:
    """The label model from (votes, documents) counts: the share of good ones and, by class, each rule's vote shares."""
    k = len(RULES)
    model = {"prior": PRIOR_GOOD, **{c: [dict(START[c]) for _ in range(k)] for c in START}}
    if not patterns:
        return model
    rows = ", ".join(f"({', '.join(map(str, v))}, {n}D)" for v, n in patterns)
    names = [f"rule_{r}" for r in RULES]
    sums = ", ".join(f"sum(IF({r} = {v}, n * {part}, 0)) AS `{c}_{j}_{v}`" for j, r in enumerate(names) for v in (-1, 0, 1) for c, part in (("good", "p"), ("bad", "(1 - p)")))
    extra = PSEUDO * sum(n for _, n in patterns)
    for _ in range(steps):
        got = spark.sql(f"SELECT sum(n * p) AS good, sum(n) AS total, {sums} FROM (SELECT *, {posterior_sql(model)} AS p FROM VALUES {rows} AS t({', '.join(names)}, n))").first()
        weight = {"good": got.good, "bad": got.total - got.good}
        model = {"prior": (got.good + extra * PRIOR_GOOD) / (got.total + extra)} | {
            c: [{v: (got[f"{c}_{j}_{v}"] + extra * START[c][v]) / (weight[c] + extra) for v in (-1, 0, 1)} for j in range(k)] for c in START
        }
    return model


def posterior_sql(model: dict) -> str:
    """Probability that a document with these votes is good."""
    from math import log

    terms = [repr(log(model["prior"] / (1 - model["prior"])))]
    for j, r in enumerate(RULES):
        ratio = {v: log(model["good"][j][v] / model["bad"][j][v]) for v in (-1, 0, 1)}
        terms.append(f"CASE rule_{r} WHEN 1 THEN {ratio[1]!r}D WHEN -1 THEN {ratio[-1]!r}D ELSE {ratio[0]!r}D END")
    return f"(1D / (1D + exp(-({terms[0]}D + {' + '.join(terms[1:])}))))"


def judge_quality(docs: DataFrame, keep_at: float = KEEP_AT) -> DataFrame:
    """Per document: the base measures, base_failed, the posterior and whether it is kept."""
    spark = docs.sparkSession
    voted = materialise(votes(text_measures(docs)), "votes")
    names = [f"rule_{r}" for r in RULES]
    counted = voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 to the number of rules
    model = estimate(spark, sorted((tuple(int(x) for x in r[:-1]), r.n) for r in counted))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.expr(posterior_sql(model)).alias("p_good"), *names,
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= keep_at))
