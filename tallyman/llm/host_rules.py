"""Quality rules on documents and on their hosts, in DataFrame operations only.

Each text is measured and checked by rules. Failures are counted by host, and a host's rate of
failing documents is shrunk towards that of all hosts by a beta prior, whose mean and strength
come from the spread of the hosts' rates: a host of few documents is judged mostly by the
others. The host's verdict goes back to its documents. Where a host is blocked they all go;
on a trusted host a document needs to pass the base rules only; elsewhere it has to pass all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.session import broadcast_if_small, stage

#: Shrunk rates of failing documents: a host above the first is blocked, below the second trusted.
BLOCK_RATE = 0.8
TRUST_RATE = 0.02
#: Base rules: fewer words, or a larger percentage of words in repeated windows of three.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Further rules: signs for 100 words; percentage of lines that repeat an earlier one, if so many
#: do at least (a heading or notice that stands twice in a short text is no fault).
MAX_SYMBOLS_PER_100 = 30
MAX_DUP_LINE_PERCENT = 30
LEAST_DUP_LINES = 4
#: Strength of the prior if the hosts' rates don't differ more than chance.
STRONGEST_PRIOR = 1e6

_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\f\r"


def measure(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words.

    Steps are projections of their own, so that an array used in a lambda is made once per row.
    """
    whole = F.coalesce(text, F.lit(""))
    words = docs.select("*", whole.alias("__text")).select(
        "*", F.regexp_extract_all("__text", F.lit(f"({_WORD})"), F.lit(1)).alias("__words")
    )
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(_WORD))
    at = F.sequence(F.lit(0), F.size("__words") - 3)
    window = lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2))
    measured = words.select(
        "*",
        lines.alias("__lines"),
        F.when(F.size("__words") >= 3, F.transform(at, window)).otherwise(F.array().cast("array<long>")).alias("__windows"),
    )
    # Windows in the order of their hash; equal ones are neighbours there.
    sorted_ = F.sort_array(F.transform("__windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    measured = measured.select("*", F.when(repeats, sorted_).alias("__sorted"))
    same = lambda x, k: (
        F.coalesce(F.get("__sorted", k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("__sorted", k + 1)["h"] == x["h"], F.lit(False))
    )
    covered = F.transform(
        F.filter("__sorted", same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)
    )
    count = lambda c: c.cast("long")
    return measured.select(
        *docs.columns,
        count(F.size("__words")).alias("n_words"),
        count(F.length(F.translate("__text", _SPACES, ""))).alias("word_chars"),
        count(F.regexp_count("__text", F.lit("[#*$%&|<>]"))).alias("n_symbols"),
        count(F.size("__lines")).alias("n_lines"),
        count(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        count(F.coalesce(F.size(F.array_distinct(F.flatten(covered))), F.lit(0))).alias("n_repeat_words"),
    )


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    block_rate: float = BLOCK_RATE,
    trust_rate: float = TRUST_RATE,
) -> DataFrame:
    """A row per document: id, its measures, base_failed, kept, failed, host_rate.

    Words are runs between white space. A null text is empty and fails the base rules. Without
    a host (null) a document has to pass all rules, and ``host_rate`` is null. Every row counts
    for its host, repeated rows and null ids too. An empty table gives no rows; columns other
    than the three named are not looked at.
    """
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.col(f"`{host_col}`").cast("string").alias("__host"), F.col(f"`{text_col}`").alias("__own")
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    more = (100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100 * F.col("n_words")) | (
        (F.col("n_dup_lines") >= LEAST_DUP_LINES)
        & (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines"))
    )
    measured = stage(
        measure(rows, F.col("__own")).drop("__own").withColumn("base_failed", base).withColumn("failed", base | more),
        "measured",
    )
    hosts = stage(
        measured.filter("__host IS NOT NULL")
        .groupBy("__host")
        .agg(F.count("*").alias("n"), F.sum(F.col("failed").cast("long")).alias("bad")),
        "hosts",
    )
    rate = F.col("bad") / F.col("n")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread")).first()
    mean, spread = prior["mean"] or 0.0, prior["spread"] or 0.0
    strength = mean * (1 - mean) / spread - 1 if spread > 0 else STRONGEST_PRIOR
    strength = min(max(strength, 1.0), STRONGEST_PRIOR)
    shrunk = (F.col("bad") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    verdicts = broadcast_if_small(hosts.select("__host", shrunk.alias("host_rate")))
    met = measured.join(verdicts, "__host", "left")
    passed = (
        F.when(F.col("host_rate") > block_rate, F.lit(False))
        .when(F.col("host_rate") < trust_rate, F.lit(True))
        .otherwise(~F.col("failed"))
    )
    return met.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", (~F.col("base_failed") & passed).alias("kept"), "failed", "host_rate",
    )
