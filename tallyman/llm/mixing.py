"""Temperature mixing of sources, in DataFrame operations only.

Each source's share of all tokens is raised to an exponent from 0 (all alike) to 1 (as they
are) and normalised. The exponent is the largest that meets a target entropy, raised further
where a limit on repetition asks for it; both are monotone, and found by bisection in steps of
2**-20, 32 exponents to a job. The budget is the least at which the source with the largest
share is passed over once, so every document is used, and the others are repeated: whole
passes, and a part of one more up to the source's tokens in the budget. Documents follow each
other in a fixed permutation of their source, dealt to blocks that each hold the sources at
their weights, and every block is permuted anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyman.session import broadcast_if_small, stage

#: Entropy of the weights as a share of the largest possible, and passes over a source at most.
TARGET_ENTROPY = 0.95
MAX_PASSES = 4.0
BLOCK_TOKENS = 1 << 20
SEED = "mix"
#: Exponents are multiples of 1 / STEPS; so many are compared in one job.
STEPS = 1 << 20
ARITY = 32
#: Rows that one window task sums up, about.
RUN_ROWS = 50_000
#: A source's permutation is cut in 2 ** LEAST_BITS ranges at least.
LEAST_BITS = 5


def permuted(seed: str, *parts: Column) -> Column:
    """60 bits of a hash: the place in a permutation. A null part counts as empty."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def find_exponent(shares: DataFrame, target_entropy: float, max_passes: float) -> int:
    """The exponent in steps, for ``shares(p)`` of positive shares; STEPS where one source is all."""
    facts = shares.agg(F.count("*").alias("n"), F.min("p").alias("least"), F.max("p").alias("most")).first()
    if facts.n < 2:
        return STEPS
    aim = target_entropy * math.log(facts.n)

    def largest(feasible) -> int:
        low, step = 0, STEPS // ARITY
        while step:
            tried = [low + k * step for k in range(ARITY + 1) if low + k * step <= STEPS]
            ok = feasible(tried)
            low = max((t for t, good in zip(tried, ok, strict=True) if good), default=low)
            step //= ARITY
        return low

    def rich(tried: list[int]) -> list[bool]:
        power = [F.pow("p", F.lit(t / STEPS)) for t in tried]
        sums = shares.agg(
            *[F.sum(x).alias(f"z{k}") for k, x in enumerate(power)],
            *[F.sum(x * F.ln("p")).alias(f"l{k}") for k, x in enumerate(power)],
        ).first()
        return [
            math.log(sums[f"z{k}"]) - t / STEPS * sums[f"l{k}"] / sums[f"z{k}"] >= aim - 1e-12
            for k, t in enumerate(tried)
        ]

    # Passes over the smallest source are (most / least) ** (1 - exponent).
    spread = facts.most / facts.least
    bound = 1 - math.log(max(max_passes, 1)) / math.log(spread) if spread > 1 else 0
    return max(largest(rich), min(STEPS, math.ceil(max(bound, 0) * STEPS)))


def _plan(rows: DataFrame, target_entropy: float, max_passes: float) -> tuple[DataFrame, DataFrame]:
    """The plan of each source, and its documents' places in its permutation.

    ``rows`` has source, tokens and key. Sources: tokens, quota, passes, and the last key of the
    part of a pass. Units: source, key, and the tokens before it.
    """
    units = stage(rows.groupBy("source", "key").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")), "units")
    totals = stage(
        units.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("units")), "sources"
    )
    facts = totals.agg(F.sum("total").alias("all"), F.max("total").alias("most"), F.sum("units").alias("units")).first()
    shares = totals.filter("total > 0").select((F.col("total") / F.lit(float(facts["all"] or 1))).alias("p"))
    exponent = find_exponent(stage(shares, "shares"), target_entropy, max_passes) / STEPS
    quota = F.floor(F.col("total") * F.pow(F.lit(float(facts["most"] or 1)) / F.col("total"), F.lit(1 - exponent)) + 1e-6)
    plan = totals.withColumn("quota", F.when(F.col("total") > 0, F.greatest(quota, "total")).otherwise(F.lit(0)))
    plan = plan.withColumn("passes", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.col("total"))).otherwise(F.lit(1)))
    plan = plan.withColumn("part", F.col("quota") - F.col("passes") * F.col("total"))
    # Running sums: within ranges of the key, and over the ranges.
    bits = LEAST_BITS + (int(facts["units"] or 0) // RUN_ROWS).bit_length()
    ranged = units.withColumn("range", F.shiftright("key", 60 - bits))
    sums = ranged.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"))
    over = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("source", "range", F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "range").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    running = ranged.withColumn("upto", F.sum("tokens").over(inner)).alias("r")
    met = running.join(bases.alias("b"), F.expr("r.source <=> b.source AND r.range = b.range"))
    places = stage(
        met.select(
            "r.source", "r.key", (F.col("base") + F.col("upto") - F.col("tokens")).alias("before"),
            (F.col("base") + F.col("upto")).alias("after"),
        ),
        "places",
    )
    cuts = (
        places.alias("u")
        .join(broadcast_if_small(plan.select("source", "part")).alias("s"), F.expr("u.source <=> s.source"))
        .filter("after <= part")
        .groupBy("u.source")
        .agg(F.max("key").alias("last_key"))
    )
    plan = plan.alias("s").join(cuts.alias("c"), F.expr("s.source <=> c.source"), "left")
    plan = stage(plan.select("s.source", "total", "quota", "passes", "last_key"), "plan")
    return plan, places


def _rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: str) -> DataFrame:
    return docs.select(
        F.col(f"`{id_col}`").alias("doc"),
        F.col(f"`{source_col}`").alias("source"),
        count_words(F.col(f"`{text_col}`")).alias("tokens"),
        permuted(seed, F.col(f"`{id_col}`")).alias("key"),
    )


def _copies() -> Column:
    """Times that a document is used."""
    part = F.coalesce(F.col("key") <= F.col("last_key"), F.lit(False)).cast("int")
    return (F.col("passes").cast("int") + part).cast("int")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float = TARGET_ENTROPY,
    max_passes: float = MAX_PASSES,
    block_tokens: int = BLOCK_TOKENS,
    seed: str = SEED,
) -> DataFrame:
    """A row per use of a document: id, source, n_tokens, pass, block and position.

    Tokens are words between white space. ``pass`` counts a document's uses from 0, ``block``
    the blocks of about ``block_tokens`` tokens, ``position`` the rows of a block from 0. Every
    row of ``docs`` is used at least once and at most ``ceil(max_passes)`` times. A null source
    is a source; null and empty texts have no tokens and are used once per pass; a source
    without tokens is passed once. Rows with one id share a place in the permutation and are
    used alike. An empty table gives no rows; other columns are not looked at.
    """
    rows = stage(_rows(docs, id_col, source_col, text_col, seed), "mix-rows")
    plan, places = _plan(rows, target_entropy, max_passes)
    budget = plan.agg(F.sum("quota").alias("q")).first()["q"] or 0
    blocks = max(1, -(-int(budget) // block_tokens))
    used = rows.alias("d").join(places.alias("u"), F.expr("d.source <=> u.source AND d.key = u.key"))
    used = used.select("d.doc", "d.source", "d.tokens", "d.key", "u.before")
    used = used.alias("d").join(broadcast_if_small(plan).alias("s"), F.expr("d.source <=> s.source"))
    used = used.select("d.*", "total", "quota", F.explode(F.sequence(F.lit(0), _copies() - 1)).alias("pass"))
    at = (F.col("pass") * F.col("total") + F.col("before")) / F.col("quota") * F.lit(float(blocks))
    block = F.when(F.col("quota") > 0, F.least(F.floor(at), F.lit(blocks - 1))).otherwise(F.lit(0))
    used = used.withColumn("block", block.cast("long")).withColumn(
        "order", permuted(seed + "-block", F.col("doc"), F.col("pass"))
    )
    # A block holds a bounded number of tokens, but any number of rows without: these go apart.
    part = F.when(F.col("tokens") > 0, F.lit(0)).otherwise(1 + F.pmod(F.col("order"), F.lit(1024)))
    used = used.withColumn("part", part)
    sums = used.groupBy("block", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("block", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("block", "part").orderBy("order", "doc", "tokens", "source")
    return (
        used.withColumn("row", F.row_number().over(inner))
        .join(bases, ["block", "part"])
        .select(
            F.col("doc").alias(id_col),
            F.col("source").alias(source_col),
            F.col("tokens").alias("n_tokens"),
            "pass",
            "block",
            (F.col("base") + F.col("row") - 1).alias("position"),
        )
    )


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    target_entropy: float = TARGET_ENTROPY,
    max_passes: float = MAX_PASSES,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` with each row as often as the mixture uses it; columns as they are."""
    plan, _ = _plan(_rows(docs, id_col, source_col, text_col, seed), target_entropy, max_passes)
    plan = plan.select(F.col("source").alias("__source"), "passes", "last_key")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = keyed.withColumn("key", permuted(seed, F.col(f"row.`{id_col}`")))
    met = keyed.join(broadcast_if_small(plan), F.col(f"row.`{source_col}`").eqNullSafe(F.col("__source")))
    used = met.select("row", F.explode(F.sequence(F.lit(1), _copies())).alias("n"))
    return used.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
