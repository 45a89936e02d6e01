"""Mixing sources to target weights by temperature."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import placed, stored


@dataclass
class Mixture:
    """exponent, and by source its weight and how often its tokens are used."""

    exponent: float
    weights: dict[str, float]
    repeats: dict[str, float]


def temperature(tokens: dict[str, int], max_repeats: float | None = None, entropy: float | None = None, budget: int | None = None) -> Mixture:
    """Weights in proportion to share ** exponent, for the exponent that meets the one target given.

    The target is the largest number of repeats of a source, or the entropy of the weights in nats. Both fall as the
    exponent grows from 0 (equal weights) over 1 (shares as they are), so bisection finds the flattest mix whose repeats
    stay within the limit, or the mix with that entropy, for which the exponent may be above 1. A target that no exponent
    meets, and two targets at once, are a ValueError. Without a target the weights are equal. Without a budget in tokens,
    it is the least one that uses every source whole at least once. Sources without tokens get weight 0 and are used once.
    """
    if max_repeats is not None and entropy is not None:
        raise ValueError("give max_repeats or entropy, not both")
    total = sum(tokens.values())
    there = {s: math.log(n / total) for s, n in tokens.items() if n > 0}

    def at(exponent: float) -> Mixture:
        if not there:
            return Mixture(exponent, dict.fromkeys(tokens, 0.0), dict.fromkeys(tokens, 1.0))
        top = max(there.values())
        raw = {s: math.exp(exponent * (share - top)) for s, share in there.items()}
        norm = math.fsum(raw.values())
        weights = {s: raw[s] / norm if s in raw else 0.0 for s in tokens}
        whole = budget if budget is not None else max((tokens[s] / weights[s] for s in there if weights[s]), default=0)
        return Mixture(exponent, weights, {s: whole * weights[s] / n if n > 0 else 1.0 for s, n in tokens.items()})

    def measure(m: Mixture) -> float:
        if max_repeats is not None:
            return max((m.repeats[s] for s in there), default=0.0)
        return -math.fsum(w * math.log(w) for w in m.weights.values() if w > 0)

    target = max_repeats if max_repeats is not None else entropy
    flat = at(0.0)
    if target is None or not there:
        return flat
    slack = 1e-9 * max(1.0, abs(target))
    if measure(flat) <= target + slack:
        if entropy is not None and measure(flat) < target - slack:
            raise ValueError(f"equal weights have entropy {measure(flat)}; {target} can't be met")
        return flat
    low, high = 0.0, 1.0
    while measure(at(high)) > target + slack:
        if max_repeats is not None:
            raise ValueError(f"the budget repeats every source {measure(at(1.0))} times; a limit of {target} can't be met")
        low, high = high, 2 * high
        if high > 4096:
            raise ValueError(f"no exponent brings the entropy down to {target}")
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if measure(at(mid)) > target else (low, mid)
    return at(high)


def mix(docs: DataFrame, id_col: str, text_col: str, source_col: str, max_repeats: float | None = None, entropy: float | None = None, budget: int | None = None, seed: int = 1, block_rows: int = 250_000, max_sources: int = 1_000_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """Realise a temperature mixture of the sources as budgeted block permutations.

    Returns a row for each use of a document: id, source, tokens long (white-space-delimited words), epoch int (from 0),
    position long (from 0, in the source's epoch), weight double, and the columns named in `keep`, as <name>_in where
    that is a name of this list. In each epoch the blocks of a source come in another order; whole epochs use every
    document once, the last one stops with the document that reaches the source's budget. Null sources form a source of
    their own; null or empty texts have no tokens and are used in whole epochs; repeated rows are used each, and may
    change places with each other; an empty table gives no rows. Other columns are not read. A target that can't be met
    is a ValueError, as temperature() says. The same files give the same permutation.

    Only one row per source comes to the driver (an error beyond `max_sources`). Texts are read once and what is used
    again is written to the shared folder; documents are dealt by a hash of their id and place to as many blocks as make
    about `block_rows` rows each, 256 at least, so a source with most of the rows, or with one row many times, is spread.
    """
    out = ["id", "source", "tokens", "epoch", "position", "weight"]
    named = [f"{c}_in" if c in (id_col, source_col, *out[2:]) else c for c in keep]
    others = [F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)]
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"\S+")).cast("bigint").alias("tokens"),
        F.when(F.col(source_col).isNull(), "null").otherwise(F.concat(F.lit("is "), F.col(source_col).cast("string"))).alias("_key"), *others,
    )
    rows = placed(rows, "mixed")
    blocks = max(256, -(-rows.count() // block_rows))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), "id", "_seq")).withColumn("_block", F.pmod(F.col("_hash"), F.lit(blocks)).cast("int"))
    sizes = stored(rows.groupBy("_key", "_block").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "blocks")
    spark = docs.sparkSession
    tokens = {r["_key"]: r["t"] for r in sizes.groupBy("_key").agg(F.sum("t").alias("t")).limit(max_sources + 1).collect()}
    if len(tokens) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    mixture = temperature(tokens, max_repeats, entropy, budget)
    plan = []
    for s in sorted(tokens):
        full = math.floor(mixture.repeats[s] + 1e-9)
        rest = max(0.0, mixture.repeats[s] - full) * tokens[s]
        plan.append((s, full, float(rest) if rest >= 1e-6 * max(tokens[s], 1) else 0.0, mixture.weights[s]))
    plan = spark.createDataFrame(plan, "_key string, _full int, _rest double, weight double")
    last = F.col("_full") - F.when(F.col("_rest") > 0, 0).otherwise(1)
    epochs = sizes.join(plan, "_key").where(last >= 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    order = Window.partitionBy("_key", "epoch").orderBy(F.xxhash64(F.lit(seed), "_key", "epoch", "_block"), "_block").rowsBetween(Window.unboundedPreceding, -1)
    epochs = epochs.withColumns({"_t": F.coalesce(F.sum("t").over(order), F.lit(0)), "_n": F.coalesce(F.sum("n").over(order), F.lit(0))})
    # Blocks that begin beyond the budget of a last epoch are left out before rows are joined.
    epochs = epochs.where((F.col("epoch") < F.col("_full")) | (F.col("_t") < F.col("_rest"))).groupBy("_key", "_block").agg(F.collect_list(F.struct("epoch", "_t", "_n", "_full", "_rest", "weight")).alias("_uses"))
    block = Window.partitionBy("_key", "_block").orderBy("_hash", "_seq")
    numbered = rows.withColumns({"_rn": F.row_number().over(block) - 1, "_cum": F.sum("tokens").over(block.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")})
    used = numbered.join(epochs, ["_key", "_block"]).withColumn("_use", F.explode("_uses"))
    used = used.where((F.col("_use.epoch") < F.col("_use._full")) | (F.col("_use._t") + F.col("_cum") < F.col("_use._rest")))
    used = used.withColumns({"epoch": F.col("_use.epoch"), "position": F.col("_use._n") + F.col("_rn"), "weight": F.col("_use.weight")})
    return used.select(*out, *(f"_keep_{i}" for i in range(len(keep)))).toDF(id_col, source_col, *out[2:], *named)
