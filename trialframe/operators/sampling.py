"""Batch tables and augmentation. Batches hold keys only; signals are joined late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialframe.functions.columns import hash_normal, hash_unit, let
from trialframe.operators.ordinal import hash_ordinal, ordinal


def stratified_batches(df: DataFrame, concept: str, key: str, batch: int, seed=0) -> DataFrame:
    """Round-robin over concepts, shuffled inside each; cut in batches, every row once."""
    d = hash_ordinal(df.select(concept, key), [concept], seed, [key], "_r")
    # round numbers thin out geometrically when one concept is far larger than the rest, so buckets grow with them
    d = ordinal(d, [], ["_r", concept], F.floor(256 * F.log2(F.col("_r") + 1)), "pos")
    return d.select(concept, key, "pos", F.floor(F.col("pos") / batch).alias("batch"))


def _concepts(df: DataFrame, concept: str) -> DataFrame:
    """(concept, n rows, dense id)."""
    sizes = df.groupBy(concept).agg(F.count(F.lit(1)).alias("n"))
    return ordinal(sizes, [], [concept], F.floor(F.col(concept) / 1024), "cid")


def batch_count(df: DataFrame, concept: str, per_batch: int, samples: int) -> tuple[int, int, int]:
    """(batches of one pass, concepts per batch, number of concepts)."""
    row = df.groupBy(concept).agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.count(F.lit(1))).head()
    if not row[0]:
        raise ValueError("no rows to sample")
    p = min(per_batch, row[1])
    return max(1, row[0] // (p * samples)), p, row[1]


def draw_rows(df: DataFrame, chosen: DataFrame, concept: str, key: str, samples: int, seed) -> DataFrame:
    """``samples`` rows per (batch, concept, n): consecutive rows of the concept's shuffle from a random start, which
    repeat only when the concept has fewer rows than asked for."""
    start = F.floor(hash_unit(f"{seed}/start", "batch", concept) * F.col("n"))
    slots = chosen.withColumn("_s", start).select("batch", concept, "n", "_s", F.explode(
        F.sequence(F.lit(0), F.lit(samples - 1))).alias("slot"))
    slots = slots.withColumn("_pos", (F.col("_s") + F.col("slot")) % F.col("n"))
    rows = hash_ordinal(df.select(concept, key), [concept], f"{seed}/row", [key], "_pos")
    return slots.join(rows, [concept, "_pos"]).select("batch", concept, "slot", key)


def balanced_batches(df: DataFrame, concept: str, key: str, per_batch: int, samples: int, seed=0,
                     n_batches: int | None = None) -> DataFrame:
    """Every batch: ``per_batch`` different concepts × ``samples`` rows.

    A round is one shuffle of all concepts and serves floor(K / P) batches, so the table of choices has about
    batches × P rows and never batches × K.
    """
    count, p, k = batch_count(df, concept, per_batch, samples)
    count = n_batches or count
    per_round = k // p
    rounds = -(-count // per_round)
    c = _concepts(df, concept).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    c = hash_ordinal(c, ["round"], seed, ["round", concept], "_at")
    c = c.filter(F.col("_at") < per_round * p).withColumn("batch", F.col("round") * per_round + F.floor(F.col("_at") / p))
    return draw_rows(df, c.filter(F.col("batch") < count), concept, key, samples, seed)


def hard_batches(df: DataFrame, neighbours: DataFrame, concept: str, key: str, per_batch: int, samples: int, seed=0,
                 n_batches: int | None = None) -> DataFrame:
    """Every batch: a seed concept and its nearest neighbours among the present ones, padded with random concepts.
    ``neighbours(concept, place, neighbour)``."""
    count, p, k = batch_count(df, concept, per_batch, samples)
    count = n_batches or count
    c = _concepts(df, concept)
    b = df.sparkSession.range(count).select(F.col("id").alias("batch"))
    b = b.withColumn("_cid", F.floor(hash_unit(f"{seed}/seed", "batch") * k))
    seeds = b.join(c.select(F.col("cid").alias("_cid"), F.col(concept).alias("_seed")), "_cid")
    ranked = F.array_sort(F.collect_list(F.struct("place", F.col("neighbour").alias("c"))))
    present = neighbours.join(c.select(F.col(concept).alias("neighbour")), "neighbour", "left_semi")
    near = present.groupBy(F.col("concept").alias("_seed")).agg(ranked.alias("_near"))
    pad0 = F.floor(hash_unit(f"{seed}/pad", "batch") * k)
    cand = seeds.join(near, "_seed", "left").withColumn("_cand", F.concat(
        F.array(F.struct(F.lit(-1).cast("bigint").alias("prio"), F.col("_seed").cast("bigint").alias("c"))),
        F.coalesce(F.transform("_near", lambda e: F.struct(e["place"].cast("bigint").alias("prio"),
                                                           e["c"].cast("bigint").alias("c"))),
                   F.array().cast("array<struct<prio:bigint,c:bigint>>"))))
    known = cand.select("batch", F.explode("_cand").alias("e")).select("batch", "e.prio", F.col("e.c").alias(concept))
    pads = cand.select("batch", F.explode(F.sequence(F.lit(0), F.lit(2 * p - 1))).alias("_j"), pad0.alias("_p0"))
    pads = pads.select("batch", (F.lit(1 << 40) + F.col("_j")).alias("prio"), ((F.col("_p0") + F.col("_j")) % k).alias("cid"))
    pads = pads.join(c.select("cid", F.col(concept).cast("bigint").alias(concept)), "cid").select("batch", "prio", concept)
    best = known.unionByName(pads).groupBy("batch", concept).agg(F.min("prio").alias("prio"))
    w = W.partitionBy("batch").orderBy("prio")
    chosen = best.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= p)
    chosen = chosen.join(c.select(F.col(concept).cast("bigint").alias(concept), "n"), concept).select("batch", concept, "n")
    return draw_rows(df.withColumn(concept, F.col(concept).cast("bigint")), chosen, concept, key, samples, seed)


def epoch_subsample(df: DataFrame, key: str, frac: float, batch: int, epoch: int, seed=0) -> DataFrame:
    """min(n, max(batch, int(n·frac))) rows without replacement, another draw for every training epoch."""
    d = hash_ordinal(df, [], f"{seed}/{epoch}", [key], "_pos", "_n")
    m = F.least(F.col("_n"), F.greatest(F.lit(batch), F.floor(F.col("_n") * frac)))
    return d.filter(F.col("_pos") < m).drop("_pos", "_n")


# ---- domain randomization --------------------------------------------------------------------------------------

# fixed values: systemic rhythms in Hz (blood-pressure wave, breathing, heart)
SYSTEMIC_HZ = (0.1, 0.25, 1.1)


def domain_randomize(df: DataFrame, key: list[str], fs: float, copies: int, seed=0, gain_sigma: float = 0.2,
                     systemic_amp: float = 0.3, max_shift_s: float = 1.0, x: str = "x") -> DataFrame:
    """Randomized copies of the train rows, appended (``copy`` = 0 is the original). Per copy: a log-normal gain per
    channel, common-mode oscillations at random phase with a linear drift that is the same in both chromophores (channel c and c + C/2), and a
    circular shift of at most ``max_shift_s``."""
    numbers = F.when(F.col("part") == "train", F.sequence(F.lit(0), F.lit(copies))).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("copy", F.explode(numbers))
    half = (F.size(x) / 2).cast("int")
    n = F.size(F.col(x)[0])
    k = int(max_shift_s * fs)
    shift = (F.floor(hash_unit(f"{seed}/shift", *key, "copy") * (2 * k + 1)) - k).cast("int")
    span = F.greatest(n - 1, F.lit(1))

    def mode(pair):
        """What both chromophores of a place share: the gain, and the oscillations with their drift over time."""
        phases = [2 * F.pi() * hash_unit(f"{seed}/phase{j}", *key, "copy", pair) for j in range(len(SYSTEMIC_HZ))]
        drift = hash_normal(f"{seed}/drift", *key, "copy", pair)

        def added(h, i):
            wave = sum((F.sin(2 * F.pi() * hz / fs * i + h[f"p{j}"]) for j, hz in enumerate(SYSTEMIC_HZ)), F.lit(0.0))
            return systemic_amp / 3.0 * (wave + h["d"] * i / span)

        wave = let(F.struct(drift.alias("d"), *[p.alias(f"p{j}") for j, p in enumerate(phases)]),
                   lambda h: F.transform(F.col(x)[0], lambda _, i: added(h, i)))
        return F.struct(F.exp(gain_sigma * hash_normal(f"{seed}/gain", *key, "copy", pair)).alias("g"), wave.alias("w"))

    def channel(modes):
        return lambda ch, c: let(modes[c % half], lambda m: F.zip_with(ch, m["w"], lambda v, w: v * m["g"] + w))

    noisy = let(F.transform(F.sequence(F.lit(0), half - 1), mode), lambda modes: F.transform(x, channel(modes)))
    rows = rows.withColumn("_k", F.pmod(-shift, n)).withColumn(x, F.when(F.col("copy") == 0, F.col(x)).otherwise(noisy))
    rolled = F.transform(x, lambda ch: F.concat(F.slice(ch, F.col("_k") + 1, n), F.slice(ch, F.lit(1), F.col("_k"))))
    return rows.withColumn(x, F.when(F.col("copy") == 0, F.col(x)).otherwise(rolled)).drop("_k")
