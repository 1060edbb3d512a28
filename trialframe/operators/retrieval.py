"""Embedding retrieval against a bank of concept prototypes.

A bank holds one vector per concept. It is read in blocks of at most ``BLOCK`` concepts; every block is shipped to the
tasks and folded into a small per-trial state (true score, how many candidates beat it, best candidate, sums), so the
trial × candidate scores never leave the map side and a bank of any size is handled by more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import dot, let, unit, vector_sum
from trialframe.operators import foldwise, metrics
from trialframe.session import checkpointed

#: Concepts of a block, trials of a pack, and trials scored at once.
BLOCK = 4096
PACK = 4096
SLICE = 512
#: True scores that a task searches.
TRUE_SCORES = 65_536
#: A candidate beats the true concept by more than this.
TIE = 1e-12
#: What a task returns for a trial and a block.
PART = {"better": "bigint", "best": "double", "pred": "bigint", "total": "double", "mass": "double", "n_cand": "bigint"}


def l2_normalize(df: DataFrame, v: str = "v", eps: float = 1e-8) -> DataFrame:
    return df.withColumn(v, unit(v, eps))


def concept_prototypes(emb: DataFrame, keys: list[str], v: str = "v", eps: float = 1e-8) -> DataFrame:
    """Mean vector per concept, re-normalized."""
    g = emb.groupBy(*keys).agg(vector_sum(v).alias("_s"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("_m", F.transform("_s", lambda x: x / F.col("n"))).select(*keys, unit("_m", eps).alias(v))


def validation_prototypes(rows: DataFrame, concept: str = "concept", v: str = "v", eps: float = 1e-8) -> DataFrame:
    """val_label, concept and prototype of every held-out concept; ``rows`` come from ``splits.concept_holdout_rows``."""
    return concept_prototypes(rows.filter(F.col("part") == "val"), ["val_label", concept], v, eps)


def concept_average(trials: DataFrame, bank: DataFrame) -> DataFrame:
    """Retrieval state of every concept's mean test vector, which counts as one trial of that name."""
    return retrieval_state(concept_prototypes(trials, ["concept"]).withColumn("trial", F.col("concept")), bank, ["trial"])


def bank_blocks(bank: DataFrame, v: str = "v", block: int | None = None, extra: list[str] | None = None) -> Iterator[tuple]:
    """(concept ids, [k, d] vectors, extra columns…) of about ``block`` concepts at a time, each block in concept order.

    Blocks are hash classes of the concept, so one path serves banks of any size and concepts of any type.
    """
    bank = bank.select("concept", v, *(extra or []))
    n = -(-bank.count() // (block or BLOCK))
    if not n:
        raise ValueError("empty bank")
    for i in range(n):
        rows = sorted(bank.filter(F.pmod(F.xxhash64("concept"), F.lit(n)) == i).collect(), key=lambda x: x[0])
        if rows:
            yield tuple(np.array(c, dtype=float if k else None) for k, c in enumerate(zip(*rows)))


STATE = {"s_true": "double", "better": "bigint", "best": "double", "pred": "bigint", "total": "double",
         "z": "double", "n_cand": "bigint"}


def fold_block(state: dict, labels: np.ndarray, s: np.ndarray, ids: np.ndarray, scale: float, first: bool) -> None:
    """Merge one block of scores [n, k] into the state. The first sweep only finds the true score."""
    at = np.searchsorted(ids, labels)
    own = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == labels)
    rows = np.flatnonzero(own)
    if first:
        state["s_true"][rows] = s[rows, at[rows]]
        return
    beat = s > state["s_true"][:, None]
    beat[rows, at[rows]] = False
    state["better"] += beat.sum(axis=1)
    top = s.argmax(axis=1)
    value = s[np.arange(len(s)), top]
    new = (value > state["best"]) | ((value == state["best"]) & (ids[top] < state["pred"]))
    peak = np.maximum(state["best"], value)
    old = np.where(np.isfinite(state["best"]), np.exp(scale * (np.where(np.isfinite(state["best"]), state["best"], 0) - peak)), 0)
    state["z"] = state["z"] * old + np.exp(scale * (s - peak[:, None])).sum(axis=1)
    state["best"] = peak
    state["pred"] = np.where(new, ids[top], state["pred"])
    state["total"] += s.sum(axis=1)
    state["n_cand"] += len(ids)


def empty_state(n: int) -> dict:
    return {"s_true": np.full(n, np.nan), "better": np.zeros(n, int), "best": np.full(n, -np.inf), "pred": np.full(n, -1),
            "total": np.zeros(n), "z": np.zeros(n), "n_cand": np.zeros(n, int)}


def ranked(state: DataFrame) -> DataFrame:
    """``rank`` of the true concept; NULL, as the true score, for a trial whose concept the bank does not have."""
    true = F.when(~F.isnan("s_true"), F.col("s_true"))
    return state.withColumn("s_true", true).withColumn("rank", F.when(F.col("s_true").isNotNull(), F.col("better") + 1))


def hit_at(k: int):
    """Whether the rank is at most k; a trial without a rank is a miss."""
    return F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")


def retrieval_state(trials: DataFrame, bank: DataFrame, keep: list[str], scale: float = 1.0, label: str = "concept",
                    v: str = "v", block: int | None = None) -> DataFrame:
    """One row per trial: score of the true concept, how many candidates beat it, best candidate, Σ scores and the
    softmax denominator relative to the best score. Columns of ``STATE``; vectors are used as given."""
    base = trials.select(*keep, F.col(label).cast("bigint").alias("_y"), v)
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.select(*keep).schema)
    state_cols = ", ".join(f"{k} {t}" for k, t in STATE.items())
    schema = f"{keys}, _y bigint, {v} array<double>, {state_cols}"
    sc = trials.sparkSession.sparkContext
    names = [*keep, "_y", v]
    out = base
    blocks = [sc.broadcast(b) for b in bank_blocks(bank, v, block)]

    def step(shared, sweeps):
        def run(batches):
            ids, m = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                x = kernels.matrix(b.column(names.index(v)), m.shape[1])
                y = b.column(names.index("_y")).to_numpy(zero_copy_only=False)
                have = b.schema.names
                st = ({k: b.column(have.index(k)).to_numpy(zero_copy_only=False).copy() for k in STATE}
                      if "s_true" in have else empty_state(len(y)))
                s = x @ m.T
                for first in sweeps:
                    fold_block(st, y, s, ids, scale, first)
                cols = [b.column(i) for i in range(len(names))]
                cols += [pa.array(st[k], type=pa.float64() if t == "double" else pa.int64()) for k, t in STATE.items()]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *STATE])
        return run

    if len(blocks) == 1:
        out = out.mapInArrow(step(blocks[0], (True, False)), schema)
    else:
        for first in (True, False):
            for shared in blocks:
                out = out.mapInArrow(step(shared, (first,)), schema)
    return ranked(out.select(*keep, F.col("_y").alias(label), *STATE))


def score_matrix(trials: DataFrame, bank: DataFrame, keep: list[str], v: str = "v") -> DataFrame:
    """(trial, cand, s) for callers that need every score; cosine when both sides are normalized."""
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trials.select(*keep).schema)
    sc = trials.sparkSession.sparkContext
    out = None
    for part in bank_blocks(bank, v):
        shared = sc.broadcast(part)

        def run(batches, shared=shared):
            ids, m = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                s = kernels.matrix(b.column(len(keep)), m.shape[1]) @ m.T
                n, k = s.shape
                rows = pa.array(np.repeat(np.arange(n), k))
                cols = [b.column(i).take(rows) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.tile(ids.astype(np.int64), n)), pa.array(s.reshape(-1))],
                                                 names=[*keep, "cand", "s"])

        piece = trials.select(*keep, v).mapInArrow(run, f"{keys}, cand bigint, s double")
        out = piece if out is None else out.unionByName(piece)
    return out


def retrieval_hits(state: DataFrame, ks=(1, 5)) -> DataFrame:
    """Hit at k by rank: candidates tied with the true one do not push it down."""
    return state.select("*", *[hit_at(k).alias(f"hit{k}") for k in ks])


def retrieval_metrics(state: DataFrame, by: list[str], ks=(1, 5)) -> DataFrame:
    recall = [F.avg(hit_at(k)).alias(f"recall{k}") for k in ks]
    return state.groupBy(*by).agg(*recall, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"),
                                  F.percentile("rank", F.lit(0.5)).alias("median_rank"))


def pr_auc(trials: DataFrame, bank: DataFrame, label: str = "concept", v: str = "v") -> DataFrame:
    """Average precision over all trial × concept scores, with a trial's own concept as the hit: (pr_auc).

    Only where true scores lie among all scores matters. A task scores one chunk of trials against one block of concepts, finds each
    score's place among a block of sorted true scores by binary search, and returns one count per true score. No score leaves a
    task, and ties cost nothing. Scores within ``TIE`` of a true score count as equal to it. A trial whose concept the bank
    lacks has misses only; without any hit the result is null.
    """
    rows = trials.select(F.col(label).cast("bigint").alias("_y"), F.col(v).cast("array<double>").alias("x"))
    held = checkpointed(bank.select(F.col("concept").cast("bigint").alias("concept"), F.col(v).cast("array<double>").alias("c")))
    width = held.select(F.size("c")).head()
    if width is None:
        raise ValueError("empty bank")
    chunks = foldwise.chunked(rows, 8 * width[0])
    true = chunks.df.join(held, F.col("_y") == F.col("concept")).select(dot("x", "c").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("p"))
    true = checkpointed(true)
    parts = max(1, -(-true.count() // TRUE_SCORES))
    edges = true.approxQuantile("s", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("s"))) if edges else F.lit(0)
    packed = true.withColumn("_part", part).groupBy("_part").agg(F.sort_array(F.collect_list(F.struct("s", "p"))).alias("_t"))
    packed = packed.select("_part", F.transform("_t", lambda t: t["s"]).alias("s"), F.transform("_t", lambda t: t["p"]).alias("p"))
    packed = checkpointed(packed)
    blocks = max(1, -(-held.count() // BLOCK))
    each = held.sparkSession.range(chunks.pieces).select(F.col("id").cast("int").alias("r_chunk"))
    grid = lambda df, name, n: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    places = grid(grid(each, "r_block", blocks), "r_part", parts)
    candidates = held.withColumn("r_block", F.pmod(F.xxhash64("concept"), F.lit(blocks)).cast("int"))
    right = places.join(candidates, "r_block").select("r_chunk", "r_block", "r_part", "concept", "c").unionByName(
        places.join(packed.select(F.col("_part").alias("r_part"), F.col("s").alias("c")), "r_part").select("r_chunk", "r_block", "r_part", F.lit(None).cast("bigint").alias("concept"), "c"))
    left = grid(grid(chunks.df, "_block", blocks), "_part", parts)
    schema = pa.schema([("_part", pa.int32()), ("n", pa.list_(pa.float64()))])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        known = pc.is_valid(b.column("concept")) if b.num_rows else None
        if not a.num_rows or not b.num_rows or pc.all(known).as_py() or not pc.any(known).as_py():
            return schema.empty_table()
        scores = np.asarray(b.filter(pc.invert(known)).column("c")[0].as_py()) - TIE
        some = b.filter(known)
        ids, m = some.column("concept").to_numpy(), kernels.matrix(some.column("c").combine_chunks(), width[0])
        x, y = kernels.matrix(a.column("x").combine_chunks(), width[0]), a.column("_y").to_numpy()
        n = np.zeros(len(scores) + 1, np.int64)
        for p in range(0, len(x), SLICE):
            s = x[p:p + SLICE] @ m.T
            s[y[p:p + SLICE, None] == ids[None, :]] = -np.inf  # hits are counted from the true scores themselves
            n += np.bincount(np.searchsorted(scores, s.ravel(), "right"), minlength=len(n))
        return pa.table([pa.array([int(a.column("_part")[0].as_py())], pa.int32()), kernels.to_list([n[1:].astype(float)])], schema=schema)

    counted = left.groupBy("_chunk", "_block", "_part").cogroup(right.groupBy("r_chunk", "r_block", "r_part")).applyInArrow(run, "_part int, n array<double>")
    counted = counted.groupBy("_part").agg(vector_sum("n").alias("n"))
    hits = packed.select("_part", F.aggregate("p", F.lit(0).cast("bigint"), lambda x, y: x + y).alias("_h"))
    above = hits.select("_part", F.coalesce(F.sum("_h").over(W.partitionBy(F.lit(1)).orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_above"))
    each = counted.join(packed, "_part").join(above, "_part")

    def precision(batches):
        for pdf in batches:
            for n, p, over in zip(pdf["n"], pdf["p"], pdf["_above"]):
                upward = lambda x: np.cumsum(np.asarray(x)[::-1])[::-1]
                got = upward(p) + over
                yield pd.DataFrame({"a": [float((np.asarray(p) * got / (upward(n) + got)).sum())], "p": [int(np.sum(p))]})

    return each.select("n", "p", "_above").mapInPandas(precision, "a double, p bigint").agg(F.try_divide(F.sum("a"), F.sum("p")).alias("pr_auc"))


def with_confidence(state: DataFrame) -> DataFrame:
    """Softmax confidence of the best candidate: its own term is 1 relative to the best score."""
    return state.withColumns({"y": F.col("concept"), "yhat": F.col("pred"), "conf": 1.0 / F.col("z")})


def retrieval_calibration(state: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Top-1 accuracy, calibration error and confidence gap (NULL without hits or misses)."""
    d = with_confidence(state).withColumn("_hit", F.col("y") == F.col("yhat"))
    cont = metrics.contingency(d, by, bins, closed_low=True)
    gap = (F.avg(F.when(F.col("_hit"), F.col("conf"))) - F.avg(F.when(~F.col("_hit"), F.col("conf")))).alias("conf_gap")
    return metrics.accuracy(cont, by).join(metrics.ece(cont, by), by).join(d.groupBy(*by).agg(gap), by)


def bank_pair_stats(bank: DataFrame, v: str = "v") -> DataFrame:
    """Mean and sample deviation of the cosine between two different concepts without forming the pairs:
    Σ cos = ‖Σu‖² and Σ cos² = ‖Σ u uᵀ‖² over unit vectors u."""
    u = bank.select(unit(v).alias("u"))
    keep = u.select("u", F.array(dot("u", "u")).alias("self"))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = kernels.matrix(b.column(0), len(b.column(0)[0]))
            own = b.column(1).flatten().to_numpy(zero_copy_only=False)
            row = np.concatenate([[len(x), own.sum(), (own * own).sum()], x.sum(axis=0), (x.T @ x).reshape(-1)])
            yield pa.RecordBatch.from_arrays([kernels.to_list([row])], names=["a"])

    total = keep.mapInArrow(run, "a array<double>").agg(vector_sum("a").alias("a"))

    def finish(batches):
        for pdf in batches:
            for a in pdf["a"]:
                a = np.asarray(a)
                d = int(round((np.sqrt(1 + 4 * (len(a) - 3)) - 1) / 2))
                k, own, own2 = a[:3]
                s1 = (a[3:3 + d] ** 2).sum() - own
                s2 = (a[3 + d:] ** 2).sum() - own2
                pairs = k * (k - 1)
                mean = s1 / pairs
                yield pd.DataFrame({"random_mean": [mean], "random_std": [np.sqrt(max(s2 - pairs * mean**2, 0) / (pairs - 1))]})

    return total.mapInPandas(finish, "random_mean double, random_std double")


def retrieval_continuous(state: DataFrame, pair_stats: DataFrame) -> DataFrame:
    """Mean and sample deviation of the cosine to the true concept and of its margin, mean rank, and the distance from
    the random-pair baseline in its deviations."""
    margin = F.col("s_true") - (F.col("total") - F.col("s_true")) / F.greatest(F.lit(1), F.col("n_cand") - 1)
    m, sd = pair_stats.select("random_mean").scalar(), pair_stats.select("random_std").scalar()
    g = state.agg(F.avg("s_true").alias("cos_mean"), F.stddev_samp("s_true").alias("cos_std"),
                  F.avg(margin).alias("margin_mean"), F.stddev_samp(margin).alias("margin_std"),
                  F.avg("rank").alias("mean_rank"))
    return g.select("*", m.alias("random_mean"), sd.alias("random_std")).withColumn(
        "cos_z", (F.col("cos_mean") - F.col("random_mean")) / (F.col("random_std") + 1e-8))


def embedding_mse(emb: DataFrame, bank: DataFrame, v: str = "v") -> DataFrame:
    """Mean squared difference to the prototype of the trial's concept."""
    j = emb.join(bank.select("concept", F.col(v).alias("_p")), "concept")
    d = F.zip_with(v, "_p", lambda a, b: a - b)
    return j.select("concept", (dot(d, d) / F.size(v)).alias("mse"))


def nearest_concepts(bank: DataFrame, k: int, v: str = "v", block: int | None = None) -> DataFrame:
    """The k most similar other concepts of every concept, ties by id. Blocks of the bank stream past all rows and only
    the running top k is kept."""
    u = bank.select(F.col("concept").cast("bigint").alias("concept"), unit(v).alias("v"))
    sc = bank.sparkSession.sparkContext
    out = u.withColumns({"ids": F.array().cast("array<bigint>"), "sims": F.array().cast("array<double>")})
    schema = "concept bigint, v array<double>, ids array<bigint>, sims array<double>"
    for part in bank_blocks(u, "v", block):
        shared = sc.broadcast(part)

        def run(batches, shared=shared):
            ids, m = shared.value
            for pdf in batches:
                if not len(pdf):
                    continue
                s = np.stack(pdf["v"]) @ m.T
                new_ids, new_s = [], []
                for i, c in enumerate(pdf["concept"]):
                    other = ids != c
                    ci = np.concatenate([np.asarray(pdf["ids"].iloc[i], dtype=np.int64), ids[other]])
                    cs = np.concatenate([np.asarray(pdf["sims"].iloc[i], dtype=float), s[i][other]])
                    best = np.lexsort((ci, -cs))[:k]
                    new_ids.append(ci[best])
                    new_s.append(cs[best])
                yield pdf.assign(ids=new_ids, sims=new_s)

        out = out.mapInPandas(run, schema)
    e = out.select("concept", F.posexplode(F.arrays_zip("ids", "sims")).alias("place", "p"))
    return e.select("concept", "place", F.col("p.ids").alias("neighbour"), F.col("p.sims").alias("sim"))


# ---- banks that depend on a key (held-out subject, fold) -------------------------------------------------------

def concept_sums(df: DataFrame, keys: list[str], v: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(vector_sum(v).alias("s"), F.count(F.lit(1)).alias("n"))


def _centroids(s: np.ndarray, n: np.ndarray, eps: float) -> np.ndarray:
    c = s / np.maximum(n, 1)[:, None]
    return c / (np.linalg.norm(c, axis=1, keepdims=True) + eps)


def _true_score(arm: str, v: str, eps: float):
    """Score of a trial's own concept from its totals (_ts, _tn) and its key's own part (_os, _on); −2 without training rows of the arm,
    null for a concept that nothing was trained on."""
    n = F.coalesce("_on", F.lit(0))
    if arm == "within":
        total, count = F.col("_os"), n
    else:
        total, count = F.when(n > 0, F.zip_with("_ts", "_os", lambda a, b: a - b)).otherwise(F.col("_ts")), F.col("_tn") - n
    c = F.transform(total, lambda a: a / count)
    score = F.when(count > 0, let(c, lambda m: dot(v, m) / (F.sqrt(dot(m, m)) + eps))).otherwise(-2.0)
    return F.when(F.col("_tn").isNotNull(), score)


def keyed_states(trials: DataFrame, train: DataFrame, key: str, arms: tuple[str, ...], keep: list[str], v: str = "v", eps: float = 1e-8) -> DataFrame:
    """Retrieval against centroids that depend on ``key``: ``cross`` = all training rows of other keys, ``within`` = the key's own ones.
    (key, keep…, concept, arm, STATE…, rank), a row per trial and arm.

    Trials lie in packs and concepts in blocks, both of bounded size, and a task scores one pack against one block. The block's
    shared totals are scored once for all keys; where a key has training rows of its own, and only there, the score is corrected. The
    states of a trial's blocks are then merged by sums and maxima. No vector reaches the driver, and nothing is gathered per
    key. Scores closer than ``TIE`` to the true one don't beat it.
    """
    sums = checkpointed(concept_sums(train, [key, "concept"], v).withColumn("concept", F.col("concept").cast("bigint")))
    totals = checkpointed(sums.groupBy("concept").agg(vector_sum("s").alias("s"), F.sum("n").alias("n")))
    blocks = max(1, -(-totals.count() // BLOCK))
    own = sums.select(key, "concept", F.col("s").alias("_os"), F.col("n").alias("_on"))
    rows = trials.select(key, *keep, F.col("concept").cast("bigint").alias("concept"), unit(v).alias("v"))
    rows = rows.join(totals.select("concept", F.col("s").alias("_ts"), F.col("n").alias("_tn")), "concept", "left").join(own, [key, "concept"], "left")
    rows = rows.select(key, *keep, "concept", "v", *[_true_score(arm, "v", eps).alias(f"_true_{arm}") for arm in arms])
    # small keys share packs, a large key has several
    size = trials.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / PACK).cast("int").alias("_m"))
    packs = max(1, -(-trials.count() // PACK))
    salt = F.when(F.col("_m") > 1, F.concat(F.col(key).cast("string"), F.lit(":"), F.pmod(F.monotonically_increasing_id(), "_m"))).otherwise(F.lit(""))
    pack = F.xxhash64(F.pmod(F.xxhash64(key), F.lit(packs)), salt)
    rows = checkpointed(rows.join(size, key).withColumn("_pack", pack).drop("_m"))
    met = rows.select(key, "_pack").distinct()
    block = F.pmod(F.xxhash64("concept"), F.lit(blocks)).cast("int")
    every = met.select("_pack").distinct().withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    key_type = trials.schema[key].dataType
    shared = every.join(totals.withColumn("_block", block), "_block").select("_pack", "_block", F.lit(None).cast(key_type).alias("_of"), "concept", "n", "s")
    parts = met.join(sums, key).select("_pack", block.alias("_block"), F.col(key).alias("_of"), "concept", "n", "s")
    right = shared.unionByName(parts).toDF("r_pack", "r_block", "r_of", "r_concept", "r_n", "r_s")
    left = rows.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    names = [key, *keep, "concept"]
    kept_schema, kept_fields = foldwise.arrow_schema(rows, names)
    schema = pa.schema([*kept_schema, ("arm", pa.string()), ("s_true", pa.float64()), *[(c, pa.int64() if t == "bigint" else pa.float64()) for c, t in PART.items()]])

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        bank = b.filter(pc.is_null(b.column("r_of"))).sort_by("r_concept")
        if not bank.num_rows:
            return schema.empty_table()
        cells = b.filter(pc.is_valid(b.column("r_of")))
        d = len(bank.column("r_s")[0])
        ids, total, n = bank.column("r_concept").to_numpy(), kernels.matrix(bank.column("r_s").combine_chunks(), d), bank.column("r_n").to_numpy()
        base = _centroids(total, n, eps)
        a = a.sort_by(key)
        keys, of = foldwise.values(a.column(key)), foldwise.values(cells.column("r_of"))
        x, y = kernels.matrix(a.column("v").combine_chunks(), d), a.column("concept").to_numpy()
        at = np.searchsorted(ids, y)
        mine = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == y)
        out = {arm: {c: [] for c in PART} for arm in arms}
        true = {arm: a.column(f"_true_{arm}").to_numpy() for arm in arms}
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip(np.r_[0, change], np.r_[change, len(keys)]):
            held = np.flatnonzero(of == keys[lo])
            some = cells.take(pa.array(held))
            place = np.searchsorted(ids, some.column("r_concept").to_numpy())
            s, k = kernels.matrix(some.column("r_s").combine_chunks(), d), some.column("r_n").to_numpy()
            for p in range(lo, hi, SLICE):
                q = slice(p, min(p + SLICE, hi))
                for arm in arms:
                    if arm == "within":
                        score = np.full((q.stop - p, len(ids)), -2.0)
                        score[:, place] = x[q] @ _centroids(s, k, eps).T
                    else:
                        score = x[q] @ base.T
                        left_over = n[place] - k
                        score[:, place] = np.where(left_over > 0, x[q] @ _centroids(total[place] - s, left_over, eps).T, -2.0)
                    beat = score > true[arm][q, None] + TIE
                    rows_of = np.flatnonzero(mine[q])
                    beat[rows_of, at[q][rows_of]] = False
                    top = score.argmax(axis=1)
                    for c, value in zip(PART, (beat.sum(axis=1), score[np.arange(len(top)), top], ids[top], score.sum(axis=1), np.exp(score).sum(axis=1),
                                               np.full(len(top), len(ids)))):
                        out[arm][c].append(value)
        tables = []
        for arm in arms:
            columns = [a.column(c) for c in names] + [pa.array([arm] * a.num_rows), pa.array(true[arm], from_pandas=True)] + [pa.array(np.concatenate(out[arm][c])) for c in PART]
            tables.append(pa.table(columns, names=schema.names).cast(schema))
        return pa.concat_tables(tables)

    fields = f"{kept_fields}, arm string, s_true double, " + ", ".join(f"{c} {t}" for c, t in PART.items())
    found = left.groupBy("_pack", "_block").cogroup(right.groupBy("r_pack", "r_block")).applyInArrow(run, fields)
    if blocks > 1:
        found = found.groupBy(*names, "arm").agg(
            F.max("s_true").alias("s_true"), F.sum("better").alias("better"), F.max("best").alias("best"),
            F.min_by("pred", F.struct(-F.col("best"), "pred")).alias("pred"), F.sum("total").alias("total"), F.sum("mass").alias("mass"), F.sum("n_cand").alias("n_cand"))
    # scores of unit vectors are bounded, so the softmax needs no running maximum
    found = found.withColumn("z", F.col("mass") * F.exp(-F.col("best"))).drop("mass")
    return found.withColumn("rank", F.when(F.col("s_true").isNotNull(), F.col("better") + 1))


def keyed_state(trials: DataFrame, train: DataFrame, key: str, arm: str = "cross", trial: str = "trial", v: str = "v", eps: float = 1e-8) -> DataFrame:
    """``keyed_states`` of one arm: (key, trial, concept, STATE…, rank)."""
    named = trials.withColumnRenamed(trial, "trial") if trial != "trial" else trials
    return keyed_states(named, train, key, (arm,), ["trial"], v, eps).drop("arm")


def robustness_rows(df: DataFrame, key: str = "subject", calib: str = "calib", ks=(1, 5)) -> DataFrame:
    """Accuracy per (held-out key, cell, k): within or cross training rows, single trials or concept averages; one pass for all four."""
    train, test = df.filter(calib), df.filter(~F.col(calib))
    means = concept_prototypes(test, [key, "concept"]).withColumn("trial", F.col("concept").cast("bigint"))
    cols = [key, "trial", "concept", "v"]
    both = test.select(*cols, F.lit("single").alias("kind")).unionByName(means.select(*cols, F.lit("avg").alias("kind")))
    state = keyed_states(both, train, key, ("within", "cross"), ["kind", "trial"])
    acc = state.groupBy(key, F.concat_ws("_", "arm", "kind").alias("cell")).agg(*[F.avg(hit_at(k)).alias(f"k{k}") for k in ks])
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"k{k}").alias("acc")) for k in ks])
    return acc.select(key, "cell", F.explode(pairs).alias("p")).select(key, "cell", "p.k", "p.acc")
