"""Channel mixing, covariances and sensor geometry. A montage is one device's sensor set: a few hundred at most."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import asum, let
from trialframe.operators.epoching import map_epochs, map_vectors

CO_SAMPLING = 0.20          # fixed value: co-sampling radius in unit-disk units


def channel_mix(df: DataFrame, weights: np.ndarray, x: str = "x") -> DataFrame:
    """out[k, t] = Σ_c W[k, c]·x[c, t]."""
    w = np.asarray(weights, dtype=float)
    return map_epochs(df, lambda s: np.einsum("kc,nct->nkt", w, s), x)


def trial_covariance(df: DataFrame, keep: list[str], estimator: str = "scm", x: str = "x") -> DataFrame:
    """One row-major covariance per epoch: ``scm`` (uncentred), ``oas`` or ``lwf`` (shrunk)."""
    fn = {"scm": kernels.uncentred_cov, "oas": kernels.oas_cov, "lwf": kernels.ledoit_wolf_cov}[estimator]
    return map_vectors(df, keep, lambda s: fn(s).reshape(len(s), -1), "cov", x)


def upper_cells(df: DataFrame, keep: list[str], d: int, cov: str = "cov") -> DataFrame:
    """(i ≤ j) entries of row-major matrices, for reports."""
    cells = df.select(*keep, F.posexplode(cov).alias("_k", "c"))
    cells = cells.withColumns({"i": F.floor(F.col("_k") / d).cast("int"), "j": (F.col("_k") % d).cast("int")})
    return cells.filter("i <= j").select(*keep, "i", "j", "c")


def montages(channels: DataFrame, key: str) -> DataFrame:
    """One row per montage with its sensors [(ch, px, py)] in channel order, positions scaled to the unit disk."""
    g = channels.groupBy(key).agg(
        F.avg("px").alias("_mx"), F.avg("py").alias("_my"),
        F.sort_array(F.collect_list(F.struct("ch", "px", "py"))).alias("p"))
    moved = F.transform("p", lambda s: F.struct(s["ch"].alias("ch"), (s["px"] - F.col("_mx")).alias("px"),
                                                (s["py"] - F.col("_my")).alias("py")))
    g = g.withColumn("p", moved)
    radius = F.array_max(F.transform("p", lambda s: F.sqrt(s["px"] * s["px"] + s["py"] * s["py"])))
    unit = let(radius + 1e-9, lambda r: F.transform("p", lambda s: F.struct(
        s["ch"].alias("ch"), (s["px"] / r).alias("px"), (s["py"] / r).alias("py"))))
    return g.select(key, unit.alias("p"))


def sq_dist(a, b) -> Column:
    dx, dy = a["px"] - b["px"], a["py"] - b["py"]
    return dx * dx + dy * dy


def electrode_graph(channels: DataFrame, key: str, sigma: float = 0.2) -> DataFrame:
    """Per channel: its row of the adjacency exp(−d²/2σ²) (zero diagonal, 0 without a position) and its degree."""
    m = montages(channels, key)
    rows = m.select(key, "p", F.explode("p").alias("s"))
    weight = lambda o: F.when(o["ch"] == F.col("s.ch"), 0.0).otherwise(
        F.coalesce(F.exp(-sq_dist(F.col("s"), o) / (2 * sigma**2)), F.lit(0.0)))
    rows = rows.withColumn("adj", F.transform("p", weight)).withColumn("degree", asum("adj"))
    lap = F.transform("p", lambda o, j: F.when(o["ch"] == F.col("s.ch"), F.col("degree")).otherwise(
        -F.col("adj")[j]))
    return rows.select(key, F.col("s.ch").alias("ch"), F.transform("p", lambda o: o["ch"]).alias("others"), "adj",
                       "degree", lap.alias("lap"))


def nearest_falloff(point: Column, sensors: Column, radius: float = CO_SAMPLING) -> Column:
    """exp(−min d² / 2r²) to the nearest sensor."""
    return F.exp(-F.array_min(F.transform(sensors, lambda s: sq_dist(point, s))) / (2 * radius**2))


def coverage(points: DataFrame, sensors_a: DataFrame, sensors_b: DataFrame, key: str) -> DataFrame:
    """Product of the falloffs to the nearest sensor of each kind. The sensors of a montage travel as one array."""
    a = sensors_a.select(key, F.col("p").alias("_a"))
    b = sensors_b.select(key, F.col("p").alias("_b"))
    here = F.struct("px", "py")
    j = points.join(a, key).join(b, key)
    return j.withColumn("coverage", nearest_falloff(here, F.col("_a")) * nearest_falloff(here, F.col("_b"))
                        ).drop("_a", "_b")


def rbf_interpolate(points: DataFrame, sources: DataFrame, key: str, sigma: float, floor: float) -> DataFrame:
    """Gaussian-weighted mean of the source values (array of (px, py, v)), scaled by its maximum over the points of
    the key, then lifted to [floor, 1]."""
    j = points.join(sources.select(key, F.col("p").alias("_s")), key)
    here = F.struct("px", "py")
    wv = F.transform("_s", lambda s: let(F.exp(-sq_dist(here, s) / (2 * sigma**2)), lambda w: F.struct(
        w.alias("w"), (w * s["v"]).alias("wv"))))
    j = j.withColumn("_t", wv)
    raw = asum(F.transform("_t", lambda e: e["wv"])) / (asum(F.transform("_t", lambda e: e["w"])) + 1e-12)
    j = j.withColumn("_raw", raw).drop("_s", "_t")
    top = j.groupBy(key).agg(F.max("_raw").alias("_top"))
    out = j.join(top, key)
    return out.withColumn("w", floor + (1.0 - floor) * F.col("_raw") / (F.col("_top") + 1e-12)).drop("_raw", "_top")


def class_channel_response(channels: DataFrame, by: list[str]) -> DataFrame:
    """Mean over epochs of the per-epoch standard deviation, divided by the largest channel of the group.
    ``channels(by…, ch, sd)``."""
    g = channels.groupBy(*by, "ch").agg(F.avg("sd").alias("_a"))
    top = g.groupBy(*by).agg(F.max("_a").alias("_top"))
    return g.join(top, by).select(*by, "ch", (F.col("_a") / (F.col("_top") + 1e-12)).alias("response"))
