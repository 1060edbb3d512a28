"""Queries over spectral, spatial and normalization operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import astd, rnd
from trialframe.operators import descriptors as D
from trialframe.operators import normalize as N
from trialframe.operators import spatial as SP
from trialframe.operators import spectral as S
from trialframe.operators import splits
from trialframe.plans.registry import query, r
from trialframe.plans.signal_plans import BANK, BANK_BODY, CELL, EPOCH, FULL_CELLS, full_cells, long_epochs

# ---- band power: blocks of 32 samples of one channel -----------------------------------------------------------

TEST_BANDS = [("slow", 0.5, 1.0), ("mid", 1.0, 1.5), ("fast", 1.5, 2.1)]


def long_blocks(v):
    s = v.samples.select("subject", F.floor(F.col("t") / 32).alias("blk"), (F.col("t") % 32).cast("int").alias("i"),
                         F.col("c0").alias("x"))
    return s


def sql_band_power(relative: bool) -> str:
    p = "p / (sum(p) OVER (PARTITION BY subject, blk) + 1e-12)" if relative else "p"
    return f"""WITH c AS (SELECT subject, t // 32 AS blk, t % 32 AS i, c0 AS x, count(*) OVER (PARTITION BY subject, t // 32)
         AS t FROM samples), n AS (SELECT *, least(t, 8) AS n FROM c),
       s AS (SELECT subject, blk, n, seg, i - seg * (n - n // 2) AS j, x FROM n, range(0, 32) g(seg)
             WHERE i >= seg * (n - n // 2) AND i < seg * (n - n // 2) + n AND seg * (n - n // 2) + n <= t),
       m AS (SELECT *, x - avg(x) OVER (PARTITION BY subject, blk, seg) AS d,
             CASE WHEN n > 1 THEN 0.5 - 0.5 * cos(2 * pi() * j / n) ELSE 1 END AS w FROM s),
       f AS (SELECT subject, blk, n, seg, k, power(sum(d * w * cos(2 * pi() * k * j / n)), 2)
             + power(sum(d * w * sin(2 * pi() * k * j / n)), 2) AS e, sum(w * w) AS ww
             FROM m, range(0, 5) q(k) WHERE k <= n // 2 GROUP BY subject, blk, n, seg, k),
       psd AS (SELECT subject, blk, n, k, avg(CASE WHEN k > 0 AND 2 * k <> n THEN 2 ELSE 1 END * e / (4 * ww)) AS p
               FROM f GROUP BY subject, blk, n, k),
       b AS (SELECT subject, blk, band, sum(CASE WHEN k * 4.0 / n >= lo AND k * 4.0 / n < hi THEN p ELSE 0 END) AS p
             FROM psd, (VALUES ('slow', 0.5, 1.0), ('mid', 1.0, 1.5), ('fast', 1.5, 2.1)) v(band, lo, hi)
             GROUP BY subject, blk, band)
       SELECT subject, blk, band, {r(f'ln({p} + 1e-12)')} AS power FROM b"""


@query("band_powers", sql_band_power(False))
def _(v):
    g = long_blocks(v).groupBy("subject", "blk").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
    e = g.select("subject", "blk", F.array(F.transform("s", lambda c: c["x"])).alias("x"))
    p = S.band_powers(e, EPOCH, 4.0, TEST_BANDS)
    names = F.array(*[F.lit(n) for n, _, _ in TEST_BANDS])
    p = p.select(*EPOCH, F.posexplode("power").alias("b", "power"))
    return p.select(*EPOCH, F.element_at(names, F.col("b") + 1).alias("band"), rnd("power").alias("power"))


@query("band_powers_relative", sql_band_power(True))
def _(v):
    return S.band_powers_relational(long_blocks(v), EPOCH, 4.0, TEST_BANDS, relative=True).withColumn(
        "power", rnd("power"))


@query("band_powers_relational", sql_band_power(False))
def _(v):
    return S.band_powers_relational(long_blocks(v), EPOCH, 4.0, TEST_BANDS).withColumn("power", rnd("power"))


# ---- cleaners --------------------------------------------------------------------------------------------------

SQL_CBSI = """pr AS (SELECT a.subject, a.blk, a.ch, a.i, a.x AS o, b.x AS r FROM cells a JOIN cells b
       ON a.subject = b.subject AND a.blk = b.blk AND a.i = b.i AND b.ch = a.ch + 2),
       al AS (SELECT *, stddev_pop(o) OVER w / (stddev_pop(r) OVER w + 1e-9) AS a FROM pr
              WINDOW w AS (PARTITION BY subject, blk, ch)),
       cb AS (SELECT subject, blk, ch, i, 0.5 * (o - a * r) AS v FROM al UNION ALL
              SELECT subject, blk, ch + 2, i, -(0.5 * (o - a * r)) / nullif(a, 0) FROM al)"""


def sql_detrend(src: str, x: str) -> str:
    return f"""SELECT subject, blk, ch, i, {x} - avg({x}) OVER w - coalesce((sum({x} * (i - mid)) OVER w)
        / nullif(sum((i - mid) * (i - mid)) OVER w, 0), 0) * (i - mid) AS v
        FROM (SELECT *, (count(*) OVER (PARTITION BY subject, blk, ch) - 1) / 2.0::DOUBLE AS mid FROM {src})
        WINDOW w AS (PARTITION BY subject, blk, ch)"""


@query("cbsi", f"WITH {SQL_CBSI} SELECT subject, blk, ch, i, {r('v')} AS v FROM cb")
def _(v):
    return long_epochs(S.cbsi(v.epochs.select(*EPOCH, "x")), EPOCH)


@query("detrend", f"WITH d AS ({sql_detrend('cells', 'x')}) SELECT subject, blk, ch, i, {r('v')} AS v FROM d")
def _(v):
    return long_epochs(S.detrend(v.epochs.select(*EPOCH, "x")), EPOCH)


@query("clean_chain", f"""WITH {SQL_CBSI}, d AS ({sql_detrend('cb', 'v')})
       SELECT subject, blk, ch, i, {r('v')} AS v FROM d""")
def _(v):
    return long_epochs(S.clean_chain(v.epochs.select(*EPOCH, "x"), ["cbsi", "detrend"]), EPOCH)


_P = kernels.glm_projection(8, 0.5, -2.0, 8.0)
_P_VALUES = ", ".join(f"({k}, {i}, {w!r}::DOUBLE)" for k, row in enumerate(_P.tolist()) for i, w in enumerate(row))


@query("glm_beta", f"""WITH {FULL_CELLS}, p(k, i, w) AS (VALUES {_P_VALUES})
       SELECT subject, blk, ch, k, {r('sum(x * w)', 5)} AS beta FROM fc JOIN p USING (i) GROUP BY subject, blk, ch, k""")
def _(v):
    e = v.epochs.filter("n = 8")
    return S.glm_beta(e, EPOCH, 8, 0.5, -2.0, 8.0).withColumn("beta", rnd("beta", 5))


# ---- channel mixing and covariance -----------------------------------------------------------------------------

MIX = np.array([[1.0, -0.5, 0.25, 0.0], [0.1, 0.2, 0.3, 0.4]])


@query("channel_mix", f"""WITH m(k, ch, w) AS (VALUES (0, 0, 1.0), (0, 1, -0.5), (0, 2, 0.25), (0, 3, 0.0),
       (1, 0, 0.1), (1, 1, 0.2), (1, 2, 0.3), (1, 3, 0.4))
       SELECT subject, blk, k AS ch, i, {r('sum(x * w)')} AS v FROM cells JOIN m USING (ch) GROUP BY subject, blk, k, i""")
def _(v):
    return long_epochs(SP.channel_mix(v.epochs.select(*EPOCH, "x"), MIX), EPOCH)


@query("trial_covariance", f"""SELECT a.subject, a.blk, a.ch AS i, b.ch AS j, {r('sum(a.x * b.x) / count(*)')} AS c
       FROM cells a JOIN cells b ON a.subject = b.subject AND a.blk = b.blk AND a.i = b.i AND a.ch <= b.ch
       GROUP BY a.subject, a.blk, a.ch, b.ch""")
def _(v):
    return SP.upper_cells(SP.trial_covariance(v.epochs, EPOCH), EPOCH, 4).withColumn("c", rnd("c"))


@query("trial_covariance_oas", f"""WITH q AS (SELECT *, x - avg(x) OVER (PARTITION BY subject, blk, ch) AS d FROM cells),
       s AS (SELECT a.subject, a.blk, a.ch AS i, b.ch AS j, sum(a.d * b.d) / count(*) AS s, count(*) AS t
             FROM q a JOIN q b ON a.subject = b.subject AND a.blk = b.blk AND a.i = b.i GROUP BY ALL),
       m AS (SELECT *, avg(s * s) OVER w AS alpha, sum(CASE WHEN i = j THEN s ELSE 0 END) OVER w / 4 AS mu FROM s
             WINDOW w AS (PARTITION BY subject, blk)),
       h AS (SELECT *, CASE WHEN (t + 1) * (alpha - mu * mu / 4) > 0 THEN
             least(1, (alpha + mu * mu) / ((t + 1) * (alpha - mu * mu / 4))) ELSE 1 END AS rho FROM m)
       SELECT subject, blk, i, j, {r('(1 - rho) * s + CASE WHEN i = j THEN rho * mu ELSE 0 END')} AS c
       FROM h WHERE i <= j""")
def _(v):
    return SP.upper_cells(SP.trial_covariance(v.epochs, EPOCH, "oas"), EPOCH, 4).withColumn("c", rnd("c"))


@query("trial_covariance_ledoit_wolf", f"""WITH q AS (SELECT *, x - avg(x) OVER (PARTITION BY subject, blk, ch) AS d FROM cells),
       s AS (SELECT a.subject, a.blk, a.ch AS i, b.ch AS j, sum(a.d * b.d) / count(*) AS s, count(*) AS t,
             sum(a.d * a.d * b.d * b.d) AS e
             FROM q a JOIN q b ON a.subject = b.subject AND a.blk = b.blk AND a.i = b.i GROUP BY ALL),
       m AS (SELECT *, sum(s * s) OVER w AS ss, sum(e) OVER w AS ee, sum(CASE WHEN i = j THEN s ELSE 0 END) OVER w / 4
             AS mu FROM s WINDOW w AS (PARTITION BY subject, blk)),
       h AS (SELECT *, (ss - 4 * mu * mu) / 4 AS delta, (ee / t - ss) / (4 * t) AS beta FROM m),
       k AS (SELECT *, CASE WHEN delta <= 0 THEN 0 ELSE greatest(0, least(beta, delta)) / delta END AS w FROM h)
       SELECT subject, blk, i, j, {r('(1 - w) * s + CASE WHEN i = j THEN w * mu ELSE 0 END')} AS c
       FROM k WHERE i <= j""")
def _(v):
    return SP.upper_cells(SP.trial_covariance(v.epochs, EPOCH, "lwf"), EPOCH, 4).withColumn("c", rnd("c"))


# ---- sensor geometry: eight suppliers are one sensor set, their customers the points ---------------------------

SQL_CH = """ch AS (SELECT s_suppkey // 8 AS montage, s_suppkey AS ch, CASE WHEN s_acctbal >= 0 THEN cos(s_suppkey) END AS px,
       CASE WHEN s_acctbal >= 0 THEN sin(s_suppkey * 1.7) END AS py, s_acctbal FROM supplier),
       mv AS (SELECT *, px - avg(px) OVER (PARTITION BY montage) AS qx, py - avg(py) OVER (PARTITION BY montage) AS qy
              FROM ch),
       ud AS (SELECT montage, ch, s_acctbal, qx / (max(sqrt(qx * qx + qy * qy)) OVER w + 1e-9) AS px,
              qy / (max(sqrt(qx * qx + qy * qy)) OVER w + 1e-9) AS py FROM mv WINDOW w AS (PARTITION BY montage)),
       pt AS (SELECT c_custkey, c_custkey // 120 AS montage, cos(c_custkey) AS px, sin(c_custkey * 1.3) AS py FROM customer)"""


def sensors(v):
    k = F.col("s_suppkey")
    ok = F.col("s_acctbal") >= 0
    return v.table("supplier").select(F.floor(k / 8).alias("montage"), k.alias("ch"), F.when(ok, F.cos(k)).alias("px"),
                                      F.when(ok, F.sin(k * 1.7)).alias("py"), "s_acctbal")


def points(v):
    k = F.col("c_custkey")
    return v.table("customer").select("c_custkey", F.floor(k / 120).alias("montage"), F.cos(k).alias("px"),
                                      F.sin(k * 1.3).alias("py"))


@query("electrode_graph", f"""WITH {SQL_CH}, a AS (SELECT a.montage, a.ch, b.ch AS o, CASE WHEN a.ch = b.ch THEN 0 ELSE
       coalesce(exp(-((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) / (2 * 0.6 * 0.6)), 0) END AS w
       FROM ud a JOIN ud b ON a.montage = b.montage)
       SELECT montage, ch, {r('sum(w)')} AS degree, {r('max(w)')} AS max_w, {r('sum(w * w) + sum(w) * sum(w)')} AS lap_sq
       FROM a GROUP BY montage, ch""")
def _(v):
    from trialframe.functions.columns import dot
    g = SP.electrode_graph(sensors(v), "montage", 0.6)
    return g.select("montage", "ch", rnd("degree").alias("degree"), rnd(F.array_max("adj")).alias("max_w"),
                    rnd(dot("lap", "lap")).alias("lap_sq"))


@query("coverage", f"""WITH {SQL_CH}, d AS (SELECT c_custkey, pt.montage, ud.ch % 8 < 4 AS a, exp(-min((pt.px - ud.px) *
       (pt.px - ud.px) + (pt.py - ud.py) * (pt.py - ud.py)) / (2 * 0.2 * 0.2)) AS f FROM pt JOIN ud USING (montage)
       WHERE ud.px IS NOT NULL GROUP BY ALL)
       SELECT x.c_custkey, {r('x.f * y.f')} AS coverage FROM d x JOIN d y ON x.c_custkey = y.c_custkey AND x.a AND NOT y.a""")
def _(v):
    m = SP.montages(sensors(v), "montage")
    half = lambda keep: m.select("montage", F.filter("p", lambda s: (s["px"].isNotNull()) & keep(s["ch"] % 8 < 4)).alias("p")
                                 ).filter(F.size("p") > 0)
    out = SP.coverage(points(v), half(lambda c: c), half(lambda c: ~c), "montage")
    return out.select("c_custkey", rnd("coverage").alias("coverage"))


@query("rbf_interpolate", f"""WITH {SQL_CH}, d AS (SELECT c_custkey, montage, sum(w * s_acctbal) / (sum(w) + 1e-12) AS a FROM
       (SELECT c_custkey, pt.montage, s_acctbal, exp(-((pt.px - ud.px) * (pt.px - ud.px) + (pt.py - ud.py)
       * (pt.py - ud.py)) / (2 * 0.5 * 0.5)) AS w FROM pt JOIN ud USING (montage) WHERE ud.px IS NOT NULL) GROUP BY 1, 2)
       SELECT c_custkey, {r('0.1 + 0.9 * a / (max(a) OVER (PARTITION BY montage) + 1e-12)')} AS w FROM d""")
def _(v):
    s = sensors(v)
    unit = SP.montages(s, "montage").select("montage", F.explode("p").alias("q")).select(
        "montage", F.col("q.ch").alias("ch"), F.col("q.px").alias("px"), F.col("q.py").alias("py"))
    src = unit.join(s.select("ch", F.col("s_acctbal").alias("v")), "ch").filter("px IS NOT NULL")
    src = src.groupBy("montage").agg(F.sort_array(F.collect_list(F.struct("ch", "px", "py", "v"))).alias("p"))
    return SP.rbf_interpolate(points(v), src, "montage", 0.5, 0.1).select("c_custkey", rnd("w").alias("w"))


@query("class_channel_response", f"""WITH s AS (SELECT label, subject, blk, ch, stddev_pop(x) AS sd FROM cells
       JOIN (SELECT subject, blk, label FROM epochs) e USING (subject, blk) GROUP BY ALL),
       a AS (SELECT label, ch, avg(sd) AS a FROM s GROUP BY ALL)
       SELECT label, ch, {r('a / (max(a) OVER (PARTITION BY label) + 1e-12)')} AS response FROM a""")
def _(v):
    e = v.epochs.select("label", F.posexplode("x").alias("ch", "s")).select("label", "ch", astd(F.col("s")).alias("sd"))
    return SP.class_channel_response(e, ["label"]).withColumn("response", rnd("response"))


# ---- normalization ---------------------------------------------------------------------------------------------

@query("zscore_epoch", f"""SELECT subject, blk, ch, i, {r('(x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-7)', 5)} AS v
       FROM cells WINDOW w AS (PARTITION BY subject, blk, ch)""")
def _(v):
    e = N.zscore_epoch(v.epochs.select(*EPOCH, "x")).select(*EPOCH, F.posexplode("x").alias("ch", "s"))
    return e.select(*EPOCH, "ch", F.posexplode("s").alias("i", "v")).withColumn("v", rnd("v", 5))


@query("zscore_block", f"""SELECT subject, blk, ch, i, {r('(x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-6)')} AS v
       FROM cells WINDOW w AS (PARTITION BY subject, blk)""")
def _(v):
    return long_epochs(N.zscore_block(v.epochs.select(*EPOCH, "x")), EPOCH)


@query("scale", f"SELECT subject, blk, ch, i, {r('x * 1e3')} AS v FROM cells")
def _(v):
    return long_epochs(N.scale(v.epochs.select(*EPOCH, "x"), 1e3), EPOCH)


@query("zscore_train", f"""WITH l AS (SELECT cells.*, session FROM cells JOIN (SELECT subject, blk, session FROM epochs) e
       USING (subject, blk)), s AS (SELECT ch, avg(x) AS m, stddev_pop(x) AS sd FROM l WHERE session <> 's2' GROUP BY ch)
       SELECT subject, blk, ch, i, {r('(x - m) / (sd + 1e-6)')} AS x FROM l JOIN s USING (ch)""")
def _(v):
    part = F.when(F.col("session") == "s2", "test").otherwise("train")
    e = v.epochs.select(*EPOCH, part.alias("part"), F.posexplode("x").alias("ch", "s"))
    c = e.select(*EPOCH, "part", "ch", F.posexplode("s").alias("i", "x"))
    return N.zscore_train(c, ["ch"], "x").select(*EPOCH, "ch", "i", rnd("x").alias("x"))


@query("ewm_standardize", f"""WITH s AS (SELECT subject AS rec, t, c0 AS x FROM samples),
       m AS (SELECT *, x - sum(x * power(0.95::DOUBLE, -t)) OVER w * power(0.95::DOUBLE, t)
             / ((1 - power(0.95::DOUBLE, t + 1)) / 0.05) AS d FROM s WINDOW w AS (PARTITION BY rec ORDER BY t)),
       q AS (SELECT *, sqrt(sum(d * d * power(0.95::DOUBLE, -t)) OVER w * power(0.95::DOUBLE, t)
             / ((1 - power(0.95::DOUBLE, t + 1)) / 0.05)) AS e, avg(x) FILTER (t < 10) OVER (PARTITION BY rec) AS hm,
             stddev_pop(x) FILTER (t < 10) OVER (PARTITION BY rec) AS hs FROM m WINDOW w AS (PARTITION BY rec ORDER BY t))
       SELECT rec, t, {r('CASE WHEN t < 10 THEN (x - hm) / greatest(1e-4, hs) ELSE d / greatest(1e-4, e) END')} AS z FROM q""")
def _(v):
    s = v.samples.select(F.col("subject").alias("rec"), "t", "c0")
    return N.ewm_standardize(s, "c0", 0.05, 10, chunk=16).withColumn("z", rnd("z"))


FEATURE = ["subject", "ch", "family"]


def long_features(v, families):
    return D.to_long(D.extract_bank(v.cells, CELL, families), CELL, families)


SQL_F = f"""{BANK}, f AS (SELECT subject, blk, ch, 'mean' AS family, mean AS f FROM bank UNION ALL
       SELECT subject, blk, ch, 'peak', peak FROM bank)"""


@query("zscore_subject", f"""WITH {SQL_F} SELECT subject, blk, ch, family,
       {r('(f - avg(f) OVER w) / (stddev_pop(f) OVER w + 1e-6)')} AS f FROM f WINDOW w AS (PARTITION BY subject, ch, family)""")
def _(v):
    return N.zscore_subject(long_features(v, ["mean", "peak"]), FEATURE, "f").select(
        *CELL, "family", rnd("f").alias("f"))


@query("zscore_calibrated", f"""WITH {SQL_F}, k AS (SELECT subject, blk, row_number() OVER (PARTITION BY subject ORDER BY
       md5('9:' || subject || ':' || blk)) - 1 < count(*) OVER (PARTITION BY subject) // 2 AS calib
       FROM (SELECT DISTINCT subject, blk FROM cells)),
       j AS (SELECT f.*, calib FROM f JOIN k USING (subject, blk))
       SELECT subject, blk, ch, family, {r('''(f - avg(f) FILTER (calib) OVER w) / (stddev_pop(f) FILTER (calib) OVER w + 1e-6)''')}
       AS f FROM j WHERE NOT calib OR calib WINDOW w AS (PARTITION BY subject, ch, family)""")
def _(v):
    f = long_features(v, ["mean", "peak"])
    half = splits.calibration_half(v.cells.select("subject", "blk").distinct(), 9, ["subject", "blk"])
    return N.zscore_calibrated(f.join(half, EPOCH), FEATURE, "f").select(*CELL, "family", rnd("f").alias("f"))


@query("weighted_family_scaler", f"""WITH {SQL_F}, j AS (SELECT f.*, subject < '5' AS train FROM f)
       SELECT subject, blk, ch, family, {r('''(f - avg(f) FILTER (train) OVER w) / (stddev_pop(f) FILTER (train) OVER w + 1e-8)
       * CASE family WHEN 'peak' THEN 2.5 ELSE 1 END''')} AS f FROM j WINDOW w AS (PARTITION BY ch, family)""")
def _(v):
    part = F.when(F.col("subject") < "5", "train").otherwise("test")
    f = long_features(v, ["mean", "peak"]).withColumn("part", part)
    out = N.weighted_family_scaler(f, ["ch", "family"], "f", "family", {"peak": 2.5})
    return out.select(*CELL, "family", rnd("f").alias("f"))


@query("compose_normalization", f"""WITH z AS (SELECT subject, blk, ch, i,
       1e3 * (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-7) AS v FROM cells WINDOW w AS (PARTITION BY subject, blk, ch))
       SELECT subject, blk, ch, i, {r('(v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-6)', 5)} AS v FROM z
       WINDOW w AS (PARTITION BY subject, blk)""")
def _(v):
    links = [N.zscore_epoch, lambda d: N.scale(d, 1e3), N.zscore_block]
    e = N.compose_normalization(v.epochs.select(*EPOCH, "x"), links).select(*EPOCH, F.posexplode("x").alias("ch", "s"))
    return e.select(*EPOCH, "ch", F.posexplode("s").alias("i", "v")).withColumn("v", rnd("v", 5))
