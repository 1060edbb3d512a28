"""Queries over evaluation metrics, calibration, fusion and run tables."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from trialframe.functions.columns import argmax0, let, rnd, softmax
from trialframe.operators import bootstrap as B
from trialframe.operators import fusion as FU
from trialframe.operators import metrics as M
from trialframe.operators.labels import restrict_classes
from trialframe.plans.registry import query, r
from trialframe.session import checkpointed, shipped


def pred_a(v, *extra):
    return M.predict_label(v.preds.withColumn("probs", F.col("pa")), "probs").select(
        "trial", "subject", "fold", "year", "y", "yhat", "conf", *extra)


SQL_PA = """pa AS (SELECT trial, subject, fold, year, y, pa, pb, CAST(list_position(pa, list_max(pa)) - 1 AS INTEGER) AS yhat,
       list_max(pa) AS conf FROM preds)"""
SQL_ARMS = """arms AS (SELECT 'a' AS arm, trial, fold, year, y, CAST(list_position(pa, list_max(pa)) - 1 AS INTEGER) AS yhat,
       list_max(pa) AS conf FROM preds UNION ALL SELECT 'b', trial, fold, year, y,
       CAST(list_position(pb, list_max(pb)) - 1 AS INTEGER), list_max(pb) FROM preds)"""


def arms(v):
    m = F.create_map(F.lit("a"), F.col("pa"), F.lit("b"), F.col("pb"))
    p = v.preds.select("trial", "fold", "year", "y", F.explode(m).alias("arm", "probs"))
    return M.predict_label(p).drop("probs")


def sql_bin(conf: str, bins: int) -> str:
    return " + ".join(f"CAST({conf} > {e!r}::DOUBLE AS INTEGER)" for e in M.bin_edges(bins)) + " - 1"


def sql_kappa(src: str, by: str) -> str:
    """(by, kappa) from rows with y and yhat; ``by`` ends with a comma or is empty."""
    g = by.rstrip(", ")
    on = " AND ".join(f"a.{c.strip()} = b.{c.strip()}" for c in g.split(",")) if g else "true"
    grp = f"GROUP BY {g}" if g else ""
    sel = ", ".join(f"a.{c.strip()}" for c in g.split(",")) + ", " if g else ""
    return f"""SELECT {sel}(po - pe) / nullif(1 - pe, 0) AS kappa FROM
      (SELECT {by} avg(CAST(y = yhat AS INTEGER)) AS po FROM {src} {grp}) a JOIN
      (SELECT {by} sum(r::DOUBLE * k) / (sum(r)::DOUBLE * sum(r)) AS pe FROM (SELECT {by} cls, sum(r) AS r, sum(k) AS k FROM
        (SELECT {by} y AS cls, 1 AS r, 0 AS k FROM {src} UNION ALL SELECT {by} yhat, 0, 1 FROM {src}) GROUP BY {by} cls) {grp})
      b ON {on}"""


def sql_ece(src: str, by: str, bins: int = 15) -> str:
    g = by.rstrip(", ")
    grp = f"GROUP BY {g}" if g else ""
    part = f"PARTITION BY {g}" if g else ""
    return f"""SELECT {by} coalesce(sum(w * abs(acc - conf)) FILTER (bin >= 0), 0) AS ece FROM (SELECT {by} bin, avg(conf) AS conf,
        avg(CAST(y = yhat AS INTEGER)) AS acc, count(*) / sum(count(*)) OVER ({part}) AS w
        FROM (SELECT *, {sql_bin('conf', bins)} AS bin FROM {src}) GROUP BY {by} bin) {grp}"""


@query("predict_label", f"WITH {SQL_PA} SELECT trial, yhat, {r('conf')} AS conf FROM pa")
def _(v):
    return pred_a(v).select("trial", "yhat", rnd("conf").alias("conf"))


@query("accuracy", f"WITH {SQL_PA} SELECT fold, {r('avg(CAST(y = yhat AS INTEGER))')} AS acc, count(*) AS n FROM pa GROUP BY fold")
def _(v):
    return M.accuracy(M.contingency(pred_a(v), ["fold"]), ["fold"]).select("fold", rnd("acc").alias("acc"), "n")


@query("kappa", f"WITH {SQL_PA}, k AS ({sql_kappa('pa', 'subject,')}) SELECT subject, {r('kappa')} AS kappa FROM k")
def _(v):
    return M.kappa(M.contingency(pred_a(v), ["subject"]), ["subject"]).select("subject", rnd("kappa").alias("kappa"))


@query("confusion", f"""WITH {SQL_PA}, g AS (SELECT fold, y, yhat FROM (SELECT DISTINCT fold FROM pa),
       (VALUES (0), (1), (2)) a(y), (VALUES (0), (1), (2)) b(yhat))
       SELECT g.fold, g.y, g.yhat, count(pa.trial) AS n FROM g LEFT JOIN pa ON g.fold = pa.fold AND g.y = pa.y AND
       g.yhat = pa.yhat GROUP BY ALL""")
def _(v):
    return M.confusion(M.contingency(pred_a(v), ["fold"]), ["fold"], 3)


@query("ece", f"WITH {SQL_PA}, e AS ({sql_ece('pa', 'fold,')}) SELECT fold, {r('ece')} AS ece FROM e")
def _(v):
    return M.ece(M.contingency(pred_a(v), ["fold"]), ["fold"]).select("fold", rnd("ece").alias("ece"))


@query("reliability", f"""WITH {SQL_PA} SELECT bin, {r('avg(conf)')} AS conf, {r('avg(CAST(y = yhat AS INTEGER))')} AS acc,
       {r('count(*) / sum(count(*)) OVER ()')} AS weight FROM (SELECT *, {sql_bin('conf', 15)} AS bin FROM pa) GROUP BY bin""")
def _(v):
    return M.reliability(M.contingency(pred_a(v), []), []).select("bin", *[rnd(c).alias(c) for c in ("conf", "acc", "weight")])


SQL_FOLDS = f"""{SQL_PA}, kf AS ({sql_kappa('pa', 'fold,')}), ef AS ({sql_ece('pa', 'fold,')}), kp AS ({sql_kappa('pa', '')}),
       ep AS ({sql_ece('pa', '')}),
       per AS (SELECT fold, acc, kappa, ece, n FROM (SELECT fold, avg(CAST(y = yhat AS INTEGER)) AS acc, count(*) AS n FROM pa
               GROUP BY fold) JOIN kf USING (fold) JOIN ef USING (fold)),
       ev AS (SELECT * FROM per UNION ALL SELECT 'fold_mean', avg(acc), avg(kappa), avg(ece), sum(n) FROM per
              UNION ALL SELECT 'pooled', (SELECT avg(CAST(y = yhat AS INTEGER)) FROM pa), (SELECT kappa FROM kp),
              (SELECT ece FROM ep), (SELECT count(*) FROM pa))"""


@query("evaluate_folds", f"""WITH {SQL_FOLDS} SELECT fold, {r('acc')} AS acc, {r('kappa')} AS kappa, {r('ece')} AS ece,
       CAST(n AS BIGINT) AS n FROM ev""")
def _(v):
    e = M.evaluate_folds(M.contingency(pred_a(v), ["fold"]))
    return e.select("fold", *[rnd(c).alias(c) for c in ("acc", "kappa", "ece")], "n")


@query("spread", f"""WITH {SQL_PA}, f AS (SELECT subject, avg(CAST(y = yhat AS INTEGER)) AS acc FROM pa GROUP BY subject)
       SELECT {r('avg(acc)')} AS mean, {r('stddev_pop(acc)')} AS std, {r('min(acc)')} AS min, {r('max(acc)')} AS max FROM f""")
def _(v):
    rows = M.accuracy(M.contingency(pred_a(v), ["subject"]), ["subject"])
    return M.spread(rows, "acc").select(*[rnd(c).alias(c) for c in ("mean", "std", "min", "max")])


@query("worst_best_fold", f"""WITH {SQL_PA}, f AS (SELECT subject, avg(CAST(y = yhat AS INTEGER)) AS acc FROM pa GROUP BY subject)
       SELECT min_by(subject, {{'a': acc, 's': subject}}) AS worst, {r('min(acc)')} AS worst_acc,
       max_by(subject, {{'a': acc, 's': subject}}) AS best, {r('max(acc)')} AS best_acc FROM f""")
def _(v):
    rows = M.accuracy(M.contingency(pred_a(v), ["subject"]), ["subject"])
    return M.worst_best_fold(rows, "subject").select("worst", rnd("worst_acc").alias("worst_acc"), "best",
                                                     rnd("best_acc").alias("best_acc"))


@query("boundary_accuracy", f"""WITH {SQL_PA} SELECT fold, {r('''count(*) FILTER (y > 0 AND y = yhat)
       / nullif(count(*) FILTER (y > 0 AND yhat > 0), 0)''')} AS load_acc, {r('''100.0 * count(*) FILTER (y = 0 AND yhat > 0)
       / nullif(count(*) FILTER (y = 0), 0)''')} AS rest_to_load, {r('''100.0 * count(*) FILTER (y > 0 AND yhat = 0)
       / nullif(count(*) FILTER (y > 0), 0)''')} AS load_to_rest FROM pa GROUP BY fold""")
def _(v):
    b = M.boundary_accuracy(M.confusion(M.contingency(pred_a(v), ["fold"]), ["fold"], 3), ["fold"])
    return b.select("fold", *[rnd(c).alias(c) for c in ("load_acc", "rest_to_load", "load_to_rest")])


# ---- bootstrap -------------------------------------------------------------------------------------------------

def sql_weight() -> str:
    """Poisson(n) from the words of the digest h."""
    word = lambda j: f"('0x' || substr(h, {1 + 8 * j}, 8))::BIGINT"
    small = " + ".join(f"CASE WHEN n & {1 << j} > 0 THEN len(list_filter({B.poisson_limits(1 << j)}, lambda k: k <= {word(j)})) ELSE 0 END" for j in range(6))
    return f"""({small} + CASE WHEN n >= 64 THEN greatest(CAST(floor((n - n % 64) + sqrt(n - n % 64) * z({word(6)}, {word(7)})
        + (power(z({word(6)}, {word(7)}), 2) - 1) / 6 + 0.5) AS BIGINT), 0) ELSE 0 END)"""


def sql_boot(cells: str, keys: str, stats: str, seed: str, by: str = "", n_boot: int = 1000) -> str:
    """CTEs from cells (keys, n, …): b (by, draw, s) of the draws, p (by, s) of the cells themselves, i (by, lo, hi). ``stats`` reads weights w
    from a table t; ``by`` ends with a comma or is empty."""
    name = " || ':' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys.split(", "))
    normal = "sqrt(-2 * ln((a + 0.5) / 4294967296.0::DOUBLE)) * cos(2 * pi() * (b / 4294967296.0::DOUBLE))"
    weight = re.sub(r"z\((.*?\)::BIGINT), (.*?\)::BIGINT)\)", lambda m: "(" + re.sub(r"\b([ab])\b", lambda x: m[1] if x[1] == "a" else m[2], normal) + ")", sql_weight())
    return f"""hd AS (SELECT c.*, draw, sha256('{seed}:' || draw || ':' || {name}) AS h FROM {cells} c, range(0, {n_boot}) q(draw)),
        wd AS MATERIALIZED (SELECT *, {weight} AS w FROM hd),
        b AS ({stats.format(t='wd', draw='draw,', by=by)}), p AS ({stats.format(t=f'(SELECT *, n AS w FROM {cells})', draw='', by=by)}),
        i AS (SELECT {by} quantile_cont(s, 0.025) AS lo, quantile_cont(s, 0.975) AS hi FROM b WHERE s IS NOT NULL AND NOT isnan(s) {'GROUP BY ' + by.rstrip(',') if by else ''})"""


MEAN = "SELECT {by} {draw} sum(w * v) / nullif(sum(w), 0) AS s FROM {t} GROUP BY ALL"
SQL_CI = f"SELECT fold, {r('s')} AS point, {r('lo')} AS lo, {r('hi')} AS hi FROM p LEFT JOIN i USING (fold)"
SQL_DELTA = f"SELECT {r('s')} AS point, {r('lo')} AS lo, {r('hi')} AS hi, CASE WHEN lo > 0 THEN 'REAL' WHEN hi >= 0 THEN 'noise' ELSE 'REVERSED' END AS verdict FROM p, i"


def sql_kappa_of(y: str, yhat: str) -> str:
    po = f"(sum(CASE WHEN {y} = {yhat} THEN w ELSE 0 END)::DOUBLE / nullif(sum(w), 0))"
    pe = "((" + " + ".join(f"sum(CASE WHEN {y} = {k} THEN w ELSE 0 END)::DOUBLE * sum(CASE WHEN {yhat} = {k} THEN w ELSE 0 END)" for k in range(3)) + ") / nullif(sum(w)::DOUBLE * sum(w), 0))"
    return f"(({po} - {pe}) / nullif(1 - {pe}, 0))"


SQL_CELLS = f"""{SQL_PA}, cl AS (SELECT fold, y, yhat, bin, avg(conf) AS conf, count(*) AS n FROM (SELECT *, {sql_bin('conf', 15)} AS bin FROM pa) GROUP BY ALL)"""
ECE_OF = " + ".join(f"abs(sum(CASE WHEN bin = {b} THEN w * (CAST(y = yhat AS INTEGER) - conf) ELSE 0 END))" for b in range(15))


def rounded(out, *keep):
    return out.select(*keep, *[rnd(c).alias(c) for c in ("point", "lo", "hi")], *[c for c in out.columns if c == "verdict"])


def boot_rows(v):
    return pred_a(v).withColumn("bin", M.conf_bin("conf", 15))


@query("bootstrap_ci", f"""WITH {SQL_PA}, cl AS (SELECT fold, CAST(y = yhat AS INTEGER) AS v, count(*) AS n FROM pa GROUP BY ALL),
       {sql_boot('cl', 'fold, v', MEAN, '0', 'fold,')} {SQL_CI}""")
def _(v):
    return rounded(B.bootstrap_ci(pred_a(v).select("fold", (F.col("y") == F.col("yhat")).cast("int").alias("hit")), "hit", by=["fold"]), "fold")


@query("bootstrap_kappa", f"""WITH {SQL_CELLS}, c2 AS (SELECT fold, y, yhat, sum(n)::BIGINT AS n FROM cl GROUP BY ALL),
       {sql_boot('c2', 'fold, y, yhat', 'SELECT {by} {draw} ' + sql_kappa_of('y', 'yhat') + ' AS s FROM {t} GROUP BY ALL', '2', 'fold,')} {SQL_CI}""")
def _(v):
    return rounded(B.bootstrap(pred_a(v), B.kappa(3), ["y", "yhat"], seed=2, by=["fold"]), "fold")


@query("bootstrap_ece", f"""WITH {SQL_CELLS},
       {sql_boot('cl', 'fold, y, yhat, bin', 'SELECT {by} {draw} (' + ECE_OF + ') / nullif(sum(w), 0) AS s FROM {t} GROUP BY ALL', '3', 'fold,')} {SQL_CI}""")
def _(v):
    return rounded(B.bootstrap(boot_rows(v), B.calibration_error(), ["y", "yhat", "bin"], ["conf"], seed=3, by=["fold"]), "fold")


def arm_hit(v, p):
    return v.preds.select("trial", "y", argmax0(p).alias("yhat"))


@query("paired_bootstrap_delta", f"""WITH h AS (SELECT CAST(y = list_position(pa, list_max(pa)) - 1 AS INTEGER) AS a, CAST(y = list_position(pb, list_max(pb)) - 1 AS INTEGER) AS b FROM preds),
       cl AS (SELECT a, b, b - a AS v, count(*) AS n FROM h GROUP BY ALL), {sql_boot('cl', 'a, b', MEAN, '1')} {SQL_DELTA}""")
def _(v):
    hit = lambda p: arm_hit(v, p).select("trial", (F.col("yhat") == F.col("y")).cast("int").alias("hit"))
    return rounded(B.paired_bootstrap_delta(hit("pa"), hit("pb"), "trial", "hit", seed=1))


@query("paired_bootstrap_kappa", f"""WITH h AS (SELECT y, list_position(pa, list_max(pa)) - 1 AS a, list_position(pb, list_max(pb)) - 1 AS b FROM preds),
       cl AS (SELECT y AS ya, a, y AS yb, b, count(*) AS n FROM h GROUP BY ALL),
       {sql_boot('cl', 'ya, a, yb, b', 'SELECT {by} {draw} ' + sql_kappa_of('y', 'b').replace('y', 'yb') + ' - ' + sql_kappa_of('y', 'a').replace('y', 'ya') + ' AS s FROM {t} GROUP BY ALL', '4')} {SQL_DELTA}""")
def _(v):
    return rounded(B.paired_bootstrap(arm_hit(v, "pa"), arm_hit(v, "pb"), "trial", B.kappa(3), ["y", "yhat"], seed=4))


# ---- temperature -----------------------------------------------------------------------------------------------

def sql_temperature(by: str, logits: str, points: int = 32, rounds: int = 3, src: str = "preds") -> str:
    """CTEs z, b0, f1, b1, … fitting the temperature per ``by``; the result is f<rounds>."""
    lo, hi = float(np.log(0.05)), float(np.log(20.0))
    nll = f"ln(list_sum(list_transform(z, lambda q: exp(q / t)))) - z[y + 1] / t"
    out = [f"z AS (SELECT {by}, y, list_transform({logits}, lambda q: q - list_max({logits})) AS z FROM {src})",
           f"b0 AS (SELECT DISTINCT {by}, {lo!r}::DOUBLE AS lo, {hi!r}::DOUBLE AS hi FROM z)"]
    for i in range(1, rounds + 1):
        out.append(f"""e{i} AS (SELECT {by}, k, any_value(lo) AS lo, any_value(hi) AS hi, avg({nll}) AS m FROM (SELECT z.*, k, lo, hi,
            exp(lo + (hi - lo) * (k / {points - 1}::DOUBLE)) AS t FROM z JOIN b{i - 1} USING ({by}), range(0, {points}) q(k))
            GROUP BY {by}, k)""")
        out.append(f"""f{i} AS (SELECT {by}, any_value(lo) AS lo, any_value(hi) AS hi, min(m) AS nll, any_value(lo) AS lo, any_value(hi) AS hi,
            any_value(lo) + (any_value(hi) - any_value(lo)) / {points - 1} * min_by(k, {{'m': m, 'k': k}}) AS tbest
            FROM e{i} GROUP BY {by})""")
        out.append(f"""b{i} AS (SELECT {by}, tbest - (hi - lo) / {points - 1} AS lo, tbest + (hi - lo) / {points - 1} AS hi FROM f{i})""")
    return ", ".join(out)


@query("temperature_fit", f"""WITH {sql_temperature('fold', 'za')} SELECT fold, {r('exp(tbest)')} AS temperature, {r('nll')} AS nll FROM f3""")
def _(v):
    t = M.temperature_fit(v.preds, ["fold"], "za")
    return t.select("fold", rnd("temperature").alias("temperature"), rnd("nll").alias("nll"))


def sql_soft(z: str, t: str) -> str:
    e = lambda i: f"exp({z}[{i}] / {t})"
    return "[" + ", ".join(f"{e(i)} / ({e(1)} + {e(2)} + {e(3)})" for i in (1, 2, 3)) + "]"


@query("temperature_apply", f"""WITH p AS (SELECT trial, {sql_soft('za', '2.5')} AS p FROM preds)
       SELECT trial, {r('p[1]')} AS p0, {r('p[2]')} AS p1, {r('p[3]')} AS p2 FROM p""")
def _(v):
    p = v.preds.select("trial", softmax("za", 1 / 2.5).alias("p"))
    return p.select("trial", *[rnd(F.col("p")[i]).alias(f"p{i}") for i in range(3)])


def sql_ece_rows(name: str, cond: str, t: str) -> str:
    p = sql_soft("za", t)
    src = (f"(SELECT fold, y, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS yhat, list_max(p) AS conf FROM "
           f"(SELECT fold, y, {p} AS p FROM fitted WHERE {cond}))")
    return f"{name} AS ({sql_ece(src, 'fold,')})"


@query("calibration_transfer", f"""WITH {sql_temperature('fold', 'za', src='(SELECT * FROM preds WHERE year < 1998)')},
       fitted AS (SELECT preds.*, exp(tbest) AS t FROM preds JOIN f3 USING (fold)), {sql_ece_rows('a', 'year < 1998', '1')},
       {sql_ece_rows('b', 'year < 1998', 't')}, {sql_ece_rows('c', 'year >= 1998', '1')}, {sql_ece_rows('d', 'year >= 1998', 't')},
       m AS (SELECT avg(exp(tbest)) AS temperature, avg(a.ece) AS va, avg(b.ece) AS vb, avg(c.ece) AS ta, avg(d.ece) AS tb,
             count(*) AS n FROM f3 JOIN a USING (fold) JOIN b USING (fold) JOIN c USING (fold) JOIN d USING (fold)),
       q AS (SELECT *, CASE WHEN va - vb > 1e-6 THEN round((ta - tb) / (va - vb), 3) END AS ratio FROM m)
       SELECT {r('temperature')} AS temperature, {r('va')} AS val_ece_uncal, {r('vb')} AS val_ece_temp, {r('ta')} AS test_ece_uncal,
       {r('tb')} AS test_ece_temp, n, ratio, CASE WHEN ratio IS NULL THEN 'already calibrated' WHEN ratio < 0.5 THEN 'limited'
       WHEN ratio < 1.2 THEN 'partial' ELSE 'transfers' END AS verdict FROM q""")
def _(v):
    """The temperature is fitted on the validation years alone; the test years only show what is left of the gain."""
    val = F.col("year") < 1998
    t = checkpointed(M.temperature_fit(v.preds.filter(val), ["fold"], "za").select("fold", "temperature"))
    rows, both = t, v.preds.join(shipped(t), "fold")
    for name, cond, scale in (("val_ece_uncal", val, 1.0), ("val_ece_temp", val, 1.0 / F.col("temperature")), ("test_ece_uncal", ~val, 1.0),
                              ("test_ece_temp", ~val, 1.0 / F.col("temperature"))):
        p = M.predict_label(both.filter(cond).select("fold", "y", softmax("za", scale).alias("probs")))
        e = M.ece(M.contingency(p, ["fold"]), ["fold"]).withColumnRenamed("ece", name)
        rows = rows.join(e, "fold")
    out = M.calibration_transfer(rows)
    nums = ("temperature", "val_ece_uncal", "val_ece_temp", "test_ece_uncal", "test_ece_temp")
    return out.select(*[rnd(c).alias(c) for c in nums], "n", "ratio", "verdict")


# ---- fusion ----------------------------------------------------------------------------------------------------

@query("late_fusion", f"""SELECT trial, {r('(pa[1] + pb[1]) / 2')} AS p0, {r('(pa[2] + pb[2]) / 2')} AS p1,
       {r('(pa[3] + pb[3]) / 2')} AS p2 FROM preds""")
def _(v):
    p = FU.late_fusion(v.preds, "pa", "pb")
    return p.select("trial", *[rnd(F.col("fused")[i]).alias(f"p{i}") for i in range(3)])


def sweep_input(v):
    mixed = F.zip_with("za", "zb", lambda x, y: 0.7 * x + 0.3 * y)
    return v.preds.select("trial", "fold", "y", "pa", "pb", let(mixed, lambda m: softmax(m)).alias("st"),
                          softmax("za", 1 / 1.5).alias("ca"), softmax("zb", 1 / 0.7).alias("cb"))


def sql_hit(p: str) -> str:
    return f"avg(CAST(y = list_position({p}, list_max({p})) - 1 AS INTEGER))"


def sql_zip(e: str) -> str:
    return "[" + ", ".join(e.replace("#", str(i)) for i in (1, 2, 3)) + "]"


SQL_SWEEP = f"""s AS (SELECT trial, fold, y, pa, pb, {sql_soft('(' + sql_zip('0.7 * za[#] + 0.3 * zb[#]') + ')', '1')} AS st,
       {sql_soft('za', '1.5')} AS ca, {sql_soft('zb', '0.7')} AS cb FROM preds),
       u AS (SELECT *, {sql_zip('(pa[#] + pb[#]) / 2')} AS m1, {sql_zip('pa[#] * pb[#]')} AS m2,
             {sql_zip('list_max(pa) * pa[#] + list_max(pb) * pb[#]')} AS m3,
             CASE WHEN list_max(pa) >= list_max(pb) THEN pa ELSE pb END AS m4, {sql_zip('(ca[#] + cb[#]) / 2')} AS m5,
             {sql_zip('list_max(ca) * ca[#] + list_max(cb) * cb[#]')} AS m6,
             y = list_position(pa, list_max(pa)) - 1 AS ha, y = list_position(pb, list_max(pb)) - 1 AS hb FROM s),
       sw AS (SELECT fold, {sql_hit('m1')} AS mean, {sql_hit('m2')} AS product, {sql_hit('m3')} AS conf_weight,
              {sql_hit('m4')} AS maxconf_pick, {sql_hit('st')} AS stacking, {sql_hit('m5')} AS cal_mean,
              {sql_hit('m6')} AS cal_conf_weight,
              avg(list_max(pa)) FILTER (ha) - avg(list_max(pa)) FILTER (NOT ha) AS gap_a,
              avg(list_max(pb)) FILTER (hb) - avg(list_max(pb)) FILTER (NOT hb) AS gap_b FROM u GROUP BY fold),
       co AS (SELECT fold, avg(CAST(ha OR hb AS INTEGER)) AS oracle_either, avg(CAST(ha AND hb AS INTEGER)) AS both_correct,
              avg(CAST(ha AND NOT hb AS INTEGER)) AS a_only, avg(CAST(hb AND NOT ha AS INTEGER)) AS b_only,
              avg(CAST(NOT ha AND NOT hb AS INTEGER)) AS both_wrong,
              greatest(avg(CAST(ha AS INTEGER)), avg(CAST(hb AS INTEGER))) AS best_single,
              (avg(CAST(ha AND hb AS INTEGER)) - avg(CAST(ha AS INTEGER)) * avg(CAST(hb AS INTEGER))) / nullif(sqrt(
              avg(CAST(ha AS INTEGER)) * (1 - avg(CAST(ha AS INTEGER))) * avg(CAST(hb AS INTEGER))
              * (1 - avg(CAST(hb AS INTEGER)))), 0) AS err_corr FROM u GROUP BY fold)"""
SWEEP_COLS = [*FU.SWEEP, "gap_a", "gap_b"]
COMP_COLS = ["oracle_either", "both_correct", "a_only", "b_only", "both_wrong", "best_single", "err_corr"]


def correctness(v):
    return v.preds.select("trial", "fold", (argmax0("pa") == F.col("y")).alias("ca"), (argmax0("pb") == F.col("y")).alias("cb"))


@query("aggregation_sweep", f"WITH {SQL_SWEEP} SELECT fold, {', '.join(f'{r(c)} AS {c}' for c in SWEEP_COLS)} FROM sw")
def _(v):
    s = FU.aggregation_sweep(sweep_input(v), ["fold"], "pa", "pb", "st", "ca", "cb")
    return s.select("fold", *[rnd(c).alias(c) for c in SWEEP_COLS])


@query("complementarity", f"WITH {SQL_SWEEP} SELECT fold, {', '.join(f'{r(c)} AS {c}' for c in COMP_COLS)} FROM co")
def _(v):
    return FU.complementarity(correctness(v), ["fold"]).select("fold", *[rnd(c).alias(c) for c in COMP_COLS])


@query("oracle_gap", f"""WITH {SQL_SWEEP}, g AS (SELECT fold, greatest({', '.join(FU.SWEEP)}) AS best_combined, best_single,
       oracle_either FROM sw JOIN co USING (fold)) SELECT fold, {r('best_combined')} AS best_combined, {r('best_single')} AS
       best_single, {r('best_combined - best_single')} AS gain, {r('oracle_either - best_combined')} AS oracle_gap FROM g""")
def _(v):
    g = FU.oracle_gap(FU.aggregation_sweep(sweep_input(v), ["fold"], "pa", "pb", "st", "ca", "cb"),
                      FU.complementarity(correctness(v), ["fold"]), ["fold"])
    return g.select("fold", *[rnd(c).alias(c) for c in ("best_combined", "best_single", "gain", "oracle_gap")])


@query("block_report", """SELECT trial, subject, y AS truth, CAST(list_position(pa, list_max(pa)) - 1 AS INTEGER) AS pred_a,
       CAST(list_position(pb, list_max(pb)) - 1 AS INTEGER) AS pred_b, y = list_position(pa, list_max(pa)) - 1 AS ca,
       y = list_position(pb, list_max(pb)) - 1 AS cb FROM preds""")
def _(v):
    a = v.preds.select("trial", "subject", F.col("y").alias("truth"), argmax0("pa").alias("pred_a"))
    return FU.block_report(a, v.preds.select("trial", argmax0("pb").alias("pred_b")), ["trial"])


# ---- run tables ------------------------------------------------------------------------------------------------

@query("mean_se", f"""SELECT method, {r('avg(acc)')} AS mean, {r('stddev_pop(acc) / sqrt(count(*))')} AS se, count(*) AS n
       FROM runs_v GROUP BY method""")
def _(v):
    m = M.mean_se(v.runs_v, ["method"], "acc")
    return m.select("method", rnd("mean").alias("mean"), rnd("se").alias("se"), "n")


SQL_CELLS = """cl AS (SELECT dataset AS subject, CASE WHEN method = 'a' AND regime < 'y1998' THEN 'within_single' WHEN method = 'a'
       THEN 'within_avg' WHEN regime < 'y1998' THEN 'cross_single' ELSE 'cross_avg' END AS cell, 1 AS k, acc FROM runs_v)"""


@query("inflation_grid", f"""WITH {SQL_CELLS}, g AS (SELECT k, cell, avg(acc) AS acc FROM cl GROUP BY k, cell)
       SELECT k, cell, {r('acc')} AS acc, {r("acc - (SELECT acc FROM g WHERE cell = 'cross_single')")} AS inflation FROM g""")
def _(v):
    early = F.col("regime") < "y1998"
    cell = (F.when((F.col("method") == "a") & early, "within_single").when(F.col("method") == "a", "within_avg")
            .when(early, "cross_single").otherwise("cross_avg"))
    rows = v.runs_v.select(F.col("dataset").alias("subject"), cell.alias("cell"), F.lit(1).alias("k"), "acc")
    g = M.inflation_grid(rows)
    return g.select("k", "cell", rnd("acc").alias("acc"), rnd("inflation").alias("inflation"))


SQL_INV = """i AS (SELECT run, CAST(CASE WHEN method = 'a' THEN 1 ELSE 5 END AS INTEGER) AS k, acc * 1.9 AS acc,
       CASE WHEN n > 420 THEN acc * 1.9 ELSE acc END AS point, acc * 1.7 AS lo, acc * 2.0 AS hi, 0.6 AS chance, 0.1 AS a, acc AS b,
       CASE WHEN n < 430 THEN acc - 0.1 ELSE acc END AS delta FROM runs_v)"""


@query("check_invariants", f"""WITH {SQL_INV} SELECT run, k, rule FROM (
       SELECT run, k, 'bounded' AS rule, NOT (acc BETWEEN 0 AND 1) AS bad FROM i UNION ALL
       SELECT run, k, 'bracket', NOT (point BETWEEN lo AND hi) FROM i UNION ALL
       SELECT run, k, 'ci_mean', abs(point - acc) > 1e-6 FROM i UNION ALL
       SELECT run, k, 'chance', k = 1 AND acc < chance FROM i UNION ALL
       SELECT run, k, 'delta', abs(delta - (b - a)) > 1e-6 FROM i) WHERE bad""")
def _(v):
    acc = F.col("acc")
    runs = v.runs_v.select("run", F.when(F.col("method") == "a", 1).otherwise(5).alias("k"), (acc * 1.9).alias("acc"),
                           F.when(F.col("n") > 420, acc * 1.9).otherwise(acc).alias("point"), (acc * 1.7).alias("lo"),
                           (acc * 2.0).alias("hi"), F.lit(0.6).alias("chance"), F.lit(0.1).alias("a"), acc.alias("b"),
                           F.when(F.col("n") < 430, acc - 0.1).otherwise(acc).alias("delta"))
    return M.check_invariants(runs)


@query("prediction_report", f"""WITH {SQL_PA}, e AS (SELECT y, min(trial) AS example, min_by(yhat, trial) AS yhat, min_by(pa, trial)
       AS p FROM pa GROUP BY y)
       SELECT example, ['rest', 'load', 'move'][y + 1] AS truth, ['rest', 'load', 'move'][yhat + 1] AS pred, {r('p[1]', 3)} AS p0,
       {r('p[2]', 3)} AS p1, {r('p[3]', 3)} AS p2, y = yhat AS correct, (SELECT {r('avg(CAST(y = yhat AS INTEGER))', 3)} FROM pa)
       AS acc, 0.333::DOUBLE AS chance FROM e""")
def _(v):
    p = pred_a(v, "probs")
    out = M.prediction_report(p, "trial", {0: "rest", 1: "load", 2: "move"})
    return out.select("example", "truth", "pred", *[F.col("probs")[i].alias(f"p{i}") for i in range(3)], "correct", "acc", "chance")


SQL_TRIALS = """tr AS (SELECT l_linenumber AS study, l_suppkey AS trial, l_returnflag || l_linestatus AS family,
       avg(l_discount + l_extendedprice / 1e6) AS weight FROM lineitem GROUP BY ALL),
       vl AS (SELECT l_linenumber AS study, l_suppkey AS trial, round(avg(ln(l_extendedprice)), 9) AS value FROM lineitem GROUP BY ALL),
       rk AS (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value DESC, trial) - 1 AS pos,
              count(*) OVER (PARTITION BY study) AS n FROM vl),
       im AS (SELECT study, family, avg(weight) AS weight FROM tr JOIN rk USING (study, trial)
              WHERE pos < greatest(1, floor(n * 0.2)) GROUP BY study, family)"""


def importance(v):
    li = v.table("lineitem")
    keys = [F.col("l_linenumber").alias("study"), F.col("l_suppkey").alias("trial")]
    tr = li.groupBy(*keys, F.concat("l_returnflag", "l_linestatus").alias("family")).agg(
        F.avg(F.col("l_discount") + F.col("l_extendedprice") / 1e6).alias("weight"))
    vl = li.groupBy(*keys).agg(F.round(F.avg(F.log("l_extendedprice")), 9).alias("value"))
    return M.importance_summary(tr.join(vl, ["study", "trial"]), 0.2)


@query("importance_summary", f"WITH {SQL_TRIALS} SELECT study, family, {r('weight')} AS weight FROM im")
def _(v):
    return importance(v).select("study", "family", rnd("weight").alias("weight"))


@query("importance_consensus", f"""WITH {SQL_TRIALS}, t AS (SELECT study, family FROM (SELECT *, row_number() OVER (PARTITION BY study
       ORDER BY weight DESC, family) AS rk FROM im) WHERE rk <= 3),
       j AS (SELECT a.study AS x, b.study AS y, (SELECT count(*) FROM t p JOIN t q USING (family) WHERE p.study = a.study AND
             q.study = b.study) AS inter FROM (SELECT DISTINCT study FROM t) a JOIN (SELECT DISTINCT study FROM t) b ON a.study < b.study),
       m AS (SELECT avg(inter / (6.0 - inter)) AS mj FROM j), f AS (SELECT family, avg(weight) AS weight FROM im GROUP BY family)
       SELECT family, {r('weight')} AS weight, CAST(row_number() OVER (ORDER BY weight DESC, family) AS INTEGER) AS position,
       (SELECT {r('mj')} FROM m) AS mean_jaccard FROM f""")
def _(v):
    c = M.consensus(importance(v), 3)
    return c.select("family", rnd("weight").alias("weight"), "position", rnd("mean_jaccard").alias("mean_jaccard"))


@query("tradeoff_knee", f"""WITH p AS (SELECT year, subject, avg(CAST(y = list_position(pa, list_max(pa)) - 1 AS INTEGER)) AS acc,
       [avg(pa[1]), avg(pa[2]), avg(pa[3])] AS w FROM preds GROUP BY year, subject),
       e AS (SELECT year, subject, acc, exp(-list_sum(list_transform(w, lambda q: CASE WHEN q > 1e-9 THEN q * ln(q) ELSE 0 END)))
             AS eff_n FROM p),
       s AS (SELECT *, sqrt(power(1 - (acc - min(acc) OVER w) / (max(acc) OVER w - min(acc) OVER w + 1e-9), 2) +
             power((eff_n - min(eff_n) OVER w) / (max(eff_n) OVER w - min(eff_n) OVER w + 1e-9), 2)) AS d FROM e
             WINDOW w AS (PARTITION BY year))
       SELECT year, min_by(subject, d) AS subject, {r('min_by(acc, d)')} AS acc, {r('min_by(eff_n, d)')} AS eff_n FROM s GROUP BY year""")
def _(v):
    hit = (argmax0("pa") == F.col("y")).cast("int")
    p = v.preds.groupBy("year", "subject").agg(F.avg(hit).alias("acc"), F.array(*[F.avg(F.col("pa")[i]) for i in range(3)]).alias("w"))
    p = p.select("year", "subject", "acc", M.effective_n(F.col("w")).alias("eff_n"))
    return M.tradeoff_knee(p, ["year"], "subject").select("year", "subject", rnd("acc").alias("acc"), rnd("eff_n").alias("eff_n"))


@query("cv_score", f"""WITH {SQL_ARMS}, k AS ({sql_kappa('arms', 'arm, year, fold,')}),
       a AS (SELECT arm, year, fold, avg(CAST(y = yhat AS INTEGER)) AS acc FROM arms GROUP BY ALL)
       SELECT arm, {r('avg(acc)')} AS acc, {r('stddev_pop(acc)')} AS acc_std, {r('avg(kappa)')} AS kappa
       FROM a JOIN k USING (arm, year, fold) GROUP BY arm""")
def _(v):
    c = M.contingency(arms(v).withColumnRenamed("year", "seed"), ["arm", "seed", "fold"])
    return M.cv_score(c, ["arm"]).select("arm", *[rnd(x).alias(x) for x in ("acc", "acc_std", "kappa")])


@query("arm_ablation", f"""WITH {SQL_ARMS}, s AS (SELECT 'all' AS classes, arm, avg(CAST(y = yhat AS INTEGER)) AS acc FROM arms
       GROUP BY arm UNION ALL SELECT '0v2', arm, avg(CAST((y = 2) = (yhat = 2) AS INTEGER)) FROM arms WHERE y IN (0, 2) GROUP BY arm)
       SELECT classes, arm, {r('acc')} AS acc, {r("acc - max(CASE WHEN arm = 'a' THEN acc END) OVER (PARTITION BY classes)")} AS delta
       FROM s""")
def _(v):
    a = arms(v)
    full = a.groupBy("arm").agg(F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("acc")).withColumn("classes", F.lit("all"))
    pair = restrict_classes(a, 0, 2, "y").groupBy("arm").agg(
        F.avg(((F.col("binary") == 1) == (F.col("yhat") == 2)).cast("int")).alias("acc")).withColumn("classes", F.lit("0v2"))
    out = M.arm_ablation(full.unionByName(pair), "a", by=["classes"])
    return out.select("classes", "arm", rnd("acc").alias("acc"), rnd("delta").alias("delta"))


@query("headroom", f"""WITH {SQL_ARMS}, h AS (SELECT arm, avg(CAST(y = yhat AS INTEGER)) FILTER (year < 1998) AS within,
       avg(CAST(y = yhat AS INTEGER)) FILTER (year >= 1998) AS "cross" FROM arms GROUP BY arm)
       SELECT arm, {r('within')} AS within, {r('"cross"')} AS "cross", {r('within - "cross"')} AS headroom,
       within - "cross" < 0.02 AS small FROM h""")
def _(v):
    reg = F.when(F.col("year") < 1998, "within").otherwise("cross")
    runs = arms(v).groupBy("arm", reg.alias("regime")).agg(F.avg((F.col("y") == F.col("yhat")).cast("int")).alias("acc"))
    h = M.headroom(runs, ["arm"])
    return h.select("arm", *[rnd(c).alias(c) for c in ("within", "cross", "headroom")], "small")
