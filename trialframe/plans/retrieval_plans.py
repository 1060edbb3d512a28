"""Queries over embedding retrieval, and the flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.columns import rnd
from trialframe.operators import bootstrap as B
from trialframe.operators import metrics as M
from trialframe.operators import retrieval as R
from trialframe.operators import splits
from trialframe.plans.metric_plans import sql_boot, sql_ece, sql_kappa
from trialframe.plans.registry import query, r

SQL_LONG = "lg AS (SELECT trial, subject, concept, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM emb)"
SQL_UNIT = """un AS (SELECT trial, subject, concept, list_transform(v, lambda q: q / (sqrt(list_inner_product(v, v)) + 1e-8)) AS u
       FROM emb)"""
SQL_BANK = f"""{SQL_LONG}, {SQL_UNIT}, pm AS (SELECT concept, list(m ORDER BY i) AS m FROM (SELECT concept, i, avg(x) AS m FROM lg
       GROUP BY concept, i) GROUP BY concept),
       bank AS (SELECT concept, list_transform(m, lambda q: q / (sqrt(list_inner_product(m, m)) + 1e-8)) AS p FROM pm),
       sc AS (SELECT un.trial, un.concept AS label, bank.concept AS cand, list_inner_product(u, p) AS s FROM un, bank),
       tr AS (SELECT trial, s AS st FROM sc WHERE cand = label),
       rk AS (SELECT trial, label, any_value(st) AS st, 1 + count(*) FILTER (s > st AND cand <> label) AS rank, max(s) AS best,
              min_by(cand, {{'s': -s, 'c': cand}}) AS pred, sum(s) AS total, count(*) AS n FROM sc JOIN tr USING (trial)
              GROUP BY trial, label)"""


def units(v):
    return R.l2_normalize(v.emb)


def bank(v):
    return R.concept_prototypes(v.emb, ["concept"])


def state(v, scale=1.0):
    return R.retrieval_state(units(v), bank(v), ["trial"], scale)


@query("l2_normalize", f"WITH {SQL_UNIT} SELECT trial, CAST(i - 1 AS INTEGER) AS i, {r('u[i]')} AS x FROM un, range(1, 65) t(i)")
def _(v):
    return units(v).select("trial", F.posexplode("v").alias("i", "x")).withColumn("x", rnd("x"))


@query("concept_prototypes", f"WITH {SQL_BANK} SELECT concept, CAST(i - 1 AS INTEGER) AS i, {r('p[i]')} AS x FROM bank, range(1, 65) t(i)")
def _(v):
    return bank(v).select("concept", F.posexplode("v").alias("i", "x")).withColumn("x", rnd("x"))


@query("score_matrix", f"WITH {SQL_BANK} SELECT trial, CAST(cand AS BIGINT) AS cand, {r('s')} AS s FROM sc")
def _(v):
    return R.score_matrix(units(v), bank(v), ["trial"]).withColumn("s", rnd("s"))


@query("retrieval_hits", f"""WITH {SQL_BANK} SELECT trial, rank, CAST(rank <= 1 AS INTEGER) AS hit1, CAST(rank <= 5 AS INTEGER) AS hit5
       FROM rk""")
def _(v):
    return R.retrieval_hits(state(v)).select("trial", "rank", "hit1", "hit5")


@query("retrieval_metrics", f"""WITH {SQL_BANK} SELECT {r('avg(CAST(rank <= 1 AS INTEGER))')} AS recall1,
       {r('avg(CAST(rank <= 5 AS INTEGER))')} AS recall5, {r('avg(1.0 / rank)')} AS mrr, {r('quantile_cont(rank, 0.5)')} AS median_rank
       FROM rk""")
def _(v):
    return R.retrieval_metrics(state(v), []).select(*[rnd(c).alias(c) for c in ("recall1", "recall5", "mrr", "median_rank")])


@query("bootstrap_recall", f"""WITH {SQL_BANK}, cl AS (SELECT rank, count(*) AS n FROM rk GROUP BY rank),
       {sql_boot('cl', 'rank', 'SELECT {by} {draw} sum(CASE WHEN rank <= 5 THEN w ELSE 0 END)::DOUBLE / nullif(sum(w), 0) AS s FROM {t} GROUP BY ALL', '5')}
       SELECT {r('s')} AS point, {r('lo')} AS lo, {r('hi')} AS hi FROM p, i""")
def _(v):
    out = B.bootstrap(R.retrieval_hits(state(v)), B.recall_at(5), ["rank"], seed=5)
    return out.select(*[rnd(c).alias(c) for c in ("point", "lo", "hi")])


@query("retrieval_pr_auc", f"""WITH {SQL_BANK}, g AS (SELECT s, sum(CAST(cand = label AS INTEGER)) AS p, count(*) AS n FROM sc GROUP BY s),
       c AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY s DESC))
       SELECT {r('sum(p * cp / cn) / sum(p)')} AS pr_auc FROM c""")
def _(v):
    return R.pr_auc(units(v), bank(v)).withColumn("pr_auc", rnd("pr_auc"))


SQL_CONF = """cf AS (SELECT k.trial % 4 AS grp, label AS y, pred AS yhat, 1 / sum(exp(12 * (s - best))) AS conf
       FROM rk k JOIN sc USING (trial, label) GROUP BY k.trial, label, pred)"""


@query("retrieval_calibration", f"""WITH {SQL_BANK}, {SQL_CONF}, e AS ({sql_ece('cf', 'grp,', 10)})
       SELECT grp, {r('avg(CAST(y = yhat AS INTEGER))')} AS acc, count(*) AS n, {r('any_value(ece)')} AS ece,
       {r('avg(conf) FILTER (y = yhat) - avg(conf) FILTER (y <> yhat)')} AS conf_gap FROM cf JOIN e USING (grp) GROUP BY grp""")
def _(v):
    s = state(v, 12.0).withColumn("grp", F.col("trial") % 4)
    c = R.retrieval_calibration(s, ["grp"])
    return c.select("grp", rnd("acc").alias("acc"), "n", rnd("ece").alias("ece"), rnd("conf_gap").alias("conf_gap"))


@query("retrieval_continuous", f"""WITH {SQL_BANK}, m AS (SELECT st, st - (total - st) / (n - 1) AS mg, rank FROM rk),
       un2 AS (SELECT concept, list_transform(p, lambda q: q / sqrt(list_inner_product(p, p))) AS q FROM bank),
       rp AS (SELECT avg(list_inner_product(a.q, b.q)) AS rm, stddev_samp(list_inner_product(a.q, b.q)) AS rs
              FROM un2 a JOIN un2 b ON a.concept <> b.concept)
       SELECT {r('avg(st)')} AS cos_mean, {r('stddev_samp(st)')} AS cos_std, {r('avg(mg)')} AS margin_mean,
       {r('stddev_samp(mg)')} AS margin_std, {r('avg(rank)')} AS mean_rank, {r('any_value(rm)')} AS random_mean,
       {r('any_value(rs)')} AS random_std, {r('(avg(st) - any_value(rm)) / (any_value(rs) + 1e-8)')} AS cos_z FROM m, rp""")
def _(v):
    out = R.retrieval_continuous(state(v), R.bank_pair_stats(bank(v)))
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("concept_average", f"""WITH {SQL_LONG}, half AS (SELECT trial, row_number() OVER (PARTITION BY subject ORDER BY md5('0:' || trial)) - 1
       < count(*) OVER (PARTITION BY subject) // 2 AS calib FROM emb),
       pv AS (SELECT calib, concept, list(m ORDER BY i) AS m FROM (SELECT calib, concept, i, avg(x) AS m FROM lg JOIN half USING (trial)
              GROUP BY ALL) GROUP BY ALL),
       pu AS (SELECT calib, concept, list_transform(m, lambda q: q / (sqrt(list_inner_product(m, m)) + 1e-8)) AS u FROM pv),
       sc AS (SELECT a.concept, b.concept AS cand, list_inner_product(a.u, b.u) AS s FROM pu a JOIN pu b ON NOT a.calib AND b.calib),
       rk AS (SELECT concept, 1 + count(*) FILTER (s > (SELECT t.s FROM sc t WHERE t.concept = sc.concept AND t.cand = sc.concept)) AS rank
              FROM sc GROUP BY concept)
       SELECT {r('avg(CAST(rank <= 1 AS INTEGER))')} AS recall1, {r('avg(CAST(rank <= 5 AS INTEGER))')} AS recall5, {r('1.0 / count(*)')}
       AS chance FROM rk""")
def _(v):
    h = splits.calibration_half(v.emb, 0, ["trial"])
    b = R.concept_prototypes(h.filter("calib"), ["concept"])
    m = R.retrieval_metrics(R.concept_average(h.filter("NOT calib"), b), [])
    k = b.agg((1.0 / F.count(F.lit(1))).alias("c")).scalar()
    return m.select(rnd("recall1").alias("recall1"), rnd("recall5").alias("recall5"), F.round(k, 6).alias("chance"))


@query("embedding_mse", f"""WITH {SQL_BANK}, d AS (SELECT e.concept, list_sum(list_transform(list_zip(e.v, b.p), lambda q: (q[1] - q[2]) *
       (q[1] - q[2]))) / 64 AS mse FROM emb e JOIN bank b USING (concept)) SELECT concept, {r('avg(mse)')} AS mse FROM d GROUP BY concept""")
def _(v):
    return R.embedding_mse(v.emb, bank(v)).groupBy("concept").agg(rnd(F.avg("mse")).alias("mse"))


@query("nearest_concepts", f"""WITH {SQL_BANK}, u2 AS (SELECT concept, list_transform(p, lambda q: q / sqrt(list_inner_product(p, p))) AS q FROM bank),
       s AS (SELECT a.concept, b.concept AS neighbour, list_inner_product(a.q, b.q) AS sim FROM u2 a JOIN u2 b ON a.concept <> b.concept),
       k AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY sim DESC, neighbour) - 1 AS place FROM s)
       SELECT CAST(concept AS BIGINT) AS concept, CAST(place AS INTEGER) AS place, CAST(neighbour AS BIGINT) AS neighbour, {r('sim')} AS sim
       FROM k WHERE place < 3""")
def _(v):
    return R.nearest_concepts(bank(v), 3).withColumn("sim", rnd("sim"))


# ---- key-dependent centroids -----------------------------------------------------------------------------------

def sql_keyed(key: str, test: str, train: str, arm: str, out: str) -> str:
    """CTEs for retrieval of ``test`` rows against the key's centroids from ``train`` (long form)."""
    own = f"(SELECT {key} AS k, concept, i, sum(x) AS s, count(*) AS n FROM {train} GROUP BY ALL)"
    if arm == "within":
        cent = f"SELECT k, concept, i, s, n FROM {own}"
    else:
        cent = f"""SELECT k.k, t.concept, t.i, t.s - coalesce(o.s, 0) AS s, t.n - coalesce(o.n, 0) AS n
            FROM (SELECT DISTINCT {key} AS k FROM {test}) k CROSS JOIN
            (SELECT concept, i, sum(x) AS s, count(*) AS n FROM {train} GROUP BY ALL) t
            LEFT JOIN {own} o ON o.k = k.k AND o.concept = t.concept AND o.i = t.i"""
    return f"""{out}_m AS (SELECT k, concept, i, s / n AS m FROM ({cent}) WHERE n > 0),
        {out}_c AS (SELECT k, concept, i, m / (sqrt(sum(m * m) OVER (PARTITION BY k, concept)) + 1e-8) AS c FROM {out}_m),
        {out}_s AS (SELECT t.{key} AS k, t.trial, t.concept AS label, c.concept AS cand, sum(t.x * c.c) / any_value(t.nrm) AS s
             FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {key}, trial)) AS nrm FROM {test}) t
             JOIN {out}_c c ON c.k = t.{key} AND c.i = t.i GROUP BY ALL),
        {out} AS (SELECT k, trial, label, 1 + count(*) FILTER (s > st AND cand <> label) AS rank,
             min_by(cand, {{'s': -s, 'c': cand}}) AS pred
             FROM (SELECT *, coalesce(max(s) FILTER (cand = label) OVER (PARTITION BY k, trial), -2) AS st FROM {out}_s) GROUP BY ALL)"""


@query("loso_centroid_retrieval", f"""WITH {SQL_LONG}, {sql_keyed('subject', 'lg', 'lg', 'cross', 'rk')},
       p AS (SELECT k AS fold, label AS y, pred AS yhat, rank FROM rk), kf AS ({sql_kappa('p', 'fold,')}), kp AS ({sql_kappa('p', '')})
       SELECT fold, {r('avg(CAST(y = yhat AS INTEGER))')} AS acc, {r('any_value(kappa)')} AS kappa, {r('avg(1.0 / rank)')} AS mrr, count(*) AS n
       FROM p JOIN kf USING (fold) GROUP BY fold UNION ALL
       SELECT 'pooled', {r('avg(CAST(y = yhat AS INTEGER))')}, {r('any_value(kappa)')}, {r('avg(1.0 / rank)')}, count(*) FROM p, kp""")
def loso_centroid_retrieval(v):
    """Every subject's trials against class centroids of all other subjects: accuracy, kappa and mean reciprocal rank
    per held-out subject and pooled."""
    e = v.emb
    s = R.keyed_state(e, e, "subject").select(F.col("subject").alias("fold"), F.col("concept").alias("y"),
                                              F.col("pred").alias("yhat"), (1.0 / F.col("rank")).alias("conf"))
    cont = s.groupBy("fold", "y", "yhat").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("sc"))
    both = cont.withColumn("fold", F.explode(F.array(F.col("fold"), F.lit("pooled")))).withColumn("bin", F.lit(0))
    out = M.evaluate(both, ["fold"])
    return out.select("fold", rnd("acc").alias("acc"), rnd("kappa").alias("kappa"), rnd("mean_conf").alias("mrr"), "n")


@query("nearest_centroid", f"""WITH {SQL_LONG}, f AS (SELECT subject, (row_number() OVER (ORDER BY subject DESC) - 1) % 5 AS fold
       FROM (SELECT DISTINCT subject FROM emb)), lf AS (SELECT lg.*, fold FROM lg JOIN f USING (subject)),
       {sql_keyed('fold', 'lf', 'lf', 'cross', 'rk')}
       SELECT CAST(k AS INTEGER) AS fold, trial, CAST(pred AS BIGINT) AS pred, rank FROM rk""")
def _(v):
    e = splits.grouped_kfold(v.emb, 5)
    return R.keyed_state(e, e, "fold").select("fold", "trial", "pred", "rank")


SQL_GRID = f"""{SQL_LONG}, half AS (SELECT trial, row_number() OVER (PARTITION BY subject ORDER BY md5('7:' || trial)) - 1
       < count(*) OVER (PARTITION BY subject) // 2 AS calib FROM emb),
       trn AS (SELECT lg.* FROM lg JOIN half USING (trial) WHERE calib), tst AS (SELECT lg.* FROM lg JOIN half USING (trial) WHERE NOT calib),
       av AS (SELECT subject, CAST(concept AS BIGINT) AS trial, concept, i, avg(x) AS x FROM tst GROUP BY ALL),
       {sql_keyed('subject', 'tst', 'trn', 'within', 'ws')}, {sql_keyed('subject', 'tst', 'trn', 'cross', 'cs')},
       {sql_keyed('subject', 'av', 'trn', 'within', 'wa')}, {sql_keyed('subject', 'av', 'trn', 'cross', 'ca')},
       al AS (SELECT k, 'within_single' AS cell, rank FROM ws UNION ALL SELECT k, 'cross_single', rank FROM cs UNION ALL
              SELECT k, 'within_avg', rank FROM wa UNION ALL SELECT k, 'cross_avg', rank FROM ca),
       rr AS (SELECT al.k AS subject, cell, q.k, avg(CAST(rank <= q.k AS INTEGER)) AS acc FROM al, (VALUES (1), (5)) q(k) GROUP BY ALL),
       gg AS (SELECT k, cell, avg(acc) AS acc FROM rr GROUP BY ALL)"""


@query("robustness_grid", f"""WITH {SQL_GRID} SELECT k, cell, {r('acc')} AS acc,
       {r("acc - max(CASE WHEN cell = 'cross_single' THEN acc END) OVER (PARTITION BY k)")} AS inflation FROM gg""")
def _(v):
    rows = R.robustness_rows(splits.calibration_half(v.emb, 7, ["trial"]))
    return M.inflation_grid(rows).select("k", "cell", rnd("acc").alias("acc"), rnd("inflation").alias("inflation"))
