"""Queries over labels, joins and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.columns import rnd
from trialframe.operators import joins, labels, retrieval, splits
from trialframe.operators.ordinal import hash_ordinal, range_bucket, time_bucket
from trialframe.plans.registry import query, r
from trialframe.plans.views import EVENT_TYPES

DAY = lambda: time_bucket("ts")


# ---- labels and filters ----------------------------------------------------------------------------------------

@query("filter_criteria", """SELECT epoch, subject, session, label FROM trials
       WHERE subject IN ('3', '10', '42') OR session IN ('s1')""")
def _(v):
    return labels.filter_criteria(v.trials, [3, 10, 42], ["s1"]).select("epoch", "subject", "session", "label")


@query("filter_criteria_long_list", """SELECT epoch, subject, label FROM trials
       WHERE subject IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)""")
def _(v):
    wanted = v.table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("subject"))
    return labels.filter_criteria(v.trials, wanted).select("epoch", "subject", "label")


CANON = {"click": 10, "error": 11, "purchase": 12, "signup": 13, "view": 14}


@query("remap_labels", """SELECT epoch, CAST(CASE label WHEN 'click' THEN 10 WHEN 'error' THEN 11
       WHEN 'purchase' THEN 12 WHEN 'signup' THEN 13 WHEN 'view' THEN 14 END AS INTEGER) AS label_id FROM trials""")
def _(v):
    return labels.remap_labels(v.trials.drop("label_id"), CANON).select("epoch", "label_id")


@query("id_to_name", """SELECT epoch, CASE label_id WHEN 0 THEN 'rest' WHEN 1 THEN 'load'
       ELSE CAST(label_id AS VARCHAR) END AS name FROM trials""")
def _(v):
    return labels.id_to_name(v.trials, {0: "rest", 1: "load"}).select("epoch", "name")


@query("marker_filter", """SELECT epoch, split_part(marker, ' ', 1) AS cls FROM (SELECT epoch, label || ' ' ||
       CASE WHEN value > 50 THEN 'session' ELSE 'pause' END AS marker FROM trials) WHERE contains(marker, 'session')""")
def _(v):
    kind = F.when(F.col("value") > 50, "session").otherwise("pause")
    return labels.marker_filter(v.trials.withColumn("marker", F.concat_ws(" ", "label", kind))).select("epoch", "cls")


@query("event_mask", "SELECT epoch, subject FROM trials WHERE label <> 'error' AND label <> 'view'")
def _(v):
    t = v.trials.withColumns({"istarget": (F.col("label") == "error").cast("int"),
                              "isteststim": (F.col("label") == "view").cast("int")})
    return labels.event_mask(t).select("epoch", "subject")


@query("restrict_classes", """SELECT epoch, CAST(label_id = 4 AS INTEGER) AS "binary" FROM trials
       WHERE label_id IN (0, 4)""")
def _(v):
    return labels.restrict_classes(v.trials, 0, 4).select("epoch", "binary")


@query("series_session", """SELECT epoch, (row_number() OVER (PARTITION BY subject ORDER BY ts, epoch) - 1) // 9
       AS series_session FROM trials""")
def _(v):
    return labels.series_session(v.trials, DAY(), 9).select("epoch", "series_session")


NAMED = "SELECT p_partkey, lpad(CAST(p_size AS VARCHAR), 5, '0') || '_' || p_name AS name, p_size, p_brand FROM part"


def named_parts(v):
    name = F.concat_ws("_", F.lpad(F.col("p_size").cast("string"), 5, "0"), "p_name")
    return v.table("part").select("p_partkey", name.alias("name"), "p_size", "p_brand")


@query("holdout_concepts", f"""WITH n AS ({NAMED}) SELECT p_partkey, name FROM n
       WHERE name NOT IN (SELECT name FROM n WHERE p_brand = 'Brand#2')""")
def _(v):
    n = named_parts(v)
    return labels.holdout_concepts(n, n.filter("p_brand = 'Brand#2'")).select("p_partkey", "name")


@query("holdout_sets_disjoint", f"""WITH n AS ({NAMED}),
       a AS (SELECT DISTINCT regexp_replace(name, '^[0-9]{{5}}_', '') AS n FROM n WHERE p_brand < 'Brand#15'),
       b AS (SELECT DISTINCT regexp_replace(name, '^[0-9]{{5}}_', '') AS n FROM n WHERE p_brand >= 'Brand#15')
       SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b,
              (SELECT count(*) FROM (SELECT n FROM a INTERSECT SELECT n FROM b)) AS overlap""")
def _(v):
    n = named_parts(v)
    return labels.holdout_sets_disjoint(n.filter("p_brand < 'Brand#15'"), n.filter("p_brand >= 'Brand#15'"))


@query("concept_index", f"""WITH n AS ({NAMED}) SELECT p_partkey,
       CAST(substr(name, 1, 5) AS INTEGER) - 1 AS concept FROM n""")
def _(v):
    return named_parts(v).select("p_partkey", labels.concept_index("name").alias("concept"))


@query("n_classes", "SELECT max(label_id) + 1 AS n_classes FROM trials")
def _(v):
    return labels.n_classes(v.trials)


@query("dense_ids", """SELECT o_orderkey, dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS dense_id
       FROM orders""")
def _(v):
    o = v.table("orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("c"))
    return labels.dense_ids(o, "c", range_bucket(o, "c")).select("o_orderkey", "dense_id")


# ---- joins -----------------------------------------------------------------------------------------------------

@query("gather", f"""SELECT m.ord, m.epoch, m.label, {r('e.value')} AS value
       FROM (SELECT epoch, label, row_number() OVER (ORDER BY md5('3:' || epoch)) - 1 AS ord FROM trials) m
       JOIN (SELECT event_id AS epoch, value FROM events) e USING (epoch)""")
def _(v):
    meta = hash_ordinal(v.trials.select("epoch", "label"), [], 3, ["epoch"], "ord")
    signals = v.table("events").select(F.col("event_id").alias("epoch"), "value")
    return joins.gather(meta, signals, ["epoch"]).select("ord", "epoch", "label", rnd("value").alias("value"))


@query("gather_aligned", """WITH a AS (SELECT subject, label, row_number() OVER (PARTITION BY subject ORDER BY ts, epoch)
       - 1 AS seq FROM trials WHERE hour(ts) < 12), b AS (SELECT subject, label,
       row_number() OVER (PARTITION BY subject ORDER BY ts, epoch) - 1 AS seq FROM trials WHERE hour(ts) >= 12)
       SELECT coalesce(a.subject, b.subject) AS subject, coalesce(a.seq, b.seq) AS seq, a.label AS label_a,
       b.label AS label_b, coalesce(a.label = b.label, false) AS ok
       FROM a FULL OUTER JOIN b ON a.subject = b.subject AND a.seq = b.seq""")
def _(v):
    t, am = v.trials, F.hour("ts") < 12
    return joins.gather_aligned(t.filter(am), t.filter(~am), DAY(), ["ts", "epoch"])


@query("paired_subjects", """SELECT subject FROM trials WHERE label = 'error' AND session = 's0' INTERSECT
       SELECT subject FROM trials WHERE label = 'purchase' AND session = 's2'""")
def _(v):
    t = v.trials
    return joins.paired_subjects(t.filter("label = 'error' AND session = 's0'"),
                                 t.filter("label = 'purchase' AND session = 's2'"))


@query("counts_by_label", """SELECT session, label, count(*) AS n, count(DISTINCT subject) AS n_subject,
       array_to_string(list_sort(list(DISTINCT run)), ',') AS run_set FROM trials GROUP BY session, label""")
def _(v):
    return labels.profile_counts(v.trials, ["session", "label"], ("subject",), ("run",))


@query("counts_by_subject", "SELECT subject, count(*) AS n, count(DISTINCT session) AS n_session FROM trials GROUP BY subject")
def _(v):
    return labels.profile_counts(v.trials, ["subject"], ("session",))


@query("embedding_lookup", f"""WITH bank AS (SELECT p_name AS file, max_by(p_retailprice, p_partkey) AS vec
       FROM part GROUP BY p_name) SELECT l_orderkey, l_linenumber, p_name AS file, {r('vec')} AS vec
       FROM lineitem JOIN part ON l_partkey = p_partkey JOIN bank ON p_name = file""")
def _(v):
    part = v.table("part").select("p_partkey", F.col("p_name").alias("file"), F.col("p_retailprice").alias("vec"))
    trials = (v.table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
              .join(part.select("p_partkey", "file"), "p_partkey"))
    out = joins.embedding_lookup(trials, part, "file", "vec", "p_partkey")
    return out.select("l_orderkey", "l_linenumber", "file", rnd("vec").alias("vec"))


@query("union_prototypes", f"""WITH a AS (SELECT s_nationkey AS name, avg(s_acctbal) AS proto FROM supplier GROUP BY 1),
       b AS (SELECT c_nationkey AS name, avg(c_acctbal) AS proto FROM customer WHERE c_mktsegment = 'BUILDING'
       AND c_nationkey < 20 GROUP BY 1)
       SELECT coalesce(b.name, a.name) AS name, {r('coalesce(b.proto, a.proto)')} AS proto
       FROM a FULL OUTER JOIN b ON a.name = b.name""")
def _(v):
    a = v.table("supplier").groupBy(F.col("s_nationkey").alias("name")).agg(F.avg("s_acctbal").alias("proto"))
    b = (v.table("customer").filter("c_mktsegment = 'BUILDING' AND c_nationkey < 20")
         .groupBy(F.col("c_nationkey").alias("name")).agg(F.avg("c_acctbal").alias("proto")))
    return joins.union_prototypes(a, b, "name", "proto").select("name", rnd("proto").alias("proto"))


@query("align_channels", f"""SELECT subject, blk, u.ch, u.i, {r('u.v')} AS v FROM epochs,
       LATERAL (SELECT 0 AS ch, unnest(x[3]) AS v, unnest(range(n)) AS i
                UNION ALL SELECT 1, unnest(x[1]), unnest(range(n))) u""")
def _(v):
    e = joins.align_channels(v.epochs, ["c0", "c1", "c2", "c3"], ["c2", "c0"])
    e = e.select("subject", "blk", F.posexplode("x").alias("ch", "s"))
    return e.select("subject", "blk", "ch", F.posexplode("s").alias("i", "v")).withColumn("v", rnd("v"))


@query("common_channels", """SELECT split_part(s_name, '#', 2) AS name, s_suppkey AS pos FROM supplier
       WHERE split_part(s_name, '#', 2) IN (SELECT split_part(c_name, '#', 2) FROM customer WHERE c_acctbal > 5000)""")
def _(v):
    part = lambda c: F.split(c, "#")[1].alias("name")
    return joins.common_channels(v.table("supplier").select(part("s_name"), F.col("s_suppkey").alias("pos")),
                                 v.table("customer").filter("c_acctbal > 5000").select(part("c_name")))


@query("upsert_run", f"""SELECT run, n, {r('acc')} AS acc FROM runs_v WHERE method = 'b'
       UNION ALL SELECT run, n + 1, {r('acc / 2')} FROM runs_v WHERE method = 'a'""")
def _(v):
    runs = v.runs_v.select("run", "n", "acc")
    new = v.runs_v.filter("method = 'a'").select("run", (F.col("n") + 1).alias("n"), (F.col("acc") / 2).alias("acc"))
    return joins.upsert_run(runs, new).withColumn("acc", rnd("acc"))


@query("compare_to_ceiling", f"""WITH bars AS (SELECT dataset, regime,
         CASE WHEN regime < 'y1998' AND dataset < '3' THEN method WHEN regime < 'y2000' THEN 'sota' ELSE 'm_' || method END
         AS method, acc + 0.05 AS acc, CASE method WHEN 'b' THEN 0 ELSE 1 END AS ordinal FROM runs_v
         WHERE dataset <> '5-LOW' AND (method = 'a' OR regime >= 'y2000')),
       j AS (SELECT r.*, c.method AS bar, c.acc AS bar_acc, row_number() OVER (PARTITION BY r.run ORDER BY
         CASE WHEN c.method = r.method THEN 0 WHEN c.method = 'sota' THEN 1 ELSE 2 END, c.ordinal) AS rk
         FROM runs_v r LEFT JOIN bars c ON r.dataset = c.dataset AND r.regime = c.regime)
       SELECT run, {r('acc')} AS acc, coalesce(bar, 'no reference') AS bar, {r('bar_acc')} AS bar_acc,
       {r('acc - bar_acc')} AS gap FROM j WHERE rk = 1""")
def _(v):
    runs = v.runs_v
    name = (F.when((F.col("regime") < "y1998") & (F.col("dataset") < "3"), F.col("method"))
            .when(F.col("regime") < "y2000", "sota").otherwise(F.concat(F.lit("m_"), "method")))
    bars = (runs.filter("dataset <> '5-LOW' AND (method = 'a' OR regime >= 'y2000')")
            .select("dataset", "regime", name.alias("method"), (F.col("acc") + 0.05).alias("acc"),
                    F.when(F.col("method") == "b", 0).otherwise(1).alias("ordinal")))
    out = joins.compare_to_ceiling(runs, bars)
    return out.select("run", rnd("acc").alias("acc"), "bar", rnd("bar_acc").alias("bar_acc"), rnd("gap").alias("gap"))


@query("run_gap", f"""SELECT regime, dataset, {r('a.acc')} AS value_a, {r('b.acc')} AS value_b,
       {r('a.acc - b.acc')} AS gap FROM (FROM runs_v WHERE method = 'a') a
       JOIN (FROM runs_v WHERE method = 'b') b USING (regime, dataset)""")
def _(v):
    g = joins.run_gap(v.runs_v, ["regime", "dataset"], "method", "a", "b")
    return g.select("regime", "dataset", *[rnd(c).alias(c) for c in ("value_a", "value_b", "gap")])


@query("top_n_trials", f"SELECT trial, {r('list_max(pa)')} AS conf FROM preds ORDER BY list_max(pa) DESC, trial LIMIT 25")
def _(v):
    p = v.preds.select("trial", F.array_max("pa").alias("conf"))
    return joins.top_n(p, [F.desc("conf"), F.asc("trial")], 25).withColumn("conf", rnd("conf"))


# ---- splits ----------------------------------------------------------------------------------------------------

@query("make_split", """SELECT epoch, CASE WHEN subject IN ('1', '7') OR session IN ('s2') THEN 'test'
       WHEN subject IN ('11', '12') THEN 'val' ELSE 'train' END AS part FROM trials""")
def _(v):
    return splits.make_split(v.trials, [1, 7], ["s2"], [11, 12]).select("epoch", "part")


@query("make_split_random_val", """WITH d AS (SELECT epoch, subject IN ('1', '7') OR session IN ('s2') AS test FROM trials),
       k AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY md5('5:' || epoch)) - 1 AS pos,
             count(*) OVER (PARTITION BY test) AS n FROM d)
       SELECT epoch, CASE WHEN test THEN 'test' WHEN pos < greatest(1, round_even(n * 0.2, 0)) THEN 'val'
       ELSE 'train' END AS part FROM k""")
def _(v):
    return splits.make_split(v.trials, [1, 7], ["s2"], seed=5).select("epoch", "part")


@query("val_carve", """WITH k AS (SELECT epoch, row_number() OVER (ORDER BY md5('0:' || epoch)) - 1 AS pos,
       count(*) OVER () AS n FROM trials)
       SELECT epoch, CASE WHEN pos < greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS part FROM k""")
def _(v):
    return splits.val_carve(v.trials).select("epoch", "part")


@query("leave_one_subject_out", """SELECT subject AS fold, count(*) AS n_test,
       (SELECT count(*) FROM trials) - count(*) AS n_train FROM trials GROUP BY subject""")
def _(v):
    return splits.leave_one_subject_out(v.trials)


FOLDS = """SELECT subject, CAST((row_number() OVER (ORDER BY subject DESC) - 1) % 5 AS INTEGER) AS fold
           FROM (SELECT DISTINCT subject FROM trials)"""


@query("grouped_kfold", f"SELECT epoch, subject, fold FROM trials JOIN ({FOLDS}) USING (subject)")
def _(v):
    return splits.grouped_kfold(v.trials).select("epoch", "subject", "fold")


@query("within_subject_sessions", """WITH k AS (SELECT epoch, session = 's2' AS test,
       row_number() OVER (PARTITION BY subject, session = 's2' ORDER BY md5('1:' || epoch)) - 1 AS pos,
       count(*) OVER (PARTITION BY subject, session = 's2') AS n FROM trials)
       SELECT epoch, CASE WHEN test THEN 'test' WHEN pos < greatest(1, round_even(n * 0.2, 0)) THEN 'val'
       ELSE 'train' END AS part FROM k""")
def _(v):
    return splits.within_subject(v.trials, ["s2"], seed=1).select("epoch", "part")


@query("within_subject_carve", """WITH k AS (SELECT epoch, row_number() OVER (PARTITION BY subject
       ORDER BY md5('2:' || epoch)) - 1 AS pos, count(*) OVER (PARTITION BY subject) AS n FROM trials),
       m AS (SELECT *, greatest(1, round_even(n * 0.2, 0)) AS nt FROM k)
       SELECT epoch, CASE WHEN pos < nt THEN 'test' WHEN pos < nt + greatest(1, round_even((n - nt) * 0.25, 0))
       THEN 'val' ELSE 'train' END AS part FROM m""")
def _(v):
    return splits.within_subject(v.trials, val_frac=0.25, seed=2).select("epoch", "part")


@query("stratified_kfold", """SELECT epoch, CAST((row_number() OVER (PARTITION BY label_id ORDER BY md5('0:' || epoch))
       - 1 + label_id) % 5 AS INTEGER) AS fold FROM trials""")
def _(v):
    return splits.stratified_kfold(v.trials).select("epoch", "fold")


@query("stratified_group_kfold", """WITH c AS (SELECT subject, label, count(*) AS c FROM trials GROUP BY ALL),
       k AS (SELECT count(DISTINCT label) AS k FROM trials),
       h AS (SELECT subject, round(sqrt(greatest(sum(c * c) / any_value(k) - power(sum(c) / any_value(k), 2), 0)), 6)
             AS spread FROM c, k GROUP BY subject),
       p AS (SELECT seed, subject, row_number() OVER (PARTITION BY seed ORDER BY spread DESC,
             md5(seed || ':' || subject)) - 1 AS pos FROM h, (SELECT unnest([0, 1, 2]) AS seed))
       SELECT CAST(seed AS INTEGER) AS seed, subject, CAST(CASE WHEN (pos // 5) % 2 = 0 THEN pos % 5
       ELSE 4 - pos % 5 END AS INTEGER) AS fold FROM p""")
def _(v):
    return splits.stratified_group_kfold(v.trials, "subject", "label", 5, (0, 1, 2))


@query("stratified_calibration", """WITH k AS (SELECT epoch, row_number() OVER (PARTITION BY subject, label_id
       ORDER BY md5('4:' || epoch)) - 1 AS pos, count(*) OVER (PARTITION BY subject, label_id) AS n FROM trials)
       SELECT epoch, CASE WHEN pos < round_even(n * 0.3, 0) THEN 'calib' ELSE 'eval' END AS part FROM k""")
def _(v):
    return splits.stratified_calibration(v.trials, 0.3, 4).select("epoch", "part")


@query("calibration_half", """SELECT epoch, row_number() OVER (PARTITION BY subject ORDER BY md5('6:' || epoch)) - 1
       < count(*) OVER (PARTITION BY subject) // 2 AS calib FROM trials""")
def _(v):
    return splits.calibration_half(v.trials, 6).select("epoch", "calib")


SQL_HOLDOUT = """k AS (SELECT concept, row_number() OVER (ORDER BY md5('0:' || concept)) - 1 AS pos,
       count(*) OVER () AS k FROM (SELECT DISTINCT concept FROM emb)),
       p AS (SELECT concept, CASE WHEN pos < greatest(1, floor(k * 0.3)) THEN 'val' ELSE 'train' END AS part FROM k),
       ho AS (SELECT concept, part, row_number() OVER (PARTITION BY part ORDER BY concept) - 1 AS dense_id FROM p)"""


@query("concept_holdout", f"WITH {SQL_HOLDOUT} SELECT concept, part, dense_id FROM ho")
def _(v):
    return splits.concept_holdout(v.emb, frac=0.3)


@query("concept_holdout_rows", f"WITH {SQL_HOLDOUT} SELECT trial, concept, part, CASE WHEN part = 'val' THEN dense_id END AS val_label FROM emb JOIN ho USING (concept)")
def _(v):
    return splits.concept_holdout_rows(v.emb, frac=0.3).select("trial", "concept", "part", "val_label")


@query("validation_prototypes", f"""WITH {SQL_HOLDOUT}, m AS (SELECT dense_id AS val_label, concept, i, avg(v[i]) AS m FROM emb JOIN ho USING (concept), range(1, 65) t(i)
       WHERE part = 'val' GROUP BY dense_id, concept, i)
       SELECT val_label, concept, CAST(i - 1 AS INTEGER) AS i, {r('m / (sqrt(sum(m * m) OVER (PARTITION BY val_label)) + 1e-8)')} AS x FROM m""")
def _(v):
    out = retrieval.validation_prototypes(splits.concept_holdout_rows(v.emb, frac=0.3))
    return out.select("val_label", "concept", F.posexplode("v").alias("i", "x")).withColumn("x", rnd("x"))


@query("folds_for", f"""WITH k AS (SELECT epoch, subject, session = 's2' AS test,
       row_number() OVER (PARTITION BY subject, session = 's2' ORDER BY md5('0:' || epoch)) - 1 AS pos,
       count(*) OVER (PARTITION BY subject, session = 's2') AS n FROM trials),
       a AS (SELECT 'within' AS regime, subject AS fold, CASE WHEN test THEN 'test'
             WHEN pos < greatest(1, round_even(n * 0.2, 0)) THEN 'val' ELSE 'train' END AS part FROM k
             UNION ALL SELECT 'cross_subject', subject, 'test' FROM trials
             UNION ALL SELECT 'cross_subject_kfold', CAST(fold AS VARCHAR), 'test' FROM trials JOIN ({FOLDS}) USING (subject))
       SELECT regime, fold, part, count(*) AS n FROM a GROUP BY ALL""")
def _(v):
    out = None
    for regime in ("within", "cross_subject", "cross_subject_kfold"):
        g = (splits.folds_for(v.trials, regime).groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("regime", F.lit(regime)))
        out = g if out is None else out.unionByName(g)
    return out


@query("nested_group_folds", f"""WITH f AS ({FOLDS}), o AS (SELECT DISTINCT fold FROM f),
       t AS (SELECT o.fold, f.subject FROM o JOIN f ON f.fold <> o.fold)
       SELECT fold, subject, CAST((row_number() OVER (PARTITION BY fold ORDER BY subject DESC) - 1) % 3 AS INTEGER)
       AS inner_fold FROM t""")
def _(v):
    return splits.nested_group_folds(v.trials)
