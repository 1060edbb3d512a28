"""Queries over epoching, the time axis and shape descriptors."""

from __future__ import annotations

from pyspark.sql import functions as F

from trialframe.functions.columns import rnd
from trialframe.operators import classify as C
from trialframe.operators import descriptors as D
from trialframe.operators import epoching as E
from trialframe.plans.registry import query, r

EPOCH = ["subject", "blk"]


def stream(v):
    return v.samples.select(F.col("subject").alias("rec"), "t", F.array("c0", "c1", "c2", "c3").alias("c"))


def onsets(v, onset="t"):
    return v.samples.select(F.col("subject").alias("rec"), F.col("epoch").alias("event"),
                            F.expr(onset).alias("onset"), "label")


def long_epochs(df, keys):
    # an inner explode makes the optimizer ask for the size of x below its projection, which computes x twice
    e = df.select(*keys, F.posexplode_outer("x").alias("ch", "_s"))
    e = e.select(*keys, "ch", F.posexplode_outer("_s").alias("i", "v")).filter("i IS NOT NULL")
    return e.withColumn("v", rnd("v"))


def full_cells(v):
    """Cells of complete blocks, from the array form."""
    e = v.epochs.filter("n = 8").select("subject", "blk", "label", F.posexplode("x").alias("ch", "s"))
    return e.select("subject", "blk", "label", "ch", F.posexplode("s").alias("i", "x"))


SQL_EPOCH_LONG = """SELECT e.event, e.label, s.ch, CAST(s.t - e.lo AS INTEGER) AS i, s.v - avg(s.v) FILTER
       (s.t - e.lo < {nb}) OVER (PARTITION BY e.event, s.ch) AS v,
       count(*) OVER (PARTITION BY e.event, s.ch) AS n
       FROM ev e JOIN (SELECT subject, t, 0 AS ch, c0 AS v FROM samples UNION ALL SELECT subject, t, 1, c1 FROM samples UNION ALL
                       SELECT subject, t, 2, c2 FROM samples UNION ALL SELECT subject, t, 3, c3 FROM samples) s
       ON s.subject = e.subject AND s.t >= e.lo AND s.t < e.lo + {n}"""


@query("block_epochs", f"""WITH ev AS (SELECT subject, epoch AS event, label, t - 4 AS lo FROM samples),
       w AS ({SQL_EPOCH_LONG.format(nb=2, n=12)})
       SELECT event, label, ch, i, {r('v')} AS v FROM w WHERE n = 12""")
def _(v):
    out = E.block_epochs(stream(v), onsets(v), fs=4, tmin=-1.0, tmax=2.0, baseline_s=0.5)
    return long_epochs(out, ["event", "label"])


@query("event_epochs", f"""WITH ev AS (SELECT subject, epoch AS event, label,
       CAST(round_even((t * 0.25 + 0.01) * 4, 0) AS BIGINT) AS lo FROM samples WHERE label NOT IN ('error', 'view')),
       w AS ({SQL_EPOCH_LONG.format(nb=1, n=6)})
       SELECT event, label, ch, i, {r('v')} AS v FROM w WHERE n = 6""")
def _(v):
    from trialframe.operators.labels import event_mask
    ev = onsets(v, "t * 0.25D + 0.01D").withColumns(
        {"istarget": (F.col("label") == "error").cast("int"), "isteststim": (F.col("label") == "view").cast("int")})
    ev = event_mask(ev).drop("istarget", "isteststim")
    return long_epochs(E.event_epochs(stream(v), ev, 4, 0.0, 1.5, 0.25), ["event", "label"])


@query("trigger_onsets", """WITH s AS (SELECT subject AS rec, t, CASE WHEN c1 > 0 THEN label_id ELSE 0 END AS code
       FROM samples), p AS (SELECT *, lag(code) OVER (PARTITION BY rec ORDER BY t) AS prev FROM s)
       SELECT rec, t AS onset, code FROM p WHERE code <> 0 AND prev = 0 AND code BETWEEN 1 AND 3""")
def _(v):
    code = F.when(F.col("c1") > 0, F.col("label_id")).otherwise(0).alias("code")
    return E.trigger_onsets(v.samples.select(F.col("subject").alias("rec"), "t", code), "code", 3)


@query("resample_linear", f"""WITH s AS MATERIALIZED (SELECT subject, epoch_us(ts - TIMESTAMP '2024-01-01') / 1e6 AS sec, unnest([0, 1, 2, 3]) AS ch, unnest([c0, c1, c2, c3]) AS v FROM samples),
       p AS MATERIALIZED (SELECT subject, ch, sec AS s0, v AS v0, lead(sec) OVER w AS s1, lead(v) OVER w AS v1 FROM s WINDOW w AS (PARTITION BY subject, ch ORDER BY sec)),
       g AS (SELECT subject, ch, CAST(g AS BIGINT) AS g, CAST(g * 21600 AS DOUBLE) AS at FROM (SELECT DISTINCT subject, ch FROM s), range(0, 124) k(g))
       SELECT g.subject || '/' || g.ch AS rec, g.g, {r('coalesce(CASE WHEN g.at = p.s0 THEN p.v0 ELSE p.v0 + (g.at - p.s0) / (p.s1 - p.s0) * (p.v1 - p.v0) END, 0)')} AS v
       FROM g ASOF LEFT JOIN p ON g.subject = p.subject AND g.ch = p.ch AND g.at >= p.s0""")
def _(v):
    """All four channels of every recording; a channel is a stream of its own."""
    sec = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'2024-01-01 00:00:00'"), F.col("ts")) / 1e6
    s = v.samples.select("subject", "t", F.round(sec, 6).alias("sec"), F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("ch", "v"))
    s = s.select(F.concat_ws("/", "subject", "ch").alias("rec"), "t", "sec", "v")
    return E.resample_linear(s, 21600.0, 124).withColumn("v", rnd("v"))


# ---- spectral kernels: on blocks of up to eight samples the linear operator is a small explicit matrix per length ----

ALL_CELLS = """ac AS (SELECT subject, blk, n, CAST(c.ch AS INTEGER) AS ch, unnest(range(0, n)) AS i, unnest(x[c.ch + 1]) AS v FROM epochs, range(0, 4) c(ch))"""
GAIN = """bins AS (SELECT n, k, least(k, n - k) * 4.0 / n AS f FROM range(1, 9) l(n), range(0, 8) t(k) WHERE k < n),
          warp AS (SELECT n, k, f, tan(pi() * least(f, 0.4999999 * 4) / 4) AS w, tan(pi() * 0.3 / 4) AS a,
                   tan(pi() * 1.2 / 4) AS b FROM bins),
          gain AS (SELECT n, k, CASE WHEN f = 0 THEN 0 ELSE 1 / (1 + power((w * w - a * b) / (w * (b - a)), 8)) END AS g
                   FROM warp)"""


@query("bandpass_epochs", f"""WITH {ALL_CELLS}, {GAIN},
       kern AS (SELECT n, m, i, sum(g * cos(2 * pi() * k * (m - i) / n)) / n AS w FROM gain, range(0, 8) a(m), range(0, 8) b(i)
                WHERE m < n AND i < n GROUP BY n, m, i)
       SELECT subject, blk, ch, CAST(m AS INTEGER) AS i, {r('sum(v * w)')} AS v FROM ac JOIN kern USING (n, i)
       GROUP BY subject, blk, ch, m""")
def _(v):
    return long_epochs(E.bandpass_epochs(v.epochs.select(*EPOCH, "x"), 0.3, 1.2, 4.0), EPOCH)


@query("band_envelope", f"""WITH {ALL_CELLS}, {GAIN},
       kern AS (SELECT n, m, i, sum(h * cos(2 * pi() * k * (m - i) / n)) / n AS re,
                sum(h * sin(2 * pi() * k * (m - i) / n)) / n AS im
                FROM (SELECT n, k, g * CASE WHEN k BETWEEN 1 AND (n - 1) // 2 THEN 2 WHEN k = 0 OR 2 * k = n THEN 1 ELSE 0 END AS h FROM gain),
                range(0, 8) a(m), range(0, 8) b(i) WHERE m < n AND i < n GROUP BY n, m, i)
       SELECT subject, blk, ch, CAST(m AS INTEGER) AS i, {r('sqrt(power(sum(v * re), 2) + power(sum(v * im), 2))')} AS v
       FROM ac JOIN kern USING (n, i) GROUP BY subject, blk, ch, m""")
def _(v):
    return long_epochs(E.band_envelope(v.epochs.select(*EPOCH, "x"), 0.3, 1.2, 4.0), EPOCH)


@query("resample_fft", f"""WITH {ALL_CELLS},
       kern AS (SELECT n, m, i, sum(CASE WHEN k = 0 OR (n < 5 AND 2 * k = n) THEN 1 ELSE 2 END
                * cos(2 * pi() * k * (m / 5.0 - i / n::DOUBLE))) / n AS w FROM range(1, 9) l(n), range(0, 3) t(k), range(0, 5) a(m), range(0, 8) b(i)
                WHERE i < n AND k <= least(n, 5) // 2 GROUP BY n, m, i)
       SELECT subject, blk, ch, CAST(m AS INTEGER) AS i, {r('sum(v * w)')} AS v FROM ac JOIN kern USING (n, i)
       GROUP BY subject, blk, ch, m""")
def _(v):
    return long_epochs(E.resample_fft(v.epochs.select(*EPOCH, "x"), 5), EPOCH)


@query("bandpass_stream")
def _(v):
    """All four channels of every recording; a channel is a stream of its own."""
    ch = F.posexplode(F.array("c0", "c1", "c2", "c3")).alias("ch", "c")
    s = v.samples.select("subject", "t", ch).select(F.concat_ws("/", "subject", "ch").alias("rec"), "t", "c")
    return E.bandpass_stream(s, "c", 0.3, 1.2, 4.0, chunk=32, halo=16).withColumn("y", rnd("y"))


# ---- windows, crops, embeddings --------------------------------------------------------------------------------

@query("subwindows", f"""WITH e AS (SELECT *, unnest(CASE WHEN n <= 3 THEN [0] ELSE range(0, n - 2, 2) END) AS start
       FROM epochs) SELECT subject, blk, start // 2 AS win, CAST(start AS INTEGER) AS start,
       {r('(start + 1.5) / n')} AS pos, {r('list_sum(x[1][start + 1:start + 3])')} AS total,
       {r('list_avg(x[3][start + 1:start + 3])')} AS mean2 FROM e""")
def _(v):
    w = E.subwindows(v.epochs.select(*EPOCH, "x"), 0.75, 0.5, 4.0)
    total = F.aggregate(F.col("x")[0], F.lit(0.0), lambda s, a: s + a)
    mean2 = F.aggregate(F.col("x")[2], F.lit(0.0), lambda s, a: s + a) / F.size(F.col("x")[2])
    return w.select(*EPOCH, F.col("win").cast("bigint").alias("win"), "start", rnd("pos").alias("pos"),
                    rnd(total).alias("total"), rnd(mean2).alias("mean2"))


@query("crops", f"""WITH e AS (SELECT subject, blk, x, n, unnest([0, 1, 2]) AS crop FROM epochs WHERE n >= 5),
       s AS (SELECT *, CAST(round_even(crop * (n - 5) / 2.0, 0) AS INTEGER) AS start FROM e)
       SELECT subject, blk, crop, start, CAST(ch AS INTEGER) AS ch, {r('list_sum(x[ch + 1][start + 1:start + 5])')} AS total FROM s, range(0, 4) c(ch)""")
def _(v):
    """Epochs of at least the crop's five samples; shorter ones have no crop."""
    c = E.crops(v.epochs.filter("n >= 5").select(*EPOCH, "x"), 5, 3)
    c = c.select(*EPOCH, "crop", "start", F.posexplode("x").alias("ch", "s"))
    return c.select(*EPOCH, "crop", "start", "ch", rnd(F.aggregate("s", F.lit(0.0), lambda s, a: s + a)).alias("total"))


@query("crop_average", f"""WITH u AS (SELECT subject, unnest([0, 1, 2]) AS cls, unnest(pa) AS p FROM preds)
       SELECT subject, cls, {r('avg(p)')} AS p FROM u GROUP BY subject, cls""")
def _(v):
    return E.crop_average(v.preds, "subject", "pa").withColumn("p", rnd("p"))


@query("time_delay_embed", f"""WITH e AS (SELECT * FROM epochs WHERE n >= 5),
       k AS (SELECT *, unnest(range(0, 12)) AS ch FROM e)
       SELECT subject, blk, CAST(ch AS INTEGER) AS ch, CAST(i AS INTEGER) AS i, {r('x[ch % 4 + 1][ch // 4 * 2 + i + 1]')} AS v
       FROM (SELECT *, unnest(range(0, n - 4)) AS i FROM k)""")
def _(v):
    return long_epochs(E.time_delay_embed(v.epochs.filter("n >= 5"), 3, 2), EPOCH)


@query("roll", f"""WITH {ALL_CELLS} SELECT a.subject, a.blk, a.ch, CAST(a.i AS INTEGER) AS i, {r('b.v')} AS v FROM ac a JOIN ac b
       ON b.subject = a.subject AND b.blk = a.blk AND b.ch = a.ch AND b.i = (a.i - 3 + 8 * a.n) % a.n""")
def _(v):
    return long_epochs(v.epochs.select(*EPOCH, F.transform("x", lambda s: E.roll(s, 3)).alias("x")), EPOCH)


@query("shift_fill", f"""WITH {ALL_CELLS} SELECT a.subject, a.blk, a.ch, CAST(a.i AS INTEGER) AS i, {r('b.v')} AS v FROM ac a JOIN ac b
       ON b.subject = a.subject AND b.blk = a.blk AND b.ch = a.ch AND b.i = greatest(a.i - 3, 0)""")
def _(v):
    return long_epochs(v.epochs.select(*EPOCH, F.transform("x", lambda s: E.shift_fill(s, 3)).alias("x")), EPOCH)


FULL_CELLS = """fc AS (SELECT label, subject, blk, u.ch, u.i, u.x FROM epochs, LATERAL (
       SELECT unnest([0,0,0,0,0,0,0,0,1,1,1,1,1,1,1,1,2,2,2,2,2,2,2,2,3,3,3,3,3,3,3,3]) AS ch,
              unnest(range(0, 32)) % 8 AS i, unnest(flatten(epochs.x)) AS x) u WHERE n = 8),
       bin3 AS (SELECT CAST(i AS INTEGER) AS i, CAST(CASE WHEN i < 2 THEN 0 WHEN i < 5 THEN 1 ELSE 2 END AS INTEGER)
                AS bin FROM range(0, 8) t(i))"""


@query("frame_bins", f"""WITH {FULL_CELLS}, m AS (SELECT label, ch, i, avg(x) AS m FROM fc GROUP BY ALL)
       SELECT label, ch, bin, {r('avg(m)')} AS v,
       CAST(CASE bin WHEN 0 THEN 1.0 / 4 - 1 WHEN 1 THEN 3.5 / 4 - 1 ELSE 6.5 / 4 - 1 END AS DOUBLE) AS time
       FROM m JOIN bin3 USING (i) GROUP BY label, ch, bin""")
def _(v):
    return E.frame_bins(full_cells(v), 8, 3, 4.0, -1.0).withColumn("v", rnd("v"))


@query("erd_frames", f"""WITH {FULL_CELLS}, p AS (SELECT label, ch, i, avg(x * x) AS p FROM fc GROUP BY ALL),
       b AS (SELECT *, avg(p) FILTER (i < 2) OVER (PARTITION BY label, ch) + 1e-20 AS base FROM p)
       SELECT label, ch, bin, {r('avg((p - base) / base)')} AS v FROM b JOIN bin3 USING (i) GROUP BY label, ch, bin""")
def _(v):
    return E.erd_frames(full_cells(v), 8, 3, 4.0, 0.5).withColumn("v", rnd("v"))


@query("power_map_frames", f"""WITH {FULL_CELLS}, p AS (SELECT label, ch, i, avg(x * x) AS p FROM fc GROUP BY ALL),
       l AS (SELECT label, ch, bin, ln(avg(p) + 1e-20) AS lp FROM p JOIN bin3 USING (i) GROUP BY label, ch, bin)
       SELECT label, ch, bin, {r('lp - avg(lp) OVER (PARTITION BY label, bin)')} AS v FROM l""")
def _(v):
    return E.power_map_frames(full_cells(v), 8, 3).withColumn("v", rnd("v"))


@query("example_waveform", f"""WITH f AS (SELECT label, min_by(x, {{'s': subject, 'b': blk}}) AS x FROM epochs GROUP BY label),
       c AS (SELECT label, unnest([0, 1, 2, 3]) AS ch, unnest(x) AS s FROM f),
       u AS (SELECT label, ch, len(s) AS t, unnest(range(0, len(s))) AS i, unnest(s) AS v FROM c)
       SELECT label, ch, CAST(i AS INTEGER) AS i, {r('v')} AS v FROM u WHERE i % greatest(1, t // 4) = 0""")
def _(v):
    return E.example_waveform(v.epochs, 4, ["subject", "blk"]).withColumn("v", rnd("v"))


# ---- descriptors -----------------------------------------------------------------------------------------------

CELL = ["subject", "blk", "ch"]


def sql_slope(cond: str = "true") -> str:
    f = lambda e: f"sum({e}) FILTER ({cond})"
    n = f"count(*) FILTER ({cond})"
    return (f"({n} * {f('x * i')} - {f('x')} * {f('i')}) / nullif(CAST({n} * {f('i * i')} - {f('i')} * {f('i')} "
            f"AS DOUBLE), 0)")


BANK_BODY = f"""SELECT {{keys}}, avg(x) AS mean, var_pop(x) AS variance, min(x) AS min, max(x) AS max,
       max(x) - min(x) AS range, sum(x) - (arg_min(x, i) + arg_max(x, i)) / 2 AS auc,
       avg(x) FILTER (i >= t - greatest(1, t // 10)) AS final, arg_max(x, {{{{'a': abs(x), 'i': -i}}}}) AS peak,
       arg_max(i, {{{{'a': abs(x), 'i': -i}}}}) / max(t) AS time_to_peak,
       CASE WHEN var_pop(x) > 0 THEN avg(power(x - mu, 3)) / power(var_pop(x), 1.5) ELSE 0 END AS skew,
       CASE WHEN var_pop(x) > 0 THEN avg(power(x - mu, 4)) / power(var_pop(x), 2) - 3 ELSE 0 END AS kurtosis,
       CAST(sum(flip) AS DOUBLE) AS zero_crossings, {sql_slope()} AS slope, {sql_slope('i < t // 2')} AS early_slope,
       {sql_slope('i >= t // 2')} AS late_slope
       FROM (SELECT *, CAST(coalesce((x < 0) <> lag(x < 0) OVER (PARTITION BY {{keys}} ORDER BY i), false) AS INTEGER)
       AS flip, count(*) OVER (PARTITION BY {{keys}}) AS t, avg(x) OVER (PARTITION BY {{keys}}) AS mu FROM {{src}})
       GROUP BY {{keys}}"""
BANK = "bank AS (" + BANK_BODY.format(keys="subject, blk, ch", src="cells") + ")"
BANK_COLS = ", ".join(f'{r(f)} AS "{f}"' for f in D.FAMILIES)


def _descriptor(name: str, families: list[str]):
    cols = ", ".join(f'{r(f)} AS "{f}"' for f in families)

    @query(name, f"WITH {BANK} SELECT subject, blk, ch, {cols} FROM bank")
    def _(v):
        b = D.extract_bank(v.cells, CELL, families)
        return b.select(*CELL, *[rnd(f).alias(f) for f in families])


for _name, _fams in {
        "descriptor_mean": ["mean"], "descriptor_variance": ["variance"], "descriptor_extrema": ["min", "max", "range"],
        "descriptor_auc": ["auc"], "descriptor_final": ["final"], "descriptor_peak": ["peak"],
        "descriptor_time_to_peak": ["time_to_peak"], "descriptor_skew": ["skew"], "descriptor_kurtosis": ["kurtosis"],
        "descriptor_zero_crossings": ["zero_crossings"], "descriptor_slope": ["slope"],
        "descriptor_half_slopes": ["early_slope", "late_slope"], "amplitude_features": ["mean", "slope", "peak"]}.items():
    _descriptor(_name, _fams)


def unpivot_sql(families: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT subject, blk, ch, '{f}' AS family, {r(f)} AS f FROM bank" for f in families)


@query("extract_bank", f"WITH {BANK} {unpivot_sql(D.FAMILIES)}")
def _(v):
    out = D.to_long(D.extract_bank(v.cells, CELL), CELL, D.FAMILIES)
    return out.withColumn("f", rnd("f"))


@query("array_bank", f"WITH {BANK} SELECT subject, blk, ch, {BANK_COLS} FROM bank")
def _(v):
    b = D.bank_cells(D.array_bank(v.epochs, EPOCH), EPOCH, D.FAMILIES)
    return b.select(*CELL, *[rnd(f).alias(f) for f in D.FAMILIES])


@query("select_recipe", f"WITH {BANK} {unpivot_sql(D.RECIPES['dynamics'])}")
def _(v):
    out = D.to_long(D.extract_bank(v.cells, CELL, D.RECIPES["dynamics"]), CELL, D.RECIPES["dynamics"])
    return D.select_recipe(out, "dynamics").withColumn("f", rnd("f"))


SQL_WINDOWS = f"""WITH n AS (SELECT *, count(*) OVER (PARTITION BY subject, blk, ch) AS n FROM cells),
       w AS (SELECT subject, blk, ch, x, win, CAST(i - win * 2 AS INTEGER) AS i FROM n, range(0, 4) k(win)
             WHERE i >= win * 2 AND i < win * 2 + 4 AND win <= CASE WHEN n <= 4 THEN 0 ELSE (n - 4) // 2 END),
       bank AS ({BANK_BODY.format(keys='subject, blk, ch, win', src='w')})"""


@query("window_bank", f"""{SQL_WINDOWS}
       SELECT subject, blk, ch, win, {r('mean')} AS mean, {r('slope')} AS slope, {r('peak')} AS peak FROM bank""")
def _(v):
    b = D.bank_cells(D.window_bank(v.epochs, EPOCH, 4, 2, D.RECIPES["amplitude"]), [*EPOCH, "win"], D.RECIPES["amplitude"])
    return b.select(*CELL, "win", *[rnd(f).alias(f) for f in ("mean", "slope", "peak")])


@query("window_concat", f"""{SQL_WINDOWS}, v AS (SELECT subject, blk, win, ch, 0 AS k, mean AS f FROM bank UNION ALL SELECT subject, blk, win, ch, 1, slope FROM bank
       UNION ALL SELECT subject, blk, win, ch, 2, peak FROM bank)
       SELECT subject, blk, CAST(row_number() OVER (PARTITION BY subject, blk ORDER BY win, ch, k) - 1 AS INTEGER) AS place, {r('coalesce(f, 0)')} AS f FROM v""")
def _(v):
    f = D.window_bank(v.epochs, EPOCH, 4, 2, D.RECIPES["amplitude"]).select(*EPOCH, "win", D.bank_vector().alias("f"))
    return C.window_concat(f, EPOCH).select(*EPOCH, F.posexplode("f").alias("place", "f")).withColumn("f", rnd("f"))
