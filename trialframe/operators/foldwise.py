"""Passes in which every row meets the state of all folds, and models fitted for all folds at once.

A fold's model is fitted on the rows of all other folds, so nearly every row takes part in every fold's fit. Rows are dealt once to
chunks of bounded size; a pass sends the states of the folds to every chunk, block by block if they are large, and returns one
partial sum per chunk and fold. No row is copied per fold, nothing but progress counts reaches the driver, and the number of jobs
doesn't depend on the number of folds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.functions import kernels
from trialframe.functions.columns import vector_sum
from trialframe.session import checkpointed

#: Bytes of rows in a chunk and of states in a block.
CHUNK_BYTES = 8 << 20
STATE_BYTES = 32 << 20


@dataclass(frozen=True)
class Chunks:
    """Checkpointed rows with their chunk in ``_chunk``."""

    df: DataFrame
    pieces: int


def chunked(df: DataFrame | Chunks, row_bytes: int) -> Chunks:
    """Deals rows evenly to chunks, whatever their keys: at least one per core, more where there are many rows. Chunks stay as they are."""
    if isinstance(df, Chunks):
        return df
    data = checkpointed(df)
    pieces = max(data.sparkSession.sparkContext.defaultParallelism, -(-data.count() * row_bytes // CHUNK_BYTES))
    return Chunks(checkpointed(data.withColumn("_chunk", F.pmod(F.monotonically_increasing_id(), F.lit(pieces)).cast("int")).repartition(pieces, "_chunk")), pieces)


def meet(rows: Chunks, state: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table | None], schema: pa.Schema, fields: str, state_bytes: int) -> DataFrame:
    """fn(a chunk's rows, states) for every chunk and block of states; the states' columns begin with ``s_``."""
    blocks = max(1, -(-state.count() * state_bytes // STATE_BYTES))
    left = rows.df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = state.select(*[F.col(c).alias(f"s_{c}") for c in state.columns], F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int").alias("s__block"),
                         F.explode(F.sequence(F.lit(0), F.lit(rows.pieces - 1))).alias("s__chunk"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = fn(a, b) if a.num_rows and b.num_rows else None
        return schema.empty_table() if out is None else out.cast(schema)

    return left.groupBy("_chunk", "_block").cogroup(right.groupBy("s__chunk", "s__block")).applyInArrow(run, fields)


def arrow_schema(df: DataFrame, names: list[str]) -> tuple[pa.Schema, str]:
    """Arrow schema and DDL text of columns of ``df``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    part = df.select(*names).schema
    return to_arrow_schema(part), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in part)


def matrices(column: pa.ChunkedArray, d: int) -> np.ndarray:
    """Row-major d × d matrices of a list column."""
    return kernels.matrix(column.combine_chunks(), d * d).reshape(-1, d, d)


def values(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_pandas().to_numpy()


def per_class(state: DataFrame, rows: Chunks, label: str) -> DataFrame:
    """``state`` once per class of the rows."""
    classes = rows.df.agg(F.sort_array(F.collect_set(label)).alias("classes"))
    return state.withColumn(label, F.explode(classes.scalar()))


def fold_sums(rows: Chunks, state: DataFrame, keys: list[str], fn, state_bytes: int) -> DataFrame:
    """(keys…, _s): sums over the chunks of what fn(rows, states) yields as (row number of the state, vector)."""
    key_schema, key_fields = arrow_schema(state, keys)
    schema = pa.schema([*key_schema, ("_s", pa.list_(pa.float64()))])

    def run(a: pa.Table, b: pa.Table) -> pa.Table | None:
        found = list(fn(a, b))
        if not found:
            return None
        at = pa.array([k for k, _ in found])
        return pa.table([*[b.column(f"s_{k}").take(at) for k in keys], kernels.to_list([v for _, v in found])], names=schema.names)

    return meet(rows, state, run, schema, f"{key_fields}, _s array<double>", state_bytes).groupBy(*keys).agg(vector_sum("_s").alias("_s"))


def own_rows(rows: Chunks, state: DataFrame, fold: str, keep: list[str], name: str, fn, state_bytes: int) -> DataFrame:
    """(keep…, name): fn(a fold's own rows, its states) gives a vector per row. All states of a fold must lie in one row of ``state``."""
    key_schema, fields = arrow_schema(rows.df, keep)
    schema = pa.schema([*key_schema, (name, pa.list_(pa.float64()))])

    def run(a: pa.Table, b: pa.Table) -> pa.Table | None:
        folds, out = values(a.column(fold)), []
        for k, f in enumerate(values(b.column(f"s_{fold}"))):
            at = np.flatnonzero(folds == f)
            if len(at):
                part = a.take(pa.array(at))
                out.append(pa.table([*[part.column(c) for c in keep], kernels.to_list(list(fn(part, b.slice(k, 1))))], names=schema.names))
        return pa.concat_tables(out) if out else None

    return meet(rows, state, run, schema, f"{fields}, `{name}` array<double>", state_bytes)


# ---- logistic regression ---------------------------------------------------------------------------------------

def softmax_rows(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _padded(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def newton_sums(x: np.ndarray, y: np.ndarray, theta: np.ndarray, present: np.ndarray) -> np.ndarray:
    """[loss, gradient, curvature] of a multinomial model on its present classes; curvature by pairs of classes."""
    x = _padded(x)
    p = softmax_rows(x @ theta[present].T)
    place = np.cumsum(present) - 1
    at = place[y]
    loss = -np.log(np.maximum(p[np.arange(len(y)), at], 1e-300)).sum()
    grad = p.T @ x
    np.subtract.at(grad, at, x)
    k, parts = p.shape[1], [[loss], grad.ravel()]
    for a in range(k):
        for b in range(a, k):
            parts.append(((x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x).ravel())
    return np.concatenate(parts)


def newton_direction(s: np.ndarray, theta: np.ndarray, ridge: float) -> tuple[float, np.ndarray, float]:
    """(objective, step, squared decrement) from the sums at ``theta`` [present classes, features + 1]."""
    k, m = theta.shape
    free = np.ones(m)
    free[-1] = 0.0  # intercepts carry no penalty
    loss = s[0] + ridge / 2 * (theta * theta * free).sum()
    grad = s[1:1 + k * m].reshape(k, m) + ridge * theta * free
    h, at = np.zeros((k, m, k, m)), 1 + k * m
    for a in range(k):
        for b in range(a, k):
            h[a, :, b] = s[at:at + m * m].reshape(m, m)
            h[b, :, a] = h[a, :, b].T
            at += m * m
    for a in range(k):
        h[a, :, a] += ridge * np.diag(free)
    h[:, -1, :, -1] += 1.0  # a common shift of all intercepts changes nothing: hold it
    step = -np.linalg.solve(h.reshape(k * m, k * m) + 1e-12 * np.eye(k * m), grad.ravel()).reshape(k, m)
    return loss, step, float(-(grad * step).sum())


def logistic_folds(rows: Chunks, fold: str, n_classes: int, keep: list[str], features, p: int, refs: DataFrame | None = None,
                   c: float = 1.0, max_rounds: int = 100, ref_bytes: int = 0) -> DataFrame:
    """(keep…, probs): multinomial logistic regression with an L2 penalty of strength 1/C, a model per fold of the other folds' rows.

    ``features(table, ref)`` gives the [n, p] features of a chunk's rows, with the fold's ``ref`` of ``refs`` (fold, ref) where given.
    Newton's method for all folds together: a pass adds up loss, gradient and curvature per fold; a step that raises the loss is
    halved; folds leave when the decrement vanishes. Classes without training rows have probability 0; without any training row
    all probabilities are null.
    """
    m = p + 1
    size = 8 * (3 * n_classes * m + n_classes) + ref_bytes
    state = (refs if refs is not None else rows.df.select(fold).distinct().withColumn("ref", F.array().cast("array<double>"))).select(fold, "ref")
    state = checkpointed(state)

    def trains(a: pa.Table, b: pa.Table):
        folds = values(a.column(fold))
        for k, f in enumerate(values(b.column(f"s_{fold}"))):
            at = np.flatnonzero(folds != f)
            if len(at):
                yield k, at

    def counts(a, b):
        y = values(a.column("y")).astype(int)
        for k, at in trains(a, b):
            yield k, np.bincount(y[at], minlength=n_classes).astype(float)

    n = fold_sums(rows, state, [fold], counts, size).withColumnRenamed("_s", "n")
    zeros = F.array_repeat(F.lit(0.0), n_classes * m)
    state = state.join(n, fold, "left").withColumns({"base": zeros, "theta": zeros, "delta": zeros, "step": F.lit(1.0), "best": F.lit(float("inf")), "open": F.col("n").isNotNull()})
    state = checkpointed(state)
    order = state.columns
    fields = arrow_schema(state, order)[1]

    def sums(a, b):
        y = values(a.column("y")).astype(int)
        theta, n = (kernels.matrix(b.column(f"s_{c}").combine_chunks(), w) for c, w in (("theta", n_classes * m), ("n", n_classes)))
        ref = b.column("s_ref").combine_chunks()
        for k, at in trains(a, b):
            yield k, newton_sums(features(a.take(pa.array(at)), np.asarray(ref[k].as_py(), dtype=float)), y[at], theta[k].reshape(n_classes, m), n[k] > 0.5)

    def move(batches):
        for pdf in batches:
            moved = []
            for r in pdf.to_dict("records"):
                present = np.asarray(r["n"]) > 0.5
                theta, base, delta = (np.array(r[c]).reshape(n_classes, m) for c in ("theta", "base", "delta"))
                loss, step, decrement = newton_direction(np.asarray(r["_s"]), theta[present], 1.0 / c)
                if loss > r["best"] + 1e-12 * abs(r["best"]) and r["step"] > 1e-6:
                    r["step"] /= 2
                    theta = base + r["step"] * delta
                else:
                    base, delta = theta.copy(), np.zeros_like(theta)
                    delta[present] = step
                    theta, r["best"], r["step"] = base + delta, loss, 1.0
                    r["open"] = decrement > 1e-12 * np.sum(r["n"])
                r["theta"], r["base"], r["delta"] = theta.ravel(), base.ravel(), delta.ravel()
                moved.append([r[c] for c in order])
            if moved:
                yield pd.DataFrame(moved, columns=order)

    for _ in range(max_rounds):
        live = state.filter("open")
        if live.isEmpty():
            break
        moved = live.join(fold_sums(rows, live, [fold], sums, size), fold).mapInPandas(move, fields)
        state = checkpointed(state.filter("not open").unionByName(moved))

    def probs(part: pa.Table, one: pa.Table) -> np.ndarray:
        seen = one.column("s_n")[0].as_py()
        out = np.full((part.num_rows, n_classes), np.nan)
        if seen is not None:
            present = np.asarray(seen) > 0.5
            theta = np.asarray(one.column("s_theta")[0].as_py()).reshape(n_classes, m)[present]
            out[:] = 0.0
            out[:, present] = softmax_rows(_padded(features(part, np.asarray(one.column("s_ref")[0].as_py(), dtype=float))) @ theta.T)
        return out

    out = own_rows(rows, state, fold, keep, "probs", probs, size)
    return out.withColumn("probs", F.when(~F.exists("probs", F.isnan), F.col("probs")))
