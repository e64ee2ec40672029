"""Linear models per fold, fitted from sums that Spark gathers.

A pass over the rows turns each Arrow batch into the sums a fold's system needs (a Gram matrix, or a gradient and Hessian);
Spark adds the sums of a fold up by position, and its system, of the size of the feature list, is solved on an executor.
Weights stay a table, one row a fold, that each turn of a fit joins to the rows again: neither rows, sums nor weights
of folds come to the driver, and no fold's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ranks import quantiles
from tidemark.sources.staging import stage

CLASSES, WEIGHTS = (-1, 0, 1), ("w_short", "w_flat", "w_long")
#: Numbers of sums that a task keeps before it hands them on: 64 MB.
KEPT = 8 << 20


def scaling(train: DataFrame, features: Sequence[str], by: Sequence[str], of: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact medians, then mean and population deviation after filling; a column without values fills with 0, one without spread scales by 1.

    ``of`` says of a column which rows are its own; by default all are.
    """
    # all columns and folds at once: no task holds the values of a fold that is not small
    own = of or {}
    mine = lambda f, x: F.when(own[f], x) if f in own else x
    values = train.withColumns({f: mine(f, F.col(f).cast("double")) for f in features}) if own else train
    found = quantiles(values, features, [0.5], by).groupBy(*by).agg(*[F.max(F.when(F.col("column") == f, F.col("q")[0])).alias(f"{f}__med") for f in features])
    med = stage(train.select(*by).distinct().join(found, list(by), "left").fillna(0.0, [f"{f}__med" for f in features]), "medians")
    filled = train.join(med, list(by))
    x = {f: mine(f, F.coalesce(F.col(f).cast("double"), F.col(f"{f}__med"))) for f in features}
    std = lambda f: F.when(F.stddev_pop(x[f]) > 1e-12, F.stddev_pop(x[f])).otherwise(1.0)
    stats = filled.groupBy(*by).agg(*[F.avg(x[f]).alias(f"{f}__mean") for f in features], *[std(f).alias(f"{f}__std") for f in features])
    return med.join(stats, list(by))


def scaled_array(features: Mapping[str, str]) -> Column:
    """Filled and scaled features as an array; ``features`` names the column of each by the name its statistics go under."""
    return F.array(*[(F.coalesce(F.col(x).cast("double"), F.col(f"{f}__med")) - F.col(f"{f}__mean")) / F.col(f"{f}__std") for f, x in features.items()])


def scaled(rows: DataFrame, stats: DataFrame, features: Sequence[str], by: Sequence[str]) -> DataFrame:
    """``rows`` with x: the filled and scaled features as an array."""
    drop = [f"{f}__{k}" for f in features for k in ("med", "mean", "std")]
    return rows.join(stats, list(by)).withColumn("x", scaled_array({f: f for f in features})).drop(*drop)


def _sums(rows: DataFrame, part) -> DataFrame:
    """(key, pos, v): sums over batches of ``part(weights or None, x, y) -> flat array``, by fold key.

    A task keeps arrays of at most ``KEPT`` numbers and hands on what it has beyond that; Spark adds them up by position.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for k, s in sums.items():
                yield pa.record_batch({"key": [k], "s": pa.array([s], pa.list_(pa.float64()))})
            sums.clear()

        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), object)
            if not len(keys):
                continue
            y = batch.column("y").to_numpy(zero_copy_only=False)
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
            for k in set(keys):
                own = np.flatnonzero(keys == k)
                w = batch.column("w")[int(own[0])].as_py() if "w" in batch.schema.names else None
                s = part(None if w is None else np.array(w), x[own], y[own])
                sums[k] = sums[k] + s if k in sums else s
            if sum(map(len, sums.values())) > KEPT:
                yield from given()
        yield from given()

    known = [F.col("w")] if "w" in rows.columns else []
    # by fold only: arrays are a quarter of their cells by position, and what a fold's sums go to next needs no other exchange
    parts = rows.select("key", "x", F.col("y").cast("double").alias("y"), *known).mapInArrow(run, "key string, s array<double>").repartition("key")
    return parts.select("key", F.posexplode("s").alias("pos", "v")).groupBy("key", "pos").agg(F.sum("v").alias("v"))


def _flat(table: pa.Table) -> np.ndarray:
    out = np.zeros(len(table))
    out[table["pos"].to_numpy()] = table["v"].to_numpy()
    return out


def _one(kind: dict[str, tuple[pa.DataType, object]]) -> pa.Table:
    return pa.table({name: pa.array([value], type_) for name, (type_, value) in kind.items()})


_TEXT, _LIST, _REAL, _FLAG = pa.string(), pa.list_(pa.float64()), pa.float64(), pa.bool_()


def ridge(train: DataFrame, n_features: int, alpha: float = 1.0) -> DataFrame:
    """(key, w): weights and intercept (last) of each fold; ``train`` has key, x (scaled) and y. The intercept is not penalised."""
    d = n_features + 1

    def gram(_, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = np.hstack([x, np.ones((len(x), 1)), y[:, None]])
        return (a.T @ a).ravel()

    def solved(table: pa.Table) -> pa.Table:
        g = _flat(table).reshape(d + 1, d + 1)
        w = np.linalg.solve(g[:d, :d] + np.diag([alpha] * n_features + [0.0]), g[:d, d])
        return _one({"key": (_TEXT, table["key"][0].as_py()), "w": (_LIST, w)})

    return stage(_sums(train, gram).groupBy("key").applyInArrow(solved, "key string, w array<double>"), "weights")


def _newton(train: DataFrame, part, step, fresh: str, most: int) -> tuple[DataFrame, bool]:
    """Repeat ``step`` (sums, state or None -> state) for each fold until its state is done; (states, whether all are).

    A state has w, best, loss and done, and is a row of a table that is written at each turn.
    """

    def turned(sums: pa.Table, state: pa.Table) -> pa.Table:
        if not len(sums):  # nothing left of the fold
            return state
        old = state.to_pylist()[0] if len(state) else None
        w, best, loss, done = step(_flat(sums), old)
        return _one({"key": (_TEXT, sums["key"][0].as_py()), "w": (_LIST, w), "best": (_LIST, best), "loss": (_REAL, loss), "done": (_FLAG, done)})

    schema = "key string, w array<double>, best array<double>, loss double, done boolean"
    state = train.sparkSession.createDataFrame([], schema)
    for turn in range(most):
        open_ = state.where(~F.col("done"))
        rows = train.join(open_.select("key", "w"), "key") if turn else train
        new = _sums(rows, part).groupBy("key").cogroup(open_.groupBy("key")).applyInArrow(turned, schema)
        state = stage(new.unionByName(state.where("done")), f"{fresh}-weights")
        if state.where(~F.col("done")).isEmpty():
            return state, True
    return state, False


def logistic(train: DataFrame, n_features: int, c: float = 1.0, most: int = 12, tolerance: float = 1e-8) -> tuple[DataFrame, bool]:
    """Binary logistic regression with L2 strength 1/c, by Newton steps, all folds at once; ((key, w), whether all converged)."""
    d = n_features + 1
    ridge_ = np.diag([1.0 / c] * n_features + [1e-9])

    def part(w: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = np.hstack([x, np.ones((len(x), 1))])
        p = 1 / (1 + np.exp(-np.clip(a @ (np.zeros(d) if w is None else w), -30, 30)))
        return np.concatenate([a.T @ (p - y), ((a * (p * (1 - p))[:, None]).T @ a).ravel()])

    def step(s: np.ndarray, old: dict | None) -> tuple:
        w = np.array(old["w"]) if old else np.zeros(d)
        move = np.linalg.solve(s[d:].reshape(d, d) + ridge_, s[:d] + ridge_ @ w)
        return w - move, w - move, 0.0, bool(np.abs(move).max() < tolerance)

    state, ok = _newton(train, part, step, "logistic", most)
    return state.select("key", "w"), ok


def softmax(train: DataFrame, n_features: int, c: float = 1.0, most: int = 30, tolerance: float = 1e-8) -> tuple[DataFrame, bool]:
    """Logistic regression of three classes (y is -1, 0 or 1) with L2 strength 1/c on all but the intercepts.

    Newton steps for all folds at once, a step halved where it does not lower the loss; ((key, w): class x weight arrays laid flat, intercepts last, whether all converged).
    """
    d = n_features + 1
    k = len(CLASSES)
    # a shift of all intercepts changes no probability: their sum is held at 0, or the system would be singular
    bias = np.tile([0.0] * n_features + [1.0], k)
    penalty = np.diag(np.tile([1.0 / c] * n_features + [0.0], k)) + np.outer(bias, bias)

    def part(w: np.ndarray | None, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        a = np.hstack([x, np.ones((len(x), 1))])
        z = a @ (np.zeros((k, d)) if w is None else w.reshape(k, d)).T
        z = z - z.max(axis=1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        hot = y[:, None] == np.array(CLASSES)
        loss = -(np.log(np.maximum(p, 1e-300)) * hot).sum()
        blocks = [[(a * (p[:, i] * ((i == j) - p[:, j]))[:, None]).T @ a for j in range(k)] for i in range(k)]
        return np.concatenate([[loss], ((p - hot).T @ a).ravel(), np.block(blocks).ravel()])

    def step(s: np.ndarray, old: dict | None) -> tuple:
        w = np.array(old["w"]) if old else np.zeros(k * d)
        loss = s[0] + 0.5 * float(w @ penalty @ w)
        if old and loss > old["loss"] * (1 + 1e-12) + 1e-12:
            best, least, trial = np.array(old["best"]), old["loss"], (np.array(old["best"]) + w) / 2
            change = float(np.abs(trial - w).max())
        else:
            move = np.linalg.solve(s[1 + k * d :].reshape(k * d, k * d) + penalty, s[1 : 1 + k * d] + penalty @ w)
            best, least, trial, change = w, loss, w - move, float(np.abs(move).max())
        return trial, best, least, bool(change < tolerance)

    state, ok = _newton(train, part, step, "softmax", most)
    return state.select("key", F.when(F.col("done"), F.col("w")).otherwise(F.col("best")).alias("w")), ok


def classifier(train: DataFrame, n_features: int, c: float = 1.0) -> tuple[DataFrame, bool]:
    """(key, w_short, w_flat, w_long), NULL for a class the fold never saw, and whether all converged; ``train`` has key, x (scaled) and y in -1, 0, 1.

    Three classes are fitted by ``softmax``, two by ``logistic`` (the lesser class has weights of zero), and a fold of one
    class has weights of zero for it, so that it is always predicted.
    """
    d = n_features + 1
    seen = stage(train.groupBy("key").agg(F.array_sort(F.collect_set(F.col("y").cast("int"))).alias("ys")), "fold-classes")
    sizes = {r[0] for r in seen.select(F.size("ys")).distinct().collect()}  # 1, 2 and 3 at most
    zero = F.array_repeat(F.lit(0.0), d)
    out = seen.where(F.size("ys") == 1).select("key", *[F.when(F.col("ys")[0] == y, zero).alias(n) for y, n in zip(CLASSES, WEIGHTS, strict=True)])
    ok = True
    of = lambda n: train.join(seen.where(F.size("ys") == n), "key")
    if 3 in sizes:
        w, ok = softmax(of(3), n_features, c)
        out = out.unionByName(w.select("key", *[F.slice("w", i * d + 1, d).alias(n) for i, n in enumerate(WEIGHTS)]))
    if 2 in sizes:
        w, fine = logistic(of(2).withColumn("y", (F.col("y") == F.col("ys")[1]).cast("double")), n_features, c)
        w = w.join(seen, "key")
        out = out.unionByName(w.select("key", *[F.when(F.col("ys")[1] == y, F.col("w")).when(F.col("ys")[0] == y, zero).alias(n) for y, n in zip(CLASSES, WEIGHTS, strict=True)]))
        ok = ok and fine
    return out, ok


def _score(w: str) -> Column:
    return F.aggregate(F.zip_with("x", F.slice(w, 1, F.size("x")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + F.element_at(w, -1)


def predict_classes(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` (key, x) with p_short, p_flat and p_long; NULL for a class that the fold never saw."""
    rows = rows.join(weights, "key").withColumns({f"_z{i}": _score(w) for i, w in enumerate(WEIGHTS)})
    top = F.greatest(*[f"_z{i}" for i in range(len(CLASSES))])
    e = [F.exp(F.col(f"_z{i}") - top) for i in range(len(CLASSES))]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in e[1:]), F.coalesce(e[0], F.lit(0.0)))
    names = ("p_short", "p_flat", "p_long")
    return rows.withColumns({n: x / total for n, x in zip(names, e, strict=True)}).drop(*WEIGHTS, *[f"_z{i}" for i in range(len(CLASSES))])


def predict(rows: DataFrame, weights: DataFrame, logit: bool = False) -> DataFrame:
    """``rows`` (key, x) with y_pred; weights (key, w) are a row per fold."""
    z = _score("w")
    return rows.join(weights.select("key", "w"), "key").withColumn("y_pred", 1 / (1 + F.exp(-z)) if logit else z).drop("w")


def ridge_1d(train: DataFrame, x: str, y: str, by: Sequence[str], alpha: float = 1.0) -> DataFrame:
    """One scaled feature in closed form: slope Sxy / (Sxx + alpha), intercept the mean of y."""
    m = train.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.stddev_pop(x).alias("sx"), F.avg(y).alias("my"), F.avg(F.col(x) * F.col(y)).alias("mxy"))
    sxy = F.col("n") * (F.col("mxy") - F.col("mx") * F.col("my")) / F.col("sx")
    return m.where("sx > 1e-12").select(*by, (sxy / (F.col("n") + alpha)).alias("slope"), F.col("my").alias("intercept"))


def class_priors(train: DataFrame, y: str, by: Sequence[str]) -> DataFrame:
    """Frequencies of -1, 0 and 1: what a model of one class predicts."""
    p = lambda k: F.avg((F.col(y) == k).cast("double"))
    return train.groupBy(*by).agg(p(-1).alias("p_short"), p(0).alias("p_flat"), p(1).alias("p_long"), F.count_distinct(y).alias("n_classes"))


def collapsed(preds: DataFrame, p: str, by: Sequence[str], least: float = 1e-9) -> DataFrame:
    """Groups whose predictions do not vary."""
    return preds.groupBy(*by).agg(F.stddev_pop(p).alias("spread")).withColumn("collapsed", F.coalesce(F.col("spread") <= least, F.lit(True)))
