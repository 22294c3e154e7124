"""Multi-layer perceptron regressor trained on distributed rows.

Executors compute loss and gradient of their rows, Spark sums them in slices, and the driver holds
the weights and the L-BFGS history. Several networks (the candidates and folds of a search) train in
step: every pass over the data serves all of them. How many do so at once is bounded by their
weights, so neither the driver nor a broadcast grows with the number of candidates.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators import encode
from panelcast.operators.learn import sized
from panelcast.operators.panel import KEYS
from panelcast.session import ship_package

# The full search grid. Activation is logistic, the output is linear.
FULL_GRID = {
    "alpha": [0.1, 0.01, 0.005],
    "hidden": [(450, 250), (500, 150), (150, 250, 100), (250, 400, 100)],
}
DEFAULTS = {"alpha": 0.1, "hidden": (150, 250, 100)}
SEED = 4

# Numbers of a slice of a gradient: slices of one gradient are summed in different tasks.
SLICE = 1 << 14
# Weights of the networks that train in step: 8 MB to each executor, and 2 HISTORY + 3 times as much
# on the driver. A network with more trains alone.
WAVE_WEIGHTS = 1 << 20
# Rows that are worth a task of their own: a pass multiplies them with all weights.
TASK_ROWS = 1_000
# Steps of a training run, the same for the search and for the model that is used.
MAX_ITER = 200
HISTORY = 10


def _shapes(n_inputs: int, hidden: Sequence[int]) -> list[tuple[int, int]]:
    sizes = [n_inputs, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:]))


def initial_weights(n_inputs: int, hidden: Sequence[int], seed: int) -> np.ndarray:
    """Uniform within sqrt(2 / (inputs + outputs)) per layer, weights then biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in _shapes(n_inputs, hidden):
        bound = np.sqrt(2.0 / (a + b))
        parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(parts)


def _layers(flat: np.ndarray, shapes: Sequence[tuple[int, int]]):
    at, out = 0, []
    for a, b in shapes:
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _activations(x: np.ndarray, layers) -> list[np.ndarray]:
    values = [x]
    for i, (w, b) in enumerate(layers):
        z = values[-1] @ w + b
        values.append(z if i == len(layers) - 1 else 0.5 * (1.0 + np.tanh(0.5 * z)))
    return values


def batch_gradient(x, label, flat, shapes) -> tuple[float, np.ndarray]:
    """Half the squared error of a batch, and its gradient."""
    layers = _layers(flat, shapes)
    values = _activations(x, layers)
    delta = values[-1] - label[:, None]
    loss, parts = 0.5 * float((delta**2).sum()), []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(values[i].T @ delta).ravel(), delta.sum(axis=0), *parts]
        if i:
            delta = (delta @ layers[i][0].T) * values[i] * (1.0 - values[i])
    return loss, np.concatenate(parts)


def _penalised(flat, shapes) -> np.ndarray:
    """Weights with the biases zeroed: only weights are penalised."""
    mask = [part for a, b in shapes for part in (np.ones(a * b), np.zeros(b))]
    return flat * np.concatenate(mask)


def total_gradients(data: DataFrame, jobs: dict[int, tuple]) -> dict[int, tuple]:
    """One pass: rows used, summed loss and gradient of every job (weights, shapes, left-out fold).

    A task keeps its rows and works on one network after the other, so it holds one gradient at a
    time. Gradients leave it in slices, which are summed by (job, slice) in one shuffle; slice -1
    has the rows and the loss. The weights travel as a broadcast variable that ends with the pass.
    """
    shared = data.sparkSession.sparkContext.broadcast(jobs)

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        label = np.concatenate([b["label"].to_numpy() for b in held])
        fold = np.concatenate([b["fold"].to_numpy() for b in held])
        x = np.concatenate([b["x"].flatten().to_numpy() for b in held]).reshape(len(label), -1)
        for key, (flat, shapes, left_out) in shared.value.items():
            rows = slice(None) if left_out < 0 else fold != left_out
            loss, grad = batch_gradient(x[rows], label[rows], flat, shapes)
            cuts = [grad[i : i + SLICE] for i in range(0, len(grad), SLICE)]
            values = [np.array([len(label[rows]), loss]), *cuts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([key] * len(values), pa.int32()),
                    pa.array(range(-1, len(cuts)), pa.int32()),
                    pa.array(values, pa.list_(pa.float64())),
                ],
                ["job", "slice", "part"],
            )

    parts = data.mapInArrow(partials, "job int, slice int, part array<double>")
    summed = parts.groupBy("job", "slice").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    found: dict[int, dict[int, np.ndarray]] = {}
    for job, place, part in summed.collect():
        found.setdefault(job, {})[place] = part.toArray()
    shared.destroy()
    if missing := {k for k in jobs if k not in found or not found[k][-1][0]}:
        raise ValueError(f"no training rows for the networks {sorted(missing)}")
    sums = {}
    for job, slices in found.items():
        n, loss = slices.pop(-1)
        sums[job] = (int(n), float(loss), np.concatenate([slices[i] for i in sorted(slices)]))
    return sums


def lbfgs(x: np.ndarray, max_iter: int, tol: float = 1e-5) -> Generator:
    """L-BFGS with a backtracking line search. Yields points, is sent (value, gradient) there."""
    f, g = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(max_iter):
        if np.abs(g).max() < tol:
            break
        direction, coefs = -g, []
        for s, y in reversed(pairs):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            coefs.append(a)
        if pairs:
            s, y = pairs[-1]
            direction = direction * ((s @ y) / (y @ y))
        else:
            direction = direction / max(1.0, float(np.linalg.norm(g)))
        for (s, y), a in zip(pairs, reversed(coefs)):
            direction = direction + s * (a - (y @ direction) / (s @ y))
        slope, step = float(g @ direction), 1.0
        while True:
            f_new, g_new = yield x + step * direction
            if f_new <= f + 1e-4 * step * slope:
                break
            step *= 0.3
            if step < 1e-8:
                return x
        s, y = step * direction, g_new - g
        if s @ y > 1e-12:
            pairs = [*pairs[-(HISTORY - 1) :], (s, y)]
        small = abs(f - f_new) <= 1e-10 * max(abs(f), abs(f_new), 1.0)
        x, f, g = x + s, f_new, g_new
        if small:
            break
    return x


def waves(sizes: dict[int, int], limit: int) -> list[list[int]]:
    """Jobs in order, in groups of at most ``limit`` weights together, of at least one job."""
    out: list[list[int]] = []
    held = 0
    for job, size in sizes.items():
        if not out or held + size > limit:
            out.append([])
            held = 0
        out[-1].append(job)
        held += size
    return out


def train_networks(
    data: DataFrame, n_inputs: int, settings: dict[int, dict], max_iter: int
) -> dict[int, tuple[np.ndarray, list]]:
    """Train all networks; ``settings`` holds alpha, hidden and the left-out fold of each.

    Networks train in step as long as they have no more than WAVE_WEIGHTS weights together, and
    otherwise in waves. ``data(x array<double>, label double, fold int)`` should be cached by the
    caller, with partitions that a task can hold.
    """
    ship_package(data.sparkSession)
    shapes = {k: _shapes(n_inputs, s["hidden"]) for k, s in settings.items()}
    sizes = {k: sum(a * b + b for a, b in s) for k, s in shapes.items()}
    done: dict[int, tuple[np.ndarray, list]] = {}
    for wave in waves(sizes, WAVE_WEIGHTS):
        done |= _train_wave(data, n_inputs, {k: settings[k] for k in wave}, shapes, max_iter)
    return done


def _train_wave(data, n_inputs: int, settings, shapes, max_iter: int) -> dict:
    runs = {
        k: lbfgs(initial_weights(n_inputs, s["hidden"], SEED), max_iter)
        for k, s in settings.items()
    }
    points = {k: next(run) for k, run in runs.items()}
    done: dict[int, tuple[np.ndarray, list]] = {}
    while points:
        jobs = {k: (x, shapes[k], settings[k].get("left_out", -1)) for k, x in points.items()}
        sums = total_gradients(data, jobs)
        following = {}
        for k, x in points.items():
            n, loss, grad = sums[k]
            kept, alpha = _penalised(x, shapes[k]), settings[k]["alpha"]
            value = (loss + 0.5 * alpha * float(kept @ kept)) / n
            try:
                following[k] = runs[k].send((value, (grad + alpha * kept) / n))
            except StopIteration as end:
                done[k] = (end.value, shapes[k])
        points = following
    return done


def predict(df: DataFrame, weights: np.ndarray, shapes: list, name: str = "prediction") -> DataFrame:
    """Network output for the array column ``x``."""
    ship_package(df.sparkSession)

    @F.pandas_udf("double")
    def output(x: pd.Series) -> pd.Series:
        layers = _layers(weights, shapes)
        return pd.Series(_activations(np.stack(x.to_numpy()), layers)[-1][:, 0])

    return df.withColumn(name, output("x"))


def _scaled(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Standardised inputs as arrays, with the mean and population deviation of the training rows;
    and how many there are. A constant input is only centred."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(F.col("features"))
    stats = vectors.where("NOT is_test").select(summary.alias("s")).first()["s"]
    mean = stats["mean"].toArray()
    deviation = np.sqrt(stats["variance"].toArray() * (1.0 - 1.0 / max(1, stats["count"])))
    deviation[deviation == 0] = 1.0
    centred = F.zip_with(vector_to_array("features"), _literal(mean), lambda x, m: x - m)
    scaled = F.zip_with(centred, _literal(deviation), lambda x, d: x / d)
    return vectors.withColumn("x", scaled).drop("features"), len(mean)


def _literal(values: np.ndarray):
    return F.array(*[F.lit(float(v)) for v in values])


def _inputs(arrays: DataFrame) -> DataFrame:
    return sized(arrays.where("NOT is_test").select("x", "label", "fold"), TASK_ROWS)


def _r2(rss: float | None, tss: float | None) -> float:
    """R2 of a fold: of a constant one, 1 if it is hit and else 0; NaN of an empty one."""
    if rss is None or tss is None:
        return float("nan")
    return 1.0 - rss / tss if tss else float(rss == 0)


def tune_mlp(
    vectors: DataFrame, grid: dict | None = None, folds: int = 5, max_iter: int = MAX_ITER
) -> DataFrame:
    """Grid search by mean R2 over the folds, all candidates and folds trained in step."""
    spark = vectors.sparkSession
    grid = grid or FULL_GRID
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    arrays, n_inputs = _scaled(vectors)
    data = _inputs(arrays)
    settings = {
        i * folds + f: {**combo, "left_out": f} for i, combo in enumerate(combos) for f in range(folds)
    }
    trained = train_networks(data, n_inputs, settings, max_iter)
    r2 = np.zeros((len(combos), folds))
    for key, (weights, shapes) in trained.items():
        held = predict(data.where(F.col("fold") == key % folds), weights, shapes)
        row = held.agg(
            F.sum((F.col("label") - F.col("prediction")) ** 2).alias("rss"),
            (F.var_pop("label") * F.count("*")).alias("tss"),
        ).first()
        r2[key // folds, key % folds] = _r2(row.rss, row.tss)
    data.unpersist()
    # an empty fold has no score, and no say
    scores = np.nan_to_num(np.ma.masked_invalid(r2).mean(axis=1).filled(-np.inf), neginf=-np.inf)
    rows = [
        ("mlp", {k: str(v) for k, v in combo.items()}, float(scores[i]), i == int(scores.argmax()))
        for i, combo in enumerate(combos)
    ]
    return spark.createDataFrame(
        rows, "model string, params map<string,string>, r2 double, best boolean"
    )


def forecast_mlp(vectors: DataFrame, params: dict | None = None, max_iter: int = MAX_ITER) -> DataFrame:
    """Train on the rows before the cutoff, forecast the test rows on the original scale."""
    arrays, n_inputs = _scaled(vectors)
    data = _inputs(arrays)
    trained = train_networks(data, n_inputs, {0: {**DEFAULTS, **(params or {})}}, max_iter)
    data.unpersist()
    predicted = encode.unlog(predict(arrays.where("is_test"), *trained[0]))
    kept = ["cutoff"] if "cutoff" in vectors.columns else []
    return predicted.select(*KEYS, "Time", *kept, F.lit("mlp").alias("model"), "pred", "real")
