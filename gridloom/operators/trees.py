"""Regression trees of many models, each fitted in the task that holds its rows.

Spark deals the rows by the models' keys (a cell) and fits all models side by side; a model's rows are
one cell's series, bounded by the time axis and the members, so a group is small however large the
grid. Trees grow leaf by leaf, the best gain first, on histograms over at most `bins` values of each
predictor; limits are the number of leaves, the depth and the rows of a leaf, and each may be open. The
trees of a forest, which don't wait for each other, grow together level by level.
Random forest, gradient boosting and AdaBoost.R2 differ in what they draw and weigh.

Rows are put in order before anything is drawn and the draws depend on the model's keys, so a model
is the same for any partitioning. A stored model is one row: its trees as packed node tables.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BINS = 255
NODE = np.dtype([("feature", "<i4"), ("left", "<i4"), ("right", "<i4"), ("at", "<f8"), ("value", "<f8")])
MODEL = "kind string, base double, rate double, trees array<binary>, votes array<double>"


@dataclass(frozen=True)
class Growth:
    """Limits of a tree; None is no limit."""

    leaves: int | None = None
    depth: int | None = None
    min_rows: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    bins: int = BINS


class Binned:
    """Predictors as bin numbers: bin b holds the values up to cuts[b]."""

    def __init__(self, x: np.ndarray, bins: int):
        self.cuts = []
        for column in x.T:
            values = np.unique(column)
            if len(values) > bins:
                values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:], method="inverted_cdf"))
            self.cuts.append((values[:-1] + values[1:]) / 2)
        self.width = max([len(c) for c in self.cuts], default=0) + 1
        codes = [np.searchsorted(c, column) + i * self.width for i, (c, column) in enumerate(zip(self.cuts, x.T, strict=True))]
        self.codes = np.stack(codes, 1) if codes else np.zeros((len(x), 0), int)


def shrunk(total, l1: float):
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0) if l1 else total


def grow(data: Binned, target: np.ndarray, weight: np.ndarray, limits: Growth, features: np.ndarray) -> np.ndarray:
    """One tree on the rows with weight; `features` are the predictors it may use."""
    n_features = data.codes.shape[1]
    size = n_features * data.width
    moment = weight * target
    usable = np.zeros((n_features, 1), bool)
    usable[features] = True

    def histogram(rows):
        at = data.codes[rows].ravel()
        sums = (np.bincount(at, np.repeat(v[rows], n_features), size) for v in (moment, weight))
        return tuple(s.reshape(n_features, data.width) for s in sums)

    def score(s, w):
        return shrunk(s, limits.l1) ** 2 / np.maximum(w + limits.l2, 1e-12)

    nodes: list[list] = []
    heap: list[tuple] = []

    def add(rows, hist, depth) -> int:
        total, mass = moment[rows].sum(), weight[rows].sum()
        nodes.append([-1, -1, -1, 0.0, float(shrunk(total, limits.l1) / max(mass + limits.l2, 1e-12))])
        number = len(nodes) - 1
        if n_features and (limits.depth is None or depth < limits.depth) and mass >= 2 * limits.min_rows:
            s, w = (np.cumsum(h, axis=1) for h in hist)
            gain = score(s, w) + score(total - s, mass - w) - score(total, mass)
            open_cut = usable & (w >= limits.min_rows) & (mass - w >= limits.min_rows) & (mass - w > 1e-9)
            gain = np.where(open_cut, np.round(gain, 9), -1.0)
            best = int(gain.argmax())
            if gain.flat[best] > 1e-9:
                heappush(heap, (-gain.flat[best], number, best, rows, hist, depth))
        return number

    first = np.flatnonzero(weight > 0)
    add(first, histogram(first), 0)
    grown = 1
    while heap and (limits.leaves is None or grown < limits.leaves):
        _, number, best, rows, hist, depth = heappop(heap)
        feature, cut = divmod(best, data.width)
        goes_left = data.codes[rows, feature] <= best
        left, right = rows[goes_left], rows[~goes_left]
        small = histogram(left if len(left) <= len(right) else right)
        other = tuple(h - s for h, s in zip(hist, small, strict=True))
        of_left, of_right = (small, other) if len(left) <= len(right) else (other, small)
        nodes[number][:4] = [feature, add(left, of_left, depth + 1), add(right, of_right, depth + 1), float(data.cuts[feature][cut])]
        grown += 1
    return np.array([tuple(n) for n in nodes], NODE)


def grow_together(data: Binned, target: np.ndarray, weights: np.ndarray, limits: Growth) -> list[np.ndarray]:
    """Many trees at once (a row of `weights` each), level by level, without a limit on leaves.

    All open nodes of all trees are cut in one pass per predictor: rows are sorted by node and bin, and
    running sums inside a node give the gain of each cut.
    """
    tree, row = np.nonzero(weights > 0)
    mass, moment = weights[tree, row], weights[tree, row] * target[row]
    node = tree.copy()  # number among the open nodes of this level
    owner = np.arange(len(weights))  # tree of each open node
    codes = data.codes - np.arange(data.codes.shape[1]) * data.width
    levels, first, depth = [], 0, 0
    while len(owner):
        k = len(owner)
        w, s = np.bincount(node, mass, k), np.bincount(node, moment, k)
        gain, feature, cut = np.full(k, 1e-9), np.full(k, -1), np.zeros(k, int)
        base = shrunk(s, limits.l1) ** 2 / np.maximum(w + limits.l2, 1e-12)
        for f in range(codes.shape[1] if limits.depth is None or depth < limits.depth else 0):
            code = codes[row, f]
            order = np.argsort(node * data.width + code, kind="stable")
            of, at = node[order], code[order]
            wl, sl = np.cumsum(mass[order]), np.cumsum(moment[order])
            begin = np.searchsorted(of, np.arange(k))
            before = lambda total, begin=begin: np.where(begin > 0, total[begin - 1], 0.0)
            wl, sl = wl - before(wl)[of], sl - before(sl)[of]
            wr, sr = w[of] - wl, s[of] - sl
            last = np.append((of[1:] != of[:-1]) | (at[1:] != at[:-1]), True)
            fits = np.flatnonzero(last & (wl >= limits.min_rows) & (wr >= limits.min_rows) & (wr > 1e-9))
            if not len(fits):
                continue
            own = shrunk(sl[fits], limits.l1) ** 2 / np.maximum(wl[fits] + limits.l2, 1e-12)
            own += shrunk(sr[fits], limits.l1) ** 2 / np.maximum(wr[fits] + limits.l2, 1e-12)
            own = np.round(own - base[of[fits]], 9)
            best = np.lexsort((np.arange(len(fits)), -own, of[fits]))
            best = best[np.append(True, np.diff(of[fits][best]) != 0)]
            where = of[fits][best]
            better = own[best] > gain[where]
            gain[where[better]], feature[where[better]], cut[where[better]] = own[best][better], f, at[fits][best][better]
        split = feature >= 0
        left = first + k + 2 * (np.cumsum(split) - 1)
        table = np.zeros(k, NODE)
        table["feature"], table["value"] = feature, shrunk(s, limits.l1) / np.maximum(w + limits.l2, 1e-12)
        table["left"], table["right"] = np.where(split, left, -1), np.where(split, left + 1, -1)
        table["at"] = [data.cuts[f][c] if f >= 0 else 0.0 for f, c in zip(feature, cut, strict=True)]
        levels.append((owner, table))
        going = split[node]
        row, node, mass, moment = row[going], node[going], mass[going], moment[going]
        right = codes[row, feature[node]] > cut[node] if len(row) else np.zeros(0, bool)
        node = left[node] - first - k + right
        owner, first, depth = np.repeat(owner[split], 2), first + k, depth + 1
    owner, table = np.concatenate([o for o, _ in levels]), np.concatenate([t for _, t in levels])
    out = []
    for t in range(len(weights)):
        own = np.flatnonzero(owner == t)
        nodes = table[own].copy()
        for side in ("left", "right"):
            nodes[side] = np.where(nodes["feature"] >= 0, np.searchsorted(own, nodes[side]), -1)
        out.append(nodes)
    return out


def applied(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The value of the leaf each row falls into."""
    at = np.zeros(len(x), np.int64)
    going = np.arange(len(x)) if tree["feature"][0] >= 0 else np.zeros(0, np.int64)
    while len(going):
        node = tree[at[going]]
        at[going] = np.where(x[going, node["feature"]] <= node["at"], node["left"], node["right"])
        going = going[tree["feature"][at[going]] >= 0]
    return tree["value"][at]


def forest(x, y, draw: np.random.Generator, trees: int = 100, limits: Growth = Growth()) -> dict:
    """Bootstrapped trees on all predictors; the prediction is their mean."""
    counts = np.stack([np.bincount(draw.integers(0, len(y), len(y)), minlength=len(y)) for _ in range(trees)]).astype(float)
    grown = grow_together(Binned(x, limits.bins), y, counts, limits)
    return {"kind": "forest", "base": 0.0, "rate": 1.0 / trees, "trees": grown, "votes": []}


def boosted(
    x,
    y,
    draw: np.random.Generator,
    rounds: int = 100,
    rate: float = 0.1,
    subsample: float = 1.0,
    columns: float = 1.0,
    limits: Growth = Growth(),
    valid: tuple[np.ndarray, np.ndarray] | None = None,
    patience: int | None = None,
    data: Binned | None = None,
) -> dict:
    """Gradient boosting of squared error; stops `patience` rounds after the best score on `valid`."""
    data = data or Binned(x, limits.bins)
    base = float(y.mean())
    now, ahead = np.full(len(y), base), np.full(len(valid[1]) if valid else 0, base)
    grown: list[np.ndarray] = []
    best, best_rounds = np.inf, 0
    used = max(1, round(columns * x.shape[1]))
    for _ in range(rounds):
        weight = (draw.random(len(y)) < subsample).astype(float) if subsample < 1 else np.ones(len(y))
        features = draw.permutation(x.shape[1])[:used]
        tree = grow(data, y - now, weight, limits, features)
        now += rate * applied(tree, x)
        grown.append(tree)
        if valid:
            ahead += rate * applied(tree, valid[0])
            error = float(((ahead - valid[1]) ** 2).mean())
            if error < best:
                best, best_rounds = error, len(grown)
            if patience and len(grown) - best_rounds >= patience:
                break
    return {"kind": "boosted", "base": base, "rate": rate, "trees": grown[:best_rounds] if valid and patience else grown, "votes": []}


def adaboost(x, y, draw: np.random.Generator, rounds: int = 50, limits: Growth = Growth(depth=3)) -> dict:
    """AdaBoost.R2 with linear loss; a tree whose average loss reaches one half ends it (the first one stays)."""
    data, everything = Binned(x, limits.bins), np.arange(x.shape[1])
    weight = np.full(len(y), 1.0)
    grown, votes = [], []
    for _ in range(rounds):
        tree = grow(data, y, weight, limits, everything)
        loss = np.abs(applied(tree, x) - y)
        worst = float(loss.max())
        average = float((weight * loss).sum() / weight.sum() / worst) if worst > 0 else 0.0
        if average >= 0.5:
            if not grown:
                grown, votes = [tree], [1.0]
            break
        beta = max(average / (1 - average), 1e-12)
        grown.append(tree)
        votes.append(-float(np.log(beta)))
        if worst == 0:
            break
        weight = weight * beta ** (1 - loss / worst)
        weight *= len(y) / weight.sum()
    return {"kind": "adaboost", "base": 0.0, "rate": 1.0, "trees": grown, "votes": votes}


def estimated(model: dict, x: np.ndarray) -> np.ndarray:
    """A model's prediction for complete rows."""
    if model["kind"] != "adaboost":
        return model["base"] + model["rate"] * sum((applied(t, x) for t in model["trees"]), np.zeros(len(x)))
    values = np.stack([applied(t, x) for t in model["trees"]], 1)
    order = np.argsort(values, axis=1, kind="stable")
    weight = np.cumsum(np.array(model["votes"])[order], axis=1)
    middle = (weight >= weight[:, -1:] / 2).argmax(1)
    return values[np.arange(len(x)), order[np.arange(len(x)), middle]]


# ---------------------------------------------------------------------------- on Spark


def matrix(table: pa.Table, columns: list[str]) -> np.ndarray:
    return np.column_stack([table.column(c).cast(pa.float64()).to_numpy() for c in columns]) if columns else np.zeros((table.num_rows, 0))


def ordered(table: pa.Table, columns: list[str]) -> pa.Table:
    """The rows in an order that depends on their values alone."""
    return table.sort_by([(c, "ascending") for c in columns])


def draws(seed: int, *parts) -> np.random.Generator:
    return np.random.default_rng([seed, zlib.crc32(repr(parts).encode())])


def by_model(df: DataFrame, keys: list[str]):
    """Rows grouped by model; enough partitions that models are fitted side by side even if their rows are few."""
    parts = max(32, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys).groupBy(*keys)


def key_of(table: pa.Table, keys: list[str]) -> tuple:
    return tuple(table.column(k)[0].as_py() for k in keys)


def fit(df: DataFrame, keys: list[str], features: list[str], target: str, order: str, learner, seed: int = 42, **settings) -> DataFrame:
    """A model per key: `learner` is forest, boosted or adaboost. Rows with a missing value are not learned from."""
    columns = [*keys, order, *features, target]
    whole = df.dropna(subset=[*features, target]).select(*dict.fromkeys(columns))
    fields = [whole.schema[k] for k in keys] + T._parse_datatype_string(MODEL).fields

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table, [order, target, *features])
        key = key_of(table, keys)
        model = learner(matrix(table, features), matrix(table, [target])[:, 0], draws(seed, key), **settings)
        out = {k: table.column(k).slice(0, 1).combine_chunks() for k in keys}
        out |= {"kind": pa.array([model["kind"]]), "base": pa.array([model["base"]]), "rate": pa.array([model["rate"]])}
        out |= {
            "trees": pa.array([[t.tobytes() for t in model["trees"]]], pa.list_(pa.binary())),
            "votes": pa.array([model["votes"]], pa.list_(pa.float64())),
        }
        return pa.table(out)

    return by_model(whole, keys).applyInArrow(run, T.StructType(fields))


def loaded(models: pa.Table) -> dict:
    row = models.slice(0, 1).to_pylist()[0]
    return row | {"trees": [np.frombuffer(t, NODE) for t in row["trees"]]}


def predict(df: DataFrame, models: DataFrame, keys: list[str], features: list[str], out: str = "predicted") -> DataFrame:
    """Adds the model's prediction; it is NULL where the key has no model or a predictor is missing."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        x = matrix(rows, features)
        known = ~np.isnan(x).any(1)
        value = np.full(len(x), np.nan)
        if model.num_rows and known.any():
            value[known] = estimated(loaded(model), x[known])
        return rows.append_column(out, pa.array(value, mask=np.isnan(value)))

    return by_model(df, keys).cogroup(by_model(models, keys)).applyInArrow(run, schema)


def cross_validated(df: DataFrame, keys: list[str], features: list[str], target: str, folds: int, learner, seed: int = 42, **settings) -> DataFrame:
    """Mean RMSE over expanding-window folds, per key: rmse, folds.

    Rows carry `_pos`, their place on the time axis, and its length `_n`; they are read once, not once a fold.
    """
    whole = df.dropna(subset=[*features, target]).select(*keys, "_pos", "_n", *features, target)
    schema = T.StructType([*[whole.schema[k] for k in keys], T.StructField("rmse", T.DoubleType()), T.StructField("folds", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table, ["_pos", target, *features])
        x, y, at = matrix(table, features), matrix(table, [target])[:, 0], table.column("_pos").to_numpy()
        n = table.column("_n")[0].as_py()
        size = n // (folds + 1)
        errors = []
        for fold in range(1, folds + 1):
            start = n - (folds - fold + 1) * size
            train, test = at <= start, (at > start) & (at <= start + size)
            if train.any() and test.any():
                model = learner(x[train], y[train], draws(seed, key_of(table, keys), fold), **settings)
                errors.append(float(np.sqrt(((estimated(model, x[test]) - y[test]) ** 2).mean())))
        out = {k: table.column(k).slice(0, 1).combine_chunks() for k in keys}
        return pa.table(out | {"rmse": pa.array([np.mean(errors) if errors else None], pa.float64()), "folds": pa.array([len(errors)], pa.int64())})

    return by_model(whole, keys).applyInArrow(run, schema)


def trial_scores(df: DataFrame, keys: list[str], features: list[str], target: str, trials: list[dict], rounds: int, patience: int, seed: int) -> DataFrame:
    """RMSE on the rows of part `valid` for every trial and key: number, keys, rmse, rounds.

    A key's rows are read and binned once for all trials; keys without rows in both parts have no score.
    """
    whole = df.dropna(subset=[*features, target]).select(*keys, "part", "time", *features, target)
    added = T._parse_datatype_string("number int, rmse double, rounds int").fields
    schema = T.StructType([*[whole.schema[k] for k in keys], *added])

    def run(table: pa.Table) -> pa.Table:
        table = ordered(table, ["time", target, *features])
        x, y = matrix(table, features), matrix(table, [target])[:, 0]
        test = np.array([p == "valid" for p in table.column("part").to_pylist()])
        rows = []
        if test.any() and not test.all():
            data = Binned(x[~test], BINS)
            for t in trials:
                limits = Growth(t["num_leaves"], t["depth"], t["min_rows"], t["l1"], t["l2"])
                model = boosted(
                    x[~test], y[~test], draws(seed, key_of(table, keys), t["number"]), rounds, t["rate"], t["subsample"],
                    t["colsample"], limits, (x[test], y[test]), patience, data,
                )
                error = float(np.sqrt(((estimated(model, x[test]) - y[test]) ** 2).mean()))
                rows.append((t["number"], error, len(model["trees"])))
        out = {k: pa.chunked_array([table.column(k).take(pa.array(np.zeros(len(rows), int))).combine_chunks()]) for k in keys}
        kinds = (pa.int32(), pa.float64(), pa.int32())
        return pa.table(out | {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("number", "rmse", "rounds"), kinds, strict=True))})

    return by_model(whole, keys).applyInArrow(run, schema)


def with_axis_position(df: DataFrame, axis: DataFrame) -> DataFrame:
    """Adds `_pos` and `_n` of the stored time axis (a row per time step)."""
    return df.join(F.broadcast(axis) if axis.count() <= 1_000_000 else axis, ["time"])
