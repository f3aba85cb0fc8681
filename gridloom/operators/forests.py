"""Global trees: random forest and gradient boosting over the whole grid by distributed histograms.

Rows are stored once as bin codes. A pass routes every row through the trees grown so far (their upper parts, which
are small) and adds up, per task, weight and gradient by (node, predictor, bin); Spark adds up the tasks' sums, runs
them along the bins and keeps the best cut of each node, and only cuts reach the driver. All trees of a forest, or
all open leaves of a boosted tree, share a pass, and no row is shuffled.

A node of at most `finish` rows isn't worth a pass over all rows: where its order of growth doesn't matter (no limit on
leaves, or the whole tree is that small), its rows are dealt to one task, which grows the rest of that subtree by the same
rule. So the passes needed depend on log(rows / finish), not on how deep a tree ends. A forest's subtrees stay a table
(as many nodes as rows, if trees grow out); rows to predict are dealt to them by (tree, node), crowded nodes in shares.

Gradients are whole multiples of a power of two, small enough that no sum overflows: sums are the same for
any partitioning, and so are the trees. Draws (a forest's Poisson counts, a round's sample) are hashes of the
row's key, the tree's number and the seed.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from heapq import heappop, heappush
from math import ceil, exp, factorial, floor, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from gridloom.operators.trees import NODE, Binned, Growth, applied, grow, grow_together, shrunk
from gridloom.sources.workspace import discard, stored

FINISH = 1 << 16  # rows of a node that one task grows to the end
CELLS = 1 << 22  # histogram cells a task holds at once
KEEP = 10  # boosting rounds between two written tables of margins
SHARE = 1 << 17  # rows to predict that one task holds for a subtree
SEED = 42
_POISSON = np.cumsum([exp(-1) / factorial(k) for k in range(20)])


# ---------------------------------------------------------------------------- rows


def edges(df: DataFrame, features: list[str], bins: int, exact: list[str] = ()) -> list[np.ndarray]:
    """Upper limits of all bins but the last, per predictor: quantiles from a mergeable sketch, or every value of `exact` ones."""
    probs = [k / bins for k in range(1, bins + 1)]
    usual = [f for f in features if f not in exact]
    row = df.agg(*[F.percentile_approx(f, probs, 50 * bins).alias(f) for f in usual], *[F.sort_array(F.collect_set(f)).alias(f) for f in exact]).first()
    return [np.unique(np.array(row[f] or [0.0], float))[:-1] for f in features]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def uniform(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    salt = mixed(np.array([(seed << 32) + tree + 1], np.uint64))[0]
    return (mixed(key.view(np.uint64) ^ salt) >> np.uint64(11)) / float(1 << 53)


def coded(df: DataFrame, keys: list[str], features: list[str], target: str, cuts: list[np.ndarray]) -> DataFrame:
    """key (hash of the row's keys), c0.. (bin of each predictor), y, margin."""
    rows = df.dropna(subset=[target, *features]).select(
        F.xxhash64(*keys).alias("key"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], F.col(target).cast("double").alias("y")
    )

    def run(batches):
        for batch in batches:
            codes = [pa.array(np.searchsorted(c, batch.column(i + 1).to_numpy()).astype(np.int32)) for i, c in enumerate(cuts)]
            y = batch.column(len(cuts) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *codes, y, pa.array(np.zeros(len(y)))], schema=arrow)

    arrow = pa.schema([("key", pa.int64()), *[(f"c{i}", pa.int32()) for i in range(len(cuts))], ("y", pa.float64()), ("margin", pa.float64())])
    return rows.mapInArrow(run, ", ".join(["key long", *[f"c{i} int" for i in range(len(cuts))], "y double", "margin double"]))


# ---------------------------------------------------------------------------- trees under growth


@dataclass
class Upper:
    """The part of a tree that the driver knows; `handed` nodes go on as subtrees."""

    number: int
    features: list[int]
    nodes: list[list] = field(default_factory=lambda: [[-1, -1, -1, 0, 0.0]])  # feature, left, right, cut (bin), value
    depth: list[int] = field(default_factory=lambda: [0])
    handed: set[int] = field(default_factory=set)
    gains: dict[int, float] = field(default_factory=dict)  # by predictor

    def table(self) -> np.ndarray:
        return np.array([tuple(n) for n in self.nodes], [("feature", "<i4"), ("left", "<i4"), ("right", "<i4"), ("at", "<f8"), ("value", "<f8")])

    def split(self, node: int, feature: int, cut: int, gain: float) -> tuple[int, int]:
        left = len(self.nodes)
        self.nodes[node][:4] = [feature, left, left + 1, cut]
        for _ in range(2):
            self.nodes.append([-1, -1, -1, 0, 0.0])
            self.depth.append(self.depth[node] + 1)
        self.gains[feature] = self.gains.get(feature, 0.0) + gain
        return left, left + 1


def leaf_of(tree: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The number of the node each row of codes ends in."""
    at = np.zeros(len(codes), np.int64)
    going = np.arange(len(codes)) if tree["feature"][0] >= 0 else np.zeros(0, np.int64)
    while len(going):
        node = tree[at[going]]
        at[going] = np.where(codes[going, node["feature"]] <= node["at"], node["left"], node["right"])
        going = going[tree["feature"][at[going]] >= 0]
    return at


@dataclass(frozen=True)
class Draws:
    """How often a row counts in a tree."""

    kind: str  # poisson, sample or all
    share: float = 1.0
    seed: int = SEED

    def weights(self, key: np.ndarray, tree: int) -> np.ndarray:
        if self.kind == "poisson":
            return np.searchsorted(_POISSON, uniform(key, tree, self.seed), side="right").astype(np.int64)
        if self.kind == "sample" and self.share < 1:
            return (uniform(key, tree, self.seed) < self.share).astype(np.int64)
        return np.ones(len(key), np.int64)


@dataclass(frozen=True)
class Rows:
    """Coded rows, the limits of trees grown on them, and what is drawn from them."""

    table: DataFrame
    cuts: list[np.ndarray]
    limits: Growth
    scale: float  # a gradient is stored as round(gradient * scale)
    drawn: Draws

    @property
    def width(self) -> int:
        return max(len(c) for c in self.cuts) + 1


def unpacked(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    key = batch.column(0).to_numpy()
    codes = np.stack([batch.column(i + 1).to_numpy() for i in range(n)], 1) if n else np.zeros((len(key), 0), np.int32)
    return key, codes, batch.column(n + 1).to_numpy(), batch.column(n + 2).to_numpy()


def shrink(total, weight, limits: Growth):
    """Value of a node with these sums."""
    return float(shrunk(total, limits.l1) / max(weight + limits.l2, 1e-12))


def best_cuts(rows: Rows, trees: list[Upper], wanted: list[tuple[int, int]], later: list[tuple[np.ndarray, float]]) -> dict:
    """For each wanted (tree, node): weight, sum, rows, and its best cut (gain, feature, bin, weight and sum of the left side)."""
    n, width, limits, scale, drawn = len(rows.cuts), rows.width, rows.limits, rows.scale, rows.drawn
    most = max(1, CELLS // max(1, n * width))
    if len(wanted) > most:
        return {k: v for i in range(0, len(wanted), most) for k, v in best_cuts(rows, trees, wanted[i : i + most], later).items()}
    slots: dict[int, dict[int, int]] = {}
    for slot, (t, node) in enumerate(wanted):
        slots.setdefault(t, {})[node] = slot
    job = [(trees[t].number, trees[t].table(), own) for t, own in slots.items()]
    shared = rows.table.sparkSession.sparkContext.broadcast((job, later))
    size = len(wanted) * n * width

    def run(batches):
        job, later = shared.value
        weight, total, count = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(len(wanted), np.int64)
        for batch in batches:
            key, codes, y, margin = unpacked(batch, n)
            margin = margin + sum((r * t["value"][leaf_of(t, codes)] for t, r in later), np.zeros(len(y)))
            gradient = np.rint((y - margin) * scale)
            for number, table, own in job:
                slot_of = np.full(len(table), -1)
                slot_of[list(own)] = list(own.values())
                slot, w = slot_of[leaf_of(table, codes)], drawn.weights(key, number)
                at = np.flatnonzero((slot >= 0) & (w > 0))
                if not len(at):
                    continue
                slot, w = slot[at], w[at]
                count += np.bincount(slot, minlength=len(wanted))
                met, inverse = np.unique(slot, return_inverse=True)  # only the wanted nodes of this tree
                for f in range(n):
                    cell = inverse * width + codes[at, f]
                    place = ((met * n + f) * width)[:, None] + np.arange(width)[None, :]
                    weight[place.ravel()] += np.bincount(cell, w, len(met) * width).astype(np.int64)
                    total[place.ravel()] += np.bincount(cell, w * gradient[at], len(met) * width).astype(np.int64)
        used = np.flatnonzero(weight)
        slot, feature, code = used // (n * width), used // width % n, used % width
        columns = [slot, feature, code, weight[used], total[used], np.zeros(len(used), np.int64)]
        met = np.flatnonzero(count)
        columns = [np.concatenate((c, x)) for c, x in zip(columns, (met, met * 0 - 1, met * 0, met * 0, met * 0, count[met]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["slot", "feature", "code", "w", "s", "n"])

    told = rows.table.mapInArrow(run, "slot long, feature long, code long, w long, s long, n long")
    cells = told.groupBy("slot", "feature", "code").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    bin_order = W.partitionBy("slot", "feature").orderBy("code").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("slot", "feature")
    sums = cells.select(
        "slot", "feature", "code", "n",
        F.sum("w").over(bin_order).alias("wl"), F.sum("s").over(bin_order).alias("sl"), F.sum("w").over(whole).alias("w"), F.sum("s").over(whole).alias("s"),
    )

    def score(s, w):
        s = s / F.lit(rows.scale)
        s = F.signum(s) * F.greatest(F.abs(s) - F.lit(limits.l1), F.lit(0.0)) if limits.l1 else s
        return s * s / F.greatest(w + F.lit(limits.l2), F.lit(1e-12))

    wr, sr = F.col("w") - F.col("wl"), F.col("s") - F.col("sl")
    gain = F.round(score(F.col("sl"), F.col("wl")) + score(sr, wr) - score(F.col("s"), F.col("w")), 9)
    allowed = F.lit(False)
    for slot_group, used in grouped_features(trees, wanted):
        allowed = allowed | (F.col("slot").isin(slot_group) if slot_group is not None else F.lit(True)) & F.col("feature").isin(used)
    fits = (F.col("wl") >= limits.min_rows) & (wr >= limits.min_rows) & (wr > 0) & allowed
    cut = F.struct(gain.alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("code")).alias("code"), "wl", "sl")
    best = sums.groupBy("slot").agg(
        F.max(F.when(F.col("feature") == 0, F.col("w"))).alias("w"), F.max(F.when(F.col("feature") == 0, F.col("s"))).alias("s"),
        F.sum("n").alias("n"), F.max(F.when(fits & (gain > 1e-9), cut)).alias("cut"),
    )
    out = {}
    for r in best.collect():
        c = r["cut"]
        cut = (c["gain"], -c["feature"], -c["code"], c["wl"], c["sl"] / rows.scale) if c else None
        out[wanted[r["slot"]]] = (r["w"] or 0, (r["s"] or 0) / rows.scale, r["n"], cut)
    shared.destroy()
    return out


def grouped_features(trees: list[Upper], wanted: list[tuple[int, int]]):
    """Slots by the predictors their tree may use; None stands for all slots where all trees may use the same."""
    by: dict[tuple, list[int]] = {}
    for slot, (t, _) in enumerate(wanted):
        by.setdefault(tuple(trees[t].features), []).append(slot)
    return [(None, list(f)) for f in by] if len(by) == 1 else [(s, list(f)) for f, s in by.items()]


def rest_of(rows: Rows, trees: list[Upper], later: list[tuple[np.ndarray, float]]) -> DataFrame:
    """tree, node, subtree (packed nodes), gains: the handed nodes, each grown to the end where its rows are dealt."""
    n, width, limits, scale, drawn = len(rows.cuts), rows.width, rows.limits, rows.scale, rows.drawn
    features = {t.number: t.features for t in trees}
    job = [(t.number, t.table(), sorted(t.handed)) for t in trees if t.handed]
    depth = {(t.number, k): t.depth[k] for t in trees for k in t.handed}
    shared = rows.table.sparkSession.sparkContext.broadcast((job, later))

    def deal(batches):
        job, later = shared.value
        for batch in batches:
            key, codes, y, margin = unpacked(batch, n)
            margin = margin + sum((r * t["value"][leaf_of(t, codes)] for t, r in later), np.zeros(len(y)))
            gradient = np.rint((y - margin) * scale)
            for number, table, handed in job:
                node, w = leaf_of(table, codes), drawn.weights(key, number)
                at = np.flatnonzero((w > 0) & np.isin(node, handed))
                if len(at):
                    own = [np.full(len(at), number), node[at], w[at], gradient[at], *codes[at].T]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64 if i == 3 else np.int32)) for i, x in enumerate(own)], names=names)

    names = ["tree", "node", "w", "g", *[f"c{i}" for i in range(n)]]
    dealt = rows.table.mapInArrow(deal, ", ".join(f"{c} {'long' if c == 'g' else 'int'}" for c in names))

    def finish(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        data = Binned.__new__(Binned)
        data.cuts = [np.arange(width, dtype=float)] * n  # cuts are bin numbers here
        data.width = width
        data.codes = np.stack([table.column(f"c{i}").to_numpy() + i * width for i in range(n)], 1).astype(np.int64)
        y, w = table.column("g").to_numpy() / scale, table.column("w").to_numpy().astype(float)
        own = replace(limits, depth=None if limits.depth is None else limits.depth - depth[tree, node])
        if limits.leaves is None and len(features[tree]) == n:
            grown = grow_together(data, y, w[None, :], own)[0]
        else:
            grown = grow(data, y, w, own, np.array(features[tree]))
        gains = importance(grown, data.codes - np.arange(n) * width, y, w, n)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()), "subtree": pa.array([grown.tobytes()]), "gains": pa.array([gains.tolist()])})

    return dealt.groupBy("tree", "node").applyInArrow(finish, "tree int, node int, subtree binary, gains array<double>")


def importance(tree: np.ndarray, codes: np.ndarray, y: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Decrease of the squared error by predictor, over the rows a tree was grown on."""
    at = leaf_of(tree, codes)
    weight, total = np.bincount(at, w, len(tree)), np.bincount(at, w * y, len(tree))
    out = np.zeros(n)
    for k in range(len(tree) - 1, -1, -1):  # children come after their parent
        if tree["feature"][k] >= 0:
            sides = [tree["left"][k], tree["right"][k]]
            weight[k], total[k] = weight[sides].sum(), total[sides].sum()
            out[tree["feature"][k]] += (total[sides] ** 2 / np.maximum(weight[sides], 1e-12)).sum() - total[k] ** 2 / max(weight[k], 1e-12)
    return out


def grown(rows: Rows, trees: list[Upper], n: int, later: list[tuple[np.ndarray, float]] = (), finish: int | None = None) -> None:
    """Grows the upper parts of all trees over n rows; nodes to be grown where their rows are go into `handed`."""
    limits, finish = rows.limits, FINISH if finish is None else finish
    if n <= finish:
        for tree in trees:
            tree.handed.add(0)
        return
    facts = best_cuts(rows, trees, [(t, 0) for t in range(len(trees))], list(later))
    queues: list[list] = [[] for _ in trees]
    leaves = [1] * len(trees)

    def settle(t: int, node: int) -> None:
        w, s, n, cut = facts[t, node]
        trees[t].nodes[node][4] = shrink(s, w, limits)
        if cut is None or limits.depth is not None and trees[t].depth[node] >= limits.depth:
            return
        if n <= finish and (limits.leaves is None or node == 0):
            trees[t].handed.add(node)
        else:
            heappush(queues[t], (-cut[0], node))

    for t in range(len(trees)):
        if (t, 0) in facts:
            settle(t, 0)
    while True:
        asked, waiting = [], []
        for t, queue in enumerate(queues):
            room = len(queue) if limits.leaves is None else limits.leaves - leaves[t]
            # the best leaves first; those that may yet be split are looked at together
            for _, node in sorted(queue)[:room]:
                _, feature, cut, wl, sl = facts[t, node][3]
                children = facts.get(("children", t, node))
                if children is None:
                    waiting.append((t, node))
        if not any(queues[t] and (limits.leaves is None or leaves[t] < limits.leaves) for t in range(len(trees))):
            return
        # tentative children of every waiting node, asked for in one pass
        trial = [Upper(tr.number, tr.features, [list(x) for x in tr.nodes], list(tr.depth)) for tr in trees]
        place = {}
        for t, node in waiting:
            gain, feature, cut, _, _ = facts[t, node][3]
            place[t, node] = trial[t].split(node, feature, cut, gain)
            asked += [(t, k) for k in place[t, node]]
        told = best_cuts(rows, trial, asked, list(later)) if asked else {}
        for (t, node), sides in place.items():
            facts["children", t, node] = [told.get((t, k)) for k in sides]
        # split for good, the best gain first, until a leaf without known children is due
        for t, queue in enumerate(queues):
            while queue and (limits.leaves is None or leaves[t] < limits.leaves) and ("children", t, queue[0][1]) in facts:
                _, node = heappop(queue)
                gain, feature, cut, _, _ = facts[t, node][3]
                for side, fact in zip(trees[t].split(node, feature, cut, gain), facts["children", t, node], strict=True):
                    facts[t, side] = fact
                    settle(t, side)
                leaves[t] += 1


# ---------------------------------------------------------------------------- models


@dataclass
class Model:
    """Trees over bin codes: `base + rate * sum of trees`; the subtrees of handed nodes are a table."""

    features: list[str]
    cuts: list[np.ndarray]
    trees: list[Upper]
    base: float
    rate: float
    subtrees: DataFrame | None = None
    whole: list[np.ndarray] = field(default_factory=list)  # boosted trees, subtrees put in


def prepared(df: DataFrame, keys: list[str], features: list[str], target: str, limits: Growth, exact: list[str], cuts=None) -> tuple[DataFrame, list[np.ndarray], dict]:
    whole = df.dropna(subset=[target, *features])
    cuts = edges(whole, features, limits.bins, exact) if cuts is None else cuts
    table = stored(coded(whole, keys, features, target, cuts), "codes")
    facts = table.agg(F.count("y").alias("n"), F.avg("y").alias("mean"), F.max(F.abs("y")).alias("most")).first().asDict()
    return table, cuts, facts


def scale_of(n: int, most: float) -> float:
    """The finest power of two at which n gradients of this size, Poisson counts included, fit 62 bits (2^30 at most)."""
    return 2.0 ** max(0, min(30, floor(62 - log2(max(1.0, 4.0 * n * max(most, 1e-300))))))


def fit_forest(
    df: DataFrame, keys: list[str], features: list[str], target: str, trees: int = 100, limits: Growth = Growth(), exact: list[str] = (), seed: int = SEED, finish: int | None = None
) -> Model | None:
    """Bootstrapped trees on all predictors; the prediction is their mean. None without a row."""
    table, cuts, facts = prepared(df, keys, features, target, limits, exact)
    if not facts["n"]:
        return None
    rows = Rows(table, cuts, limits, scale_of(facts["n"], facts["most"]), Draws("poisson", seed=seed))
    uppers = [Upper(t, list(range(len(features)))) for t in range(trees)]
    grown(rows, uppers, facts["n"], finish=finish)
    subtrees = stored(rest_of(rows, uppers, []), "subtrees") if any(t.handed for t in uppers) else None
    return Model(features, cuts, uppers, 0.0, 1.0 / trees, subtrees)


def put_together(upper: Upper, subtrees: dict[int, np.ndarray]) -> np.ndarray:
    """One node table from a tree's upper part and its subtrees."""
    nodes = [tuple(x) for x in upper.nodes]
    for node, own in subtrees.items():
        shift = len(nodes) - 1
        moved = [(int(f), int(a) + shift if f >= 0 else -1, int(b) + shift if f >= 0 else -1, float(at), float(v)) for f, a, b, at, v in own]
        nodes[node] = moved[0]
        nodes += moved[1:]
    return np.array(nodes, NODE)


def fit_boosted(
    df: DataFrame, keys: list[str], features: list[str], target: str, rounds: int = 100, rate: float = 0.1, subsample: float = 1.0, columns: float = 1.0,
    limits: Growth = Growth(depth=6), exact: list[str] = (), valid: DataFrame | None = None, patience: int | None = None, seed: int = SEED,
    finish: int | None = None, cuts: list[np.ndarray] | None = None,
) -> Model | None:
    """Gradient boosting of squared error; with `valid` and `patience` it stops that many rounds after its best score there."""
    table, cuts, facts = prepared(df, keys, features, target, limits, exact, cuts)
    if not facts["n"]:
        return None
    if limits.depth is None and limits.leaves is None:
        raise ValueError("boosted trees need a limit on depth or leaves")
    base, scale = facts["mean"], scale_of(facts["n"], 2 * facts["most"])
    draw = np.random.default_rng(seed)
    used = max(1, round(columns * len(features)))
    table = moved_on(table, [], base, len(cuts))
    checked = moved_on(stored(coded(valid, keys, features, target, cuts), "codes"), [], base, len(cuts)) if valid is not None else None
    uppers, whole, errors, later = [], [], [], []
    for number in range(rounds):
        rows = Rows(table, cuts, limits, scale, Draws("sample", subsample, seed))
        upper = Upper(number, sorted(draw.permutation(len(features))[:used].tolist()))
        grown(rows, [upper], facts["n"], later, finish)
        own, gains = {}, upper.gains
        if upper.handed:  # at most `finish` rows and bounded in depth or leaves, so few nodes
            for r in rest_of(rows, [upper], later).collect():
                own[r["node"]] = np.frombuffer(r["subtree"], NODE)
                for f, g in enumerate(r["gains"]):
                    gains[f] = gains.get(f, 0.0) + g
        tree = put_together(upper, own)
        uppers.append(upper)
        whole.append(tree)
        later = [*later, (tree, rate)]
        if len(later) == KEEP or number == rounds - 1:
            if checked is not None:
                errors += round_errors(checked, later, len(cuts))
                if patience and len(errors) - 1 - int(np.argmin(errors)) >= patience:
                    break
                checked = moved_on(checked, later, 0.0, len(cuts))
            table, later = moved_on(table, later, 0.0, len(cuts)), []
    discard(table)
    if errors and patience:
        whole = whole[: int(np.argmin(errors)) + 1]
    return Model(features, cuts, uppers[: len(whole)], base, rate, None, whole)


def moved_on(table: DataFrame, later: list[tuple[np.ndarray, float]], plus: float, n: int) -> DataFrame:
    """The coded rows with margins moved by the trees of the last rounds, written; the table before is deleted."""

    def run(batches):
        for batch in batches:
            _, codes, _, margin = unpacked(batch, n)
            margin = margin + plus + sum((r * t["value"][leaf_of(t, codes)] for t, r in later), np.zeros(len(margin)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(margin)], schema=batch.schema)

    out = stored(table.mapInArrow(run, table.schema), "margins")
    discard(table)
    return out


def round_errors(table: DataFrame, later: list[tuple[np.ndarray, float]], n: int) -> list[float]:
    """Mean squared error after each of these rounds."""

    def run(batches):
        sums, count = np.zeros(len(later)), 0
        for batch in batches:
            _, codes, y, margin = unpacked(batch, n)
            count += len(y)
            for k, (t, r) in enumerate(later):
                margin = margin + r * t["value"][leaf_of(t, codes)]
                sums[k] += ((y - margin) ** 2).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(later), dtype=np.int32)), pa.array(sums), pa.array(np.full(len(later), count))], names=["round", "s", "n"])

    told = table.mapInArrow(run, "round int, s double, n long").groupBy("round").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return [r["s"] / max(1, r["n"]) for r in told.orderBy("round").collect()]


def predict(df: DataFrame, model: Model, out: str = "predicted") -> DataFrame:
    """Adds the prediction; rows with a missing predictor have NULL."""
    features, cuts, base, rate = model.features, model.cuts, model.base, model.rate
    values = F.array(*[F.col(f).cast("double") for f in features])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def codes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(features))
        return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], 1).astype(np.int32), ~np.isnan(x).any(1)

    if model.subtrees is None:
        trees = model.whole or [t.table() for t in model.trees]
        shared = df.sparkSession.sparkContext.broadcast(trees)  # boosted: as many nodes as rounds and limits allow

        def run(batches):
            for batch in batches:
                codes, known = codes_of(batch.column(batch.num_columns - 1))
                value = base + rate * sum((t["value"][leaf_of(t, codes)] for t in shared.value), np.zeros(len(codes)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(value, mask=~known)], names=schema.names)

        return df.withColumn("_values", values).mapInArrow(run, schema)
    return by_subtree(df, model, codes_of, values, out)


def by_subtree(df: DataFrame, model: Model, codes_of, values, out: str) -> DataFrame:
    """Rows are dealt to the subtrees they end in, (tree, node, share), and their values averaged by row."""
    n = len(model.features)
    whole = F.lit(True)
    for f in model.features:
        whole = whole & F.col(f).isNotNull()
    numbered = stored(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    known = numbered.where(whole).select("_row", values.alias("v"))
    tables = [(t.number, t.table(), sorted(t.handed)) for t in model.trees]
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def routed(batch):
        codes, _ = codes_of(batch.column(1))
        for number, table, handed in shared.value:
            yield number, codes, table, leaf_of(table, codes), handed

    def counted(batches):
        for batch in batches:
            for number, _, _, node, _ in routed(batch):
                met, times = np.unique(node, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), number, np.int32)), pa.array(met.astype(np.int32)), pa.array(times)], names=["tree", "node", "n"])

    sizes = known.mapInArrow(counted, "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect()  # upper nodes only
    shares = {(r["tree"], r["node"]): ceil(r["n"] / SHARE) for r in sizes}

    def dealt(batches):
        for batch in batches:
            row = batch.column(0).to_numpy()
            for number, codes, table, node, handed in routed(batch):
                met, inverse = np.unique(node, return_inverse=True)
                share = mixed(row.astype(np.uint64)) % np.array([shares[number, k] for k in met.tolist()], np.uint64)[inverse]
                own = [np.full(len(row), number), node, share, row, table["value"][node], *codes.T]
                kinds = [np.int32, np.int32, np.int32, np.int64, np.float64] + [np.int32] * n
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in zip(own, kinds, strict=True)], names=names)

    names = ["tree", "node", "share", "_row", "value", *[f"c{i}" for i in range(n)]]
    kinds = ["int", "int", "int", "long", "double"] + ["int"] * n
    rows = known.mapInArrow(dealt, ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))
    parts = df.sparkSession.createDataFrame([(t, k, s) for (t, k), times in shares.items() for s in range(times)] or [(-1, -1, 0)], "tree int, node int, share int")
    below = model.subtrees.select("tree", "node", "subtree").join(parts, ["tree", "node"])

    def valued(own: pa.Table, subtree: pa.Table) -> pa.Table:
        value = own.column("value").to_numpy()
        if subtree.num_rows and own.num_rows:
            codes = np.stack([own.column(f"c{i}").to_numpy() for i in range(n)], 1).astype(float)
            value = applied(np.frombuffer(subtree.column("subtree")[0].as_py(), NODE), codes)
        return pa.table({"_row": own.column("_row"), "value": pa.array(value, pa.float64())})

    key = ["tree", "node", "share"]
    found = rows.groupBy(*key).cogroup(below.groupBy(*key)).applyInArrow(valued, "_row long, value double")
    mean = found.groupBy("_row").agg(F.sum("value").alias("_sum"))
    return numbered.join(mean, "_row", "left").withColumn(out, F.lit(model.base) + F.lit(model.rate) * F.col("_sum")).select(*df.columns, out)


def importances(df: DataFrame, model: Model) -> DataFrame:
    """feature, importance: each tree's share of the error decrease by predictor, averaged over trees and scaled to one."""
    spark, n = df.sparkSession, len(model.features)
    upper = [(t.number, f, float(g)) for t in model.trees for f, g in t.gains.items()]
    rows = spark.createDataFrame(upper or [(-1, 0, 0.0)], "tree int, at int, gain double")
    if model.subtrees is not None:
        rows = rows.unionByName(model.subtrees.select("tree", F.posexplode("gains").alias("at", "gain")))
    per = rows.groupBy("tree", "at").agg(F.sum("gain").alias("gain"))
    per = per.withColumn("share", F.try_divide("gain", F.sum("gain").over(W.partitionBy("tree"))))
    total = per.groupBy("at").agg(F.sum("share").alias("share"))
    every = spark.createDataFrame(list(enumerate(model.features)), "at int, feature string").join(total, "at", "left")
    all_of = every.agg(F.sum("share").alias("sum")).scalar()
    return every.select("feature", F.coalesce(F.try_divide("share", all_of), F.lit(0.0)).alias("importance"))
