"""Vector code compression: each vector becomes one codebook index per part, found through memoised grid cells.

A component x becomes the integer floor(256 x); vectors are cut into 16 consecutive parts, and each part
position has a codebook of up to 64 entries, which starts as the parts of the smallest ids and is moved to
its members' means in whole numbers, twice. All arithmetic is in integers, so results don't depend on
partitions or order.

The nearest entry is found by grid cells: a part lies in a box of the grid (its components divided by
the cell width, rounded down). For a box, an entry is dominated if its least distance to the box is greater than
another entry's greatest distance to it: no part in the box is nearest to it. What isn't dominated is
remembered under the cell's key, and a part is compared exactly with the remembered entries of its cell
only (the least index among equals). A task remembers cells for as long as their number stays below a
bound, then starts afresh, so its memory doesn't grow with the data; codes don't depend on it.

Per round every task adds up its members per (part, entry) and Spark adds up the tasks' sums; the driver
holds codebooks only (16 x 64 entries). Sums per label are partial sums as well; they meet the rows again as a
table that is broadcast only where its written size is small.

Defined results: rows whose vector is null or has a null or non-finite component are dropped, and so are those whose
length isn't that of the smallest kept id (they have no place in the codebooks); repeated ids and rows all stay, and equal ids are
ordered by their components; a null id is kept and starts no codebook unless there are too few others; with fewer
than 64 rows there are as many entries; a length that 16 doesn't divide is cut as evenly as can be. Integers beyond
sqrt(2^61 / length) in size count as that bound, so that distances fit 64 bits. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.sources.workspace import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELLS = 20_000  # remembered boxes a part and task; at 64 entries 100 bytes or so each
BLOCK = 1 << 22  # numbers held at once for comparisons


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (array of double) of the rows whose vector is complete and finite."""
    rows = vectors.where("embedding is not null").select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v")
    )
    return rows.where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))


def whole(values: np.ndarray) -> np.ndarray:
    """Rows of floor(256 x), bounded."""
    limit = isqrt((1 << 61) // max(1, values.shape[1]))
    return np.clip(np.floor(values * SCALE), -limit, limit).astype(np.int64)


def borders(length: int, parts: int = PARTS) -> list[int]:
    return [length * p // parts for p in range(parts + 1)]


class Grid:
    """Nearest entries of one codebook; remembers per cell which entries may be nearest."""

    def __init__(self, entries: np.ndarray, cells: int = CELLS):
        self.entries, self.cells = entries, cells
        spread = float(entries.std(axis=0).mean()) if entries.size else 1.0
        self.width = 1 << max(0, round(np.log2(max(1.0, spread))))
        self.known: dict[bytes, int] = {}
        self.first, self.count, self.kept = [], [], []

    def remember(self, cells: np.ndarray) -> None:
        """Adds boxes (rows of cell coordinates): which entries some part inside may be nearest to."""
        low = cells * self.width
        high = low + (self.width - 1)
        e = self.entries[None, :, :]
        beyond = np.maximum(np.maximum(low[:, None, :] - e, e - high[:, None, :]), 0)
        farthest = np.maximum(np.abs(e - low[:, None, :]), np.abs(high[:, None, :] - e))
        least, most = (beyond * beyond).sum(2), (farthest * farthest).sum(2)
        kept = least <= most.min(axis=1, keepdims=True)
        for key, own in zip(cells, kept, strict=True):
            at = np.flatnonzero(own)
            self.known[key.tobytes()] = len(self.count)
            self.first.append(len(self.kept))
            self.count.append(len(at))
            self.kept.extend(at.tolist())

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and the squared distance."""
        if not len(parts) or not parts.shape[1]:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        most = max(1, BLOCK // self.entries.size)
        if len(parts) > most:
            done = [self.nearest(parts[i : i + most]) for i in range(0, len(parts), most)]
            return np.concatenate([a for a, _ in done]), np.concatenate([d for _, d in done])
        cells, of = np.unique(parts // self.width, axis=0, return_inverse=True)
        of = of.ravel()
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new and len(self.known) + len(new) > self.cells:
            self.known, self.first, self.count, self.kept = {}, [], [], []
            new = list(range(len(keys)))
        step = max(1, BLOCK // self.entries.size)
        for begin in range(0, len(new), step):
            self.remember(cells[new[begin : begin + step]])
        slot = np.array([self.known[k] for k in keys])[of]
        count = np.array(self.count)[slot]
        start = np.cumsum(count) - count
        row = np.repeat(np.arange(len(parts)), count)
        entry = np.array(self.kept)[np.repeat(np.array(self.first)[slot] - start, count) + np.arange(len(row))]
        apart = parts[row] - self.entries[entry]
        distance = (apart * apart).sum(1)
        best = np.minimum.reduceat(distance, start)
        hit = np.flatnonzero(distance == best[row])
        _, at = np.unique(row[hit], return_index=True)  # entries of a cell ascend, so the first is the least
        return entry[hit[at]], best


def matrix(column: pa.Array, length: int) -> np.ndarray:
    return whole(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length))


def start(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> tuple[int, list[np.ndarray]] | None:
    """Length of the vectors and the first codebooks."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["v"])
    least = rows.where(F.size("v") == length).orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    book = whole(np.array([r["v"] for r in least], float).reshape(len(least), length))
    cut = borders(length, parts)
    return length, [book[:, a:b] for a, b in zip(cut, cut[1:], strict=False)]


def members(rows: DataFrame, length: int, books: list[np.ndarray]) -> DataFrame:
    """part, entry, n, sums: the members of each entry, added up."""
    shared, cut = rows.sparkSession.sparkContext.broadcast(books), borders(length, len(books))

    def run(batches):
        grids = [Grid(b) for b in shared.value]
        n = [np.zeros(len(b), np.int64) for b in shared.value]
        sums = [np.zeros(b.shape, object) for b in shared.value]  # Python integers: no number of rows is too many
        for batch in batches:
            whole_rows = matrix(batch.column(0), length)
            for p, grid in enumerate(grids):
                own = whole_rows[:, cut[p] : cut[p + 1]]
                at, _ = grid.nearest(own)
                n[p] += np.bincount(at, minlength=len(n[p]))
                order = np.argsort(at, kind="stable")
                met, first = np.unique(at[order], return_index=True)
                if own.size:
                    sums[p][met] += np.add.reduceat(own[order], first, axis=0)
        met = [(p, e) for p in range(len(n)) for e in np.flatnonzero(n[p])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in met], pa.int32()),
                pa.array([e for _, e in met], pa.int32()),
                pa.array([int(n[p][e]) for p, e in met], pa.int64()),
                pa.array([[str(x) for x in sums[p][e]] for p, e in met], pa.list_(pa.string())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    told = rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<string>")
    one = told.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
    added = one.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    return added.groupBy("part", "entry").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("at", "x"))).alias("sums"))


def moved(books: list[np.ndarray], rows: DataFrame, length: int) -> list[np.ndarray]:
    """The codebooks after one round: entries with members at floor(sum / count)."""
    books = [b.copy() for b in books]
    for r in members(rows, length, books).collect():
        books[r["part"]][r["entry"]] = [int(s["x"]) // r["n"] for s in r["sums"]]
    return books


def trained(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> tuple[int, list[np.ndarray]] | None:
    """Length and final codebooks over all rows."""
    begun = start(rows, entries, parts)
    if begun is None:
        return None
    length, books = begun
    own = rows.where(F.size("v") == length)
    for _ in range(rounds if length else 0):
        books = moved(books, own, length)
    return length, books


def assigned(rows: DataFrame, length: int, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code, error."""
    shared, cut = rows.sparkSession.sparkContext.broadcast(books), borders(length, len(books))
    hexed = np.array([f"{i:02x}" for i in range(max(len(b) for b in books))])

    def run(batches):
        grids = [Grid(b) for b in shared.value]
        for batch in batches:
            own = matrix(batch.column(2), length) if length else np.zeros((batch.num_rows, 0), np.int64)
            code, error = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64)
            for p, grid in enumerate(grids):
                at, distance = grid.nearest(own[:, cut[p] : cut[p + 1]])
                code = code + hexed[at].astype(object)
                error += distance
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    label = rows.schema["label"].dataType.simpleString()
    own = rows.where(F.size("v") == length).select("vec_id", "label", "v")
    return own.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def written_out(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> DataFrame:
    """Per kept row: vec_id, label, code, error, label_error, codebooks_sha256."""
    rows = usable(vectors)
    done = trained(rows, rounds, entries, parts)
    length, books = done or (0, [np.zeros((1, 0), np.int64)] * parts)
    codes = stored(assigned(rows, length, books), "codes")
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = codes.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), most).cast("long").alias("label_error"))
    told = stored(sums, "label_sums").withColumnRenamed("label", "of")
    return codes.join(told, F.col("of").eqNullSafe(F.col("label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(written_out(books)).alias("codebooks_sha256")
    )
