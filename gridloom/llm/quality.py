"""Quality rules: fixed limits and robust multivariate outliers, in DataFrame functions only.

Base rules look at a document alone: too few words, or too many of its words in repeated five-word
windows. Beyond them, each document's statistics become a vector of ratios, and a minimum-covariance-
determinant estimate per language and source says which vectors belong together: starting from
medians, concentration steps keep the `share` of documents nearest by Mahalanobis distance and take
their mean and covariance anew, until the determinants settle. A document farther than `cutoff` from
its cell's centre is rejected. The vector holds ratios, never lengths, and each direction has a least
spread, so that neither long documents nor the rare one with a single symbol are outliers.

Cells with fewer than `min_rows` documents use the language's estimate, then the one over all; if even
that has too few, the fixed rules decide alone. All statistics cover every document.

Plan: text is read once into a stored table of numbers; each step aggregates that table by cell
(partial sums on the map side, medians and distances over a fixed grid, so that a cell's buffer is
bounded by the grid) and the cells' parameters, one row per cell, are joined back. A hot source
costs no more than any other: its rows are never gathered.

Defined results: a null or empty text has no words, fails the base rules and is not kept; null
languages and sources are cells of their own; repeated rows are judged alike, each for itself; an
empty table gives no rows; extra columns are nested in `row`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.sources.workspace import stored

SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
REPEAT_WINDOW = 5
GRID = 256  # steps per unit, for medians and distances
SHARE = 0.75
CUTOFF_TAIL = 1e-9
LEAST_SPREAD = (0.08, 0.25, 0.12, 0.12)  # of each direction of the vector
MIN_ROWS = 40
TOLERANCE = 0.02
MAX_STEPS = 12


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """The words of a text: what stands between white space."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def repeated_words(words: Column) -> Column:
    """Words inside five-word windows found twice or more, the first one included."""
    k = REPEAT_WINDOW
    last = F.size(words) - k
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def exact() -> Column:
        grams = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", F.slice(words, i + 1, k)).alias("gram"), i.alias("at"))
        )

        def twice(ordered: Column) -> Column:
            marked = F.transform(
                ordered,
                lambda x, i: F.when(
                    (x["gram"] == F.get(ordered, i - 1)["gram"]) | (x["gram"] == F.get(ordered, i + 1)["gram"]), x["at"]
                ),
            )
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        def covered(at: Column) -> Column:
            own = F.transform(at, lambda x, i: F.least(F.lit(k), F.coalesce(F.get(at, i + 1) - x, F.lit(k))))
            return F.aggregate(own, F.lit(0), lambda a, b: a + b)

        return let(let(F.sort_array(grams), twice), covered)

    # equal windows have equal hashes: without two equal hashes nothing is repeated
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(last < 1, F.lit(0)).otherwise(F.when(some, exact()).otherwise(F.lit(0))).cast("long")


def statistics(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of a whole text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(NOT_SPACE))
    by_words = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    by_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    symbols = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOLS)).cast("long")
    return F.struct(by_words.alias("w"), by_lines.alias("l"), symbols.alias("n_symbols"))


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row, the statistics, base_failed, the vector x0..x3, and lang and source as cell keys."""
    stats = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.coalesce("lang", F.lit("\0")).alias("cell_lang"),
        F.coalesce("source", F.lit("\0")).alias("cell_source"),
        statistics(F.col("text")).alias("s"),
    ).select("row", "cell_lang", "cell_source", "s.w.*", "s.l.*", "s.n_symbols")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    vector = [
        F.log(chars / words),
        F.log1p(1000 * F.col("n_symbols") / chars) / 2,
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.sqrt(F.col("n_repeat_words") / words),
    ]
    return stats.withColumn("base_failed", failed).withColumns({f"x{i}": F.round(v * GRID) / GRID for i, v in enumerate(vector)})


# ---------------------------------------------------------------------------- the estimate

SIZE = len(LEAST_SPREAD)
PAIRS = [(i, j) for i in range(SIZE) for j in range(i + 1)]


def chi_square(p: float, freedom: int) -> float:
    """Quantile for an even number of degrees of freedom."""
    tail = lambda x: math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - p else (low, mid)
    return low


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest `share` that of all, for normal vectors."""
    q = chi_square(share, SIZE)
    inner = 1 - math.exp(-q / 2) * sum((q / 2) ** k / math.factorial(k) for k in range(SIZE // 2 + 1))
    return share / inner


def factored(moments: DataFrame, scale: float) -> DataFrame:
    """mean and covariance columns -> m0.., Cholesky factor c00.., log determinant."""
    out = moments
    for i, j in PAIRS:  # row by row, each from the columns before it
        value = F.col(f"v{i}{j}") * scale + (LEAST_SPREAD[i] ** 2 if i == j else 0.0)
        for k in range(j):
            value = value - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
        value = F.sqrt(F.greatest(value, F.lit(1e-12))) if i == j else value / F.col(f"c{j}{j}")
        out = out.withColumn(f"c{i}{j}", value)
    log_det = sum((F.log(F.col(f"c{i}{i}")) for i in range(SIZE)), F.lit(0.0))
    return out.select("cell", *[f"m{i}" for i in range(SIZE)], *[f"c{i}{j}" for i, j in PAIRS], (2 * log_det).alias("log_det"))


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. under c00.. by forward substitution."""
    solved: list[Column] = []
    for i in range(SIZE):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"c{i}{k}") * solved[k]
        solved.append(rest / F.col(f"c{i}{i}"))
    return sum((z * z for z in solved), F.lit(0.0))


def moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance by cell."""
    return rows.groupBy("cell").agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(SIZE)],
        *[F.covar_pop(f"x{i}", f"x{j}").alias(f"v{i}{j}") for i, j in PAIRS],
    )


def start(rows: DataFrame) -> DataFrame:
    """Medians and median absolute deviations: a robust first centre and a diagonal spread."""
    centre = stored(rows.groupBy("cell").agg(*[F.expr(f"percentile(x{i}, 0.5)").alias(f"m{i}") for i in range(SIZE)]), "mcd")
    spread = rows.join(centre, "cell").groupBy("cell").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(SIZE)],
        *[F.expr(f"percentile(round(abs(x{i} - m{i}) * {GRID}) / {GRID}, 0.5)").alias(f"d{i}") for i in range(SIZE)],
    )
    flat = spread.withColumns({f"v{i}{j}": F.pow(1.4826 * F.col(f"d{i}"), F.lit(2)) if i == j else F.lit(0.0) for i, j in PAIRS})
    return factored(flat, 1.0)


def estimates(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """The MCD centre and factor of each cell; rows: cell, x0.. (a stored table)."""
    now = stored(start(rows), "mcd")
    scale = consistency(share)
    for _ in range(MAX_STEPS):
        near = rows.join(now, "cell").withColumn("d", F.round(F.log1p(distance()) * GRID) / GRID)
        # stored, so that the planner knows it is a row per cell and leaves the documents where they are
        limit = stored(near.groupBy("cell").agg(F.expr(f"percentile(d, {share})").alias("limit")), "mcd")
        kept = near.select("cell", "d", *[f"x{i}" for i in range(SIZE)]).join(limit, "cell").where("d <= limit")
        after = stored(factored(moments(kept), scale), "mcd")
        change = after.join(now.select("cell", F.col("log_det").alias("was")), "cell").agg(F.max(F.abs(F.col("log_det") - F.col("was"))))
        now, moved = after, change.first()[0]
        if moved is None or moved < TOLERANCE:
            break
    return now


def judged(docs: DataFrame, keep: list[str], tail: float = CUTOFF_TAIL, min_rows: int = MIN_ROWS) -> DataFrame:
    """row, the statistics, base_failed, distance (null without an estimate) and kept."""
    table = stored(measured(docs, keep), "quality")
    sound = table.where("not base_failed").select("cell_lang", "cell_source", *[f"x{i}" for i in range(SIZE)])
    levels = [("cell_lang", "cell_source"), ("cell_lang",), ()]
    name = lambda cols: F.concat_ws("\1", F.lit(str(len(cols))), *cols)
    # each level's estimate is over all its documents; a cell takes the finest that has enough
    counts = sound.groupBy("cell_lang", "cell_source").count()
    of = counts.select(
        "cell_lang",
        "cell_source",
        F.col("count").alias("n2"),
        F.sum("count").over(_all("cell_lang")).alias("n1"),
    )
    total = counts.agg(F.sum("count")).first()[0] or 0
    coarse = name(levels[2]) if total >= min_rows else F.lit(None).cast("string")
    cells = of.select(
        "cell_lang",
        "cell_source",
        F.when(F.col("n2") >= min_rows, name(levels[0])).when(F.col("n1") >= min_rows, name(levels[1])).otherwise(coarse).alias("cell"),
    )
    cells = stored(cells, "cells")
    used = stored(cells.select("cell").distinct(), "cells")
    rows = None
    for cols in levels:
        part = sound.withColumn("cell", name(cols)).join(used, "cell", "left_semi").select("cell", *[f"x{i}" for i in range(SIZE)])
        rows = part if rows is None else rows.unionByName(part)
    fitted = estimates(rows)
    by_cell = stored(cells.join(fitted, "cell", "left").drop("cell", "log_det"), "cells")
    out = table.join(by_cell, ["cell_lang", "cell_source"], "left").withColumn("distance", distance())
    far = F.coalesce(F.col("distance") > chi_square(1 - tail, SIZE), F.lit(False))
    return out.select(
        "row", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )


def _all(*cols):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def passed(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    return judged(docs, docs.columns).where("kept").select("row.*")
