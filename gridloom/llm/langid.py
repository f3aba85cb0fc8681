"""Hierarchical language identification: the family first, then linear SVMs between its languages.

A text is a vector of hashed byte n-grams (1 to 4 bytes, `DIM` places for each length, square roots of
shares, unit length), taken over the whole text. Languages are grouped into families by the likeness
of their mean vectors (average linkage, down to about the square root of their number). One linear
model per family separates it from the others; inside a family a linear SVM (squared hinge) stands
between each two languages, and the language with most votes wins, margins breaking ties.

Fitting uses at most `per_language` documents of each language, those with the smallest hash of their
doc_id; that bound is a parameter. Vectors are made and models fitted on Spark, one group per model;
the driver holds mean vectors and finished models only (their size depends on the number of languages,
not of documents). Every document is then predicted in one pass without a shuffle.

Defined results: a null text or one without a letter is `und` with score 0; without any labelled
document everything is `und`; documents with a null doc_id are never held out and never learned from;
repeated rows are predicted alike; lang, source and doc_id are not inputs of a prediction.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import hashing as H
from gridloom.llm.batches import over_texts, packed
from gridloom.sources.workspace import stored

DIM, GRAMS, PER_LANGUAGE = 2048, (1, 2, 3, 4), 500
WIDTH = DIM * len(GRAMS)
UNKNOWN = "und"
PENALTY, ROUNDS = 1e-3, 300
SHARPNESS = 4.0
#: White space, digits and punctuation of ASCII count as one space; A-Z as a-z.
FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
ASCII_LETTER = re.compile("[A-Za-z]")


def vectors(texts: pa.Array) -> np.ndarray:
    """One unit vector per text (zero for an empty text)."""
    data, borders = packed(texts)
    n = len(texts)
    out = np.zeros((n, WIDTH), np.float32)
    data = FOLD[data]
    of = np.repeat(np.arange(n), np.diff(borders))
    code = np.zeros(len(data), np.uint64)
    for g, size in enumerate(GRAMS):
        code = code[: len(data) - size + 1] * np.uint64(257) + data[size - 1 :] + np.uint64(1) if len(data) >= size else code[:0]
        inside = of[: len(code)] == of[size - 1 :] if len(code) else np.zeros(0, bool)
        place = (H.mixed(code) >> np.uint64(64 - 11)).astype(np.int64)
        counts = np.bincount((of[: len(code)] * DIM + place)[inside], minlength=n * DIM).reshape(n, DIM)
        out[:, g * DIM : (g + 1) * DIM] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
    return out / np.float32(len(GRAMS) ** 0.5)


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 5


def sample(docs: DataFrame, per_language: int) -> DataFrame:
    """lang, text of at most `per_language` documents a language that may be learned from.

    Ids are chosen first, from those with small draws; texts are fetched for the chosen ones only, so no text is
    shuffled but theirs. Repeated rows count once.
    """
    key = [F.col("lang"), F.col("doc_id"), F.xxhash64("text").alias("text_key")]
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder() != 0))
    counts = stored(usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")  # a row per language
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    likely = usable.select(*key, draw.alias("draw")).join(counts, "lang").where(F.col("draw") * F.col("n") < F.lit(2.0 * per_language * (1 << 30)))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text_key")
    chosen = likely.select("lang", "doc_id", "text_key", "draw").distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_language)
    names = ["lang", "doc_id", "text_key"]
    chosen = stored(chosen.select(*names), "chosen")  # per_language rows a language at most
    return usable.select(*key, "text").join(chosen, names).dropDuplicates(names).select("lang", "text")


def families(names: list[str], means: np.ndarray) -> list[list[str]]:
    """Average linkage of the mean vectors down to about sqrt(n) groups."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    like = unit @ unit.T
    groups = [[i] for i in range(len(names))]
    while len(groups) > max(1, int(np.ceil(len(names) ** 0.5))):
        pairs = [(like[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs, key=lambda x: (x[0], -x[1], -x[2]))
        groups[i] += groups.pop(j)
    return sorted(sorted(names[i] for i in g) for g in groups)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and intercept of a balanced linear SVM with squared hinge, by accelerated gradient steps."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = ahead = np.zeros(x.shape[1])
    step = 1 / (2 * 2.0 + PENALTY)
    for k in range(ROUNDS):
        short = np.maximum(0, 1 - y * (x @ ahead))
        gradient = PENALTY * ahead - 2 * (x.T @ (weight * y * short))
        after = ahead - step * gradient
        ahead = after + k / (k + 3) * (after - w)
        w = after
    return w


def fitted(docs: DataFrame, per_language: int = PER_LANGUAGE) -> dict:
    """The families, and a weight vector per family and per pair of languages in one family."""

    def made(texts: pa.Array) -> list:
        return [pa.array([v.tobytes() for v in vectors(texts)], pa.binary())]

    rows = stored(over_texts(sample(docs, per_language), made, "vector binary", ["lang"]).select("row.lang", "vector"), "language_sample")

    def mean(table: pa.Table) -> pa.Table:
        own = np.stack([np.frombuffer(v, np.float32) for v in table.column("vector").to_pylist()]).mean(0)
        return pa.table({"lang": table.column("lang").slice(0, 1), "vector": pa.array([own.astype(np.float32).tobytes()], pa.binary())})

    means = sorted(rows.groupBy("lang").applyInArrow(mean, "lang string, vector binary").collect(), key=lambda r: r["lang"])
    if not means:
        return {"families": [], "models": {}}
    names = [r["lang"] for r in means]
    groups = families(names, np.stack([np.frombuffer(r["vector"], np.float32) for r in means]))
    problems = [(f"family:{k}", lang, 1 if lang in g else -1) for k, g in enumerate(groups) for lang in names if len(groups) > 1]
    problems += [
        (f"pair:{a}:{b}", lang, 1 if lang == a else -1) for g in groups for i, a in enumerate(g) for b in g[i + 1 :] for lang in (a, b)
    ]

    def train(table: pa.Table) -> pa.Table:
        x = np.stack([np.frombuffer(v, np.float32) for v in table.column("vector").to_pylist()])
        w = fit(x, table.column("side").to_numpy().astype(float))
        return pa.table({"problem": table.column("problem").slice(0, 1), "weights": pa.array([w.astype("<f4").tobytes()], pa.binary())})

    models = {}
    if problems:
        asked = docs.sparkSession.createDataFrame(problems, "problem string, lang string, side int")
        found = rows.join(F.broadcast(asked), "lang").groupBy("problem").applyInArrow(train, "problem string, weights binary")
        models = {r["problem"]: np.frombuffer(r["weights"], "<f4") for r in found.collect()}
    return {"families": groups, "models": models}


def decided(x: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    """Language and score of each vector."""
    groups, models = model["families"], model["models"]
    margin = lambda name: x @ models[name][:-1] + models[name][-1]
    likely = lambda m: 1 / (1 + np.exp(-SHARPNESS * np.clip(m, -20, 20)))
    n = len(x)
    sure = np.stack([likely(margin(f"family:{k}")) for k in range(len(groups))], 1) if len(groups) > 1 else np.ones((n, 1))
    family = sure.argmax(1)
    share = sure[np.arange(n), family] / np.maximum(sure.sum(1), 1e-12)
    names, scores = [""] * n, np.zeros(n)
    for k, group in enumerate(groups):
        at = np.flatnonzero(family == k)
        if not len(at):
            continue
        votes, total = np.zeros((len(at), len(group))), np.zeros((len(at), len(group)))
        for i, a in enumerate(group):
            for j in range(i + 1, len(group)):
                m = margin(f"pair:{a}:{group[j]}")[at]
                votes[:, i] += m >= 0
                votes[:, j] += m < 0
                total[:, i] += likely(m)
                total[:, j] += 1 - likely(m)
        best = (votes + total / (len(group) + 1)).argmax(1)
        inside = total[np.arange(len(at)), best] / max(1, len(group) - 1) if len(group) > 1 else np.ones(len(at))
        scores[at] = share[at] * inside
        for p, b in zip(at, best, strict=True):
            names[p] = group[b]
    return names, np.clip(scores, 0, 1)


def predict(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Per document: row, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(texts: pa.Array) -> list:
        names, scores = decided(vectors(texts), shared.value) if shared.value["families"] else ([UNKNOWN] * len(texts), np.zeros(len(texts)))
        known = [has_letter(t) for t in texts.to_pylist()]
        return [
            pa.array([x if k else UNKNOWN for x, k in zip(names, known, strict=True)], pa.string()),
            pa.array(np.where(known, scores, 0.0), pa.float64()),
        ]

    return over_texts(docs, found, "lang_pred string, score double", keep)


def identify(docs: DataFrame, keep: list[str], per_language: int = PER_LANGUAGE) -> DataFrame:
    return predict(docs, fitted(docs, per_language), keep)
