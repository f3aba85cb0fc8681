"""Toxicity by a subsequence string kernel: a support vector machine on Nyström landmarks.

Two chunks of text are alike by the subsequences of `ORDER` characters that they share, each weighted by
`DECAY` per character it skips (at most `SPAN` characters from first to last), so that an insult with
characters put between its letters is still like the plain one. A chunk is what stands between white space,
in lower case, without punctuation at its ends, with a mark before and after it; three or more single letters in a row
are one chunk as well ("i d i o t", "i.d.i.o.t"), and long chunks are cut into overlapping pieces that miss no subsequence. A sentence is as toxic as
the worst of its chunks, a text as the worst of its sentences.

Fitting. Labels say which documents are toxic, not which of their sentences; so sentences of clean documents are
labelled clean, and of each toxic document the sentence that holds its worst chunk, and those with a chunk beyond
doubt, are labelled toxic. The worst is at first the chunk that most sets toxic documents apart, then the one with the
greatest margin, and the clean chunks with the greatest margins join the examples (`ROUNDS` times). Landmarks are the chunks that most set
toxic documents apart and a spread of clean ones; examples are mapped by the kernel to them and the
inverse root of the landmarks' own kernel matrix, and a linear SVM is fitted there. Copies of the toxic examples with
inserted characters are examples too. A fifth of the documents isn't fitted on and turns margins into a
probability. Near copies (equal least hash of their chunks) count once.

The fit uses at most `PER_LABEL` labelled documents per label, those with the least hash of their doc_id (a documented
bound on what one task and the driver hold); the model is two arrays. Since the margin is linear in the
kernel, the landmarks' weights add up to one weight per subsequence, and every document is scored in one
pass over its whole text without a shuffle; a task keeps the margins of chunks it has met, up to a bound.

Defined results: a null or empty text has the score of a text without any likeness; without labels of both kinds the
score is 0; a null doc_id is never held out and never learned from; a null label is no label, and a document
with both labels is an example of both; repeated rows score alike; lang, source and doc_id are no inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import over_texts
from gridloom.llm.hashing import mixed
from gridloom.llm.langid import fit as linear_svm

ORDER, SPAN, DECAY = 3, 6, 0.7
PIECE = 24
PER_LABEL, ROUNDS = 2500, 4
TOXIC_MARKS, CLEAN_MARKS = 256, 128
SURE, FIRM = 5.0, 0.3  # chunks with so many deviations, and so much of the greatest, are examples beyond doubt
KNOWN = 1_000_000  # chunks a task remembers
BEGIN, END = "\x02", "\x03"
SINGLES = re.compile(r"(?<![^\W_])[^\W_](?:[\W_]+[^\W_]){2,}(?![^\W_])")  # one letter after another, anything else between
NO_LETTER = re.compile(r"[\W_]+")
EDGE = ".,;:!?\"'()[]{}<>*-_"
#: character distances of a subsequence's later characters from its first
STEPS = [c for c in combinations(range(1, SPAN), ORDER - 1)]
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
LIMIT = 20  # of the table that tells most subsequences without weight, in bits


def chunks(text: str | None) -> set[str]:
    """The distinct chunks of a text."""
    low = (text or "").lower()
    found = set(low.split())
    for run in SINGLES.findall(low):
        found.add(NO_LETTER.sub("", run))
    return found


def pieces(chunk: str) -> list[str]:
    """The chunk with its marks, cut so that every span of SPAN characters is whole in some piece."""
    whole = BEGIN + chunk.strip(EDGE) + END
    if len(whole) <= PIECE:
        return [whole]
    step = PIECE - SPAN + 1
    return [whole[i : i + PIECE] for i in range(0, len(whole) - SPAN + 1, step)]


def flat(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points laid end to end, the string each belongs to, and how many of the string follow each."""
    data = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    of = np.repeat(np.arange(len(strings)), sizes)
    after = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data)) - 1
    return data, of, after


def scale(sizes: np.ndarray) -> np.ndarray:
    """What a string of this length is divided by: the length of its vector, were all its subsequences different."""
    table = np.zeros(PIECE + 1)
    for n in range(PIECE + 1):
        table[n] = sum(max(0, n - c[-1]) * DECAY ** (2 * (c[-1] - ORDER + 1)) for c in STEPS)
    return np.sqrt(np.maximum(table, 1.0))[sizes]


def subsequences(strings: list[str]):
    """Yields per distance pattern: string number, hash and weight of each subsequence."""
    data, of, after = flat(strings)
    for step in STEPS:
        n = len(data) - step[-1]
        if n <= 0:
            continue
        at = np.flatnonzero(after[:n] >= step[-1])
        code = data[at] * FACTORS[0]
        for k, s in enumerate(step):
            code += data[at + s] * FACTORS[k + 1]
        yield of[at], mixed(code), DECAY ** (step[-1] - ORDER + 1)


class Landmarks:
    """Kernel of any string with the landmarks."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        parts = [(h, of, np.full(len(h), w)) for of, h, w in subsequences(strings)]
        h, of, w = (np.concatenate([p[i] for p in parts]) for i in range(3)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0))
        w = w / scale(np.fromiter(map(len, strings), np.int64, len(strings)))[of] if len(w) else w
        order = np.lexsort((of, h))
        self.hash, self.of, self.weight = h[order], of[order], w[order]
        self.keys, self.first, self.count = np.unique(self.hash, return_index=True, return_counts=True)

    def kernel(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), len(self.strings)))
        for of, h, w in subsequences(strings):
            at = np.searchsorted(self.keys, h)
            hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == h) if len(self.keys) else []
            if not len(hit):
                continue
            at, own = at[hit], of[hit]
            n = self.count[at]
            start = np.cumsum(n) - n
            place = np.repeat(self.first[at] - start, n) + np.arange(n.sum())
            np.add.at(out, (np.repeat(own, n), self.of[place]), w * self.weight[place])
        return out / scale(np.fromiter(map(len, strings), np.int64, len(strings)))[:, None]

    def summed(self, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight per subsequence of a combination of landmarks."""
        return self.keys, np.add.reduceat(self.weight * coefficients[self.of], self.first) if len(self.first) else np.zeros(0)


class Margins:
    """Margins of chunks under a fitted model."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.flag = np.zeros(1 << LIMIT, bool)
        self.flag[keys >> np.uint64(64 - LIMIT)] = True

    def of_pieces(self, strings: list[str]) -> np.ndarray:
        total = np.zeros(len(strings))
        if len(self.keys):
            for of, h, w in subsequences(strings):
                may = np.flatnonzero(self.flag[h >> np.uint64(64 - LIMIT)])
                at = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
                own = np.where(self.keys[at] == h[may], self.weights[at], 0.0)
                total += w * np.bincount(of[may], weights=own, minlength=len(strings))
        return total / scale(np.fromiter(map(len, strings), np.int64, len(strings))) + self.bias

    def of_chunks(self, some: list[str], block: int = 20_000) -> np.ndarray:
        """The greatest margin among a chunk's pieces."""
        out = np.full(len(some), self.bias)
        strings, of = [], []

        def settle():
            if strings:
                np.maximum.at(out, np.array(of), self.of_pieces(strings))

        for i, chunk in enumerate(some):
            for p in pieces(chunk):
                strings.append(p)
                of.append(i)
                if len(strings) >= block:
                    settle()
                    strings, of = [], []
        settle()
        return out


# ---------------------------------------------------------------------------- fitting


def disguised(chunk: str) -> list[str]:
    """The chunk with one character put in, and with one between all letters."""
    if len(chunk) < ORDER or len(chunk) > PIECE // 2:
        return []
    seed = zlib.crc32(chunk.encode("utf-8", "surrogatepass"))
    sign = ".*-_x"[seed % 5]
    at = 1 + seed // 5 % (len(chunk) - 1)
    return [chunk[:at] + sign + chunk[at:], sign.join(chunk)]


def grams(chunk: str) -> set[str]:
    whole = pieces(chunk)[0]
    return {whole[i : i + ORDER] for i in range(max(1, len(whole) - ORDER + 1))}


def apart(toxic: list[list[str]], clean: list[list[str]]) -> dict[str, tuple[float, float]]:
    """How much a chunk sets toxic documents apart: the share of documents with it among toxic ones against that among
    clean ones, in deviations; and the mean of this and the same for the most telling of its runs of ORDER characters."""
    of = {w: grams(w) for d in (*toxic, *clean) for w in d}
    every = []
    for unit in (lambda d: d, lambda d: set().union(*(of[w] for w in d)) if d else ()):
        in_toxic, in_clean = Counter(u for d in toxic for u in unit(d)), Counter(u for d in clean for u in unit(d))
        told = {}
        for u, n in in_toxic.items():
            p, q = n / len(toxic), in_clean.get(u, 0) / len(clean)
            pooled = (n + in_clean.get(u, 0) + 0.5) / (len(toxic) + len(clean))
            told[u] = (p - q) / np.sqrt(pooled * (1 / len(toxic) + 1 / len(clean)))
        every.append(told)
    whole, part = every
    return {w: (n, 0.5 * n + 0.5 * max(part[g] for g in of[w])) for w, n in whole.items()}


def valued(margins: Margins, documents: list[list[str]]) -> dict[str, float]:
    """The margin of every chunk."""
    every = sorted(set().union(*documents)) if documents else []
    return dict(zip(every, margins.of_chunks(every).tolist(), strict=True))


def worst(value: dict[str, float], document: list[str]) -> str:
    return max(document, key=lambda w: (value[w], w))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn margins into probabilities (targets drawn in as Platt does; Newton steps)."""
    pos, neg = weight[y > 0].sum(), weight[y < 0].sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    w = np.array([1.0, 0.0])
    ridge = np.array([1e-3, 1e-6])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - t)) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        w = w - np.clip(np.linalg.solve(bend, gradient), -2, 2)
    return max(float(w[0]), 1e-3), float(w[1])


def trained(rows: list[tuple[int, list[str], float]]) -> tuple[np.ndarray, np.ndarray, float, float, float] | None:
    """keys, weights, bias, slope, intercept from (label, chunks, weight of the label)."""
    seen, kept = set(), []
    for label, own, weight in sorted(rows, key=lambda r: (r[0], sorted(r[1])[:3], len(r[1]))):
        least = min((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in own), default=-1)
        if (label, least) not in seen:
            seen.add((label, least))
            kept.append((label, sorted(own), weight, zlib.crc32(str(least).encode()) % 5 == 0))
    fitted_on = [r for r in kept if not r[3]]
    toxic, clean = ([r[1] for r in fitted_on if r[0] == side] for side in (1, 0))
    if not any(toxic) or not any(clean):
        return None
    toxic, clean = [d for d in toxic if d], [d for d in clean if d]
    in_clean = Counter(w for d in clean for w in d)
    measured = apart(toxic, clean)
    told = {w: z for w, (_, z) in measured.items()}
    marks = sorted(told, key=lambda w: (-told[w], w))[:TOXIC_MARKS]
    others = sorted((w for w in in_clean if w not in set(marks)), key=lambda w: (-in_clean[w], w))
    spread = sorted(others, key=lambda w: zlib.crc32(w.encode("utf-8", "surrogatepass")))[: CLEAN_MARKS // 2]
    strings = sorted({pieces(w)[0] for w in marks + others[: CLEAN_MARKS // 2] + spread})
    landmarks = Landmarks(strings)
    gram = landmarks.kernel(strings)
    size, axes = np.linalg.eigh((gram + gram.T) / 2)
    use = size > 1e-4 * max(size.max(), 1e-9)
    root = axes[:, use] / np.sqrt(size[use])

    def mapped(some: list[str]) -> np.ndarray:
        return landmarks.kernel([pieces(w)[0] for w in some]) @ root

    firm = max(SURE, FIRM * max(z for z, _ in measured.values()))
    firm = {w for w, (z, _) in measured.items() if z >= firm}
    shown = {max(d, key=lambda w: (told[w], w)) for d in toxic} | firm
    hard = set(others[: 8 * CLEAN_MARKS]) | {d[len(d) // 2] for d in clean}
    margins = None
    for _ in range(ROUNDS):
        examples = sorted(shown) + sorted({v for w in shown for v in disguised(w)})
        against = sorted(hard - set(examples))
        y = np.concatenate([np.ones(len(examples)), -np.ones(len(against))])
        w = linear_svm(mapped(examples + against), y)
        margins = Margins(*landmarks.summed(root @ w[:-1]), float(w[-1]))
        value = valued(margins, toxic)
        shown = {worst(value, d) for d in toxic} | firm
        value = valued(margins, clean)
        hard |= {worst(value, d) for d in clean}
    held = [r for r in kept if r[3]]
    held = held if {r[0] for r in held} == {0, 1} else kept
    value = valued(margins, [r[1] for r in held])
    m = np.array([value[worst(value, r[1])] if r[1] else margins.bias for r in held])
    slope, intercept = platt(m, np.array([1.0 if r[0] else -1.0 for r in held]), np.array([r[2] for r in held]))
    return margins.keys, margins.weights, margins.bias, slope, intercept


# ---------------------------------------------------------------------------- on Spark


def remainder():
    return F.crc32(F.col("doc_id").cast("string")) % 4


def sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """toxic, text of at most `per_label` labelled documents per label; ids are chosen first, texts fetched for those only."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder() != 2).select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    chosen = usable.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).unionByName(
        usable.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    )
    weight = F.when(F.col("toxic") == 1, F.lit(counts.get(1, 0) / min(per_label, max(1, counts.get(1, 0))))).otherwise(
        F.lit(counts.get(0, 0) / min(per_label, max(1, counts.get(0, 0))))
    )
    small = F.broadcast(chosen.withColumn("weight", weight))  # 2 x per_label rows of ids at most
    return docs.select("doc_id", "text").join(small, "doc_id").dropDuplicates(["doc_id", "toxic"]).select("toxic", "weight", "text")


def fitted(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple | None:
    """The model, fitted in one task on the bounded sample; None without labels of both kinds."""

    def cut(texts: pa.Array) -> list:
        return [pa.array([sorted(chunks(t)) for t in texts.to_pylist()], pa.list_(pa.string()))]

    rows = over_texts(sample(docs, labels, per_label), cut, "chunks array<string>", ["toxic", "weight"])

    def train(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_pylist() for c in ("toxic", "chunks", "weight")]
        done = trained(list(zip(*columns, strict=True)))
        names = ["keys", "weights", "numbers"]
        if done is None:
            return pa.table([pa.array([], pa.binary())] * 2 + [pa.array([], pa.list_(pa.float64()))], names=names)
        keys, weights, *numbers = done
        return pa.table([pa.array([keys.astype("<u8").tobytes()]), pa.array([weights.astype("<f8").tobytes()]), pa.array([numbers], pa.list_(pa.float64()))], names=names)

    told = rows.select("row.*", "chunks").groupBy(F.lit(0).alias("all")).applyInArrow(train, "keys binary, weights binary, numbers array<double>")
    found = told.collect()
    if not found:
        return None
    return np.frombuffer(found[0]["keys"], "<u8"), np.frombuffer(found[0]["weights"], "<f8"), *found[0]["numbers"]


def scored(docs: DataFrame, model: tuple | None, keep: list[str]) -> DataFrame:
    """Per document: row, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def found(texts: pa.Array) -> list:
        if shared.value is None:
            return [pa.array(np.zeros(len(texts)))]
        keys, weights, bias, slope, intercept = shared.value
        if not state:
            state.update(margins=Margins(keys, weights, bias), known={})
        known = state["known"]
        own = [chunks(t) for t in texts.to_pylist()]
        new = list(set().union(*own).difference(known))
        if len(known) + len(new) > KNOWN:
            known.clear()
            new = list(set().union(*own))
        known.update(zip(new, state["margins"].of_chunks(new).tolist(), strict=True))
        most = np.array([max(map(known.__getitem__, d), default=bias) for d in own])
        return [pa.array(1 / (1 + np.exp(-np.clip(slope * most + intercept, -30, 30))))]

    return over_texts(docs, found, "score double", keep)


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str], per_label: int = PER_LABEL) -> DataFrame:
    """Per document: row, score (0 to 1, higher is more toxic)."""
    return scored(docs, fitted(docs, labels, per_label), keep)
