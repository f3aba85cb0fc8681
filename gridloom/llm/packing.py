"""Sequence packing by non-negative least squares over a length histogram.

A document is its token ids and an end id. It is cut into whole windows, a part whose length is a
multiple of `unit`, and a tail shorter than `unit`; every id lies in one piece. The lengths of all
pieces are counted into a histogram with fewer than window / unit + unit entries, whatever the
corpus. Over the multiples of `unit`, all combinations of at most `depth` lengths that fill a window
exactly are enumerated; non-negative least squares finds how often to repeat each so that the
histogram is used up. Counts are rounded down, and what is left (with the tails) is packed greedily,
longest first, as repeated patterns of lengths. The plan is a small table of rank ranges per length.

On Spark, pieces get their rank within their length in two levels (inside a bucket of about the
square root of all pieces, and over buckets), so no length, however common, is one task; a piece's
rank then names its sequence and offset.

Defined results: a null or empty text is the end id alone; repeated rows and repeated or null
doc_ids are separate documents (order among equal keys is by file position only through the stored
table, so ids stay unique); an empty table gives no piece. The last sequences may need padding.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.batches import rows_from_texts
from gridloom.sources.workspace import stored

WINDOW, UNIT, DEPTH, END_ID = 2048, 32, 4, 1
MEMO_PARTS, MEMO_WORDS = 200_000, 400_000

# ---------------------------------------------------------------------------- tokens

_LOADED: dict = {}
#: Control characters that Python's split() takes for white space and the tokenizer doesn't.
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: Letters of Latin-1 and then ASCII marks (no apostrophe): two words to the tokenizer, whatever stands beside them.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    The tokenizer splits at white space before anything else, so the ids of a text are those of its
    white-space-free parts, one after another. Parts and plain words seen before are looked up; a new
    plain word goes to the tokenizer's model, any other new part through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = re.compile("|".join(map(re.escape, (t.content for t in self.tokenizer.get_added_tokens_decoder().values()))) or r"(?!)")
        self.letters = byte_letters()
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.coded = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def spelt(self, word: str) -> bytes:
        """Ids of a plain word in lower case, or of a run of marks, from the tokenizer's model."""
        word = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([self.coded[t.id] for t in self.model.tokenize(word)])

    def learn(self, new: list[str]) -> dict[str, bytes]:
        out, rest, words, marks = {}, [], self.words, self.marks
        for part in new:
            found = PLAIN.fullmatch(part)
            if not found:
                rest.append(part)
                continue
            word, end = found.groups()
            word = word.lower()
            ids = words.get(word)
            if ids is None:
                ids = words[word] = self.spelt(word)
            if end:
                tail = marks.get(end)
                if tail is None:
                    tail = marks[end] = self.spelt(end)
                ids += tail
            out[part] = ids
        return out | dict(zip(rest, self.whole(rest), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [bool(ODD_SPACE.search(t) or self.specials.search(t)) for t in texts]
        parts = [[] if o else t.split() for t, o in zip(texts, odd, strict=True)]
        now = set().union(*parts)
        if len(self.words) > MEMO_WORDS:
            self.words = {}
        if len(self.marks) > MEMO_PARTS:
            self.marks = {}
        if len(self.parts) > MEMO_PARTS:  # keep memory bounded: only this batch's parts stay
            self.parts = {p: self.parts[p] for p in now if p in self.parts}
        self.parts.update(self.learn([p for p in now if p not in self.parts]))
        memo = self.parts
        rest = iter(self.whole([t for t, o in zip(texts, odd, strict=True) if o]))
        return [next(rest) if o else b"".join(map(memo.__getitem__, ps)) for ps, o in zip(parts, odd, strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


def cuts(total: int, window: int = WINDOW, unit: int = UNIT) -> list[int]:
    """Lengths of a document's pieces, in order."""
    whole, rest = divmod(total, window)
    return [window] * whole + [x for x in (rest - rest % unit, rest % unit) if x]


def pieces(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batch: pa.RecordBatch, texts: pa.Array) -> list:
        coded = encoder(path).encode([t or "" for t in texts.to_pylist()])
        counts, start, length, crc, total = [], [], [], [], []
        for ids in coded:
            ids += end
            n = len(ids) // 4
            sizes = cuts(n, window, unit)
            at = 0
            for size in sizes:
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
                at += size
            counts.append(len(sizes))
            total += [n] * len(sizes)
        rows = np.repeat(np.arange(len(coded)), counts)
        kind = pa.int64()
        return [batch.column(0).take(pa.array(rows)), *(pa.array(x, kind) for x in (start, length, crc, total))]

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows_from_texts(docs, cut, schema, ["doc_id"])


# ---------------------------------------------------------------------------- plan


def combinations(units: int, depth: int) -> list[tuple[int, ...]]:
    """All ways to fill `units` with at most `depth` positive parts, in falling order."""

    def fill(left: int, most: int, deep: int):
        if left == 0:
            yield ()
        elif deep:
            for part in range(min(left, most), -(-left // deep) - 1, -1):
                for rest in fill(left - part, part, deep - 1):
                    yield (part, *rest)

    return list(fill(units, units, depth))


def least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """min |a x - b| with x >= 0, by active sets: columns enter by gradient and leave at zero."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(10 * a.shape[1]):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * scale:
            break
        used[best] = True
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if s.min() > 0:
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            used[at[(x[at] <= 1e-12 * scale) & low]] = False
            x[~used] = 0
            if not used.any():
                break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns as ([(length, how many of it)], repeats); each piece of the histogram is used once."""
    left = Counter({k: v for k, v in histogram.items() if v})
    out: list[tuple[list[tuple[int, int]], int]] = []
    coarse = [k for k in left if k % unit == 0]
    if coarse:
        shapes = [c for c in combinations(window // unit, depth) if all(p * unit in left for p in c)]
        rows = {k // unit: i for i, k in enumerate(sorted(coarse))}
        a = np.zeros((len(rows), len(shapes)))
        for j, shape in enumerate(shapes):
            for part in shape:
                a[rows[part], j] += 1
        if shapes:
            solved = least_squares(a, np.array([left[k] for k in sorted(coarse)], float))
            for j in np.argsort(-solved, kind="stable"):
                need = Counter(p * unit for p in shapes[j])
                times = min(int(solved[j] + 1e-6), *(left[k] // n for k, n in need.items()))
                if times > 0:
                    out.append((sorted(need.items(), reverse=True), times))
                    left.subtract({k: n * times for k, n in need.items()})
    while left := +left:
        room, taken = window, []
        for length in sorted(left, reverse=True):
            if many := min(left[length], room // length):
                taken.append((length, many))
                room -= many * length
        times = min(left[k] // n for k, n in taken)
        out.append((taken, times))
        left.subtract({k: n * times for k, n in taken})
    return out


def plan_rows(patterns: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, how many per sequence, first sequence, first offset) per slot."""
    rows, used = [], Counter()
    first_sequence = 0
    for parts, times in patterns:
        offset = 0
        for length, many in parts:
            rows.append((length, used[length], used[length] + many * times, many, first_sequence, offset))
            used[length] += many * times
            offset += many * length
        first_sequence += times
    return rows


# ---------------------------------------------------------------------------- placing


def place(cut: DataFrame, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """Adds sequence_id and offset to the pieces (a stored table: it is read several times)."""
    spark = cut.sparkSession
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # < window / unit + unit rows
    total = sum(histogram.values())
    buckets = max(1, int(total**0.5))
    names = ["slot_length", "low", "high", "many", "first_sequence", "first_offset"]
    planned = np.array(plan_rows(plan(histogram, window, unit, depth)) or [(0, 0, 0, 1, 0, 0)], np.int64)
    slots = spark.createDataFrame(pa.table(list(planned.T), names=names))  # from Arrow: rows of Python would start workers to read them
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    over = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy("length", "bucket")
        .count()
        .select("length", "bucket", F.coalesce(F.sum("count").over(over), F.lit(0)).alias("before"))
    )
    ranked = (
        dealt.withColumn("inner_rank", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inner_rank"))
    )
    step = F.col("rank") - F.col("low")
    return ranked.join(
        F.broadcast(slots),  # at most a few slots per length and pattern, whatever the corpus
        (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")),
    ).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.floor(step / F.col("many"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + F.pmod(step, F.col("many")) * F.col("length")).alias("offset"),
    )


def pack(docs: DataFrame, path: str, window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH) -> DataFrame:
    """All documents as pieces in sequences of at most `window` tokens."""
    return place(stored(pieces(docs, path, window, unit), "pieces"), window, unit, depth)
