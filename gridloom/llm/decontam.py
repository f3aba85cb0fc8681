"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are runs of digits, letters and non-ASCII characters, lower-cased in A-Z. Every window of
`window` consecutive words of an item is a pattern; an item with fewer words, but not none, is one
pattern. A document is scanned once; hits are mapped to word numbers and to offsets in the
original text.

Defined results: a null or empty text has no words, no hits and is never contaminated; items
without words or without text have no pattern; repeated items count once by their item_id, items
whose id is null are matched but never counted or named; repeated documents are scanned each for
itself; an empty item table leaves every document clean. Columns of the input are nested in `row`.

The automaton is broadcast, so the items go in blocks of at most `block_bytes` of text: each block
is one pass over the documents, and what the blocks found is merged per document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.batches import over_texts, raw

#: Bytes that are part of a word: digits, letters (lower-cased) and whatever is not ASCII. Others become spaces.
TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
BLOCK_BYTES = 8 << 20


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    """The item's patterns, with a space at both ends so that they meet whole words only."""
    if not words:
        return []
    if len(words) <= window:
        return [b" " + b" ".join(words) + b" "]
    return [b" " + b" ".join(words[i : i + window]) + b" " for i in range(len(words) - window + 1)]


def automaton(items: list[tuple[str | None, bytes]], window: int):
    """Patterns -> (number of words, items that have them)."""
    import ahocorasick

    owners: dict[bytes, set] = {}
    for item, text in items:
        for pattern in windows_of(words_of(text), window):
            owners.setdefault(pattern, set()).add(item)
    found = ahocorasick.Automaton()
    for pattern, who in owners.items():
        found.add_word(pattern.decode("latin-1"), (len(pattern), tuple(who)))
    if len(found):
        found.make_automaton()
    return found


_BUILT: dict = {}


def built(block, window: int):
    """The automaton of a broadcast block, once per Python worker."""
    if _BUILT.get("key") != (block.value["id"], window):
        _BUILT.update(key=(block.value["id"], window), automaton=automaton(block.value["items"], window))
    return _BUILT["automaton"]


def original_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words' starts and ends."""
    inside = np.frombuffer(text.translate(TABLE), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hits_of(text: bytes, automaton) -> tuple[int, list[list[int]], set]:
    """Number of words, hit runs as [first word, end word, first byte, end byte), and the items met."""
    words = text.translate(TABLE).split()
    if not words or not len(automaton):
        return len(words), [], set()
    line = b" " + b" ".join(words) + b" "
    runs, items = [], set()
    for end, (size, who) in automaton.iter(line.decode("latin-1")):
        items.update(who)
        runs.append((end - size + 1, end))
    if not runs:
        return len(words), [], items
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    starts, ends = original_words(text)
    merged: list[list[int]] = []
    for first, last in sorted(zip(np.searchsorted(spaces, [a for a, _ in runs]), np.searchsorted(spaces, [b for _, b in runs]), strict=True)):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], int(last))
        else:
            merged.append([int(first), int(last)])
    return len(words), [[a, b, int(starts[a]), int(ends[b - 1])] for a, b in merged], items


def item_blocks(items: DataFrame, block_bytes: int) -> list[list[tuple[str | None, bytes]]]:
    """The items in blocks of bounded size; a block is what is broadcast at a time."""
    items = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= block_bytes:
        return [[(r["item"], r["text"].encode()) for r in items.collect()]]
    number = -(-total // (block_bytes // 2))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(number)))
    return [[(r["item"], r["text"].encode()) for r in dealt.where(F.col("block") == b).collect()] for b in range(number)]


FIELDS = "n_words long, runs array<array<long>>, items array<string>"


def scan(docs: DataFrame, items: DataFrame, keep: list[str], window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: row, n_words, runs (word and byte offsets of the hit passages), items (ids met, sorted)."""
    spark = docs.sparkSession
    passes = []
    for number, block in enumerate(item_blocks(items, block_bytes)):
        shared = spark.sparkContext.broadcast({"id": (number, hashlib.sha256(repr(block).encode()).hexdigest()), "items": block})

        def found(texts: pa.Array, shared=shared) -> list:
            known = built(shared, window)
            rows = [hits_of(t, known) for t in raw(texts)]
            return [
                pa.array([n for n, _, _ in rows], pa.int64()),
                pa.array([r for _, r, _ in rows], pa.list_(pa.list_(pa.int64()))),
                pa.array([sorted(x for x in i if x is not None) for _, _, i in rows], pa.list_(pa.string())),
            ]

        passes.append((shared, found))
    if len(passes) == 1:
        return over_texts(docs, passes[0][1], FIELDS, keep)
    # several blocks: each adds what it found to the row, so no document is shuffled
    out = over_texts(docs, passes[0][1], FIELDS, sorted({*keep, "text"}))
    for _, found in passes[1:]:
        more = over_texts(
            out.select(F.struct("row", "n_words", "runs", "items").alias("had"), F.col("row.text").alias("text")), found, FIELDS, ["had"]
        )
        out = more.select(
            F.col("row.had.row").alias("row"),
            "n_words",
            F.concat("row.had.runs", "runs").alias("runs"),
            F.array_sort(F.array_union("row.had.items", "items")).alias("items"),
        )
    return out.select(F.struct(*[F.col(f"row.`{c}`") for c in keep]).alias("row"), "n_words", merged_runs(F.col("runs")).alias("runs"), "items")


def merged_runs(runs):
    """Overlapping runs of several passes as one."""

    def add(done, run):
        last = F.element_at(done, -1)
        joined = F.array(last[0], F.greatest(last[1], run[1]), last[2], F.greatest(last[3], run[3]))
        return F.when((F.size(done) > 0) & (run[0] <= last[1]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(run))
        )

    one = F.transform(F.slice(F.array_sort(runs), 1, 1), lambda x: x)
    return F.when(F.size(runs) < 2, runs).otherwise(
        F.aggregate(F.slice(F.array_sort(runs), 2, F.greatest(F.size(runs) - 1, F.lit(0))), one, add)
    )


def verdict(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (a twentieth of the words or more are hit)."""
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return (
        found.withColumn("n_hit", n_hit)
        .withColumn("n_items", F.size("items").cast("long"))
        .withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    )


def clean(docs: DataFrame, items: DataFrame, window: int = 13) -> DataFrame:
    """The documents that are not contaminated, with their columns."""
    return verdict(scan(docs, items, docs.columns, window)).where("not contaminated").select("row.*")
