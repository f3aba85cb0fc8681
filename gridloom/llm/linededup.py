"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without the white space at its ends, in lower case for A-Z. A run holds
(key hash, number of documents), sorted by hash in files that each cover a range of hashes, so that
a merge join reads only the files it needs. Each batch of documents adds one run to level 0; as soon
as `fan_in` runs stand on a level they are merged, hash by hash, into one on the next level, so that
a key sits in about log(batches) runs. `unseen` merge-anti-joins a batch with all runs (incremental
dedup: only lines never seen before stay); `common` sums the runs' counts and gives the keys found
in at least `min_docs` documents, whose lines are then dropped everywhere.

Keys are 128-bit hashes of the bytes of the key. Counts are of documents: a row is a document, and a
key counts once per row. Counting combines on the map side, so a line in a third of all documents
costs a row per task. A document meets its dropped keys by doc_id and a hash of its text.

Defined results: a null or empty text is one empty line; empty keys (shorter than `min_chars`) are
never dropped; repeated rows are separate documents; an empty table gives no row. Input columns are
nested in `row`, so extra columns don't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from gridloom.llm.batches import lists, over_texts, raw
from gridloom.sources.workspace import stored

ENDS = b"\x20\x09\x0a\x0b\x0c\x0d"
BATCHES = 4


def key_of(line: bytes) -> bytes:
    return line.strip(ENDS).lower()


def hashes_of(text: bytes, min_chars: int) -> list[bytes | None]:
    """A hash per line; none for lines that are never dropped."""
    keys = (key_of(line) for line in text.split(b"\n"))
    return [xxh3_128_digest(k) if k and (min_chars <= 1 or len(k.decode()) >= min_chars) else None for k in keys]


def document_key():
    """What a document is met by: its doc_id and its text, both null-safe; equal ones have equal lines."""
    return [F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")]


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """Per document: id_key, text_key and its distinct line hashes."""

    def found(texts: pa.Array) -> list:
        own = [list({h for h in hashes_of(t, min_chars) if h}) for t in raw(texts)]
        return [lists([h for hs in own for h in hs], np.fromiter(map(len, own), np.int64, len(own)), pa.binary())]

    source = docs.select(*document_key(), F.col("text").alias("text"))
    return over_texts(source, found, "hashes array<binary>", ["id_key", "text_key"]).select("row.*", "hashes")


class Runs:
    """Levels of sorted runs (key binary, n_docs long); equal-sized runs merge into the next level."""

    def __init__(self, spark: SparkSession, fan_in: int = 2):
        self.spark, self.fan_in, self.levels = spark, fan_in, []

    def _write(self, rows: DataFrame) -> DataFrame:
        counted = rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
        return stored(counted.repartitionByRange("key").sortWithinPartitions("key"), "run")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, hashes: DataFrame) -> None:
        """Adds a batch (a `hashes` array per document) as a run and compacts."""
        run = self._write(hashes.select(F.explode("hashes").alias("key"), F.lit(1).cast("long").alias("n_docs")))
        at = 0
        while True:
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(run)
            if len(self.levels[at]) < self.fan_in:
                return
            merged = self.levels[at][0]
            for other in self.levels[at][1:]:
                merged = merged.unionByName(other)
            run, self.levels[at] = self._write(merged), []
            at += 1

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The batch's keys that no run has."""
        fresh = hashes.select(F.explode("hashes").alias("key")).distinct()
        for run in self.runs():
            fresh = fresh.join(run.select("key"), "key", "left_anti")
        return fresh

    def common(self, min_docs: int) -> DataFrame:
        """Keys found in at least `min_docs` documents, over all runs."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "key binary")
        all_rows = runs[0]
        for run in runs[1:]:
            all_rows = all_rows.unionByName(run)
        if len(runs) > 1:
            all_rows = all_rows.groupBy("key").agg(F.sum("n_docs").alias("n_docs"))
        return all_rows.where(F.col("n_docs") >= min_docs).select("key")


def dedup(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, fan_in: int = 2, keep: list[str] | None = None
) -> DataFrame:
    """Per document: row (columns in `keep`), new_text, n_lines, n_dropped."""
    met = documents_and_dropped(docs, min_docs, min_chars, batches, fan_in, keep or docs.columns)
    return without(met, min_chars).select(F.col("row.row").alias("row"), "new_text", "n_lines", "n_dropped")


def documents_and_dropped(docs: DataFrame, min_docs: int, min_chars: int, batches: int, fan_in: int, keep: list[str]) -> DataFrame:
    """Per document: row (row, there: text is not null, dropped: hashes of its common lines) and, unless `keep` has it, text."""
    hashed = stored(line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("id_key", "text_key"), F.lit(batches))), "lines")
    runs = Runs(docs.sparkSession, fan_in)
    for batch in range(batches):
        runs.add(hashed.where(F.col("batch") == batch))
    common = stored(runs.common(min_docs), "common")
    dropped = (
        hashed.select("id_key", "text_key", F.explode("hashes").alias("key"))
        .join(common, "key")
        .groupBy("id_key", "text_key")
        .agg(F.collect_set("key").alias("dropped"))
    )
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    text = [] if "text" in keep else ["text"]  # once, inside `row` or beside it
    rows = docs.select(*document_key(), row, F.col("text").isNotNull().alias("there"), *text)
    return rows.join(dropped, ["id_key", "text_key"], "left").select(F.struct("row", "there", "dropped").alias("row"), *text)


def without(met: DataFrame, min_chars: int) -> DataFrame:
    """Drops the lines whose hash is in row.dropped."""
    from pyspark.sql import types as T

    fields = "new_text string, n_lines long, n_dropped long"
    schema = T.StructType([met.schema["row"], *T._parse_datatype_string(fields).fields])

    def run(cols):
        for batch in cols:
            rows = batch.column(0)
            texts = batch.column(1) if batch.num_columns > 1 else rows.field("row").field("text")
            gone = rows.field("dropped")
            out = []
            for text, drop in zip(raw(texts), gone.to_pylist(), strict=True):
                lines = text.split(b"\n")
                if drop:
                    drop = set(drop)
                    left = [line for line, h in zip(lines, hashes_of(text, min_chars), strict=True) if h not in drop]
                    out.append((b"\n".join(left).decode(), len(lines), len(lines) - len(left)))
                else:
                    out.append((text.decode(), len(lines), 0))
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())],
                names=schema.names,
            )

    return met.mapInArrow(run, schema)


def cleaned(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents with the common lines dropped from their texts; the other columns stay.

    A null text stays null; where `n_chars` is a column it follows the new text.
    """
    keep = [c for c in docs.columns if c != "text"]
    done = without(documents_and_dropped(docs, min_docs, min_chars, BATCHES, 2, keep), min_chars)
    there = F.col("row.there")
    new = {"text": F.when(there, F.col("new_text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(there, F.char_length("new_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.row.n_chars"))
    return done.select(*[new.get(c, F.col(f"row.row.`{c}`")).alias(c) for c in docs.columns])
