"""Exact substring dedup with a logarithmic family of sparse suffix indexes.

A byte goes if it is covered by a string of `length` bytes that starts at another place too, in any
document or the same one. A full suffix array needs eight bytes per byte of text; here suffixes are
sampled so that no match is missed: of all windows of `length // 2` bytes inside a string of `length`
bytes, those with the least hash are its anchors. Equal strings have equal anchors at equal places.

* Index. Per batch of documents, the anchors' suffixes, ordered by the hash of their first half
  string, are written as a level (hash, occurrences). A new batch is merge-scanned against the levels:
  hashes it shares with one, or has twice itself, are where long matches may be. Levels of equal size
  merge into one of the next size, so that there are about log(batches) of them.
* Matches. Only around such anchors is text compared: an anchor's context reaches as far as strings
  through it can (`length` bytes from it to either side). Contexts are folded when equal, dealt by
  anchor hash, and every string through the anchor, cut out of its context, is compared with those of
  the other contexts of the same anchor (by 64-bit hashes over both sides, joined with the anchor's).
  The strings found twice or more, all occurrences counted, give back byte ranges per document.
* Anchors with more than `hot` occurrences (a passage in a third of all documents) don't go to one
  task: each of their strings becomes a row, and equal rows are counted over the cluster.

Text is shuffled once, to meet its anchors' positions, and a second time, to meet its ranges, only where
those are too many to be broadcast. Strings are judged on the input, not on what is left.

Defined results: a null or empty text has no bytes and loses none; texts shorter than `length` stay;
repeated rows are each other's copies; matches never cross documents; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import hashing as H
from gridloom.llm.batches import lists, over_texts, packed, raw, rows_from_texts
from gridloom.sources.workspace import discard, stored

LENGTH, BATCHES, HOT = 400, 4, 20_000
CHUNK_ROWS = 4096
BROADCAST_SPANS = 1_000_000  # documents with removals and their ranges, or places of hot anchors, some 40 MB


def document_key(docs: DataFrame, *more: str) -> DataFrame:
    """id_key and text_key: equal for rows with equal doc_id and text, whose results are equal."""
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(0)).cast("long").alias("id_key"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.col("text").alias("text"),
        *more,
    )


# ---------------------------------------------------------------------------- anchors


def anchors(data: np.ndarray, borders: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors in the packed bytes, and their hashes."""
    half = length // 2
    reach = length - half + 1  # half strings inside one string
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    own = H.rolling(data, half)
    least = H.sliding(own, reach, np.minimum)
    of = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    least[of[: len(least)] != of[length - 1 : length - 1 + len(least)]] = 0  # strings across two documents
    edge = np.zeros(reach - 1, np.uint64)
    best = H.sliding(np.concatenate((edge, least, edge)), reach, np.maximum)
    at = np.flatnonzero((best == own) & (best > 0))
    return at, own[at]


def indexed(docs: DataFrame, length: int, batches: int) -> DataFrame:
    """id_key, text_key, at (positions), hashes, batch."""

    def found(texts: pa.Array) -> list:
        data, borders = packed(texts)
        at, hashes = anchors(data, borders, length)
        of = np.searchsorted(borders, at, side="right") - 1
        counts = np.bincount(of, minlength=len(texts))
        return [lists(at - borders[of], counts, pa.int32()), lists(hashes.view(np.int64), counts, pa.int64())]

    out = over_texts(document_key(docs), found, "at array<int>, hashes array<long>", ["id_key", "text_key"])
    return out.select("row.*", "at", "hashes").withColumn("batch", F.pmod(F.xxhash64("id_key", "text_key"), F.lit(batches)))


class Levels:
    """Sorted levels (hash, n) that merge when they are of equal size."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []  # (size in batches, table), large first

    def _written(self, rows: DataFrame) -> DataFrame:
        return stored(rows.groupBy("hash").agg(F.sum("n").alias("n")).sortWithinPartitions("hash"), "level")

    def written(self, batch: DataFrame) -> DataFrame:
        """A batch of suffixes (hash) as a level of its own."""
        return self._written(batch.select("hash", F.lit(1).cast("long").alias("n")))

    def scan(self, own: DataFrame) -> DataFrame:
        """Hashes of a written batch that a level has, or that it has twice itself."""
        shared = own.where("n > 1").select("hash")
        for _, level in self.levels:
            shared = shared.unionByName(own.select("hash").join(level.select("hash"), "hash", "left_semi"))
        return shared

    def add(self, own: DataFrame) -> None:
        """Adds a written batch as a level and merges equal sizes; what a merge has read is deleted."""
        size, table = 1, own
        while self.levels and self.levels[-1][0] <= size:
            below_size, below = self.levels.pop()
            both = self._written(below.unionByName(table))
            discard(below)
            discard(table)
            size, table = size + below_size, both
        self.levels.append((size, table))

    def counts(self) -> DataFrame:
        rows = self.levels[0][1]
        for _, level in self.levels[1:]:
            rows = rows.unionByName(level)
        return rows.groupBy("hash").agg(F.sum("n").alias("n")) if len(self.levels) > 1 else rows


def repeated_anchors(index: DataFrame, batches: int) -> DataFrame:
    """hash, n: anchors that stand at two places or more (stored)."""
    levels = Levels(index.sparkSession)
    hits = []
    for batch in range(batches):
        own = levels.written(index.where(F.col("batch") == batch).select(F.explode("hashes").alias("hash")))
        hits.append(stored(levels.scan(own), "matches"))
        levels.add(own)
    shared = hits[0]
    for more in hits[1:]:
        shared = shared.unionByName(more)
    repeated = stored(levels.counts().join(shared.distinct(), "hash", "left_semi"), "repeated")
    for table in [*hits, *(level for _, level in levels.levels)]:
        discard(table)
    return repeated


# ---------------------------------------------------------------------------- contexts


def contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """A row per anchor place: id_key, text_key, at, hash, context; n, left and right only where it is the slice's first of its kind."""
    half = length // 2
    reach = length - half

    def found(batch: pa.RecordBatch, texts: pa.Array) -> list:
        data, borders = packed(texts)
        where = batch.column(batch.schema.get_field_index("places"))
        counts = np.array([len(x) for x in where.to_pylist()], np.int64)
        of = np.repeat(np.arange(len(texts)), counts)
        at = where.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        p = borders[:-1][of] + at
        low, high = np.maximum(p - reach, borders[:-1][of]), np.minimum(p + length, borders[1:][of])
        sums = H.prefix_sums(data)
        hashes = H.rolling(data, half)[p] if len(p) else np.zeros(0, np.uint64)
        key = H.mixed(H.spans(sums, low, high) * np.uint64(3) + (p - low).astype(np.uint64))
        _, first, inverse, n = np.unique(np.stack((hashes, key)), axis=1, return_index=True, return_inverse=True, return_counts=True) if len(p) else (0, [], [], [])
        shown = np.full(len(p), -1)
        shown[first] = n
        blob = data.tobytes()
        is_first = shown > 0
        left = [blob[a:b] if f else None for a, b, f in zip(low, p, is_first, strict=True)]
        right = [blob[a:b] if f else None for a, b, f in zip(p + half, high, is_first, strict=True)]
        take = pa.array(of)
        return [
            batch.column(0).take(take),
            batch.column(1).take(take),
            pa.array(at, pa.int32()),
            pa.array(hashes.view(np.int64)),
            pa.array(key.view(np.int64)),
            pa.array(np.maximum(shown, 0), pa.int64()),
            pa.array(left, pa.binary()),
            pa.array(right, pa.binary()),
        ]

    wanted = document_key(docs).join(places, ["id_key", "text_key"])
    schema = "id_key long, text_key long, at int, hash long, context long, n long, left binary, right binary"
    return rows_from_texts(wanted, found, schema, ["id_key", "text_key", "places"])


def side_hashes(sides: list[bytes], reach: int, reverse: bool, salt: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the first 0..reach bytes outward from the anchor, and the length of each side."""
    sizes = np.array([len(x) for x in sides], np.int64)
    grid = np.zeros((len(sides), reach), np.uint8)
    flat = np.frombuffer(b"".join(x[::-1] if reverse else x for x in sides), np.uint8)
    grid[np.arange(reach)[None, :] < sizes[:, None]] = flat
    up, _ = H.powers(reach)
    out = np.zeros((len(sides), reach + 1), np.uint64)
    np.cumsum(H.BYTE[grid] * up[:reach] * salt, axis=1, out=out[:, 1:])
    return out, sizes


def string_keys(hashes: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the strings that start o = 0..reach bytes before the anchor (contexts x o), and which of them exist."""
    reach = length - length // 2
    a, before = side_hashes(left, reach, True, np.uint64(0x9FB21C651E98DF25))
    b, after = side_hashes(right, reach, False, np.uint64(0xD1B54A32D192ED03))
    o = np.arange(reach + 1)
    exists = (o[None, :] <= before[:, None]) & (reach - o[None, :] <= after[:, None])
    keys = H.mixed(H.mixed(a) * np.uint64(5) + H.mixed(b[:, ::-1]) + H.mixed(hashes[:, None] ^ o.astype(np.uint64)[None, :]))
    return keys, exists


def repeated_strings(hashes, left, right, n, length: int) -> np.ndarray:
    """Which strings (contexts x o) stand at two places or more among these contexts."""
    keys, exists = string_keys(hashes, left, right, length)
    places = np.flatnonzero(exists)
    flat = keys.ravel()[places]
    order = np.argsort(flat)
    flat, weight = flat[order], np.repeat(n, exists.sum(1))[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    begins = np.flatnonzero(new)
    total = np.add.reduceat(weight, begins) if len(begins) else weight
    out = np.zeros(keys.size, bool)
    out[places[order]] = np.repeat(total, np.diff(np.append(begins, len(flat)))) > 1
    return out.reshape(keys.shape)


def runs_of(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of marked o per context as pairs (first, last) laid end to end, and the number of values per context."""
    edge = np.diff(np.pad(marked.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return np.stack((first, last - 1), 1).ravel(), 2 * np.bincount(rows, minlength=len(marked))


def compared(found: DataFrame, length: int) -> DataFrame:
    """hash, context, runs of o; contexts of one anchor hash are compared together."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        hashes = rows.column("hash").to_numpy().view(np.uint64)
        context = rows.column("context").to_numpy()
        n = rows.column("n").to_numpy()
        _, first, inverse = np.unique(np.stack((hashes.view(np.int64), context)), axis=1, return_index=True, return_inverse=True)
        counts = np.bincount(inverse.ravel(), weights=n, minlength=len(first)).astype(np.int64)
        only = rows.take(pa.array(first))
        marked = repeated_strings(hashes[first], only.column("left").to_pylist(), only.column("right").to_pylist(), counts, length)
        values, sizes = runs_of(marked)
        out = [only.column("hash").combine_chunks(), only.column("context").combine_chunks(), lists(values, sizes, pa.int32())]
        return pa.RecordBatch.from_arrays(out, names=["hash", "context", "runs"])

    def run(batches):
        waiting, count = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            count += batch.num_rows
            if count < CHUNK_ROWS:
                continue
            table = pa.Table.from_batches(waiting)
            hashes = table.column("hash").to_numpy()
            last = int(np.searchsorted(hashes, hashes[-1]))  # the last anchor may go on in the next batch
            for begin, end in pieces(hashes[:last]):
                yield settle(table.slice(begin, end - begin))
            rest = table.slice(last)
            waiting, count = rest.to_batches(), rest.num_rows
        if count:
            table = pa.Table.from_batches(waiting)
            for begin, end in pieces(table.column("hash").to_numpy()):
                yield settle(table.slice(begin, end - begin))

    def pieces(hashes):
        """Cuts of about CHUNK_ROWS rows that don't divide an anchor."""
        begin = 0
        while begin < len(hashes):
            end = min(len(hashes), begin + CHUNK_ROWS)
            if end < len(hashes):
                end = max(int(np.searchsorted(hashes, hashes[end])), int(np.searchsorted(hashes, hashes[begin], side="right")))
            yield begin, end
            begin = end

    firsts = found.where("n > 0").select("hash", "context", "n", "left", "right")
    together = firsts.repartition("hash").sortWithinPartitions("hash")
    return together.mapInArrow(run, "hash long, context long, runs array<int>").where(F.size("runs") > 0)


def strings_of(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Every string through the places' anchors as a row: id_key, text_key, start, string (two hashes)."""

    def found(batch: pa.RecordBatch, texts: pa.Array) -> list:
        data, borders = packed(texts)
        where = batch.column(batch.schema.get_field_index("places"))
        counts = np.array([len(x) for x in where.to_pylist()], np.int64)
        of = np.repeat(np.arange(len(texts)), counts)
        p = where.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        reach = length - length // 2
        start = p[:, None] - np.arange(reach + 1)[None, :]
        size = np.diff(borders)[of]
        fits = (start >= 0) & (start + length <= size[:, None])
        of = np.broadcast_to(of[:, None], start.shape)[fits]
        start = start[fits]
        both = np.unique(np.stack((of, start)), axis=1)
        of, start = both[0], both[1]
        begin = borders[:-1][of] + start
        one = H.spans(H.prefix_sums(data), begin, begin + length)
        two = H.spans(H.prefix_sums(data[::-1].copy()), len(data) - begin - length, len(data) - begin)
        take = pa.array(of)
        return [batch.column(0).take(take), batch.column(1).take(take), pa.array(start, pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]

    wanted = document_key(docs).join(places, ["id_key", "text_key"])
    return rows_from_texts(wanted, found, "id_key long, text_key long, start int, one long, two long", ["id_key", "text_key", "places"])


# ---------------------------------------------------------------------------- the operator


def merged(spans: list[list[int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(map(tuple, spans or [])):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def spans_of(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """id_key, text_key, spans: maximal byte ranges [start, end) covered by repeated strings, of the documents that have any (stored)."""
    index = stored(indexed(docs, length, batches), "index")
    repeated = repeated_anchors(index, batches)
    place = index.select("id_key", "text_key", F.explode(F.arrays_zip("at", "hashes")).alias("x"))
    met = place.select("id_key", "text_key", F.col("x.at").alias("at"), F.col("x.hashes").alias("hash")).join(repeated, "hash")
    by_document = stored(
        met.groupBy("id_key", "text_key", (F.col("n") > hot).alias("hot")).agg(F.array_sort(F.collect_set("at")).alias("places")), "places"
    )
    discard(index)
    discard(repeated)
    usual = by_document.where("not hot").select("id_key", "text_key", "places")
    common = stored(by_document.where("hot").select("id_key", "text_key", "places"), "hot_places")  # its own size decides how it meets texts
    found = stored(contexts(docs, usual, length), "contexts")
    runs = stored(compared(found, length), "runs")
    o = F.explode(F.expr("transform(sequence(0, size(runs) - 2, 2), i -> struct(runs[i] as low, runs[i + 1] as high))"))
    met = found.select("id_key", "text_key", "at", "hash", "context").join(runs, ["hash", "context"])
    used = [by_document, common, found, runs]
    spans = met.select("id_key", "text_key", "at", o.alias("o")).select(
        "id_key", "text_key", F.array((F.col("at") - F.col("o.high")), (F.col("at") - F.col("o.low") + length)).alias("span")
    )
    n_common = common.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
    if n_common:
        few = F.broadcast(common) if n_common <= BROADCAST_SPANS else common
        strings = stored(strings_of(docs, few, length), "strings")
        twice = strings.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("one", "two")
        twice = stored(twice, "twice")
        used += [strings, twice]
        again = strings.join(twice, ["one", "two"])
        spans = spans.unionByName(again.select("id_key", "text_key", F.array("start", F.col("start") + length).alias("span")))
    collected = spans.groupBy("id_key", "text_key").agg(F.collect_set("span").alias("spans"))

    def joined(batches):
        for batch in batches:
            runs = [[list(x) for x in merged(own)] for own in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(runs, pa.list_(pa.list_(pa.int64())))], names=["id_key", "text_key", "spans"])

    out = stored(collected.mapInArrow(joined, "id_key long, text_key long, spans array<array<long>>"), "spans")
    for table in used:  # nothing but the ranges is needed any more
        discard(table)
    return out


def dedup(docs: DataFrame, keep: list[str], length: int = LENGTH, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """Per document: row, n_bytes, removed (maximal runs as [start, end)), kept (the bytes left)."""
    spans = spans_of(docs, length, batches, hot)
    size = spans.agg(F.count(F.lit(1)) + F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if size <= BROADCAST_SPANS else spans
    keyed = document_key(docs, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")).join(spans, ["id_key", "text_key"], "left")

    def cut(batch: pa.RecordBatch, texts: pa.Array) -> list:
        sizes, removed, kept = [], [], []
        for text, own in zip(raw(texts), batch.column(1).to_pylist(), strict=True):
            gone = own or []
            at, left = 0, []
            for a, b in gone:
                left.append(text[at:a])
                at = b
            left.append(text[at:])
            sizes.append(len(text))
            removed.append(gone)
            kept.append(b"".join(left))
        return [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())]

    row = keyed.schema["row"].dataType.simpleString()
    return rows_from_texts(keyed, cut, f"row {row}, n_bytes long, removed array<array<long>>, kept binary", ["row", "spans"])
