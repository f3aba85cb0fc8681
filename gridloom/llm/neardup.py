"""MinHash near-dedup with an LSH forest.

Documents are sets of word shingles. Equal sets are folded into one class first, so copies cost one
row each. A class has `trees` signatures of `depth` minimum hashes. In each tree, classes with the
same first `depth` values form a region, and only regions with two classes or more go on. Inside a
region the classes are sorted by the tree's further values (the next trees' values serve as its
deeper levels), and neighbours in that order, those with the longest common prefix, become
candidates if all their minimum hashes together agree in at least `near` of the places. Regions with
more than `region_rows` classes (a passage or text that very many share) are sorted deeper, by all
values of the sketch, from each of TURNS, and in ranges: a range holds about `region_rows` classes, and where one
ends inside a region its last class meets the first of the next, so no neighbours are parted.

Candidates only say which documents are compared with each other: their connected components
(groups) are found by distributed star contraction, and each group is settled exactly on the full
shingle sets. In a group, the class that agrees most with the others is compared with all of them,
then every class not yet in the largest component is compared with all; links inside a component
can't change it, so no pair of its members is made. That finds the exact components of the group
while comparing (1 + classes outside the largest component) x group sets, of which only those that
share one of a set's rarest shingles are looked at (prefix filter, loses no link). Groups with more than
`group_rows` classes are dealt into blocks: each block is settled in itself, and the classes outside
the largest component are compared with all blocks, block by block.

Chance of missing a link at similarity s is (1 - s^depth)^trees for a lone pair (8e-7 at 0.85, 7e-5
at 0.8 with 24 x 5); in a group one link of many suffices. README has the chance in crowded regions.

Defined results: a text without words (or null) is in no group: its own class, zero shingles. Equal
doc_ids with different texts are different documents. component_id is the smallest non-null doc_id
of the component (null if it has none). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import hashing as H
from gridloom.llm.batches import lists, over_texts, packed
from gridloom.sources.workspace import discard, stored

TREES, DEPTH = 24, 5
REGION_ROWS, GROUP_ROWS, GROUP_SHINGLES = 2000, 4000, 4 << 20
BROADCAST_ROWS = 500_000
NEAR = 0.5
TURNS = [0, 29, 58, 87]  # a crowded region is sorted from so many places of the sketch

# ---------------------------------------------------------------------------- shingles

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
STEP = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # one per place in a shingle


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and their number per text."""
    data, borders = packed(texts)
    n = len(texts)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    data = LOWER[data]
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_at = borders[:-1][np.diff(borders) > 0]
    first[starts_at] = inside[starts_at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = borders[1:][np.diff(borders) > 0] - 1
    last[ends_at] = inside[ends_at]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    own = H.spans(H.prefix_sums(data), starts, ends)
    to = np.searchsorted(starts, borders)  # words of text i: to[i] .. to[i + 1]
    counts = np.diff(to)
    # windows of `words` words inside one text; shorter texts have all their words as one
    text_of = np.repeat(np.arange(n), counts)
    place = np.arange(len(own)) - to[:-1][text_of]
    full = place + words <= counts[text_of]
    at = np.flatnonzero(full)
    hashed = np.zeros(len(at), np.uint64)
    for k in range(words):
        hashed += own[at + k] * STEP[k]
    short = np.flatnonzero((counts > 0) & (counts < words))
    extra = np.array(
        [sum(int(own[to[i] + k]) * int(STEP[k]) for k in range(counts[i])) + int(counts[i]) & (1 << 64) - 1 for i in short], np.uint64
    ).reshape(-1)
    values = H.mixed(np.concatenate((hashed, extra)))
    of = np.concatenate((text_of[at], short))
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[new], of[new]
    return values, np.bincount(of, minlength=n)


def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(values: np.ndarray, counts: np.ndarray, number: int) -> np.ndarray:
    """Minimum hashes (32 bits) per text with shingles: rows x number."""
    filled = np.flatnonzero(counts)
    begins = (np.cumsum(counts) - counts)[filled]
    out = np.zeros((len(filled), number), np.uint32)
    if len(filled):
        for k, a in enumerate(multipliers(number)):
            out[:, k] = np.minimum.reduceat(((values ^ (a >> np.uint64(7))) * a) >> np.uint64(32), begins)
    return out


def class_keys(values: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A 128-bit key per distinct shingle set; none for an empty set."""
    filled = np.flatnonzero(counts)
    if not len(filled):
        return [None] * len(counts)
    begins = (np.cumsum(counts) - counts)[filled]
    a = H.mixed(np.add.reduceat(values, begins) + counts[filled].astype(np.uint64))
    b = H.mixed(np.add.reduceat(H.mixed(values ^ STEP[0]), begins))
    pairs = np.stack((a, b), 1).astype(">u8").tobytes()
    out: list[bytes | None] = [None] * len(counts)
    for i, k in enumerate(filled):
        out[k] = pairs[16 * i : 16 * i + 16]
    return out


def sketches(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """doc_id, text_key, n_shingles, class (null for an empty set), regions (a key per tree), sketch (a byte per value)."""

    def made(texts: pa.Array) -> list:
        values, counts = shingle_sets(texts, words)
        mins = minima(values, counts, trees * depth)
        keys = np.zeros((len(mins), trees), np.uint64)
        for t in range(trees):
            key = np.full(len(mins), t + 1, np.uint64)
            for d in range(depth):
                key = H.mixed(key * STEP[0] + mins[:, t * depth + d])
            keys[:, t] = key
        sketch = iter((mins & np.uint32(255)).astype(np.uint8))
        filled = counts > 0
        return [
            pa.array(counts, pa.int64()),
            pa.array(class_keys(values, counts), pa.binary()),
            lists(keys.view(np.int64).ravel(), np.where(filled, trees, 0), pa.int64()),
            pa.array([next(sketch).tobytes() if c else None for c in filled], pa.binary()),
        ]

    source = docs.select("doc_id", text_key(), "text")
    found = over_texts(source, made, "n_shingles long, class binary, regions array<long>, sketch binary", ["doc_id", "text_key"])
    return found.select("row.*", "n_shingles", "class", "regions", "sketch")


def text_key():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


# ---------------------------------------------------------------------------- candidates


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def sorted_neighbours(batches, near: float):
    """Close neighbours of one sorted range, and its first and last class (with their place) for the borders."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        region, place = batch.column(0).to_numpy(), 2 * batch.column(3)[0].as_py()
        keys = batch.column(1).to_pylist()
        sketch = np.stack([np.frombuffer(x, np.uint8) for x in batch.column(2).to_pylist()])
        if last is None:
            first = (keys[0], None, int(region[0]), place, sketch[0].tobytes())
        else:
            region, keys, sketch = np.append(last[0], region), [last[1], *keys], np.vstack((last[2], sketch))
        at = np.flatnonzero((region[1:] == region[:-1]) & (agreement(sketch[1:], sketch[:-1]) >= near))
        last = region[-1:], keys[-1], sketch[-1:]
        yield crowd_rows([(keys[i], keys[i + 1], None, None, None) for i in at])
    if last is not None:
        yield crowd_rows([first, (last[1], None, int(last[0][0]), place + 1, last[2].tobytes())])


def crowd_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"a": pa.binary(), "b": pa.binary(), "region": pa.int64(), "place": pa.int64(), "sketch": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def neighbours(classes: DataFrame, depth: int, region_rows: int, near: float) -> DataFrame:
    """Candidate pairs (a, b) of classes; classes: class, regions, sketch (one row per class, stored)."""
    spots = classes.select("class", F.posexplode("regions").alias("tree", "region"))
    sizes = spots.groupBy("region").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    met = stored(spots.join(sizes, "region"), "regions")

    def ordered(spots: DataFrame, levels, turn=F.lit(0)) -> DataFrame:
        # the deeper levels of a tree are the values after its own (and after the turn), going round
        start = F.pmod((F.col("tree") + 1) * depth + turn, F.length("sketch")) + 1
        deeper = F.substring(F.concat("sketch", "sketch"), start, levels)
        return spots.join(classes.select("class", "sketch"), "class").withColumn("deeper", deeper)

    order = Window.partitionBy("region").orderBy("deeper", "class")

    def before(table: DataFrame, window) -> DataFrame:
        lagged = table.select(
            "class", "sketch", F.lag("class").over(window).alias("other"), F.lag("sketch").over(window).alias("other_sketch")
        )
        return lagged.where("other is not null")

    def close(batches):
        for batch in batches:
            if batch.num_rows:
                a, b = (np.stack([np.frombuffer(x, np.uint8) for x in batch.column(i).to_pylist()]) for i in (1, 3))
                keep = pa.array(agreement(a, b) >= near)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(2).filter(keep)], names=["a", "b"])

    pairs = before(ordered(met.where(F.col("rows") <= region_rows), F.lit(12)), order).mapInArrow(close, "a binary, b binary")
    crowded = met.where(F.col("rows") > region_rows)
    n_crowded = crowded.count()
    if n_crowded:
        keys = ["region", "deeper", "class"]
        turned = crowded.withColumn("turn", F.explode(F.lit(TURNS))).withColumn("region", F.xxhash64("region", "turn"))
        ranges = ordered(turned, F.length("sketch"), F.col("turn")).select(*keys, "sketch")
        ranges = ranges.repartitionByRange(-(-n_crowded * len(TURNS) // region_rows), *keys)
        shape = "a binary, b binary, region long, place long, sketch binary"
        found = ranges.sortWithinPartitions(*keys).select("region", "class", "sketch", F.spark_partition_id().alias("range"))
        found = stored(found.mapInArrow(lambda batches: sorted_neighbours(batches, near), shape), "crowded")
        edges = found.where("place is not null").withColumnRenamed("a", "class")
        borders = before(edges, Window.partitionBy("region").orderBy("place")).mapInArrow(close, "a binary, b binary")
        pairs = pairs.unionByName(found.where("place is null").select("a", "b")).unionByName(borders)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# ---------------------------------------------------------------------------- components


def bounded(table: DataFrame, links: DataFrame) -> DataFrame:
    """A row per node, broadcast where the (stored) links are few; else shuffled, with hubs split by the planner."""
    return F.broadcast(table) if links.count() <= BROADCAST_ROWS else table


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """node, label (smallest node of its component) by alternating large-star and small-star steps."""
    now = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(bounded(least, now), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(bounded(lowest, now), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        after = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        # settled when every node has one link and no root is itself linked downwards
        open_nodes = after.select(F.col("v").alias("u")).distinct().join(after.select("u").distinct(), "u", "left_semi")
        many = after.groupBy("u").count().where("count > 1").select("u")
        discard(now)
        now = after
        if not open_nodes.unionByName(many).take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)


# ---------------------------------------------------------------------------- exact settling


class Sets:
    """Shingle sets of a block, end to end, with their minimum hashes' low bytes."""

    def __init__(self, sets: list[np.ndarray], sketch: np.ndarray):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.sketch = sketch
        self.percent = None

    def one(self, i: int) -> np.ndarray:
        return self.values[self.begins[i] : self.begins[i] + self.sizes[i]]

    def index(self, percent: int) -> None:
        """Post every set under its rarest shingles, as many as it may lack of a linked set, and one.

        Two linked sets share percent / 100 of the larger one, so the first shingle they share, in any
        fixed order, is among these of both: no link is lost. Rarest first (in this block) keeps a
        passage that all share out of the postings.
        """
        self.known, inverse, uses = np.unique(self.values, return_inverse=True, return_counts=True)
        self.rank = np.empty(len(self.known), np.int32)
        self.rank[np.argsort(uses, kind="stable")] = np.arange(len(self.known), dtype=np.int32)
        rank = self.rank[inverse]
        del inverse
        owner = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        rank = rank[np.lexsort((rank, owner))]
        posted = np.arange(len(rank)) - np.repeat(self.begins, self.sizes) < np.repeat(prefix(self.sizes, percent), self.sizes)
        rank, owner = rank[posted], owner[posted]
        order = np.argsort(rank, kind="stable")
        self.posted, self.owner, self.percent = rank[order], owner[order], percent

    def sharing(self, own: np.ndarray) -> np.ndarray:
        """Indexes of the sets posted under one of the rarest shingles of `own`."""
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        ranks = np.sort(self.rank[at[self.known[at] == own]])
        unseen = len(own) - len(ranks)  # the rarest of all: in no set of the block
        ranks = ranks[: max(int(prefix(len(own), self.percent)) - unseen, 0)]
        low, high = np.searchsorted(self.posted, ranks), np.searchsorted(self.posted, ranks, "right")
        found = np.zeros(len(self.sizes), bool)
        for i, j in zip(low, high, strict=True):
            found[self.owner[i:j]] = True
        return np.flatnonzero(found)

    def linked(self, own: np.ndarray, percent: int) -> np.ndarray:
        """Indexes of the sets whose similarity with `own` is percent / 100 or more, exactly."""
        may = self.sharing(own) if self.percent == percent else np.arange(len(self.sizes))
        small, large = np.minimum(self.sizes[may], len(own)), np.maximum(self.sizes[may], len(own))
        may = may[100 * small >= percent * large]
        if not len(may):
            return may
        sizes = self.sizes[may]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[may] - (ends - sizes), sizes) + np.arange(ends[-1])
        values = self.values[at]
        to = np.minimum(np.searchsorted(own, values), len(own) - 1)
        both = np.add.reduceat((own[to] == values).astype(np.int64), ends - sizes)
        return may[100 * both >= percent * (sizes + len(own) - both)]


def prefix(sizes, percent: int):
    """How many of a set's shingles, in a fixed order, hold the first that it shares with any linked set."""
    return sizes + (-percent * sizes) // 100 + 1


def found_root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def settle(block: Sets, percent: int) -> np.ndarray:
    """The component (its smallest index) of each set of the block."""
    n = len(block.sizes)
    parent = np.arange(n)

    def lead(i: int) -> None:
        for j in block.linked(block.one(i), percent):
            a, b = found_root(parent, i), found_root(parent, int(j))
            parent[max(a, b)] = min(a, b)

    def roots() -> np.ndarray:
        return np.array([found_root(parent, i) for i in range(n)])

    if n > 2:
        lead(medoid(block.sketch))
    label = roots()
    outside = np.flatnonzero(label != np.bincount(label).argmax()) if n > 1 else np.zeros(0, np.int64)
    if len(outside) > 2:
        block.index(percent)
    for i in outside:
        lead(int(i))
    return roots()


def medoid(sketch: np.ndarray) -> int:
    """The row that agrees most with the commonest value of each place."""
    common = np.array([np.bincount(column, minlength=256).argmax() for column in sketch.T], np.uint8)
    return int(agreement(sketch, common).argmax())


def sets_of(docs: DataFrame, members: DataFrame, words: int, number: int) -> DataFrame:
    """label, part, parts, class, set (binary), sketch (binary) of the classes in groups.

    members: doc_id and text_key of a document of the class, class, label, part, parts. Where they are
    few enough to be broadcast, no text is shuffled.
    """
    wanted = members.select(F.coalesce("doc_id", F.lit(0)).alias("id_key"), "text_key", "label", "part", "parts", "class")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    source = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id_key"), text_key(), "text").join(wanted, ["id_key", "text_key"])

    def made(texts: pa.Array) -> list:
        values, counts = shingle_sets(texts, words)
        sketch = iter((minima(values, counts, number) & np.uint32(255)).astype(np.uint8))
        ends = np.cumsum(counts)
        return [
            pa.array(class_keys(values, counts), pa.binary()),
            pa.array([values[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary()),
            pa.array([next(sketch).tobytes() if c else b"" for c in counts], pa.binary()),
        ]

    found = over_texts(source, made, "own binary, set binary, sketch binary", ["label", "part", "parts", "class"])
    return found.where("row.class = own").select("row.*", "set", "sketch")


def loaded(table: pa.Table) -> tuple[list[bytes], Sets]:
    keys = table.column("class").to_pylist()
    seen: dict[bytes, int] = {k: i for i, k in enumerate(keys)}  # repeated rows bring a class more than once
    if len(seen) < len(keys):
        table = table.take(pa.array(sorted(seen.values())))
        keys = table.column("class").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    sketch = np.stack([np.frombuffer(x, np.uint8) for x in table.column("sketch").to_pylist()])
    return keys, Sets(sets, sketch)


def links_in_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Inside each (label, part): class and the class that stands for its component."""

    def run(table: pa.Table) -> pa.Table:
        keys, block = loaded(table)
        label = settle(block, percent)
        return pa.table({"a": pa.array(keys, pa.binary()), "b": pa.array([keys[i] for i in label], pa.binary())})

    return sets.groupBy("label", "part").applyInArrow(run, "a binary, b binary")


def links_across(sets: DataFrame, outside: DataFrame, percent: int) -> DataFrame:
    """Links of the classes outside a group's largest component with the blocks of the group.

    Each outside block meets each block of its group once; one link per outside class and block's component suffices.
    """
    asking = sets.join(outside, "class", "left_semi").select(
        "label", F.col("part").alias("from_part"), "parts", "class", "set", "sketch", F.lit(True).alias("asks")
    )
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    there = sets.join(asking.select("label", "from_part").distinct(), "label").select(
        "label", "from_part", "parts", "class", "set", "sketch", F.lit(False).alias("asks"), "part"
    )

    def run(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        a, b = table.filter(asks), table.filter(pc.invert(asks))
        out_a, out_b = [], []
        if a.num_rows and b.num_rows:
            own, block = loaded(a)
            names, target = loaded(b)
            if len(own) > 2:
                target.index(percent)
            for i, key in enumerate(own):
                for j in target.linked(block.one(i), percent):
                    out_a.append(key)
                    out_b.append(names[j])
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    both = asking.select(there.columns).unionByName(there)
    return both.groupBy("label", "from_part", "part").applyInArrow(run, "a binary, b binary")


def settled(docs: DataFrame, members: DataFrame, words: int, number: int, percent: int, group_rows: int) -> DataFrame:
    """class, root for the classes in groups. members: label, class, doc_id, text_key, n_shingles (stored)."""
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / group_rows, F.sum("n_shingles") / GROUP_SHINGLES)).cast("long")
    sizes = members.groupBy("label").agg(parts.alias("parts"))
    dealt = members.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    small = sets_of(docs, dealt.where("parts = 1"), words, number)
    settled_small = links_in_blocks(small, percent)
    large = stored(dealt.where("parts > 1"), "large")
    if not large.take(1):
        return settled_small.select(F.col("a").alias("class"), F.col("b").alias("root"))
    # large groups: join the blocks' components through one leader per block, then ask for what is outside
    sets = stored(sets_of(docs, large, words, number), "sets")
    inner = stored(links_in_blocks(sets, percent), "inner")
    where = large.select("class", "label", "part").dropDuplicates(["class"])
    sizes = inner.groupBy(F.col("b").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("label", "part").orderBy(F.desc("n"), "class")
    leaders = where.join(sizes, "class").withColumn("nth", F.row_number().over(first)).where("nth = 1").select("class")
    joined = stored(inner.unionByName(links_across(sets, leaders, percent)), "joined")
    roots = components(joined).select(F.col("node").alias("class"), F.col("label").alias("root"))
    named = stored(where.join(roots, "class", "left").withColumn("root", F.coalesce("root", "class")), "named")
    most = Window.partitionBy("label").orderBy(F.desc("n"), "root")
    largest = named.groupBy("label", "root").agg(F.count(F.lit(1)).alias("n")).withColumn("nth", F.row_number().over(most)).where("nth = 1")
    outside = named.join(largest.select("root"), "root", "left_anti").select("class")
    final = components(joined.unionByName(links_across(sets, outside, percent)))
    of_large = where.select("class").join(final.select(F.col("node").alias("class"), F.col("label").alias("root")), "class", "left")
    return settled_small.select(F.col("a").alias("class"), F.col("b").alias("root")).unionByName(
        of_large.select("class", F.coalesce("root", "class").alias("root"))
    )


# ---------------------------------------------------------------------------- the operator


def near_duplicates(
    docs: DataFrame,
    words: int = 5,
    percent: int = 80,
    trees: int = TREES,
    depth: int = DEPTH,
    near: float = NEAR,
    region_rows: int = REGION_ROWS,
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """Per document: doc_id, text_key, n_shingles, component (a key), component_id, kept."""
    number = trees * depth
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    made = stored(sketches(docs, words, trees, depth).withColumn("row_id", F.monotonically_increasing_id()), "sketches")
    # each class by its first row in the stored table, with the smallest doc_id of all its rows
    first = made.where("class is not null").groupBy("class").agg(F.min("row_id").alias("row_id"), F.min("doc_id").alias("least_id"))
    classes = stored(made.join(first.select("row_id", "least_id"), "row_id"), "classes")
    pairs = neighbours(classes.select("class", "regions", "sketch"), depth, region_rows, near)
    groups = components(pairs).select(F.col("node").alias("class"), "label")
    members = stored(groups.join(classes.select("class", "doc_id", "text_key", "n_shingles"), "class"), "members")
    roots = stored(settled(docs, members, words, number, percent, group_rows), "settled")
    named = classes.select("class", "least_id").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = named.select("class", "root").join(least, "root").select("class", F.col("root").alias("component"), "component_id")
    out = made.select("doc_id", "text_key", "n_shingles", "class").join(of_class, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select(
        "doc_id", "text_key", "n_shingles", "component", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")
    )


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component (its smallest doc_id; of equal ones the smallest text hash) and all without words."""
    found = stored(near_duplicates(docs, words, percent), "near")
    # a null doc_id is not document 0
    keys = ["no_id", "id_key", "text_key"]
    id_key = F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("id_key")
    rows = found.where("component is not null")
    first = rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("text_key").alias("first_key"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key"))
    gone = stored(rows.join(first, "component").where(~stays).select(*id_key, "text_key").distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *id_key, text_key())
    left = keyed.join(gone, keys, "left_anti")
    repeats = rows.groupBy("doc_id", "text_key").count().where("count > 1").select(*id_key, "text_key", F.lit(True).alias("again"))
    if not repeats.take(1):
        return left.select("row.*")
    # repeated rows with words: one of each stays
    marked = left.join(stored(repeats, "repeats"), keys, "left")
    once = marked.where("again").dropDuplicates(keys)
    return marked.where("again is null").unionByName(once).select("row.*")
