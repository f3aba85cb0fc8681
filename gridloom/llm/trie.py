"""Prefix trie of rebuilt conversations from composable fingerprints; rebuilt texts are never made.

A rebuilt conversation is the first `head_turns(c)` turns of its base (all of them if there are fewer), then
its own turns after as many. A run of turns has the monoid element (n, f): n turns, and per lane
f = sum of t_i * B^i modulo a prime, where t_i is drawn from a hash of turn i's role and text. The
product is (n, f) * (m, g) = (n + m, f + B^n g), and since B has an inverse a run's first turns can
be divided out again. So the fingerprint of every rebuilt prefix comes from two stored prefix products,
base head and own turns, and a node of the trie is a (depth, fingerprint).

* Prefix products. Turns are sorted over the cluster by range of (conversation, turn), so that a
  conversation with a third of all turns is many partitions; products run inside a partition, and the
  products of whole partitions (a few rows each) carry what lies before them.
* Nodes are one aggregation of (depth, fingerprint). A node belongs to the path of its smallest
  member, and those of one member are the lower end of its path. Sums over a subtree are therefore sums
  over the node's members of one number a conversation (all that its own nodes hold), but for the
  smallest member, of which the part above the node comes off: a running total of its own nodes. No
  step goes through the depths one by one.
* Equality is verified, not assumed: turns of equal hash must have equal role and text where they are
  stored, and members of a node must refer to turns of one hash and to one parent. If any differ, all
  is done again with the next seed.

Defined results: rows are ordered by turn (null first), then role and text, and repeated rows all stay;
a null role or text is empty; rows with a null conv_id belong to no conversation and are left out (one
without an id can't be a member); c % 5 has the sign of c, as in SQL; an empty table has no conversation
and so no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gridloom.sources.workspace import discard, stored

FAMILY, HEADS = 5, 9
PRIME = (1 << 31) - 1
BASES = (1_220_703_125, 1_977_326_743, 742_938_285)  # one per lane, below PRIME
LANES = ("f0", "f1", "f2")
CHUNK = 1 << 14
SEEDS = 8


def base_of(conv: Column) -> Column:
    return conv - conv % FAMILY


def head_turns(conv: Column) -> Column:
    return (F.crc32(conv.cast("string")) % HEADS).cast("int")


# ---------------------------------------------------------------------------- prefix products


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo PRIME, by doubling."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
        done += more
    return out


def product(one: tuple, two: tuple) -> tuple:
    """(n, (f, ..)) * (m, (g, ..))."""
    (n, f), (m, g) = one, two
    return n + m, tuple((x + pow(b, n, PRIME) * y) % PRIME for x, y, b in zip(f, g, BASES, strict=True))


EMPTY = (0, (0,) * len(BASES))


def hashed(conversations: DataFrame, seed: int) -> DataFrame:
    """conv_id, turn, role, text, key (hash of role and text), size (UTF-8 bytes of the text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text")
    )
    key = F.xxhash64(F.lit(seed), "role", "text")
    return rows.withColumns({"key": key, "size": F.octet_length("text").cast("long")})


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, part, pos, key, size, and the product of the conversation's turns in its partition before (b) and after (f) each."""
    lanes = [F.pmod(F.xxhash64("key", F.lit(k)), F.lit(PRIME)).alias(f"t{k}") for k in range(len(BASES))]
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    rows = turns.withColumn("tie", F.rand(1))  # deals rows that are equal in everything
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "size", *lanes)
    schema = "conv_id long, part int, pos long, key long, size long, " + ", ".join(f"b{k} long, f{k} long" for k in range(len(BASES)))

    def run(batches):
        part = TaskContext.get().partitionId()
        current, carry = None, EMPTY
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column(0).to_numpy()
            new = np.ones(n, bool)
            new[1:] = conv[1:] != conv[:-1]
            first = np.flatnonzero(new)
            segment = np.cumsum(new) - 1
            at = np.arange(n) - first[segment]
            goes_on = current is not None and conv[0] == current
            began = carry if goes_on else EMPTY
            lead = first[1] if len(first) > 1 else n  # rows of the first conversation
            pos = at.astype(np.int64)
            pos[:lead] += began[0]
            columns = [batch.column(0), pa.array(np.full(n, part, np.int32)), pa.array(pos), batch.column(1), batch.column(2)]
            ends = []
            for k, base in enumerate(BASES):
                own = batch.column(3 + k).to_numpy().astype(np.uint64) * powers(base, int(at.max()) + 1)[at] % np.uint64(PRIME)
                total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(own)))
                start = total[first][segment]
                both = np.stack((total[:-1] - start, total[1:] - start)) % np.uint64(PRIME)
                both[:, :lead] = (both[:, :lead] * np.uint64(pow(base, began[0], PRIME)) + np.uint64(began[1][k])) % np.uint64(PRIME)
                columns += [pa.array(x.astype(np.int64)) for x in both]
                ends.append(int(both[1, -1]))
            current, carry = conv[-1], (int(pos[-1]) + 1, tuple(ends))
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    arrow = pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int32()), ("pos", pa.int64()), ("key", pa.int64()), ("size", pa.int64())]
        + [(f"{x}{k}", pa.int64()) for k in range(len(BASES)) for x in "bf"]
    )
    return rows.mapInArrow(run, schema)


def carried(local: DataFrame) -> dict[int, list]:
    """By partition: (conversation, partition, n, f) before it, for conversations that span several; two a partition at most."""
    last = local.groupBy("conv_id", "part").agg(F.max(F.struct(F.col("pos"), *LANES)).alias("end"))
    border = last.groupBy("part").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    shared = (
        last.join(border, "part")
        .where("conv_id = low or conv_id = high")
        .withColumn("parts", F.count(F.lit(1)).over(W.partitionBy("conv_id")))
        .where("parts > 1")
        .orderBy("conv_id", "part")
    )
    before, so_far = {}, {}
    for r in shared.select("conv_id", "part", "end").collect():
        done = so_far.get(r["conv_id"], EMPTY)
        if done[0]:
            before.setdefault(r["part"], []).append((r["conv_id"], r["part"], *done))
        so_far[r["conv_id"]] = product(done, (r["end"]["pos"] + 1, tuple(r["end"][f] for f in LANES)))
    return before


def placed(local: DataFrame) -> DataFrame:
    """The local products multiplied by what lies before them: conv_id, pos, key, size, b.., f.. over whole conversations."""
    before = local.sparkSession.sparkContext.broadcast(carried(local))
    names = ["conv_id", "pos", "key", "size", *(f"{x}{k}" for k in range(len(BASES)) for x in "bf")]

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            conv, part = table.column("conv_id").to_numpy(), table.column("part").to_numpy()
            values = {c: table.column(c).to_numpy().copy() for c in names}
            for c, p, n, f in (x for own in np.unique(part).tolist() for x in before.value.get(own, ())):
                at = np.flatnonzero((part == p) & (conv == c))
                values["pos"][at] += n
                for k, base in enumerate(BASES):
                    for x in "bf":
                        values[f"{x}{k}"][at] = (values[f"{x}{k}"][at].astype(np.uint64) * np.uint64(pow(base, n, PRIME)) + np.uint64(f[k])) % np.uint64(PRIME)
            yield pa.RecordBatch.from_arrays([pa.array(values[c].astype(np.int64)) for c in names], names=names)

    schema = ", ".join(f"{c} long" for c in names)
    return local.select("conv_id", "part", *[c for c in names if c != "conv_id"]).mapInArrow(run, schema)


# ---------------------------------------------------------------------------- rebuilt conversations


def rebuilt(turns: DataFrame) -> DataFrame:
    """A row per turn of a rebuilt conversation, and one for the root: conv_id, depth, length, f.., b.. (parent), key, size, at (stored turn)."""
    conv = F.col("conv_id")
    cut = F.col("pos") == head_turns(conv)
    bs = [f"b{k}" for k in range(len(BASES))]
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(F.when(cut, F.col(b))).alias(f"cut_{b}") for b in bs])
    head = (
        turns.where(F.col("pos") < HEADS - 1)
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "size", *bs, *LANES))).alias("head"))
        .select(F.col("conv_id").alias("base"), "head")
    )
    glue = (
        own.withColumns({"base": base_of(conv), "h": head_turns(conv)})
        .join(head, "base", "left")
        .withColumn("head", F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.expr("slice(head, 1, 0)"), F.array()))
        .withColumn("had", F.size("head"))
        .withColumn("length", F.col("had") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    )
    glue = stored(glue, "glue")
    none = F.lit(0).cast("long")
    root = glue.select(
        "conv_id", none.alias("depth"), "length", *[none.alias(c) for c in (*LANES, *bs)], none.alias("key"), none.alias("size"),
        F.struct(none.alias("conv_id"), none.alias("pos")).alias("at"),
    )
    shown = F.col("x")
    heads = glue.select("conv_id", "base", "length", F.explode("head").alias("x")).select(
        "conv_id", (shown["pos"] + 1).alias("depth"), "length", *[shown[c].alias(c) for c in (*LANES, *bs)], shown["key"].alias("key"),
        shown["size"].alias("size"), F.struct(F.col("base").alias("conv_id"), shown["pos"].alias("pos")).alias("at"),
    )
    # own turns: the first h divided out, the base's head multiplied on
    last = F.get("head", F.col("had") - 1)
    joint = glue.where("n > h").select(
        "conv_id", "h", "had", "length", *[F.col(f"cut_{b}") for b in bs], *[F.coalesce(last[f], none).alias(f"head_{f}") for f in LANES],
        F.explode(F.sequence(none, F.floor(F.col("n") / CHUNK).cast("long"))).alias("chunk"),
    )
    met = turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK).cast("long")).join(joint, ["conv_id", "chunk"]).where("pos >= h")

    def shifted(name: str, k: int) -> Column:
        back = F.array(*[F.lit(pow(BASES[k], -x, PRIME)).cast("long") for x in range(HEADS)])
        rest = F.pmod(F.col(name) - F.col(f"cut_b{k}"), F.lit(PRIME))
        return (F.col(f"head_f{k}") + rest * F.get(back, F.col("h") - F.col("had"))) % PRIME

    owns = met.select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("had") + 1).alias("depth"), "length",
        *[shifted(f, k).alias(f) for k, f in enumerate(LANES)], *[shifted(b, k).alias(b) for k, b in enumerate(bs)], "key", "size",
        F.struct("conv_id", "pos").alias("at"),
    )
    return root.unionByName(heads).unionByName(owns).withColumn("length", F.col("length").cast("long"))


def same_content(turns: DataFrame) -> bool:
    """Whether turns of equal key have equal role and text."""
    ends = turns.groupBy("key").agg(*[f(c).alias(f"{n}_{c}") for c in ("role", "text") for n, f in (("low", F.min), ("high", F.max))])
    return not ends.where("low_role <> high_role or low_text <> high_text").take(1)


def nodes_of(rows: DataFrame) -> DataFrame:
    """A row per node: depth, f.., b.. (parent), conv_id (smallest member), n_convs, n_ends, size, at, same (members agree)."""
    bs = [f"b{k}" for k in range(len(BASES))]
    differ = [F.min(c) != F.max(c) for c in (*bs, "key")]
    return rows.groupBy("depth", *LANES).agg(
        *[F.min(b).alias(b) for b in bs],
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum((F.col("depth") == F.col("length")).cast("long")).alias("n_ends"),
        F.max("size").alias("size"),
        F.min("at").alias("at"),
        (~reduce(lambda x, y: x | y, differ)).alias("same"),
    )


# ---------------------------------------------------------------------------- digests


def end_digests(rows: DataFrame) -> DataFrame:
    """depth, f.., ends_sha256: SHA-256 of the members that end at a node, in order.

    Ids are joined into strings per 65,536 consecutive ids; a node's strings are sorted and fed to the digest one by
    one, so that memory doesn't grow with the node (the digest itself is one after another by nature).
    """
    piece = F.shiftright("conv_id", 16)
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    texts = rows.where("depth = length").groupBy("depth", *LANES, piece.alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    key = ["depth", *LANES]

    def run(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if r[:-2] != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = r[:-2], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(r[-1].encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*key, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], names=[*key, "ends_sha256"])

    ordered = texts.repartition(*key).sortWithinPartitions(*key, "piece").select(*key, "piece", "ids")
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in key) + ", ends_sha256 string")


# ---------------------------------------------------------------------------- the operator


def own_totals(nodes: DataFrame) -> DataFrame:
    """conv_id, depth, below: what the member's own nodes save from that depth on; total: all of them; leaf: 1 if one is childless."""
    saving = nodes.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("size")).alias("w"), (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    chunked = saving.withColumn("chunk", F.floor(F.col("depth") / CHUNK).cast("long"))
    pieces = chunked.groupBy("conv_id", "chunk").agg(F.sum("w").alias("sum"), F.max(F.col("leaf").cast("long")).alias("leaf"))
    after = W.partitionBy("conv_id").orderBy(F.col("chunk").desc())
    pieces = pieces.select(
        "conv_id", "chunk", F.coalesce(F.sum("sum").over(after.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("later"),
        F.sum("sum").over(W.partitionBy("conv_id")).alias("total"), F.max("leaf").over(W.partitionBy("conv_id")).alias("is_leaf"),
    )
    inner = W.partitionBy("conv_id", "chunk").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    run = chunked.withColumn("run", F.sum("w").over(inner)).join(pieces, ["conv_id", "chunk"])
    return run.select("conv_id", "depth", (F.col("run") + F.col("later")).alias("below"), "total", "is_leaf")


def fingerprinted(conversations: DataFrame, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """Rows of the rebuilt conversations and the nodes (both stored); none if two contents met in one fingerprint."""
    turns = hashed(conversations, seed)
    if not same_content(turns):
        return None
    local = stored(prefixes(turns), "products")
    products = stored(placed(local), "turns")
    discard(local)
    rows = stored(rebuilt(products), "rebuilt")
    discard(products)
    nodes = stored(nodes_of(rows), "nodes")
    if nodes.where("not same").take(1):
        discard(rows)
        discard(nodes)
        return None
    return rows, nodes.drop("same")


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    at (conversation and position where the node's last turn is stored)."""
    found = next((x for s in range(seed, seed + SEEDS) if (x := fingerprinted(conversations, s)) is not None), None)
    if found is None:
        raise RuntimeError(f"no seed of {SEEDS} tells all turns apart")
    rows, nodes = found
    key = ["depth", *LANES]
    bs = [f"b{k}" for k in range(len(BASES))]
    totals = stored(own_totals(nodes), "totals")
    per_conv = totals.groupBy("conv_id").agg(F.max("total").alias("total"), F.max("is_leaf").alias("is_leaf"), F.max("depth").alias("deep"))
    per_conv = per_conv.where("total > 0 or is_leaf > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("deep") / CHUNK).cast("long")))
    )
    sums = (
        rows.select("conv_id", *key, F.floor(F.col("depth") / CHUNK).cast("long").alias("chunk"))
        .join(per_conv, ["conv_id", "chunk"])
        .groupBy(*key)
        .agg(F.sum("total").alias("members_total"), F.sum("is_leaf").alias("n_leaves"))
    )
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(b).alias(f) for b, f in zip(bs, LANES, strict=True)]]
    children = nodes.where("depth > 0").select(*up).groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    top = nodes.where("depth = 0").select("conv_id").scalar()  # all depth-1 nodes have one parent, so it isn't joined
    parent = nodes.where("depth > 0").select(F.col("depth").alias("up"), *[F.col(f).alias(f"up_{f}") for f in LANES], F.col("conv_id").alias("above"))
    of = nodes.withColumns({"up": F.when(F.col("depth") > 1, F.col("depth") - 1), **{f"up_{f}": F.col(b) for f, b in zip(LANES, bs, strict=True)}})
    deep = of.where("depth > 1").join(parent, ["up", *[f"up_{f}" for f in LANES]], "left")
    shallow = of.where("depth <= 1").withColumn("above", F.when(F.col("depth") == 1, top))
    out = deep.select(*nodes.columns, "above").unionByName(shallow.select(*nodes.columns, "above"))
    out = (
        out.join(sums, key, "left")
        .join(children, key, "left")
        .join(end_digests(rows), key, "left")
        .join(totals.select("conv_id", "depth", "below", "total"), ["conv_id", "depth"])
    )
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id",
        "depth",
        F.col("above").alias("parent_conv_id"),
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("n_leaves", zero).alias("n_leaves"),
        (F.coalesce("members_total", zero) - F.col("total") + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        "at",
    )
