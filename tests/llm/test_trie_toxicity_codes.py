"""Prefix trie, toxicity and vector codes against plain loops, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import toxicity, trie, vectorcodes
from gridloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------------------- trie


def trie_of(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in by.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members, kids = defaultdict(set), defaultdict(set)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    for n in members:
        if n:
            kids[n[:-1]].add(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) if kids[n] else 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(full[c]) == len(n))
        parent = min(members[n[:-1]]) if n else None
        out.append((min(m), len(n), parent, len(m), len(kids[n]), leaves[n], saved[n], sha(ends)))
    return sorted(out)


def test_trie_of_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = sorted(tuple(r) for r in QUERIES["op11_prefix_trie"](spark, SF).collect())
    assert got == trie_of([tuple(r) for r in table.collect()])


@pytest.fixture(scope="module")
def talk():
    rnd = random.Random(5)
    rows = [(c, t, "user" if t % 2 else "assistant", rnd.choice("ab") * rnd.randrange(3)) for c in range(-12, 40) for t in range(rnd.randrange(1, 12))]
    rows += [(c, None, None, None) for c in range(0, 40, 3)] + [(7, 3, None, "é")] * 3  # null turns, ties, repeated rows
    rows += [(50, t, "user", "x") for t in range(900)] + [(51, t, "user", "x") for t in range(900)]  # a very long conversation
    rows += [(60 + c, 0, "user", "only one turn") for c in range(200)]  # often rebuilt without a turn
    return [*rows, (None, 0, "user", "no id"), (9, 1, "user", "long " * 200_000)]


def test_trie_edge_cases(spark, talk, monkeypatch):
    table = spark.createDataFrame([(*r, 1, "x") for r in talk], "conv_id long, turn long, role string, text string, depth long, key string").repartition(7)
    monkeypatch.setattr(trie, "CHUNK", 64)  # several chunks and partitions in the long conversations
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in trie.prefix_trie(table).select(*columns).collect()) == trie_of(talk)
    assert trie.prefix_trie(table.where("false")).count() == 0
    assert trie.prefix_trie(table.where("conv_id is null")).count() == 0


def test_trie_starts_again_when_fingerprints_meet(spark, monkeypatch):
    table = spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (3, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    real, seeds = trie.hashed, []

    def poor(conversations, seed):
        seeds.append(seed)
        return real(conversations, seed).withColumn("key", F.lit(1).cast("long")) if seed == 0 else real(conversations, seed)

    monkeypatch.setattr(trie, "hashed", poor)
    assert trie.prefix_trie(table).count() == len(trie_of([tuple(r) for r in table.collect()]))
    assert seeds == [0, 1]


def test_products_compose():
    rnd = random.Random(3)
    run = lambda n: [tuple(rnd.randrange(trie.PRIME) for _ in trie.BASES) for _ in range(n)]
    value = lambda turns: (len(turns), tuple(sum(t[k] * pow(b, i, trie.PRIME) for i, t in enumerate(turns)) % trie.PRIME for k, b in enumerate(trie.BASES)))
    a, b, c = run(3), run(5), run(2)
    assert trie.product(value(a), value(b)) == value(a + b)
    assert trie.product(trie.product(value(a), value(b)), value(c)) == trie.product(value(a), trie.product(value(b), value(c)))
    assert trie.product(trie.EMPTY, value(a)) == value(a) == trie.product(value(a), trie.EMPTY)


# ---------------------------------------------------------------------------- toxicity


def test_kernel_against_plain_loops():
    def features(s):
        out = defaultdict(float)
        for at in combinations(range(len(s)), toxicity.ORDER):
            if at[-1] - at[0] < toxicity.SPAN:
                out["".join(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] - toxicity.ORDER + 1)
        size = sum(toxicity.DECAY ** (2 * (at[-1] - at[0] - toxicity.ORDER + 1)) for at in combinations(range(len(s)), toxicity.ORDER) if at[-1] - at[0] < toxicity.SPAN)
        return out, max(1.0, size) ** 0.5

    marks, some = ["\x02idiot\x03", "\x02noodles\x03", "ab"], ["\x02idixot\x03", "\x02i.d.i.o.t\x03", "\x02éßidiotidiot\x03", "x", ""]
    landmarks = toxicity.Landmarks(marks)
    got = landmarks.kernel(some)
    for i, s in enumerate(some):
        for j, m in enumerate(marks):
            (a, na), (b, nb) = features(s), features(m)
            assert got[i, j] == pytest.approx(sum(w * b[u] for u, w in a.items()) / na / nb)
    alpha = np.array([1.5, -0.5, 2.0])
    margins = toxicity.Margins(*landmarks.summed(alpha), 0.25)
    assert margins.of_pieces(some) == pytest.approx(got @ alpha + 0.25)
    assert margins.of_chunks(["idixot", "", "q" * 500])[:2] == pytest.approx([got[0] @ alpha + 0.25, 0.25])
    long = toxicity.pieces("abcdefghij" * 9)
    spans = {("\x02" + "abcdefghij" * 9 + "\x03")[i : i + toxicity.SPAN] for i in range(92 - toxicity.SPAN + 1)}
    assert all(any(s in p for p in long) for s in spans)


def test_toxicity_held_out(spark):
    """All labelled rows of sf0.01: seldom wrong on clean documents, most toxic ones found from a few dozen examples."""
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op12_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all((r["predicted"] == 1) == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    clean, toxic = [r["predicted"] for r in held if r["toxic"] == 0], [r["predicted"] for r in held if r["toxic"] == 1]
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.6 * len(toxic)


def test_toxicity_of_disguised_insults(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice(["th", "er", "on", "an", "in", "st", "ou"]) for _ in range(rnd.randrange(1, 4)))
    insults = ["blockhead", "scoundrel", "nitwit"]

    def text(bad):
        words = [word() for _ in range(60)]
        return " ".join([*words[:30], *([bad] if bad else []), *words[30:]])

    made = [(i, text(rnd.choice(insults) if i % 4 == 0 else None), "en", "s") for i in range(900)]
    docs = spark.createDataFrame([*made, (None, None, None, None), (5000, "", None, None), (5001, None, "x", "y"), (5002, text(None) * 3000, "x", "y")], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("score", F.lit("clash")).withColumn("row", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(900)] + [(None, 1, 1), (3, None, 1), (7777, 1, 0)], "doc_id long, toxic int, text int")
    model = toxicity.fitted(docs, labels)
    score = lambda df: {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(df, model, ["doc_id", "score", "row"]).collect()}
    found = score(docs)
    assert all((found[i] >= 0.3) == (i % 4 == 0) for i in range(900))
    assert max(found[k] for k in (None, 5000, 5001, 5002)) < 0.3
    ways = ["{0}", "{0}!!!", "BLOCKHEAD", "b l o c k h e a d", "s.c.o.u.n.d.r.e.l", "block-head", "scounxdrel", "blo..ckhead"]
    other = spark.createDataFrame([(i, text(w.format("nitwit")), "s", 1) for i, w in enumerate(ways)], "doc_id long, text string, score string, row int")
    assert min(score(other).values()) >= 0.3
    assert toxicity.toxicity(docs.where("false"), labels, ["doc_id"]).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("toxic = 1"), ["doc_id"]).collect()} == {0.0}
    assert {r["score"] for r in toxicity.toxicity(docs, labels.where("false"), ["doc_id"]).collect()} == {0.0}


# ---------------------------------------------------------------------------- vector codes


def codes_of(rows):
    kept = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: r[0])
    length = len(kept[0][2])
    cut = [length * p // 16 for p in range(17)]
    part = lambda v, p: v[cut[p] : cut[p + 1]]
    books = [[list(part(r[2], p)) for r in kept[:64]] for p in range(16)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(v, p), e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(2):
        new = []
        for p in range(16):
            own = defaultdict(list)
            for _, _, v in kept:
                own[nearest(v, p)[1]].append(part(v, p))
            new.append([[sum(x) // len(own[i]) for x in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(books[p])])
        books = new
    text = ",".join(str(x) for b in books for e in b for x in e)
    found = {}
    by_label = defaultdict(int)
    for i, lab, v in kept:
        near = [nearest(v, p) for p in range(16)]
        found[i] = ("".join(f"{n[1]:02x}" for n in near), sum(n[0] for n in near))
        by_label[lab] += found[i][1]
    return sorted((i, *found[i], by_label[lab], sha(text)) for i, lab, _ in kept)


def test_codes_of_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_vector_codes"](spark, SF).collect()) == codes_of(rows)


def test_codes_edge_cases(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 0.3) if i % 7 else round(rnd.gauss(0, 2)) / 4 for _ in range(19)], [None, 1, 2][i % 3]) for i in range(300)]
    rows += [(i, rows[5][1], 1) for i in range(300, 420)]  # copies and ties
    bad = [(500, None, 1), (501, [None] * 19, 1), (502, [float("nan")] * 19, 1), (503, [float("inf")] + [0.0] * 18, None)]
    schema = "vec_id long, embedding array<float>, label int, code string, v int"
    table = spark.createDataFrame([(*r, "x", 1) for r in rows + bad], schema).repartition(5)
    single = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    got = lambda t: sorted(tuple(r) for r in vectorcodes.compressed(t).select(*columns).collect())
    assert got(table) == codes_of(single)
    monkeypatch.setattr(vectorcodes, "CELLS", 3)  # cells are forgotten again and again
    monkeypatch.setattr(vectorcodes, "BLOCK", 5000)
    assert got(table) == codes_of(single)
    assert got(table.where("vec_id < 10")) == codes_of(single[:10])  # fewer rows than entries
    assert got(table.where("vec_id >= 500")) == [] == got(table.where("false"))
    odd = spark.createDataFrame([(1, [1.0] * 16, 1), (2, [1.0] * 16, 1), (3, [1.0], 1), (None, [3e38] * 16, None)], "vec_id long, embedding array<float>, label int")
    assert [r["vec_id"] for r in vectorcodes.compressed(odd).orderBy("vec_id").collect()] == [None, 1, 2]
    empty = spark.createDataFrame([(1, [], 1), (2, [], None)], "vec_id long, embedding array<float>, label int")
    assert [(r["code"], r["error"]) for r in vectorcodes.compressed(empty).collect()] == [("00" * 16, 0)] * 2


def test_grid_is_exact():
    rnd = np.random.default_rng(1)
    entries = rnd.integers(-60, 60, (64, 4))
    entries[40] = entries[3]  # ties go to the lower index
    parts = rnd.integers(-90, 90, (5000, 4))
    distance = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    at, best = vectorcodes.Grid(entries).nearest(parts)
    assert (at == distance.argmin(1)).all() and (best == distance.min(1)).all()
