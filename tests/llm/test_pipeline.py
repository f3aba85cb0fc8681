"""The corpus pipeline, stage by stage, against plain loops on each stage's own input."""

from collections import Counter, defaultdict

import corpus_pipeline

from gridloom.sources.workspace import stored

from .test_against_brute_force import SF, SPACE, contamination, lower, near_components, quality_numbers


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "pack"]
    seen = {"documents": by_id(docs)}
    frames = {}
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = stored(stage(spark, docs, SF), name)
        frames[name] = docs
        if name != "pack":
            assert docs.columns == columns
            seen[name] = by_id(docs)
            assert docs.count() == len(seen[name])

    before, after = seen["documents"], seen["quality_rules"]
    failed = {k for k, d in before.items() if (n := quality_numbers(d["text"]))[0] < 10 or 100 * n[4] > 20 * n[0]}
    assert not failed & after.keys() and all(after[k] == before[k] for k in after)
    assert len((good - failed) & after.keys()) >= 0.98 * len((good - failed) & before.keys())

    before, after = after, seen["line_dedup"]
    key = lambda line: lower(line.strip(SPACE))
    df = Counter(k for d in before.values() for k in {key(x) for x in d["text"].split("\n")})
    assert after.keys() == before.keys()
    for k, d in before.items():
        text = "\n".join(x for x in d["text"].split("\n") if not (key(x) and df[key(x)] >= 10))
        assert after[k]["text"] == text and after[k]["n_chars"] == len(text) and after[k]["lang"] == d["lang"]

    before, after = after, seen["near_dedup"]
    found = near_components({k: d["text"] for k, d in before.items()}, 5, 80)
    assert after.keys() == {k for k, (n, root) in found.items() if root == k}

    before, after = after, seen["decontaminate"]
    assert after.keys() == {k for k, d in before.items() if not contamination(d["text"], items)[4]}
    assert all(after[k] == before[k] for k in after)

    pieces = defaultdict(list)
    for r in frames["pack"].collect():
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    assert pieces.keys() == after.keys()
    for own in pieces.values():
        at = 0
        for start, length, total in sorted(own):
            assert start == at
            at += length
        assert at == total


def test_run_equals_the_stages(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert set(rows.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows.collect())
    assert spots and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spots, spots[1:], strict=False))
