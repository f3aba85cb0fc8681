"""What a task holds at once: Arrow batches end by bytes, and a text travels once."""

import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import linededup, packing
from gridloom.llm.batches import BATCH_BYTES, BATCH_SETTING, over_texts


def test_batches_end_by_bytes(spark):
    def held(texts: pa.Array) -> list:  # the size of the batch that a slice is part of
        return [pa.array([texts.buffers()[2].size] * len(texts), pa.int64())]

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("text"))
    sizes = [r["held"] for r in over_texts(docs, held, "held long", ["doc_id"]).select("held").collect()]
    assert len(sizes) == 3000 and max(sizes) <= 2 * BATCH_BYTES
    before = spark.conf.get(BATCH_SETTING)
    try:
        spark.conf.set(BATCH_SETTING, 1 << 20)
        assert max(r["held"] for r in over_texts(docs, held, "held long", ["doc_id"]).select("held").collect()) <= 2 << 20
    finally:
        spark.conf.set(BATCH_SETTING, before)


def test_line_dedup_carries_a_text_once(spark, monkeypatch):
    rows = [(i, f"own {i}\ncommon", None, 7) for i in range(12)] + [(50, None, "row", 9), (None, "Common \n\n", "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, n_chars long")
    seen, real = [], linededup.without
    monkeypatch.setattr(linededup, "without", lambda met, n: (seen.append(met.schema.simpleString()), real(met, n))[1])
    cleaned = linededup.cleaned(docs)
    assert cleaned.columns == docs.columns
    got = {r["doc_id"]: tuple(r)[1:] for r in cleaned.collect()}
    assert got == {i: (f"own {i}", None, len(f"own {i}")) for i in range(12)} | {50: (None, "row", 9), None: ("\n", "x", 1)}
    whole = {r["row"]["doc_id"]: (r["row"]["text"], r["new_text"], r["n_lines"], r["n_dropped"]) for r in linededup.dedup(docs).collect()}
    assert whole[3] == ("own 3\ncommon", "own 3", 2, 1) and whole[50] == (None, "", 1, 0) and whole[None] == ("Common \n\n", "\n", 3, 1)
    few = {r["row"]["doc_id"]: r["new_text"] for r in linededup.dedup(docs, keep=["doc_id"]).collect()}
    assert few == {k: v[1] for k, v in whole.items()}
    assert len(seen) == 3 and all(x.count("text:string") == 1 for x in seen)


def test_plan_of_slots_starts_no_python_worker(spark, monkeypatch):
    made, real = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: (made.append(data), real(self, data, *a, **b))[1])
    cut = real(spark, [(i, 0, 32 + i % 2, 5, 32 + i % 2) for i in range(300)], "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    rows = packing.place(cut).collect()
    assert len(rows) == 300 and all(isinstance(x, pa.Table) for x in made)
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spots, spots[1:], strict=False))
