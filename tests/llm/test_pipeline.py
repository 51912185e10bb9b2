"""The pipeline's stages on a small table, each on what the one before it kept."""

import pytest

from .conftest import LINE, LONG, ODD

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, tmp_path):
    clean = lambda i: " ".join(f"word{i}x{k}" for k in range(40)) + f".\n{LINE} Ends {i}."
    table = [(i, clean(i), f"s{i % 3}") for i in range(12)] + [(100 + i, clean(0), "s0") for i in range(3)] + [(200, "short", "s1"), (201, None, "s1"), (202, "BUY!! *** " * 40, "s2")]
    frame = docs(table).select("doc_id", "text", "lang", "source", "n_chars")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    kept, held = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frame.columns
        out.write.parquet(f"{tmp_path}/{k}")
        held = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in held.collect()})
    assert kept[0] == set(range(12)) | {100, 101, 102}
    assert kept[1] == kept[0]
    assert kept[2] == set(range(12))
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    last = held.collect()
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, list(r.ids))
    assert sorted(map(key, last)) == sorted(map(key, again))
    assert all(len(r.ids) for r in last)


def test_stages_take_odd_tables(spark, docs, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names; no rows."""
    clean = lambda i: " ".join(f"word{i}x{k}" for k in range(40)) + "."
    table = [*ODD, (50, clean(50), None), (None, clean(51), "a"), (52, clean(52), "a"), (52, clean(52), "a"), (53, LONG + ".", "b"), (54, "\n".join([clean(54)] * 3 + [LONG + "."]), "b")]
    frame = docs(table).withColumnRenamed("kept", "_words").withColumnRenamed("doc", "row").withColumnRenamed("size", "_key")
    for k, held in enumerate((frame, frame.limit(0))):
        names = held.columns
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
            held = stage(spark, held, str(tmp_path))
            assert held.columns == names if n < 4 else set(held.columns) == {*names, "ids"} - {"text"}
            held.write.parquet(f"{tmp_path}/{k}-{n}")
            held = spark.read.parquet(f"{tmp_path}/{k}-{n}")
        rows = held.collect()
        assert all(r["_words"] == "x" and r["row"] == "y" and r["_key"] == 1 for r in rows)
        assert {r.doc_id for r in rows} <= ({7, 50, None, 52, 53, 54} if k == 0 else set())
        assert bool(rows) == (k == 0)
