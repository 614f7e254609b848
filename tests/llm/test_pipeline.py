import random

import pytest


@pytest.fixture
def folder(spark, tmp_path):
    r = random.Random(11)
    text = lambda n: " ".join("".join(r.choice(["the", "on", "er", "in", "ti", "a"]) for _ in range(3)) for _ in range(n))
    good = [text(90) for _ in range(90)]
    leak = text(30)
    rows = [(i, t) for i, t in enumerate(good)]
    rows += [(100, good[3]), (101, good[4] + " end"), (102, good[5][:200] + " " + leak), (103, " ".join(w.upper() + "!!" for w in good[6].split())), (104, text(40) + " mail jo.doe@mail.example.com")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b1", leak)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline(spark, folder):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids, columns = [], docs.columns
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
        docs = docs.cache()
        ids.append({r.doc_id for r in docs.collect()})
    assert 103 not in ids[0] and len(ids[0]) >= 90
    assert not {100, 101} & ids[1] and {3, 4} & ids[0] <= ids[1]
    assert 102 not in ids[2] and len(ids[2]) >= len(ids[1]) - 1
    assert ids[3] == ids[2] and "jo.doe" not in " ".join(r.text for r in docs.collect())
    out = p.run(spark, folder)
    assert {r.doc_id for r in out.collect()} == ids[3]


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)} and "pipeline" in names


@pytest.fixture
def odd(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns with names that stages use."""
    r = random.Random(4)
    text = lambda n: " ".join("".join(r.choice(["the", "on", "er", "in", "ti", "a"]) for _ in range(3)) for _ in range(n))
    a, long = text(60), text(9000)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 2), (None, a, None, None, None), (None, None, None, None, None), (2, None, "en", "s", 3), (3, "", "en", "s", 4), (4, "  ", "de", "s", 5), (5, long, "en", "s", 6), (5, long, "en", "s", 6), (6, "x", None, "s", 7)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, 1, 0) for i in (1, 5, 6)] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b", text(30)), (None, None), ("e", "")], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(rows, columns)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path), df


def test_stages_with_odd_rows(spark, odd):
    pytest.importorskip("public_tokenizers")
    from pyspark.sql import functions as F

    import corpus_pipeline as p

    folder, df = odd
    wide = df
    for name in ("_kept", "keep", "nll", "hits", "n_found", "row", "key", "part", "_chunk", "_row"):
        wide = wide.withColumn(name, F.lit("z"))
    left = {name: sorted(((x.doc_id, x.n_chars) for x in stage(spark, wide, folder).collect()), key=str) for name, stage in p.STAGES[:-1]}
    every = sorted(((x.doc_id, x.n_chars) for x in df.collect()), key=str)
    assert left["decontamination"] == every and left["personal data"] == every
    assert left["quality"] == sorted([(1, 1), (1, 2), (None, None), (4, 5), (5, 6), (5, 6), (6, 7)], key=str)
    # one row of the group of text a (null ids first), one of the two long ones
    assert sorted(left["near duplicates"], key=str) == sorted([(None, None), (None, None), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7)], key=str)
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, wide, folder).columns == wide.columns
    for _, stage in p.STAGES:
        assert stage(spark, df.limit(0), folder).count() == 0
    tokens = {(x.doc_id, x.n_tokens) for x in p.STAGES[-1][1](spark, df, folder).collect()}
    assert {(2, 0), (3, 0), (None, 0)} <= tokens
    # what quality leaves, less the copies: text a under its null id, the blank text, the long one, the word
    assert sorted((x.doc_id for x in p.run(spark, folder).collect()), key=str) == sorted([None, 4, 5, 6], key=str)
