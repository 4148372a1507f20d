"""Files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from tesserakt.operators import losses
from tesserakt.operators.correction import bounds
from tesserakt.sources import readers


def test_corpus(spark, tmp_path):
    rows = [{"id": "0", "contents": '"A title"\nfirst line\nsecond'}, {"id": "1", "contents": "alone"}, {"id": "2", "contents": None}]
    (tmp_path / "c.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    corpus = readers.read_corpus(spark, f"file://{tmp_path}/c.jsonl")
    assert [(r["title"], r["text"]) for r in corpus.orderBy("id").collect()] == [("A title", "first line\nsecond"), ("alone", ""), (None, "")]
    hits = spark.createDataFrame([("0",), ("0",), ("9",)], "id string")
    assert readers.by_ordinal(hits, corpus, "id").count() == 2


def test_files_of_two_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}\n{"x": 2, "y": "b"}\n')
    spark.createDataFrame([(3,)], "x long").write.parquet(f"file://{tmp_path}/b.parquet")
    got = readers.read_files(spark, [f"file://{tmp_path}/a.json", f"file://{tmp_path}/b.parquet"])
    assert sorted((r["x"], r["y"]) for r in got.fillna("", "y").collect()) == [(1, ""), (2, "b"), (3, "")]
    with pytest.raises(ValueError):
        readers.read_files(spark, ["x.csv"])


def test_steps_replace_themselves(spark, tmp_path):
    path = f"file://{tmp_path}/steps"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "step int, v string")
    readers.write_steps(rows, path, "step")
    readers.write_steps(rows.filter("step = 2").withColumn("v", F.lit("c")), path, "step")
    assert sorted((r["step"], r["v"]) for r in spark.read.json(path).collect()) == [(1, "a"), (2, "c")]


def test_preferences(spark):
    df = spark.createDataFrame([(0, "q", "good", "bad")], "i long, p string, c string, r string")
    rows = readers.preference_rows(df, "p", "c", "r").collect()
    assert sorted((r["kind"], r["text"]) for r in rows) == [("chosen", "q good"), ("rejected", "q bad")]
    three = readers.preference_variants(df, "p", "c", "r", "hh", "train", "i")
    assert three["rm"].columns == ["prompt", "chosen", "rejected"] and three["sft"].first()["response"] == "good" and three["rl"].first()["reward_model"]["ground_truth"] == "good"


def test_thresholds_and_coefficients():
    assert bounds("0.5_2") == (0.5, 2.0) and bounds(4) == (0.25, 4.0)
    for bad in ("2_1", "0_1"):
        with pytest.raises(ValueError):
            bounds(bad)
    with pytest.raises(TypeError):
        bounds(True)
    assert losses.next_kl_coefficient(0.1, 12.0, 6.0, 10, 100) == pytest.approx(0.1 * 1.02)
    assert losses.next_kl_coefficient(0.1, 5.7, 6.0, 10, 100) == pytest.approx(0.1 * (1 - 0.05 * 0.1))
