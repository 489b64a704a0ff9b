import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lodestream.sources import io
from lodestream.streaming import incremental


def test_lines_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{bad\n[1]\n{"x": 2}\n')
    got = io.tolerant_lines(spark, str(tmp_path / "a.jsonl"))
    assert got.count() == 4 and got.where("valid").count() == 2
    assert io.json_lines(spark, str(tmp_path / "a.jsonl"), "x int", strict=False).where("x is not null").count() == 2
    io.write_routed(spark.createDataFrame([(1, "a"), (2, "b")], "v int, s string"), str(tmp_path / "out"), "s")
    assert (tmp_path / "out" / "s=a").exists()
    assert not io.write_if(spark.range(1), str(tmp_path / "no"), False) and not (tmp_path / "no").exists()
    assert io.file_digests(spark, str(tmp_path / "a.jsonl")).first()["bytes"] == 28
    assert io.aligned([spark.range(1).select("id"), spark.range(1).withColumn("y", F.lit(1))]).columns == ["id", "y"]


def test_incremental_batches_are_idempotent(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.range(10).withColumn("v", F.col("id") * 2).write.parquet(src)
    run = lambda c: incremental.run_once(incremental.source(spark, src, "id bigint, v bigint"), lambda b: b, out, "id", c)
    run(ck)
    spark.range(5, 15).withColumn("v", F.col("id") * 2).write.mode("append").parquet(src)
    run(ck)
    run(str(tmp_path / "ck2"))
    got = spark.read.parquet(out)
    assert got.count() == 15 == got.select("id").distinct().count()


def test_materialized_tables_are_released(spark):
    from lodestream.session import materialize, release, shared_dir

    df = materialize(spark.range(5), "x")
    assert df.count() == 5 and shared_dir(spark).removeprefix("file:") in df.inputFiles()[0]
    assert release(spark) and not release(spark)


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "n.jsonl").write_text('{"x": 1}\n\n{bad\n{"x": 2}\n')
    got = [(r["line"], r["valid"]) for r in io.numbered_lines(spark, str(tmp_path / "n.jsonl")).orderBy("line").collect()]
    assert got == [(1, True), (3, False), (4, True)]
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "bad.json").write_text('[{"a": 1}, 3]')
    assert io.object_list(spark, str(tmp_path / "list.json")).count() == 2
    with pytest.raises(ValueError, match="list of objects"):
        io.object_list(spark, str(tmp_path / "bad.json"))
    spark.range(3).write.parquet(str(tmp_path / "t1"))
    x, gone = io.tables(spark, [str(tmp_path / "t1"), str(tmp_path / "t2")])
    assert x.count() == 3 and gone == [str(tmp_path / "t2")]
    train, held = io.with_fallback_split(spark.range(400), None, "id", 10)
    assert train.count() + held.count() == 400 and 15 < held.count() < 80
    assert io.with_fallback_split(spark.range(4), spark.range(2), "id", 10)[1].count() == 2
    (tmp_path / "w.txt").write_text("alpha 3\n beta\n\nalpha 7 n\n")
    assert {tuple(r) for r in io.word_frequencies(spark, str(tmp_path / "w.txt")).collect()} == {("alpha", 7), ("beta", 0)}
    assert io.key_values(["A=1", "export B='x y'", "# C=2", "A=3", "9=4", "no"]) == {"A": "1", "B": "x y"}
    assert io.write_json_lines(spark.range(5), str(tmp_path / "five")) == 5
    io.write_csv(spark.createDataFrame([(1, "甲")], "n int, s string"), str(tmp_path / "csv"))
    assert next((tmp_path / "csv").glob("*.csv")).read_bytes().decode("utf-8-sig").splitlines() == ["n,s", "1,甲"]
    io.write_stats(spark, str(tmp_path / "stats"), {"a": {"b": 1}})
    assert json.loads(next((tmp_path / "stats").glob("part*")).read_text()) == {"a": {"b": 1}}
    io.write_manifest(spark.range(50).withColumn("id", F.col("id").cast("string")), str(tmp_path / "m"), "id")
    ids = [json.loads(x)["id"] for f in sorted((tmp_path / "m").glob("part*")) for x in f.read_text().split()]
    assert ids == sorted(map(str, range(50)), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
