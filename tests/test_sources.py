"""Deliveries in and out, file checks, and the drop folder."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.sources import checks, delivery
from plumbline.streaming import drops


def test_csv_is_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n01,\n2,x\n")
    assert [tuple(r) for r in delivery.read_csv(spark, str(tmp_path), ["a", "b"]).collect()] == [("01", ""), ("2", "x")]
    (tmp_path / "b.csv").write_text("a,b\n1,2,3\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        delivery.read_csv(spark, str(tmp_path / "b.csv"), ["a", "b"], strict=True).collect()


def test_contract(spark):
    c = delivery.Contract({"id": "ID", "age": "AGE"}, ("id",), count=2, whitelist=frozenset({"X"}))
    assert c.check(["AGE", "Y"]) == [("failure", "missing id: ID"), ("failure", "missing whitelisted column X"), ("warning", "unknown column Y")]
    df = spark.createDataFrame([("1", 5)], "ID string, AGE int")
    assert delivery.conform(df, delivery.Contract({"id": "ID", "age": "AGE"}, ("id",))).columns == ["id", "age"]
    with pytest.raises(delivery.ContractError, match="missing id"):
        delivery.conform(df.drop("ID"), c)
    with pytest.raises(delivery.ContractError, match="AGE is int"):
        delivery.conform(df, delivery.Contract({"id": "ID", "age": "AGE"}, ("id",), types={"AGE": "string"}))


def test_stages_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"x{i}") for i in range(50)], "id int, x string")
    first = delivery.snapshot(df, str(tmp_path / "s"))
    assert first["n_rows"] == 50 and first == delivery.snapshot(df.repartition(3), str(tmp_path / "t"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        delivery.write_stage(df, str(tmp_path / "s"))
    delivery.write_ordered_csv(df, [F.col("id").desc()], str(tmp_path / "c"))
    lines = [x for p in sorted((tmp_path / "c").glob("part*")) for x in p.read_text().splitlines()[1:]]
    assert [int(x.split(",")[0]) for x in lines] == list(range(49, -1, -1)) and [int(x.split(",")[-1]) for x in lines] == list(range(1, 51))
    before = checks.manifest(str(tmp_path / "s"))
    assert checks.changed(str(tmp_path / "s"), before) == []
    (tmp_path / "s" / "new").write_text("x")
    assert checks.changed(str(tmp_path / "s"), before) == ["new"]


def test_parquet_takes_only_what_is_asked(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string").write.parquet(str(tmp_path / "p"))
    got = delivery.read_parquet(spark, str(tmp_path / "p"), ["id"], ["y"], F.col("id") > 1)
    assert [tuple(r) for r in got.collect()] == [(2, None)]
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,1)]" in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(delivery.ContractError):
        delivery.read_parquet(spark, str(tmp_path / "p"), ["nowhere"])


def test_codes_are_padded(spark):
    assert sorted(tuple(r) for r in delivery.code_list(spark.createDataFrame([("7", "123"), (" 07", "123")], "a string, b string"), ["a", "b"]).collect()) == [("07", "123")]


def test_file_digests(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\xef\xbb\xbfx\0y")
    (tmp_path / "b").write_bytes(b"plain")
    got = {r["path"][-1]: r for r in checks.file_digests(spark, str(tmp_path), 5).collect()}
    assert got["b"]["sha256"] == hashlib.sha256(b"plain").hexdigest() and not got["b"]["bom"] and not got["b"]["nul"]
    assert got["a"]["too_long"] and got["a"]["sha256"] is None
    assert {r["path"][-1]: (r["bom"], r["nul"]) for r in checks.file_digests(spark, str(tmp_path)).collect()} == {"a": (True, True), "b": (False, False)}


def test_drop_folder(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    df.write.parquet(str(tmp_path / "in" / "one"))
    for _ in range(2):  # the second run has nothing new
        drops.run_batches(drops.watch(spark, str(tmp_path / "in" / "*"), df.schema), lambda b: b.withColumn("y", F.col("x") * 2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted(r["y"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 4]


def test_stale_jobs_and_slots(spark):
    jobs = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:09:00")], "id int, at string").withColumn("at", F.to_timestamp("at"))
    assert [r["id"] for r in drops.stale(jobs, "at", F.to_timestamp(F.lit("2024-01-01 00:10:00")), 300).collect()] == [1]
    assert sorted(r["n"] for r in drops.slots(jobs, "at", 5).collect()) == [1, 1]
