"""Array files read in byte ranges, against Python's json."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docweave.sources.json_arrays import json_objects
from docweave.sources.readers import read_json_records
from docweave.sources.writers import write_json_arrays


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "97")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def odd_records(count, seed):
    pick = random.Random(seed)
    letters = ['"', "\\", "}", "{", "[", "]", ",", "a", "\n", "ü", "😀", "\\\\", '\\"', "}]"]

    def text():
        return "".join(pick.choice(letters) for _ in range(pick.choice([0, 3, 30, 400])))

    return [{"id": i, "t": text(), "x": {"y": [{"z": text()}, {}], "}": [[], [{}]]}} for i in range(count)]


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_in_ranges(spark, tmp_path, small_ranges, indent):
    files = {f"{i}.json": odd_records(n, i) for i, n in enumerate((0, 1, 40, 90))}
    for name, records in files.items():
        (tmp_path / name).write_text(("﻿" if name == "2.json" else " ") + json.dumps(records, indent=indent, ensure_ascii=name == "1.json"), encoding="utf-8")
    rows = json_objects(spark, str(tmp_path)).collect()
    for name, records in files.items():
        got = [json.loads(r.record) for r in rows if r.path.endswith("/" + name)]
        assert sorted(got, key=lambda r: r["id"]) == records


def test_objects_in_lines_and_files_without_objects(spark, tmp_path, small_ranges):
    records = odd_records(30, 7)
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(r) for r in records) + "\n")
    (tmp_path / "one.json").write_text(json.dumps({"id": 99}))
    (tmp_path / "cut.json").write_text('[{"id": 100}, {"id": 101, "t": "}')
    for name, text in (("empty", ""), ("blank", " \n"), ("number", "5"), ("none", "[ ]")):
        (tmp_path / f"{name}.json").write_text(text)
    got = sorted((json.loads(r.record) for r in json_objects(spark, str(tmp_path)).collect()), key=lambda r: r["id"])
    assert got == [*records, {"id": 99}, {"id": 100}]


def test_records_without_a_schema_and_broken_ones(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"recall@1": 0.5, "n": null}, {"recall@1" 1}, {"n": 3}]')
    got = read_json_records(spark, str(tmp_path / "r.json"), "`recall@1` double, n long")
    assert sorted(map(tuple, got.collect()), key=str) == [(0.5, None), (None, 3), (None, None)] and "recall_at_1" in got.columns


def test_one_large_array_is_the_work_of_many_tasks(spark, tmp_path):
    target = str(tmp_path / "large")
    rows = spark.range(0, 100_000, 1, 1).select("id", F.concat(F.lit('said "}{" \\ '), F.col("id").cast("string")).alias("t"))
    write_json_arrays(rows, target)
    write_json_arrays(rows.where("id < 0"), str(tmp_path / "nothing"))
    assert read_json_records(spark, str(tmp_path / "nothing"), "id long").count() == 0
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 18))
    try:
        assert spark.read.option("lineSep", "}").text(target).rdd.getNumPartitions() >= 8
        got = read_json_records(spark, target, "id long, t string")
        assert got.exceptAll(rows).count() == 0 and got.count() == 100_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
