"""Arrow and JSON-array files by folder of partition values."""

import datetime as dt
import json
from pathlib import Path

import pytest

from tidemark.sources import files

ROWS = [
    (i, [None, "a/b: c=%", "ü plain", "x"][i % 4], dt.date(2024, 1, 1 + i % 2), None if i % 5 == 0 else f"t\n{i}") for i in range(400)
]


@pytest.mark.parametrize("suffix", [".feather", ".json", ".jsonl", ".parquet"])
def test_round_trip_by_folder(spark, tmp_path, suffix):
    df = spark.createDataFrame(ROWS, "id long, kind string, day date, text string")
    path = str(tmp_path / f"rows{suffix}")
    files.write_table(df, path, partition_by=["day", "kind"])
    days = sorted(p.name for p in Path(path).iterdir() if p.is_dir())
    assert days == ["day=2024-01-01", "day=2024-01-02"]
    back = files.read_table(spark, path).select("id", "kind", "day", "text")
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    files.write_table(df.limit(3), path, mode="append", partition_by=["day", "kind"])
    assert files.read_table(spark, path).count() == 403


def test_json_files_are_whole_arrays(spark, tmp_path):
    path = tmp_path / "rows.json"
    files.write_table(spark.createDataFrame(ROWS, "id long, kind string, day date, text string").repartition(3), str(path), partition_by=["day"])
    got = [(f.parent.name, r) for f in path.glob("day=*/*.txt") for r in json.loads(f.read_text())]
    assert sorted(r["id"] for _, r in got) == list(range(400))
    assert all(set(r) == {"id", "kind", "text"} and (folder == "day=2024-01-01") == (r["id"] % 2 == 0) for folder, r in got)


def test_odd_partition_columns(spark, tmp_path):
    for suffix in (".feather", ".json"):
        with pytest.raises(ValueError):
            files.write_table(spark.range(1), str(tmp_path / f"a{suffix}"), partition_by=["id"])
    empty = spark.createDataFrame([], "id long, kind string")
    files.write_table(empty, str(tmp_path / "empty.feather"), partition_by=["kind"])
    assert files.read_table(spark, str(tmp_path / "empty.feather")).count() == 0
