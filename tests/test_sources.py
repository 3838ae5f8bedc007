import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.schema import FEATURE_ORDER
from foldwise.sources import files


def _line(values):
    return ",".join(str(v) for v in values)


def _write_home(root, home, header, rows):
    os.makedirs(f"{root}/{home}", exist_ok=True)
    with open(f"{root}/{home}/{home}.ann.features.csv", "w") as fh:
        fh.write(",".join(header) + "\n")
        for r in rows:
            fh.write(_line([r[c] for c in header]) + "\n")


def _row(label, hour="3"):
    r = {c: "1" for c in FEATURE_ORDER}
    r["lastSensorEventHours"] = hour
    r["activity"] = label
    return r


def test_headers_bound_by_name(spark, tmpdir_path):
    root = f"{tmpdir_path}/raw"
    header = FEATURE_ORDER + ["activity"]
    permuted = ["activity"] + list(reversed(FEATURE_ORDER))
    _write_home(root, "csh101", header, [_row("r1.Sleep", "3.0"), _row("Laundry")])
    _write_home(root, "csh103", permuted, [_row("Other_Activity", "7")])
    os.makedirs(f"{root}/csh102", exist_ok=True)  # present directory, no file
    assert files.available_groups(spark, root) == ["csh101", "csh103"]
    df = files.load_groups(spark, root, groups=files.group_range("csh", 101, 103))
    got = sorted((r.home_id, r.activity, r.lastSensorEventHours) for r in df.collect())
    assert got == [("csh101", "Laundry", 3), ("csh101", "r1.Sleep", 3), ("csh103", "Other_Activity", 7)]
    assert dict(df.dtypes)["lastSensorEventHours"] == "int"
    assert dict(df.dtypes)["sensorCount-Kitchen"] == "double"


def test_extra_column_diagonal(spark, tmpdir_path):
    root = f"{tmpdir_path}/raw"
    header = FEATURE_ORDER + ["activity"]
    _write_home(root, "csh101", header, [_row("Sleep")])
    r2 = _row("Cook")
    r2["extra"] = "9"
    _write_home(root, "csh104", header + ["extra"], [r2])
    df = files.load_groups(spark, root)
    rows = {r.home_id: r.extra for r in df.collect()}
    assert rows == {"csh101": None, "csh104": "9"}


def test_bad_value_raises_and_missing_file(spark, tmpdir_path):
    root = f"{tmpdir_path}/raw"
    _write_home(root, "csh101", FEATURE_ORDER + ["activity"], [_row("Sleep", "abc")])
    with pytest.raises(Exception):
        files.load_group(spark, "csh101", root).collect()
    with pytest.raises(Exception):
        files.load_group(spark, "csh199", root).collect()
    with pytest.raises(FileNotFoundError):
        files.load_groups(spark, root, groups=["csh150"])


def test_parquet_round_trip_partitioned(spark, tmpdir_path):
    df = spark.createDataFrame([("h1", 1.0), ("h2", 2.0)], "home_id string, x double")
    path = files.save_processed(df, f"{tmpdir_path}/proc")
    assert os.path.isdir(f"{path}/home_id=h1")
    back = files.load_processed(spark, path).filter(F.col("home_id") == "h2")
    assert back.collect()[0].x == 2.0
    with pytest.raises(Exception):
        files.load_processed(spark, f"{tmpdir_path}/absent").collect()


def _write(root, home, text):
    os.makedirs(f"{root}/{home}", exist_ok=True)
    path = f"{root}/{home}/{home}.ann.features.csv"
    with open(path, "w") as fh:
        fh.write(text)
    return path


TYPES = {"x": T.IntegerType(), "activity": T.StringType()}


def test_quotes_and_permuted_headers(spark, tmpdir_path):
    paths = [_write(tmpdir_path, "h1", 'x,activity\n1,"Cook, eat"\n'), _write(tmpdir_path, "h2", 'activity,x\n"a ""b""",2.0\n'),
             _write(tmpdir_path, "h3", "x,activity\n")]
    got = files.read_group_csvs(spark, paths, TYPES)
    assert got.columns == ["x", "activity", "home_id"]
    assert sorted(map(tuple, got.collect())) == [(1, "Cook, eat", "h1"), (2, 'a "b"', "h2")]


@pytest.mark.parametrize("line", ["1", "1,a,b"])
def test_a_damaged_line_fails(spark, tmpdir_path, line):
    path = _write(tmpdir_path, "h1", f"x,activity\n1,a\n{line}\n")
    with pytest.raises(Exception):
        files.read_group_csvs(spark, [path], TYPES).collect()


@pytest.mark.parametrize("header", ["x,label", "x,x,activity"])
def test_a_missing_label_or_repeated_column_fails(spark, tmpdir_path, header):
    with pytest.raises(ValueError):
        files.read_group_csvs(spark, [_write(tmpdir_path, "h1", header + "\n1,2,3\n")], TYPES)


def test_headers_of_all_files_come_from_one_job(spark, tmpdir_path):
    paths = [_write(f"{tmpdir_path}/with space%", f"h{i}", ("x,activity\n" if i % 2 else "activity,x\n") + "1,1\n" * 3) for i in range(40)]
    tracker, group = spark.sparkContext.statusTracker(), "headers-test"
    spark.sparkContext.setJobGroup(group, group)
    found = files.read_headers(spark, paths)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert {h: len(f) for (h, _), f in found.items()} == {("x", "activity"): 20, ("activity", "x"): 20}
    assert jobs <= 6        # whatever the files: listing, the scan and the groups
    assert files.read_group_csvs(spark, paths, TYPES).count() == 120


def test_headers_that_a_line_break_splits_and_empty_files(spark, tmpdir_path):
    path = _write(tmpdir_path, "h1", '"x\ny",activity\n1,a\n')
    got = files.read_group_csvs(spark, [path], {"activity": T.StringType()})
    assert sorted(map(tuple, got.select("x\ny", "activity").collect())) == [("1", "a")]
    with pytest.raises(ValueError):
        files.read_group_csvs(spark, [path, _write(tmpdir_path, "h2", "")], TYPES)
