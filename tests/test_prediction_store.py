"""Stores of predictions: a bounded number of folders, records found by folder and file statistics."""

import os

from pyspark.sql import functions as F

from vitalgrid.sources import tables


def test_many_records_few_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.range(20_000).selectExpr("concat('r', id) record", "id % 3 epoch", "'x' class", "0D y_true", "1D y_pred")
    tables.write_predictions(rows, path, 30)
    folders = [d for d in os.listdir(path) if d.startswith("folder=")]
    assert len(folders) == tables.FOLDERS
    assert sum(f.endswith(".parquet") for d in folders for f in os.listdir(f"{path}/{d}")) == tables.FOLDERS
    back = tables.read_predictions(spark, path)
    assert set(back.columns) == {*rows.columns, "fs"}
    assert back.select(rows.columns).exceptAll(rows).count() == 0 and back.count() == 20_000
    one = tables.read_predictions(spark, path, ["r77", "r19999"])
    assert sorted(r.record for r in one.collect()) == ["r19999", "r77"]
    assert len(one.select(F.input_file_name()).distinct().collect()) <= 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "folder" in plan.split("PartitionFilters:")[1].split("]")[0]
    assert "In(record" in plan.split("PushedFilters:")[1]


def test_a_folder_per_record_and_no_rows(spark, tmp_path):
    rows = spark.sql("select 'a' record, 0L epoch, 'x' class, 0D y_true, 1D y_pred union all select 'b', 0L, 'x', 0D, 1D")
    tables.write_predictions(rows, str(tmp_path / "each"), 30, folders=None)
    assert {d for d in os.listdir(tmp_path / "each") if "=" in d} == {"record=a", "record=b"}
    tables.write_predictions(rows, str(tmp_path / "one"), 30, folders=1)
    assert tables.read_predictions(spark, str(tmp_path / "one"), [], folders=1).count() == 0
