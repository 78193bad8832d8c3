"""Uploads: what is stored, set aside and refused."""

import os
import re

import pytest
from pyspark.sql import functions as F

from levelmark.plans.ingest import Upload, ingest, ingest_folder
from levelmark.schemas import FRAMEWORK_COLUMNS, LISTING_COLUMNS, publish
from levelmark.sources import sinks
from levelmark.sources.sinks import clear_inputs

LISTING = [
    ("c1", "['a', 'b']", "t", "about", "l", 1),
    ("c1", "[broken]", "t", "about", "l", 2),
    ("c2", " plain ", "t", "about", "l", 3),
    ("c2", " plain ", "t2", "about", "l", 4),
    ("c3", "[]", "t", None, "l", 5),
    ("c4", None, "t", None, "l", 6),
]


def upload(spark, title="Skills Title 2K", file="SFW_Human Resource.csv", rows=LISTING):
    headers = [title if name == "Skill Title" else f" {name}" for name in LISTING_COLUMNS]
    listing = spark.createDataFrame(rows, ", ".join(f"c{i} string" for i in range(5)) + ", src_row long").toDF(*headers, "src_row")
    framework = spark.createDataFrame([("x",) * 6 + (1,) + ("x",) * 3], [f"c{i}" for i in range(10)]).toDF(*FRAMEWORK_COLUMNS)
    files = [spark.createDataFrame([(path, 1)], "path string, length long") for path in (file, "HR_Human Resource_sector_course_listing.csv")]
    return Upload(framework, listing, *files, alias="HR", order=["src_row"], required=["about"])


@pytest.mark.parametrize("title", ["Skills Title 2K", "Skill Title "])
def test_lists_are_taken_apart_and_unreadable_cells_kept(spark, tmp_path, title):
    assert ingest(upload(spark, title), str(tmp_path), "20240102_0304")
    stored = spark.read.parquet(f"{tmp_path}/role=listing")
    got = sorted((r["course_ref"], r["skill_title"], r["course_title"]) for r in stored.collect())
    assert got == [("c1", "a", "t"), ("c1", "b", "t"), ("c2", " plain ", "t")]
    assert [r["skill_title"] for r in spark.read.parquet(f"{tmp_path}/rejected").collect()] == ["[broken]"]
    report = spark.read.parquet(f"{tmp_path}/report").collect()
    assert {(r["rule"], r["n_bad"]) for r in report} >= {("list_cell", 1)}


@pytest.mark.parametrize("fault", [{"file": "Other.csv"}, {"rows": []}, {"title": "Another"}, {"rows": [("c1", "[open", "t", "about", "l", 1)]}])
def test_a_failing_upload_stores_its_report_only(spark, tmp_path, fault):
    assert not ingest(upload(spark, **fault), str(tmp_path), "20240102_0304")
    assert os.listdir(tmp_path) == ["report"]
    assert all(r["message"] for r in spark.read.parquet(f"{tmp_path}/report").collect())


def uploaded(spark, folder, framework="SFW_Human Resource.csv", listing="HR_Human Resource_sector_course_listing.csv", rows=LISTING):
    made = upload(spark, rows=rows)
    frame = made.framework.withColumn("level", F.lit("3.0")) if framework.endswith("csv") else made.framework
    for name, df in ((framework, publish(frame, FRAMEWORK_COLUMNS)), (listing, publish(made.listing.drop("src_row"), LISTING_COLUMNS))):
        write = sinks.write_csv if name.endswith("csv") else sinks.write_parquet
        write(df.coalesce(1), f"{folder}/{name}")


@pytest.mark.parametrize("framework", ["SFW_Human Resource.csv", "SFW_Human Resource.parquet"])
def test_a_folder_is_ingested(spark, tmp_path, framework):
    uploaded(spark, f"{tmp_path}/in", framework)
    passed, stamp = ingest_folder(spark, f"{tmp_path}/in/", "HR", f"{tmp_path}/out", required=["about"])
    assert passed and re.fullmatch(r"\d{8}_\d{4}", stamp)
    stored = spark.read.parquet(f"{tmp_path}/out/role=listing")
    got = sorted((r["course_ref"], r["skill_title"], r["run_ts"]) for r in stored.collect())
    assert got == [("c1", "a", stamp), ("c1", "b", stamp), ("c2", " plain ", stamp)]
    topics = spark.read.parquet(f"{tmp_path}/out/role=framework").collect()
    assert [r["level"] for r in topics] == [3 if framework.endswith("csv") else 1]
    clear_inputs(spark, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/role=listing").count() == spark.read.parquet(f"{tmp_path}/out/report").count() == 0


def test_folders_that_are_refused(spark, tmp_path):
    uploaded(spark, f"{tmp_path}/named", listing="HR_Food.csv")
    uploaded(spark, f"{tmp_path}/kind", listing="HR_Human Resource_sector_course_listing.xlsx.txt")
    os.makedirs(f"{tmp_path}/empty")
    for name in ("SFW_Human Resource.csv", "HR_Human Resource_sector_course_listing.csv"):
        open(f"{tmp_path}/empty/{name}", "w").close()
    os.makedirs(f"{tmp_path}/nothing")
    rules = {}
    for name in ("named", "kind", "empty", "nothing"):
        passed, stamp = ingest_folder(spark, f"file:{tmp_path}/{name}", "HR", f"{tmp_path}/out/{name}", "20240102_0304")
        report = spark.read.parquet(f"{tmp_path}/out/{name}/report").collect()
        assert not passed and stamp == "20240102_0304" and all(r["message"] for r in report)
        rules[name] = sorted((r["dataset"], r["rule"]) for r in report if r["rule"] != "list_cell")
    assert rules == {
        "named": [("listing", "suffix")],
        "kind": [("listing", "format"), ("listing", "missing_file")],
        "empty": [(d, r) for d in ("framework", "listing") for r in ("empty_file", "missing_file")],
        "nothing": [(d, "missing_file") for d in ("framework", "listing")],
    }


@pytest.mark.parametrize("rows_per_file", [1, 2])
def test_the_size_limit_is_one_of_each_file(spark, tmp_path, rows_per_file):
    """Two parts of 0.6 MB make a listing of over 1 MB: only as one file it is too large."""
    made = upload(spark, rows=[(f"c{i}", f"title {i}", "t", "a" * 600_000, "l", i) for i in range(2)])
    listing = publish(made.listing.drop("src_row"), LISTING_COLUMNS).coalesce(1)
    sinks.write_csv(publish(made.framework, FRAMEWORK_COLUMNS), f"{tmp_path}/in/SFW_Human Resource.csv")
    sinks.write_csv(listing, f"{tmp_path}/in/HR_Human Resource_sector_course_listing.csv", rows_per_file)
    passed, _ = ingest_folder(spark, f"{tmp_path}/in", "HR", f"{tmp_path}/out", "20240102_0304", ["about"], max_mb=1)
    assert passed == (rows_per_file == 1)
    report = {r["rule"] for r in spark.read.parquet(f"{tmp_path}/out/report").collect()}
    assert ("too_large" in report) == (rows_per_file == 2)
