"""Files of one split each are read once; with one of several splits among them, as before."""

import gzip

import pytest

from levelmark.sources.csv_records import any_file_cut, csv_records, physical_lines

SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture
def small_splits(spark):
    before = [spark.conf.get(s) for s in SETTINGS]
    for s in SETTINGS:
        spark.conf.set(s, "64")
    yield
    for s, value in zip(SETTINGS, before, strict=True):
        spark.conf.set(s, value)


def record(i):
    return f'{i},"a ""{i}""\n\nb, {i}",{"x" * (i % 7)}'


def records_of(spark, path):
    rows = csv_records(spark, str(path)).orderBy("src_file", "start", "number").collect()
    out = {}
    for r in rows:
        out.setdefault(r["src_file"].rsplit("/", 1)[1], []).append(r["record"])
    return out


def test_uncut_files_are_scanned_once(spark, tmp_path):
    for n in range(3):
        (tmp_path / f"part {n}.csv").write_text("h\n" + "\n".join(record(i) for i in range(20)) + "\n")
    df = csv_records(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Exchange" not in plan
    assert records_of(spark, tmp_path) == {f"part%20{n}.csv": [record(i) for i in range(20)] for n in range(3)}


def test_cut_and_whole_files_together(spark, tmp_path, small_splits):
    (tmp_path / "long one.csv").write_text("h\n" + "\n".join(record(i) for i in range(60)) + "\n")
    (tmp_path / "short.csv").write_text('h\n1,"open\r\n2\r\n')  # a cell that is never closed
    with gzip.open(tmp_path / "packed.csv.gz", "wt", newline="") as f:
        f.write("h\r\n" + "\r\n".join(record(i) for i in range(60)) + "\r\n")
    assert any_file_cut(physical_lines(spark, str(tmp_path)))
    assert not any_file_cut(physical_lines(spark, str(tmp_path / "packed.csv.gz")))
    assert records_of(spark, tmp_path / "short.csv") == {"short.csv": ['1,"open\r\n2\r']}
    found = records_of(spark, tmp_path)
    assert found["long%20one.csv"] == found["packed.csv.gz"] == [record(i) for i in range(60)]
    assert found["short.csv"] == ['1,"open\r\n2\r']


def test_no_rows_where_only_the_header_is(spark, tmp_path):
    (tmp_path / "a.csv").write_text("h,k\n")
    assert csv_records(spark, str(tmp_path)).count() == 0
