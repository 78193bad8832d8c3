"""Files: listings, CSV across splits, footers, versions of results."""

import csv
import os
import random
import types

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmark.sources import csv_records, folder_files, profiles, scans, shared, sinks, versions

SPLIT = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes."""

    def use(size):
        spark.conf.set(SPLIT, size)
        spark.conf.set(COST, 1)

    yield use
    spark.conf.unset(SPLIT)
    spark.conf.unset(COST)


def whole_file(spark, path, schema):
    """Spark's own reader, one task per file."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    return reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_open_cells():
    closed = ["", "a,b", '"a",b', 'a"b,c', '"a ""b"" c",d', '"",""', 'a,"b" c,d', ' "a,b']
    opened = ['"a', 'a,"', 'a,"b""', 'x,"y ""z""', '"a",b,"c,d']
    assert not any(csv_records.open_at_end(x, False) for x in closed)
    assert all(csv_records.open_at_end(x, False) for x in opened)
    assert csv_records.open_at_end("no quote, here", True) and csv_records.open_at_end('""', True)
    assert not csv_records.open_at_end('end", next', True) and csv_records.open_at_end('end","next', True)


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("one", "two words", "It's three")])


def random_files(folder, seed, ends="\n"):
    draw = random.Random(seed)
    pieces = ["a", "b c", ",", '"', '""', "\n", "\r\n", "é", " ", "", "日本", "x" * 30, "'", "\n\n", '",', ',"']
    os.makedirs(folder)
    for n in range(3):
        with open(f"{folder}/f{n}.csv", "w", encoding="utf-8", newline="") as out:
            writer = csv.writer(out, lineterminator=ends)
            writer.writerow(SCHEMA.names)
            for _ in range(draw.randint(0, 25)):
                # an empty first cell would make an empty line of a record
                writer.writerow(["k" + "".join(draw.choices(pieces, k=draw.randint(0, 6))) for _ in SCHEMA.names])


@pytest.mark.parametrize("seed, size, ends", [(1, 23, "\n"), (2, 64, "\r\n"), (3, 300, "\n"), (4, 100_000, "\r\n")])
def test_csv_over_splits(spark, tmp_path, small_splits, seed, size, ends):
    random_files(f"{tmp_path}/csv", seed, ends)
    expected = []
    for name in os.listdir(f"{tmp_path}/csv"):
        with open(f"{tmp_path}/csv/{name}", encoding="utf-8", newline="") as f:
            expected += [tuple(c or None for c in row) for row in list(csv.reader(f))[1:]]
    small_splits(size)
    found = scans.read_csv(spark, f"{tmp_path}/csv", SCHEMA)
    assert rows_of(found) == sorted(expected, key=repr)
    if ends == "\n":  # the reader of whole files turns the line breaks in cells into the file's
        assert rows_of(whole_file(spark, f"{tmp_path}/csv", SCHEMA)) == sorted(expected, key=repr)


def test_csv_takes_a_task_per_split(spark, tmp_path, small_splits):
    with open(f"{tmp_path}/one.csv", "w", newline="") as out:
        csv.writer(out).writerows([("one", "two", "three"), *((i, "line\nbreak, " * 5, "x") for i in range(2000))])
    small_splits(10_000)
    lines = csv_records.physical_lines(spark, f"{tmp_path}/one.csv")
    assert lines.rdd.getNumPartitions() >= os.path.getsize(f"{tmp_path}/one.csv") // 10_000
    records = csv_records.csv_records(spark, f"{tmp_path}/one.csv")
    assert records.count() == 2000 and records.select("start").distinct().count() > 10


def test_odd_csv_files(spark, tmp_path, small_splits):
    texts = {
        "empty": "",
        "header": "one,two,three\n",
        "mark": '﻿"one",two,three\n1,2,3\n',
        "blank": "\n\none,two,three\n\n1,2,3\n\n\n4,5,6",
        "stray": 'one,two,three\n5" disk,b,c\nd,6" x 7",f\n',
        "unclosed": 'one,two,three\n1,2,3\n4,"5\n6,7',
        "short": "one,two,three\n1\n1,2,3,4\n",
        "long": "one,two,three\n" + '1,"' + "a\n" * 300 + '",3\n4,5,6\n',
    }
    for name, text in texts.items():
        os.makedirs(f"{tmp_path}/{name}")
        with open(f"{tmp_path}/{name}/f.csv", "w", encoding="utf-8", newline="") as out:
            out.write(text)
        for size in (5, 1000):
            small_splits(size)
            assert rows_of(scans.read_csv(spark, f"{tmp_path}/{name}", SCHEMA)) == rows_of(whole_file(spark, f"{tmp_path}/{name}", SCHEMA)), name


def test_malformed_records_keep_their_text(spark, tmp_path, small_splits):
    os.makedirs(f"{tmp_path}/csv")
    with open(f"{tmp_path}/csv/f.csv", "w", newline="") as out:
        out.write('name,size\nok,1\n"bad\none",x\nok2,3\n')
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("size", T.IntegerType())])
    for size in (4, 1000):
        small_splits(size)
        table = sinks.convert_csv(spark, f"{tmp_path}/csv", schema, f"{tmp_path}/out{size}")
        assert rows_of(table.select("name", "size", sinks.BAD_RECORD)) == [("bad\none", None, '"bad\none",x'), ("ok", 1, None), ("ok2", 3, None)]
        assert table.where(F.col("src_file").endswith("/csv/f.csv")).count() == 3


def test_listing_holds_every_file(spark, tmp_path, monkeypatch):
    sizes = {"a.csv": 0, "b/c.csv": 3, "b/d/e.txt": 5, "b/d/g h%20i.csv": 1, "x=1/y=2/f.csv": 0, "_hidden/f.csv": 1, ".dot.csv": 1, "_x=1/k.csv": 2}
    for name, size in sizes.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "w") as out:
            out.write("z" * size)
    seen = {n: s for n, s in sizes.items() if not n.startswith("_hidden") and not n.startswith(".")}

    def listed(folder=str(tmp_path), **options):
        return {r["path"].removeprefix(f"file:{tmp_path}/"): r["length"] for r in scans.list_files(spark, folder, **options).collect()}

    assert listed() == listed(f"file://{tmp_path}/") == listed(f"file:{tmp_path}") == seen
    assert listed(pattern="*.txt") == {"b/d/e.txt": 5} and listed(recursive=False) == {"a.csv": 0}
    reader = folder_files.FolderReader({"path": str(tmp_path)})
    assert {p.below for p in reader.partitions()} == {False}
    monkeypatch.setattr(folder_files, "SPREAD", 2)
    parts = reader.partitions()
    assert {p.below for p in parts} == {False, True} and sum(b.num_rows for p in parts for b in reader.read(p)) == len(seen)
    newest = scans.list_files(spark, str(tmp_path)).select(F.max("modificationTime").alias("t")).first()["t"]
    assert abs(newest.timestamp() - max(os.path.getmtime(f"{tmp_path}/{n}") for n in seen)) < 1
    with pytest.raises(Exception, match="(?i)no such|not exist|cannot|missing"):
        scans.list_files(spark, f"{tmp_path}/missing").collect()


BUCKETS = "bucket string, n int"


def published(spark, root, part, rows):
    return versions.publish(spark.createDataFrame(rows, BUCKETS), root, part)


def stored(spark, root):
    return sorted((r["part"], r["bucket"], r["n"]) for r in versions.read_current(spark, root).collect())


def test_results_appear_at_once(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/results"
    published(spark, root, "HR", [("valid", 1), ("invalid", 2)])
    published(spark, root, "FIN", [("valid", 3)])
    before = stored(spark, root)
    reading = versions.read_current(spark, root)

    def half(x):  # the writer dies after the first bucket
        if x > 7:
            raise OSError("stopped")
        return x

    failing = spark.createDataFrame([("valid", 7), ("zzz", 8)], BUCKETS).repartitionByRange(2, "bucket")
    failing = failing.withColumn("n", F.udf(half, "int")("n"))
    with pytest.raises(Exception, match="stopped"):
        versions.publish(failing, root, "HR")
    assert stored(spark, root) == before

    # it dies between the version and the manifest
    with monkeypatch.context() as patch:
        patch.setattr(versions, "current", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            published(spark, root, "HR", [("valid", 9)])
    assert stored(spark, root) == before

    published(spark, root, "HR", [("valid", 9)])
    assert stored(spark, root) == [("FIN", "valid", 3), ("HR", "valid", 9)]
    # who began to read earlier still finds the former version
    assert sorted((r["part"], r["n"]) for r in reading.collect()) == [("FIN", 3), ("HR", 1), ("HR", 2)]


def test_old_versions_go_and_clearing_is_a_version(spark, tmp_path):
    root = f"{tmp_path}/results"
    names = [published(spark, root, "HR", [("valid", n)]) for n in range(4)]
    assert sorted(os.listdir(f"{root}/parts/HR")) == sorted(names[-versions.KEPT :])
    versions.clear(spark, root)
    assert stored(spark, root) == []
    published(spark, root, "HR", [])
    assert versions.read_current(spark, root).count() == 0
    versions.clear(spark, f"{tmp_path}/never")
    with pytest.raises(FileNotFoundError):
        versions.read_current(spark, f"{tmp_path}/never")


def test_footers(spark, tmp_path):
    rows = [(i, f"t{i}" if i % 3 else None, float(i) / 4) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, text string, x double").repartitionByRange(3, "id")
    sinks.write_parquet(df, f"{tmp_path}/table", "zstd")
    profile = profiles.parquet_profile(spark, f"{tmp_path}/table").first()
    on_disk = sum(p.stat().st_size for p in tmp_path.glob("table/*.parquet"))
    assert profile.asDict() == {"n_files": 3, "bytes": on_disk, "n_row_groups": 3, "n_rows": 1000, "n_columns": 3, "column_names": "id,text,x"}
    columns = {r["column_name"]: r for r in profiles.column_profile(spark, f"{tmp_path}/table").collect()}
    assert [(columns[c]["n_rows"], columns[c]["n_nulls"], columns[c]["codecs"]) for c in ("id", "text", "x")] == [(1000, n, "zstd") for n in (0, 334, 0)]
    assert [(columns[c]["low"], columns[c]["high"]) for c in ("id", "text", "x")] == [("0", "999"), ("t1", "t998"), ("0.0", "249.75")]
    (one, *_) = tmp_path.glob("table/*.parquet")
    assert profiles.parquet_profile(spark, str(one)).first()["n_files"] == 1


def test_shared_folder(spark, tmp_path, monkeypatch):
    path = shared.scratch_path(spark, "x")
    assert path.startswith(shared.own_dir(spark)) and spark.sparkContext.applicationId in path
    sinks.write_parquet(spark.range(3), f"{tmp_path}/gone/x")
    monkeypatch.setattr(shared, "own_dir", lambda _: f"file:{tmp_path}/gone")
    assert shared.released(spark) and not os.path.exists(f"{tmp_path}/gone") and not shared.released(spark)

    class Session:
        def __init__(self, master, store, folder=None):
            settings = {"spark.sql.warehouse.dir": store, shared.CHECKPOINT_SETTING: folder}
            self.conf = types.SimpleNamespace(get=lambda name, default=None: settings[name] or default)
            self.sparkContext = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None)

    assert shared.shared_dir(Session("local[8]", "file:/w/")) == "file:/w/shared"
    assert shared.shared_dir(Session("spark://x", "hdfs://n/w")) == "hdfs://n/w/shared"
    assert shared.shared_dir(Session("yarn", "file:/w", "hdfs://n/c/")) == "hdfs://n/c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session("yarn", "file:/w"))
