"""Stored runs: invariants, resume, streaming, sources and sinks."""

import hashlib
import json
import os
import pathlib
import random
import shutil

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from levelmark.plans import runs
from levelmark.plans.rounds import work_identity
from levelmark.plans.runs import RunSettings, RunStore, run_two_rounds
from levelmark.schemas import FILE_ORDER, FRAMEWORK_COLUMNS, LISTING_COLUMNS, framework_schema, listing_schema, shorten
from levelmark.sources import profiles, scans, sinks
from levelmark.sources.shared import shared_dir, written
from levelmark.streaming import microbatch
from levelmark.streaming.microbatch import read_batches, stream_listing

FRAMEWORK = [
    ("t", "c", "Human Resource", "g", "Excel", None, 1, "basic", "knowledge", "open files"),
    ("t", "c", "Human Resource", "g", "EXCEL", None, 2, "good", "ability", "pivot tables"),
    ("t", "c", "Human Resource", "g", "SQL", None, 3, "joins", "knowledge", "joins"),
    ("t", "c", "Food", "g", "Cooking", None, 1, "boil", "ability", "boil water"),
]
LISTING = [
    ("c1", " excel ", "T1", "about 1", "learn 1"),
    ("c1", "Excel", "T1b", "about 1b", "learn 1b"),
    ("c1", "SQL", "T1", "about 1", "learn 1"),
    ("c2", "Cooking", "T2", "about 2", "learn 2"),
    ("c3", "EXCEL", "T3", "about 3", "learn 3"),
    ("c4", "Excel", "T3", "about 3", "learn 3"),
    ("c5", "SQL", None, "about 5", "learn 5"),
    ("c6", "sql", "T6", "about 6", "learn 6"),
]
LEVELS1 = {"T1": "1", "T3": 6, "T6": 0}
LEVELS2 = {"T1": 3, "T3": 2, "T6": 5}


class Calls:
    """Scorers that write every prompt they see to a folder."""

    def __init__(self, folder):
        self.folder = folder

    def make(self, levels, field, fail_on=()):
        folder = str(self.folder)

        def make():
            import pathlib
            import uuid

            def call(system, prompt):
                title = next(t for t in levels if t in prompt)
                pathlib.Path(folder, uuid.uuid4().hex).write_text(f"{field} {title}")
                if title in fail_on:
                    raise TimeoutError("later")
                return json.dumps({field: levels[title], "reason": f"{field} {title}", "confidence": "high"})

            return call

        return make

    def seen(self):
        return sorted(p.read_text() for p in self.folder.iterdir())


@pytest.fixture
def inputs(spark, tmp_path):
    folder = f"{tmp_path}/inputs"
    fw = spark.createDataFrame(FRAMEWORK, framework_schema()).coalesce(1)
    li = spark.createDataFrame(LISTING, listing_schema()).coalesce(1)
    sinks.write_parquet(fw, f"{folder}/SFW_Human Resource.parquet")
    sinks.write_parquet(li, f"{folder}/HR_Human Resource_sector_course_listing.parquet")
    return folder


@pytest.fixture
def calls(tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    return Calls(folder)


def settings(calls, **kwargs):
    fail = kwargs.pop("fail_on", ())
    return RunSettings(
        sectors=["Human Resource"],
        alias="HR",
        make_scorer1=calls.make(LEVELS1, "proficiency_level", fail),
        make_scorer2=calls.make(LEVELS2, "proficiency"),
        order=FILE_ORDER,
        partitions=2,
        **kwargs,
    )


def run(spark, inputs, root, settings_):
    framework, listing = scans.read_framework(spark, inputs), scans.read_listing(spark, inputs)
    return run_two_rounds(spark, framework, listing, root, settings_)


def outcome(results):
    return sorted((r["bucket"], r["course_ref"], r["skill_key"], r["level"], r["reason"]) for r in results.collect())


EXPECTED = [
    ("all_tagged", "c1", "excel", 1, "proficiency_level T1"),
    ("all_tagged", "c1", "sql", 3, "proficiency T1"),
    ("all_tagged", "c3", "excel", 2, "proficiency T3"),
    ("all_tagged", "c4", "excel", 2, "proficiency T3"),
    ("invalid", "c6", "sql", 0, "proficiency_level T6"),
    ("valid", "c1", "sql", 1, "proficiency_level T1"),
    ("valid", "c3", "excel", 6, "proficiency_level T3"),
    ("valid", "c4", "excel", 6, "proficiency_level T3"),
]


def test_full_run(spark, inputs, calls, tmp_path):
    results = run(spark, inputs, f"{tmp_path}/run", settings(calls))
    assert outcome(results) == EXPECTED
    # c3 and c4 share title, text and skill: one call in round two.
    assert calls.seen().count("proficiency T3") == 1
    tagged = spark.read.parquet(f"{tmp_path}/run/tagged")
    assert {(r["bucket"], r["n"]) for r in tagged.groupBy("bucket").agg(F.count("*").alias("n")).collect()} == {
        ("irrelevant", 1),
        ("r1_valid", 1),
        ("r1_invalid", 4),
    }
    state = RunStore(spark, f"{tmp_path}/run").state().first()
    assert (state["round"], state["n_total"], state["n_done"], state["progress"], state["sector"]) == ("r2", 3, 3, 1.0, "HR")
    assert profiles.run_complete(results).first().asDict() == {"n_results": 3, "complete": True}
    promoted = results.where("bucket = 'all_tagged' AND skill_key = 'excel' AND course_ref = 'c3'").first()
    assert promoted["skill_title"] == "EXCEL" and promoted["level2"] is None


def test_resume_scores_only_what_is_pending(spark, inputs, calls, tmp_path):
    root = f"{tmp_path}/run"
    run(spark, inputs, root, settings(calls, fail_on=("T1",)))
    first = calls.seen()
    results = run(spark, inputs, root, settings(calls, chunks=3))
    assert outcome(results) == EXPECTED
    again = calls.seen()
    for call in set(again):
        # Only the failed calls of round one are made a second time.
        assert again.count(call) - first.count(call) == (2 if call == "proficiency_level T1" else 0)
    assert outcome(run(spark, inputs, root, settings(calls))) == EXPECTED
    assert calls.seen() == again
    RunStore(spark, root).clear()
    assert RunStore(spark, root).state().count() == 0
    assert outcome(run(spark, inputs, root, settings(calls))) == EXPECTED
    assert len(calls.seen()) > len(again)
    store = RunStore(spark, root)
    store.clear_all()
    stored = [n for n in store.tables() if n != "inputs"]
    assert {n: spark.read.parquet(store.path(n)).count() for n in stored} == dict.fromkeys(stored, 0)


def test_a_run_without_relevant_rows_completes(spark, inputs, calls, tmp_path):
    framework = scans.read_framework(spark, inputs)
    listing = scans.read_listing(spark, inputs).where("skill_title = 'Cooking'")
    assert run_two_rounds(spark, framework, listing, f"{tmp_path}/run", settings(calls)).count() == 0


def jobs_so_far(spark):
    return max(spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None), default=-1)


def test_chunks_cost_the_same_however_many(spark, tmp_path, monkeypatch):
    """Each chunk takes as many jobs, and reads its own part of the work and of the answers."""
    rows = [(f"c{i}", "Excel" if i % 3 else "SQL", f"T{i}", "a", "b", "f", i) for i in range(200)]
    listing = spark.createDataFrame(rows, ["course_ref", "skill_title", "course_title", "about", "learn", "src_file", "src_row"])
    framework = shorten(spark.createDataFrame(FRAMEWORK, framework_schema()), FRAMEWORK_COLUMNS).withColumns({"src_file": F.lit("f"), "src_row": F.lit(1)})
    answer = lambda system, prompt: '{"proficiency_level": 1, "proficiency": 2}'
    steps = {}
    for chunks in (2, 20):
        jobs, reads = [], []

        def noted(work, answers, before=runs.pending):
            jobs.append(jobs_so_far(spark))
            files = [len(df.inputFiles()) for df in (work, answers)]
            reads.append((work.count(), answers.count(), files[1]))
            return before(work, answers)

        root = f"{tmp_path}/run{chunks}"
        made = RunSettings(["Human Resource"], "HR", lambda: answer, lambda: answer, FILE_ORDER, partitions=2, chunks=chunks)
        for again in (False, True):
            if again:
                monkeypatch.setattr(runs, "pending", noted)
            run_two_rounds(spark, framework, listing, root, made)
            monkeypatch.undo()
        assert len(jobs) == 2 * chunks
        # what the chunks read adds up to the work and the answers once, in each round
        assert [sum(r[i] for r in reads[:chunks]) for i in (0, 1)] == [200, 200]
        assert [sum(r[i] for r in reads[chunks:]) for i in (0, 1)] == [67, 67]
        states = sorted(spark.read.parquet(f"{root}/state").collect(), key=lambda s: s["saved_at"])
        assert len(states) == 4 * chunks and states[-1]["n_done"] == states[-1]["n_total"] == 67
        gaps = {b - a for a, b in zip(jobs[: chunks - 1], jobs[1:chunks])}
        steps[chunks] = max(gaps)
        first = [s["n_done"] for s in states if s["round"] == "r1"][:chunks]
        assert first == sorted(first) and first[-1] == 200 and (chunks == 2 or first[0] < 200)
    assert steps[2] == steps[20]


def stream(spark, source, framework, root, settings_):
    return stream_listing(spark, source, listing_schema(), framework, root, settings_, prepare=lambda df: shorten(df, LISTING_COLUMNS))


def arrive(spark, source, rows):
    spark.createDataFrame(rows, listing_schema()).coalesce(1).write.mode("append").parquet(source)


def test_micro_batches(spark, inputs, calls, tmp_path):
    source, root = f"{tmp_path}/arriving", f"{tmp_path}/stream"
    framework = scans.read_framework(spark, inputs)
    # c1 with its skills comes again and is not tagged twice.
    for rows in (LISTING[:4], LISTING[2:], LISTING[:3]):
        arrive(spark, source, rows)
        assert stream(spark, source, framework, root, settings(calls)).awaitTermination(120)
    results = read_batches(spark, root, "results")
    assert outcome(results) == EXPECTED
    assert sorted(r["batch"] for r in results.select("batch").distinct().collect()) == [0, 1]
    assert len(calls.seen()) == 8  # five in round one, three contents in round two
    # what passed the state is stored once, however often it came
    arrived = read_batches(spark, root, "arrivals").groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in arrived} == {"work": 7, "course": 6}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").count("RocksDB") == 0


def test_three_batches_equal_one_run(spark, inputs, calls, tmp_path):
    """Rows in random order with repeats and other texts: the first row of a course
    describes it in every batch, the first of a course and skill is tagged."""
    draw = random.Random(2)
    rows = [(f"c{draw.randint(1, 9)}", draw.choice(["Excel", " excel", "SQL", "Cooking", None]), draw.choice(["T1", "T3", "T6"]),
             draw.choice(["a", "b", None]), "l") for _ in range(60)] + [(None, "Excel", "T1", "a", "l")] * 2
    framework = scans.read_framework(spark, inputs)
    source, root = f"{tmp_path}/arriving", f"{tmp_path}/stream"
    for n, part in enumerate((rows[:20], rows[20:25], rows[25:])):
        # names in order of arrival: one run reads the files in this order
        spark.createDataFrame(part, listing_schema()).coalesce(1).write.parquet(f"{tmp_path}/made{n}")
        os.makedirs(source, exist_ok=True)
        (made,) = pathlib.Path(f"{tmp_path}/made{n}").glob("part-*.parquet")
        shutil.copy(made, f"{source}/f{n}.parquet")
        assert stream(spark, source, framework, root, settings(calls)).awaitTermination(120)
    whole = shorten(scans.with_file_order(spark.read.parquet(source)), LISTING_COLUMNS)
    once = run_two_rounds(spark, framework, whole, f"{tmp_path}/once", settings(calls))
    assert outcome(read_batches(spark, root, "results")) == outcome(once)


def test_a_stopped_batch_scores_nothing_twice(spark, inputs, calls, tmp_path, monkeypatch):
    source, root = f"{tmp_path}/arriving", f"{tmp_path}/stream"
    framework = scans.read_framework(spark, inputs)
    arrive(spark, source, LISTING[:4])
    assert stream(spark, source, framework, root, settings(calls)).awaitTermination(120)

    def stopped(*_):
        raise OSError("stopped")

    arrive(spark, source, LISTING[2:])
    with monkeypatch.context() as patch:
        patch.setattr(microbatch, "write_buckets", stopped)
        with pytest.raises(StreamingQueryException):
            stream(spark, source, framework, root, settings(calls)).awaitTermination(120)
    before = calls.seen()
    assert stream(spark, source, framework, root, settings(calls)).awaitTermination(120)
    assert calls.seen() == before and outcome(read_batches(spark, root, "results")) == EXPECTED


def test_sources_and_sinks(spark, inputs, tmp_path):
    fw = scans.read_framework(spark, inputs)
    assert set(FRAMEWORK_COLUMNS.values()) <= set(fw.columns) and fw.count() == 4
    li = scans.read_listing(spark, inputs, ["Course Reference Number", "Skill Title"])
    assert li.columns == ["course_ref", "skill_title", *FILE_ORDER] and li.count() == 8

    texts = [
        ("c1", 'say "hi", \n twice', " edge ", "", None),
        ("c2", "a\r\nb\rc", "back\\", 'q\\"q"', "#x"),
        ("c3", "é　日本", "\t", "'", ","),
    ]
    df = spark.createDataFrame(texts, listing_schema())
    sinks.write_csv(df, f"{tmp_path}/csv")
    back = scans.read_csv(spark, f"{tmp_path}/csv").orderBy("`Course Reference Number`").collect()
    # CSV cannot tell empty text from null.
    assert [tuple(r) for r in back] == [tuple(c or None for c in row) for row in texts]

    root = f"{tmp_path}/buckets"
    for alias, rows in [("HR", [("valid", 1), ("invalid", 2)]), ("FIN", [("valid", 3)]), ("HR", [("valid", 9)])]:
        sinks.write_results(spark.createDataFrame(rows, "bucket string, n int"), root, alias)
    stored = scans.read_results(spark, root).collect()
    assert sorted((r["sector"], r["bucket"], r["n"]) for r in stored) == [("FIN", "valid", 3), ("HR", "valid", 9)]

    sinks.write_inputs(df, df, f"{tmp_path}/stored", "20250101_0000")
    sinks.write_inputs(df, df, f"{tmp_path}/stored", "20250102_0000")
    assert scans.read_role(spark, f"{tmp_path}/stored", "listing").count() == 6

    empty = df.where("false")
    sinks.write_parquet(empty, f"{tmp_path}/empty")
    assert scans.read_parquet(spark, f"{tmp_path}/empty", ["Skill Title"]).count() == 0
    assert written(df, "copy").count() == 3
    assert shared_dir(spark)
    profile = profiles.parquet_profile(spark, f"{tmp_path}/stored").first()
    assert profile["n_files"] >= 4 and profile["bytes"] > 0 and profile["n_rows"] == 12


def test_file_listings(spark, tmp_path):
    for name, text in [("b_20250102.csv", "x"), ("a_20250103.csv", "yy"), ("c.parquet", ""), ("d e.csv", "")]:
        (tmp_path / name).write_text(text)
    files = scans.list_files(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1]: r["length"] for r in files.collect()} == {
        "b_20250102.csv": 1,
        "a_20250103.csv": 2,
        "c.parquet": 0,
        "d e.csv": 0,
    }
    counts = {r["suffix"]: (r["n_files"], r["n_convertible"]) for r in profiles.extension_counts(files).collect()}
    assert counts == {"csv": (3, 3), "parquet": (1, 0)}
    assert scans.latest_file(files).first()["path"].endswith("d e.csv")
    assert scans.latest_file(files.where("length > 0")).first()["path"].endswith("b_20250102.csv")
    assert scans.latest_file(files, by_time=True).count() == 1
    assert scans.size_check(files, max_mb=0).where("size_ok").count() == 2


def test_conversion_keeps_malformed_lines(spark, tmp_path):
    (tmp_path / "one.csv").write_text("n,s\n1,a\nx,b\n")
    (tmp_path / "two.csv").write_text('n,s\n2,"c\nd"\n')
    table = sinks.convert_csv(spark, f"{tmp_path}/*.csv", framework_like(), f"{tmp_path}/out")
    report = sinks.conversion_report(table, F.regexp_extract("src_file", r"([^/]+)$", 1))
    assert {(r["source"], r["n_good"], r["n_bad"]) for r in report.collect()} == {("one.csv", 1, 1), ("two.csv", 1, 0)}


def framework_like():
    from pyspark.sql import types as T

    return T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])


class Session:
    """A session with or without a folder for checkpoints."""

    def __init__(self, folder=None, checkpoints=None):
        self.sparkContext = self.conf = self
        self.folder, self.checkpoints = folder, checkpoints

    def getCheckpointDir(self):
        return self.checkpoints

    def get(self, key, default=None):
        return {"spark.checkpoint.dir": self.folder, "spark.sql.warehouse.dir": "hdfs:///tables"}[key] or default


def test_shared_folder_comes_from_the_session():
    assert shared_dir(Session("hdfs:///shared/")) == "hdfs:///shared"
    assert shared_dir(Session(checkpoints="hdfs:///shared/1")) == "hdfs:///shared/1"
    assert shared_dir(Session()) == "hdfs:///tables/shared"


def brute_force(framework, listing):
    """Both rounds row by row in plain Python."""
    levels = {}
    for _, _, sector, _, title, _, level, *_ in framework:
        if sector == "Human Resource":
            levels.setdefault(title.lower().strip(), set()).add(level)
    first, descr = {}, {}
    for ref, title, *texts in listing:
        descr.setdefault(ref, texts)
        if title is not None:
            first.setdefault((ref, title.lower().strip()), (title, texts))
    buckets = {}
    for (ref, key), (title, texts) in first.items():
        if None in texts:
            continue
        if key not in levels:
            buckets[ref, key] = "irrelevant"
        elif first_level(title, texts[0]) in levels[key]:
            buckets[ref, key] = "all_tagged"
        else:
            course = [new if new is not None else own for new, own in zip(descr[ref], texts)]
            level = second_level(f"{course[0]} |: {course[1]} | {course[2]}")
            buckets[ref, key] = "valid" if level in levels[key] else "invalid"
    return buckets


def first_level(title, course_title):
    return (len(title) + len(course_title)) % 4


def second_level(text):
    return len(text) % 5


def scorers():
    """Nested, so that they reach the workers by value."""

    def make1():
        import re

        def call(system, prompt):
            title, course = re.match(r'.*for skill: "(.*?)", based .* of a course: (.*?), Course', prompt, re.S).groups()
            return json.dumps({"proficiency_level": (len(title) + len(course)) % 4})

        return call

    def make2():
        return lambda system, prompt: json.dumps({"proficiency": len(prompt.split("“")[1].split("”")[0]) % 5})

    return make1, make2


@pytest.mark.parametrize("seed, forced", [(1, {}), (2, {"broadcastRows": "0", "hotRows": "5", "salts": "3"})])
def test_random_listing_against_brute_force(spark, tmp_path, seed, forced):
    rng = random.Random(seed)
    titles = ["Excel", " EXCEL", "excel\t", "SQL", "sql ", "Cooking", "Golf", None]

    def text(prefix):
        return prefix + "x" * rng.randrange(6) if rng.random() > 0.1 else None

    listing = [
        ("hot" if rng.random() < 0.33 else f"c{rng.randrange(60)}", rng.choice(titles), text("T"), text("A"), text("L"))
        for _ in range(400)
    ]
    folder = f"{tmp_path}/in"
    sinks.write_parquet(spark.createDataFrame(FRAMEWORK, framework_schema()).coalesce(1), f"{folder}/SFW_x.parquet")
    sinks.write_parquet(spark.createDataFrame(listing, listing_schema()).coalesce(1), f"{folder}/HR.parquet")
    for key, value in forced.items():
        spark.conf.set(f"spark.levelmark.{key}", value)
    try:
        chosen = RunSettings(["Human Resource"], "HR", *scorers(), FILE_ORDER)
        results = run(spark, folder, f"{tmp_path}/run", chosen)
        got = {(r["course_ref"], r["skill_key"]): r["bucket"] for r in results.where("bucket <> 'valid'").collect()}
        valid = {(r["course_ref"], r["skill_key"]): "valid" for r in results.where("bucket = 'valid'").collect()}
        tagged = spark.read.parquet(f"{tmp_path}/run/tagged")
        irrelevant = {
            (r["course_ref"], r["skill_key"]): "irrelevant" for r in tagged.where("bucket = 'irrelevant'").collect()
        }
    finally:
        for key in forced:
            spark.conf.unset(f"spark.levelmark.{key}")
    expected = brute_force(FRAMEWORK, listing)
    assert {**irrelevant, **got, **valid} == expected
    assert set(expected.values()) == {"irrelevant", "all_tagged", "valid", "invalid"}
    # Every clean row is in one bucket of round one.
    assert tagged.count() == len(expected) == tagged.select("course_ref", "skill_key").distinct().count()


def test_ids_are_short_and_few_chunks_are_written_where_the_rows_are(spark, tmp_path):
    """A hash and a shuffle of the work were most of what a stored run wrote."""
    made = work_identity(F.col("course"), F.col("title")).alias("work_id")
    rows = [("c1", "excel"), ("c1", "x" * 70), (None, "c1"), ("c1", None), ("c1", "")]
    ids = [r["work_id"] for r in spark.createDataFrame(rows, "course string, title string").coalesce(1).select(made).collect()]
    hashed = [hashlib.sha256(x.encode()).hexdigest() for x in ("c1\x1f" + "x" * 70, "c1", "c1")]
    assert ids == ["c1\x1fexcel", *hashed, "c1\x1f"]
    work = spark.range(0, 400, 1, 4).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("work_id"))
    for chunks, files in ((3, 12), (20, None)):
        store = RunStore(spark, f"{tmp_path}/{chunks}")
        assert store.keep_work(work, "work", wanted=chunks).select("work_id", "chunk").distinct().count() == 400
        found = len(list(pathlib.Path(store.path("work")).glob("chunk=*/*.parquet")))
        assert found == files or files is None and found < 4 * chunks


def test_compressed_csv_files_are_converted_like_plain_ones(spark, tmp_path):
    texts = [(f"c{i}", 'say "hi", \n twice', "a\r\nb", "é", None) for i in range(50)]
    df = spark.createDataFrame(texts, listing_schema()).coalesce(1)
    sinks.write_csv(df, f"{tmp_path}/csv", rows_per_file=20, compression="gzip")
    assert len(list(pathlib.Path(f"{tmp_path}/csv").glob("*.csv.gz"))) == 3
    table = sinks.convert_csv(spark, f"{tmp_path}/csv", listing_schema(), f"{tmp_path}/out").drop("src_file", sinks.BAD_RECORD)
    assert sorted(map(tuple, table.collect())) == sorted(texts)
