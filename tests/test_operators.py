"""Joins, dedupe, taxonomy, prompts and scoring on hand-made rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from levelmark.operators import quality, taxonomy
from levelmark.operators.dedupe import keep_first
from levelmark.operators.joins import fits_broadcast, lookup_join, salted_join
from levelmark.operators.listing import (
    attach_descriptions,
    course_descriptions,
    dedupe_then_drop,
    drop_then_dedupe,
    extract_list_skills,
    mixed_formats,
)
from levelmark.operators.progress import eta_seconds, eta_text
from levelmark.operators.prompts import (
    SplitPrompts,
    knowledge_texts,
    level_texts,
    round1_prompts,
    round2_prompts,
    split_round1,
    split_round2,
)
from levelmark.operators.routing import flag_relevance
from levelmark.operators.scoring import lexical_levels, score, wait_turn
from levelmark.workload import scoring as queries

FRAMEWORK = "ord long, sector string, title string, level int, level_descr string, item_class string, item string"


def sorted_rows(df):
    return sorted(map(repr, df.collect()))


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows in one key."""
    rows = [(0 if i % 3 == 0 else i % 50, i) for i in range(3000)]
    return spark.createDataFrame(rows, "k int, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_the_plain_join(spark, skewed, how):
    right = spark.createDataFrame([(i, f"r{i % 7}") for i in list(range(0, 40)) + [0, 3]], "k int, w string")
    salted = salted_join(skewed, right, ["k"], how, salt_by=["v"], hot_rows=100, salts=8)
    assert sorted_rows(salted) == sorted_rows(skewed.join(right, ["k"], how))


@pytest.mark.parametrize("hot_rows", [100, 10_000])
def test_a_join_has_the_partitions_it_is_given(spark, skewed, hot_rows):
    right = spark.createDataFrame([(i, f"r{i % 7}") for i in range(40)], "k int, w string")
    joined = salted_join(skewed, right, ["k"], "left", salt_by=["v"], hot_rows=hot_rows, salts=8, partitions=13)
    assert joined.rdd.getNumPartitions() == 13
    assert sorted_rows(joined) == sorted_rows(skewed.join(right, ["k"], "left"))


def test_salted_join_spreads_the_hot_key(spark, skewed):
    right = spark.range(50).select(F.col("id").cast("int").alias("k"))
    seen = (
        salted_join(skewed.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(8))), right, ["k"], "inner", ["v"], None, 100, 8)
        .where("k = 0")
        .select("part")
        .distinct()
        .count()
    )
    assert seen == 8


def test_lookup_join_broadcasts_only_what_was_measured(spark, skewed):
    lookup = spark.range(50).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("w"))
    small = lookup_join(skewed, lookup, ["k"], "left", ["v"])
    large = lookup_join(skewed, lookup, ["k"], "left", ["v"], max_rows=10, hot_rows=100)
    assert "_salt" not in plan(small) and "_salt" in plan(large)
    assert sorted_rows(small) == sorted_rows(large)
    assert not fits_broadcast(lookup, max_bytes=100)


def test_keep_first_on_shuffled_rows(spark):
    rows = [(i % 20, i // 20, f"v{i}") for i in range(400)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, o int, v string").repartition(7)
    first = keep_first(df, ["k"], ["o"])
    assert sorted(tuple(r) for r in first.collect()) == [(k, 0, f"v{k}") for k in range(20)]
    assert "WindowGroupLimit" in plan(first)


def test_the_two_cleaning_orders_differ(spark):
    rows = [("c", "t", None, 1), ("c", "t", "a", 2)]
    df = spark.createDataFrame(rows, "course_ref string, skill_title string, about string, o int")
    assert dedupe_then_drop(df, ["about"], ["o"]).count() == 0
    assert drop_then_dedupe(df, ["about"], ["o"]).count() == 1


LISTING = "course_ref string, skill_title string, course_title string, about string, learn string, o int"


def test_list_cells_and_descriptions(spark):
    rows = [
        ("c1", "['a', 'b']", "T1", "A1", "L1", 1),
        ("c1", "plain", "T2", "A2", "L2", 2),
        ("c2", "[]", "T3", "A3", "L3", 3),
        ("c3", '["z"]', "T4", None, "L4", 4),
    ]
    df = spark.createDataFrame(rows, LISTING)
    got = extract_list_skills(df, ["o"], hot_rows=1).select("course_ref", "skill_title", "course_title", "about")
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("c1", "a", "T1", "A1"),
        ("c1", "b", "T1", "A1"),
        ("c3", "z", "T4", None),
    ]
    kept = extract_list_skills(df, ["o"], keep_plain=True)
    assert [r["course_title"] for r in kept.where("skill_title = 'plain'").collect()] == ["T2"]
    assert mixed_formats(df).first()["mixed"]
    descr = course_descriptions(df, ["o"])
    joined = attach_descriptions(df.withColumn("about", F.lit("own")), descr, salt_by=["o"], hot_rows=1)
    assert {(r["o"], r["about"]) for r in joined.collect()} == {(1, "A1"), (2, "A1"), (3, "A3"), (4, "own")}
    bare = df.select("course_ref", "o")
    assert "learn" in attach_descriptions(bare, descr.select("course_ref", "learn"), salt_by=["o"]).columns


@pytest.fixture(scope="module")
def topics(spark):
    rows = [
        (1, "S", "Excel", 2, "second", "ability", "format cells"),
        (2, "S", "EXCEL", 1, "first", "knowledge", "open files"),
        (3, "S", "Excel", 1, "later", "knowledge", "save files"),
        (4, "S", "excel ", 1, "later", "knowledge", "open files"),
        (5, "S", "Excel", 1, "later", "ability", None),
        (6, "S", "SQL", 3, "third", "Knowledge", "write joins"),
        (7, "S", "SQL", None, "none", "ability", "read tables"),
        (8, "X", "SQL", 5, "other", "ability", "read tables"),
    ]
    return taxonomy.sector_framework(spark.createDataFrame(rows, FRAMEWORK), ["S"])


def test_levels_per_topic(topics):
    assert {r["skill_key"]: r["levels"] for r in taxonomy.level_sets(topics).collect()} == {"excel": [1, 2], "sql": [3]}
    firsts = {r["skill_key"]: r["levels"] for r in taxonomy.first_title_levels(topics).collect()}
    assert firsts == {"excel": [1], "sql": [3]}


@pytest.mark.parametrize("page_rows", [1, 2, 100])
def test_skill_info_keeps_first_seen_order(topics, page_rows):
    pages = taxonomy.skill_pages(taxonomy.distinct_items(topics, ["ord"]), ["ord"], page_rows)
    info = {(r["skill_key"], r["level"]): r for r in taxonomy.skill_info(pages).collect()}
    excel = info["excel", 1]
    assert (excel["level_descr"], excel["knowledge"], excel["ability"]) == ("first", ["open files", "save files"], [])
    assert info["sql", 3]["knowledge"] == []  # the class is compared exactly


@pytest.mark.parametrize("page_rows", [1, 2, 3, 100])
def test_knowledge_base_does_not_depend_on_the_page_size(topics, page_rows):
    pages = taxonomy.knowledge_pages(topics, ["ord"], page_rows)
    kb = {r["skill_key"]: r["knowledge"] for r in taxonomy.knowledge_base(pages).collect()}
    assert kb["excel"] == (
        '[{"level":1,"items":"open files, save files, open files, "},{"level":2,"items":"format cells"}]'
    )


@pytest.fixture(scope="module")
def work(spark):
    rows = [
        ("w1", "excel", "Excel", "T", "open and save files", "L", "T |: open and save files | L"),
        ("w2", "sql", "SQL", "T", "nothing shared", "L", "T |: nothing shared | L"),
        ("w3", "unknown", "Unknown", "T", "A", "L", "T |: A | L"),
    ]
    return spark.createDataFrame(
        rows, "work_id string, skill_key string, skill_title string, course_title string, about string, learn string, course_text string"
    )


def test_round1_prompt(work, topics):
    rows = {r["work_id"]: r for r in round1_prompts(work, level_texts(topics, ["ord"]), ["work_id"]).collect()}
    assert rows["w1"]["prompt"].startswith('Determine the appropriate proficency level for skill: "Excel", based on')
    block = "Proficiency Level: 2\nProficiency Description: second\nKnowledge Items:\nAbility Items:\n- format cells\n\n"
    assert block + "Proficiency Level: 1\nProficiency Description: first\n" in rows["w1"]["prompt"]
    assert rows["w1"]["prompt_error"] is None
    assert rows["w3"]["prompt"] is None and rows["w3"]["prompt_error"] == "topic not in the framework"


def test_prompts_in_two_parts_are_the_whole_prompts(spark, work, topics):
    """A topic's text goes to the workers once, not with each row."""
    bare = [(k, k and "excel", "Excel", None, None, "L", None) for k in ("w4", None)]
    rows = work.unionByName(spark.createDataFrame(bare, work.schema))
    rows = rows.unionByName(work.where("work_id = 'w1'").withColumn("work_id", F.lit("w5")).withColumn("skill_key", F.lit(None).cast("string")))
    make = lambda: lambda system, prompt: prompt.upper()
    for whole, split, texts in ((round1_prompts, split_round1, level_texts), (round2_prompts, split_round2, knowledge_texts)):
        made = texts(topics, ["ord"])
        expected = sorted_rows(score(whole(rows, made, ["work_id"]), make, "s"))
        parts = split(rows, made, ["work_id"])
        assert isinstance(parts, SplitPrompts) and {"excel", "sql"} <= set(parts.ends)
        assert sorted_rows(score(parts, make, "s")) == expected
        too_large = split(rows, made._replace(fits=False), ["work_id"])
        assert not isinstance(too_large, SplitPrompts) and sorted_rows(score(too_large, make, "s")) == expected


def test_long_work_is_shuffled_once_to_as_many_tasks_as_its_rows_need(spark, folder):
    spark.conf.set("spark.levelmark.taskRows", 500)  # of 6,000 rows
    try:
        work = queries.long_work(spark, folder)
        assert work.rdd.getNumPartitions() == 12
    finally:
        spark.conf.unset("spark.levelmark.taskRows")
    made = work._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(course_ref" in made
    assert not any("skill_key" in line for line in made.splitlines() if "Exchange hashpartitioning(course_ref" in line)


def test_short_gaps_between_calls_are_kept():
    """A sleep takes many times a gap of ten microseconds."""
    spent = []
    for _ in range(3):
        start = time.monotonic()
        for _ in range(5_000):
            wait_turn(1e-5)
        spent.append(time.monotonic() - start)
    assert 0.0499 <= min(spent) < 0.15


def test_setup_chooses_the_item_lists(work, topics):
    only = round1_prompts(work, level_texts(topics, ["ord"], setup=1), ["work_id"]).where("work_id = 'w1'").first()["prompt"]
    assert "Knowledge Items:" in only and "Ability Items:" not in only


def test_a_topic_of_many_megabytes_gets_its_prompt_and_answer(spark):
    letters = "abcdefghi"
    rows = [(i, "S", "Big", 1, "long", "knowledge", c * (1 << 20)) for i, c in enumerate(letters)]
    rows.append((99, "S", "Small", 1, "short", "knowledge", "x"))
    topics = taxonomy.sector_framework(spark.createDataFrame(rows, FRAMEWORK), ["S"])
    columns = "work_id string, skill_key string, skill_title string, course_title string, about string, learn string, course_text string"
    work = spark.createDataFrame([(k, k, k.title(), "c", "a", "l", "t") for k in ("big", "small")], columns)
    make = lambda: lambda system, prompt: str(len(prompt))
    for build, texts in ((round1_prompts, level_texts), (round2_prompts, knowledge_texts)):
        answers = score(build(work, texts(topics, ["ord"]), ["work_id"]), make, "s").collect()
        sizes = {r["work_id"]: int(r["answer"]) for r in answers if r["error"] is None}
        assert sizes["big"] > 9 << 20 and 0 < sizes["small"] < 10_000


def test_relevance_without_broadcast(spark, work, topics):
    flagged = flag_relevance(work, topics, ["work_id"], max_rows=0)
    assert {r["work_id"]: r["relevance"] for r in flagged.collect()} == {
        "w1": "In Sector",
        "w2": "In Sector",
        "w3": "Not in sector",
    }


def test_lexical_levels(work, topics):
    scored = lexical_levels(work, topics, "course_text", ["work_id"], ["ord"])
    assert {r["work_id"]: r["level"] for r in scored.collect()} == {"w1": 1, "w2": 0, "w3": 0}


def prompts_of(spark, n, parts=1):
    rows = [(f"w{i:03d}", f"p{i}", "no text" if i == 1 else None) for i in range(n)]
    return spark.createDataFrame(rows, "work_id string, prompt string, prompt_error string").coalesce(parts)


def test_a_failing_call_keeps_its_row(spark):
    def make():
        def call(system, prompt):
            if prompt == "p2":
                raise ValueError("bad call")
            return None if prompt == "p3" else f"{system}:{prompt}"

        return call

    rows = {r["work_id"]: (r["answer"], r["error"]) for r in score(prompts_of(spark, 5), make, "s").collect()}
    assert rows["w000"] == ("s:p0", None)
    assert rows["w001"] == ("", "no text")
    assert rows["w002"] == ("", "ValueError: bad call")
    assert rows["w003"] == ("", None)


def test_a_scorer_that_cannot_start_is_an_error_per_row(spark):
    def make():
        raise ValueError("no key")

    errors = [r["error"] for r in score(prompts_of(spark, 3), make, "s").orderBy("work_id").collect()]
    assert errors == ["ValueError: no key", "no text", "ValueError: no key"]


@pytest.mark.parametrize("rows, partitions, calls, pause", [(80, 16, 40, 1.0), (20, 20, 4, 0.5)])
def test_rate_limit_holds_for_any_partitions(spark, rows, partitions, calls, pause):
    """Many small partitions, and more tasks than calls between two pauses."""
    make = lambda: lambda system, prompt: "{}"
    columns = "work_id string, prompt string, prompt_error string"
    prompts = spark.createDataFrame([(str(i), "p", None) for i in range(rows)], columns).repartition(partitions, "work_id")
    start = time.time()
    answers = score(prompts, make, "s", calls_per_pause=calls, pause_seconds=pause, tasks=8).collect()
    assert len(answers) == rows
    assert time.time() - start >= (rows - calls) * pause / calls


def test_remaining_time(spark):
    # Rows done, all rows, seconds so far: seconds left, worked out by hand.
    expected = {
        (0, 130, 0.0): 98.0,
        (30, 130, 15.0): 70.0,
        (60, 130, 40.0): 45.0,
        (60, 500, 5.0): 264.0,
        (59, 10_000, 60.0): 11_769.4915254,
        (130, 130, 99.0): 0.0,
        (60, 121, 70.0): 71.0,
    }
    df = spark.createDataFrame(list(expected), "d long, t long, e double")
    got = [r[0] for r in df.select(eta_seconds(F.col("d"), F.col("t"), F.col("e"))).collect()]
    assert got == pytest.approx(list(expected.values()))
    texts = {
        30.0: "Less than 1 minute remaining",
        61.0: "About 1 minute remaining",
        95.0: "About 2 minutes remaining",
        3601.0: "About 1 hour remaining",
        7325.0: "About 2 hours and 2 minutes remaining",
        3665.0: "About 1 hour and 1 minute remaining",
    }
    df = spark.createDataFrame([(s,) for s in texts], "s double")
    assert [r[0] for r in df.select(eta_text(F.col("s"))).collect()] == list(texts.values())


def test_quality_rules(spark):
    rows = [("1",), ("x",), (None,), ("2.5",), ("3.0",)]
    df = spark.createDataFrame(rows, "level string")
    found = {r["rule"]: r["n_bad"] for r in quality.level_types(df, "d").collect()}
    assert found == {"not_numeric": 1, "not_whole": 1, "empty_level": 1}
    assert quality.no_rows(df.where("false"), "d").first()["rule"] == "no_rows"
    assert quality.all_null(df.where("level IS NULL"), "d", ["level"]).first()["n_bad"] == 1
    clean = quality.framework_report(df.where("level = '1'"), "d", ["level"], ["level"])
    assert quality.report_passes(clean).first().asDict() == {"n_failed": 0, "passed": True}
    broken = quality.framework_report(df, "d", ["level", "title"], ["level"])
    assert not quality.report_passes(broken).first()["passed"]
    assert {r["rule"] for r in broken.collect()} == {"missing_column", "not_numeric", "not_whole", "empty_level"}


def test_file_name_rules(spark):
    names = ["SFW_Design.xlsx", "SFW_.csv", "x.csv", "SFW_Nowhere.csv", "SFW_Food.csv"]
    files = spark.createDataFrame([(f"/in/{n}",) for n in names], "path string")
    rules = {r["path"][4:]: r["rule"] for r in quality.framework_names(files, alias="DSGN").collect()}
    assert [rules[n] for n in names] == [None, "sector_missing", "prefix", "sector_unknown", "other_sector"]
    tail = "_sector_course_listing.csv"
    names = [f"HR_Human Resource{tail}", f"hr_Human Resource{tail}", f"ZZ_Food{tail}", f"HR_Food{tail}", f"HR{tail}", "HR_Food.csv", f"_Food{tail}", f"HR_{tail}"]
    files = spark.createDataFrame([(f"/in/{n}",) for n in names], "path string")
    rules = {r["path"][4:]: r["rule"] for r in quality.listing_names(files).collect()}
    expected = [None, "alias_case", "alias_unknown", "name_mismatch", "two_parts", "suffix", "alias_missing", "sector_missing"]
    assert [rules[n] for n in names] == expected
