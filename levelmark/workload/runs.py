"""Whole rounds: flagship summary, both rounds, resume."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.operators.joins import fits_broadcast
from levelmark.operators.listing import course_descriptions, extract_list_skills, preprocess
from levelmark.operators.taxonomy import level_pairs
from levelmark.plans.rounds import bucket_round1, bucket_round2, prepare_work, round2_work, tag_round1, tag_round2
from levelmark.plans.runs import RunSettings, RunStore, run_two_rounds
from levelmark.sources.shared import scratch_path, written
from levelmark.workload import scoring as sc
from levelmark.workload import tables as t
from levelmark.workload.registry import query

BUCKETS_SQL = """
checked AS (
  SELECT w.*, p1.level IS NOT NULL AS ok1, p2.level IS NOT NULL AS ok2
  FROM routed w
  LEFT JOIN pairs p1 ON w.skill_key = p1.skill_key AND w.answer1 = p1.level
  LEFT JOIN pairs p2 ON w.skill_key = p2.skill_key AND w.answer2 = p2.level),
tagged AS (
  SELECT *, CASE WHEN relevance <> 'In Sector' THEN 'irrelevant' WHEN ok1 THEN 'r1_valid'
                 WHEN answer2 = 0 THEN 'r2_untagged' WHEN ok2 THEN 'r2_valid' ELSE 'r2_invalid' END AS bucket
  FROM checked)
"""


def tagged_rows(spark: SparkSession, folder: str, title: str = "skill_title") -> DataFrame:
    """Both rounds over the fixed answers carried by the rows."""
    topics = t.topics(spark, folder)
    fits = fits_broadcast(level_pairs(topics))
    rows = t.routed(spark, folder, title, fits=fits)
    r1 = bucket_round1(rows.withColumn("level", F.col("answer1")), topics, F.lit(False), fits=fits)
    r1 = r1.withColumn("level2", F.col("answer2")).withColumnRenamed("bucket", "bucket1")
    both = bucket_round2(r1, topics, fits=fits)
    final = F.when(F.col("bucket1") == "r1_invalid", F.col("bucket")).otherwise(F.col("bucket1"))
    return both.withColumn("bucket", final).drop("bucket1")


@query(f"""WITH {t.routed_sql()}, {BUCKETS_SQL}
SELECT bucket, count(*) AS n_rows, count(DISTINCT course_ref) AS n_courses FROM tagged GROUP BY bucket""")
def two_round_summary(spark: SparkSession, folder: str) -> DataFrame:
    return (
        tagged_rows(spark, folder)
        .groupBy("bucket")
        .agg(F.count("*").alias("n_rows"), F.count_distinct("course_ref").alias("n_courses"))
    )


def fixed_answers(work: DataFrame, key: str, level: str, field: str) -> DataFrame:
    """Answer texts as a scorer returns them."""
    body = F.to_json(F.struct(F.col(level).alias(field), F.lit("fixed").alias("reason"), F.lit("low").alias("confidence")))
    return work.select(F.col(key).alias("work_id"), body.alias("answer"))


@query(f"""WITH {t.routed_sql("skill_key")}
SELECT course_ref, r.skill_key, answer1 AS level,
       CASE WHEN relevance <> 'In Sector' THEN 'irrelevant' WHEN p.level IS NULL THEN 'r1_invalid' ELSE 'r1_valid' END AS bucket
FROM routed r LEFT JOIN pairs p ON r.skill_key = p.skill_key AND answer1 = p.level""")
def round1(spark: SparkSession, folder: str) -> DataFrame:
    topics = t.topics(spark, folder)
    fits = fits_broadcast(level_pairs(topics))
    # Read twice below, as rows and as answers.
    work = written(prepare_work(t.listing(spark, folder), topics, t.ORDER, ["about"], fits=fits), "work")
    tagged = tag_round1(work, fixed_answers(work, "work_id", "answer1", "proficiency_level"), topics, fits=fits)
    return tagged.select("course_ref", "skill_key", "level", "bucket")


ROUND2_SQL = f"""
WITH {t.routed_sql("skill_key")}, {t.first_descriptions_sql()},
failed AS (
  SELECT w.course_ref, w.skill_key, w.skill_title, w.answer1, w.answer2,
         coalesce(d.course_title, w.course_title) || ' |: ' || coalesce(d.about, w.about) || ' | '
           || coalesce(d.learn, w.learn) AS course_text
  FROM work w LEFT JOIN pairs p ON w.skill_key = p.skill_key AND answer1 = p.level
  LEFT JOIN descr d ON w.course_ref = d.course_ref
  WHERE p.level IS NULL),
ids AS (SELECT *, sha256(lower(course_text || skill_title)) AS unique_id FROM failed),
ans AS (SELECT unique_id, min(answer2) AS level2 FROM ids GROUP BY unique_id),
final AS (
  SELECT i.course_ref, i.skill_key, i.unique_id, i.answer1 AS level, a.level2,
         CASE WHEN a.level2 = 0 THEN 'r2_untagged' WHEN p.level IS NULL THEN 'r2_invalid' ELSE 'r2_valid' END AS bucket
  FROM ids i JOIN ans a USING (unique_id) LEFT JOIN pairs p ON i.skill_key = p.skill_key AND a.level2 = p.level)
"""


@query(f"{ROUND2_SQL} SELECT course_ref, skill_key, unique_id, level, level2, bucket FROM final")
def round2(spark: SparkSession, folder: str) -> DataFrame:
    topics = t.topics(spark, folder)
    fits = fits_broadcast(level_pairs(topics))

    def contents(part: DataFrame, join) -> DataFrame:
        work = prepare_work(part, topics, t.ORDER, ["about"], fits=fits).where("relevance = 'In Sector'")
        r1 = bucket_round1(work.withColumn("level", F.col("answer1")), topics, F.lit(False), fits=fits)
        return round2_work(r1.where("bucket = 'r1_invalid'"), course_descriptions(part, t.ORDER), join=join)

    ids = t.stored_listing(spark, folder).apply(contents)
    # Read three times below: answers, hot ids, rows.
    columns = ["work_id", "course_ref", "skill_key", "unique_id", "level", "answer2", "bucket"]
    ids = written(ids.select(*columns), "contents")
    lowest = ids.groupBy("unique_id").agg(F.min("answer2").alias("answer2"))
    tagged = tag_round2(ids, fixed_answers(lowest, "unique_id", "answer2", "proficiency"), topics, fits=fits)
    return tagged.select("course_ref", "skill_key", "unique_id", "level", "level2", "bucket")


@query(f"""WITH {t.LISTING_SQL},
kept AS (SELECT * FROM li WHERE about IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY course_ref, skill_title ORDER BY {t.ORDER_SQL}) AS rn FROM kept)
SELECT course_ref, skill_title, about, learn, l_linenumber FROM ranked WHERE rn = 1""")
def preprocess_listing(spark: SparkSession, folder: str) -> DataFrame:
    clean = preprocess(t.listing(spark, folder), ["about"], t.ORDER)
    return clean.select("course_ref", "skill_title", "about", "learn", "l_linenumber")


def list_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells_of(t.listing(spark, folder))


def cells_of(rows: DataFrame) -> DataFrame:
    """Listing whose titles are partly list cells: two skills in single or
    double quotes, an empty list, or a plain name."""
    name = F.trim(F.lower("skill_title"))
    kind = F.col("l_linenumber") % 4
    cell = (
        F.when(kind == 0, F.concat(F.lit("['"), name, F.lit("', 'extra "), name, F.lit("']")))
        .when(kind == 1, F.concat(F.lit('["'), name, F.lit('"]')))
        .when(kind == 2, F.lit("[]"))
        .otherwise(name)
    )
    return rows.withColumn("skill_title", cell)


LIST_CELLS_SQL = t.LISTING_SQL.replace(
    "li AS (SELECT * FROM li0)",
    """li AS (SELECT * REPLACE (CASE l_linenumber % 4
      WHEN 0 THEN '[''' || skill_key || ''', ''extra ' || skill_key || ''']'
      WHEN 1 THEN '["' || skill_key || '"]' WHEN 2 THEN '[]' ELSE skill_key END AS skill_title) FROM li0)""",
)


@query(f"""WITH {LIST_CELLS_SQL}, {t.first_descriptions_sql()},
skills AS (
  SELECT course_ref, l_linenumber, skill_key AS skill_title FROM li WHERE l_linenumber % 4 IN (0, 1)
  UNION ALL
  SELECT course_ref, l_linenumber, 'extra ' || skill_key FROM li WHERE l_linenumber % 4 = 0)
SELECT s.course_ref, s.l_linenumber, s.skill_title, d.course_title, d.about, d.learn
FROM skills s LEFT JOIN descr d ON s.course_ref = d.course_ref""", name="extract_list_skills")
def list_skills(spark: SparkSession, folder: str) -> DataFrame:
    def skills(part: DataFrame, join) -> DataFrame:
        rows = extract_list_skills(cells_of(part), t.ORDER, join=join)
        return rows.select("course_ref", "l_linenumber", "skill_title", "course_title", "about", "learn")

    return t.stored_listing(spark, folder).apply(skills)


RESUME_SQL = f"""
WITH {t.routed_sql("skill_key")}, {sc.BLOCKS_SQL}, {sc.KNOWLEDGE_SQL}, {t.first_descriptions_sql()},
one AS (SELECT w.*, length({sc.round1_prompt_sql("w")}) % 7 AS level FROM work w JOIN blocks b USING (skill_key)),
r1 AS (SELECT o.*, p.level IS NOT NULL AS ok1 FROM one o LEFT JOIN pairs p ON o.skill_key = p.skill_key AND o.level = p.level),
failed AS (
  SELECT r1.*, coalesce(d.course_title, r1.course_title) || ' |: ' || coalesce(d.about, r1.about) || ' | '
           || coalesce(d.learn, r1.learn) AS course_text
  FROM r1 LEFT JOIN descr d ON r1.course_ref = d.course_ref WHERE NOT ok1),
two AS (SELECT f.*, length({sc.round2_prompt_sql("f")}) % 7 AS level2 FROM failed f JOIN kb USING (skill_key)),
r2 AS (SELECT t.*, p.level IS NOT NULL AS ok2 FROM two t LEFT JOIN pairs p ON t.skill_key = p.skill_key AND t.level2 = p.level)
SELECT course_ref, skill_key, CAST(level AS INTEGER) AS level, 'all_tagged' AS bucket FROM r1 WHERE ok1
UNION ALL SELECT course_ref, skill_key, CAST(level2 AS INTEGER), 'all_tagged' FROM r2 WHERE ok2 AND level2 > 0
UNION ALL SELECT course_ref, skill_key, CAST(level AS INTEGER), 'valid' FROM r2 WHERE ok2 AND level2 > 0
UNION ALL SELECT course_ref, skill_key, CAST(level AS INTEGER), 'invalid' FROM r2 WHERE NOT ok2 OR level2 = 0
"""


@query(RESUME_SQL)
def resume_equals_full(spark: SparkSession, folder: str) -> DataFrame:
    """A run that finds part of the round-one answers already stored, some of
    them as failed calls, ends like a run from the start."""
    topics = t.topics(spark, folder)
    root = scratch_path(spark, "run")
    settings = RunSettings(
        sectors=[t.SECTOR],
        alias="B1",
        make_scorer1=sc.length_scorer("proficiency_level"),
        make_scorer2=sc.length_scorer("proficiency"),
        order=t.ORDER,
        required=["about"],
        framework_order=t.FRAMEWORK_ORDER,
    )
    work = prepare_work(t.listing(spark, folder), topics, t.ORDER, ["about"]).where("relevance = 'In Sector'")
    prompts = sc.prompts1(work, topics)
    early = prompts.where(F.col("course_ref") % 3 < 2).select(
        "work_id",
        F.when(F.col("course_ref") % 3 == 0, sc.length_answer("proficiency_level")).otherwise("").alias("answer"),
        F.when(F.col("course_ref") % 3 == 1, "stopped").alias("error"),
    )
    RunStore(spark, root).append_answers(early, "r1")
    results = run_two_rounds(spark, t.framework(spark, folder), t.listing(spark, folder), root, settings)
    return results.select("course_ref", "skill_key", "level", "bucket")


def early_run(spark: SparkSession, folder: str) -> RunStore:
    """A run stopped in round one: some rows answered, some calls failed."""
    work = prepare_work(t.listing(spark, folder), t.topics(spark, folder), t.ORDER, ["about"]).where("relevance = 'In Sector'")
    store = RunStore(spark, scratch_path(spark, "run"))
    work = store.keep_work(work, "work", wanted=3)
    answered = work.where("answer1 > 0").select(
        "work_id", F.lit("{}").alias("answer"), F.when(F.col("answer1") == 1, "stopped").alias("error")
    )
    store.append_answers(answered, "r1")
    totals, done = store.counted("r1", work)
    store.save_state("r1", sum(totals.values()), sum(done.values()), "B1")
    return store


@query(f"""WITH {t.routed_sql("skill_key")}
SELECT 'r1' AS round, count(*) AS n_total, count(*) FILTER (WHERE answer1 > 1) AS n_done,
       count(*) FILTER (WHERE answer1 > 1) / count(*) AS progress, 'B1' AS sector FROM work""")
def run_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state that a stopped run has saved."""
    return early_run(spark, folder).state().select("round", "n_total", "n_done", "progress", "sector")


@query(f"""WITH {t.routed_sql("skill_key")}
SELECT 'answers' AS name, count(*) FILTER (WHERE answer1 > 0) AS n_before, CAST(0 AS BIGINT) AS n_after FROM work
UNION ALL SELECT 'state', 1, 0 UNION ALL SELECT 'work', count(*), 0 FROM work""")
def clear_run(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a run's tables before and after it is cleared."""
    store = early_run(spark, folder)

    def counts(column: str) -> DataFrame:
        parts = [spark.read.parquet(store.path(n)).agg(F.lit(n).alias("name"), F.count("*").alias(column)) for n in ("answers", "state", "work")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    before = written(counts("n_before"), "before")
    store.clear_all()
    return before.join(counts("n_after"), "name")
