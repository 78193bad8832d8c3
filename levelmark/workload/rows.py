"""Projections, filters, predicates, scalar functions, limits and unions."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.functions import text as tx
from levelmark.functions.answers import cast_level as cast_level_column
from levelmark.functions.answers import parse_round1, parse_round2
from levelmark.operators import progress
from levelmark.operators.listing import attach_descriptions, course_descriptions, rename_if_present, trim_headers
from levelmark.operators.routing import check_level
from levelmark.operators.taxonomy import level_pairs
from levelmark.plans.rounds import promote
from levelmark.workload import runs
from levelmark.workload import tables as t
from levelmark.workload.registry import query


@query(f"WITH {t.FRAMEWORK_SQL} SELECT ord, title, skill_key, level FROM topics")
def sector_filter(spark: SparkSession, folder: str) -> DataFrame:
    return t.topics(spark, folder).select("ord", "title", "skill_key", "level")


@query(f"WITH {t.LISTING_SQL} SELECT skill_title, lower(trim(skill_title)) AS skill_key, count(*) AS n_rows FROM li GROUP BY ALL")
def normalise_key(spark: SparkSession, folder: str) -> DataFrame:
    keyed = t.keyed(spark, folder)
    return keyed.groupBy("skill_title", "skill_key").agg(F.count("*").alias("n_rows"))


@query(f"WITH {t.routed_sql()} SELECT course_ref, skill_title, relevance FROM routed")
def relevance_flag(spark: SparkSession, folder: str) -> DataFrame:
    return t.routed(spark, folder).select("course_ref", "skill_title", "relevance")


@query(f"""WITH {t.routed_sql()}
SELECT relevance, count(*) AS n_rows, count(DISTINCT course_ref) AS n_courses FROM routed GROUP BY relevance""")
def route_relevance(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.routed(spark, folder)
    return rows.groupBy("relevance").agg(
        F.count("*").alias("n_rows"), F.count_distinct("course_ref").alias("n_courses")
    )


@query("""SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS l_linenumber, l_shipdate FROM lineitem""")
def project_descr(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.table(spark, folder, "lineitem")
    spaced = rows.toDF(*[f" {c} " for c in rows.columns])
    return trim_headers(spaced).select("l_orderkey", "l_linenumber", "l_shipdate")


@query(f"WITH {t.LISTING_SQL} SELECT course_ref, l_linenumber, skill_title, about FROM li WHERE about IS NOT NULL")
def drop_any_null(spark: SparkSession, folder: str) -> DataFrame:
    return t.listing(spark, folder).na.drop("any").select("course_ref", "l_linenumber", "skill_title", "about")


NULLABLE_LEVEL_SQL = "CASE WHEN l_linenumber = 7 THEN NULL ELSE answer2 END"


@query(f"""WITH {t.LISTING_SQL}, lv AS (SELECT course_ref, {NULLABLE_LEVEL_SQL} AS level FROM li)
SELECT course_ref, level, CASE WHEN level = 0 THEN 'untagged' ELSE 'tagged' END AS part FROM lv WHERE level >= 0""")
def split_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """Untagged (0) and tagged (> 0); rows without a level are in neither."""
    level = F.when(F.col("l_linenumber") != 7, F.col("answer2"))
    rows = t.listing(spark, folder).select("course_ref", level.alias("level"))
    part = F.when(F.col("level") == 0, "untagged").when(F.col("level") > 0, "tagged")
    return rows.withColumn("part", part).where(F.col("part").isNotNull())


@query('SELECT l_orderkey AS "Skill Title", l_linenumber FROM lineitem', name="rename_if_present")
def rename_columns(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    renamed = rename_if_present(rows, "l_orderkey")
    return rename_if_present(renamed, "absent column", "unused")


@query(f"""WITH {t.routed_sql()}, {t.first_descriptions_sql()}
SELECT w.course_ref, w.skill_title, coalesce(d.about, w.about) AS about, coalesce(d.learn, w.learn) AS learn
FROM work w LEFT JOIN descr d ON w.course_ref = d.course_ref""")
def coalesce_descr(spark: SparkSession, folder: str) -> DataFrame:
    def described(part: DataFrame, join) -> DataFrame:
        work = t.routed(spark, folder, rows=part).where("relevance = 'In Sector'")
        joined = attach_descriptions(work, course_descriptions(part, t.ORDER), salt_by=["skill_title"], join=join)
        return joined.select("course_ref", "skill_title", "about", "learn")

    return t.stored_listing(spark, folder).apply(described)


@query(f"""WITH {t.LISTING_SQL},
lv AS (SELECT course_ref, l_linenumber, CASE answer1 WHEN 0 THEN 'none' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE CAST(answer1 AS VARCHAR) END AS raw FROM li)
SELECT course_ref, l_linenumber, raw, CAST(coalesce(try_cast(raw AS INTEGER), 0) AS INTEGER) AS level FROM lv""")
def cast_level(spark: SparkSession, folder: str) -> DataFrame:
    answer = F.col("answer1")
    raw = F.when(answer == 0, "none").when(answer == 1, "").when(answer > 2, answer.cast("string"))
    rows = t.listing(spark, folder).select("course_ref", "l_linenumber", raw.alias("raw"))
    return rows.withColumn("level", cast_level_column(F.col("raw")))


@query(f"""WITH {t.routed_sql()}, {runs.BUCKETS_SQL}
SELECT course_ref, skill_title, answer2 AS level, 'second' AS reason, 'high' AS confidence FROM tagged WHERE bucket = 'r2_valid'""")
def promote_r2(spark: SparkSession, folder: str) -> DataFrame:
    rows = runs.tagged_rows(spark, folder).where("bucket = 'r2_valid'")
    texts = {"reason": "first", "confidence": "low", "reason2": "second", "confidence2": "high"}
    promoted = promote(rows.withColumns({c: F.lit(v) for c, v in texts.items()}))
    return promoted.select("course_ref", "skill_title", "level", "reason", "confidence")


@query(f"""WITH {t.routed_sql()}
SELECT w.course_ref, w.skill_title, answer1 AS level, p.level IS NOT NULL AS valid
FROM work w LEFT JOIN pairs p ON w.skill_key = p.skill_key AND w.answer1 = p.level""")
def r1_validity(spark: SparkSession, folder: str) -> DataFrame:
    topics = t.topics(spark, folder)
    work = t.routed(spark, folder).where("relevance = 'In Sector'").withColumn("level", F.col("answer1"))
    checked = check_level(work, level_pairs(topics), "level", "valid", salt_by=["course_ref"])
    return checked.select("course_ref", "skill_title", "level", "valid")


PREVIEW_ORDER = ["course_ref", *t.ORDER]


@query(f"""WITH {t.LISTING_SQL}
SELECT course_ref, skill_title, l_linenumber FROM li ORDER BY course_ref, {t.ORDER_SQL} LIMIT 5""")
def limit_preview(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.listing(spark, folder).orderBy(*PREVIEW_ORDER).limit(5)
    return rows.select("course_ref", "skill_title", "l_linenumber")


@query(f"""WITH {t.routed_sql()}
SELECT course_ref, skill_title FROM work ORDER BY course_ref, {t.ORDER_SQL} LIMIT 200""")
def limit_work(spark: SparkSession, folder: str) -> DataFrame:
    """The optional cap on round-one work."""
    work = t.routed(spark, folder).where("relevance = 'In Sector'")
    return work.orderBy(*PREVIEW_ORDER).limit(200).select("course_ref", "skill_title")


@query(f"""WITH {t.routed_sql()}, {runs.BUCKETS_SQL}
SELECT course_ref, skill_title, CASE bucket WHEN 'r1_valid' THEN answer1 ELSE answer2 END AS level,
       CASE bucket WHEN 'r2_valid' THEN answer1 END AS level1
FROM tagged WHERE bucket IN ('r1_valid', 'r2_valid')""")
def union_all_valid(spark: SparkSession, folder: str) -> DataFrame:
    """Union by name; a column one side lacks is null there."""
    rows = runs.tagged_rows(spark, folder)
    first = rows.where("bucket = 'r1_valid'").select("course_ref", "skill_title", F.col("answer1").alias("level"))
    second = rows.where("bucket = 'r2_valid'").select(
        "course_ref", "skill_title", F.col("answer2").alias("level"), F.col("answer1").alias("level1")
    )
    return first.unionByName(second, allowMissingColumns=True)


TEXT_SQL = "course_title || ' |: ' || about || ' | ' || learn"


@query(f"""WITH {t.LONG_LISTING_SQL}
SELECT course_ref, l_linenumber, sha256(lower({TEXT_SQL} || skill_title)) AS unique_id FROM li""")
def content_id(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.long_listing(spark, folder)
    text = tx.course_text(F.col("course_title"), F.col("about"), F.col("learn"))
    return rows.select("course_ref", "l_linenumber", tx.content_id(text, F.col("skill_title")).alias("unique_id"))


@query("SELECT doc_id, sha256(lower(trim(text, E' \\n\\t\\r'))) AS id FROM documents")
def content_id_stripped(spark: SparkSession, folder: str) -> DataFrame:
    return t.table(spark, folder, "documents").select("doc_id", tx.content_id_stripped(F.col("text")).alias("id"))


@query(f"""WITH {t.LONG_LISTING_SQL}
SELECT course_ref, l_linenumber, CAST(length({TEXT_SQL}) AS INTEGER) AS n_chars, sha256({TEXT_SQL}) AS digest FROM li""")
def course_text(spark: SparkSession, folder: str) -> DataFrame:
    rows = t.long_listing(spark, folder)
    text = tx.course_text(F.col("course_title"), F.col("about"), F.col("learn"))
    return rows.select(
        "course_ref", "l_linenumber", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("digest")
    )


@query("""SELECT p_brand || ' (' || p_name || ')' AS label, p_brand AS alias, p_name AS full_name, count(*) AS n_rows
FROM part GROUP BY ALL""")
def split_sector_label(spark: SparkSession, folder: str) -> DataFrame:
    label = F.concat("p_brand", F.lit(" ("), "p_name", F.lit(")"))
    rows = t.table(spark, folder, "part").select(label.alias("label"))
    split = rows.select(
        "label", tx.sector_alias(F.col("label")).alias("alias"), tx.sector_name(F.col("label")).alias("full_name")
    )
    return split.groupBy("label", "alias", "full_name").agg(F.count("*").alias("n_rows"))


# Cells of every kind the list tests tell apart, by line number.
CELLS = {
    0: ('["', '"]'),
    1: ("['", "']"),
    2: ('  ["', '"] '),
    3: ("[", "]"),
    4: ('["', '"]]'),
    5: ('["', '"] ["x"]'),
    6: ("", ""),
}


def cells(spark: SparkSession, folder: str) -> DataFrame:
    cell = F.lit(None).cast("string")
    for kind, (left, right) in CELLS.items():
        text = F.concat(F.lit(left), F.lower(F.trim("skill_title")), F.lit(right))
        cell = F.when(F.col("l_linenumber") % 7 == kind, text).otherwise(cell)
    return t.listing(spark, folder).select("course_ref", "l_linenumber", cell.alias("cell"))


CELLS_SQL = t.LISTING_SQL + ", cells AS (SELECT course_ref, l_linenumber, skill_key, CASE l_linenumber % 7 {} END AS cell FROM li)".format(
    " ".join(
        "WHEN {} THEN '{}' || skill_key || '{}'".format(kind, left.replace("'", "''"), right.replace("'", "''"))
        for kind, (left, right) in CELLS.items()
    )
)


@query(f"""WITH {CELLS_SQL}
SELECT course_ref, l_linenumber, cell, json_valid(trim(cell)) AND trim(cell) LIKE '[%' AS list_like FROM cells""")
def is_list_like(spark: SparkSession, folder: str) -> DataFrame:
    return cells(spark, folder).withColumn("list_like", tx.is_list_like(F.col("cell")))


@query(f"""WITH {runs.LIST_CELLS_SQL}
SELECT course_ref, l_linenumber, skill_title AS cell,
       CASE l_linenumber % 4 WHEN 0 THEN skill_key || '|extra ' || skill_key WHEN 1 THEN skill_key WHEN 2 THEN '' END AS skills
FROM li""")
def parse_list_cell(spark: SparkSession, folder: str) -> DataFrame:
    parsed = F.array_join(tx.parse_list_cell(F.col("skill_title")), "|").alias("skills")
    return runs.list_cells(spark, folder).select("course_ref", "l_linenumber", F.col("skill_title").alias("cell"), parsed)


@query(f"""WITH {runs.LIST_CELLS_SQL}
SELECT course_ref, l_linenumber, skill_key AS skill FROM li WHERE l_linenumber % 4 IN (0, 1)
UNION ALL SELECT course_ref, l_linenumber, 'extra ' || skill_key FROM li WHERE l_linenumber % 4 = 0
UNION ALL SELECT course_ref, l_linenumber, NULL FROM li WHERE l_linenumber % 4 IN (2, 3)""")
def explode_skills(spark: SparkSession, folder: str) -> DataFrame:
    """Empty lists and plain cells stay as one row without a skill."""
    parsed = F.explode_outer(tx.parse_list_cell(F.col("skill_title"))).alias("skill")
    return runs.list_cells(spark, folder).select("course_ref", "l_linenumber", parsed)


TITLE_FORMS = {0: ("", ""), 1: ("['", "']"), 2: ("[", ""), 3: ("", "]tail"), 4: ("[", "]")}


def title_forms(spark: SparkSession, folder: str) -> DataFrame:
    title = F.lit(None).cast("string")
    for kind, (left, right) in TITLE_FORMS.items():
        text = F.concat(F.lit(left), F.lower(F.trim("skill_title")), F.lit(right))
        title = F.when(F.col("l_linenumber") % 6 == kind, text).otherwise(title)
    return t.listing(spark, folder).withColumn("skill_title", title)


TITLE_FORMS_SQL = t.LISTING_SQL.replace(
    "li AS (SELECT * FROM li0)",
    "li AS (SELECT * REPLACE (CASE l_linenumber % 6 {} END AS skill_title) FROM li0)".format(
        " ".join(
            "WHEN {} THEN '{}' || skill_key || '{}'".format(kind, left.replace("'", "''"), right.replace("'", "''"))
            for kind, (left, right) in TITLE_FORMS.items()
        )
    ),
)
TITLE_OK_SQL = "skill_title IS NULL OR regexp_full_match(skill_title, '[^\\[\\]]+') OR regexp_full_match(skill_title, '\\[.*\\]')"


@query(f"WITH {TITLE_FORMS_SQL} SELECT course_ref, l_linenumber, skill_title, ({TITLE_OK_SQL}) AS ok FROM li")
def title_format_ok(spark: SparkSession, folder: str) -> DataFrame:
    ok = tx.title_format_ok(F.col("skill_title")).alias("ok")
    return title_forms(spark, folder).select("course_ref", "l_linenumber", "skill_title", ok)


# Answers of every kind the parser meets, by the fixed round-one answer.
ANSWER_TEXTS = {
    0: '{"proficiency_level": "3", "reason": "r", "confidence": "high"}',
    1: '{"proficiency_level": 4.0, "reason": "r", "confidence": "low", "more": 1}',
    2: '{"reason": "no level", "confidence": "medium"}',
    3: "",
    4: "oops",
    5: "[1]",
    6: '{"proficiency_level": "high", "reason": "r", "confidence": "low"}',
}
PARSED = {
    0: (3, "r", "high"),
    1: (4, "r", "low"),
    2: (0, "no level", "medium"),
    3: (0, "answer is not a JSON object", "low"),
    4: (0, "answer is not a JSON object", "low"),
    5: (0, "answer is not a JSON object", "low"),
    6: (0, "r", "low"),
}
PARSED_SQL = "parsed(answer1, level, reason, confidence) AS (VALUES %s)" % ", ".join(
    f"({k}, {level}, '{reason}', '{confidence}')" for k, (level, reason, confidence) in PARSED.items()
)


def answers(spark: SparkSession, folder: str, texts: dict[int, str]) -> DataFrame:
    answer = F.lit(None).cast("string")
    for kind, text in texts.items():
        answer = F.when(F.col("answer1") == kind, text).otherwise(answer)
    return t.listing(spark, folder).select("course_ref", "l_linenumber", answer.alias("answer"))


@query(f"""WITH {t.LISTING_SQL}, {PARSED_SQL}
SELECT course_ref, l_linenumber, level, reason, confidence FROM li JOIN parsed USING (answer1)""")
def parse_answer(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_round1(F.col("answer")).alias("a")
    return answers(spark, folder, ANSWER_TEXTS).select("course_ref", "l_linenumber", parsed).select(
        "course_ref", "l_linenumber", "a.*"
    )


DEFAULT_TEXTS = {
    0: '{"proficiency": 5.0, "reason": "r", "confidence": "high"}',
    1: '{"proficiency": " 2 "}',
    2: '{"reason": "r"}',
    3: "{}",
    4: "",
    5: "oops",
    6: '{"proficiency": 2.7, "confidence": "low"}',
}
DEFAULTS_SQL = """parsed(answer1, level, reason, confidence) AS (VALUES
  (0, 5, 'r', 'high'), (1, 2, '', ''), (2, 0, 'r', ''), (3, 0, '', ''), (4, 0, '', ''), (5, 0, '', ''), (6, 0, '', 'low'))"""


@query(f"""WITH {t.LISTING_SQL}, {DEFAULTS_SQL}
SELECT course_ref, l_linenumber, level, reason, confidence FROM li JOIN parsed USING (answer1)""")
def answer_defaults(spark: SparkSession, folder: str) -> DataFrame:
    parsed = parse_round2(F.col("answer")).alias("a")
    return answers(spark, folder, DEFAULT_TEXTS).select("course_ref", "l_linenumber", parsed).select(
        "course_ref", "l_linenumber", "a.*"
    )


@query("""WITH uris AS (SELECT page_id, regexp_replace(url, '^https?://', CASE WHEN page_id % 4 = 0 THEN '' ELSE 's3://' END) AS uri FROM pages)
SELECT page_id, CASE WHEN regexp_matches(uri, '^s3://[^/]+/') THEN regexp_extract(uri, '^s3://([^/]+)/(.*)$', 1) END AS bucket,
       CASE WHEN regexp_matches(uri, '^s3://[^/]+/') THEN regexp_extract(uri, '^s3://([^/]+)/(.*)$', 2) END AS key
FROM uris""")
def split_uri(spark: SparkSession, folder: str) -> DataFrame:
    scheme = F.when(F.col("page_id") % 4 == 0, "").otherwise("s3://")
    uri = F.regexp_replace(F.col("url"), F.lit("^https?://"), scheme)
    rows = t.table(spark, folder, "pages").select("page_id", uri.alias("uri"))
    return rows.select("page_id", tx.uri_bucket(F.col("uri")).alias("bucket"), tx.uri_key(F.col("uri")).alias("key"))


def user_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per user: its events are the work rows, errors are pending."""
    events = t.table(spark, folder, "events").withColumn("done", F.col("event_type") != "error")
    return progress.run_counts(events, ["user_id"])


USER_RUNS_SQL = """
runs AS (
  SELECT user_id, count(*) AS n_total, count(*) FILTER (WHERE event_type <> 'error') AS n_done,
         count(*) FILTER (WHERE event_type = 'error') AS n_pending
  FROM events GROUP BY user_id)
"""


@query(f"WITH {USER_RUNS_SQL} SELECT user_id, n_total, n_done, n_pending FROM runs")
def agg_run_counts(spark: SparkSession, folder: str) -> DataFrame:
    return user_runs(spark, folder)


@query(f"WITH {USER_RUNS_SQL} SELECT user_id, CAST(round(n_done * 1e6 / n_total) AS BIGINT) AS progress_ppm FROM runs")
def run_progress(spark: SparkSession, folder: str) -> DataFrame:
    share = progress.progress(F.col("n_done"), F.col("n_total"))
    return user_runs(spark, folder).select("user_id", F.round(share * 1e6).cast("bigint").alias("progress_ppm"))


# Done, total and elapsed seconds of a run, from the order of its events.
ETA_SQL = """
r AS (SELECT o_custkey AS run, count(*) * 37 AS total, count(*) FILTER (WHERE o_orderstatus <> 'O') * 31 AS done,
             CAST(count(*) * 16 AS DOUBLE) AS elapsed FROM orders GROUP BY o_custkey),
parts AS (
  SELECT *, total - done AS rest, elapsed - floor(done / 60) * 10 AS working, 60 - done % 60 AS room FROM r),
secs AS (
  SELECT run, total, done,
         CASE WHEN done = 0 THEN total * 0.6::DOUBLE + floor(total / 60) * 10
              WHEN working > 0 THEN rest * working / done + CASE WHEN rest <= room THEN 0 ELSE (1 + floor((rest - room) / 60)) * 10 END
              ELSE rest * 0.6::DOUBLE END AS s
  FROM parts),
hm AS (SELECT *, CAST(floor(s / 3600) AS BIGINT) AS h, CAST(floor((s - floor(s / 3600) * 3600) / 60) AS BIGINT) AS m,
              CAST(floor(s / 60 + 0.5) AS BIGINT) AS mins FROM secs)
SELECT run, total, done,
  CASE WHEN s > 3600 THEN 'About ' || h || ' hour' || CASE WHEN h > 1 THEN 's' ELSE '' END
         || CASE WHEN m > 0 THEN ' and ' || m || ' minute' || CASE WHEN m > 1 THEN 's' ELSE '' END ELSE '' END || ' remaining'
       WHEN s > 60 THEN 'About ' || mins || ' minute' || CASE WHEN mins > 1 THEN 's' ELSE '' END || ' remaining'
       ELSE 'Less than 1 minute remaining' END AS eta
FROM hm
"""


@query(f"WITH {ETA_SQL}")
def run_eta(spark: SparkSession, folder: str) -> DataFrame:
    """Remaining time of one run per customer."""
    runs_ = t.table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("run")).agg(
        (F.count("*") * 37).alias("total"),
        (F.count_if(F.col("o_orderstatus") != "O") * 31).alias("done"),
        (F.count("*") * 16).cast("double").alias("elapsed"),
    )
    seconds = progress.eta_seconds(F.col("done"), F.col("total"), F.col("elapsed"))
    return runs_.withColumn("s", seconds).select("run", "total", "done", progress.eta_text(F.col("s")).alias("eta"))
