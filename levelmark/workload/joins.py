"""Joins and aggregates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levelmark.functions.text import content_id, course_text
from levelmark.operators import taxonomy
from levelmark.operators.dedupe import keep_first
from levelmark.operators.joins import lookup_join
from levelmark.operators.listing import attach_descriptions, course_descriptions, mixed_formats
from levelmark.operators.routing import check_level, irrelevant_rows, join_answers, level_violations, relevant_rows
from levelmark.operators.taxonomy import level_pairs
from levelmark.plans.runs import pending, pending_filtered
from levelmark.sources.shared import written
from levelmark.workload import runs
from levelmark.workload import scoring as sc
from levelmark.workload import tables as t
from levelmark.workload.registry import query

PAGE = 1_000


def work_rows(spark: SparkSession, folder: str, rows: DataFrame | None = None) -> DataFrame:
    return relevant_rows(t.clean(spark, folder, rows=rows), t.topics(spark, folder), salt_by=["course_ref", "skill_title"])


@query(f"WITH {t.routed_sql()} SELECT course_ref, skill_title, skill_key FROM work")
def join_semi_in_sector(spark: SparkSession, folder: str) -> DataFrame:
    return work_rows(spark, folder).select("course_ref", "skill_title", "skill_key")


@query(f"WITH {t.routed_sql()} SELECT course_ref, skill_title, skill_key FROM routed WHERE relevance <> 'In Sector'")
def join_anti_irrelevant(spark: SparkSession, folder: str) -> DataFrame:
    rows = irrelevant_rows(t.clean(spark, folder), t.topics(spark, folder), salt_by=["course_ref", "skill_title"])
    return rows.select("course_ref", "skill_title", "skill_key")


@query(f"""WITH {t.routed_sql()},
ans AS (SELECT course_ref, skill_key, answer1 AS level FROM work)
SELECT w.course_ref, w.skill_title, a.level FROM work w JOIN ans a USING (course_ref, skill_key)""")
def join_inner_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Plain join semantics: titles that share a key multiply. The dedupe by
    raw title bounds a (course, key) group by its title variants."""
    # Cleaned once: both sides come from the stored rows.
    work = written(work_rows(spark, folder).select("course_ref", "skill_key", "skill_title", "answer1"), "work")
    answers = work.select("course_ref", "skill_key", F.col("answer1").alias("level"))
    joined = work.join(answers, ["course_ref", "skill_key"])
    return joined.select("course_ref", "skill_title", "level")


@query(f"""WITH {t.routed_sql()}, {t.first_descriptions_sql()}
SELECT w.course_ref, w.skill_title, d.about AS first_about, d.learn AS first_learn
FROM work w LEFT JOIN descr d ON w.course_ref = d.course_ref""")
def join_left_descr(spark: SparkSession, folder: str) -> DataFrame:
    def described(part: DataFrame, join) -> DataFrame:
        descr = course_descriptions(part, t.ORDER)
        firsts = descr.select("course_ref", F.col("about").alias("first_about"), F.col("learn").alias("first_learn"))
        joined = join(work_rows(spark, folder, part), firsts, ["course_ref"], "left", ["skill_title"])
        return joined.select("course_ref", "skill_title", "first_about", "first_learn")

    return t.stored_listing(spark, folder).apply(described)


@query(f"""WITH {t.FRAMEWORK_SQL}, {t.LISTING_SQL}
SELECT li.course_ref, li.l_linenumber, li.skill_key, p.level
FROM li LEFT JOIN pairs p ON li.skill_key = p.skill_key AND li.answer2 = p.level""")
def join_level_lookup(spark: SparkSession, folder: str) -> DataFrame:
    pairs = level_pairs(t.topics(spark, folder))
    rows = t.keyed(spark, folder).withColumn("level", F.col("answer2"))
    checked = check_level(rows, pairs, "level", "ok", salt_by=["course_ref", "l_linenumber"])
    return checked.select("course_ref", "l_linenumber", "skill_key", F.when(F.col("ok"), F.col("level")).alias("level"))


CONTENT_SQL = "sha256(lower('About |: ' || about || ' | ' || learn || skill_title))"


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a content id that many courses share."""
    text = course_text(F.lit("About"), F.col("about"), F.col("learn"))
    return work_rows(spark, folder).withColumn("unique_id", content_id(text, F.col("skill_title")))


@query(f"""WITH {t.routed_sql()},
ids AS (SELECT *, {CONTENT_SQL} AS unique_id FROM work),
ans AS (SELECT unique_id, min(answer2) AS level2 FROM ids WHERE answer2 > 0 GROUP BY unique_id)
SELECT course_ref, skill_title, unique_id, level2 FROM ids LEFT JOIN ans USING (unique_id)""")
def join_left_r2(spark: SparkSession, folder: str) -> DataFrame:
    # Read three times below: answers, hot ids, rows.
    columns = ["course_ref", "skill_title", "unique_id", "answer2"]
    ids = written(contents(spark, folder).select(*columns), "contents")
    answers = ids.where("answer2 > 0").groupBy("unique_id").agg(F.min("answer2").alias("level2"))
    joined = join_answers(ids, answers, ["unique_id"], "left", salt_by=["course_ref"])
    return joined.select("course_ref", "skill_title", "unique_id", "level2")


VARIANTS_SQL = """
variants AS (
  SELECT CASE WHEN ord % 3 = 0 THEN upper(title) ELSE title END AS title, skill_key, level FROM topics),
per_title AS (
  SELECT skill_key, title, string_agg(DISTINCT CAST(level AS VARCHAR), ',' ORDER BY CAST(level AS VARCHAR)) AS levels
  FROM variants GROUP BY ALL)
"""


def title_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Topics whose titles differ in case within one key."""
    title = F.when(F.col("ord") % 3 == 0, F.upper("title")).otherwise(F.col("title"))
    return t.topics(spark, folder).withColumn("title", title)


def joined_levels(levels: str):
    return F.array_join(F.col(levels).cast("array<string>"), ",")


@query(f"""WITH {t.FRAMEWORK_SQL}, {t.LISTING_SQL}, {VARIANTS_SQL},
firsts AS (SELECT skill_key, arg_min(levels, title) AS levels FROM per_title GROUP BY skill_key)
SELECT li.course_ref, li.l_linenumber, f.levels FROM li LEFT JOIN firsts f ON li.skill_key = f.skill_key""")
def join_first_match(spark: SparkSession, folder: str) -> DataFrame:
    firsts = taxonomy.first_title_levels(title_variants(spark, folder))
    texts = firsts.select("skill_key", joined_levels("levels").alias("levels"))
    joined = lookup_join(t.keyed(spark, folder), texts, ["skill_key"], "left", ["course_ref", "l_linenumber"])
    return joined.select("course_ref", "l_linenumber", "levels")


@query(f"""WITH {t.routed_sql()},
tagged AS (SELECT * FROM work WHERE answer2 > 0),
viol AS (
  SELECT DISTINCT skill_key, answer2 AS invalid_pl FROM tagged
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.skill_key = tagged.skill_key AND p.level = tagged.answer2))
SELECT t.course_ref, t.skill_title, t.answer2 AS level, v.invalid_pl
FROM tagged t FULL OUTER JOIN viol v ON t.skill_key = v.skill_key AND t.answer2 = v.invalid_pl""")
def join_outer_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Every violation comes from a tagged row, so checking each row against the
    framework gives the rows of the full outer join without building it."""
    topics = t.topics(spark, folder)
    tagged = work_rows(spark, folder).where("answer2 > 0").withColumn("level", F.col("answer2"))
    checked = check_level(tagged, level_pairs(topics), "level", "ok", salt_by=["course_ref"])
    return checked.select("course_ref", "skill_title", "level", F.when(~F.col("ok"), F.col("level")).alias("invalid_pl"))


@query(f"""WITH {runs.LIST_CELLS_SQL}, {t.first_descriptions_sql()}
SELECT li.course_ref, li.skill_title, d.course_title, d.about, d.learn
FROM li LEFT JOIN descr d ON li.course_ref = d.course_ref""")
def join_left_meta(spark: SparkSession, folder: str) -> DataFrame:
    def described(part: DataFrame, join) -> DataFrame:
        rows = runs.cells_of(part)
        bare = rows.select("course_ref", "skill_title", *t.ORDER)
        joined = attach_descriptions(bare, course_descriptions(rows, t.ORDER), salt_by=t.ORDER, join=join)
        return joined.select("course_ref", "skill_title", "course_title", "about", "learn")

    return t.stored_listing(spark, folder).apply(described)


@query(f"""WITH {t.routed_sql("skill_key")}
SELECT course_ref, skill_key FROM work WHERE answer1 < 3""")
def join_anti_pending(spark: SparkSession, folder: str) -> DataFrame:
    """Work without a good answer: no answer at all, or a failed call."""
    work = relevant_rows(t.clean(spark, folder, "skill_key"), t.topics(spark, folder), salt_by=["course_ref"])
    work = work.withColumn("work_id", F.concat_ws("/", F.col("course_ref").cast("string"), "skill_key"))
    failed = F.when(F.col("answer1") == 1, "stopped")
    answers = work.where("answer1 > 0 AND answer1 <> 2").select("work_id", failed.alias("error"))
    return pending(work, answers).select("course_ref", "skill_key")


@query(f"""WITH {t.routed_sql("skill_key")}
SELECT course_ref, skill_key FROM work WHERE NOT (l_linenumber = 1 AND answer1 > 2)""")
def join_pending_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Work without a good answer where few rows have one: most skip the join."""
    work = relevant_rows(t.clean(spark, folder, "skill_key"), t.topics(spark, folder), salt_by=["course_ref"])
    identity = F.concat_ws("/", F.col("course_ref").cast("string"), "skill_key").alias("work_id")
    # Read three times: the filter, and the two sides of it.
    work = written(work.select(identity, "course_ref", "skill_key", "answer1", "l_linenumber"), "work")
    failed = F.when(F.col("answer1") <= 2, "stopped")
    answers = work.where("l_linenumber = 1 AND answer1 > 0").select("work_id", failed.alias("error"))
    return pending_filtered(work, answers).select("course_ref", "skill_key")


@query(f"""WITH {t.FRAMEWORK_SQL}
SELECT skill_key, string_agg(CAST(level AS VARCHAR), ',' ORDER BY level) AS levels FROM pairs GROUP BY skill_key""")
def agg_level_set(spark: SparkSession, folder: str) -> DataFrame:
    sets = taxonomy.level_sets(t.topics(spark, folder))
    return sets.select("skill_key", joined_levels("levels").alias("levels"))


@query(f"WITH {t.FRAMEWORK_SQL}, {VARIANTS_SQL} SELECT title, levels FROM per_title")
def agg_level_set_title(spark: SparkSession, folder: str) -> DataFrame:
    sets = taxonomy.level_sets(title_variants(spark, folder), "title")
    return sets.select("title", joined_levels("levels").alias("levels"))


@query(f"""WITH {t.FRAMEWORK_SQL},
items AS (
  SELECT skill_key, level, item_class, item, min(ord) AS o, arg_min(level_descr, ord) AS level_descr
  FROM topics GROUP BY ALL)
SELECT skill_key, level, arg_min(level_descr, o) AS level_descr,
  coalesce(string_agg(item, '|' ORDER BY o) FILTER (WHERE item_class = 'knowledge' AND item IS NOT NULL), '') AS knowledge,
  coalesce(string_agg(item, '|' ORDER BY o) FILTER (WHERE item_class = 'ability' AND item IS NOT NULL), '') AS ability
FROM items GROUP BY skill_key, level""")
def agg_skill_info(spark: SparkSession, folder: str) -> DataFrame:
    items = taxonomy.distinct_items(t.topics(spark, folder), t.FRAMEWORK_ORDER)
    info = taxonomy.skill_info(taxonomy.skill_pages(items, t.FRAMEWORK_ORDER, PAGE))
    return info.select(
        "skill_key",
        "level",
        "level_descr",
        F.array_join("knowledge", "|").alias("knowledge"),
        F.array_join("ability", "|").alias("ability"),
    )


@query(f"WITH {t.FRAMEWORK_SQL}, {sc.KNOWLEDGE_SQL} SELECT skill_key, knowledge FROM kb")
def agg_knowledge_base(spark: SparkSession, folder: str) -> DataFrame:
    return taxonomy.knowledge_base(taxonomy.knowledge_pages(t.topics(spark, folder), t.FRAMEWORK_ORDER, PAGE))


@query(f"""WITH {runs.LIST_CELLS_SQL}, c AS (
  SELECT count(*) FILTER (WHERE l_linenumber % 4 IN (1, 2)) AS n_list,
         count(*) FILTER (WHERE l_linenumber % 4 IN (0, 3)) AS n_plain FROM li)
SELECT n_list, n_plain, n_list > 0 AND n_plain > 0 AS mixed FROM c""")
def agg_mixed_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Single-quoted lists count as plain titles."""
    return mixed_formats(runs.list_cells(spark, folder))


@query(f"""WITH {t.LISTING_SQL},
ranked AS (SELECT *, row_number() OVER (PARTITION BY course_ref, skill_title ORDER BY {t.ORDER_SQL}) AS rn FROM li)
SELECT course_ref, skill_title, about, l_linenumber, l_partkey FROM ranked WHERE rn = 1""")
def dedup_course_skill(spark: SparkSession, folder: str) -> DataFrame:
    first = keep_first(t.listing(spark, folder), ["course_ref", "skill_title"], t.ORDER)
    return first.select("course_ref", "skill_title", "about", "l_linenumber", "l_partkey")


@query(f"WITH {t.LISTING_SQL}, {t.first_descriptions_sql()} SELECT course_ref, course_title, about, learn FROM descr")
def dedup_course(spark: SparkSession, folder: str) -> DataFrame:
    return course_descriptions(t.listing(spark, folder), t.ORDER)


@query(f"""WITH {t.routed_sql()},
viol AS (
  SELECT DISTINCT w.skill_key, answer2 AS level FROM work w
  WHERE answer2 > 0 AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.skill_key = w.skill_key AND p.level = w.answer2))
SELECT skill_key, string_agg(CAST(level AS VARCHAR), ',' ORDER BY level) AS levels FROM viol GROUP BY skill_key""")
def agg_violations(spark: SparkSession, folder: str) -> DataFrame:
    tagged = work_rows(spark, folder).where("answer2 > 0").withColumn("level", F.col("answer2"))
    bad = level_violations(tagged, t.topics(spark, folder))
    sets = bad.groupBy("skill_key").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    return sets.select("skill_key", joined_levels("levels").alias("levels"))
