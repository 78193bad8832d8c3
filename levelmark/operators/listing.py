"""Listing preparation: null rows, dedupe, list cells, descriptions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmark.functions.text import is_list_like, normalise_key, parse_list_cell, strip
from levelmark.operators.dedupe import keep_first
from levelmark.operators.joins import hot_keys, salted_join
from levelmark.schemas import DESCRIPTION_COLUMNS

OLD_SKILL_COLUMN = "Skills Title 2K"  # fixed value


def rename_if_present(df: DataFrame, old: str = OLD_SKILL_COLUMN, new: str = "Skill Title") -> DataFrame:
    return df.withColumnRenamed(old, new)


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def dedupe_then_drop(listing: DataFrame, required: list[str], order: list[str], title: str = "skill_title") -> DataFrame:
    """Run order: first row per course and title, then rows without nulls."""
    return keep_first(listing, ["course_ref", title], order).na.drop("any", subset=required)


def drop_then_dedupe(listing: DataFrame, required: list[str], order: list[str]) -> DataFrame:
    """Upload order: rows without nulls, then first row per course and title."""
    return keep_first(listing.na.drop("any", subset=required), ["course_ref", "skill_title"], order)


def mixed_formats(listing: DataFrame) -> DataFrame:
    """One row: list-like titles, plain titles, and whether both occur."""
    title = F.col("skill_title")
    list_like = is_list_like(title)
    plain = title.isNotNull() & ~list_like & (strip(title) != "")
    counts = listing.agg(F.count_if(list_like).alias("n_list"), F.count_if(plain).alias("n_plain"))
    return counts.withColumn("mixed", (F.col("n_list") > 0) & (F.col("n_plain") > 0))


def course_descriptions(listing: DataFrame, order: list[str]) -> DataFrame:
    """First description per course, courses without a key left out."""
    columns = ["course_ref", *DESCRIPTION_COLUMNS]
    narrow = listing.na.drop(subset=["course_ref"]).select(*columns, *[c for c in order if c not in columns])
    return keep_first(narrow, ["course_ref"], order).select(*columns)


def extract_list_skills(
    listing: DataFrame,
    order: list[str],
    keep_plain: bool = False,
    hot: DataFrame | None = None,
    hot_rows: int | None = None,
    join=None,
) -> DataFrame:
    """One row per skill of every list cell, with the course's first
    description; plain rows only on request. `join` takes the place of the
    salted join where the listing is stored by course."""
    position = order_only(order)
    # Cells without a list and empty lists give no rows.
    skills = listing.select("course_ref", *position, F.explode(parse_list_cell(F.col("skill_title"))).alias("skill_title"))
    described, salt_by = course_descriptions(listing, order), [*position, "skill_title"]
    if join is None:
        hot = hot_keys(listing, ["course_ref"], hot_rows) if hot is None else hot
        with_meta = salted_join(skills, described, ["course_ref"], "left", salt_by, hot=hot)
    else:
        with_meta = join(skills, described, ["course_ref"], "left", salt_by)
    columns = ["course_ref", "skill_title", *DESCRIPTION_COLUMNS, *position]
    exploded = with_meta.select(*columns)
    if not keep_plain:
        return exploded
    plain = listing.where(~F.coalesce(F.col("skill_title").startswith("["), F.lit(False)))
    return exploded.unionByName(plain.select(*columns))


def order_only(order: list[str]) -> list[str]:
    return [c for c in order if c != "course_ref"]


def preprocess(
    listing: DataFrame,
    required: list[str],
    order: list[str],
    complex_format: bool = False,
) -> DataFrame:
    """Upload preprocessing: drop null rows, dedupe, optionally list cells."""
    clean = drop_then_dedupe(listing, required, order)
    return extract_list_skills(clean, order) if complex_format else clean


def with_skill_key(listing: DataFrame) -> DataFrame:
    return listing.withColumn("skill_key", normalise_key(F.col("skill_title")))


def attach_descriptions(
    rows: DataFrame,
    descriptions: DataFrame,
    salt_by: list[str],
    hot: DataFrame | None = None,
    hot_rows: int | None = None,
    join=None,
) -> DataFrame:
    """Left join on the course; the joined description wins, the row's own one
    fills gaps, and either side may lack a column. `join` takes the place of the
    salted join where the rows are stored by course."""
    fresh = descriptions.select(
        "course_ref", *[F.col(c).alias(f"_{c}") for c in DESCRIPTION_COLUMNS if c in descriptions.columns]
    )
    if join is None:
        joined = salted_join(rows, fresh, ["course_ref"], "left", salt_by, hot=hot, hot_rows=hot_rows)
    else:
        joined = join(rows, fresh, ["course_ref"], "left", salt_by)
    for c in DESCRIPTION_COLUMNS:
        sides = [s for s in (f"_{c}", c) if s in joined.columns]
        if sides:
            joined = joined.withColumn(c, F.coalesce(*[F.col(s) for s in sides]))
    return joined.drop(*[f"_{c}" for c in DESCRIPTION_COLUMNS])
