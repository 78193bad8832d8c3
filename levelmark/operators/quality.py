"""Validation rules; each returns rows (dataset, rule, column, n_bad, message)
and a dataset passes when no row comes back."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levelmark.functions.text import file_name, file_stem, parse_list_cell, title_format_ok
from levelmark.reference_values import sector_dimension

# Rule, column, number of bad rows (an aggregate), message.
Check = tuple[str, str, Column, str]

# Parts of the expected file names.
FRAMEWORK_PREFIX = "SFW_"
LISTING_SUFFIX = "_sector_course_listing"


def _counted(df: DataFrame, dataset: str, checks: list[Check]) -> DataFrame:
    """All checks of a table in one pass."""
    if not checks:
        checks = [("nothing_to_check", "*", F.lit(0), "")]
    counts = df.agg(*[count.cast("bigint").alias(f"_{i}") for i, (_, _, count, _) in enumerate(checks)])
    cells = [
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(rule).alias("rule"),
            F.lit(column).alias("column"),
            F.col(f"_{i}").alias("n_bad"),
            F.lit(message).alias("message"),
        )
        for i, (rule, column, _, message) in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*cells))).where("n_bad > 0")


def column_checks(df: DataFrame, expected: list[str]) -> list[Check]:
    """Missing and extra columns; every row counts as bad."""
    rows = F.greatest(F.count("*"), F.lit(1))
    missing = sorted(set(expected) - set(df.columns))
    extra = sorted(set(df.columns) - set(expected))
    return [("missing_column", c, rows, "column is missing") for c in missing] + [
        ("extra_column", c, rows, "column is not expected") for c in extra
    ]


def text_checks(df: DataFrame, columns: list[str]) -> list[Check]:
    """Columns that should be text but are not; every filled cell is bad."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return [
        ("not_text", c, F.greatest(F.count(c), F.lit(1)), f"should be text, is {kinds[c].simpleString()}")
        for c in columns
        if c in kinds and not isinstance(kinds[c], T.StringType)
    ]


def level_checks(column: str) -> list[Check]:
    """Level read as text: not a number, not whole, empty; each counted apart."""
    number = F.col(column).try_cast("double")
    return [
        ("not_numeric", column, F.count_if(F.col(column).isNotNull() & number.isNull()), "should be a number"),
        ("not_whole", column, F.count_if(number != F.floor(number)), "should be a whole number"),
        ("empty_level", column, F.count_if(F.col(column).isNull()), "should not be empty"),
    ]


def no_rows_check() -> Check:
    return ("no_rows", "*", F.when(F.count("*") == 0, 1).otherwise(0), "there are no data rows")


def all_null_check(column: str) -> Check:
    empty = (F.count("*") > 0) & (F.count(column) == 0)
    return ("all_null", column, F.when(empty, F.count("*")).otherwise(0), "column is completely empty")


def title_format_check(column: str = "skill_title") -> Check:
    return ("title_format", column, F.count_if(~title_format_ok(F.col(column))), "neither a name nor a list")


def column_names(df: DataFrame, dataset: str, expected: list[str]) -> DataFrame:
    return _counted(df, dataset, column_checks(df, expected))


def level_types(df: DataFrame, dataset: str, column: str = "level") -> DataFrame:
    return _counted(df, dataset, level_checks(column))


def no_rows(df: DataFrame, dataset: str) -> DataFrame:
    return _counted(df, dataset, [no_rows_check()])


def all_null(df: DataFrame, dataset: str, columns: list[str]) -> DataFrame:
    return _counted(df, dataset, [all_null_check(c) for c in columns])


def list_cell_check(column: str = "skill_title") -> Check:
    """Cells that start a list but are none: they would give no skills."""
    cell = F.col(column)
    unreadable = cell.startswith("[") & parse_list_cell(cell).isNull()
    return ("list_cell", column, F.count_if(unreadable), "starts like a list but cannot be read as one")


def bad_titles(listing: DataFrame) -> DataFrame:
    """Distinct titles of unknown format with their number of rows."""
    return listing.where(~title_format_ok(F.col("skill_title"))).groupBy("skill_title").agg(F.count("*").alias("n_bad"))


def framework_report(df: DataFrame, dataset: str, expected: list[str], text_columns: list[str]) -> DataFrame:
    """All framework rules in one pass over the table."""
    checks = [*column_checks(df, expected), *text_checks(df, text_columns), no_rows_check()]
    if "level" in df.columns:
        checks += level_checks("level")
    return _counted(df, dataset, checks)


def listing_report(df: DataFrame, dataset: str, expected: list[str], text_columns: list[str]) -> DataFrame:
    """All listing rules in one pass over the table."""
    checks = [*column_checks(df, expected), *text_checks(df, text_columns), no_rows_check()]
    checks += [all_null_check(c) for c in ("course_ref", "course_title") if c in df.columns]
    if "skill_title" in df.columns:
        checks += [title_format_check(), list_cell_check()]
    return _counted(df, dataset, checks)


def report_passes(report: DataFrame) -> DataFrame:
    """One row: number of failed checks and whether the run may go on."""
    return report.agg(F.count("*").alias("n_failed"), (F.count("*") == 0).alias("passed"))


def empty_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("length") == 0).select("path", F.lit("empty_file").alias("rule"))


def framework_names(files: DataFrame, alias: str | None = None) -> DataFrame:
    """Failing rule per framework file name, null when it is right."""
    stem = file_stem(file_name(F.col("path")))
    named = files.withColumn("full_name", F.substr(stem, F.lit(len(FRAMEWORK_PREFIX) + 1)))
    known = F.broadcast(sector_dimension(files.sparkSession).select("full_name", "alias"))
    rule = (
        F.when(~stem.startswith(FRAMEWORK_PREFIX), "prefix")
        .when(F.col("full_name") == "", "sector_missing")
        .when(F.col("alias").isNull(), "sector_unknown")
    )
    if alias is not None:
        rule = rule.when(F.col("alias") != alias, "other_sector")
    return named.join(known, "full_name", "left").withColumn("rule", rule).select("path", "rule")


def listing_names(files: DataFrame, selected: str | None = None) -> DataFrame:
    """Failing rule per listing file name, null when it is right."""
    stem = file_stem(file_name(F.col("path")))
    prefix = F.regexp_replace(stem, LISTING_SUFFIX + "$", "")
    parts = F.split(prefix, "_", 2)
    named = files.withColumn("alias", F.get(parts, F.lit(0))).withColumn("named", F.get(parts, F.lit(1)))
    known = F.broadcast(sector_dimension(files.sparkSession).select("alias", F.col("full_name").alias("expected")))
    rule = (
        F.when(~stem.endswith(LISTING_SUFFIX), "suffix")
        .when(F.col("named").isNull(), "two_parts")
        .when(F.col("alias") == "", "alias_missing")
        .when(F.col("named") == "", "sector_missing")
        .when(F.col("alias") != F.upper("alias"), "alias_case")
        .when(F.col("expected").isNull(), "alias_unknown")
        .when(F.col("named") != (F.lit(selected) if selected else F.col("expected")), "name_mismatch")
    )
    return named.join(known, "alias", "left").withColumn("rule", rule).select("path", "rule")


def single_run(states: DataFrame, by: list[str]) -> DataFrame:
    """Exactly one saved state is expected (per group): none and many are errors."""
    status = F.when(F.count("*") == 0, "none").when(F.count("*") > 1, "many").otherwise("one")
    return states.groupBy(*by).agg(F.count("*").alias("n_runs"), status.alias("status"))
