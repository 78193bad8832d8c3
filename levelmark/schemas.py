"""Input schemas and the short column names used inside the package."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Published column name -> name inside the package.
FRAMEWORK_COLUMNS = {
    "TSC_CCS_Type": "topic_type",
    "TSC_CCS Code": "topic_code",
    "Sector": "sector",
    "TSC_CCS Category": "category",
    "TSC_CCS Title": "title",
    "TSC_CCS Description": "topic_descr",
    "Proficiency Level": "level",
    "Proficiency Description": "level_descr",
    "Knowledge / Ability Classification": "item_class",
    "Knowledge / Ability Items": "item",
}
LISTING_COLUMNS = {
    "Course Reference Number": "course_ref",
    "Skill Title": "skill_title",
    "Course Title": "course_title",
    "About This Course": "about",
    "What You'll Learn": "learn",
}

DESCRIPTION_COLUMNS = ["course_title", "about", "learn"]

# Row position in the input files; "keep first" means first in this order.
FILE_ORDER = ["src_file", "src_row"]


def framework_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField(name, T.IntegerType() if name == "Proficiency Level" else T.StringType())
            for name in FRAMEWORK_COLUMNS
        ]
    )


def listing_schema() -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in LISTING_COLUMNS])


def shorten(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Published names (header spaces tolerated) to package names."""
    return df.toDF(*[columns.get(name.strip(), name.strip()) for name in df.columns])


def publish(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Package names back to published names."""
    back = {short: name for name, short in columns.items()}
    return df.toDF(*[back.get(name, name) for name in df.columns])
