"""Tables derived from the framework: keys, levels, items, knowledge base."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmark.functions.text import normalise_key
from levelmark.reference_values import ITEM_SEPARATOR

PAGE_ROWS = 10_000


def sector_framework(framework: DataFrame, sectors: list[str]) -> DataFrame:
    """Rows of the chosen sectors with the normalised topic key."""
    return framework.where(F.col("sector").isin(*sectors)).withColumn("skill_key", normalise_key(F.col("title")))


def topic_keys(framework: DataFrame) -> DataFrame:
    return framework.where(F.col("skill_key").isNotNull()).select("skill_key").distinct()


def leveled(framework: DataFrame) -> DataFrame:
    """Rows without a level define nothing."""
    return framework.where(F.col("level").isNotNull())


def level_pairs(framework: DataFrame, by: str = "skill_key") -> DataFrame:
    """One row per topic and level it defines."""
    return leveled(framework).select(by, "level").distinct()


def level_sets(framework: DataFrame, by: str = "skill_key") -> DataFrame:
    """Sorted distinct levels per topic; only distinct pairs are gathered."""
    return level_pairs(framework, by).groupBy(by).agg(F.sort_array(F.collect_list("level")).alias("levels"))


def first_title_levels(framework: DataFrame) -> DataFrame:
    """Levels of the first raw title (by name) of each topic key."""
    per_title = level_pairs(framework.withColumn("_k", F.struct("skill_key", "title")), "_k")
    sets = per_title.groupBy("_k").agg(F.sort_array(F.collect_list("level")).alias("levels"))
    return sets.groupBy(F.col("_k.skill_key").alias("skill_key")).agg(
        F.min_by("levels", F.col("_k.title")).alias("levels")
    )


def distinct_items(framework: DataFrame, order: list[str]) -> DataFrame:
    """One row per topic, level, class and item with its first position; repeats
    are folded before the shuffle."""
    return leveled(framework).groupBy("skill_key", "level", "item_class", "item").agg(
        F.min(F.struct(F.struct(*order).alias("pos"), "level_descr")).alias("first")
    )


def page_of(position: Column, order: list[str], page_rows: int) -> Column:
    """Page of a source position, named by its start. The last column of `order`
    is an integer, so a page holds at most `page_rows` positions."""
    *leading, last = [position[c] for c in order]
    named = [c.alias(n) for c, n in zip(leading, order)]
    return F.struct(*named, (last - last % page_rows).cast("bigint").alias("page"))


def skill_pages(items: DataFrame, order: list[str], page_rows: int = PAGE_ROWS) -> DataFrame:
    """Per topic and level: first description, distinct knowledge and ability
    items in first-seen order, from `distinct_items`. One row per page of source
    positions: an item counts where it is first seen, so a page stays small
    however many items a topic has."""

    def listed(item_class: str) -> Column:
        wanted = (F.col("item_class") == item_class) & F.col("item").isNotNull()
        cells = F.collect_list(F.when(wanted, F.struct(F.col("first.pos").alias("pos"), "item")))
        return F.transform(F.array_sort(cells), lambda cell: cell["item"])

    page = page_of(F.col("first.pos"), order, page_rows)
    return items.groupBy("skill_key", "level", page.alias("page")).agg(
        F.min("first").alias("first"), listed("knowledge").alias("knowledge"), listed("ability").alias("ability")
    )


def skill_info(pages: DataFrame) -> DataFrame:
    """Pages of each topic and level put together: one row, however long."""

    def joined(lists: str) -> Column:
        in_order = F.array_sort(F.collect_list(F.struct("page", lists)))
        return F.flatten(F.transform(in_order, lambda cell: cell[lists]))

    whole = pages.groupBy("skill_key", "level").agg(
        F.min("first").alias("first"), joined("knowledge").alias("knowledge"), joined("ability").alias("ability")
    )
    return whole.select("skill_key", "level", "first.*", "knowledge", "ability")


def knowledge_pages(framework: DataFrame, order: list[str], page_rows: int = PAGE_ROWS) -> DataFrame:
    """Items per topic and level joined in source order, repeats kept, nulls as
    empty text; one row per page of source positions, so no group grows with
    the topic."""
    position = ", ".join(f"`{c}`" for c in order)
    page = page_of(F.struct(*order), order, page_rows)
    joined = f"listagg(coalesce(item, ''), '{ITEM_SEPARATOR}') WITHIN GROUP (ORDER BY {position})"
    return leveled(framework).groupBy("skill_key", "level", page.alias("page")).agg(F.expr(joined).alias("items"))


def knowledge_base(pages: DataFrame) -> DataFrame:
    """Per topic: its levels ascending, each with all pages joined, as JSON."""
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("page", "items"))), lambda cell: cell["items"])
    levels = pages.groupBy("skill_key", "level").agg(F.array_join(in_order, ITEM_SEPARATOR).alias("items"))
    listed = F.array_sort(F.collect_list(F.struct("level", "items")))
    return levels.groupBy("skill_key").agg(F.to_json(listed).alias("knowledge"))
