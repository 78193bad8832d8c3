"""Mixing sources to target weights through a hypergeometric splitting tree.

Each source's documents are put in a random order and cut into blocks of equal
numbers of words. A source's target says how many of its blocks the mixture
draws: the quota, exact, the last block trimmed to the target; beyond the
source's size the blocks come round a second time. A binary tree over the output
shards then splits the quotas: a node's share of every source is drawn from the
multivariate hypergeometric law, so each leaf holds what blind dealing of all
drawn blocks would have given it, while all sums stay exact. Leaf shards take
disjoint runs of each source's shuffled blocks and shuffle their rows locally.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levelmark.llm.common import ROW_KEYS, exploded, row_keys, running_totals, text_or_empty
from levelmark.operators.joins import lookup_join
from levelmark.sources.shared import written

WEIGHTS = (3, 1, 2)
#: Words of the mixture by words of all sources, and most often a document may come.
SHARE, MOST = 1.5, 2
LEVELS, BLOCKS_PER_SHARD, SEED = 3, 256, 17
WORD = r"[^\x20\x09-\x0D]+"
SOURCE = ["_no_source", "_source"]


def _targets(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds `target` to (SOURCE, words): the share of all words by weight, a
    source's excess over MOST times its words going to the others by weight.

    The last level of the filling is found from running sums over the sources
    in the order in which they fill up; one number comes back.
    """
    ranked = running_totals(sizes.withColumn("_one", F.lit(1).cast("long")), SOURCE, rank="_one", words_before="words")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    filled = ranked.withColumn("weight", weight.cast("long")).withColumn("most", F.col("words") * MOST).drop("_one")
    filled = filled.withColumn("full_at", F.col("most") / F.col("weight"))
    filled = running_totals(filled, ["full_at", "rank"], most_before="most", weight_before="weight")
    sums = filled.agg(F.sum("words").alias("words"), F.sum("weight").alias("weight")).first()
    if not sums["weight"]:
        return filled.withColumn("target", F.lit(0.0))
    level = (F.lit(SHARE * sums["words"]) - F.col("most_before")) / (F.lit(sums["weight"]) - F.col("weight_before"))
    first = filled.withColumn("level", level).where("level <= full_at").agg(F.min_by("level", F.struct("full_at", "rank"))).first()[0]
    return filled.withColumn("target", F.least(F.col("most").cast("double"), F.col("weight") * F.lit(float(first or 0.0))))


def _split(seed: int):
    def split(node: pd.DataFrame) -> pd.DataFrame:
        """One node's quotas dealt to its two children; a row per source."""
        node = node.sort_values("rank")
        blocks = node["blocks"].to_numpy()
        number = int(node["node"].iloc[0])
        draw = np.random.default_rng([seed, number])
        left = draw.multivariate_hypergeometric(blocks, int(blocks.sum()) // 2, method="marginals")
        sides = [(2 * number, left), (2 * number + 1, blocks - left)]
        return pd.concat(pd.DataFrame({"node": n, "rank": node["rank"], "blocks": b}) for n, b in sides)

    return split


def _shares(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(rank, ends): where each shard's run of the source's drawn blocks ends.

    Every group of the tree holds one number per source."""
    tree = quotas.select(F.lit(1).cast("long").alias("node"), "rank", "blocks")
    for _ in range(levels):
        tree = tree.groupBy("node").applyInPandas(_split(seed), "node long, rank long, blocks long")
    run = Window.partitionBy("rank").orderBy("node")
    tree = tree.withColumn("end", F.sum("blocks").over(run))
    return tree.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("node", "end"))), lambda x: x["end"]).alias("ends"))


def plan_mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, `draws`,
    an array of (epoch, block, shard, place), one entry each time the mixture
    takes the document, ROW_KEYS, and `copy`, its number among the `copies` of
    its row.

    Size counts words of non-space characters; a null text has none. Sources
    stand in code-point order, null last, and weigh `weights`, repeating. Repeats
    of one row (id, source, text) stand side by side in the order and are drawn
    one by one. Documents without words may
    be drawn, which takes no words. Reruns agree: order and draws follow
    from `seed` and the rows. An empty table gives no rows; columns beside
    doc_id, source and text are not read.
    """
    rows = docs.select(
        "doc_id",
        "source",
        F.col("source").isNull().alias("_no_source"),
        F.coalesce("source", F.lit("")).alias("_source"),
        F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"),
        *row_keys("source"),
    )
    units = written(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "units")
    units = units.withColumn("_words", F.col("size") * F.col("copies"))

    sources = _targets(written(units.groupBy(*SOURCE).agg(F.sum("_words").alias("words")), "sources"), weights)
    block_words = F.lit(max(1, (sources.agg(F.sum("words")).first()[0] or 0) // (BLOCKS_PER_SHARD << levels)))
    sources = sources.withColumn("round", F.ceil(F.col("words") / block_words))
    over = F.greatest(F.col("target") - F.col("words"), F.lit(0.0))
    quota = F.ceil(F.least("target", "words") / block_words) + F.ceil(over / block_words)
    sources = written(sources.withColumn("blocks", quota.cast("long")), "quotas")
    sources = written(sources.join(_shares(sources, levels, seed), "rank"), "shares")

    shuffled = units.withColumn("_order", F.xxhash64(F.lit(seed), *ROW_KEYS))
    shuffled = running_totals(shuffled, [*SOURCE, "_order", *ROW_KEYS], _before="_words")
    facts = sources.select(*SOURCE, "words", "words_before", "target", "round", "ends")
    placed = lookup_join(shuffled, facts, SOURCE, "inner", ROW_KEYS)
    placed = exploded(placed, F.lit(1).cast("long"), F.col("copies"), "copy")
    # A document is taken when its middle lies before the target; blocks go by the middle too.
    middle = F.col("_before") - F.col("words_before") + (F.col("copy") - 0.5) * F.col("size")
    placed = placed.withColumn("_middle", middle).withColumn("_block", F.floor(middle / block_words))

    def draw(epoch: int):
        block = F.col("_block") + epoch * F.col("round")
        shard = F.least(F.size(F.filter("ends", lambda end: end <= block)), F.lit((1 << levels) - 1))
        place = F.xxhash64(F.lit(seed), F.lit(epoch), "_block", "copy", *ROW_KEYS)
        entry = F.named_struct(F.lit("epoch"), F.lit(epoch), F.lit("block"), block, F.lit("shard"), shard, F.lit("place"), place)
        return F.when(F.col("_middle") + epoch * F.col("words") < F.col("target"), entry)

    return placed.select(
        "doc_id",
        "size",
        "source",
        F.col("words").alias("source_size"),
        "target",
        F.array_compact(F.array(*map(draw, range(MOST)))).alias("draws"),
        *ROW_KEYS,
        "copy",
        "copies",
    )


def _numbered(rows: DataFrame) -> DataFrame:
    """`rows` (with ROW_KEYS), each with `copy`, its number among those of its keys.

    Equal rows are counted, not numbered, before the shuffle."""
    variant = F.xxhash64(*(part for c in rows.columns for part in (F.col(c).isNull(), F.col(c)))).alias("_variant")
    one = F.first(F.struct(*rows.columns)).alias("_row")
    variants = rows.groupBy(*ROW_KEYS, variant).agg(one, F.count("*").alias("_n"))
    variants = running_totals(variants, [*ROW_KEYS, "_variant"], _before="_n")
    first = variants.groupBy(*ROW_KEYS).agg(F.min("_before").alias("_first"))
    variants = lookup_join(variants, first, ROW_KEYS, "inner", [*ROW_KEYS, "_variant"])
    before = F.col("_before") - F.col("_first")
    variants = variants.select("_row", (before + 1).alias("_one"), (before + F.col("_n")).alias("_last"))
    return exploded(variants, F.col("_one"), F.col("_last"), "copy").select("_row.*", "copy")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, levels: int = LEVELS, seed: int = SEED) -> DataFrame:
    """The mixed documents: all columns of `docs`, as often as drawn, dealt to
    shards and shuffled inside them (rows lie in that order)."""
    plan = plan_mixture(docs, weights, levels, seed).where(F.size("draws") > 0)
    plan = written(plan.select(*ROW_KEYS, "copy", "copies", "draws"), "draws")
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # clear of the columns added on the way
    keyed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()), *row_keys("source"))
    single = plan.where("copies = 1").select(*ROW_KEYS, "draws")
    drawn = lookup_join(keyed, single, ROW_KEYS, "inner", ROW_KEYS)
    repeated = plan.where("copies > 1").select(*ROW_KEYS, "copy", "draws")
    if not repeated.isEmpty():
        keys = repeated.select(*ROW_KEYS).distinct()
        copies = _numbered(lookup_join(keyed, keys, ROW_KEYS, "left_semi", ROW_KEYS))
        on = [*ROW_KEYS, "copy"]
        drawn = drawn.unionByName(lookup_join(copies, repeated, on, "inner", on).drop("copy"))
    drawn = drawn.select(*named.values(), F.explode("draws").alias("_draw"))
    order = ["_draw.shard", "_draw.place"]
    return drawn.repartitionByRange(*order).sortWithinPartitions(*order).select(*(F.col(n).alias(c) for c, n in named.items()))
