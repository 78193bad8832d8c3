"""Connected components of a graph given by its edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmark.sources.shared import written


def _least(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, with the least of its node and the node's neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.join(least, "a")


def _large_star(edges: DataFrame) -> DataFrame:
    return _least(edges).where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every edge points from its larger node to its smaller one here."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = down.join(down.groupBy("a").agg(F.min("b").alias("least")), "a")
    ends = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return ends.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), with root its component's
    least node. Alternates large and small stars (Kiveris et al., 2014) until
    all edges point to a root; every round is stored."""
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges")
    known = None
    while True:
        edges = written(_small_star(_large_star(edges)), "stars")
        print_ = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = tuple(edges.agg(F.count("*"), print_).first())
        if now == known:
            break
        known = now
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
