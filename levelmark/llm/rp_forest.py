"""Nearest neighbours by a forest of random-projection trees.

Every tree splits space by hyperplanes through a bounded sample; every vector of
the table then falls into one leaf of each tree. A query walks all trees at once:
one priority queue holds the branches not taken, by how far beyond the splitting
planes they lie, and gives out leaves from near to far. The vectors of those
leaves are ranked exactly. How many leaves a query visits is set by measurement:
so many that a sample of queries finds the wanted part of its true neighbours.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levelmark.llm.common import schema_with
from levelmark.sources.shared import written

K, EVERY, SEED = 20, 20, 11
TREES = 4
#: Vectors the trees are built on, and queries the number of visits is measured on, at most.
SAMPLE, PROBES = 32_768, 64
#: Vectors of a leaf that are ranked together; larger leaves are cut into pieces.
LEAF_ROWS = 1024
#: Pieces of a leaf, and parts of the queries that visit it, met by one task at a time.
PIECE_ROWS, PART_QUERIES = 4 * LEAF_ROWS, 8192
#: Part of the true neighbours that the sampled queries must find.
RECALL = 0.95


@dataclass
class Forest:
    """Trees as arrays: node i has plane (normals[i], offsets[i]) and two
    children; a child below zero is leaf -(child + 1)."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: list[int]
    leaves: int
    radius: float

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors on a sphere in one more dimension, where the largest inner
        product with a query is the smallest angle."""
        inside = vectors / self.radius
        height = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", inside, inside)))
        return np.column_stack([inside, height])

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector (row) in each tree (column)."""
        points = self.lifted(vectors)
        out = np.empty((len(points), len(self.roots)), np.int64)
        for tree, root in enumerate(self.roots):
            at = np.full(len(points), root, np.int64)
            while (open_ := np.flatnonzero(at >= 0)).size:
                nodes = at[open_]
                side = np.einsum("ij,ij->i", points[open_], self.normals[nodes]) > self.offsets[nodes]
                at[open_] = self.children[nodes, side.astype(np.int64)]
            out[:, tree] = -at - 1
        return out

    def nearest_leaves(self, queries: np.ndarray, visits: int) -> Iterator[list[int]]:
        """For each query its leaves in the order of the shared queue, at most `visits`."""
        length = np.linalg.norm(queries, axis=1, keepdims=True)
        points = np.column_stack([queries / length, np.zeros(len(queries))])
        children = self.children.tolist()
        for row in points:
            beyond = (self.normals @ row - self.offsets).tolist()
            queue, found = [(0.0, root) for root in self.roots], []
            while queue and len(found) < visits:
                cost, node = heapq.heappop(queue)
                while node >= 0:
                    margin = beyond[node]
                    near, far = children[node][margin > 0], children[node][margin <= 0]
                    heapq.heappush(queue, (cost + margin * margin, far))
                    node = near
                found.append(-node - 1)
            yield found


def build_forest(sample: np.ndarray, radius: float, leaves: int, trees: int = TREES, seed: int = SEED) -> Forest:
    """Trees of about `leaves` leaves; planes halve the sample between two of its points."""
    forest = Forest(np.empty(0), np.empty(0), np.empty(0), [], 0, radius)
    points = forest.lifted(sample)
    random = np.random.default_rng(seed)
    normals, offsets, children = [], [], []

    def grow(members: np.ndarray, wanted: int) -> int:
        if wanted > 1 and len(members) >= 4:
            for _ in range(8):
                a, b = points[random.choice(members, 2, replace=False)]
                normal = a - b
                if (length := np.linalg.norm(normal)) > 0:
                    along = points[members] @ (normal / length)
                    cut = float(np.median(along))
                    right = along > cut
                    if right.any() and not right.all():
                        node = len(normals)
                        normals.append(normal / length)
                        offsets.append(cut)
                        children.append([0, 0])
                        children[node][0] = grow(members[~right], wanted // 2)
                        children[node][1] = grow(members[right], wanted - wanted // 2)
                        return node
        forest.leaves += 1
        return -forest.leaves

    forest.roots = [grow(np.arange(len(points)), leaves) for _ in range(trees)]
    dim = points.shape[1]
    forest.normals = np.array(normals).reshape(-1, dim)
    forest.offsets, forest.children = np.array(offsets), np.array(children, np.int64).reshape(-1, 2)
    return forest


def visits_for(forest: Forest, queries: np.ndarray, neighbours: list[np.ndarray], recall: float) -> int:
    """Fewest leaves after which the queries have met `recall` of their neighbours."""
    met = []
    for order, near in zip(forest.nearest_leaves(queries, forest.leaves), neighbours, strict=True):
        turn = np.full(forest.leaves, forest.leaves, np.int64)
        turn[order] = np.arange(1, len(order) + 1)
        if len(near):
            met.append(turn[forest.leaves_of(near)].min(axis=1))
    return int(np.quantile(np.concatenate(met), recall, method="higher")) if met else 1


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equally long vectors as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): rows with an id whose vector is of the commonest length,
    not zero, and free of null and non-finite components. One row per id: of
    several, that with the smallest vector."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = F.col("vec_id").isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda c: c != 0)
    rows = table.where(F.coalesce(sound, F.lit(False))).select("vec_id", x.alias("vector"))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.where(F.size("vector") == (lengths[0]["n"] if lengths else 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _distinct_points(vectors: DataFrame, k: int) -> DataFrame:
    """(vector, ids): each vector once, with the k + 1 smallest ids that have it;
    no others can be among anyone's k nearest."""
    same = Window.partitionBy("vector").orderBy("vec_id")
    first = vectors.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    return first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def _best(scores: np.ndarray, count: int) -> np.ndarray:
    """Columns of the `count` largest scores of each row, of equal ones the first."""
    if count >= scores.shape[1]:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    best = np.argpartition(-scores, count - 1, axis=1)[:, :count]
    least = np.take_along_axis(scores, best, 1).min(axis=1, keepdims=True)
    for row in np.flatnonzero((scores >= least).sum(axis=1) > count):
        best[row] = np.argsort(-scores[row], kind="stable")[:count]
    return best


def _ranked(points: pa.Table, probes: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score): the nearest points of one piece of a leaf to
    the queries that visit it, no lower than the query's floor; scores on the
    vectors as they are."""
    out = {"query_id": [], "vec_id": [], "score": []}
    if points.num_rows and probes.num_rows:
        first = points.column("ids").combine_chunks()
        order = np.argsort(first.flatten().to_numpy()[first.offsets.to_numpy()[:-1] - first.offsets[0].as_py()], kind="stable")
        points = points.take(order)
        vectors, lists = _matrix(points.column("vector")), points.column("ids").combine_chunks()
        ids, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sizes = np.diff(ends)
        queries, names = _matrix(probes.column("vector")), probes.column("query_id").to_numpy()
        floors = probes.column("floor").to_numpy()
        for at in range(0, len(queries), 512):
            some, own = queries[at : at + 512], names[at : at + 512]
            best = _best(some @ vectors.T, k + 1)
            chosen = best.ravel()
            asked = np.repeat(np.arange(len(some)), best.shape[1])
            score = np.einsum("ij,ij->i", some[asked], vectors[chosen])
            many = sizes[chosen]
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found = ids[np.repeat(ends[chosen], many) + inside]
            query = own[np.repeat(asked, many)]
            wanted = (found != query) & np.repeat(score >= floors[at : at + 512][asked], many)
            for name, values in zip(out, (query, found, np.repeat(score, many)), strict=True):
                out[name].append(values[wanted])
    types = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
    return pa.table({n: np.concatenate([np.empty(0, types[n]), *v]).astype(types[n]) for n, v in out.items()})


def _true_neighbours(points: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Vectors nearest to a few queries, by comparing them with every point."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("vector"))
            alone = [x[0] if len(x) == 1 else None for x in batch.column("ids").to_pylist()]
            scores = queries @ vectors.T
            scores[np.array([[a == i for a in alone] for i in ids])] = -np.inf
            best = _best(scores, k)
            near = pa.array(list(vectors[best.ravel()]), pa.list_(pa.float64()))
            asked = np.repeat(np.arange(len(queries), dtype=np.int32), best.shape[1])
            score = np.take_along_axis(scores, best, 1).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(score), near], ["query", "score", "near"])

    found = points.mapInArrow(scan, "query int, score double, near array<double>").where("score > double('-Infinity')")
    best = Window.partitionBy("query").orderBy(F.desc("score"))
    rows = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select("query", "near").collect()
    near = [[] for _ in ids]
    for row in rows:
        near[row["query"]].append(row["near"])
    return [np.array(x, dtype=np.float64).reshape(-1, queries.shape[1]) for x in near]


def search(table: DataFrame, k: int = K, every: int = EVERY, trees: int = TREES, recall: float = RECALL, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by
    `every`, the k nearest found among all other rows by largest inner product.

    Equal scores rank by smaller vec_id. Unusable vectors (see usable_vectors)
    take no part, so an empty table, or one without usable rows, gives no rows;
    a query gets fewer than k where there are fewer candidates. Copies of a
    vector are all candidates, but only k + 1 ids of each are carried along.
    Columns beside vec_id and embedding are not read.
    """
    spark = table.sparkSession
    vectors = written(usable_vectors(table), "vectors")
    points = written(_distinct_points(vectors, k), "points")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    facts = points.agg(F.count("*").alias("n"), F.max(length).alias("radius")).first()
    queries = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector")
    if not facts["n"]:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score"))

    # Samples by hash: at most SAMPLE points and PROBES queries come to the driver.
    spread = F.pmod(F.xxhash64("vector"), F.lit(facts["n"]))
    sample = _matrix(points.where(spread < SAMPLE).limit(SAMPLE).select("vector").toArrow().column(0))
    asked = queries.orderBy(F.xxhash64("query_id")).limit(PROBES).toArrow()
    leaves = max(1, min(facts["n"] // leaf_rows, SAMPLE // 8))
    built = build_forest(sample, facts["radius"] * (1 + 1e-9), leaves, trees)
    few = _matrix(asked.column("vector"))
    visits = 1
    if len(few) and built.leaves > trees:
        visits = visits_for(built, few, _true_neighbours(points, few, asked.column("query_id").to_numpy(), k), recall)
    forest = spark.sparkContext.broadcast(built)  # bounded by SAMPLE: a plane per inner node

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = forest.value.leaves_of(_matrix(batch.column("vector")))
                column = pa.ListArray.from_arrays(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32), own.astype(np.int32).ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "leaves"])

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list(forest.value.nearest_leaves(_matrix(batch.column("vector")), visits))
                column = pa.array(found, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "leaves"])

    points = written(points.mapInArrow(placed, schema_with(points, "leaves array<int>")), "placed")
    probes = written(queries.mapInArrow(visited, schema_with(queries, "leaves array<int>")), "probes")
    first, later = F.slice("leaves", 1, trees), F.slice("leaves", trees + 1, built.leaves)
    met = written(_met(points, probes.select("query_id", "vector", first.alias("leaves"), F.lit(float("-inf")).alias("floor")), k), "met")
    # What the first leaves gave bounds what the others can add.
    floors = _top(met, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = floors.select("query_id", F.when(F.col("n") >= k, F.col("least")).alias("least"))
    rest = probes.select("query_id", "vector", later.alias("leaves")).join(floors, "query_id", "left")
    rest = rest.select("query_id", "vector", "leaves", F.coalesce("least", F.lit(float("-inf"))).alias("floor"))
    return _top(met.unionByName(_met(points, rest, k)), k).select("query_id", "rank", "vec_id", "score")


def _top(met: DataFrame, k: int) -> DataFrame:
    """The k best (vec_id, score) of each query, with their rank."""
    best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _met(points: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score): for each query and each of its leaves the best
    points there. Large leaves are cut into pieces, and many visitors of a leaf
    into parts; each piece meets each part in one task."""
    # One row per leaf of the forest.
    load = points.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("rows"))
    visitors = probes.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("queries"))
    cuts = load.join(visitors, "leaf").select(
        "leaf",
        F.ceil(F.col("rows") / PIECE_ROWS).cast("int").alias("pieces"),
        F.ceil(F.col("queries") / PART_QUERIES).cast("int").alias("parts"),
    )
    cuts = F.broadcast(written(cuts, "cuts"))
    numbers = lambda column: F.explode(F.sequence(F.lit(0), F.col(column) - 1))
    left = points.select("vector", "ids", F.explode("leaves").alias("leaf")).join(cuts, "leaf")
    left = left.withColumn("piece", F.pmod(F.xxhash64(F.col("ids")[0]), F.col("pieces")).cast("int"))
    left = left.select("leaf", "piece", numbers("parts").alias("part"), "vector", "ids")
    right = probes.select("query_id", "vector", "floor", F.explode("leaves").alias("leaf")).join(cuts, "leaf")
    right = right.withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    right = right.select("leaf", numbers("pieces").alias("piece"), "part", "query_id", "vector", "floor")
    key = ["leaf", "piece", "part"]
    met = left.groupBy(*key).cogroup(right.groupBy(*key))
    return met.applyInArrow(lambda a, b: _ranked(a, b, k), "query_id long, vec_id long, score double")
