"""Jaccard join on word n-grams by signature trees.

A document's signature is a bitmap with one bit set for each of its shingles.
Documents are the leaves of a tree whose nodes hold the OR of the signatures
below, the range of set sizes, and the most shingles a bitmap below hides behind
shared bits. Two trees (or a tree and itself) are walked from their roots: a pair
of nodes is given up when no two documents below can share enough shingles, by
the sizes or by the bits the two nodes have in common; it is also given up when
all documents below belong to one component already. Pairs of leaves that are
left are compared shingle by shingle.

Trees are grown where links can be. Two sets with Jaccard similarity t share one
of the first n - ceil(t n) + 1 shingles of each in any common order, so only
documents that share one of those, and whose signatures allow it, can be linked.
The order goes by how common the words of a shingle are together, so that the
first ones are rare however many documents there are, and puts shingles that many
documents were seen to hold last, so shared passages bring few together. The groups found this way are cut into pieces of bounded size: first
each piece is joined with itself and the next, then those pairs of pieces whose
root nodes could still hold a link between components.

Equal sets are one node of all this. No step drops or caps anything: the order of
shingles and the cut into pieces decide how long it takes, not what is found.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmark.llm.common import ROW_KEYS, row_keys, running_totals, schema_with, without_rows
from levelmark.llm.components import components
from levelmark.llm.shingles import count_words, mixed, shingle_sets, weighted_sets
from levelmark.operators.joins import lookup_join
from levelmark.sources.shared import written

WORDS, PERCENT = 4, 85
#: Common shingles that the order knows, at most, and the count from which one may be common.
COMMON, COMMON_COUNT = 200_000, 8
#: Buckets that words are counted in, and the steps of a weight for twice the count.
BUCKETS, STEPS = 1 << 18, 8
#: A task reports shingles that it met in so many documents.
TASK_COUNT = 3
#: Shingles of a piece of a group, about.
PIECE_SHINGLES = 1 << 19
#: Sets of one shingle that are paired by their bitmaps; more are taken as they are. Few:
#: shingles that so many documents have among their first are known as common ones.
RUN = 1024
#: Children of a node, and the widest signature in bits.
FAN, WIDEST = 8, 1 << 15


# Signature trees


class SignatureTree:
    """Nodes by level, leaves first: OR of bitmaps, least and largest set size,
    most hidden shingles; node i of a level covers FAN nodes of the level below."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets])
        marks = np.zeros((len(sets), bits), bool)
        for row, members in zip(marks, sets, strict=True):
            row[(members & np.uint64(bits - 1)).astype(np.int64)] = True
        maps = np.packbits(marks, axis=1).view(np.uint64)
        hidden = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, hidden)]
        while len(maps) > 1:
            cuts = np.arange(0, len(maps), FAN)
            low, high = self.levels[-1][1:3]
            maps = np.bitwise_or.reduceat(maps, cuts, axis=0)
            hidden = np.maximum.reduceat(hidden, cuts)
            self.levels.append((maps, np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), hidden))

    def leaves(self, level: int, node: int) -> slice:
        return slice(node * FAN**level, min((node + 1) * FAN**level, len(self.levels[0][1])))


def can_link(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes (i of level a, j of level b) could hold a link.

    Shared shingles lie on shared bits, and beside one on each of those a
    document holds at most its hidden ones."""
    fits = (a[2][i] * 100 >= b[1][j] * percent) & (b[2][j] * 100 >= a[1][i] * percent)
    bits = np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64)
    most = np.minimum(np.minimum(a[2][i], b[2][j]), bits + np.minimum(a[3][i], b[3][j]))
    return fits & (most * (100 + percent) >= (a[1][i] + b[1][j]) * percent)


class Labels:
    """Components of the documents at hand, the least position standing for each."""

    def __init__(self, given: np.ndarray):
        self.of = given.copy()

    def merge(self, a: int, b: int) -> None:
        low, high = sorted((self.of[a], self.of[b]))
        self.of[self.of == high] = low

    def one(self, *parts: slice) -> bool:
        first = self.of[parts[0].start]
        return all((self.of[p] == first).all() for p in parts)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def _width(sets: list[np.ndarray]) -> int:
    """Four bits a shingle of the larger sets, within bounds."""
    wanted = 4 * int(np.quantile([len(s) for s in sets], 0.9)) + 64
    return min(WIDEST, max(64, 1 << (wanted - 1).bit_length()))


def tree_links(left: list[np.ndarray], right: list[np.ndarray] | None, given: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join components among `left`, or between `left` and `right`.

    Positions count through left, then right; `given` says which are in one
    component from the start. Every component of all links is connected by the
    links returned and those given.
    """
    sets = left if right is None else left + right
    bits = _width(sets)
    one, labels, found = SignatureTree(left, bits), Labels(given), []
    two, shift = (one, 0) if right is None else (SignatureTree(right, bits), len(left))
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        level, i, other, j = stack.pop()
        here, there = one.leaves(level, i), two.leaves(other, j)
        there = slice(there.start + shift, there.stop + shift)
        if labels.one(here, there):
            continue
        if level == other == 0:
            if labels.of[here.start] != labels.of[there.start] and linked(sets[here.start], sets[there.start], percent):
                labels.merge(here.start, there.start)
                found.append((here.start, there.start))
            continue
        # Open the higher node, both of equally high ones.
        down, across = level - (level >= other), other - (other >= level)
        below = np.arange(i * FAN, min((i + 1) * FAN, len(one.levels[down][1]))) if down < level else np.array([i])
        beside = np.arange(j * FAN, min((j + 1) * FAN, len(two.levels[across][1]))) if across < other else np.array([j])
        x, y = (v.ravel() for v in np.meshgrid(below, beside, indexing="ij"))
        if right is None and down == across:
            x, y = x[x <= y], y[x <= y]
        keep = can_link(one.levels[down], x, two.levels[across], y, percent)
        if right is None and down == across:
            keep |= (x == y) & (down > 0)
            keep &= (x != y) | (down > 0)
        stack += [(down, int(p), across, int(q)) for p, q in zip(x[keep][::-1], y[keep][::-1], strict=True)]
    return found


# Shingles of documents


def _packed(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([s.tobytes() for s in sets], pa.binary())


def _unpacked(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in column.to_pylist()]


class Order(NamedTuple):
    """What the order of shingles goes by, one size however many documents there are."""

    #: Hashes of common shingles, ascending, and their rank by number of documents.
    common: np.ndarray
    rank: np.ndarray
    #: By bucket of words, the logarithm of their number.
    weights: np.ndarray


def _order(texts: DataFrame, words: int) -> Order:
    """Shingles that a task meets in TASK_COUNT documents are counted over all
    tasks; those with the highest counts come back, at most COMMON. Words are
    counted by bucket. Both order shingles and nothing else."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, in_bucket = [], 0, np.zeros(BUCKETS, np.int64)

        def rows(key, n, word):
            columns = [pa.array(key), pa.array(n), pa.array(np.full(len(key), word))]
            return pa.RecordBatch.from_arrays(columns, ["key", "n", "word"])

        def flush():
            shingles, n = np.unique(np.concatenate([np.empty(0, np.uint64), *parts]), return_counts=True)
            often = n >= TASK_COUNT
            return rows(shingles[often].view(np.int64), n[often].astype(np.int64), False)

        for batch in batches:
            count_words(batch.column("text"), in_bucket)
            for members in shingle_sets(batch.column("text"), words):
                parts.append(members)
                size += len(members)
                if size >= 4 * PIECE_SHINGLES:
                    yield flush()
                    parts, size = [], 0
        yield flush()
        met = np.flatnonzero(in_bucket)
        yield rows(met, in_bucket[met], True)

    counts = texts.select("text").mapInArrow(count, "key long, n long, word boolean").groupBy("word", "key").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("word") | (F.col("n") >= COMMON_COUNT))
    counts = written(counts.withColumn("step", F.floor(F.log2("n") * STEPS).cast("int")), "common")
    in_bucket = counts.where("word").select("key", "step").toArrow()  # at most BUCKETS rows
    weights = np.zeros(BUCKETS, np.uint16)
    weights[in_bucket.column("key").to_numpy()] = in_bucket.column("step").to_numpy()
    counts, room, least = counts.where("not word"), COMMON, 1 << 30
    for row in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # at most 8 x 64 rows
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    chosen = counts.where(F.col("step") >= least).orderBy("n", "key").select("key").toArrow().column(0).to_numpy()
    hashes = chosen.astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Order(hashes[order], np.arange(len(hashes), dtype=np.uint64)[order], weights)


#: A shingle's place in the order: its weight, then the upper bits of its hash or, for a common one, the rank.
HASH_BITS, LAST = np.uint64(48), 0xFFFF


def prefix(members: np.ndarray, weight: np.ndarray, order: Order, percent: int) -> np.ndarray:
    """The first n - ceil(percent n / 100) + 1 shingles, and those whose place is
    that of the last one: those of rare words first, then by hash, then common ones by rank."""
    n = len(members)
    need = n - (percent * n + 99) // 100 + 1
    place = np.minimum(weight, LAST - 1).astype(np.uint64) << HASH_BITS | members >> (np.uint64(64) - HASH_BITS)
    if len(order.common):
        at = np.minimum(np.searchsorted(order.common, members), len(order.common) - 1)
        known = order.common[at] == members
        place[known] = np.uint64(LAST) << HASH_BITS | order.rank[at[known]]
    return members[place <= np.partition(place, need - 1)[need - 1]]


def _signed(texts: DataFrame, words: int, percent: int, order: Order) -> DataFrame:
    """Adds n_shingles, a 128-bit print of the set, and the prefix; text goes."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(tuple(order))  # at most COMMON entries of 16 bytes, BUCKETS of 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(*sent.value)
        for batch in batches:
            n, one, two, keys, maps = [], [], [], [], []
            for members, weight in weighted_sets(batch.column("text"), words, order.weights):
                n.append(len(members))
                one.append(mixed(members).sum(dtype=np.uint64))
                two.append(mixed(members ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64))
                maps.append(sketch(members) if len(members) else None)
                keys.append(prefix(members, weight, order, percent).view(np.int64) if len(members) else np.empty(0, np.int64))
            kept = [c for c in batch.schema.names if c != "text"]
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            keys = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.int64), *keys]))
            prints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
            columns = [*(batch.column(c) for c in kept), pa.array(n, pa.int64()), *prints, keys, pa.array(maps, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, [*kept, *MADE])

    return texts.mapInArrow(run, schema_with(texts.drop("text"), "n_shingles long, print1 long, print2 long, keys array<long>, sketch binary"))


MADE = ["n_shingles", "print1", "print2", "keys", "sketch"]
PRINT = ["n_shingles", "print1", "print2"]


# Groups that links can be in


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) sorted in the task: the nodes of each key that has 2
    to RUN of them; for more, edges between neighbours. The first and the last
    key of a task may go on in another one: they give edges, and their end rows."""
    names, empty = ["key", "a", "b", "nodes"], np.empty(0, np.int64)

    def out(key=empty, a=empty, b=empty, nodes=()):
        rows = max(len(a), len(nodes))
        pad = lambda x, kind: x if len(x) else pa.nulls(rows, kind)
        columns = [pad(pa.array(x, pa.int64()), pa.int64()) for x in (key, a, b)]
        return pa.RecordBatch.from_arrays([*columns, pad(pa.array(nodes, pa.list_(pa.int64())), pa.list_(pa.int64()))], names)

    def end(key, node):
        return out(key[:1], node[:1], node[:1])

    held_key, held, first, going_on = empty, empty, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        key, node = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in ((held_key, "key"), (held, "node")))
        if first is None:
            first = key[0]
            yield end(key, node)
        cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
        lists, chains = [], []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if high == len(key):  # may go on in the next batch
                over = high - low > RUN
                if over:
                    chains.append(node[low:high])
                    low = high - 1
                held_key, held, going_on = key[low:], node[low:], over or (going_on and low == 0)
            elif high - low > 1:
                if high - low > RUN or key[low] == first or (going_on and low == 0):
                    chains.append(node[low:high])
                else:
                    lists.append(node[low:high].tolist())
        if lists:
            yield out(nodes=lists)
        for chain in chains:
            yield out(a=chain[:-1], b=chain[1:])
    if first is not None:
        if len(held) > 1:
            yield out(a=held[:-1], b=held[1:])
        yield end(held_key[-1:], held[-1:])


def sketch(members: np.ndarray) -> bytes:
    """Bitmap of a set, of as many bits as it has members or up to twice that."""
    bits = min(WIDEST, max(64, 1 << (len(members) - 1).bit_length()))
    marks = np.zeros(bits, bool)
    marks[(members & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(marks, bitorder="little").tobytes()


class Maps:
    """Bitmaps of sets in the order of their size, and so of their width; folded
    to a narrower width where a smaller set asks for it."""

    def __init__(self, maps: list[np.ndarray], size: np.ndarray):
        self.size, widths = size, np.array([len(x) for x in maps])
        cuts = np.append(np.flatnonzero(np.append(True, widths[1:] != widths[:-1])), len(maps))
        self.ends = dict(zip(widths[cuts[:-1]].tolist(), zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True), strict=True))
        self.folded = {(w, w): self._counted(w, np.stack(maps[low:high])) for w, (low, high) in self.ends.items()}
        self.width = widths.tolist()

    def _counted(self, width: int, maps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """With the shingles that each map hides behind shared bits."""
        low, high = self.ends[width]
        return maps, self.size[low:high] - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)

    def partners(self, i: int, of: np.ndarray, percent: int) -> np.ndarray:
        """Those of the larger sets `of`, ascending, that set i could link with:
        the bound of can_link."""
        width, found = self.width[i], []
        own, hidden = (x[i - self.ends[width][0]] for x in self.folded[width, width])
        for wide, (low, high) in self.ends.items():
            here = of[slice(*np.searchsorted(of, [low, high]))]
            if not len(here):
                continue
            if (wide, width) not in self.folded:
                maps = self.folded[wide, wide][0]
                self.folded[wide, width] = self._counted(wide, np.bitwise_or.reduce(maps.reshape(len(maps), -1, width), axis=1))
            maps, behind = (x[here - low] for x in self.folded[wide, width])
            shared = np.bitwise_count(maps & own).sum(axis=1, dtype=np.int64) + np.minimum(hidden, behind)
            found.append(here[np.minimum(self.size[i], shared) * (100 + percent) >= (self.size[i] + self.size[here]) * percent])
        return np.concatenate(found)


def _paired(size: np.ndarray, maps: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs that connect all sets which could link; sizes ascend."""
    held, label = Maps(maps, size), np.arange(len(size))
    last = np.searchsorted(size, size * 100 // percent, "right")
    for i, end in enumerate(last):
        larger = np.arange(i + 1, end)
        larger = larger[label[larger] != label[i]]
        if not len(larger):
            continue
        for j in held.partners(i, larger, percent):
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                yield i, int(j)


def _possible(percent: int):
    """Edges that connect the sets of a list which could link, by their bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            if not table.num_rows:
                continue
            lists = table.column("list").to_numpy()
            cuts = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
            held = table.slice(int(cuts[-1])).to_batches()[0]
            yield of_lists(table.slice(0, int(cuts[-1])), cuts)
        if held is not None:
            yield of_lists(pa.Table.from_batches([held]), np.array([0, held.num_rows]))

    def of_lists(table: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        node, size = (table.column(c).to_numpy() for c in ("node", "n_shingles"))
        maps = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        found = []
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            order = low + np.argsort(size[low:high], kind="stable")
            pairs = _paired(size[order], [maps[i] for i in order], percent)
            found += [(int(node[order[i]]), int(node[order[j]])) for i, j in pairs]
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _candidate_groups(signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of the sets that may link, directly or through others: they
    share a prefix shingle, and their bitmaps allow it.

    The sets of one shingle are paired by bitmap if they are up to RUN, else
    chained unseen; a shingle of many sets spreads over tasks."""
    keyed = lookup_join(signed.select("keys", *ROW_KEYS), sets.select("node", *ROW_KEYS), ROW_KEYS, "inner", ROW_KEYS)
    keys = keyed.select(F.explode("keys").alias("key"), "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    runs = written(keys.mapInArrow(_runs, "key long, a long, b long, nodes array<long>"), "runs")
    ends = runs.where("key is not null")
    firsts = ends.groupBy("key").agg(F.min("a").alias("b"))
    chains = runs.where("key is null and a is not null").select("a", "b")
    chains = chains.unionByName(ends.select("key", "a").join(firsts, "key").select("a", "b"))
    # Near copies share many shingles, so many lists are equal.
    lists = runs.where("nodes is not null").select("nodes").distinct().select(F.monotonically_increasing_id().alias("list"), "nodes")
    lists = written(lists, "lists").select("list", F.explode("nodes").alias("node"))
    maps = lookup_join(signed.select("sketch", *ROW_KEYS), sets.select("node", "n_shingles", *ROW_KEYS), ROW_KEYS, "inner", ROW_KEYS)
    listed = lookup_join(lists, written(maps.select("node", "n_shingles", "sketch").dropDuplicates(["node"]), "sketches"), ["node"], "inner", ["list"])
    listed = listed.select("list", "node", "n_shingles", "sketch").repartition("list").sortWithinPartitions("list")
    return components(chains.unionByName(listed.mapInArrow(_possible(percent), "a long, b long")))


# Pieces of groups


def _shingled(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c != "text"]
            packed = _packed(list(shingle_sets(batch.column("text"), words)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), packed], [*kept, "shingles"])

    return run


def _joined(percent: int):
    """Links among rows (node, group, n_shingles, label, shingles, side) of one piece or pair of pieces."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("group", "ascending"), ("n_shingles", "ascending"), ("node", "ascending")])
        # A row that occurs several times in the table is one member.
        node = rows.column("node").to_numpy()
        rows = rows.filter(pa.array(np.append(True, node[1:] != node[:-1])))
        group = rows.column("group").to_numpy()
        node, label, side = (rows.column(c).to_numpy() for c in ("node", "label", "side"))
        sets = _unpacked(rows.column("shingles"))
        cuts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        out: list[tuple[int, int]] = []
        for low, high in zip(cuts, [*cuts[1:], len(group)], strict=True):
            if high - low < 2:
                continue
            order = low + np.argsort(side[low:high], kind="stable")
            own, names = [sets[i] for i in order], node[order]
            first = int((side[order] == 0).sum())
            _, given = np.unique(label[order], return_inverse=True)
            starts = np.full(given.max() + 1, len(given))
            np.minimum.at(starts, given, np.arange(len(given)))
            given = starts[given]
            if first == len(own):
                links = tree_links(own, None, given, percent)
            elif first:
                links = tree_links(own[:first], own[first:], given, percent)
            else:
                continue
            out += [(int(names[i]), int(names[j])) for i, j in links]
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


_ROW = ["node", "group", "n_shingles", "label", "shingles"]


def _links(sets: DataFrame, members, percent: int) -> DataFrame:
    """Edges that connect the components of all links among `sets` (node, group,
    piece, n_shingles, ROW_KEYS); `members` adds the shingles to some of them."""
    within = members(sets.withColumn("label", F.col("node")).withColumn("side", F.lit(0)))
    within = within.select(*_ROW, "side", "piece").groupBy("piece").applyInArrow(_joined(percent), "a long, b long")
    # Groups that lie in several pieces: neighbouring pieces next, then the rest.
    pieces = sets.select("group", "piece").distinct()
    spread = pieces.groupBy("group").agg(F.count("*").alias("pieces")).where("pieces > 1").select("group")
    wide = written(pieces.join(spread, "group"), "pieces")
    found = written(within, "links")
    if wide.isEmpty():
        return found
    first, second = wide.select("group", F.col("piece").alias("one")), wide.select("group", F.col("piece").alias("two"))
    large = written(sets.join(wide, ["group", "piece"], "left_semi").withColumn("label", F.col("node")), "large")
    neighbours = first.join(second, "group").where("two = one + 1")
    found = written(found.unionByName(_between(members(large), neighbours, percent)), "links")
    labelled = large.drop("label").join(components(found), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    labelled = written(labelled, "labelled")
    nodes = labelled.groupBy("group", "piece").agg(
        F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.min("label").alias("least"), F.max("label").alias("most")
    )
    one, two = (nodes.select("group", *(F.col(c).alias(f"{c}{i}") for c in ("piece", "low", "high", "least", "most"))) for i in (1, 2))
    fits = f"piece2 > piece1 + 1 and high1 * 100 >= low2 * {percent} and high2 * 100 >= low1 * {percent}"
    open_ = "not (least1 = most1 and least2 = most2 and least1 = least2)"
    rest = one.join(two, "group").where(fits).where(open_).select("group", F.col("piece1").alias("one"), F.col("piece2").alias("two"))
    rest = written(rest, "pairs")
    if rest.isEmpty():
        return found
    again = labelled.join(rest.select("group").distinct(), "group", "left_semi")
    return found.unionByName(_between(members(again), rest, percent))


def _between(members: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links between the two pieces of each pair (group, one, two)."""
    sides = pairs.select("group", "one", "two", F.explode(F.array("one", "two")).alias("piece"))
    sides = sides.withColumn("side", (F.col("piece") == F.col("two")).cast("int"))
    rows = members.join(sides, ["group", "piece"]).select(*_ROW, "side", "one", "two", F.col("group").alias("of"))
    return rows.groupBy("of", "one", "two").applyInArrow(_joined(percent), "a long, b long")


def similar_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, piece: int = PIECE_SHINGLES) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, ROW_KEYS.

    A document's set is its distinct shingles of `words` words (A-Z lower-cased);
    with fewer words the whole sequence is one shingle; null, empty and blank
    texts have none and are linked with nothing. Two documents link when 100
    times the shingles in both is at least `percent` times those in either;
    component_id is the smallest doc_id reachable by links, itself included
    (null ids are passed over unless there is no other). Repeated rows link as
    equal texts do. Columns beside doc_id and text are not read.
    """
    texts = docs.select("doc_id", *row_keys(), "text")
    signed = written(_signed(texts, words, percent, _order(texts, words)), "signed")
    sets = signed.where("n_shingles > 0").groupBy(*PRINT).agg(F.min("doc_id").alias("least_id"), F.min(F.struct(*ROW_KEYS)).alias("row"))
    sets = written(sets.select(F.monotonically_increasing_id().alias("node"), *PRINT, "least_id", "row.*"), "sets")

    groups = _candidate_groups(signed, sets, percent).withColumnRenamed("root", "group")
    slim = sets.select("node", "n_shingles", *ROW_KEYS).join(groups, "node")
    slim = running_totals(slim, ["group", "n_shingles", "node"], before="n_shingles")
    slim = written(slim.withColumn("piece", F.floor(F.col("before") / piece)).drop("before"), "grouped")

    def members(of: DataFrame) -> DataFrame:
        """The shingles of the sets, from their documents' texts; not stored, as they outweigh the texts."""
        rows = lookup_join(texts, of, ROW_KEYS, "inner", ROW_KEYS).select("text", "n_shingles", *(c for c in of.columns if c not in texts.columns and c != "n_shingles"))
        return rows.mapInArrow(_shingled(words), schema_with(rows.drop("text"), "shingles binary"))

    roots = components(_links(slim, members, percent))
    classes = sets.select(*PRINT, "least_id", "node").join(roots, "node", "left")
    classes = written(classes.withColumn("root", F.coalesce("root", "node")), "classes")
    least = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = classes.join(least, "root").select(*PRINT, "component_id")
    joined = signed.select("doc_id", *PRINT, *ROW_KEYS).join(classes, PRINT, "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), *ROW_KEYS)


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """`docs` with one row of each component, that with its id; all columns."""
    rows = similar_documents(docs, words, percent)
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), *(F.col(k) for k in ROW_KEYS))
    apart = F.when(F.col("n_shingles") > 0, F.lit(0)).otherwise(F.xxhash64(*ROW_KEYS))
    rows = written(rows.withColumn("apart", apart), "components")
    same = ["component_id", "apart"]
    kept = rows.groupBy(*same).agg(F.min(first).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    met = (rows["component_id"].eqNullSafe(kept["component_id"])) & (rows["apart"] == kept["apart"])
    spare = F.expr(" and ".join(f"{k} = first.{k}" for k in ROW_KEYS)).alias("spare")
    gone = rows.join(kept, met).select(*ROW_KEYS, spare)
    repeated = gone.groupBy(*ROW_KEYS, "spare").count().where("not spare or count > 1")
    return without_rows(docs, repeated.select(*ROW_KEYS, "spare"))
