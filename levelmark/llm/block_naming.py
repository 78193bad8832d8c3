"""Exact duplicates by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are
sorted and numbered: equal blocks get one integer name, different blocks never
share one. Then adjacent names are paired, the distinct pairs sorted and
numbered in turn, until one name is left for each document. That name, with the
number of rounds it took, is equal for two documents if and only if their
(normalised) texts are.

Whole texts are shuffled once, as distinct blocks. Occurrences find their name
by a 64-bit print of the block; blocks that share a print (counted, not assumed
away) are told apart by their bytes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from levelmark.llm.common import ROW_KEYS, ascii_lower, row_keys, text_or_empty, without_rows
from levelmark.sources.shared import written

#: Bytes of a block.
BLOCK_BYTES = 4096


def _blocks(block_bytes: int) -> str:
    """The blocks of `norm`; an empty text has one empty block."""
    last = f"greatest(octet_length(norm) - 1, 0) div {block_bytes}"
    return f"transform(sequence(0L, {last}), i -> substring(norm, cast(i * {block_bytes} + 1 as int), {block_bytes}))"


def _print(print_bits: int) -> str:
    return f"shiftrightunsigned(xxhash64(block), {64 - print_bits})"


def _numbers(first: int = 1, step: int = 1) -> Column:
    """Numbers of the sorted rows of each partition, unique over all partitions."""
    return (F.lit(first) + F.lit(step) * F.monotonically_increasing_id()).alias("name")


def _named_blocks(norm: DataFrame, block_bytes: int, print_bits: int) -> tuple[DataFrame, list[int]]:
    """Names by print, and by block where different blocks share a print; the shared prints."""
    blocks = norm.select(F.explode(F.expr(_blocks(block_bytes))).alias("block"))
    print_of = F.expr(_print(print_bits)).alias("print")
    distinct = blocks.distinct().sortWithinPartitions("block")
    names = written(distinct.select(print_of, F.lit(None).cast("binary").alias("block"), _numbers()), "block_names")
    # About blocks^2 / 2^65 prints are shared by accident: a few hundred at 10^11 blocks.
    shared = [r["print"] for r in names.groupBy("print").count().where("count > 1").select("print").collect()]
    if not shared:
        return names, shared
    apart = blocks.where(F.expr(_print(print_bits)).isin(shared)).distinct().sortWithinPartitions("block")
    apart = written(apart.select(print_of, "block", _numbers(-1, -1)), "told_apart")
    return names.where(~F.col("print").isin(shared)).unionByName(apart), shared


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES, print_bits: int = 64) -> DataFrame:
    """(row, doc_id, text_sha256, ROW_KEYS, level, name): one row per document,
    with (level, name) equal exactly where the normalised texts are equal."""
    norm = docs.select("doc_id", ascii_lower(text_or_empty()).cast("binary").alias("norm"), *row_keys())
    names, shared = _named_blocks(norm, block_bytes, print_bits)

    told = f"array_contains(array({', '.join(f'{p}L' for p in shared)}), {_print(print_bits)})" if shared else "false"
    piece = f"struct({_print(print_bits)} as print, case when {told} then block end as block)"
    rows = written(
        norm.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.sha2("norm", 256).alias("text_sha256"),
            *ROW_KEYS,
            F.expr(f"transform({_blocks(block_bytes)}, block -> {piece})").alias("pieces"),
        ),
        "rows",
    )
    pieces = rows.select("row", F.size("pieces").alias("left"), F.posexplode("pieces").alias("pos", "piece")).select(
        "row", "left", "pos", F.col("piece.print").alias("print"), F.col("piece.block").alias("block")
    )
    same = (pieces["print"] == names["print"]) & pieces["block"].eqNullSafe(names["block"])
    current = written(pieces.join(names, same).select("row", "left", "pos", "name"), "names_0")
    longest = rows.agg(F.max(F.size("pieces"))).first()[0] or 1

    level, found = 0, []
    while True:
        found.append(current.where("left = 1").select("row", F.lit(level).alias("level"), "name"))
        if longest == 1:
            break
        longest, level = (longest + 1) // 2, level + 1
        current = _paired(current.where("left > 1"), level)
    ids = found[0]
    for more in found[1:]:
        ids = ids.unionByName(more)
    return rows.drop("pieces").join(ids, "row")


def _paired(current: DataFrame, level: int) -> DataFrame:
    """Names of the pairs of adjacent names; 0 stands for a missing right one."""
    even = F.col("pos") % 2 == 0
    pairs = (
        current.groupBy("row", "left", F.expr("pos div 2").cast("int").alias("pair"))
        .agg(F.max(F.when(even, F.col("name"))).alias("first"), F.max(F.when(~even, F.col("name"))).alias("second"))
        .fillna(0, ["second"])
    )
    distinct = pairs.select("first", "second").distinct().sortWithinPartitions("first", "second")
    names = written(distinct.select("*", _numbers()), f"pair_names_{level}")
    halved = F.expr("(left + 1) div 2").cast("int").alias("left")
    return written(
        pairs.join(names, ["first", "second"]).select("row", halved, F.col("pair").alias("pos"), "name"), f"names_{level}"
    )


def exact_duplicates(docs: DataFrame, block_bytes: int = BLOCK_BYTES, print_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256,
    ROW_KEYS, and `spare`: whether the row equals the one that stays, id and text.

    Texts are equal when identical after lower-casing A-Z; null counts as empty
    text, and all empty texts form a group. The row with the largest doc_id
    stays, a null id coming after all others; of several rows with that id, one
    stays. An empty table gives no rows; other columns of `docs` are not read.
    """
    rows = written(identities(docs, block_bytes, print_bits), "identities")
    groups = rows.groupBy("level", "name").agg(
        F.max(F.struct("doc_id", "row", *ROW_KEYS)).alias("keep"), F.count("*").alias("group_size")
    )
    # Stored, so that both sides of the join are dealt anew and a large group can be split.
    return rows.join(written(groups, "groups"), ["level", "name"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        "text_sha256",
        *ROW_KEYS,
        F.expr(" and ".join(f"{k} = keep.{k}" for k in ROW_KEYS)).alias("spare"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of equal texts; all its columns."""
    return without_rows(docs, exact_duplicates(docs).where(~F.col("kept")).select(*ROW_KEYS, "spare"))
