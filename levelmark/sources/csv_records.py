"""CSV records of large files, by many tasks.

A cell in quotes may hold line breaks, so where a record ends depends on all that
is before it in the file. A file is read as physical lines, split by split. One
pass finds for every split whether a quoted cell is open at its end, both if one
was open at its start and if not; going through these answers, one per split,
gives the true start of each. With it, a second pass puts the lines of a split
together to records. Only a record that goes on in another split is joined from
its parts. Where every file is one split, one pass does it all.
"""

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, DELIMITER = '"', ","
BYTE_ORDER_MARK = "﻿"

RECORDS = "src_file string, start bigint, number bigint, part string, record string"
#: Parts of records: a whole one, the lines of one that stays open at the end of
#: a split, and of one that was open at its start.
WHOLE, OPENS, GOES_ON = "whole", "opens", "goes on"


def open_at_end(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after the line, if one was (`inside`) or was
    not before. Quotes open a cell at its start only, and close it unless doubled;
    what follows up to the delimiter is part of the cell."""
    at = 0
    while True:
        if not inside:
            if not line.startswith(QUOTE, at):
                at = line.find(DELIMITER, at) + 1
                if not at:
                    return False
                continue
            at += 1
        while True:
            at = line.find(QUOTE, at) + 1
            if not at:
                return True
            if not line.startswith(QUOTE, at):
                break
            at += 1
        inside = False
        at = line.find(DELIMITER, at) + 1
        if not at:
            return False


def physical_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their file, the place where their split starts and whether it is
    the whole file; the lines of a split come in order, in one task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    whole = F.expr("_metadata.file_block_start = 0 and _metadata.file_block_length = _metadata.file_size")
    return lines.select(
        "value", F.col("_metadata.file_path").alias("src_file"), F.col("_metadata.file_block_start").alias("start"), whole.alias("whole")
    )


def any_file_cut(lines: DataFrame) -> bool:
    """Whether a file lies in several splits; the scan's own list says it, nothing is read."""
    splits = (file for partition in lines._jdf.queryExecution().toRdd().partitions() for file in partition.files())
    return any(file.start() > 0 or file.length() < file.fileSize() for file in splits)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """The lines of a batch by split."""
    files, starts = batch.column("src_file"), batch.column("start")
    low = 0
    while low < batch.num_rows:
        same = pc.and_(pc.equal(files[low:], files[low]), pc.equal(starts[low:], starts[low]))
        other = pc.index(same, False).as_py()
        high = batch.num_rows if other < 0 else low + other
        yield files[low].as_py(), starts[low].as_py(), batch.slice(low, high - low)
        low = high


def _first_line(line: str, start: int, first: bool) -> str:
    return line.removeprefix(BYTE_ORDER_MARK) if first and not start else line


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src_file, start, if_closed, if_open) of each split."""
    split, states = None, [False, True]

    def row():
        columns = [[split[0]], [split[1]], [states[0]], [states[1]]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["src_file", "start", "if_closed", "if_open"])

    for batch in batches:
        for file, start, lines in _runs(batch):
            first = (file, start) != split
            if first:
                if split is not None:
                    yield row()
                split, states = (file, start), [False, True]
            values = lines.column("value")
            quoted = pc.indices_nonzero(pc.match_substring(values, QUOTE)).to_pylist()
            for i, line in zip(quoted, values.take(pa.array(quoted, pa.int64())).to_pylist(), strict=True):
                line = _first_line(line, start, first and i == 0)
                states = [open_at_end(line, s) for s in states]
    if split is not None:
        yield row()


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(src_file, start, inside) of each split, from the splits of whole files."""
    for batch in batches:
        for row in batch.to_pylist():
            inside, found = False, []
            for split in row["splits"]:
                found.append(inside)
                inside = split["if_open"] if inside else split["if_closed"]
            starts = [s["start"] for s in row["splits"]]
            columns = [pa.array([row["src_file"]] * len(starts)), pa.array(starts, pa.int64()), pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, ["src_file", "start", "inside"])


class _Assembler:
    """Puts the lines of a split together."""

    def __init__(self, file: str, start: int, inside: bool):
        self.file, self.start, self.inside = file, start, inside
        self.part, self.lines, self.number, self.first = GOES_ON if inside else WHOLE, [], 0, True
        self.out: list[tuple[int, str, str]] = []

    def add(self, line: str) -> None:
        line = _first_line(line, self.start, self.first)
        self.first = False
        if QUOTE in line:
            self.inside = open_at_end(line, self.inside)
        self.lines.append(line)
        if not self.inside:
            self.flush(self.part)
            self.part = WHOLE

    def flush(self, part: str) -> None:
        record = "\n".join(self.lines)
        if part != OPENS and not (self.inside and part == GOES_ON):
            record = record.removesuffix("\r")
        self.lines = []
        if record or part != WHOLE:  # empty lines are no records
            self.out.append((self.number, part, record))
            self.number += 1

    def end(self) -> None:
        if self.lines:
            self.flush(OPENS if self.part == WHOLE else GOES_ON)

    def batch(self) -> pa.RecordBatch:
        number, part, record = zip(*self.out, strict=True) if self.out else ((), (), ())
        n = len(self.out)
        self.out = []
        columns = [
            pa.array([self.file] * n, pa.string()),
            pa.array([self.start] * n, pa.int64()),
            pa.array(number, pa.int64()),
            pa.array(part, pa.string()),
            pa.array(record, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in RECORDS.split(", ")])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at = None
    for batch in batches:
        for file, start, lines in _runs(batch):
            if at is None or (file, start) != (at.file, at.start):
                if at is not None:
                    at.end()
                    yield at.batch()
                inside = lines.column("inside")[0].as_py()
                if inside is None:
                    raise ValueError(f"{file} has changed while it was read")
                at = _Assembler(file, start, inside)
            for line in lines.column("value").to_pylist():
                at.add(line)
            yield at.batch()
    if at is not None:
        at.end()
        yield at.batch()


def csv_records(spark: SparkSession, path) -> DataFrame:
    """(src_file, start, number, record): the records of CSV files without their
    headers, in the order (start, number) of each file. Lines end with \\n or
    \\r\\n; a record keeps the line breaks of its cells. Empty lines are no records;
    a cell that is never closed ends with its file."""
    lines = physical_lines(spark, path)
    if any_file_cut(lines):
        records = _of_cut_files(lines.drop("whole"))
    else:
        # No record goes on elsewhere: what is open at the end ends with its file.
        inside = F.when(F.col("whole"), F.lit(False))
        records = lines.select("value", "src_file", "start", inside.alias("inside")).mapInArrow(_assembled, RECORDS).drop("part")
    return records.where("start > 0 or number > 0")


def _of_cut_files(lines: DataFrame) -> DataFrame:
    ends = lines.mapInArrow(_ends, "src_file string, start bigint, if_closed boolean, if_open boolean")
    # A file's splits, a few bytes each, come together; so few that the scan lists them all.
    splits = ends.groupBy("src_file").agg(F.sort_array(F.collect_list(F.struct("start", "if_closed", "if_open"))).alias("splits"))
    starts = splits.mapInArrow(_starts, "src_file string, start bigint, inside boolean")
    # As many rows as the scan has splits, which the driver holds anyway; a shuffle would lose the lines' order.
    known = lines.join(F.broadcast(starts), ["src_file", "start"], "left").select("value", "src_file", "start", "inside")
    parts = known.mapInArrow(_assembled, RECORDS)

    # Of one file at most two parts per split are not whole.
    in_file = Window.partitionBy("src_file").orderBy("start", "number").rowsBetween(Window.unboundedPreceding, 0)
    torn = parts.where(F.col("part") != WHOLE).withColumn("of", F.count_if(F.col("part") == OPENS).over(in_file))
    pieces = F.array_sort(F.collect_list(F.struct("start", "number", "record")))
    joined = torn.groupBy("src_file", "of").agg(pieces.alias("pieces")).select(
        "src_file",
        F.col("pieces")[0]["start"].alias("start"),
        F.col("pieces")[0]["number"].alias("number"),
        F.array_join(F.col("pieces.record"), "\n").alias("record"),
    )
    whole = parts.where(F.col("part") == WHOLE).drop("part")
    return whole.unionByName(joined)


OPTIONS = {"escape": QUOTE, "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def csv_header(spark: SparkSession, path) -> list[str]:
    """The cells of the first record; nothing else is read."""
    return [c or "" for c in (spark.read.options(**OPTIONS).csv(path).first() or [])]


def csv_rows(records: DataFrame, schema, bad_record: str | None = None) -> DataFrame:
    """The records with `cells`, parsed to the schema; malformed ones keep their
    text in `bad_record`."""
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    options = {**OPTIONS, "mode": "PERMISSIVE"}
    if bad_record:
        options["columnNameOfCorruptRecord"] = bad_record
    return records.withColumn("cells", F.from_csv("record", ddl, options))
