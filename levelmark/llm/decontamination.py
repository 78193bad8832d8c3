"""Benchmark passages in documents by Wu-Manber search over words.

Windows of benchmark items are the test strings, a table of them per number of
words, so that the few short ones do not shorten the jumps for the others. Each
table knows for a block of two words how far the search may jump before a window
can end there; a word that is in no window lets it jump over a whole window.
Where the jump is zero, the block is a window's ending: it selects the windows
with this ending and, among them, those with the first two words at hand, which
are compared word by word.

Windows are dealt into blocks of bounded bytes. One block is sent to the workers
at a time, so a benchmark of any size is searched for, in as many scans as it has
blocks; most have one.
"""

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmark.llm.common import ROW_KEYS, give_back, row_keys, running_totals, schema_with, without_rows
from levelmark.operators.joins import lookup_join
from levelmark.sources.shared import written

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: Windows and item ids sent to the workers at a time, in bytes.
BLOCK_BYTES = 8 * 1024 * 1024
#: Bytes of a text that are split into words at a time.
PIECE_BYTES = 1 << 20

# In UTF-8, with A-Z lower-cased: digits, a-z and everything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
REST = re.compile(rb"[0-9A-Za-z\x80-\xff]*")
MARKED = re.compile(rb"\x01+")

Span = tuple[int, int]


def words_of(data: bytes, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, in lists of about `piece` bytes, cut between words."""
    start = 0
    while start < len(data):
        end = REST.match(data, min(start + piece, len(data))).end()
        yield WORD.findall(data[start:end].lower())
        start = end


class WindowTable:
    """Windows of `size` words each, as word numbers: jumps, endings, items."""

    def __init__(self, size: int, base: int, windows: dict[tuple[int, ...], list[str]]):
        self.size, self.base, self.items = size, base, windows
        self.block = min(2, size)
        self.jumps: dict[int, int] = {}
        self.endings: dict[int, dict[int, list[list[int]]]] = defaultdict(lambda: defaultdict(list))
        for window in windows:
            for end in range(self.block - 1, size):
                key = self._key(window, end)
                self.jumps[key] = min(self.jumps.get(key, size), size - 1 - end)
            self.endings[self._key(window, size - 1)][self._key(window, self.block - 1)].append(list(window))

    def _key(self, numbers, end: int) -> int:
        return numbers[end - 1] * self.base + numbers[end] if self.block == 2 else numbers[end]

    def search(self, numbers: list[int], start: int) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(end, window) of each window whose last word is at `start` or later. 0
        numbers a word that no window holds."""
        size, base, jump, two = self.size, self.base, self.jumps.get, self.block == 2
        farthest = size - self.block + 1
        at, length = max(start, size - 1), len(numbers)
        while at < length:
            last = numbers[at]
            if not last:
                at += size
                continue
            key = numbers[at - 1] * base + last if two else last
            ahead = jump(key, farthest)
            if ahead:
                at += ahead
                continue
            first = at - size + 1
            for window in self.endings[key].get(self._key(numbers, first + self.block - 1), ()):
                if numbers[first : at + 1] == window:
                    yield at + 1, tuple(window)
            at += 1


class Matcher:
    """Tables for the windows (words joined by blanks, items) of one block."""

    def __init__(self, windows: list[tuple[bytes, list[str]]]):
        self.numbers: dict[bytes, int] = {}
        by_size: dict[int, dict[tuple[int, ...], list[str]]] = defaultdict(dict)
        for text, items in windows:
            numbers = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split(b" "))
            by_size[len(numbers)][numbers] = items
        self.tables = [WindowTable(size, len(self.numbers) + 1, found) for size, found in sorted(by_size.items())]

    def scan(self, data: bytes, piece: int = PIECE_BYTES) -> tuple[int, list[Span], set[str]]:
        """Number of words, stretches of words inside windows, items whose windows occur."""
        count, spans, items = 0, [], set()
        numbers: list[int] = []
        marks = bytearray()
        for words in words_of(data, piece):
            kept = len(numbers)  # of the piece before: windows may start there
            numbers.extend(map(self.numbers.get, words, repeat(0)))
            marks.extend(bytes(len(words)))
            for table in self.tables:
                for end, window in table.search(numbers, kept):
                    marks[end - table.size : end] = b"\x01" * table.size
                    items.update(table.items[window])
            settled = max(0, len(numbers) - WINDOW + 1)
            self._add(spans, marks[:settled], count)
            count += settled
            del numbers[:settled], marks[:settled]
        self._add(spans, marks, count)
        return count + len(numbers), spans, items

    @staticmethod
    def _add(spans: list[Span], marks: bytearray, offset: int) -> None:
        if 1 not in marks:
            return
        for found in MARKED.finditer(marks):
            start, end = found.start() + offset, found.end() + offset
            if spans and spans[-1][1] == start:
                start = spans.pop()[0]
            spans.append((start, end))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(window, item): distinct windows with the items, as text, that hold them.
    A null id is the empty text; items without words have no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, value in zip(batch.column("item").to_pylist(), batch.column("text"), strict=True):
                carried: list[bytes] = []
                whole = True
                for words in words_of(value.as_buffer().to_pybytes()):
                    carried += words
                    if len(carried) >= WINDOW:
                        whole = False
                        found = [b" ".join(carried[i : i + WINDOW]) for i in range(len(carried) - WINDOW + 1)]
                        yield _window_rows(found, item)
                        carried = carried[len(carried) - WINDOW + 1 :]
                if whole and carried:
                    yield _window_rows([b" ".join(carried)], item)

    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, "window binary, item string").distinct()


def _window_rows(found: list[bytes], item: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([item] * len(found))], ["window", "item"])


def _blocks(windows: DataFrame, block_bytes: int) -> Iterator[Broadcast]:
    """The windows in broadcasts of about `block_bytes` each; a window of very many
    items may be in several."""
    spark = windows.sparkSession
    size = F.octet_length("window") + F.octet_length("item") + 16
    windows = written(windows.select("*", size.cast("long").alias("size")), "windows")
    total = windows.agg(F.sum("size")).first()[0] or 0
    if total > block_bytes:
        windows = running_totals(windows, ["window", "item"], before="size")
    else:
        windows = windows.withColumn("before", F.lit(0))
    windows = windows.select("window", "item", F.floor(F.col("before") / block_bytes).alias("block"))
    for block in range(-(-total // block_bytes)):
        items: dict[bytes, list[str]] = defaultdict(list)
        for row in windows.where(F.col("block") == block).toLocalIterator():  # block_bytes and one row at most
            items[bytes(row["window"])].append(row["item"])
        yield spark.sparkContext.broadcast(list(items.items()))


_held: dict[str, Matcher] = {}


def _matcher(key: str, sent: Broadcast) -> Matcher:
    """One per worker, for the block at work."""
    if key not in _held:
        _held.clear()
        _held[key] = Matcher(sent.value)
    return _held[key]


def _scanned(rows: DataFrame, sent: Broadcast | None, matches_only: bool) -> DataFrame:
    """Replaces `_text` by n_words, spans and items; `matches_only` leaves rows without a match out."""
    kept = [c for c in rows.columns if c != "_text"]
    added = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, sent) if sent is not None else Matcher([])
        for batch in batches:
            found = [matcher.scan(text.as_buffer().to_pybytes()) for text in batch.column("_text")]
            at = [i for i, f in enumerate(found) if f[1] or not matches_only]
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in kept]
            columns.append(pa.array([found[i][0] for i in at], pa.int64()))
            spans = [[{"start": a, "end": b} for a, b in found[i][1]] for i in at]
            columns.append(pa.array(spans, pa.list_(span)))
            columns.append(pa.array([sorted(found[i][2]) for i in at], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, [*kept, "n_words", "spans", "items"])
        give_back()

    return rows.mapInArrow(run, schema_with(rows.select(*kept), added))


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the spans that a text got from several blocks."""
    for batch in batches:
        united = []
        for spans in batch.column("spans").to_pylist():
            out: list[list[int]] = []
            for span in sorted((s["start"], s["end"]) for s in spans):
                if out and span[0] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], span[1])
                else:
                    out.append(list(span))
            united.append([{"start": a, "end": b} for a, b in out])
        at = batch.schema.get_field_index("spans")
        yield batch.set_column(at, "spans", pa.array(united, batch.schema.field(at).type))


KEYS = ["_text_key1", "_text_key2"]


def contamination(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep` with n_words, spans (of words inside occurrences of
    windows: start, end exclusive, apart and in order) and items (ids as text, in
    order) of every whole text, one row per document.

    A null text has no words; so have texts of nothing but marks. Repeated rows
    are repeated; items of one id share their windows; a null item id is the empty
    text; items without words are in no document; without items nothing is found.
    Other columns of both tables are not read.
    """
    named = [F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*named, text.alias("_text"))
    back = [F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)]
    blocks = list(_blocks(item_windows(benchmark), block_bytes))
    if len(blocks) <= 1:
        return _scanned(rows, blocks[0] if blocks else None, False).select(*back, "n_words", "spans", "items")

    keys = [F.xxhash64("_text").alias(KEYS[0]), F.xxhash64(F.lit("second"), "_text").alias(KEYS[1])]
    texts = rows.select(*keys, "_text")
    # A match depends on the text alone: of its repeats one is enough.
    parts = [_scanned(texts, sent, True).dropDuplicates(KEYS).withColumn("block", F.lit(i)) for i, sent in enumerate(blocks)]
    matches = parts[0]
    for part in parts[1:]:
        matches = matches.unionByName(part)
    matches = written(matches, "matches")
    joined = matches.groupBy(*KEYS).agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = written(joined.mapInArrow(_together, joined.schema), "joined")
    counted = _scanned(rows.select("*", *keys), None, False).drop("spans", "items")
    # Stored, so that the numbers by which the rows of a hot text spread stay the same.
    counted = written(counted.withColumn("_at", F.monotonically_increasing_id()), "counted")
    out = lookup_join(counted, joined, KEYS, "left", ["_at"])
    none = {c: F.coalesce(c, F.array().cast(joined.schema[c].dataType)).alias(c) for c in ("spans", "items")}
    return out.select(*back, "n_words", *none.values())


def digests(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit (words inside windows), n_items, items_sha256,
    contaminated of each document; see `contamination`."""
    found = contamination(docs, benchmark, block_bytes)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        items.alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs`, with all its columns, without the documents that hold a window."""
    found = contamination(docs.select("doc_id", "text", *row_keys()), benchmark, block_bytes, tuple(ROW_KEYS))
    dropped = found.where(F.size("spans") > 0).select(*ROW_KEYS, F.lit(False).alias("spare"))
    return without_rows(docs, dropped)
