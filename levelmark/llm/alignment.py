"""Alignment of two tokenizers' tokens over the same bytes, and how often their
tokens meet in a corpus.

Where a blank is between two words, both tokenizers start a new token, so texts are
cut there and every distinct word is encoded once. Some hundred words are a lane.
The lanes of a batch are merged in lockstep: one state holds every
lane's place among its A tokens and its B tokens, and a step moves all of them on,
each past the token that ends first, or past both where they end together, which
cuts a group. Finished lanes leave the state.

How many documents hold a pair of ids is counted once per chunk of documents and
summed over chunks. A chunk's documents refer to the chunk's own list of pairs, so
what returns to them is one count per pair and chunk, not per link: neither the
pairs of the corpus nor the links of a document meet in one place.
"""

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from levelmark.llm.common import give_back, schema_with, slices
from levelmark.llm.trie_bpe import _byte_alphabet
from levelmark.sources.shared import written

#: Words of a lane; characters of the texts merged at a time, and of a chunk, about.
LANE_WORDS, SLICE_CHARS, CHUNK_CHARS = 100, 2_000_000, 16_000_000
#: Words whose tokens are taken over at a time, and those of them that are encoded as one text.
TOGETHER, JOINED = 16_384, 64
#: Words kept with their tokens, and their characters, before a worker starts anew.
MAX_WORDS, MAX_CHARS = 300_000, 8_000_000
#: Links of a group from which on its pairs of ids are counted instead of listed.
LARGE_GROUP = 4096

# How byte-level BPE splits text, and SentencePiece's mark for a blank.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"

BEYOND_LATIN = re.compile("[^\x00-ſ]")
#: A blank that neither tokenizer joins to what is before it.
SEAM = re.compile(f"(?<=[^\\s{BLANK}]) (?=[^\\s{BLANK}])")
EDGES = "".join(c for c in map(chr, range(0x3100)) if c.isspace()) + BLANK
#: Any other blank.
NO_SEAM = re.compile(f"^ | [\\s{BLANK}]|[\\s{BLANK}] | \\Z")


class ByteLevel:
    """Byte-level BPE from the JSON text of its file; special tokens are plain text."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        alphabet = {c: b for b, c in _byte_alphabet().items()}
        self.names = {i: bytes(alphabet[c] for c in s) for s, i in model["vocab"].items() if all(c in alphabet for c in s)}
        self.library = Tokenizer.from_str(spec)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        # Where ids are in the order of the merges, ranks of byte strings say the same, and faster.
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in pairs]
        ranks = {self.names[i]: i for i in chain(map(model["vocab"].get, alphabet), made)}
        fits = made == sorted(set(made)) and made[:1] > [len(alphabet) - 1] and len(ranks) == len(alphabet) + len(made)
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if fits else None

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Classes of characters beyond Latin may differ between the libraries: there the file's own decides."""
        if self.fast is None:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        return [
            self.library.encode(t, add_special_tokens=False).ids if BEYOND_LATIN.search(t) else self.fast.encode_ordinary(t)
            for t in texts
        ]


class Pieces:
    """SentencePiece BPE from its model's bytes."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.names, self.seams = {}, True
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            self.names[i] = bytes([int(piece[3:5], 16)]) if self.library.is_byte(i) else piece.replace(BLANK, " ").encode()
            self.seams &= BLANK not in piece.lstrip(BLANK)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


class Coders:
    """Both tokenizers and what the ids of either stand for."""

    def __init__(self, spec: str, model: bytes):
        self.a, self.b = ByteLevel(spec), Pieces(model)
        self.size_b = max(self.b.names) + 1
        most = max(max(self.a.names), max(self.b.names))
        self.lengths = [np.zeros(most + 1, np.int64) for _ in range(2)]
        for lengths, names in zip(self.lengths, (self.a.names, self.b.names), strict=True):
            for i, name in names.items():
                lengths[i] = len(name)
        # Decimal digits of every id, with room for a mark behind them.
        width = len(str(most)) + 1
        self.digits = np.zeros((most + 1, width), np.uint8)
        self.n_digits = np.zeros(most + 1, np.int64)
        for i in range(most + 1):
            text = str(i).encode()
            self.digits[i, : len(text)] = np.frombuffer(text, np.uint8)
            self.n_digits[i] = len(text)

        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.chars = 0
        self.spelled = np.empty(0, bool)
        self.tokens = [np.empty(0, np.int64) for _ in range(2)]
        self.starts = [np.zeros(1, np.int64) for _ in range(2)]

    def parts(self, text: str) -> list[str]:
        """The words of a text, cut at every seam; none of an empty one."""
        if not text or not self.b.seams:
            return [text] if text else []
        return SEAM.split(text) if NO_SEAM.search(text) else text.split(" ")

    def learn(self, words: set[str]) -> None:
        """Encodes words and notes whether the tokens of either kind spell a blank and the word."""
        size = sum(map(len, words))
        if len(self.words) + len(words) > MAX_WORDS or self.chars + size > MAX_CHARS:
            self.forget()
        new = list(words - self.words.keys())
        self.chars += size
        odd = [w for w in new if not w or w.strip(EDGES) != w]
        plain = list(set(new).difference(odd)) if odd else new
        self.words.update(zip(chain(plain, odd), range(len(self.words), len(self.words) + len(new)), strict=True))
        for i in range(0, len(plain), TOGETHER):
            self._add(plain[i : i + TOGETHER])
        for w in odd:
            self._add([w])

    def _add(self, words: list[str]) -> None:
        """Encodes words joined to texts: between them are seams. Word by word where
        the tokens do not spell them."""
        data = [f" {w}".encode() for w in words]
        ends = _starts(np.fromiter(map(len, data), np.int64, len(data)))
        texts, whole = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)], b"".join(data)
        found = []
        for coder, lengths, given in ((self.a, self.lengths[0], [" " + t for t in texts]), (self.b, self.lengths[1], texts)):
            ids = list(chain.from_iterable(coder.encode(given)))
            spelled = b"".join(map(coder.names.__getitem__, ids)) == whole
            ids = np.array(ids, np.int64)
            reached = _starts(lengths[ids])
            at = np.searchsorted(reached, ends) if spelled else np.array([0, len(ids)])
            found.append((spelled and np.array_equal(reached[at], ends), ids, at))
        spelled = all(f[0] for f in found)
        if not spelled and len(words) > 1:
            for w in words:
                self._add([w])
            return
        self.spelled = np.concatenate([self.spelled, np.full(len(words), spelled)])
        for k, (_, ids, at) in enumerate(found):
            self.starts[k] = np.concatenate([self.starts[k], at[1:] + self.starts[k][-1]])
            self.tokens[k] = np.concatenate([self.tokens[k], ids])


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, to_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which A and which B tokens end a group. `ends` are the tokens' ends in bytes
    from the start of their lane, lane after lane; a lane's A tokens are from_a ..
    to_a - 1, its B tokens start at from_b. All lanes move at each step, and the ones
    that are through leave."""
    cut_a, cut_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    i, j, last = from_a.copy(), from_b.copy(), to_a - 1
    while len(i):
        a, b = ends_a[i], ends_b[j]
        meet = a == b
        cut_a[i[meet]] = True
        cut_b[j[meet]] = True
        through = meet & (i == last)
        i += a <= b
        j += b <= a
        if through.any():
            stay = ~through
            i, j, last = i[stay], j[stay], last[stay]
    return cut_a, cut_b


def _starts(counts: np.ndarray) -> np.ndarray:
    """Where each of several stretches starts, and the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Aligned:
    """Tokens and groups of the texts of a slice, text after text.

    `texts_a`, `texts_b` and `texts_g` say where each text's A tokens, B tokens and
    groups start; `groups_a` and `groups_b` where each group's tokens start. All
    end with the total.
    """

    ids_a: np.ndarray
    ids_b: np.ndarray
    groups_a: np.ndarray
    groups_b: np.ndarray
    texts_a: np.ndarray
    texts_b: np.ndarray
    texts_g: np.ndarray

    def links(self) -> np.ndarray:
        return np.diff(self.groups_a) * np.diff(self.groups_b)

    def pairs(self, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, code, times): every text's linked pairs of ids, in order, with
        the number of its links that they have; code = A id * size_b + B id."""
        per_a, per_b, links = np.diff(self.groups_a), np.diff(self.groups_b), self.links()
        text_of = np.repeat(np.arange(len(self.texts_g) - 1), np.diff(self.texts_g))
        listed = np.flatnonzero(links <= LARGE_GROUP)
        n = links[listed]
        of = np.repeat(listed, n)
        place = np.arange(len(of)) - np.repeat(_starts(n)[:-1], n)
        a = self.ids_a[self.groups_a[of] + place // per_b[of]]
        b = self.ids_b[self.groups_b[of] + place % per_b[of]]
        keys = [(text_of[of] << 40) | (a.astype(np.int64) * size_b + b)]
        times = [np.ones(len(of), np.int64)]
        for g in np.flatnonzero(links > LARGE_GROUP):
            a, n_a = np.unique(self.ids_a[self.groups_a[g] : self.groups_a[g] + per_a[g]], return_counts=True)
            b, n_b = np.unique(self.ids_b[self.groups_b[g] : self.groups_b[g] + per_b[g]], return_counts=True)
            keys.append(((text_of[g] << 40) | (a.astype(np.int64)[:, None] * size_b + b)).ravel())
            times.append((n_a[:, None] * n_b).ravel())
        keys, times = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(keys, kind="stable")
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        return keys[first] >> 40, keys[first] & ((1 << 40) - 1), np.add.reduceat(times, first) if len(first) else times

    def written_out(self, coders: Coders) -> Iterator[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        per_a, per_b = np.diff(self.groups_a), np.diff(self.groups_b)
        ids = np.empty(len(self.ids_a) + len(self.ids_b), np.int64)
        marks = np.full(len(ids), ord(","), np.uint8)
        at_a = np.arange(len(self.ids_a)) + np.repeat(self.groups_b[:-1], per_a)
        at_b = np.arange(len(self.ids_b)) + np.repeat(self.groups_a[1:], per_b)
        ids[at_a], ids[at_b] = self.ids_a, self.ids_b
        marks[at_a[self.groups_a[1:] - 1]] = ord("|")
        marks[at_b[self.groups_b[1:] - 1]] = ord(";")
        digits, n = coders.digits[ids], coders.n_digits[ids]
        digits[np.arange(len(ids)), n] = marks
        data = digits[np.arange(digits.shape[1]) <= n[:, None]].tobytes()
        ends = _starts(n + 1)[self.texts_a + self.texts_b]
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield data[start : max(start, end - 1)]


def align(coders: Coders, texts: list[str]) -> Aligned:
    """Texts that are empty, or whose tokens of either kind do not spell a blank
    and the text, have no tokens."""
    parts = [coders.parts(t) for t in texts]
    coders.learn(set(chain.from_iterable(parts)))
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    words = np.fromiter(map(coders.words.__getitem__, chain.from_iterable(parts)), np.int64, int(counts.sum()))
    del parts
    unspelled = np.diff(_starts(~coders.spelled[words])[_starts(counts)]) > 0
    words, counts = words[~np.repeat(unspelled, counts)], np.where(unspelled, 0, counts)

    texts_of = _starts(counts)
    per_text = -(-counts // LANE_WORDS)
    place = np.arange(per_text.sum()) - np.repeat(_starts(per_text)[:-1], per_text)
    lanes_of = np.append(np.repeat(texts_of[:-1], per_text) + place * LANE_WORDS, len(words))
    ids, lanes, texts_at, ends = [], [], [], []
    for tokens, starts, lengths in zip(coders.tokens, coders.starts, coders.lengths, strict=True):
        n = starts[words + 1] - starts[words]
        before = _starts(n)
        found = tokens[np.arange(before[-1]) + np.repeat(starts[words] - before[:-1], n)]
        total = _starts(lengths[found])
        lane = before[lanes_of]
        ids.append(found)
        lanes.append(lane)
        texts_at.append(before[texts_of])
        ends.append(total[1:] - np.repeat(total[lane[:-1]], np.diff(lane)))
    cut_a, cut_b = lockstep(*ends, lanes[0][:-1], lanes[1][:-1], lanes[0][1:])
    groups_a, groups_b = (np.concatenate([[0], np.flatnonzero(cut) + 1]) for cut in (cut_a, cut_b))
    return Aligned(*ids, groups_a, groups_b, *texts_at, np.searchsorted(groups_a, texts_at[0]))


# On tables


_held: dict[tuple[str, str], Coders] = {}


def _coders(paths: tuple[str, str], sent) -> Coders:
    """One per worker."""
    if paths not in _held:
        _held.clear()
        _held[paths] = Coders(*sent.value)
    return _held[paths]


def _sent(df: DataFrame, path_a: str, path_b: str):
    """Both files whole, read by the driver (a few MB, fixed by the vocabularies)."""
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return df.sparkSession.sparkContext.broadcast((a.read(), b.read()))


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))


def token_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a_ids, b_ids, a_ends, b_ends: a document's tokens by both
    tokenizers, and for every group the number of tokens up to its end."""
    sent = _sent(docs, path_a, path_b)
    names = ["a_ids", "b_ids", "a_ends", "b_ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders((path_a, path_b), sent)
        for rows, texts in slices(batches, "_text", SLICE_CHARS):
            x = align(coders, texts)
            groups = np.repeat(np.arange(len(texts)), np.diff(x.texts_g))
            ends = [g[1:] - t[groups] for g, t in ((x.groups_a, x.texts_a), (x.groups_b, x.texts_b))]
            columns = [_lists(x.ids_a, x.texts_a), _lists(x.ids_b, x.texts_b), *(_lists(e, x.texts_g) for e in ends)]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", *names])
        give_back()

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return rows.mapInArrow(run, schema_with(rows.select("doc_id"), ", ".join(f"{n} array<int>" for n in names)))


FACTS = ["n_a", "n_b", "n_groups", "n_links"]


class _Chunk:
    """What a chunk's documents gave so far."""

    def __init__(self, number: int):
        self.number, self.chars = number, 0
        self.rows: list[pa.RecordBatch] = []
        self.facts: list[np.ndarray] = []
        self.hashes: list[str] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, rows: pa.RecordBatch, texts: list[str], coders: Coders) -> None:
        x = align(coders, texts)
        links = _starts(x.links())[x.texts_g]
        before = sum(map(len, self.facts))
        self.facts.append(np.column_stack([np.diff(v) for v in (x.texts_a, x.texts_b, x.texts_g, links)]))
        of, code, times = x.pairs(coders.size_b)
        self.pairs.append((of + before, code, times))
        has = np.diff(x.texts_a) > 0
        spelled = (hashlib.sha256(s).hexdigest() for s in x.written_out(coders))
        self.hashes += [h if y else "" for h, y in zip(spelled, has.tolist(), strict=True)]
        self.rows.append(rows.select(["doc_id"]))
        self.chars += sum(map(len, texts))

    def output(self) -> Iterator[pa.RecordBatch]:
        """A row per document, and one with the chunk's pairs and how many of its documents hold them."""
        of, code, times = (np.concatenate(c) for c in zip(*self.pairs, strict=True))
        codes, at, held = np.unique(code, return_inverse=True, return_counts=True)
        facts = np.concatenate(self.facts)
        bounds = np.searchsorted(of, np.arange(len(facts) + 1))
        pack = zstandard.ZstdCompressor(level=3).compress
        blobs = []
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            # places in the chunk's list of pairs, ascending, as steps; then how many links each has
            steps = np.diff(at[start:end], prepend=0).astype("<u4")
            blobs.append(pack(steps.tobytes() + times[start:end].astype("<i8").tobytes()) if end > start else None)
        n = len(facts)
        ids = pa.concat_arrays([r.column("doc_id") for r in self.rows])
        columns = [
            pa.array([self.number] * n, pa.int64()),
            ids,
            *(pa.array(facts[:, k]) for k in range(len(FACTS))),
            pa.array(self.hashes),
            pa.array(blobs, pa.binary()),
            pa.nulls(n, pa.list_(pa.int64())),
            pa.nulls(n, pa.list_(pa.int64())),
        ]
        names = ["chunk", "doc_id", *FACTS, "groups_sha256", "blob", "codes", "held"]
        yield pa.RecordBatch.from_arrays(columns, names)
        if len(codes):
            columns = [pa.array([self.number], pa.int64()), *(pa.nulls(1, c.type) for c in columns[1:-2])]
            columns += [pa.array([v.tolist()], pa.list_(pa.int64())) for v in (codes, held)]
            yield pa.RecordBatch.from_arrays(columns, names)


def _counted(batches: Iterator[pa.RecordBatch], coders: Coders) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    chunk = _Chunk(first)
    for rows, texts in slices(batches, "_text", SLICE_CHARS):
        chunk.add(rows, texts, coders)
        if chunk.chars >= CHUNK_CHARS or sum(map(len, chunk.facts)) >= 1 << 20:
            yield from chunk.output()
            chunk = _Chunk(chunk.number + 1)
    if chunk.rows:
        yield from chunk.output()


def pair_counts(table: DataFrame, size_b: int) -> DataFrame:
    """(chunk, at, code, n, best): every chunk's pairs, in how many documents of
    the corpus they are linked, and whether no pair of the same A id is in more."""
    held = table.where("codes IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("codes", "held")).alias("at", "pair"))
    held = held.select("chunk", "at", F.col("pair.codes").alias("code"), F.col("pair.held").alias("held"))
    counts = held.groupBy("code").agg(F.sum("held").alias("n"))
    # An A id has at most as many pairs as B has ids.
    of_a = Window.partitionBy(F.expr(f"code div {size_b}"))
    counts = counts.select("code", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))
    return held.select("chunk", "at", "code").join(counts, "code")


def digests(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Every whole text is encoded by both tokenizers once. A null or empty text, and
    one whose tokens do not spell it, has no tokens: zeros and an empty string.
    Repeated rows are repeated and each count as a document; ids may be null;
    other columns are not read.
    """
    sent = _sent(docs, path_a, path_b)
    size_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    doc_id = rows.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{n} bigint" for n in FACTS)
    schema = f"chunk bigint, doc_id {doc_id}, {longs}, groups_sha256 string, blob binary, codes array<bigint>, held array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _counted(batches, _coders((path_a, path_b), sent))
        give_back()

    table = written(rows.mapInArrow(run, schema), "alignments")
    counts = pair_counts(table, size_b).select(F.col("chunk").alias("of_chunk"), "at", "n", "best")
    of_docs = table.where("codes IS NULL").select("chunk", "doc_id", *FACTS, "groups_sha256", "blob")

    def rated(left: pa.Table, right: pa.Table) -> pa.Table:
        n, best = (np.zeros(right.num_rows, np.int64) for _ in range(2))
        at = right.column("at").to_numpy()
        n[at], best[at] = right.column("n").to_numpy(), right.column("best").to_numpy()
        unpack, sums = zstandard.ZstdDecompressor().decompress, []
        for blob in left.column("blob").to_pylist():
            if blob is None:
                sums.append((0, 0))
                continue
            data = unpack(blob)
            size = len(data) // 12
            places = np.cumsum(np.frombuffer(data, "<u4", size).astype(np.int64))
            times = np.frombuffer(data, "<i8", size, 4 * size)
            sums.append((int(times @ best[places]), int(times @ n[places])))
        out = left.select(["doc_id", *FACTS])
        for name, column in zip(("n_best", "count_sum"), zip(*sums, strict=True), strict=True):
            out = out.append_column(name, pa.array(column, pa.int64()))
        return out.append_column("groups_sha256", left.column("groups_sha256"))

    out = f"doc_id {doc_id}, {longs}, n_best bigint, count_sum bigint, groups_sha256 string"
    return of_docs.groupBy("chunk").cogroup(counts.groupBy("of_chunk")).applyInArrow(rated, out)
