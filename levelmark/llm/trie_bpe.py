"""BPE encoding over a trie of distinct words, and decoding.

The distinct words of a batch are put in order, which is the order in which a
depth-first walk over their trie meets them; the stretch a word shares with the
one before is the path the walk is still on. Each node of the path keeps the
last token of the encoding of its prefix. That token is the one vocabulary entry
that ends here and that the merges leave beside the last token of the prefix it
starts after, so a node is settled from the nodes above it, once for all the
words below. Reading the last tokens backwards gives a word's encoding.
"""

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.normalizers import NFC, Lowercase, Sequence
from tokenizers.pre_tokenizers import Split

from levelmark.llm.common import give_back, schema_with, slices

#: Words kept with their encodings in a task before it starts anew.
MAX_WORDS = 200_000
#: Pairs of tokens kept in a worker with whether they stay apart.
MAX_PAIRS = 100_000

# What the tokenizer file's normaliser, splitter and byte alphabet say.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

# The same pieces for text below U+0180, where NFC changes nothing.
BEYOND_LATIN = re.compile("[^\x00-\u017f]")
LATIN_PIECES = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-\u017f]+|[0-9²³¹¼-¾]|[^\\t-\\r \x85\xa0a-zªµºÀ-ÖØ-öø-\u017f0-9²³¹¼-¾]+"
)


def _byte_alphabet() -> dict[int, str]:
    """Printable Latin-1 bytes stand for themselves, the others for the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Pairs(dict):
    """Whether the merges leave two tokens as they are where their texts meet.

    Undoes the merges inside both, latest first, and looks for one across the
    seam that would have come before the merge undone last.
    """

    def __init__(self, rank: dict[tuple[int, int], int], made: dict[int, int], parts: dict[int, tuple[int, int]]):
        super().__init__()
        self.rank, self.made, self.parts = rank, made, parts

    def __missing__(self, key: tuple[int, int]) -> bool:
        left, right = key
        before, apart = len(self.rank), True
        while True:
            across = self.rank.get((left, right))
            if across is not None and across < before:
                apart = False
                break
            of_left, of_right = self.made.get(left, -1), self.made.get(right, -1)
            if of_left < 0 and of_right < 0:
                break
            if of_left > of_right:
                before, left = of_left, self.parts[left][1]
            else:  # of equal merges the left one comes first: one across precedes the right token's own
                before, right = of_right + 1, self.parts[right][0]
        self[key] = apart
        return apart


class TrieBpe:
    """Encoder and decoder for a word-end BPE vocabulary (the JSON text of its file).
    `own` are the ids of the tokens that encode their own text, where known."""

    def __init__(self, vocabulary: str, own: frozenset[int] | None = None):
        spec = json.loads(vocabulary)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.names = {i: s for s, i in (self.ids | special).items()}
        self.number = {i: str(i) for i in self.names}
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for n, merge in enumerate(spec["model"]["merges"]):
            left, right = (self.ids[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            whole = self.ids[self.names[left] + self.names[right]]
            self.rank[left, right] = n
            self.made.setdefault(whole, n)
            self.parts.setdefault(whole, (left, right))
        self.alphabet = _byte_alphabet()
        self.words: dict[str, tuple[int, ...]] = {}
        self.apart = Pairs(self.rank, self.made, self.parts)
        # Only a token that is the encoding of its own text can be part of one.
        if own is None:
            own = frozenset(i for s, i in self.ids.items() if self._merged(s) == [i])
        self.own, own = own, {s: i for s, i in self.ids.items() if i in own}
        self.inner = {s: i for s, i in own.items() if not s.endswith(WORD_END)}
        self.endings = {s[: -len(WORD_END)]: i for s, i in own.items() if s.endswith(WORD_END)}
        self.sizes = {i: len(s.removesuffix(WORD_END)) for s, i in own.items()}
        self.longest = max(self.sizes.values())
        self.lower, self.splitter = Sequence([NFC(), Lowercase()]), Split(Regex(PIECES), "removed", invert=True)

    # Tokens and their merges

    def _merged(self, text: str) -> list[int]:
        """The merges, lowest first, applied to the symbols of a token's name."""
        ends = text.endswith(WORD_END) and len(text) > len(WORD_END)
        symbols = list(text[: -len(WORD_END)] if ends else text)
        if ends:
            symbols[-1] += WORD_END
        tokens = [self.ids[s] for s in symbols]
        while len(tokens) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)))
            if rank == len(self.rank):
                break
            tokens[at : at + 2] = [self.ids[self.names[tokens[at]] + self.names[tokens[at + 1]]]]
        return tokens

    def add_words(self, words: Iterable[str]) -> None:
        """Walks over the trie of the words and keeps their encodings."""
        symbols = {w: w.encode().decode("latin-1").translate(self.alphabet) for w in words}
        inner_tokens, last_tokens, apart, size = self.inner.get, self.endings.get, self.apart, self.sizes
        longest = self.longest
        if len(apart) > MAX_PAIRS:
            apart.clear()
        path, lasts = "", [-1]  # lasts[i]: last token of the encoding of path[:i]
        for word, text in sorted(symbols.items(), key=itemgetter(1)):
            # All symbols but the last are nodes on the way; the last one ends the word.
            inner = len(text) - 1
            shared, most = 0, min(len(path), inner)
            while shared < most and path[shared] == text[shared]:
                shared += 1
            del lasts[shared + 1 :]
            path = text[:inner]
            for end in range(shared + 1, inner + 1):
                start = end - longest if end > longest else 0
                token = inner_tokens(text[start:end])
                while token is None or start and not apart[lasts[start], token]:
                    start += 1
                    token = inner_tokens(text[start:end])
                lasts.append(token)
            start = inner + 1 - longest if inner >= longest else 0
            token = last_tokens(text[start:])
            while token is None or start and not apart[lasts[start], token]:
                start += 1
                token = last_tokens(text[start:])
            found = [token]
            while start > 0:
                found.append(lasts[start])
                start -= size[lasts[start]]
            found.reverse()
            self.words[word] = tuple(found)

    # Texts

    def _plain_pieces(self, text: str) -> list[str]:
        if text.isascii() or not BEYOND_LATIN.search(text):
            return LATIN_PIECES.findall(text.lower())
        return [p for p, _ in self.splitter.pre_tokenize_str(self.lower.normalize_str(text))]

    def _pieces(self, text: str) -> tuple[list[str], bool]:
        """Pieces of the text; whether special tokens are among them."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain_pieces(text), False
        parts = self.split_special.split(text)
        return list(chain.from_iterable([p] if i % 2 else self._plain_pieces(p) for i, p in enumerate(parts))), True

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """Token ids of each text. Distinct words of all texts are encoded once."""
        split = [self._pieces(t) for t in texts]
        if len(self.words) > MAX_WORDS:
            self.words.clear()
        new = set().union(*(p for p, _ in split)) - self.words.keys()
        self.add_words(new - self.special.keys())
        known, special = self.words, {s: (i,) for s, i in self.special.items()}
        for pieces, has_special in split:
            of = (lambda p: special.get(p) or known[p]) if has_special else known.__getitem__
            yield list(chain.from_iterable(map(of, pieces)))

    def decode(self, ids: Iterable[int]) -> str:
        """Names of the tokens, joined by spaces, as the file (it names no decoder) has it."""
        return " ".join(map(self.names.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of tokens, sha256 of the ids' text and of the decoded text."""
        numbers = " ".join(map(self.number.__getitem__, ids))
        return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (numbers, self.decode(ids)))


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _known(path: str) -> tuple[str, frozenset[int]]:
    """The file, and what takes long to find out of it: once, not in every task."""
    text = _read(path)
    own = TrieBpe(text).own
    give_back()  # the driver keeps nothing of the tables
    return text, own


def _coded(docs: DataFrame, path: str, keep: list[str], made: str, columns) -> DataFrame:
    """`keep` columns of the documents and those that `columns` makes of a coder
    and the texts. The file is read once, by the driver, and sent out whole (its
    size is fixed by the vocabulary, under 2 MB)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(_known(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TrieBpe(*vocabulary.value)
        for rows, texts in slices(batches, "_text"):
            made_rows = [columns(coder, ids) for ids in coder.encode(texts)]
            made_columns = [pa.array(list(c), t) for c, t in zip(zip(*made_rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), *made_columns], [*keep, *names])
        del coder  # its tables are of 50 MB and the worker goes on to other tasks
        give_back()

    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    names, types = zip(*((c.split()[0], kinds[c.split()[1]]) for c in made.split(", ")), strict=True)
    schema = schema_with(docs.select(*keep), made)
    return docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and `ids`, the tokens of the whole text. A null text counts as empty."""
    return _coded(docs, path, ["doc_id"], "ids array<int>", lambda coder, ids: (ids,))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and `text`, decoded from `ids`; null ids stay null."""
    vocabulary = encoded.sparkSession.sparkContext.broadcast(_known(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TrieBpe(*vocabulary.value)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])
        del coder
        give_back()

    schema = schema_with(encoded.select("doc_id"), "text string")
    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per document, null
    text as empty; repeated rows are repeated; other columns are not read.

    Encodes and decodes every whole text; ids and texts stay in the task.
    """
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(docs, path, ["doc_id"], made, lambda coder, ids: coder.digests(ids))
