"""Alignment against the tokenizers run over whole texts and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from levelmark.llm import alignment
from levelmark.llm.queries import ALIGNED_A, ALIGNED_B

DOCS = "doc_id long, text string, lang string, chunk long, at int, _text string, n_a int, code long"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(ALIGNED_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=ALIGNED_B)


@pytest.fixture(scope="module")
def coders():
    with open(ALIGNED_A, encoding="utf-8") as a, open(ALIGNED_B, "rb") as b:
        return alignment.Coders(a.read(), b.read())


def plain_groups(libraries, text):
    """[(A tokens, B tokens)] of each group; none where the tokens do not spell the text."""
    a, b = libraries
    if not text:
        return []
    bytes_of = {c: n for n, c in alignment._byte_alphabet().items()}
    tokens_a = [(i, bytes(bytes_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tokens_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        tokens_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if any(b"".join(x for _, x in t) != whole for t in (tokens_a, tokens_b)):
        return []
    ends = []
    for tokens in (tokens_a, tokens_b):
        at, found = 0, []
        for _, x in tokens:
            at += len(x)
            found.append(at)
        ends.append(found)
    cuts = sorted(set(ends[0]) & set(ends[1]))
    return [
        tuple([i for (i, _), e in zip(t, found, strict=True) if lo < e <= hi] for t, found in ((tokens_a, ends[0]), (tokens_b, ends[1])))
        for lo, hi in zip([0, *cuts], cuts, strict=False)
    ]


def plain(libraries, rows):
    groups = [plain_groups(libraries, t) for _, t in rows]
    linked = [Counter((a, b) for ga, gb in g for a in ga for b in gb) for g in groups]
    held = Counter(p for c in linked for p in c)
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, _), g, c in zip(rows, groups, linked, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (
                doc_id,
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                sum(c.values()),
                sum(n for p, n in c.items() if held[p] == best[p[0]]),
                sum(n * held[p] for p, n in c.items()),
                hashlib.sha256(text.encode()).hexdigest() if g else "",
            )
        )
    return sorted(out, key=str)


def sample():
    draw = random.Random(8)
    words = "the worker's élève naïve 12345 3.14 Straße ñandú I'll don't <|endoftext|> <s> </s> <unk> <0x0A> foo_bar a@b.c … – 日本語 привет 🙂🙃 ﬁ Ǆ".split(" ")
    gaps = [" "] * 12 + ["  ", "\n", "\n\n", "\t", " \n ", "   ", "\r\n", " ", " ", "", ","]
    rows = []
    for i in range(120):
        rows.append((i, "".join(draw.choice(words) + draw.choice(gaps) for _ in range(draw.randint(0, 250)))))
    rows += [(300 + i, t) for i, t in enumerate([None, "", " ", "  ", "\n", "a", " a", "a ", "▁", "a ▁b", "x\x00y", "é", "<unk>", "🙂" * 50])]
    rows += [(400, "a" * 3000), (401, " " * 3000), (402, "ab " * 2000), (403, "=-" * 1500), (None, "no id"), (404, "same text")] + [(404, "same text")] * 5
    return rows


def test_lanes_and_groups_of_single_texts(libraries, coders):
    rows = sample()
    texts = [t or "" for _, t in rows]
    aligned = alignment.align(coders, texts)
    for k, text in enumerate(texts):
        expected = plain_groups(libraries, text)
        found = []
        for g in range(aligned.texts_g[k], aligned.texts_g[k + 1]):
            a = aligned.ids_a[aligned.groups_a[g] : aligned.groups_a[g + 1]].tolist()
            b = aligned.ids_b[aligned.groups_b[g] : aligned.groups_b[g + 1]].tolist()
            found.append((a, b))
        assert found == expected, text[:80]
    assert max(len(coders.parts(t)) for t in texts) > 2 * alignment.LANE_WORDS


def test_latin_texts_encode_as_the_file_does(libraries, coders):
    assert coders.a.fast is not None and coders.b.seams
    draw = random.Random(9)
    latin = [chr(c) for c in range(0x180)]
    texts = ["".join(draw.choices(latin, k=draw.randint(1, 40))) for _ in range(6000)]
    texts += ["".join(draw.choices([" ", "\n", "\x85", "\xa0", "a", "1", "²", "'", "s", "\x1c", "\x1f", "é"], k=12)) for _ in range(6000)]
    assert coders.a.encode(texts) == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts]


def test_words_learnt_anew(coders, monkeypatch):
    texts = ["one two three", "two three four five", "six  two\n x", "▁ bad one", "one"]
    whole = alignment.align(coders, texts)
    monkeypatch.setattr(alignment, "MAX_WORDS", 3)
    monkeypatch.setattr(alignment, "LANE_WORDS", 2)
    again = [alignment.align(coders, [t]) for t in texts]
    assert whole.ids_a.tolist() == sum((x.ids_a.tolist() for x in again), [])
    assert np.diff(whole.texts_g).tolist() == [len(x.groups_a) - 1 for x in again]


def test_seams_change_nothing(libraries, coders):
    """Cutting at every seam gives the tokens of the whole text."""
    draw = random.Random(10)
    pieces = ["a", "b", "the", "é", "1", "'s", ".", "\n", " ", "  ", "▁", "\t", "日", "-", "\xa0", "\x1f", " "]
    for _ in range(1500):
        text = "".join(draw.choice(pieces) + draw.choice(["", " "]) for _ in range(draw.randint(1, 14)))
        lanes = coders.parts(text)
        assert " ".join(lanes) == text and lanes == alignment.SEAM.split(text)
        for library, coder, blank in ((libraries[0], coders.a, " "), (libraries[1], coders.b, "")):
            whole = library.encode(" " + text, add_special_tokens=False).ids if blank else library.encode(text)
            assert sum(coder.encode([blank + x for x in lanes]), []) == whole, (text, lanes)


def test_large_groups_are_counted(coders, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "LARGE_GROUP", 1)
    x = alignment.align(coders, ["a" * 500, "ünïcödé çäfé", ""])
    of, code, times = x.pairs(coders.size_b)
    for k, text in enumerate(["a" * 500, "ünïcödé çäfé", ""]):
        expected = Counter((a, b) for ga, gb in plain_groups(libraries, text) for a in ga for b in gb)
        assert {divmod(int(c), coders.size_b): int(n) for t, c, n in zip(of, code, times, strict=True) if t == k} == expected


def test_digests_against_plain_loops(spark, libraries, monkeypatch):
    rows = sample()
    frame = spark.createDataFrame([(i, t, "en", 1, 2, "x", 3, 4) for i, t in rows], DOCS).repartition(3)
    found = alignment.digests(frame, ALIGNED_A, ALIGNED_B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(libraries, rows)
    assert alignment.digests(frame.limit(0), ALIGNED_A, ALIGNED_B).count() == 0
    no_tokens = frame.where("text IS NULL OR text = ''")
    assert {tuple(r)[1:] for r in alignment.digests(no_tokens, ALIGNED_A, ALIGNED_B).collect()} == {(0,) * 6 + ("",)}


def test_chunks_change_nothing(spark, libraries, coders):
    """The same sums from chunks of a few documents each."""
    rows = [(i, t or "") for i, t in sample()]
    expected = {r[0]: r[4] for r in plain(libraries, rows)}
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([t for _, t in rows])], ["doc_id", "_text"])
    chunk, found, numbers = alignment._Chunk(0), {}, []
    for start in range(0, len(rows), 7):
        chunk.add(batch.slice(start, 7), [t for _, t in rows[start : start + 7]], coders)
        if chunk.chars > 3000:
            for out in chunk.output():
                numbers.append(chunk.number)
                found |= {r["doc_id"]: r["n_links"] for r in out.to_pylist() if r["codes"] is None}
            chunk = alignment._Chunk(chunk.number + 1)
    for out in chunk.output() if chunk.rows else ():
        found |= {r["doc_id"]: r["n_links"] for r in out.to_pylist() if r["codes"] is None}
    assert found == expected and len(set(numbers)) > 3


def test_token_groups(spark, libraries):
    rows = [(1, "The naïve 3.14 worker's"), (2, ""), (3, None)]
    found = {r["doc_id"]: r for r in alignment.token_groups(spark.createDataFrame(rows, "doc_id long, text string"), ALIGNED_A, ALIGNED_B).collect()}
    groups = plain_groups(libraries, rows[0][1])
    assert found[1]["a_ids"] == [i for a, _ in groups for i in a] and found[1]["b_ids"] == [i for _, b in groups for i in b]
    assert found[1]["a_ends"][-1] == len(found[1]["a_ids"]) and len(found[1]["b_ends"]) == len(groups)
    assert found[2]["a_ids"] == found[3]["b_ends"] == []


def test_very_long_texts(libraries, coders):
    """Megabytes in one text: many lanes, one lane, one long run."""
    draw = random.Random(12)
    words = ["the", "naïve", "worker's", "3.14", "Straße", "élève,", "x" * 40]
    texts = [" ".join(draw.choices(words, k=150_000)), "ab" * 200_000, " " * 100_000, "\n".join(draw.choices(words, k=30_000))]
    x = alignment.align(coders, texts)
    for k, text in enumerate(texts):
        assert x.texts_a[k + 1] - x.texts_a[k] == len(libraries[0].encode(" " + text, add_special_tokens=False).ids)
        assert x.texts_b[k + 1] - x.texts_b[k] == len(libraries[1].encode(text))
    assert len(x.groups_a) == len(x.groups_b) and (np.diff(x.texts_g) > 0).all()
