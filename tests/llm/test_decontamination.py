"""Benchmark passages against plain word-by-word search."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from levelmark.llm import decontamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, _text string, spans int, _row_key1 long"
ITEMS = "item_id long, text string, window string, size int"


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain(docs, items):
    windows = set()
    for item, text in items:
        words = plain_words(text)
        k = min(10, len(words))
        windows |= {(tuple(words[i : i + k]), "" if item is None else str(item)) for i in range(len(words) - k + 1) if k}
    out = []
    for doc_id, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for window, item in windows:
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(found), names, bool(hit)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    rows = [(i, t, "en", "s", 1, 2, "x", 3, 4) for i, t in docs]
    return spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame([(i, t, "w", 1) for i, t in items], ITEMS)


def sample(seed, words="a b c d E é 7", docs=150):
    draw = random.Random(seed)
    pick = lambda n: draw.choice([" ", ", ", "-"]).join(draw.choice(words.split()) for _ in range(n))
    items = [(i, pick(draw.choice([1, 2, 3, 4, 5, 9, 10, 11, 14, 25]))) for i in range(30)]
    items = [(i, t) for i, t in items if len(plain_words(t)) > 2 or draw.random() < 0.1]
    items += [(None, "no id but words"), (3, "a second row of item three"), (90, None), (91, ""), (92, "!?"), (93, "no id but words")]
    rows = []
    for i in range(docs):
        text = pick(draw.randint(0, 60))
        if draw.random() < 0.4:
            text += draw.choice([" ", "x", "\n"]) + draw.choice(items)[1].__str__().upper()
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "..."), (None, "see: No ID but WORDS"), (503, "No id, but words!")] + [(504, "no id but words")] * 20
    return rows, items


def test_against_plain_search(spark):
    for seed in (1, 2):
        docs, items = sample(seed)
        found = decontamination.digests(*tables(spark, docs, items)).collect()
        assert sorted(map(tuple, found), key=str) == plain(docs, items)


def test_blocks_give_the_same(spark):
    docs, items = sample(3)
    frames = tables(spark, docs, items)
    once = sorted(map(tuple, decontamination.contamination(*frames).collect()), key=str)
    many = sorted(map(tuple, decontamination.contamination(*frames, block_bytes=400).collect()), key=str)
    assert once == many and any(spans for _, _, spans, _ in once)
    assert sorted(map(tuple, decontamination.digests(*frames, block_bytes=400).collect()), key=str) == plain(docs, items)


def test_pieces_of_long_texts():
    draw = random.Random(4)
    words = [draw.choice(["aa", "b", "cé", "d"]) for _ in range(4000)]
    windows = [(" ".join(words[i : i + 10]).encode(), [str(i)]) for i in range(0, 3900, 97)] + [(b"aa b", ["short"]), (b"d", ["one"])]
    matcher = decontamination.Matcher(windows)
    data = " ".join(words).encode()
    whole = matcher.scan(data)
    assert whole[0] == 4000 and "one" in whole[2]
    for piece in (1, 7, 64, 1000):
        assert matcher.scan(data, piece) == whole


def test_windows_longer_than_a_piece(spark):
    words = [f"w{i}" for i in range(40)]
    frames = tables(spark, [(1, " ".join(words[5:30]))], [(1, " ".join(words))])
    row = decontamination.contamination(*frames).first()
    assert row["n_words"] == 25 and [tuple(s) for s in row["spans"]] == [(0, 25)] and row["items"] == ["1"]


def test_empty_tables(spark):
    docs, items = sample(5, docs=5)
    no_docs, no_items = (f.limit(0) for f in tables(spark, docs, items))
    some_docs, some_items = tables(spark, docs, items)
    assert decontamination.digests(no_docs, some_items).count() == 0
    assert sorted(map(tuple, decontamination.digests(some_docs, no_items).collect()), key=str) == plain(docs, [])


def test_clean_documents_stay(spark):
    docs, items = sample(6)
    frame, benchmark = tables(spark, docs, items)
    kept = decontamination.keep_uncontaminated(frame, benchmark)
    assert kept.columns == frame.columns
    clean = sorted((r[:1] for r in plain(docs, items) if not r[5]), key=str)
    assert sorted(((r["doc_id"],) for r in kept.collect()), key=str) == clean
    assert kept.where(F.col("_row_key1") != 4).count() == 0
