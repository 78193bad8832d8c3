"""Many texts that share shingles but are no copies: they come together in no group."""

import numpy as np
import pyarrow as pa
from test_texts import plain_components

from levelmark.llm import signature_join
from levelmark.llm.shingles import count_words, shingle_sets, weighted_sets


def test_many_sets_of_one_shingle_are_not_taken_unseen():
    key = np.array([1, *[5] * 200, 9])
    rows = pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.arange(len(key)))], ["key", "node"])
    out = pa.Table.from_batches(signature_join._runs(iter([rows])))
    assert [n for n in out.column("nodes").to_pylist() if n] == [list(range(1, 201))]
    # Beside the ends of the task, no pair is an edge before the bitmaps were compared.
    assert not [a for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist()) if a != b]


def test_pairs_are_those_of_a_plain_loop():
    rng = np.random.default_rng(3)
    sets = []
    for n in (1, 2, 5, 20, 60, 70, 130, 250, 260, 500):
        for _ in range(6):
            own = rng.integers(0, 1 << 63, n).astype(np.uint64)
            sets += [own, np.append(own[: n - n // 20], rng.integers(0, 1 << 63, n // 20 + 1).astype(np.uint64))]
    sets = sorted((np.unique(s) for s in sets), key=len)
    size = np.array([len(s) for s in sets])
    maps = [np.frombuffer(signature_join.sketch(s), np.uint64) for s in sets]
    for percent in (50, 85, 100):
        could = set()
        for j in range(len(sets)):
            for i in range(j):
                one, two = maps[i], np.bitwise_or.reduce(maps[j].reshape(-1, len(maps[i])), axis=0)
                hidden = min(int(n) - int(np.bitwise_count(x).sum()) for n, x in ((size[i], one), (size[j], two)))
                most = min(int(size[i]), int(np.bitwise_count(one & two).sum()) + hidden)
                if size[i] * 100 >= size[j] * percent and most * (100 + percent) >= int(size[i] + size[j]) * percent:
                    could.add((i, j))
        found = list(signature_join._paired(size, maps, percent))
        assert set(found) <= could

        def components(pairs):
            label = list(range(len(sets)))
            for a, b in pairs:
                old, new = label[b], label[a]
                label = [new if v == old else v for v in label]
            first = {}
            return [first.setdefault(v, i) for i, v in enumerate(label)]

        assert components(found) == components(could)


def test_shingles_of_rare_words_come_first():
    texts = pa.array(["the of and to in that was " * 30, "the of and to gribble that was his of the and in to the was that"])
    counts = np.zeros(1 << 16, np.int64)
    count_words(texts, counts)
    assert counts.sum() == 7 * 30 + 16
    weights = np.floor(np.log2(np.maximum(counts, 1)) * 8).astype(np.uint16)
    (_, _), (members, weight) = weighted_sets(texts, 4, weights)
    assert [m.tolist() for m, _ in weighted_sets(texts, 4, weights)] == [s.tolist() for s in shingle_sets(texts, 4)]
    order = signature_join.Order(np.empty(0, np.uint64), np.empty(0, np.uint64), weights)
    first = signature_join.prefix(members, weight, order, 85)
    assert len(first) == len(members) - -(-85 * len(members) // 100) + 1
    with_gribble = list(shingle_sets(pa.array(["of and to gribble that was his"]), 4))[0]
    assert set(first.tolist()) <= set(with_gribble.tolist())


def test_a_known_common_shingle_comes_last():
    members = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 40).astype(np.uint64))
    order = signature_join.Order(members[:30], np.arange(30, dtype=np.uint64)[::-1].copy(), np.zeros(4, np.uint16))
    first = signature_join.prefix(members, np.zeros(40, np.uint32), order, 50)
    assert set(first.tolist()) == {*members[30:].tolist(), *members[19:30].tolist()}


def test_texts_with_one_passage_in_common(spark):
    rng = np.random.default_rng(7)
    made = []
    for i in range(150):
        own = [f"w{x}" for x in rng.integers(0, 400, 12 + i % 9)]
        text = " ".join([*own[:4], "all rights reserved by the owner", *own[4:]])
        made += [text, text + " again"] if i % 5 == 0 else [text]
    docs = spark.createDataFrame(list(enumerate(made, 1)), "doc_id long, text string")
    rows = signature_join.similar_documents(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain_components(list(enumerate(made, 1)), 4, 85)
