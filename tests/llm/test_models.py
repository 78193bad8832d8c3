"""Held-out accuracy of the fitted scorers, their odd cases, and the pipeline."""

import hashlib
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from test_tables import filled
from test_texts import plain_components
from tokenizers import Tokenizer

import corpus_pipeline
from levelmark.llm import mixing, quality, toxicity
from levelmark.llm.queries import ORACLES, QUERIES, VOCABULARY
from levelmark.sources.shared import written

LARGER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, score double, p double, _text string"


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    values, inverse, counts = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    ones = labels == 1
    assert len(order) == len(labels)
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize("score, label, folds, held", [(quality.score_quality, "quality", 3, 1), (toxicity.score_toxicity, "toxic", 5, 0)])
def test_held_out_scores(spark, score, label, folds, held):
    docs, labels = (spark.read.parquet(f"{LARGER}/{n}.parquet") for n in ("documents", "labels"))
    rows = score(docs, labels).toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    assert (rows["held_out"] == [crc32(str(i).encode()) % folds == held for i in rows["doc_id"]]).all()
    seen = rows.merge(labels.toPandas(), on="doc_id")
    seen = seen[seen["held_out"]]
    assert auc(seen[label].to_numpy(), seen["score"].to_numpy()) > 0.95
    clean = seen[seen[label] == (1 if label == "quality" else 0)]
    assert (clean["predicted"] == clean[label]).mean() > 0.97


def odd_documents(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (3, " \n"), (None, "you idi0t, you s.t.u.p.i.d moron!!"), (4, "fine words here " * 20_000), (5, "x" * 100_000)]
    return spark.createDataFrame([(i, t, "en", "s", 9.0, 8.0, "z") for i, t in rows], DOCS)


@pytest.mark.parametrize("score, label", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_scores_without_two_classes(spark, score, label):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(None, 1), (2, None), (3, 7)], f"doc_id long, {label} int")
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count() and len({r["score"] for r in rows}) == 1
    one = spark.createDataFrame([(i, 1) for i in range(1, 6)], f"doc_id long, {label} int")
    assert {r["predicted"] for r in score(docs, one).collect()} == {1}
    assert score(docs.where("false"), one).count() == 0


def test_odd_documents_are_scored_by_models(spark):
    words = ["good", "plain", "fair", "even"]
    rows = [(100 + i, " ".join(words[(i * j) % 4] for j in range(1, 30)) + (" moron clown!" if i % 3 == 0 else ".")) for i in range(120)]
    docs = odd_documents(spark)
    docs = docs.union(spark.createDataFrame([(i, t, "en", "s", 9.0, 8.0, "z") for i, t in rows], DOCS))
    labels = spark.createDataFrame([(i, i % 2, int("moron" in t)) for i, t in rows], "doc_id long, quality int, toxic int")
    for found in (quality.score_quality(docs, labels), toxicity.score_toxicity(docs, labels)):
        scores = [r["score"] for r in found.collect()]
        assert len(scores) == 127 and all(0 <= s <= 1 for s in scores)
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {9.0}
    left = {r["doc_id"] for r in kept.collect()}
    assert not left & {i for i, t in rows if "moron" in t} and {i for i, t in rows if "moron" not in t} <= left


def test_toxicity_does_not_depend_on_partitions(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{name}.parquet") for name in ("documents", "labels"))
    first = toxicity.score_toxicity(docs, labels).select("doc_id", "score")
    second = toxicity.score_toxicity(docs.repartition(7, "n_chars"), labels.repartition(3)).select("doc_id", "score")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def test_obfuscated_words_are_read():
    assert toxicity.spellings("s.t.u.p.i.d!!") == (["s", "t", "u", "p", "i", "d", "stupid"], True)
    assert toxicity.spellings("idi0t") == (["idi", "t", "idiot"], True)
    assert toxicity.spellings("***") == ([], False) and toxicity.spellings("plain,") == (["plain"], False)


def test_queries_are_registered():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_pipeline_stages(spark, folder):
    """Each stage against what plain Python makes of its input."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages, kept = dict(corpus_pipeline.STAGES), {}
    for name, stage in stages.items():
        kept[name] = rows = docs.collect()
        docs = stage(spark, docs, folder)
        if name != "BPE encoding and decoding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = written(docs, "stage")
        assert docs.count() > 0 and rows
    order = list(stages)
    after = {name: kept[order[i + 1]] for i, name in enumerate(order[:-1])}
    lower = {i: chr(i + 32) for i in range(65, 91)}
    last = {}
    for r in kept["exact dedup"]:
        key = (r["text"] or "").translate(lower)
        last[key] = max(last.get(key, -1), r["doc_id"])
    assert {r["doc_id"] for r in after["exact dedup"]} == set(last.values())
    judged = toxicity.score_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()
    clean = Counter(r["doc_id"] for r in judged if not r["predicted"])
    assert Counter(r["doc_id"] for r in after["toxicity"]) == clean and clean.total() < len(judged)
    linked = plain_components([(r["doc_id"], r["text"]) for r in kept["n-gram Jaccard join"]], 5, 80)
    assert Counter(r["doc_id"] for r in after["n-gram Jaccard join"]) == Counter({root: 1 for _, root in linked.values()})
    sizes, taken, longest = Counter(), Counter(), 0
    for rows, words in ((kept["mixing sources to target weights"], sizes), (after["mixing sources to target weights"], taken)):
        for r in rows:
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
            words[r["source"]], longest = words[r["source"]] + n, max(longest, n)
    targets = filled(sizes, mixing.WEIGHTS)
    assert all(abs(taken[s] - targets[s]) <= longest for s in sizes)
    mixed = Counter(r["doc_id"] for r in after["mixing sources to target weights"])
    assert max(mixed.values()) <= 2 and set(mixed) <= {r["doc_id"] for r in kept["mixing sources to target weights"]}
    library = Tokenizer.from_file(VOCABULARY)
    expected = Counter()
    for r in kept["BPE encoding and decoding"]:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        expected[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in docs.collect()) == expected
    assert Counter(r["ids_sha256"] for r in corpus_pipeline.run(spark, folder).collect()) == Counter(k[2] for k in expected.elements())
