"""Mixing, sharding, URL rules and vector search against plain Python."""

import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from levelmark.llm import block_naming, hilbert, mixing, rp_forest, signature_join, url_filter
from levelmark.llm.common import exploded, running_totals
from levelmark.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, target double"


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(9)
    rows = [(i, " ".join("w" * draw.randint(1, 9) for _ in range(draw.randint(0, 40)))) for i in range(400)]
    rows += [(1000 + i, "the same text in many copies") for i in range(150)] + [(2000, None), (2001, ""), (None, "no id"), (3000, "again"), (3000, "again")]
    sources = ["a", "b", "b", "b", "c", "é", None]
    return spark.createDataFrame([(i, t, draw.choice(["en", "de", None]), draw.choice(sources), 1, 2, 3, 4.0) for i, t in rows], DOCS).cache()


def test_running_totals(spark):
    draw = random.Random(1)
    rows = [(draw.choice("abc"), i, draw.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, w long")
    found = {r["i"]: r["before"] for r in running_totals(df, ["k", "i"], before="w").collect()}
    total, expected = 0, {}
    for _, i, w in sorted(rows):
        expected[i], total = total, total + w
    assert found == expected


def filled(sizes, weights):
    """Targets by filling up source after source."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mixture(spark, docs):
    rows = mixing.plan_mixture(docs).collect()
    assert len(rows) == docs.count()
    sizes = Counter()
    for r in docs.select("source", "text").collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    targets = filled(sizes, mixing.WEIGHTS)
    taken = Counter()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert len(r["draws"]) <= 2 and all(0 <= d["shard"] < 8 for d in r["draws"])
        taken[r["source"]] += r["size"] * len(r["draws"])
    assert all(abs(taken[s] - targets[s]) <= max(40, 0.02 * targets[s]) for s in sizes)
    again = mixing.plan_mixture(docs).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    drawn = mixing.mixture(docs)
    assert drawn.columns == docs.columns and drawn.count() == sum(len(r["draws"]) for r in rows)
    assert mixing.plan_mixture(docs.where("false")).count() == 0
    empty = docs.where("text is null or text = ''")
    assert {(r["size"], r["target"]) for r in mixing.plan_mixture(empty).collect()} == {(0, 0.0)}


def test_mixture_takes_repeats_one_by_one(spark):
    """A source of repeats, one that holds a third of them, and one of documents of their own."""
    rows = [(None, "five words in a row", "en", "a", i % 2, 2, 3, 4.0) for i in range(300)]
    rows += [(None, "three more words", "en", "b", 1, 2, 3, 4.0)] * 100
    rows += [(i, "w " * (i % 9), "en", "b", 1, 2, 3, 4.0) for i in range(200)] + [(i, "w " * 9, "en", "c", 1, 2, 3, 4.0) for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    plan = mixing.plan_mixture(docs, weights=(1, 3, 12)).collect()
    assert len(plan) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    targets, taken = filled(sizes, (1, 3, 12)), Counter()
    for r in plan:
        taken[r["source"]] += r["size"] * len(r["draws"])
    assert targets["a"] < sizes["a"] / 2 and all(abs(taken[s] - targets[s]) <= 9 for s in sizes)
    drawn = mixing.mixture(docs, weights=(1, 3, 12))
    words = Counter()
    for r in drawn.collect():
        words[r["source"]] += len(r["text"].split())
    assert words == taken and drawn.columns == docs.columns
    assert set(map(tuple, drawn.collect())) <= set(rows)
    every = mixing.mixture(docs, weights=(10**6, 1, 1)).where("source = 'a'").groupBy("n_chars").count().collect()
    assert {r["n_chars"]: r["count"] for r in every} == {0: 300, 1: 300}


def test_splitting_tree_keeps_sums(spark):
    quotas = {0: 1000, 1: 37, 2: 0, 3: 5}
    df = spark.createDataFrame(list(quotas.items()), "rank long, blocks long")
    ends = {r["rank"]: r["ends"] for r in mixing._shares(df, 3, 1).collect()}
    assert {k: v[-1] for k, v in ends.items()} == quotas
    shards = np.diff(np.array([[0, *ends[k]] for k in sorted(ends)]), axis=1)
    assert (shards >= 0).all() and shards.sum(axis=0).max() - shards.sum(axis=0).min() <= 3


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_every_cell_by_steps(dims, bits):
    cells = np.indices((1 << bits,) * dims).reshape(dims, -1)
    index = hilbert.hilbert_index(list(cells), bits)
    assert sorted(index) == list(range(1 << bits * dims))
    path = cells[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(axis=0) == 1).all()


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, docs, law):
    rows = hilbert.shard_layout(docs, law=law).collect()
    assert len(rows) == docs.count()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
    slots, sizes, groups = defaultdict(list), Counter(), defaultdict(set)
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, crc32(data), law, None)
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        groups[data].add(r["shard"])
    assert set(slots) <= set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    else:
        mean = sum(sizes.values()) / 8
        assert all(abs(s - mean) <= 0.1 * mean for s in sizes.values())
        big = b"the same text in many copies"
        assert all(len(s) == 1 for t, s in groups.items() if t != big)
    again = hilbert.shard_layout(docs, law=law).collect()
    assert Counter(map(str, again)) == Counter(map(str, rows))
    assert hilbert.shard_layout(docs.where("false")).count() == 0


def test_written_shards(spark, docs, tmp_path):
    hilbert.write_shards(docs, f"{tmp_path}/shards")
    stored = spark.read.parquet(f"{tmp_path}/shards")
    assert stored.count() == docs.count() and set(docs.columns) < set(stored.columns)


def plain_judge(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in rules:
        name, tail = url_filter.split_rule(rule)
        if (host == name or host.endswith("." + name)) and path.startswith(tail):
            best = max(best or (0,), (len(rule), len(name), name + tail, verdict))
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("bits", [64, 2])
def test_url_rules(spark, bits):
    """Also with digests so short that nearly all collide."""
    draw = random.Random(5)
    rules = URL_RULES + [("block", "a.b.example.org/"), ("allow", "b.example.org/en/12/x"), ("block", "é.de/ü")]
    hosts = ["org", "Example.ORG", "xexample.org", "a.b.example.org", "b.example.org", "shop.com", "com", "é.de", "", "o\x00rg"]
    paths = ["", "/", "/en/1", "/en/12/x?y=/es/", "/es/#top", "/fr/a//b", "/de", "/de/", "/ü?", "?q=://x.org/", "#/fr/"]
    made = [draw.choice(["http://", "https://", "://"]) + draw.choice(hosts) + draw.choice(paths) for _ in range(400)]
    made += [None, "", "no scheme", "http:/x.org/", "a://b://org/", "http://org", "x" * 20_000 + "://org/" + "y" * 20_000]
    rows = list(enumerate(made)) + [(None, "http://a.org/"), (1 << 60, "http://a.com/de/"), (3, made[3])]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in rows], "page_id long, url string, host string, rule string")
    found = url_filter.judge(pages, rules, bits=bits).collect()
    expected = Counter((i, *plain_judge(u, rules)) for i, u in rows)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in found) == expected
    assert url_filter.judge(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, [], "block").collect()} == {"block"}


def plain_search(vectors, k, every):
    ids = np.array(sorted(vectors))
    matrix = np.array([vectors[i] for i in ids], dtype=np.float64)
    out = {}
    for i in ids[ids % every == 0]:
        score = np.einsum("ij,j->i", matrix, matrix[ids == i][0])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
        out[int(i)] = [int(ids[j]) for j in order]
    return out


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_small_search_is_exact_with_ties_and_copies(spark):
    draw = np.random.default_rng(2)
    rows = {i: draw.integers(-2, 3, 6).astype(float).tolist() for i in range(300)}
    rows |= {1000 + i: [1.0, 2.0, 0.0, 0.0, 1.0, -1.0] for i in range(100)}
    bad = [(2000, None), (2020, []), (2040, [0.0] * 6), (2060, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2080, [float("nan")] * 6), (2100, [float("inf")] * 6), (2120, [1.0, 2.0]), (None, [1.0] * 6)]
    usable = {i: v for i, v in rows.items() if any(v)}
    frame = vectors_frame(spark, list(rows.items()) + bad + [(0, rows[0])])
    found = defaultdict(list)
    for r in rp_forest.search(frame, k=7).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
        assert r["rank"] == len(found[r["query_id"]])
    assert dict(found) == plain_search(usable, 7, 20)
    assert rp_forest.search(frame.where("false")).count() == 0
    alone = rp_forest.search(frame.where("vec_id = 20 or vec_id = 21")).collect()
    assert [(r["query_id"], r["vec_id"]) for r in alone] == [(20, 21)]


def test_search_recall_in_a_forest(spark):
    """Clustered vectors of different lengths in many leaves."""
    draw = np.random.default_rng(7)
    centres = draw.normal(size=(40, 16))
    rows = {i: (centres[i % 40] + 0.4 * draw.normal(size=16)).astype(np.float32).tolist() for i in range(6000)}
    truth = plain_search(rows, 10, 20)
    found = defaultdict(set)
    for r in rp_forest.search(vectors_frame(spark, list(rows.items())), k=10, leaf_rows=128).collect():
        found[r["query_id"]].add(r["vec_id"])
    assert set(found) == set(truth)
    assert sum(len(found[q] & set(t)) for q, t in truth.items()) >= 0.9 * sum(map(len, truth.values()))


def test_long_hosts_are_probed_by_the_rules_labels(spark):
    long_hosts = ["a." * 500_000 + "org", "x" * 1_000_000 + ".org", "." * 300_000 + "example.org", "y" * 1_000_000]
    urls = [f"https://{h}/es/{'p' * 100_000}" for h in long_hosts]
    pages = spark.createDataFrame([(i, u, 1, "r") for i, u in enumerate(urls)], "page_id long, url string, _url int, rule string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, URL_RULES, "none").collect()}
    assert found == {0: ("org/", "allow"), 1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: (None, "none")}
    index = url_filter._candidates
    made = list(index(long_hosts[0], "/es/p", url_filter._mapped(url_filter._publish(spark, url_filter.build_index(URL_RULES, 64)))))
    assert len(made) < 20 and max(map(len, made)) < 40


def test_long_ranges_are_cut(spark):
    df = spark.createDataFrame([(1, 5), (3, 3), (4, 3), (0, 2_000_000), (10, 47)], "a long, b long")
    rows = exploded(df, F.col("a"), F.col("b"), "i", block=1000)
    counts = {(r["a"], r["b"]): (r["n"], r["low"], r["high"], r["d"]) for r in rows.groupBy("a", "b").agg(
        F.count("*").alias("n"), F.min("i").alias("low"), F.max("i").alias("high"), F.count_distinct("i").alias("d")).collect()}
    assert counts == {(a, b): (b - a + 1, a, b, b - a + 1) for a, b in [(1, 5), (3, 3), (0, 2_000_000), (10, 47)]}
    sizes = rows.where("a = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 1_500_000


def test_a_row_of_very_many_repeats_is_drawn_in_many_tasks(spark):
    many = spark.range(200_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same words").alias("text"), F.lit("a").alias("source"))
    plan = mixing.plan_mixture(many)
    assert plan.count() == 200_000 and plan.select("copy").distinct().count() == 200_000
    taken = plan.select(F.sum(F.col("size") * F.size("draws")).alias("n"), F.first("target").alias("target")).first()
    assert abs(taken["n"] - taken["target"]) <= 4


TWENTY = [f"https://shared.example.org/a/very/long/stretch/{x}" for x in "abcdefghijklmnopqrst"]


def test_texts_that_share_a_stretch_are_told_apart(spark):
    rows = [(i, f"text {i}", TWENTY[i % 20] if i % 21 else None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {r["doc_id"]: r["source"] or "" for r in docs.collect()}
    for dims in (("source",), ("size",), ("source", "size")):
        layout = hilbert.shard_layout(docs, dims=dims).collect()
        assert len(layout) == 2000 and len({r["shard"] for r in layout}) == 8
        per_shard = defaultdict(set)
        for r in layout:
            per_shard[r["shard"]].add(source[r["doc_id"]])
        if dims == ("source",):  # runs of neighbouring sources: 21 of them over 8 shards
            assert max(map(len, per_shard.values())) <= 4
            ends = [(min(per_shard[s]), max(per_shard[s])) for s in range(8)]
            assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_clashing_columns(spark, tmp_path):
    names = ["_row_key1", "_row_key2", "_draw", "_shard", "_c0", "_at", "copy", "draws", "spare"]
    rows = [(i, f"text of {i % 30}", "s", *([i] * len(names))) for i in range(60)] + [(None, None, None, *([7] * len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names))
    given = {r["doc_id"]: tuple(r) for r in docs.collect()}
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns and all(given[r["doc_id"]] == tuple(r) for r in mixed.collect())
    kept = block_naming.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, *range(30, 60)]
    near = signature_join.keep_one_of_each(docs)
    assert near.columns == docs.columns and near.count() == 31
    hilbert.write_shards(docs.withColumn("lang", F.lit("en")), f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 61 and set(out.columns) == {*docs.columns, "lang", "__shard"}
