"""The fitted scorers and the randomness tests against plain loops and NumPy."""

import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from levelmark.llm import quality, secret_scan, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels, docs.toPandas(), labels.toPandas()


def learnt(doc_id, folds, held):
    return crc32(str(doc_id).encode()) % folds != held


# Quality


def angle(part, whole):
    return math.asin(math.sqrt(min(1.0, part / whole))) if whole else 0.0


def plain_statistics(text):
    words = text.split()
    if not words:
        return [0.0] * 15
    size = len(text.encode())
    count = lambda chars: sum(text.count(c) for c in chars)
    lines = [x for x in text.split("\n") if x]
    n = len(words)
    return [
        math.log(1 + n),
        math.log(len(text) / n),
        angle(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size),
        angle(count("0123456789"), size),
        angle(count("#$%&*@^~=+<>|\\/_{}[]"), size),
        angle(count(".,;:"), n),
        angle(count("!"), n),
        angle(count("|"), n),
        angle(size - len(text), size),
        angle(sum(words[i] == words[i + 1] for i in range(n - 1)), n),
        angle(len(set(words)), n),
        math.log(1 + n / len(lines)),
        angle(len(lines) - len(set(lines)), len(lines)),
        angle(sum(" " not in x for x in lines), len(lines)),
        angle(sum(w[-1] in "#$%&*@^~=+<>|\\/_!" for w in words), n),
    ]


def test_quality_against_a_plain_discriminant(spark, tables):
    docs, labels, rows, marks = tables
    x = np.array([plain_statistics(t or "") for t in rows["text"]])
    label = dict(zip(marks["doc_id"], marks["quality"], strict=True))
    use = [i in label and label[i] in (0, 1) and learnt(i, 3, 1) for i in rows["doc_id"]]
    y = np.array([label.get(i, -1) for i in rows["doc_id"]])
    parts = [x[np.array(use) & (y == k)] for k in (0, 1)]
    covariances = [np.cov(p.T, bias=True) for p in parts]
    pooled = np.diag((np.diag(covariances[0]) + np.diag(covariances[1])) / 2)
    logs = []
    for part, covariance in zip(parts, covariances, strict=True):
        c = 0.9 * covariance + 0.1 * pooled + 1e-4 * np.eye(15)
        away = x - part.mean(axis=0)
        inverse = np.linalg.inv(c)
        logs.append(np.log(len(part)) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.array([a @ inverse @ a for a in away]))
    odds = logs[1] - logs[0]
    expected = dict(zip(rows["doc_id"], 1 / (1 + np.exp(-np.clip(odds / 15, -700, 700))), strict=True))
    found = quality.score_quality(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert abs(r["score"] - expected[r["doc_id"]]) < 1e-7 and r["predicted"] == (expected[r["doc_id"]] >= 0.5)


# Toxicity


def plain_weights(docs, counted):
    """Log-odds of what `counted` finds in a document, by the operator's thresholds."""
    seen = {1: Counter(), 0: Counter()}
    for text, label in docs:
        seen[label].update(counted(text))
    n = Counter(label for _, label in docs)
    out = {}
    for entry, t in seen[1].items():
        weight = math.log((t + 0.5) / (n[1] + 1)) - math.log((seen[0][entry] + 0.5) / (n[0] + 1))
        if t >= max(toxicity.LEAST_DOCS, toxicity.LEAST_SHARE * n[1]) and weight >= toxicity.LEAST_WEIGHT:
            out[entry] = weight
    return out


def plain_features(text, words, beginnings):
    tokens = text.split()
    if not tokens:
        return [0.0] * 15
    n, weights, hits, starts, addresses, hidden = len(tokens), [], [], [], [], 0
    obfuscated = 0
    for i, token in enumerate(tokens):
        spelt, odd = toxicity.spellings(token)
        weight = max([words.get(w, 0.0) for w in spelt], default=0.0)
        start = max([beginnings.get(w[:4], 0.0) for w in spelt if len(w) > 4], default=0.0)
        obfuscated += odd
        hits += [i] * (weight > 0)
        starts += [i] * (start > 0)
        if weight > 0 or start > 0:
            hidden += odd
        weights.append(min(int(max(weight, start) * 16), 4095) / 16)
        addresses += [i] * any(w in toxicity.SECOND_PERSON for w in spelt)
    either = sorted({*hits, *starts})
    gaps = [min(abs(i - j) for j in addresses) for i in either] if addresses else []
    capitals = sum(len(t) > 1 and bool(re.search(r"[^\W\d_]", t)) and t.isupper() for t in tokens)
    return [
        math.log(1 + n), len(hits) / n, math.log(1 + len(hits)), sum(weights[i] for i in either) / n, max(weights), len(starts) / n,
        math.log(1 + len(starts)), sum(g <= 5 for g in gaps) / n, 1 / (1 + min(gaps)) if gaps else 0.0, len(addresses) / n, capitals / n,
        sum(t.endswith("!") for t in tokens) / n, obfuscated / n, hidden, sum(text.count(c) for c in "!?.,;:*#%&$@|") / n,
    ]


def tree_value(lines, x):
    """A printed tree's prediction."""
    depth = lambda line: len(line) - len(line.lstrip())
    at = 0
    while True:
        line = lines[at].strip()
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, sign, border = re.match(r"If \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line).groups()
        if (x[int(feature)] <= float(border)) == (sign == "<="):
            at += 1
        else:
            at = next(i for i in range(at + 1, len(lines)) if depth(lines[i]) == depth(lines[at])) + 1


def test_toxicity_against_plain_trees(spark):
    # of the smallest tables too few documents are toxic
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.Model(docs, labels)
    rows = docs.toPandas()
    toxic = {i: t for i, t in labels.toPandas()[["doc_id", "toxic"]].itertuples(index=False) if t in (0, 1) and learnt(i, 5, 0)}
    sample = {}
    for i, text in zip(rows["doc_id"], rows["text"], strict=True):
        if i in toxic:
            sample[text or ""] = max(toxic[i], sample.get(text or "", 0))
    sample = list(sample.items())
    words = plain_weights(sample, toxicity.plain_words)
    beginnings = plain_weights(sample, lambda t: {w[:4] for w in toxicity.plain_words(t) if len(w) > 4})
    for ours, plain in ((model.lexicons[None].words, words), (model.lexicons[None].beginnings, beginnings)):
        assert ours.keys() == plain.keys() and all(abs(ours[w] - plain[w]) < 1e-9 for w in plain) and plain

    trees = [[x for x in t.toDebugString.split("\n")[1:] if x] for t in model.trees.trees]
    borders, values = model.levels
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(found) == len(rows)
    for i, text in zip(rows["doc_id"], rows["text"], strict=True):
        x = plain_features(text or "", words, beginnings)
        margin = sum(w * tree_value(t, x) for w, t in zip(model.trees.treeWeights, trees, strict=True))
        p = 1 / (1 + math.exp(-2 * margin))
        score = (1 - toxicity.ORDER_PART) * float(np.interp(p, borders, values)) + toxicity.ORDER_PART * p
        assert abs(found[i]["score"] - score) < 1e-6 and found[i]["predicted"] == (found[i]["score"] >= 0.5)


# Randomness


def tail(z):
    return 1 / (1 + math.exp(min(700.0, 1.5976 * z + 0.07056 * z**3)))


def plain_p(run):
    letters = next(s for pattern, s in secret_scan.ENCODINGS.values() if re.search(pattern, run))
    code = run.rstrip("=")
    padding = len(run) - len(code)
    if "_" not in letters:
        code = re.sub("[_-]", "", code)
    if len(code) + padding < 20:
        return None
    n, k = len(code), len(letters)
    counts = Counter(code)
    chi, df = max(0.0, sum((counts[c] - n / k) ** 2 for c in letters) / (n / k)), k - 1
    uniform = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    halves = [letters.index(c) >= k // 2 for c in code]
    ones = sum(halves)
    runs = 1 + sum(a != b for a, b in zip(halves, halves[1:], strict=False))
    mean = 2 * ones * (n - ones) / n + 1
    of_runs = (runs - mean) / math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    places = [letters.index(c) + 1 for c in code]
    middle = sum(places) / n
    off = [x - middle for x in places]
    serial = (sum(a * b for a, b in zip(off, off[1:], strict=False)) / max(sum(x * x for x in off), 1e-9) + 1 / n) * math.sqrt(n)
    return min(1.0, 3 * min(tail(uniform), 2 * tail(abs(of_runs)), 2 * tail(abs(serial))))


def candidates(seed, n=400):
    draw = random.Random(seed)
    alphabets = [s for _, s in secret_scan.ENCODINGS.values()]
    out = []
    for _ in range(n):
        letters = draw.choice(alphabets)
        skewed = draw.random() < 0.4
        pool = draw.sample(letters, 6) if skewed else letters
        run = "".join(draw.choices(pool, k=draw.randint(20, 90))) + "=" * draw.choice([0, 0, 0, 1, 2])
        out.append(run if re.search("[0-9]", run) and re.search("[A-Za-z]", run) else f"a1{run}")
    return out


def test_p_values_against_plain_sums(spark):
    runs = [r for r in candidates(1) if any(re.search(p, r) for p, _ in secret_scan.ENCODINGS.values())]
    found = secret_scan.with_p_values(spark.createDataFrame([(r,) for r in runs], "run string")).collect()
    assert len(found) == len(runs) > 300
    for r in found:
        expected = plain_p(r["run"])
        assert (r["p"] is None) == (expected is None) and (expected is None or abs(r["p"] - expected) < 1e-9), r["run"]


def test_the_cut_is_that_of_benjamini_and_hochberg(spark):
    runs = candidates(2, 600)
    df = secret_scan.with_p_values(spark.createDataFrame([(r,) for r in runs], "run string"))
    by_class = defaultdict(list)
    for r in df.where("p is not null").collect():
        step = min(math.floor(-math.log10(max(r["p"], 1e-300)) / secret_scan.STEP), round(300 / secret_scan.STEP))
        by_class[int(math.log2(len(r["run"])))].append(step)
    expected = {}
    for of_length, steps in by_class.items():
        # a step's p is its largest, so rows of one step stand or fall together
        ranked = sorted(steps, reverse=True)
        met = [s for s in ranked if 10 ** (-s * secret_scan.STEP) * len(ranked) <= 0.05 * sum(x >= s for x in ranked)]
        if met:
            expected[of_length] = min(met)
    assert secret_scan.rejections(df) == expected and expected
