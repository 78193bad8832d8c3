"""Toxicity by gradient-boosted trees over dense features, calibrated isotonically.

A lexicon of words, and one of word beginnings, is learnt from how many labelled
toxic and clean documents hold them. A document's features are densities and
weights of lexicon words, their distance from words that address the reader,
capitals, punctuation and the rate of obfuscated words (which are matched in
plain spelling too). Spark's boosted trees are fitted on these, and isotonic
regression on a part of the rows that the trees have not seen.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levelmark.llm.common import give_back, id_remainder, schema_with, slices
from levelmark.llm.quality import one_label
from levelmark.operators.joins import lookup_join
from levelmark.sources.shared import written

FOLDS, HELD_OUT = 5, 0
#: Labelled documents that the trees are fitted on, at most: half of them of each class, by
#: hash of the id. The lexicons are counted over all labelled documents.
SAMPLE = 20_000
#: Every so many of them go to the calibration instead of the trees.
CALIBRATE = 4
TREES, DEPTH, SEED = 20, 3, 5
#: Entries of a lexicon, at most; those with the largest weights.
LEXICON = 5_000
#: A word of the lexicon is in so many toxic documents (a number, and a part of them) ...
LEAST_DOCS, LEAST_SHARE = 2, 0.004
#: ... and its log-odds of toxicity are at least this.
LEAST_WEIGHT = 2.0
#: Characters of a word beginning.
BEGINNING = 4
#: Words at most so far from an address count as near.
NEAR = 5
#: Calibrated scores keep the trees' order inside a step by this part of theirs.
ORDER_PART = 0.01
#: Words remembered by a worker before it starts anew.
MAX_WORDS = 100_000

# Words that address the reader, in the four languages of the tables.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen euch euer ihr tu te toi ton ta tes vous votre vos ti tú usted ustedes vosotros".split()
)
LEET = str.maketrans("013457@$!", "oieastasi")
EDGES = ".,;:!?\"'()[]{}<>|*#%&$~_-+=/\\"
INNER = re.compile(r"[^\w]+")
WORD = re.compile(r"[^\W\d_]+")

# What a word is, as bits of its code; the weight follows in steps of 1/16.
IS_LEXICON, IS_BEGINNING, IS_ADDRESS, IS_CAPITALS, IS_OBFUSCATED, IS_SHOUTED, WEIGHT_BITS = 1, 2, 4, 8, 16, 32, 6
NAMES = (
    "words", "lexicon", "lexicon_count", "weight", "heaviest", "beginnings", "beginning_count", "near_address",
    "distance", "address", "capitals", "shouts", "obfuscated", "hidden_lexicon", "punctuation",
)
PUNCTUATION = b"!?.,;:*#%&$@|"


def plain_words(text: str) -> set[str]:
    """Distinct lower-case words of a text, obfuscated ones in plain spelling."""
    words = set()
    for token in set(text.split()):
        words.update(spellings(token)[0])
    return words


def spellings(token: str) -> tuple[list[str], bool]:
    """A token's words in lower case; whether one was put into plain spelling
    (look-alike characters for letters, or marks between the letters)."""
    core = token.strip(EDGES).lower()
    if core.isalpha():
        return [core], False
    parts = WORD.findall(core)
    if not parts:
        return [], False
    plain = INNER.sub("", core.translate(LEET))
    if plain.isalpha() and len(plain) >= 3 and len(max(parts, key=len)) < len(plain) <= 20 and "@" not in core[1:-1].replace("@", "", 1):
        return [*parts, plain], True
    return parts, False


@dataclass
class Lexicon:
    """Weights of words and of word beginnings."""

    words: dict[str, float]
    beginnings: dict[str, float]
    codes: dict[str, int] = field(default_factory=dict)

    def code(self, token: str) -> int:
        found = self.codes.get(token)
        if found is None:
            if len(self.codes) >= MAX_WORDS:
                self.codes.clear()
            found = self.codes[token] = self._code(token)
        return found

    def _code(self, token: str) -> int:
        words, obfuscated = spellings(token)
        weight = max((self.words.get(w, 0.0) for w in words), default=0.0)
        start = max((self.beginnings.get(w[:BEGINNING], 0.0) for w in words if len(w) > BEGINNING), default=0.0)
        letters = WORD.findall(token)
        bits = IS_LEXICON * (weight > 0) | IS_BEGINNING * (start > 0)
        bits |= IS_ADDRESS * any(w in SECOND_PERSON for w in words)
        bits |= IS_CAPITALS * (len(token) > 1 and bool(letters) and token.isupper())
        bits |= IS_OBFUSCATED * obfuscated | IS_SHOUTED * token.endswith("!")
        return bits | min(int(max(weight, start) * 16), 4095) << WEIGHT_BITS

    def features(self, text: str) -> list[float]:
        """NAMES of one whole text; all zero for one without words."""
        tokens = text.split()
        n = len(tokens)
        if not n:
            return [0.0] * len(NAMES)
        codes = np.fromiter(map(self.code, tokens), np.int64, n)
        has = lambda bit: (codes & bit) > 0
        hit, start, address = has(IS_LEXICON), has(IS_BEGINNING), has(IS_ADDRESS)
        either = hit | start
        weights = (codes >> WEIGHT_BITS) / 16
        gaps = np.empty(0)
        at, to = np.flatnonzero(either), np.flatnonzero(address)
        if len(at) and len(to):
            after = np.searchsorted(to, at)
            gaps = np.minimum(np.abs(at - to[np.maximum(after - 1, 0)]), np.abs(to[np.minimum(after, len(to) - 1)] - at))
        data = text.encode(errors="replace")
        return [
            float(np.log1p(n)),
            hit.mean(),
            float(np.log1p(hit.sum())),
            float(weights[either].sum() / n),
            float(weights.max()),
            start.mean(),
            float(np.log1p(start.sum())),
            float((gaps <= NEAR).sum() / n),
            1 / (1 + float(gaps.min())) if len(gaps) else 0.0,
            address.mean(),
            has(IS_CAPITALS).mean(),
            has(IS_SHOUTED).mean(),
            has(IS_OBFUSCATED).mean(),
            float((has(IS_OBFUSCATED) & either).sum()),
            (len(data) - len(data.translate(None, PUNCTUATION))) / n,
        ]


def _weights(counts: list, toxic: int, clean: int, own: int | None = None) -> dict[str, float]:
    """Log-odds of the entries that pass the thresholds. `own` leaves one
    document of that class out of every count, which is how a document's own
    words must be seen while fitting."""
    toxic_docs, clean_docs = toxic - (own == 1), clean - (own == 0)
    least = max(LEAST_DOCS, LEAST_SHARE * toxic_docs)
    out = {}
    for entry, t, c in counts:
        t, c = t - (own == 1), c - (own == 0 and c > 0)
        weight = np.log((t + 0.5) / (toxic_docs + 1)) - np.log((c + 0.5) / (clean_docs + 1))
        if t >= least and weight >= LEAST_WEIGHT:
            out[entry] = float(weight)
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, entry, toxic, clean): documents of a task that hold a word or beginning."""
    seen = {("word", 1): Counter(), ("word", 0): Counter(), ("start", 1): Counter(), ("start", 0): Counter()}

    def flush():
        rows = [(k, e, n * label, n * (1 - label)) for (k, label), c in seen.items() for e, n in c.items()]
        for c in seen.values():
            c.clear()
        if rows:
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["kind", "entry", "toxic", "clean"])

    for rows, texts in slices(batches, "_text"):
        for text, label in zip(texts, rows.column("label").to_pylist(), strict=True):
            words = plain_words(text)
            seen["word", label].update(words)
            seen["start", label].update({w[:BEGINNING] for w in words if len(w) > BEGINNING})
        if sum(map(len, seen.values())) > MAX_WORDS:
            yield from flush()
    yield from flush()
    give_back()


def learn_lexicons(labelled: DataFrame) -> dict[int | None, Lexicon]:
    """Lexicons of all labelled documents (label, _text): the whole one under None,
    and under 1 and 0 as a toxic or clean one of them sees it."""
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    words = labelled.select("label", "_text").mapInArrow(_count_words, "kind string, entry string, toxic long, clean long")
    words = words.groupBy("kind", "entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # Only what could pass the thresholds comes back, the commonest first, for each kind twice a lexicon at most.
    odds = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.greatest(F.col("clean") - 1, F.lit(0)) + 0.5) / (clean + 1))
    words = words.where((F.col("toxic") >= max(LEAST_DOCS, LEAST_SHARE * (toxic - 1))) & (odds >= float(np.exp(LEAST_WEIGHT - 0.5))))
    words = written(words, "words")  # asked for each kind
    rows = {k: words.where(F.col("kind") == k).orderBy(F.desc("toxic"), "entry").limit(2 * LEXICON).collect() for k in ("word", "start")}
    entries = {k: [(r["entry"], r["toxic"], r["clean"]) for r in v] for k, v in rows.items()}
    return {own: Lexicon(*(_weights(entries[k], toxic, clean, own) for k in ("word", "start"))) for own in (None, 1, 0)}


def _with_features(docs: DataFrame, lexicons: dict[int | None, Lexicon], by_label: bool, text: str = "_text", keep: bool = False) -> DataFrame:
    """Adds `x`, the features of the text column, which goes unless `keep`."""
    sent = docs.sparkSession.sparkContext.broadcast(lexicons)  # at most 6 x LEXICON entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for rows, texts in slices(batches, text):
            labels = rows.column("label").to_pylist() if by_label else [None] * len(texts)
            x = pa.array([known[y].features(t) for t, y in zip(texts, labels, strict=True)], pa.list_(pa.float64()))
            kept = [n for n in rows.schema.names if keep or n != text]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), x], [*kept, "x"])
        for lexicon in known.values():  # the worker goes on to other tasks
            lexicon.codes.clear()
        give_back()

    return docs.mapInArrow(run, schema_with(docs if keep else docs.drop(text), "x array<double>"))


class Model:
    """Lexicons, trees and calibration; without rows of both classes, one score."""

    def __init__(self, docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT):
        chosen = written(one_label(labels, label).where(id_remainder("doc_id", folds) != held_out), "labels")
        text = F.coalesce("text", F.lit("")).alias("_text")
        rows = lookup_join(docs.select("doc_id", text), chosen, ["doc_id"], "inner", ["doc_id"])
        # Copies of a text would make its words look common; one of each is learnt from, the
        # same in every run: the larger label, and the smallest id, which decides its use.
        one = rows.groupBy("_text").agg(F.max("label").alias("label"), F.min("doc_id").alias("doc_id"))
        self.labelled = written(one.select("label", "_text", "doc_id"), "labelled")
        ids = self.labelled.select("label", "doc_id")  # drawn before their texts are fetched
        drawn = [ids.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(SAMPLE // 2) for k in (0, 1)]
        # At most SAMPLE ids of 12 bytes.
        of_sample = F.broadcast(written(drawn[0].unionByName(drawn[1]).distinct(), "drawn"))
        self.sample = written(self.labelled.join(of_sample, ["label", "doc_id"], "left_semi"), "sample")
        shares = {r["label"]: r["count"] for r in self.sample.groupBy("label").count().collect()}
        self.score = None if len(shares) == 2 else float(next(iter(shares), 0))
        if self.score is None:
            self._fit()

    def _fit(self) -> None:
        self.lexicons = learn_lexicons(self.labelled)
        rows = _with_features(self.sample, self.lexicons, True).withColumn("weight", F.lit(1.0))
        # Places and order by id, so that the trees see the rows alike in every run.
        rows = rows.repartition(4, "doc_id").sortWithinPartitions("doc_id", "label", "x")
        rows = written(rows, "training").withColumn("features", array_to_vector("x"))
        aside = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(CALIBRATE)) == 0
        seen = rows.where(~aside)
        if seen.select("label").distinct().count() < 2:
            seen = rows
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED)
        self.trees = trees.fit(seen.coalesce(2))
        rated = self._rated(rows.where(aside))
        fitted = rated.select(F.col("label").cast("double").alias("label"), F.col("p").alias("features"))
        # Two sure points keep the ends of the scale where the part set aside is small or empty.
        ends = rows.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "label double, features double")
        steps = IsotonicRegression(featuresCol="features", labelCol="label").fit(fitted.unionByName(ends).coalesce(1))
        self.levels = steps.boundaries.toArray(), steps.predictions.toArray()

    def _rated(self, rows: DataFrame) -> DataFrame:
        return self.trees.transform(rows).withColumn("p", vector_to_array("probability")[1])

    def scored(self, docs: DataFrame, text: str = "_text", keep: bool = False) -> DataFrame:
        """Adds `score` and `predicted`; the text column goes unless `keep`."""
        columns = [c for c in docs.columns if keep or c != text]
        if self.score is not None:
            rows = docs.select(*columns, F.lit(self.score).alias("score"))
        else:
            rows = _with_features(docs, self.lexicons, False, text, keep).withColumn("features", array_to_vector("x"))
            rows = self._rated(rows).select(*columns, self._calibrated(F.col("p")).alias("score"))
        return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

    def _calibrated(self, p):
        """The isotonic steps as one expression, linear between their borders."""
        borders, values = self.levels
        out = F.lit(float(values[-1]))
        for (a, b), (u, v) in reversed(list(zip(zip(borders, borders[1:]), zip(values, values[1:]), strict=True))):  # noqa: B905
            line = F.lit(float(u)) + (p - float(a)) * float((v - u) / (b - a)) if b > a else F.lit(float(v))
            out = F.when(p <= float(b), line).otherwise(out)
        return (1 - ORDER_PART) * out + ORDER_PART * p


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Learns from the labelled rows whose crc32(doc_id) modulo 5 is not 0: words
    from all of them, trees from a sample (SAMPLE by hash of the id, half of each
    class); scores all. Null and empty texts have
    all-zero features. Without labelled rows of both classes every score is the
    one class there is, or 0. Of several labels of an id the larger counts; only
    doc_id and text are read; repeated rows are scored one by one. The same rows
    give the same scores, whatever their partitions.
    """
    model = Model(docs, labels)
    held = (id_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return model.scored(docs.select("doc_id", held, F.coalesce("text", F.lit("")).alias("_text")))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the documents judged toxic; all its columns."""
    model = Model(docs, labels)
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # clear of the columns added on the way
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    kept = model.scored(rows, named["text"], keep=True).where("predicted = 0")
    return kept.select(*(F.col(n).alias(c) for c, n in named.items()))
