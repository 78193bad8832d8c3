"""Secrets in texts: known forms, and runs that pass a battery of randomness tests.

Known forms (`assign`, `access`, `hex`) are found by pattern. Other long runs of
code characters that mix letters and digits are candidates. `=` belongs to a run
only as padding at its end; `+`, `/`, `_` and `-` may be symbols of an encoding or
stand between a path, a name and a value, so a text is read with each of READINGS
as symbols and the others as ends of a run. The encoding of a candidate is
inferred from the characters it uses (the smallest alphabet that holds them; `_`
and `-` in a run of one case are separators), and three tests ask whether they look
drawn at random from its alphabet: chi-squared uniformity of the symbols, the
number of runs above and below the middle of the alphabet, and the serial
correlation of neighbours. The smallest of the three p-values, times three, is
the candidate's. Randomness is rejected by Benjamini-Hochberg within classes of
length, so that many short runs do not set the threshold of long ones; what is
not rejected is reported as `random`, overlapping readings as one span.

DataFrame functions only. Positions come from running sums over the pieces of a
text between matches and the matches, so long texts cost no more per character.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from levelmark.llm.common import text_or_empty
from levelmark.sources.shared import written

# The base patterns and least lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN_LEAST = 12
# A shorter run of these two can hold no longer one, so the least length is in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: Characters that count as symbols beside letters and digits, per reading.
READINGS = ("+/", "_-", "+", "")
#: Least length of a candidate, with its padding.
CANDIDATE_LEAST = 20
PADDING = r"={1,6}(?![A-Za-z0-9+/_=-])"


def _candidate(others: str) -> str:
    """Whole runs of at least 20 code characters, padding included, with a letter and a digit."""
    code = f"A-Za-z0-9{others}"
    run = f"(?:[{code}]{{20,}}(?:{PADDING})?|[{code}]{{14,19}}{PADDING})"
    return f"(?<![{code}])(?=[A-Za-z{others}]*[0-9])(?=[0-9{others}]*[A-Za-z]){run}"


#: Encodings by the characters used, first fit first, base64 for all that is left.
#: A run of one case has no symbols '-' and '_': there they separate, and are taken out.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = {
    "hex": ("^[0-9A-F_-]+=*$", DIGITS + "ABCDEF"),
    "hex_lower": ("^[0-9a-f_-]+=*$", DIGITS + "abcdef"),
    "base32": ("^[A-Z2-7_-]+=*$", UPPER + "234567"),
    "base32_lower": ("^[a-z2-7_-]+=*$", LOWER + "234567"),
    "base36_upper": ("^[A-Z0-9_-]+=*$", DIGITS + UPPER),
    "base36": ("^[a-z0-9_-]+=*$", DIGITS + LOWER),
    "base62": ("^[A-Za-z0-9]+=*$", UPPER + LOWER + DIGITS),
    "base64url": ("^[A-Za-z0-9_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    "base64": ("^[A-Za-z0-9+/]+=*$", UPPER + LOWER + DIGITS + "+/"),
}
#: Part of the random candidates that may be rejected, on average.
FALSE_REJECTIONS = 0.05
#: Steps of log10(p) that p-values are counted in.
STEP = 0.05


def _matches(kind: str, pattern: str, present: Column, reading: int = 0) -> Column:
    """The matches of a kind in `_text`: reading, number, characters since the last
    match, characters of the match, whether it is long enough, the run of a candidate."""
    text, whole = F.col("_text"), F.lit(pattern)
    found = F.regexp_extract_all(text, whole, F.lit(0))
    between = F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, whole, F.lit(2)) if kind == "assign" else found
    least = {"assign": ASSIGN_LEAST, "random": CANDIDATE_LEAST}.get(kind, 0)
    matches = F.transform(
        F.arrays_zip(found.alias("match"), between.alias("before"), value.alias("value")),
        lambda m, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            F.lit(reading).alias("reading"),
            i.alias("i"),
            F.char_length(m["before"]).alias("gap"),
            F.char_length(m["match"]).alias("size"),
            (F.char_length(m["value"]) >= least).alias("counts"),
            (m["match"] if kind == "random" else F.lit(None).cast("string")).alias("run"),
        ),
    )
    # The text after the last match has no match beside it.
    return F.when(present, F.filter(matches, lambda m: m["size"].isNotNull()))


def _found() -> Column:
    text = F.col("_text")
    lowered, assigned = F.lower(text), F.lit(False)
    for word in ASSIGN_WORDS:
        assigned = assigned | F.contains(lowered, F.lit(word))
    kinds = [
        _matches("assign", ASSIGN, assigned),
        _matches("access", ACCESS, F.contains(text, F.lit("AKIA"))),
        _matches("hex", HEX, text.rlike(HEX)),
        *(_matches("random", _candidate(x), text.rlike(_candidate(x)), i) for i, x in enumerate(READINGS)),
    ]
    return F.flatten(F.array_compact(F.array(*kinds))).alias("found")


def _normal_tail(z: Column) -> Column:
    """P(Z > z), by the logistic approximation with a cubic term (error below 2e-4)."""
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(700.0))))


def with_p_values(runs: DataFrame) -> DataFrame:
    """Adds `p` to rows with `run`: the p-value of randomness, null for a null run and
    where fewer than 20 characters remain without separators."""
    alphabet = F.lit(None).cast("string")
    for pattern, symbols in reversed(ENCODINGS.values()):
        alphabet = F.when(F.col("run").rlike(pattern), F.lit(symbols)).otherwise(alphabet)
    rows = runs.withColumn("_alphabet", alphabet)
    symbols_only = F.regexp_replace("run", "=+$", "")
    parted = ~F.contains("_alphabet", F.lit("_"))
    code = F.when(parted, F.regexp_replace(symbols_only, "[_-]", "")).otherwise(symbols_only)
    left = F.char_length("run") - F.char_length(symbols_only) + F.char_length(code)
    rows = rows.withColumn("_code", F.when(left >= CANDIDATE_LEAST, code))
    code, letters = F.col("_code"), F.col("_alphabet")
    symbols = lambda text: F.filter(F.split(text, ""), lambda c: c != "")
    k, n = F.char_length(letters).cast("double"), F.char_length(code).cast("double")
    rows = rows.withColumns({
        "_halves": F.expr("translate(_code, _alphabet, concat(repeat('0', int(length(_alphabet) / 2)), repeat('1', length(_alphabet))))"),
        "_numbers": F.transform(symbols(code), lambda c: F.position(c, letters).cast("double")),
        # A symbol's count is what removing it takes away.
        "_squares": F.aggregate(symbols(letters), F.lit(0.0), lambda a, c: a + F.pow(n - F.char_length(F.replace(code, c, F.lit(""))), 2.0)),
    })
    numbers = F.col("_numbers")
    middle = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x) / n
    rows = rows.withColumns({
        "_middle": middle,
        "_ones": F.char_length(F.replace("_halves", F.lit("0"), F.lit(""))).cast("double"),
        "_runs": F.char_length(F.regexp_replace("_halves", "0+|1+", "x")).cast("double"),
    })
    # Uniformity of the symbols: chi-squared with k - 1 degrees of freedom, by the cube root.
    chi, df = F.greatest(F.col("_squares") * k / n - n, F.lit(0.0)), k - 1
    z_uniform = (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    # Runs of symbols from one half of the alphabet.
    mean = 2 * F.col("_ones") * (n - F.col("_ones")) / n + 1
    z_runs = (F.col("_runs") - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
    # Serial correlation of neighbours.
    off = F.transform(numbers, lambda x: x - F.col("_middle"))
    steps = F.zip_with(F.slice(off, F.lit(1), F.size(off) - 1), F.slice(off, F.lit(2), F.size(off) - 1), lambda a, b: a * b)
    total = F.aggregate(off, F.lit(0.0), lambda a, x: a + x * x)
    z_serial = (F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / F.greatest(total, F.lit(1e-9)) + 1 / n) * F.sqrt(n)
    least = F.least(_normal_tail(z_uniform), 2 * _normal_tail(F.abs(z_runs)), 2 * _normal_tail(F.abs(z_serial)))
    p = F.when(n >= 2, F.least(F.lit(1.0), 3 * least))
    return rows.withColumn("p", p).drop(*(c for c in rows.columns if c not in runs.columns))


def _p_step() -> Column:
    return F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) / STEP), F.lit(int(300 / STEP))).cast("int")


def _length_class() -> Column:
    return F.floor(F.log2(F.char_length("run").cast("double"))).cast("int")


def rejections(candidates: DataFrame, rate: float = FALSE_REJECTIONS) -> dict[int, int]:
    """By class of length, the first step of p from which randomness is rejected
    (Benjamini-Hochberg on counts per step; a step's p is its largest)."""
    tested = candidates.where("p is not null").groupBy(_length_class().alias("class"), _p_step().alias("step"))
    counts = tested.agg(F.count("*").alias("n"))  # at most classes x steps rows
    up_to = Window.partitionBy("class").orderBy(F.desc("step"))
    whole = Window.partitionBy("class")
    ranked = counts.withColumn("rank", F.sum("n").over(up_to)).withColumn("m", F.sum("n").over(whole))
    met = ranked.where(F.pow(F.lit(10.0), -F.col("step") * STEP) * F.col("m") <= rate * F.col("rank"))
    return {r["class"]: r["step"] for r in met.groupBy("class").agg(F.min("step").alias("step")).collect()}


def scan(docs: DataFrame, rate: float = FALSE_REJECTIONS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_random.

    A span is kind:start:end in code points, end exclusive, of the whole match;
    spans stand by start, then kind, joined by commas. `base_sha256` is of the
    base kinds' spans. A candidate that touches a base span is left to it. Null
    and empty texts have no spans; repeated rows are scanned one by one; only
    doc_id and text are read.
    """
    texts = docs.select("doc_id", text_or_empty().alias("_text"))
    rows = written(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", _found()), "found")
    match = rows.where(F.size("found") > 0).select("row", F.explode("found").alias("m")).select("row", "m.*")
    match = match.repartition("row")
    so_far = Window.partitionBy("row", "kind", "reading").orderBy("i")
    match = match.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("int"))
    match = match.withColumn("start", F.col("end") - F.col("size")).where("counts")
    match = match.dropDuplicates(["row", "kind", "start", "end"])  # readings that agree
    base = F.col("kind") < KINDS.index("random")
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    reached = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    follows = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    touched = (F.coalesce(reached, F.lit(-1)) > F.col("start")) | (F.coalesce(follows, F.col("end")) < F.col("end"))
    match = match.withColumn("touched", touched).where(base | ~F.col("touched"))
    spans = written(with_p_values(match).select("row", "kind", "start", "end", "run", "p"), "spans")

    rejected = F.lit(False)
    for class_, step in rejections(spans, rate).items():
        rejected = rejected | ((_length_class() == class_) & (_p_step() >= step))
    base = F.col("kind") < KINDS.index("random")
    kept = spans.where(base | (F.col("p").isNotNull() & ~rejected))
    # Random readings that overlap become one span; base matches stay as they are.
    order = Window.partitionBy("row", "kind").orderBy("start", F.desc("end"))
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = kept.withColumn("_new", base | reached.isNull() | (F.col("start") >= reached))
    kept = kept.withColumn("_island", F.sum(F.col("_new").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.groupBy("row", "kind", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    span = F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("span")
    grouped = kept.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", span))).alias("spans"),  # bounded by one text
        *(F.sum((F.col("kind") == i).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)),
    )
    joined = rows.select("row", "doc_id").join(grouped, "row", "left")
    text = lambda a: F.coalesce(F.concat_ws(",", F.transform(a, lambda x: x["span"])), F.lit(""))
    base_text = text(F.filter("spans", lambda x: x["kind"] < KINDS.index("random")))
    return joined.select(
        "doc_id",
        *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.encode(base_text, "UTF-8"), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        F.coalesce("n_random", F.lit(0)).cast("long").alias("n_random"),
    )
