"""Exact copies, BPE, secrets and the n-gram join against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from levelmark.llm import block_naming, secret_scan, signature_join, trie_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LOWER = {i: chr(i + 32) for i in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, name string, node string"


def documents(spark, texts):
    """Rows with clashing extra columns; ids from 1, some null or repeated where given as pairs."""
    rows = [x if isinstance(x, tuple) else (i + 1, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", 1, "r", "n", "o") for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(4)
    made = ["", None, "A", "a", "É", "é", "ab" * 3000, "AB" * 3000, "ab" * 3000 + "c", " "]
    return made + ["".join(draw.choices("abAB", k=draw.randint(0, 9))) for _ in range(150)]


@pytest.mark.parametrize("block, bits", [(4096, 64), (3, 4)])
def test_exact_duplicates(spark, texts, block, bits):
    """Also with blocks of 3 bytes whose prints nearly all collide."""
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOWER)].append(i + 1)
    expected = {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}
    rows = block_naming.exact_duplicates(documents(spark, texts), block, bits).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows} == expected


def test_exact_duplicates_of_odd_rows(spark):
    rows = [(1, "x"), (1, "x"), (1, "X"), (None, "x"), (None, "y"), (None, "y"), (2, None), (3, ""), (4, "z"), (4, "z")]
    docs = documents(spark, rows)
    found = block_naming.exact_duplicates(docs)
    kept = sorted((r["text_sha256"], r["doc_id"]) for r in found.where("kept").collect() if r["doc_id"])
    assert kept == sorted([(sha("x"), 1), (sha(""), 3), (sha("z"), 4)]) and found.where("kept").count() == 4
    left = block_naming.keep_one(docs)
    assert left.columns == docs.columns
    assert sorted((str(r["doc_id"]), (r["text"] or "").lower()) for r in left.collect()) == [("1", "x"), ("3", ""), ("4", "z"), ("None", "y")]
    assert block_naming.exact_duplicates(docs.where("false")).count() == 0
    assert block_naming.keep_one(docs.where("false")).count() == 0


def fuzz_texts():
    draw = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEÉéßΣσςİıñ'’ \t\n\x0b\x85\xa0\u200b\u3000<|>/w0123½²٣ⅷ中文字🙂!!..--__ḍ̇가\x00\x1c"
    made = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(3000)]
    words = "the of and thing tion ing internationalization unbelievable hello's".split()
    made += [" ".join("".join(draw.choices(words, k=2)) for _ in range(30)) for _ in range(200)]
    made += ["<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> X", "</w>", "a</w>b</w>", "THEY'RE o'clock 's's", "<|end", "é" * 5000]
    return made + [chr(i) for i in range(0x3000)] + [f"a{chr(i)}b" for i in range(0x600)]


def test_bpe_equals_the_library():
    library, own = Tokenizer.from_file(PATH), trie_bpe.TrieBpe(trie_bpe._read(PATH))
    made = fuzz_texts()
    for text, known, ids in zip(made, library.encode_batch(made, add_special_tokens=False), own.encode(made), strict=True):
        assert known.ids == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def test_bpe_frames(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(None, None), (7, ""), (7, "")], "doc_id long, text string")
    )
    library = Tokenizer.from_file(PATH)
    rows = docs.collect()
    ids = [library.encode(r["text"] or "", add_special_tokens=False).ids for r in rows]
    decoded = [library.decode(i, skip_special_tokens=False) for i in ids]
    expected = Counter((r["doc_id"], len(i), sha(" ".join(map(str, i))), sha(d)) for r, i, d in zip(rows, ids, decoded, strict=True))
    assert Counter(tuple(r) for r in trie_bpe.digests(docs, PATH).collect()) == expected
    encoded = trie_bpe.encode(docs, PATH)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded.collect()) == Counter((r["doc_id"], tuple(i)) for r, i in zip(rows, ids, strict=True))
    assert Counter(r["text"] for r in trie_bpe.decode(encoded, PATH).collect()) == Counter(decoded)
    assert trie_bpe.digests(docs.where("false"), PATH).count() == 0


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def random_runs(n):
    draw = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return ["".join(draw.choices(letters, k=44)) for _ in range(n)]


def test_secret_spans(spark):
    draw = random.Random(2)
    bits = ["password=", "TOKEN: ", "api_key = '", "secret", "é🙂 ", "AKIA", "0123456789abcdef", "ABCDEFGH12345678", "deadbeef", "token=token:", " ", "x" * 11, "Z9" * 9, "\n"]
    made = ["".join(draw.choices(bits, k=draw.randint(0, 12))) for _ in range(300)]
    made += ["", None, "f" * 40_000, "deadbeefdeadbeef " * 500]
    rows = {r["doc_id"]: r for r in secret_scan.scan(documents(spark, made)).collect()}
    assert len(rows) == len(made)
    for i, text in enumerate(made):
        base, row = base_spans(text or ""), rows[i + 1]
        assert row["base_sha256"] == sha(",".join(base))
        spans = row["spans"].split(",") if row["spans"] else []
        assert [s for s in spans if not s.startswith("random")] == base
        assert [row[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s.startswith(k) for s in base) for k in ("assign", "access", "hex")]


def test_random_runs_are_secrets_and_regular_ones_are_not(spark):
    secrets = random_runs(60)
    regular = ["Section1Section1Section1Section1Section1Section1", "aB1" * 20, "AAAAAAAAAAAAAAAAAAAAaaaaaaaaaaaaaaaaaaaa1111111111"] * 5
    prose = ["Thereisnothingtoseehere" * 3, "plain words only", "2024-11-30T10-20-30-000"]
    docs = documents(spark, [f"é the {s} end" for s in secrets] + [f"see {r} here" for r in regular] + prose)
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    hits = [rows[i + 1]["spans"] for i in range(60)]
    assert sum(h == f"random:6:{6 + 44}" for h in hits) >= 54
    assert all(rows[i]["n_random"] == 0 for i in range(61, len(rows) + 1))


def found_in(spark, before, secrets, after):
    """How many secrets, set between the two texts, lie in a random span; none beside it."""
    rows = {r["doc_id"]: r for r in secret_scan.scan(documents(spark, [before + s + after for s in secrets])).collect()}
    found = 0
    for i, secret in enumerate(secrets, 1):
        spans = [tuple(map(int, s.split(":")[1:])) for s in rows[i]["spans"].split(",") if s.startswith("random")]
        assert len(spans) == rows[i]["n_random"] <= 1
        found += any(a <= len(before) and b >= len(before) + len(secret) for a, b in spans)
    return found


@pytest.mark.parametrize(
    "before, after",
    [("AUTH=", ""), ("x?sig=", "&n=1"), ("DB_KEY=", " "), ("/a_b/", "/c"), ("see /a_b/", ".html"), ("https://h.io/v1/my-files/", "?x=1")],
)
def test_random_runs_after_names_and_in_paths(spark, before, after):
    assert found_in(spark, before, random_runs(60), after) >= 54


def test_padding_belongs_to_the_run(spark):
    secrets = [s[:42] + "==" for s in random_runs(60)]
    rows = secret_scan.scan(documents(spark, [f"AUTH={s}" for s in secrets])).collect()
    assert sum(r["spans"] == "random:5:49" for r in rows) >= 54
    rows = secret_scan.scan(documents(spark, [f"{s}={s}" for s in random_runs(60)])).collect()
    assert sum(r["spans"] == "random:0:44,random:45:89" for r in rows) >= 48


def drawn(letters, sizes, joined, before=""):
    draw = random.Random(5)
    return [before + joined.join("".join(draw.choices(letters, k=n)) for n in sizes) for _ in range(60)]


CAPITALS, SMALL, HEX = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"


@pytest.mark.parametrize(
    "letters, sizes, joined, before",
    [
        (CAPITALS, [24], "", ""),
        (CAPITALS, [40], "", ""),
        (CAPITALS, [5] * 5, "-", ""),
        (HEX, [8, 4, 4, 4, 12], "-", ""),
        (HEX.upper(), [8, 4, 4, 4, 12], "-", ""),
        (SMALL, [32], "", "sk_live_"),
        (SMALL, [16, 16], "_", ""),
    ],
)
def test_runs_of_one_case_are_tested(spark, letters, sizes, joined, before):
    assert found_in(spark, "the ", drawn(letters, sizes, joined), " end") >= 52
    if before:
        assert found_in(spark, "the " + before, drawn(letters, sizes, joined), " end") >= 52


def test_every_candidate_has_a_p_value(spark):
    draw = random.Random(9)
    made = []
    for others in secret_scan.READINGS:
        code = "".join(draw.sample(CAPITALS + SMALL[:26] + others, k=12))
        made += ["".join(draw.choices(code, k=draw.randint(24, 60))) for _ in range(100)]
    candidates = [m[0] for t in made for x in secret_scan.READINGS for m in re.finditer(secret_scan._candidate(x), t)]
    candidates = [c for c in candidates if len(re.sub("[_-]", "", c)) >= 20]
    rows = secret_scan.with_p_values(spark.createDataFrame([(c,) for c in candidates], "run string")).collect()
    assert len(rows) > 200 and all(r["p"] is not None and 0 <= r["p"] <= 1 for r in rows)


def test_regular_runs_of_one_case_are_not_secrets(spark):
    regular = ["chapter-12-of-the-annual-report-on-the-state-of-the-economy", "SECTION_1_SECTION_1_SECTION_1_SECTION_1", "-" * 30 + "a1" + "_" * 30,
               "1234-5678-9012-3456-7890-1234", "2024-11-30T10-20-30-000", "aaaaaaaaaaaaaaaa-1111111111111111", "https://example.org/blog/2024/how-the-weather-changes-the-weather"] * 3
    rows = secret_scan.scan(documents(spark, [f"see {r} here" for r in regular])).collect()
    assert [r["spans"] for r in rows if r["n_random"]] == []


def plain_components(rows, k, percent):
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))} if words else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for x, i in enumerate(ids):
        for j in ids[:x]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def noisy_copies():
    draw = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choices(words, k=30))
    made = ["", None, "  ", "one", "ONE", "one two", "a b c d", "a b c d e"]
    for _ in range(12):
        base = draw.choices(words, k=draw.randint(5, 120))
        for _ in range(draw.randint(1, 9)):
            copy = list(base)
            for _ in range(draw.randint(0, 4)):
                copy[draw.randrange(len(copy))] = draw.choice(words)
            made.append(" ".join(copy) + (" " + passage if draw.random() < 0.3 else ""))
    chain = draw.choices(words, k=100)
    for i in range(40):  # each like the next, the ends unlike
        chain[(7 * i) % 100] = f"new{i}"
        made.append(" ".join(chain).upper())
    return made


@pytest.mark.parametrize("k, percent, piece", [(4, 85, 1 << 19), (3, 60, 300)])
def test_similar_documents(spark, monkeypatch, k, percent, piece):
    """Also with groups cut into small pieces and long runs of shared shingles."""
    if piece < 1000:
        monkeypatch.setattr(signature_join, "RUN", 3)
    made = noisy_copies()
    rows = signature_join.similar_documents(documents(spark, made), k, percent, piece).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain_components(list(enumerate(made, 1)), k, percent)


def test_similar_documents_of_odd_rows(spark):
    long = " ".join(f"v{i}" for i in range(60))
    docs = documents(spark, [(5, long), (5, long), (3, long + " tail"), (None, long), (8, ""), (8, ""), (None, None), (9, "other words here now")])
    found = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in signature_join.similar_documents(docs).collect())
    assert found == sorted(
        [("5", 57, "3"), ("5", 57, "3"), ("3", 58, "3"), ("None", 57, "3"), ("8", 0, "8"), ("8", 0, "8"), ("None", 0, "None"), ("9", 1, "9")]
    )
    left = signature_join.keep_one_of_each(docs)
    assert left.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["3", "8", "9", "None"]
    assert signature_join.similar_documents(docs.where("false")).count() == 0
