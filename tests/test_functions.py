"""Keys, list cells, names and answers on hand-made rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from levelmark.functions import text as tx
from levelmark.functions.answers import parse_round1, parse_round2


def values(spark, cells, column):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


SPACED = ["  Excel\t", "\xa0Data\xa0", "\x1fy\x1f", " A b　\n", "", " \t", "ÉTÉ ", None, "​x", "Straße"]


def test_normalise_key_strips_as_python_does(spark):
    expected = [None if c is None else c.lower().strip() for c in SPACED]
    assert values(spark, SPACED, tx.normalise_key(F.col("c"))) == expected


def test_white_space_is_what_python_strips():
    every = {chr(i) for i in range(0x110000) if chr(i).isspace()}
    assert set(tx.WHITE_SPACE) == every


LIST_CELLS = [
    '["a","b"]', "[]", "[1,2]", "['a','b']", "[a]", '["a"]]', '["a"] ["b"]', '  ["x"]\t', '["a"],"w":["b"]',
    '["a"],["b"]', '["a"],"v":["b"]', '[{"a":1}]', '["a",]', '{"a":1}', "[true]", "[01]", '["a" "b"]', "[null]",
    "plain", "", None, '["b\\u00e9"]', "[", "]", '["a]',
]


def python_list_like(cell):
    if cell is None:
        return False
    try:
        return isinstance(json.loads(cell.strip()), list)
    except ValueError:
        return False


def test_is_list_like_agrees_with_a_json_parser(spark):
    assert values(spark, LIST_CELLS, tx.is_list_like(F.col("c"))) == [python_list_like(c) for c in LIST_CELLS]


@pytest.mark.parametrize(
    "cell, skills",
    [
        ("['Python', 'SQL']", ["Python", "SQL"]),
        ("""['a', "b's"]""", ["a", "b's"]),
        ('["x"]', ["x"]),
        ("['it\\'s']", ["it's"]),
        ("['a', ]", ["a"]),
        ("[]", []),
        ("Excel", None),
        (" ['a']", None),
        ("['a'", None),
        (None, None),
    ],
)
def test_parse_list_cell(spark, cell, skills):
    assert values(spark, [cell], tx.parse_list_cell(F.col("c"))) == [skills]


def test_title_format(spark):
    good = ["Excel", "['a','b']", "[x]", None, "a\rb"]
    bad = ["[a", "a]b", "", "[x]tail", "a[b]"]
    assert values(spark, good + bad, tx.title_format_ok(F.col("c"))) == [True] * 5 + [False] * 5


def test_ids_and_texts(spark):
    row = spark.createDataFrame([("T", "À b", "l", " Skill "), ("T", None, "l", "s")], "t string, a string, l string, s string")
    text = tx.course_text(F.col("t"), F.col("a"), F.col("l"))
    got = row.select(text.alias("x"), tx.content_id(text, F.col("s")).alias("id")).collect()
    assert got[0]["x"] == "T |: À b | l"
    assert got[0]["id"] == hashlib.sha256("t |: à b | l skill ".encode()).hexdigest()
    assert got[1]["x"] is None and got[1]["id"] is None
    stripped = values(spark, [" Ab\n"], tx.content_id_stripped(F.col("c")))
    assert stripped == [hashlib.sha256(b"ab").hexdigest()]


def test_labels_uris_and_file_names(spark):
    assert values(spark, ["HR (Human Resource)"], tx.sector_alias(F.col("c"))) == ["HR"]
    assert values(spark, ["A (B (C))"], tx.sector_name(F.col("c"))) == ["B (C"]
    uris = ["s3://b/k/x", "s3://b", "s3:///k", "b/k", "s3://b/"]
    assert values(spark, uris, tx.uri_bucket(F.col("c"))) == ["b", None, None, None, "b"]
    assert values(spark, uris, tx.uri_key(F.col("c"))) == ["k/x", None, None, None, ""]
    names = ["SFW_x.y.csv", "noext", ".hidden", "a.CSV"]
    assert values(spark, names, tx.file_stem(F.col("c"))) == ["SFW_x.y", "noext", ".hidden", "a"]
    assert values(spark, ["/d.x/a.CSV", "/d.x/a"], tx.file_suffix(F.col("c"))) == ["csv", ""]


def test_round1_answers(spark):
    cells = ['{"proficiency_level": "3"}', '{"proficiency_level": 4, "confidence": "high"}', "{}", "", "oops", "[1]", None]
    parsed = values(spark, cells, parse_round1(F.col("c")))
    assert [p["level"] for p in parsed] == [3, 4, 0, 0, 0, 0, 0]
    assert [p["confidence"] for p in parsed] == [None, "high", None, "low", "low", "low", "low"]


def test_round2_answers(spark):
    cells = ['{"proficiency": 5, "reason": "r", "confidence": "high"}', "{}", "", "oops", '{"proficiency": "x"}', None]
    parsed = values(spark, cells, parse_round2(F.col("c")))
    assert [tuple(p) for p in parsed] == [(5, "r", "high")] + [(0, "", "")] * 5


def test_level_forms(spark):
    forms = {"3": 3, "3.0": 3, " 3 ": 3, "+3.": 3, "2.7": 0, "3d": 0, "1e2": 0, "": 0, "99999999999": 0, "-1": -1, "high": 0, None: 0}
    from levelmark.functions.answers import cast_level

    df = spark.createDataFrame([(t,) for t in forms], "t string").select(cast_level(F.col("t")).alias("level"))
    assert [r["level"] for r in df.collect()] == list(forms.values())
