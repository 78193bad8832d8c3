"""Words whose hashes a polynomial modulo 2^64 cannot tell apart."""

import pyarrow as pa
from test_texts import plain_components

from levelmark.llm.shingles import shingle_sets
from levelmark.llm.signature_join import similar_documents


def thue_morse(length):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(length))


def test_thue_morse_words_are_not_linked(spark):
    rows = []
    for i, length in enumerate((64, 512, 1024, 2048, 4096)):
        word = thue_morse(length)
        other = word.translate(str.maketrans("ab", "ba"))
        rows += [(10 * i + 1, f"{word} one two three"), (10 * i + 2, f"{other} one two three"), (10 * i + 3, f"{word.upper()}\tONE two  three")]
    found = similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == plain_components(rows, 4, 85)


def test_places_and_cases_of_letters():
    texts = ["ab", "ba", "AB", "aab", "abb", "é", "é", "a" * 300, "a" * 301]
    sets = [tuple(s.tolist()) for s in shingle_sets(pa.array(texts), 4)]
    assert sets[0] == sets[2] and len(set(sets)) == len(texts) - 1
