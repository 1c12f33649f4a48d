"""Rows that repeat a doc_id, and rows without one, through line dedup and the choice among near copies."""

from collections import Counter

import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_repeated_and_null_ids_are_separate_documents(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    near = a.replace("a29", "z")
    rows = [(3, a), (7, near), (7, b), (8, c), (8, c), (None, d), (None, d), (None, d), (None, "one more text of its own"), (9, ""), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = cp.near_copies(spark, docs, SF)
    assert left.columns == docs.columns
    want = Counter({(3, a): 1, (7, b): 1, (8, c): 1, (None, d): 1, (None, "one more text of its own"): 1, (9, ""): 2})
    assert Counter((r.doc_id, r.text) for r in left.collect()) == want
    both = cp.near_copies(spark, cp.lines(spark, docs, SF).checkpoint(), SF)
    del want[(9, "")]  # without a word
    assert Counter((r.doc_id, r.text) for r in both.collect()) == want
