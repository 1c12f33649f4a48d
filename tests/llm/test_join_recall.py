"""Recall of the Jaccard join at its threshold, whatever else the corpus holds."""

from acadia.llm import jaccard_join


def test_pairs_at_the_threshold_beside_a_large_group(spark):
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(150):  # pairs of this group are 0.88 alike
        words = list(base)
        words[4 + 5 * (i % 30)] = f"g{i}"
        rows.append((i, " ".join(words)))
    for i in range(300):  # one word of 49 to 54 differs: 40 of 50 to 45 of 55 grams
        words = [f"p{i}x{k}" for k in range(49 + i % 6)]
        rows.append((1000 + 2 * i, " ".join(words)))
        words[20] = f"other{i}"
        rows.append((1001 + 2 * i, " ".join(words)))
    got = {r.doc_id: r for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[1001 + 2 * i].class_id == 1000 + 2 * i for i in range(300))
    assert found >= 0.98 * 300
    assert all(got[i].class_id == 0 for i in range(150))
