"""Line dedup in DataFrame operations: no Python on the executors; its sets, band keys and links."""

import random

import numpy as np
import pytest

from acadia.llm import line_dedup
from acadia.llm._store import staged


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["", "a", "elevenchars", "twelve chars", "aaaaaaaaaaaaaaaaaaaa"]
    for alphabet in ("abcdefgh ", "新日本語漢字", "aéก\U0001f600"):
        for n in (13, 19, 20, 21, 60, 300):
            base = "".join(rng.choice(alphabet) for _ in range(n))
            out += [base, base + "!", base[:n // 2] + "?" + base[n // 2:]]
    return out


def _sets(texts):
    return [{x[i:i + 12] for i in range(max(1, len(x) - 11))} for x in texts]


def test_shingle_sets_are_those_of_every_character(spark, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, line string").select("id", line_dedup.shingle_set("line").alias("set"))
    got = {r.id: r.set for r in rows.collect()}
    want = _sets(texts)
    for i, own in enumerate(want):
        assert len(got[i]) == len(own)
        assert all(len(set(got[i]) & set(got[j])) == len(own & other) for j, other in enumerate(want))


def test_bands_equal_where_the_numpy_keys_do(spark, texts):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    lines = staged(line_dedup.lines_of(line_dedup.keyed(docs)), "lines")
    keys = {(r.c1, r.c2): [r[b] for b in line_dedup.BAND_NAMES] for r in line_dedup._signatures(lines).collect()}
    rows = lines.select("c1", "c2", line_dedup.shingle_set("line").alias("set")).distinct().collect()
    hashes = np.array([h for r in rows for h in r.set], dtype=np.int64).view(np.uint64)
    want = line_dedup.band_keys(hashes, np.cumsum([0, *[len(r.set) for r in rows]]))
    got = np.array([keys[r.c1, r.c2] for r in rows])
    assert len(got) == len(set(texts) - {""})
    for b in range(line_dedup.BANDS):
        assert np.array_equal(got[:, b, None] == got[None, :, b], want[:, b, None] == want[None, :, b])


def test_no_python_on_the_executors(spark, monkeypatch):
    plans = []

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().toString()))
        return staged(df, name)

    monkeypatch.setattr(line_dedup, "staged", recorded)
    docs = spark.createDataFrame([(1, "a line that is here twice\nother"), (2, "a line that is here twice!")], "doc_id long, text string")
    out = line_dedup.judge_lines(docs)
    plans.append(("out", out._jdf.queryExecution().toString()))
    # Rows of a local list reach Spark through Python themselves, as an RDD; the operator adds no node of its own.
    assert not [name for name, plan in plans if any(x in plan for x in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "MapInPython"))]
    assert len(plans) > 5


def test_members_that_miss_the_head_meet_each_other(spark, monkeypatch):
    """All lines share every band, so one head serves two groups; the mixed line is alike to none."""
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh ") for _ in range(240))
    other = "".join(rng.choice("abcdefgh ") for _ in range(240))
    texts = [base, base + "x", other, other + "y", "z" + other, base[:120] + other[120:]]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    lines = staged(line_dedup.lines_of(line_dedup.keyed(docs)), "lines")
    classes = staged(line_dedup._signatures(lines).selectExpr("c1", "c2", "n", *[f"{k}L as band_{k}" for k in range(line_dedup.BANDS)]), "classes")
    name = {(r.c1, r.c2): r.doc_id for r in lines.collect()}
    for size in (512, 1):
        monkeypatch.setattr(line_dedup, "BLOCK_LINES", size)
        links = line_dedup._links(classes, lines, 0.8)
        group = {name[tuple(r.node)]: r.component for r in line_dedup.components(links).collect()}
        assert set(group) == {0, 1, 2, 3, 4} and group[0] == group[1] != group[2] == group[3] == group[4]
