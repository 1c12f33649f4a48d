"""Line dedup against an independent Jaccard over the shingles of every character."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from acadia.llm import line_dedup
from acadia.llm._store import staged


def _jaccard(a, b, k=12):
    a, b = ({x[i:i + k] for i in range(max(1, len(x) - k + 1))} for x in (a, b))
    return len(a & b) / len(a | b)


def test_unspaced_lines_meet_after_a_front_insertion(spark):
    rng = random.Random(4)
    cjk = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(200))
    url = "//example.org/" + "".join(rng.choice("abcdef0123456789") for _ in range(140))
    mixed = "".join(chr(rng.choice([97, 233, 0xE01, 0x1F600]) + rng.randrange(20)) for _ in range(150))
    lines = [cjk, "新" + cjk, "http:" + url, "https:" + url, mixed, "x" + mixed, mixed[:60] + "y" * 60, "short", "short", "shorts"]
    assert _jaccard(lines[0], lines[1]) > 0.99 and _jaccard(lines[2], lines[3]) > 0.9
    same = list(range(len(lines)))
    for a, b in combinations(range(len(lines)), 2):
        if _jaccard(lines[a], lines[b]) >= 0.8:
            same[b] = min(same[b], same[a])
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup.judge_lines(docs).collect()}
    assert {i for i, r in rows.items() if r.kept} == {i for i, s in enumerate(same) if i == s}
    assert all(((rows[a].g1, rows[a].g2) == (rows[b].g1, rows[b].g2)) == (same[a] == same[b]) for a, b in combinations(rows, 2))


@pytest.mark.parametrize("shared, total", [(4, 5), (5, 6), (8, 10), (9, 11), (16, 20), (40, 50), (160, 200)])
def test_bands_find_short_lines_as_often_as_long_ones(shared, total):
    pool = np.random.default_rng(3).integers(0, 2**64, (20_000, total), dtype=np.uint64)
    cut = shared + (total - shared) // 2
    sides = (pool[:, :cut], np.concatenate([pool[:, :shared], pool[:, cut:]], axis=1))
    a, b = (line_dedup.band_keys(np.ascontiguousarray(x).ravel(), np.arange(0, x.size + 1, x.shape[1])) for x in sides)
    found = (a == b).any(axis=1).mean()
    assert found >= 0.99 and found == pytest.approx(1 - (1 - (shared / total) ** line_dedup.ROWS) ** line_dedup.BANDS, abs=0.003)


def test_a_single_unlinked_line_is_in_no_group(spark):
    docs = spark.createDataFrame([(1, "alone\nsame"), (2, "same\nother")], "doc_id long, text string")
    lines = staged(line_dedup.lines_of(line_dedup.keyed(docs)), "lines")
    same = lines.where("line = 'same'").select("c1", "c2", "c1", "c2").distinct()
    assert line_dedup.line_groups(lines, 0.8).collect() == same.collect()
    rows = line_dedup.judge_lines(docs).collect()
    assert {(r.doc_id, r.line_no, r.kept) for r in rows} == {(1, 0, True), (1, 1, True), (2, 0, False), (2, 1, True)}


def test_a_unit_cut_by_batches_is_verified_whole():
    rng = random.Random(8)
    text = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(12)]
    name = lambda k: {"c1": k, "c2": -k}
    rows = [{"band": u, "i": 0, "j": 0, "cls": name(10 * u + k), "component": name(10 * u + k), "minor": k == 0, "line": text[u] + "xy"[:k] if k < 2 else text[u - 1]}
            for u in range(3) for k in range(3)]
    kind = pa.struct([("c1", pa.int64()), ("c2", pa.int64())])
    schema = pa.schema([("band", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("cls", kind), ("component", kind), ("minor", pa.bool_()), ("line", pa.string())])
    for size in (1, 2, 4, 9):
        batches = [pa.RecordBatch.from_pylist(rows[k:k + size], schema=schema) for k in range(0, 9, size)]
        got = [r for b in line_dedup._verify(0.8)(iter(batches)) for r in b.to_pylist()]
        assert got == [{"a": name(10 * u), "b": name(10 * u + 1)} for u in range(3)]
