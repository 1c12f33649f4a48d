"""The language model against a plain count of n-grams, and its edge cases."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from acadia.llm import ngram_model
from acadia.llm.ngram_model import discounts, held_out_scores, score, train
from acadia.llm.queries import QUERIES
from acadia.sources.tables import read_table

WORD = re.compile(r"[^ \t-\r]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score string, n_tokens int"


def _tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


class Plain:
    """Interpolated modified Kneser-Ney from dictionaries; the start is 0, the end None."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {order: Counter()}
        for text in texts:
            padded = [0] * (order - 1) + _tokens(text)
            self.counts[order].update(tuple(padded[i:i + order]) for i in range(len(padded) - order + 1))
        self.raw = Counter()
        for g, n in self.counts[order].items():
            self.raw[g[-1]] += n
        often = self.counts[order]
        for k in range(order - 1, 0, -1):
            self.counts[k], shorter = Counter(), Counter()
            for g, n in often.items():
                shorter[g[1:]] += n
            for g in self.counts[k + 1]:
                self.counts[k][g[1:]] += often[g] if g[1] == 0 else 1
            often = shorter
        self.d, self.of = {}, {}
        for k, counts in self.counts.items():
            n = Counter(counts.values())
            self.d[k] = (0, *discounts(n[1], n[2], n[3], n[4]))
            self.of[k] = defaultdict(list)
            for g, c in counts.items():
                self.of[k][g[:-1]].append(c)
        self.after = {(k, h): (sum(found), sum(self.d[k][min(x, 3)] for x in found) / sum(found))
                      for k, of in self.of.items() for h, found in of.items()}

    def p(self, gram):
        k = len(gram)
        if k == 0:
            return 1 / (len(self.raw) + 1)
        if (k, gram[:-1]) not in self.after:
            return self.p(gram[1:])
        (total, left), c = self.after[k, gram[:-1]], self.counts[k][gram]
        return (c - self.d[k][min(c, 3)]) / total + left * self.p(gram[1:])

    def score(self, text):
        padded = [0] * (self.order - 1) + _tokens(text)
        return sum(math.log10(self.p(tuple(padded[i:i + self.order]))) for i in range(len(padded) - self.order + 1))

    def base(self, text):
        n, v = sum(self.raw.values()), len(self.raw)
        return sum(math.log10((self.raw[t] + 1) / (n + v + 1)) for t in _tokens(text))


def _held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _check(got, rows, order):
    plain = Plain([t for i, t in rows if not _held(i)], order)
    expected = sorted(((i is None, i or 0, t or "", _held(i), len(_tokens(t)), sum(plain.raw[x] > 0 for x in _tokens(t)),
                        sum(plain.raw.values()), plain.base(t), plain.score(t)) for i, t in rows), key=lambda r: r[:3])
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for e in expected:
        by_id[None if e[0] else e[1]].append(e[3:])
    for r in got:
        own = (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)
        near = [e for e in by_id[r.doc_id] if e[:4] == own[:4] and np.allclose(e[4:], own[4:], rtol=1e-9, atol=1e-9)]
        assert near, (r, by_id[r.doc_id])
        by_id[r.doc_id].remove(near[0])
        assert math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens), rel_tol=1e-9)


@pytest.mark.parametrize("order, shard_bytes, chunk", [(2, 16 << 20, 16 << 20), (2, 20_000, 9_000), (3, 30_000, 50_000), (1, 50_000, 50_000)])
def test_scores_match_plain_counts(spark, monkeypatch, order, shard_bytes, chunk):
    monkeypatch.setattr(ngram_model, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(ngram_model, "SCORED_BYTES", chunk // 2)
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    _check(held_out_scores(docs, order, shard_bytes=shard_bytes).collect(), [(r.doc_id, r.text) for r in docs.collect()], order)


def test_odd_texts_and_frequent_contexts(spark, monkeypatch):
    rows = [(None, "the the a"), (1, None), (2, ""), (3, " \t\n"), (4, "The THE the Ä ä " * 3000), (5, "a b"), (5, "a b"), (6, "A\vB c"),
            (7, "x" * 70_000), *((100 + i, " ".join(f"the w{j % (i + 2)}" for j in range(40))) for i in range(40))]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS)
    got = held_out_scores(table, 2, shard_bytes=2000).collect()
    _check(got, rows, 2)
    model = train(table, 2, shard_bytes=2000)
    the = ngram_model._fold([ngram_model.tokens(ngram_model.pa.array(["the"]))[0][:1]], 1)[0]
    assert model.shards > 50 and the in model.hot[2] and model.hot_counts[2][list(model.hot[2]).index(the)][0] > 800


def test_probabilities_of_all_words_sum_to_one():
    plain = Plain(["a b a c", "b a", "c c d", "a b"], 2)
    for before in ("a", "b", 0, "never seen"):
        assert math.isclose(sum(plain.p((before, w)) for w in [*plain.raw, "unknown"]), 1)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert held_out_scores(none).count() == 0
    one = spark.createDataFrame([(1, "a b", "x", 1)], DOCS)
    got = score(one, train(none), ["doc_id"]).first()
    assert (got.n_tokens, got.n_known, got.train_tokens, got.base_score, got.score) == (3, 0, 0, 0.0, 0.0)


def test_discounts_stay_within_the_counts():
    assert discounts(10, 5, 3, 2) == pytest.approx((0.5, 2 - 3 * 0.5 * 3 / 5, 3 - 4 * 0.5 * 2 / 3))
    assert discounts(5, 0, 1, 1) == (0.5, 1.0, 1.5) and discounts(1, 1, 9, 1)[1] == 1.0


def test_model_beats_single_words_on_held_out_documents(spark):
    got = QUERIES["op12_lm_scoring"](spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b
