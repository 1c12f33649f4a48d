"""Each operator against a brute-force version or an exact round trip on small tables, and on
the edge cases its docstring defines (nulls, empty and long texts, ties, repeated rows, empty
tables, extra columns with clashing names)."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acadia.llm import (_words, chat, fingerprint, html_extract, jaccard_join, line_dedup, mixing, packing, quality_classifier,
                        quality_rules, url_filter)
from acadia.llm._components import components
from acadia.llm.queries import ORACLE, QUERIES, chat_events, tokenizer_path
from acadia.sources.tables import read_table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, label int"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(None, "null id here now and then", "en", None, 1, "x", 1), (1, None, None, "src1", None, None, None), (2, "", "en", "src1", 0, "", 0),
       (3, " \t\n ", "de", "src2", 4, "y", 1), (4, LONG, "en", "src1", len(LONG), "z", 0), (5, "a b c d e f g", "en", "src1", 13, "t", 1),
       (5, "a b c d e f g", "en", "src1", 13, "t", 1), (6, "a b c d e f g", "fr", "src3", 13, "t", 1), (7, "Zeile\nZeile\n\nö ü", "de", "src2", 16, "u", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF, "documents")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def _linked(sets, threshold=0.8):
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = Counter(p for v in where.values() for p in combinations(sorted(set(v)), 2))
    return [p for p, c in shared.items() if c >= threshold * (len(sets[p[0]]) + len(sets[p[1]]) - c) - 1e-9]


def _roots(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def _grams(text, k=5):
    w = WORD.findall(text or "")
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_words_and_shingles_follow_the_bytes():
    texts = ["a bb  ccc", None, "", "x\ty\nz", "é ü", "a bb  ccc", "q" * (_words.WINDOW + 9) + " end"]
    raw, offsets = _words.text_buffer(pa.array(texts))
    starts, ends, rows = _words.word_spans(raw, offsets)
    words = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == [w for t in texts for w in (t or "").split()]
    hashes = _words.word_hashes(raw, starts, ends)
    assert len(set(hashes.tolist())) == len(set(words))
    own, cuts = _words.shingle_hashes(hashes, rows, 2)
    assert np.diff(cuts).tolist() == [2, 0, 0, 2, 1, 2, 1]
    assert own[cuts[0]:cuts[1]].tolist() == own[cuts[5]:cuts[6]].tolist()


def test_components_match_union_find(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = _roots({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got for e in edges if e[0] != e[1] for k in e)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 mixing

def test_budget_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("d", "en", "a", 1, 10), ("d", "en", "b", 9, 900), ("d", "fr", "c", 9, 900)],
                                   "domain string, lang string, source string, docs long, tokens long")
    got = {r.source: r.share for r in mixing.leaf_budgets(leaves, {}, 400, 1.0, 1).collect()}
    assert got == {"a": 10, "b": 190, "c": 200}  # a's shortage stays in en
    got = {r.source: r.share for r in mixing.leaf_budgets(leaves, {"lang": {"en": 0}}, 400, 1.0, 1).collect()}
    assert got == {"a": 0, "b": 0, "c": 400}


def test_mixing_edges(odd, none):
    mixed = mixing.mix(odd.withColumn("epoch", F.lit("old")), F.lit("d"), {}, budget=10**9, max_epochs=2).collect()
    assert len(mixed) == 2 * 6 and {r.epoch for r in mixed} == {0, 1}  # all but null, empty and blank texts
    cut = mixing.mix(odd, F.lit("d"), {}, budget=100).collect()
    assert sum(r.taken_tokens for r in cut) <= 100 and all(len(WORD.findall(r.text)) == r.taken_tokens for r in cut)
    assert all(LONG.startswith(r.text) for r in cut if r.doc_id == 4)
    assert mixing.mix(odd, F.lit("d"), {}, budget=0).count() == 0 == mixing.mix(none, F.lit("d"), {}).count()


def test_mixing_repeated_rows_give_what_is_asked(spark):
    rows = [(7, "a b c d", "en", "s", i) for i in range(3)] + [(8, "e f", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rest int")
    for budget in range(15):
        got = mixing.mix(docs.where("doc_id = 7"), F.lit("d"), {}, budget=budget, max_epochs=1).collect()
        assert sum(r.taken_tokens for r in got) == min(budget, 12) and len({r.rest for r in got}) == len(got) == -(-min(budget, 12) // 4)
    for budget in (3, 9, 13, 20, 27):
        got = mixing.mix(docs, F.lit("d"), {}, budget=budget, max_epochs=2).collect()
        assert sum(r.taken_tokens for r in got) == min(budget, 28) == sum(len(r.text.split()) for r in got)


def test_columns_named_like_the_operators_own(spark):
    import corpus_pipeline as cp
    rows = [(i, f"line {i} of its own\nthe same line in every text here", "en", "s", 9, "v") for i in range(4)]
    names = ["rest", "full", "cut", "cut_taken", "_leaf", "_doc", "_nth", "_any", "_key", "_row", "_drop", "n_lines", "row_key", "class_id", "node", "doc", "d", "x"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, v string")
    docs = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    for stage in (cp.lines, cp.near_copies, cp.mixing):
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and all(r[n] == f"own {n}" for r in got.collect() for n in names)
    assert line_dedup.line_dedup(docs).columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]


# 2 chat

def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi \\ <|im_end|> <\\| <"), (1, 1, "assistant", None), (1, 1, "assistant", "|x\nüber"), (2, None, None, ""),
            (None, 3, "ro\\n\nle<|", "<|im_end|>\n<|im_start|>assistant\nno")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat_events(table))).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", rows[0][3]), ("assistant", ""), ("assistant", "|x\nüber")]
    assert [(t.role, t.text) for t in back[None].turns] == [(rows[4][2], rows[4][3])] and list(back[1].loss) == ["", "|x\nüber"]
    assert back[-1].formatted.count("<|im_start|>") == 2
    empty = spark.createDataFrame([], "conv_id long, seq long, message long, role string, kind string, text string")
    assert chat.digests(chat.format_chats(empty)).count() == 0


def test_events_fold_in_sequence(spark):
    log = [(1, 5, 0, "a", "delta", "c"), (1, 1, 0, "a", "delta", "lost"), (1, 2, 0, "a", "edit", "a"), (1, 4, 0, "a", "delta", None),
           (1, 3, 0, "a", "delta", "b"), (1, 9, 1, "a", "delta", "gone"), (1, 10, 1, "a", "regenerate", "x"), (1, 11, 1, "a", "other", "y")]
    table = spark.createDataFrame(log, "conv_id long, seq long, message long, role string, kind string, text string")
    assert {r.message: r.text for r in chat.fold_events(table).collect()} == {0: "abc", 1: ""}


# 3 n-gram Jaccard join

def test_join_matches_all_pairs(spark, docs):
    rows = docs.collect()
    sets = {r.doc_id: _grams(r.text) for r in rows}
    links = _linked(sets)
    count, root = Counter(x for p in links for x in p), _roots(sets, links)
    got = jaccard_join.jaccard_join(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got} == {i: (root[i], count[i]) for i in sets}


def test_join_counts_every_link_of_a_large_group(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):  # more than one block of near copies
        w = list(base)
        w[int(rng.integers(0, 60))] = f"x{int(rng.integers(0, 400))}"
        rows.append((i, " ".join(w)))
    sets = {i: _grams(t) for i, t in rows}
    links = _linked(sets)
    count = Counter(x for p in links for x in p)
    got = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found, true = sum(r.n_links for r in got), 2 * len(links)
    assert 0.97 * true <= found <= true and all(r.n_links <= count[r.doc_id] for r in got)


def test_join_edges(odd, none):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(odd).collect()), key=str)
    assert got == sorted([(None, None, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 2), (5, 5, 2), (6, 5, 2), (7, 7, 0)], key=str)
    assert jaccard_join.jaccard_join(none).count() == 0


# 4 url filter

def test_automaton_matches_globs():
    globs = ["*.example.org/es/**", ".a*b/**", "**x**", "*", ".a/b"] + [f"*lit{i}*/**" for i in range(30)]
    texts = ["", ".example.org/es/", ".a.example.org/es/1", ".evil.com/x.example.org/es/", ".ab/", ".aqqb/z", ".a/b", "x", ".lit29z/", "é/x"]
    raw = [t.encode() for t in texts]
    fits = url_filter.Automaton(globs).run(*url_filter._buffer(raw))
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            pattern = "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.findall(r"\*\*|\*|[^*]+", g))
            assert fits[i, j] == bool(re.fullmatch(pattern, t, re.S)), (t, g)


def test_url_edges(spark):
    urls = [None, "", "no scheme", "HTTP://A.ORG", "http://Sub.Example.ORG/en/12?x", "http://x.com/de/#f", "http://spam.net", "a://b://c/d",
            "http://x.org/" + "p" * 5000, "http://ÀB.fr/fr/"]
    table = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: (r.host, r.path[:8], r.rule, r.verdict) for r in url_filter.filter_urls(table).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("a.org", "", None, "allow")
    assert got[4] == ("sub.example.org", "/en/12", "example.org/en/1", "block") and got[5] == ("x.com", "/de/", "com/de/", "block")
    assert got[6][3] == "block" and got[7] == ("b:", "//c/d", None, "allow") and got[8][2:] == ("org/", "allow") and got[9][0] == "Àb.fr"


# 5 quality rules

def _stats(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_statistics(docs, odd):
    for table in (docs, odd):
        want = sorted((r.doc_id if r.doc_id is not None else -1, *_stats(r.text)) for r in table.collect())
        rows = quality_rules.judge(table).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted((r.doc_id if r.doc_id is not None else -1, *(r[n] for n in names)) for r in rows) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
        assert not any(r.kept and r.base_failed for r in rows)


def test_rule_rates_follow_expectation_maximisation(spark):
    rng = np.random.default_rng(2)
    m, rows = len(quality_rules.RULES), []
    for _ in range(400):
        good = rng.random() < 0.8
        rows.append(([int(rng.choice(3, p=[0.03, 0.77, 0.2] if good else [0.7, 0.1, 0.2])) for _ in range(m)],))
    got = quality_rules.estimate(spark.createDataFrame(rows, "votes array<int>")).first().model
    votes = np.array([r[0] for r in rows])
    prior, good, bad = 0.9, np.tile([0.02, 0.68, 0.3], (m, 1)), np.tile([0.4, 0.3, 0.3], (m, 1))
    for _ in range(quality_rules.STEPS):
        odds = np.log(prior / (1 - prior)) + np.log(good[np.arange(m), votes] / bad[np.arange(m), votes]).sum(axis=1)
        p = 1 / (1 + np.exp(-odds))
        count = lambda w: np.array([[w[votes[:, j] == v].sum() + 1 for v in range(3)] for j in range(m)]) / (w.sum() + 3)
        prior, good, bad = (p.sum() + 1) / (len(p) + 2), count(p), count(1 - p)
    assert got.prior == pytest.approx(prior) and list(got.good) == pytest.approx(good.ravel().tolist())
    assert list(got.bad) == pytest.approx(bad.ravel().tolist())


def test_rules_empty_table(none):
    assert quality_rules.judge(none).count() == 0


# 6 line dedup

def _line_sets(rows):
    word = re.compile(r"\S", re.A)
    lines = [(r.doc_id, k, frozenset(x[i:i + 12] for i in range(max(1, len(x) - 11))) if word.search(x) else None)
             for r in rows for k, x in enumerate((r.text or "").split("\n"))]
    return [x for x in lines if x[2]]


def test_lines_match_all_pairs(docs):
    rows = docs.collect()
    lines = _line_sets(rows)
    ids = {s: i for i, s in enumerate(dict.fromkeys(x[2] for x in lines))}
    root = _roots(ids.values(), _linked({i: s for s, i in ids.items()}))
    first = {}
    for d, k, s in sorted(lines, key=lambda x: x[:2]):
        first.setdefault(root[ids[s]], (d, k))
    got = line_dedup.judge_lines(docs).collect()
    assert len(got) == len(lines) and {(r.doc_id, r.line_no) for r in got if r.kept} == set(first.values())
    kept = set(first.values()) | {(r.doc_id, k) for r in rows for k, x in enumerate(r.text.split("\n")) if not re.search(r"\S", x, re.A)}
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) in kept) for r in rows}
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == want


def test_lines_edges(odd, none):
    got = line_dedup.line_dedup(odd).collect()
    assert len(got) == len(ODD) and {r.text for r in got if r.doc_id == 7} == {"Zeile\n\nö ü"}
    assert [r.text for r in got if r.doc_id == 6] == [""] and [r.text for r in got if r.doc_id == 1] == [None]
    assert line_dedup.line_dedup(none).count() == 0


# 7 fingerprints

def _edited(rows):
    order = sorted(rows, key=lambda r: r.doc_id)
    for a, b in zip(order, order[1:] + order[:1]):
        t, n = a.text or "", b.text or ""
        k = len(t) // 4
        yield a.doc_id, len(t), hashlib.sha256((t[:len(t) - k] + n[:k]).encode()).hexdigest()


def test_fingerprints(spark, docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RUN", 7)  # many runs, so that successors cross them
    got = fingerprint.edited_fingerprints(docs).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(_edited(docs.collect()))
    text = {r.doc_id: r.text for r in docs.collect()}
    for a in got[:40]:
        sets = _grams(text[a.doc_id])
        assert abs(len(fingerprint.decode(a.fingerprint)) - len(sets) / 4) <= 4 * (len(sets) ** 0.5 / 2 + 1)
    both = fingerprint.merge([got[0].fingerprint, got[1].fingerprint])
    assert fingerprint.contained(fingerprint.decode(got[0].fingerprint), both) in (0.0, 1.0)


def test_fingerprint_edges(spark, odd, none):
    got = fingerprint.edited_fingerprints(odd).collect()
    assert len(got) == len(ODD) and len({r.fingerprint for r in got if r.doc_id in (5, 6)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint.edited_fingerprints(none).count() == 0
    one = fingerprint.edited_fingerprints(spark.createDataFrame([(9, "abcdefgh")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


# 8 html

def test_extraction_of_the_pages(spark):
    for r in html_extract.extract_pages(read_table(spark, SF, "pages")).join(
            read_table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)(</article>|\Z)", r.html)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]*>", " ", body.group(1)))).split()) if body else ""
        assert r.text == want and r.n_chars == len(want)


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("<p>", ""), ("plain &amp; simple", "plain & simple"),
    ("<nav><a href=x>Home</a></nav><h1>T</h1><p>One <b>t</b>wo.<p class=ad>Buy<p>Three<br>four<footer>F</footer>", "T One two. Three four"),
    ("<div id='cookie-notice'>We <div>use</div> cookies</div><main><p>A</p><aside>s</aside><form>f<input></form><p>B</p></main><p>out</p>", "A B"),
    ("<article><p>A</p><script>if (a < b) '</p>'</script><!-- c --><section class='reader comments'><p>no</p></section></article>", "A"),
    ("<style>p{}</style><ul><li><a href=1>l1</a><li><a href=2>l2</a></ul><p>Text &lt;b&gt; &#8364;</p>", "Text <b> €"),
    ("<article><p>open", "open"), ("<nav>left open<article><p>A</p></article>", "A"),
])
def test_extraction_edges(page, want):
    assert html_extract.main_text(page) == want


# 9 classifier

def test_classifier_on_held_out_labels(spark):
    docs, labels = (read_table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    seen = labels.where("doc_id % 2 = 0")
    rows = quality_classifier.classify(docs, seen).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = sum(r.kept == bool(r.quality) for r in rows) / len(rows)
    clean = [r for r in rows if r.quality == 1]
    assert len(rows) > 100 and right >= 0.95 and sum(r.kept for r in clean) >= 0.97 * len(clean)


def test_classifier_edges(spark, odd, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept and r.p_good == 1 for r in quality_classifier.classify(odd, no_labels).collect())
    few = spark.createDataFrame([(4, 0), (5, 1), (5, 1), (None, 0), (7, 9)], "doc_id long, quality int")
    got = quality_classifier.classify(odd, few).collect()
    assert len(got) == len(ODD) and all(0 <= r.p_good <= 1 for r in got)
    kept = quality_classifier.keep_good(odd, few)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert quality_classifier.classify(none, few).count() == 0


# 10 packing

def _check_packing(rows, texts):
    from tokenizers import Tokenizer
    tokenizer, by_doc, by_seq = Tokenizer.from_file(tokenizer_path()), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for doc_id, text in texts.items():
        ids, at = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        ends = np.cumsum([0] + [r.length for r in sorted(pieces, key=lambda r: r.offset)])
        assert [r.offset for r in sorted(pieces, key=lambda r: r.offset)] == ends[:-1].tolist() and ends[-1] <= 4096
    return sum(r.length for r in rows) / (4096 * len(by_seq))


def test_packing_round_trip(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert _check_packing(rows, {r.doc_id: r.text for r in docs.collect()}) > 0.97


def test_packing_edges(spark, odd, none):
    texts = {1: None, 2: "", 3: " \n", 4: LONG, 5: "a\x00b <|endoftext|> ÀÉ \u00a0 it's", 6: "\x00 <| x"}
    rows = packing.pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), tokenizer_path()).collect()
    _check_packing(rows, texts)
    assert len(packing.pack(odd, tokenizer_path()).collect()) >= len(ODD)
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(1)
    edges = packing.bin_edges(4096)
    for total in (0, 1, 5000):
        hist = np.bincount(np.minimum(rng.geometric(0.01, total), len(edges)) - 1, minlength=len(edges))
        rows = packing.plan(hist, 4096)
        placed, load = defaultdict(list), Counter()
        for b, first, times, seq, slot in rows.tolist():
            placed[b].extend(range(first, first + times))
            for s in range(seq, seq + times):
                load[s] += int(edges[b])
        assert all(sorted(placed[b]) == list(range(hist[b])) for b in range(len(edges))) and all(v <= 4096 for v in load.values())


# queries, SQL and pipeline

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    plain = lambda x: sorted(map(str, x.astype(object).where(x.notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    docs = read_table(spark, SF, "documents")
    frames = [docs]
    for name, stage in cp.STAGES[:-1]:
        frames.append(stage(spark, frames[-1], SF).checkpoint())
        assert frames[-1].columns == docs.columns, name
        assert all(r.n_chars == len(r.text) for r in frames[-1].collect() if name in ("line_dedup", "mixing"))
    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in frames[1].collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    lines = _line_sets(frames[2].collect())
    sets = {i: s for i, s in enumerate(x[2] for x in lines)}
    assert not _linked(sets)  # what line dedup leaves has no two alike lines
    assert not _linked({r.doc_id: _grams(r.text) for r in frames[3].collect()})
    rows = cp.STAGES[-1][1](spark, frames[4], SF).collect()
    assert sum(r.length for r in rows) == sum({(r.doc_id, r.start, r.ids_crc32, r.sequence_id, r.offset): r.length for r in rows}.values())
    assert cp.run(spark, SF).count() == len(rows)
