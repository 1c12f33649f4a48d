"""Registered queries of the subpackage: ``QUERIES[name](spark, sf_dir)`` and DuckDB SQL.

Each query applies its operator, with production parameters, to its whole table.  Queries
whose operator SQL cannot express (hashes, models, iteration, tokenizers) have no SQL; their
operators are tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import prepare
from ..sources.tables import read_table
from . import (chat, fingerprint, hard_negatives, html_extract, jaccard_join, line_dedup, mixing, ngram_model, packing, quality_classifier, quality_rules, structure_repair,
               url_filter)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# The mixture of the registered query and of the pipeline.  The documents name no domain;
# sources stand for three sites.
DOMAIN_SQL = "concat('site', coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS bigint), 0) % 3)"
WEIGHTS = {"domain": {"site0": 5, "site1": 3, "site2": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 3}, "source": {"src0": 4}}
FRACTION, MAX_EPOCHS, SEED = 0.6, 3, 17


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_path() -> str:
    """The public tokenizer file of the packing contract."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def mixture(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, F.expr(DOMAIN_SQL), WEIGHTS, fraction=FRACTION, max_epochs=MAX_EPOCHS, seed=SEED)


def _weight_sql(level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    return f"CASE {level} {cases} ELSE 1 END"


def _mixing_sql() -> str:
    """Leaf statistics, three rounds of dealing, then the epochs of each leaf."""
    levels = mixing.LEVELS
    ctes = [f"""d AS (SELECT doc_id, {DOMAIN_SQL} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
      leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, sum(n)::BIGINT * {MAX_EPOCHS} AS cap
        FROM d WHERE n > 0 GROUP BY ALL)""",
            f"given AS (SELECT cast(floor(sum(tokens) * {FRACTION}) AS BIGINT) AS budget FROM leaf)"]
    above = "given"
    for k, level in enumerate(levels):
        keys, up = ", ".join(levels[:k + 1]), ", ".join(levels[:k])
        by = f"PARTITION BY {up}" if up else ""
        link = f"JOIN {above} USING ({up})" if up else f"CROSS JOIN {above}"
        ctes.append(f"""c{k} AS (SELECT * FROM (SELECT {keys}, sum(cap)::HUGEINT AS cap, {_weight_sql(level)}::HUGEINT AS weight
            FROM leaf GROUP BY {keys}) {link}),
          f{k} AS (SELECT *, cap * (sum(weight) OVER ({by}) - coalesce(sum(weight) OVER o, 0))
              <= weight * (budget - coalesce(sum(cap) OVER o, 0)) AS full_ FROM c{k}
            WINDOW o AS ({by} ORDER BY cap::DOUBLE / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
          s{k} AS (SELECT {keys}, (CASE WHEN full_ THEN cap ELSE
              (weight::HUGEINT * (budget - coalesce(sum(cap) FILTER (WHERE full_) OVER w, 0))::HUGEINT)
              // (sum(weight) FILTER (WHERE NOT full_) OVER w)::HUGEINT END)::BIGINT AS budget
            FROM f{k} WINDOW w AS ({by}))""")
        above = f"s{k}"
    ctes.append(f"""e AS (SELECT d.*, s2.budget AS share, s2.budget // leaf.tokens AS whole, unnest(range(0, s2.budget // leaf.tokens + 1)) AS epoch
        FROM d JOIN leaf USING (domain, lang, source) JOIN s2 USING (domain, lang, source) WHERE n > 0),
      r AS (SELECT *, share - epoch * (sum(n) OVER (PARTITION BY domain, lang, source, epoch)) AS rest,
          sum(n) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5(concat_ws(':', '{SEED}', epoch, doc_id)), doc_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS start_ FROM e)""")
    return f"""WITH {', '.join(ctes)}
      SELECT doc_id, domain, lang, source, epoch::BIGINT AS epoch, n AS n_tokens, least(n, rest - start_)::BIGINT AS taken_tokens
      FROM r WHERE start_ < rest"""


@query("op1_mixing", _mixing_sql())
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to the target weights: which, in which epoch, and how many of its tokens."""
    return mixture(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "domain", "lang", "source", "epoch", "n_tokens", "taken_tokens")


def chat_events(conversations: DataFrame) -> DataFrame:
    """An event log whose final messages are the rows of ``conversations``, by turn.

    Each message starts with a draft that is regenerated, arrives in two deltas, and every
    third one gets a stray delta that an edit takes back.  Rows of one turn keep apart.
    """
    said = "<|im_end|><|im_start|>assistant ok"
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"),
                       (F.row_number().over(order) - 1).cast("long").alias("message"))
    half = F.floor(F.length("text") / 2).cast("int")
    steps = [("delta", F.concat(F.lit("draft "), F.substring("text", 1, 5))), ("regenerate", F.lit(None).cast("string")),
             ("delta", F.substring("text", F.lit(1), half)), ("delta", F.substring("text", half + 1, F.length("text")))]
    late = [("delta", F.lit(" stray")), ("edit", F.col("text"))]
    event = lambda k, kind, text: F.struct((F.col("message") * 8 + k).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    log = F.array(*[event(k, *s) for k, s in enumerate(steps)])
    more = F.array(*[event(k + len(steps), *s) for k, s in enumerate(late)])
    log = F.when(F.col("message") % 3 == 0, F.concat(log, more)).otherwise(log)
    return rows.select("conv_id", "message", "role", F.explode(log).alias("e")).select(
        "conv_id", "e.seq", "message", "role", "e.kind", "e.text")


@query("op2_chat", """
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
    m AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
      sum(length('<|im_start|>') + length('<|im_end|>') + 2
        + length(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|'), chr(10), chr(92) || 'n'))
        + length(replace(replace(text, chr(92), chr(92) || chr(92)), '<|', '<' || chr(92) || '|')))::BIGINT AS formatted_chars
    FROM m GROUP BY conv_id""")
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations folded from their event log, rendered, and read back as digests."""
    return chat.digests(chat.format_chats(chat_events(read_table(spark, sf_dir, "conversations"))))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class and its number of links (five-word grams, 0.8)."""
    return jaccard_join.jaccard_join(read_table(spark, sf_dir, "documents"))


def _url_sql() -> str:
    rules = ", ".join(f"('{r}', '.{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}', {len(r)})" for r, v in url_filter.LIST_RULES)
    odd = " OR ".join(f"host LIKE '{g.replace('*', '%')}'" for g in url_filter.HOST_GLOBS)
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH p AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '(?s)^([^?#]*)', 1)
        ELSE '' END AS rest FROM pages),
    q AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), '{up}', '{low}') AS host, regexp_extract(rest, '(?s)/.*$') AS path FROM p),
    rules(rule, tail, start_, verdict, size) AS (VALUES {rules}),
    hit AS (SELECT page_id, host, path, arg_max(rule, size) AS rule, arg_max(verdict, size) AS verdict
      FROM q JOIN rules ON ends_with('.' || host, tail) AND starts_with(path, start_) GROUP BY ALL)
    SELECT q.page_id, q.host, q.path, hit.rule, coalesce(hit.verdict, CASE WHEN {odd.replace('host', 'q.host')} THEN 'block' ELSE 'allow' END) AS verdict
    FROM q LEFT JOIN hit USING (page_id, host, path)"""


@query("op4_url_filter", _url_sql())
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"))


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality_rules.judge(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line with a word: the group of alike lines it is in, and whether it is kept."""
    judged = line_dedup.judge_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "line_no", "g1", "g2", "kept")


@query("op7_fingerprint")
def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.edited_fingerprints(read_table(spark, sf_dir, "documents"))


@query("op8_html_extract")
def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of both views and together, and the verdict, for every document."""
    return quality_classifier.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document, and its place in a sequence of 4096 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def _repair_sql() -> str:
    """The damage, the faults, costs from the last row to the first, then the edits in order."""
    bit = "xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END)"
    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda b, z: {bit})), 4294967295)"""
    keep = {"e": "CASE initial WHEN 's' THEN s WHEN 'u' THEN u END", "s": "CASE initial WHEN 'u' THEN u END",
            "u": "CASE initial WHEN 'a' THEN a END", "a": "CASE initial WHEN 'u' THEN u END"}
    after = {"e": "u", "s": "u", "u": "a", "a": "u"}
    options = ", ".join(f"2 + {q} AS d{q}, CASE WHEN NOT gone THEN extra + {keep[q]} END AS k{q}, "
                        f"CASE WHEN NOT gone THEN 1 + extra + {after[q]} END AS r{q}" for q in "esua")
    best = ", ".join(f"least(d{q}, k{q}, r{q}) AS t{q}" for q in "esua")
    least = "least(ta, 5 + tu) AS na, least(tu, 5 + ta) AS nu, least(te, 5 + tu, 10 + ta) AS ne, least(ts, 5 + tu, 10 + ta) AS ns"
    letter = " || ".join(f"CASE n{q} WHEN d{q} THEN 'D' WHEN 5 + n{after[q]} THEN 'I' WHEN k{q} THEN 'K' ELSE 'R' END" for q in "esua")
    return f"""
    WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    k AS (SELECT *, {crc} % 20 AS kind FROM c),
    d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
    f AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
    g AS (SELECT *, left(role, 1) AS initial, bare = '' OR again AS gone,
        CASE WHEN bare = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS above FROM f),
    n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (above IS NOT NULL AND above || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
    b AS (SELECT conv_id, n + 1 AS i, 0 AS e, 10 AS s, 5 AS u, 0 AS a, 'DIID' AS letters FROM n
      UNION ALL
      SELECT conv_id, i, ne, ns, nu, na, {letter}
      FROM (SELECT *, {least} FROM (SELECT *, {best} FROM (SELECT g.conv_id, g.i, {options}
        FROM b JOIN (SELECT *, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS extra FROM g) g
          ON g.conv_id IS NOT DISTINCT FROM b.conv_id AND g.i = b.i - 1)))),
    w AS (SELECT conv_id, 1::BIGINT AS i, 1 AS state, '' AS audit, '' AS said FROM n
      UNION ALL
      SELECT conv_id, CASE letter WHEN 'I' THEN i ELSE i + 1 END,
        CASE letter WHEN 'D' THEN state WHEN 'K' THEN CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END
          ELSE CASE state WHEN 3 THEN 4 ELSE 3 END END, audit || letter,
        said || CASE letter WHEN 'D' THEN '' ELSE CASE said WHEN '' THEN '' ELSE chr(10) END || CASE letter WHEN 'K' THEN role
          ELSE CASE state WHEN 3 THEN 'assistant' ELSE 'user' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END END
      FROM (SELECT w.*, substr(b.letters, w.state, 1) AS letter, g.role, g.text, g.initial
        FROM w JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i
        LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.i = w.i
        JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND NOT (w.i > n.n AND w.state IN (1, 4)))),
    z AS (SELECT w.conv_id, n.gaps, n.blank, n.duplicate, n.truncated, n.illegal, b.e AS cost, w.audit, sha256(w.said) AS repaired_sha256
      FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i > n.n AND w.state IN (1, 4)
      JOIN b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = 1)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
      coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
      coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM o.conv_id"""


@query("op11_structure_repair", _repair_sql())
def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation, after the contract's damage."""
    return structure_repair.audit_damaged(read_table(spark, sf_dir, "conversations"))


@query("op12_lm_scoring")
def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under a Kneser-Ney model of six sevenths of them."""
    return ngram_model.held_out_scores(read_table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", """
    WITH q AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(coalesce(x, 0))))),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= 5""")
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, some labels being wrong on purpose."""
    vectors = hard_negatives.quantised(read_table(spark, sf_dir, "embeddings"))
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", noisy), F.col("vec_id") % 100 == 0)
