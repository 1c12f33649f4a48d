"""Fuzzy line dedup, in DataFrame operations.

Every line of every text becomes its set of character shingles: all runs of ``SHINGLE``
characters, one from each character on, overlapping; a shorter line is one shingle.  Lines
with equal texts form one class.  A class is signed with ``BANDS * ROWS`` MinHash minima;
classes that agree on a band are candidates, the Jaccard similarity of the whole sets
decides, and connected classes form a component, of which the first line is kept.

Lines are cut in UTF-32, where a shingle is found without counting characters.  ``STEP``
shingles make one row for the minima's aggregate, which folds them before anything is
shuffled; the sets of two lines are built where the lines meet.  What is stored and shuffled
are texts of lines, minima and band keys, never shingles.

Within a band the members are held against the band's most frequent class first.  Members
outside of the band's main component then meet all members of other components, in blocks
of bounded size, one join key per pair of blocks, so a large group of near copies neither
stores a row for each of its pairs nor meets in one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._components import components
from ._line_reference import _verify  # noqa: F401
from ._store import staged

SHINGLE = 12
STEP = 8
BANDS = 8
ROWS = 3
BAND_NAMES = [f"band_{b}" for b in range(BANDS)]
MASKS = np.random.default_rng(7).integers(1, 2**63, BANDS).tolist()
SHIFTS = [0, 21, 42]  # a hash is ordered by its upper, middle and lower bits: three functions
BLOCK_LINES = 512
BLOCK_CHARS = 1_000_000
BROADCAST_KEYS = 2_000_000


def _shingle(code: Column, at: Column) -> Column:
    """Hash of the shingle from character ``at`` on; ``code`` is the line in UTF-32."""
    return F.xxhash64(F.substring(code, at * 4 + 1, F.lit(4 * SHINGLE)))


def _last(code: Column) -> Column:
    """Where the last shingle starts."""
    return F.greatest(F.shiftright(F.length(code), 2) - SHINGLE, F.lit(0))


def shingle_set(line: Column) -> Column:
    """Hashes of the different shingles of a line.  An empty line has one as well."""
    own = lambda code: F.array_distinct(F.transform(F.sequence(F.lit(0), _last(code)), lambda at: _shingle(code, at)))
    return F.transform(F.array(F.encode(line, "UTF-32")), own)[0]


def _alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether the Jaccard similarity of two sets reaches the threshold."""
    sizes = F.size(a) + F.size(b)
    possible = threshold * F.greatest(F.size(a), F.size(b)) <= F.least(F.size(a), F.size(b)) + 1e-9
    return possible & ((1 + threshold) * F.size(F.array_intersect(a, b)) >= threshold * sizes - 1e-9)


def _rehashed(h: np.ndarray) -> np.ndarray:
    """``xxhash64`` of bigints."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    x = turn((turn(h * p2, 31) * p1) ^ (np.uint64(42 + 8) + p5), 27) * p1 + p4
    x = (x ^ x >> np.uint64(33)) * p2
    x = (x ^ x >> np.uint64(29)) * p3
    return x ^ x >> np.uint64(32)


def band_keys(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One key per row and band, from the minima that ``_signatures`` takes of the row's hashes
    (in numpy, to measure what the bands find)."""
    keys = np.empty((len(cuts) - 1, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        keys[:, b] = b + 1
        own = _rehashed(hashes ^ np.uint64(MASKS[b]))
        for shift in SHIFTS:
            least = (np.minimum.reduceat((own << np.uint64(shift)).view(np.int64), cuts[:-1]) >> 32).view(np.uint64)
            keys[:, b] = W.mix(keys[:, b] * np.uint64(0x9E3779B97F4A7C15) + least)
    return keys


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, line_no, line, c1, c2``, one row per line that has a word."""
    lines = docs.select(F.col("doc_id"), "row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.regexp_like("line", F.lit(r"\S")))
    return lines.select("doc_id", "row_key", "line_no", "line", F.xxhash64("line").alias("c1"), F.xxhash64(F.lit(1), "line").alias("c2"))


def _signatures(lines: DataFrame) -> DataFrame:
    """Per class: its number of lines and one key per band."""
    code = lines.select("c1", "c2", F.encode("line", "UTF-32").alias("code"))
    code = code.select("c1", "c2", "code", _last(F.col("code")).alias("last"))
    rows = code.select("c1", "c2", "code", "last", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(STEP))).alias("at"))
    # Minima of 32 bits are shuffled.  Beyond the last shingle it is taken again, which changes no minimum.
    rows = rows.select("c1", "c2", "at", *[_shingle(F.col("code"), F.least(F.col("at") + j, F.col("last"))).alias(f"h_{j}") for j in range(STEP)])
    hashed = lambda b, j: F.xxhash64(F.col(f"h_{j}").bitwiseXOR(F.lit(MASKS[b])))
    least = {f"m{b}_{shift}": F.least(*[F.shiftleft(hashed(b, j), shift) if shift else hashed(b, j) for j in range(STEP)])
             for b in range(BANDS) for shift in SHIFTS}
    minima = rows.groupBy("c1", "c2").agg(F.sum(F.when(F.col("at") == 0, 1).otherwise(0)).alias("n"), *[F.min(F.shiftright(x, 32)).alias(m) for m, x in least.items()])
    keys = [F.xxhash64(F.lit(b), *[f"m{b}_{shift}" for shift in SHIFTS]).alias(name) for b, name in enumerate(BAND_NAMES)]
    return minima.select("c1", "c2", "n", *keys)


def _small(keys: DataFrame) -> DataFrame:
    """``keys`` marked for broadcast if they are few enough; else the join shuffles."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _links(classes: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Edges ``(a, b)`` between classes (structs of c1, c2) whose lines are alike."""
    cls = F.struct("c1", "c2")
    band = classes.select("c1", "c2", "n", F.explode(F.array(*BAND_NAMES)).alias("band"))
    met = staged(band.groupBy("band").agg(F.count("*").alias("met")).where("met > 1").select("band"), "line-met")
    shared = band.join(_small(met), "band", "left_semi").select("band", "n", cls.alias("cls"))
    head = shared.groupBy("band").agg(F.max(F.struct("n", "cls")).alias("head")).select("band", F.col("head.cls").alias("head"))
    shared = staged(shared.join(head, "band").select("band", "cls", "head"), "line-bands")

    wanted = staged(shared.select("cls.c1", "cls.c2").distinct(), "line-wanted")
    texts = (lines.select("c1", "c2", "line").join(_small(wanted), ["c1", "c2"], "left_semi")
             .groupBy("c1", "c2").agg(F.first("line").alias("line")))
    texts = staged(texts.select(cls.alias("cls"), "line"), "line-texts")

    heads = texts.select(F.col("cls").alias("head"), F.col("line").alias("head_line"))
    pairs = shared.where("cls != head").select("cls", "head").distinct()
    near = _alike(F.col("set"), F.col("head_set"), threshold)
    star = pairs.join(texts, "cls").join(heads, "head").select("cls", "head", shingle_set(F.col("line")).alias("set"), shingle_set(F.col("head_line")).alias("head_set"))
    star = staged(star.where(near).select(F.col("cls").alias("a"), F.col("head").alias("b")), "line-star")

    group = components(star)
    member = (shared.join(group.withColumnRenamed("node", "cls"), "cls", "left")
              .withColumn("component", F.coalesce("component", "cls")))
    member = staged(member.join(texts.select("cls", F.length("line").alias("chars")), "cls"), "line-members")
    # The head has met every member: what is left are pairs of others, where two components met.
    main = member.groupBy("band").agg(F.max_by("component", F.col("cls") == F.col("head")).alias("main"))
    others = member.where("cls != head")
    split = others.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi")
    rest = others.join(main.join(split.select("band"), "band"), "band")
    minor = F.col("component") != F.col("main")
    many = lambda own: F.greatest(F.ceil(F.sum(F.when(own, 1)) / BLOCK_LINES), F.ceil(F.sum(F.when(own, F.col("chars"))) / BLOCK_CHARS)).cast("int")
    blocks = rest.groupBy("band").agg(many(minor).alias("minors"), many(F.lit(True)).alias("all"))
    dealt = rest.join(blocks, "band").select("band", "cls", "component", "minors", "all", minor.alias("own_minor"), F.explode(
        F.when(minor, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("minor"))
    own = F.pmod(F.xxhash64("cls"), F.when(F.col("minor"), F.col("minors")).otherwise(F.col("all"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("minor"), F.col("all")).otherwise(F.col("minors")) - 1))
    units = dealt.select("band", "cls", "component", "own_minor", "minor", own.alias("own"), other.alias("other")).select(
        "band", "cls", "component", "own_minor", "minor", F.when(F.col("minor"), F.col("own")).otherwise(F.col("other")).alias("i"),
        F.when(F.col("minor"), F.col("other")).otherwise(F.col("own")).alias("j"))
    known = texts.join(rest.groupBy("cls").agg(F.collect_set("band").alias("bands")), "cls")
    units = units.join(known, "cls").repartition("band", "i", "j").select(
        "band", "i", "j", "component", "own_minor", "minor", "bands", shingle_set(F.col("line")).alias("set"))
    one, two = units.where("minor").alias("x"), units.where("not minor").alias("y")
    # Two members of several bands are compared in one of them, and once where both are minor.
    met = one.join(two, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("band", "i", "j")]
                   + [F.col("x.component") != F.col("y.component"), ~F.col("y.own_minor") | (F.col("x.component") < F.col("y.component")),
                      F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band"), _alike(F.col("x.set"), F.col("y.set"), threshold)])
    # A component's name is one of its classes, so linking the names links the components.
    return star.union(met.select(F.col("x.component").alias("a"), F.col("y.component").alias("b")).distinct())


def line_groups(lines: DataFrame, threshold: float) -> DataFrame:
    """``c1, c2, g1, g2``: the component of each class that is linked to another or has several lines."""
    classes = staged(_signatures(lines), "line-classes")
    group = components(_links(classes, lines, threshold))
    group = group.select("node.c1", "node.c2", F.col("component.c1").alias("g1"), F.col("component.c2").alias("g2"))
    own = classes.where("n > 1").select("c1", "c2", F.col("c1").alias("g1"), F.col("c2").alias("g2"))
    return group.union(own.join(group, ["c1", "c2"], "left_anti"))


def judge_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``doc_id, row_key, line_no, c1, g1, kept`` for every line with a word.

    Two lines are alike if the Jaccard similarity of their shingle sets is at least
    ``threshold``.  Of each connected group of alike lines the first by (doc_id, row_key,
    line_no), nulls first, is kept.
    """
    docs = keyed(docs)
    lines = staged(lines_of(docs), "lines")
    groups = line_groups(lines, threshold)
    named = lines.select("doc_id", "row_key", "line_no", "c1", "c2").join(groups, ["c1", "c2"], "left")
    named = staged(named, "line-groups")
    alone = named.where("g1 is null").select("doc_id", "row_key", "line_no", F.col("c1").alias("g1"), F.col("c2").alias("g2"), F.lit(True).alias("kept"))
    named = named.where("g1 is not null").drop("c1", "c2")
    first = named.groupBy("g1", "g2").agg(F.min(F.struct("doc_id", "row_key", "line_no")).alias("f"))
    first = first.select("f.doc_id", "f.row_key", "f.line_no", F.lit(True).alias("first"))
    # Joined by line, not by group: a group may hold a third of all lines.
    same = named.alias("n").join(first.alias("f"), F.col("n.doc_id").eqNullSafe(F.col("f.doc_id"))
                                 & (F.col("n.row_key") == F.col("f.row_key")) & (F.col("n.line_no") == F.col("f.line_no")), "left")
    return alone.union(same.select("n.doc_id", "n.row_key", "n.line_no", "n.g1", "n.g2", F.coalesce("f.first", F.lit(False)).alias("kept")))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``row_key``, which tells rows of one doc_id but different texts apart."""
    return docs.withColumn("row_key", F.xxhash64("text"))


def line_dedup(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the lines that repeat, exactly or nearly, an earlier line anywhere.

    Lines are cut at LF.  Lines without a word are kept where they stand.  The columns of
    ``docs`` return unchanged but for ``text``; ``n_lines`` (lines with a word) and
    ``n_dropped`` are added.  A null text stays null with zero lines; an empty one stays
    empty.  Rows that repeat a doc_id are separate documents; rows equal in doc_id and text
    are copies whose lines are decided together.  An empty table gives no rows.  Columns of
    ``docs`` named like the added ones are replaced.
    """
    out = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    judged = judge_lines(docs.select("doc_id", "text"), threshold)
    dropped = judged.groupBy("doc_id", "row_key").agg(
        F.count_distinct("line_no").alias("_seen"), F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("_drop"))
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in out]).alias("d"), F.xxhash64("text").alias("_key"))
    both = left.join(dropped.alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.col("_key") == F.col("x.row_key")), "left")
    drop = F.col("x._drop")
    text = F.when(F.coalesce(F.size(drop), F.lit(0)) <= 0, F.col("d.text")).otherwise(
        F.transform(F.array(F.split(F.col("d.text"), "\n")), lambda lines: F.array_join(F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drop), lambda i: F.get(lines, i)), "\n"))[0])
    return both.select(*[text.alias("text") if c == "text" else F.col(f"d.`{c}`").alias(c) for c in out],
                       F.coalesce("x._seen", F.lit(0)).cast("long").alias("n_lines"),
                       F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))
