"""Mixing sources to target weights, in DataFrame functions only.

Documents hang on a tree: domain, language, source (the leaf).  The token budget runs down
the tree: each node deals its budget to its children by weight, a child that cannot use its
share (all tokens below it, ``max_epochs`` times) leaves the rest to its siblings, and only
what a whole family cannot use goes to the family's siblings.  Each leaf then reads its
documents in seeded epochs, in a fresh random order each time, and takes the prefix of that
stream that holds its budget; the document at the cut is cut at a token.

A token is a run of characters other than space and TAB to CR.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import sequence_number
from ._store import staged

LEVELS = ["domain", "lang", "source"]
DOCS_PER_BUCKET = 512
TOKEN = r"[^ \t-\r]+"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("long")


def first_tokens(text: Column, n: Column) -> Column:
    """``text`` up to the end of its ``n``-th token, white space before it untouched."""
    pieces = F.split(text, r"(?<=[ \t-\r])(?=[^ \t-\r])")  # a token each, but for a blank first one
    return F.transform(F.array(pieces), lambda p: F.regexp_replace(F.array_join(F.slice(
        p, F.lit(1), n.cast("int") + F.when(F.regexp_like(p[0], F.lit(TOKEN)), 0).otherwise(1)), ""), r"[ \t-\r]+\z", ""))[0]


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    """The level's weight of a node: as given by its name, else 1."""
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out


def _deal(nodes: DataFrame, parents: list[str], level: str) -> DataFrame:
    """Adds ``share`` to ``nodes(parents, level, weight, cap, budget)``: the parent's budget by
    weight, no child over its cap, whole tokens (what rounding leaves is not dealt).

    Taken by rising cap per weight, a child is full if its cap is within its part of what the
    children before it leave; the children that are not full split the rest by weight.
    """
    family = Window.partitionBy(*[F.col(p) for p in parents]) if parents else Window.partitionBy(F.lit(0))
    past = family.orderBy(F.expr("cap / nullif(weight, 0)").asc_nulls_last(), level).rowsBetween(
        Window.unboundedPreceding, -1)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(past), F.lit(0))
    heavy = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(past), F.lit(0))
    big = "decimal(38,0)"
    full = F.col("cap").cast(big) * heavy.cast(big) <= F.col("weight").cast(big) * left.cast(big)
    nodes = nodes.withColumn("_full", full)
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(family), F.lit(0))
    load = F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(family), F.lit(0))
    nodes = nodes.withColumns({"_rest": F.greatest(rest, F.lit(0)), "_load": load})
    part = F.expr(f"cast(weight as {big}) * cast(_rest as {big}) div cast(nullif(_load, 0) as {big})")
    share = F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.coalesce(part, F.lit(0))))
    return nodes.withColumn("share", share.cast("long")).drop("_full", "_rest", "_load")


def leaf_budgets(leaves: DataFrame, weights: dict[str, dict[str, int]], budget: int | None,
                 fraction: float, max_epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, docs, tokens)`` with ``share``, the tokens each may give."""
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first().tokens
    budget = int(total * fraction) if budget is None else int(budget)
    w = {level: _weight(level, weights) for level in LEVELS}
    none = (w["domain"] == 0) | (w["lang"] == 0) | (w["source"] == 0)
    leaves = leaves.withColumn("cap", F.when(none, 0).otherwise(F.col("tokens") * max_epochs).cast("long"))
    above, parents = None, []
    for level in LEVELS:
        nodes = leaves.groupBy(*parents, level).agg(F.sum("cap").alias("cap")).withColumn("weight", w[level].cast("long"))
        if above is None:
            nodes = nodes.withColumn("budget", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(above, parents)
        dealt = _deal(nodes, parents, level)
        parents = parents + [level]
        above = dealt.select(*parents, F.col("share").alias("budget"))
    return leaves.drop("cap").join(above.withColumnRenamed("budget", "share"), LEVELS)


def _order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: md5 of seed, epoch and doc_id, in hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), doc_id.cast("string")).cast("binary"))


def _cuts(slim: DataFrame, budgets: DataFrame, seed: int) -> DataFrame:
    """Per leaf with a partial epoch: the document that crosses its end, and what it gives.

    Prefix sums run over buckets of the order key first; only the bucket that holds the cut
    is put in order, so a leaf with a third of all documents is never in one task.
    """
    part = slim.join(budgets.where("rest > 0").select(*LEVELS, "docs", "full", "rest"), LEVELS)
    key = _order_key(seed, F.col("full"), F.col("doc_id"))
    buckets = F.ceil(F.col("docs") / DOCS_PER_BUCKET)
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2.0 ** 32
    part = part.withColumn("key", key).withColumn("bucket", F.floor(spot * buckets))
    sums = part.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("held"), F.max("rest").alias("rest"))
    order = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("held").over(order), F.lit(0)))
    at = staged(sums.where("start < rest AND start + held >= rest").select(*LEVELS, "bucket", "start"), "mix-cut")
    inside = part.join(at, [*LEVELS, "bucket"])
    line = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "n_tokens", "row_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("end", F.col("start") + F.sum("n_tokens").over(line))
    equal = Window.partitionBy(*LEVELS, "key", "doc_id", "n_tokens", "row_key")
    before = F.col("end") - F.col("n_tokens")
    inside = inside.withColumns({"copies": F.count("*").over(equal),
                                 "nth": ((before - F.min(before).over(equal)) / F.col("n_tokens")).cast("long")})
    cross = inside.where("end >= rest AND end - n_tokens < rest")
    return cross.groupBy(*LEVELS).agg(F.min(F.struct(
        "end", F.struct("key", "doc_id", "n_tokens", "row_key").alias("at"),
        (F.col("n_tokens") - F.col("end") + F.col("rest")).alias("taken"), "nth", "copies")).alias("c")).select(
        *LEVELS, F.col("c.at").alias("cut"), F.col("c.taken").alias("cut_taken"), F.col("c.nth").alias("cut_nth"), "c.copies")


def _numbered(rows: DataFrame, plan: DataFrame, at_cut: Column) -> DataFrame:
    """``rows`` with ``_nth``: the number, from 0, of each row at its leaf's cut among its equals."""
    if plan.where("copies > 1").isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    at_cut = F.coalesce(at_cut, F.lit(False))
    equal = rows.where(at_cut).withColumns({"_any": F.monotonically_increasing_id(), **{f"_by_{c}": F.col(f"_leaf.{c}") for c in LEVELS}})
    equal = sequence_number(equal, [f"_by_{c}" for c in LEVELS], ["_any"], "_nth")
    equal = equal.withColumn("_nth", F.col("_nth") - 1).select(*rows.columns, "_nth")
    return rows.where(~at_cut).withColumn("_nth", F.lit(0).cast("long")).unionByName(equal)


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: int | None = None,
        fraction: float = 0.5, max_epochs: int = 4, seed: int = 17) -> DataFrame:
    """``docs(doc_id, text, lang, source, ...)`` mixed to ``weights``.

    ``weights[level][name]`` (``level``: domain, lang, source) are whole numbers; a name
    without one weighs 1, and 0 takes nothing.  ``domain`` derives the domain of a row.  The
    budget is ``budget`` tokens, else ``fraction`` of all tokens.  The columns of ``docs``
    return, once per epoch that takes the row, with ``domain``, ``epoch``, ``n_tokens`` and
    ``taken_tokens`` added; ``text`` is cut where only its first tokens are taken.

    A null domain, language or source is the node ''.  Rows without a token (null, empty or
    blank text) give nothing and are left out.  Rows that repeat a doc_id are separate rows
    of the stream.  An empty table, or a budget of 0, gives no rows.  Columns of ``docs``
    named like the added ones are replaced.
    """
    added = ["domain", "epoch", "n_tokens", "taken_tokens"]
    names = [c for c in docs.columns if c not in added]
    leaf = [F.coalesce(domain.cast("string"), F.lit("")).alias("domain"),
            F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")]
    tokens = n_tokens(F.col("text"))
    docs = docs.where(F.regexp_like("text", F.lit(TOKEN)))
    slim = staged(docs.select("doc_id", *leaf, tokens.alias("n_tokens"), F.xxhash64("text").alias("row_key")), "mix-rows")
    leaves = staged(slim.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "mix-leaves")
    budgets = leaf_budgets(leaves, weights, budget, fraction, max_epochs)
    budgets = staged(budgets.select("*", F.expr("share div tokens").alias("full"), F.expr("share % tokens").alias("rest")), "mix-budgets")
    plan = staged(budgets.join(_cuts(slim, budgets, seed), LEVELS, "left")
                  .select(*[F.col(c).alias(f"_{c}") for c in LEVELS], "full", "rest", "cut", "cut_taken", "cut_nth", "copies"), "mix-plan")

    # The caller's columns travel in one struct, so that none of them clashes with the plan's.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.struct(*leaf).alias("_leaf"), tokens.alias("n_tokens"))
    on = [F.col(f"_leaf.{c}") == F.col(f"_{c}") for c in LEVELS]
    rows = rows.join(plan, on)
    text = F.col("_doc.text")
    place = F.struct(_order_key(seed, F.col("full"), F.col("_doc.doc_id")).alias("key"), F.col("_doc.doc_id").alias("doc_id"),
                     F.col("n_tokens").alias("n_tokens"), F.xxhash64(text).alias("row_key"))
    rows = _numbered(rows, plan, place.eqNullSafe(F.col("cut")))
    at_cut = place.eqNullSafe(F.col("cut"))
    given = F.when(~at_cut | (F.col("_nth") < F.col("cut_nth")), F.col("n_tokens")).when(F.col("_nth") == F.col("cut_nth"), F.col("cut_taken"))
    whole = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda e: F.struct(
        e.alias("epoch"), F.col("n_tokens").alias("taken")))).otherwise(F.expr("array()"))
    last = F.when((F.col("rest") > 0) & (place <= F.col("cut")) & given.isNotNull(), F.array(F.struct(
        F.col("full").alias("epoch"), given.alias("taken")))).otherwise(F.expr("array()"))
    kind = "array<struct<epoch:bigint,taken:bigint>>"
    rows = rows.withColumn("_e", F.explode(F.concat(whole.cast(kind), last.cast(kind))))
    text = F.when(F.col("_e.taken") < F.col("n_tokens"), first_tokens(text, F.col("_e.taken"))).otherwise(text)
    return rows.select(*[text.alias("text") if c == "text" else F.col(f"_doc.`{c}`").alias(c) for c in names],
                       F.col("_leaf.domain").alias("domain"), F.col("_e.epoch").alias("epoch"), "n_tokens",
                       F.col("_e.taken").alias("taken_tokens"))
