"""Content jobs: ordered append (39), sparse patch (40), insert-if-absent (41), status
transitions (42), delete by key (46)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MATERIAL_CATEGORIES
from ..functions.keys import flag_exists, flag_first, latest_per_key
from ..functions.sequence import sequence_number
from ..functions.text import leading_int, trimmed, truthy


def _on(left: DataFrame, right: DataFrame, pairs) -> Column:
    return reduce(lambda a, b: a & b, [left[l] == right[r] for l, r in pairs])


def append_ordered(batch: DataFrame, existing: DataFrame, text_col: str,
                   parent: str | None = None, allowed_parents: tuple | None = None,
                   parents: DataFrame | None = None, order: tuple[str, str] = ("ts", "request_id"),
                   optional: tuple[str, ...] = (), flags: tuple[str, ...] = ()) -> DataFrame:
    """Item 39. Number new rows after the current maximum ``sort_order`` of their parent.

    ``batch``: request_id, ts, [parent], text column (+ extra columns kept as is).  The
    text is trimmed and required (``text_required``); with ``allowed_parents`` the parent
    must be one of them (``bad_parent``, e.g. the five material categories); with
    ``parents`` (column ``id``) it must be a row of that table (``parent_not_found``, the
    foreign key of topics and videos; a NULL parent is not found).  Accepted
    rows get ``sort_order = coalesce(max existing in parent, 0) + n``, n = 1, 2, ... in
    batch order within the parent (for lessons, ``parent=None``: the whole table).
    The numbering is skew-safe (range-partitioned, see ``functions.sequence``) and runs
    over the batch only, never over the table.  Returns every request with
    ``sort_order`` (NULL when rejected) and ``reason``.  ``optional`` text columns are
    trimmed with blank -> NULL; ``flags`` become booleans (``functions.text.truthy``).
    """
    b = batch.withColumn(text_col, trimmed(F.col(text_col)))
    for c in optional:
        b = b.withColumn(c, F.nullif(trimmed(F.col(c)), F.lit("")))
    for c in flags:
        b = b.withColumn(c, truthy(F.col(c), dict(batch.dtypes)[c]))
    reason = F.when(F.coalesce(F.col(text_col), F.lit("")) == "", F.lit("text_required"))
    if allowed_parents is not None:
        reason = reason.when(~F.coalesce(F.col(parent).isin(*allowed_parents), F.lit(False)),
                             F.lit("bad_parent"))
    if parents is not None:
        b = flag_exists(b, parents, parent, "id", "_known")
        reason = reason.when(~F.col("_known"), F.lit("parent_not_found"))
    b = b.withColumn("reason", reason).drop("_known")
    keys = [parent] if parent else []
    ok = b.where(F.col("reason").isNull())
    numbered = sequence_number(ok, keys, list(order), "_n")
    if parent:
        top = existing.groupBy(F.col(parent).alias("_par")).agg(F.max("sort_order").alias("_max"))
        numbered = numbered.join(top, numbered[parent] == top["_par"], "left").drop("_par")
    else:
        top = existing.agg(F.max("sort_order").alias("_max"))
        numbered = numbered.crossJoin(top)
    numbered = numbered.select("request_id", (F.coalesce(F.col("_max"), F.lit(0)) + F.col("_n"))
                               .cast("int").alias("sort_order"))
    return b.join(numbered, "request_id", "left")


def append_materials(batch: DataFrame, materials: DataFrame) -> DataFrame:
    """Item 39 for materials: parent = category, one of the five categories."""
    return append_ordered(batch, materials, "title", "category", MATERIAL_CATEGORIES)


def sparse_patch(patches: DataFrame, table: DataFrame, key: str, columns: dict[str, str],
                 order: tuple[str, str] = ("ts", "patch_id"), max_len: dict | None = None):
    """Item 40. Apply partial updates; returns (new table, rejects).

    ``patches``: patch_id, ts, key, and for each patchable column ``c`` the value ``c``
    and a flag ``set_c`` (was the field supplied).  ``columns`` maps a column to its
    kind: ``required`` (trimmed; blank rejected, as for a user name), ``text`` (trimmed, a
    blank one stored as ``''``, as for titles), ``optional`` (trimmed, blank becomes NULL),
    ``int`` (the leading whole number), ``bool`` (``functions.text.truthy``).
    Rejected: ``empty`` (no field supplied), ``not_found`` (unknown key), ``blank``
    (required text empty, or ``text`` supplied as NULL), ``bad_number`` (no leading whole
    number, or beyond int), ``too_long`` (over ``max_len``).  Accepted patches apply in
    ``order``: per column, the last supplied value wins.
    """
    max_len = max_len or {}
    p = patches
    any_set = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"set_{c}"), F.lit(False))
                                          for c in columns])
    for c, kind in columns.items():
        v = F.col(c)
        if kind in ("required", "text", "optional"):
            v = trimmed(v)
        if kind == "optional":
            v = F.nullif(v, F.lit(""))
        if kind == "int":
            v = leading_int(v)
        if kind == "bool":
            v = truthy(v, dict(patches.dtypes)[c])
        p = p.withColumn(c, v)
    known = table.select(F.col(key).alias("_k")).distinct()
    p = p.join(known, p[key] == known["_k"], "left")
    reason = F.when(~any_set, F.lit("empty")).when(F.col("_k").isNull(), F.lit("not_found"))
    for c, kind in columns.items():
        supplied = F.coalesce(F.col(f"set_{c}"), F.lit(False))
        if kind == "required":
            reason = reason.when(supplied & (F.coalesce(F.col(c), F.lit("")) == ""), F.lit("blank"))
        if kind == "text":
            reason = reason.when(supplied & F.col(c).isNull(), F.lit("blank"))
        if kind == "int":
            reason = reason.when(supplied & F.col(c).isNull(), F.lit("bad_number"))
        if c in max_len:
            reason = reason.when(supplied & (F.length(F.col(c)) > max_len[c]), F.lit("too_long"))
    p = p.withColumn("reason", reason)
    rejects = p.where(F.col("reason").isNotNull()).select("patch_id", key, "reason")
    ok = p.where(F.col("reason").isNull())
    aggs = []
    for c in columns:
        # Latest supplying patch per column; the value is wrapped in a struct so that a
        # supplied NULL (blank optional text) differs from "not supplied".
        when_set = F.when(F.coalesce(F.col(f"set_{c}"), F.lit(False)),
                          F.struct(F.col(order[0]), F.col(order[1])))
        aggs.append(F.max_by(F.struct(F.col(c).alias("v")), when_set).alias(f"_p_{c}"))
    merged = ok.groupBy(F.col(key).alias("_pk")).agg(*aggs)
    t = table.join(merged, table[key] == merged["_pk"], "left")
    out = t.select(*[F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v"))
                     .otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c)
                     if c in columns else F.col(c) for c in table.columns])
    return out, rejects


def insert_if_absent(batch: DataFrame, table: DataFrame, key: list[str],
                     order: tuple[str, str] = ("ts", "request_id")) -> DataFrame:
    """Item 41. ``INSERT ... ON CONFLICT (key) DO NOTHING`` for a batch.

    Rows whose key already exists are dropped; within the batch the first arrival per
    key wins.  Returns the new table (existing rows plus accepted batch rows).
    """
    existing = table.select(*[F.col(k).alias(f"_e_{k}") for k in key]).distinct()
    b = batch.join(existing, _on(batch, existing, [(k, f"_e_{k}") for k in key]), "left_anti")
    b = flag_first(b, key, list(order), "_first").where("_first")
    return table.unionByName(b.select(*table.columns))


def status_transition(updates: DataFrame, table: DataFrame, key: str, column: str,
                      allowed: tuple, as_of, stamps: dict[str, Column] | None = None,
                      order: tuple[str, str] = ("ts", "update_id")):
    """Item 42. Enum-checked update of one column with conditional stamps.

    ``updates``: update_id, ts, key, ``column`` (new value) and any columns the stamps
    read (e.g. ``actor_id``).  Values outside ``allowed`` are rejected (``bad_value``),
    as are unknown keys (``not_found``).  Per key the latest valid update wins; each
    ``stamps`` entry sets a column on updated rows (expressions may use ``as_of`` via
    ``acadia.functions.filters.ts_lit`` and the update's columns, prefixed ``u_``).
    Returns (new table, rejects).
    """
    known = table.select(F.col(key).alias("_k")).distinct()
    u = updates.join(known, updates[key] == known["_k"], "left")
    reason = (F.when(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)), F.lit("bad_value"))
              .when(F.col("_k").isNull(), F.lit("not_found")))
    u = u.withColumn("reason", reason)
    rejects = u.where(F.col("reason").isNotNull()).select("update_id", key, column, "reason")
    last = latest_per_key(u.where(F.col("reason").isNull()), [key],
                          [F.col(order[0]).desc(), F.col(order[1]).desc()])
    last = last.select(*[F.col(c).alias(f"u_{c}") for c in updates.columns])
    t = table.join(last, table[key] == last[f"u_{key}"], "left")
    hit = F.col(f"u_{key}").isNotNull()
    stamps = dict(stamps or {})
    cols = list(table.columns) + [c for c in stamps if c not in table.columns]
    out = []
    for c in cols:
        if c == column:
            out.append(F.when(hit, F.col(f"u_{column}")).otherwise(F.col(c)).alias(c))
        elif c in stamps:
            old = F.col(c) if c in table.columns else F.lit(None)
            out.append(F.when(hit, stamps[c]).otherwise(old).alias(c))
        else:
            out.append(F.col(c))
    return t.select(*out), rejects


def delete_by_key(ids: DataFrame, table: DataFrame, key: str = "id",
                  children: dict[str, tuple[DataFrame, str]] | None = None,
                  blockers: dict[str, tuple[DataFrame, str]] | None = None):
    """Item 46. Delete rows by key with cascades and blockers.

    ``ids``: (id).  A requested id is ``not_found`` when absent, ``blocked`` when a
    blocker table references it (FK without cascade, e.g. progress -> lesson).  Deleted
    rows take their cascading children with them.  Returns (new table, new children
    dict, report of (id, outcome)).
    """
    req = ids.select(F.col("id").alias("_id")).distinct()
    present = table.select(F.col(key).alias("_t")).distinct()
    r = req.join(present, req["_id"] == present["_t"], "left")
    blocked = None
    for name, (df, fk) in (blockers or {}).items():
        refs = df.select(F.col(fk).alias(f"_b_{name}")).distinct()
        r = r.join(refs, r["_id"] == refs[f"_b_{name}"], "left")
        hit = F.col(f"_b_{name}").isNotNull()
        blocked = hit if blocked is None else blocked | hit
    outcome = F.when(F.col("_t").isNull(), F.lit("not_found"))
    if blocked is not None:
        outcome = outcome.when(blocked, F.lit("blocked"))
    report = r.select(F.col("_id").alias("id"), outcome.otherwise(F.lit("deleted")).alias("outcome"))
    gone = report.where(F.col("outcome") == "deleted").select(F.col("id").alias("_gone"))
    new_table = table.join(gone, table[key] == gone["_gone"], "left_anti")
    new_children = {name: df.join(gone, df[fk] == gone["_gone"], "left_anti")
                    for name, (df, fk) in (children or {}).items()}
    return new_table, new_children, report

