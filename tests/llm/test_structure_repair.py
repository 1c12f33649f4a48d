"""Structure repair against a brute-force search over edits, and its edge cases."""

import hashlib
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from acadia.llm import structure_repair
from acadia.llm.structure_repair import ENDS, SPACE, audit_damaged, audits, repair

ROWS = "conv_id long, turn long, role string, text string, cost string, fault int"


def _key(v):
    return " " if v is None else str(v)


def _damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{_key(conv)}:{_key(turn)}".encode()) % 20
        role, text = _key(role), _key(text)
        text = "" if kind == 1 else "".join(c for c in text if c not in ENDS) if kind == 2 else text
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, "user" if kind == 4 else role, text


def _audit(rows):
    """rows: (turn, role, text) of one conversation, in order."""
    seen, fault = set(), []
    for _, role, text in rows:
        bare = text.rstrip(SPACE)
        fault.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ENDS else None)
        seen.add((role, text))
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        other = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[other]
        if inserted < 2:
            c, a, t = best(i, other, inserted + 1)
            found.append((c + 5, "I" + a, (f"{name}:",) + t))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            found.append((c + 2, "D" + a, t))
            extra = 5 if fault[i] == "truncated" else 0
            if fault[i] in (None, "truncated"):
                if (state, role[:1]) in goes:
                    c, a, t = best(i + 1, goes[state, role[:1]], 0)
                    found.append((c + extra, "K" + a, (f"{role}:{text}",) + t))
                c, a, t = best(i + 1, other, 0)
                found.append((c + extra + 1, "R" + a, (f"{name}:{text}",) + t))
        return min(found) if found else (10**6, "", ())

    cost, audit, said = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def _expected(rows, damage=True):
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == conv]
        own = list(_damage(own)) if damage else [(c, t, _key(r), _key(x)) for c, t, r, x in own]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        out[conv] = _audit([r[1:] for r in own])
    return out


def _made(seed=5, convs=150):
    import random
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut", "so . ", "", " \t", None, "Ja.\n", "x"]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]
    rows = [(c, rnd.choice([None, *range(9)]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.6 else f"t{rnd.random()}.")
            for c in range(convs) for _ in range(rnd.randrange(0, 9))]
    return rows + [(None, 1, "user", "a."), (None, 2, "assistant", "b."), (-7, None, "user", "a."), (-7, None, "user", "a.")]


@pytest.mark.parametrize("damage", [True, False])
def test_audits_match_a_search_over_edits(spark, damage):
    rows = _made()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], ROWS)
    got = {r.conv_id: tuple(r)[1:] for r in (audit_damaged(table) if damage else audits(table)).collect()}
    want = _expected(rows, damage)
    assert got == want and {x for v in want.values() for x in v[6]} == set("DKR")  # two deletions are cheaper than an insertion


def test_insertions_where_they_are_cheapest(monkeypatch):
    monkeypatch.setattr(structure_repair, "DELETE", 20)
    monkeypatch.setattr(structure_repair, "REROLE", 20)
    structure_repair._step.cache_clear()
    told = structure_repair._Conversation()
    told.add([("2", "user", "b.", None), ("1", "user", "a.", None), ("0", "system", "s.", None)])
    edits = list(told.edits())
    structure_repair._step.cache_clear()
    assert [(e[0], e[2]) for e in edits] == [("K", "system"), ("K", "user"), ("I", "assistant"), ("K", "user"), ("I", "assistant")]
    assert told.least + told.costs[0] == sum(e[6] for e in edits) == 10


def test_edits_give_the_repaired_conversation(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "cut off"), (1, 2, "assistant", "Yes."), (1, 3, "assistant", "Yes.")]
    got = repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).orderBy("place").collect()
    assert "".join(r.edit for r in got) == "DDDD" or sum(r.cost for r in got) <= 8
    kept = [r.role[:1] for r in got if r.role is not None]
    assert "".join(kept) in ("", "ua") and [r.place for r in got] == list(range(len(got)))


def test_giant_conversation_spills_its_backpointers(spark, monkeypatch):
    told = structure_repair._Conversation()
    monkeypatch.setattr(structure_repair, "SPILL_BYTES", 2000)
    rows = [(str(i), "user" if i % 2 == 0 else "assistant", f"turn {i}.", None) for i in range(1000)]
    for a in range(1000, 0, -50):
        told.add(rows[a - 50:a][::-1])
    assert told.file is not None and sum(isinstance(p, int) for p in told.parts) > 10
    edits = list(told.edits())
    assert "".join(e[0] for e in edits) == "K" * 1000 and [e[1] for e in edits] == [str(i) for i in range(1000)] and told.least == 0


def test_large_conversation_across_batches(spark):
    rows = spark.range(30_000).select(F.lit(3).alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                      F.concat(F.lit("t"), F.col("id"), F.lit(".")).alias("text"))
    got = audits(rows.where("turn != 15000")).first()
    # One user turn is missing: the assistant's next one goes, for 2.
    assert got.gaps == 1 and got.cost == 2 and len(got.audit) == 29_999 and got.audit.count("D") == 1 and got.illegal == 1


def test_empty_table_and_conversation_without_rows_left(spark):
    assert audit_damaged(spark.createDataFrame([], ROWS)).count() == 0 == repair(spark.createDataFrame([], ROWS)).count()
    gone = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = audit_damaged(spark.createDataFrame([(*gone, "user", "Hi.", "x", 1)], ROWS)).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
