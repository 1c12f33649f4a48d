"""Hand-made edge cases for the data jobs (items 25-46)."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from acadia.operators import (access, applications, content, integrity, payouts, progress,
                              promo, purge, sessions)

from .conftest import df

T = dt.datetime
AS_OF = T(2001, 8, 1)
PARTNERS = ("id long, user_id long, slug string, promo_code string, balance decimal(12,2), "
            "total_earned decimal(12,2)")
USERS = "id long, email string, name string, role string, email_verified boolean, created_at timestamp"
APPS = ("id long, user_id long, name string, email string, telegram string, slug string, "
        "status string, created_at timestamp")
PROMO = "id int, code string, discount_percent int, expires_at timestamp, is_active boolean"
ORDERS = ("id long, user_id long, product string, amount decimal(12,2), "
          "referral_partner_id long, promo_code string, status string, "
          "created_at timestamp, paid_at timestamp")
PROGRESS = ("user_id long, lesson_id int, viewed boolean, completed boolean, "
            "viewed_at timestamp, completed_at timestamp")
LESSONS = "id int, title string, sort_order int, is_free boolean"


def test_promo_resolution_precedence(spark):
    codes = df(spark, [(1, "OFF", 15, None, True), (2, "OLD", 5, T(2000, 1, 1), True),
                       (3, "OFFX", 5, None, False), (4, "PARTNER1", 50, None, True)], PROMO)
    parts = df(spark, [(1, 10, "p1", "PARTNER1", D(0), D(0)), (2, 20, "p2", "PARTNER2", D(0), D(0)),
                       (3, 99, "p3", "GHOST", D(0), D(0))], PARTNERS)
    us = df(spark, [(10, "a@x", "A", "partner", True, AS_OF), (20, "b@x", "B", "partner", True, AS_OF)], USERS)
    req = df(spark, [(1, " off "), (2, "old"), (3, "OFFX"), (4, "partner1"), (5, "partner2"),
                     (6, "ghost"), (7, "   "), (8, None), (9, "nope")], "request_id long, code string")
    out = {r.request_id: (r.outcome, r.discount)
           for r in promo.promo_resolution(req, codes, parts, us, AS_OF).collect()}
    assert out == {1: ("discount", 15), 2: ("expired", None), 3: ("inactive", None),
                   4: ("discount", 50), 5: ("partner", 0), 6: ("not_found", None),
                   7: ("missing", None), 8: ("missing", None), 9: ("not_found", None)}


def test_promo_code_load_rules(spark):
    existing = df(spark, [(1, "TAKEN", 10, None, True)], PROMO)
    batch = df(spark, [(1, " new ", None, None, T(2001, 1, 1)), (2, "NEW", "20", None, T(2001, 1, 2)),
                       (3, "taken", "5", None, T(2001, 1, 1)), (4, "x", "0", None, T(2001, 1, 1)),
                       (5, "y", "101", None, T(2001, 1, 1)), (6, "y", "7abc", None, T(2001, 1, 2)),
                       (7, "", "5", None, T(2001, 1, 1))],
                   "request_id long, code string, discount string, expires_at timestamp, ts timestamp")
    out = {r.request_id: (r.code, r.discount, r.reason)
           for r in promo.promo_code_load(batch, existing).collect()}
    assert out == {1: ("NEW", 10, None), 2: ("NEW", 20, "duplicate"), 3: ("TAKEN", 5, "duplicate"),
                   4: ("X", 10, None), 5: ("Y", 101, "discount_range"), 6: ("Y", 7, None),
                   7: ("", 5, "code_required")}


def test_slug_availability(spark):
    apps = df(spark, [(1, 1, "n", "e", None, "taken-a", "pending", AS_OF)], APPS)
    parts = df(spark, [(1, 1, "taken-p", "TAKEN-P", D(0), D(0))], PARTNERS)
    req = df(spark, [(1, " Taken-A "), (2, "taken-p"), (3, "free-1"), (4, "ab"), (5, "bad slug")],
             "request_id long, slug string")
    out = {r.request_id: (r.slug, r.valid, r.available)
           for r in applications.slug_availability(req, apps, parts).collect()}
    assert out == {1: ("taken-a", True, False), 2: ("taken-p", True, False),
                   3: ("free-1", True, True), 4: ("ab", False, False),
                   5: ("bad slug", False, False)}


def test_application_admission_in_batch(spark):
    apps = df(spark, [(1, None, "n", "old@x", None, "old", "pending", T(2000, 1, 1)),
                      (2, None, "n", "done@x", None, "old2", "pending", T(2000, 1, 1)),
                      (3, None, "n", "done@x", None, "old3", "rejected", T(2000, 2, 1))], APPS)
    parts = df(spark, [], PARTNERS)
    cols = ("request_id long, ts timestamp, user_id long, name string, email string, slug string, "
            "telegram string, cooperation_type string")
    rows = [(1, T(2001, 1, 1), None, "A", "a@x", "slug1", "  ", None),
            (2, T(2001, 1, 2), None, "B", "b@x", "SLUG1", "@b", "ambassador"),   # same slug, later
            (3, T(2001, 1, 1), None, "C", " A@X ", "slug3", None, ""),           # same email, later id
            (4, T(2001, 1, 1), None, "D", "old@x", "slug4", None, None),         # pending exists
            (5, T(2001, 1, 1), None, "E", "done@x", "slug5", None, None),        # latest is rejected
            (6, T(2001, 1, 1), None, "", "f@x", "slug6", None, None),            # required
            (7, T(2001, 1, 1), None, "G", "g@x", "old2", None, None),         # slug held
            (8, T(2001, 1, 1), None, "H", "h@x", "bad!", None, None)]         # invalid
    out = {r.request_id: r for r in
           applications.application_admission(df(spark, rows, cols), apps, parts).collect()}
    assert {k: v.reason for k, v in out.items()} == {
        1: None, 2: "slug_taken", 3: "pending_exists", 4: "pending_exists", 5: None,
        6: "required", 7: "slug_taken", 8: "invalid_slug"}
    assert (out[1].telegram, out[1].cooperation_type, out[1].status) == (None, "partner", "pending")
    assert (out[3].email, out[2].cooperation_type) == ("a@x", "ambassador")


def test_partner_provisioning_slugs(spark):
    us = df(spark, [(1, "ivan@x", "Иван", "user", True, AS_OF),          # no latin letters
                    (2, "bob.smith@x", None, "user", True, AS_OF),       # e-mail prefix
                    (3, "bob2@x", "Bob Smith", "user", True, AS_OF),      # same base as user 2
                    (4, "z@x", "Taken", "user", True, AS_OF),             # base held by a partner
                    (5, "p@x", "Already", "user", True, AS_OF)], USERS)
    parts = df(spark, [(9, 5, "already", "ALREADY", D(0), D(0)), (8, 50, "taken", "TAKEN", D(0), D(0))],
               PARTNERS)
    apps = df(spark, [], APPS)
    promoted = df(spark, [(1, T(2001, 1, 1)), (2, T(2001, 1, 1)), (3, T(2001, 1, 2)),
                          (4, T(2001, 1, 1)), (5, T(2001, 1, 1)), (6, T(2001, 1, 1))],
                  "user_id long, ts timestamp")
    out = {r.user_id: (r.slug, r.promo_code, r.outcome)
           for r in applications.partner_provisioning(promoted, us, parts, apps).collect()}
    assert out == {1: ("partner", "PARTNER", "created"), 2: ("bobsmith", "BOBSMITH", "created"),
                   3: ("bobsmith3", "BOBSMITH3", "created"), 4: ("taken4", "TAKEN4", "created"),
                   5: (None, None, "skipped"), 6: (None, None, "unknown_user")}


def _python_fold(reqs, balances, order_key):
    bal = dict(balances)
    out = {}
    for r in sorted(reqs, key=order_key):
        rid, pid, amount, method, requisites = r[0], r[1], r[2], r[3], r[4]
        if pid not in bal:
            out[rid] = ("partner_not_found", None)
        elif amount is None or amount < 500:
            out[rid] = ("min_amount", None)
        elif method not in ("card", "usdt", "sbp"):
            out[rid] = ("bad_method", None)
        elif not (requisites or "").strip():
            out[rid] = ("no_requisites", None)
        elif amount > bal[pid]:
            out[rid] = ("insufficient_balance", None)
        else:
            bal[pid] -= amount
            out[rid] = (None, bal[pid])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_payout_admission_equals_sequential_fold(spark, seed):
    rnd = random.Random(seed)
    balances = {1: D("5000.00"), 2: D("1200.00"), 3: D("-10.00"), 4: D("99999.00")}
    reqs = []
    for i in range(400):
        pid = 4 if rnd.random() < 0.5 else rnd.choice([1, 2, 3, 5])   # partner 4 is hot
        amount = D(rnd.choice([300, 500, 600, 900, 1500, 2500, 4000, 20000])) + D(rnd.randint(0, 99)) / 100
        method = rnd.choice(["card", "usdt", "sbp", "sbp", "paypal"])
        requisites = rnd.choice(["acct", "acct", "acct", "  "])
        reqs.append((i, pid, amount, method, requisites))
    rq = df(spark, reqs, "rid long, partner_id long, amount decimal(12,2), method string, requisites string")
    parts = df(spark, [(k, k * 10, f"p{k}", f"P{k}", v, v) for k, v in balances.items()], PARTNERS)
    want = _python_fold(reqs, balances, lambda r: r[0])
    got = {r.rid: (r.reason, r.balance_after) for r in payouts.payout_admission(rq, parts, ["rid"]).collect()}
    assert got == want


def test_payout_commission_half_up(spark):
    rq = df(spark, [(1, 1, D("512.25"), "card", "a"), (2, 1, D("600.50"), "usdt", "a")],
            "rid long, partner_id long, amount decimal(12,2), method string, requisites string")
    parts = df(spark, [(1, 10, "p", "P", D("100000"), D(0))], PARTNERS)
    out = {r.rid: (r.commission_amount, r.amount_to_receive)
           for r in payouts.payout_checks(rq, parts).collect()}
    assert out == {1: (D("10.25"), D("502.00")), 2: (D("6.01"), D("594.49"))}


def test_payout_status_second_rejection_refunds_once(spark):
    pays = df(spark, [(1, 7, D("100.00"), "rejected"), (2, 7, D("50.00"), "pending"),
                      (3, 7, D("30.00"), "pending")],
              "id long, partner_id long, amount decimal(12,2), status string")
    parts = df(spark, [(7, 70, "p", "P", D("0.00"), D(0))], PARTNERS)
    upd = df(spark, [(1, "rejected", None, T(2001, 1, 1)), (2, "rejected", "x", T(2001, 1, 1)),
                     (3, "cancelled", None, T(2001, 1, 1)), (9, "paid", None, T(2001, 1, 1))],
             "id long, status string, reject_reason string, ts timestamp")
    new_pay, new_part, rej = payouts.payout_status_batch(upd, pays, parts, AS_OF, ["id"])
    assert new_part.collect()[0].balance == D("50.00")
    st = {r.id: (r.status, r.processed_at) for r in new_pay.collect()}
    assert st == {1: ("rejected", AS_OF), 2: ("rejected", AS_OF), 3: ("pending", None)}
    assert {r.id: r.reason for r in rej.collect()} == {3: "bad_status", 9: "not_found"}


def test_progress_upsert_out_of_order_and_idempotent(spark):
    les = df(spark, [(1, "l1", 1, False), (2, "l2", 2, True)], LESSONS)
    us = df(spark, [(1, "a@x", "A", "user", True, AS_OF), (2, "b@x", "B", "user", True, AS_OF)], USERS)
    orders = df(spark, [(1, 1, "Essential", D(1), None, None, "paid", AS_OF, AS_OF)], ORDERS)
    ev_schema = "event_id long, user_id long, lesson_id int, viewed boolean, completed boolean, ts timestamp"
    ev = df(spark, [(1, 1, 1, None, True, T(2001, 7, 3)), (2, 1, 1, True, None, T(2001, 7, 1)),
                    (3, 2, 1, True, None, T(2001, 7, 1)),     # no access
                    (4, 2, 2, True, None, T(2001, 7, 5)),     # free lesson
                    (5, 2, 9, True, None, T(2001, 7, 5)),     # unknown lesson
                    (6, 1, 2, None, None, T(2001, 7, 5))], ev_schema)  # no data
    state = df(spark, [(2, 2, True, False, T(2001, 6, 1), None)], PROGRESS)
    once = progress.progress_upsert(ev, state, les, orders, us)
    twice = progress.progress_upsert(ev, once, les, orders, us)
    rows = sorted(tuple(r) for r in once.collect())
    assert rows == sorted(tuple(r) for r in twice.collect())
    assert rows == [(1, 1, True, True, T(2001, 7, 1), T(2001, 7, 3)),
                    (2, 2, True, False, T(2001, 6, 1), None)]
    reasons = {r.event_id: r.reason for r in progress.progress_admission(ev, les, orders, us).collect()}
    assert reasons == {1: None, 2: None, 3: "no_access", 4: None, 5: "lesson_not_found", 6: "no_data"}


def test_access_grant_and_revoke(spark):
    orders = df(spark, [(10, 1, "Extra", D(5), None, None, "paid", AS_OF, AS_OF),
                        (11, 2, "Extra", D(5), None, None, "pending", AS_OF, None)], ORDERS)
    ids = df(spark, [(1,), (2,), (2,), (5,), (99,)], "user_id long")
    us = df(spark, [(i, f"u{i}@x", "n", "user", True, AS_OF) for i in (1, 2, 5)], USERS)
    grants = access.access_grants(ids, orders, us, AS_OF).collect()
    assert sorted((g.id, g.user_id, g.amount, g.status) for g in grants) == [
        (12, 2, D("0.00"), "paid"), (13, 5, D("0.00"), "paid")]   # 99 is no user; ids without gaps
    left = {r.id for r in access.access_revoke(ids, orders).collect()}
    assert left == {11}


def test_user_purge_blockers(spark):
    us = df(spark, [(i, f"u{i}@x", "n", "user", True, AS_OF) for i in (1, 2, 3, 4)], USERS)
    parts = df(spark, [(7, 2, "p", "P", D(0), D(0)), (8, 3, "q", "Q", D(0), D(0))], PARTNERS)
    orders = df(spark, [(1, 4, "E", D(1), 7, None, "paid", AS_OF, AS_OF),    # blocks user 2
                        (2, 3, "E", D(1), 8, None, "paid", AS_OF, AS_OF)], ORDERS)  # own order
    apps = df(spark, [], APPS)
    ids = df(spark, [(1,), (2,), (3,), (9,)], "user_id long")
    rep = {r.user_id: r.outcome for r in purge.purge_report(ids, 1, us, orders, parts, apps).collect()}
    assert rep == {1: "self", 2: "blocked_orders", 3: "deleted", 9: "not_found"}


def test_session_retention_keeps_newest_five(spark):
    toks = df(spark, [(i, 1 if i <= 7 else 2, f"h{i}", T(2001, 7, 1 + i), T(2001, 9, 1)) for i in range(1, 10)],
              "id long, user_id long, token_hash string, created_at timestamp, expires_at timestamp")
    kept = sorted(r.id for r in sessions.session_retention(toks).collect())
    assert kept == [3, 4, 5, 6, 7, 8, 9]
    assert sorted(r.id for r in sessions.session_pruned(toks).collect()) == [1, 2]


def test_code_check_states(spark):
    codes = df(spark, [(1, "a@x", "111111", "login", T(2001, 7, 31, 23, 55), T(2001, 8, 1, 0, 5), False),
                       (2, "a@x", "222222", "login", T(2001, 7, 1), T(2001, 7, 1, 0, 10), False),
                       (3, "a@x", "333333", "login", T(2001, 7, 31, 23, 59), T(2001, 8, 1, 0, 9), True),
                       (4, "a@x", "444444", "change_email:new@x", T(2001, 7, 31, 23, 58),
                        T(2001, 8, 1, 0, 8), False)],
                  "id long, email string, code string, purpose string, created_at timestamp, "
                  "expires_at timestamp, used boolean")
    att = df(spark, [(1, "a@x", "login", "111111"), (2, "a@x", "login", "222222"),
                     (3, "a@x", "login", "333333"), (4, "a@x", "login", "999999"),
                     (5, "a@x", "change_email:", "444444")],
             "attempt_id long, email string, purpose string, code string")
    out = {r.attempt_id: (r.result, r.new_email) for r in sessions.code_check(att, codes, AS_OF).collect()}
    assert out == {1: ("ok", None), 2: ("expired", None), 3: ("used", None), 4: ("invalid", None),
                   5: ("ok", "new@x")}
    cur = {r.purpose: r.code for r in sessions.current_codes(codes, AS_OF).collect()}
    assert cur["login"] == "333333"


def test_sparse_patch_null_versus_absent(spark):
    table = df(spark, [(1, "t", "desc", 1), (2, "u", "keep", 2)],
               "id long, title string, description string, sort_order int")
    patches = df(spark, [(1, T(2001, 1, 1), 1, " T2 ", True, "  ", True, None, False),
                         (2, T(2001, 1, 2), 1, None, False, None, False, 9, True),
                         (3, T(2001, 1, 1), 2, None, False, None, False, None, False),
                         (4, T(2001, 1, 1), 5, "x", True, None, False, None, False),
                         (5, T(2001, 1, 1), 2, "  ", True, None, False, None, False)],
                     "patch_id long, ts timestamp, id long, title string, set_title boolean, "
                     "description string, set_description boolean, sort_order int, "
                     "set_sort_order boolean")
    new, rej = content.sparse_patch(patches, table, "id",
                                    {"title": "required", "description": "optional", "sort_order": "int"})
    assert sorted(tuple(r) for r in new.collect()) == [(1, "T2", None, 9), (2, "u", "keep", 2)]
    assert {r.patch_id: r.reason for r in rej.collect()} == {3: "empty", 4: "not_found", 5: "blank"}


def test_sparse_patch_titles_numbers_flags(spark):
    table = df(spark, [(1, "t", 1, True), (2, "u", 2, True)], "id long, title string, sort_order int, is_main boolean")
    rows = [(1, 1, " \u00a0", True, None, False, None, False), (2, 1, None, False, " 12px", True, "no", True),
            (3, 2, None, True, None, False, None, False), (4, 2, None, False, "abc", True, None, False),
            (5, 2, None, False, "99999999999", True, None, False), (6, 2, None, False, "-3.9", True, "", True),
            (7, 2, "x", True, None, True, None, False)]
    patches = df(spark, [(r[0], T(2001, 1, r[0]), *r[1:]) for r in rows],
                 "patch_id long, ts timestamp, id long, title string, set_title boolean, sort_order string, "
                 "set_sort_order boolean, is_main string, set_is_main boolean")
    new, rej = content.sparse_patch(patches, table, "id", {"title": "text", "sort_order": "int", "is_main": "bool"})
    assert sorted(tuple(r) for r in new.collect()) == [(1, "", 12, True), (2, "u", -3, False)]
    assert {r.patch_id: r.reason for r in rej.collect()} == {3: "blank", 4: "bad_number", 5: "bad_number",
                                                             7: "bad_number"}


def test_append_ordered_needs_its_parent(spark):
    existing = df(spark, [(1, 1, "a", 4)], "id long, lesson_id int, text string, sort_order int")
    lessons = df(spark, [(1, "l", 1, True)], LESSONS)
    batch = df(spark, [(1, 1, "x", T(2001, 1, 1)), (2, 999, "y", T(2001, 1, 1)), (3, None, "z", T(2001, 1, 1)),
                       (4, 999, " ", T(2001, 1, 1))], "request_id long, lesson_id int, text string, ts timestamp")
    out = {r.request_id: (r.reason, r.sort_order)
           for r in content.append_ordered(batch, existing, "text", "lesson_id", parents=lessons).collect()}
    assert out == {1: (None, 5), 2: ("parent_not_found", None), 3: ("parent_not_found", None),
                   4: ("text_required", None)}


def test_delete_lessons_blocked_by_progress(spark):
    les = df(spark, [(1, "a", 1, True), (2, "b", 2, False)], LESSONS)
    topics = df(spark, [(10, 1, "x", 1), (11, 2, "y", 1)], "id long, lesson_id int, text string, sort_order int")
    prog = df(spark, [(5, 1, True, False, None, None)], PROGRESS)
    ids = df(spark, [(1,), (2,), (3,)], "id long")
    new, kids, rep = content.delete_by_key(ids, les, "id", {"topics": (topics, "lesson_id")},
                                           {"progress": (prog, "lesson_id")})
    assert {r.id: r.outcome for r in rep.collect()} == {1: "blocked", 2: "deleted", 3: "not_found"}
    assert [r.id for r in new.collect()] == [1]
    assert [r.id for r in kids["topics"].collect()] == [10]


def test_append_ordered_per_parent_with_hot_parent(spark):
    existing = df(spark, [(1, 1, "a", 4), (2, 2, "b", 9)], "id long, lesson_id int, text string, sort_order int")
    rows = [(i, 1 if i % 10 else 2, f" t{i} " if i % 7 else "  ", T(2001, 1, 1) + dt.timedelta(seconds=i))
            for i in range(1, 301)]
    batch = df(spark, rows, "request_id long, lesson_id int, text string, ts timestamp")
    out = {r.request_id: (r.reason, r.sort_order)
           for r in content.append_ordered(batch, existing, "text", "lesson_id").collect()}
    expect, nxt = {}, {1: 4, 2: 9}
    for i, lesson, text, _ in rows:
        if not text.strip():
            expect[i] = ("text_required", None)
        else:
            nxt[lesson] += 1
            expect[i] = (None, nxt[lesson])
    assert out == expect


def test_integrity_report_finds_injected_violations(spark):
    us = df(spark, [(1, "a@x", "n", "user", True, AS_OF), (2, "a@x", "n", "boss", True, AS_OF)], USERS)
    orders = df(spark, [(1, 3, "E", D(1), None, None, "lost", AS_OF, None)], ORDERS)
    rep = {(r.check, r.table_name, r.column_name): r.violations
           for r in integrity.integrity_report({"users": us, "orders": orders}).collect()}
    assert rep[("unique", "users", "email")] == 1
    assert rep[("enum", "users", "role")] == 1
    assert rep[("foreign_key", "orders", "user_id->users.id")] == 1
    assert rep[("enum", "orders", "status")] == 1
    assert rep[("not_null", "orders", "amount")] == 0
    assert rep[("unique", "partners", "slug")] is None  # no such table given
    assert rep[("foreign_key", "orders", "referral_partner_id->partners.id")] is None
    assert rep[("not_null", "users", "updated_at")] is None


def test_integrity_report_keys(spark):
    """Composite keys, NULL keys, repeated parents, an empty child and code purposes."""
    us = df(spark, [(1, "a", "n", "user", True, AS_OF), (1, "b", "n", "user", True, AS_OF)], USERS)
    les = df(spark, [(1, "a", 1, True)], LESSONS)
    prog = df(spark, [(1, 1, True, False, None, None)] * 3 + [(None, 1, True, False, None, None)] * 2
              + [(1, 7, True, None, None, None), (5, 7, True, False, None, None)], PROGRESS)
    tokens = df(spark, [], "id long, user_id long, token_hash string, expires_at timestamp, created_at timestamp")
    codes = df(spark, [("login",), ("change_email:a@x",), ("other",), (None,)], "purpose string")
    rep = {(r.check, r.table_name, r.column_name): r.violations for r in integrity.integrity_report(
        {"users": us, "lessons": les, "course_progress": prog, "refresh_tokens": tokens, "otp_codes": codes}).collect()}
    assert rep[("unique", "course_progress", "user_id,lesson_id")] == 2
    assert rep[("foreign_key", "course_progress", "user_id->users.id")] == 1
    assert rep[("foreign_key", "course_progress", "lesson_id->lessons.id")] == 2
    assert rep[("not_null", "course_progress", "completed")] == 1
    assert rep[("unique", "refresh_tokens", "token_hash")] == 0
    assert rep[("foreign_key", "refresh_tokens", "user_id->users.id")] == 0
    assert rep[("enum", "otp_codes", "purpose")] == 1 and rep[("not_null", "otp_codes", "purpose")] == 1


def test_promo_code_load_huge_discount_is_out_of_range(spark):
    existing = df(spark, [], PROMO)
    batch = df(spark, [(1, "a", "99999999999999", None, T(2001, 1, 1)), (2, "b", "-3", None, T(2001, 1, 1))],
               "request_id long, code string, discount string, expires_at timestamp, ts timestamp")
    out = {r.request_id: (r.discount, r.reason) for r in promo.promo_code_load(batch, existing).collect()}
    assert out == {1: (None, "discount_range"), 2: (-3, "discount_range")}


def test_partner_provisioning_in_batch_duplicates(spark):
    us = df(spark, [(5, "b@x", "Bob", "user", True, AS_OF), (7, "c@x", "Bob5", "user", True, AS_OF),
                    (8, "d@x", "Dan", "user", True, AS_OF)], USERS)
    parts = df(spark, [(1, 99, "bob", "BOB", D(0), D(0))], PARTNERS)
    promoted = df(spark, [(5, T(2001, 1, 1)), (7, T(2001, 1, 2)), (8, T(2001, 1, 1)), (8, T(2001, 1, 3))],
                  "user_id long, ts timestamp")
    rows = sorted(((r.user_id, r.slug, r.outcome) for r in
                   applications.partner_provisioning(promoted, us, parts, df(spark, [], APPS)).collect()),
                  key=lambda t: (t[0], str(t[1])))
    want = [(5, "bob5", "created"), (7, "bob5", "slug_conflict"), (8, "dan", "created")]
    assert rows == sorted(want, key=lambda t: (t[0], str(t[1])))


def test_promo_resolution_case_variants_lowest_id_wins(spark):
    codes = df(spark, [(7, "Sale", 30, None, True), (3, "SALE", 10, None, False)], PROMO)
    parts = df(spark, [], PARTNERS)
    us = df(spark, [], USERS)
    req = df(spark, [(1, "sale")], "request_id long, code string")
    out = [(r.outcome, r.discount) for r in promo.promo_resolution(req, codes, parts, us, AS_OF).collect()]
    assert out == [("inactive", None)]
