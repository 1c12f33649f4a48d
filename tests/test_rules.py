"""Rules of the request handlers that set operators must keep: white space, codes that work
once, ordered payout updates, promo code conflicts."""

import datetime as dt
from decimal import Decimal as D

from acadia.functions.text import trimmed
from acadia.operators import applications, payouts, sessions

from .conftest import df

AS_OF = dt.datetime(2001, 8, 1)


def test_trim_and_slug_know_every_white_space(spark):
    rows = df(spark, [(1, "\t abc\n"), (2, " abc "), (3, "a b"), (4, "\n"), (5, None)], "id long, t string")
    assert {r.id: r.t for r in rows.select("id", trimmed("t").alias("t")).collect()} == {1: "abc", 2: "abc", 3: "a b", 4: "", 5: None}
    req = df(spark, [(1, "abc\n"), (2, "a\nbc"), (3, "held")], "request_id long, slug string")
    apps, parts = df(spark, [("held",)], "slug string"), df(spark, [], "slug string")
    got = {r.request_id: (r.slug, r.valid, r.available) for r in applications.slug_availability(req, apps, parts).collect()}
    assert got == {1: ("abc", True, True), 2: ("a\nbc", False, False), 3: ("held", True, False)}


def test_a_code_works_once(spark):
    later = dt.datetime(2001, 9, 1)
    codes = df(spark, [(1, "a@x", "login", "11", False, AS_OF, later), (2, "b@x", "login", "22", False, AS_OF, AS_OF - dt.timedelta(1)),
                       (3, "c@x", "login", "33", True, AS_OF, later)],
               "id long, email string, purpose string, code string, used boolean, created_at timestamp, expires_at timestamp")
    tries = df(spark, [(1, " A@X ", "login", "11"), (2, "a@x", "login", "11"), (3, "b@x", "login", "22"), (4, "c@x", "login", "33"),
                       (5, "a@x", "login", "99")], "attempt_id long, email string, purpose string, code string")
    got = {r.attempt_id: r.result for r in sessions.code_check(tries, codes, AS_OF).collect()}
    assert got == {1: "ok", 2: "used", 3: "expired", 4: "used", 5: "invalid"}
    assert {r.id: r.used for r in sessions.codes_after_check(tries, codes, AS_OF).collect()} == {1: True, 2: False, 3: True}


def test_payout_updates_apply_in_order(spark):
    pays = df(spark, [(1, 7, D("100.00"), "pending"), (2, 7, D("10.00"), "rejected"), (3, 7, D("1.00"), "pending")],
              "id long, partner_id long, amount decimal(12,2), status string")
    parts = df(spark, [(7, 70, D("0.00"))], "id long, user_id long, balance decimal(12,2)")
    day = lambda d: dt.datetime(2001, 1, d)
    upd = df(spark, [(1, "rejected", "no", day(1)), (1, "processing", "", day(2)), (2, "processing", None, day(1)),
                     (2, "rejected", "x", day(2)), (2, "rejected", "y", day(3)), (3, "processing", None, day(1))],
             "id long, status string, reject_reason string, ts timestamp")
    new, partners, _ = payouts.payout_status_batch(upd, pays, parts, AS_OF, ["id"])
    assert partners.first().balance == D("110.00")   # one refund per step into 'rejected'
    assert {r.id: (r.status, r.reject_reason, r.processed_at) for r in new.collect()} == {
        1: ("processing", None, AS_OF), 2: ("rejected", "y", AS_OF), 3: ("processing", None, None)}


def test_promo_code_held_by_another_partner(spark):
    users = df(spark, [(5, "bob", "b@x")], "id long, name string, email string")
    parts = df(spark, [(1, 9, "robert", "BOB")], "id long, user_id long, slug string, promo_code string")
    got = applications.partner_provisioning(df(spark, [(5, AS_OF)], "user_id long, ts timestamp"), users, parts,
                                            df(spark, [], "slug string")).first()
    assert got.outcome == "slug_conflict"
