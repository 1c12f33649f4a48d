"""Branch coverage: every outcome of the jobs' ordered rules occurs in some fixture.

Outcomes the driver tables cannot produce are covered by the hand-made tables in
test_jobs.py (listed in HAND_MADE below)."""

import datetime as dt
from decimal import Decimal as D

import pytest

from acadia.operators import applications
from acadia.plans import QUERIES

from .conftest import df

SF = "/root/testdata/sf0.01"

EXPECTED = {
    "promo_resolution": ("outcome", {"discount", "expired", "inactive", "missing", "not_found", "partner"}),
    "application_admission": ("reason", {None, "invalid_slug", "pending_exists", "required", "slug_taken"}),
    "partner_provisioning": ("outcome", {"created", "skipped", "unknown_user"}),
    "payout_admission": ("reason", {None, "bad_method", "insufficient_balance", "min_amount", "no_requisites"}),
    "partner_approvals": ("outcome", {"created", "missing_user_or_slug", "skipped", "slug_conflict"}),
    "rate_limit_global": ("over_limit", {False, True}),
    "rate_limit_slug": ("over_limit", {False, True}),
    "rate_limit_auth": ("over_limit", {False, True}),
    "payout_status_rejects": ("reason", {"bad_status", "not_found"}),
    "append_materials": ("reason", {None, "bad_parent", "text_required"}),
    "append_topics": ("reason", {None, "parent_not_found", "text_required"}),
    "append_videos": ("reason", {None, "parent_not_found", "text_required"}),
    "lesson_delete_report": ("outcome", {"blocked", "deleted", "not_found"}),
    "sparse_patch_rejects": ("reason", {"bad_number", "empty", "not_found"}),
    "sparse_patch_user_names": ("reason", {"blank", "empty", "too_long"}),
    "promo_code_load": ("reason", {None, "code_required", "discount_range", "duplicate"}),
    "user_intake": ("reason", {None, "duplicate", "email_required"}),
    "promo_code_usage": ("code_status", {"active", "disabled", "expired"}),
    "otp_code_check": ("result", {"expired", "invalid", "ok", "used"}),
    "partner_purchases": ("product_class", {"deluxe", "essential", "extra", "other"}),
    "rate_limit_daily": ("over_limit", {False, True}),
    "active_sessions": ("expired", {False, True}),
}
HAND_MADE = {
    "partner_provisioning": "slug_conflict: test_partner_provisioning_slugs",
    "payout_admission": "partner_not_found: test_payout_admission_equals_sequential_fold",
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_fixture_branches(spark, name):
    col, want = EXPECTED[name]
    got = {r[0] for r in QUERIES[name](spark, SF).select(col).distinct().collect()}
    assert got == want


def test_approval_path(spark):
    t = dt.datetime(2001, 1, 1)
    parts = df(spark, [(1, 10, "old", "OLD", D(0), D(0))],
               "id long, user_id long, slug string, promo_code string, balance decimal(12,2), "
               "total_earned decimal(12,2)")
    approved = df(spark, [(1, 10, "x1", t), (2, 20, "old", t), (3, 30, "new", t),
                          (4, 40, "new", t + dt.timedelta(days=1)), (5, None, "y", t),
                          (6, 30, "new2", t + dt.timedelta(days=2))],
                  "id long, user_id long, slug string, ts timestamp")
    out = {r.application_id: (r.slug, r.promo_code, r.outcome)
           for r in applications.partners_from_approvals(approved, parts).collect()}
    assert out == {1: ("x1", "X1", "skipped"), 2: ("old", "OLD", "slug_conflict"),
                   3: ("new", "NEW", "created"), 4: ("new", "NEW", "slug_conflict"),
                   5: ("y", "Y", "missing_user_or_slug"), 6: ("new2", "NEW2", "skipped")}
