"""Chained jobs: later steps see earlier steps' states, and all is published at once or not at all."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from acadia.operators import chains
from acadia.plans import QUERIES
from acadia.sources.domain import publish, write_version
from acadia.sources.versions import Conflict, publish_on, read_version, snapshot

SF = "/root/testdata/sf0.01"
T0, AS_OF = dt.datetime(2001, 1, 1), dt.datetime(2001, 8, 1)


def _stored(spark, base, tables):
    for n, df in tables.items():
        write_version(df, base, n, "0")
    publish(spark, base, {n: "0" for n in tables})
    return {n: df.schema for n, df in tables.items()}


def _people(spark):
    users = spark.createDataFrame([(1, "ann@x", "Ann", "user", False), (2, "ann2@x", "Ann", "user", False), (3, "bob@x", None, "user", True),
                                   (4, "cid@x", "Cid", "partner", True)], "id long, email string, name string, role string, email_verified boolean")
    partners = spark.createDataFrame([(7, 4, "cid", "CID", D(5), D(9), T0)], "id long, user_id long, slug string, promo_code string, "
                                     "balance decimal(12,2), total_earned decimal(12,2), created_at timestamp")
    apps = spark.createDataFrame([(1, 9, "bob", "pending"), (2, 3, "robert", "pending"), (3, 2, "cid", "pending"), (4, None, "zed", "pending")],
                                 "id long, user_id long, slug string, status string")
    return {"users": users, "partners": partners, "partner_applications": apps}


def test_role_changes_make_partners(spark, tmp_path):
    base = str(tmp_path / "t")
    schemas = _stored(spark, base, _people(spark))
    updates = spark.createDataFrame([(1, 1, "partner", T0), (2, 2, "partner", T0 + dt.timedelta(1)), (3, 2, "user", T0 + dt.timedelta(2)),
                                     (4, 3, "partner", T0), (5, 4, "partner", T0), (6, 99, "partner", T0), (7, 3, "owner", T0 + dt.timedelta(9))],
                                    "update_id long, id long, role string, ts timestamp")
    after, state = chains.run_chain(spark, base, schemas, chains.role_steps(updates, AS_OF))
    assert after.seq == 2 and set(after.versions) == {"users", "partners", "partner_applications"} and after.versions["partner_applications"] == "0"
    assert {r.id: r.role for r in state["users"].collect()} == {1: "partner", 2: "user", 3: "partner", 4: "partner"}
    made = {r.user_id: (r.id, r.slug, r.promo_code, r.balance, r.created_at) for r in state["partners"].collect()}
    # bob's slug is held by an application; the second Ann was a partner for a day and keeps her row.
    assert made == {4: (7, "cid", "CID", D(5), T0), 1: (8, "ann", "ANN", D(0), AS_OF), 2: (9, "ann2", "ANN2", D(0), AS_OF),
                    3: (10, "bob3", "BOB3", D(0), AS_OF)}


def test_reviews_make_partners(spark, tmp_path):
    base = str(tmp_path / "t")
    schemas = _stored(spark, base, _people(spark))
    updates = spark.createDataFrame([(i, i, "approved", None, 4, T0) for i in (1, 2, 3, 4)] + [(9, 2, "rejected", "no", 4, T0 + dt.timedelta(1))],
                                    "update_id long, id long, status string, reject_reason string, actor_id long, ts timestamp")
    _, state = chains.run_chain(spark, base, schemas, chains.review_steps(updates, AS_OF))
    assert {r.id: (r.status, r.reject_reason) for r in state["partner_applications"].collect()} == {
        1: ("approved", None), 2: ("rejected", "no"), 3: ("approved", None), 4: ("approved", None)}
    assert {(r.user_id, r.slug) for r in state["partners"].collect()} == {(4, "cid"), (3, "robert"), (9, "bob")}


def test_a_failed_step_publishes_nothing(spark, tmp_path):
    base = str(tmp_path / "t")
    schemas = _stored(spark, base, _people(spark))

    def fails(t):
        assert t["users"].where("role = 'admin'").count() == 4  # the step before, unpublished yet
        raise ValueError("no")

    def first(t):
        return {"users": t["users"].withColumn("role", F.lit("admin"))}

    with pytest.raises(ValueError):
        chains.run_chain(spark, base, schemas, [first, fails])
    now = snapshot(spark, base)
    assert now.seq == 1 and read_version(spark, base, "users", now.versions["users"], schemas["users"]).where("role = 'admin'").count() == 0


def test_a_chain_on_tables_changed_meanwhile_is_refused(spark, tmp_path):
    base = str(tmp_path / "t")
    schemas = _stored(spark, base, _people(spark))

    def other(t):
        write_version(t["partners"].where("id < 0"), base, "partners", "other")
        publish_on(spark, base, snapshot(spark, base), {"partners": "other"})
        return {"users": t["users"]}

    with pytest.raises(Conflict):
        chains.run_chain(spark, base, schemas, [other])
    assert snapshot(spark, base).versions["users"] == "0"


def test_verification_changes_users_and_codes(spark):
    users, codes = (QUERIES[n](spark, SF) for n in ("chain_verify_users", "chain_verify_codes"))
    assert users.where("updated_at IS NOT NULL").count() > 0 and users.where("updated_at IS NULL").count() > 0
    assert codes.where("used").count() > codes.where("used AND id % 2 = 0").count()


def test_email_changes(spark, tmp_path):
    base, day = str(tmp_path / "t"), dt.timedelta(1)
    people = _people(spark)["users"].unionByName(spark.createDataFrame([(5, "dee@x", "Dee", "user", True)], _people(spark)["users"].schema))
    code = lambda i, who, new, used=False, late=False: (i, who, f"c{i}", f"change_email:{new}", T0, T0 if late else AS_OF + day, used)
    codes = [code(1, "ann@x", "a@y"), code(2, "ann2@x", "a@y"), code(3, "bob@x", "cid@x"), code(4, "cid@x", "c@y", used=True),
             code(5, "cid@x", "c@y", late=True), code(6, "ann@x", "b@y"), code(7, "dee@x", "d@y")]
    tables = {"users": people, "otp_codes": spark.createDataFrame(codes, "id long, email string, code string, purpose string, created_at timestamp, "
                                                                  "expires_at timestamp, used boolean"),
              "refresh_tokens": spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 5), (5, None)], "id long, user_id long")}
    schemas = _stored(spark, base, tables)
    tries = spark.createDataFrame([(1, 1, "Ann@x ", "c1"), (2, 2, "ann2@x", "c2"), (3, 3, "bob@x", "c3"), (4, 4, "cid@x", "c4"), (5, 4, "cid@x", "c5"),
                                   (6, 1, "ann@x", "c6"), (7, 99, "dee@x", "c7"), (8, 5, "dee@x", "no")], "attempt_id long, user_id long, email string, code string")
    got = chains.email_changes(tries, tables["otp_codes"], people, AS_OF)
    assert {r.attempt_id: r.outcome for r in got.collect()} == {1: "changed", 2: "email_taken", 3: "email_taken", 4: "used", 5: "expired", 6: "superseded",
                                                                7: "not_found", 8: "invalid"}
    _, state = chains.run_chain(spark, base, schemas, chains.email_change_steps(tries, AS_OF))
    assert {r.id: (r.email, r.updated_at) for r in state["users"].collect() if r.updated_at} == {1: ("a@y", AS_OF)}
    assert {r.id for r in state["otp_codes"].where("used").collect()} == {1, 4} and {r.id for r in state["refresh_tokens"].collect()} == {3, 4, 5}
