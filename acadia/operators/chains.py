"""Chained jobs: steps that see each other's new table states and publish them together.

The original runs such steps in one request: a role change that makes a partner, a review that
does, a code that verifies an address.  Here each step is a set operator over stored tables;
its new states are written as versions of their own, the next step reads those, and all are
published in one entry at the end, or none: a failed step publishes nothing, and another
writer's change to a table that the chain read raises ``Conflict`` (``sources.versions``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import APPLICATION_STATUSES, CHANGE_EMAIL_PREFIX, USER_ROLES
from ..functions.filters import ts_lit
from ..functions.keys import flag_exists, flag_first
from ..functions.sequence import sequence_number
from ..functions.stored import stored
from ..functions.text import trimmed
from ..sources.domain import write_version
from ..sources.versions import Snapshot, publish_on, read_version, snapshot
from . import applications, content, sessions

Step = Callable[["State"], dict[str, DataFrame]]


class State(Mapping):
    """The tables as a step sees them: those written by the steps before, else as published."""

    def __init__(self, spark: SparkSession, base: str, schemas: dict[str, StructType]):
        self.spark, self.base, self.schemas = spark, base, dict(schemas)
        self.published = snapshot(spark, base)
        self.written: dict[str, str] = {}
        self.read: set[str] = set()

    def __getitem__(self, name: str) -> DataFrame:
        self.read.add(name)
        version = self.written.get(name) or self.published.versions[name]
        return read_version(self.spark, self.base, name, version, self.schemas[name])

    def __iter__(self) -> Iterator[str]:
        return iter(self.schemas)

    def __len__(self) -> int:
        return len(self.schemas)

    def put(self, name: str, df: DataFrame) -> None:
        version = uuid.uuid4().hex
        write_version(df, self.base, name, version)
        self.schemas[name], self.written[name] = df.schema, version


def run_chain(spark: SparkSession, base: str, schemas: dict[str, StructType], steps: list[Step]) -> tuple[Snapshot, State]:
    """Run ``steps`` in order over the tables of ``schemas`` and publish all they changed at once.

    A step gets the ``State`` and returns new tables by name.
    """
    state = State(spark, base, schemas)
    for step in steps:
        for name, df in step(state).items():
            state.put(name, df)
    return publish_on(spark, base, state.published, state.written, state.read), state


def add_partners(partners: DataFrame, made: DataFrame, as_of) -> DataFrame:
    """``partners`` with a row for each of ``made(user_id, slug, promo_code)``: ids go on from the
    largest, by user_id; balances are zero."""
    top = partners.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    new = sequence_number(made.select("user_id", "slug", "promo_code"), [], ["user_id"], "_n").join(F.broadcast(top))
    values = {"id": F.col("_top") + F.col("_n"), "balance": F.lit(0), "total_earned": F.lit(0), "created_at": ts_lit(as_of)}
    own = {f.name: f.dataType for f in partners.schema}
    rows = new.select(*[(values[c] if c in values else F.col(c) if c in new.columns else F.lit(None)).cast(t).alias(c) for c, t in own.items()])
    return partners.unionByName(rows)


def role_steps(updates: DataFrame, as_of) -> list[Step]:
    """Items 42 + 28: role changes, then a partner row for every user that one of them made a
    partner, also where a later one of the batch took the role back."""
    def roles(t: State) -> dict[str, DataFrame]:
        return {"users": content.status_transition(updates, t["users"], "id", "role", USER_ROLES, as_of, {"updated_at": ts_lit(as_of)})[0]}

    def partners(t: State) -> dict[str, DataFrame]:
        known = t["users"].select("id")
        promoted = updates.where(F.col("role") == "partner").join(known, "id", "left_semi").select(F.col("id").alias("user_id"), "ts")
        made = applications.partner_provisioning(promoted, t["users"], t["partners"], t["partner_applications"])
        return {"partners": add_partners(t["partners"], made.where("outcome = 'created'"), as_of)}

    return [roles, partners]


def review_steps(updates: DataFrame, as_of) -> list[Step]:
    """Items 42 + 28: reviews, then a partner row for every application that one of them approved."""
    def reviews(t: State) -> dict[str, DataFrame]:
        return {"partner_applications": content.status_transition(
            updates, t["partner_applications"], "id", "status", APPLICATION_STATUSES, as_of,
            {"reviewed_at": ts_lit(as_of), "reviewed_by": F.col("u_actor_id"), "reject_reason": F.col("u_reject_reason")})[0]}

    def partners(t: State) -> dict[str, DataFrame]:
        first = updates.where(F.col("status") == "approved").groupBy("id").agg(F.min("ts").alias("ts"))
        approved = t["partner_applications"].select("id", "user_id", "slug").join(first, "id")
        made = applications.partners_from_approvals(approved, t["partners"])
        return {"partners": add_partners(t["partners"], made.where("outcome = 'created'"), as_of)}

    return [reviews, partners]


def verify_steps(attempts: DataFrame, as_of) -> list[Step]:
    """Items 38 + 42: codes that good attempts use up, then the addresses that they verify.

    Both steps judge the attempts by the codes as published, before they are used up; the judgement
    is stored, so it is made once.
    """
    judged: list[DataFrame] = []

    def codes(t: State) -> dict[str, DataFrame]:
        judged.append(stored(sessions.code_check(attempts, t["otp_codes"], as_of), "judged"))
        return {"otp_codes": sessions.mark_spent(t["otp_codes"], judged[0])}

    def users(t: State) -> dict[str, DataFrame]:
        good = judged[0].where("result = 'ok' AND purpose = 'verify_email'")
        updates = good.select(F.col("attempt_id").alias("update_id"), F.lower(trimmed(F.col("email"))).alias("email"),
                              F.lit(True).alias("email_verified"), ts_lit(as_of).alias("ts"))
        return {"users": content.status_transition(updates, t["users"], "email", "email_verified", (True,), as_of,
                                                   {"updated_at": ts_lit(as_of)})[0]}

    return [codes, users]


def email_changes(attempts: DataFrame, codes: DataFrame, users: DataFrame, as_of) -> DataFrame:
    """Item 38. ``attempts(attempt_id, user_id, email, code)`` to move a user's address to the one a
    ``change_email:<address>`` code names: ``attempt_id, user_id, code_id, new_email, outcome``.

    The outcome is that of ``code_check`` (``invalid``, ``used``, ``expired``), else ``not_found`` (no such
    user), ``email_taken`` (by a user, or by an earlier good attempt), ``superseded`` (the user's
    address has changed by an earlier good attempt) or ``changed``.

    The attempts and what is known of each are stored, as each search for a first one reads them twice.
    """
    attempts = stored(attempts.select("attempt_id", "user_id", "email", "code"), "changes")
    checked = sessions.code_check(attempts.select("attempt_id", "email", F.lit(CHANGE_EMAIL_PREFIX).alias("purpose"), "code"), codes, as_of)
    r = checked.join(attempts.select(F.col("attempt_id").alias("_a"), "user_id"), F.col("attempt_id") == F.col("_a")).drop("_a")
    r = flag_exists(r, users, "user_id", "id", "_known")
    r = flag_exists(r, users, "new_email", "email", "_taken")
    r = stored(r.select("attempt_id", "user_id", "code_id", "new_email", "result", "_known", "_taken"), "changes-known")
    good = (F.col("result") == "ok") & F.col("_known") & ~F.col("_taken")
    r = flag_first(r, ["user_id"], ["attempt_id"], "_first_user", when=good)
    r = flag_first(r, ["new_email"], ["attempt_id"], "_first_email", when=good & F.col("_first_user"))
    outcome = (F.when(F.col("result") != "ok", F.col("result")).when(~F.col("_known"), "not_found").when(F.col("_taken"), "email_taken")
               .when(~F.col("_first_user"), "superseded").when(~F.col("_first_email"), "email_taken").otherwise("changed"))
    return r.select("attempt_id", "user_id", "code_id", "new_email", outcome.alias("outcome"))


def email_change_steps(attempts: DataFrame, as_of) -> list[Step]:
    """Items 38 + 42 + 46: good codes are used up, their users get the new address, and all their
    sessions end.  What changes is stored, so the three steps do not judge the attempts anew."""
    judged: list[DataFrame] = []

    def codes(t: State) -> dict[str, DataFrame]:
        judged.append(stored(email_changes(attempts, t["otp_codes"], t["users"], as_of).where("outcome = 'changed'"), "judged"))
        done = judged[0].select(F.col("code_id").alias("_done"))
        marked = t["otp_codes"].join(done, F.col("id") == F.col("_done"), "left")
        return {"otp_codes": marked.select(*[(F.col("used") | F.col("_done").isNotNull()).alias("used") if c == "used" else F.col(c)
                                             for c in t["otp_codes"].columns])}

    def users(t: State) -> dict[str, DataFrame]:
        new = judged[0].select(F.col("user_id").alias("_uid"), "new_email")
        rows, old = t["users"].join(new, F.col("id") == F.col("_uid"), "left"), t["users"].columns
        stamp = F.when(F.col("_uid").isNotNull(), ts_lit(as_of))
        stamp = F.coalesce(stamp, F.col("updated_at")) if "updated_at" in old else stamp
        return {"users": rows.select(*[F.coalesce("new_email", "email").alias("email") if c == "email" else F.col(c) for c in old if c != "updated_at"],
                                     stamp.alias("updated_at"))}

    def tokens(t: State) -> dict[str, DataFrame]:
        out = judged[0].select(F.col("user_id").alias("_uid"))
        return {"refresh_tokens": t["refresh_tokens"].join(out, F.col("user_id") == F.col("_uid"), "left_anti")}

    return [codes, users, tokens]
