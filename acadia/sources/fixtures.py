"""Stand-in inputs for the domain tables, derived from the driver tables.

The reference ships no data, so each domain table (users, orders, partners, ...) is a
portable SQL view over one driver table (see FIXTURES.md).  The same text runs in Spark
(through ``spark.sql`` with DataFrame arguments, so no global temp views are created)
and, with plain table names, as the ``WITH`` prefix of the DuckDB oracle.  These views
only give rows in the schema the operators expect; they do none of the operators' work.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

# Fixed fixture definitions (FIXTURES.md). ``{name}`` is a driver table or an earlier view.
FIXTURE_SQL: dict[str, str] = {
    "f_users": """
SELECT c_custkey AS id, concat(lower(replace(c_name, '#', '.')), '@example.test') AS email, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name, CASE WHEN c_custkey % 150 = 0 THEN 'admin' WHEN c_custkey % 15 = 1 THEN 'partner' ELSE 'user' END AS role, c_custkey % 7 <> 0 AS email_verified, CAST(DATE '1995-01-01' + CAST((c_custkey * 37) % 2403 AS INT) AS TIMESTAMP) AS created_at
FROM {customer}""",
    "f_orders": """
SELECT o_orderkey AS id, o_custkey AS user_id, CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderpriority = '1-URGENT' THEN 'Deluxe' WHEN o_orderpriority = '2-HIGH' THEN 'Extra' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Partnership' ELSE 'Essential' END AS product, CAST(o_totalprice AS DECIMAL(12,2)) AS amount, CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_custkey / 15) AS BIGINT) END AS referral_partner_id, CASE WHEN o_orderkey % 5 = 0 THEN concat('PARTNER', CAST(CAST(floor(o_custkey / 15) AS BIGINT) AS STRING)) WHEN o_orderkey % 5 = 1 THEN concat('BRAND', CAST(o_orderkey % 30 AS STRING)) END AS promo_code, CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'refunded' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR * CAST(o_orderkey % 72 AS INT) END AS paid_at
FROM {orders}""",
    "f_partners": """
SELECT s_suppkey AS id, s_suppkey * 15 + 1 AS user_id, concat('partner', CAST(s_suppkey AS STRING)) AS slug, concat('PARTNER', CAST(s_suppkey AS STRING)) AS promo_code, CAST(s_acctbal AS DECIMAL(12,2)) AS balance, CAST(CAST(s_acctbal AS DECIMAL(12,2)) + 1000 AS DECIMAL(12,2)) AS total_earned
FROM {supplier}""",
    "f_referrals": """
SELECT event_id AS id, CAST(floor(user_id / 15) AS BIGINT) AS partner_id, user_id AS referred_user_id, CAST(ts AS TIMESTAMP) - INTERVAL '8218' DAY AS created_at
FROM {events} WHERE event_type = 'signup'""",
    "f_lessons": """
SELECT n_nationkey AS id, n_name AS title, n_nationkey + 1 AS sort_order, n_nationkey % 6 = 0 AS is_free
FROM {nation}""",
    "f_lesson_topics": """
SELECT p_partkey AS id, CAST(p_partkey % 25 AS INT) AS lesson_id, p_name AS text, CAST(floor(p_partkey / 25) AS INT) AS sort_order
FROM {part} WHERE p_partkey % 3 = 0""",
    "f_lesson_videos": """
SELECT p_partkey AS id, CAST(p_partkey % 25 AS INT) AS lesson_id, p_name AS title, concat('https://video.example.test/', CAST(p_partkey AS STRING)) AS video_url, p_partkey < 25 AS is_main, CAST(floor(p_partkey / 25) AS INT) AS sort_order
FROM {part} WHERE p_partkey % 3 = 1""",
    "f_materials": """
SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN 'maps' WHEN 'LARGE' THEN 'assets' WHEN 'MEDIUM' THEN 'extra_maps' WHEN 'PROMO' THEN 'extra_lessons' ELSE 'updates' END AS category, p_name AS title, CAST(p_partkey AS INT) AS sort_order
FROM {part} WHERE p_partkey % 3 = 2""",
    "f_progress_events": """
SELECT event_id, user_id, CAST(event_id % 27 AS INT) AS lesson_id, event_type IN ('view', 'click') AS viewed, event_type = 'purchase' AS completed, CAST(ts AS TIMESTAMP) - INTERVAL '8218' DAY AS ts
FROM {events} WHERE event_type IN ('view', 'click', 'purchase')""",
    "f_course_progress": """
SELECT user_id, lesson_id, bool_or(viewed OR completed) AS viewed, bool_or(completed) AS completed, min(CASE WHEN viewed OR completed THEN ts END) AS viewed_at, min(CASE WHEN completed THEN ts END) AS completed_at
FROM {f_progress_events} WHERE lesson_id < 25 GROUP BY user_id, lesson_id""",
    "f_partner_payouts": """
SELECT l_orderkey, l_linenumber, l_suppkey AS partner_id, CAST(l_extendedprice AS DECIMAL(12,2)) AS amount, CASE l_returnflag WHEN 'A' THEN 'card' WHEN 'N' THEN 'usdt' ELSE 'sbp' END AS method, CASE WHEN l_linestatus = 'O' AND l_linenumber % 2 = 0 THEN 'pending' WHEN l_linestatus = 'O' THEN 'processing' WHEN l_linenumber % 4 = 0 THEN 'rejected' ELSE 'paid' END AS status, CAST(l_shipdate AS TIMESTAMP) AS created_at
FROM {lineitem}""",
    "f_payout_requests": """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS partner_id, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.02 AS DECIMAL(12,2)) AS amount, CASE WHEN l_linenumber = 7 THEN 'paypal' WHEN l_returnflag = 'A' THEN 'card' WHEN l_returnflag = 'N' THEN 'usdt' ELSE 'sbp' END AS method, CASE WHEN l_partkey % 13 = 0 THEN '  ' ELSE concat('acct-', CAST(l_partkey AS STRING)) END AS requisites
FROM {lineitem}""",
    "f_promo_codes": """
SELECT CAST(substring(p_brand, 7) AS INT) AS id, upper(replace(p_brand, '#', '')) AS code, CAST(substring(p_brand, 7) AS INT) AS discount_percent, CASE WHEN CAST(substring(p_brand, 7) AS INT) % 3 = 1 THEN TIMESTAMP '1997-01-01 00:00:00' WHEN CAST(substring(p_brand, 7) AS INT) % 3 = 2 THEN TIMESTAMP '2030-01-01 00:00:00' END AS expires_at, CAST(substring(p_brand, 7) AS INT) % 4 <> 0 AS is_active
FROM (SELECT DISTINCT p_brand
FROM {part}) b""",
    "f_partner_applications": """
SELECT c_custkey AS id, c_custkey AS user_id, c_name AS name, concat('applicant', CAST(c_custkey % 40 AS STRING), '@example.test') AS email, concat('@tg', CAST(c_custkey AS STRING)) AS telegram, CASE WHEN c_custkey % 15 = 1 THEN concat('partner', CAST(CAST(floor(c_custkey / 15) AS BIGINT) AS STRING)) ELSE concat('apply-', CAST(c_custkey AS STRING)) END AS slug, CASE WHEN c_custkey % 15 = 1 THEN 'approved' WHEN c_custkey % 2 = 0 THEN 'pending' ELSE 'rejected' END AS status, CAST(DATE '2000-01-01' + CAST((c_custkey * 31) % 577 AS INT) AS TIMESTAMP) AS created_at
FROM {customer} WHERE c_custkey % 15 IN (1, 2, 5, 9)""",
    "f_subscriptions": """
SELECT c_custkey AS user_id, 'partnership' AS plan, CASE WHEN c_custkey % 8 = 0 THEN 'expired' ELSE 'active' END AS status, CASE WHEN c_custkey % 12 = 4 THEN NULL ELSE CAST(DATE '2001-01-01' + CAST((c_custkey * 17) % 400 AS INT) AS TIMESTAMP) END AS expires_at
FROM {customer} WHERE c_custkey % 4 = 0""",
    "f_refresh_tokens": """
SELECT event_id AS id, user_id, md5(CAST(event_id AS STRING)) AS token_hash, CAST(ts AS TIMESTAMP) - INTERVAL '8218' DAY AS created_at, CAST(ts AS TIMESTAMP) - INTERVAL '8188' DAY AS expires_at
FROM {events} WHERE event_type IN ('click', 'view')""",
    "f_otp_codes": """
SELECT event_id AS id, concat('u', CAST(user_id AS STRING), '@example.test') AS email, CAST(100000 + event_id % 900000 AS STRING) AS code, CASE event_id % 3 WHEN 0 THEN 'verify_email' WHEN 1 THEN 'login' ELSE 'reset_password' END AS purpose, CAST(ts AS TIMESTAMP) - INTERVAL '8218' DAY AS created_at, CAST(ts AS TIMESTAMP) - INTERVAL '8218' DAY + INTERVAL '10' MINUTE AS expires_at, event_id % 2 = 0 AS used
FROM {events} WHERE event_type IN ('error', 'signup')""",
    "f_requests": """
SELECT event_id, user_id AS client_key, event_type AS route, CAST(ts AS TIMESTAMP) - INTERVAL '8218' DAY AS ts
FROM {events}""",
}

_REF = re.compile(r"\{(\w+)\}")
_VIEW_NAME = re.compile(r"\bf_\w+\b")


def sources_of(view: str) -> list[str]:
    """Driver tables or earlier views a fixture reads."""
    return _REF.findall(FIXTURE_SQL[view])


def duckdb_text(view: str) -> str:
    """The view body with plain table names, for the oracle's WITH prefix."""
    return _REF.sub(lambda m: m.group(1), FIXTURE_SQL[view]).strip()


class Fixtures:
    """Lazily built fixture DataFrames for one scale-factor directory.

    ``fx.users`` is the ``f_users`` view, and so on; each is built once per instance.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._built: dict[str, DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        if name not in self._built:
            args = {src: (self.view(src) if src.startswith("f_")
                          else read_table(self.spark, self.sf_dir, src))
                    for src in sources_of(name)}
            self._built[name] = self.spark.sql(FIXTURE_SQL[name], **args)
        return self._built[name]

    def __getattr__(self, item: str) -> DataFrame:
        if item.startswith("_") or f"f_{item}" not in FIXTURE_SQL:
            raise AttributeError(item)
        return self.view(f"f_{item}")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over the fixture views (referenced by their ``f_*`` names).

        Used for batch inputs of the data jobs, written once and shared with the
        oracle's WITH prefix so both engines see the same rows.
        """
        used = sorted(set(_VIEW_NAME.findall(text)) & set(FIXTURE_SQL))
        templ = _VIEW_NAME.sub(lambda m: "{%s}" % m.group(0) if m.group(0) in FIXTURE_SQL
                               else m.group(0), text.replace("{", "{{").replace("}", "}}"))
        return self.spark.sql(templ, **{v: self.view(v) for v in used})

    @cached_property
    def names(self) -> list[str]:
        return [n[2:] for n in FIXTURE_SQL]
