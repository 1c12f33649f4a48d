"""Registered chains of data jobs (28 + 42, 38 + 42), with oracle SQL.

The fixture tables a chain works on are stored and published, the chain runs on the stored
tables, and the query returns a table of the state it published.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..operators import chains
from ..session import checkpoint_dir
from ..sources.domain import publish, write_version
from ..streaming import progress as progress_table
from .jobs import _ADMITTED, AS_OF_CODES, AS_OF_CODES_SQL, B_PROGRESS_STATE, B_REVIEWS, B_ROLE_UPDATES, _TAKEN
from .registry import AS_OF, AS_OF_SQL, query


def _published(fx, tables: dict[str, DataFrame], steps, name: str) -> DataFrame:
    base = f"{checkpoint_dir(fx.spark).rstrip('/')}/chain-{uuid.uuid4().hex}"
    for n, df in tables.items():
        write_version(df, base, n, "0")
    publish(fx.spark, base, {n: "0" for n in tables})
    return chains.run_chain(fx.spark, base, {n: df.schema for n, df in tables.items()}, steps)[1][name]


def _partners_sql(made: str) -> str:
    return f"""
SELECT id, user_id, slug, promo_code, balance, total_earned FROM f_partners
UNION ALL
SELECT (SELECT max(id) FROM f_partners) + row_number() OVER (ORDER BY user_id), user_id, slug, upper(slug),
       CAST(0 AS DECIMAL(12,2)), CAST(0 AS DECIMAL(12,2))
FROM ({made})
"""


def _role_tables(fx):
    return {"users": fx.users, "partners": fx.partners, "partner_applications": fx.partner_applications}


query("chain_role_users", sql=f"""
WITH u AS ({B_ROLE_UPDATES})
SELECT x.id, x.email, x.name, CASE WHEN u.role IN ('user', 'partner', 'admin') THEN u.role ELSE x.role END AS role, x.email_verified,
       x.created_at, CASE WHEN u.role IN ('user', 'partner', 'admin') THEN {AS_OF_SQL} END AS updated_at
FROM f_users x LEFT JOIN u ON u.id = x.id
""")(lambda fx: _published(fx, _role_tables(fx), chains.role_steps(fx.sql(B_ROLE_UPDATES), AS_OF), "users"))

query("chain_role_partners", sql=f"""
WITH taken AS ({_TAKEN}),
p AS (SELECT x.id AS user_id, u.ts,
        coalesce(nullif(left(regexp_replace(lower(coalesce(nullif(x.name, ''), split_part(x.email, '@', 1))), '[^a-z0-9]', '', 'g'), 28), ''),
                 'partner') AS base
      FROM f_users x JOIN ({B_ROLE_UPDATES}) u ON u.id = x.id AND u.role = 'partner'
      WHERE NOT EXISTS (SELECT 1 FROM f_partners q WHERE q.user_id = x.id)),
s AS (SELECT user_id, ts, CASE WHEN base IN (SELECT slug FROM taken)
               OR row_number() OVER (PARTITION BY base ORDER BY ts, user_id) > 1 THEN base || CAST(user_id AS VARCHAR) ELSE base END AS slug FROM p)
{_partners_sql('''SELECT user_id, slug FROM s WHERE slug NOT IN (SELECT slug FROM taken)
      AND upper(slug) NOT IN (SELECT promo_code FROM f_partners)
      QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ts, user_id) = 1''')}
""")(lambda fx: _published(fx, _role_tables(fx), chains.role_steps(fx.sql(B_ROLE_UPDATES), AS_OF), "partners"))

query("chain_review_partners", sql=f"""
WITH a AS (SELECT x.id, x.user_id, x.slug, u.ts FROM f_partner_applications x JOIN ({B_REVIEWS}) u ON u.id = x.id AND u.status = 'approved'
           WHERE x.user_id IS NOT NULL AND coalesce(x.slug, '') <> '' AND x.user_id NOT IN (SELECT user_id FROM f_partners)),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, id) = 1)
{_partners_sql('''SELECT user_id, slug FROM b WHERE slug NOT IN (SELECT slug FROM f_partners)
      AND upper(slug) NOT IN (SELECT promo_code FROM f_partners)
      QUALIFY row_number() OVER (PARTITION BY slug ORDER BY ts, id) = 1''')}
""")(lambda fx: _published(fx, {"partners": fx.partners, "partner_applications": fx.partner_applications},
                           chains.review_steps(fx.sql(B_REVIEWS), AS_OF), "partners"))

# Codes sent to the users' own addresses; half of the users try theirs, some twice or wrongly.
B_USER_CODES = """
SELECT c.id, u.email, c.code, c.purpose, c.created_at, c.expires_at + INTERVAL '1' DAY * CAST(c.id % 20 AS INT) AS expires_at, c.used
FROM f_otp_codes c JOIN f_users u ON c.email = concat('u', CAST(u.id AS STRING), '@example.test')"""
B_USER_ATTEMPTS = f"""
SELECT id AS attempt_id, concat(' ', upper(email)) AS email, purpose, CASE WHEN id % 9 = 0 THEN 'wrong' ELSE code END AS code
FROM ({B_USER_CODES}) c WHERE id % 2 = 1
UNION ALL
SELECT id + 100000000 AS attempt_id, email, purpose, code FROM ({B_USER_CODES}) c WHERE id % 6 = 1"""
_GOOD = f"""
codes AS ({B_USER_CODES}),
good AS (SELECT DISTINCT c.id, c.email, c.purpose FROM codes c JOIN ({B_USER_ATTEMPTS}) a
         ON lower(trim(a.email)) = c.email AND a.purpose = c.purpose AND a.code = c.code
         WHERE NOT c.used AND {AS_OF_CODES_SQL} <= c.expires_at
           AND NOT EXISTS (SELECT 1 FROM codes d WHERE d.email = c.email AND d.purpose = c.purpose AND d.code = c.code
                           AND (d.created_at, d.id) > (c.created_at, c.id)))"""


def _verified(name: str):
    return lambda fx: _published(fx, {"users": fx.users, "otp_codes": fx.sql(B_USER_CODES)},
                                 chains.verify_steps(fx.sql(B_USER_ATTEMPTS), AS_OF_CODES), name)


query("chain_verify_users", sql=f"""
WITH {_GOOD},
v AS (SELECT DISTINCT email FROM good WHERE purpose = 'verify_email')
SELECT x.id, x.email, x.name, x.role, x.email_verified OR v.email IS NOT NULL AS email_verified, x.created_at,
       CASE WHEN v.email IS NOT NULL THEN {AS_OF_CODES_SQL} END AS updated_at
FROM f_users x LEFT JOIN v ON v.email = x.email
""")(_verified("users"))

query("chain_verify_codes", sql=f"""
WITH {_GOOD}
SELECT c.* REPLACE (c.used OR c.id IN (SELECT id FROM good) AS used) FROM codes c
""")(_verified("otp_codes"))

# Every code asks for a new address; some of these are taken, some asked for twice.
B_CHANGE_CODES = """
SELECT c.id, u.email, c.code, concat('change_email:', CASE WHEN c.id % 8 = 0 THEN concat('customer.00000000', CAST(1 + c.id % 9 AS STRING))
       ELSE concat('new', CAST(c.id % 700 AS STRING)) END, '@example.test') AS purpose, c.created_at,
       c.expires_at + INTERVAL '1' DAY * CAST(c.id % 20 AS INT) AS expires_at, c.used
FROM f_otp_codes c JOIN f_users u ON c.email = concat('u', CAST(u.id AS STRING), '@example.test')"""
B_CHANGES = f"""
SELECT c.id AS attempt_id, CASE WHEN c.id % 31 = 0 THEN u.id + 100000000 ELSE u.id END AS user_id, c.email,
       CASE WHEN c.id % 9 = 1 THEN 'wrong' ELSE c.code END AS code
FROM ({B_CHANGE_CODES}) c JOIN f_users u ON u.email = c.email WHERE u.id % 4 <> 1"""
_CHANGES_SQL = f"""
codes AS ({B_CHANGE_CODES}),
tries AS (SELECT a.attempt_id, a.user_id, n.id AS code_id, substr(n.purpose, 14) AS new_email,
            CASE WHEN n.id IS NULL THEN 'invalid' WHEN n.used THEN 'used' WHEN {AS_OF_CODES_SQL} > n.expires_at THEN 'expired'
                 WHEN a.user_id NOT IN (SELECT id FROM f_users) THEN 'not_found'
                 WHEN substr(n.purpose, 14) IN (SELECT email FROM f_users) THEN 'email_taken' END AS fault
          FROM ({B_CHANGES}) a LEFT JOIN (SELECT * FROM codes QUALIFY row_number() OVER (PARTITION BY email, code ORDER BY created_at DESC, id DESC) = 1) n
            ON n.email = lower(trim(a.email)) AND n.code = a.code),
own AS (SELECT *, fault IS NULL AND row_number() OVER (PARTITION BY user_id, fault IS NULL ORDER BY attempt_id) = 1 AS mine FROM tries),
changes AS (SELECT attempt_id, user_id, code_id, new_email, CASE WHEN fault IS NOT NULL THEN fault WHEN NOT mine THEN 'superseded'
              WHEN row_number() OVER (PARTITION BY new_email, mine ORDER BY attempt_id) > 1 THEN 'email_taken' ELSE 'changed' END AS outcome FROM own)"""


def _changed(name: str):
    return lambda fx: _published(fx, {"users": fx.users, "otp_codes": fx.sql(B_CHANGE_CODES), "refresh_tokens": fx.refresh_tokens},
                                 chains.email_change_steps(fx.sql(B_CHANGES), AS_OF_CODES), name)


query("email_changes", sql=f"WITH {_CHANGES_SQL} SELECT * FROM changes")(
    lambda fx: chains.email_changes(fx.sql(B_CHANGES), fx.sql(B_CHANGE_CODES), fx.users, AS_OF_CODES))
query("chain_email_users", sql=f"""
WITH {_CHANGES_SQL},
won AS (SELECT user_id, new_email FROM changes WHERE outcome = 'changed')
SELECT u.id, coalesce(won.new_email, u.email) AS email, u.name, u.role, u.email_verified, u.created_at,
       CASE WHEN won.user_id IS NOT NULL THEN {AS_OF_CODES_SQL} END AS updated_at
FROM f_users u LEFT JOIN won ON won.user_id = u.id
""")(_changed("users"))
query("chain_email_codes", sql=f"""
WITH {_CHANGES_SQL}
SELECT c.* REPLACE (c.used OR c.id IN (SELECT code_id FROM changes WHERE outcome = 'changed') AS used) FROM codes c
""")(_changed("otp_codes"))
query("chain_email_tokens", sql=f"""
WITH {_CHANGES_SQL}
SELECT * FROM f_refresh_tokens WHERE user_id NOT IN (SELECT user_id FROM changes WHERE outcome = 'changed')
""")(_changed("refresh_tokens"))

# ------------------------------------------ item 31 on the stored, bucketed table

def _upserted(fx) -> DataFrame:
    base = f"{checkpoint_dir(fx.spark).rstrip('/')}/progress-{uuid.uuid4().hex}"
    progress_table.create_progress_table(fx.sql(B_PROGRESS_STATE), base)
    progress_table.upsert_stored(fx.spark, base, fx.progress_events, fx.lessons, fx.orders, fx.users)
    return progress_table.read_progress_table(fx.spark, base)


query("progress_upsert_stored", sql=f"""
WITH {_ADMITTED},
s AS ({B_PROGRESS_STATE})
SELECT user_id, lesson_id, bool_or(viewed) AS viewed, bool_or(completed) AS completed,
       coalesce(min(viewed_at) FILTER (old), min(viewed_at)) AS viewed_at, coalesce(min(completed_at) FILTER (old), min(completed_at)) AS completed_at
FROM (SELECT *, TRUE AS old FROM s UNION ALL SELECT *, FALSE FROM fold) GROUP BY user_id, lesson_id
""")(_upserted)
