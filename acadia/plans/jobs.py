"""Registered data-job queries (items 25-46) with their oracle SQL.

Each job's command batch is a SQL text over the fixture views (``B_*`` below).  Spark
runs it through ``Fixtures.sql``; the oracle embeds the same text as a CTE, so both
engines start from identical rows.  The batches only shape existing rows into the
command schema a job expects; all of the job's work happens in the operator.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from ..operators import (access, applications, content, intake, integrity, payouts,
                         progress, promo, purge, sessions)
from ..functions.filters import ts_lit
from ..session import checkpoint_dir
from ..sources.domain import publish, write_version
from ..sources.versions import read_version as read_stored
from .registry import AS_OF, AS_OF_SQL, query

# --------------------------------------------------------------------- command batches

B_PROMO_REQUESTS = """
SELECT id AS request_id,
       CASE WHEN id % 4 = 0 THEN concat('  ', lower(promo_code), ' ') WHEN id % 7 = 0 THEN ''
            ELSE promo_code END AS code
FROM f_orders"""

B_SLUG_REQUESTS = """
SELECT id AS request_id,
       CASE id % 5 WHEN 0 THEN concat('partner', CAST(id % 130 AS STRING))
                   WHEN 1 THEN concat(' Apply-', CAST(id AS STRING), ' ')
                   WHEN 2 THEN concat('new-', CAST(id AS STRING))
                   WHEN 3 THEN 'ab'
                   ELSE concat('Bad Slug ', CAST(id AS STRING)) END AS slug
FROM f_users"""

B_APPLICATIONS = """
SELECT id AS request_id, created_at AS ts, id AS user_id,
       CASE WHEN id % 13 = 0 THEN '' ELSE name END AS name,
       CASE WHEN id % 3 = 0 THEN concat(' Applicant', CAST(id % 40 AS STRING), '@Example.test ')
            ELSE email END AS email,
       CASE id % 6 WHEN 0 THEN concat('partner', CAST(id % 110 AS STRING))
                   WHEN 1 THEN concat('Slug-', CAST(id % 200 AS STRING))
                   WHEN 2 THEN concat('apply-', CAST(id AS STRING))
                   WHEN 3 THEN 'x!'
                   ELSE concat('fresh-', CAST(id % 500 AS STRING)) END AS slug,
       CASE WHEN id % 2 = 0 THEN '  ' ELSE concat('@t', CAST(id AS STRING)) END AS telegram,
       CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ambassador' END AS cooperation_type
FROM f_users"""

B_PROMOTED = """
SELECT CASE WHEN id % 60 = 3 THEN id + 100000000 ELSE id END AS user_id, created_at AS ts
FROM f_users WHERE role = 'partner' OR id % 20 = 3"""

B_APPROVED = """
SELECT id, CASE WHEN id % 35 = 0 THEN NULL ELSE user_id END AS user_id,
       CASE id % 9 WHEN 0 THEN concat('partner', CAST(id % 90 AS STRING)) WHEN 1 THEN 'same-slug' WHEN 2 THEN '' ELSE slug END AS slug,
       created_at AS ts
FROM f_partner_applications WHERE status = 'approved' OR id % 2 = 0"""

B_PAYOUT_UPDATES = """
SELECT DISTINCT CASE WHEN l_orderkey % 97 = 0 THEN l_orderkey + 100000000 ELSE l_orderkey END AS l_orderkey, l_linenumber,
       CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'paid' WHEN 1 THEN 'rejected'
            WHEN 2 THEN 'processing' ELSE 'cancelled' END AS status,
       CASE WHEN (l_orderkey + l_linenumber) % 4 = 1 THEN 'bad requisites' END AS reject_reason,
       created_at + INTERVAL '1' DAY AS ts
FROM f_partner_payouts"""

# Two thirds of the users, an hour early; odd lessons have not been completed yet.
B_PROGRESS_STATE = """
SELECT user_id, lesson_id, viewed, completed AND lesson_id % 2 = 0 AS completed, viewed_at - INTERVAL '1' HOUR AS viewed_at,
       CASE WHEN lesson_id % 2 = 0 THEN completed_at END AS completed_at
FROM f_course_progress WHERE user_id % 3 > 0"""

B_RESETS = """
SELECT id AS actor_id, CASE WHEN id % 3 = 0 THEN id + 1 END AS target_user_id
FROM f_users WHERE id % 7 = 0 OR role = 'admin'"""

B_ACCESS_USERS = "SELECT id AS user_id FROM f_users"

B_PURGE_USERS = "SELECT id AS user_id FROM f_users WHERE id % 25 = 1 OR id = 150"
PURGE_ACTOR = 150
# Every fifth partner but the first has no attributed orders left, so that partners can be purged too.
B_PURGE_ORDERS = """
SELECT id, user_id, product, amount, CASE WHEN referral_partner_id % 5 <> 0 OR referral_partner_id = 0 THEN referral_partner_id END AS referral_partner_id,
       promo_code, status, created_at, paid_at
FROM f_orders"""

B_TOPICS = """
SELECT id AS request_id, CASE WHEN id % 13 = 5 THEN lesson_id + 25 ELSE lesson_id END AS lesson_id,
       CASE WHEN id % 10 = 1 THEN '   ' ELSE concat('  ', title, ' ') END AS text,
       CAST(DATE '2001-07-01' AS TIMESTAMP) + INTERVAL '1' SECOND * CAST(id % 1000 AS INT) AS ts
FROM f_lesson_videos"""

B_MATERIALS = """
SELECT id AS request_id,
       CASE id % 7 WHEN 0 THEN 'maps' WHEN 1 THEN 'assets' WHEN 2 THEN 'extra_maps'
                   WHEN 3 THEN 'extra_lessons' WHEN 4 THEN 'updates' WHEN 5 THEN 'bogus'
                   ELSE 'maps' END AS category,
       CASE WHEN id % 11 = 0 THEN '' ELSE text END AS title,
       CAST(DATE '2001-07-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(id % 500 AS INT) AS ts
FROM f_lesson_topics"""

B_LESSONS_NEW = """
SELECT id AS request_id, CASE WHEN id % 13 = 0 THEN '  ' ELSE concat(' ', title) END AS title,
       CAST(DATE '2001-07-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(id % 1000 AS INT) AS ts
FROM f_materials"""

B_LESSON_PATCHES = """
SELECT user_id * 1000 + lesson_id AS patch_id, lesson_id AS id,
       CASE WHEN user_id % 8 = 6 THEN '   ' ELSE concat(' Lesson ', CAST(lesson_id AS STRING), ' by ',
            CAST(user_id AS STRING), ' ') END AS title,
       user_id % 2 = 0 AS set_title,
       CASE WHEN user_id % 5 = 0 THEN 'last' WHEN user_id % 5 = 1 THEN '99999999999'
            WHEN user_id % 5 = 2 THEN concat(' ', CAST(100 + user_id % 50 AS STRING), '.7px')
            ELSE CAST(100 + user_id % 50 AS STRING) END AS sort_order, user_id % 3 = 0 AS set_sort_order,
       coalesce(viewed_at, CAST(DATE '2001-07-01' AS TIMESTAMP)) AS ts
FROM f_course_progress
UNION ALL
SELECT -id AS patch_id, id + 1000 AS id, 'Ghost' AS title, TRUE AS set_title,
       '1' AS sort_order, FALSE AS set_sort_order, CAST(DATE '2001-07-02' AS TIMESTAMP) AS ts
FROM f_materials WHERE id % 50 = 2"""

B_LESSON_SEEDS = """
SELECT CAST(id % 60 AS INT) AS id, concat('Seed ', title) AS title, CAST(id % 60 + 1 AS INT) AS sort_order,
       id % 6 = 0 AS is_free, id AS request_id,
       CAST(DATE '2001-07-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(id % 977 AS INT) AS ts
FROM f_materials"""

B_ROLE_UPDATES = """
SELECT id AS update_id, id,
       CASE id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'partner' WHEN 3 THEN 'owner' ELSE 'user' END AS role,
       created_at AS ts
FROM f_users"""

B_REVIEWS = """
SELECT id AS update_id, id,
       CASE id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'archived' END AS status,
       CASE WHEN id % 3 = 1 THEN concat('reason ', CAST(id AS STRING)) END AS reject_reason,
       CAST(150 AS BIGINT) AS actor_id, created_at AS ts
FROM f_partner_applications"""

B_PROMO_LOAD = """
SELECT id AS request_id,
       CASE id % 5 WHEN 0 THEN concat(' brand', CAST(id % 30 AS STRING))
                   WHEN 1 THEN concat('spring', CAST(id % 7 AS STRING))
                   WHEN 2 THEN '   '
                   ELSE concat('code', CAST(id AS STRING)) END AS code,
       CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN '0' WHEN 2 THEN CAST(id % 150 AS STRING)
                   ELSE ' 25x' END AS discount,
       CAST(NULL AS TIMESTAMP) AS expires_at,
       CAST(DATE '2001-07-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * CAST(id % 977 AS INT) AS ts
FROM f_materials"""

B_SIGNUPS = """
SELECT id AS request_id, created_at AS ts,
       CASE id % 4 WHEN 0 THEN upper(email)
                   WHEN 1 THEN concat('  new', CAST(id AS STRING), '@example.test ')
                   WHEN 2 THEN concat('new', CAST(id % 50 AS STRING), '@example.test')
                   ELSE '' END AS email,
       CASE WHEN id % 3 = 0 THEN '  ' ELSE name END AS name
FROM f_users"""

# Twice as many lessons as anybody has opened, with the topics and videos spread over all of
# them, so a delete finds blocked, free and unknown ids.
B_COURSE_LESSONS = """
SELECT id, title, sort_order, is_free FROM f_lessons
UNION ALL SELECT CAST(id + 25 AS INT) AS id, title, sort_order, is_free FROM f_lessons"""
B_COURSE_TOPICS = "SELECT id, CAST(id % 50 AS INT) AS lesson_id, text, sort_order FROM f_lesson_topics"
B_COURSE_VIDEOS = "SELECT id, CAST(id % 50 AS INT) AS lesson_id, title, video_url, is_main, sort_order FROM f_lesson_videos"
B_LESSON_DELETES = """
SELECT id FROM f_lessons WHERE id % 4 = 0
UNION ALL SELECT CAST(id * 3 + 20 AS INT) AS id FROM f_lessons"""

B_ATTEMPTS = """
SELECT id AS attempt_id, email, purpose, CASE WHEN id % 5 = 0 THEN '000000' ELSE code END AS code
FROM f_otp_codes
UNION ALL
SELECT -id AS attempt_id, upper(concat(' ', email)) AS email, purpose, code FROM f_otp_codes WHERE id % 3 = 0"""
# Within the months in which codes were issued, so that some are still good.
AS_OF_CODES = dt.datetime(2001, 7, 15)
AS_OF_CODES_SQL = "TIMESTAMP '2001-07-15 00:00:00'"

AS_OF_LATE = dt.datetime(2001, 8, 15)
AS_OF_LATE_SQL = "TIMESTAMP '2001-08-15 00:00:00'"

# ----------------------------------------------------------- item 25: promo resolution

query("promo_resolution", sql=f"""
WITH req AS ({B_PROMO_REQUESTS}),
r AS (SELECT request_id, upper(trim(coalesce(code, ''))) AS code FROM req),
d AS (SELECT k, discount_percent, is_active, expires_at FROM (
        SELECT upper(code) AS k, discount_percent, is_active, expires_at,
               row_number() OVER (PARTITION BY upper(code) ORDER BY id) AS rn
        FROM f_promo_codes) WHERE rn = 1),
p AS (SELECT DISTINCT promo_code FROM f_partners WHERE user_id IN (SELECT id FROM f_users)),
o AS (SELECT r.request_id, r.code,
        CASE WHEN r.code = '' THEN 'missing'
             WHEN d.k IS NOT NULL AND NOT d.is_active THEN 'inactive'
             WHEN d.k IS NOT NULL AND d.expires_at IS NOT NULL AND d.expires_at < {AS_OF_SQL} THEN 'expired'
             WHEN d.k IS NOT NULL THEN 'discount'
             WHEN p.promo_code IS NOT NULL THEN 'partner' ELSE 'not_found' END AS outcome,
        d.discount_percent
      FROM r LEFT JOIN d ON d.k = r.code LEFT JOIN p ON p.promo_code = r.code)
SELECT request_id, code, outcome,
       CASE outcome WHEN 'discount' THEN discount_percent WHEN 'partner' THEN 0 END AS discount
FROM o
""")(lambda fx: promo.promo_resolution(fx.sql(B_PROMO_REQUESTS), fx.promo_codes, fx.partners,
                                       fx.users, AS_OF))

# ------------------------------------------------------------ item 26: slug availability

_TAKEN = """SELECT slug FROM f_partner_applications WHERE slug IS NOT NULL
            UNION SELECT slug FROM f_partners WHERE slug IS NOT NULL"""

query("slug_availability", sql=f"""
WITH req AS ({B_SLUG_REQUESTS}),
r AS (SELECT request_id, trim(lower(coalesce(slug, ''))) AS slug FROM req),
t AS ({_TAKEN})
SELECT r.request_id, r.slug, regexp_matches(r.slug, '^[a-z0-9-]{{3,32}}$') AS valid,
       regexp_matches(r.slug, '^[a-z0-9-]{{3,32}}$') AND t.slug IS NULL AS available
FROM r LEFT JOIN t ON t.slug = r.slug
""".replace("{{", "{").replace("}}", "}"))(
    lambda fx: applications.slug_availability(fx.sql(B_SLUG_REQUESTS), fx.partner_applications,
                                              fx.partners))

# --------------------------------------------------------- item 27: application admission

query("application_admission", sql=f"""
WITH req AS ({B_APPLICATIONS}),
b0 AS (SELECT request_id, ts, user_id,
         name IS NOT NULL AND name <> '' AND email IS NOT NULL AND email <> ''
           AND slug IS NOT NULL AND slug <> '' AS req_ok,
         trim(name) AS name, lower(trim(email)) AS email, trim(lower(slug)) AS slug,
         nullif(trim(telegram), '') AS telegram,
         coalesce(nullif(cooperation_type, ''), 'partner') AS cooperation_type
       FROM req),
taken AS ({_TAKEN}),
la AS (SELECT email, status = 'pending' AS pending FROM (
         SELECT email, status, row_number() OVER (PARTITION BY email ORDER BY created_at DESC, id DESC) AS rn
         FROM f_partner_applications WHERE email IS NOT NULL) WHERE rn = 1),
b1 AS (SELECT b0.*, t.slug IS NOT NULL AS taken, coalesce(la.pending, FALSE) AS pending,
              coalesce(regexp_matches(b0.slug, '^[a-z0-9-]{{3,32}}$'), FALSE) AS valid
       FROM b0 LEFT JOIN taken t ON t.slug = b0.slug LEFT JOIN la ON la.email = b0.email),
b2 AS (SELECT *, req_ok AND valid AND NOT taken AS static_ok FROM b1),
b3 AS (SELECT *, CASE WHEN static_ok THEN row_number() OVER (PARTITION BY slug, static_ok
                  ORDER BY ts, request_id) = 1 ELSE FALSE END AS slug_first FROM b2),
b4 AS (SELECT *, static_ok AND slug_first AND NOT pending AS survivor FROM b3),
b5 AS (SELECT *, CASE WHEN survivor THEN row_number() OVER (PARTITION BY email, survivor
                  ORDER BY ts, request_id) = 1 ELSE FALSE END AS email_first FROM b4),
b6 AS (SELECT *, CASE WHEN NOT req_ok THEN 'required' WHEN NOT valid THEN 'invalid_slug'
                      WHEN taken OR NOT slug_first THEN 'slug_taken'
                      WHEN pending OR NOT email_first THEN 'pending_exists' END AS reason FROM b5)
SELECT request_id, ts, user_id, name, email, slug, telegram, cooperation_type,
       CASE WHEN reason IS NULL THEN 'pending' END AS status, reason
FROM b6
""".replace("{{", "{").replace("}}", "}"))(
    lambda fx: applications.application_admission(fx.sql(B_APPLICATIONS), fx.partner_applications,
                                                  fx.partners))

# ---------------------------------------------------------- item 28: partner provisioning

query("partner_provisioning", sql=f"""
WITH req AS ({B_PROMOTED}),
taken AS ({_TAKEN}),
b0 AS (SELECT req.user_id, req.ts, u.id AS uid, p.user_id AS puser,
         coalesce(nullif(substr(regexp_replace(lower(coalesce(nullif(u.name, ''),
                   split_part(u.email, '@', 1))), '[^a-z0-9]', '', 'g'), 1, 28), ''), 'partner') AS base
       FROM req LEFT JOIN f_users u ON u.id = req.user_id
       LEFT JOIN (SELECT DISTINCT user_id FROM f_partners) p ON p.user_id = req.user_id),
b1 AS (SELECT b0.*, t.slug IS NOT NULL AS base_taken,
              uid IS NOT NULL AND puser IS NULL AS eligible FROM b0 LEFT JOIN taken t ON t.slug = b0.base),
b2 AS (SELECT *, CASE WHEN eligible THEN row_number() OVER (PARTITION BY base, eligible
                  ORDER BY ts, user_id) = 1 ELSE FALSE END AS first_base FROM b1),
b3 AS (SELECT *, CASE WHEN eligible THEN (CASE WHEN NOT base_taken AND first_base THEN base
                  ELSE concat(base, CAST(user_id AS STRING)) END) END AS slug FROM b2)
SELECT b3.user_id, b3.slug, upper(b3.slug) AS promo_code,
       CASE WHEN uid IS NULL THEN 'unknown_user' WHEN puser IS NOT NULL THEN 'skipped'
            WHEN t.slug IS NOT NULL THEN 'slug_conflict' ELSE 'created' END AS outcome
FROM b3 LEFT JOIN taken t ON t.slug = b3.slug
""")(lambda fx: applications.partner_provisioning(fx.sql(B_PROMOTED), fx.users, fx.partners,
                                                  fx.partner_applications))

query("partner_approvals", sql=f"""
WITH req AS ({B_APPROVED}),
b0 AS (SELECT req.*, req.user_id IS NOT NULL AND req.slug IS NOT NULL AND req.slug <> '' AS ok,
              p.user_id IS NOT NULL AS has_partner,
              hs.slug IS NOT NULL OR hc.promo_code IS NOT NULL AS held
       FROM req LEFT JOIN (SELECT DISTINCT user_id FROM f_partners) p ON p.user_id = req.user_id
       LEFT JOIN (SELECT DISTINCT slug FROM f_partners) hs ON hs.slug = req.slug
       LEFT JOIN (SELECT DISTINCT promo_code FROM f_partners) hc ON hc.promo_code = upper(req.slug)),
b1 AS (SELECT *, ok AND NOT has_partner AS fresh FROM b0),
b2 AS (SELECT *, CASE WHEN fresh THEN row_number() OVER (PARTITION BY user_id, fresh ORDER BY ts, id) = 1
                 ELSE FALSE END AS first_user FROM b1),
b3 AS (SELECT *, fresh AND first_user AND NOT held AS cand FROM b2),
b4 AS (SELECT *, CASE WHEN cand THEN row_number() OVER (PARTITION BY slug, cand ORDER BY ts, id) = 1
                 ELSE FALSE END AS first_slug FROM b3)
SELECT id AS application_id, user_id, slug, upper(slug) AS promo_code,
       CASE WHEN NOT ok THEN 'missing_user_or_slug'
            WHEN has_partner OR NOT first_user THEN 'skipped'
            WHEN held OR NOT first_slug THEN 'slug_conflict' ELSE 'created' END AS outcome
FROM b4
""")(lambda fx: applications.partners_from_approvals(fx.sql(B_APPROVED), fx.partners))

# ------------------------------------------------------------- item 29: payout admission

_PAYOUT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "amount", "method", "requisites"]
_RATE_SQL = ("CAST(CASE method WHEN 'card' THEN 0.02 WHEN 'usdt' THEN 0.01 WHEN 'sbp' THEN 0 END"
             " AS DECIMAL(5,4))")

_PAYOUT_CHECKS = f"""
ck AS (
  SELECT r.*, p.balance AS start_balance,
         CASE WHEN p.id IS NULL THEN 'partner_not_found'
              WHEN r.amount IS NULL OR r.amount < 500 THEN 'min_amount'
              WHEN r.method IS NULL OR r.method NOT IN ('card', 'usdt', 'sbp') THEN 'bad_method'
              WHEN coalesce(trim(r.requisites), '') = '' THEN 'no_requisites' END AS static_reason,
         {_RATE_SQL.replace('method', 'r.method')} AS commission_rate
  FROM f_payout_requests r LEFT JOIN f_partners p ON p.id = r.partner_id),
ck2 AS (
  SELECT *, CAST(ROUND(amount * commission_rate, 2) AS DECIMAL(12,2)) AS commission_amount
  FROM ck)"""

query("payout_checks", sql=f"""
WITH {_PAYOUT_CHECKS}
SELECT l_orderkey, l_linenumber, l_partkey, partner_id, amount, method, requisites,
       start_balance, static_reason, commission_rate, commission_amount,
       CAST(amount - commission_amount AS DECIMAL(12,2)) AS amount_to_receive
FROM ck2
""")(lambda fx: payouts.payout_checks(fx.payout_requests, fx.partners))

query("payout_admission", sql=f"""
WITH RECURSIVE {_PAYOUT_CHECKS},
ck3 AS (
  SELECT *, CASE WHEN static_reason IS NULL THEN row_number() OVER (
              PARTITION BY partner_id, static_reason IS NULL
              ORDER BY {', '.join(_PAYOUT_ORDER)}) END AS rn
  FROM ck2),
fold AS (
  SELECT partner_id, rn,
         CAST(CASE WHEN amount <= start_balance THEN start_balance - amount ELSE start_balance END
              AS DECIMAL(12,2)) AS bal,
         amount <= start_balance AS adm
  FROM ck3 WHERE rn = 1
  UNION ALL
  SELECT c.partner_id, c.rn,
         CAST(CASE WHEN c.amount <= f.bal THEN f.bal - c.amount ELSE f.bal END AS DECIMAL(12,2)),
         c.amount <= f.bal
  FROM fold f JOIN ck3 c ON c.partner_id = f.partner_id AND c.rn = f.rn + 1)
SELECT c.l_orderkey, c.l_linenumber, c.l_partkey, c.partner_id, c.amount, c.method, c.requisites,
       coalesce(c.static_reason, CASE WHEN f.adm THEN NULL ELSE 'insufficient_balance' END) AS reason,
       c.commission_rate, c.commission_amount,
       CAST(c.amount - c.commission_amount AS DECIMAL(12,2)) AS amount_to_receive,
       CASE WHEN f.adm THEN f.bal END AS balance_after
FROM ck3 c LEFT JOIN fold f ON f.partner_id = c.partner_id AND f.rn = c.rn
""")(lambda fx: payouts.payout_admission(fx.payout_requests, fx.partners, _PAYOUT_ORDER))

# ------------------------------------------------------------ item 30: payout status batch

_KEY = ["l_orderkey", "l_linenumber"]
_STATUS_CTE = f"""
u AS ({B_PAYOUT_UPDATES}),
v AS (SELECT u.* FROM u WHERE status IN ('processing', 'paid', 'rejected')
        AND EXISTS (SELECT 1 FROM f_partner_payouts p
                    WHERE p.l_orderkey = u.l_orderkey AND p.l_linenumber = u.l_linenumber)),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                  ORDER BY ts DESC, status DESC) AS rn FROM v) WHERE rn = 1),
j AS (SELECT p.*, last.status AS new_status, last.reject_reason AS why
      FROM f_partner_payouts p LEFT JOIN last
        ON last.l_orderkey = p.l_orderkey AND last.l_linenumber = p.l_linenumber)"""


def _status_batch(fx):
    return payouts.payout_status_batch(fx.sql(B_PAYOUT_UPDATES), fx.partner_payouts, fx.partners,
                                       AS_OF, _KEY)


query("payout_status_payouts", sql=f"""
WITH {_STATUS_CTE}
SELECT l_orderkey, l_linenumber, partner_id, amount, method, created_at,
       coalesce(new_status, status) AS status,
       CASE WHEN new_status IS NOT NULL THEN why END AS reject_reason,
       CASE WHEN new_status IN ('paid', 'rejected') THEN {AS_OF_SQL} END AS processed_at
FROM j
""")(lambda fx: _status_batch(fx)[0])

query("payout_status_partners", sql=f"""
WITH {_STATUS_CTE},
refund AS (SELECT partner_id, SUM(amount) AS add_amount FROM j
           WHERE new_status = 'rejected' AND status <> 'rejected' GROUP BY partner_id)
SELECT p.id, p.user_id, p.slug, p.promo_code,
       CAST(p.balance + coalesce(r.add_amount, 0) AS DECIMAL(12,2)) AS balance, p.total_earned
FROM f_partners p LEFT JOIN refund r ON r.partner_id = p.id
""")(lambda fx: _status_batch(fx)[1])

query("payout_status_rejects", sql=f"""
WITH u AS ({B_PAYOUT_UPDATES})
SELECT u.*, CASE WHEN status NOT IN ('processing', 'paid', 'rejected') THEN 'bad_status'
                 ELSE 'not_found' END AS reason
FROM u WHERE status NOT IN ('processing', 'paid', 'rejected')
   OR NOT EXISTS (SELECT 1 FROM f_partner_payouts p
                  WHERE p.l_orderkey = u.l_orderkey AND p.l_linenumber = u.l_linenumber)
""")(lambda fx: _status_batch(fx)[2])

# --------------------------------------------------------- items 31, 35: progress jobs

_ADMITTED = """
adm AS (SELECT e.* FROM f_progress_events e JOIN f_lessons l ON l.id = e.lesson_id
        WHERE l.is_free OR e.user_id IN (SELECT id FROM f_users WHERE role = 'admin')
           OR e.user_id IN (SELECT user_id FROM f_orders WHERE status = 'paid')),
fold AS (SELECT user_id, lesson_id, bool_or(viewed OR completed) AS viewed,
                bool_or(completed) AS completed,
                min(CASE WHEN viewed OR completed THEN ts END) AS viewed_at,
                min(CASE WHEN completed THEN ts END) AS completed_at
         FROM adm GROUP BY user_id, lesson_id)"""


def _empty_progress(fx):
    return fx.course_progress.where(F.lit(False))


query("progress_upsert_fresh", sql=f"WITH {_ADMITTED} SELECT * FROM fold")(
    lambda fx: progress.progress_upsert(fx.progress_events, _empty_progress(fx), fx.lessons,
                                        fx.orders, fx.users))


def _upsert_in_two_batches(fx):
    cut = ts_lit("2001-07-16 00:00:00")
    ev = fx.progress_events
    first = progress.progress_upsert(ev.where(F.col("ts") < cut), _empty_progress(fx),
                                     fx.lessons, fx.orders, fx.users)
    return progress.progress_upsert(ev.where(F.col("ts") >= cut), first, fx.lessons, fx.orders,
                                    fx.users)


query("progress_upsert_two_batches", sql=f"WITH {_ADMITTED} SELECT * FROM fold")(
    _upsert_in_two_batches)

query("progress_upsert_existing", sql=f"""
WITH {_ADMITTED},
s AS ({B_PROGRESS_STATE})
SELECT coalesce(s.user_id, n.user_id) AS user_id, coalesce(s.lesson_id, n.lesson_id) AS lesson_id,
       coalesce(s.viewed, FALSE) OR coalesce(n.viewed, FALSE) AS viewed,
       coalesce(s.completed, FALSE) OR coalesce(n.completed, FALSE) AS completed,
       coalesce(s.viewed_at, n.viewed_at) AS viewed_at,
       coalesce(s.completed_at, n.completed_at) AS completed_at
FROM s FULL OUTER JOIN fold n
  ON s.user_id = n.user_id AND s.lesson_id = n.lesson_id
""")(lambda fx: progress.progress_upsert(fx.progress_events, fx.sql(B_PROGRESS_STATE), fx.lessons,
                                         fx.orders, fx.users))

query("progress_reset", sql=f"""
WITH req AS ({B_RESETS}),
t AS (SELECT DISTINCT CASE WHEN u.role = 'admin' AND req.target_user_id IS NOT NULL
                           THEN req.target_user_id ELSE req.actor_id END AS uid
      FROM req LEFT JOIN f_users u ON u.id = req.actor_id)
SELECT * FROM f_course_progress WHERE user_id NOT IN (SELECT uid FROM t WHERE uid IS NOT NULL)
""")(lambda fx: progress.progress_reset(fx.sql(B_RESETS), fx.course_progress, fx.users))

# ---------------------------------------------------------------- items 32, 33: access

query("access_grant", sql=f"""
WITH req AS ({B_ACCESS_USERS}),
todo AS (SELECT DISTINCT user_id FROM req WHERE user_id IN (SELECT id FROM f_users)
         AND user_id NOT IN (SELECT user_id FROM f_orders WHERE status = 'paid' AND user_id IS NOT NULL)),
top AS (SELECT coalesce(max(id), 0) AS m FROM f_orders)
SELECT * FROM f_orders
UNION ALL
SELECT top.m + row_number() OVER (ORDER BY todo.user_id), todo.user_id, 'Essential', CAST(0 AS DECIMAL(12,2)), CAST(NULL AS BIGINT),
       CAST(NULL AS VARCHAR), 'paid', {AS_OF_SQL}, {AS_OF_SQL}
FROM todo CROSS JOIN top
""")(lambda fx: access.access_grant(fx.sql(B_ACCESS_USERS), fx.orders, fx.users, AS_OF))

query("access_revoke", sql=f"""
WITH req AS ({B_ACCESS_USERS})
SELECT * FROM f_orders o
WHERE NOT (o.status = 'paid' AND o.user_id IN (SELECT user_id FROM req WHERE user_id IS NOT NULL))
""")(lambda fx: access.access_revoke(fx.sql(B_ACCESS_USERS), fx.orders))

# ------------------------------------------------------------------- item 34: user purge


def _purge_tables(fx):
    return {"users": fx.users, "referrals": fx.referrals, "orders": fx.sql(B_PURGE_ORDERS),
            "partner_payouts": fx.partner_payouts, "partners": fx.partners,
            "partner_applications": fx.partner_applications,
            "course_progress": fx.course_progress, "refresh_tokens": fx.refresh_tokens}


query("user_purge_counts", sql=f"""
WITH req AS ({B_PURGE_USERS}),
purge_orders AS ({B_PURGE_ORDERS}),
r0 AS (SELECT DISTINCT user_id FROM req WHERE user_id IS NOT NULL),
owned AS (SELECT id AS pid, user_id AS owner FROM f_partners),
blocked AS (SELECT DISTINCT owned.owner FROM purge_orders o JOIN owned ON o.referral_partner_id = owned.pid
            WHERE o.user_id IS NULL OR o.user_id <> owned.owner),
rep AS (SELECT r0.user_id,
          CASE WHEN r0.user_id = {PURGE_ACTOR} THEN 'self'
               WHEN u.id IS NULL THEN 'not_found'
               WHEN b.owner IS NOT NULL THEN 'blocked_orders' ELSE 'deleted' END AS outcome
        FROM r0 LEFT JOIN f_users u ON u.id = r0.user_id LEFT JOIN blocked b ON b.owner = r0.user_id),
g AS (SELECT user_id FROM rep WHERE outcome = 'deleted'),
gp AS (SELECT id FROM f_partners WHERE user_id IN (SELECT user_id FROM g))
SELECT 'users' AS item, (SELECT count(*) FROM f_users WHERE id IN (SELECT user_id FROM g)) AS n
UNION ALL SELECT 'referrals', (SELECT count(*) FROM f_referrals
    WHERE referred_user_id IN (SELECT user_id FROM g) OR partner_id IN (SELECT id FROM gp))
UNION ALL SELECT 'orders', (SELECT count(*) FROM purge_orders WHERE user_id IN (SELECT user_id FROM g))
UNION ALL SELECT 'partner_payouts', (SELECT count(*) FROM f_partner_payouts WHERE partner_id IN (SELECT id FROM gp))
UNION ALL SELECT 'partners', (SELECT count(*) FROM f_partners WHERE user_id IN (SELECT user_id FROM g))
UNION ALL SELECT 'partner_applications', (SELECT count(*) FROM f_partner_applications
    WHERE user_id IN (SELECT user_id FROM g))
UNION ALL SELECT 'course_progress', (SELECT count(*) FROM f_course_progress WHERE user_id IN (SELECT user_id FROM g))
UNION ALL SELECT 'refresh_tokens', (SELECT count(*) FROM f_refresh_tokens WHERE user_id IN (SELECT user_id FROM g))
UNION ALL SELECT concat('outcome:', outcome), count(*) FROM rep GROUP BY outcome
""")(lambda fx: purge.user_purge_counts(fx.sql(B_PURGE_USERS), PURGE_ACTOR, _purge_tables(fx)))

_PURGED_CTE = f"""
req AS ({B_PURGE_USERS}),
purge_orders AS ({B_PURGE_ORDERS}),
r0 AS (SELECT DISTINCT user_id FROM req WHERE user_id IS NOT NULL),
owned AS (SELECT id AS pid, user_id AS owner FROM f_partners),
blocked AS (SELECT DISTINCT owned.owner FROM purge_orders o JOIN owned ON o.referral_partner_id = owned.pid
            WHERE o.user_id IS NULL OR o.user_id <> owned.owner),
rep AS (SELECT r0.user_id,
          CASE WHEN r0.user_id = {PURGE_ACTOR} THEN 'self'
               WHEN u.id IS NULL THEN 'not_found'
               WHEN b.owner IS NOT NULL THEN 'blocked_orders' ELSE 'deleted' END AS outcome
        FROM r0 LEFT JOIN f_users u ON u.id = r0.user_id LEFT JOIN blocked b ON b.owner = r0.user_id),
g AS (SELECT user_id FROM rep WHERE outcome = 'deleted'),
gp AS (SELECT id FROM f_partners WHERE user_id IN (SELECT user_id FROM g))"""
_GONE_USER, _GONE_PARTNER = "(SELECT user_id FROM g)", "(SELECT id FROM gp)"


def _purged_state(name: str):
    """The state of one table after the purge of stored tables: its fixture rows are stored in
    files by range of the first linked key, purged by touched files, and read back."""
    def run(fx):
        tables = _purge_tables(fx)
        base = f"{checkpoint_dir(fx.spark).rstrip('/')}/purge-{uuid.uuid4().hex}"
        stored = tables[name]
        write_version(stored.repartitionByRange(8, purge.LINKS[name][0][0]), base, name, "0")
        publish(fx.spark, base, {name: "0"})
        after, _, _ = purge.purge_stored(fx.spark, base, fx.sql(B_PURGE_USERS), PURGE_ACTOR, {name: stored.schema}, "1",
                                         {n: tables[n] for n in purge.CHECKED if n != name})
        return read_stored(fx.spark, base, name, after.versions[name], stored.schema)
    return run


for _name, _links in purge.LINKS.items():
    _left = " AND ".join(f"({_c} IS NULL OR {_c} NOT IN {_GONE_USER if _kind == 'user' else _GONE_PARTNER})" for _c, _kind in _links)
    query(f"user_purge_{_name}", sql=f"WITH {_PURGED_CTE} SELECT * FROM {'purge_orders' if _name == 'orders' else f'f_{_name}'} WHERE {_left}")(_purged_state(_name))

# ----------------------------------------------------- items 36-38: sessions and codes

query("session_retention", sql="""
SELECT id, user_id, token_hash, created_at, expires_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
  FROM f_refresh_tokens) WHERE rn <= 5
""")(lambda fx: sessions.session_retention(fx.refresh_tokens))

query("session_pruned", sql="""
SELECT id, user_id, token_hash, created_at, expires_at FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn
  FROM f_refresh_tokens) WHERE rn > 5
""")(lambda fx: sessions.session_pruned(fx.refresh_tokens))

query("active_sessions", sql=f"""
SELECT t.id, t.user_id, t.token_hash, t.created_at, t.expires_at, u.email, u.name, u.role,
       {AS_OF_LATE_SQL} > t.expires_at AS expired
FROM f_refresh_tokens t JOIN f_users u ON u.id = t.user_id
""")(lambda fx: sessions.active_sessions(fx.refresh_tokens, fx.users, AS_OF_LATE))

_CODE_STATUS = f"""CASE WHEN used THEN 'used' WHEN {AS_OF_SQL} > expires_at THEN 'expired'
                   ELSE 'valid' END"""
_NEW_EMAIL = """CASE WHEN starts_with(purpose, 'change_email:') THEN substr(purpose, 14) END"""

query("otp_code_status", sql=f"""
SELECT email, purpose, code, id, created_at, expires_at, {_CODE_STATUS} AS status,
       {_NEW_EMAIL} AS new_email
FROM (SELECT *, row_number() OVER (PARTITION BY email, purpose, code
                                   ORDER BY created_at DESC, id DESC) AS rn FROM f_otp_codes)
WHERE rn = 1
""")(lambda fx: sessions.code_status(fx.otp_codes, AS_OF))

query("otp_current_codes", sql=f"""
SELECT email, purpose, code, id, created_at, expires_at, {_CODE_STATUS} AS status
FROM (SELECT *, row_number() OVER (PARTITION BY email, purpose
                                   ORDER BY created_at DESC, id DESC) AS rn FROM f_otp_codes)
WHERE rn = 1
""")(lambda fx: sessions.current_codes(fx.otp_codes, AS_OF))

query("otp_code_check", sql=f"""
WITH a AS (SELECT *, lower(trim(email)) AS address FROM ({B_ATTEMPTS})),
c AS (SELECT *, CASE WHEN starts_with(purpose, 'change_email:') THEN 'change_email:'
                     ELSE purpose END AS kind FROM f_otp_codes),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY email, kind, code
                       ORDER BY created_at DESC, id DESC) AS rn FROM c) WHERE rn = 1),
m AS (SELECT a.attempt_id, a.email, a.purpose, a.code, n.id AS code_id, n.used, n.purpose AS full_purpose,
             n.id IS NOT NULL AND NOT n.used AND {AS_OF_CODES_SQL} <= n.expires_at AS good
      FROM a LEFT JOIN n ON n.email = a.address AND n.kind = a.purpose AND n.code = a.code)
SELECT attempt_id, email, purpose, code, code_id,
       CASE WHEN code_id IS NULL THEN 'invalid' WHEN used THEN 'used' WHEN NOT good THEN 'expired'
            WHEN row_number() OVER (PARTITION BY code_id, good ORDER BY attempt_id) > 1 THEN 'used'
            ELSE 'ok' END AS result,
       CASE WHEN starts_with(full_purpose, 'change_email:') THEN substr(full_purpose, 14) END AS new_email
FROM m
""")(lambda fx: sessions.code_check(fx.sql(B_ATTEMPTS), fx.otp_codes, AS_OF_CODES))

query("otp_codes_after_check", sql=f"""
WITH good AS (
  SELECT DISTINCT c.id FROM ({B_ATTEMPTS}) a JOIN f_otp_codes c
    ON c.email = lower(trim(a.email)) AND c.purpose = a.purpose AND c.code = a.code
  WHERE {AS_OF_CODES_SQL} <= c.expires_at
    AND NOT EXISTS (SELECT 1 FROM f_otp_codes d WHERE d.email = c.email AND d.purpose = c.purpose
                    AND d.code = c.code AND (d.created_at, d.id) > (c.created_at, c.id)))
SELECT c.* REPLACE (c.used OR g.id IS NOT NULL AS used) FROM f_otp_codes c LEFT JOIN good g ON g.id = c.id
""")(lambda fx: sessions.codes_after_check(fx.sql(B_ATTEMPTS), fx.otp_codes, AS_OF_CODES))

# ------------------------------------------------------------ item 39: ordered append


def _append_sql(batch: str, parent: str | None, text: str, table: str,
                allowed: tuple | None = None, parents: str | None = None) -> str:
    chk = f"WHEN coalesce(trim({text}), '') = '' THEN 'text_required'"
    if allowed:
        dom = ", ".join(f"'{a}'" for a in allowed)
        chk += f" WHEN {parent} IS NULL OR {parent} NOT IN ({dom}) THEN 'bad_parent'"
    if parents:  # the insert breaks the foreign key
        chk += f" WHEN NOT EXISTS (SELECT 1 FROM {parents} p WHERE p.id = req.{parent}) THEN 'parent_not_found'"
    part = f"PARTITION BY {parent}" if parent else ""
    top = (f"LEFT JOIN (SELECT {parent} AS par, max(sort_order) AS m FROM {table} GROUP BY {parent}) t"
           f" ON t.par = ok.{parent}") if parent else \
        f"CROSS JOIN (SELECT max(sort_order) AS m FROM {table}) t"
    return f"""
WITH req AS ({batch}),
b AS (SELECT * REPLACE (trim({text}) AS {text}), CASE {chk} END AS reason FROM req),
ok AS (SELECT *, row_number() OVER ({part} ORDER BY ts, request_id) AS n FROM b WHERE reason IS NULL),
num AS (SELECT ok.request_id, CAST(coalesce(t.m, 0) + ok.n AS INT) AS sort_order FROM ok {top})
SELECT b.*, num.sort_order FROM b LEFT JOIN num ON num.request_id = b.request_id
"""


query("append_topics", sql=_append_sql(B_TOPICS, "lesson_id", "text", "f_lesson_topics", parents="f_lessons"))(
    lambda fx: content.append_ordered(fx.sql(B_TOPICS), fx.lesson_topics, "text", "lesson_id",
                                      parents=fx.lessons))

query("append_materials", sql=_append_sql(
    B_MATERIALS, "category", "title", "f_materials",
    ("maps", "assets", "extra_maps", "extra_lessons", "updates")))(
    lambda fx: content.append_materials(fx.sql(B_MATERIALS), fx.materials))

query("append_lessons", sql=_append_sql(B_LESSONS_NEW, None, "title", "f_lessons"))(
    lambda fx: content.append_ordered(fx.sql(B_LESSONS_NEW), fx.lessons, "title"))

# --------------------------------------------------------------- item 40: sparse patch

_PATCH_CTE = f"""
p0 AS ({B_LESSON_PATCHES}),
n0 AS (SELECT *, TRY_CAST(regexp_extract(trim(sort_order), '^[+-]?[0-9]+') AS INT) AS number FROM p0),
p AS (SELECT patch_id, id, trim(title) AS title, set_title, number AS sort_order, set_sort_order, ts,
        CASE WHEN NOT (coalesce(set_title, FALSE) OR coalesce(set_sort_order, FALSE)) THEN 'empty'
             WHEN id NOT IN (SELECT id FROM f_lessons) THEN 'not_found'
             WHEN coalesce(set_title, FALSE) AND title IS NULL THEN 'blank'
             WHEN coalesce(set_sort_order, FALSE) AND number IS NULL THEN 'bad_number'
        END AS reason
      FROM n0)"""


def _lesson_patch(fx):
    return content.sparse_patch(fx.sql(B_LESSON_PATCHES), fx.lessons, "id",
                                {"title": "text", "sort_order": "int"})


query("sparse_patch_lessons", sql=f"""
WITH {_PATCH_CTE},
ok AS (SELECT * FROM p WHERE reason IS NULL),
lt AS (SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, patch_id DESC) rn
       FROM ok WHERE set_title) WHERE rn = 1),
ls AS (SELECT id, sort_order FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, patch_id DESC) rn
       FROM ok WHERE set_sort_order) WHERE rn = 1)
SELECT l.id, CASE WHEN lt.id IS NOT NULL THEN lt.title ELSE l.title END AS title,
       CASE WHEN ls.id IS NOT NULL THEN ls.sort_order ELSE l.sort_order END AS sort_order, l.is_free
FROM f_lessons l LEFT JOIN lt ON lt.id = l.id LEFT JOIN ls ON ls.id = l.id
""")(lambda fx: _lesson_patch(fx)[0])

query("sparse_patch_rejects", sql=f"""
WITH {_PATCH_CTE}
SELECT patch_id, id, reason FROM p WHERE reason IS NOT NULL
""")(lambda fx: _lesson_patch(fx)[1])

# ----------------------------------------------------------- item 41: insert if absent

query("insert_if_absent_lessons", sql=f"""
WITH b AS ({B_LESSON_SEEDS}),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, request_id) AS rn
      FROM b WHERE id NOT IN (SELECT id FROM f_lessons)) WHERE rn = 1)
SELECT id, title, sort_order, is_free FROM f_lessons
UNION ALL SELECT id, title, sort_order, is_free FROM n
""")(lambda fx: content.insert_if_absent(fx.sql(B_LESSON_SEEDS), fx.lessons, ["id"]))

# ---------------------------------------------------------- item 42: status transitions


def _role_update(fx):
    return content.status_transition(fx.sql(B_ROLE_UPDATES), fx.users, "id", "role",
                                     ("user", "partner", "admin"), AS_OF,
                                     {"updated_at": ts_lit(AS_OF)})


query("role_update", sql=f"""
WITH u AS ({B_ROLE_UPDATES}),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, update_id DESC) rn
      FROM u WHERE role IN ('user', 'partner', 'admin') AND id IN (SELECT id FROM f_users)) WHERE rn = 1)
SELECT x.id, x.email, x.name, coalesce(v.role, x.role) AS role, x.email_verified, x.created_at,
       CASE WHEN v.id IS NOT NULL THEN {AS_OF_SQL} END AS updated_at
FROM f_users x LEFT JOIN v ON v.id = x.id
""")(lambda fx: _role_update(fx)[0])

query("role_update_rejects", sql=f"""
WITH u AS ({B_ROLE_UPDATES})
SELECT update_id, id, role, CASE WHEN role NOT IN ('user', 'partner', 'admin') THEN 'bad_value'
                                 ELSE 'not_found' END AS reason
FROM u WHERE role NOT IN ('user', 'partner', 'admin') OR id NOT IN (SELECT id FROM f_users)
""")(lambda fx: _role_update(fx)[1])

query("application_review", sql=f"""
WITH u AS ({B_REVIEWS}),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, update_id DESC) rn
      FROM u WHERE status IN ('approved', 'rejected', 'pending')
        AND id IN (SELECT id FROM f_partner_applications)) WHERE rn = 1)
SELECT a.id, a.user_id, a.name, a.email, a.telegram, a.slug, coalesce(v.status, a.status) AS status,
       a.created_at, CASE WHEN v.id IS NOT NULL THEN {AS_OF_SQL} END AS reviewed_at,
       CASE WHEN v.id IS NOT NULL THEN v.actor_id END AS reviewed_by,
       CASE WHEN v.id IS NOT NULL THEN v.reject_reason END AS reject_reason
FROM f_partner_applications a LEFT JOIN v ON v.id = a.id
""")(lambda fx: content.status_transition(
    fx.sql(B_REVIEWS), fx.partner_applications, "id", "status",
    ("approved", "rejected", "pending"), AS_OF,
    {"reviewed_at": ts_lit(AS_OF), "reviewed_by": F.col("u_actor_id"),
     "reject_reason": F.col("u_reject_reason")})[0])

# ------------------------------------------------------------- item 43: promo code load

query("promo_code_load", sql=f"""
WITH b0 AS ({B_PROMO_LOAD}),
b1 AS (SELECT request_id, ts, expires_at, upper(trim(coalesce(code, ''))) AS code,
         regexp_extract(trim(CAST(discount AS VARCHAR)), '^([+-]?\\d+)', 1) AS parsed FROM b0),
b2 AS (SELECT *, coalesce(nullif(CASE WHEN parsed = '' THEN NULL
                                       ELSE TRY_CAST(parsed AS DECIMAL(38,0)) END, 0), 10) AS num FROM b1),
b3 AS (SELECT *, TRY_CAST(num AS INT) AS discount, code <> '' AS valid_code,
              num >= 1 AND num <= 100 AS in_range FROM b2),
b4 AS (SELECT *, CASE WHEN valid_code AND in_range THEN row_number() OVER (
                   PARTITION BY code, valid_code AND in_range ORDER BY ts, request_id) = 1
                 ELSE FALSE END AS first FROM b3)
SELECT b4.request_id, b4.code, b4.discount, b4.expires_at,
       CASE WHEN NOT valid_code THEN 'code_required' WHEN NOT in_range THEN 'discount_range'
            WHEN e.code IS NOT NULL OR NOT first THEN 'duplicate' END AS reason
FROM b4 LEFT JOIN (SELECT DISTINCT code FROM f_promo_codes) e ON e.code = b4.code
""")(lambda fx: promo.promo_code_load(fx.sql(B_PROMO_LOAD), fx.promo_codes))

# ---------------------------------------------------------------- item 45: user intake

query("user_intake", sql=f"""
WITH b0 AS ({B_SIGNUPS}),
b1 AS (SELECT request_id, ts, lower(trim(coalesce(email, ''))) AS email, nullif(trim(name), '') AS name
       FROM b0),
b2 AS (SELECT b1.*, e.email IS NOT NULL AS exists_already FROM b1
       LEFT JOIN (SELECT DISTINCT email FROM f_users) e ON e.email = b1.email),
b3 AS (SELECT *, CASE WHEN email <> '' AND NOT exists_already THEN row_number() OVER (
                   PARTITION BY email, email <> '' AND NOT exists_already ORDER BY ts, request_id) = 1
                 ELSE FALSE END AS first FROM b2),
b4 AS (SELECT *, CASE WHEN email = '' THEN 'email_required'
                      WHEN exists_already OR NOT first THEN 'duplicate' END AS reason FROM b3),
ids AS (SELECT request_id, (SELECT coalesce(max(id), 0) FROM f_users)
               + row_number() OVER (ORDER BY ts, request_id) AS id FROM b4 WHERE reason IS NULL)
SELECT b4.request_id, ids.id, b4.email, b4.name,
       CASE WHEN reason IS NULL THEN 'user' END AS role,
       CASE WHEN reason IS NULL THEN FALSE END AS email_verified,
       CASE WHEN reason IS NULL THEN {AS_OF_SQL} END AS created_at, b4.reason
FROM b4 LEFT JOIN ids ON ids.request_id = b4.request_id
""")(lambda fx: intake.user_intake(fx.sql(B_SIGNUPS), fx.users, AS_OF))

# ------------------------------------------------------------ item 44: integrity report


def _domain_tables(fx):
    return {"users": fx.users, "otp_codes": fx.otp_codes, "refresh_tokens": fx.refresh_tokens,
            "lessons": fx.lessons, "lesson_topics": fx.lesson_topics,
            "lesson_videos": fx.lesson_videos, "course_progress": fx.course_progress,
            "partner_applications": fx.partner_applications, "partners": fx.partners,
            "referrals": fx.referrals, "orders": fx.orders, "partner_payouts": fx.partner_payouts,
            "promo_codes": fx.promo_codes, "materials": fx.materials}


# Columns of each fixture view (FIXTURES.md); checks on absent columns report NULL.
_FIXTURE_COLUMNS = {
    "users": "id email name role email_verified created_at",
    "otp_codes": "id email code purpose created_at expires_at used",
    "refresh_tokens": "id user_id token_hash created_at expires_at",
    "lessons": "id title sort_order is_free",
    "lesson_topics": "id lesson_id text sort_order",
    "lesson_videos": "id lesson_id title video_url is_main sort_order",
    "course_progress": "user_id lesson_id viewed completed viewed_at completed_at",
    "partner_applications": "id user_id name email telegram slug status created_at",
    "partners": "id user_id slug promo_code balance total_earned",
    "referrals": "id partner_id referred_user_id created_at",
    "orders": "id user_id product amount referral_partner_id promo_code status created_at paid_at",
    "partner_payouts": "l_orderkey l_linenumber partner_id amount method status created_at",
    "promo_codes": "id code discount_percent expires_at is_active",
    "materials": "id category title sort_order",
}


def _integrity_sql() -> str:
    """Every declared check as its own count; NULL where the fixture view lacks the column."""
    rows = []

    def add(kind, t, label, cols, count):
        have = all(c in _FIXTURE_COLUMNS[t].split() for c in cols)
        rows.append(f"SELECT '{kind}', '{t}', '{label}', " + (count if have else "CAST(NULL AS BIGINT)"))

    for t, cols in integrity.UNIQUE_KEYS:
        given = " AND ".join(f"{c} IS NOT NULL" for c in cols)
        add("unique", t, ",".join(cols), cols,
            f"(SELECT count(*) - count(DISTINCT ({', '.join(cols)})) FROM f_{t} WHERE {given})")
    for t, c in integrity.NOT_NULL:
        add("not_null", t, c, [c], f"(SELECT count(*) - count({c}) FROM f_{t})")
    for t, c, pt, pc in integrity.FOREIGN_KEYS:
        add("foreign_key", t, f"{c}->{pt}.{pc}", [c],
            f"(SELECT count({c}) FROM f_{t} x WHERE NOT EXISTS (SELECT 1 FROM f_{pt} y WHERE y.{pc} = x.{c}))")
    for t, c, n in integrity.MAX_LENGTH:
        add("length", t, c, [c], f"(SELECT count(*) FROM f_{t} WHERE length({c}) > {n})")
    for t, c, dom in integrity.ENUMS:
        odd = f"{c} NOT IN ({', '.join(repr(v) for v in dom)})"
        if c == "purpose":
            odd += " AND NOT starts_with(purpose, 'change_email:')"
        add("enum", t, c, [c], f"(SELECT count(*) FROM f_{t} WHERE {odd})")
    return ('SELECT col0 AS "check", col1 AS table_name, col2 AS column_name, CAST(col3 AS BIGINT) AS violations FROM ('
            + "\nUNION ALL ".join(rows) + ") x(col0, col1, col2, col3)")


query("integrity_report", sql=_integrity_sql())(
    lambda fx: integrity.integrity_report(_domain_tables(fx)))

# ----------------------------------------------------------- item 46: delete by key


def _lesson_delete(fx):
    return content.delete_by_key(
        fx.sql(B_LESSON_DELETES), fx.sql(B_COURSE_LESSONS), "id",
        children={"lesson_topics": (fx.sql(B_COURSE_TOPICS), "lesson_id"),
                  "lesson_videos": (fx.sql(B_COURSE_VIDEOS), "lesson_id")},
        blockers={"course_progress": (fx.course_progress, "lesson_id")})


query("lesson_delete_report", sql=f"""
WITH r AS (SELECT DISTINCT id FROM ({B_LESSON_DELETES}))
SELECT r.id, CASE WHEN r.id NOT IN (SELECT id FROM ({B_COURSE_LESSONS})) THEN 'not_found'
                  WHEN r.id IN (SELECT lesson_id FROM f_course_progress WHERE lesson_id IS NOT NULL)
                  THEN 'blocked' ELSE 'deleted' END AS outcome
FROM r
""")(lambda fx: _lesson_delete(fx)[2])

query("lesson_delete_topics", sql=f"""
WITH r AS (SELECT DISTINCT id FROM ({B_LESSON_DELETES})),
g AS (SELECT id FROM r WHERE id IN (SELECT id FROM ({B_COURSE_LESSONS}))
        AND id NOT IN (SELECT lesson_id FROM f_course_progress WHERE lesson_id IS NOT NULL))
SELECT * FROM ({B_COURSE_TOPICS}) WHERE lesson_id IS NULL OR lesson_id NOT IN (SELECT id FROM g)
""")(lambda fx: _lesson_delete(fx)[1]["lesson_topics"])


# ------------------------------------------------- more variants of items 39, 40, 42, 46

B_VIDEOS_NEW = """
SELECT id AS request_id, CASE WHEN id % 14 = 5 THEN NULL ELSE lesson_id END AS lesson_id,
       CASE WHEN id % 9 = 0 THEN ' ' ELSE text END AS title,
       CASE WHEN id % 2 = 0 THEN '  ' ELSE concat(' https://video.example.test/n', CAST(id AS STRING), ' ') END
         AS video_url,
       id % 5 = 0 AS is_main,
       CAST(DATE '2001-07-01' AS TIMESTAMP) + INTERVAL '1' SECOND * CAST(id % 600 AS INT) AS ts
FROM f_lesson_topics"""

query("append_videos", sql=f"""
WITH req AS ({B_VIDEOS_NEW}),
b AS (SELECT request_id, lesson_id, trim(title) AS title, nullif(trim(video_url), '') AS video_url,
             coalesce(is_main, FALSE) AS is_main, ts,
             CASE WHEN coalesce(trim(title), '') = '' THEN 'text_required'
                  WHEN NOT EXISTS (SELECT 1 FROM f_lessons p WHERE p.id = req.lesson_id)
                  THEN 'parent_not_found' END AS reason FROM req),
ok AS (SELECT *, row_number() OVER (PARTITION BY lesson_id ORDER BY ts, request_id) AS n
       FROM b WHERE reason IS NULL),
num AS (SELECT ok.request_id, CAST(coalesce(t.m, 0) + ok.n AS INT) AS sort_order FROM ok
        LEFT JOIN (SELECT lesson_id AS par, max(sort_order) AS m FROM f_lesson_videos GROUP BY lesson_id) t
          ON t.par = ok.lesson_id)
SELECT b.*, num.sort_order FROM b LEFT JOIN num ON num.request_id = b.request_id
""")(lambda fx: content.append_ordered(fx.sql(B_VIDEOS_NEW), fx.lesson_videos, "title", "lesson_id",
                                       parents=fx.lessons, optional=("video_url",), flags=("is_main",)))

B_VIDEO_PATCHES = """
SELECT id AS patch_id, id, CASE id % 4 WHEN 0 THEN '  ' WHEN 1 THEN NULL ELSE concat(' ', title) END AS title,
       id % 3 = 1 AND id % 2 = 0 OR id % 12 = 1 AS set_title,
       CASE WHEN id % 2 = 0 THEN '   ' ELSE concat('https://cdn.example.test/', CAST(id AS STRING)) END
         AS video_url, id % 4 = 1 AS set_video_url,
       id % 7 = 0 AS is_main, id % 5 = 0 AS set_is_main,
       CAST(DATE '2001-07-01' AS TIMESTAMP) AS ts
FROM f_lesson_videos"""


def _video_patch(fx):
    return content.sparse_patch(fx.sql(B_VIDEO_PATCHES), fx.lesson_videos, "id",
                                {"title": "text", "video_url": "optional", "is_main": "bool"})


query("sparse_patch_videos", sql=f"""
WITH p0 AS ({B_VIDEO_PATCHES}),
p AS (SELECT patch_id, id, trim(title) AS title, set_title, nullif(trim(video_url), '') AS video_url,
             set_video_url, is_main, set_is_main, ts,
        CASE WHEN NOT (coalesce(set_title, FALSE) OR coalesce(set_video_url, FALSE)
                       OR coalesce(set_is_main, FALSE)) THEN 'empty'
             WHEN id NOT IN (SELECT id FROM f_lesson_videos) THEN 'not_found'
             WHEN coalesce(set_title, FALSE) AND title IS NULL THEN 'blank' END AS reason
      FROM p0),
ok AS (SELECT * FROM p WHERE reason IS NULL)
SELECT v.id, v.lesson_id,
       CASE WHEN ok.set_title THEN ok.title ELSE v.title END AS title,
       CASE WHEN ok.set_video_url THEN ok.video_url ELSE v.video_url END AS video_url,
       CASE WHEN ok.set_is_main THEN ok.is_main ELSE v.is_main END AS is_main, v.sort_order
FROM f_lesson_videos v LEFT JOIN ok ON ok.id = v.id
""")(lambda fx: _video_patch(fx)[0])

B_NAME_PATCHES = """
SELECT id AS patch_id, id,
       CASE id % 4 WHEN 0 THEN concat('  New name ', CAST(id AS STRING), ' ')
                   WHEN 1 THEN '    '
                   WHEN 2 THEN concat('A very long display name number ', CAST(id AS STRING))
                   ELSE concat('N', CAST(id AS STRING)) END AS name,
       id % 3 <> 2 AS set_name, created_at AS ts
FROM f_users"""


def _name_patch(fx):
    return content.sparse_patch(fx.sql(B_NAME_PATCHES), fx.users, "id", {"name": "required"},
                                max_len={"name": 30})


query("sparse_patch_user_names", sql=f"""
WITH p0 AS ({B_NAME_PATCHES}),
p AS (SELECT patch_id, id, trim(name) AS name, set_name, ts,
        CASE WHEN NOT coalesce(set_name, FALSE) THEN 'empty'
             WHEN id NOT IN (SELECT id FROM f_users) THEN 'not_found'
             WHEN coalesce(trim(name), '') = '' THEN 'blank'
             WHEN length(trim(name)) > 30 THEN 'too_long' END AS reason FROM p0)
SELECT patch_id, id, reason FROM p WHERE reason IS NOT NULL
""")(lambda fx: _name_patch(fx)[1])

B_PROMO_TOGGLES = """
SELECT id AS update_id, CAST(substring(promo_code, 6) AS INT) AS id, id % 2 = 0 AS is_active,
       created_at AS ts
FROM f_orders WHERE promo_code LIKE 'BRAND%'"""

query("promo_toggle", sql=f"""
WITH u0 AS ({B_PROMO_TOGGLES}),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC, update_id DESC) rn
      FROM u0 WHERE is_active IN (TRUE, FALSE) AND id IN (SELECT id FROM f_promo_codes)) WHERE rn = 1)
SELECT p.id, p.code, p.discount_percent, p.expires_at, coalesce(u.is_active, p.is_active) AS is_active
FROM f_promo_codes p LEFT JOIN u ON u.id = p.id
""")(lambda fx: content.status_transition(fx.sql(B_PROMO_TOGGLES), fx.promo_codes, "id",
                                          "is_active", (True, False), AS_OF)[0])

B_VERIFICATIONS = """
SELECT id AS update_id, email, TRUE AS email_verified, created_at AS ts FROM f_users
UNION ALL
SELECT id + 100000000 AS update_id, email, TRUE, created_at FROM f_otp_codes"""

query("email_verification", sql=f"""
WITH u AS (SELECT DISTINCT email FROM ({B_VERIFICATIONS}) WHERE email IN (SELECT email FROM f_users))
SELECT x.id, x.email, x.name, x.role, x.email_verified OR u.email IS NOT NULL AS email_verified,
       x.created_at, CASE WHEN u.email IS NOT NULL THEN {AS_OF_SQL} END AS updated_at
FROM f_users x LEFT JOIN u ON u.email = x.email
""")(lambda fx: content.status_transition(fx.sql(B_VERIFICATIONS), fx.users, "email",
                                          "email_verified", (True,), AS_OF,
                                          {"updated_at": ts_lit(AS_OF)})[0])

B_PROMO_DELETES = """
SELECT CAST(substring(promo_code, 6) AS INT) + CASE WHEN id % 11 = 0 THEN 1000 ELSE 0 END AS id
FROM f_orders WHERE promo_code LIKE 'BRAND%' AND id % 4 = 1"""
B_MATERIAL_DELETES = "SELECT id FROM f_materials WHERE id % 10 = 2"

query("promo_code_delete", sql=f"""
SELECT * FROM f_promo_codes WHERE id NOT IN (SELECT id FROM ({B_PROMO_DELETES}))
""")(lambda fx: content.delete_by_key(fx.sql(B_PROMO_DELETES), fx.promo_codes, "id")[0])

query("material_delete", sql=f"""
SELECT * FROM f_materials WHERE id NOT IN (SELECT id FROM ({B_MATERIAL_DELETES}))
""")(lambda fx: content.delete_by_key(fx.sql(B_MATERIAL_DELETES), fx.materials, "id")[0])

B_TOPIC_DELETES = """
SELECT CASE WHEN id % 12 = 0 THEN id + 1 ELSE id END AS id FROM f_lesson_topics WHERE id % 6 = 0"""
B_VIDEO_DELETES = "SELECT id FROM f_lesson_videos WHERE id % 5 = 1"

query("topic_delete", sql=f"""
SELECT * FROM f_lesson_topics WHERE id NOT IN (SELECT id FROM ({B_TOPIC_DELETES}))
""")(lambda fx: content.delete_by_key(fx.sql(B_TOPIC_DELETES), fx.lesson_topics, "id")[0])

query("video_delete", sql=f"""
SELECT * FROM f_lesson_videos WHERE id NOT IN (SELECT id FROM ({B_VIDEO_DELETES}))
""")(lambda fx: content.delete_by_key(fx.sql(B_VIDEO_DELETES), fx.lesson_videos, "id")[0])
