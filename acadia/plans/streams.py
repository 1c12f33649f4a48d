"""Registered streaming queries (items 47, 48) and their batch twins, with oracle SQL.

The stream registrations run the Structured Streaming job over everything available
(``availableNow``) and return the sink read back as a batch DataFrame, so they can be
compared with the same SQL as the batch twin.
"""

from __future__ import annotations

from ..sources.tables import read_table
from ..streaming import progress as progress_stream
from ..streaming import rate_limit
from .jobs import _ADMITTED
from .registry import query


# Requests close together, a second or less apart; every other client is one busy client.
B_BURSTS = """
SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS client_key,
       CASE event_type WHEN 'signup' THEN 'auth' WHEN 'error' THEN 'other' ELSE 'slug' END AS route,
       CAST(DATE '2001-07-01' AS TIMESTAMP) + INTERVAL '1' SECOND * CAST(event_id % 6000 AS INT) AS ts
FROM {events}"""


def _rate_sql(seconds: int, max_requests: int, requests: str = "SELECT * FROM f_requests", where: str = "TRUE") -> str:
    """Each request's successor past its window, the starts from the first request on, then the counts."""
    w = f"to_seconds({seconds})"
    return f"""
WITH RECURSIVE r AS ({requests}),
h AS (SELECT client_key, ts, count(*) AS n FROM r WHERE {where} GROUP BY 1, 2),
past AS (SELECT client_key, ts, min(ts) OVER (PARTITION BY client_key ORDER BY ts
           RANGE BETWEEN INTERVAL '{seconds}' SECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM h),
s AS (SELECT client_key, min(ts) AS start FROM h GROUP BY 1
      UNION ALL SELECT s.client_key, past.nxt FROM s JOIN past ON past.client_key = s.client_key AND past.ts = s.start AND past.nxt IS NOT NULL),
l AS (SELECT h.client_key, h.n, last_value(s.start IGNORE NULLS) OVER (PARTITION BY h.client_key ORDER BY h.ts) AS start
      FROM h LEFT JOIN s ON h.client_key = s.client_key AND h.ts = s.start),
c AS (SELECT client_key, start, CAST(sum(n) AS BIGINT) AS requests FROM l GROUP BY 1, 2)
SELECT client_key, start AS window_start, start + {w} AS window_end, requests, requests > {max_requests} AS over_limit,
       greatest(requests - {max_requests}, 0) AS rejected
FROM c
"""


def _bursts(fx):
    return fx.spark.sql(B_BURSTS, events=read_table(fx.spark, fx.sf_dir, "events"))


_BURSTS_SQL = B_BURSTS.format(events="events")

query("rate_limit_daily", sql=_rate_sql(86400, 5))(
    lambda fx: rate_limit.rate_limit_report(fx.requests, "1 day", 5))
query("rate_limit_global", sql=_rate_sql(900, 300, _BURSTS_SQL))(
    lambda fx: rate_limit.rate_limit_report(_bursts(fx), limiter="global"))
query("rate_limit_slug", sql=_rate_sql(60, 30, _BURSTS_SQL, "route = 'slug'"))(
    lambda fx: rate_limit.rate_limit_report(_bursts(fx), limiter="slug", routes=("slug",)))
query("rate_limit_auth", sql=_rate_sql(900, 20, _BURSTS_SQL, "route = 'auth'"))(
    lambda fx: rate_limit.rate_limit_report(_bursts(fx), limiter="auth", routes=("auth",)))
query("rate_limit_stream", sql=_rate_sql(86400, 5))(
    lambda fx: rate_limit.run_rate_limit_stream(fx.spark, fx.sf_dir, "1 day", 5))

query("progress_stream", sql=f"WITH {_ADMITTED} SELECT * FROM fold")(
    lambda fx: progress_stream.run_progress_stream(fx.spark, fx.sf_dir, fx.lessons, fx.orders,
                                                   fx.users))
