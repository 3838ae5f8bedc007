"""Shared SQL fragments for the DuckDB oracle statements.

They restate, in SQL, the views in :mod:`foldwise.plans.views` so each
oracle statement is self-contained over the pre-registered tables.
"""

# labelled events with the raw (possibly prefixed) label
EV_RAW = r"""
ev_raw AS (
  SELECT event_id, ts, user_id AS home_id,
         CASE event_id % 10 WHEN 0 THEN 'r1.' || event_type
                            WHEN 5 THEN 'r2.' || event_type
                            ELSE event_type END AS activity,
         value, props
  FROM events)"""

# prefix stripped, catch-all dropped, general label added
EV_CLEAN = EV_RAW + r""",
ev_clean AS (
  SELECT event_id, ts, home_id, a AS activity,
         CASE a WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse'
                WHEN 'purchase' THEN 'convert' WHEN 'signup' THEN 'convert'
                ELSE a END AS activity_general,
         value, props
  FROM (SELECT *, regexp_replace(activity, '^r[12]\.', '') AS a FROM ev_raw)
  WHERE a <> 'error')"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(p.strip() for p in parts)
