"""Windows over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming.events import session_counts, tumbling_counts
from .spec import Query

QUERIES = [
    Query("z1_tumbling", build=lambda e: tumbling_counts(e.table("events")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n_events"),
          oracle="SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_events FROM events GROUP BY ALL"),
    Query("z2_session", build=lambda e: session_counts(e.table("events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n_events"),
          oracle="WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n_events FROM s GROUP BY user_id, k"),
]
