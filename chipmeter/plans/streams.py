"""Queries over submissions that arrive in portions, some of them late: append mode, watermarks, state that ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import views as V
from ..sources.scratch import scratch_folder
from ..streaming import submissions as T
from .records import SUBS

Q, SQL = {}, {}

#: Days of arrivals in a portion; portions that the SQL walks through.
DAYS, PORTIONS = 6, 10


def query(name: str, sql: str):
    def put(f):
        Q[name] = f
        SQL[name] = "WITH RECURSIVE " + SUBS.strip() + sql
        return f

    return put


class _Arriving:
    """Stands for a session whose events arrive in portions, so that batch views serve the stream unchanged."""

    def __init__(self, spark):
        self._spark, self.read = spark, self

    def parquet(self, path):
        events = self._spark.read.parquet(path)
        folder = scratch_folder(self._spark, "arrivals")
        late = F.when(F.col("event_id") % 50 == 0, 15 * 86400).otherwise(F.col("event_id") % 3 * 8 * 3600)  # one in fifty arrives 15 days late
        T.arrive(events, F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) + late) / (DAYS * 86400)), folder)
        return T.arrivals(self._spark, folder, events.schema)


#: Portions in order (k), and for each the watermark that evicts (w) and the one that late rows fall behind (the batch before's, wl), in milliseconds.
ARRIVED = f""", ar AS (SELECT *, dense_rank() OVER (ORDER BY (epoch_us(ts) // 1000000 + CASE WHEN event_id % 50 = 0 THEN 1296000 ELSE event_id % 3 * 28800 END) // {DAYS * 86400}) - 1 AS k, epoch_us(ts) AS us FROM ck),
tops AS (SELECT k, max(us) // 1000 AS top FROM ar GROUP BY k),
wm AS (SELECT k, coalesce(max(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400000, 0) AS w, coalesce(max(top) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) - 86400000, 0) AS wl FROM tops)"""


def _accepted_sql() -> str:
    """Portion after portion: an assignment without a living winner takes its first good row that isn't late."""
    hold, parts = 7 * 86400000, []
    for k in range(PORTIONS):
        alive = f"SELECT assignment FROM s{k - 1}, wm WHERE wm.k = {k} AND till > wm.w" if k else "SELECT -1 AS assignment"
        parts.append(f"""t{k} AS (SELECT ar.*, row_number() OVER (PARTITION BY assignment, bad IS NULL ORDER BY ar.us, event_id) AS r, assignment IN ({alive}) AS taken FROM ar JOIN wm USING (k) WHERE k = {k} AND us > wl * 1000),
v{k} AS (SELECT event_id, assignment, us, CASE WHEN bad IS NOT NULL THEN bad WHEN r = 1 AND NOT taken THEN 'accepted' ELSE 'conflict' END AS status FROM t{k}),
s{k} AS (SELECT assignment, us // 1000 + {hold} AS till FROM v{k} WHERE status = 'accepted'{f" UNION ALL SELECT assignment, till FROM s{k - 1}, wm WHERE wm.k = {k} AND till > wm.w" if k else ""})""")
    return ", " + ", ".join(parts) + " SELECT event_id, assignment, status FROM (" + " UNION ALL ".join(f"SELECT event_id, assignment, status FROM v{k}" for k in range(PORTIONS)) + ")"


@query("T1_accepted_first_append", ARRIVED + _accepted_sql())
def accepted_first(spark, sf):
    stream = T.accepted_first(V.submissions(_Arriving(spark), sf), V.predictions(spark, sf))
    return T.run_available(stream, scratch_folder(spark, "streams"))


@query("T2_window_counts_append", ARRIVED + """, d AS (SELECT date_trunc('day', ts) AS day, labeler, verdict, wl, (SELECT max(top) - 86400000 FROM tops) AS w_end FROM ar JOIN wm USING (k)),
e AS (SELECT * FROM d WHERE epoch_ms(day) + 86400000 > wl AND epoch_ms(day) + 86400000 <= w_end)
SELECT strftime(day, '%Y-%m-%d') AS day, labeler, count(*) AS n, count(*) FILTER (verdict = 'accepted') AS n_accepted FROM e GROUP BY ALL""")  # fmt: skip
def window_counts(spark, sf):
    """Counts of windows that the watermark has closed; each window appears once, and its state is gone."""
    out = T.run_available(T.progress(V.submissions(_Arriving(spark), sf)), scratch_folder(spark, "streams"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "labeler", "n", "n_accepted")
