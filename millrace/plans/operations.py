"""Queries on jobs, reviews, words with boxes and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import geometry, jobs
from ..streaming import limits, progress
from .invoices import _N, _lines
from .tables import table


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: customers own them, nations are tenants."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("queued")
    return o.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "clean").otherwise("extract").alias("kind"), (F.col("o_orderkey") % 10).alias("items"), (F.col("o_orderkey") % 4).alias("flagged"), F.concat(F.lit("error "), F.col("o_orderpriority")).alias("error"))


def owner_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    return jobs.with_owner(_jobs(spark, sf_dir), users).select("job_id", "owner")


def tenant_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("admin_id"))
    return jobs.visible(_jobs(spark, sf_dir).join(users, "customer_id"), "admin", 3).select("job_id", "customer_id")


def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.recent(_jobs(spark, sf_dir), 50).select("job_id")


def usage_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.monthly_usage(_jobs(spark, sf_dir))


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.batch_summary(_jobs(spark, sf_dir), ["customer_id"])


def quota_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = jobs.monthly_usage(_jobs(spark, sf_dir)).groupBy("customer_id").agg(F.sum("used").alias("used"))
    return used.select("customer_id", jobs.quota_share(F.col("used"), F.col("customer_id") % 4).alias("percent"))


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir)
    of, job = F.col("customer_id"), F.col("job_id")
    plan, role = F.when(of % 4 > 0, "basic"), F.when(of % 7 == 0, "admin").otherwise("customer")
    why = jobs.admission(F.col("kind"), role, plan, of % 5 > 0, of % 3, of % 6 - 2, job % 29)
    return j.select("job_id", why.alias("reason"))


def review_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells are the prices of line items; the lines of every eleventh order were edited, some twice."""
    li = _lines(spark, sf_dir)
    cells = li.select(F.col("l_orderkey").cast("string").alias("output"), F.lit("Items").alias("sheet"), F.col("n").alias("row"), F.lit(3).alias("column"), F.format_string("%.2f", "l_extendedprice").alias("value"))
    of = li.where("l_orderkey % 11 = 0").select(F.col("l_orderkey").cast("string").alias("output"), F.lit("ITEMS").alias("sheet"), F.col("n").alias("row"), F.lit(3).alias("column"), F.explode(F.array(F.lit(1), F.lit(2))).alias("edit_id"))
    return jobs.apply_review(cells, of.withColumn("value", F.concat(F.lit("edit "), F.col("edit_id").cast("string")))).select("output", "row", "value", "edited")


def review_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence is a line's part modulo 100."""
    li = _lines(spark, sf_dir).select("l_suppkey", F.concat(F.col("l_orderkey").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("cell_idx"), (F.col("l_partkey") % 100).cast("double").alias("conf"), (F.col("n") == 1).alias("review"))
    return jobs.least_confident(li, ["l_suppkey"])


def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("stage"), F.col("event_id").alias("page"), (F.col("event_id") % 1000).alias("ms"))
    return jobs.stage_totals(e)


def sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's sessions: groups of events with no more than a day between neighbours."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    grouped = geometry.cluster_1d(e, ["user_id"], "s", 24 * 3600.0)
    return grouped.groupBy("user_id", F.col("cluster").cast("long").alias("session")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("first_s"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: a line for each item, three words in it, slightly shaken."""
    li = _lines(spark, sf_dir)
    words = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(float(x)).alias("x"), c.cast("string").alias("text")) for i, (x, c) in enumerate(((10, F.col("l_partkey")), (150, F.col("l_suppkey")), (300, F.col("l_linenumber"))))])
    w = li.select("l_orderkey", "n", F.explode(words).alias("w"))
    shake = (F.col("n") * 7 + F.col("w.k") * 3) % 5 - 2.0
    y = F.col("n") * 30.0 + shake * 0.5
    return w.select("l_orderkey", (F.col("n") * 3 + F.col("w.k")).alias("word_idx"), F.col("w.text").alias("text"), "n", F.col("w.k").alias("k"), (F.col("w.x") + shake).alias("x0"), (F.col("w.x") + 60 + shake).alias("x1"), y.alias("y0"), (y + 12).alias("y1"))


def words_to_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.words_to_lines(_words(spark, sf_dir).drop("n", "k"), ["l_orderkey"]).select("l_orderkey", "word_idx", "line")


def split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.split_cells(_words(spark, sf_dir), ["l_orderkey", "n"], 20.0).select("l_orderkey", "word_idx", "cell")


def words_to_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    cells = w.where("n % 2 = 1").select("l_orderkey", F.col("word_idx").alias("cell_idx"), (F.col("k") * 145.0).alias("x0"), (F.col("k") * 145.0 + 100).alias("x1"), (F.col("n") * 30.0 - 5).alias("y0"), (F.col("n") * 30.0 + 18).alias("y1"))
    return geometry.words_to_cells(w, cells, ["l_orderkey"]).select("l_orderkey", "word_idx", "cell_idx")


def nearest_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _words(spark, sf_dir)
    columns = w.select("l_orderkey").distinct().select("l_orderkey", F.posexplode(F.array(F.lit(40.0), F.lit(180.0), F.lit(330.0))).alias("column_idx", "x"))
    return geometry.nearest_column(w, columns, ["l_orderkey"]).select("l_orderkey", "word_idx", "column_idx")


def column_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = geometry.column_edges(_words(spark, sf_dir), ["l_orderkey"])
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("columns"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return limits.rate_limited(e, most=3, window_ms=24 * 3600 * 1000)


def lockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), (F.col("event_id") % 5 > 0).alias("failed"))
    return limits.lockouts(e)


def progress_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as progress lines of a job for each user; every eighth line is damaged."""
    e = table(spark, sf_dir, "events")
    stage = F.get(F.array(*[F.lit(s) for s in progress.STAGES]), (F.col("event_id") % len(progress.STAGES)).cast("int"))
    body = F.to_json(F.struct(stage.alias("stage"), F.lit("done").alias("state"), (F.col("event_id") % 900).alias("ms"), (F.col("event_id") % 20).cast("int").alias("page"), F.lit(True).alias("page_complete")))
    line = F.when(F.col("event_id") % 8 == 0, F.lit("noise {")).otherwise(F.concat(F.lit(progress.MARKER), body))
    return progress.state(e.select(F.col("user_id").cast("string").alias("job_id"), line.alias("line")))


QUERIES = {
    "owner_lookup": owner_lookup, "tenant_jobs": tenant_jobs, "recent_jobs": recent_jobs, "usage_monthly": usage_monthly, "batch_summary": batch_summary, "quota_share": quota_share,
    "admission": admission, "review_patch": review_patch, "review_topk": review_topk, "stage_totals": stage_totals, "sessionize": sessionize, "words_to_lines": words_to_lines,
    "split_cells": split_cells, "words_to_cells": words_to_cells, "nearest_column": nearest_column, "column_edges": column_edges, "rate_limit": rate_limit, "lockout": lockout,
    "progress_state": progress_state,
}

_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'queued' END"
_W = f"l AS (SELECT l_orderkey, CAST({_N} AS INTEGER) AS n FROM lineitem), w AS (SELECT l_orderkey, n, k, n * 3 + k AS word_idx FROM l, (SELECT CAST(unnest(range(3)) AS INTEGER) AS k))"
_PROGRESS_STAGES = ", ".join(f"'{s}'" for s in progress.STAGES)

ORACLES = {
    "owner_lookup": "SELECT o_orderkey AS job_id, coalesce(c_name, '—') AS owner FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 10 > 0) ON o_custkey = c_custkey",
    "tenant_jobs": "SELECT o_orderkey AS job_id, o_custkey AS customer_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3",
    "recent_jobs": "SELECT o_orderkey AS job_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "usage_monthly": "SELECT o_custkey AS customer_id, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS used FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0 GROUP BY ALL",
    "batch_summary": f"""
        WITH j AS (SELECT o_custkey AS customer_id, o_orderkey, {_STATUS} AS status, 'error ' || o_orderpriority AS error FROM orders)
        SELECT customer_id, count(*) AS jobs, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'queued') AS waiting,
               CAST(sum(o_orderkey % 10) AS BIGINT) AS items, CAST(sum(o_orderkey % 4) AS BIGINT) AS flagged, arg_min(error, o_orderkey) FILTER (WHERE status = 'failed') AS first_error FROM j GROUP BY 1""",
    "quota_share": """
        SELECT o_custkey AS customer_id, CASE WHEN o_custkey % 4 > 0 THEN least(100.0, round(count(*) / (o_custkey % 4) * 100)) ELSE 0.0 END AS percent
        FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 > 0 GROUP BY o_custkey""",
    "admission": """
        -- in this order: customers only; a plan that is not active; a quota that is used up; then the pages. The two in the middle bind no cleaning, whose pages are one
        WITH j AS (SELECT o_orderkey AS job_id, o_custkey % 7 = 0 AS admin, o_orderkey % 3 = 0 AS cleaning, o_custkey % 4 > 0 AS planned, o_custkey % 5 > 0 AS active, o_custkey % 3 AS quota, o_custkey % 6 - 2 AS left_, o_orderkey % 29 AS pages FROM orders)
        SELECT job_id, CASE WHEN admin THEN 'customer_only' WHEN cleaning THEN NULL WHEN planned AND NOT active THEN 'plan_inactive' WHEN quota > 0 AND left_ <= 0 THEN 'quota_exhausted'
               WHEN pages = 0 THEN 'pdf_unreadable' WHEN pages > 20 THEN 'too_many_pages' END AS reason FROM j""",
    "review_patch": f"""
        SELECT CAST(l_orderkey AS VARCHAR) AS output, CAST({_N} AS INTEGER) AS "row", CASE WHEN l_orderkey % 11 = 0 THEN 'edit 2' ELSE printf('%.2f', l_extendedprice) END AS value, l_orderkey % 11 = 0 AS edited FROM lineitem""",
    "review_topk": f"""
        WITH c AS (SELECT l_suppkey, {_N} AS n, l_orderkey, CAST(l_partkey % 100 AS DOUBLE) AS conf FROM lineitem),
             d AS (SELECT l_suppkey, CAST(l_orderkey AS VARCHAR) || '/' || CAST(n AS VARCHAR) AS cell_idx, conf, n = 1 AS review FROM c)
        SELECT * FROM d WHERE conf < 70 OR review QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY conf, cell_idx) <= 12""",
    "stage_totals": """
        SELECT user_id AS job_id, event_type AS stage, event_id AS page, event_id % 1000 AS ms, CAST(sum(event_id % 1000) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS BIGINT) AS total_ms FROM events""",
    "sessionize": """
        WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events), f AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) > 86400 THEN 1 ELSE 0 END AS new FROM e),
             g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM f)
        SELECT user_id, session, count(*) AS n, min(s) AS first_s FROM g GROUP BY 1, 2""",
    "words_to_lines": f"WITH {_W} SELECT l_orderkey, word_idx, n - 1 AS line FROM w",
    "split_cells": f"WITH {_W} SELECT l_orderkey, word_idx, k AS cell FROM w",
    "words_to_cells": f"WITH {_W} SELECT l_orderkey, word_idx, CASE WHEN n % 2 = 1 THEN word_idx END AS cell_idx FROM w",
    "nearest_column": f"WITH {_W} SELECT l_orderkey, word_idx, k AS column_idx FROM w",
    "column_edges": "SELECT DISTINCT l_orderkey, CAST(3 AS BIGINT) AS columns FROM lineitem",
    "progress_state": f"""
        WITH e AS (SELECT CAST(user_id AS VARCHAR) AS job_id, ([{_PROGRESS_STAGES}])[event_id % {len(progress.STAGES)} + 1] AS stage, event_id % 900 AS ms, event_id % 20 AS page FROM events WHERE event_id % 8 > 0)
        SELECT job_id, stage, max(ms) AS ms, CAST(max(page) AS INTEGER) AS pages_done FROM e GROUP BY 1, 2""",
    "rate_limit": """
        WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_ns(ts) // 1000000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ns(ts) // 1000000, event_id) AS i FROM events),
             f AS (SELECT key, event_id, ms, i, true AS accepted, [ms] AS hits FROM e WHERE i = 1
                   UNION ALL
                   SELECT key, event_id, ms, i, len(hits) < 3, CASE WHEN len(hits) < 3 THEN list_append(hits, ms) ELSE hits END
                   FROM (SELECT e.key, e.event_id, e.ms, e.i, list_filter(f.hits, lambda h: h > e.ms - 86400000) AS hits FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1))
        SELECT key, event_id, ms, accepted FROM f""",
    "lockout": """
        WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_ns(ts) // 1000000 AS ms, event_id % 5 > 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ns(ts) // 1000000, event_id) AS i FROM events),
             f AS (SELECT key, event_id, ms, failed, i, false AS locked, CAST(failed AS INTEGER) AS n, CAST(-1 AS BIGINT) AS until FROM e WHERE i = 1
                   UNION ALL
                   SELECT key, event_id, ms, failed, i, locked, CASE WHEN locked THEN old WHEN n >= 5 THEN 0 ELSE n END, CASE WHEN NOT locked AND n >= 5 THEN ms + 900000 ELSE until END
                   FROM (SELECT e.key, e.event_id, e.ms, e.failed, e.i, e.ms < f.until AS locked, f.n AS old, CASE WHEN e.failed THEN f.n + 1 ELSE 0 END AS n, f.until FROM f JOIN e ON e.key = f.key AND e.i = f.i + 1))
        SELECT key, event_id, ms, failed, locked, n AS count FROM f""",
}
