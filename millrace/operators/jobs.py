"""Jobs, their owners and reviews: lookups, sums, access and patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_owner(jobs: DataFrame, users: DataFrame, missing: str = "—") -> DataFrame:
    """jobs with the owner's name, ``missing`` where there is none. Spark broadcasts the users if they are small."""
    return jobs.join(users.select(F.col("user_id").alias("customer_id"), F.col("name").alias("owner")), "customer_id", "left").withColumn("owner", F.coalesce("owner", F.lit(missing)))


def visible(jobs: DataFrame, role: str, user_id: int) -> DataFrame:
    """An owner sees all, an admin the jobs of the own tenant, a customer the own."""
    return {"owner": lambda: jobs, "admin": lambda: jobs.where(F.col("admin_id") == user_id), "customer": lambda: jobs.where(F.col("customer_id") == user_id)}[role]()


def recent(jobs: DataFrame, n: int, most: int = 200) -> DataFrame:
    """The latest jobs; ids settle ties."""
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(min(n, most))


def monthly_usage(jobs: DataFrame) -> DataFrame:
    """Completed extractions of each customer by month."""
    done = jobs.where("status = 'completed' AND kind = 'extract'")
    return done.groupBy("customer_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("used"))


def batch_summary(jobs: DataFrame, by: list[str]) -> DataFrame:
    first_error = F.min_by(F.when(F.col("status") == "failed", F.col("error")), F.when(F.col("status") == "failed", F.col("job_id")))
    return jobs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status").isin("queued", "processing")).alias("waiting"), F.sum("items").alias("items"), F.sum("flagged").alias("flagged"), first_error.alias("first_error"),
    )


def quota_share(used: Column, quota: Column) -> Column:
    """Percent of a quota, at most 100; 0 without one."""
    return F.when(quota > 0, F.least(F.lit(100.0), F.round(used / quota * 100))).otherwise(0.0)


def admission(kind: Column, role: Column, plan: Column, plan_active: Column, quota: Column, remaining: Column, pages: Column, most_pages: int = 20) -> Column:
    """The code with which a job is refused, or null. Only customers upload. A plan binds an account that has one, a quota one
    that has one, and neither binds cleaning; the pages are looked at last, and what is cleaned counts as one page."""
    paid = kind != "clean"
    count = F.when(paid, pages).otherwise(1)
    return (
        F.when(role != "customer", "customer_only")
        .when(paid & F.coalesce(plan != "", F.lit(False)) & ~F.coalesce(plan_active, F.lit(False)), "plan_inactive")
        .when(paid & (F.coalesce(quota, F.lit(0)) > 0) & (remaining <= 0), "quota_exhausted")
        .when(count == 0, "pdf_unreadable")
        .when(count > most_pages, "too_many_pages")
    )


def status_label(status: Column, low: Column, warnings: Column) -> Column:
    return F.when(status.isin("failed", "unsupported"), status).when(low > 0, "needs_review").when(warnings > 0, "auto_corrected").otherwise("success")


def stage_totals(stages: DataFrame) -> DataFrame:
    """stages (job_id, stage, page, ms) with the running sum over pages."""
    w = Window.partitionBy("job_id", "stage").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stages.withColumn("total_ms", F.sum("ms").over(w))


def upsert_stages(events: DataFrame) -> DataFrame:
    """The latest state of each stage of a job."""
    return events.groupBy("job_id", "stage").agg(F.max_by("ms", F.struct("ts", "event_id")).alias("ms"))


def apply_review(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """cells (output, sheet, row, column, value) with the last edit (edit_id) of each; keys ignore case."""
    key = lambda c: F.lower(c)
    last = edits.groupBy(key("output").alias("_o"), key("sheet").alias("_s"), F.col("row").alias("_r"), F.col("column").alias("_c")).agg(F.max_by("value", "edit_id").alias("_v"), F.lit(True).alias("_e"))
    same = (key(F.col("output")) == F.col("_o")) & (key(F.col("sheet")) == F.col("_s")) & (F.col("row") == F.col("_r")) & (F.col("column") == F.col("_c"))
    return cells.join(last, same, "left").withColumn("value", F.when(F.col("_e"), F.col("_v")).otherwise(F.col("value"))).withColumn("edited", F.coalesce("_e", F.lit(False))).drop("_o", "_s", "_r", "_c", "_v", "_e")


def least_confident(cells: DataFrame, by: list[str], n: int = 12, below: float = 70.0) -> DataFrame:
    """The ``n`` cells of each group to read again: unsure or marked, least sure first; cell_idx settles ties."""
    order = F.row_number().over(Window.partitionBy(*by).orderBy("conf", "cell_idx"))
    return cells.where((F.col("conf") < below) | F.col("review")).withColumn("_k", order).where(F.col("_k") <= n).drop("_k")


def dedupe_best(items: DataFrame, by: list[str]) -> DataFrame:
    """Of items with the same description, whatever its case, the surest, the last of equal ones."""
    rest = F.struct(*items.columns)
    best = F.max_by(rest, F.struct("conf", "item_no")).alias("_b")
    return items.groupBy(*by, F.lower("description").alias("_d")).agg(best).select("_b.*")
