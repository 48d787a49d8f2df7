"""Plans, leads, accounts and models: lookups, changes of state, scores. Changes are tables of events; states are the last
event or a flag, so that nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import BOTH_FAILED, FAILURE_CODES, NO_PAGE, PASSING_STATUS


def with_plan(users: DataFrame, plans: DataFrame) -> DataFrame:
    """users with their active plan's price; users of plans that do not exist are dropped by ``known_plan``."""
    active = plans.where("active").select(F.col("slug").alias("plan_slug"), "price")
    return users.join(active, "plan_slug", "left")


def known_plan(users: DataFrame, plans: DataFrame) -> DataFrame:
    return users.join(plans.select(F.col("slug").alias("plan_slug")), "plan_slug", "left_semi")


def active_plans(plans: DataFrame) -> DataFrame:
    return plans.where("active").orderBy("sort_order", "slug")


def seed_plans(plans: DataFrame, seed: DataFrame) -> DataFrame:
    """The plans, or the seed where there are none."""
    return plans.unionByName(seed.join(plans.select("slug").limit(1).withColumnRenamed("slug", "_any"), F.lit(True), "left_anti"))


def upsert_accounts(accounts: DataFrame, changes: DataFrame) -> DataFrame:
    """accounts (email, plan_slug, plan_active, activated_at) with the last change (at) of each e-mail; no plan is active
    without a plan, and the time of activation is set once."""
    last = changes.groupBy(F.lower("email").alias("email")).agg(F.max_by(F.struct("plan_slug", "plan_active"), "at").alias("n"), F.min(F.when(F.col("plan_active") & F.col("plan_slug").isNotNull(), F.col("at"))).alias("_a"))
    both = accounts.withColumn("email", F.lower("email")).join(last, "email", "full_outer")
    slug = F.when(F.col("n").isNotNull(), F.col("n.plan_slug")).otherwise(F.col("plan_slug"))
    on = F.when(F.col("n").isNotNull(), F.col("n.plan_active")).otherwise(F.col("plan_active"))
    return both.select("email", slug.alias("plan_slug"), (on & slug.isNotNull()).alias("plan_active"), F.coalesce("activated_at", "_a").alias("activated_at"))


def lead_states(events: DataFrame) -> DataFrame:
    """events (lead_id, at, status, honeypot): the state of each lead that is no robot's; contacted_at is the first touch,
    and once converted a lead stays so."""
    real = events.groupBy("lead_id").agg(
        F.bool_or(F.coalesce(F.col("honeypot") != "", F.lit(False))).alias("_robot"), F.max_by("status", F.struct("at", "status")).alias("_last"),
        F.min(F.when(F.col("status") == "contacted", F.col("at"))).alias("contacted_at"), F.bool_or(F.col("status") == "converted").alias("_done"),
    )
    return real.where("NOT _robot").select("lead_id", F.when(F.col("_done"), "converted").otherwise(F.col("_last")).alias("status"), "contacted_at")


def model_scores(reads: DataFrame) -> DataFrame:
    """reads (model, items, priced, adds_up, prompt_tokens, completion_tokens, prompt_price, completion_price: per million)."""
    cost = (F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")) / 1e6
    return reads.groupBy("model").agg(F.sum("items").alias("items"), F.avg(F.col("priced").cast("double")).alias("priced"), F.avg(F.col("adds_up").cast("double")).alias("adds_up"), F.sum(cost).alias("cost"))


def reader_gone(status: Column, message: Column) -> Column:
    """Was no reader there? Out of credit, busy or broken upstream (402, 408, 429, 500 and more), or the second reader failed too."""
    passing = status.isin(*PASSING_STATUS) | (status >= 500)
    return F.coalesce(passing, F.lit(False)) | F.coalesce(message.contains(BOTH_FAILED), F.lit(False))


def failure_code(message: Column, error: Column, unavailable: Column) -> Column:
    """The stable code of a failed job: message, type of the error, and whether no reader was available."""
    return (
        F.when(F.coalesce(message.contains(NO_PAGE), F.lit(False)), FAILURE_CODES[0])
        .when(F.coalesce(error == "FileNotFoundError", F.lit(False)), FAILURE_CODES[1])
        .when(F.coalesce(unavailable, F.lit(False)), FAILURE_CODES[2])
        .otherwise(FAILURE_CODES[3])
    )


def cancelled(status: Column) -> Column:
    """A job that is done cannot be cancelled."""
    return F.when(status.isin("completed", "failed", "cancelled"), status).otherwise("cancelled")


def capped_warnings(*parts: Column, most: int = 50) -> Column:
    return F.slice(F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]), 1, most)


def first_that_passes(*candidates: tuple[Column, Column]) -> Column:
    """The first (value, passed) of a cascade that passed."""
    return F.coalesce(*[F.when(ok, value) for value, ok in candidates])
