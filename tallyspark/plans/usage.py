"""Queries on token usage, cost, and the remaining record rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import cost as ops, rules
from tallyspark.plans.registry import query
from tallyspark.sources import warehouse

_USAGE = """WITH usage AS (SELECT CASE l_linenumber % 5 WHEN 0 THEN 'gpt-5.4' WHEN 1 THEN 'gpt-5.4-mini-2026-01-01'
    WHEN 2 THEN 'gpt-5.4-nano' WHEN 3 THEN 'gpt-5.4-2026' ELSE 'other-model' END AS model,
  CAST(l_quantity AS BIGINT) * 1000 AS input,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 60000 END AS cached_input,
  CAST(l_suppkey AS BIGINT) * 10 AS output FROM lineitem)"""


def _usage(spark, folder):
    c = F.col
    model = (
        F.when(c("l_linenumber") % 5 == 0, "gpt-5.4")
        .when(c("l_linenumber") % 5 == 1, "gpt-5.4-mini-2026-01-01")
        .when(c("l_linenumber") % 5 == 2, "gpt-5.4-nano")
        .when(c("l_linenumber") % 5 == 3, "gpt-5.4-2026")
        .otherwise("other-model")
    )
    return warehouse.table(spark, folder, "lineitem").select(
        model.alias("model"),
        (c("l_quantity").cast("bigint") * 1000).alias("input"),
        F.when(c("l_linenumber") % 2 == 0, c("l_partkey") % 60000).alias("cached_input"),
        (c("l_suppkey") * 10).alias("output"),
    )


@query(
    "cost_by_model",
    _USAGE + """, prices(name, i, c, o) AS (VALUES ('gpt-5.4', 1250, 125, 10000),
  ('gpt-5.4-mini', 250, 25, 2000), ('gpt-5.4-nano', 50, 5, 400)), models AS (
  SELECT model, coalesce(arg_max(name, length(name)), 'gpt-5.4-mini') AS name
  FROM (SELECT DISTINCT model FROM usage) LEFT JOIN prices ON starts_with(model, name) GROUP BY model), spent AS (
  SELECT u.model, input, output, greatest(0, input - coalesce(cached_input, 0)) * p.i
    + coalesce(cached_input, 0) * p.c + output * p.o AS x
  FROM usage u JOIN models m ON u.model = m.model JOIN prices p ON p.name = m.name)
SELECT model, count(*) AS calls, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output,
  sum(x // 1000 + CASE WHEN x % 1000 > 500 OR (x % 1000 = 500 AND (x // 1000) % 2 = 1) THEN 1 ELSE 0 END)
    / CAST(1000000 AS DOUBLE) AS cost_usd FROM spent GROUP BY model""",
)
def cost_by_model(spark, folder):
    return ops.cost_by_model(_usage(spark, folder))


@query(
    "token_usage_totals",
    _USAGE + """ SELECT model, CAST(sum(input + output) AS BIGINT) AS total,
  CAST(count(*) FILTER (WHERE cached_input > 0) AS BIGINT) AS with_cache,
  CAST(coalesce(sum(cached_input), 0) AS BIGINT) AS cached_input FROM usage GROUP BY model""",
)
def token_usage_totals(spark, folder):
    """Usage maps as stored with a job, added up per model; sub-counts exist only when positive."""
    null = F.lit(None).cast("bigint")
    tokens = ops.token_usage(F.col("input"), F.col("output"), null, F.col("cached_input"), null)
    rows = _usage(spark, folder).select("model", tokens.alias("t"))
    return rows.groupBy("model").agg(
        F.sum(F.col("t")["total"]).alias("total"),
        F.count_if(F.map_contains_key("t", "cached_input")).alias("with_cache"),
        F.coalesce(F.sum(F.try_element_at("t", F.lit("cached_input"))), F.lit(0)).alias("cached_input"),
    )


@query(
    "two_party_totals",
    """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag <> 'A' AND NOT (l_discount = 0 AND l_tax = 0)) AS assumed,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2))
    ELSE coalesce(CASE WHEN l_discount <> 0 THEN CAST(l_discount * 100 AS DECIMAL(18,2)) END, 0)
       + coalesce(CASE WHEN l_tax <> 0 THEN CAST(l_tax * 100 AS DECIMAL(18,2)) END, 0) END) AS DOUBLE) AS total_charges
FROM lineitem GROUP BY l_suppkey""",
)
def two_party_totals(spark, folder):
    """Totals of fills that state what each party paid: the summary where there is one, else an assumed sum."""
    c = F.col
    cents = lambda v: v.cast("decimal(18,2)")
    total = rules.paid_total(
        F.when(c("l_discount") != 0, cents(c("l_discount") * 100)),
        F.when(c("l_tax") != 0, cents(c("l_tax") * 100)),
        F.when(c("l_returnflag") == "A", cents(c("l_extendedprice"))),
    )
    rows = warehouse.table(spark, folder, "lineitem").select("l_suppkey", total.alias("t"))
    return rows.groupBy("l_suppkey").agg(
        F.count_if("t.assumed").alias("assumed"),
        F.coalesce(F.sum("t.total_charges"), F.lit(0)).cast("double").alias("total_charges"),
    )


@query(
    "settled_adjustments",
    """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0) AS written_off,
  CAST(coalesce(sum(CASE WHEN l_returnflag = 'R' AND l_discount > 0 THEN CAST(l_discount * 100 AS DECIMAL(18,2)) END), 0)
    AS DOUBLE) AS amount FROM lineitem GROUP BY l_suppkey""",
)
def settled_adjustments(spark, folder):
    """Write-offs of settled fills: what the charge exceeds the insurer's and the patient's payments by."""
    c = F.col
    cents = lambda v: v.cast("decimal(18,2)")
    total = cents(c("l_extendedprice"))
    gap = rules.settled_adjustment(
        total, total - cents(c("l_discount") * 100), F.lit(None).cast("decimal(18,2)"),
        F.when(c("l_returnflag") == "R", F.lit(0)).otherwise(F.lit(1)),
    )
    rows = warehouse.table(spark, folder, "lineitem").select("l_suppkey", gap.alias("gap"))
    return rows.groupBy("l_suppkey").agg(
        F.count("gap").alias("written_off"), F.coalesce(F.sum("gap"), F.lit(0)).cast("double").alias("amount")
    )


@query(
    "no_placeholders",
    """SELECT count(*) AS events, count(CASE WHEN event_type NOT IN ('error', 'view') THEN 1 END) AS known, user_id
FROM events GROUP BY user_id""",
)
def no_placeholders(spark, folder):
    """Placeholder words and blanks become null: errors are spelt `N/A` and views blank here."""
    kind = F.col("event_type")
    shown = F.when(kind == "error", " N/A").when(kind == "view", "  ").otherwise(kind)
    rows = warehouse.table(spark, folder, "events").select("user_id", rules.no_placeholder(shown).alias("kind"))
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.count("kind").alias("known"))
