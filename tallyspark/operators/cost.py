"""Token usage and what it costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark import fixed


def token_usage(
    input_tokens: Column, output_tokens: Column, total_tokens: Column, cached: Column, reasoning: Column
) -> Column:
    """Usage map: input, output and total always, the two sub-counts only when positive."""
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    total = F.when(zero(total_tokens) != 0, zero(total_tokens)).otherwise(zero(input_tokens) + zero(output_tokens))
    entries = F.create_map(
        F.lit("input"), zero(input_tokens),
        F.lit("output"), zero(output_tokens),
        F.lit("total"), total,
        F.lit("cached_input"), zero(cached),
        F.lit("reasoning"), zero(reasoning),
    )
    optional = lambda key: key.isin("cached_input", "reasoning")
    return F.map_filter(entries, lambda key, value: ~optional(key) | (value != 0))


def price_of(model: Column) -> Column:
    """Rates of the longest known model name that begins the id, else those of the default model.

    A handful of constant rates needs no join: longer names are tried first.
    """
    exact = lambda rate, name: F.lit(str(rate)).cast("decimal(9,4)").alias(name)
    rates = {
        name: F.struct(exact(i, "input"), exact(c, "cached"), exact(o, "output"))
        for name, i, c, o in fixed.MODEL_PRICES
    }
    ordered = sorted(rates, key=len, reverse=True)
    chain = reduce(
        lambda chain, name: chain.when(model.startswith(name), rates[name]), ordered, F.when(F.lit(False), None)
    )
    return chain.otherwise(rates[fixed.DEFAULT_PRICE_MODEL])


def cost_usd(model: Column, input_tokens: Column, cached: Column, output_tokens: Column) -> Column:
    """Spend in USD, in exact decimals, rounded half-even to six places."""
    price = price_of(model)
    fresh = F.greatest(F.lit(0), input_tokens - cached)
    spend = fresh * price["input"] + cached * price["cached"] + output_tokens * price["output"]
    return F.bround(spend * F.lit("0.000001").cast("decimal(6,6)"), 6).cast("double")


def with_cost(usage: DataFrame) -> DataFrame:
    """Add ``cost_usd`` to ``usage(model, input, cached_input, output)``."""
    cached = F.coalesce("cached_input", F.lit(0))
    return usage.withColumn("cost_usd", cost_usd(F.col("model"), F.col("input"), cached, F.col("output")))


def cost_by_model(usage: DataFrame) -> DataFrame:
    """Calls, tokens and spend per model; costs add up as exact decimals, in any order."""
    return (
        with_cost(usage)
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("input").alias("input"),
            F.sum("output").alias("output"),
            F.sum(F.col("cost_usd").cast("decimal(20,6)")).cast("double").alias("cost_usd"),
        )
    )
