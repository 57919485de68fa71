"""Rules the domain text states for billing records, as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.functions.text import blank_to_null, strip
from tallyspark.schema import MONEY_COLUMNS


def review_severity(
    total: Column, ins_paid: Column, adjustment: Column, payments: Column, balance: Column
) -> Column:
    """``high`` when four of five amounts or the total are missing, ``medium`` for two or three, ``low`` for one."""
    missing = sum((c.isNull().cast("int") for c in (ins_paid, adjustment, payments, balance)), total.isNull().cast("int"))
    return (
        F.when((missing >= 4) | total.isNull(), "high")
        .when(missing >= 2, "medium")
        .when(missing == 1, "low")
    )


def with_review_severity(records: DataFrame) -> DataFrame:
    return records.withColumn("severity", review_severity(*[F.col(c) for c in MONEY_COLUMNS]))


def prefer_summary(items: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """The summary amounts of a key where there is a summary row, else the sums of its items."""
    sums = items.groupBy(key).agg(*[F.sum(c).alias(f"_{c}") for c in MONEY_COLUMNS])
    stated = summaries.select(key, *MONEY_COLUMNS, F.lit(True).alias("_stated"))
    has_summary = F.coalesce("_stated", F.lit(False))
    return sums.join(stated, key, "full").select(
        key,
        F.when(has_summary, "summary").otherwise("items").alias("basis"),
        *[F.when(has_summary, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in MONEY_COLUMNS],
    )


def prefer_ledger(ledger: DataFrame, forms: DataFrame, keys: list[str]) -> DataFrame:
    """The ledger row of an episode, with a claim form filling only what the ledger leaves open."""
    values = [c for c in ledger.columns if c not in keys]
    form = forms.select(*keys, *[F.col(c).alias(f"_{c}") for c in values if c in forms.columns], F.lit(True).alias("_form"))
    rows = ledger.withColumn("_ledger", F.lit(True)).join(form, keys, "full")
    pick = lambda c: (F.coalesce(c, f"_{c}") if c in forms.columns else F.col(c)).alias(c)
    source = F.when(F.col("_ledger").isNull(), "form").when(F.col("_form").isNull(), "ledger").otherwise("both")
    return rows.select(*keys, *[pick(c) for c in values], source.alias("source"))


def paid_total(third_party_paid: Column, patient_paid: Column, summary_total: Column) -> Column:
    """Total of a two-column pharmacy: the stated total, else what both parties paid, flagged as assumed."""
    assumed = F.coalesce(third_party_paid, F.lit(0)) + F.coalesce(patient_paid, F.lit(0))
    known = third_party_paid.isNotNull() | patient_paid.isNotNull()
    return F.struct(
        F.coalesce(summary_total, F.when(known, assumed)).alias("total_charges"),
        (summary_total.isNull() & known).alias("assumed"),
    )


def settled_adjustment(total: Column, ins_paid: Column, payments: Column, balance: Column) -> Column:
    """Write-off of a settled account: what charges exceed both payments by, else null."""
    gap = total - F.coalesce(ins_paid, F.lit(0)) - F.coalesce(payments, F.lit(0))
    return F.when((balance == 0) & (gap > 0), gap)


def codes_on_range(treatment_start: Column, treatment_end: Column, codes: Column) -> Column:
    """True where a multi-day record still lists procedure codes, which the rules forbid."""
    return F.coalesce((treatment_start != treatment_end) & (F.size(codes) > 0), F.lit(False))


def no_placeholder(value: Column) -> Column:
    """The value, or null when it is blank or only says that it is unknown."""
    bare = blank_to_null(strip(value))
    return F.when(~F.lower(bare).isin("n/a", "unknown"), bare)
