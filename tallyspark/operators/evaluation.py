"""Score extracted records against ground truth, field by field and in record order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, DoubleType, FloatType, NumericType

from tallyspark import fixed
from tallyspark.functions.text import squeeze


def comparable(value: Column, kind: DataType) -> Column:
    """The form in which two field values are compared, as text; null stays null.

    Text loses extra blanks, numbers are rounded half up to cents, lists are ordered. A boolean never equals a
    number, and an infinite number equals only itself.
    """
    if isinstance(kind, ArrayType):
        items = F.transform(value, lambda v: comparable(v, kind.elementType))
        ordered = F.sort_array(F.transform(items, lambda i: F.coalesce(F.concat(F.lit("="), i), F.lit("~"))))
        return F.to_json(ordered)
    if isinstance(kind, BooleanType):
        return F.concat(F.lit("bool:"), value.cast("string"))
    if isinstance(kind, (DoubleType, FloatType)):
        # the shortest decimal text of a double, so that 2.675 rounds to 2.68
        finite = F.round(value.cast("string").try_cast("decimal(38,10)"), 2).cast("string")
        special = F.concat(F.lit("nonfinite:"), value.cast("string"))
        odd = F.isnan(value) | (F.abs(value) == float("inf"))
        return F.when(odd, special).otherwise(F.concat(F.lit("number:"), finite))
    if isinstance(kind, (DecimalType, NumericType)):
        return F.concat(F.lit("number:"), F.round(value.cast("decimal(38,10)"), 2).cast("string"))
    return F.concat(F.lit("text:"), squeeze(value))


def _field_kinds(df: DataFrame) -> dict[str, DataType]:
    return {f.name: f.dataType for f in df.schema["records"].dataType.elementType.fields}


def _comparable_records(df: DataFrame, names: list[str], side: str) -> DataFrame:
    """``doc_id``, the number of records and the records as arrays of comparable texts, one struct per record."""
    kinds = _field_kinds(df)

    def texts(record):
        return F.struct(*[
            (comparable(record[name], kinds[name]) if name in kinds else F.lit(None).cast("string")).alias(f"f{i}")
            for i, name in enumerate(names)
        ])

    records = F.coalesce(F.col("records"), F.array())
    return df.select("doc_id", F.size(records).alias(f"{side}_n"), F.transform(records, texts).alias(side))


def paired_records(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per ground-truth document ``doc_id, t_n, p_n, pairs``: record counts and one struct of flags per position.

    Both sides are reduced to comparable text before the one join on the document; records pair up inside the
    row, and one on a single side misses every field. ``p_n`` is null where there is no prediction.
    """
    left = _comparable_records(truth, [t for t, _ in fixed.SCORED_FIELDS], "t")
    right = _comparable_records(predictions, [p for _, p in fixed.SCORED_FIELDS], "p")

    def flags(t, p):
        both = t.isNotNull() & p.isNotNull()
        return F.struct(*[
            (both & t[f"f{i}"].eqNullSafe(p[f"f{i}"])).alias(name) for i, (name, _) in enumerate(fixed.SCORED_FIELDS)
        ])

    joined = left.join(right, "doc_id", "left")
    # without a prediction the other side is as empty as an array can be
    found = F.coalesce(F.col("p"), F.slice("t", 1, 0))
    return joined.select("doc_id", "t_n", "p_n", F.zip_with("t", found, flags).alias("pairs"))


def field_matches(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """One row per compared record: ``doc_id, pos`` and one flag per scored field.

    Documents without ground truth are left out. The rows stay where the join put their document, so grouping
    them by document needs no further shuffle.
    """
    paired = paired_records(truth, predictions).select("doc_id", F.posexplode("pairs").alias("pos", "_pair"))
    return paired.select("doc_id", "pos", "_pair.*")


def _ratio(matched: Column, total: Column) -> Column:
    return F.when(total > 0, F.bround(matched / total, 4)).otherwise(F.lit(0.0))


def accuracy(matches: DataFrame) -> DataFrame:
    """Matched, total and ratio overall, per field and per document: ``grain, doc_id, field``.

    The hits of a document are counted before fields become rows, so the wide shuffle carries one row per
    document instead of twelve per record.
    """
    names = [name for name, _ in fixed.SCORED_FIELDS]
    per_document = matches.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(name).alias(name) for name in names]
    )
    fields = F.array(
        *[F.struct(F.lit(n).alias("field"), F.col(n).alias("matched"), F.col("n").alias("total")) for n in names]
    )
    long = per_document.select("doc_id", F.inline(fields))
    sums = long.groupingSets(
        [[], ["field"], ["doc_id"]], "field", "doc_id"
    ).agg(
        F.grouping_id().alias("_g"),
        F.sum("matched").alias("matched"),
        F.sum("total").alias("total"),
    )
    grain = F.when(F.col("_g") == 3, "overall").when(F.col("_g") == 1, "field").otherwise("document")
    return sums.select(
        grain.alias("grain"),
        "doc_id",
        "field",
        "matched",
        "total",
        _ratio(F.col("matched"), F.col("total")).alias("accuracy"),
    )


def document_scores(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Per ground-truth document: status, record counts, field accuracy."""
    names = [name for name, _ in fixed.SCORED_FIELDS]
    zero = F.lit(0).cast("bigint")
    matched = F.aggregate("pairs", zero, lambda n, pair: n + sum((pair[f].cast("int") for f in names), zero))
    counted = paired_records(truth, predictions).select(
        "doc_id", "t_n", "p_n", matched.alias("matched"), (F.size("pairs") * len(names)).alias("total")
    )
    return counted.select(
        "doc_id",
        F.when(F.col("p_n").isNotNull(), "scored").otherwise("missing_prediction").alias("status"),
        F.col("t_n").alias("records_expected"),
        F.coalesce("p_n", F.lit(0)).alias("records_predicted"),
        _ratio(F.col("matched"), F.col("total")).alias("field_accuracy"),
    )


def duplicate_documents(truth: DataFrame) -> DataFrame:
    return truth.groupBy("doc_id").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def require_unique_documents(truth: DataFrame) -> DataFrame:
    """The same table; raises when a ``doc_id`` occurs twice."""
    found = duplicate_documents(truth).limit(5).collect()
    if found:
        raise ValueError(f"duplicate doc_id in ground truth: {[r['doc_id'] for r in found]}")
    return truth
