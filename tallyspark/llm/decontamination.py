"""Benchmark decontamination by spaced seeds, in built-in functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.base import unused

# Which of the tokens of a window a seed looks at. Every seed has eight tokens. Whichever two of 14
# aligned tokens are substituted, one of the seeds fits among the others at some place.
SEEDS = ["11101110011", "11010011111", "10011111101", "110110010111"]
OVERLAP = 14  # aligned tokens that are compared around a hit
LEAST_EQUAL = 12  # of them
PIECE = 1000  # tokens of an item that are searched together
BLOCK = 500_000  # benchmark windows that are sent to all executors at once


def token_hashes(text: Column) -> Column:
    """One 64-bit hash per lower-cased run of letters and digits; null has none."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda word: F.xxhash64(word))


def turned(value: Column, by: int) -> Column:
    if not by:
        return value
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by))


def seed_hashes(tokens: Column, at: Column) -> list[Column]:
    """For each seed, the hash of the window that starts at the zero-based token ``at``, null where it passes the end.

    A window's hash is the exclusive or of its marked tokens, each turned by its place.
    """
    hashes = []
    for seed in SEEDS:
        kept = [turned(F.get(tokens, at + k), 4 * k) for k, mark in enumerate(seed) if mark == "1"]
        hashes.append(reduce(lambda a, b: a.bitwiseXOR(b), kept).bitwiseXOR(F.lit(len(seed))))
    return hashes


def run_hash(tokens: Column, at: Column, length: int) -> Column:
    """The hash of the ``length`` tokens from ``at`` on, null where they pass the end."""
    turns = [turned(F.get(tokens, at + k), 4 * k) for k in range(length)]
    return reduce(lambda a, b: a.bitwiseXOR(b), turns).bitwiseXOR(F.lit(length))


def whole_items(texts: DataFrame, items: DataFrame, lengths: dict[int, int]) -> list[DataFrame]:
    """``(doc_id, item_id, at, equal, passed)`` of the runs in ``texts`` that are a whole item of one of ``lengths``.

    ``lengths`` has the number of items by length; as with windows, the items are sent in blocks.
    """
    if not lengths:
        return []
    blocks = max(1, math.ceil(sum(lengths.values()) / BLOCK))
    # no filter on the number of tokens, as in windows
    starts = F.explode(F.when(F.size("tokens") >= 1, F.sequence(F.lit(0), F.size("tokens") - 1)))
    placed = texts.select("doc_id", "tokens", starts.alias("at"))
    runs = [
        F.struct(F.lit(n).alias("length"), run_hash(F.col("tokens"), F.col("at"), n).alias("hash")) for n in sorted(lengths)
    ]
    seen = placed.select("doc_id", "tokens", "at", F.explode(F.array(*runs)).alias("run"))
    seen = seen.select("doc_id", "tokens", "at", "run.length", "run.hash")
    hashes = [run_hash(F.col("all_tokens"), F.lit(0), n) for n in sorted(lengths)]
    hash_of = F.element_at(F.map_from_arrays(F.array(*map(F.lit, sorted(lengths))), F.array(*hashes)), F.size("all_tokens"))
    short = items.where(F.size("all_tokens") < OVERLAP)
    short = short.select("item_id", "all_tokens", F.size("all_tokens").alias("length"), hash_of.alias("hash"))
    found = []
    for block in range(blocks):
        part = short.where(F.pmod(F.xxhash64("all_tokens"), F.lit(blocks)) == block)
        hits = seen.join(F.broadcast(part), ["length", "hash"])
        same = F.slice("tokens", F.col("at") + 1, F.col("length")) == F.col("all_tokens")
        found.append(hits.select("doc_id", "item_id", "at", F.col("length").alias("equal"), same.alias("passed")))
    return found


def windows(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per seed and place of ``rows(tokens, ...)``: ``at`` and ``hash``."""
    shortest, size = min(map(len, SEEDS)), F.size("tokens")
    # no filter on the number of tokens: it would go below the projection and split every text twice
    starts = F.explode(F.when(size >= shortest, F.sequence(F.lit(0), size - shortest)))
    placed = rows.select(*keep, "tokens", starts.alias("at"))
    # as columns first: four seeds inside the explode took several times as long
    hashes = {f"_h{k}": h for k, h in enumerate(seed_hashes(F.col("tokens"), F.col("at")))}
    hashed = placed.select(*keep, "tokens", "at", *(h.alias(name) for name, h in hashes.items()))
    return hashed.select(*keep, "tokens", "at", F.explode(F.array(*hashes)).alias("hash"))


SLACK = OVERLAP - min(map(len, SEEDS))


def around(tokens: Column, at: Column) -> Column:
    """The tokens that a comparison around a hit at ``at`` can reach, null beyond the ends."""
    return F.array(*(F.get(tokens, at + k) for k in range(-SLACK, OVERLAP)))


def most_equal(tokens: Column, at: Column, item_around: Column) -> Column:
    """The most equal tokens of any ``OVERLAP`` aligned ones that hold the shortest seed's window at ``at``."""
    marks = {
        k: F.when(F.get(tokens, at + k) == F.get(item_around, F.lit(k + SLACK)), 1).otherwise(0)
        for k in range(-SLACK, OVERLAP)
    }
    return F.greatest(*(sum((marks[k + j] for j in range(1, OVERLAP)), marks[k]) for k in range(-SLACK, 1)))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, equal_tokens, first_token, hits)``: documents that overlap a benchmark item.

    A seed hashes the tokens at its marked places, so a substituted token at another place does not change the
    hash. Hashes of all windows of ``docs(doc_id, text)`` and ``benchmark(item_id, text)`` are joined; around a
    hit, the two texts are compared token by token on the same alignment, and at least 12 of 14 aligned tokens
    must be equal; places beyond the end of a text are not. One of the seeds fits wherever that holds, so no such
    overlap is lost. An item of fewer than 14 tokens, down to one, overlaps the documents that hold the whole of it,
    token by token. Items with the same tokens are reported under the least item_id. A null or wordless text has
    no overlap. Rows without a doc_id are compared but reported under null; repeated
    rows count as one document; other columns are not looked at; empty tables give no rows.

    The hash side is sent to all executors in blocks of a fixed number of windows, each joined with all documents,
    so no text is shuffled and a benchmark of any size fits. With each window goes what a comparison can reach.
    """
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), token_hashes(F.col("text")).alias("all_tokens"))
        .groupBy("all_tokens")
        .agg(F.min("item_id").alias("item_id"))
        .where(F.size("all_tokens") >= 1)
    )
    by_length = items.groupBy(F.least(F.size("all_tokens"), F.lit(OVERLAP)).alias("length"))
    by_length = by_length.agg(F.count("*").alias("items"), F.sum(F.size("all_tokens")).alias("tokens")).collect()
    total = sum(r.tokens * len(SEEDS) for r in by_length if r.length == OVERLAP)
    blocks = max(1, math.ceil(total / BLOCK))
    # a long item is cut into pieces that overlap by what a comparison around a hit can reach
    starts = F.explode(F.sequence(F.lit(0), F.size("all_tokens") - OVERLAP, F.lit(PIECE)))
    long = items.where(F.size("all_tokens") >= OVERLAP)
    pieces = long.select("item_id", "all_tokens", starts.alias("start")).select(
        "item_id",
        F.slice("all_tokens", F.greatest(F.col("start") - 3 * OVERLAP, F.lit(0)) + 1, PIECE + 6 * OVERLAP).alias(
            "tokens"
        ),
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_hashes(F.col("text")).alias("tokens"))
    seen = windows(texts, "doc_id")
    found = whole_items(texts, items, {r.length: r["items"] for r in by_length if r.length < OVERLAP})
    for block in range(blocks):
        part = pieces.where(F.pmod(F.xxhash64("tokens"), F.lit(blocks)) == block)
        sought = windows(part, "item_id").select(
            "hash", "item_id", around(F.col("tokens"), F.col("at")).alias("item_around")
        )
        hits = seen.join(F.broadcast(sought), "hash")
        equal = most_equal(F.col("tokens"), F.col("at"), F.col("item_around"))
        hits = hits.select("doc_id", "item_id", "at", equal.alias("equal"))
        found.append(hits.withColumn("passed", F.col("equal") >= LEAST_EQUAL))
    # the comparison is filtered after grouping, or it would become part of the join's condition
    passed = F.col("passed")
    return (
        reduce(DataFrame.unionAll, found)
        .groupBy("doc_id", "item_id")
        .agg(
            F.max(F.when(passed, F.col("equal"))).alias("equal_tokens"),
            F.min(F.when(passed, F.col("at"))).alias("first_token"),
            F.count_if(passed).alias("hits"),
        )
        .where(F.col("hits") > 0)
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item, with all their columns; each row goes by its own text."""
    name = unused(docs, "row_key")
    marked = docs.withColumn(name, F.xxhash64("doc_id", "text"))
    found = contaminated(marked.select(F.col(name).alias("doc_id"), "text"), benchmark)
    found = found.select(F.col("doc_id").alias(name)).distinct()
    return marked.join(found, name, "left_anti").select(*docs.columns)
