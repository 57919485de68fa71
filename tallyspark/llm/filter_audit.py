"""Filter interaction audit: a byte transducer measures texts, patterns of failed filters answer all orders."""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.llm.base import slices, utf8

CHUNK = 1 << 18  # bytes that go through the transducer at once, so that a text of any length needs bounded memory
LEAST_WORDS = 200
LEAST_DISTINCT_PERCENT = 50
MOST_CAPITALS_PERCENT = 3
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]

# Classes of bytes and what the transducer gives for them, as bits.
BETWEEN, INSIDE = 0, 1  # states: between words, inside a word
OPENS, CLOSES, POINT, CAPITAL, SYMBOL = 1, 2, 4, 8, 16


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """``(next state by byte, output by state and byte)``.

    White space is ASCII, so the bytes of a longer character are all inside a word, and only the first one counts
    as a code point. The next state is told by the byte alone, which lets whole arrays go through the tables.
    """
    byte = np.arange(256)
    blank = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    output = np.zeros((2, 256), dtype=np.uint8)
    output[:, (byte & 0xC0) != 0x80] |= POINT
    output[:, (byte >= ord("A")) & (byte <= ord("Z"))] |= CAPITAL
    output[:, np.isin(byte, np.frombuffer(SYMBOLS.encode(), np.uint8))] |= SYMBOL
    output[BETWEEN, ~blank] |= OPENS
    output[INSIDE, blank] |= CLOSES
    return np.where(blank, BETWEEN, INSIDE).astype(np.uint8), output


NEXT, OUTPUT = transducer()


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, distinct words, code points, capitals and symbols of a UTF-8 text, in one pass over its bytes.

    Word spans go into a set of byte strings: where two hashes agree the set compares the words themselves.
    """
    codes = np.frombuffer(text, dtype=np.uint8)
    words, points, capitals, symbols = 0, 0, 0, 0
    seen: set[bytes] = set()
    state, opened = BETWEEN, 0
    for first in range(0, len(codes), CHUNK):
        part = codes[first : first + CHUNK]
        after = NEXT[part]
        before = np.concatenate((np.array([state], dtype=np.uint8), after[:-1]))
        out = OUTPUT[before, part]
        starts = np.flatnonzero(out & OPENS) + first
        ends = np.flatnonzero(out & CLOSES) + first
        words += len(starts)
        points += int(np.count_nonzero(out & POINT))
        capitals += int(np.count_nonzero(out & CAPITAL))
        symbols += int(np.count_nonzero(out & SYMBOL))
        spans = starts.tolist()
        if state == INSIDE:
            spans.insert(0, opened)
        state = int(after[-1])
        if state == INSIDE:
            opened = spans.pop()
        seen.update([text[a:b] for a, b in zip(spans, ends.tolist())])
    if state == INSIDE:
        seen.add(text[opened:])
    return words, len(seen), points, capitals, symbols


def text_failures(docs: DataFrame) -> DataFrame:
    """``(doc_id, part, digest, bits)`` of every row: bit 0 to 3 is set if the text fails filter A to D."""

    def run(batches):
        for batch in slices(batches):
            bits = []
            for text in batch.column(3).to_pylist():
                words, distinct, points, capitals, symbols = measures(text)
                bits.append(
                    (words < LEAST_WORDS)
                    | (100 * distinct < LEAST_DISTINCT_PERCENT * words) << 1
                    | (100 * capitals > MOST_CAPITALS_PERCENT * points) << 2
                    | (symbols > 0) << 3
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(bits, pa.int32())],
                names=["doc_id", "part", "digest", "bits"],
            )

    text = utf8(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"),
    )
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, bits int")


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, bits, n, good, toxic)``: how many rows of a part fail just the filters of ``bits``, and their labels.

    Copies of a text are counted by document before they meet, so the rows of a text, however many, come together as
    one row per part and label. A row fails E (bit 4) if a smaller ``doc_id`` has the same text (by SHA-256).
    """
    per_document = text_failures(docs).groupBy("digest", "part", "bits", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(c)
    labelled = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("l_doc"))
    labelled = labelled.agg(is_one("quality"), is_one("toxic"))
    met = per_document.join(labelled, F.col("doc_id") == F.col("l_doc"), "left")
    known = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = met.select("digest", "part", "bits", "doc_id", "n", known("quality"), known("toxic"))
    grouped = rows.groupBy("digest", "part", "bits", "quality", "toxic").agg(
        F.sum("n").alias("n"),
        F.min("doc_id").alias("least"),
        # rows of the least doc_id, and rows without one: no smaller document is known for them
        F.min_by("n", "doc_id").alias("n_least"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    first = F.min("least").over(Window.partitionBy("digest"))
    first = grouped.withColumn("first", first)
    kept = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    either = F.array(
        F.struct(F.col("bits").alias("bits"), kept.alias("n")),
        F.struct((F.col("bits") + 16).alias("bits"), (F.col("n") - kept).alias("n")),
    )
    both = first.select("part", "quality", "toxic", F.explode(either).alias("it"))
    return both.groupBy("part", F.col("it.bits").alias("bits")).agg(
        F.sum("it.n").alias("n"),
        F.sum(F.col("it.n") * F.col("quality")).alias("good"),
        F.sum(F.col("it.n") * F.col("toxic")).alias("toxic"),
    )


def steps() -> Column:
    """All orders and steps: ``(filter_order, step, own, earlier)``, filters as bits."""
    rows = []
    for order in ORDERS:
        earlier = 0
        for k, letter in enumerate(order):
            own = 1 << FILTERS.index(letter)
            rows.append(f"{order},{k + 1},{own},{earlier}")
            earlier |= own
    cut = lambda x: F.split(x, ",")
    return F.transform(F.split(F.lit(";".join(rows)), ";"), lambda x: F.struct(
        cut(x)[0].alias("filter_order"), cut(x)[1].cast("int").alias("step"),
        cut(x)[2].cast("int").alias("own"), cut(x)[3].cast("int").alias("earlier"),
    ))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What every filter does at every step of every order, per value of ``lang``.

    Filters are A too few words, B too few distinct words, C too many capitals, D symbols, E a smaller document's
    text. ``docs`` has ``doc_id``, ``text``, ``lang``, ``labels`` has ``doc_id``, ``quality``, ``toxic``; other columns
    take no part. A null text is empty, a null language is the part ``""``. Repeated rows count each, and are no copies
    of each other; a row without ``doc_id`` has no label and fails E never, nor makes others fail. Of several label
    rows of a document a 1 counts. An empty table gives no rows.

    At most 32 patterns of a part go through the orders, whatever the number of documents.
    """
    at_step = patterns(docs, labels).select("part", "bits", "n", "good", "toxic", F.explode(steps()).alias("at"))
    has = lambda mask: F.col("bits").bitwiseAND(F.col(f"at.{mask}")) != 0
    fails, gone = has("own"), has("earlier")
    removed = fails & ~gone
    total = lambda when, of=F.col("n"): F.sum(F.when(when, of).otherwise(0))
    # of the orders of all filters, a pattern's filters come first equally often
    first_in = F.col("n") * F.try_divide(F.lit(len(ORDERS)), F.bit_count("bits")).cast("long")
    return at_step.groupBy("part", F.col("at.filter_order").alias("filter_order"), F.col("at.step").alias("step")).agg(
        total(~fails & ~gone).alias("kept"),
        total(removed).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("bits") == F.col("at.own")).alias("unique_fails"),
        total(removed, F.col("good")).alias("good_lost"),
        total(removed, F.col("toxic")).alias("toxic_lost"),
        total(fails, first_in).alias("shapley"),
    )
