"""SimHash near-duplicates: segment popcounts as an embedding, a grid range join, exact verification."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.base import hex64, slices, utf8
from tallyspark.llm.components import connected_components
from tallyspark.session import stored, unsent

SEED = 42
CHUNK = 65_536  # shingles hashed at once, so that a text of any length needs bounded memory
SEGMENTS = 16  # of four bits each
DENSE_CELL = 64  # fingerprints in a grid cell from which on pairs are not compared one by one


def shingle_hashes(text: bytes, size: int):
    """Arrays of the XXH64 of all word shingles of a text, in order; a text of fewer words is one shingle."""
    words = text.lower().split()
    if not words:
        return
    if len(words) < size:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    shingles = zip(*(islice(words, k, None) for k in range(size)))
    digest = xxhash.xxh64_intdigest
    while part := [digest(b" ".join(s), SEED) for s in islice(shingles, CHUNK)]:
        yield np.array(part, dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, total: int) -> int:
    """The signed long whose bits are set in over half of ``total`` hashes."""
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<i8")[0])


def fingerprint(text: bytes, size: int) -> int:
    counts, total = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text, size):
        counts += bit_counts(hashes)
        total += len(hashes)
    return majority(counts, total) if total else 0


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id long, fp long)`` of every row; null or wordless texts have fingerprint zero."""

    def run(batches):
        for batch in slices(batches):
            fps = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def popcounts(fp: Column) -> Column:
    """The bit counts of the 16 four-bit segments, one in each hex digit of a long."""
    ones = F.lit(0x1111111111111111)
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in (1, 2, 3)), fp.bitwiseAND(ones))


def grid_cells(fps: DataFrame) -> DataFrame:
    """``(fp, cell)``: a fingerprint stands in the cell of its segment counts and in the cells next to it.

    The Manhattan distance of the counts is a lower bound of the bit distance. Two count vectors at distance 2 or
    less have a vector between them that is at distance 1 or less from both, so linked fingerprints share a cell.
    """
    at = F.col("at")
    near = [at]
    for i in range(SEGMENTS):
        digit = F.shiftrightunsigned(at, 4 * i).bitwiseAND(F.lit(15))
        step = F.lit(1 << (4 * i))  # a digit is four at most, so the sums stay below the sign bit
        near += [F.when(digit < 4, at + step), F.when(digit > 0, at - step)]
    cells = F.explode(F.array_compact(F.array(*near)))
    return fps.select("fp", popcounts(F.col("fp")).alias("at")).select("fp", cells.alias("cell"))


def linked(fps: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that join all distinct fingerprints at two or fewer differing bits.

    In an ordinary grid cell every pair is verified. Members of a dense cell are linked without pairs: two
    fingerprints are at distance 2 or less exactly if flipping one bit or none of each gives a common value, and
    everything within one bit of a value is linked, so a star around the least member of each value joins the
    same fingerprints. A value has 65 members at most.
    """
    cells = grid_cells(fps)
    dense = stored(cells.groupBy("cell").count().where(F.col("count") > DENSE_CELL).select("cell"), "dense")
    sparse = unsent(cells.join(dense, "cell", "left_anti"))
    pairs = (
        sparse.withColumnRenamed("fp", "a")
        .join(sparse.withColumnRenamed("fp", "b"), "cell")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
        .select("a", "b")
    )
    members = cells.join(dense, "cell", "left_semi").select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(bit)) for bit in [1 << i for i in range(63)] + [-(1 << 63)]]
    values = unsent(members.select("fp", F.explode(F.array(*flips)).alias("value")))
    least = values.groupBy("value").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = values.join(least, "value").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionAll(stars)


def near_copies(docs: DataFrame, words: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs(doc_id, text)``; links at two bits or fewer.

    ``component_id`` is the least doc_id that links lead to. Null and wordless texts have fingerprint zero and are
    linked like any other. Repeated rows come back as often as they came; a row with a null doc_id is linked too
    but names no component. Other columns are not looked at; an empty table gives no rows.
    """
    rows = stored(fingerprints(docs, words), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = connected_components(linked(classes.select("fp")))
    rooted = stored(
        classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")),
        "rooted",
    )
    least = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    named = stored(rooted.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
