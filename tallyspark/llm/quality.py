"""Quality by co-training: a classifier of texts and one of page metadata teach each other."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.llm.base import slices, utf8
from tallyspark.llm.linear import Logistic, folds_of, logit, sigmoid
from tallyspark.session import stored

# The classifiers are fitted on samples of about these many rows, chosen by a hash of doc_id; see ``fit``.
LABELLED_ROWS = 10_000
POOL_ROWS = 10_000
ROUNDS = 4
TAUGHT = 0.1  # of the pool, in a round and for each view
CONFIDENT = 0.95
FOLDS = 5
KEEP = 0.5  # least quality of a document that stays
SOURCE_SLOTS, LANGUAGE_SLOTS = 64, 16
SCALE = 1 << 53


def text_view(text: bytes) -> np.ndarray:
    """Shares of printable characters, and how words, lines and their repeats look."""
    size = max(1, len(text))
    counts = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256).astype(np.float64)
    upper, lower = counts[65:91].sum(), counts[97:123].sum() + counts[128:].sum()
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    kinds = Counter(words)
    most = kinds.most_common(1)[0][1] if kinds else 0
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    shape = [
        np.log1p(len(text)),
        upper / size,
        lower / size,
        upper / max(1.0, upper + lower),
        len(kinds) / n_words,
        most / n_words,
        size / n_words,
        len(set(lines)) / n_lines,
        np.log1p(n_words / n_lines),
        sum(not word[-1:].isalnum() and word[-1] < 128 for word in kinds) / max(1, len(kinds)),
    ]
    return np.concatenate([shape, np.sqrt(counts[32:128] / size)])


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Source and language as hashed indicators, and the declared length."""
    out = np.zeros(SOURCE_SLOTS + LANGUAGE_SLOTS + 3)
    out[zlib.crc32((source or "").encode()) % SOURCE_SLOTS] = 1
    out[SOURCE_SLOTS + zlib.crc32((lang or "").encode()) % LANGUAGE_SLOTS] = 1
    length = np.log1p(max(0, n_chars or 0))
    out[-3:] = length, length * length, n_chars is None
    return out


def views(docs: DataFrame) -> DataFrame:
    """``(doc_id, content, metadata)``, the last two as the bytes of their numbers."""

    def run(batches):
        for batch in slices(batches):
            ids, texts, langs, sources, lengths = (batch.column(k) for k in range(5))
            content = [text_view(t).tobytes() for t in texts.to_pylist()]
            rows = zip(langs.to_pylist(), sources.to_pylist(), lengths.to_pylist())
            meta = [metadata_view(*row).tobytes() for row in rows]
            columns = [ids, pa.array(content, pa.binary()), pa.array(meta, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "metadata"])

    return docs.select(*inputs()).mapInArrow(run, "doc_id long, content binary, metadata binary")


def inputs() -> list[Column]:
    return [
        F.col("doc_id").cast("long").alias("doc_id"),
        utf8(F.col("text")).alias("text"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        F.col("n_chars").cast("long").alias("n_chars"),
    ]


def place(column: str) -> Column:
    """A hash of a column, evenly spread over [0, 1)."""
    return F.pmod(F.xxhash64(column, F.lit("sample")), F.lit(SCALE)) / float(SCALE)


class CoTrained:
    """Two calibrated views. ``fit`` takes labelled rows (``y``) and unlabelled ones (null ``y``)."""

    def fit(self, keys, x, y) -> CoTrained:
        """``x`` is a pair of feature arrays, one of each view; ``y`` is 0, 1 or not a number."""
        known = ~np.isnan(y)
        fold = folds_of(keys, FOLDS)
        self.share = (np.sum(y[known]) + 1) / (known.sum() + 2)
        # scores of labelled rows by models that have not seen them calibrate the views
        held = [np.zeros(len(y)), np.zeros(len(y))]
        for k in range(FOLDS):
            test = known & (fold == k)
            if test.any():
                for view, model in enumerate(co_train(x, np.where(test, np.nan, y), ~known, fold)):
                    held[view][test] = model.probability(x[view][test])
        self.models = co_train(x, y, ~known, fold)
        self.calibrations = [Logistic(1e-3).fit(logit(h[known])[:, None], y[known]) for h in held]
        joint = np.column_stack([self.calibrated(v, h[known]) for v, h in enumerate(held)])
        self.joint = Logistic(1e-3).fit(joint, y[known])
        return self

    def calibrated(self, view: int, raw: np.ndarray) -> np.ndarray:
        return logit(self.calibrations[view].probability(logit(raw)[:, None]))

    def probability(self, x) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of good quality: combined, by content, by metadata."""
        odds = [self.calibrated(v, m.probability(x[v])) for v, m in enumerate(self.models)]
        return self.joint.probability(np.column_stack(odds)), sigmoid(odds[0]), sigmoid(odds[1])


def earned_confidence(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Logistic:
    """What a view's odds are worth, from predictions of labelled rows by models that have not seen them.

    A view that knows nothing gets the share of the class for every row, and so is never confident enough to teach.
    """
    known, half = ~np.isnan(y), fold % 2 == 0
    odds = np.zeros(len(y))
    for test in (half, ~half):
        rows = known & ~test
        odds[known & test] = logit(Logistic(5.0).fit(x[rows], y[rows]).probability(x[known & test]))
    return Logistic(1.0).fit(odds[known][:, None], y[known])


def co_train(x, y, pool, fold) -> list[Logistic]:
    """Fit both views; in each round, a view's most confident labels of pool rows go to the other view."""
    labels = [y.copy(), y.copy()]
    earned = [earned_confidence(x[view], y, fold) for view in range(2)]
    models = []
    for round_number in range(ROUNDS + 1):
        models = []
        for view in range(2):
            rows = ~np.isnan(labels[view])
            weight = np.where(np.isnan(y[rows]), 0.5, 1.0)  # what another view believes counts half
            models.append(Logistic(5.0).fit(x[view][rows], labels[view][rows], weight))
        if round_number == ROUNDS or not pool.any():
            break
        for view in range(2):
            p = earned[view].probability(logit(models[view].probability(x[view]))[:, None])
            other = labels[1 - view]
            sure = pool & np.isnan(other) & (np.maximum(p, 1 - p) >= CONFIDENT)
            order = np.flatnonzero(sure)[np.argsort(-np.maximum(p, 1 - p)[sure], kind="stable")]
            taken = order[: max(1, int(TAUGHT * pool.sum()))]
            other[taken] = (p[taken] >= 0.5).astype(float)
    return models


def fit(docs: DataFrame, labels: DataFrame) -> CoTrained:
    """Fit on about ``LABELLED_ROWS`` labelled and ``POOL_ROWS`` unlabelled documents.

    The samples are the rows whose hashed doc_id is below a share that follows from the row counts, so they are
    the same on every run, need no ordering, and hold a document with all its repeats. A document with several
    labels has their mean, rounded up; null labels and null ids take no part.
    """
    wanted = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    wanted = wanted.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    wanted = stored(wanted.select("doc_id", (F.col("y") >= 0.5).cast("double").alias("y")), "labels")
    # labels may name documents that are not here, and so take no part in the counts
    ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    labelled, total = ids.join(wanted, "doc_id", "left_semi").count(), ids.count()
    near = min(1.0, LABELLED_ROWS / max(1, labelled))
    far = min(1.0, POOL_ROWS / max(1, total - labelled))
    sample = docs.where("doc_id IS NOT NULL").where(place("doc_id") < max(near, far))
    seen = views(sample).join(wanted.where(place("doc_id") < max(near, far)), "doc_id", "left")
    chosen = F.when(F.col("y").isNotNull(), place("doc_id") < near).otherwise(place("doc_id") < far)
    rows = seen.where(chosen).dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    sizes = {"content": len(text_view(b"")), "metadata": len(metadata_view(None, None, None))}
    x = tuple(np.frombuffer(b"".join(map(bytes, rows[c])), np.float64).reshape(-1, size) for c, size in sizes.items())
    return CoTrained().fit(rows["doc_id"].to_numpy(np.int64), x, rows["y"].to_numpy(np.float64))


def score(docs: DataFrame, model: CoTrained, *extra: str) -> DataFrame:
    """``kept_0``, ``kept_1`` and so on, the ``extra`` columns of ``docs``, and ``quality``, ``content_quality``,
    ``metadata_quality`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches):
            texts, langs, sources, lengths = (batch.column(c).to_pylist() for c in range(1, 5))
            if not texts:
                continue
            content = np.array([text_view(t) for t in texts])
            meta = np.array([metadata_view(*row) for row in zip(langs, sources, lengths)])
            found = sent.value.probability((content, meta))
            columns = [batch.column(c) for c in range(5, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(f) for f in found], names=names)

    names = [f"kept_{k}" for k in range(len(extra))] + ["quality", "content_quality", "metadata_quality"]
    rows = docs.select(*inputs(), *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(extra)))
    kinds = [f"kept_{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(extra)]
    kinds += [f"{name} double" for name in names[len(extra) :]]
    return rows.mapInArrow(run, ", ".join(kinds))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, quality, content_quality, metadata_quality, keep)`` for every row of ``docs``.

    ``docs`` has ``doc_id, text, lang, source, n_chars``, ``labels`` has ``doc_id, quality`` (0 or 1). A null text
    is empty; a null language, source or length is a value of its own. Without labels every row has quality one
    half. Repeated rows score alike; other columns are not looked at; an empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels), "doc_id").withColumnRenamed("kept_0", "doc_id")
    return scored.withColumn("keep", F.col("quality") >= KEEP)


def of_good_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    scored = score(docs, fit(docs, labels), *docs.columns)
    kept = scored.where(F.col("quality") >= KEEP).drop("quality", "content_quality", "metadata_quality")
    return kept.toDF(*docs.columns)
