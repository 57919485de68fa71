"""Toxicity categories by a chain of linear models, trained with out-of-fold predictions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.base import slices, utf8
from tallyspark.llm.linear import Logistic, logit
from tallyspark.session import stored

# The chain is fitted on a sample of about so many labelled rows, chosen by a hash of doc_id; see ``labelled_terms``.
LABELLED_ROWS = 15_000
FOLDS = 5
LEAST_SUPPORT = 4  # labelled documents that must hold a term, two of them of a category
TERMS = 4_000  # of a category, with the largest log odds, that the models look up
TOP = 5  # largest log odds of a document that are features of their own
TOXIC = 0.5
SCALE = 1 << 53

NOT_LETTERS = bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 128))
LETTERS = bytes.maketrans(NOT_LETTERS, b" " * len(NOT_LETTERS))


def terms(text: bytes) -> set[bytes]:
    """The distinct lower-cased words of letters."""
    return set(text.translate(LETTERS).lower().split())


def labelled_terms(docs: DataFrame, labels: DataFrame, categories: list[str]) -> DataFrame:
    """``(doc_id, terms, categories...)`` of the sampled labelled documents.

    A row is in the sample if its hashed doc_id is below a share that follows from the number of labels, so a
    document comes with all its repeats and no ordering is needed. A document with several labels has a category
    if the mean of them is a half or more.
    """
    whole = [F.avg(c).alias(c) for c in categories]
    wanted = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*whole)
    wanted = wanted.dropna(subset=categories)
    wanted = stored(wanted.select("doc_id", *((F.col(c) >= 0.5).cast("int").alias(c) for c in categories)), "labels")
    share = min(1.0, LABELLED_ROWS / max(1, wanted.count()))
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("chain")), F.lit(SCALE)) / float(SCALE) < share
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    rows = texts.where(chosen).join(wanted.where(chosen), "doc_id")

    def run(batches):
        for batch in slices(batches):
            found = pa.array([sorted(terms(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))
            others = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *others], names=names)

    names = ["doc_id", "terms", *categories]
    kinds = ", ".join(f"`{c}` int" for c in categories)
    return rows.mapInArrow(run, f"doc_id long, terms array<binary>, {kinds}").dropDuplicates(["doc_id"])


class Lexicon:
    """Log odds of a category by term, from documents that hold the term."""

    def __init__(self, odds: dict[bytes, float]):
        self.odds, self.terms = odds, frozenset(odds)

    @classmethod
    def of(cls, names: np.ndarray, with_term: np.ndarray, without: np.ndarray, n_with: int, n_without: int) -> Lexicon:
        """``with_term`` and ``without``: documents that hold the term, among those with and without the category."""
        odds = np.log((with_term + 0.5) / (n_with + 1)) - np.log((without + 0.5) / (n_without + 1))
        # a term of few documents says little: its log odds shrink with their expected number
        odds *= (with_term + without) / (with_term + without + 2 * LEAST_SUPPORT)
        best = np.lexsort((names, -odds))[:TERMS]
        return cls({names[k]: float(odds[k]) for k in best if odds[k] > 0})

    def features(self, found: set[bytes]) -> list[float]:
        odds = sorted((self.odds[t] for t in found & self.terms), reverse=True)
        top = (odds + [0.0] * TOP)[:TOP]
        return [*top, sum(o for o in odds if o > 1), sum(odds) / max(1, len(found)), float(np.log1p(len(found)))]


class Chain:
    """A lexicon and a linear model per category; each model also sees the log odds of the categories before."""

    def __init__(self, categories: list[str]):
        self.categories, self.lexicons, self.models = categories, [], []

    def probabilities(self, documents: list[set[bytes]]) -> np.ndarray:
        """A column per category, in order."""
        out = np.zeros((len(documents), len(self.categories)))
        for k, (lexicon, model) in enumerate(zip(self.lexicons, self.models)):
            own = np.array([lexicon.features(d) for d in documents]).reshape(len(documents), -1)
            out[:, k] = model.probability(np.hstack([own, logit(out[:, :k])]))
        return out


def fit(docs: DataFrame, labels: DataFrame, categories: list[str]) -> Chain:
    """Fit a chain over 0/1 columns of ``labels(doc_id, ...)``.

    Term counts by fold and category are a grouped aggregation. A model of a category learns from features of
    lexicons that have not seen the row's fold, and from predictions of the earlier categories that have not
    either, so at use the chain meets inputs as good as those it was trained on.
    """
    rows = stored(labelled_terms(docs, labels, categories), "labelled")
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")
    sums = [F.sum(c).alias(c) for c in categories]
    counted = (
        rows.select(F.explode("terms").alias("term"), fold, *categories)
        .groupBy("term", "fold")
        .agg(F.count("*").alias("n"), *sums)
    )
    counted = stored(counted, "terms")
    # a term of no category has no positive log odds
    common = counted.groupBy("term").agg(F.sum("n").alias("n"), *sums)
    most = F.greatest(F.lit(0), *categories, F.lit(0))
    common = common.where((F.col("n") >= LEAST_SUPPORT) & (most >= 2)).select("term")
    counts = counted.join(common, "term").toPandas()  # terms of the sample, bounded by its rows
    names, row = np.unique(np.array(counts["term"].tolist(), dtype=object), return_inverse=True)
    tables = np.zeros((FOLDS, len(names), len(categories) + 1))
    if len(names):
        tables[counts["fold"].to_numpy(np.int64), row] = counts[["n", *categories]].to_numpy(np.float64)
    totals = np.zeros((FOLDS, len(categories) + 1))
    for found in rows.groupBy(fold).agg(F.count("*").alias("n"), *sums).collect():
        totals[found["fold"]] = [found[c] for c in ["n", *categories]]

    def lexicon(k: int, left_out: int | None) -> Lexicon:
        kept = [f for f in range(FOLDS) if f != left_out]
        table, total = tables[kept].sum(axis=0), totals[kept].sum(axis=0)
        return Lexicon.of(names, table[:, k + 1], table[:, 0] - table[:, k + 1], total[k + 1], total[0] - total[k + 1])

    # the features of a row come from the lexicons that have not seen its fold
    sent = rows.sparkSession.sparkContext.broadcast(
        [[lexicon(k, f) for k in range(len(categories))] for f in range(FOLDS)]
    )

    def features(batches):
        for batch in slices(batches):
            found = []
            for terms_of_row, f in zip(batch.column("terms").to_pylist(), batch.column("fold").to_pylist()):
                held = set(terms_of_row)
                found.append([x for one in sent.value[f] for x in one.features(held)])
            batch = batch.drop_columns(["terms"])
            yield batch.append_column("features", pa.array(found, pa.list_(pa.float64())))

    kinds = ", ".join(f"`{c}` int" for c in categories)
    seen = rows.select("doc_id", fold, "terms", *categories)
    seen = seen.mapInArrow(features, f"doc_id long, fold long, {kinds}, features array<double>")
    seen = seen.orderBy("doc_id").toPandas()
    place = seen["fold"].to_numpy(np.int64)
    y = seen[categories].to_numpy(np.int64).reshape(len(seen), len(categories))
    own = np.array(seen["features"].tolist()).reshape(len(seen), len(categories), TOP + 3)
    chain = Chain(categories)
    before = np.zeros((len(seen), 0))
    for k in range(len(categories)):
        x = np.hstack([own[:, k], before])
        held = np.zeros(len(seen))
        for f in range(FOLDS):
            test = place == f
            held[test] = Logistic().fit(x[~test], y[~test, k]).probability(x[test])
        before = np.hstack([before, logit(held)[:, None]])
        chain.lexicons.append(lexicon(k, None))
        chain.models.append(Logistic().fit(x, y[:, k]))
    return chain


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id`` and one probability per category, for every row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches):
        for batch in slices(batches):
            found = sent.value.probabilities([terms(t) for t in batch.column(1).to_pylist()])
            columns = [pa.array(np.ascontiguousarray(found[:, k])) for k in range(found.shape[1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *chain.categories])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"`{c}` double" for c in chain.categories))


def categories_of(labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic, toxic_prose, toxic_junk)``: toxicity, and whether it stands in good or in poor text."""
    toxic = F.col("toxic") == 1
    kinds = {"toxic": toxic, "toxic_prose": toxic & (F.col("quality") == 1), "toxic_junk": toxic & (F.col("quality") == 0)}
    return labels.where("toxic IS NOT NULL").select(
        "doc_id", *(F.coalesce(kind, F.lit(False)).cast("int").alias(name) for name, kind in kinds.items())
    )


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, toxic, toxic_prose, toxic_junk, is_toxic)`` for every row of ``docs(doc_id, text)``.

    ``labels(doc_id, quality, toxic)`` hold 0 or 1; a null toxicity takes no part, a null quality is in neither
    kind. The three probabilities are a chain in this order; ``is_toxic`` says that the first is a half or more. A
    null, empty or wordless text has the features of no words. Without labels every probability is one half.
    Repeated rows score alike; a null doc_id is scored too; other columns are not looked at; an empty table gives
    no rows.
    """
    categories = ["toxic", "toxic_prose", "toxic_junk"]
    scored = score(docs, fit(docs, categories_of(labels), categories))
    return scored.withColumn("is_toxic", F.col("toxic") >= TOXIC)
