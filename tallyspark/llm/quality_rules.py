"""Quality rules: counts of words, symbols and repeats, and distances of histograms to those of the language."""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.llm.base import slices, utf8
from tallyspark.llm.langid import LANGUAGE_CODES, UNKNOWN
from tallyspark.session import stored

LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
SYMBOLS = b"#*$%&|<>"
STOPS = b".,;:!?"
TRIMMED = b".,;:!?\"'()"
LINE_BREAKS = range(0x09, 0x0E)

COMMON = 100  # words of a language's histogram, besides one bin for all others
LONGEST_COMMON = 64  # bytes of a word that can be a common one
LEAST_REFERENCE = 1000  # words of a language from which on it is a reference
LEAST_CHARS = 200  # code points of a text from which on its characters are compared
#: A text of n words is let through up to the base distance and a share of 1 / sqrt(n): short texts scatter more.
CLASS_BASE, CLASS_SCATTER = 0.30, 1.0
WORD_BASE, WORD_SCATTER = 0.40, 1.2
HELD = 200_000  # words that a task counts before it passes their counts on

CLASSES = 11
CONTINUATION = CLASSES


def byte_classes() -> np.ndarray:
    """The class of a character by its first byte: small, capital, digit, blank, line break, stop, symbol, other
    ASCII, U+0080 to U+027F, to U+07FF, above; the other bytes of a character are no class."""
    table = np.full(256, 10, dtype=np.uint8)
    table[:0x80] = 7
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    table[ord("0") : ord("9") + 1] = 2
    table[0x20] = 3
    table[list(LINE_BREAKS)] = 4
    table[list(STOPS)] = 5
    table[list(SYMBOLS)] = 6
    table[0x80:0xC0] = CONTINUATION
    table[0xC0:0xCA] = 8
    table[0xCA:0xE0] = 9
    return table


BYTE_CLASSES = byte_classes()
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def class_counts(codes: np.ndarray) -> np.ndarray:
    return np.bincount(BYTE_CLASSES[codes], minlength=CLASSES + 1)[:CLASSES]


def common_form(word: bytes) -> bytes:
    """A word as it counts for the histograms: A to Z as small letters, without marks around it."""
    return word.lower().strip(TRIMMED)


class Measured(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    classes: np.ndarray
    words: list[tuple[bytes, int]]  # distinct words and how often they occur


def measure(text: bytes) -> Measured:
    """The counts of a whole UTF-8 text."""
    codes = np.frombuffer(text, dtype=np.uint8)
    classes = class_counts(codes)
    places: dict[bytes, int] = {}
    ids = np.fromiter((places.setdefault(w, len(places)) for w in text.split()), dtype=np.int64)
    return Measured(
        len(ids),
        int(classes.sum() - classes[3] - classes[4]),
        int(np.count_nonzero(IS_SYMBOL[codes])),
        duplicate_lines(text),
        repeated_words(ids, len(places)),
        classes,
        list(zip(places, np.bincount(ids, minlength=len(places)).tolist())),
    )


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside a window of three that stands in the text twice or more."""
    if len(ids) < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct >= 1 << 21:  # three numbers no longer fit one long
        _, pairs = np.unique(pairs, return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * distinct + ids[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum())


def jensen_shannon(found: np.ndarray, expected: np.ndarray) -> float:
    """The Jensen-Shannon distance of two histograms, 0 to 1."""
    p, q = found / found.sum(), expected / expected.sum()
    middle = (p + q) / 2

    def bits(a):
        some = a > 0
        return float(np.sum(a[some] * np.log2(a[some] / middle[some])))

    return max(0.0, (bits(p) + bits(q)) / 2) ** 0.5


def language(declared: Column) -> Column:
    """A declared language code, or ``und`` for anything else: so there are a few hundred languages at most."""
    return F.when(declared.isin(*sorted(LANGUAGE_CODES)), declared).otherwise(UNKNOWN)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), language(F.col("lang").cast("string")).alias("lang"),
        utf8(F.col("text")).alias("text"),
    )


def language_counts(docs: DataFrame) -> DataFrame:
    """``(lang, word, class, n)``: how often a language has a word, or (word null) characters of a class, or
    (both null) words at all, over all documents."""

    def run(batches):
        counts, classes = Counter(), {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.split()
                classes[lang] = classes.get(lang, 0) + np.append(class_counts(np.frombuffer(text, np.uint8)), len(words))
                for word, n in Counter(words).items():
                    form = common_form(word)
                    if 0 < len(form) <= LONGEST_COMMON:
                        counts[lang, form] += n
            if len(counts) > HELD:
                yield out([(lang, word, None, n) for (lang, word), n in counts.items()])
                counts = Counter()
        rows = [(lang, word, None, n) for (lang, word), n in counts.items()]
        for lang, sums in classes.items():
            rows += [(lang, None, k if k < CLASSES else None, n) for k, n in enumerate(sums.tolist())]
        yield out(rows)

    def out(rows):
        columns, kinds = list(zip(*rows)) or [()] * 4, [pa.string(), pa.binary(), pa.int32(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "word", "class", "n"])

    counted = texts_of(docs).select("lang", "text").mapInArrow(run, "lang string, word binary, class int, n long")
    return counted.groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))


class Reference(NamedTuple):
    classes: np.ndarray
    places: dict[bytes, int]  # bins of the common words
    words: np.ndarray  # counts of the bins; the last one has all other words


def references(docs: DataFrame) -> dict[str, Reference]:
    """The histograms of every language with enough words, counted over all documents.

    The driver gets a hundred words and a few sums for each of at most a few hundred languages.
    """
    counts = stored(language_counts(docs), "language_counts")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    common = counts.where("word IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= COMMON)
    sums: dict[str, dict] = {}
    for row in counts.where("word IS NULL").collect():
        sums.setdefault(row.lang, {})[row["class"]] = row.n
    words: dict[str, list] = {}
    for row in common.orderBy("lang", "rank").select("lang", "word", "n").collect():
        words.setdefault(row.lang, []).append((bytes(row.word), row.n))
    found = {}
    for lang, by_class in sums.items():
        if by_class[None] >= LEAST_REFERENCE:
            listed = words.get(lang, [])
            rest = by_class[None] - sum(n for _, n in listed)
            places = {word: k for k, (word, _) in enumerate(listed)}
            classes = np.array([by_class[k] for k in range(CLASSES)], dtype=float)
            found[lang] = Reference(classes, places, np.array([n for _, n in listed] + [rest], dtype=float))
    return found


def distances(it: Measured, reference: Reference | None) -> tuple[float | None, float | None]:
    """Distances of characters and words to a language's; none where a guard on length says so."""
    if reference is None or it.n_words < LEAST_WORDS:
        return None, None
    bins = np.zeros(len(reference.words))
    for word, n in it.words:
        bins[reference.places.get(common_form(word), -1)] += n
    by_class = jensen_shannon(it.classes, reference.classes) if it.classes.sum() >= LEAST_CHARS else None
    return by_class, jensen_shannon(bins, reference.words)


def judged(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document: ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, class_distance, word_distance, kept)``.

    ``docs`` has ``doc_id``, ``text``, ``lang``; other columns take no part. The base rules ask for ``LEAST_WORDS``
    words and for repeated words up to ``MOST_REPEAT_PERCENT`` per cent. Beyond them a document goes if its characters
    or its words lie too far from all documents of its language. Languages of fewer than ``LEAST_REFERENCE`` words
    and texts below ``LEAST_CHARS`` code points or ``LEAST_WORDS`` words are not compared: a distance is null there.

    A null text is empty, a null or unknown language is ``und``. Rows are judged alone, so repeated rows get the same
    verdict. An empty table gives no rows.
    """
    known = references(docs)
    kind = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, class_distance double, word_distance double, kept boolean"
    )
    names = [part.split()[0] for part in kind.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]

    def run(batches):
        for batch in slices(batches):
            rows = [row(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(3)))]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def row(doc_id, lang, text):
        it = measure(text)
        failed = it.n_words < LEAST_WORDS or 100 * it.n_repeat_words > MOST_REPEAT_PERCENT * it.n_words
        by_class, by_word = distances(it, known.get(lang))
        slack = 1 / max(it.n_words, 1) ** 0.5
        far = (by_class is not None and by_class > CLASS_BASE + CLASS_SCATTER * slack) or (
            by_word is not None and by_word > WORD_BASE + WORD_SCATTER * slack
        )
        return (doc_id, *it[:5], failed, by_class, by_word, not failed and not far)

    return texts_of(docs).mapInArrow(run, kind)
