"""Byte-level BPE: merge ranks in a priority queue over a linked symbol list; decoding joins vocabulary strings."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tallyspark.llm.base import slices, utf8

# How byte-level vocabularies split a text and which characters stand for the bytes that print.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

KNOWN_WORDS = 300_000  # words a task remembers, in each of two generations; more would only save time
KNOWN_LENGTH = 48
CHUNK = 200_000  # words split off at once
LONG_TEXT = 1_000_000


class Tables:
    """Merge ranks and vocabulary of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary = spec["model"]["vocab"]
        added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        others = [b for b in range(256) if b not in set(PRINTED_BYTES)]
        byte_of = {chr(b): b for b in PRINTED_BYTES} | {chr(256 + k): b for k, b in enumerate(others)}
        self.byte_ids = [0] * 256
        for character, byte in byte_of.items():
            self.byte_ids[byte] = vocabulary[character]
        self.ranks, self.merged = {}, []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault(vocabulary[left] << 20 | vocabulary[right], rank)
            self.merged.append(vocabulary[left + right])
        size = max([*vocabulary.values(), *added.values()]) + 1
        self.strings = [b""] * size
        for string, number in vocabulary.items():
            self.strings[number] = bytes(byte_of[c] for c in string)
        for string, number in added.items():
            self.strings[number] = string.encode()
        self.added = {string: pack([number]) for string, number in added.items()}
        longest_first = sorted(map(re.escape, added), key=len, reverse=True)
        self.split_added = re.compile("(" + "|".join(longest_first) + ")") if added else None
        self.known = KnownWords(self)

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply merges in order of rank, then of place, until none is left."""
        count, rank_of, merged = len(symbols), self.ranks.get, self.merged
        following, before = list(range(1, count + 1)), list(range(-1, count - 1))
        queue = []
        for i in range(count - 1):
            rank = rank_of(symbols[i] << 20 | symbols[i + 1])
            if rank is not None:
                queue.append(rank << 32 | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = following[i]
            # stale: a symbol is gone, or its neighbour or itself has changed since this entry was made
            if symbols[i] < 0 or j >= count or rank_of(symbols[i] << 20 | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = merged[rank], -1
            after = following[i] = following[j]
            if after < count:
                before[after] = i
                rank = rank_of(symbols[i] << 20 | symbols[after])
                if rank is not None:
                    heappush(queue, rank << 32 | i)
            if before[i] >= 0:
                rank = rank_of(symbols[before[i]] << 20 | symbols[i])
                if rank is not None:
                    heappush(queue, rank << 32 | before[i])
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        parts = self.split_added.split(text) if self.split_added else [text]
        return b"".join(self.added.get(p) or b"".join(map(self.known.__getitem__, words(p))) for p in parts if p)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids; what is no UTF-8 becomes the replacement character."""
        raw = b"".join(map(self.strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        return raw.decode("utf-8", errors="replace").encode()


class KnownWords(dict):
    """Ids of the words met so far, as bytes; words that were not met for long are forgotten."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables, self.older = tables, {}

    def __missing__(self, word: str) -> bytes:
        tables = self.tables
        ids = self.older.get(word)
        if ids is None:
            ids = pack(tables.merge([tables.byte_ids[b] for b in word.encode()]))
        if len(word) <= KNOWN_LENGTH:
            if len(self) >= KNOWN_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


def pack(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


WORD = regex.compile(WORDS)


def words(text: str):
    if len(text) < LONG_TEXT:
        yield from WORD.findall(text)
        return
    found = WORD.finditer(text)
    while part := [m.group() for m in islice(found, CHUNK)]:
        yield from part


@lru_cache(maxsize=2)
def tables(path: str) -> Tables:
    return Tables(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids binary)`` per row of ``docs(doc_id, text)``: ids as little-endian unsigned 32-bit integers.

    ``path`` is a tokenizer file that every executor can read. A null or empty text has no ids. Rows come back as
    often as they came, whatever their doc_id; texts of any length are taken whole, in one pass without a shuffle.
    Added tokens of the file are single ids where their strings stand in a text.
    """

    def run(batches):
        of = tables(path)
        for batch in slices(batches):
            ids = [of.encode(t.decode("utf-8", errors="replace")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, text binary)``: the UTF-8 text of ``coded(doc_id, ids)``, null ids as no ids."""

    def run(batches):
        of = tables(path)
        for batch in slices(batches):
            texts = [of.decode(i or b"") for i in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, n_tokens, ids_sha256, decoded_sha256)``: documents encoded, then decoded from their ids.

    Both steps are one pass, so a core holds one set of tables. Rows are treated as in ``encode``.
    """

    def run(batches):
        of = tables(path)
        for batch in slices(batches):
            ids = [of.encode(t.decode("utf-8", errors="replace")) for t in batch.column(1).to_pylist()]
            texts = [of.decode(i) for i in ids]
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, text binary").select(
        "doc_id",
        "ids",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
