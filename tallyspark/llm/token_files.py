"""Token ids in files: an adaptive context-mixing range coder over independent, checksummed blocks."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from functools import lru_cache
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyspark.llm.base import utf8
from tallyspark.llm.bpe import PRINTED_BYTES
from tallyspark.session import new_folder

BLOCK_IDS = 1 << 21
LANE_IDS = 512  # about so many ids of a block are coded one after another, the rest of it side by side
MAGIC = b"TID2"
SLOTS = 18  # bits of the hashed table of order 2
WEIGHT = 8  # bits of the weights
FLOOR, EDGE, WORD = np.uint64(1 << 40), np.uint64(1 << 48), np.uint64(16)

KNOWN_PIECES = 1_300_000  # pieces of texts that a task remembers; more would only save time
KNOWN_LENGTH = 48
POOL_IDS = 8_000_000
SLICE_ROWS, SLICE_BYTES = 4_096, 12_000_000
# Kinds of bytes: 1 to 3 letters, digits and marks of ASCII, 4 the apostrophe, 5 space, 6 line feed, 7 the first byte of
# U+00C0 to U+024F, 0 all others.
KINDS = np.zeros(256, np.uint8)
KINDS[33:127], KINDS[48:58], KINDS[65:91], KINDS[97:123] = 3, 2, 1, 1
KINDS[39], KINDS[32], KINDS[10], KINDS[0xC3:0xCA] = 4, 5, 6, 7
# A piece that is one word of a byte-level tokenizer.
WORD_PIECE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+)")


class Mixer:
    """Mixed predictions of the next id, for all lanes of a block, from an empty start.

    Order 2 and order 1 give all their mass to the id that last followed a context, with a confidence of 0 to 3. Order
    0 has a share for every id, by the ids counted so far. The three are added up, and the sum is what is coded:
    ``P = w2 P2 + w1 P1 + w0 P0``. There are weights for every pair of confidences, learnt from the part that each order
    had in the mass of the ids that came. Lanes share the model of their block; it learns after every step of the lanes.
    """

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary, self.bits = vocabulary, max(vocabulary - 1, 1).bit_length() + 4
        self.total = self.bits + WEIGHT  # bits of the whole mass
        self.kind = np.int32 if self.total < 31 else np.int64
        self.sign = np.dtype(self.kind).itemsize * 8 - 1
        self.followers = [np.zeros(1 << SLOTS, self.kind), np.zeros(vocabulary + 1, self.kind)]  # id * 4 + trust
        self.last, self.before = np.full(lanes, vocabulary), np.full(lanes, vocabulary)
        self.parts = np.array([[4.0, 2.0, 2.0]] * 16)
        self.parts[:4, 0] = 0  # order 2 knows nothing
        self.parts[::4, 1] = 0  # order 1 knows nothing, or the same as order 2
        self.possible = self.parts > 0
        self.counts = np.zeros(vocabulary, np.int64)
        self.weigh()
        self.count(np.empty(0, np.int64))

    def weigh(self) -> None:
        sums = self.parts.sum(axis=1, keepdims=True)
        spare = (1 << WEIGHT) - self.possible.sum(axis=1, keepdims=True)
        weights = (self.possible + np.floor(self.parts * spare / sums)).astype(np.int32)
        # both in one number: the third weight is what is left
        self.weights = weights[:, 0] << 16 | weights[:, 1]

    def count(self, ids) -> None:
        """Order 0 learns ``ids``; every id keeps a share."""
        self.counts += np.bincount(ids, minlength=self.vocabulary)
        sum_, room = int(self.counts.sum()), (1 << self.bits) - self.vocabulary
        size = 1 + (self.counts * room // sum_ if sum_ else np.full(self.vocabulary, room // self.vocabulary))
        size[self.counts.argmax()] += (1 << self.bits) - size.sum()
        ends = np.cumsum(size)
        self.ends, self.shares = ends, (ends - size) << 32 | size  # where the share of an id begins, and its size
        # the id at every 16th place
        cells = np.diff(ends + 15 >> 4, prepend=0)
        self.cells = np.repeat(np.arange(self.vocabulary, dtype=np.int32), cells)

    def share(self, ids):
        both = self.shares.take(ids)
        return (both >> 32).astype(self.kind), both.astype(np.int32).astype(self.kind, copy=False)

    def look(self, n: int) -> None:
        """What the orders predict in the first ``n`` lanes."""
        last = self.last[:n]
        slot = last * 0x2545F491
        slot += self.before[:n] * 0x9E3779B1
        slot >>= 7
        slot &= (1 << SLOTS) - 1
        self.places = slot, last
        two, one = self.entries = self.followers[0].take(slot), self.followers[1].take(last)
        self.ids, self.trusts = (two >> 2, one >> 2), (two & 3, one & 3)
        self.pair = self.trusts[0] * 4
        self.pair += np.where((self.ids[0] == self.ids[1]) & (self.trusts[0] > 0), 0, self.trusts[1])
        both = self.weights.take(self.pair).astype(self.kind, copy=False)
        w2, w1 = both >> 16, both & 0xFFFF
        self.now = w2 << self.bits, w1 << self.bits, (1 << WEIGHT) - w2 - w1

    def mass(self, ids):
        """Where the mass of an id begins in each lane, and how much it is."""
        w2, w1, w0 = self.now
        start, self.got = self.share(ids)
        start *= w0
        self.got *= w0
        self.hits, narrow = [], ids.astype(self.kind)
        for follower, weight in zip(self.ids, (w2, w1)):
            apart = follower - narrow
            start += (apart >> self.sign) & weight  # all bits are set if the follower comes before
            hit = ~((apart | -apart) >> self.sign)  # all bits are set if it is the id
            self.got += hit & weight
            self.hits.append(hit)
        return start, self.got

    def find(self, point):
        """The id of each lane whose mass holds ``point``."""
        (a, b), (w2, w1, w0) = self.ids, self.now
        apart = a - b
        rest = point.copy()
        spans = []
        for follower, weight, other in ((a, w2, (-apart >> self.sign) & w1), (b, w1, (apart >> self.sign) & w2)):
            start, size = self.share(follower)
            start *= w0
            start += other
            size *= w0
            size += weight
            after = point - start
            past = after - size  # below zero before the end
            rest -= ~(past >> self.sign) & weight
            spans.append(~after & past < 0)
        # exact: both are below 2 to the 53rd by far. Where a follower comes it is not looked at
        place = (rest / w0).astype(np.int64)
        ids = self.cells.take(place >> 4, mode="clip")
        late = np.flatnonzero(self.ends.take(ids) <= place)
        late = late[~(spans[0] | spans[1]).take(late)]
        while len(late):
            ids[late] += 1
            late = late[self.ends.take(ids.take(late)) <= place.take(late)]
        ids = np.where(spans[0], a, np.where(spans[1], b, ids))
        return ids.astype(np.int64)

    def learn(self, ids, step: int) -> None:
        n, entry = len(ids), (ids * 4).astype(self.kind)
        for k in range(2):
            hit, trust = self.hits[k], self.trusts[k]
            new = np.maximum(np.minimum(trust + 1, 3) & hit, 1)
            new += entry
            # an id that was trusted stays after a miss
            self.followers[k][self.places[k]] = np.where(trust & ~hit > 1, self.entries[k] - 1, new)
        if step < 32 or step % 16 == 0:
            rest = np.bincount(self.pair, minlength=16) * 256.0
            for k in range(2):
                of = np.flatnonzero(self.hits[k] & self.now[k])
                # whole numbers below 2 to the 53rd: sums do not depend on their order
                part = self.now[k].take(of).astype(np.int64) * 256 // self.got.take(of)
                part = np.bincount(self.pair.take(of), part, minlength=16)
                self.parts[:, k] += part
                rest -= part
            self.parts[:, 2] += rest
            self.weigh()
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


class Coder:
    """A carry-less range coder for many lanes, in words of 16 bits; with ``words`` it decodes."""

    def __init__(self, lanes: int, words: np.ndarray | None = None, at: np.ndarray | None = None):
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 2**64 - 1, np.uint64)
        self.words, self.at, self.out = words, at, []
        if words is not None:
            self.left = np.zeros(lanes, np.uint64)  # how far the code lies above low
            for _ in range(4):
                self._move(np.arange(lanes), self.low)

    def _move(self, lane, low) -> None:
        if self.words is None:
            self.out.append((lane.astype(np.uint32), (low >> np.uint64(48)).astype("<u2")))
            return
        at = self.at.take(lane)
        self.left[lane] = self.left.take(lane) << WORD | self.words.take(at, mode="clip")
        self.at[lane] = at + 1

    def point(self, n: int, bits: int):
        found = self.left[:n] // (self.range[:n] >> np.uint64(bits))
        return np.minimum(found, np.uint64((1 << bits) - 1))

    def narrow(self, start, size, bits: int) -> None:
        n = len(start)
        low, width = self.low[:n], self.range[:n]
        width >>= np.uint64(bits)
        skipped = start.astype(np.uint64) * width
        low += skipped
        if self.words is not None:
            self.left[:n] -= skipped
        width *= size.astype(np.uint64)
        lane = np.flatnonzero(width < FLOOR)
        while len(lane):
            some = low.take(lane)
            # the bits that leave are the same for the whole range, which is cut where they would not be
            rest = np.minimum(width.take(lane), EDGE - (some & (EDGE - np.uint64(1)))) << WORD
            self._move(lane, some)
            low[lane], width[lane] = some << WORD, rest
            lane = lane[rest < FLOOR]

    def close(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of all lanes, lane by lane, and how many each has."""
        lanes = np.arange(len(self.low))
        ends = self.low + np.uint64(2**32 - 1)
        for _ in range(2):
            self._move(lanes, ends)
            ends = ends << WORD
        lane, words = (np.concatenate(c) for c in zip(*self.out))
        return words[np.argsort(lane, kind="stable")], np.bincount(lane, minlength=len(self.low))


def shape(n: int) -> tuple[int, int]:
    """Lanes of a block of ``n`` ids and the ids of each; the last lane may have fewer."""
    steps = -(-n // max(1, n // LANE_IDS))
    return -(-n // steps), steps


def learns_at(step: int) -> bool:
    """Whether order 0 learns before this step: at first often, then twice while the steps double."""
    return step > 0 and step % (1 << max(0, step.bit_length() - 2)) == 0


def compress(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """A payload for every block of ids below ``vocabulary``; each starts from an empty model."""
    return [_compress(np.asarray(ids, np.int64), vocabulary) for ids in blocks]


def _compress(ids: np.ndarray, vocabulary: int) -> bytes:
    if not len(ids):
        return b""
    lanes, steps = shape(len(ids))
    rows = np.zeros(lanes * steps, np.int64)
    rows[: len(ids)] = ids
    rows = np.ascontiguousarray(rows.reshape(lanes, steps).T)
    full = len(ids) - (lanes - 1) * steps  # steps of the last lane
    mixer, coder, learnt = Mixer(lanes, vocabulary), Coder(lanes), 0
    for t in range(steps):
        if learns_at(t):
            mixer.count(_seen(rows, learnt, t, full))
            learnt = t
        now = rows[t] if t < full else rows[t, :-1]
        mixer.look(len(now))
        coder.narrow(*mixer.mass(now), mixer.total)
        mixer.learn(now, t)
    words, sizes = coder.close()
    return sizes.astype("<u2").tobytes() + words.tobytes()


def _seen(rows: np.ndarray, first: int, end: int, full: int) -> np.ndarray:
    """The ids of steps ``first`` to ``end``, without the places after the end of the last lane."""
    if end <= full:
        return rows[first:end].ravel()
    return np.concatenate([rows[first:end, :-1].ravel(), rows[first : max(first, full), -1]])


def expand(payloads: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of every payload, the way ``compress`` took them."""
    return [_expand(p, n, vocabulary) for p, n in zip(payloads, lengths)]


def _expand(payload: bytes, n: int, vocabulary: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.int64)
    lanes, steps = shape(n)
    if len(payload) < 6 * lanes or len(payload) % 2:
        raise ValueError("a block of token ids is damaged")
    sizes = np.frombuffer(payload, "<u2", lanes).astype(np.int64)
    words = np.frombuffer(payload, "<u2", offset=2 * lanes).astype(np.uint64)
    rows = np.zeros((steps, lanes), np.int64)
    full = n - (lanes - 1) * steps
    mixer, coder, learnt = Mixer(lanes, vocabulary), Coder(lanes, words, np.cumsum(sizes) - sizes), 0
    for t in range(steps):
        if learns_at(t):
            mixer.count(_seen(rows, learnt, t, full))
            learnt = t
        lane = lanes if t < full else lanes - 1
        mixer.look(lane)
        now = mixer.find(coder.point(lane, mixer.total).astype(mixer.kind))
        coder.narrow(*mixer.mass(now), mixer.total)
        mixer.learn(now, t)
        rows[t, :lane] = now
    return rows.T.ravel()[:n]


def seal(ids: np.ndarray, payload: bytes, vocabulary: int) -> bytes:
    """Magic, vocabulary size, number of ids, checksum of the ids, payload."""
    return MAGIC + struct.pack("<III", vocabulary, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) + payload


def unseal(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of blocks; a block that is damaged or no block is an error."""
    if not blocks:
        return []
    heads = []
    for block in blocks:
        if block[:4] != MAGIC or len(block) < 16:
            raise ValueError("not a block of token ids")
        heads.append(struct.unpack("<III", block[4:16]))
    found: list = [None] * len(blocks)
    for vocabulary in {h[0] for h in heads}:
        places = [k for k, h in enumerate(heads) if h[0] == vocabulary]
        ids = expand([blocks[k][16:] for k in places], [heads[k][1] for k in places], vocabulary)
        for k, row in zip(places, ids):
            if zlib.crc32(row.astype("<u4").tobytes()) != heads[k][2]:
                raise ValueError("a block of token ids is damaged")
            found[k] = row
    return found


class Encoder:
    """Ids of whole texts by the tokenizers library, which is asked once for each piece that comes again and again.

    Only a byte-level tokenizer that takes texts as they are is asked for pieces, and only for texts without its added
    tokens; others get whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model, self.vocabulary = self.library.model, self.library.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec["pre_tokenizer"] or {}
        self.cut = (
            not any(spec.get(part) for part in ("normalizer", "truncation", "padding"))
            and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
        )
        self.added = [token["content"] for token in spec["added_tokens"]]
        others = (b for b in range(256) if b not in set(PRINTED_BYTES))
        printed = {b: chr(b) for b in PRINTED_BYTES} | {b: chr(256 + k) for k, b in enumerate(others)}
        self.printed = {c: "".join(printed[b] for b in chr(c).encode()) for c in [32, *range(0xC0, 0x250)]}
        self.forget()

    def forget(self) -> None:
        self.known, self.end = {}, 0  # the number of each piece; its ids lie in the pool
        self.pool, self.starts, self.sizes = np.empty(1 << 16, np.int32), array("q"), array("q")

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of every text of a ``large_string`` array without nulls."""
        if not self.cut:
            return [np.array(ids, np.int32) for ids in self.whole(texts.to_pylist())]
        if len(self.known) > KNOWN_PIECES or self.end > POOL_IDS:
            self.forget()
        texts = pa.concat_arrays([texts, pa.array([], texts.type)])  # begins at the first byte
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64, len(texts) + 1) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8, int(ends[-1])) if ends[-1] else np.empty(0, np.uint8)
        begins = self.begins(raw)
        for token in self.added:
            for k in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                begins[ends[k] : ends[k + 1]] = False
        begins[ends[:-1][ends[:-1] < len(raw)]] = True
        cuts = np.append(np.flatnonzero(begins), len(raw))
        words = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw))
        coded = words.dictionary_encode()
        starts, sizes = self.places(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        sizes = sizes[codes]
        last = np.cumsum(sizes)
        at = np.repeat(starts[codes] - (last - sizes), sizes)
        at += np.arange(len(at))
        ids = self.pool.take(at)
        bounds = np.concatenate([[0], last])[np.searchsorted(cuts, ends[1:])]
        return np.split(ids, bounds[:-1]) if len(texts) else []

    @staticmethod
    def begins(raw: np.ndarray) -> np.ndarray:
        """Where a word of the tokenizer is sure to begin: pieces from there on have the ids that they have in the text.

        That is at a space before anything but white space, where letters, digits and marks meet (but not after an
        apostrophe, which may begin a word with the letters after it), and around a lone line feed.
        """
        kinds = KINDS[raw]
        out = np.zeros(len(raw), bool)
        if len(raw) < 3:
            return out
        seen = (kinds > 0) & (kinds != 5) & (kinds != 6)  # no white space
        out[:-1] |= (kinds[:-1] == 5) & seen[1:]
        before, now = kinds[:-1], kinds[1:]
        out[1:] |= (before != now) & (before > 0) & (before < 4) & (now > 0) & (now < 5) & ~((before == 3) & (now == 4))
        lone = (kinds[1:-1] == 6) & seen[2:] & (kinds[:-2] > 0) & (kinds[:-2] < 5)
        out[1:-1] |= lone
        out[2:] |= lone
        return out

    def places(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of pieces lie in the pool, and how many there are."""
        found = np.array([*map(self.known.get, pieces, repeat(-1))], np.int64)
        new = [pieces[k] for k in np.flatnonzero(found < 0).tolist()]
        plain, other = [], []
        for piece in new:
            (plain if WORD_PIECE.fullmatch(piece) else other).append(piece)
        ids = [*map(self.word, plain)]
        ids += [np.array(i, np.int32).tobytes() for i in self.whole(other)]
        numbers = dict(zip([*plain, *other], range(len(self.starts), len(self.starts) + len(new))))
        found[found < 0] = [*map(numbers.get, new)]
        self.known.update((p, n) for p, n in numbers.items() if len(p) <= KNOWN_LENGTH)
        sizes = np.array([*map(len, ids)], np.int64) // 4
        self.starts.frombytes((self.end + np.cumsum(sizes) - sizes).tobytes())
        self.sizes.frombytes(sizes.tobytes())
        self.end += int(sizes.sum())
        if self.end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(self.end, len(self.pool)), np.int32)])
        if ids:
            fresh = np.frombuffer(b"".join(ids), np.int32)
            self.pool[self.end - len(fresh) : self.end] = fresh
        # copies, as an array that is looked at can't grow
        return np.array(self.starts).take(found), np.array(self.sizes).take(found)

    def word(self, word: str) -> bytes:
        # the vocabulary has a character for each byte
        printed = word.replace(" ", self.printed[32]) if word.isascii() else word.translate(self.printed)
        tokens = self.model.tokenize(printed)
        return array("i", [token.id for token in tokens]).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def text_slices(batches):
    """``(doc_ids, texts)`` of parts of Arrow batches with columns doc_id and text, the latter as UTF-8 bytes."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
        first = 0
        while first < batch.num_rows:
            limit = (ends[first - 1] if first else 0) + SLICE_BYTES
            rows = min(max(1, int(np.searchsorted(ends, limit)) - first), SLICE_ROWS)
            doc_ids, texts = (batch.column(k).slice(first, rows) for k in range(2))
            first += rows
            try:
                texts = texts.cast(pa.large_binary()).cast(pa.large_string())
            except pa.ArrowInvalid:  # bytes that are no UTF-8
                texts = pa.array([t.decode("utf-8", errors="replace") for t in texts.to_pylist()], pa.large_string())
            yield doc_ids.to_pylist(), texts


def write_tokens(docs: DataFrame, path: str, folder: str, end_id: int = 0) -> None:
    """Encode ``docs(doc_id, text)`` with the tokenizer at ``path`` and write the ids to ``folder``.

    Documents are dealt by ranges of doc_id and lie in ascending order over the files, null ids first, equal ids by
    text. ``end_id`` follows every document. A file holds blocks of 2,097,152 ids, the last may be shorter, each with
    the documents that lie in it: ``first`` is the number of its first document in the file, ``doc_ids`` and
    ``sizes`` say how many of the block's ids belong to which document.
    """

    def run(batches):
        part = TaskContext.get().partitionId()
        of = encoder(path)
        waiting, held = [], 0  # (doc number, doc_id, ids)
        number, block = 0, 0

        def sealed(last: bool):
            nonlocal waiting, held, block
            at = 0
            while held >= BLOCK_IDS or (last and held):
                taken, room = [], BLOCK_IDS
                while at < len(waiting) and room:
                    n, doc_id, ids = waiting[at]
                    taken.append((n, doc_id, ids[:room]))
                    if len(ids) > room:
                        waiting[at] = (n, doc_id, ids[room:])
                    else:
                        at += 1
                    room -= len(taken[-1][2])
                held -= BLOCK_IDS - room
                ids = np.concatenate([t[2] for t in taken])
                columns = [
                    pa.array([part], pa.int64()),
                    pa.array([block], pa.int64()),
                    pa.array([taken[0][0]], pa.int64()),
                    pa.array([[t[1] for t in taken]], pa.list_(pa.int64())),
                    pa.array([[len(t[2]) for t in taken]], pa.list_(pa.int64())),
                    pa.array([seal(ids, compress([ids], of.vocabulary)[0], of.vocabulary)], pa.binary()),
                ]
                names = ["part", "block", "first", "doc_ids", "sizes", "data"]
                block += 1
                yield pa.RecordBatch.from_arrays(columns, names=names)
            waiting = waiting[at:]

        for doc_ids, texts in text_slices(batches):
            for doc_id, ids in zip(doc_ids, of.encode(texts)):
                waiting.append((number, doc_id, np.append(ids, np.int32(end_id))))
                number, held = number + 1, held + len(ids) + 1
            yield from sealed(False)
        yield from sealed(True)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    kind = "part long, block long, first long, doc_ids array<long>, sizes array<long>, data binary"
    ordered.mapInArrow(run, kind).write.parquet(folder)


def read_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """``(part, number, block, doc_id, n, crc)``: for each block, the documents in it, from its decoded ids."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, block, start, doc_ids, sizes, data = (batch.column(k)[row].as_py() for k in range(6))
                ids = unseal([data])[0]
                if sum(sizes) != len(ids):
                    raise ValueError("a block does not hold the ids of its documents")
                raw, ends = memoryview(ids.astype("<u4").tobytes()), list(accumulate(sizes, initial=0))
                columns = [
                    pa.array([part] * len(sizes), pa.int64()),
                    pa.array(range(start, start + len(sizes)), pa.int64()),
                    pa.array([block] * len(sizes), pa.int64()),
                    pa.array(doc_ids, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "block", "doc_id", "n", "crc"])

    kind = "part long, number long, block long, doc_id long, n long, crc long"
    return spark.read.parquet(folder).select("part", "block", "first", "doc_ids", "sizes", "data").mapInArrow(run, kind)


def joined_crc(pieces: list[tuple[int, int]]) -> int:
    """The checksum of bytes from the checksums and lengths of their pieces, in order."""
    whole = 0
    for crc, size in pieces:
        zeros = bytes(size)
        # a checksum is linear: what the bytes before do to it does not depend on the bytes that follow
        whole = zlib.crc32(zeros, whole) ^ zlib.crc32(zeros) ^ crc
    return whole


def token_index(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files that are written and read back.

    A null or empty text is its end id alone. Repeated rows are documents of their own. An empty table gives no
    rows. ``start`` counts the ids of all documents before, in ascending order of doc_id.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "tokens")
    write_tokens(docs, path, folder)

    def whole(batches):
        for batch in batches:
            crcs = [joined_crc([(p["crc"], 4 * p["n"]) for p in pieces]) for pieces in batch.column("pieces").to_pylist()]
            yield batch.drop_columns(["pieces"]).append_column("ids_crc32", pa.array(crcs, pa.int64()))

    # a document has a piece for each block of 2,097,152 ids
    pieces = read_pieces(spark, folder).groupBy("part", "number")
    pieces = pieces.agg(
        F.min("doc_id").alias("doc_id"),
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("pieces"),
    )
    found = pieces.mapInArrow(whole, "part long, number long, doc_id long, n_tokens long, ids_crc32 long")
    sizes = found.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("offset"))
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("n_tokens").over(before), F.lit(0))
    placed = found.withColumn("within", within).join(offsets, "part")
    return placed.select("doc_id", (F.col("within") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
