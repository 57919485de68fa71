"""Whole near-duplicate documents: SimHash and prefix candidates, verified by the Jaccard similarity of shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspark.llm.base import slices, unused, utf8
from tallyspark.llm.components import connected_components
from tallyspark.llm.simhash import bit_counts, linked, majority, shingle_hashes
from tallyspark.session import stored, unsent

WORDS = 5
SIMILARITY = 0.8
PARTS = 16  # parts of the shingles that have a fingerprint of their own
PART_SIZE = 4  # shingles of a part at least, and twice that at most, unless the text is short
SMALL_GROUP = 16  # texts that share a shingle up to which partners are looked for by a join
BLOCK = 512  # texts of larger groups that a task compares with as many others
SAMPLE = 8192  # texts, about, whose shingles tell which ones are common
COMMON = 8  # texts of the sample that a common shingle is in at least
MOST_COMMON = 500_000  # common shingles that are sent to the executors
MARKS = [f"m{i}" for i in range(8)]
NO_ID = -(1 << 63)


def part_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys that two shingle sets of a Jaccard similarity of 0.8 or more mostly share.

    A hash deals the shingles out to parts of four to eight; sixteen parts are fingerprinted. As a rule a part agrees
    only if no shingle of one set alone falls into it, so a few pairs in a hundred near 0.8 share no key; ``joined_up`` finds them. The number
    of parts follows from the band of the set's size, and a set has keys for two bands, so that similar sets share one.
    """
    if not len(shingles):
        return np.empty(0, dtype=np.uint64)
    band = int(math.log(len(shingles)) / -math.log(SIMILARITY) + 1e-9)
    mixed = shingles * np.uint64(0x9E3779B97F4A7C15)
    keys, known = [], {}
    for b in (band, band + 1):
        parts = max(PARTS, 1 << int(math.log2(max(1.0, (1 / SIMILARITY) ** b / PART_SIZE))))
        if parts not in known:
            dealt = (mixed >> np.uint64(33)) % np.uint64(parts)
            chosen = dealt < PARTS
            order = np.argsort(dealt[chosen], kind="stable")
            number, hashes = dealt[chosen][order], shingles[chosen][order]
            kinds, starts, sizes = np.unique(number, return_index=True, return_counts=True)
            if len(kinds):
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
                fps = np.packbits(sums * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
            else:
                fps = np.empty(0, dtype=np.uint64)
            known[parts] = (kinds, fps)
        kinds, fps = known[parts]
        salted = (fps ^ (kinds + np.uint64(b * 1009 + 1)) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(0xBF58476D1CE4E5B9)
        keys.append(salted ^ (salted >> np.uint64(31)))
    return np.concatenate(keys)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order."""
    found = [np.unique(part) for part in shingle_hashes(text, WORDS)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)


def signatures(texts: DataFrame) -> DataFrame:
    """``(id, fp, keys)`` of ``texts(id, text)``: a whole fingerprint and the part keys."""

    def run(batches):
        for batch in slices(batches):
            fps, keys = [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text)
                fps.append(majority(bit_counts(shingles), len(shingles)) if len(shingles) else 0)
                keys.append(part_keys(shingles).view(np.int64) if len(shingles) else np.zeros(1, dtype=np.int64))
            columns = [batch.column(0), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fp", "keys"])

    return texts.mapInArrow(run, "id long, fp long, keys array<long>")


def candidates(signed: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ids that share a part key with a hub or whose whole fingerprints differ in two bits or fewer.

    Every text that has a key is paired with one text only, the hub of that key: the one whose keys are shared most
    often. Texts near the centre of a group share most, so the keys of a group have few hubs and its texts few pairs.
    """
    rows = signed.select("id", F.explode("keys").alias("key"))
    groups = stored(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "groups")
    members = stored(rows.join(groups, "key"), "members")
    shared = stored(members.groupBy("id").agg(F.sum("n").alias("shared")), "sharing")
    ranked = stored(members.select("key", "id").join(shared, "id"), "ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("shared", "id")).alias("hub"))
    hubs = stored(hubs.select("key", F.col("hub.id").alias("hub")), "hubs")
    whole = stored(signed.groupBy("fp").agg(F.min("id").alias("first")), "whole")
    near = stored(linked(whole.select("fp")), "near")
    ends = [whole.select(F.col("fp").alias(c), F.col("first").alias(f"id_{c}")) for c in ("a", "b")]
    pairs = (
        ranked.join(hubs, "key").select(F.col("hub").alias("a"), F.col("id").alias("b"))
        .unionAll(signed.join(whole, "fp").select(F.col("first").alias("a"), F.col("id").alias("b")))
        .unionAll(near.join(ends[0], "a").join(ends[1], "b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
    )
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Hashes, in order, of the shingles that many of a sample of ``texts(id, text)`` have."""
    share = max(1, texts.count() // SAMPLE)
    sets = shingle_sets(texts.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)).dropDuplicates(["id"])

    def run(batches):
        for batch in slices(batches, 64):
            found = [np.frombuffer(s, np.int64) for s in batch.column("shingles").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found), pa.int64())], names=["shingle"])

    counts = sets.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON)
    return np.sort(often.select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(np.uint64))


def prefixes(sets: DataFrame, common: np.ndarray) -> DataFrame:
    """``(id, n, heads, wide, m0, ...)``: the first fifth of each shingle set of ``n``, and one more.

    All sets are put into the same order, the ``common`` shingles last. Sets of a Jaccard similarity of at least 0.8
    share one of the heads, whatever the order. Of sets of x and y shingles, x at least as large, they have 0.8 x or
    more in common, so no more than a fifth of either set is not; the first common shingle therefore stands in both
    prefixes. The marks are 512 bits that say whether an odd number of the set's shingles fall to each; every shingle
    in one set alone changes one of them, so sets differ in as many shingles as their marks differ in bits, or more.
    ``wide`` has such bits in a number that grows with the set, for ``not_ruled_out``.
    """
    sent = sets.sparkSession.sparkContext.broadcast(common)

    def head(shingles: np.ndarray) -> np.ndarray:
        size = min(len(shingles), int(len(shingles) * (1 - SIMILARITY) + 1e-6) + 1)
        if len(sent.value):
            place = np.minimum(np.searchsorted(sent.value, shingles), len(sent.value) - 1)
            last = sent.value[place] == shingles
            shingles = np.concatenate([shingles[~last], shingles[last]])
        return shingles[:size].view(np.int64)

    def run(batches):
        for batch in slices(batches, 64):
            full = [np.frombuffer(s, np.uint64) for s in batch.column("shingles").to_pylist()]
            spread = [(s * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(55) for s in full]
            odd = np.array([np.bincount(s.astype(np.int64), minlength=64 * len(MARKS)) & 1 for s in spread], np.uint8)
            marks = np.packbits(odd, axis=1, bitorder="little").view("<i8")
            columns = [batch.column("id"), pa.array([len(s) for s in full], pa.int64())]
            columns += [pa.array([head(s) for s in full], pa.list_(pa.int64()))]
            columns += [pa.array([parities(s) for s in full], pa.binary())]
            columns += [pa.array(np.ascontiguousarray(m), pa.int64()) for m in marks.T]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "heads", "wide", *MARKS])

    marks = ", ".join(f"{m} long" for m in MARKS)
    return sets.select("id", "shingles").mapInArrow(run, f"id long, n long, heads array<long>, wide binary, {marks}")


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each of 512 or more ranges of hashes, twice the set's size at most: an odd number falls there."""
    power = max(9, len(shingles).bit_length())
    place = (shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - power)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=1 << power) & 1).tobytes()


def not_ruled_out(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs whose ``wide(id, n, wide)`` parities do not show a similarity below 0.8; no link is lost."""

    def run(batches):
        for batch in slices(batches):
            kept = []
            sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist())
            bits = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            for (n_a, n_b), both in zip(sizes, bits):
                x, y = (np.unpackbits(np.frombuffer(b, np.uint8)) for b in sorted(both, key=len))
                while len(y) > len(x):  # two neighbouring ranges make one of the shorter
                    y = y[::2] ^ y[1::2]
                kept.append(int((x ^ y).sum()) * 9 <= n_a + n_b)
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(wide.toDF("a", "n_a", "x"), "a").join(wide.toDF("b", "n_b", "y"), "b")
    return both.select("a", "b", "n_a", "n_b", "x", "y").mapInArrow(run, "a long, b long")


def may_link(n, place, other_n, other_place):
    """Whether two sets of these sizes can be alike whose first common shingle stands at these places of their heads.

    At 0.8, four ninths of both sizes are common, and the first common shingle has the rest behind it.
    """
    left, other_left = (n - place) * 9, (other_n - other_place) * 9
    both = (n + other_n) * 4
    return (left >= both) & (other_left >= both)


def in_small_groups(shared: DataFrame) -> DataFrame:
    """Partners by a join: every text that seeks meets fewer than ``SMALL_GROUP`` others for a shingle."""
    names = ["id", "root", "size", "n", "place", "seeks", "tried", *MARKS]
    left, right = (shared.select("shingle", *(F.col(c).alias(f"{c}_{side}") for c in names)) for side in "ab")
    apart = sum(F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARKS)
    above = F.struct("size_a", "root_a") < F.struct(F.col("size_b").alias("size_a"), F.col("root_b").alias("root_a"))
    fits = may_link(F.col("n_a"), F.col("place_a"), F.col("n_b"), F.col("place_b"))
    fits = fits & (apart * 9 <= F.col("n_a") + F.col("n_b")) & (F.col("root_a") != F.col("root_b"))
    fits = fits & F.when(F.col("tried_a").isNull(), above).otherwise(~F.array_contains("tried_a", F.col("id_b")))
    met = left.where("seeks_a").join(right, "shingle").where(fits)
    return met.select(
        F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.col("root_b").alias("root"), apart.cast("int").alias("apart"),
        F.lit(False).alias("cut"),
    )


def in_large_groups(shared: DataFrame, limit: int) -> DataFrame:
    """Partners inside tasks: of each other component, ``limit`` texts nearest by their marks for every text that seeks.

    The texts of a shingle are dealt into blocks, and a task gets two blocks, so that no group of any size meets in
    one task; what a task gives out grows with its texts, not with their pairs.
    """
    numbers = ["id", "root", "size", "n", "place", "own", *MARKS]

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("shingle", "low", "high")], axis=1)
            starts = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            for first, end in zip([0, *starts], [*starts, len(keys)]):
                if held and tuple(keys[first]) != key:
                    yield partners(held, key[1] != key[2])
                    held = []
                if end > first:
                    key = tuple(keys[first])
                    held.append(batch.slice(first, end - first))
        if held:
            yield partners(held, key[1] != key[2])

    def partners(held, two_blocks):
        rows = pa.Table.from_batches(held)
        node, root, size, n, place, own, *marks = (rows.column(c).to_numpy() for c in numbers)
        marks, tried = np.stack(marks, axis=1).view(np.uint64), rows.column("tried")
        found = []
        for s in np.flatnonzero(rows.column("seeks").to_numpy()):
            fits = (root != root[s]) & may_link(n[s], place[s], n, place)
            if two_blocks:
                fits &= own != own[s]
            done = tried[int(s)].as_py()
            if done is None:
                fits &= (size > size[s]) | ((size == size[s]) & (root > root[s]))
            else:
                fits &= ~np.isin(node, done)
            at = np.flatnonzero(fits)
            apart = np.bitwise_count(marks[at] ^ marks[s]).sum(axis=1, dtype=np.int64)
            near = apart * 9 <= n[at] + n[s]
            at, apart = at[near], apart[near]
            if not len(at):
                continue
            order = np.lexsort((node[at], apart, root[at]))
            at, apart = at[order], apart[order]
            new = np.concatenate(([True], root[at][1:] != root[at][:-1]))
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            kept = np.arange(len(at)) - first < limit
            cut = np.isin(root[at], root[at][~kept])
            found += zip([node[s]] * int(kept.sum()), node[at][kept], root[at][kept], apart[kept], cut[kept])
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        arrays = [pa.array(np.array(c, k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=["a", "b", "root", "apart", "cut"])

    own = F.pmod(F.xxhash64("id"), F.ceil(F.col("texts") / BLOCK)).alias("own")
    dealt = shared.select("*", own).select("*", F.explode(F.expr(f"sequence(0, CAST(ceil(texts / {BLOCK}) AS INT) - 1)")).alias("meets"))
    dealt = dealt.withColumns({"low": F.least("own", "meets"), "high": F.greatest("own", "meets")})
    place = ["shingle", "low", "high"]
    ordered = dealt.select(*place, *numbers, "seeks", "tried").repartition(*place).sortWithinPartitions(*place)
    return ordered.mapInArrow(run, "a long, b long, root long, apart int, cut boolean")


def joined_up(roots: DataFrame, sets: DataFrame, links_of, common: np.ndarray = np.empty(0, np.uint64)) -> DataFrame:
    """``(node, root)`` of every text of ``sets(id, shingles)`` when no link is missing between components.

    ``roots(node, root)`` are the components so far; texts that it lacks are components of their own. Texts are joined on
    the shingles of their prefixes, which loses no link. For a shingle whose texts are all in one component there is
    nothing to do; else the texts outside its largest component seek partners. Pairs whose sizes, places or marks rule out a
    similarity of 0.8 are passed over.

    One link is enough to join two components, so that of each other component a text is compared with the one text that
    is nearest by its marks. Only texts that were not joined so, and have more texts of that component left, seek again,
    eight times as many each time, until none is left. ``links_of`` gives the verified ones of pairs. Sets may be repeated.
    """
    heads = stored(prefixes(sets, common).dropDuplicates(["id"]), "prefixes")
    rows = heads.select("id", F.posexplode("heads").alias("place", "shingle"))
    # most shingles are in one text only: counted before anything else is carried along
    repeated = stored(rows.groupBy("shingle").agg(F.count("*").alias("texts")).where("texts > 1"), "repeated")
    met = stored(unsent(rows).join(repeated, "shingle"), "met")
    named = stored(roots.toDF("id", "root"), "named")
    everyone = heads.select("id").join(named, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
    everyone, tried, limit = stored(everyone, "everyone"), None, 1
    while True:
        sizes = stored(everyone.groupBy("root").agg(F.count("*").alias("size")), "sizes")
        ranked = stored(everyone.join(sizes, "root"), "ranked")
        placed = stored(met.join(ranked, "id"), "placed")
        rank = F.struct("size", "root")
        if tried is None:
            open_groups = placed.groupBy("shingle").agg(F.max(rank).alias("top"), F.min(rank).alias("low")).where("top <> low")
        else:
            open_groups = placed.join(tried.select("id"), "id", "left_semi").select("shingle", F.lit(None).alias("top")).distinct()
        open_groups = stored(open_groups.select("shingle", F.col("top").cast("struct<size:long,root:long>")), "open_groups")
        shared = placed.join(open_groups, "shingle").join(heads.select("id", "n", *MARKS), "id")
        if tried is None:
            shared = shared.withColumns({"seeks": rank < F.col("top"), "tried": F.lit(None).cast("array<long>")})
        else:
            shared = shared.join(tried, "id", "left").withColumn("seeks", F.col("tried").isNotNull())
        shared = stored(shared.drop("top"), "shared")
        small = F.col("texts") <= SMALL_GROUP
        found = in_small_groups(shared.where(small)).unionAll(in_large_groups(shared.where(~small), limit))
        found = stored(found.groupBy("a", "b").agg(F.first("root").alias("root"), F.min("apart").alias("apart"), F.max("cut").alias("cut")), "found")
        by_root = Window.partitionBy("a", "root")
        order = F.row_number().over(by_root.orderBy("apart", "b"))
        left = F.max("cut").over(by_root) | (F.count("*").over(by_root) > limit)
        chosen = found.select("a", "b", "root", order.alias("k"), left.alias("left")).where(F.col("k") <= limit)
        chosen = stored(chosen, "chosen")
        if chosen.isEmpty():
            return everyone.toDF("node", "root")
        ends = chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = links_of(stored(not_ruled_out(ends, heads.select("id", "n", "wide")), "may_link"))
        ends = [everyone.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
        merged = connected_components(links.join(ends[0], "a").join(ends[1], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        merged = stored(merged.toDF("root", "next"), "merged")
        everyone = stored(everyone.join(merged, "root", "left").select("id", F.coalesce("next", "root").alias("root")), "everyone")
        ends = [everyone.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}")) for c in ("a", "b")]
        again = chosen.where("left").join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b").select(F.col("a").alias("id")).distinct()
        again = stored(again, "again")
        if again.isEmpty():
            return everyone.toDF("node", "root")
        pairs = chosen.select(F.col("a").alias("id"), "b")
        if tried is not None:
            pairs = pairs.unionAll(tried.select("id", F.explode("tried").alias("b")))
        tried = stored(pairs.join(again, "id", "left_semi").groupBy("id").agg(F.collect_set("b").alias("tried")), "tried")
        limit *= 8


def shingle_sets(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least 0.8."""

    def run(batches):
        for batch in slices(batches):
            kept = []
            for left, right in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                low, high = sorted((len(left), len(right)))
                if low < SIMILARITY * high:
                    kept.append(False)
                    continue
                both = len(np.intersect1d(left, right, assume_unique=True))
                kept.append(both >= SIMILARITY * (low + high - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def text_id() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: the one with the least doc_id.

    Two documents are linked if their sets of five-word shingles (lower-cased as in ``simhash``; a text of fewer
    words is one shingle) have a Jaccard similarity of at least 0.8; a group is what links join. Candidates come
    from SimHash fingerprints of the whole set, joined on the popcount grid, and of parts of the set; texts that these
    leave apart are joined on prefixes of their sets, which loses no link. Every link is verified on the whole sets.
    Equal texts are one text from the start, by a 64-bit hash; null, empty and wordless texts are one group. A row without a doc_id counts as one with the least; repeated rows leave one.
    """
    link = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("link_id")
    texts = docs.select(text_id().alias("id"), link, utf8(F.col("text")).alias("text"))
    firsts = stored(texts.groupBy("id").agg(F.min("link_id").alias("link_id")), "firsts")
    signed = stored(signatures(texts.select("id", "text")), "signatures").dropDuplicates(["id"])
    signed = stored(signed, "signatures")

    def links_of(pairs):
        asked = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(firsts, "id")
        shown = texts.join(stored(asked, "asked"), ["id", "link_id"], "left_semi").select("id", "text")
        sets = stored(shingle_sets(shown).dropDuplicates(["id"]), "sets")
        return stored(verified(pairs, sets), "verified")

    links = links_of(stored(candidates(signed), "pairs"))
    texts_only = texts.select("id", "text")
    common = common_shingles(texts_only)
    roots = joined_up(connected_components(links), shingle_sets(texts_only), links_of, common)
    groups = firsts.join(roots.withColumnRenamed("node", "id"), "id", "left")
    groups = groups.select("id", "link_id", F.coalesce("root", "id").alias("root"))
    best = groups.groupBy("root").agg(F.min(F.struct("link_id", "id")).alias("best"))
    kept = stored(best.select("best.id", "best.link_id"), "kept")
    names = [unused(docs, "kept_id"), unused(docs, "kept_link")]
    marked = docs.withColumns(dict(zip(names, [text_id(), link])))
    return marked.join(kept.toDF(*names), names, "left_semi").dropDuplicates(names).select(*docs.columns)
