"""Fingerprints, links and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import simhash, similar
from tallyspark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, root string"


def frame(spark, texts, start=0):
    rows = [(start + k, t, "en", "s", len(t or ""), 5, "clash") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def plain_fingerprint(text, size):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(items, linked):
    """Least member by item, of what ``linked`` joins."""
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in items}


def sample_texts():
    dice = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    base = [dice.choice(words) for _ in range(400)]
    texts = [None, "", "  \t\n", "one", "One", "one two", " ".join(base), " ".join(base).upper(), "é\x1cx y z"]
    for _ in range(25):
        copy = list(base)
        for _ in range(dice.randint(1, 4)):
            copy[dice.randrange(len(copy))] = dice.choice(words)
        texts.append("  ".join(copy))
    return texts + [" ".join(dice.choice(words) for _ in range(60)) for _ in range(20)] + ["one", ""]


def test_near_copies_match_brute_force(spark):
    texts = sample_texts()
    fps = [plain_fingerprint(t, 3) for t in texts]
    want = groups_of(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    rows = simhash.near_copies(frame(spark, texts)).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {k: f"{f:016x}" for k, f in enumerate(fps)}
    assert {r.doc_id: r.component_id for r in rows} == want


def test_repeated_null_and_missing_rows(spark):
    rows = frame(spark, ["a b c d", "a b c d"]).unionAll(frame(spark, ["a b c d"]))
    rows = rows.unionAll(spark.createDataFrame([(None, "a b c d", None, None, None, None, None)], DOCS))
    found = simhash.near_copies(rows).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in found) == [
        (False, 0, 0), (False, 0, 0), (False, 1, 0), (True, 0, 0),
    ]
    assert simhash.near_copies(frame(spark, [])).collect() == []


@pytest.mark.parametrize("spread", [1, 3, 6])
def test_dense_cells_keep_all_links(spark, spread):
    dice = random.Random(spread)
    base = dice.getrandbits(64)
    values = {base ^ sum(1 << dice.randrange(64) for _ in range(dice.randint(0, spread))) & (1 << 64) - 1 for _ in range(250)}
    signed = {v - (1 << 64) if v >> 63 else v: v for v in values}
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.linked(fps)).collect()}
    want = groups_of(list(signed), lambda a, b: (signed[a] ^ signed[b]).bit_count() <= 2)
    found = {}
    for v in signed:
        found.setdefault(roots.get(v, v), set()).add(v)
    wanted = {}
    for v, r in want.items():
        wanted.setdefault(r, set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1400)] + [(7, 7), (5000, 5001), (5001, 5000)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links + [(None, 3)], "a long, b long")).collect()}
    groups = {}
    for node, root in found.items():
        groups.setdefault(root, set()).add(node)
    assert sorted(map(min, groups.values())) == [0, 1000, 5000]
    assert sorted(map(len, groups.values())) == [2, 301, 400]
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each_matches_exact_similarity(spark):
    texts = sample_texts()
    sets = [set(similar.shingle_set((t or "").encode()).tolist()) for t in texts]

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    want = set(groups_of(range(len(texts)), alike).values())
    docs = frame(spark, texts)
    kept = similar.one_of_each(docs.unionAll(docs.limit(3)))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert similar.one_of_each(docs.limit(0)).collect() == []


def test_a_large_group_of_near_copies_leaves_one(spark):
    dice = random.Random(2)
    base = [f"w{dice.randrange(5000)}" for _ in range(300)]
    texts = []
    for _ in range(150):
        copy = list(base)
        copy[dice.randrange(300)] = f"x{dice.randrange(10**6)}"
        texts.append(" ".join(copy))
    assert [r.doc_id for r in similar.one_of_each(frame(spark, texts)).collect()] == [0]


def components(roots):
    groups = {}
    for r in roots.collect():
        groups.setdefault(r.root, set()).add(r.node)
    return sorted(map(sorted, groups.values()))


def exact_components(texts):
    sets = [set(similar.shingle_set(t.encode()).tolist()) for t in texts]

    def alike(a, b):
        both = len(sets[a] & sets[b])
        return both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)

    groups = {}
    for node, root in groups_of(range(len(texts)), alike).items():
        groups.setdefault(root, set()).add(node)
    return sorted(map(sorted, groups.values()))


def join_up(spark, texts, known=(), pairs=None):
    rows = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "id long, text binary")
    sets = similar.shingle_sets(rows)

    def links_of(found):
        if pairs is not None:
            pairs.append(found.count())
        return similar.verified(found, sets)

    return similar.joined_up(spark.createDataFrame(list(known), "node long, root long"), sets, links_of, similar.common_shingles(rows))


@pytest.mark.parametrize(("small", "block"), [(similar.SMALL_GROUP, similar.BLOCK), (1, 7), (1, 1000)])
def test_a_dense_group_loses_no_link(spark, monkeypatch, small, block):
    # a chain of texts: neighbours are alike, no text is like most others
    monkeypatch.setattr(similar, "SMALL_GROUP", small)
    monkeypatch.setattr(similar, "BLOCK", block)
    words = [f"w{k}" for k in range(900)]
    texts = [" ".join(words[8 * k : 8 * k + 200]) for k in range(80)]
    assert components(join_up(spark, texts, [(k, 0) for k in range(30)])) == exact_components(texts)


@pytest.mark.parametrize("small", [1, 100])
def test_texts_that_are_nearly_alike_are_all_looked_at(spark, monkeypatch, small):
    # pairs lie just above and just below 0.8, so that the nearest by its marks is not always alike
    monkeypatch.setattr(similar, "SMALL_GROUP", small)
    dice = random.Random(6)
    base = [f"w{dice.randrange(10**6)}" for _ in range(300)]
    texts = []
    for k in range(60):
        copy = list(base)
        for j in dice.sample(range(300), 4 + k % 5):
            copy[j] = f"x{dice.randrange(10**6)}"
        texts.append(" ".join(copy))
    assert components(join_up(spark, texts)) == exact_components(texts)


def test_candidates_grow_with_the_texts(spark):
    made, looked = [], []
    for n in (100, 200, 400):
        dice = random.Random(n)
        base = [f"w{dice.randrange(10**6)}" for _ in range(300)]
        texts = []
        for _ in range(n):
            copy = list(base)
            for j in dice.sample(range(300), 4):
                copy[j] = f"x{dice.randrange(10**6)}"
            texts.append(" ".join(copy))
        rows = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "id long, text binary")
        pairs = similar.candidates(similar.signatures(rows))
        made.append(pairs.count())
        roots = connected_components(similar.verified(pairs, similar.shingle_sets(rows)))
        looked.append([])
        join_up(spark, texts, [(r.node, r.root) for r in roots.collect()], looked[-1])
    assert made[2] <= 4.8 * made[0]
    assert sum(looked[2]) <= 6 * max(sum(looked[0]), 60)


def test_links_that_share_no_part_key_are_found(spark):
    dice = random.Random(4)
    texts = []
    while len(texts) < 6:
        base = [f"w{dice.randrange(10**6)}" for _ in range(1004)]
        other = base[:893] + [f"x{dice.randrange(10**6)}" for _ in range(111)]
        sets = [similar.shingle_set(" ".join(t).encode()) for t in (base, other)]
        both = len(np.intersect1d(*sets))
        assert both >= 0.8 * (len(sets[0]) + len(sets[1]) - both)
        if not len(np.intersect1d(*map(similar.part_keys, sets))):
            texts += [" ".join(base), " ".join(other)]
    assert sorted(r.doc_id for r in similar.one_of_each(frame(spark, texts)).collect()) == [0, 2, 4]


def test_common_shingles_lose_no_link(spark):
    # every text has the same passage, so its shingles stand last; some texts are little more than the passage
    dice = random.Random(5)
    passage = [f"p{k}" for k in range(100)]
    texts = [" ".join([f"w{dice.randrange(10**6)}" for _ in range(n)] + passage) for n in [3, 8, 12, 15, 40, 90] * 4]
    rows = spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "id long, text binary")
    common = similar.common_shingles(rows)
    assert set(similar.shingle_set(" ".join(passage).encode()).tolist()) <= set(common.tolist())
    found = components(join_up(spark, texts))
    assert found == exact_components(texts) and 1 < len(found) < 24


def test_columns_with_the_names_used_inside_stay(spark):
    rows = [(k, "one two three four five six", k, "x", "id", 7) for k in (3, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id0 long, kept_link0 string, id string, link_id int")
    assert [tuple(r) for r in similar.one_of_each(docs).collect()] == [(1, "one two three four five six", 1, "x", "id", 7)]


def test_long_texts_are_ruled_out_by_more_marks(spark):
    dice = random.Random(9)
    base = [f"w{dice.randrange(10**6)}" for _ in range(4300)]
    texts = [base, base[:3850] + ["x"] * 3, base[:3700] + [f"y{k}" for k in range(400)], base[:900] + [f"z{k}" for k in range(3500)]]
    rows = spark.createDataFrame([(k, " ".join(t).encode()) for k, t in enumerate(texts)], "id long, text binary")
    sets_of = similar.shingle_sets(rows)
    wide = similar.prefixes(sets_of, np.empty(0, np.uint64)).select("id", "n", "wide")
    pairs = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 4)], "a long, b long")
    left = {(r.a, r.b) for r in similar.not_ruled_out(pairs, wide).collect()}
    links = {(r.a, r.b) for r in similar.verified(pairs, sets_of).collect()}
    assert links and links <= left and not left & {(0, 3), (1, 3), (2, 3)}


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_exploded_fingerprints_are_not_sent_to_all_executors(spark):
    # Spark takes a fingerprint's 33 cells and a value's 65 neighbours for one row each
    lines = plan(simhash.linked(spark.range(100).select(F.xxhash64("id").alias("fp")))).splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    sent = [k for k, line in enumerate(lines) if "BroadcastExchange" in line]
    ends = [next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines)) for k in sent]
    assert sent and not [line for k, end in zip(sent, ends) for line in lines[k:end] if "Generate" in line]


def test_exploded_prefixes_are_not_sent_to_all_executors(spark, monkeypatch):
    seen, kept = [], similar.stored

    def keep(df, label):
        seen.append((label, plan(df)))
        if label == "met":
            raise InterruptedError
        return kept(df, label)

    monkeypatch.setattr(similar, "stored", keep)
    with pytest.raises(InterruptedError):
        join_up(spark, ["one two three four five six", "one two three four five"])
    assert "Generate" in dict(seen)["met"] and "BroadcastExchange" not in dict(seen)["met"]
