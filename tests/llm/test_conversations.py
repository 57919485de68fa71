"""Conversation repair against a search over all edits, and odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest

from tallyspark.llm import conversations as c

KIND = "conv_id long, turn long, role string, text string, is_row string, audit string"


def cheapest(signature: str) -> tuple[int, str]:
    """Least cost, then least audit, by walking edits in order of cost."""
    import heapq

    heap = [(0, "", 0, "")]
    while heap:
        cost, audit, at, said = heapq.heappop(heap)
        if at == len(signature) and re.fullmatch("(s?(ua)+)?", said):
            return cost, audit
        if len(said) > len(signature) + 2 or not re.fullmatch("s?(ua)*u?", said):
            continue
        for role in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", at, said + role))
        if at < len(signature):
            symbol = signature[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, said))
            if symbol != "d":
                extra = symbol.isupper()
                heapq.heappush(heap, (cost + extra, audit + "K", at + 1, said + symbol.lower()))
                for role in "ua":
                    heapq.heappush(heap, (cost + extra + 2, audit + "R", at + 1, said + role))


def test_automaton_against_all_edits():
    draw = random.Random(5)
    signatures = {"".join(draw.choice("dsuaxSUAX") for _ in range(draw.randint(0, 5))) for _ in range(150)}
    automaton = c.SuffixAutomaton()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        automaton.enter(signature[::-1])
        assert automaton.best() == cheapest(signature), signature


def test_nodes_are_shared():
    automaton = c.SuffixAutomaton()
    automaton.enter("uaua"[::-1])
    kept = automaton.costs[:3]
    automaton.enter("ssua"[::-1])
    assert all(a is b for a, b in zip(kept, automaton.costs))
    assert len(automaton.costs) == 5


def turns(spark, rows):
    return spark.createDataFrame(rows, KIND)


def brute(rows):
    """Counts, audit and repaired lines of one conversation."""
    blank_of = lambda t: not t.strip(" \t\n\r\x0b\x0c")
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
    counts, seen, signature = Counter(), set(), ""
    for k, (_, role, text) in enumerate(rows):
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if blank_of(text):
            counts["blank"] += 1
            initial = "d"
        elif (role, text) in seen:
            counts["duplicate"] += 1
            initial = "d"
        elif text.rstrip(" \t\n\r\x0b\x0c")[-1] not in ".!?":
            counts["truncated"] += 1
            initial = initial.upper()
        seen.add((role, text))
        signature += initial
        counts["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = cheapest(signature)
    lines, at, said = [], 0, ""
    for edit in audit:
        role = "assistant" if said[-1:] == "u" else "user"
        if edit == "K":
            role = rows[at][1]
        if edit != "D":
            lines.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
            said += role[0]
        at += edit != "I"
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, lines


def test_repair_against_brute_force(spark):
    draw = random.Random(11)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Ü?\n", None, "Yes."]
    roles = ["system", "user", "assistant", "tool", None, "", "user", "assistant"]
    rows = [
        (conv, draw.choice([None, 0, 1, 2, 3, 7]), draw.choice(roles), draw.choice(texts), "x", "y")
        for conv in [None, *range(60)]
        for _ in range(draw.randint(1, 5))
    ]
    conversations, repaired = c.repair(turns(spark, rows))
    lines = {}
    for r in repaired.orderBy("conv_id", "place").collect():
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    found = {r.conv_id: r for r in conversations.collect()}
    digests = {r.conv_id: r.repaired_sha256 for r in c.text_digests(repaired).collect()}
    assert set(found) == {r[0] for r in rows}
    for conv, r in found.items():
        *numbers, wanted = brute([(t, role, text) for k, t, role, text, *_ in rows if k == conv])
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == numbers, conv
        assert lines.get(conv, []) == wanted
        if wanted:
            assert digests[conv] == hashlib.sha256("\n".join(wanted).encode()).hexdigest()


def test_every_conversation_is_returned(spark):
    rows = [(k, 0, "user", "Hello.", "", "") for k in range(200)] + [(None, None, None, None, "", "")]
    found = {r.conv_id: r for r in c.repair_digests(turns(spark, rows)).collect()}
    assert set(found) == {*range(200), None}
    empty = [r for r in found.values() if r.audit == ""]
    assert empty and all(r.repaired_sha256 == hashlib.sha256(b"").hexdigest() and r.cost == 0 for r in empty)
    assert found[None].audit == "D" and found[None].cost == 3


def test_long_conversation_and_empty_table(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.", "", "") for k in range(20_000)]
    conversations, repaired = c.repair(turns(spark, rows + [(1, 20_000, "user", "x" * 1_000_000 + ".", "", "")]))
    (one,) = conversations.collect()
    assert one.audit == "K" * 20_001 + "I" and one.cost == 2
    assert repaired.count() == 20_002
    conversations, repaired = c.repair(turns(spark, []))
    assert conversations.collect() == [] and repaired.collect() == []
    assert c.repair_digests(turns(spark, [])).collect() == []


@pytest.mark.parametrize("copies", [3, 50])
def test_repeats_go(spark, copies):
    rows = [(4, 0, "user", "Same.", "", "")] * copies + [(4, 1, "assistant", "Fine.", "", "")]
    (one,) = c.repair(turns(spark, rows))[0].collect()
    assert one.duplicate == copies - 1 and one.audit == "K" + "D" * (copies - 1) + "K"
