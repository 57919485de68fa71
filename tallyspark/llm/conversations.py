"""Conversation repair: faults as signatures, a suffix-shared automaton of all of them, cheapest edits per node."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspark.session import stored

BLANKS = r"\x20\x09-\x0D"
ENDINGS = ".!?"
ALLOWED_PAIRS = frozenset({"su", "ua", "au"})
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs; keeping costs nothing

# Grammar states of ``(s?(ua)+)?``: nothing yet, after system, after user, after assistant.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORWARD = (2, 2, 3, 2)  # where a user or assistant put in by an edit leads to
FORWARD_ROLE = ("user", "user", "assistant", "user")
ACCEPTED = (0, 3)
NEVER = 1 << 40


def fault_columns(text: Column) -> tuple[Column, Column]:
    """Whether a text is blank, and whether its last character that is not white space ends no sentence."""
    return ~text.rlike(f"[^{BLANKS}]"), ~text.rlike(rf"[{ENDINGS}][{BLANKS}]*\z")


def clean_rows(turns: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"))


def signatures(turns: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, signature)``, a row per conversation.

    A row's first fault counts: blank, duplicate (role and text seen earlier), truncated. ``illegal`` counts
    neighbours whose roles may not follow each other, ``gaps`` the turn numbers that are missing between the least and
    the greatest. A signature has a character per row: ``d`` for what has to go, else the role's initial (``x`` for
    others than system, user, assistant), as a capital if the text is truncated.

    Where a text was first seen is a grouped minimum, so that no conversation's texts are held together. Only the
    signature itself, a byte per row like the audit that is returned for it, is built in one task.
    """
    rows = clean_rows(turns).withColumn("digest", F.sha2("text", 256))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"), F.col("digest").alias("f_digest"), "first")
    met = F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
    blank, truncated = fault_columns(F.col("text"))
    marked = rows.join(first, met).select(
        "conv_id", "turn", "role", "text", "digest", blank.alias("blank"), truncated.alias("truncated"),
        (~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("later"),
    )
    ordered = marked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    columns = ["conv_id", "turn", "role", "digest", "blank", "truncated", "later"]
    kind = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    names = [part.split()[0] for part in kind.split(", ")]

    def run(batches):
        done, conversation, before = [], None, None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(columns)))):
                if conversation is None or row[0] != conversation.conv_id:
                    if conversation is not None:
                        done.append(conversation.summary())
                    conversation, before = Conversation(row[0]), None
                conversation.add(row, row[1:4] == before)
                before = row[1:4]
            if len(done) >= 1000:
                yield batch_of(done, names, kind)
                done = []
        if conversation is not None:
            done.append(conversation.summary())
        yield batch_of(done, names, kind)

    return ordered.select(*columns).mapInArrow(run, kind)


class Conversation:
    """Counts and signature of the rows of one conversation, met in order."""

    def __init__(self, conv_id):
        self.conv_id, self.blank, self.duplicate, self.truncated, self.illegal = conv_id, 0, 0, 0, 0
        self.least = self.greatest = self.initial = None
        self.turns, self.signature = 0, []

    def add(self, row, repeated: bool) -> None:
        _, turn, role, _, blank, truncated, later = row
        if turn is not None and (self.greatest is None or turn > self.greatest):
            self.least = turn if self.least is None else self.least
            self.greatest, self.turns = turn, self.turns + 1
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in ALLOWED_PAIRS
        self.initial = initial
        symbol = initial if initial in ("s", "u", "a") else "x"
        if blank:
            self.blank, symbol = self.blank + 1, "d"
        elif later or repeated:
            self.duplicate, symbol = self.duplicate + 1, "d"
        elif truncated:
            self.truncated, symbol = self.truncated + 1, symbol.upper()
        self.signature.append(symbol)

    def summary(self) -> tuple:
        gaps = 0 if self.least is None else self.greatest - self.least + 1 - self.turns
        faults = (self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.conv_id, gaps, *faults, "".join(self.signature))


def batch_of(rows: list[tuple], names: list[str], kind: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    columns = list(zip(*rows)) or [()] * len(names)
    types = [kinds[part.split()[1]] for part in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


@lru_cache(maxsize=None)
def node_values(symbol: str, costs: tuple[int, ...] | None) -> tuple[int, tuple[int, ...], str]:
    """Costs to go and first edits of a node, by grammar state; ``costs``: those of the node that ``symbol`` leads to.

    Costs are above the least of the four, which comes first; so they take few values and are worked out once. No two
    edits that are open to a node and state share an initial: of equal costs the least initial gives the least audit.
    """
    if costs is None:
        found = [(0, "") if state in ACCEPTED else (NEVER, "") for state in range(4)]
    else:
        found = [min(row_edits(symbol, state, costs)) for state in range(4)]
    for _ in range(3):
        found = [min(best, (found[FORWARD[state]][0] + INSERT, "I")) for state, best in enumerate(found)]
    least = min(found)[0]
    return least, tuple(cost - least for cost, _ in found), "".join(edit or "." for _, edit in found)


def row_edits(symbol: str, state: int, costs: tuple[int, ...]):
    yield costs[state] + DELETE, "D"
    if symbol == "d":
        return
    extra, kept = TRUNCATED * symbol.isupper(), KEEP[state].get(symbol.lower())
    if kept is not None:
        yield costs[kept] + extra, "K"
    yield costs[FORWARD[state]] + extra + REROLE, "R"


class SuffixAutomaton:
    """The nodes on the way from the end of the signature met last; signatures come in order of their reversals.

    A node is a suffix, shared by all signatures that end in it; in that order they follow each other, so that a node
    is made and valued once, and left for good when a signature without it comes. Kept are the nodes of one
    signature, a few bytes for each of its rows.
    """

    def __init__(self):
        least, costs, edits = node_values("", None)
        self.symbols, self.least, self.costs, self.edits = "", [least], [costs], [edits]

    def enter(self, backwards: str) -> None:
        shared = sum(1 for _ in takewhile(lambda pair: pair[0] == pair[1], zip(self.symbols, backwards)))
        for column in (self.least, self.costs, self.edits):
            del column[shared + 1 :]
        for symbol in backwards[shared:]:
            least, costs, edits = node_values(symbol, self.costs[-1])
            self.least.append(self.least[-1] + least)
            self.costs.append(costs)
            self.edits.append(edits)
        self.symbols = backwards

    def best(self) -> tuple[int, str]:
        """Cost and audit of the signature entered last, along the edits of its nodes."""
        state, audit, node = 0, [], len(self.symbols)
        while (edit := self.edits[node][state]) != ".":
            audit.append(edit)
            if edit in "IR":
                state = FORWARD[state]
            elif edit == "K":
                state = KEEP[state][self.symbols[node - 1].lower()]
            node -= edit != "I"
        return self.least[-1] + self.costs[-1][0], "".join(audit)


def audits(signed: DataFrame) -> DataFrame:
    """``(signature, cost, audit)`` of every distinct ``signature``, from the automaton of all of them.

    Signatures are sorted by their reversals in ranges; a task builds its range's part of the automaton, so that only
    the path on the edge of two ranges is valued twice.
    """

    def run(batches):
        automaton = SuffixAutomaton()
        for batch in batches:
            out = []
            for signature in batch.column(0).to_pylist():
                automaton.enter(signature[::-1])
                out.append((signature, *automaton.best()))
            yield batch_of(out, ["signature", "cost", "audit"], kind)

    kind = "signature string, cost long, audit string"
    distinct = stored(signed.groupBy("signature").count().select("signature"), "signatures")
    backwards = F.reverse("signature")
    return distinct.repartitionByRange(backwards).sortWithinPartitions(backwards).mapInArrow(run, kind)


def repaired_turns(turns: DataFrame, audited: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, turn, role, text)``: the rows of the repaired conversations, in order within a partition.

    ``audited`` has ``conv_id`` and ``audit``. Rows put in have an empty text and no turn. The rows of a conversation
    and, before them, its audit are streamed in order, spilling to disk if needed; none are held.
    """
    rows = clean_rows(turns).withColumn("audit", F.lit(None).cast("string"))
    none = lambda kind: F.lit(None).cast(kind)
    heads = audited.select("conv_id", none("long").alias("turn"), none("string").alias("role"), none("string").alias("text"), "audit")
    mixed = rows.unionByName(heads).withColumn("is_row", F.col("audit").isNull())
    ordered = mixed.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "text")
    kind = "conv_id long, place long, edit string, turn long, role string, text string"
    names = [part.split()[0] for part in kind.split(", ")]

    def run(batches):
        repair, out = None, []
        for batch in batches:
            for conv, turn, role, text, audit in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if audit is not None:
                    repair = Repair(conv, audit)
                    out.extend(repair.inserted())
                else:
                    out.extend(repair.row(turn, role, text))
                if len(out) >= 1000:
                    yield batch_of(out, names, kind)
                    out = []
        yield batch_of(out, names, kind)

    return ordered.select("conv_id", "turn", "role", "text", "audit").mapInArrow(run, kind)


class Repair:
    """Applies an audit to the rows of a conversation, met in order."""

    def __init__(self, conv_id, audit: str):
        self.conv_id, self.audit, self.at, self.state, self.place = conv_id, audit, 0, 0, 0

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            yield self._out("I", None, FORWARD_ROLE[self.state], "")
            self.at, self.state = self.at + 1, FORWARD[self.state]

    def row(self, turn, role, text):
        edit = self.audit[self.at]
        if edit == "K":
            yield self._out(edit, turn, role, text)
            self.state = KEEP[self.state][role[:1]]
        elif edit == "R":
            yield self._out(edit, turn, FORWARD_ROLE[self.state], text)
            self.state = FORWARD[self.state]
        self.at += 1
        yield from self.inserted()

    def _out(self, edit, turn, role, text):
        self.place += 1
        return self.conv_id, self.place, edit, turn, role, text


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations of a table of turns and their repaired rows: the frames of ``repaired_turns`` and below.

    ``turns`` has ``conv_id``, ``turn``, ``role``, ``text``; other columns take no part. The first frame has a row
    per conversation: ``conv_id``, the counts of ``signatures``, ``cost`` and ``audit``, the initials of the cheapest
    edits (keep, delete, insert, rerole) that make the roles a conversation, the least in ASCII among the cheapest.

    Rows are in order of turn (nulls first), then role, then text, so repeated rows are neighbours. A null role or
    text is one blank; rows with a null conv_id are one conversation; an empty text is a blank one. A role that
    starts with none of ``s``, ``u``, ``a`` (an empty one too) can't be kept. An empty table gives no rows.
    """
    signed = stored(signatures(turns), "signed")
    found = stored(audits(signed), "audits").withColumnRenamed("signature", "of")
    conversations = stored(signed.join(found, F.col("signature") == F.col("of")).drop("of", "signature"), "audited")
    return conversations, repaired_turns(turns, conversations)


def text_digests(repaired: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)`` of ``role:text`` lines; rows of a conversation stand together, in order.

    A hash runs over a conversation from its first row to its last, so a conversation is streamed by one task.
    """

    def run(batches):
        done, current, state = [], None, None
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if state is not None and conv == current:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = conv, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
            if len(done) >= 1000:
                yield batch_of(done, names, kind)
                done = []
        if state is not None:
            done.append((current, state.hexdigest()))
        yield batch_of(done, names, kind)

    kind, names = "conv_id long, repaired_sha256 string", ["conv_id", "repaired_sha256"]
    return repaired.select("conv_id", "role", "text").mapInArrow(run, kind)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults put in by a checksum of conversation and turn: some rows are dropped, emptied, cut, repeated
    or said by the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    emptied = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", f"[{ENDINGS}]", ""))
    copies = F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        emptied.otherwise(F.col("text")).alias("text"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def repair_digests(turns: DataFrame) -> DataFrame:
    """The repair of the damaged ``turns``: counts, cost, audit and digest of every conversation, however little is
    left of it; one without rows has zeros, an empty audit and the digest of nothing."""
    broken = damaged(turns)
    conversations, repaired = repair(broken)
    every = turns.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    named = text_digests(repaired).withColumnRenamed("conv_id", "d_conv")
    same = lambda c: F.col("conv").eqNullSafe(F.col(c))
    met = every.join(conversations, same("conv_id"), "left").join(named, same("d_conv"), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return met.select(
        F.col("conv").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
