"""Chat formatting: schema fingerprints choose declarative mappings from record layouts to canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspark.session import new_folder

# The control strings of the template.
BEGIN, END = "<|im_start|>", "<|im_end|>"

# Names that dialogue layouts give to the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# A mapping says where turns stand in a record and where a turn keeps its role and text. ``items`` is the field with
# the list of turns (none: the record is a turn). ``pairs`` maps fields of the record to roles, in order; those that
# a record does not have, or that are null in an optional field, give no turn.
MAPPINGS = {
    "turn": {"paths": ["role", "text"], "role": "role", "text": "text"},
    "messages": {"paths": ["messages[]", "messages[].content", "messages[].role"], "items": "messages", "role": "role", "text": "content"},
    "dialogue": {"paths": ["conversations[]", "conversations[].from", "conversations[].value"], "items": "conversations", "role": "from", "text": "value", "names": ROLE_NAMES},
    "instruction": {"paths": ["instruction", "output"], "pairs": [("instruction", "user"), ("output", "assistant")]},
    "instruction_input": {
        "paths": ["input", "instruction", "output"],
        "pairs": [("instruction", "user"), ("input", "user"), ("output", "assistant")],
        "optional": ["input"],
    },
    "prompt": {"paths": ["completion", "prompt"], "pairs": [("prompt", "user"), ("completion", "assistant")]},
    "system_prompt": {
        "paths": ["completion", "prompt", "system"],
        "pairs": [("system", "system"), ("prompt", "user"), ("completion", "assistant")],
        "optional": ["system"],
    },
    "question": {"paths": ["answer", "question"], "pairs": [("question", "user"), ("answer", "assistant")]},
}
def field_paths(value, prefix: str = "") -> Iterator[str]:
    """The paths of a record's leaves and lists, whatever their values: ``a.b``, ``list[]``, ``list[].c``."""
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from field_paths(inner, f"{prefix}.{name}" if prefix else name)
    elif isinstance(value, list):
        yield f"{prefix}[]"
        for inner in value:
            if isinstance(inner, (dict, list)):
                yield from field_paths(inner, f"{prefix}[]")
    elif prefix:
        yield prefix


def fingerprint(paths) -> str:
    """A hash of the distinct field paths, in order of name: equal for records of one layout."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode("utf-8", "surrogatepass")).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m["paths"]): (name, m) for name, m in MAPPINGS.items()}
# a list without turns has no fields inside
BY_FINGERPRINT |= {fingerprint([f"{m['items']}[]"]): (name, m) for name, m in MAPPINGS.items() if "items" in m}


def turns_of(record: dict, mapping: dict) -> list[tuple[str, str]]:
    """Canonical ``(role, text)`` turns; a null role or text is empty."""
    if "pairs" in mapping:
        optional = mapping.get("optional", [])
        fields = [(name, role) for name, role in mapping["pairs"] if name not in optional or record[name] not in (None, "")]
        return [(role, plain(record[name])) for name, role in fields]
    items = record[mapping["items"]] if "items" in mapping else [record]
    found = [(plain(item.get(mapping["role"])), plain(item.get(mapping["text"]))) for item in items if isinstance(item, dict)]
    canonical = mapping.get("names", {})
    return [(canonical.get(role, role), text) for role, text in found]


def plain(value) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical_turns(records: DataFrame) -> DataFrame:
    """``(conv_id, turn, part, layout, role, text)``: one row per turn of ``records(conv_id, turn, record)``.

    ``record`` is a JSON object in one of the ``MAPPINGS`` layouts; ``turn`` is its place in the conversation, null
    as 0, and ``part`` counts the turns inside it. A record that is null, no object, or in no known layout gives one row with a
    null layout, role and text, so that nothing goes lost unseen.
    """

    def run(batches):
        for batch in batches:
            out = []
            for conv, turn, record in zip(*(batch.column(k).to_pylist() for k in range(3))):
                try:
                    value = json.loads(record) if record is not None else None
                except ValueError:
                    value = None
                known = BY_FINGERPRINT.get(fingerprint(field_paths(value))) if isinstance(value, dict) else None
                if known is None:
                    out.append((conv, turn, 0, None, None, None))
                    continue
                for part, (role, text) in enumerate(turns_of(value, known[1])):
                    out.append((conv, turn, part, known[0], role, text))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["conv_id", "turn", "part", "layout", "role", "text"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = records.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.col("record").cast("string").alias("record"),
    )
    return rows.mapInArrow(run, "conv_id long, turn long, part long, layout string, role string, text string")


def escape(text: str) -> str:
    """No control string can stand in the result: ``<|``, and what escapes it, get one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, part, chunk, loss_start, loss_chars)``: the template's text of every canonical turn.

    A conversation's text is its chunks in order of turn and part. The loss mask covers the ``loss_chars`` code
    points of a chunk from ``loss_start`` on: the escaped text of an assistant's turn, nothing of others. Turns
    of records in no known layout are left out here; ``canonical_turns`` shows them.
    """

    def run(batches):
        for batch in batches:
            out = []
            for conv, turn, part, role, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
                head, body = f"{BEGIN}{escape_role(role)}\n", escape(text)
                learnt = len(body) if role == "assistant" else 0
                out.append((conv, turn, part, f"{head}{body}{END}\n", len(head), learnt))
            columns = list(zip(*out)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["conv_id", "turn", "part", "chunk", "loss_start", "loss_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    rows = turns.where("layout IS NOT NULL").select("conv_id", "turn", "part", "role", "text")
    kind = "conv_id long, turn long, part long, chunk string, loss_start long, loss_chars long"
    return rows.mapInArrow(run, kind)


def read_chunk(chunk: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (chunk.startswith(BEGIN) and chunk.endswith(f"{END}\n")):
        raise ValueError("a chunk is not in the template's format")
    role, _, body = chunk[len(BEGIN) : -len(END) - 1].partition("\n")
    return unescape_role(role), unescape(body)


def digests(chunks: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from chunks.

    A hash over a conversation is one after the other by nature: a conversation's chunks are brought into order in
    one partition, spilling to disk if needed, and streamed through the hashes, so its length does not matter for
    memory.
    """

    def run(batches):
        done, current, state = [], None, None
        for batch in batches:
            for conv, chunk, start, learnt in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if state is None or conv != current:
                    if state is not None:
                        done.append(closed(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = read_chunk(chunk)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                loss = unescape(chunk[start : start + learnt])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += len(chunk)
            if len(done) >= 1000:
                yield out(done)
                done = []
        if state is not None:
            done.append(closed(current, state))
        yield out(done)

    def closed(conv, state):
        return conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    def out(rows):
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    ordered = chunks.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "part", "chunk")
    kind = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "chunk", "loss_start", "loss_chars").mapInArrow(run, kind)


def chat_digests(spark: SparkSession, records: DataFrame) -> DataFrame:
    """Records to canonical turns, to formatted chunks in files, and digests of what is read back from these.

    The order of a conversation is that of ``turn``, then that inside a record; equal turns go by their formatted
    text, so repeated rows are repeated turns. Rows with a null conv_id are one conversation. An empty table gives
    no rows.
    """
    folder = new_folder(spark, "chat")
    written = formatted(canonical_turns(records))
    written.write.parquet(folder)
    return digests(spark.read.schema(written.schema).parquet(folder))
