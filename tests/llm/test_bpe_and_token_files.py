"""Ids and texts against the tokenizers library; token files by an exact round trip."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import bpe, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    None, "", " ", "Hello world, it's 12345!", "<|endoftext|>", "a<|endoftext|> <|endoftext|>b", "naïve  façade\t\r\n ",
    "\x00\x1c\x85​　x", "😀 日本語テキスト", "ab" * 5000, "x" + " " * 3000, "Hello world, it's 12345!",
]


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, b"x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids binary, n int")


def test_ids_and_texts_match_the_library(spark):
    found = {r.doc_id: r for r in bpe.round_trip(docs(spark), PATH).collect()}
    for k, text in enumerate(TEXTS):
        ids = library_ids(text)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        assert found[k].n_tokens == len(ids)
        assert found[k].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.round_trip(docs(spark, []), PATH).collect() == []


def test_random_texts_and_ids():
    tables, dice = bpe.Tables(PATH), random.Random(5)
    pieces = [" ", "\n", "the", "ing", "é", "😀", "\x1c", "1", "'s", "<|", "|>", "<|endoftext|>", "Zz"]
    for _ in range(1500):
        text = "".join(dice.choice(pieces) for _ in range(dice.randint(0, 25)))
        assert np.frombuffer(tables.encode(text), "<u4").tolist() == library_ids(text)
    ids = [dice.randrange(50257) for _ in range(5000)]
    assert tables.decode(bpe.pack(ids)).decode() == LIBRARY.decode(ids, skip_special_tokens=False)


def test_long_texts_are_split_alike(monkeypatch):
    text = "word  and\nmore 123 " * 200
    whole = list(bpe.words(text))
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "CHUNK", 7)
    assert list(bpe.words(text)) == whole


def test_blocks_come_back_exactly():
    dice = np.random.default_rng(3)
    blocks = [
        dice.integers(0, 50257, 1500), np.empty(0, np.int64), np.full(2500, 7), np.tile(dice.integers(0, 90, 30), 60),
        dice.zipf(1.4, 2000) % 50257, np.array([50256]), np.array([0]),
    ]
    payloads = token_files.compress(blocks, 50257)
    back = token_files.expand(payloads, [len(b) for b in blocks], 50257)
    assert all((a == b).all() for a, b in zip(blocks, back))
    assert len(payloads[2]) < 100 and len(payloads[3]) < 400
    # a block does not depend on its neighbours
    assert token_files.compress([blocks[4]], 50257)[0] == payloads[4]


def test_damage_is_found():
    ids = np.arange(500) % 60
    block = token_files.seal(ids, token_files.compress([ids], 1000)[0], 1000)
    assert (token_files.unseal([block])[0] == ids).all()
    for broken in (b"XXXX" + block[4:], block[:10], block[:20] + bytes([block[20] ^ 255]) + block[21:]):
        with pytest.raises(ValueError):
            token_files.unseal([broken])


def test_joined_checksums():
    data = bytes(range(256)) * 5
    parts = [data[:100], data[100:100], data[100:700], data[700:]]
    assert token_files.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


def test_files_hold_all_documents_in_order(spark, monkeypatch):
    texts = TEXTS + ["some words " * 9000]  # more ids than a block holds
    found = sorted(token_files.token_index(docs(spark, texts), PATH).collect(), key=lambda r: r.doc_id)
    start = 0
    for k, text in enumerate(texts):
        ids = [*library_ids(text), 0]
        assert (found[k].doc_id, found[k].start, found[k].n_tokens) == (k, start, len(ids))
        assert found[k].ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    repeated = docs(spark, ["a b"]).unionAll(docs(spark, ["a b"]))
    assert sorted((r.start, r.n_tokens) for r in token_files.token_index(repeated, PATH).collect()) == [(0, 3), (3, 3)]
    assert token_files.token_index(docs(spark, []), PATH).collect() == []


def test_pieces_give_the_ids_of_whole_texts():
    of, dice = token_files.Encoder(PATH), random.Random(11)
    assert of.cut
    pieces = [
        " ", " ", "  ", "\n", " \n", "\t", "the", "ing", "é", "ęst", "ÿ×÷", "Ġ", "Ėx", "😀", "日本", "\x0b", "\x1c", "\x85", "\xa0", "\xad",
        "\u180e", "\u200b", "\u2028", "\u3000", "\ufeff", "1", "42", "'s", "'", ",", '."', "<|", "|>", "<|endoftext|>", "Zz", "x" * 60,
    ]
    texts = TEXTS[1:] + ["".join(dice.choice(pieces) for _ in range(dice.randint(0, 25))) for _ in range(4000)]
    for _ in range(2):  # with all pieces new, and known
        found = of.encode(pa.array(texts, pa.large_string()))
        assert [ids.tolist() for ids in found] == [library_ids(t) for t in texts]
    tail = of.encode(pa.array(texts, pa.large_string()).slice(3000))
    assert [ids.tolist() for ids in tail] == [library_ids(t) for t in texts[3000:]]
    assert of.encode(pa.array([], pa.large_string())) == []
    assert [len(ids) for ids in of.encode(pa.array(["", ""], pa.large_string()))] == [0, 0]


def test_the_library_is_asked_once_for_a_piece(monkeypatch):
    of, asked = token_files.Encoder(PATH), []
    whole, word = of.whole, of.word
    monkeypatch.setattr(of, "whole", lambda texts: asked.extend(texts) or whole(texts))
    monkeypatch.setattr(of, "word", lambda w: asked.append(w) or word(w))
    found = of.encode(pa.array(["the cat, the dog"] * 50, pa.large_string()))
    assert all(ids.tolist() == library_ids("the cat, the dog") for ids in found)
    assert sorted(asked) == [" cat", " dog", " the", ",", "the"]


def test_predictions_are_mixed():
    mixer = token_files.Mixer(2, 1000)
    for step in range(40):  # the same id again and again: all orders predict it
        ids = np.array([7, 9])
        mixer.look(2)
        mixer.mass(ids)
        mixer.learn(ids, step)
    mixer.count(np.array([7, 9] * 40))
    mixer.look(2)
    every = np.array([mixer.mass(np.full(2, k))[1] for k in range(1000)], np.int64)
    assert (every.sum(axis=0) == 1 << mixer.total).all() and every.min() >= 1
    starts = np.array([mixer.mass(np.full(2, k))[0] for k in range(1000)], np.int64)
    assert (starts == np.cumsum(every, axis=0) - every).all()
    # order 2 has its weight and the part of order 0
    w2, w1, w0 = mixer.now
    size = np.diff(mixer.ends, prepend=0)
    assert every[7, 0] == w2[0] + w0[0] * size[7] and w2[0] > w0[0] * size[7] > 0 and w1[0] == 0
    assert (mixer.find(starts[7].astype(mixer.kind)) == 7).all()
    assert (mixer.find((starts[7] + every[7] - 1).astype(mixer.kind)) == 7).all()


def test_lanes_of_any_shape_come_back_exactly():
    dice = np.random.default_rng(5)
    for n in (1, 2, 511, 512, 1023, 1024, 1025, 20_011):
        ids = dice.zipf(1.3, n) % 300_000
        for vocabulary in (300_000, 300_001):
            payload = token_files.compress([ids], vocabulary)[0]
            assert (token_files.expand([payload], [n], vocabulary)[0] == ids).all()
