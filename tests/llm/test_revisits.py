"""Not-modified revisits against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import warc

KIND = "capture long, url string, at long, status int, headers map<string,string>, digest string, page string, base int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


@pytest.mark.parametrize(
    ("url", "page"),
    [
        ("HTTPS://www.A.example/x/?b=2&a=1&utm_source=f#top", "a.example/x?a=1&b=2"),
        ("http://m.a.example:80/", "a.example"),
        ("a.example/Path?ref=1", "a.example/Path"),
        ("http://a.example?refer=1&&", "a.example?refer=1"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_urls(spark, url, page):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == page


def plain(rows):
    done, out = {}, {}
    urls = {"http://a/1": "a/1", "https://www.a/1#x": "a/1", "https://b/2?ref=1": "b/2", "http://b/2": "b/2", None: None}
    for capture, url, at, status, headers, digest in sorted(set((r[0], r[1], r[2], r[3], None, r[5]) for r in rows), key=lambda r: (r[2] is None, r[2] or 0, r[0])):
        headers = next(r[4] for r in rows if r[0] == capture)
        page = urls[url]
        base = done.get(page) if page is not None and at is not None else None
        if status == 304:
            mine = headers or {}
            if base is None:
                outcome = "missing"
            elif "etag" not in mine and "last-modified" not in mine:
                outcome = "unvalidated"
            else:
                name = "etag" if "etag" in mine else "last-modified"
                outcome = "resolved" if mine[name] == (base[1] or {}).get(name) else "changed"
            merged = mine
            if outcome == "resolved":
                merged = dict(base[1]) | {k: v for k, v in mine.items() if k in warc.UPDATED_HEADERS}
            out[capture] = (base and base[0], outcome, base[2] if outcome == "resolved" else None, merged)
        elif status == 200 and page is not None and at is not None:
            done[page] = (capture, headers, digest)
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_matches_a_plain_loop(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    dice = random.Random(block)
    rows = []
    for k in range(300):
        status = dice.choice([200, 304, 304, 404])
        headers = {"content-type": "t" + str(k), "date": str(k), "x-own": "y"}
        if dice.random() < 0.7:
            headers["etag"] = dice.choice("ab")
        if dice.random() < 0.4:
            headers["last-modified"] = dice.choice("cd")
        url = dice.choice(["http://a/1", "https://www.a/1#x", "https://b/2?ref=1", "http://b/2", None])
        at = None if dice.random() < 0.03 else dice.randrange(60)
        rows.append((k, url, at, status, None if dice.random() < 0.05 else headers, f"d{k}"))
    found = {r.capture: (r.base, r.outcome, r.digest, r.headers) for r in warc.resolve(frame(spark, rows + rows[:20])).collect()}
    assert found == plain(rows)


def test_empty(spark):
    assert warc.resolve(frame(spark, [])).collect() == []
    assert warc.resolve(frame(spark, [(None, "http://a/1", 1, 304, {}, None)])).collect() == []
