"""Ranks against a plain version that scores every document."""

import math
import random
import re

import pytest
from terraloom.llm import lexical_search
from terraloom.llm.lexical_search import build_index, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=20):
    own = [(i, terms(t)) for i, t in docs]
    own = [(i, t) for i, t in own if t]
    n, total = len(own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for doc, t in own:
            score = 0
            for x in terms(text):
                if tf := t.count(x):
                    m = 100 - 25 + (25 * len(t) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        scored.sort(key=lambda s: s[:3])
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(scored[:k])]
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id long, text string, term string, item int")


def corpus(seed, count):
    r = random.Random(seed)
    words = [f"W{k}" for k in range(200)] + ["É", "naïve", "x_y"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(i, " ".join(r.choices(words, weights, k=r.choice([1, 3, 20, 60])))) for i in range(count)]


def test_ranks_equal_the_plain_version(spark, documents, items, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK", 4)
    monkeypatch.setattr(lexical_search, "WINDOW", 16)
    docs = corpus(1, 700)
    asks = [(i, t) for i, (_, t) in enumerate(corpus(2, 40))]
    assert result(ranked(documents(docs), items(asks), 5)) == plain(docs, asks, 5)
    monkeypatch.setattr(lexical_search, "ITEM_TERMS", 200)
    monkeypatch.setattr(lexical_search, "SHARD_POSTINGS", 700)
    assert result(ranked(documents(docs), items(asks))) == plain(docs, asks)


def test_blocks_are_rejected_unopened(spark, documents):
    """A frequent term's blocks stay packed once rare terms have filled the heap."""
    lexical_search_docs = [(i, "common " + ("rare " * 3 if i % 50 == 0 else "other thing " * (i % 7))) for i in range(3000)]
    index, frequencies, n = build_index(documents(lexical_search_docs).coalesce(1))
    held = index.where("shard = 0").sort("term", "block").toArrow().to_batches()
    shard = lexical_search.Shard(held)
    df = {r["term"]: r["df"] for r in frequencies.collect()}
    lists = [(t, lexical_search.weight(df[t], n), max(x.peak.tolist())) for t, x in shard.lists.items() if df[t] in (60, 3000)]
    at, score = shard.best(lists, 2)
    assert len(at) == 2 and score[0] >= score[1] > 0
    common = next(x for t, x in shard.lists.items() if df[t] == 3000)
    assert len(common.open) < len(common.packed)


def test_defined_cases(spark, documents, items):
    docs = [(3, "alpha beta"), (2, "alpha beta"), (2, "alpha beta"), (None, "alpha beta"), (5, None), (6, ""), (7, "- _ !"), (8, "gamma " * 40000), (9, "ALPHA-Beta É")]
    asks = [(1, "Alpha alpha beta"), (2, None), (3, "?!"), (4, "nowhere"), (5, "é É gamma"), (5, "gamma"), (None, "beta")]
    assert result(ranked(documents(docs), items(asks))) == plain(docs, asks)
    assert ranked(documents(docs[:0]), items(asks)).count() == 0
    assert ranked(documents(docs), items(asks[:0])).count() == 0
