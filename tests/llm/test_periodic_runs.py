"""Runs against a plain version that tries every lag of every text."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from terraloom.llm.periodic_runs import find_runs, planted, run_digests, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    out = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_row(doc, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode()) if doc is not None else 1
    if plant and doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc, len(found), *top, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def texts(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        vocabulary = [f"w{k}" for k in range(r.choice([1, 2, 3, 8, 60]))]
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 90))]
        for _ in range(r.randrange(0, 3)):
            unit = [r.choice(vocabulary) for _ in range(r.randrange(1, 12))]
            at = r.randrange(0, len(words) + 1)
            words[at:at] = (unit * 9)[: r.randrange(1, 9 * len(unit) + 1)]
        yield r.choice([" ", "\n", "\t "]).join(words)


def test_find_runs_equals_every_lag():
    for text in texts(5, 600):
        words = text.split()
        ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
        hashed = np.array([ids[w] * 0x9E3779B97F4A7C15 % 2**64 for w in words], np.uint64)
        start, end, period = find_runs(hashed, np.zeros(len(words), np.int64))
        assert sorted(zip(start.tolist(), (end - start).tolist(), period.tolist(), strict=True)) == plain_runs(words), text


def test_runs_do_not_cross_texts(spark, documents):
    docs = documents([(1, "a a a a"), (2, "a a a a"), (3, "x " + "b c " * 4)])
    assert [tuple(r) for r in runs(docs).collect()] == [(3, 1, 8, 2)]


def test_digests_equal_the_plain_version(spark, documents):
    rows = [(i, t) for i, t in enumerate(texts(8, 400))]
    got = sorted(tuple(r) for r in planted(documents(rows)).collect())
    assert got == sorted(plain_row(i, t, True) for i, t in rows)


def test_defined_cases(spark, documents):
    long = "start " + "x y z " * 30000 + "end"
    same = "na " * 40
    rows = [(0, None), (1, ""), (2, " \n"), (None, "é " * 7), (5, long), (6, same), (6, same), (7, "a b c d e f"), (8, "a a a b a a a b a a a b a a a b")]
    got = sorted((tuple(r) for r in run_digests(documents(rows)).collect()), key=repr)
    want = [plain_row(i, t, False) for i, t in rows if t is not long]
    base = hashlib.sha256(b"start x y z end").hexdigest()
    want.append((5, 1, 1, 90000, 3, 30000000, hashlib.sha256(b"1,90000,3\n").hexdigest(), base))
    assert got == sorted(want, key=repr)
    assert planted(documents(rows)).where("doc_id IS NULL").first()["n_runs"] == 1
    empty = documents(rows).limit(0)
    assert run_digests(empty).count() == 0 and runs(empty).count() == 0
