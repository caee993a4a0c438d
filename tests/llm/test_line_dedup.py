import random
import re

from terraloom.llm import line_dedup
from terraloom.llm._shared import written
from terraloom.llm.line_dedup import MIN_WORDS, _cleaned, _keyed, _texts, dedup_lines, repeated_runs, suffix_array


def brute(rows, min_words=MIN_WORDS):
    """Lines kept per document, by comparing every pair of places."""
    rows = sorted(set((i, t or "") for i, t in rows))
    places = []
    for d, (_, t) in enumerate(rows):
        for no, line in enumerate(t.split("\n")):
            if n := len(re.findall(r"[^\x20\x09-\x0D]+", line)):
                places.append((d, no, line, n))
    gone = set()
    for i in range(len(places)):
        for j in range(i):
            n = words = 0
            while i + n < len(places) and places[i + n][0] == places[i][0] and places[j + n][0] == places[j][0] and places[i + n][2] == places[j + n][2]:
                words += places[i + n][3]
                n += 1
            if words >= min_words:
                gone |= {places[k][:2] for k in range(i, i + n)}
    return {row[0]: [k for k in range(len(row[1].split("\n"))) if (d, k) not in gone] for d, row in enumerate(rows)}


def test_runs_against_brute_force(spark, documents):
    rng = random.Random(5)
    lines = ["a", "b c", "d", "e f g", "long line of more than five words", "", "  ", "é ü", "h i j k l"]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.8 else f"own {rng.random()}" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "x " * 5000)]
    rows = [(rng.getrandbits(60), t) for _, t in rows] + [(rng.getrandbits(60), rows[k][1]) for k in range(5)]  # scattered ids, and copies
    for words in (1, 4, MIN_WORDS, 9):
        got = {r.doc_id: (r.deleted, r.n_lines, r.kept) for r in _cleaned(documents(rows), words, "text", "doc_id").collect()}
        expected = brute(rows, words)
        for i, t in rows:
            every = (t or "").split("\n")
            assert [k for k in range(len(every)) if k not in set(got[i][0])] == expected[i], (words, i)
            assert got[i][1] == len(every)
            assert got[i][2] == "\n".join(every[k] for k in expected[i])


def test_defined_cases(spark, documents):
    run = "one two three four five six"
    rows = [(None, run), (1, run), (1, run), (2, f"short\n{run}\nshort"), (3, None), (4, "")]
    out = dedup_lines(documents(rows))
    assert out.columns == documents(rows).columns
    got = sorted(((r.doc_id is not None, r.doc_id, r.text, r.n_chars) for r in out.collect()), key=repr)
    assert got == sorted([(False, None, run, len(run)), (True, 2, "short\nshort", 11), (True, 3, None, None), (True, 4, "", 0)], key=repr)
    assert dedup_lines(documents([])).count() == 0


def test_suffix_array_and_maximal_runs(spark, documents, monkeypatch):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(30)]
    passage = "\n".join(f"line {k} of a passage" for k in range(37))
    texts += [f"own {k}\n{passage}\nmore {k}" for k in range(3)]
    docs = documents(list(enumerate(texts)))
    for limit in (500_000, 0):
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", limit)
        keyed = _keyed(docs, "text", "doc_id")
        places = written(_texts(keyed), "texts")
        start = {r.start: r.row_key for r in places.collect()}
        said = {r.row_key: r.text.split("\n") for r in keyed.collect()}
        rows = sorted(suffix_array(keyed, places).collect(), key=lambda r: (r.r, r.pos))
        every = [x for t in said.values() for x in t]
        tails = []
        for r in rows:
            tail = said[start[r.start]][r.at :]
            single = next((k for k, x in enumerate(tail) if every.count(x) == 1), len(tail))
            tails.append(tail[:single])
        common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        for i in range(len(rows)):
            low = len(tails[i])
            for j in range(i + 1, len(rows)):
                low = min(low, common(tails[j - 1], tails[j]))
                assert common(tails[i], tails[j]) == low
            assert (i > 0 and rows[i - 1].r == rows[i].r) == (i > 0 and tails[i - 1] == tails[i])
            assert rows[i].r == next(k for k in range(len(rows)) if tails[k] == tails[i])
        runs = {(r.doc_id, r.line, r.lines, r.copies) for r in repeated_runs(docs).collect()}
        assert (31, 1, 37, 3) in runs and (32, 1, 37, 3) in runs and not any(r[0] == 30 for r in runs)


def plain_runs(rows, min_words):
    """Maximal runs with an earlier copy, by comparing every pair of places of texts that differ."""
    said, out = {}, set()
    for i, t in sorted(set(rows)):
        lines = [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)]
        if t in said.values():
            if sum(n for *_, n in lines) >= min_words:
                out.add((i, lines[0][0], len(lines), 0))
        else:
            said[i] = t
    order = sorted(said)
    lines = {i: [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(said[i].split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for i in order}
    keys = {i: [x for _, x, _ in lines[i]] for i in order}

    def common(a, p, b, q):
        n = 0
        while p + n < len(keys[a]) and q + n < len(keys[b]) and keys[a][p + n] == keys[b][q + n]:
            n += 1
        return n

    for i in order:
        earlier = lambda p: max([common(i, p, j, q) for j in order if j <= i for q in range(len(keys[j])) if j < i or q < p], default=0)
        most = [earlier(p) for p in range(len(keys[i]))]
        for p, n in enumerate(most):
            if n and (p == 0 or most[p - 1] - 1 < n) and sum(w for *_, w in lines[i][p : p + n]) >= min_words:
                copies = sum(keys[j][q : q + n] == keys[i][p : p + n] for j in order for q in range(len(keys[j])))
                out.add((i, lines[i][p][0], n, copies))
    return out


def test_runs_are_maximal(spark, documents):
    rng = random.Random(8)
    whole = [f"{c}{c} one two three four" for c in "abcdefg"]
    rows = [(0, "\n".join(["own 0", *whole[:5], "end 0"])), (1, "\n".join(["own 1", *whole, "end 1"])), (3, "\n".join(["own 3", *whole, "end 3"]))]
    got = lambda rows, words: sorted(tuple(r) for r in repeated_runs(documents(rows), words).collect())
    assert got(rows, MIN_WORDS) == [(1, 1, 5, 3), (3, 1, 7, 2)] == sorted(plain_runs(rows, MIN_WORDS))
    passage = [f"line {k} of it" for k in range(23)]
    for n in range(40):
        a, b = sorted((rng.randrange(24), rng.randrange(24)))
        rows.append((10 + n, "\n".join(rng.choices(["x", "y z", "", " "], k=rng.randrange(5)) + passage[a:b] + rng.choices(["x", "y z", "u"], k=rng.randrange(9)))))
    rows += [(200, rows[5][1]), (201, rows[1][1]), (202, ""), (203, "x"), (204, "\n\nx y z u v w\n")]
    for words in (1, 6):
        assert got(rows, words) == sorted(plain_runs(rows, words)), words
    assert got([], MIN_WORDS) == []
