import random
import re

import numpy as np

from terraloom.llm import ngram_join
from terraloom.llm.ngram_join import jaccard_components, keep_one


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} - {()} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(s), low.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    common = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(2)]
    rows, texts = [], []
    for _ in range(90):
        n = rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20, 33, 40, 70, 140, 300])
        texts.append(" ".join(rng.choices(vocabulary, k=n)))
    for _ in range(130):  # near copies at all distances around the threshold
        words = rng.choice(texts).split()
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            k = rng.randrange(len(words)) if words else 0
            words[k : k + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 2))
        texts.append(" ".join(words))
    for _ in range(60):  # mostly a passage that many share
        texts.append(rng.choice(common) + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 12))))
    texts += ["", None, " \n\t", "The SAME", "the same", "the  same\n"]
    rng.shuffle(texts)
    rows = [(k * 3, t) for k, t in enumerate(texts)]
    return rows + [(rows[5][0], rows[5][1]), (rows[6][0], "an id again"), (None, rows[7][1]), (None, "lonely words here now and then")]


def test_components_against_brute_force(spark, documents):
    rows = corpus(1)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(documents(rows)).collect()), key=repr)
    assert got == brute(rows)


def test_keep_one(spark, documents):
    a = " ".join(f"a{k}" for k in range(30))
    rows = [(4, a), (2, a + " more"), (2, a + " more"), (7, "other words in this one here"), (8, None), (8, None), (9, "")]
    out = keep_one(documents(rows))
    assert out.columns == documents(rows).columns
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(2, a + " more"), (7, rows[3][1]), (8, ""), (8, ""), (9, "")]


def test_keep_one_by_component_not_by_id(spark, documents):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b + " more"), (3, c), (3, d), (9, c + " more"), (None, d + " more")]
    kept = sorted(((r.doc_id, r.text[0]) for r in keep_one(documents(rows)).collect()), key=repr)
    assert kept == [(3, "c"), (3, "d"), (None, "a"), (None, "b")]


def test_empty_table(spark, documents):
    assert jaccard_components(documents([])).count() == 0


def test_large_sets_against_brute_force(spark, documents):
    rng, texts = random.Random(4), []
    for n in (690, 720, 1000, 1030, 2040, 2060):
        base = [f"v{rng.randrange(10**6)}" for _ in range(n)]
        for share in (0.0, 0.01, 0.025, 0.028, 0.03, 0.035, 0.06):  # a word in the middle of others changes 5 shingles
            texts.append(" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base))
        texts += [" ".join(base[: n * 3 // 4]), " ".join(base[: n * 3 // 4 + 2])]
    rows = list(enumerate(texts))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(documents(rows)).collect()), key=repr)
    assert got == brute(rows) and 20 < len({c for _, _, c in got}) < len(rows)


def test_wide_sketches_pass_every_link():
    rng = np.random.default_rng(3)
    for n in (701, 1020, 1030, 4000):
        every = rng.integers(1 << 62, size=2 * n).astype(np.uint64)
        for m in (n, n * 9 // 8, n * 4 // 3):  # the lesser within the larger, which may have twice its bits
            a, b = ngram_join._wide(np.concatenate([every[:n], every[:m]]), np.repeat([0, 1], [n, m]), 2).to_pylist()
            assert 7 * ngram_join._flipped(a, b) <= 7 * (m - n) <= n + m and ngram_join._flipped(a, b) == ngram_join._flipped(b, a)


def test_texts_of_unlike_large_sets_are_not_fetched(spark, documents, monkeypatch):
    """Sets of 3,600 shingles, two and two with a passage in common: 1024 parities let them through, and all their texts were joined."""
    rng, fetched = random.Random(6), []
    rows = [(d, " ".join([f"v{rng.randrange(10**7)}" for _ in range(3000)] + [f"c{d // 2}-{k}" for k in range(600)])) for d in range(12)]

    def written(df, name, plain=ngram_join.written):
        out = plain(df, name)
        fetched.append(out.count() if name == "wanted" else 0)
        return out

    monkeypatch.setattr(ngram_join, "written", written)
    assert sorted(r.component_id for r in jaccard_components(documents(rows)).collect()) == list(range(12))
    assert sum(fetched) == 0
