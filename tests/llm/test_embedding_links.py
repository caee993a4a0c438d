"""Links of vectors against all pairs."""

import numpy as np
import pytest
from terraloom.llm import embedding_links
from terraloom.llm.embedding_links import codes, near_vectors, rotated, unit

SCHEMA = "vec_id long, embedding array<float>, label int, ball string, radius double"


def plain(rows):
    """[(vec_id, n_links, component_id, kept)] by all pairs."""
    usable = [i for i, (_, e, label) in enumerate(rows) if label is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = {i: set() for i in range(len(rows))}
    vecs = {i: np.array(rows[i][1], np.float32).astype(float) for i in usable}
    for i in usable:
        for j in usable:
            if i != j and rows[i][2] == rows[j][2] and len(vecs[i]) == len(vecs[j]):
                a, b = vecs[i], vecs[j]
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                    links[i].add(j)
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((vec, len(links[i]), low, vec == low))
    return sorted(out, key=repr)


def made(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], label, "x", 1.0) for i, e, label in rows], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def around(rng, centre, cosine):
    g = rng.normal(size=len(centre))
    g -= g @ centre * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * g / np.linalg.norm(g)


@pytest.fixture(scope="module")
def groups():
    """Close copies, loose groups around the threshold, chains and lone vectors."""
    rng, rows = np.random.default_rng(3), []
    for label in (0, 1):
        for cosine, size in ((0.999, 60), (0.98, 40), (0.968, 40), (0.96, 30)):
            centre = unit(rng.normal(size=(1, 64)))[0]
            rows += [(around(rng, centre, cosine), label) for _ in range(size)]
        step = unit(rng.normal(size=(1, 64)))[0]
        for _ in range(20):
            step = around(rng, step, 0.94)
            rows.append((step, label))
        rows += [(unit(rng.normal(size=(1, 64)))[0], label) for _ in range(60)]
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in np.float32(rows[k][0] * (1 + i % 3))], rows[k][1]) for i, k in enumerate(order)]


def test_equals_all_pairs(spark, groups):
    assert result(near_vectors(made(spark, groups))) == plain(groups)


def test_small_cells_and_blocks_change_nothing(spark, groups, monkeypatch):
    monkeypatch.setattr(embedding_links, "CELL", 16)
    monkeypatch.setattr(embedding_links, "BLOCK", 4)
    assert result(near_vectors(made(spark, groups))) == plain(groups)


def test_rotation_keeps_lengths_and_codes_find_pairs():
    rng = np.random.default_rng(1)
    a = unit(rng.normal(size=(2000, 64)))
    assert np.allclose(np.linalg.norm(rotated(a, 5), axis=1), 1)
    b = np.stack([around(rng, x, 0.93) for x in a])
    met = np.zeros(len(a), bool)
    for t in range(embedding_links.TABLES):
        met |= (codes(a, t)[:, :, None] == codes(b, t)[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.999


def test_defined_cases(spark):
    e = [1.0, 2.0, 3.0]
    rows = [
        (5, e, 1), (4, [2.0, 4.0, 6.0], 1), (5, e, 1), (6, e, 2), (7, e, None), (8, None, 1), (9, [], 1), (10, [0.0, 0.0, 0.0], 1), (11, [1.0, None, 3.0], 1),
        (12, [float("nan"), 1.0, 1.0], 1), (13, [float("inf"), 1.0, 1.0], 1), (14, [1.0, 2.0], 1), (None, [-1.0, 1.0, 0.0], 1), (None, [-1.0, 1.0, 0.0], 1), (None, e, 2), (3, [3e38, 3e38, 0.0], 3), (2, [1e-38, 1e-38, 0.0], 3),
        (20, [1.0], 4), (21, [2.0], 4), (22, [-1.0], 4),
    ]
    assert result(near_vectors(made(spark, rows))) == plain(rows)
    assert near_vectors(made(spark, rows[:0])).count() == 0
    assert near_vectors(made(spark, [(1, None, None)])).collect() == [(1, 0, 1, True)]
