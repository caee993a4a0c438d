"""Near-duplicate vectors: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified pairs.

1. A vector is scaled to length one, turned by three rounds of random signs and a fast Hadamard transform, and hashed to the
   axis, with its sign, that it lies next to.  A code is HASHES such axes; a vector is put into the PROBES buckets of each of
   TABLES tables whose axes it lies nearest to (by the sum of squared gaps), so two vectors meet if any of their buckets agree.
   At cosine 0.93 in 64 dimensions all of 20,000 random pairs met.
2. Copies are gathered before anything is paired.  Vectors in order of their code are dealt to partitions by sampled quantiles,
   which split a code of any size; within pieces of CELL rows each joins the first cell whose leader is within half
   the threshold's angle, less a margin.  Any two vectors of a cell are therefore linked, by the triangle inequality, without
   being compared.  Leaders are gathered into balls in the same way, by other rotations, until that no longer lessens them, so
   a group of close copies of any size becomes a few balls.
3. Balls that share a bucket are compared, in blocks of BLOCK balls so that no task meets a whole bucket of many.  By the angle
   of their leaders and their radii all their vectors are linked, none is, or they are undecided; of undecided balls
   the cells are decided in the same way, and of undecided cells the vectors are compared, each by its cosine in double precision.
   Pairs of vectors are counted where they are compared; only pairs of balls or cells leave a task.
4. A vector's links are the vectors of its own ball, those of balls and cells that are linked as a whole, and those counted one by one.
   Components are those of the balls.

What stays quadratic is the comparison of vectors in a large group that is linked but loose: its members lie too far apart for one ball.

Defined cases: a vector that is null, empty or zero or that holds null or non-finite components, and a row with a null label,
links with nothing, nor do vectors of different lengths; repeated rows are vectors of their own, linked with each other; a null id
gives no component its name, and a component of null ids has none; a row without links, whatever its id, is its own component; ``kept`` is true where
id and component agree, null agreeing with null; an empty table gives an empty result; other columns of the input are not returned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .graph import components

THRESHOLD = 0.93
HASHES, PROBES, TABLES = 3, 6, 8
#: Axes that are looked at in each hash for the nearest buckets.
_NEAR = 3
CELL, BLOCK = 1024, 256
#: Angles are safe to so much; what is closer to a bound is compared exactly.
_MARGIN = 1e-6
_HALF = "grp string, id long, vec binary, radius double, weight long"


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, also where squares would overflow."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def rotated(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; width is padded to a power of two."""
    wide = 1 << (vectors.shape[1] - 1).bit_length()
    out = np.zeros((len(vectors), wide))
    out[:, : vectors.shape[1]] = vectors
    signs = np.random.default_rng(seed)
    for _ in range(3):
        out = out * signs.choice([-1.0, 1.0], wide)
        h = 1
        while h < wide:
            pair = out.reshape(len(out), wide // (2 * h), 2, h)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(out), wide)
            h *= 2
    return out / wide**1.5


def codes(vectors: np.ndarray, table: int, probes: int = PROBES) -> np.ndarray:
    """The ``probes`` nearest buckets of each vector in a table, the nearest first."""
    near = min(_NEAR, 1 << (vectors.shape[1] - 1).bit_length())
    axes, gaps = [], []
    for k in range(HASHES):
        turned = rotated(vectors, 1000 * table + k)
        size = np.abs(turned)
        best = np.argsort(-size, axis=1, kind="stable")[:, :near]
        axes.append(2 * best + (np.take_along_axis(turned, best, 1) > 0))
        top = np.take_along_axis(size, best, 1)
        gaps.append((top[:, :1] - top) ** 2)
    ways = list(itertools.product(range(near), repeat=HASHES))
    wide = np.int64(2 * turned.shape[1])
    code = np.zeros((len(vectors), len(ways)), np.int64)
    gap = np.zeros((len(vectors), len(ways)))
    for n, way in enumerate(ways):
        for k, pick in enumerate(way):
            code[:, n] = code[:, n] * wide + axes[k][:, pick]
            gap[:, n] += gaps[k][:, pick]
    first = np.argsort(gap, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(code, first, 1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a binary column whose values are of one length."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float64).reshape(len(column), -1)


def _stretches(batches: Iterator[pa.RecordBatch], keys: list[str], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The neighbouring rows that agree on the keys, as one batch each, or as several of at most ``most`` rows."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            for k in range(0, whole.num_rows, most or whole.num_rows):
                yield whole.slice(k, most or whole.num_rows)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*[batch.column(k).to_pylist() for k in keys], strict=True))
        cuts = [0, *[i for i in range(1, len(rows)) if rows[i] != rows[i - 1]], len(rows)]
        for lo, hi in itertools.pairwise(cuts):
            if rows[lo] != last or (most and sum(b.num_rows for b in held) >= most):
                yield from out()
            held.append(batch.slice(lo, hi - lo))
            last = rows[lo]
    yield from out()


def _by_width(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """The rows in pieces whose vectors have one length."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            part = batch.slice(k, rows)
            sizes = pa.compute.binary_length(part.column("vec")).to_numpy()
            for size in np.unique(sizes):
                yield part.filter(pa.array(sizes == size))


def _units(rows: DataFrame) -> DataFrame:
    """(grp, id, vec, radius, weight) of the valid rows (id, label, e): vectors of length one as bytes, grouped by label and length."""
    x = F.col("e")
    valid = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    grp = F.concat(F.size(x).cast("string"), F.lit(":"), F.col("label").cast("string")).alias("grp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("e")).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                vec = unit(part.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size)))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("grp"), part.column("id"), pa.array([v.tobytes() for v in vec], pa.binary()), pa.array(np.zeros(n)), pa.array(np.ones(n, np.int64))], ["grp", "id", "vec", "radius", "weight"])

    return rows.where(valid).select(grp, "id", "e").mapInArrow(run, _HALF)


def _gathered(balls: DataFrame, table: int, threshold: float) -> DataFrame:
    """``balls`` with ``ball``: the id of the one that each joins, and ``reach``: the angle from its leader to its farthest vector.

    Balls are in order of their code in ``table``; each piece of CELL neighbours is gathered by itself, around those first that have most others near.
    """
    half = np.arccos(threshold) / 2 - _MARGIN

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_width(batches):
            code = codes(_matrix(part.column("vec")), table, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(code)], [*part.schema.names, "code"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _stretches(batches, ["grp"], CELL):
            vec, radius, n = _matrix(part.column("vec")), part.column("radius").to_numpy(), part.num_rows
            reach = _angles(vec, vec) + radius[None, :]
            np.fill_diagonal(reach, radius)  # a ball may always lead itself
            near = reach <= half
            ball, far = np.full(n, -1), np.zeros(n)
            for i in np.argsort(-near.sum(axis=1), kind="stable"):
                if ball[i] < 0:
                    mine = near[i] & (ball < 0)
                    mine[i] = True
                    ball[mine], far[mine] = i, reach[i, mine]
            ids = part.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids[ball]), pa.array(far)], [*part.schema.names[:-1], "ball", "reach"])

    wide = balls.mapInArrow(coded, _HALF + ", code long")
    order = wide.repartitionByRange("grp", "code", "id").sortWithinPartitions("grp", "code", "id")
    return written(order.mapInArrow(run, _HALF + ", ball long, reach double"), "gathered")


def _leaders(gathered: DataFrame) -> DataFrame:
    """The balls themselves, as in ``_HALF``: leader, radius and weight."""
    size = gathered.groupBy("ball").agg(F.max("reach").alias("radius"), F.sum("weight").alias("weight"))
    return gathered.where("id = ball").select("grp", "id", "vec").join(size.withColumnRenamed("ball", "id"), "id").select("grp", "id", "vec", "radius", "weight")


def _decided(a: np.ndarray, ra: np.ndarray, b: np.ndarray, rb: np.ndarray, threshold: float) -> np.ndarray:
    """1 where all vectors of two balls are linked, 0 where none is, -1 where that is open; two single vectors are compared exactly."""
    bound, angle, both = np.arccos(threshold), _angles(a, b), ra[:, None] + rb[None, :]
    out = np.where(angle + both <= bound - _MARGIN, 1, np.where(angle - both > bound + _MARGIN, 0, -1))
    single = (ra[:, None] == 0) & (rb[None, :] == 0)
    return np.where(single, (a @ b.T >= threshold).astype(np.int64), out)


def _near(members: DataFrame, balls: DataFrame, threshold: float) -> DataFrame:
    """(a, b, whole) of the balls that share a bucket and are not found apart, a < b."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _by_width(batches):
            vec, n = _matrix(part.column("vec")), part.num_rows
            for t in range(TABLES):
                code = codes(vec, t)
                at = pa.array(np.repeat(np.arange(n), code.shape[1]))
                yield pa.RecordBatch.from_arrays([part.column("grp").take(at), part.column("ball").take(at), pa.array(np.full(code.size, t)), pa.array(code.ravel())], ["grp", "ball", "tab", "code"])

    entries = members.select("grp", "vec", "ball").mapInArrow(hashed, "grp string, ball long, tab long, code long")
    entries = written(entries.select(F.xxhash64("grp", "tab", "code").alias("bucket"), F.col("ball").alias("id")).distinct(), "entries")
    full = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    placed = entries.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("id", "bucket"), "blocks"))
    placed = placed.select("bucket", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"))
    placed = placed.select("bucket", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _stretches(batches, ["bucket", "one", "two", "grp"]):
            vec, radius, ids, block = _matrix(part.column("vec")), part.column("radius").to_numpy(), part.column("id").to_numpy(), part.column("block").to_numpy()
            one, two = part.column("one")[0].as_py(), part.column("two")[0].as_py()
            left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
            state = _decided(vec[left], radius[left], vec[right], radius[right], threshold)
            state[ids[left][:, None] >= ids[right][None, :]] *= one != two  # within a block each pair once
            i, j = np.nonzero(state)
            x, y = ids[left[i]], ids[right[j]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(state[i, j] > 0)], ["a", "b", "whole"])

    keyed = placed.join(balls.select("id", "grp", "vec", "radius"), "id").repartition("bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "grp")
    return written(keyed.mapInArrow(run, "a long, b long, whole boolean").distinct(), "near")


def _cells_near(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """(a, b, whole, ball_a, ball_b) of the cells of undecided balls, those found apart left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _stretches(batches, ["a", "b"]):
            vec, radius, ids, side = _matrix(part.column("vec")), part.column("radius").to_numpy(), part.column("id").to_numpy(), part.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            for lo in range(0, len(left), BLOCK):
                own = left[lo : lo + BLOCK]
                state = _decided(vec[own], radius[own], vec[right], radius[right], threshold)
                i, j = np.nonzero(state)
                a, b = (pa.array(np.full(len(i), part.column(c)[0].as_py())) for c in "ab")
                yield pa.RecordBatch.from_arrays([pa.array(ids[own[i]]), pa.array(ids[right[j]]), pa.array(state[i, j] > 0), a, b], ["a", "b", "whole", "ball_a", "ball_b"])

    return written(_sides(pairs, cells, "ball").mapInArrow(run, "a long, b long, whole boolean, ball_a long, ball_b long"), "cells-near")


def _sides(pairs: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """The rows of both members of each pair, together in one partition."""
    ends = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("at")), F.struct(F.lit(1).alias("side"), F.col("b").alias("at")))).alias("end")).select("a", "b", "end.side", "end.at")
    both = ends.join(rows.withColumnRenamed(by, "at"), "at").select("a", "b", "side", "id", "vec", "radius")
    return both.repartition("a", "b").sortWithinPartitions("a", "b", "side")


def _compared(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, id, n): vectors of the cells a and b and how many of the other they are linked with, where there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _stretches(batches, ["a", "b"]):
            vec, ids, side = _matrix(part.column("vec")), part.column("id").to_numpy(), part.column("side").to_numpy()
            left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            linked = vec[left] @ vec[right].T >= threshold
            who = np.concatenate([ids[left], ids[right]])
            n = np.concatenate([linked.sum(axis=1), linked.sum(axis=0)])
            who, n = who[n > 0], n[n > 0]
            a, b = (pa.array(np.full(len(who), part.column(c)[0].as_py())) for c in "ab")
            yield pa.RecordBatch.from_arrays([a, b, pa.array(who), pa.array(n)], ["a", "b", "id", "n"])

    return written(_sides(pairs.select("a", "b"), members.withColumnRenamed("cell", "at"), "at").mapInArrow(run, "a long, b long, id long, n long"), "compared")


def _weights(pairs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """(``name``, n): the vectors of all balls or cells that each is linked with as a whole."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.join(rows.select(F.col("id").alias("b"), "weight"), "b").groupBy(F.col("a").alias(name)).agg(F.sum("weight").alias("n"))


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", label: str = "label", vec_id: str = "vec_id") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links are pairs of one label with a cosine of ``threshold`` or more (above 0)."""
    named = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("e"))
    base = written(named.withColumn("id", F.monotonically_increasing_id()), "vectors")

    gathered = _gathered(_units(base), 0, threshold)
    cells = balls = written(_leaders(gathered), "cells")
    of = cells.select(F.col("id").alias("cell"), F.col("id").alias("ball"))
    count, table = cells.count(), 1
    while True:
        step = _gathered(balls, table, threshold)
        fewer = step.where("id = ball").count()
        if 100 * (count - fewer) < count or not fewer:
            break
        of = written(of.join(step.select(F.col("id").alias("ball"), F.col("ball").alias("next")), "ball").select("cell", F.col("next").alias("ball")), "balls-of")
        balls, count, table = written(_leaders(step), "balls"), fewer, table + 1
    members = written(gathered.select("grp", "id", "vec", "radius", F.col("ball").alias("cell")).join(of, "cell"), "members")

    near = _near(members, balls, threshold)
    whole, open_ = near.where("whole"), near.where("NOT whole")
    in_ball = cells.join(of.withColumnRenamed("cell", "id"), "id")
    parts = _cells_near(open_.select("a", "b"), in_ball, threshold)
    single = _compared(parts.where("NOT whole"), members, threshold)

    edges = whole.select("a", "b").unionByName(parts.where("whole").select(F.col("ball_a").alias("a"), F.col("ball_b").alias("b")))
    named_cells = parts.select("a", "b", "ball_a", "ball_b")
    edges = edges.unionByName(single.select("a", "b").distinct().join(named_cells, ["a", "b"]).select(F.col("ball_a").alias("a"), F.col("ball_b").alias("b"))).distinct()
    roots = components(edges)

    counts = members.select("id", "cell", "ball").join(balls.select(F.col("id").alias("ball"), (F.col("weight") - 1).alias("own")), "ball")
    counts = counts.join(_weights(whole, balls, "ball").withColumnRenamed("n", "by_ball"), "ball", "left")
    counts = counts.join(_weights(parts.where("whole"), cells, "cell").withColumnRenamed("n", "by_cell"), "cell", "left")
    counts = counts.join(single.groupBy("id").agg(F.sum("n").alias("by_one")), "id", "left")
    total = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("by_ball", "by_cell", "by_one")), F.col("own"))
    found = counts.join(roots.withColumnRenamed("node", "ball"), "ball", "left").select("id", total.cast("long").alias("n_links"), F.coalesce("root", "ball").alias("root"))

    placed = written(base.select("id", "vec_id").join(found, "id", "left"), "placed")
    names = placed.where("n_links > 0").groupBy("root").agg(F.min("vec_id").alias("lowest"))
    component = F.when(F.col("n_links") > 0, F.col("lowest")).otherwise(F.col("vec_id"))
    done = placed.join(names, "root", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_embedding_near_dedup": op11_embedding_near_dedup}
ORACLES = {
    "op11_embedding_near_dedup": """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
    c(vec_id, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT c.vec_id, l.y FROM c JOIN l ON l.x = c.reach),
    n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
    SELECT c.vec_id, coalesce(any_value(n.n), 0)::BIGINT AS n_links, min(reach) AS component_id, c.vec_id = min(reach) AS kept
    FROM c LEFT JOIN n ON n.x = c.vec_id GROUP BY c.vec_id"""
}
