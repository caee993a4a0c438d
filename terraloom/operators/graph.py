"""Loops over edges: components, label propagation, shortest paths, growth. Each round is written to the shared folder."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of ``nodes`` (id) under undirected ``edges`` (src, dst) between them; component is the least id.

    In a round every root with edges hooks to its neighbour of least rank, a hash drawn anew.  Two steps on the rank is never greater, so cycles are
    pairs, of which the lesser stays a root; the trees are flattened by jumping, and only distinct edges between their roots go on.  At most half of these
    roots are left by a round, whatever the order of the ids: least ids themselves may pass on by single steps, in as many rounds as a component is wide.
    """
    nodes = cut(nodes.select("id").distinct())
    known = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
    edges = cut(_between(known.select("src", "dst")))
    trees = None
    for k in count():
        if edges.isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("rank"), F.col(c).alias("id"))  # noqa: B023, E731
        roots = cut(both.groupBy(F.col("src").alias("id")).agg(F.min(rank("dst"))["id"].alias("root")))
        while True:
            up = roots.select(F.col("id").alias("root"), F.col("root").alias("up"))
            at = F.when(F.col("up") == F.col("id"), F.least(rank("id"), rank("root"))["id"]).otherwise(F.col("up"))
            roots = cut(roots.join(up, "root").select("id", at.alias("root"), (at != F.col("root")).alias("moved")))
            if roots.where("moved").isEmpty():
                break
        roots = roots.select("id", "root")
        ends = {c: roots.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")) for c in ("src", "dst")}
        edges = cut(_between(edges.join(ends["src"], "src").join(ends["dst"], "dst").select(F.col("src_root").alias("src"), F.col("dst_root").alias("dst"))))
        if trees is None:
            trees = roots
        else:
            trees = cut(trees.join(roots.select(F.col("id").alias("root"), F.col("root").alias("up")), "root", "left").select("id", F.coalesce("up", "root").alias("root")))
    if trees is None:
        return nodes.select("id", F.col("id").alias("component"))
    named = trees.join(trees.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")
    return cut(nodes.join(named, "id", "left").select("id", F.coalesce("component", "id").alias("component")))


def _between(edges: DataFrame) -> DataFrame:
    """Distinct undirected edges, the lesser end first, without loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


#: Weights of border, neighbours and evidence (fixed values).
BORDER, NEIGHBOURS, EVIDENCE = 0.50, 0.20, 0.30


def propagate(nodes: DataFrame, edges: DataFrame, evidence: DataFrame | None = None, voters: DataFrame | None = None) -> DataFrame:
    """Labels for ``nodes`` (id, code or null) from labelled neighbours over ``edges`` (src, dst, shared), all open nodes at once per round.

    A neighbours' code has the weighted sum of its shared border, its neighbours and its ``evidence`` (id, code, score), if given, each as a share
    of the greatest among the node's candidate codes; ties go to the least code. Returns (id, code, round); round 0 had a label, null never got one.
    A node votes ``n`` times, if it has that column; ``voters`` (dst, code, n), if given, vote besides from the start.
    """
    times = F.col("n").cast("long") if "n" in nodes.columns else F.lit(1).cast("long")
    now = cut(nodes.select("id", "code", times.alias("n"), F.when(F.col("code").isNotNull(), F.lit(0)).alias("round")))
    edges, voters = cut(edges.select("src", "dst", "shared")), None if voters is None else cut(voters.select("dst", "code", "n"))
    for k in count(1):
        said = now.where("code IS NOT NULL").select(F.col("id").alias("dst"), "code", "n")
        votes = edges.join(now.where("code IS NULL").select(F.col("id").alias("src")), "src").join(said if voters is None else said.unionByName(voters), "dst")
        by_code = votes.groupBy("src", "code").agg(F.sum(F.col("shared") * F.col("n")).alias("shared"), F.sum("n").alias("n"))
        w = Window.partitionBy("src")
        share = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(w)), F.lit(0.0))
        score = share("shared") * BORDER + share("n") * NEIGHBOURS
        if evidence is not None:
            by_code = by_code.join(evidence.select(F.col("id").alias("src"), "code", F.col("score").cast("double").alias("seen")), ["src", "code"], "left").fillna(0.0, ["seen"])
            score = score + share("seen") * EVIDENCE
        best = by_code.withColumn("score", F.round(score, 9)).withColumn("__r", F.row_number().over(w.orderBy(F.desc("score"), "code"))).where("__r = 1").select(F.col("src").alias("id"), F.col("code").alias("new"))
        after = cut(now.join(best, "id", "left").select("id", F.coalesce("code", "new").alias("code"), "n", F.coalesce("round", F.when(F.col("new").isNotNull(), F.lit(k))).alias("round")))
        if after.where(F.col("round") == k).isEmpty():
            return after.drop("n")
        now = after


def propagate_agreed(nodes: DataFrame, edges: DataFrame, evidence: DataFrame | None = None, least: int = 3, share: float = 0.75, support: float = 0.20) -> DataFrame:
    """Labels for ``nodes`` (id, code or null) where labelled neighbours over ``edges`` (src, dst) agree, all open nodes at once per round.

    A code is taken where all labelled neighbours have it, or where ``least`` or more vote, ``share`` of them for it, and
    ``evidence`` (id, code, share), if given, has at least ``support`` for it. Returns (id, code, round); null never got one.
    """
    now = cut(nodes.select("id", "code", F.when(F.col("code").isNotNull(), F.lit(0)).alias("round")))
    for k in count(1):
        votes = edges.select("src", "dst").distinct().join(now.where("code IS NULL").select(F.col("id").alias("src")), "src").join(now.where("code IS NOT NULL").select(F.col("id").alias("dst"), "code"), "dst")
        by_code = votes.groupBy("src", "code").agg(F.count(F.lit(1)).alias("n"))
        best = by_code.withColumn("total", F.sum("n").over(Window.partitionBy("src"))).withColumnRenamed("src", "id")
        backed = F.lit(True)
        if evidence is not None:
            best = best.join(evidence.select("id", "code", F.col("share").alias("__share")), ["id", "code"], "left")
            backed = F.coalesce(F.col("__share"), F.lit(0.0)) >= support
        # With a share above one half at most one code passes.
        new = best.where((F.col("n") == F.col("total")) | (F.col("total") >= least) & (F.col("n") >= share * F.col("total")) & backed).select("id", F.col("code").alias("new"))
        after = cut(now.join(new, "id", "left").select("id", F.coalesce("code", "new").alias("code"), F.coalesce("round", F.when(F.col("new").isNotNull(), F.lit(k))).alias("round")))
        if after.where(F.col("round") == k).isEmpty():
            return after
        now = after


def multi_source_paths(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, dist, prefix, seed) of least cost from any of ``seeds`` (id, prefix, and seed if its name is not the id) over ``edges`` (src, dst, cost), ties by (dist, prefix, seed)."""
    named = F.col("seed" if "seed" in seeds.columns else "id").alias("seed")
    best = cut(seeds.select("id", F.struct(F.lit(0.0).alias("dist"), "prefix", named).alias("b")).groupBy("id").agg(F.min("b").alias("b")))
    edge = cut(edges.select("src", "dst", F.col("cost").cast("double").alias("cost")))
    front = best
    while True:
        step = edge.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), F.struct((F.col("b.dist") + F.col("cost")).alias("dist"), F.col("b.prefix").alias("prefix"), F.col("b.seed").alias("seed")).alias("b"))
        merged = cut(best.withColumn("old", F.lit(True)).unionByName(step.withColumn("old", F.lit(False))).groupBy("id").agg(F.min("b").alias("b"), F.min(F.when(F.col("old"), F.col("b"))).alias("was")))
        front = merged.where("was IS NULL OR b < was").select("id", "b")
        best = merged.select("id", "b")
        if front.isEmpty():
            return best.select("id", "b.dist", "b.prefix", "b.seed")


def grow(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, round): nodes reached from ``seeds`` (id) over ``edges`` (src, dst), breadth first."""
    found, edges = cut(seeds.select("id", F.lit(0).alias("round")).distinct()), cut(edges.select("src", "dst"))
    for k in count(1):
        front = found.where(F.col("round") == k - 1).select(F.col("id").alias("src"))
        new = edges.join(front, "src").select(F.col("dst").alias("id")).distinct().join(found.select("id"), "id", "left_anti").withColumn("round", F.lit(k))
        after = cut(found.unionByName(new))
        if after.where(F.col("round") == k).isEmpty():
            return found
        found = after


def greedy_independent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id): what a greedy pass in ascending (rank, id) would keep, each kept node ruling out its neighbours.

    ``nodes`` (id, rank), symmetric ``edges`` (src, dst). In a round, every open node that no open neighbour precedes is kept and
    its neighbours go: the rounds give the sequential result, with as many rounds as the longest chain of precedence.
    """
    left = cut(nodes.select("id", F.struct("rank", "id").alias("r")))
    ahead = left.select(F.col("id").alias("dst"), F.col("r").alias("rd"))
    # (src, dst) where dst comes before src.
    open_edges = cut(edges.select("src", "dst").join(left.select(F.col("id").alias("src"), F.col("r").alias("rs")), "src").join(ahead, "dst").where("rd < rs").select("src", "dst").distinct())
    kept, left = None, left.select("id")
    while True:
        won = cut(left.join(open_edges.select(F.col("src").alias("id")), "id", "left_anti"))
        kept = won if kept is None else kept.unionByName(won)
        gone = open_edges.join(won.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
        left = cut(left.join(won, "id", "left_anti").join(gone, "id", "left_anti"))
        if left.isEmpty():
            return kept
        open_edges = cut(open_edges.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi"))
