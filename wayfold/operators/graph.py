"""Shortest paths by rounds of relaxation, from sources to all nodes or between given pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.sources.shared import release, saved


#: Nodes whose distances to all others bound the searches between pairs.
LANDMARKS = 8
#: States of a round that are sent to all edges; with more, edges are shuffled.
BROADCAST_FRONT = 1 << 16


def both_ways(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst", "weight_m").union(edges.select("dst", "src", "weight_m")).where("weight_m >= 0")
    return saved(both.groupBy("src", "dst").agg(F.min("weight_m").alias("weight_m")), "edges")


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, node, distance) over undirected edges (src, dst, weight_m) of weights that aren't negative.

    A round extends the paths that the last one improved by an edge and keeps the best of each pair; it
    ends when none improves, after as many rounds as the longest of the shortest paths has edges.  Each
    round's table is written to the shared folder, so lineage stays short.
    """
    both = both_ways(edges)
    state = saved(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("distance"), F.lit(True).alias("fresh")).distinct(), "paths")
    while not state.where("fresh").isEmpty():
        front = state.where("fresh").join(both, F.col("node") == F.col("src"))
        reached = front.select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("weight_m")).alias("distance"), F.lit(None).cast("double").alias("old"))
        known = state.select("source", "node", "distance", F.col("distance").alias("old"))
        best = known.union(reached).groupBy("source", "node").agg(F.min("distance").alias("distance"), F.min("old").alias("old"))
        older, state = state, saved(best.select("source", "node", "distance", (F.col("old").isNull() | (F.col("distance") < F.col("old"))).alias("fresh")), "paths")
        release(older)
    release(both)
    return state.drop("fresh")


def _stepped(front: DataFrame, n: int, edges: DataFrame, values: list[str]) -> DataFrame:
    """The nodes an edge from ``front`` of ``n`` states, with its values that much longer; a short front goes to the edges, which stay where they are."""
    met = (F.broadcast(front) if n <= BROADCAST_FRONT else front).join(edges, F.col("node") == F.col("src"))
    keys = [c for c in front.columns if c not in (*values, "node")]
    return met.select(*keys, F.col("dst").alias("node"), *[(F.col(c) + F.col("weight_m")).alias(c) for c in values])


def _improved(known: DataFrame, reached: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The least of each value, known or reached, and what is less than what was known as fresh_{value}, else null."""
    both = known.select(*keys, *values, *[F.col(c).alias(f"old_{c}") for c in values]).unionByName(reached.select(*keys, *values), allowMissingColumns=True)
    best = both.groupBy(*keys).agg(*[F.min(c).alias(c) for c in values], *[F.min(f"old_{c}").alias(f"old_{c}") for c in values])
    fresh = lambda c: F.when(F.col(f"old_{c}").isNull() | (F.col(c) < F.col(f"old_{c}")), F.col(c)).alias(f"fresh_{c}")
    return best.select(*keys, *values, *[fresh(c) for c in values])


def _front(state: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The states with a fresh value, these under their own names."""
    return state.where(F.coalesce(*[f"fresh_{c}" for c in values]).isNotNull()).select(*keys, *[F.col(f"fresh_{c}").alias(c) for c in values])


def landmark_distances(edges: DataFrame, count: int = LANDMARKS) -> DataFrame:
    """node, far: the distances of each node to some nodes, null where there is no path; ``edges`` go both ways.

    A node is one row with a column for each landmark, so a round moves it once, not once a landmark.
    """
    nodes = edges.select(F.col("src").alias("node")).distinct()
    marks = [r["node"] for r in nodes.orderBy(F.xxhash64("node"), "node").limit(count).collect()]
    values = [f"d{i}" for i in range(count)]
    kind = edges.schema["src"].dataType
    at = [F.when(F.col("node") == F.lit(m).cast(kind), 0.0).alias(c) for c, m in zip(values, marks, strict=False)] + [F.lit(None).cast("double").alias(c) for c in values[len(marks):]]
    start = nodes.where(F.col("node").isin(*marks)).select("node", *at)
    state = saved(start.select("*", *[F.col(c).alias(f"fresh_{c}") for c in values]), "far")
    while n := (front := _front(state, ["node"], values)).count():
        older, state = state, saved(_improved(state, _stepped(front, n, edges, values), ["node"], values), "far")
        release(older)
    out = saved(nodes.join(state, "node", "left").select("node", F.array(*values).alias("far")), "far")
    release(state)
    return out


def _least(a: Column, b: Column) -> Column:
    """Metres between two nodes at least, by the triangles with landmarks."""
    return F.coalesce(F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0))


def _searched(edges: DataFrame, pairs: DataFrame, landmarks: int) -> DataFrame:
    """source, target, node, forth, back: the metres from the source and to the target, as far as a search from both ends has them.

    Landmarks tell at least and at most how long a path between two nodes is.  A state is kept only if what it has
    walked and has to walk at least isn't more than the least that is known for its pair, and goes on only up to half of that:
    either end reaches the middle of a shortest path, where both meet.  So what is looked at are two small
    areas around the ends, and of these what lies near the shortest paths.  Pairs that a landmark tells apart are unconnected
    and aren't searched.  Rounds as in :func:`shortest_paths`.
    """
    both = both_ways(edges)
    far = landmark_distances(both, landmarks)
    wanted = pairs.select("source", "target").distinct()
    a, b = far.select(F.col("node").alias("source"), F.col("far").alias("__s")), far.select(F.col("node").alias("target"), F.col("far").alias("__t"))
    ends = wanted.join(a, "source").join(b, "target")
    apart = F.exists(F.zip_with("__s", "__t", lambda x, y: x.isNull() != y.isNull()), lambda x: x)
    most = F.array_min(F.zip_with("__s", "__t", lambda x, y: x + y))
    # A little more than the bound, as sums of doubles are rounded.
    bounds = saved(ends.where(~apart).select("source", "target", "__s", "__t", (most * (1 + 1e-9)).alias("most")), "bounds")
    pair, keys, values = ["source", "target"], ["source", "target", "node"], ["forth", "back"]
    none = F.lit(None).cast("double")
    start = bounds.select(*pair, F.col("source").alias("node"), F.lit(0.0).alias("forth"), none.alias("back")).union(bounds.select(*pair, F.col("target").alias("node"), none.alias("forth"), F.lit(0.0).alias("back")))
    state = saved(_improved(start.limit(0), start, keys, values), "paths")
    while True:
        met = state.groupBy(*pair).agg((F.min(F.col("forth") + F.col("back")) * (1 + 1e-9)).alias("met"))
        limits = saved(bounds.join(met, pair, "left").select(*pair, "__s", "__t", F.least("most", "met").alias("limit")), "limits")
        half = lambda c: F.when(F.col("limit").isNull() | (2 * F.col(c) <= F.col("limit")), F.col(c)).alias(c)
        front = _front(state, keys, values).join(limits, pair).select(*keys, *map(half, values)).where(F.coalesce(*values).isNotNull())
        if not (n := front.count()):
            break
        reached = _stepped(front, n, both, values).groupBy(*keys).agg(*[F.min(c).alias(c) for c in values])
        reached = reached.join(far, "node").join(limits, pair)
        fine = lambda c, end: F.when(F.col("limit").isNull() | (F.col(c) + _least(F.col("far"), F.col(end)) * (1 - 1e-9) <= F.col("limit")), F.col(c)).alias(c)
        reached = reached.select(*keys, fine("forth", "__t"), fine("back", "__s")).where(F.coalesce(*values).isNotNull())
        older, state = state, saved(_improved(state, reached, keys, values), "paths")
        release(older, limits)
    release(both, far, bounds, limits)
    return state.select(*keys, *values)


def explored(edges: DataFrame, pairs: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """source, target, node, distance of the states that a search between the pairs looks at.

    The distance is that from the source, null where only the target's side has come; the target's own is that of the path.
    """
    state = _searched(edges, pairs, landmarks)
    ways = state.groupBy("source", "target").agg(F.min(F.col("forth") + F.col("back")).alias("distance")).where("distance IS NOT NULL")
    others = state.where("node <> target").select("source", "target", "node", F.col("forth").alias("distance"))
    return others.union(ways.select("source", "target", F.col("target").alias("node"), "distance"))


def pair_paths(edges: DataFrame, pairs: DataFrame, landmarks: int = LANDMARKS) -> DataFrame:
    """(source, target, distance) of the pairs that a path connects, over undirected edges (src, dst, weight_m)."""
    return explored(edges, pairs, landmarks).where("node = target").select("source", "target", "distance")
