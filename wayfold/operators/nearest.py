"""The nearest edge of a line, by a packed tree of boxes that is searched by branch and bound.

A line's edges lie in order, so runs of neighbours have small boxes: a level of the tree has a box for
each FANOUT boxes of the level below, without pointers.  A point goes down the tree to a few near edges
first; then, from the root, only boxes nearer than those edges are opened, for all points of a block at
once.  So a point looks at a number of boxes that grows with the logarithm of the line's length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.sources.shared import ship_package

Names = Sequence[str]
FANOUT = 8
#: Boxes of each level that are followed for a first near edge.
TRIED = 4
#: Points of a line that go to one task, and pairs of points and boxes that a step looks at.
BLOCK, STEP = 1 << 18, 1 << 20


def _or_infinite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), np.inf, x)


class EdgeTree:
    """Boxes over the edges a to b of a line; edges without finite ends are never the nearest."""

    def __init__(self, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray):
        self.a, self.b = np.stack([ax, ay]), np.stack([bx, by])
        self.levels = [np.concatenate([np.minimum(self.a, self.b), np.maximum(self.a, self.b)])]
        while (n := self.levels[-1].shape[1]) > FANOUT:
            starts, below = np.arange(0, n, FANOUT), self.levels[-1]
            self.levels.append(np.concatenate([np.fmin.reduceat(below[:2], starts, axis=1), np.fmax.reduceat(below[2:], starts, axis=1)]))
        self.visited = 0

    def _to_boxes(self, level: int, p: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances; a box that isn't finite is infinitely far."""
        self.visited += at.size
        box = self.levels[level][:, at]
        gap = np.maximum(np.maximum(box[:2] - p, p - box[2:]), 0)
        return _or_infinite((gap * gap).sum(axis=0))

    def _to_edges(self, p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances to edges, and where on them."""
        self.visited += at.size
        a = self.a[:, at]
        d = self.b[:, at] - a
        square = (d * d).sum(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            t = np.where(square <= 1e-12, 0.0, ((p - a) * d).sum(axis=0) / square)
        t = np.clip(t, 0.0, 1.0)
        off = p - (a + t * d)
        return _or_infinite(np.sqrt((off * off).sum(axis=0))), t

    def nearest(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edge, distance and share of the edge; the first edge wins ties.  Infinitely far where nothing is finite."""
        fine = np.isfinite(x) & np.isfinite(y)
        if not fine.all():
            edge, far, share = np.zeros(len(x), dtype=np.int64), np.full(len(x), np.inf), np.zeros(len(x))
            if fine.any():
                edge[fine], far[fine], share[fine] = self.nearest(x[fine], y[fine])
            return edge, far, share
        p = np.stack([x, y])
        n, top, near = len(x), len(self.levels) - 1, None
        for level in range(top, -1, -1):
            size = self.levels[level].shape[1]
            children = np.broadcast_to(np.arange(size), (n, size)) if near is None else np.minimum((near[:, :, None] * FANOUT + np.arange(FANOUT)).reshape(n, -1), size - 1)
            box = self.levels[level][:, children]
            off = (box[:2] + box[2:]) / 2 - p[:, :, None]
            # Boxes may overlap: of those that hold the point, the ones whose middle is near.
            far = self._to_boxes(level, p[:, :, None], children) + 1e-3 * _or_infinite((off * off).sum(axis=0))
            width = min(TRIED, children.shape[1])
            near = np.take_along_axis(children, np.argpartition(far, width - 1, axis=1)[:, :width], axis=1)
        bound = self._to_edges(p[:, :, None], near)[0].min(axis=1)
        return self._opened(p, bound)

    def _opened(self, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = p.shape[1]
        limit = bound * bound * (1 + 1e-9) + 1e-12
        point, at = np.arange(n), None
        for level in range(len(self.levels) - 1, -1, -1):
            size = self.levels[level].shape[1]
            children = np.arange(size) if at is None else np.minimum(at[:, None] * FANOUT + np.arange(FANOUT), size)
            width = size if at is None else FANOUT
            if n > 1 and len(point) * width > STEP:
                halves = [self._opened(p[:, s], bound[s]) for s in (slice(0, n // 2), slice(n // 2, n))]
                return tuple(np.concatenate(h) for h in zip(*halves, strict=True))
            point = np.repeat(point, width)
            at = np.tile(children, n) if at is None else children.ravel()
            inside = at < size
            point, at = point[inside], at[inside]
            fine = self._to_boxes(level, p[:, point], at) <= limit[point]
            point, at = point[fine], at[fine]
        far, t = self._to_edges(p[:, point], at)
        best = np.full(n, np.inf)
        np.minimum.at(best, point, far)
        edge = np.full(n, self.a.shape[1], dtype=np.int64)
        hit = far == best[point]
        np.minimum.at(edge, point[hit], at[hit])
        share = np.zeros(n)
        own = hit & (at == edge[point])
        share[point[own]] = t[own]
        return edge, best, share


def _runs(batch: pa.RecordBatch, keys: Names) -> np.ndarray:
    """Where runs of equal keys begin, and the number of rows."""
    n = batch.num_rows
    fresh = np.zeros(n, dtype=bool)
    if n:
        fresh[0] = True
        for k in keys:
            c = batch.column(k)
            fresh[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(fresh), n)


def project_on_lines(points: DataFrame, line_edges: DataFrame, keys: Names, point_id: str, x: str, y: str) -> DataFrame:
    """Each point's nearest place on the line of its key: distance_m, chainage_m, edge, near_x and near_y.

    The first edge wins ties; points whose key is null or has no line are left out; those without a finite place keep
    nulls.  A task streams: a line's row (a value) makes its tree, the points of its key follow.  Points of a line with
    over BLOCK of them are dealt over several tasks, each with the line; as many such keys as blocks are broadcast.
    """
    ship_package(points.sparkSession)
    whole = F.array_sort(F.collect_list(F.struct("edge", *[F.col(c).cast("double").alias(c) for c in ("cum_m", "ax", "ay", "bx", "by")])))
    known = [F.col(k).isNotNull() for k in keys]
    lines, p = line_edges, points.select(*keys, point_id, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    for k in known:
        lines, p = lines.where(k), p.where(k)
    lines = lines.groupBy(*keys).agg(whole.alias("__edges"))
    counts = p.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("__tasks")).where("__tasks > 1")
    counts = F.broadcast(counts)  # a row for each BLOCK points at most
    tasks = F.coalesce("__tasks", F.lit(1))
    built = lines.join(counts, list(keys), "left").withColumn("__task", F.explode(F.sequence(F.lit(0), tasks - 1)))
    built = built.select(*keys, "__task", F.lit(None).cast(p.schema[point_id].dataType).alias(point_id), F.lit(None).cast("double").alias("__x"), F.lit(None).cast("double").alias("__y"), "__edges")
    asks = p.join(counts, list(keys), "left").withColumn("__task", F.pmod(F.xxhash64(point_id, "__x", "__y"), tasks).cast("int"))
    asks = asks.select(*keys, "__task", point_id, "__x", "__y", F.lit(None).cast(built.schema["__edges"].dataType).alias("__edges"))
    rows = built.union(asks).repartition(*keys, "__task").sortWithinPartitions(*keys, "__task", F.col("__edges").isNull())
    edge_type = line_edges.schema["edge"].dataType
    fields = [T.StructField(f.name, f.dataType) for f in p.select(*keys, point_id).schema.fields]
    schema = T.StructType([*fields, T.StructField("distance_m", T.DoubleType()), T.StructField("chainage_m", T.DoubleType()), T.StructField("edge", edge_type), T.StructField("near_x", T.DoubleType()), T.StructField("near_y", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, label, length, ax, ay, bx, by, cum = (None,) * 9
        for batch in batches:
            edges, places = batch.column("__edges"), [batch.column(c).to_numpy(zero_copy_only=False) for c in ("__x", "__y")]
            is_line, starts = edges.is_valid().to_numpy(zero_copy_only=False), _runs(batch, [*keys, "__task"])
            taken, told = [], {"distance_m": [], "chainage_m": [], "edge": [], "near_x": [], "near_y": []}
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                own = tuple(batch.column(k)[int(a)].as_py() for k in (*keys, "__task"))
                if is_line[a]:
                    line = edges.slice(a, 1).flatten()
                    ax, ay, bx, by, cum = (line.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by", "cum_m"))
                    key, tree, label, length = own, EdgeTree(ax, ay, bx, by), line.field("edge"), np.hypot(bx - ax, by - ay)
                    a += 1
                if a == b or own != key:
                    continue
                px, py = (c[a:b].astype(np.float64) for c in places)
                at, far, share = (np.concatenate(c) for c in zip(*(tree.nearest(px[i : i + STEP // 64], py[i : i + STEP // 64]) for i in range(0, b - a, STEP // 64)), strict=True))
                lost = ~np.isfinite(far)
                at = np.where(lost, 0, at)
                taken.append(np.arange(a, b))
                told["distance_m"].append(pa.array(far, mask=lost))
                told["chainage_m"].append(pa.array(cum[at] + share * length[at], mask=lost))
                told["edge"].append(label.take(pa.array(at, mask=lost)))
                told["near_x"].append(pa.array(ax[at] + share * (bx - ax)[at], mask=lost))
                told["near_y"].append(pa.array(ay[at] + share * (by - ay)[at], mask=lost))
            if taken:
                rows = batch.select([*keys, point_id]).take(pa.array(np.concatenate(taken)))
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.concat_arrays(c) for c in told.values())], schema.names)

    return rows.mapInArrow(run, schema)
