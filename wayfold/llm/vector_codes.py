"""Vector code compression: product codes whose nearest entries are found by annular norm pruning.

Vectors are cut into equal parts; each part position has a codebook, refined by rounds of assignment
and averaging.  A codebook's entries are sorted by norm.  As a distance is at least the difference of
two norms, a part's best distance to a few entries of about its norm bounds the norms that any nearer
entry can have: a binary search gives that interval, and only the entries of this annulus, both ends
included, are evaluated, in exact integers.

A task reads vectors in slices of bounded size and sends a count and sums for each entry at most; the
driver holds codebooks only (``entries`` times the width of a vector).

Defined results: vectors that are null, or hold a null or non-finite component, take no part; shorter
vectors count as padded with zeros, up to a multiple of ``parts``; rows that repeat an id get a row
each, and the smallest of their vectors, component by component, gives the entry; rows without an id
come last; fewer ids than ``entries`` make smaller codebooks; ties go to the lower index; labels are
equal when both are null; an empty table gives an empty result.  An error that a long can't hold, or a
sum of components beyond 60 digits, ends the run.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import saved, ship_package, table

#: Entries of about a part's own norm that are evaluated for its first bound.
FIRST = 4
#: Components of pairs that a step evaluates at once.
STEP = 1 << 21
#: Labels up to this count are broadcast with their sums; more are joined by shuffle, in SALTS parts.
BROADCAST_LABELS, SALTS = 100_000, 16
#: Below this, all sums of a step are exact in doubles and longs.
EXACT = 2**52
#: Sums travel as decimals of two parts, the lower of which stays below this.
LIMB = 10**27


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def integers(rows: pa.ListArray, scale: float, width: int) -> np.ndarray:
    """floor(scale * component) of each vector, padded; Python integers where doubles aren't exact."""
    flat = np.floor(scale * rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    sizes = np.diff(rows.offsets.to_numpy())
    if np.isinf(flat).any():
        flat = np.array([math.floor(int(scale) * int(x)) if abs(x) > 2**60 else math.floor(scale * x) for x in rows.flatten().to_pylist()], dtype=object)
    elif np.abs(flat).max(initial=0) >= EXACT:
        flat = np.array([int(x) for x in flat], dtype=object)
    out = np.zeros((len(rows), width), dtype=object if flat.dtype == object else np.float64)
    if (sizes == width).all():
        out[:] = flat.reshape(len(rows), width)
    else:
        at = np.repeat(np.arange(len(rows)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[at] = flat
    return out


class Codebook:
    """The entries of one part position, sorted by norm."""

    def __init__(self, entries: list[list[int]]):
        whole = np.array(entries, dtype=object).reshape(len(entries), -1)
        norms = np.array([math.sqrt(sum(int(x) ** 2 for x in e)) for e in entries])
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.most = norms[self.order], max((abs(x) for e in entries for x in e), default=0)
        self.big = whole[self.order]
        self.entries = self.big.astype(np.float64) if self.most < EXACT else None

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the nearest entry of each row; how many pairs were evaluated."""
        n, count = len(x), len(self.norms)
        span = x.shape[1] * (float(np.abs(x).max(initial=0)) + self.most) ** 2
        exact = x.dtype != object and self.entries is not None and span * count < EXACT
        c = self.entries if exact else self.big
        x = x if exact else np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
        own = np.sqrt((x * x).sum(axis=1).astype(np.float64))

        def best(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """The least distance * count + index among the entries low to high - 1 of each of the rows; none has no entries."""
            sizes = high - low
            first = np.cumsum(sizes) - sizes
            at = np.arange(sizes.sum()) - np.repeat(first - low, sizes)
            off = x[np.repeat(rows, sizes)] - c[at]
            far = (off * off).sum(axis=1)
            return np.minimum.reduceat((far.astype(np.int64) if exact else far) * count + self.order[at], first)

        low = np.clip(np.searchsorted(self.norms, own) - FIRST // 2, 0, max(0, count - FIRST))
        high = np.minimum(low + FIRST, count)
        found, pairs = best(np.arange(n), low, high), int((high - low).sum())
        reach = np.sqrt((found // count).astype(np.float64))
        slack = (own + reach + 1) * 1e-9  # norms are rounded
        inner, outer = np.searchsorted(self.norms, own - reach - slack, "left"), np.searchsorted(self.norms, own + reach + slack, "right")
        for start, end in ((inner, low), (high, outer)):  # what the annulus has besides the first entries
            rows = np.flatnonzero(start < end)
            if len(rows):
                found[rows] = np.minimum(found[rows], best(rows, start[rows], end[rows]))
                pairs += int((end - start)[rows].sum())
        return (found % count).astype(np.int64), found // count, pairs


def _slices(batches: Iterator[pa.RecordBatch], scale: float, width: int, rows: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, integers(part.column("v"), scale, width)


def _refined(kept: DataFrame, books: list[list[list[int]]], scale: float, width: int, rows: int) -> list[list[list[int]]]:
    """The codebooks after a round: each entry is the floor of its parts' mean."""
    size = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        sums = np.zeros((len(books), len(books[0]), size), dtype=object)
        n = np.zeros((len(books), len(books[0])), dtype=np.int64)
        for _, x in _slices(batches, scale, width, rows):
            for p, book in enumerate(made):
                own = x[:, p * size : (p + 1) * size]
                j, _, _ = book.nearest(own)
                step = np.zeros(sums.shape[1:], dtype=object if own.dtype == object or np.abs(own).max(initial=0) * len(own) >= EXACT else np.float64)
                np.add.at(step, j, own)
                used = np.unique(j)
                sums[p, used] += np.array([[int(v) for v in e] for e in step[used]], dtype=object).reshape(len(used), size)
                n[p] += np.bincount(j, minlength=len(books[0]))
        p, j = np.nonzero(n)
        total = [[Decimal(v // LIMB) for v in e] + [Decimal(v % LIMB) for v in e] for e in sums[p, j]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(j, pa.int32()), pa.array(n[p, j]), pa.array(total, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "total"])

    found = kept.select("v").mapInArrow(run, "part int, entry int, n long, total array<decimal(38,0)>")
    if not size:
        return books
    cells = found.select("part", "entry", "n", F.posexplode("total").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [[list(e) for e in b] for b in books]
    limbs: dict = {}
    for r in cells.collect():
        limbs[r["part"], r["entry"], r["pos"]] = int(r["x"]), r["n"]
    for (p, j, at), (high, n) in limbs.items():
        if at < size:
            out[p][j][at] = (high * LIMB + limbs[p, j, at + size][0]) // n
    return out


def _coded(kept: DataFrame, books: list[list[list[int]]], scale: float, width: int, rows: int) -> DataFrame:
    size = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        for part, x in _slices(batches, scale, width, rows):
            codes, error = np.zeros((len(x), len(books)), dtype=np.uint8), [0] * len(x)
            for p, book in enumerate(made):
                codes[:, p], far, _ = book.nearest(x[:, p * size : (p + 1) * size])
                error = [a + int(b) for a, b in zip(error, far, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    label = kept.schema["label"].dataType.simpleString()
    return kept.mapInArrow(run, f"id long, label {label}, code string, error long")


def codebooks(kept: DataFrame, parts: int, entries: int, rounds: int, scale: float) -> tuple[list[list[list[int]]], int]:
    """The final codebooks by part, entry and position, and the width that vectors are padded to."""
    width = kept.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return [], 0
    width = -(-width // parts) * parts
    ids = [r[0] for r in kept.select("id").distinct().orderBy(F.col("id").asc_nulls_last()).limit(entries).collect()]
    chosen = F.col("id").isin([i for i in ids if i is not None])
    chosen = chosen | F.col("id").isNull() if None in ids else chosen
    first = kept.where(chosen).groupBy("id").agg(F.min("v").alias("v")).collect()
    starts = [r["v"] for r in sorted(first, key=lambda r: (r["id"] is None, r["id"]))]
    whole = integers(pa.array(starts, pa.list_(pa.float64())), scale, width)
    size = width // parts
    books = [[[int(v) for v in e[p * size : (p + 1) * size]] for e in whole] for p in range(parts)]
    for _ in range(rounds):
        books = _refined(kept, books, scale, width, _rows(entries, size))
    return books, width


def _rows(entries: int, size: int) -> int:
    return max(1, STEP // (entries * max(1, size)))


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0,
) -> DataFrame:
    """id_col, code, error, label_error and codebooks_sha256 of every usable row."""
    if not 0 < entries <= 256:
        raise ValueError("a part's index has two hex digits: up to 256 entries")
    spark = vectors.sparkSession
    ship_package(spark)
    kept = _kept(vectors, id_col, vector_col, label_col)
    books, width = codebooks(kept, parts, entries, rounds, scale)
    if not books:
        return kept.select(F.col("id").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    coded = saved(_coded(kept, books, scale, width, _rows(entries, width // parts)), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    sums = saved(sums.withColumnRenamed("label", "of"), "label_errors")
    if sums.count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
        every = sums.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(every.hint("merge"), F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("at")))
    return out.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def brute_force(rows: list[tuple], parts: int, entries: int, rounds: int, scale: float = 256.0) -> list[tuple]:
    """For tests: the rows of :func:`compress` of (id, vector, label) by full scans in plain Python."""
    fine = [(i, [math.floor(scale * float(x)) for x in v], m) for i, v, m in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fine:
        return []
    width = -(-max(len(v) for _, v, _ in fine) // parts) * parts
    size = width // parts
    fine = [(i, v + [0] * (width - len(v)), m) for i, v, m in fine]
    of_id: dict = {}
    for i, v, _ in fine:
        of_id[i] = min(v, of_id.get(i, v))
    starts = [of_id[i] for i in sorted(of_id, key=lambda i: (i is None, i))[:entries]]
    books = [[e[p * size : (p + 1) * size] for e in starts] for p in range(parts)]

    def nearest(p: int, v: list[int]) -> tuple[int, int]:
        own = v[p * size : (p + 1) * size]
        return min((sum((a - b) ** 2 for a, b in zip(own, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        groups: dict = {}
        for _, v, _ in fine:
            for p in range(parts):
                groups.setdefault((p, nearest(p, v)[1]), []).append(v[p * size : (p + 1) * size])
        for (p, j), own in groups.items():
            books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, m in fine:
        best = [nearest(p, v) for p in range(parts)]
        error = sum(d for d, _ in best)
        by_label[m] = by_label.get(m, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in best), error, m))
    return [(i, code, error, by_label[m], digest) for i, code, error, m in out]


def _round_sql(k: int) -> str:
    """The assignment to the codebooks ``b{k}`` as ``a{k}``: distance times 64 plus index."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT t.vec_id, t.p, min(CAST(t.q - 2 * list_inner_product(t.s, b.s) + list_inner_product(b.s, b.s) AS BIGINT) * 64 + b.j) AS best
  FROM t JOIN b{k} AS b ON b.p = t.p GROUP BY t.vec_id, t.p)"""


def _means_sql(k: int) -> str:
    """The codebooks after round ``k``."""
    return f"""
m{k} AS MATERIALIZED (
  SELECT p, j, list(x ORDER BY pos) AS s FROM (
    SELECT t.p, a.best % 64 AS j, i.pos, floor(sum(t.s[i.pos]) / count(*)) AS x
    FROM t JOIN a{k} AS a ON a.vec_id = t.vec_id AND a.p = t.p JOIN (SELECT CAST(range AS BIGINT) + 1 AS pos FROM range(64)) AS i ON i.pos <= len(t.s)
    GROUP BY t.p, a.best % 64, i.pos) GROUP BY p, j),
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.j, coalesce(m.s, b.s) AS s FROM b{k} AS b LEFT JOIN m{k} AS m ON m.p = b.p AND m.j = b.j)"""


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
t AS MATERIALIZED (
  SELECT vec_id, p, s, list_inner_product(s, s) AS q FROM (
    SELECT vec_id, range AS p, c[range * (len(c) // 16) + 1 : (range + 1) * (len(c) // 16)] AS s FROM v, range(16))),
b0 AS MATERIALIZED (
  SELECT p, j, s FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, s FROM t) WHERE j < 64),
{_round_sql(0)},{_means_sql(0)},{_round_sql(1)},{_means_sql(1)},{_round_sql(2)},
c AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
h AS (
  SELECT sha256(string_agg(x, ',' ORDER BY p, j)) AS codebooks_sha256
  FROM (SELECT p, j, list_aggregate([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN s], 'string_agg', ',') AS x FROM b2))
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error, codebooks_sha256
FROM c JOIN v ON v.vec_id = c.vec_id, h
"""
