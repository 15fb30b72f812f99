"""Exact top-k search by distributed histogram selection.

Queries and candidates are cut into blocks; every pair of blocks is scored by one task as a
matrix product.  The score of the k-th best candidate of each query is found by rounds over
global histograms: a round divides the interval known to hold it into bins, every task
counts its scores per bin from the top until it has counted k, the counts are added up, and
the interval shrinks to the bin that holds the k-th score.  The first interval is bounded by the lengths of
vectors, without scoring; with BINS bins most searches take one round.  Once the interval is a single
score, a last pass keeps what lies above it, and of the ties at it each task's smallest ids.

A task holds one block of each side and one score matrix, all of fixed size.  A task sends
at most k bins or k rows per query, whatever the number of ties.

Defined results: vectors that are null, or hold a null or non-finite component, take no part;
shorter vectors count as padded with zeros; ties go to the smaller id; rows that repeat an id
are candidates of their own, but never of a query with that id, and of the vectors of one query id the smallest, component
by component, asks; a query with fewer than k
candidates gets all; null ids take no part.  Components turn into floor(scale * x); a score that
a long can't hold is an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import saved, ship_package, table

#: Rows in a block of candidates and of queries.
CANDIDATES, QUERIES = 4096, 1024
#: Bins of a round for each query; a task gives at most k of them.
BINS = 1 << 16


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
    )
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def _matrix(rows, scale: float, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = np.floor(scale * np.asarray(x, dtype=np.float64))
    return out


def _scores(left: pd.DataFrame, right: pd.DataFrame, scale: float) -> np.ndarray:
    """Integer inner products, right by left; exact whatever the magnitude that int64 can hold."""
    width = max(max(map(len, left.v), default=0), max(map(len, right.v), default=0), 1)
    a, b = _matrix(right.v, scale, width), _matrix(left.v, scale, width)
    most = width * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1)
    if most < 2**52:  # every partial sum is an exact double
        return (a @ b.T).astype(np.int64)
    return (a.astype(np.int64).astype(object) @ b.T.astype(np.int64).astype(object)).astype(np.int64)


def _masked(left: pd.DataFrame, right: pd.DataFrame, scale: float) -> tuple[np.ndarray, np.ndarray]:
    s = _scores(left, right, scale)
    return s, right.id.to_numpy()[:, None] != left.id.to_numpy()[None, :]


def _count_bins(scale: float, k: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"qid": [], "bin": [], "n": []}
        if len(left) and len(right):
            s, ok = _masked(left, right, scale)
            low, width = right.low.to_numpy()[:, None], right.width.to_numpy()[:, None]
            b = np.where(ok, np.minimum((s - low) // width, BINS), -1)
            for i, q in enumerate(right.id.to_numpy()):
                row = b[i]
                row = row[row >= 0]
                if len(row) > k:
                    row = np.partition(row, len(row) - k)[len(row) - k :]
                bins, n = np.unique(row, return_counts=True)
                out["qid"].append(np.full(len(bins), q))
                out["bin"].append(bins)
                out["n"].append(n)
        return pd.DataFrame({c: np.concatenate(x) if x else np.array([], dtype=np.int64) for c, x in out.items()}).astype("int64")

    return run


def _winners(scale: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(left) and len(right):
            s, ok = _masked(left, right, scale)
            ids = left.id.to_numpy()
            for i, (q, kth, ties) in enumerate(zip(right.id, right.low, right.ties, strict=True)):
                above = np.flatnonzero(ok[i] & (s[i] > kth))
                at = ids[ok[i] & (s[i] == kth)]
                at = np.partition(at, ties - 1)[:ties] if len(at) > ties else at
                parts.append(pd.DataFrame({
                    "query_id": q, "vec_id": np.concatenate([ids[above], at]),
                    "score": np.concatenate([s[i][above], np.full(len(at), kth)])}))
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return (pd.concat(parts) if parts else empty).astype("int64")

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query, exactly."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows, wanted = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    n_rows, n_queries = rows.count(), wanted.count()
    slabs, parts = max(1, -(-n_rows // CANDIDATES)), max(1, -(-n_queries // QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Rows repeat an id, so what deals them out must not be the id alone.
    left = saved(rows.withColumn("slab", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(slabs)).cast("int")), "candidates")
    right = saved(wanted.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), "queries")
    key = ["slab", "part"]
    left_pairs = left.withColumn("part", spread(parts))

    def over_blocks(state: DataFrame | None, run, schema: str) -> DataFrame:
        r = right if state is None else right.join(state, right["id"] == state["qid"]).drop("qid")
        blocks = r.withColumn("slab", spread(slabs)).groupBy(*key)
        return left_pairs.groupBy(*key).cogroup(blocks).applyInPandas(run, schema)

    # A score is at most the product of both lengths, a little more where doubles round.
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.floor(x * scale) * F.floor(x * scale)))
    longest = left.agg(F.max(length)).first()[0] or 0.0
    others = left.join(right.select("id"), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    bound = F.least(F.ceil(length * longest * (1 + 1e-9)) + 1, F.lit(2.0**62)).cast("long")
    state = right.select("id", bound.alias("high")).join(others.hint("merge"), "id", "left").select(F.col("id").alias("qid"), (-F.col("high")).alias("low"), "high", (F.lit(n_rows) - F.coalesce("own", F.lit(0))).alias("n"))
    state = state.where("n > 0").select("qid", "low", "high", F.least(F.col("n"), F.lit(k)).cast("long").alias("need"))
    state = saved(state.withColumn("ties", F.col("need")), "ends")
    span = lambda: F.col("high") / 2 - F.col("low") / 2  # noqa: E731  half, so that it can't overflow
    while (widest := state.agg(F.max(span())).first()[0]) is not None and widest > 0:
        # At most BINS bins, with one to spare where a double can't hold the width exactly.
        state = state.withColumn("width", F.expr(f"greatest(1L, bigint(ceil((high / 2 - low / 2 + 0.5) / {BINS // 2}))) + if(high / 2 - low / 2 > 1e15, 1L, 0L)"))
        counts = over_blocks(state.select("qid", "low", "width"), _count_bins(scale, k), "qid long, bin long, n long")
        state = saved(_narrowed(state, counts), "narrowed")
    found = over_blocks(state.select("qid", "low", "ties"), _winners(scale), "query_id long, vec_id long, score long")
    return _ranked(found, k)


def _narrowed(state: DataFrame, counts: DataFrame) -> DataFrame:
    """The interval of each query cut down to the bin that holds its k-th score.

    A bin's count is whole wherever the counts from the top reach ``need``: a task leaves a
    score out only if it has k better ones.  ``need`` is the rank sought in the whole
    interval from ``low`` up; scores above the last bin of the interval fall into bin BINS.
    """
    from pyspark.sql import Window

    per_bin = counts.groupBy("qid", "bin").agg(F.sum("n").alias("n"))
    from_top = Window.partitionBy("qid").orderBy(F.col("bin").desc())
    cut = (
        per_bin.withColumn("upto", F.sum("n").over(from_top))
        .join(state, "qid")
        .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("n") < F.col("need")))
    )
    low = F.col("low") + F.col("bin") * F.col("width")
    return cut.select(
        "qid", low.alias("low"), F.least(F.col("high"), low + F.col("width") - 1).alias("high"), "need",
        (F.col("need") - (F.col("upto") - F.col("n"))).alias("ties"),
    )


def _ranked(found: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def brute_force(rows: list[tuple], queries: list[int], k: int, scale: float = 64.0) -> list[tuple]:
    """For tests: (query_id, rank, vec_id, score) by a scan in plain Python."""
    import math

    fine = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    by_id: dict[int, list[int]] = {}
    for i, v in sorted(fine, key=lambda r: [*r[1]], reverse=True):
        by_id[i] = v
    out = []
    for q in queries:
        if q in by_id:
            scored = sorted((-sum(a * b for a, b in zip(by_id[q], v, strict=False)), i) for i, v in fine if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.c, v.c)]) AS BIGINT) AS score
  FROM v AS q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
