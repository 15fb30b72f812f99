"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers look at each text and vote good, bad or abstain.  Nobody knows how good
they are; expectation-maximisation over the counts of vote patterns in the whole corpus
estimates how often each labeller votes what, or abstains, for good and for bad documents, and the
share of good ones.  The posterior of each document's votes is its weak label.  A logistic scorer over
hashed features learns the weak labels from a bounded sample (SAMPLE documents, the first by a
hash of their ids) and then scores every document whole; a document is kept if it scores KEEP or
more.

Defined results: a null or empty text gets the votes of an empty text, and is not kept; a null
doc_id is scored like any other; rows that repeat a doc_id are scored each; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import Memo, chunks
from .scratch import ship_package, table

SAMPLE, DIMENSIONS, KEEP = 20_000, 1 << 14, 0.5
EPOCHS, RATE, RIDGE = 6, 0.3, 1e-5
#: Weight, as a share of the corpus, of the belief that a vote is nine times as likely where it is right: it says as much as
#: the corpus.  Set beforehand, not by labels.
PRIOR = 1.0
MEMO = 200_000

LETTER, UPPER, DIGIT, SPACE, SYMBOL = range(5)
_CLASS = np.full(256, LETTER, dtype=np.uint8)  # bytes of other scripts count as letters
for _c in range(128):
    _CLASS[_c] = UPPER if chr(_c).isupper() else LETTER if chr(_c).isalpha() else DIGIT if chr(_c).isdigit() else SPACE if chr(_c).isspace() or _c < 32 else SYMBOL


def measures(text: str) -> dict[str, float]:
    """What the labellers look at."""
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    count = np.bincount(_CLASS[raw], minlength=5)
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n = max(len(words), 1)
    letters = max(int(count[LETTER] + count[UPPER]), 1)
    seen = Counter(words)
    return {
        "words": len(words),
        "upper": count[UPPER] / letters,
        "symbols": (count[SYMBOL]) / max(len(raw) - int(count[SPACE]), 1),
        "digits": count[DIGIT] / max(len(raw) - int(count[SPACE]), 1),
        "alone": sum(n for w, n in seen.items() if not any(map(str.isalnum, w))) / n,
        "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "distinct": len(seen) / n,
        "lines": len(set(lines)) / max(len(lines), 1),
        "length": sum(len(w) * n for w, n in seen.items()) / n,
        "short": sum(n for w, n in seen.items() if len(w) <= 3) / n,
        "ends": sum(n for w, n in seen.items() if w[-1] in ".!?") / n,
        "plain": sum(n for w, n in seen.items() if (w[:-1] if w[-1] in ".,;:!?" else w).isalnum()) / n,
        "runs": sum(n for w, n in seen.items() if len(w) > 2 and w[-1] == w[-2] and not w[-1].isalnum()) / n,
    }


#: Labellers: name and vote (1 good, 0 bad, 2 abstains).  Each fault of a text shows to several.
LABELLERS = {
    "upper case": lambda m: 0 if m["upper"] > 0.3 else 2,
    "symbols": lambda m: 0 if m["symbols"] > 0.12 else 2,
    "separators": lambda m: 0 if m["alone"] > 0.1 else 2,
    "symbol runs": lambda m: 0 if m["runs"] > 0.1 else 2,
    "plain words": lambda m: 2 if m["words"] < 5 else 0 if m["plain"] < 0.7 else 1 if m["plain"] > 0.9 else 2,
    "repeated words": lambda m: 0 if m["repeats"] > 0.1 else 2,
    "vocabulary": lambda m: 2 if m["words"] < 20 else 0 if m["distinct"] < 0.5 * min(1.0, 60 / m["words"] + 0.3) else 1,
    "repeated lines": lambda m: 0 if m["lines"] < 0.6 else 2,
    "word length": lambda m: 2 if 3 <= m["length"] <= 9 else 0,
    "sentences": lambda m: 1 if 0.02 <= m["ends"] <= 0.35 and m["words"] >= 5 else 2,
    "size": lambda m: 0 if m["words"] < 3 else 2,
}


def votes(m: dict[str, float]) -> str:
    return "".join(str(f(m)) for f in LABELLERS.values())


def estimate(patterns: dict[str, int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The classes' shares, and for class, labeller and vote (abstaining too) its probability, by EM over counts.

    A labeller that can only say bad tells by how often it does so in each class.  Starts from the
    votes' majority, and takes each vote as nine times as likely where it is right, with the weight of a share PRIOR
    of the corpus, so that class 1 is what they call good and a corpus of any size with the same
    shares of patterns gives the same estimates.
    """
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], dtype=float)
    n /= n.sum()
    v = np.array([[int(c) for c in k] for k in keys])
    good, bad = (v == 1).sum(axis=1), (v == 0).sum(axis=1)
    q = (good + 2.0) / (good + 2.0 * bad + 2.5)
    cast = np.stack([(n[:, None] * (v == x)).sum(axis=0) for x in (0, 1, 2)], axis=1) + 1e-6
    share, table_ = np.array([0.2, 0.8]), np.ones((2, v.shape[1], 3))
    for _ in range(rounds):
        before = q
        weights = (n * (1 - q), n * q)
        share = np.array([w.sum() for w in weights]) + 1e-3
        share /= share.sum()
        odds = share[:, None] * np.array([[0.9, 0.1, 0.5], [0.1, 0.9, 0.5]])
        odds /= odds.sum(axis=0)
        for y, w in enumerate(weights):
            table_[y] = np.stack([(w[:, None] * (v == x)).sum(axis=0) for x in (0, 1, 2)], axis=1) + PRIOR * cast * odds[y]
            table_[y] /= table_[y].sum(axis=1, keepdims=True)
        q = _posterior(v, share, table_)
        if np.abs(q - before).max() < 1e-6:
            break
    return share, table_


def _posterior(v: np.ndarray, share: np.ndarray, table_: np.ndarray) -> np.ndarray:
    j = np.arange(v.shape[1])
    odds = math.log(share[1] / share[0]) + (np.log(table_[1][j, v]) - np.log(table_[0][j, v])).sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def posteriors(patterns: list[str], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return _posterior(np.array([[int(c) for c in k] for k in patterns]), *model)


def shape(word: str) -> str:
    """A word's shape: runs of upper, lower, digits and each symbol, squeezed."""
    out = []
    for c in word[:64]:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            out.append(k)
    return "".join(out[:12]) + f"/{min(len(word), 64).bit_length()}"


class Featurer:
    """Hashed features of a text: shares of word shapes, and its measures in steps."""

    def __init__(self):
        self.memo = Memo(MEMO)

    def __call__(self, words: Counter, m: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        for w in self.memo.absent(set(words)):
            self.memo.new[w] = xxhash.xxh32_intdigest(shape(w)) % DIMENSIONS
        known, n = self.memo.new, max(sum(words.values()), 1)
        got: dict[int, float] = {}
        for w, k in words.items():
            i = known[w]
            got[i] = got.get(i, 0.0) + k / n
        for name, x in m.items():
            step = int(8 * math.log1p(x)) if name in ("words", "length") else int(20 * x)
            got[xxhash.xxh32_intdigest(f"{name}={step}") % DIMENSIONS] = 1.0
        self.memo.turn()
        return np.fromiter(got, dtype=np.int32, count=len(got)), np.sqrt(np.fromiter(got.values(), dtype=np.float64, count=len(got)))


def _votes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                out = [votes(measures(t or "")) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "votes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, votes string")


def _train(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, float]:
    """Weights and offset learnt from the posteriors of at most SAMPLE documents."""
    order = F.crc32(F.concat(F.lit("q"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    ids = docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(order, "doc_id").limit(SAMPLE)
    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text")  # SAMPLE ids at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        featurer = Featurer()
        for b in batches:
            measured = [measures(t or "") for t in b["text"]]
            found = [featurer(Counter((t or "").split()), m) for t, m in zip(b["text"], measured, strict=True)]
            yield pd.DataFrame({"votes": [votes(m) for m in measured], "at": [i.tolist() for i, _ in found], "x": [x.tolist() for _, x in found], "key": b["key"]})

    # Where rows repeat an id, which of them are learnt from is told by their texts.
    found = rows.withColumn("key", F.xxhash64("doc_id", "text")).mapInPandas(run, "votes string, at array<int>, x array<double>, key long")
    sample = found.orderBy("key", "votes").limit(2 * SAMPLE).collect()
    w, offset, total = np.zeros(DIMENSIONS), 0.0, np.full(DIMENSIONS, 1e-8)
    if not sample:
        return w, offset
    y = posteriors([r["votes"] for r in sample], model)
    data = [(np.array(r["at"], dtype=np.int64), np.array(r["x"])) for r in sample]
    draw = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for k in draw.permutation(len(data)):
            i, x = data[k]
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[i] @ x) + offset))))
            g = (p - y[k]) * x + RIDGE * w[i]
            total[i] += g * g
            w[i] -= RATE * g / np.sqrt(total[i])
            offset -= 0.01 * (p - y[k])
    return w, offset


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score and kept of every row."""
    spark = docs.sparkSession
    ship_package(spark)
    counts = _votes(docs).groupBy("votes").count()  # 3 ** len(LABELLERS) patterns at most
    patterns = {r["votes"]: r["count"] for r in counts.collect()}
    model = estimate(patterns) if patterns else (np.array([0.5, 0.5]), np.ones((2, len(LABELLERS), 3)))
    weights, offset = _train(docs, model)
    shared = spark.sparkContext.broadcast((weights, offset, model))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, weak = shared.value
        featurer = Featurer()
        for batch in batches:
            for part in chunks(batch):
                own, score = [], []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for t in texts:
                    m = measures(t)
                    i, x = featurer(Counter(t.split()), m)
                    own.append(votes(m))
                    score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(w[i] @ x) + b)))))
                kept = [s >= KEEP and bool(t.strip()) for s, t in zip(score, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(own, pa.string()), pa.array(posteriors(own, weak)), pa.array(score, pa.float64()), pa.array(kept)], ["doc_id", "votes", "posterior", "score", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, votes string, posterior double, score double, kept boolean")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
