"""Toxicity: a learnt lexicon, misspellings by Levenshtein automata, and context windows.

The lexicon is a trie of words and word beginnings.  A seed of common insults is joined by
terms learnt from labelled documents: word beginnings and whole words that toxic documents
hold and clean ones don't, and beginnings that several words of a toxic document share.  A word of a text is run through
the trie with a Levenshtein automaton of one edit (its states are places in the word, before and after
the edit), so one walk finds all terms within an edit.  Each hit weighs by the log odds that its term, at its
distance and in as many different words (MANY at most), had in the labelled documents; a window of words around
the hit lowers the weight where it reads as a quotation and raises it where it addresses someone.  The sum of the
hits, each further one by half, is calibrated to a probability on the same labelled documents.

What is learnt comes from at most SAMPLE labelled documents of each class, the first by a hash of
their ids; everything else sees every document whole.

Defined results: a null or empty text has no hits and gets the score of no evidence; without
labelled rows of both classes the seed and a fixed calibration serve; a document that several
labels name counts as toxic if any does; rows that repeat a doc_id are scored each; an empty
table gives an empty result; extra columns are ignored by :func:`scores` and kept by
:func:`without_toxic`.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import Memo, chunks, settle
from .scratch import saved, ship_package, table

#: Labelled documents of each class that may be learnt from.
SAMPLE = 10_000
#: Learnt terms are word beginnings of these lengths, and whole words.
STEMS = (4, 5, 6, 7)
#: Toxic texts that a term must be in, counting only those with fewer than EXPLAINED stronger terms; so at most
#: EXPLAINED / LEAST_SUPPORT terms a text of the sample are learnt.
LEAST_SUPPORT, EXPLAINED = 4, 3
#: By how much, in logs, a term must beat the best that chance gives.  This, the two above and MANY were settled by cross-validation
#: within the rows that may be learnt from (tests/llm/plain_toxicity.py); rows held out took no part in it.
MARGIN = 1.0
#: Different words of a text up to which a term's hits are told apart by their number, and the weights that hits may have.
MANY, LEAST_WEIGHT, MOST_WEIGHT = 3, -1.0, 8.0
#: Words on each side of a hit that tell quotation from abuse.
WINDOW = 6
THRESHOLD = 0.7
MEMO = 150_000

SEED = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumbass", "bastard", "asshole", "bitch", "retard", "vermin")
QUOTING = frozenset("said says saying quote quoted quotes quoting wrote writes word words term called reported claims according definition slur insult".split())
ADDRESS = frozenset("you your you're youre u ur they're them these those".split())
QUOTES = "\"'“”‘’«»„`"
WORD = re.compile(r"\w+(?:['’]\w+)*")


def _root(terms: list[tuple[int, str, bool]]) -> dict:
    """(number, term, whether a beginning) as nested dicts."""
    root: dict = {}
    for n, term, beginning in terms:
        node = root
        for c in term:
            node = node.setdefault(c, {})
        node[1 if beginning else 0] = n
    return root


class Trie:
    """Terms as nested dicts; 0 marks a whole word, 1 a word beginning, with the term's number."""

    def __init__(self, terms: list[tuple[str, bool]], loose: frozenset[str] | None = None):
        """All terms may be misspelt, or those in ``loose``."""
        named = [(n, t, b) for n, (t, b) in enumerate(terms)]
        self.root = _root(named)
        self.loose = _root([(n, t, b) for n, t, b in named if (b or len(t) >= 5) and (loose is None or t in loose)])

    def matches(self, word: str) -> list[tuple[int, int]]:
        """(term, distance) of the terms that the word is, starts with, or misspells by one edit.

        Words under four letters, and terms under five that are whole words, are matched exactly;
        a misspelt word keeps its first letter; two neighbours swapped are one edit; a beginning
        is misspelt if a beginning of the word is one edit from it.
        """
        out = []
        node = self.root
        for i, c in enumerate(word):
            node = node.get(c)
            if node is None:
                break
            if 1 in node:
                out.append((node[1], 0))
            if i + 1 == len(word) and 0 in node:
                out.append((node[0], 0))
        if not out and len(word) >= 4:
            out += self._within(word)
        return out

    def _within(self, word: str) -> set[tuple[int, int]]:
        """The product of the trie and the word's automaton of one edit.

        A state is a place in the word and the edits made.  Without an edit there is one path;
        from each of its nodes every edit leads to a state from which the rest must be as it is.
        """
        out: set[tuple[int, int]] = set()
        node, n = self.loose.get(word[0]), len(word)
        for i in range(1, n + 1):
            if node is None:
                break
            c = word[i] if i < n else None
            for k, child in node.items():
                if k == 0 or k == 1:
                    continue
                self._rest(child, word, i, out)  # a letter left out
                if c is not None and k != c:
                    self._rest(child, word, i + 1, out)  # another letter
            if c is None:
                break
            self._rest(node, word, i + 1, out)  # a letter too many
            if i + 1 < n and (child := node.get(word[i + 1])) is not None and (child := child.get(c)) is not None:
                self._rest(child, word, i + 2, out)  # neighbours swapped
            node = node.get(c)
        return out

    @staticmethod
    def _rest(node: dict, word: str, i: int, out: set[tuple[int, int]]) -> None:
        """Follows the word from a place on, without a further edit."""
        while node is not None:
            if 1 in node:
                out.add((node[1], 1))
            if i == len(word):
                if 0 in node:
                    out.add((node[0], 1))
                return
            node = node.get(word[i])
            i += 1


@dataclass
class Model:
    """Terms (and whether each is a word beginning), weights and calibration."""

    terms: list[tuple[str, bool]]
    weights: dict[tuple[int, int, int], float] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = -2.5

    def weight(self, term: int, distance: int, n: int = 1) -> float:
        """The weight of a term found at a distance in ``n`` different words; that of fewer where it isn't known."""
        for k in range(n, 0, -1):
            if (found := self.weights.get((term, distance, k))) is not None:
                return found
        return 4.0 if distance == 0 else 2.5


#: A term, at which distance, and in how many different words (MANY at most).
Hit = tuple[int, int, int]


class Scorer:
    def __init__(self, model: Model):
        self.model, self.trie, self.memo = model, Trie(model.terms), Memo(MEMO)

    def hits(self, texts: list[str]) -> list[list[tuple[Hit, float]]]:
        """For each text its hits, each with the best that contexts make of it."""
        split = [t.lower().split() for t in texts]
        own = [set(words) for words in split]
        distinct: set[str] = set().union(*own)
        for w in self.memo.absent(distinct):
            found: list[tuple[int, int]] = []
            for part in (w,) if w.isalpha() else WORD.findall(w):
                found += self.trie.matches(part)
            self.memo.new[w] = tuple(sorted(set(found)))
        known = self.memo.new
        toxic = {w for w in distinct if known[w]}
        out = []
        for words, seen in zip(split, own, strict=True):
            best: dict[tuple[int, int], float] = {}
            held: dict[tuple[int, int], set[str]] = {}
            if not toxic.isdisjoint(seen):
                for i, w in enumerate(words):
                    if w in toxic:
                        c, bare = context(words, i), "".join(filter(str.isalnum, w))
                        for x in known[w]:
                            best[x] = max(best.get(x, 0.0), c)
                            held.setdefault(x, set()).add(bare)
            out.append([((*x, min(len(held[x]), MANY)), c) for x, c in best.items()])
        self.memo.turn()
        return out

    def evidence(self, hits: list[tuple[Hit, float]]) -> float:
        """The weights of the terms' best hits, each further one counting half of the one before."""
        best: dict[int, float] = {}
        for (term, distance, n), c in hits:
            w = self.model.weight(term, distance, n) * c
            best[term] = max(best.get(term, -9.0), w)
        return sum(math.ldexp(w, -i) for i, w in enumerate(sorted(best.values(), reverse=True)))

    def score(self, hits) -> float:
        z = self.model.slope * self.evidence(hits) + self.model.offset
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def context(words: list[str], at: int) -> float:
    """A factor under 1 for a word quoted or talked about, over 1 for one that addresses someone."""
    around = words[max(0, at - WINDOW) : at] + words[at + 1 : at + 1 + WINDOW]
    plain = [x.strip(".,;:!?()" + QUOTES) for x in around]
    quoted = words[at][0] in QUOTES and words[at].rstrip(".,;:!?)")[-1] in QUOTES
    talked = any(x in QUOTING for x in plain)
    if quoted or talked:
        return 0.3 if quoted and talked else 0.6
    return 1.15 if any(x in ADDRESS for x in plain) else 1.0


def features(text: str | None) -> set[str]:
    """Whole words, and word beginnings marked by as many ^ as different words have them, and by fewer, up to MANY; words of
    four letters or more."""
    words = {w for w in WORD.findall((text or "").lower()) if len(w) >= 4}
    stems = Counter(w[:k] for w in words for k in STEMS if len(w) > k)
    return words | {"^" * k + x for x, n in stems.items() for k in range(1, min(n, MANY) + 1)}


def _marked(feature: str) -> tuple[int, str]:
    """In how many words a feature's beginning is (0 for a whole word), and the beginning or word."""
    bare = feature.lstrip("^")
    return len(feature) - len(bare), bare


def is_held_out(doc_id):
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """At most SAMPLE labelled documents of each class that aren't held out: toxic, text."""
    from pyspark.sql import Window

    toxic = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out(F.col("doc_id")))
    toxic = toxic.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.crc32(F.concat(F.lit("s"), F.col("doc_id").cast("string")).cast("binary"))
    parts = [toxic.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(SAMPLE) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.join(F.broadcast(chosen), "doc_id").select("toxic", "text")  # 2 * SAMPLE ids at most


def _count_features(sample: DataFrame) -> DataFrame:
    """feature, toxic and clean: the documents of each class that hold it; those in toxic documents only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())

        def told() -> pd.DataFrame:
            names = list(seen[0].keys() | seen[1].keys())
            out = pd.DataFrame({"feature": names, "clean": [seen[0][x] for x in names], "toxic": [seen[1][x] for x in names]})
            for s in seen:
                s.clear()
            return out

        for b in batches:
            for toxic, text in zip(b["toxic"], b["text"], strict=True):
                seen[1 if toxic else 0].update(features(text))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield told()
        if seen[0] or seen[1]:
            yield told()

    counts = sample.mapInPandas(run, "feature string, clean long, toxic long")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _terms(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """The features that so many toxic documents hold as chance doesn't give the best of all that could be found.

    Hoeffding's bound on the upper tail of a binomial, against the number of features of their kind in LEAST_SUPPORT documents
    or more, for no rarer one could pass.
    """
    n, share = F.col("toxic") + F.col("clean"), n_toxic / (n_toxic + n_clean)
    kind = F.length(F.regexp_extract("feature", r"^\^*", 0))
    tested = {r["kind"]: r["count"] for r in counts.where(n >= LEAST_SUPPORT).groupBy(kind.alias("kind")).count().collect()}  # a row for each kind
    p = F.col("toxic") / n
    kl = p * F.log(p / share) + F.when(p < 1, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    rare = F.col("clean") <= 0.005 * n_clean + 0.1 * F.col("toxic")
    enough = F.lit(False)
    for k, found in tested.items():
        enough = F.when(kind == k, n * kl > math.log(max(found, 2)) + MARGIN).otherwise(enough)
    return counts.where((F.col("toxic") >= LEAST_SUPPORT) & rare & (p > share) & enough)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model learnt from labelled documents; the driver gets the counts of terms that LEAST_SUPPORT or more of at most
    SAMPLE toxic documents hold beyond chance, and a row of numbers for each of at most 2 * SAMPLE documents."""
    spark = docs.sparkSession
    ship_package(spark)
    sample = saved(_sample(docs, labels), "labelled")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sum(n for c, n in sizes.items() if c)
    terms = [(w, False) for w in SEED]
    if not n_clean or not n_toxic:
        return Model(terms)
    counts = saved(_count_features(sample.repartition(max(4, (n_clean + n_toxic) // 500))), "features")
    best = _terms(counts, n_toxic, n_clean).collect()
    best.sort(key=lambda r: (3 * r["clean"] - r["toxic"], len(r["feature"]), r["feature"]))
    names: dict[str, None] = {}
    for r in best:
        n, bare = _marked(r["feature"])
        shorter = ("^" * m + bare[:k] for k in STEMS if len(bare) >= k for m in range(1, max(n, 1) + 1))
        if not any(x in names for x in shorter if x != r["feature"]):
            names[r["feature"]] = None  # no beginning says it that is shorter, or that fewer words need have
    chosen = _explaining(list(names), sample)
    whole: dict[str, list[str]] = {}
    for r in best:
        if not _marked(r["feature"])[0]:
            for k in STEMS:
                whole.setdefault(r["feature"][:k], []).append(r["feature"])
    for n, bare in map(_marked, chosen):
        own = whole.get(bare, []) if n == 1 else [bare]
        # A beginning that one word accounts for is that word, which can then be misspelt.
        terms.append((own[0], False) if n < 2 and len(own) == 1 else (bare, True))
    model = Model(list(dict.fromkeys(terms)))
    return _calibrated(model, sample, n_toxic, n_clean)


def _explaining(names: list[str], sample: DataFrame) -> list[str]:
    """Those of ``names``, strongest first, that LEAST_SUPPORT toxic texts need for an explanation.

    A text with EXPLAINED stronger terms needs no more, so words that copies of one text share
    aren't taken for terms.
    """
    place = {x: i for i, x in enumerate(names)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"own": [sorted(place[x] for x in features(t) if x in place) for t in b["text"]]})

    # A short list for each distinct toxic text of the sample.
    texts = sample.where("toxic <> 0").select("text").distinct()
    own = [r["own"] for r in texts.mapInPandas(run, "own array<int>").collect()]
    needed_by: list[list[int]] = [[] for _ in names]
    for t, x in enumerate(own):
        for i in x:
            needed_by[i].append(t)
    explained, chosen = [0] * len(own), []
    for i, name in enumerate(names):
        if sum(explained[t] < EXPLAINED for t in needed_by[i]) >= LEAST_SUPPORT:
            chosen.append(name)
            for t in needed_by[i]:
                explained[t] += 1
    return chosen


def _calibrated(model: Model, sample: DataFrame, n_toxic: int, n_clean: int) -> Model:
    """Weights of terms by distance, then a logistic curve from evidence to probability."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            hits = [scorer.hits([t or ""])[0] for t in b["text"]]
            yield pd.DataFrame({
                "toxic": b["toxic"].astype(int),
                "hits": [",".join(":".join(map(str, (*x, c))) for x, c in own) for own in hits]})

    rows = [(r["toxic"], [x.split(":") for x in r["hits"].split(",") if x]) for r in sample.mapInPandas(run, "toxic int, hits string").collect()]
    rows = [(y, [((int(t), int(d), int(n)), float(c)) for t, d, n, c in h]) for y, h in rows]
    seen = (Counter(), Counter())
    for y, h in rows:
        seen[1 if y else 0].update(x for x, _ in h)
    for x in seen[0].keys() | seen[1].keys():
        odds = math.log((seen[1][x] + 0.5) / (n_toxic + 1)) - math.log((seen[0][x] + 0.5) / (n_clean + 1))
        # Few documents say little; shrink to the weight that an unseen hit has.
        n = seen[0][x] + seen[1][x]
        prior = 4.0 if x[1] == 0 else 2.5
        model.weights[x] = float(np.clip((n * odds + 2 * prior) / (n + 2), LEAST_WEIGHT, MOST_WEIGHT))
    scorer = Scorer(model)
    e = np.array([scorer.evidence(h) for _, h in rows])
    y = np.array([1.0 if t else 0.0 for t, _ in rows])
    model.slope, model.offset = _logistic(e, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float]:
    """Slope and offset of a ridge logistic regression by Newton's method."""
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * x).sum() + ridge * a, (p - y).sum() + ridge * b])
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(a), float(b)) if a > 0 else (1.0, -2.5)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # EXPLAINED * SAMPLE / LEAST_SUPPORT terms at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in chunks(batch):
                ids = part.column("doc_id").to_pylist()
                s = [scorer.score(h) for h in scorer.hits([t or "" for t in part.column("text").to_pylist()])]
                held = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(held), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())],
                    ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text isn't predicted toxic, with all their columns."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        scorer = Scorer(shared.value)
        for batch in batches:
            for part in chunks(batch):
                hits = scorer.hits([t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array([scorer.score(h) < THRESHOLD for h in hits], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))
