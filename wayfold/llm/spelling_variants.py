"""Spelling variants: words one error apart, found in forward and backward minimal automata.

The vocabulary is sorted by length and word and cut into ranges; each range is a minimal acyclic
automaton, once over its words and once, in an order of its own, over its words reversed.  Nodes count
the words they lead to, so that a walk gives a word's number in its range (a minimal perfect hash).  A
word asks for its neighbours twice: its first half is matched exactly in the forward automata of the
ranges that this half falls into, its second half in the backward ones, and the rest is completed with
one error.  Both ways together find every neighbour; what both find is counted once.

Tasks stream: a range's words build its automaton, then the words that ask follow, in slices of bounded
size.  So a task holds one automaton, whatever the vocabulary; the driver holds the ranges' ends, one
for SHARD words.

Defined results: null and empty texts have no words; a null doc_id counts as an empty string where
occurrences are told apart; rows that repeat a doc_id count each; ties for a form go to the smallest
word in code-point order; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks, settle
from .scratch import release, saved, ship_package, table

# The letters of words, and what tells the occurrences with a missing letter.
LETTERS = "A-Za-zÀ-ÿ"
MISSING = 199
# End of fixed values.

#: Words of a range, and words that ask in one slice of it.
SHARD, SLICE = 1 << 15, 1 << 17
#: Different words that a task counts before it hands them on.
HELD = 1 << 17
LAST = "\U0010ffff"


# Words and their counts


def counted(docs: DataFrame, least_length: int, missing: int = MISSING) -> DataFrame:
    """word, n of all words of ``docs``; an occurrence in ``missing``, told by a checksum, lacks a letter."""
    runs = re.compile(rf"[{LETTERS.replace('A-Z', '')}]{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        total: Counter = Counter()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in chunks(batch):
                for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                    # ASCII letters alone change in the case of bytes.
                    own = Counter(runs.findall((text or b"").lower().decode()))
                    start = zlib.crc32(b"%s:" % (b"" if i is None else b"%d" % i))
                    for w in own:
                        h = zlib.crc32(w.encode(), start)
                        if h % missing:
                            continue
                        at = h % len(w)
                        total[w[:at] + w[at + 1 :]] += own[w]
                        own[w] = 0
                    total.update(own)
                if len(total) > HELD:
                    yield given()
        yield given()

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return found.where((F.length("word") >= least_length) & (F.col("n") > 0)).groupBy("word").agg(F.sum("n").alias("n"))


# Automata


class Automaton:
    """A minimal acyclic automaton of words that are added in order of length, then of code points.

    Words of one length share a root, and all lengths share nodes.  A node is a dict from a letter to
    (node, words before); None is the end.
    """

    def __init__(self):
        self.roots: dict[int, tuple[dict, int]] = {}
        self.numbers: list[int] = []
        self._known: dict[tuple, tuple[dict, int]] = {}
        self._path: list[list] = []  # of the word added last: [letter, its node, words], arcs that are done
        self._last, self._base = "", 0

    def add(self, word: str, number: int) -> None:
        same = 0
        if len(word) == len(self._last):
            while word[same] == self._last[same]:
                same += 1
        else:
            self.close()
            self._base = len(self.numbers)
            self._path = [[]]
        self._fold(same)
        self._path += [[] for _ in range(len(word) - same)]
        self._last = word
        self.numbers.append(number)

    def _fold(self, depth: int) -> None:
        """Replace what lies below ``depth`` on the path by nodes that are known."""
        path, last = self._path, self._last
        while len(path) > depth + 1:
            arcs = path.pop()
            at = len(path) - 1
            if arcs:
                path[at].append((last[at], *self._node(arcs)))
            else:
                path[at].append((last[at], None, 1))

    def _node(self, arcs: list) -> tuple[dict, int]:
        key = tuple([(c, id(x)) for c, x, _ in arcs])
        if (found := self._known.get(key)) is None:
            node, before = {}, 0
            for c, x, n in arcs:
                node[c] = (x, before)
                before += n
            found = self._known[key] = node, before
        return found

    def close(self) -> None:
        """All words of the present length are added."""
        if self._last:
            self._fold(0)
            self.roots[len(self._last)] = self._node(self._path[0])[0], self._base
            self._last, self._path = "", []

    def neighbours(self, word: str, half: int) -> Iterator[int]:
        """Numbers of the words that begin with ``word[:half]`` and are one error from it."""
        size = len(word)
        for wanted in (size - 1, size, size + 1):
            if wanted not in self.roots:
                continue
            node, base = self.roots[wanted]
            for c in word[:half]:
                if node is None or (step := node.get(c)) is None:
                    break
                node, base = step[0], base + step[1]
            else:
                yield from self._completed(node, base, word, half, wanted - size)

    def _completed(self, node: dict | None, base: int, word: str, at: int, change: int) -> Iterator[int]:
        """One error at or after ``at``: a letter lost (-1), replaced (0) or gained (1)."""
        numbers, size = self.numbers, len(word)
        while True:
            here = word[at] if at < size else ""
            if change < 0:
                if not here:
                    return
                # Of equal letters in a row, losing the last says it all.
                if (at + 1 == size or word[at + 1] != here) and (found := _walk(node, base, word, at + 1)) is not None:
                    yield numbers[found]
            elif node is not None and (here or change):
                after = at if change else at + 1
                for c, (x, before) in node.items():
                    if c != here and (found := _walk(x, base + before, word, after)) is not None:
                        yield numbers[found]
            if not here or node is None or (step := node.get(here)) is None:
                return
            node, base, at = step[0], base + step[1], at + 1


def _walk(node: dict | None, base: int, word: str, at: int) -> int | None:
    for i in range(at, len(word)):  # a slice of a very long word would be copied at every letter
        if node is None or (step := node.get(word[i])) is None:
            return None
        node, base = step[0], base + step[1]
    return base


# Ranges


def _ranged(words: DataFrame, n_words: int) -> tuple[DataFrame, list[tuple[int, str]]]:
    """The words in order of length and word, with their number and range; the first of each range.

    A number is the range shifted left by 33, plus the word's place in it.
    """
    shards = max(1, -(-n_words // SHARD))
    dealt = words.withColumn("size", F.length("word")).repartitionByRange(shards, "size", "word").sortWithinPartitions("size", "word")
    out = saved(dealt.withColumn("number", F.monotonically_increasing_id()).withColumn("shard", F.shiftright("number", 33)), "ranges")
    firsts = out.groupBy("shard").agg(F.min(F.struct("size", "word")).alias("first")).orderBy("shard").collect()
    return out, [(r["shard"], r["first"]["size"], r["first"]["word"]) for r in firsts]


def _asked(words: DataFrame, firsts: list[tuple[int, int, str]], least_length: int) -> DataFrame:
    """shard, word, number: each word at the ranges that words with its half, or a letter less of it, may be in."""
    from pyspark.sql import types as T

    starts, ids = [(s, w) for _, s, w in firsts], [i for i, _, _ in firsts]

    def ranges(word: str) -> list[int]:
        half, out = word[: _half(word)], set()
        for size in range(max(least_length, len(word) - 1), len(word) + 2):
            low = max(0, bisect_right(starts, (size, half)) - 1)
            out.update(ids[low : bisect_right(starts, (size, half + LAST))])
        return sorted(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranges(w) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("number"), pa.array(found, pa.list_(pa.int64()))], ["word", "number", "shards"])

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("number", T.LongType()), T.StructField("shards", T.ArrayType(T.LongType()))])
    return words.select("word", "number").mapInArrow(run, schema).select(F.explode("shards").alias("shard"), "word", "number")


def _half(word: str) -> int:
    return len(word) // 2


def _searched(words: DataFrame, asked: DataFrame, backward: bool) -> DataFrame:
    """a, b: numbers of the words that ask and of their neighbours, from one direction."""
    slices = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    build = words.join(slices, "shard").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    own = asked.join(slices, "shard").withColumn("slice", F.pmod(F.xxhash64("number"), F.col("slices")).cast("int"))
    both = build.select("shard", "slice", F.lit(False).alias("asks"), "word", "number").union(own.select("shard", "slice", F.lit(True), "word", "number"))
    ordered = both.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "asks", F.length("word"), "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        key, built, closed = None, Automaton(), False
        for batch in batches:
            a, b = [], []
            columns = [batch.column(c).to_pylist() for c in ("shard", "slice", "asks", "word", "number")]
            for shard, piece, asks, word, number in zip(*columns, strict=True):
                if key != (shard, piece):
                    key, built, closed = (shard, piece), Automaton(), False
                if not asks:
                    built.add(word, number)
                    continue
                if not closed:
                    built.close()
                    closed = True
                found = list(built.neighbours(word, len(word) - _half(word) if backward else _half(word)))
                a += [number] * len(found)
                b += found
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return ordered.mapInArrow(run, "a long, b long")


def near_pairs(words: DataFrame, least_length: int) -> tuple[DataFrame, DataFrame]:
    """The words with their numbers, and a, b: all pairs of them that are one error apart, both ways."""
    n = words.count()
    forward, firsts = _ranged(words, n)
    reverse, lasts = _ranged(forward.select(F.reverse("word").alias("word"), F.col("number").alias("of")), n)
    # The backward automata give the forward numbers.
    behind = reverse.select("shard", "word", F.col("of").alias("number"))
    found = _searched(forward.select("shard", "word", "number"), _asked(forward, firsts, least_length), False)
    found = found.union(_searched(behind, _asked(behind, lasts, least_length), True))
    return forward, found.distinct()


# Forms and roots


def variants(docs: DataFrame, least_length: int = 6, least_n: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of ``docs`` that are long and frequent enough."""
    spark = docs.sparkSession
    ship_package(spark)
    vocabulary = saved(counted(docs, least_length).where(F.col("n") >= least_n), "vocabulary")
    words, pairs = near_pairs(vocabulary.select("word", "n"), least_length)
    # Least first: the largest n, then the smallest number, which is not the smallest word: lengths come first.
    other = words.select(F.col("number").alias("b"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"), F.col("number").alias("at")).alias("near"))
    best = pairs.join(other, "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min("near").alias("near"))
    full = words.select("number", "word", "n").join(best, words["number"] == best["a"], "left")
    wins = -F.col("near.less") >= factor * F.col("n")
    state = saved(full.select(
        "number", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(wins, F.col("near.at")).alias("to"), F.when(wins, F.col("near.word")).alias("form"), F.when(wins, -F.col("near.less")).alias("form_n")), "forms")
    release(vocabulary)
    ends = _ends(state)
    out = state.join(ends, state["number"] == ends["from"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _ends(state: DataFrame) -> DataFrame:
    """from, root: the last word of each chain of forms, by doubling the steps until none goes on.

    Along a chain n grows by the factor, so a chain is as long as the logarithm of a count.
    """
    now = saved(state.where("to IS NOT NULL").select(F.col("number").alias("from"), "to", F.col("form").alias("root")), "steps")
    while True:
        ahead = now.select(F.col("from").alias("mid"), F.col("to").alias("far"), F.col("root").alias("far_root"))
        joined = now.join(ahead, now["to"] == ahead["mid"], "left")
        done = saved(joined.select("from", F.coalesce("far", "to").alias("to"), F.coalesce("far_root", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "steps")
        release(now)
        now = done
        if not done.where("moved").limit(1).count():
            return done.select("from", "root")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple], least_length: int = 6, least_n: int = 5, factor: int = 5) -> list[tuple]:
    """For tests: the rows of :func:`variants` by comparing all pairs of words."""
    n: Counter = Counter()
    for i, text in rows:
        for run in re.findall(f"[{LETTERS}]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % MISSING else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: k for w, k in n.items() if len(w) >= least_length and k >= least_n}

    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, found in around.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= factor * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(around[w]), words[form[w]] if form[w] else None))
    return out


ORACLE_SQL = r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || [8, 7, 6, 5, 4, 3, 2, 1]::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)))),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]{6,}')) AS run
  FROM documents),
held AS MATERIALIZED (SELECT doc, run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten([CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [195, unicode(c) - 64] END FOR c IN string_split(doc || ':' || run, '')]) AS b FROM held),
sums AS (
  SELECT run, n, xor(list_reduce([4294967295] || b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, tab),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN run[1 : h % len(run)] || run[h % len(run) + 2 :] ELSE run END AS word, n FROM sums)
  WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
lacking AS MATERIALIZED (
  SELECT word, pos, word[1 : pos - 1] || word[pos + 1 :] AS rest FROM (SELECT word, unnest(range(1, len(word) + 1)) AS pos FROM words)),
pairs AS MATERIALIZED (
  SELECT a.word AS a, b.word AS b FROM lacking AS a JOIN lacking AS b ON a.rest = b.rest AND a.pos = b.pos AND a.word <> b.word
  UNION SELECT a.word, w.word FROM lacking AS a JOIN words AS w ON w.word = a.rest
  UNION SELECT w.word, a.word FROM lacking AS a JOIN words AS w ON w.word = a.rest),
ranked AS (
  SELECT p.a, p.b, w.n, count(*) OVER (PARTITION BY p.a) AS n_near, row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, p.b) AS k
  FROM pairs AS p JOIN words AS w ON w.word = p.b),
forms AS MATERIALIZED (
  SELECT w.word, w.n, CAST(coalesce(r.n_near, 0) AS BIGINT) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.b END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words AS w LEFT JOIN ranked AS r ON r.a = w.word AND r.k = 1),
chain AS (
  SELECT word, word AS now, 0 AS step FROM forms
  UNION ALL SELECT c.word, f.form, c.step + 1 FROM chain AS c JOIN forms AS f ON f.word = c.now WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(now, step) AS root FROM chain GROUP BY word)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM forms AS f JOIN ends AS e ON e.word = f.word
"""
