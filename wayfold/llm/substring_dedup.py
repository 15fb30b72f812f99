"""Substring deduplication with prefix-partitioned suffix trees.

A run of WINDOW words that also starts in a document with a smaller id is removed.  The suffixes
of all texts are split by the words they begin with, and each part becomes a tree of its own,
small enough for one task; tree nodes WINDOW words deep or more are the repeats.

* Which suffixes can repeat at all is told by their prefixes' counts.  In each window the run of
  GRAM words with the least hash is its anchor, so equal windows have equal anchors at equal places.
  The windows of a text that have the same anchor are neighbours and form a segment; one row for
  each segment stands for all of its suffixes.  Segments whose anchor occurs in one document only
  hold no repeat.
* Segments with the same anchor and the same words are a class, of which only the smallest
  document counts.  Where an anchor has one class, all is known.  Where it has several, the words
  of one segment a class are read, and the suffixes are sorted into a tree.
* The prefix by which suffixes are split is GRAM words where few classes share it.  Where more
  than GROUP do, it is extended to the whole WINDOW, at which depth a part is a single node and its
  smallest document a plain aggregate.  So no part outgrows a task, however common a passage.

Words are runs other than U+0020 and U+0009 to U+000D.  Defined results: a null text has no words;
texts under WINDOW words lose nothing; a row without a doc_id neither loses words nor makes others
lose any; rows that repeat a doc_id don't count against each other; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks
from .scratch import saved, ship_package, table
from .words import grams, hashed_split, lowest_in_window, mixed

#: Words of a repeat, and of the prefix that anchors it.  A segment's windows must fit into 63 bits.
WINDOW, GRAM = 50, 8
#: Classes of an anchor that form a tree by their shortest prefix.
GROUP = 2048
#: Suffixes that are sorted at once.
TREE = 65_536
#: Ids that are broadcast; a longer list is joined by a shuffle.
BROADCAST_IDS = 500_000

_STEP = np.uint64(0xD6E8FEB86659FD93)


def _anchor_places(words: np.ndarray) -> np.ndarray:
    """For each window of WINDOW words the place of its anchor; ignores where texts end."""
    g = grams(words, GRAM)
    width = WINDOW - GRAM + 1
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.array([], dtype=np.int64)
    out, block = np.empty(n, dtype=np.int64), 1 << 23
    for at in range(0, n, block):
        own = g[at : at + block + width - 1]
        # The high bits of the hash with the place below: the leftmost of equal hashes wins.
        v = (own & ~np.uint64(0xFFFFFF)) | np.arange(len(own), dtype=np.uint64)
        low = lowest_in_window(v, width)
        out[at : at + len(low)] = (low & np.uint64(0xFFFFFF)).astype(np.int64) + at
    return out


def segments(words: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, start, anchor offset, number of windows, key and digest of every segment."""
    length = np.diff(edge)
    n = len(words) - WINDOW + 1
    if n <= 0 or not (length >= WINDOW).any():
        none = np.array([], dtype=np.int64)
        return none, none, none, none, none, none
    of = np.repeat(np.arange(len(length)), length)[:n]
    fine = np.arange(n) + WINDOW <= edge[1:][of]
    place = _anchor_places(words)
    at = np.flatnonzero(fine)
    place, of = place[at], of[at]
    new = np.append(True, (place[1:] != place[:-1]) | (of[1:] != of[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, text, anchor = at[first], of[first], place[first]
    key = grams(words, GRAM)[anchor]
    # A polynomial over the words' hashes, shifted to begin at power 0 by an odd step's inverse.
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(words), _STEP, dtype=np.uint64)))
    back = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(words), np.uint64(pow(int(_STEP), -1, 1 << 64)), dtype=np.uint64)))
    total = np.append(np.uint64(0), np.cumsum(mixed(words) * power[:-1], dtype=np.uint64))
    digest = (total[start + count - 1 + WINDOW] - total[start]) * back[start]
    digest = mixed(digest ^ ((anchor - start) * 64 + count).astype(np.uint64))
    return text, start - edge[:-1][text], anchor - start, count, key.view(np.int64), digest.view(np.int64)


def suffix_tree(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of rows of words, and how many words each has in common with the one before.

    The two arrays are the tree: its nodes are the maximal ranges whose common lengths don't fall
    below a depth.
    """
    rows = np.ascontiguousarray(suffixes)
    order = np.argsort(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), kind="stable")
    common = np.zeros(len(rows), dtype=np.int64)
    if len(rows) > 1:
        same = rows[order[1:]] == rows[order[:-1]]
        common[1:] = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    return order, common


def _smallest_of_node(suffixes: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each suffix the smallest document below its node of depth WINDOW."""
    order, common = suffix_tree(suffixes)
    starts = np.flatnonzero(common < WINDOW)
    low = np.minimum.reduceat(least[order], starts)
    out = np.empty(len(least), dtype=least.dtype)
    out[order] = np.repeat(low, np.diff(np.append(starts, len(least))))
    return out


def _texts(batch: pa.RecordBatch) -> list[list[bytes]]:
    return [(t or b"").split() for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _name(words: list[bytes]) -> tuple[bytes, int]:
    """SHA-256 of the words joined by a space, and its first 64 bits, which name the text."""
    digest = hashlib.sha256(b" ".join(words)).digest()
    return digest, int.from_bytes(digest[:8], "little", signed=True)


def _scan(docs: DataFrame) -> DataFrame:
    """A row for each document (windows = 0) and for each of its segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                split = _texts(part)
                ids = part.column("doc_id")
                names = [_name(w) for w in split]
                words, edge = hashed_split(split)
                text, start, offset, count, key, digest = segments(words, edge)
                known = np.array([i is not None for i in ids.to_pylist()], dtype=bool)
                fine = known[text] if len(text) else np.array([], dtype=bool)
                text, start, offset, count, key, digest = (x[fine] for x in (text, start, offset, count, key, digest))
                n, m = len(split), len(text)
                rows = np.append(np.arange(n), text)
                zero = np.zeros(n, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows)), pa.array([x for _, x in names], pa.int64()).take(pa.array(rows)),
                     pa.array(np.append(np.diff(edge), np.zeros(m, dtype=np.int64)), pa.int64()),
                     pa.array([d for d, _ in names] + [None] * m, pa.binary()),
                     pa.array(np.append(zero, count), pa.int32()), pa.array(np.append(zero, start), pa.int32()),
                     pa.array(np.append(zero, offset), pa.int32()), pa.array(np.append(zero, key)), pa.array(np.append(zero, digest))],
                    ["doc_id", "name", "n_words", "sha", "windows", "start", "offset", "key", "digest"])

    schema = "doc_id long, name long, n_words long, sha binary, windows int, start int, offset int, key long, digest long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _restrict(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids; a short list is broadcast, a long one shuffled."""
    n = ids.count()
    docs, ids = docs.select("doc_id", "text"), ids.select(F.col("doc_id").alias("__id"))
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge")
    return docs.join(ids, docs["doc_id"].cast("long") == ids["__id"], "left_semi")


def _read_classes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of one segment of each class: wanted rows with ``words`` (64-bit hashes)."""
    per_doc = wanted.groupBy("doc_id", "name").agg(F.collect_list(F.struct("key", "digest", "start", "offset", "windows", "large")).alias("own"))
    per_doc = saved(per_doc, "wanted")
    rows = _restrict(docs, per_doc.select("doc_id").distinct()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.join(per_doc.hint("merge"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                split = _texts(part)
                words, edge = hashed_split(split)
                out: dict[str, list] = {c: [] for c in ("key", "digest", "least", "offset", "windows", "large", "words")}
                for i, (doc, name, own) in enumerate(zip(part.column("doc_id").to_pylist(), part.column("name").to_pylist(), part.column("own").to_pylist(), strict=True)):
                    if _name(split[i])[1] != name:
                        continue  # another text under the same id
                    for x in own:
                        at = edge[i] + x["start"]
                        out["words"].append(words[at : at + x["windows"] - 1 + WINDOW].tobytes())
                        out["least"].append(doc)
                        for c in ("key", "digest", "offset", "windows", "large"):
                            out[c].append(x[c])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return rows.mapInArrow(run, "key long, digest long, least long, offset int, windows int, large boolean, words binary")


def _unfolded(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the segments, cut to WINDOW words, with the row and the window of each."""
    windows = part.column("windows").to_numpy()
    words = [np.frombuffer(x, dtype=np.uint64) for x in part.column("words").to_pylist()]
    flat = np.concatenate(words)
    first = np.cumsum([0, *map(len, words)])[:-1]
    row = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    return flat[(first[row] + nth)[:, None] + np.arange(WINDOW)[None, :]], row, nth


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about TREE suffixes that don't cut an anchor's classes apart."""
    key = batch.column("key").to_numpy()
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    total = np.append(0, np.cumsum(batch.column("windows").to_numpy()))
    at = 0
    while at < len(key):
        fit = ends[(ends > at) & (total[ends] <= total[at] + TREE)]
        end = int(fit[-1]) if len(fit) else int(ends[np.searchsorted(ends, at, side="right")])
        yield batch.slice(at, end - at)
        at = end


def _small_parts(classes: DataFrame) -> DataFrame:
    """key, digest, mask: the windows of each class that a smaller document has, by trees."""

    def masks(part: pa.RecordBatch) -> pa.RecordBatch:
        suffixes, row, nth = _unfolded(part)
        least = part.column("least").to_numpy()
        hit = _smallest_of_node(suffixes, least[row]) < least[row]
        mask = np.zeros(part.num_rows, dtype=np.int64)
        np.bitwise_or.at(mask, row[hit], np.int64(1) << nth[hit])
        return pa.RecordBatch.from_arrays([part.column("key"), part.column("digest"), pa.array(mask)], ["key", "digest", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # classes of the last anchor, at most GROUP
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            key = whole.column("key").to_numpy()
            cut = len(key) - int(np.searchsorted(key[::-1] != key[-1], True))
            for part in _pieces(whole.slice(0, cut)) if cut else ():
                yield masks(part)
            held = [whole.slice(cut)]
        for part in held:
            yield masks(part)

    ordered = classes.where("NOT large").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "key long, digest long, mask long").where("mask <> 0")


def _large_parts(classes: DataFrame) -> DataFrame:
    """The same for anchors with many classes: parts by whole windows, each of them one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                suffixes, row, nth = _unfolded(part)
                w = np.arange(1, WINDOW + 1, dtype=np.uint64)
                one = mixed((mixed(suffixes ^ w) * (2 * w + np.uint64(1))).sum(axis=1, dtype=np.uint64))
                two = mixed((mixed(suffixes * _STEP + w) * (2 * w[::-1] + np.uint64(1))).sum(axis=1, dtype=np.uint64))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(nth, pa.int32()), *(part.column(c).take(take) for c in ("key", "digest", "least"))],
                    ["one", "two", "nth", "key", "digest", "least"])

    rows = saved(classes.where("large").mapInArrow(run, "one long, two long, nth int, key long, digest long, least long"), "windows")
    nodes = saved(rows.groupBy("one", "two").agg(F.min("least").alias("low")), "nodes")
    hit = rows.join(nodes.hint("merge"), ["one", "two"]).where("low < least")
    return hit.groupBy("key", "digest").agg(F.expr("bit_or(shiftleft(1L, nth))").alias("mask"))


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each document, the windows to remove by text as (start, windows, mask))."""
    ship_package(docs.sparkSession)
    rows = saved(_scan(docs), "scan")
    own = rows.where("windows > 0").select("doc_id", "name", "windows", "start", "offset", "key", "digest")
    keys = own.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    keys = saved(keys.select("key"), "keys")
    members = saved(own.join(keys.hint("merge"), "key", "left_semi"), "members")
    least = F.min(F.struct("doc_id", "name", "start")).alias("least")
    classes = members.groupBy("key", "digest").agg(least, F.first("offset").alias("offset"), F.first("windows").alias("windows"))
    classes = saved(classes, "classes")
    several = saved(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", (F.col("n") > GROUP).alias("large")), "several")
    wanted = classes.join(several.hint("merge"), "key").select("key", "digest", "least.doc_id", "least.name", "least.start", "offset", "windows", "large")
    read = saved(_read_classes(docs, wanted), "read")
    masks = _small_parts(read).unionByName(_large_parts(read))
    decided = classes.join(masks.hint("merge"), ["key", "digest"], "left").select("key", "digest", F.col("least.doc_id").alias("least"), F.coalesce("mask", F.lit(0)).alias("mask"))
    decided = saved(decided, "decided")
    every = F.lit((1 << (WINDOW - GRAM + 1)) - 1)
    hit = members.join(decided.hint("merge"), ["key", "digest"]).withColumn("mask", F.when(F.col("doc_id") > F.col("least"), every).otherwise(F.col("mask")))
    hit = hit.where("mask <> 0").groupBy("doc_id", "name").agg(F.collect_list(F.struct("start", "windows", "mask")).alias("hits"))
    return rows.where("windows = 0").select("doc_id", "name", "n_words", "sha"), saved(hit, "hits")


def _covered(n: int, hits: list[dict]) -> np.ndarray:
    """Which of n words the windows in ``hits`` cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    start = np.array([x["start"] for x in hits])
    count = np.array([x["windows"] for x in hits])
    mask = np.array([x["mask"] for x in hits])
    nth = np.arange(WINDOW - GRAM + 1)
    on = ((mask[:, None] >> nth) & 1).astype(bool) & (nth < count[:, None])
    at = (start[:, None] + nth)[on]
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return np.cumsum(edge)[:n] > 0


def _touched(docs: DataFrame, hits: DataFrame) -> DataFrame:
    rows = _restrict(docs, hits.select("doc_id").distinct())
    own = hits.select(F.col("doc_id").alias("__doc"), F.col("name").alias("__name"), F.col("hits").alias("__hits"))
    return rows.join(own.hint("merge"), rows["doc_id"].cast("long") == own["__doc"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows, hits = _found(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                ids, names, removed, digest = [], [], [], []
                for doc, name, found, words in zip(part.column("__doc").to_pylist(), part.column("__name").to_pylist(), part.column("__hits").to_pylist(), _texts(part), strict=True):
                    if _name(words)[1] == name:
                        gone = _covered(len(words), found)
                        ids.append(doc)
                        names.append(name)
                        removed.append(int(gone.sum()))
                        digest.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])).hexdigest())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "name", "removed", "kept"])

    changed = _touched(docs, hits).select("text", "__doc", "__name", "__hits").mapInArrow(run, "doc_id long, name long, removed long, kept string")
    changed = saved(changed.distinct(), "changed")
    out = rows.join(changed.hint("merge"), ["doc_id", "name"], "left")
    return out.select("doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", F.lower(F.hex("sha"))).alias("kept_sha256"))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, start, end: the stretches of words to remove, end exclusive."""
    _, hits = _found(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc, found in zip(batch.column("doc_id").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                gone = _covered(max(x["start"] + x["windows"] for x in found) + WINDOW, found).astype(np.int8)
                turn = np.diff(np.concatenate([[0], gone, [0]]))
                for a, b in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist(), strict=True):
                    for c, x in zip(out, (doc, a, b), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "end"])

    return hits.select("doc_id", "hits").mapInArrow(run, "doc_id long, start long, end long")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """For tests: (doc_id, n_words, n_removed, kept_sha256) with a dict of all windows."""
    import re

    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first: dict[tuple, int] = {}
    for i, w in split:
        for k in range(len(w) - WINDOW + 1) if i is not None else ():
            x = tuple(w[k : k + WINDOW])
            first[x] = min(first.get(x, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - WINDOW + 1) if i is not None else ():
            if first[tuple(w[k : k + WINDOW])] < i:
                gone[k : k + WINDOW] = [True] * WINDOW
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
h AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d WHERE len(w) >= {WINDOW})),
m AS (SELECT g, min(doc_id) AS low FROM h GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM h JOIN m USING (g) WHERE low < doc_id),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
