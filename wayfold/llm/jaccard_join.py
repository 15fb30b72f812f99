"""N-gram Jaccard self-join by a grouped prefix join, and its components.

Documents with the same shingle set are one set.  Under a global order of shingles two sets
with Jaccard similarity t or more share one of the first ``n - ceil(t * n) + 1`` shingles of
each, the prefix; sets that meet under a shingle are candidates if their sizes, and what is left of
each set from there on, allow.  The order is by hash, but popular shingles come last, by their
counts, so that passages which many documents share seldom lead to a candidate.  That order is
only a matter of speed: any order finds all links.

* Sets with equal prefixes and sizes meet under every shingle of the prefix; they are collapsed
  into one group, groups are paired and filtered by size, and pairs of groups and of members
  expand into pairs of sets.
* A pair of sets is first bounded by counts of shingles per hash bucket, then verified exactly.
* More than MEETING groups under one shingle are a crowd, which is not paired out.  Its sets are
  compared with a leader, verified, and joined into components, in ROUNDS rounds with other
  leaders.  Sets that are then still outside the largest component of a crowd ask, block by block,
  for the nearest others that are not in their component and that parities of hash buckets don't tell
  apart: NEAREST of them, then the next ones, until none is left.  A round makes a bounded number of
  rows for each set and block, and joins components as it goes.  Nothing is skipped: two sets in one
  component need no further comparison, any others get one.
* Groups under the hottest shingles (over HOT sets have them) are a crowd at once, so that no task
  sorts them.
* Sets are told apart by 128 bits of their shingles' hashes, and numbered; a group's name is a hash of
  64 bits, and groups or crowds that share a name only meet more often than they need to.

Defined results: a null text, or one without words, has no shingles and links to nothing; a text
of fewer words than a shingle is one shingle; rows that repeat a doc_id give a row each, linked
by their texts; a row without a doc_id links to nothing and has no component; an empty table gives
an empty result; extra columns are ignored by :func:`classes`, kept by :func:`one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import Memo, chunks, settle
from .components import components
from .scratch import release, saved, ship_package, table, unused
from .words import grams, hashed, mixed

#: Words in a shingle, and the similarity in percent that links two sets.
SHINGLE, PERCENT = 5, 80
#: A shingle of more sets goes to the end of the order, if it is one of the FLAGS most frequent.
POPULAR, FLAGS = 40, 1_000_000
#: Popular shingles are looked for in sets that have one among the first 1/SCOUT of their prefix.
SCOUT = 4
#: Groups under a shingle that are paired out.
MEETING = 64
#: A shingle that so many sets have gives a crowd without being sorted.
HOT = 4096
#: Rounds of leaders before what is left of a crowd is compared.
ROUNDS = 2
#: Nearest others that a set asks for at first, in a block of a crowd; later rounds go so many times further.
NEAREST = 8
#: Sets in a block of those that ask, and of those that are asked.
ASKING, ASKED = 1024, 8192
#: Hash buckets of the bound.
BUCKETS = 256
#: 64-bit words of the parities that tell sets in crowds apart.
PARITY = 8
#: Ids that are broadcast; a longer list is joined by a shuffle.
BROADCAST_IDS = 500_000


def prefix_length(n):
    return n - (PERCENT * n + 99) // 100 + 1


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and where each text's begin and end."""
    words, edge = hashed([t.lower() for t in texts])
    length = np.diff(edge)
    of = np.repeat(np.arange(len(texts)), length)
    last = np.repeat(edge[1:], length)
    whole = np.arange(len(words)) + SHINGLE <= last
    g = grams(words, SHINGLE)
    h, d = g[whole[: len(g)]], of[whole]
    for i in np.flatnonzero((length > 0) & (length < SHINGLE)):
        own = words[edge[i] : edge[i + 1]]
        h = np.append(h, mixed(grams(own, len(own)) ^ np.uint64(len(own))))
        d = np.append(d, i)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(len(texts) + 1))


class Popular:
    """Popular shingles, ascending, the place of each in the order by count, and the hottest of them."""

    def __init__(self, shingles: np.ndarray, place: np.ndarray, hottest: np.ndarray | None = None):
        self.shingles, self.place, self.hottest = shingles, place, hottest
        self.low = np.zeros(1 << 20, dtype=bool)
        self.low[(shingles & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each shingle, -1 for those that aren't popular."""
        out = np.full(len(h), -1, dtype=np.int64)
        at = np.flatnonzero(self.low[(h & np.uint64(0xFFFFF)).astype(np.int64)])
        if len(at):
            near = np.minimum(np.searchsorted(self.shingles, h[at]), len(self.shingles) - 1)
            out[at] = np.where(self.shingles[near] == h[at], self.place[near], -1)
        return out


def _prefix(h: np.ndarray, place: np.ndarray, p: int) -> np.ndarray:
    """The first p shingles of a set: those that aren't popular by hash, then popular ones by count."""
    popular = place >= 0
    if popular[:p].any():
        rare = h[~popular][:p]
        h = np.concatenate([rare, h[popular][np.argsort(place[popular], kind="stable")][: p - len(rare)]])
    return h[:p]


def _ids(own: bytes) -> tuple[int, int]:
    """The id of a set: 128 bits as two longs."""
    digest = xxhash.xxh3_128_digest(own)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _tokens(docs: DataFrame, shared: Broadcast | None) -> DataFrame:
    """Shingles of sets: the first of each prefix, or all of the sets that have a scouted one there.

    A set counts once a task, as far as the task remembers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        seen = Memo(200_000)
        known = None if shared is None else Popular(shared.value, np.zeros(len(shared.value), dtype=np.int64))
        for batch in batches:
            for part in chunks(batch):
                h, edge = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                hit = None if known is None else known.places(h) >= 0
                out = []
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    few = max(3, prefix_length(b - a) // SCOUT)
                    if b == a or (hit is not None and not hit[a : min(b, a + few)].any()):
                        continue
                    key = xxhash.xxh3_128_digest(h[a:b].tobytes())
                    if seen.absent({key}):
                        seen.new[key] = True
                        out.append(h[a : min(b, a + few) if hit is None else b])
                seen.turn()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(out)))], ["token"])

    return docs.select("text").mapInArrow(run, "token long")


def _frequent(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most FLAGS shingles of a count over POPULAR, the most frequent, and their counts."""
    counts = tokens.groupBy("token").count().where(F.col("count") > POPULAR)
    top = counts.orderBy(F.col("count").desc(), "token").limit(FLAGS).toPandas()
    token = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["count"].to_numpy(dtype=np.int64)[order]


def popular_shingles(docs: DataFrame) -> Popular | None:
    scouted, _ = _frequent(_tokens(docs, None))
    if not len(scouted):
        return None
    shared = docs.sparkSession.sparkContext.broadcast(scouted)  # FLAGS shingles at most
    shingles, count = _frequent(_tokens(docs, shared))
    shared.destroy()
    if not len(shingles):
        return None
    place = np.empty(len(shingles), dtype=np.int64)
    place[np.lexsort((shingles, count))] = np.arange(len(shingles))
    return Popular(shingles, place, _signed(shingles[count > HOT]))


def _sets(docs: DataFrame, popular: Popular | None) -> DataFrame:
    """doc_id, key (a hash of the text), n, the set's id (two longs), bucket counts, parities, and prefix
    (null where a task gave it before, or the row has no doc_id)."""
    shared = docs.sparkSession.sparkContext.broadcast(popular)  # FLAGS shingles at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known, seen = shared.value, Memo(200_000)
        for batch in batches:
            for part in chunks(batch):
                h, edge = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                n = np.diff(edge)
                place = known.places(h) if known is not None else np.full(len(h), -1)
                bucket = np.repeat(np.arange(len(n)), n) * BUCKETS + (h & np.uint64(BUCKETS - 1)).astype(np.int64)
                counts = np.minimum(np.bincount(bucket, minlength=len(n) * BUCKETS), 255).astype(np.uint8).reshape(len(n), BUCKETS)
                bit = np.repeat(np.arange(len(n)), n) * (64 * PARITY) + ((h >> np.uint64(8)) % np.uint64(64 * PARITY)).astype(np.int64)
                odd = np.packbits((np.bincount(bit, minlength=len(n) * 64 * PARITY) & 1).astype(np.uint8)).view(np.int64).reshape(len(n), PARITY)
                id1, id2, sketch, prefix = [], [], [], []
                ids = part.column("doc_id").to_pylist()
                for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
                    digest = _ids(h[a:b].tobytes())
                    id1.append(digest[0])
                    id2.append(digest[1])
                    sketch.append(counts[i].tobytes() if b > a else None)
                    if b > a and ids[i] is not None and seen.absent({digest}):
                        seen.new[digest] = True
                        prefix.append(_signed(_prefix(h[a:b], place[a:b], prefix_length(b - a))))
                    else:
                        prefix.append(None)
                seen.turn()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(id1, pa.int64()), pa.array(id2, pa.int64()),
                     pa.array(sketch, pa.binary()), pa.array(list(odd), pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64()))],
                    ["doc_id", "key", "n", "id1", "id2", "sketch", "parity", "prefix"])

    schema = "doc_id long, key long, n long, id1 long, id2 long, sketch binary, parity array<long>, prefix array<long>"
    out = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, schema), "sets")
    shared.destroy()
    return out


def _compatible(n_a, n_b, left_a=None, left_b=None):
    """Whether sizes, and what is left of each set from the shingle they meet under, allow the similarity.

    If it is the first they share, what they share lies in what is left; if it isn't, they also
    meet under the first.
    """
    fine = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT
    if left_a is not None:
        fine = fine & (F.least(left_a, left_b) * (100 + PERCENT) >= (n_a + n_b) * PERCENT)
    return fine


def _near_enough(a: str, b: str, n_a, n_b):
    """Whether the parities allow the similarity: a bit that differs is a shingle that only one set has."""
    apart = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITY)), F.lit(0))
    return apart * (100 + PERCENT) <= (n_a + n_b) * (100 - PERCENT)


def _meetings(entries: DataFrame) -> DataFrame:
    """Pairs of groups that meet under a shingle (x, y), and the groups under shingles with too many
    (x: the shingle, y: the group, left: what is left of it).

    Reads (token, n, gid, left) sorted; holds no more than a batch and MEETING rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.array([], dtype=np.int64)
        held = [empty, empty, empty, empty]
        hot: int | None = None  # the shingle at hand, once known to have too many

        def rows(a, b, token, gid, left) -> pa.RecordBatch:
            is_hot = np.append(np.zeros(len(a), dtype=bool), np.ones(len(token), dtype=bool))
            left = np.append(np.zeros(len(a), dtype=np.int64), left)
            return pa.RecordBatch.from_arrays([pa.array(is_hot), pa.array(np.append(a, token)), pa.array(np.append(b, gid)), pa.array(left)], ["hot", "x", "y", "left"])

        def told(token, n, gid, left) -> Iterator[pa.RecordBatch]:
            """Rows of complete shingles."""
            if not len(token):
                return
            new = np.append(True, token[1:] != token[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(token)))
            many = np.repeat(size > MEETING, size)
            t, m, g, rest = token[~many], n[~many], gid[~many], left[~many]
            a, b, at = [empty], [empty], np.arange(len(t))
            for k in range(1, MEETING):
                at = at[at + k < len(t)]
                at = at[t[at] == t[at + k]]
                if not len(at):
                    break
                fine = (m[at] * 100 >= m[at + k] * PERCENT) & (np.minimum(rest[at], rest[at + k]) * (100 + PERCENT) >= (m[at] + m[at + k]) * PERCENT)
                a.append(g[at[fine]])
                b.append(g[at[fine] + k])
            pairs = np.stack([np.concatenate(a), np.concatenate(b)], axis=1)
            if len(pairs):
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
            if len(pairs) or many.any():
                yield rows(pairs[:, 0], pairs[:, 1], token[many], gid[many], left[many])

        for batch in batches:
            token, n, gid, left = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in zip(held, ("token", "n", "gid", "left"), strict=True))
            keep = np.append(True, (token[1:] != token[:-1]) | (gid[1:] != gid[:-1]) | (n[1:] != n[:-1]) | (left[1:] != left[:-1]))[: len(token)]
            token, n, gid, left = token[keep], n[keep], gid[keep], left[keep]
            if hot is not None and len(token):
                same = int(np.searchsorted(token != hot, True)) if token[0] == hot else 0
                if same:
                    yield rows(empty, empty, token[:same], gid[:same], left[:same])
                    token, n, gid, left = token[same:], n[same:], gid[same:], left[same:]
                if len(token):
                    hot = None
            if not len(token):
                held = [empty, empty, empty, empty]
                continue
            cut = len(token) - int(np.searchsorted(token[::-1] != token[-1], True))
            if len(token) - cut > MEETING:
                hot, cut = int(token[-1]), len(token)
            yield from told(token[:cut], n[:cut], gid[:cut], left[:cut])
            held = [token[cut:], n[cut:], gid[cut:], left[cut:]]
        yield from told(*held)

    ordered = entries.repartition("token").sortWithinPartitions("token", "n", "gid", "left")
    return ordered.select("token", "n", "gid", "left").mapInArrow(run, "hot boolean, x long, y long, left long")


def _within_bound(pairs: DataFrame) -> DataFrame:
    """Pairs (with n and sketch of both sides) whose bucket counts allow the similarity."""
    keep = [c for c in pairs.columns if not c.startswith("sketch")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint8).reshape(-1, BUCKETS) for c in ("sketch_a", "sketch_b"))
                most = np.minimum(a, b).sum(axis=1, dtype=np.int64)
                total = part.column("n_a").to_numpy() + part.column("n_b").to_numpy()
                full = ((a == 255) & (b == 255)).any(axis=1)
                fine = full | (most * 100 >= PERCENT * (total - most))
                yield part.filter(pa.array(fine)).select(keep)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in keep)
    return pairs.mapInArrow(run, schema)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of sets (a, b) whose bucket counts allow the similarity, with their ids and representatives."""
    for side in "ab":
        named = [F.col(c).alias(f"{c}_{side}") for c in ("rep", "id1", "id2", "n", "sketch")]
        pairs = pairs.join(sets.select(F.col("sid").alias(side), *named).hint("merge"), side)
    pairs = pairs.where(_compatible(F.col("n_a"), F.col("n_b")))
    return saved(_within_bound(pairs).drop("n_a", "n_b"), "bounded")


def _restrict(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids; a short list is broadcast, a long one shuffled."""
    n = ids.count()
    docs, ids = docs.select("doc_id", "text"), ids.select(F.col(ids.columns[0]).alias("__id"))
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids.hint("merge")
    return docs.join(ids, docs["doc_id"].cast("long") == ids["__id"], "left_semi")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b of the pairs whose shingle sets are similar enough, exactly."""
    if pairs.isEmpty():
        return pairs.select("a", "b")
    ids = pairs.select(F.col("rep_a").alias("id")).union(pairs.select("rep_b")).distinct()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in chunks(batch):
                h, edge = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                own = [h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                names = [_ids(x) for x in own]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in names], pa.int64()), pa.array([x for _, x in names], pa.int64()), pa.array(own, pa.binary())], ["id1", "id2", "shingles"])

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = []
            for a, b in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                a, b = np.frombuffer(a.as_buffer(), dtype=np.uint64), np.frombuffer(b.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                fine.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(fine, pa.bool_()))

    # Where rows repeat an id with other texts, more sets come along than were asked for.
    shingles = saved(_restrict(docs, ids).select("text").mapInArrow(sets, "id1 long, id2 long, shingles binary"), "shingles")
    out = pairs.select("a", "b", "id1_a", "id2_a", "id1_b", "id2_b")
    for side in "ab":
        own = [f"id1_{side}", f"id2_{side}"]
        s = shingles.select(F.col("id1").alias(own[0]), F.col("id2").alias(own[1]), F.col("shingles").alias(f"s_{side}"))
        out = out.join(s.hint("merge"), own).drop(*own)
    links = saved(out.mapInArrow(similar, "a long, b long").distinct(), "links")
    release(shingles, pairs)
    return links


def _ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _crowded_links(docs: DataFrame, crowded: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and those among sets that meet in crowds (crowd, sid, n, left, parity)."""
    for seed in range(ROUNDS):
        marked = _outside(crowded, links)
        if marked is None:
            return links
        rest = marked.where("part <> main").select("crowd", *(F.col(c).alias(f"{o}_a") for c, o in (("sid", "id"), ("n", "n"), ("left", "left"), ("parity", "parity"))))
        # A leader for each crowd, from its largest component: first a set of which most is left, so
        # one with few shingles of its own, then any.
        by = -F.col("left") if seed == 0 else F.xxhash64("sid", F.lit(seed))
        lead = F.min(F.struct(by.alias("by"), "sid", "n", "left", "parity")).alias("lead")
        other = marked.where("part = main").groupBy("crowd").agg(lead)
        other = saved(other.select("crowd", F.col("lead.sid").alias("id_b"), F.col("lead.n").alias("n_b"), F.col("lead.left").alias("left_b"), F.col("lead.parity").alias("parity_b")), "leaders")
        fine = _compatible(F.col("n_a"), F.col("n_b"), F.col("left_a"), F.col("left_b")) & _near_enough("parity_a", "parity_b", F.col("n_a"), F.col("n_b"))
        met = rest.join(other.hint("merge"), "crowd").where(fine).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
        links = _more_links(docs, met, sets, links)
        release(marked, other)
    first, low, high = _outside(crowded, links), 0, NEAREST
    marked = None if first is None else first.withColumn("now", F.col("part"))
    while marked is not None:
        met = saved(_nearest(marked, low, high), "nearest")
        links = _more_links(docs, met.where("b IS NOT NULL").select("a", "b"), sets, links)
        further = not met.where("b IS NULL").isEmpty()
        release(met)
        if not further:
            break
        low, high = high, high * NEAREST
        label = components(links).select(F.col("node").alias("sid"), F.col("component").alias("now"))
        marked = saved(first.join(label.hint("merge"), "sid", "left").withColumn("now", F.coalesce("now", "sid")), "marked")
    return links


def _more_links(docs: DataFrame, met: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and those of the pairs that are similar enough."""
    met = saved(_ordered_pairs(met), "met")
    found = _verified(docs, _with_sets(met, sets))
    out = saved(links.unionByName(found).distinct(), "links")
    release(links, found, met)
    return out


def _outside(crowded: DataFrame, links: DataFrame) -> DataFrame | None:
    """The rows of crowds of several components with their component (part) and the crowd's largest (main)."""
    label = components(links).withColumnRenamed("node", "sid")
    named = crowded.join(label.hint("merge"), "sid", "left")
    named = saved(named.select("crowd", "sid", "n", "left", "parity", F.coalesce("component", "sid").alias("part")), "named")
    sizes = named.groupBy("crowd", "part").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("crowd").agg(F.max(F.struct("size", "part")).alias("top"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("parts"))
    main = saved(main.where("parts > 1").select("crowd", F.col("top.part").alias("main"), "size", (F.col("size") - F.col("top.size")).alias("rest")), "main")
    out = None if main.isEmpty() else saved(named.join(main.hint("merge"), "crowd"), "marked")
    release(named, main)
    return out


def _nearest(marked: DataFrame, low: int, high: int) -> DataFrame:
    """a, b: others that sets outside the largest component of a crowd are compared with.

    Those are ranked by how many parities differ, in each block of the crowd; the ranks from ``low`` to
    before ``high`` are given, but for others that are in the same component by now.  A null b
    tells that there are further ones.  The ranking doesn't change between calls.
    """

    def run(asking: pa.Table, asked: pa.Table) -> pa.Table:
        found, told = [np.array([], dtype=np.int64)] * 2, []
        if asking.num_rows and asked.num_rows:
            column = lambda t, c: t.column(c).to_numpy()
            matrix = lambda t: t.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITY)
            own = [column(asking, c).tolist() for c in ("sid", "n", "left", "part", "now")]
            sid, n, left, part, now, main = (column(asked, c) for c in ("sid", "n", "left", "part", "now", "main"))
            parity, central, a_of, b_of = matrix(asked), part == main, [], []
            for bits, x, m, rest, p, here in zip(matrix(asking), *own, strict=True):
                fine = (part != p) & (central | (sid > x)) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT)
                at = np.flatnonzero(fine & (np.minimum(left, rest) * (100 + PERCENT) >= (n + m) * PERCENT))
                apart = np.bitwise_count(parity[at] ^ bits).sum(axis=1, dtype=np.int64)
                near = apart * (100 + PERCENT) <= (n[at] + m) * (100 - PERCENT)
                at, apart = at[near], apart[near]
                if len(at) > low:
                    at = at[np.lexsort((sid[at], apart))]
                    other = at[low:high][now[at[low:high]] != here]
                    a_of.append(np.full(len(other), x))
                    b_of.append(sid[other])
                    if (now[at[high:]] != here).any():
                        told.append(x)
            if a_of:
                found = [np.concatenate(a_of), np.concatenate(b_of)]
        a = np.concatenate([found[0], np.array(told, dtype=np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array([*found[1].tolist(), *[None] * len(told)], pa.int64())})

    block = lambda seed, rows, size: F.pmod(F.xxhash64("sid", F.lit(seed)), F.ceil(F.col(rows) / size)).cast("int")
    blocks = lambda rows, size: F.explode(F.sequence(F.lit(0), (F.ceil(F.col(rows) / size) - 1).cast("int")))
    columns = ("crowd", "sid", "n", "left", "parity", "part", "now", "main")
    asking = marked.where("part <> main").select(*columns, block(1, "rest", ASKING).alias("i"), blocks("size", ASKED).alias("j"))
    asked = marked.select(*columns, block(2, "size", ASKED).alias("j"), blocks("rest", ASKING).alias("i"))
    key = ("crowd", "i", "j")
    return asking.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(run, "a long, b long")


def links_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sets, links): a row for each document, each distinct set, and each link between sets.

    The links hold a forest of every component at least, and all links but for those between sets
    of one component that meet in crowds only.
    """
    spark = docs.sparkSession
    ship_package(spark)
    popular = popular_shingles(docs)
    rows = _sets(docs, popular)
    fine = rows.where("n > 0 AND doc_id IS NOT NULL")
    sets = fine.groupBy("id1", "id2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("parity").alias("parity"))
    sets = saved(sets.withColumn("sid", F.monotonically_increasing_id()), "distinct")
    # Sets with equal prefixes and sizes are one group, named by a hash of both.
    heads = rows.where("prefix IS NOT NULL").select("id1", "id2", "n", "prefix", F.xxhash64("prefix", "n").alias("gid"))
    entries = heads.select(F.posexplode("prefix").alias("pos", "token"), "n", "gid").select("token", "n", "gid", (F.col("n") - F.col("pos")).alias("left"))
    hot = None
    if popular is not None and len(popular.hottest):
        hottest = F.broadcast(spark.createDataFrame(pd.DataFrame({"token": popular.hottest})))  # FLAGS shingles at most
        hot = entries.join(hottest, "token", "left_semi").select(F.col("token").alias("x"), F.col("gid").alias("y"), "left").distinct()
        entries = entries.join(hottest, "token", "left_anti")
    met = saved(_meetings(entries), "met")
    pairs = met.where("NOT hot").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    known = sets.select("id1", "id2", "sid").hint("merge")
    members = saved(heads.select("gid", "id1", "id2", "n").distinct().join(known, ["id1", "id2"]).select("gid", "sid", "n"), "members")
    sizes = saved(members.groupBy("gid").agg(F.count(F.lit(1)).alias("size")), "sizes")
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("gid").alias(side), F.col("size").alias(f"size_{side}")).hint("merge"), side)
    pairs = saved(pairs, "group_pairs")
    few, many = pairs.where(f"size_a * size_b <= {MEETING}"), pairs.where(f"size_a * size_b > {MEETING}")
    for side in "ab":
        m = members.select(F.col("gid").alias(side), F.col("sid").alias("member"))
        few = few.join(m.hint("merge"), side).withColumn(side, F.col("member")).drop("member")
    links = _verified(docs, _with_sets(saved(_ordered_pairs(few), "pairs"), sets))
    # Crowds: what meets under a crowded shingle, within a group, or in two groups too large to pair out.
    crowd = F.xxhash64("a", "b").alias("crowd")
    whole = F.lit(None).cast("long").alias("left")
    crowds = met.where("hot").select("x", "y", "left")
    if hot is not None:
        crowds = crowds.union(hot)
    groups = (
        crowds.select(F.col("x").alias("crowd"), F.col("y").alias("gid"), "left")
        .union(sizes.where("size > 1").select(F.col("gid").alias("crowd"), "gid", whole))
        .union(many.select(crowd, F.col("a").alias("gid"), whole))
        .union(many.select(crowd, F.col("b").alias("gid"), whole))
    )
    crowded = groups.join(members.hint("merge"), "gid").select("crowd", "sid", "n", F.coalesce("left", "n").alias("left"))
    crowded = saved(crowded.distinct().join(sets.select("sid", "parity").hint("merge"), "sid"), "crowded")
    if not crowded.isEmpty():
        links = _crowded_links(docs, crowded, sets, links)
    release(met, pairs, members, sizes, crowded)
    return rows, sets, links


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles and component_id of every row."""
    rows, sets, links = links_of(docs)
    label = components(links).withColumnRenamed("node", "sid")
    named = saved(sets.select("sid", "id1", "id2", "rep").join(label.hint("merge"), "sid", "left"), "labelled")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(saved(least, "least").hint("merge"), "component", "left")
    named = saved(named.select("id1", "id2", F.coalesce("least", "rep").alias("component_id")), "named")
    out = rows.select("doc_id", "key", F.col("n").alias("n_shingles"), "id1", "id2").join(named.hint("merge"), ["id1", "id2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", "n_shingles", own.alias("component_id"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _classes(docs).drop("key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest doc_id, with all columns.

    Of rows that repeat both doc_id and text one stays; rows without a doc_id all do.
    """
    of, nth, kept_id, kept_key = unused(docs, "__of", "__nth", "__kept_id", "__kept_key")
    kept = _classes(docs).where("doc_id = component_id").select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key)).distinct()
    kept = saved(kept, "kept")
    named = docs.withColumn(of, F.xxhash64("text"))
    same = (named["doc_id"].cast("long") == kept[kept_id]) & (named[of] == kept[kept_key])
    # Which of them is told by all their columns, so that a task that runs again keeps the same row.
    first = Window.partitionBy("doc_id", of).orderBy(F.xxhash64(*docs.columns), F.hash(*docs.columns))
    out = named.join(kept.hint("merge"), same, "left_semi").withColumn(nth, F.row_number().over(first)).where(F.col(nth) == 1).drop(nth)
    return out.unionByName(named.where("doc_id IS NULL")).drop(of)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple]) -> list[tuple]:
    """For tests: (doc_id, n_shingles, component_id) by comparing all pairs."""
    import re

    own = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        own.append((i, {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()))
    top = list(range(len(own)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, (_, a) in enumerate(own):
        for y in range(x):
            b = own[y][1]
            if a and b and 100 * len(a & b) >= PERCENT * len(a | b):
                top[find(x)] = find(y)
    least: dict[int, int] = {}
    for x, (i, _) in enumerate(own):
        least[find(x)] = min(least.get(find(x), i), i)
    return [(i, len(s), least[find(x)]) for x, (i, s) in enumerate(own)]


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})]) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c WHERE 100 * k >= {PERCENT} * (n + m - k)),
r(node, top) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.top FROM r JOIN l ON l.a = r.node)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(top) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, g
"""
