"""Personal data: fixed patterns, and identifiers that stand where personal data stands.

What the patterns find are seeds.  Every seed, and every item of a text that looks like an identifier,
stands in three lexical patterns: the two items before it, the two after it, and one on either side.
Spark scores the graph of patterns and instances in rounds: a pattern is as good as the share of trusted
instances among all different items that stand in it, ordinary words included; an identifier is trusted
by the patterns it stands in.  Identifiers that stand in a pattern of high confidence are reported as
``context``.

Texts are read for seeds and identifiers, then for the ordinary words in patterns that several
instances share.  These patterns are told by a bitmap of fixed size, whatever their number, and then
exactly by a join.  Copies don't count again: a pattern's instances are different strings.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; spans of
one kind never overlap, those of ``context`` overlap no others; rows that repeat a doc_id give a row each;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks, settle
from .scratch import release, saved, ship_package, table
from .words import mixed

# The patterns and their limits.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MOST_PART = 255
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)
KINDS = ("email", "ip", "card", "phone", "context")
# End of fixed values.

#: What items end at, besides white space; sentences end with the marks of STOPS.
DELIMITERS, STOPS = r"\x20\x09-\x0D:=\"'<>()\[\]{},;|", ".!?"
#: Groups of digits with single spaces are one item; digits are read as 0.
ITEM = re.compile(rf"0+(?: 0+)++|[^{DELIMITERS}{STOPS}]+(?:[{STOPS}]+[^{DELIMITERS}{STOPS}]+)*+")
PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", b"abcdefghijklmnopqrstuvwxyz000000000")
SEED, BEFORE, AFTER = "\x00", "\x01<", "\x01>"
#: Where a long text may be cut: white space that doesn't join groups of digits.
CUT = re.compile(r"(?<=[^0\s])\s")
PIECE = 1 << 20

#: Characters of an identifier at least.
LEAST_ITEM = 5
#: Trusted instances of a pattern at least, and the different items it is shared by at least.
SUPPORT = 3
#: Confidence of a pattern that reports; below the floor a pattern lends no trust.
CONFIDENT, FLOOR = 0.7, 0.3
ROUNDS = 4
#: Shares of the texts (one in so many) by which patterns that can't reach the floor are left out; the last counts all texts.
PARTS = (64, 8, 1)
#: Bits of the map of patterns.
BITS = 1 << 26


# Fixed patterns


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find; kind as an index of KINDS."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= MOST_PART for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(map(m[0].count, "0123456789")) <= PHONE_DIGITS[1]:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# Items and their patterns


def plain(text: str) -> str:
    """ASCII letters in lower case and digits as 0; positions stay."""
    return text.encode().translate(PLAIN).decode()


def joined(base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of different kinds that overlap, as one of the first kind."""
    out: list[tuple[int, int, int]] = []
    for s, k, e in base:
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], out[-1][1], max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out


def items(norm: str, seeds: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """start, end and string of each item; a seed is one item, told by its kind."""
    at = 0
    for s, k, e in seeds:
        yield from ((m.start(), m.end(), m[0]) for m in ITEM.finditer(norm, at, s))
        yield s, e, SEED + KINDS[k]
        at = e
    yield from ((m.start(), m.end(), m[0]) for m in ITEM.finditer(norm, at))


def is_identifier(item: str) -> bool:
    return not item.startswith((SEED, BEFORE[0])) and ("@" in item or (len(item) >= LEAST_ITEM and "0" in item))


def targets(norm: str, seeds: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, bool, tuple[str, str, str, str]]]:
    """start, end, whether it is a seed, and the two items on either side, of seeds and identifiers."""
    edges = [(0, 0, BEFORE)] * 2, [(0, 0, AFTER)] * 2
    stream = chain(edges[0], items(norm, seeds), edges[1])
    a, b, c, d = (next(stream) for _ in range(4))
    for e in stream:
        if c[2].startswith(SEED) or is_identifier(c[2]):
            yield c[0], c[1], c[2].startswith(SEED), (a[2], b[2], d[2], e[2])
        a, b, c, d = b, c, d, e


def _hashes(strings: list[str]) -> np.ndarray:
    """64-bit hashes of strings."""
    return pd.util.hash_array(np.array(strings, dtype=object), categorize=False)


def _patterns(a: np.ndarray, b: np.ndarray, d: np.ndarray, e: np.ndarray) -> list[np.ndarray]:
    """Hashes of the patterns of an item between b and d, which a and e enclose."""
    return [mixed(mixed(x + np.uint64(k)) * np.uint64(3) + y) for k, (x, y) in enumerate(((a, b), (b, d), (d, e)), 1)]


def _seeded(docs: DataFrame) -> DataFrame:
    """A row for each document: counts, digest and spans of the fixed patterns, and its seeds and identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            for part in chunks(batch):
                bases, edge, found = [], [0], []
                for text in part.column("text").to_pylist():
                    norm = plain(text or "")
                    base = base_spans(text) if "0" in norm or "@" in norm else []
                    bases.append(base)
                    if "0" in norm or "@" in norm:
                        found += [(s, e, seed, around, text[s:e]) for s, e, seed, around in targets(norm, joined(base))]
                    edge.append(len(found))
                starts, ends, seeds, around, own = zip(*found, strict=True) if found else ((),) * 5
                sides = [_hashes([x[i] for x in around]) for i in range(4)]
                graph = np.stack(_patterns(*sides), axis=1).view(np.int64) if found else np.zeros((0, 3), np.int64)
                places = pa.StructArray.from_arrays(
                    [pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(seeds, pa.bool_()), pa.array(_hashes(list(own)).view(np.int64)),
                     pa.FixedSizeListArray.from_arrays(pa.array(graph.ravel()), 3).cast(pa.list_(pa.int64()))], ["start", "end", "seed", "instance", "patterns"])
                spans = pa.array([[{"start": s, "kind": k, "end": e} for s, k, e in b] for b in bases], pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])))
                counts = [pa.array([sum(k == x for _, k, _ in b) for b in bases], pa.int64()) for x in range(4)]
                digest = pa.array([hashlib.sha256(written(b).encode()).hexdigest() for b in bases])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts, digest, spans, pa.ListArray.from_arrays(pa.array(edge, pa.int32()), places)], [f.split()[0] for f in columns])

    columns = ["doc_id long", *(f"n_{k} long" for k in KINDS[:4]), "base_sha256 string", "base array<struct<start:int,kind:int,end:int>>",
               "places array<struct<start:int,end:int,seed:boolean,instance:bigint,patterns:array<bigint>>>"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(columns))


# Ordinary words in patterns


def _bitmap(patterns: DataFrame) -> np.ndarray:
    """Which of BITS places the patterns have; 4 KB of it at a time are made by Spark."""
    place = F.pmod("pattern", F.lit(BITS)) + 1
    parts = patterns.select(F.bitmap_bucket_number(place).alias("at"), F.bitmap_bit_position(place).alias("bit")).groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for r in parts.collect():
        piece = np.frombuffer(r["bits"], dtype=np.uint8)
        start = (r["at"] - 1) * len(piece)
        out[start : start + len(piece)] = piece
    return out


def _pieces(norm: str) -> Iterator[str]:
    at = 0
    while len(norm) - at > PIECE and (cut := CUT.search(norm, at + PIECE)):
        yield norm[at : cut.start()]
        at = cut.start()
    yield norm[at:]


def _item_lists(texts: list[str | None]) -> Iterator[list[str]]:
    """Items of all texts in lists of bounded size, each with two more on either side."""
    now = []
    for text in texts:
        if not text:
            continue
        norm = plain(text)
        if "0" in norm or "@" in norm:
            parts, at = [], 0
            for s, k, e in joined(base_spans(text)):
                parts += [norm[at:s], f" {SEED}{KINDS[k]} "]
                at = e
            norm = "".join(parts) + norm[at:]
        now += [BEFORE, BEFORE]
        for piece in _pieces(norm):
            now += ITEM.findall(piece)
            if len(now) > PIECE // 4:
                yield now
                now = now[-4:]
        now += [AFTER, AFTER]
    yield now


def _ordinary(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, item: the different ordinary items that stand in the patterns, and some in others."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(patterns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known = bits.value
        for batch in batches:
            for part in chunks(batch):
                for listed in _item_lists(part.column("text").to_pylist()):
                    if len(listed) < 5:
                        continue
                    strings = np.empty(len(listed), dtype=object)
                    strings[:] = listed
                    code, distinct = pd.factorize(strings)
                    ordinary = np.array([not (is_identifier(x) or x[0] in (SEED, BEFORE[0])) for x in distinct])[code][2:-2]
                    h = pd.util.hash_array(distinct, categorize=False)[code]
                    own, found = h[2:-2], []
                    for p in _patterns(h[:-4], h[1:-3], h[3:-1], h[4:]):
                        place = p & np.uint64(BITS - 1)
                        hit = np.flatnonzero(ordinary & ((known[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1))
                        found.append(pd.DataFrame({"pattern": p[hit].view(np.int64), "item": own[hit].view(np.int64)}))
                    yield pa.RecordBatch.from_pandas(pd.concat(found).drop_duplicates(), preserve_index=False)

    return docs.select("text").mapInArrow(run, "pattern long, item long").distinct()


def _item_counts(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern, n_items (instances and different ordinary items) of the patterns that can reach the floor.

    Most patterns are held by far too many ordinary items.  Those that are so in a part of the texts already are
    left out before more is read, as more texts can't lower their count; what is left is counted over all texts.
    """
    alive = patterns
    for part in PARTS:
        if alive.isEmpty():
            return alive.select("pattern", F.col("n_instances").alias("n_items"))
        some = docs if part == 1 else docs.where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
        others = _ordinary(some, alive).groupBy("pattern").agg(F.count(F.lit(1)).alias("n_others"))
        met = alive.join(others, "pattern", "left").withColumn("n_items", F.col("n_instances") + F.coalesce("n_others", F.lit(0)))
        counted = saved(met.where(F.round(F.col("n_instances") / (F.col("n_items") + 1), 9) >= FLOOR).select("pattern", "n_instances", "n_items"), "counts")
        alive = counted.drop("n_items")
    return counted.select("pattern", "n_items")


# Scores


def _scored(edges: DataFrame, patterns: DataFrame, support: int, rounds: int) -> DataFrame:
    """pattern, confidence after the rounds; ``patterns`` has the number of items of each."""
    trust = None
    for k in range(rounds):
        lent = edges.withColumn("trust", F.col("seed").cast("double")) if trust is None else edges.join(trust, "instance")
        sums = lent.groupBy("pattern").agg(F.sum("trust").alias("trust"))
        good = F.round(F.col("trust") / (F.col("n_items") + 1), 9)
        scores = sums.join(patterns.select("pattern", "n_items"), "pattern").select("pattern", F.when(F.round("trust", 9) >= support, good).otherwise(0.0).alias("confidence"))
        scores = saved(scores.where(F.col("confidence") >= FLOOR), "confidences")
        if k == rounds - 1:
            break
        doubt = F.exp(F.sum(F.when(F.col("confidence").isNull(), 0.0).otherwise(F.log(1 - F.col("confidence")))))
        by = edges.join(scores, "pattern", "left").groupBy("instance").agg(F.max("seed").alias("seed"), doubt.alias("doubt"))
        before, trust = trust, saved(by.select("instance", F.when(F.col("seed"), 1.0).otherwise(1 - F.col("doubt")).alias("trust")), "trust")
        release(*([before] if before is not None else []))
    return scores


def scan(docs: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256 and spans of every row."""
    ship_package(docs.sparkSession)
    rows = saved(_seeded(docs).withColumn("row", F.monotonically_increasing_id()), "seeded")
    places = rows.select("row", F.explode("places").alias("p")).select("row", "p.*")
    graph = places.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    graph = saved(graph, "graph")
    shared = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n_instances")).where(F.col("n_instances") >= support)
    shared = saved(shared, "patterns")
    counts = _item_counts(docs, shared)
    edges = saved(graph.join(shared.select("pattern"), "pattern", "left_semi"), "edges")
    best = _scored(edges, counts, support, rounds).where(F.col("confidence") >= confident).select("pattern")
    unseen = places.where("NOT seed").select("row", "start", "end", F.explode("patterns").alias("pattern"))
    hits = unseen.join(best, "pattern", "left_semi").select("row", "start", "end").distinct()
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")
    found = hits.groupBy("row").agg(F.collect_list(span).alias("found"))
    out = rows.drop("places").join(found, "row", "left")
    every = F.array_sort(F.when(F.col("found").isNull(), F.col("base")).otherwise(F.concat("base", "found")))
    text = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")
    return out.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", text.alias("spans"), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_context"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple], support: int = SUPPORT, confident: float = CONFIDENT, rounds: int = ROUNDS) -> list[tuple]:
    """For tests: doc_id, the base spans and all spans as text, of every row, in plain Python."""
    import math

    def fixed(text: str) -> list[tuple[int, int, int]]:
        out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = [int(c) for c in m[0] if c.isdigit()]
            twice = [x * 2 - 9 * (x > 4) if i % 2 else x for i, x in enumerate(reversed(d))]
            if 14 <= len(d) <= 19 and sum(twice) % 10 == 0:
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
        return sorted(out)

    graph, others, placed, bases = defaultdict(dict), defaultdict(set), [], []
    for n, (_, text) in enumerate(rows):
        text = text or ""
        bases.append(fixed(text))
        every = [(0, 0, BEFORE)] * 2 + list(items(plain(text), joined(bases[-1]))) + [(0, 0, AFTER)] * 2
        for k in range(2, len(every) - 2):
            s, e, own = every[k]
            around = [(1, every[k - 2][2], every[k - 1][2]), (2, every[k - 1][2], every[k + 1][2]), (3, every[k + 1][2], every[k + 2][2])]
            seed = own.startswith(SEED)
            for p in around:
                if seed or is_identifier(own):
                    graph[p][text[s:e]] = graph[p].get(text[s:e], False) or seed
                else:
                    others[p].add(own)
            if not seed and is_identifier(own):
                placed.append((n, s, e, around))
    graph = {p: x for p, x in graph.items() if len(x) >= support}
    seeds = {i: False for x in graph.values() for i in x}
    for x in graph.values():
        for i, s in x.items():
            seeds[i] = seeds[i] or s
    trust = None
    for _ in range(rounds):
        sums = {p: sum(float(s) if trust is None else trust[i] for i, s in x.items()) for p, x in graph.items()}
        good = {p: round(t / (len(graph[p]) + len(others[p]) + 1), 9) for p, t in sums.items() if round(t, 9) >= support}
        good = {p: c for p, c in good.items() if c >= FLOOR}
        trust = {i: 1.0 if s else 1 - math.exp(sum(math.log(1 - good[p]) for p, x in graph.items() if p in good and i in x)) for i, s in seeds.items()}
    found = defaultdict(set)
    for n, s, e, around in placed:
        if any(good.get(p, 0) >= confident for p in around):
            found[n].add((s, len(KINDS) - 1, e))
    return [(i, written(b), written(sorted([*b, *found[n]]))) for n, ((i, _), b) in enumerate(zip(rows, bases, strict=True))]
