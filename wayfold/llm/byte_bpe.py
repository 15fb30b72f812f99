"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is split into pre-tokens by a pattern.  A pre-token that is itself in the vocabulary
resolves by a minimal perfect hash: one probe, one comparison.  Any other is built up from its
bytes by merges: the bytes are a doubly linked list, a heap holds the ranks of adjacent pairs,
and the lowest rank, leftmost first, is merged until no pair is in the vocabulary.

Work is done once for each distinct run between breaks that no pre-token crosses (a single
space after a character that isn't white space); a bounded memo keeps the results.

Defined results: a null or empty text has no ids (both digests are of the empty string);
rows that repeat a doc_id give a row each; an empty table gives an empty result; a byte
that the ranks don't have raises an error; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import Memo, chunks, model
from .scratch import ship_package, table

#: Runs whose ids a worker remembers.
MEMO = 500_000
#: Mean number of keys in a bucket of the perfect hash.
PER_BUCKET = 4


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings by hashing and displacing.

    Keys are dealt into buckets; the largest bucket first, each seeks a displacement under
    which all its keys fall into free slots.  There are as many slots as keys.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, -(-n // PER_BUCKET))
        low, high = self._halves(keys)
        bucket = low % self.buckets
        order = np.argsort(bucket, kind="stable")
        at = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.displacement = np.zeros(self.buckets, dtype=np.int64)
        taken = np.zeros(n, dtype=bool)
        slot_of = np.zeros(n, dtype=np.int64)
        for b in np.argsort(at[:-1] - at[1:], kind="stable"):
            members = order[at[b] : at[b + 1]]
            if not len(members):
                break
            base, step = low[members] // self.buckets, high[members]
            for first in range(0, 1 << 24, 256):
                d = np.arange(first, first + 256)[:, None]
                slots = self._mix(base[None, :], step[None, :], d) % n
                ordered = np.sort(slots, axis=1)
                fine = ~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if fine.any():
                    found = int(np.argmax(fine))
                    self.displacement[b] = first + found
                    slot_of[members] = slots[found]
                    taken[slots[found]] = True
                    break
            else:
                raise ValueError("no displacement found")
        self.keys: list[bytes] = [b""] * n
        for k, s in zip(keys, slot_of.tolist(), strict=True):
            self.keys[s] = k

    @staticmethod
    def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))
        return (h & np.uint64(0xFFFFFFFF)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _mix(base, step, d):
        x = (base + step * (2 * d + 1)) & 0x7FFFFFFF
        return (x ^ (x >> 15)) * 0x2C1B3C6D % 0x7FFFFFFF

    def slots(self, keys: list[bytes]) -> list[int]:
        """The slot of each key, -1 for those that aren't in the set."""
        if not self.n or not keys:
            return [-1] * len(keys)
        low, high = self._halves(keys)
        s = (self._mix(low // self.buckets, high, self.displacement[low % self.buckets]) % self.n).tolist()
        own = self.keys
        return [x if own[x] == k else -1 for x, k in zip(s, keys, strict=True)]


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of bytes that aren't a token: merges by rank with a heap over linked bytes."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    end = list(range(1, n + 1))  # where the part that starts here ends; also the next part's start
    before = list(range(-1, n - 1))
    alive = [True] * n
    rank = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue  # one of the two has grown since
        alive[j] = False
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := rank(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (b := before[i]) >= 0 and (r := rank(piece[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class ByteBpe:
    """Encoder and decoder for a table of ranks and a pattern of pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.hash = PerfectHash(list(ranks))
        self.id_of_slot = [ranks[k] for k in self.hash.keys]
        self.bytes_of = {i: k for k, i in ranks.items()}
        self.pattern = regex.compile(pattern)
        #: A single space after a character that isn't white space starts a pre-token.
        self.breaks = regex.compile(r"(?<=\S)(?= )")
        self.unsafe = regex.compile(r"\s ")
        self.memo = Memo(MEMO)

    def runs(self, text: str) -> list[str]:
        if self.unsafe.search(text) or text.startswith(" "):
            return self.breaks.split(text) if text else []
        first, *rest = text.split(" ")
        out = [" " + x for x in rest]
        if first or not rest:
            out.insert(0, first)
        return out if text else []

    def _learn(self, distinct: set[str]) -> None:
        """Put ids and decoded bytes of new runs into the memo."""
        missing = self.memo.absent(distinct)
        if not missing:
            return
        split = [[p.encode() for p in self.pattern.findall(x)] for x in missing]
        tokens = list({p for x in split for p in x})
        ids: dict[bytes, list[int]] = {}
        for p, s in zip(tokens, self.hash.slots(tokens), strict=True):
            ids[p] = [self.id_of_slot[s]] if s >= 0 else merged(p, self.ranks)
        for x, parts in zip(missing, split, strict=True):
            own = [i for p in parts for i in ids[p]]
            self.memo.new[x] = (" ".join(map(str, own)), len(own), self.decode(own))

    def encode(self, text: str) -> list[int]:
        return [int(i) for x in self.encode_batch([text])[0][0] for i in x.split()]

    def encode_batch(self, texts: list[str]) -> list[tuple[list[str], int, list[bytes]]]:
        """For each text: its ids in decimal by run, their number, and the bytes they decode to by run."""
        runs = [self.runs(t) for t in texts]
        distinct: set[str] = set()
        for r in runs:
            distinct.update(r)
        self._learn(distinct)
        known = self.memo.new
        out = []
        for r in runs:
            found = [known[x] for x in r]
            out.append(([x[0] for x in found if x[1]], sum([x[1] for x in found]), [x[2] for x in found]))
        self.memo.turn()
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


def _bpe(path: str, pattern: str) -> ByteBpe:
    return model(("byte BPE", path, pattern), lambda: ByteBpe(read_ranks(path), pattern))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids of each text and of what they decode to."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            for part in chunks(batch):
                n, of_ids, of_bytes = [], [], []
                for ids, count, decoded in bpe.encode_batch([t or "" for t in part.column("text").to_pylist()]):
                    n.append(count)
                    of_ids.append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(b"".join(decoded)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of each text."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            for part in chunks(batch):
                ids = [[int(i) for x in found[0] for i in x.split()] for found in bpe.encode_batch([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and text (bytes) of rows of ids; null ids decode to no bytes."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(ranks_path, pattern)
        for batch in batches:
            out = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
