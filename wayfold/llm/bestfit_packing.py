"""Best-fit packing of tokenised documents into sequences of fixed length.

Documents are tokenised and, where longer than a sequence, cut into pieces.  The packing is
planned over a histogram of piece lengths: best-fit decreasing runs over (length, count)
pairs, and bins of equal content are planned together, so that the plan's size and time
depend on the sequence length and not on the number of documents.  Pieces then take the
planned slots by their rank within their length.  Ranks come from a window over (length,
salt) with the counts of the earlier salts added, so a length that a third of all pieces
share is still dealt over many tasks.

Defined results: a null or empty text is a document of the closing id alone; a null doc_id is
packed like any other; rows that repeat a doc_id are packed as documents of their own;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .batches import Memo, chunks, model
from .scratch import parallelism, saved, ship_package, table, unused

#: Words whose ids a worker remembers.
MEMO = 300_000
#: Bytes of text tokenised at once; more of it has fewer distinct words a byte.
AT_ONCE = 3 << 20
STOP = re.compile(rb"(?<=[a-z])([.,])(?=\s|\Z)")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts under a lower-casing word BPE whose tokens never cross ASCII white space.

    Each run between white space is tokenised by itself, and a run seen before is looked up.
    A run of letters is one word, which ends with a token marked as its end.  A text that holds the string of an
    added token, in whatever case, goes whole to the tokenizer as it is.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # The same merges for words of lower-case letters, without normalising and matching.
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.added = sorted({str(t.content).lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()})
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo = Memo(MEMO)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # The tokenizer lower-cases anyway, and a stop between a letter and white space is a word.
        low = [t.lower() for t in texts]
        odd = {i: self._whole(texts[i]) for i, t in enumerate(low) if any(a in t for a in self.added)}
        words = [[] if i in odd else STOP.sub(rb" \1", t).split() for i, t in enumerate(low)]
        distinct: set[bytes] = set()
        for w in words:
            distinct.update(w)
        self._learn(self.memo.absent(distinct))
        known = self.memo.new
        out = [odd[i] if i in odd else b"".join(map(known.__getitem__, w)) for i, w in enumerate(words)]
        self.memo.turn()
        return out

    def _whole(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, missing: list[bytes]) -> None:
        known = self.memo.new
        plain = [w for w in missing if w.isalpha()]  # ASCII letters only
        other = []
        for w in set(missing).difference(plain):
            t = w.decode("utf-8", "replace")
            # Letters that neither lower-casing nor composing would change are one run, too.
            (plain if t.isalpha() and t == t.lower() and unicodedata.is_normalized("NFC", t) else other).append(w)
        for at in range(0, len(plain), 512):
            some = plain[at : at + 512]
            ids = np.array(self.letters.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.append(0, 4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) != len(some) + 1:
                other += some
                continue
            known.update(zip(some, map(ids.tobytes().__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
        for at in range(0, len(other), 512):
            some = other[at : at + 512]
            text = [w.decode("utf-8", "replace") for w in some]
            start = np.cumsum([0, *(len(t) + 1 for t in text)])
            found = self.tokenizer.encode(" ".join(text), add_special_tokens=False)
            cuts = (4 * np.searchsorted([i for i, _ in found.offsets], start)).tolist()
            ids = np.array(found.ids, dtype="<u4").tobytes()
            known.update(zip(some, map(ids.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))


def _tokenizer(path: str) -> WordTokenizer:
    return model(("words", path), lambda: WordTokenizer(path))


def pieces(docs: DataFrame, tokenizer_path: str, length: int = 2048, end_id: int = 0) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32."""
    ship_package(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for batch in batches:
            for part in chunks(batch, limit=AT_ONCE):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                cols: list[list] = [[], [], [], [], []]
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokenizer.encode(texts), strict=True):
                    ids += end
                    for n, at in enumerate(range(0, len(ids), 4 * length)):
                        cut = ids[at : at + 4 * length]
                        for c, x in zip(cols, (doc, n, at // 4, len(cut) // 4, zlib.crc32(cut)), strict=True):
                            c.append(x)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def plan(histogram: dict[int, int], capacity: int) -> tuple[pd.DataFrame, int]:
    """Best-fit decreasing over counts: slots, and the number of sequences.

    A slot row says that the pieces of ``length`` with ranks from ``rank`` on fill ``bins``
    sequences from ``sequence`` on, ``each`` of them side by side from ``offset`` on.
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of sequences (first, how many)
    slots: list[tuple[int, int, int, int, int, int]] = []
    used = 0

    def put(length: int, rank: int, room: int, first: int, bins: int, each: int) -> int:
        slots.append((length, rank, bins, each, first, capacity - room))
        if left := room - each * length:
            free.setdefault(left, []).append((first, bins))
        return rank + bins * each

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        for room in sorted(r for r in free if r >= length):
            fits = room // length
            while rank < count and free.get(room):
                first, bins = free[room].pop()
                whole = min(bins, (count - rank) // fits)
                if whole:
                    rank = put(length, rank, room, first, whole, fits)
                    first, bins = first + whole, bins - whole
                if bins and (rest := count - rank):  # fewer than fit into one more
                    rank = put(length, rank, room, first, 1, rest)
                    first, bins = first + 1, bins - 1
                if bins:
                    free[room].append((first, bins))
            if not free.get(room):
                free.pop(room, None)
            if rank == count:
                break
        if rest := count - rank:
            fits = capacity // length
            if whole := rest // fits:
                rank = put(length, rank, capacity, used, whole, fits)
                used += whole
            if rest := count - rank:
                put(length, rank, capacity, used, 1, rest)
                used += 1
    return pd.DataFrame(slots, columns=["length", "rank", "bins", "each", "sequence", "offset"]).sort_values(["length", "rank"]), used


def _ranked(rows: DataFrame, salt: str, order: list[str], rank: str) -> tuple[DataFrame, DataFrame]:
    """Salted rows with their rank within their length, and counts by length and salt."""
    nth, before = unused(rows, "__nth", "__before")
    counts = saved(rows.groupBy("length", salt).agg(F.count(F.lit(1)).alias(nth)), "counts")  # a row for each length and salt at most
    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(nth).over(earlier), F.lit(0))).drop(nth)
    within = Window.partitionBy("length", salt).orderBy(*order)
    ranked = rows.withColumn(nth, F.row_number().over(within) - 1).join(offsets.hint("merge"), ["length", salt])
    return ranked.withColumn(rank, F.col(before) + F.col(nth)).drop(before, nth, salt), counts.withColumnRenamed(nth, "n")


def pack(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """Rows with a ``length`` of at most ``capacity``, with sequence_id and offset; rows of one length differ in nothing."""
    ship_package(rows.sparkSession)
    kept = rows.columns
    salts = max(64, 2 * parallelism(rows.sparkSession))
    salt, place, rank = unused(rows, "__salt", "__place", "__rank")
    # A row's number tells rows apart that are equal; written, it and the salt stay as they are.
    rows = rows.withColumn(place, F.monotonically_increasing_id())
    rows = saved(rows.withColumn(salt, F.pmod(F.xxhash64(place), F.lit(salts))), "pieces")
    ranked, counts = _ranked(rows, salt, [place], rank)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, capacity)
    # The plan's size is bounded by the sequence length, not by the rows.
    shared = rows.sparkSession.sparkContext.broadcast({n: x.astype("int64").to_numpy() for n, x in slots.groupby("length")})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_of = shared.value
        for f in frames:
            sequence, offset = np.zeros(len(f), dtype=np.int64), np.zeros(len(f), dtype=np.int64)
            for length, at in f.groupby("length").indices.items():
                s = table_of[length]
                nth = f[rank].to_numpy()[at]
                row = s[np.searchsorted(s[:, 1], nth, side="right") - 1]
                nth = nth - row[:, 1]
                sequence[at] = row[:, 4] + nth // row[:, 3]
                offset[at] = row[:, 5] + nth % row[:, 3] * length
            yield f[kept].assign(sequence_id=sequence, offset=offset)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept)
    return ranked.mapInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity), capacity)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
