"""Secret scans: fixed patterns, and random strings found by their token efficiency.

Prose and identifiers take few tokens of a byte-level vocabulary for their length; random
strings take many.  A run of token characters that holds letters, or a stretch of its parts, whose
characters per token fall below a limit, is reported as random unless it is of a known
digest length in hex or a UUID; what the patterns already found is left out of the runs.

Defined results: a null or empty text has no spans; positions are code points, ends
exclusive; spans of one kind never overlap; rows that repeat a doc_id give a row each; an
empty table gives an empty result; :func:`redact` keeps every column.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import chunks, model
from .byte_bpe import read_ranks
from .scratch import ship_package, table

# The patterns, and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
LEAST_VALUE, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "random")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
# End of fixed values.

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
HEX_ONLY = re.compile(r"[0-9a-fA-F]+")
PART = re.compile(rf"(?<![A-Za-z0-9]){UUID.pattern}(?![A-Za-z0-9])|[A-Za-z0-9+]+")
LEAST_RANDOM = 20
#: Characters a token below which a string counts as random.
RATIO = 1.9


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find; kind as an index of KINDS."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def is_known(run: str) -> bool:
    """A digest, a UUID or a string without letters, which random strings are not reported for."""
    if HEX_ONLY.fullmatch(run):
        return len(run) in DIGEST_LENGTHS or run.isdigit()
    return bool(UUID.fullmatch(run)) or not any(c.isalpha() for c in run)


def outside(start: int, end: int, found: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the spans of ``found``, in order, leave of a stretch."""
    for s, _, e in found:
        if s < end and start < e:
            yield start, s
            start = e
    yield start, end


def random_parts(run: str, n_tokens) -> list[tuple[int, int]]:
    """Where a run is random: all of it, or stretches of its parts that together are.

    Parts lie between = / _ and -.  Each counts its tokens' characters at RATIO less its own; the
    stretches are the maximal ones by that sum, so that words beside a random string don't hide it.
    """
    if len(run) < LEAST_RANDOM or is_known(run):
        return []
    if len(run) < RATIO * n_tokens(run):
        return [(0, len(run))]
    parts = []
    for m in PART.finditer(run):
        gain = -math.inf if UUID.fullmatch(m[0]) else RATIO * n_tokens(m[0]) - len(m[0])
        parts.append((m.start(), m.end(), gain))
    # Ruzzo and Tompa: start, end, sum before and sum after of each stretch.
    best: list[tuple[int, int, float, float]] = []
    total = 0.0
    for s, e, gain in parts:
        if gain == -math.inf:
            total = min([total, *(x[2] for x in best)]) - 1.0  # nothing reaches over it
            continue
        before, total = total, total + gain
        if gain <= 0:
            continue
        new = (s, e, before, total)
        while True:
            k = next((k for k in range(len(best) - 1, -1, -1) if best[k][2] < new[2]), None)
            if k is None or best[k][3] >= new[3]:
                best.append(new)
                break
            new = (best[k][0], new[1], best[k][2], new[3])
            del best[k:]
    return [(s, e) for s, e, _, _ in best if e - s >= LEAST_RANDOM and not is_known(run[s:e])]


def random_spans(text: str, found: list[tuple[int, int, int]], n_tokens) -> list[tuple[int, int, int]]:
    """Strings with fewer than RATIO characters a token, outside the spans of ``found``."""
    out = []
    for m in CANDIDATE.finditer(text):
        for start, end in outside(m.start(), m.end(), found):
            out += [(start + s, 3, start + e) for s, e in random_parts(text[start:end], n_tokens)]
    return out


def _counter(ranks_path: str):
    """Number of tokens of a string."""

    def made():
        import tiktoken

        coder = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        return lambda x: len(coder.encode_ordinary(x))

    return model(("token counts", ranks_path), made)


def _spans_of(text: str | None, n_tokens) -> tuple[list, list]:
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, n_tokens))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, the number of spans of each kind, base_sha256 and spans of every row."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = _counter(ranks_path)
        for batch in batches:
            for part in chunks(batch):
                rows = [_spans_of(t, n_tokens) for t in part.column("text").to_pylist()]
                counts = [pa.array([sum(k == x for _, k, _ in every) for _, every in rows], pa.int64()) for x in range(len(KINDS))]
                digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *counts[:3], pa.array(digest), pa.array([written(x) for _, x in rows], pa.string()), counts[3]],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, ranks_path: str, mark: str = "[SECRET]") -> DataFrame:
    """The rows with each stretch of spans replaced; n_chars, if there, follows the text."""
    ship_package(docs.sparkSession)
    names, at = docs.columns, docs.columns.index("text")

    def clean(text: str | None, n_tokens) -> str | None:
        spans = _spans_of(text, n_tokens)[1]
        if not spans:
            return text
        out, last = [], 0
        for s, _, e in spans:
            if s >= last:
                out += [text[last:s], mark]
            last = max(last, e)
        return "".join(out) + text[last:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = _counter(ranks_path)
        for batch in batches:
            for part in chunks(batch):
                cols = list(part.columns)
                cols[at] = pa.array([clean(t, n_tokens) for t in part.column("text").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("n_chars").isNull() | F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)
        out = out.withColumn("n_chars", changed).select(*names)
    return out


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


