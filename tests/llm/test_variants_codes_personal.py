"""Spelling variants, vector codes and personal data against brute force and on odd tables."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from wayfold.llm import personal_data, spelling_variants, vector_codes  # noqa: E402

DOCS = "doc_id long, text string, lang string, word string, row long, pattern boolean"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", "w", 7, True) for i, t in rows], DOCS)


# Spelling variants


def _texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abÀé") for _ in range(rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(n):
        own = [rng.choice(stems[: rng.choice((3, 60))]) for _ in range(rng.randint(0, 80))]
        for k in range(len(own)):
            if rng.random() < 0.2:
                at = rng.randrange(len(own[k]))
                own[k] = own[k][:at] + rng.choice(("", "a", "b", "xa")) + own[k][at + rng.choice((0, 1)) :]
        rows.append((i, rng.choice((" ", "-", "1")).join(w.upper() if rng.random() < 0.1 else w for w in own)))
    return rows


def _near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("shard, piece", [(1 << 15, 1 << 17), (7, 3)])
def test_variants_match_brute_force(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(spelling_variants, "SHARD", shard)
    monkeypatch.setattr(spelling_variants, "SLICE", piece)
    rows = [*_texts(2, 120), (3, "ab\u00d7ab\u00f7ab " * 6), (4, None), (5, ""), (6, "x" * 70000), (3, "abcdef abcdef"), (None, "abcdef " * 9), (7, "short words here")]
    got = spelling_variants.variants(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(spelling_variants.brute_force(rows))
    assert any(r["form"] for r in got) and any(r["n_near"] > 2 for r in got)


def test_variants_of_nothing(spark):
    assert spelling_variants.variants(docs(spark, [])).collect() == []
    assert spelling_variants.variants(docs(spark, [(1, None), (2, "a b")])).collect() == []


def test_long_words_and_chains(spark):
    long = "k" * 3000
    rows = [(i, f"{long}a " * n + f"{long}b " * (n // 5)) for i, n in ((1, 100), (2, 60))] + [(3, "aaaaaaa " * 600 + "aaaaaab " * 110 + "aaaaabb " * 20 + "aaaabbb " * 5)]
    got = spelling_variants.variants(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(spelling_variants.brute_force(rows))
    assert any(r["root"] not in (r["word"], r["form"]) for r in got)


def test_automata_number_words_in_order():
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(900)}, key=lambda w: (len(w), w))
    made = spelling_variants.Automaton()
    for i, w in enumerate(words):
        made.add(w, i)
    made.close()
    for i, w in enumerate(words):
        node, at = made.roots[len(w)]
        assert spelling_variants._walk(node, at, w, 0) == i
    back = spelling_variants.Automaton()
    for w, i in sorted((w[::-1], i) for i, w in enumerate(words)):
        if len(w) == 7:
            back.add(w, i)
    back.close()
    for q in rng.sample(words, 80):
        ahead = list(made.neighbours(q, len(q) // 2))
        assert len(ahead) == len(set(ahead))
        assert set(ahead) == {i for i, w in enumerate(words) if _near(q, w) and w.startswith(q[: len(q) // 2])}
        half = len(q) - len(q) // 2
        assert set(back.neighbours(q[::-1], half)) == {i for i, w in enumerate(words) if len(w) == 7 and _near(q, w) and w.endswith(q[len(q) // 2 :])}


def test_variants_of_megabytes(spark):
    rng = random.Random(6)
    some = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(40)]
    long = " ".join(rng.choice(some) for _ in range(400_000))
    rows = [(1, long), (2, long[: len(long) // 3]), (3, "abcdef")]
    assert len(long) > 3_000_000
    got = spelling_variants.variants(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(spelling_variants.brute_force(rows))


# Vector codes

VECTORS = "vec_id long, embedding array<float>, label int, id string, error long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, m, "x", 1) for i, v, m in rows], VECTORS)


def _vectors(seed: int, n: int, width: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, [float(np.float32(x)) for x in np.round(centres[i % 6] + rng.normal(size=width) / 4, 1)], None if i % 7 == 0 else i % 3) for i in range(n)]


@pytest.mark.parametrize("width, parts, entries", [(8, 4, 5), (6, 4, 300), (1, 1, 3)])
def test_codes_match_brute_force(spark, monkeypatch, width, parts, entries):
    entries = min(entries, 256)
    monkeypatch.setattr(vector_codes, "STEP", 64)
    odd = [(900, None, 1), (901, [float("nan")] * width, 1), (902, [float("inf")] * width, 2), (903, [None] * width, 2), (904, [], 1), (905, [0.0] * width, 1), (None, [0.5] * width, 1), (2, [-9.0] * width, 0)]
    rows = [*_vectors(3, 150, width), *_vectors(3, 20, width), *odd]
    got = vector_codes.compress(vectors(spark, rows), parts=parts, entries=entries).collect()
    assert sorted(map(tuple, got), key=str) == sorted(vector_codes.brute_force(rows, parts, entries, 2), key=str)


def test_labels_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 0)
    rows = _vectors(5, 90, 4)
    got = vector_codes.compress(vectors(spark, rows), parts=2, entries=4).collect()
    assert sorted(map(tuple, got), key=str) == sorted(vector_codes.brute_force(rows, 2, 4, 2), key=str)


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(x)) for x in (i * 3.1e12, 1e6 - i, -7e11)], 1) for i in range(5)]
    big = [(i, [float(np.float32(1e30)), float(np.float32(3e38))], None) for i in range(4)]
    for own, entries in ((rows[:2], 2), (big, 2)):
        got = vector_codes.compress(vectors(spark, own), parts=1, entries=entries).collect()
        assert sorted(map(tuple, got), key=str) == sorted(vector_codes.brute_force(own, 1, entries, 2), key=str)


def test_no_vectors(spark):
    assert vector_codes.compress(vectors(spark, [])).collect() == []
    assert vector_codes.compress(vectors(spark, [(1, None, 1)])).collect() == []


def test_annuli_save_work_and_keep_ties():
    rng = np.random.default_rng(1)
    entries = rng.integers(-400, 400, size=(64, 4))
    entries = (entries * rng.uniform(0.1, 6, size=(64, 1))).astype(np.int64)
    entries[9], entries[40] = entries[3], -entries[3]
    book = vector_codes.Codebook(entries.tolist())
    x = (entries[rng.integers(0, 64, 500)] + rng.integers(-60, 60, size=(500, 4))).astype(np.float64)
    x[7] = 0
    j, far, pairs = book.nearest(x)
    all_far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (j == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
    assert pairs < 0.6 * all_far.size


# Personal data


def _people(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    some = ["mer", "tol", "sa", "vek", "ordin", "plu", "dane", "of", "the"]
    words = lambda k: " ".join(rng.choice(some) for _ in range(k))
    rows = []
    for i in range(n):
        rows.append((i, rng.choice((
            f"{words(8)} please contact user.{i}@mail{i % 7}.example.com for details {words(5)}",
            f"{words(8)} please contact ACC-{i}77 for details {words(5)}",
            f"{words(3)} item {i}{i}0 {words(4)}", f"my badge number: ACC-{i}77. {words(4)}",
            f"my badge number: B{i}9921, {words(4)}", words(30), words(2) + f" +1 (743) 555-{1000 + i} " + words(3)))))
    return rows


ODD = [(900, None), (901, ""), (902, "x" * 3000), (903, "+1 4111 1111 1111 1111"), (904, "é" * 10 + " 10.0.0.1 "), (None, "please contact 12345-AB for details"), (905, "a@b.c")]


def test_personal_data_matches_brute_force(spark):
    rows = [*_people(3, 200), *ODD]
    rows += rows[:3]
    got = personal_data.scan(docs(spark, rows)).collect()
    want = [(i, hashlib.sha256(b.encode()).hexdigest(), s) for i, b, s in personal_data.brute_force(rows)]
    assert sorted(((r["doc_id"], r["base_sha256"], r["spans"]) for r in got), key=str) == sorted(want, key=str)
    kinds = ("email", "ip", "card", "phone", "context")
    assert all(r["spans"].count(f"{k}:") == r[f"n_{k}"] for r in got for k in kinds)
    text = dict(rows)
    found = {text[r["doc_id"]][int(s) : int(e)] for r in got for s, e in re.findall(r"context:(\d+):(\d+)", r["spans"])}
    # Accounts stand where addresses do, and badges where known accounts do; items don't.
    assert "12345-AB" in found and any(x.startswith("ACC-") for x in found) and not any(x.isdigit() for x in found)


def test_personal_data_of_megabytes(spark):
    rows = _people(5, 40)
    long = " ".join(t for _, t in rows * 1200)
    assert len(long) > 3_000_000
    got = personal_data.scan(docs(spark, [*rows, (900, long), (901, "1 " * 1_000_000)])).collect()
    want = {i: s for i, _, s in personal_data.brute_force([*rows, (900, long)])}
    found = {r["doc_id"]: r["spans"] for r in got}
    assert {i: found[i] for i in want} == want and found[901] == ""


def test_patterns_survive_pieces(spark, monkeypatch):
    monkeypatch.setattr(personal_data, "PIECE", 24)
    rows = [*_people(4, 60), *ODD]
    want = personal_data.brute_force(rows)
    seen = [x for listed in personal_data._item_lists([t for _, t in rows]) for x in listed[2:-2]]
    whole = [x for _, t in rows if t for x in [personal_data.BEFORE] * 2 + [i for _, _, i in personal_data.items(personal_data.plain(t), personal_data.joined(personal_data.base_spans(t)))] + [personal_data.AFTER] * 2][2:-2]
    assert seen == whole and len(want) == len(rows)


def test_bitmap_has_every_pattern(spark):
    rng = random.Random(9)
    patterns = [rng.getrandbits(64) - 2**63 for _ in range(500)]
    bits = personal_data._bitmap(spark.createDataFrame([(p,) for p in patterns], "pattern long"))
    places = {p % personal_data.BITS for p in patterns}
    assert {int(i) for i in np.flatnonzero(np.unpackbits(bits, bitorder="little"))} == places


def test_personal_data_of_nothing(spark):
    assert personal_data.scan(docs(spark, [])).collect() == []


def test_fixed_patterns_fuzzed():
    rng = random.Random(8)
    rows = []
    for i in range(6000):
        letters = rng.choice(("ab@.-1 ", "0123456789 -", "1.2 5", "+1()-. 23", "a@@b.c-%+_ 9", "0129 .-@+a(é"))
        rows.append((i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))))
    want = [b for _, b, _ in personal_data.brute_force(rows)]
    assert [personal_data.written(personal_data.base_spans(t)) for _, t in rows] == want


@pytest.mark.parametrize("text", ["x" * 10**6, "1" * 10**6, "1." * 500_000, "a@" * 300_000, "+1 " * 300_000, "." * 10**6, "1 " * 500_000])
def test_long_runs_take_linear_time(text):
    seeds = personal_data.joined(personal_data.base_spans(text))
    assert sum(1 for _ in personal_data.targets(personal_data.plain(text), seeds)) <= len(text) // 8 + 1
