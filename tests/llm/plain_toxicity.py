"""A plain fit of the toxicity model on lists of texts: what ``toxicity.fit`` is tested against, and a choice among settings by
cross-validation within rows that may be learnt from.

``python tests/llm/plain_toxicity.py DIR...`` prints, for each setting, the log loss, recall and false alarms of five folds of the
training rows of each folder of tables; rows held out are never read.
"""

from __future__ import annotations

import math
import os
import sys
import zlib
from collections import Counter
from dataclasses import asdict, dataclass

import numpy as np

from wayfold.llm import toxicity


@dataclass(frozen=True)
class Settings:
    least: int = toxicity.LEAST_SUPPORT
    explained: int = toxicity.EXPLAINED
    margin: float = toxicity.MARGIN
    many: int = toxicity.MANY


def _kind(feature: str) -> int:
    return len(feature) - len(feature.lstrip("^"))


def names(texts: list[set[str]], toxic: list[int], s: Settings) -> list[str]:
    """The features that are more frequent among toxic texts than chance explains, strongest first."""
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    hit, miss = Counter(), Counter()
    for own, y in zip(texts, toxic, strict=True):
        (hit if y else miss).update(own)
    tested = Counter(_kind(x) for x in hit.keys() | miss.keys() if hit[x] + miss[x] >= s.least)
    share, found = n1 / (n1 + n0), []
    for x, a in hit.items():
        b = miss[x]
        p = a / (a + b)
        if a < s.least or p <= share or b > 0.005 * n0 + 0.1 * a:
            continue
        kl = p * math.log(p / share) + ((1 - p) * math.log((1 - p) / (1 - share)) if p < 1 else 0.0)
        if (a + b) * kl > math.log(max(tested[_kind(x)], 2)) + s.margin:
            found.append((3 * b - a, len(x), x))
    return [x for _, _, x in sorted(found)]


def terms(texts: list[set[str]], raw: list[str], toxic: list[int], s: Settings) -> list[tuple[str, bool]]:
    """The lexicon: the seed, and the names that say what no shorter one says and that texts need."""
    ranked, kept = names(texts, toxic, s), []
    for x in ranked:
        k, bare = _kind(x), x.lstrip("^")
        if not any(y != x and _kind(y) and _kind(y) <= max(k, 1) and len(y.lstrip("^")) in toxicity.STEMS and bare.startswith(y.lstrip("^")) for y in kept):
            kept.append(x)
    distinct = {t: own for t, own, y in zip(raw, texts, toxic, strict=True) if y}
    said, chosen = Counter(), []
    for x in kept:
        holders = [t for t, own in distinct.items() if x in own]
        if sum(said[t] < s.explained for t in holders) >= s.least:
            chosen.append(x)
            said.update(holders)
    out = [(w, False) for w in toxicity.SEED]
    for x in chosen:
        k, bare = _kind(x), x.lstrip("^")
        words = [y for y in ranked if not _kind(y) and y.startswith(bare)] if k == 1 else [bare]
        out.append((words[0], False) if k < 2 and len(words) == 1 else (bare, True))
    return list(dict.fromkeys(out))


def fit(raw: list[str], toxic: list[int], s: Settings = Settings(), own: list[set[str]] | None = None) -> toxicity.Model:
    model = toxicity.Model(terms(own or [toxicity.features(t) for t in raw], raw, toxic, s))
    scorer = toxicity.Scorer(model)
    hits = [scorer.hits([t])[0] for t in raw]
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    for x in {x for h in hits for x, _ in h}:
        a = sum(y and any(x == z for z, _ in h) for h, y in zip(hits, toxic, strict=True))
        b = sum(not y and any(x == z for z, _ in h) for h, y in zip(hits, toxic, strict=True))
        odds = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
        usual = 4.0 if x[1] == 0 else 2.5
        model.weights[x] = min(max(((a + b) * odds + 2 * usual) / (a + b + 2), toxicity.LEAST_WEIGHT), toxicity.MOST_WEIGHT)
    e = np.array([scorer.evidence(h) for h in hits])
    model.slope, model.offset = toxicity._logistic(e, np.array(toxic, dtype=float))
    return model


def training_rows(folder: str) -> list[tuple[str, int, int]]:
    """(text, toxic, fold) of the rows that may be learnt from."""
    import duckdb

    rows = duckdb.sql(f"SELECT doc_id, coalesce(text, ''), toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) "
                      "WHERE toxic IS NOT NULL").fetchall()
    return [(t, int(y), zlib.crc32(f"fold{i}".encode()) % 5) for i, t, y in sorted(rows) if zlib.crc32(str(i).encode()) % 3 != 1]


def cross_validated(args: tuple[str, Settings]) -> tuple[str, Settings, float, float, int]:
    """Log loss, recall and false alarms over the folds that a model wasn't fitted on."""
    folder, s = args
    toxicity.MANY = s.many
    rows = training_rows(folder)
    own = [toxicity.features(t) for t, _, _ in rows]
    loss, caught, false = 0.0, 0, 0
    for fold in range(5):
        at = [i for i, r in enumerate(rows) if r[2] != fold]
        scorer = toxicity.Scorer(fit([rows[i][0] for i in at], [rows[i][1] for i in at], s, [own[i] for i in at]))
        for t, y, k in rows:
            if k == fold:
                p = scorer.score(scorer.hits([t])[0])
                loss -= math.log(p if y else 1 - p)
                caught, false = caught + (y and p >= toxicity.THRESHOLD), false + (not y and p >= toxicity.THRESHOLD)
    return folder, s, loss / len(rows), caught / max(sum(r[1] for r in rows), 1), false


def settings() -> list[Settings]:
    """What is tried: one thing changed at a time, then the bold and the careful together."""
    now = Settings()
    single = {"least": (2, 3, 6), "explained": (1, 2, 5), "margin": (0.0, 3.0, 6.0), "many": (1, 2)}
    out = [now] + [Settings(**(asdict(now) | {k: x})) for k, xs in single.items() for x in xs]
    return out + [Settings(3, 2, 1.0), Settings(3, 5, 1.0), Settings(6, 2, 6.0)]


if __name__ == "__main__":
    from multiprocessing import Pool

    todo = [(os.path.abspath(f), s) for f in sys.argv[1:] for s in settings()]
    with Pool(8) as pool:
        for folder, s, loss, recall, false in pool.imap(cross_validated, todo, 1):
            print(os.path.basename(folder), *asdict(s).values(), f"loss {loss:.5f} recall {recall:.3f} false {false}", flush=True)
