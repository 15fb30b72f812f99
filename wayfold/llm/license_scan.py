"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Only DataFrame functions are used.  A text becomes an array of hashes of its five-word shingles.
Overlapping windows of SPAN shingles (SPAN + 4 words) are taken every SPAN shingles, so that
each shingle is in one window.  A window has BANDS bands of one MinHash row; it retrieves a
template if they agree in a band.  Templates are indexed by all their runs of up to SPAN
shingles, so a window that holds s of a template's shingles has a Jaccard similarity of s / SPAN
with one of the runs.  With two shingles a window and BANDS bands, a single shared shingle is
retrieved with probability 1 - (1/2)^BANDS, over 0.9999 for 14, and a window inside a template
always.  A retrieved template is verified: the share of its shingles that the document has, over
the whole text, must be at least CONTAINMENT.

Templates are a bounded list, so their bands and shingles are literals in the plan.  Defined results: letters
count in lower case, all but letters and digits separates words; null texts and texts under five
words have no license; rows that repeat a doc_id give a row for each license, with the best
containment; a null doc_id stays null; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

SHINGLE, SPAN, BANDS, CONTAINMENT = 5, 2, 14, 0.8

# Notices by which licenses are told, as their stewards publish them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT notice": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
}
# End of fixed values.


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")  # one stands at an end that is a separator


def _settled(rows: DataFrame, *kept: str, **made: Column) -> DataFrame:
    """The columns ``kept``, and those ``made``, which a generator computes: each once for a row, however often it is used."""
    return rows.select(*kept, F.inline(F.array(F.struct(*[c.alias(name) for name, c in made.items()]))))


def _shingled(rows: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept``, and the hashes of all shingles of ``text``, in order; without the texts that have none."""
    worded = _settled(rows, *kept, words=words(F.col("text"))).where(F.size("words") >= SHINGLE)
    places = F.sequence(F.lit(0), F.size("words") - SHINGLE)
    return _settled(worded, *kept, shingles=F.transform(places, lambda at: F.xxhash64(*[F.get("words", at + i) for i in range(SHINGLE)])))


def _bands(shingles: list[Column]) -> list[Column]:
    """The minimum of each band's hash over the shingles, none of which may be null."""
    return [F.least(*[F.xxhash64(s, F.lit(b)) for s in shingles]) if len(shingles) > 1 else F.xxhash64(shingles[0], F.lit(b)) for b in range(BANDS)]


def template_index(spark: SparkSession, templates: dict[str, str]) -> tuple[list[list[int]], Column]:
    """Band values of all runs of template shingles by band, and a literal array of (license, its band values, its
    distinct shingles)."""
    named = _shingled(spark.createDataFrame(list(templates.items()), "license string, text string"), "license")
    runs = named.select("license", F.posexplode("shingles").alias("at", "first"), "shingles")
    values: dict[str, set[tuple[int, int]]] = {name: set() for name in templates}
    for n in range(1, SPAN + 1):
        run = runs.where(F.col("at") + n <= F.size("shingles")).select("license", *[F.get("shingles", F.col("at") + i).alias(f"s{i}") for i in range(n)])
        for r in run.select("license", *_bands([F.col(f"s{i}") for i in range(n)])).distinct().collect():  # as many as the templates have words
            values[r[0]] |= set(enumerate(r[1:]))
    by_band = [sorted({v for own in values.values() for k, v in own if k == b}) for b in range(BANDS)]
    own = {r["license"]: r["own"] for r in named.select("license", F.array_distinct("shingles").alias("own")).collect()}
    known = [F.struct(F.lit(x).alias("license"), F.lit(sorted(v for _, v in values[x])).cast("array<long>").alias("values"), F.lit(own[x]).cast("array<long>").alias("template")) for x in own]
    return by_band, F.array(*known)


def _retrieving(by_band: list[list[int]]) -> Column:
    """The distinct band values of those windows of ``shingles`` that agree with a template in a band."""
    first = F.sequence(F.lit(0), F.size("shingles") - 1, F.lit(SPAN))
    # The first shingle is always there; what lies beyond the end repeats it, which changes no minimum.
    window = lambda at: F.struct(*[F.coalesce(F.get("shingles", at + i), F.get("shingles", at)).alias(f"s{i}") for i in range(SPAN)])
    bands = lambda w: _bands([w[f"s{i}"] for i in range(SPAN)])
    hits = F.filter(F.transform(first, window), lambda w: reduce(Column.__or__, [v.isin(own) for v, own in zip(bands(w), by_band, strict=True)]))
    return F.array_distinct(F.flatten(F.transform(hits, lambda w: F.array(*bands(w)))))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license and containment of every license that a document holds.

    Windows are taken, asked and verified within the document's row, so that no window carries its text along and
    nothing but findings is shuffled.
    """
    if not any(len(x.split()) >= SHINGLE for x in templates.values()):
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment")).where("false")
    by_band, known = template_index(docs.sparkSession, templates)
    rows = _shingled(docs.select("doc_id", "text"), "doc_id")
    rows = _settled(rows, "doc_id", "shingles", values=_retrieving(by_band)).where(F.size("values") > 0)
    retrieved = F.filter(known, lambda t: F.arrays_overlap(t["values"], "values"))
    share = lambda t: F.size(F.array_intersect(t["template"], "shingles")) / F.size(t["template"])
    verified = F.transform(retrieved, lambda t: F.struct(t["license"].alias("license"), F.round(share(t), 6).alias("containment")))
    found = rows.select("doc_id", F.inline(verified)).where(F.col("containment") >= CONTAINMENT)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """The same by brute force: every template's shingles against every document's."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    cut = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
    grams = f"[array_to_string(w[i : i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(w) - {SHINGLE - 2})]"
    return f"""
WITH t(license, text) AS (VALUES {values}),
tw AS (SELECT license, {cut} AS w FROM t),
ts AS (SELECT license, list_distinct({grams}) AS s FROM tw),
dw AS (SELECT doc_id, {cut} AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT DISTINCT doc_id, unnest({grams}) AS g FROM dw WHERE len(w) >= {SHINGLE}),
x AS (SELECT license, len(s) AS n, unnest(s) AS g FROM ts),
c AS (SELECT d.doc_id, x.license, round(count(*) / any_value(x.n), 6) AS containment FROM d JOIN x USING (g) GROUP BY ALL)
SELECT doc_id, license, containment FROM c WHERE containment >= {CONTAINMENT}
"""


ORACLE_SQL = _oracle()
