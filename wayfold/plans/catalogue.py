"""All named queries and their SQL."""

from __future__ import annotations

from wayfold.plans import fused, matching, networks, routes, scans, texts, tracks

PARTS = (tracks, matching, texts, fused, routes, networks, scans)
QUERIES = {k: v for p in PARTS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PARTS for k, v in p.ORACLES.items()}
