"""The pandas models of the bench do the work of the queries they are compared with."""

import os
import sys

import pytest
from conftest import ROOT, SF_DIR

from wayfold.plans import catalogue

sys.path.insert(0, ROOT)
import baseline  # noqa: E402


@pytest.mark.parametrize("name", sorted(baseline.MODELS))
def test_models_have_the_rows_of_queries(spark, name):
    if os.path.isdir(f"{SF_DIR}/events.parquet"):
        pytest.skip("a table of several files")
    assert len(baseline.MODELS[name](SF_DIR)) == catalogue.QUERIES[name](spark, SF_DIR).count()
