"""Every registered query against its SQL counterpart, on the small tables."""

import importlib.util
from pathlib import Path

import pytest

from ripplegraph.plans.oracle import ORACLE
from ripplegraph.plans.registry import QUERIES

SMALL = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]

spec = importlib.util.spec_from_file_location("compare", ROOT / "tools" / "compare.py")
compare = importlib.util.module_from_spec(spec)
spec.loader.exec_module(compare)

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="the test tables are absent")
# Fits and forward passes are tested on their own; here they need too long.
SLOW = {"fit_structure", "fit_structure_text", "save_load_model", "gnn_infer", "gnn_infer_news", "graph_embeddings",
    "graph_feature_importance"}


@pytest.fixture(scope="module")
def db():
    return compare.connect(SMALL)


def test_every_counterpart_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SMALL).toPandas()
    if name in ORACLE:
        assert compare.difference(found, db.execute(ORACLE[name]).df()) == ""
    else:
        assert len(found) > 0


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).count() > 0
    assert set(module.oracle_sql()) <= set(module.queries())
