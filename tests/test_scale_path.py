"""The large-data code paths (bucketed global rank, heavy-tie splitting, grouped
exact quantiles) must give exactly the twin's answer. Tiny buckets force them
on the small fixture: every SQL-twinned batch job is re-run with 25-row buckets."""

import pytest

from valuescope import catalog
from valuescope.parity import compare

from .conftest import SMALL

catalog.load_all()
BATCH = sorted(n for n, e in catalog.REGISTRY.items() if e.sql and e.family not in ("streaming", "ml", "text"))


@pytest.fixture(scope="module")
def tiny_buckets(spark):
    spark.conf.set("valuescope.rank.bucketRows", "25")
    yield spark
    spark.conf.unset("valuescope.rank.bucketRows")


@pytest.mark.parametrize("name", BATCH)
def test_scale_path_matches_duckdb(tiny_buckets, registry, duck_small, name):
    e = registry[name]
    r = compare(tiny_buckets, duck_small, name, e.fn, e.sql, SMALL)
    assert r["status"] == "match", r
