import pytest

from tests.oracle import rows
from tidepool.plans import registry, registry_tools  # noqa: F401

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    if name not in registry.ORACLES:
        assert registry.QUERIES[name](spark, DATA).count() > 0
        return
    got, want = rows(spark, name, registry.QUERIES[name], registry.ORACLES[name], DATA)
    assert got, name
    assert len(got) == len(want)
    assert [p for p in zip(got, want, strict=True) if p[0] != p[1]][:3] == []
