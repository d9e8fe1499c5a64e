"""Every registered query with a twin gives the twin's rows; the others give rows."""

import catalog
import pytest
from compare import compare

# fits without a twin have property tests of their own
SLOW = ("m5_", "m6_", "m7_", "m8_", "m9_", "m11_", "m16_", "t1_", "t4_", "t7_forecast_run", "t8_")


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES or not n.startswith(SLOW)])
def test_query(spark, sf, name):
    # order priorities by day are sparse at the smallest scale
    where = sf.replace("0.001", "0.01") if name.startswith(("w12", "t2", "t3", "f4_", "feature")) else sf
    assert compare(spark, name, catalog.QUERIES[name], catalog.ORACLES.get(name), where) is None
