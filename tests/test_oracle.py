import pytest

from siftline.plans import queries as engine
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
#: No item of the smallest tables has both gold and a log row.
EMPTY = {"j14_outcome_calibration"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(engine.QUERIES))
def test_query(spark, duck, name):
    df = engine.QUERIES[name](spark, SF)
    if name in engine.ORACLE_SQL:
        assert difference(df, duck, engine.ORACLE_SQL[name]) == ("no rows" if name in EMPTY else "")
    else:
        assert df.count() > 0
