"""The golden cases against their SQL, and reconstructions of them with and without flags."""

import duckdb
import pytest
from chronofold.operators import fold
from chronofold.plans.reconstruct import reconstruct, state

from tests import golden


def plain(value):
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(golden.CASES))
def test_golden_rows(spark, name):
    case, sql = golden.CASES[name]
    found = case(spark, "")
    want = duckdb.connect().sql(sql)
    assert sorted(found.columns) == sorted(want.columns)
    rows = want.fetchall()
    order = [want.columns.index(c) for c in found.columns]
    assert sorted(repr(plain(r)) for r in found.collect()) == sorted(repr(plain([r[k] for k in order])) for r in rows)


def test_state_is_the_reconstruction(spark):
    bases, raw = golden._statutes(spark)
    for date in (None, "2001-06-01", "2004-12-31"):
        want = sorted(map(tuple, reconstruct(bases, [raw], date, recovery=2)[0].collect()))
        assert sorted(map(tuple, state(bases, [raw], date, recovery=2).select("law", "para", "text").collect())) == want
    assert fold.flags(fold.fold(bases.select("law", "para", "text"), golden.oplog.load(raw, 2))).count() == 1
