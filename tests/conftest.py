import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from haulcomp.session import local_session

    return local_session("tests", 8, 4)


@pytest.fixture(scope="session")
def survey(spark):
    """(lfreq, cpue, specimen) of the smallest test tables."""
    from haulcomp import catalog

    return catalog.lfreq(spark, SF), catalog.cpue(spark, SF), catalog.specimen(spark, SF)


def rows(df, *by):
    """Rows as plain tuples, sorted."""
    return sorted(tuple(r) for r in (df.select(*by) if by else df).collect())


@pytest.fixture
def table(spark):
    """Small survey tables: table("lfreq", [(...), ...])."""
    from haulcomp.sources import schemas

    def make(kind, data):
        cols = {"lfreq": schemas.LFREQ, "cpue": schemas.CPUE, "specimen": schemas.SPECIMEN}[kind]
        return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in cols.items()))

    return make
