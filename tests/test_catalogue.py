import pytest
from conftest import SF, same

from colloquy.plans import models, more  # noqa: F401 (register queries)
from colloquy.plans.catalogue import ORACLE, QUERIES


#: Runs of minutes; the operators have tests of their own.
SLOW = {"kmeans_sweep", "tfidf_cv", "suite_headline", "density_choice", "word_topics"}


@pytest.mark.parametrize("name", list(ORACLE))
def test_same_as_sql(spark, duck, name):
    same(QUERIES[name](spark, SF), duck.sql(ORACLE[name]))


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE and n not in SLOW])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) >= {"variant", "seed", "n_runs"}
    assert set(e.oracle_sql()) <= set(e.queries())
