"""Every query of the engine against its SQL."""

import pytest

from vecloom.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, compare, name):
    compare(queries()[name](spark, FOLDER), oracle_sql()[name], FOLDER)


def test_entry_and_queries_without_sql(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    for name in sorted(queries().keys() - oracle_sql().keys()):
        assert queries()[name](spark, FOLDER).count() > 0


def test_derived_searches_follow_the_number_of_points_and_find_more(spark):
    """More of the exact nearest than with fixed parameters, in every search, and no ratio below 1."""
    known = queries()
    truth = {(r.qid, r.id): r.dist for r in known["exact_knn"](spark, FOLDER).collect()}
    for name in ("search_partitioned_complete", "search_partitioned_strict", "search_iteratively"):
        fixed, derived = ({(r.qid, r.id) for r in known[n](spark, FOLDER).collect()} for n in (name, f"{name}_derived"))
        assert len(derived & truth.keys()) > len(fixed & truth.keys())
    assert all(r.valid for r in known["eval_ratio_derived"](spark, FOLDER).collect())
    assert known["eval_missed_derived"](spark, FOLDER).first().average_ratio >= 1


def test_draws_do_not_depend_on_the_number_of_cores(spark, monkeypatch):
    """Nor do the moments, which a share close to the edge of its rounding did."""
    seen, own = set(), oracle_sql()["random_moments"]
    for cores in (2, 3, 9):
        monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", cores)
        seen.add(queries()["random_generators"](spark, FOLDER).selectExpr("sum(hash(*))").first()[0])
    assert len(seen) == 1
    settled = queries()["random_moments"](spark, FOLDER).first()
    assert f"{settled.zipf_tenth}::DOUBLE AS zipf_tenth" in own and f"{settled.zipf_first}::DOUBLE AS zipf_first" in own
