"""The native operators run no Python, and the texts of a scan are read once where one reading does."""

import re

import pytest

from folioflow.llm import queries

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


@pytest.mark.parametrize("name", ["op2_source_mixing", "op4_url_filters", "op9_quality_rules"])
def test_native(spark, name):
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", physical(queries.QUERIES[name](spark, SF)))


def test_rules_read_texts_once_and_shuffle_nothing(spark):
    p = physical(queries.QUERIES["op9_quality_rules"](spark, SF))
    assert p.count("FileScan") == 1 and "Exchange" not in p


def test_filters_on_the_ledger_stay_above_it(spark):
    """Below the generator, a filter would compute the measurements again inside its lambdas."""
    import corpus_pipeline
    from folioflow.llm.common import table

    p = physical(corpus_pipeline.quality(spark, table(spark, SF, "documents"), SF))
    assert p.index("Filter") < p.index("Generate")


def test_urls_read_two_columns(spark):
    assert "html" not in physical(queries.QUERIES["op4_url_filters"](spark, SF))
