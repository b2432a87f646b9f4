"""The registered boosted imputations run with the parameters of the operator."""

import inspect

import pytest
from pyspark.sql import functions as F

from tidemark.plans import risk
from workload import risk_queries
from workload.inputs import Inputs

SIGNATURE = inspect.signature(risk.impute_boosted)


@pytest.mark.parametrize("build, want", [(risk_queries.boosted, (0.05, 100, 10)), (risk_queries.carrier_boosted, (0.01, 300, 10))])
def test_production_parameters(spark, monkeypatch, build, want):
    seen = []

    def record(*args, **kwargs):
        call = SIGNATURE.bind(*args, **kwargs)
        call.apply_defaults()
        seen.append(tuple(call.arguments[k] for k in ("rate", "trees", "depth")))
        return args[0].withColumn("risk_score", F.lit(0.0))

    monkeypatch.setattr(risk, "impute_boosted", record)
    build(Inputs(spark, "/root/testdata/sf0.001"))
    assert seen == [want]
