"""Tools, chains, plugins and agents."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.plans.extensions import Registry, Step, Tool, chain, register_agent


@pytest.fixture
def registry():
    made = Registry()
    made.add(Tool("double", lambda df: df.withColumn("n", F.col("n") * 2), {"n": "bigint"}, "twice n"))
    made.add(Tool("fail", lambda df: df.select("missing")))
    return made


def test_chain_maps_columns_and_stops_at_the_first_fault(spark, registry):
    frame = spark.range(3).withColumn("x", F.lit("y"))
    got = chain(registry, [Step("double", {"n": "id"}), Step("double")])(frame)
    assert got.columns == ["n"] and [r["n"] for r in got.orderBy("n").collect()] == [0, 4, 8]
    with pytest.raises(RuntimeError, match=r"step 1 \(fail\) failed"):
        chain(registry, [Step("double", {"n": "id"}), Step("fail")])(frame)
    with pytest.raises(RuntimeError, match="no such column: nowhere"):
        chain(registry, [Step("double", {"n": "nowhere"})])(frame)
    with pytest.raises(RuntimeError, match="double needs n bigint"):
        chain(registry, [Step("double")])(frame)
    with pytest.raises(ValueError, match="no such tool"):
        chain(registry, [Step("absent")])
    with pytest.raises(ValueError, match="1 to 10 steps"):
        chain(registry, [Step("double")] * 11)


def test_registry(spark, registry):
    with pytest.raises(ValueError, match="already"):
        registry.add(Tool("double", lambda df: df))
    assert [r["name"] for r in registry.catalogue(spark).collect()] == ["double", "fail"]


def test_plugins_that_are_broken_harm_no_other(tmp_path, registry):
    (tmp_path / "good.py").write_text("from sparkloom.plans.extensions import Tool\nTOOLS = [Tool('same', lambda df: df)]")
    (tmp_path / "bad.py").write_text("raise OSError('no')")
    (tmp_path / "twin.py").write_text("from sparkloom.plans.extensions import Tool\nTOOLS = [Tool('double', lambda df: df)]")
    assert registry.load(str(tmp_path)) == {"bad": "OSError: no", "twin": "ValueError: there is a tool 'double' already"} and "same" in registry.tools


def test_agent_as_table_function(spark):
    def events(text):
        if text == "boom":
            raise ValueError("no")
        return [("token", text), ("final", text.upper())]

    register_agent(spark, "shout", events)
    assert [tuple(r) for r in spark.sql("SELECT * FROM shout('hi')").collect()] == [("token", "hi"), ("final", "HI")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM shout('boom')").collect()] == [("error", "ValueError: no")]
