"""What the physical plans must and must not contain."""

from __future__ import annotations

import os
import re

import pytest

import __spark_entry__ as entry
from cellarline.operators import customers, products
from cellarline.sources import fact
from tests.conftest import DATA
from tools.plans import final_plan

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")

# Queries that answer with shares or totals of their own groups.
ONE_SCAN = (
    "dim_tipo", "vendedores", "segmento_precio_costo", "productos_all", "marcas_all", "top_productos_year",
    "top_clientes_year", "brand_type_fit", "market_share_tipo", "dependencia_marca", "retencion", "analisis_experto",
    "kpi_year", "cross_sell_opportunity", "fc_serie_productos", "forecast_total", "analisis_clientes_wide",
    "fin_balance", "fin_resultados", "fin_flujo", "fin_detalle", "ledger_profile_years", "ledger_profile_accounts",
)


@pytest.mark.parametrize("name", ONE_SCAN)
def test_one_scan(spark, name):
    plan = final_plan(entry.queries()[name](spark, DATA))
    assert len(re.findall("FileScan", plan)) == 1
    assert not re.search("NestedLoop|CartesianProduct|Python|InPandas", plan)


@pytest.mark.parametrize("name", ["analisis_experto", "analisis_clientes_wide"])
def test_expert_groups_take_three_hash_shuffles(spark, name):
    plan = final_plan(entry.queries()[name](spark, DATA))
    assert len(re.findall("Exchange hashpartitioning", plan)) <= 3


def test_no_query_multiplies_rows_or_runs_python(spark):
    eager = {"materialize_views", "resolve_materialized", "incremental_append", "write_truncate", "export_csv", "refresh_years"}
    eager |= {"kpi_year_states", "kpi_ytd_states", "transactional_append", "page_from_index", "search_from_index"}
    for name, run in entry.queries().items():
        if name not in eager:
            plan = run(spark, DATA)._jdf.queryExecution().executedPlan().toString()
            assert not re.search("NestedLoop|CartesianProduct|ArrowEvalPython|BatchEvalPython|InPandas", plan), name


def test_columns_reach_the_scan(spark):
    from cellarline.plans.warehouse import sales_table

    plan = final_plan(products.dim_marca(sales_table(spark, DATA)))
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert set(re.findall(r"(\w+):", read)) == {"marca_producto", "cantidad", "venta_neta_mn", "margen_mn"}


def test_account_filter_removes_branches(spark):
    from cellarline.operators import finance
    from cellarline.plans.warehouse import sales_table

    plan = final_plan(finance.fin_flujo(fact.ledger(sales_table(spark, DATA)), 2000))
    assert len(re.findall("FileScan", plan)) == 1


def test_hot_keys_are_split(spark):
    """Lines of which a third belong to one order, without broadcasts and with small thresholds."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {key: spark.conf.get(key, None) for key in options}
    star = fact.read_star(spark, DATA)
    from pyspark.sql import functions as F

    hot = F.when(F.col("l_linenumber") <= 2, F.lit(3)).otherwise(F.col("l_orderkey"))
    star["lineitem"] = star["lineitem"].withColumn("l_orderkey", hot.cast("bigint")).repartition(6)
    try:
        for key, value in options.items():
            spark.conf.set(key, value)
        joined = fact.sales_fact(star)
        plan = final_plan(joined)
        rows = joined.count()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plan and rows == star["lineitem"].count()


def test_orders_meet_the_lines_last(spark):
    """Else a sort-merge join with a dimension scatters the lines of an order, and sums by order shuffle every line."""
    plan = fact.sales_fact(fact.read_star(spark, DATA))._jdf.queryExecution().optimizedPlan().toString()
    upper = re.findall(r"Join Inner, \(?\(?(l_\w+)#", plan)
    assert upper == ["l_orderkey", "l_partkey", "l_suppkey"]


def test_rank_of_all_customers_is_distributed(spark):
    from cellarline.plans.warehouse import sales_table

    ranked = customers.top_clientes(sales_table(spark, DATA), "2001-08-01")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    # The only window without a partition runs over the counts per sort partition.
    assert plan.count("Window [") == 1 and "_rows" in plan.split("Window [")[1].split("]")[0]
