import duckdb
import pytest

from tessera.operators import components
from tessera.plans import catalog, derived


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """lineitem whose flow graph has one component of most vertices, two small ones and isolated vertices."""
    d = tmp_path_factory.mktemp("catalog")
    orders = [[(7 * o + 11 * k * k) % 60 for k in range(4)] for o in range(40)] + [[70, 71, 70], [75, 74, 76], [90]]
    rows = [(o, k, p, p % 5, float(1 + (o + k) % 50), 10.0 * p, 0.0) for o, parts in enumerate(orders) for k, p in enumerate(parts)]
    columns = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{d}/lineitem.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["cc_afforest_flow", "verify_cc_flow", "verify_bc_flow"])
def test_whole_table_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect())) == sorted(con.sql(catalog.SQL[name]).fetchall())


def test_whole_table_has_a_giant_component(spark, sf):
    """What the sparse graph lacks: a component of most vertices, inside which Afforest drops edges that its sample hasn't."""
    g = derived.flow(spark, sf)
    comp = {r.id: r.comp for r in components.afforest(g).collect()}
    sizes = sorted((sum(c == k for c in comp.values()) for k in set(comp.values())), reverse=True)
    assert sizes[0] > len(comp) // 2 and sizes[1:3] == [3, 2] and sizes[-1] == 1
    assert g.edges.groupBy("src").count().where("count > 2").count()
