import duckdb
import pandas as pd
import pytest

from plexweave.plans.catalogue import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = "lineitem supplier part"
NAMES = ["ibu_count", "ibu_count_strict", "count_by_gene", "mtx_entries", "umi_correct", "whitelist_remap", "whitelist_hd1_halves", "whitelist_hd1_misses", "seq_variants", "map_gex", "map_crispr", "probe_dynamic", "guide_assign_cut"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, expected = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(expected.columns)
    order = lambda x: x[columns].astype(str).replace({"<NA>": "nan", "None": "nan"}).map(lambda v: v.removesuffix(".0")).sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(found), order(expected))
