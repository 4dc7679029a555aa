"""Every query against its oracle on a freshly generated TPC-H-like dataset
(other sizes, keys and distributions than the driver's tables)."""

import os

import numpy as np
import pandas as pd
import pytest

from tests.oracle_harness import compare, duck
from tillroll.plans.catalog import ORACLE, QUERIES
from tillroll.session import scratch_dir


def make_tables(path: str, seed: int = 11) -> None:
    rng = np.random.default_rng(seed)
    n_cust, n_part, n_orders = 60, 90, 700
    names = ["rose", "steel", "blue", "small", "lace", "tin", "gold", "mint"]
    types = ["ECONOMY", "STANDARD", "SMALL", "LARGE", "MEDIUM", "PROMO"]
    nation = pd.DataFrame({"n_nationkey": np.arange(25, dtype="int32"),
                           "n_name": [f"NATION_{i}" for i in range(25)],
                           "n_regionkey": (np.arange(25) % 5).astype("int32")})
    customer = pd.DataFrame({"c_custkey": np.arange(n_cust, dtype="int64"),
                             "c_nationkey": rng.integers(0, 25, n_cust).astype("int32")})
    part = pd.DataFrame({"p_partkey": np.arange(n_part, dtype="int64"),
                         "p_name": [f"{names[i % 8]} {names[(i * 3) % 8]}" for i in range(n_part)],
                         "p_brand": [f"Brand#{rng.integers(1, 9)}" for _ in range(n_part)],
                         "p_type": [types[rng.integers(0, 6)] for _ in range(n_part)],
                         "p_retailprice": np.round(rng.uniform(1, 40, n_part), 1)})
    okeys = np.sort(rng.choice(np.arange(1, 20000), n_orders, replace=False)).astype("int64")
    # a heavy customer: about a third of the orders
    cust = np.where(rng.random(n_orders) < 0.33, 5, rng.integers(0, n_cust, n_orders)).astype("int64")
    days = rng.integers(0, 3 * 365, n_orders)
    orders = pd.DataFrame({"o_orderkey": okeys, "o_custkey": cust,
                           "o_orderdate": (pd.Timestamp("2009-12-01") + pd.to_timedelta(days, unit="D"))
                           .astype("datetime64[us]")})
    li = []
    for k in okeys:
        for ln in range(1, rng.integers(1, 8) + 1):
            li.append((k, int(rng.integers(0, n_part)), ln, float(rng.integers(1, 30))))
    lineitem = pd.DataFrame(li, columns=["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]).astype(
        {"l_orderkey": "int64", "l_partkey": "int64", "l_linenumber": "int32", "l_quantity": "float64"})
    for name, df in {"nation": nation, "customer": customer, "part": part, "orders": orders,
                     "lineitem": lineitem}.items():
        df.to_parquet(os.path.join(path, f"{name}.parquet"), index=False)


@pytest.fixture(scope="module")
def tables(spark):
    path = scratch_dir(spark, "random-tables")
    os.makedirs(path, exist_ok=True)
    make_tables(path)
    return path


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle_on_random_tables(spark, tables, name):
    con = duck(tables)
    try:
        r = compare(spark, tables, name, QUERIES[name], ORACLE[name], con)
    except Exception as e:  # noqa: BLE001
        if "Bin edges must be unique" in str(e):
            pytest.skip("repeated quantile edges raise, as in the original")
        raise
    assert r["status"] == "match", r
