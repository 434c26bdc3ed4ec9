import duckdb

from kumiki.plans import queries as Q


def test_weights_are_rounded_once_as_in_the_sql(spark, tmp_path):
    # balances halfway between two weights, where a double lies a little under or over its shortest decimal form
    rows = [(f"Customer#{k}", 10.0 * k + 5.0, "MACHINERY") for k in range(-100, 20_000)] + [("none", None, "MACHINERY")]
    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame(rows, "c_name string, c_acctbal double, c_mktsegment string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(Q.oracle_sql()["text_model_costs"]).fetchall())
    assert sorted(map(tuple, Q.text_model_costs(spark, str(tmp_path)).collect())) == want
