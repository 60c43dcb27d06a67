"""Queries do the whole job on tables that the given ones are too small for."""

from helicase.plans import catalog


def test_ids_with_gaps_reach_the_last_customer(spark, tmp_path):
    spark.createDataFrame([(3, "three"), (2500, "last")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["id"]: r["value"] for r in catalog.QUERIES["container_ids_with_gaps"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(2501))
    assert {i: v for i, v in got.items() if v is not None} == {3: "three", 2500: "last"}
