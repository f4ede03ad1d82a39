"""Large numbers are rounded and printed as the SQL of number_strings does it."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F

from papyrine.operators import grounding
from papyrine.plans import grounding_queries


def test_large_numbers_are_those_of_the_sql(spark, tmp_path):
    texts = ["5472476151044309 and 908038000000000 of 0.0000005", "9885103314 b, 4121565183462279, 40000000000000.0078", "0 or 0.1234565 or 2.50 or 100", "9" * 30 + " and " + "7" * 60, "1" + "0" * 305, "none", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet' WHERE doc_id <> 4")
    want = dict(db.execute(grounding_queries.SQL["number_strings"]).fetchall())
    got = {r.doc_id: r.numbers for r in grounding_queries.number_strings(spark, str(tmp_path)).collect()}
    assert got.pop(4) == f"{float('1' + '0' * 305):.0f}" and got == want and len(want) == 4
    assert spark.createDataFrame([(None,)], "t string").select(grounding.number_strings(F.col("t")).alias("x")).first().x == []
