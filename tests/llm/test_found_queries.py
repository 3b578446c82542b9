import os

import duckdb

from lodestrand.llm import queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": ["chunk_id"], "p2_found": ["case_id_a", "case_id_b"], "p3_found": ["chunk_id", "start_pos", "end_pos"], "p4_found": ["chunk_id_a", "chunk_id_b"],
    "p5_found": ["record_kind", "id_a", "id_b"], "p6_found": ["chunk_id_a", "chunk_id_b"], "p7_found": ["chunk_id", "line_no"], "p10_found": ["doc_id"],
}


def test_columns_and_order(spark):
    for name, columns in COLUMNS.items():
        df = queries.queries()[name](spark, FOLDER)
        assert df.columns == columns, name
        rows = df.collect()
        assert len(rows) == len(set(rows)), name
        if columns[-1].endswith("_b"):
            assert all(r[-2] < r[-1] for r in rows), name


def test_sql(spark):
    con = duckdb.connect()
    for name in ("chunks", "eval_cases", "documents", "chunk_vectors"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        ours = sorted(map(tuple, queries.queries()[name](spark, FOLDER).collect()))
        assert ours == sorted(con.sql(sql).fetchall()), name
