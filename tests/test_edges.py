"""Queries against their SQL on rows that the driver's tables seldom or never have."""

import __spark_entry__
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq


def both(spark, folder, query, **tables):
    """What a query gives on such tables, and what its SQL gives."""
    con = duckdb.connect()
    for name, rows in tables.items():
        pq.write_table(rows, f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    df = __spark_entry__.queries()[query](spark, str(folder))
    columns = ", ".join(df.columns)
    return sorted(map(tuple, df.collect()), key=repr), sorted(con.execute(f"select {columns} from ({__spark_entry__.oracle_sql()[query]})").fetchall(), key=repr)


def test_files_at_the_limit_of_size(spark, tmp_path):
    texts = ["a" * n for n in (10484, 10485, 10486, 10487)] + ["é" * 5243, "", None]
    docs = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "n_chars": pa.array([len(t) if t is not None else None for t in texts], pa.int64())})
    got, want = both(spark, tmp_path, "inspect_records", documents=docs)
    assert got == want and [r[5] for r in got] == [False, False, False, True, False, False, False]


def test_records_that_break_their_tools_rule(spark, tmp_path):
    """One line an order, all as it lies on disk: what is wrong is by the rule alone."""
    n = 19 * 40
    keys = list(range(n))
    lines = pa.table({
        "l_orderkey": pa.array(keys, pa.int64()), "l_partkey": pa.array([k % 3 for k in keys], pa.int64()), "l_suppkey": pa.array([1] * n, pa.int64()), "l_linenumber": pa.array([1 + k // 19 % 7 for k in keys], pa.int32()), "l_quantity": [float(3 + k // 19 * 11 % 47) for k in keys],
        "l_discount": [k // 19 % 11 / 100 for k in keys], "l_tax": [k // 19 % 9 / 100 for k in keys], "l_returnflag": ["N"] * n, "l_linestatus": ["OF"[k // 19 % 2] for k in keys],
    })
    got, want = both(spark, tmp_path, "result_problems", lineitem=lines)
    assert got == want and {r[1] for r in got} == {None, "rule"} and len({r[0] % 19 for r in got if r[1]}) >= 10
