"""Rows that the given tables lack: texts without words, ids and texts that are null."""

import duckdb

from textmill.plans.catalog import ORACLES, QUERIES


def test_id_lines_of_texts_without_words(spark, tmp_path):
    rows = [(1, "two words"), (2, ""), (3, None), (4, " \t\n"), (None, "no id"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sql = duckdb.connect()
    sql.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("id_line_sidecar", "id_sentence_scan"):
        made = QUERIES[name](spark, str(tmp_path))
        want = sql.execute(ORACLES[name])
        names = [x[0] for x in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in made.collect())
