"""Documents written as text files and read back."""

import os

from ledgerleaf.registry.queries import QUERIES
from ledgerleaf.sources import files


def test_a_file_for_each_row_and_a_folder_for_each_task(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert files.write_text_files(docs, f"file://{tmp_path}/out") == 200
    assert len(os.listdir(tmp_path / "out")) <= 3 and sum(len(f) for _, _, f in os.walk(tmp_path / "out")) == 200
    read = files.read_text_files(spark, f"{tmp_path}/out/*").select("text").collect()
    assert sorted(r.text for r in read) == sorted(f"{t}\n" for _, t in rows)


def test_scan_text_keeps_every_row(spark, tmp_path):
    rows = [(1, "Été\r\nb\rc"), (1, "the id again"), (-7, ""), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    read = {(r.doc_id, r.text) for r in QUERIES["scan_text"](spark, str(tmp_path)).collect()}
    assert read == {(1, "Été\nb\nc\n"), (1, "the id again\n"), (-7, "\n"), (None, "no id\n")}


def test_scan_text_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["scan_text"](spark, str(tmp_path)).collect() == []
