"""Chunks of very long texts."""

from quarrylight.plans import catalogue


def test_line_windows_of_a_very_long_text(spark, tmp_path):
    n = 30_000
    spark.createDataFrame([(1, "\n".join(f"line {i}" for i in range(n)))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalogue.QUERIES["chunk_line_window"](spark, str(tmp_path)).collect()
    assert len(rows) == 667 and max(r["end_line"] for r in rows) == n
