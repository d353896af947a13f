import shutil

from pyspark.sql import functions as F

from tokenloom.streaming import ingest


def _write(spark, folder, rows):
    spark.createDataFrame(rows, ingest.DOCUMENTS).coalesce(1).write.mode("append").parquet(folder)


def test_restart_reads_only_new_files(spark, tmp_path):
    source, table, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def run():
        ingest.append_batches(
            ingest.read_documents(spark, source), lambda b: b.where(F.col("n_chars") > 1).select("doc_id", "source", "n_chars"),
            table, ckpt).awaitTermination()
        return sorted(r["doc_id"] for r in spark.read.parquet(table).collect())

    _write(spark, source, [(1, "ab", "en", "a", 2), (2, "c", "en", "a", 1)])
    assert run() == [1]
    _write(spark, source, [(3, "abc", "en", "b", 3)])
    assert run() == [1, 3]
    assert run() == [1, 3]


def test_running_totals_continue(spark, tmp_path):
    source, table, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))

    def run():
        stream = ingest.read_documents(spark, source).select("source", F.col("n_chars").alias("n_tok"))
        ingest.running_source_totals(stream, table, ckpt).awaitTermination()
        return {r["source"]: (r["docs"], r["tokens"]) for r in ingest.latest_version(spark, table).collect()}

    _write(spark, source, [(1, "ab", "en", "a", 2), (2, "c", "en", "a", 1)])
    assert run() == {"a": (2, 3)}
    _write(spark, source, [(3, "abc", "en", "b", 3), (4, "d", "en", "a", 1)])
    assert run() == {"a": (3, 4), "b": (1, 3)}


def test_a_table_of_one_file_or_of_several_is_read_whole(spark, tmp_path):
    """Beside the table lies another: none of its rows are read."""
    rows = [(i, "ab" * i, "en", "a", 2 * i) for i in range(1, 7)]
    folder, single = tmp_path / "many" / "documents.parquet", tmp_path / "one" / "documents.parquet"
    spark.createDataFrame(rows, ingest.DOCUMENTS).repartition(3).write.parquet(str(folder))
    _write(spark, str(tmp_path / "part"), rows)
    single.parent.mkdir()
    shutil.copy(next((tmp_path / "part").glob("*.parquet")), single)
    for at in (folder, single):
        _write(spark, str(at.parent / "labels.parquet"), [(9, "x", "en", "b", 1)])
        out = str(at.parent.parent / f"out-{at.parent.name}")
        ingest.append_batches(ingest.read_table(spark, str(at)), lambda b: b.select("doc_id"), out, f"{out}-ckpt").awaitTermination()
        assert sorted(r["doc_id"] for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5, 6]
