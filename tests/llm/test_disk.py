"""What a job leaves on disk, and what it holds there and in memory while it runs."""

from __future__ import annotations

import time

import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from finquery.llm import ngram_join
from finquery.llm.alignment import alignment
from finquery.llm.scratch import LARGE_ROWS, READER_ROWS, Scratch


def test_shuffles_go_with_their_job(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(files.getAllFiles().apply(k).getName().startswith("shuffle_") for k in range(files.getAllFiles().size()))
    before, work = shuffled(), Scratch(spark, "test")
    table = work.table("dealt", spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count())
    assert len(table.collect()) == 10
    for _ in range(50):  # they go beside the next steps
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before
    work.remove()


def test_a_stage_leaves_its_decisions_only(spark, tmp_path, monkeypatch):
    rows = [(k, f"the same story number {k // 3} is told by the old woman at the gate of town {k // 3} each year", "en", "web", 10) for k in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("finquery.llm.scratch.shared_folder", lambda spark: f"file://{tmp_path}/shared")
    kept = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert [p.name.split("-")[1] for p in (tmp_path / "shared").iterdir()] == ["gone"]
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == list(range(0, 30, 3))


def test_copies_hold_no_shingles(spark, monkeypatch):
    """A text with copies, in whatever chunks, is read once; what else it links with, its copies link with."""
    monkeypatch.setattr("finquery.llm.fingerprint_index.CHUNK_BYTES", 1)
    words = [f"w{k}" for k in range(200)]
    near = " ".join([*words[:-1], "other"])
    texts = [" ".join(words)] * 20 + [near] * 2 + [" ".join(words).upper(), " ".join(f"x{k}" for k in range(50))] + ["alone with copies and nothing else near it"] * 5
    docs = spark.createDataFrame([*((k, t) for k, t in enumerate(texts)), (None, texts[0]), (None, "nobody")], "doc_id long, text string").repartition(8)
    work = Scratch(spark, "test")
    known, with_sets = ngram_join.shared_sets(work, docs, 3, 90)
    assert known.count() == len(texts) + 2
    assert sorted(r[0] for r in with_sets.select("doc_id").collect()) == [0, 20]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark, docs).where("doc_id is not null").collect()}
    assert found == {k: (198, 0) for k in range(23)} | {23: (48, 23)} | {k: (6, 24) for k in range(24, 29)}
    assert sorted((r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(spark, docs).where("doc_id is null").collect()) == [(1, None), (198, None)]
    work.remove()


def test_rows_of_megabytes_are_read_a_few_at_a_time(spark, monkeypatch):
    """A chunk row of the alignment has megabytes: as many as Spark's reader takes by itself do not fit an executor."""
    rows, write = {}, DataFrameWriter.parquet
    name = "spark.sql.parquet.columnarReaderBatchSize"
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (rows.update({path.rsplit("/", 1)[1]: int(spark.conf.get(name))}), write(self, path, *a, **b))[1])
    docs, _ = alignment(spark, spark.createDataFrame([(1, "the cat sat"), (2, "on a mat")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert docs.count() == 2
    assert rows["pairs"] <= 8 and rows["documents"] <= 8
    assert int(spark.conf.get(name)) == READER_ROWS


def test_tables_of_large_rows_are_written_in_small_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("finquery.llm.scratch.shared_folder", lambda spark: f"file://{tmp_path}")
    work = Scratch(spark, "test")
    large = spark.range(0, 40, 1, 1).select(F.expr("array_join(transform(sequence(1, 16384), k -> sha2(string(k * 41 + id), 256)), '')").alias("raw"))
    assert work.table("large", large, **LARGE_ROWS).count() == 40
    (file,) = (p for p in tmp_path.rglob("*.parquet") if p.name.startswith("part-"))
    found = pq.ParquetFile(file).metadata
    assert max(found.row_group(k).total_byte_size for k in range(found.num_row_groups)) < 32 << 20
    work.remove()
