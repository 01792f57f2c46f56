"""Streams over files: rows that come twice, late rows, operators on new batches."""

from pyspark.sql import functions as F

from strandloom.operators import reads
from strandloom.streaming.deliveries import apply_to_new, counts_by_time, once_only, stream_files


def deliveries(spark, folder, parts):
    schema = "read_ind long, sample string, seq string, arrived_at timestamp_ntz"
    for k, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "read_ind long, sample string, seq string, t string").select("read_ind", "sample", "seq", F.expr("cast(t as timestamp_ntz) as arrived_at"))
        df.coalesce(1).write.mode("append").parquet(folder)
    return stream_files(spark, folder, spark.createDataFrame([], schema).schema, 1)


def test_streams(spark, tmp_path):
    parts = [[(1, "s", "ACGT", "2025-01-01 00:00:00"), (2, "s", "GG", "2025-01-01 00:10:00")], [(1, "s", "ACGT", "2025-01-01 02:00:00"), (3, "t", None, "2025-01-01 02:00:00")]]
    rows = deliveries(spark, str(tmp_path / "in"), parts)
    once = once_only(rows, ["read_ind"], "arrived_at")
    q = once.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.read_ind for r in spark.table("once").collect()) == [1, 2, 3]
    q = counts_by_time(rows, "arrived_at", "sample").writeStream.format("memory").outputMode("complete").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.sample, r.n_reads, r.n_bases) for r in spark.table("counts").collect()) == [("s", 1, 4), ("s", 2, 6), ("t", 1, None)]
    refs = spark.createDataFrame([(7, "TTACGTT")], "ref_ind int, ref_seq string")
    apply_to_new(rows, lambda b: reads.match_sequences(b.select("seq"), refs, 0), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r.seq, r.ref_ind) for r in found} == {("ACGT", 7)} and len(found) == 2
