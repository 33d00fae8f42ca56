"""Sources and sinks: round trips, order over part files, refusals, reuse of stages, and streams against batches."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicklake.functions.times import from_micros, micros
from clicklake.sources.formats import Config, Stages, append_segment, checked, compact, raw_fingerprint, read_npy, read_tsv, row_index, write_ranked_text, write_tsv, zip_text
from clicklake.streaming.counters import rolling_counters, run_to_end, windowed


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


def test_tsv_keeps_quotes_and_nulls(spark, tmp_path):
    data = [("1", 'say "hi"', None), ("2", "a\tb\nc", "æ"), ("3", '"', "x")]
    write_tsv(spark.createDataFrame(data, "a string, b string, c string"), str(tmp_path / "t"))
    assert rows(read_tsv(spark, str(tmp_path / "t"), "a string, b string, c string")) == [("1", 'say "hi"', None), ("2", "a b c", "æ"), ("3", '"', "x")]


def test_npy_files(spark, tmp_path):
    for k in range(3):
        np.save(tmp_path / f"m{k}.npy", np.full((k + 1, 4), k, np.float64))
    got = read_npy(spark, str(tmp_path))
    assert got.count() == 6 and {len(r.vector) for r in got.collect()} == {4}


def test_row_index_is_known_before_filters(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    assert rows(row_index(spark.read.parquet(str(tmp_path / "t")).where("id % 40 = 7")).select("id", "row")) == [(7, 7), (47, 47), (87, 87)]


def test_ranked_text_is_in_order_and_zips(spark, tmp_path):
    lines = spark.range(1000).orderBy(F.rand(3)).select(F.col("id").alias("src_row"), F.concat(F.col("id").cast("string"), F.lit(" [1]")).alias("line"))
    write_ranked_text(lines.repartition(7), str(tmp_path / "t"))
    target = io.BytesIO()
    zip_text(spark, str(tmp_path / "t"), target, "inner.txt")
    with zipfile.ZipFile(target) as z:
        assert z.namelist() == ["inner.txt"]
        assert z.read("inner.txt").decode().split("\n")[:-1] == [f"{i} [1]" for i in range(1000)]


def test_bad_output_is_seen(spark):
    want = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, n int")
    got = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (2, [1, 2]), (9, [1])], "id long, ranks array<int>")
    assert tuple(checked(got, want, "id", "ranks", F.col("n")).first()) == (1, 1, 1, 1)


def test_stages_are_reused_until_the_fingerprint_changes(spark, tmp_path):
    s, built = Stages(spark, str(tmp_path / "s")), []
    for f in ("a", "a", "b"):
        assert s.stage("x", f, lambda: built.append(1) or spark.range(3)).count() == 3
    assert len(built) == 2 and [m["reused"] for m in s.metrics] == [False, True, False]


def test_fingerprint_and_config(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    one = raw_fingerprint(spark, str(tmp_path))
    (tmp_path / "a").write_text("xy")
    assert one != raw_fingerprint(spark, str(tmp_path))
    c = Config.load('{"dataset": "d", "splits": [{"name": "t", "time_from": "a", "time_to": "b"}]}')
    assert c.splits[0].name == "t" and c.fingerprint() == Config.load('{"dataset": "d", "splits": [{"name": "t", "time_from": "a", "time_to": "b"}]}').fingerprint()
    with pytest.raises(TypeError):
        Config.load('{"dataset": "d", "colour": 1}')


def test_segments(spark, tmp_path):
    for d in ("1", "2", "2"):
        append_segment(spark.range(int(d) * 10), str(tmp_path / "in"), d)
    assert compact(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1).count() == 30


def test_micros_round_trip(spark):
    df = spark.sql("select timestamp_ntz'2024-10-27 02:30:00.123456' as t union all select timestamp_ntz'1969-12-31 23:59:59.999999' union all select null")
    assert rows(df.select(from_micros(micros(F.col("t"))))) == rows(df) and rows(df.select(micros(F.col("t"))))[0] == (-1,)


def test_stream_counters_equal_batch_over_several_batches(spark, tmp_path):
    for k in range(3):  # files in order of time, as a stream brings them
        spark.sql(f"select id % 3 as article_idx, timestamp_ntz'2024-09-0{k + 1} 00:00:00' + make_dt_interval(0, 0, 0, cast(id % 7 as int)) as time, id % 2 = 0 as label from range(50)").coalesce(1).write.parquet(str(tmp_path / f"f{k}"))
    schema = "article_idx long, time timestamp_ntz, label boolean"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f*"))
    got = run_to_end(rolling_counters(stream)).groupBy("article_idx").agg(F.max("roll_inview"), F.max("roll_clicks"), F.sum("late"))
    batch = spark.read.schema(schema).parquet(str(tmp_path / "f*"))
    assert rows(got) == rows(batch.groupBy("article_idx").agg(F.count("*"), F.count_if("label"), F.lit(0)))
    days = run_to_end(windowed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "f*")), "time", "article_idx", "1 day"), "complete")
    assert days.agg(F.sum("n")).first()[0] == 150 and days.count() == 9
