"""Sources and sinks besides plain Parquet: TSV, vector files, ranked text, archives, fingerprints, stages and segments."""

from __future__ import annotations

import hashlib
import io
import json
import resource
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clicklake.operators.lists import list_rank, ranked_line
from clicklake.plans.cut import cut, shared_dir
from clicklake.sources.logs import ARTICLES, IMP, articles, impressions
from clicklake.sources.tables import table

NEWS = "news_id string, category string, title string, abstract string"


@dataclass(frozen=True)
class Split:
    """A half-open window of the log."""

    name: str
    time_from: str
    time_to: str


@dataclass(frozen=True)
class Config:
    """A data set's settings, read from JSON; unknown keys are refused."""

    dataset: str
    splits: tuple[Split, ...] = ()
    halflife_hours: float = 24.0
    params: dict = field(default_factory=dict)

    @staticmethod
    def load(text: str) -> Config:
        raw = json.loads(text)
        return Config(**{**raw, "splits": tuple(Split(**s) for s in raw.get("splits", ()))})

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headerless tab-separated text, quotes being ordinary characters, under an explicit schema; empty fields are null."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """The inverse: tabs and line ends inside fields become spaces, null an empty field."""
    plain = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), "[\t\r\n]+", " "), F.lit("")).alias(c) for c in df.columns]
    df.select(F.concat_ws("\t", *plain).alias("value")).write.text(path)


def row_index(df: DataFrame) -> DataFrame:
    """Adds `file` and `row`, the position in the Parquet file, before any filter: known to the scan, not counted."""
    return df.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))


def decode_npy(files: DataFrame) -> DataFrame:
    """(path, id, vector) of files (path, content) that each hold a two-dimensional `.npy` matrix; ids count its rows."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, data in zip(b["path"], b["content"]):
                m = np.load(io.BytesIO(data)).astype(np.float32)
                yield pd.DataFrame({"path": p, "id": np.arange(len(m)), "vector": list(m)})

    return files.select("path", "content").mapInPandas(rows, "path string, id bigint, vector array<float>")


def encode_npy(vectors: DataFrame, vector: str, rows_a_file: int = 4096) -> DataFrame:
    """(path, content): the vectors of each partition as matrices of at most so many rows, named by partition and number."""

    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, k = TaskContext.get().partitionId(), 0
        for b in batches:
            for i in range(0, len(b), rows_a_file):
                data = io.BytesIO()
                np.save(data, np.array(b[vector].iloc[i : i + rows_a_file].tolist(), np.float32))
                yield pd.DataFrame({"path": [f"{part}-{k}.npy"], "content": [data.getvalue()]})
                k += 1

    return vectors.select(vector).mapInPandas(files, "path string, content binary")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """The vectors of a `.npy` file or a folder of them, one file being one task's work: a large matrix belongs into many."""
    return decode_npy(spark.read.format("binaryFile").load(path))


def write_ranked_text(lines: DataFrame, path: str, row_id: str = "src_row", line: str = "line") -> None:
    """One line a source row, in order of the row id over all part files: a range partitioning, sorted within."""
    lines.repartitionByRange(row_id).sortWithinPartitions(row_id).select(F.col(line).alias("value")).write.text(path)


def checked(lines: DataFrame, expected: DataFrame, row_id: str, ranks: str, size: Column) -> DataFrame:
    """One row: expected rows without a line, lines nobody expects, rows twice, and lists of the wrong size. All must be 0."""
    both = expected.select(row_id, size.alias("size")).join(lines.groupBy(row_id).agg(F.count("*").alias("n"), F.max(F.size(ranks)).alias("got")), row_id, "full")
    return both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("size").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("twice"), F.count_if((F.col("size") != F.col("got"))).alias("wrong_size"))


def zip_text(spark: SparkSession, folder: str, target: str | io.BytesIO, inner: str) -> None:
    """The part files of a text table, in order, as one member of an archive; lines stream through the driver."""
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*"))
    names = sorted(f.getPath().toString() for f in files)
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z, z.open(inner, "w", force_zip64=True) as out:
        for name in names:
            for row in spark.read.text(name).toLocalIterator():
                out.write((row[0] + "\n").encode())


def raw_fingerprint(spark: SparkSession, folder: str, pattern: str = "*") -> str:
    """SHA-256 over the sorted (name, size) of a folder's entries; times don't matter."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")) or []
    return hashlib.sha256(json.dumps(sorted((f.getPath().getName(), fs.getContentSummary(f.getPath()).getLength()) for f in found)).encode()).hexdigest()


class Stages:
    """Stages of a build, each written once: a stage whose table and fingerprint exist is read back, not computed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.metrics = spark, root, []

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _memory(self) -> dict[str, float]:
        """Most resident MB of this Python process so far, and MB of the driver's heap in use now."""
        heap = self.spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
        return {"python_mb": round(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024, 1), "heap_mb": round((heap.totalMemory() - heap.freeMemory()) / 1e6, 1)}

    def stage(self, name: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage; its rows, seconds, whether it was reused, and MB of the driver's Python and JVM are noted in `metrics`."""
        began, mark = time.time(), f"{name}.{fingerprint[:16]}"
        done, fs = self._path(f"{mark}/_SUCCESS")
        reused = fs.exists(done)
        if not reused:
            build().write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{mark}")
        out = self.spark.read.parquet(f"{self.root}/{mark}")
        self.metrics.append({"stage": name, "reused": reused, "rows": out.count(), "seconds": round(time.time() - began, 3), **self._memory()})
        return out


def append_segment(df: DataFrame, root: str, segment: str) -> None:
    """A day's rows as a segment of their own: nothing older is rewritten."""
    df.write.mode("overwrite").parquet(f"{root}/segment={segment}")


def compact(spark: SparkSession, root: str, target: str, files: int) -> DataFrame:
    """All segments as one table of fewer, larger files."""
    spark.read.parquet(root).repartition(files).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


# queries


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def scan_parquet_q(spark, folder):
    return table(spark, folder, "articles").where("lang = 'en'").select("idx", "src_id", "lang")


def scan_tsv_q(spark, folder):
    path = _scratch(spark)
    write_tsv(articles(spark, folder).select("src_id", "topic", "title", "abstract"), path)
    return read_tsv(spark, path, NEWS)


def scan_npy_q(spark, folder):
    """All vectors as matrix files and back, the id going along as a first column."""
    rows = table(spark, folder, "embeddings").select(F.concat(F.array(F.col("vec_id").cast("float")), F.col("embedding").cast("array<float>")).alias("v"))
    back = decode_npy(encode_npy(rows, "v"))
    return back.select(F.col("vector")[0].cast("bigint").alias("id"), (F.size("vector") - 1).alias("n"), F.round(F.col("vector")[1].cast("double"), 6).alias("first"))


def row_index_q(spark, folder):
    return row_index(table(spark, folder, "clickstream")).select("row", "click_id", "user_idx")


def sink_parquet_q(spark, folder):
    path = _scratch(spark)
    articles(spark, folder).select("idx", "title").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def _ranked(spark, folder):
    rows = impressions(spark, folder, "size(candidates) > 0")
    ranks = list_rank(F.transform("candidates", lambda x: (x % 7).cast("double")))
    return rows.select("src_row", "candidates", ranks.alias("ranks")).withColumn("line", ranked_line(F.col("src_row"), F.col("ranks")))


def sink_ranked_text_q(spark, folder):
    """Lines written in order and read back with the place each has over all files."""
    path = _scratch(spark)
    write_ranked_text(_ranked(spark, folder), path)
    back = spark.read.text(path).select(F.col("value").alias("line"), F.regexp_extract(F.input_file_name(), "part-(\\d+)", 1).cast("int").alias("part"), F.monotonically_increasing_id().alias("at"), F.regexp_extract("value", "^(\\d+) ", 1).cast("bigint").alias("src_row"))
    order = back.groupBy("part").agg(F.min("src_row").alias("least"), F.max("src_row").alias("greatest"), F.count("*").alias("n"))
    return order.agg(F.sum("n").alias("lines"), F.count_if(F.col("least") > F.col("greatest")).alias("disordered"))


def sink_zip_q(spark, folder):
    """The ranked lines as an archive: its member, and its lines read back."""
    path, target = _scratch(spark), io.BytesIO()
    write_ranked_text(_ranked(spark, folder), path)
    zip_text(spark, path, target, "predictions.txt")
    with zipfile.ZipFile(target) as z:
        rows = [(n, sum(1 for _ in z.open(n))) for n in z.namelist()]
    return spark.createDataFrame(rows, "member string, lines bigint")


def raw_fingerprint_q(spark, folder):
    """Two fingerprints of the same files are equal, one of other files is not."""
    a, b, c = (raw_fingerprint(spark, folder, p) for p in ("a*.parquet", "a*.parquet", "b*.parquet"))
    return spark.createDataFrame([(a == b, a == c)], "same boolean, other boolean")


def sink_checks_q(spark, folder):
    """The checks on lines that are spoilt on purpose: some left out, some twice, some too short, some under ids nobody expects."""
    got, n = _ranked(spark, folder).select("src_row", "candidates", "ranks"), F.col("src_row")
    short = F.slice("ranks", F.lit(1), F.size("ranks") - 1)
    spoilt = got.where(n % 7 != 0).withColumn("ranks", F.when(n % 13 == 1, short).otherwise(F.col("ranks")))
    lines = spoilt.unionByName(spoilt.where(n % 11 == 2)).unionByName(got.where(n % 17 == 3).withColumn("src_row", -n - 1))
    return checked(lines, impressions(spark, folder, "size(candidates) > 0"), "src_row", "ranks", F.size("candidates"))


def codec_sweep_q(spark, folder):
    """Bytes of the article texts under several codecs."""
    every, root = [], _scratch(spark)
    for codec in ("none", "snappy", "gzip", "zstd"):
        articles(spark, folder).select("idx", "title", "abstract", "body").write.option("compression", codec).parquet(f"{root}/{codec}")
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{root}/{codec}")
        every.append((codec, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()))
    return spark.createDataFrame(every, "codec string, bytes bigint")


def stage_cache_q(spark, folder):
    """The same stage three times: built, reused, and built again under another fingerprint."""
    stages = Stages(spark, _scratch(spark))
    mark = raw_fingerprint(spark, folder, "articles.parquet")
    for fingerprint in (mark, mark, "0" * 64):
        stages.stage("articles", fingerprint, lambda: articles(spark, folder).select("idx"))
    return spark.createDataFrame([(i, m["reused"], m["rows"]) for i, m in enumerate(stages.metrics)], "run int, reused boolean, rows bigint")


def stage_metrics_q(spark, folder):
    """What is noted of two stages and of one reused: rows, and that time and memory were measured."""
    stages = Stages(spark, _scratch(spark))
    for name, key in (("articles", "idx"), ("impressions", "src_row"), ("articles", "idx")):
        stages.stage(name, "1" * 64, lambda: table(spark, folder, name).select(key).distinct())
    return spark.createDataFrame([(i, m["stage"], m["reused"], m["rows"], m["seconds"] >= 0 and m["python_mb"] > 0 and m["heap_mb"] > 0) for i, m in enumerate(stages.metrics)], "run int, stage string, reused boolean, rows bigint, measured boolean")


CONFIG = json.dumps({"dataset": "clicks", "halflife_hours": 12.0, "splits": [{"name": n, "time_from": a, "time_to": b} for n, a, b in (("train", "2024-01-01", "2024-10-01"), ("val", "2024-10-01", "2024-10-08"), ("test", "2024-10-08", "2025-01-01"))]})


def scan_config_q(spark, folder):
    """Impressions of each split of a configuration read from JSON."""
    config, t = Config.load(CONFIG), F.col("time")
    name = F.coalesce(*(F.when((t >= F.lit(s.time_from).cast("timestamp_ntz")) & (t < F.lit(s.time_to).cast("timestamp_ntz")), s.name) for s in config.splits))
    return impressions(spark, folder, "time is not null").groupBy(name.alias("split")).agg(F.count("*").alias("n"))


def segments_q(spark, folder):
    """Daily segments appended, then compacted: the same rows in fewer files."""
    root = _scratch(spark)
    rows = cut(impressions(spark, folder, "time is not null").select("src_row", F.date_format("time", "yyyy-MM").alias("month")), "months")
    for m in [r[0] for r in rows.select("month").distinct().collect()]:
        append_segment(rows.where(F.col("month") == m), f"{root}/in", m)
    whole = compact(spark, f"{root}/in", f"{root}/out", 2)
    return whole.groupBy("month").agg(F.count("*").alias("n"), F.max("src_row").alias("last"))


QUERIES = {
    "scan_parquet": scan_parquet_q, "scan_tsv": scan_tsv_q, "scan_npy": scan_npy_q, "row_index": row_index_q, "sink_parquet": sink_parquet_q, "sink_ranked_text": sink_ranked_text_q, "sink_checks": sink_checks_q, "sink_zip": sink_zip_q, "raw_fingerprint": raw_fingerprint_q, "codec_sweep": codec_sweep_q,
    "stage_cache": stage_cache_q, "stage_metrics": stage_metrics_q, "scan_config": scan_config_q, "segments": segments_q,
}

ORACLES = {
    "scan_parquet": "SELECT idx, src_id, lang FROM articles WHERE lang = 'en'",
    "scan_tsv": f"WITH {ARTICLES} SELECT src_id AS news_id, topic AS category, nullif(regexp_replace(title, '[\\t\\r\\n]+', ' ', 'g'), '') AS title, nullif(regexp_replace(abstract, '[\\t\\r\\n]+', ' ', 'g'), '') AS abstract FROM art",
    "scan_npy": "SELECT vec_id AS id, CAST(len(embedding) AS INT) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings",
    "row_index": "SELECT row_number() OVER () - 1 AS row, click_id, user_idx FROM clickstream",
    "sink_parquet": f"WITH {ARTICLES} SELECT idx, title FROM art",
    "sink_ranked_text": f"WITH {IMP} SELECT count(*) AS lines, CAST(0 AS BIGINT) AS disordered FROM imp WHERE len(candidates) > 0",
    "sink_zip": f"WITH {IMP} SELECT 'predictions.txt' AS member, count(*) AS lines FROM imp WHERE len(candidates) > 0",
    "raw_fingerprint": "SELECT true AS same, false AS other",
    "sink_checks": f"WITH {IMP}, n AS (SELECT src_row AS s FROM imp WHERE len(candidates) > 0) SELECT count(*) FILTER (s % 7 = 0) AS missing, count(*) FILTER (s % 17 = 3) AS unexpected, count(*) FILTER (s % 7 <> 0 AND s % 11 = 2) AS twice, count(*) FILTER (s % 7 <> 0 AND s % 13 = 1) AS wrong_size FROM n",
    "stage_cache": "SELECT CAST(run AS INT) AS run, run = 1 AS reused, (SELECT count(DISTINCT idx) FROM articles) AS rows FROM range(3) t(run)",
    "stage_metrics": "SELECT CAST(run AS INT) AS run, CASE WHEN run = 1 THEN 'impressions' ELSE 'articles' END AS stage, run = 2 AS reused, CASE WHEN run = 1 THEN (SELECT count(*) FROM (SELECT DISTINCT src_row FROM impressions)) ELSE (SELECT count(*) FROM (SELECT DISTINCT idx FROM articles)) END AS rows, true AS measured FROM range(3) t(run)",
    "scan_config": f"WITH {IMP} SELECT CASE WHEN time < '2024-01-01' THEN NULL WHEN time < '2024-10-01' THEN 'train' WHEN time < '2024-10-08' THEN 'val' WHEN time < '2025-01-01' THEN 'test' END AS split, count(*) AS n FROM imp WHERE time IS NOT NULL GROUP BY 1",
    "segments": f"WITH {IMP} SELECT strftime(time, '%Y-%m') AS month, count(*) AS n, max(src_row) AS last FROM imp WHERE time IS NOT NULL GROUP BY 1",
}
