"""Dense ids, list columns, and scalar expressions of the click log."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clicklake.plans.cut import cut
from clicklake.sources.logs import ARTICLES, IMP, PAIRS, VAL_FROM, TEST_FROM, articles, at, impressions, pair_table
from clicklake.sources.tables import table


def dense_ids(df: DataFrame, key: str) -> DataFrame:
    """(key, id): the distinct non-null values as strings, sorted and numbered from 0.

    Values are range-partitioned and each partition numbers its own, shifted by the sizes of those before it: only one row
    a partition meets in one task. The partitioned table is written once, so both passes see the same bounds.
    """
    values = df.select(F.col(key).cast("string").alias("key")).where("key is not null").distinct()
    ranged = cut(values.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "ids")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    shift = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    inside = F.row_number().over(W.partitionBy("part").orderBy("key")) - 1
    return ranged.withColumn("inside", inside).join(shift, "part").select("key", (F.col("inside") + F.col("shift")).alias("id"))


def remap_list(df: DataFrame, row_id: str, values: str, ids: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(row_id, mapped): list elements replaced by the ids of `ids` (key, id), order kept, unknown and null ones dropped.

    Rows of null or empty lists, or of unknown elements only, keep an empty list. A dictionary of at most `most` keys, which
    is counted first, goes to every task and lists are mapped where they lie. A larger one is joined by
    element; a hot element is split by adaptive execution, and the lists are gathered again by row id.
    """
    rows = df.select(F.col(row_id).alias("row"), F.col(values).alias("list"))
    kind = dict(df.select(F.col(values).alias("list")).dtypes)["list"]
    ids = cut(ids.where("key is not null").select(F.col("key").cast(kind.removeprefix("array<").removesuffix(">")).alias("key"), F.col("id").cast("bigint").alias("id")), "dictionary")
    if ids.count() <= most:
        known = ids.orderBy("key").toArrow().combine_chunks()
        return rows.mapInArrow(_remapped(known["key"], known["id"].to_numpy(), row_id), f"{row_id} {dict(rows.dtypes)['row']}, mapped array<bigint>")
    opened = rows.select("row", F.posexplode("list").alias("pos", "key"))
    found = opened.join(ids, "key").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("mapped"))
    return rows.select("row").join(found, "row", "left").select(F.col("row").alias(row_id), F.coalesce("mapped", F.array().cast("array<bigint>")).alias("mapped"))


def _remapped(keys: pa.ChunkedArray, to: np.ndarray, row_id: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            at = pc.index_in(lists.flatten(), value_set=keys, skip_nulls=True)
            keep = at.is_valid().to_numpy(zero_copy_only=False)
            kept = np.concatenate([[0], np.cumsum(keep)])
            offsets = kept[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            found = pc.drop_null(at).to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(to[found] if len(to) else np.zeros(0, np.int64)))], [row_id, "mapped"])

    return run


def list_rank(scores: Column) -> Column:
    """Rank of each element of a list, 1 for the highest; equal scores rank by position. Two sorts: by score, and back by position."""
    order = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("i"))))
    return F.transform(F.array_sort(F.transform(order, lambda x, r: F.struct(x["i"].alias("i"), (r + 1).cast("int").alias("r")))), lambda x: x["r"])


def list_lookup(df: DataFrame, row_id: str, values: str, scores: DataFrame, default: float = 0.0) -> DataFrame:
    """(row_id, scores): the score of each list element from `scores` (key, score), the default where there is none."""
    opened = df.select(F.col(row_id).alias("row"), F.posexplode(values).alias("pos", "key"))
    met = opened.join(scores, "key", "left").withColumn("score", F.coalesce("score", F.lit(default)))
    return met.groupBy(F.col("row").alias(row_id)).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "score"))), lambda x: x["score"]).alias("scores"))


def ranked_line(row_id: Column, ranks: Column) -> Column:
    """`<id> [r1,r2,...]`."""
    return F.concat(row_id.cast("string"), F.lit(" ["), F.array_join(ranks.cast("array<string>"), ","), F.lit("]"))


def uniform(a: Column, b: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on two integers and the seed alone: 53 bits of a 64-bit finaliser, in Arrow batches.

    Wrapping 64-bit products aren't SQL arithmetic, so this runs on NumPy.
    """

    @F.pandas_udf("double")
    def draw(x: pd.Series, y: pd.Series) -> pd.Series:
        u = np.uint64
        with np.errstate(over="ignore"):
            z = x.to_numpy(np.int64).view(u) * u(0x9E3779B97F4A7C15) + y.to_numpy(np.int64).view(u) * u(0xC2B2AE3D27D4EB4F) + u(seed)
            z = (z ^ (z >> u(30))) * u(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> u(27))) * u(0x94D049BB133111EB)
        return pd.Series((z ^ (z >> u(31))) >> u(11)) / 2.0**53

    return draw(a.cast("bigint"), b.cast("bigint"))


#: The same draw in DuckDB for the oracles; {a}, {b}, {seed} are filled in.
UNIFORM_SQL = """(SELECT CAST(xor(z2, z2 >> 31) >> 11 AS DOUBLE) / 9007199254740992.0 FROM (SELECT CAST((CAST(xor(z1, z1 >> 27) AS UHUGEINT) * 10723151780598845931) % 18446744073709551616 AS UBIGINT) AS z2
 FROM (SELECT CAST((CAST(xor(z0, z0 >> 30) AS UHUGEINT) * 13787848793156543929) % 18446744073709551616 AS UBIGINT) AS z1
 FROM (SELECT CAST((CAST({a} AS UHUGEINT) * 11400714819323198485 + CAST({b} AS UHUGEINT) * 14029467366897019727 + {seed}) % 18446744073709551616 AS UBIGINT) AS z0))))"""


def zscore_within(df: DataFrame, group: str, value: str) -> Column:
    """(x - mean) / sample deviation over the group; 0 where the value is null, deviation 1 where there is none."""
    w = W.partitionBy(group)
    sd = F.coalesce(F.nullif(F.stddev_samp(value).over(w), F.lit(0.0)), F.lit(1.0))
    return F.coalesce((F.col(value) - F.avg(value).over(w)) / sd, F.lit(0.0))


# queries


def id_map(spark: SparkSession, folder: str) -> DataFrame:
    ids = dense_ids(table(spark, folder, "articles"), "src_id")
    return ids.select(F.col("key").alias("src_id"), F.col("id").cast("bigint").alias("idx"))


def _article_ids(spark: SparkSession, folder: str) -> DataFrame:
    return dense_ids(table(spark, folder, "articles").select("idx"), "idx").select(F.col("key").cast("bigint").alias("key"), F.col("id").cast("bigint").alias("id"))


def remap_list_q(spark: SparkSession, folder: str) -> DataFrame:
    return remap_list(impressions(spark, folder), "src_row", "candidates", _article_ids(spark, folder)).select("src_row", F.array_join(F.col("mapped").cast("array<string>"), ",").alias("mapped"))


def union_dedup(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "articles").select("idx", "src_id", F.col("total_pageviews").cast("double").alias("views"), F.lit(0).alias("source"))
    b = table(spark, folder, "articles").select("idx", "src_id", F.col("total_pageviews").alias("views"), F.lit(1).alias("source"))
    first = F.row_number().over(W.partitionBy("idx").orderBy("source", F.col("views").desc_nulls_last(), "src_id"))
    return a.unionByName(b.withColumn("views", F.col("views").cast("double"))).withColumn("n", first).where("n = 1").select("idx", "src_id", "views", "source")


def explode_with_pos(spark: SparkSession, folder: str) -> DataFrame:
    return pair_table(impressions(spark, folder)).select("imp", "position", "article_idx", "label", F.round("position_frac", 9).alias("position_frac"))


def explode_two(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "user_history").dropDuplicates(["user_idx"]).where("size(article_idx) = size(ts)")
    return rows.select("user_idx", F.inline(F.arrays_zip("article_idx", "ts")))


def list_setops(spark: SparkSession, folder: str) -> DataFrame:
    c, k = F.col("candidates"), F.coalesce("clicked", F.array().cast("array<bigint>"))
    text = lambda x: F.array_join(F.array_sort(x).cast("array<string>"), ",")
    return impressions(spark, folder, "candidates is not null").select(
        "src_row", text(F.array_intersect(c, k)).alias("shown_clicked"), text(F.array_except(c, k)).alias("passed"), F.array_join(F.slice(F.concat(c, k), 1, 3).cast("array<string>"), ",").alias("head"),
        F.size(c).alias("n"), F.array_max(c).alias("greatest"), F.size(F.array_distinct(F.array_compact(c))).alias("n_distinct"), F.coalesce(F.array_contains(k, F.get(c, F.lit(0))), F.lit(False)).alias("first_clicked"))


def _list_scores(spark: SparkSession, folder: str) -> DataFrame:
    """A score with many ties for each candidate: its id modulo 7."""
    return impressions(spark, folder, "size(candidates) > 0").select("src_row", F.transform("candidates", lambda x: (x % 7).cast("double")).alias("scores"))


def list_rank_q(spark: SparkSession, folder: str) -> DataFrame:
    return _list_scores(spark, folder).select("src_row", F.array_join(list_rank(F.col("scores")).cast("array<string>"), ",").alias("ranks"))


def list_lookup_q(spark: SparkSession, folder: str) -> DataFrame:
    views = articles(spark, folder).select(F.col("idx").alias("key"), F.col("total_pageviews").cast("double").alias("score"))
    return list_lookup(impressions(spark, folder), "src_row", "candidates", views, -1.0).select("src_row", F.array_join(F.transform("scores", lambda x: x.cast("bigint").cast("string")), ",").alias("scores"))


def format_line(spark: SparkSession, folder: str) -> DataFrame:
    return _list_scores(spark, folder).select(ranked_line(F.col("src_row"), list_rank(F.col("scores"))).alias("line"))


def list_prefix_suffix(spark: SparkSession, folder: str) -> DataFrame:
    a = F.col("article_idx")
    rows = table(spark, folder, "user_history").dropDuplicates(["user_idx"]).where("size(article_idx) > 0")
    old, new = F.slice(a, 1, F.greatest(F.size(a) - 2, F.lit(1))), a
    n = F.size(old)
    return rows.select("user_idx", (F.slice(new, 1, n) == old).alias("is_prefix"), (F.slice(new, -n, n) == old).alias("is_suffix"), (F.array_sort("ts") == F.col("ts")).alias("ascending"))


def text_concat(spark: SparkSession, folder: str) -> DataFrame:
    return articles(spark, folder).select("idx", F.concat_ws(" ", "title", "abstract").alias("text"), (F.length(F.trim(F.coalesce("abstract", F.lit("")))) > 0).alias("has_abstract"))


def time_window(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("time")
    return impressions(spark, folder, (t >= at(VAL_FROM)) & (t < at(TEST_FROM))).select("src_row", "impression_id", "user_idx", "time")


def stable_uniform(spark: SparkSession, folder: str) -> DataFrame:
    rows = impressions(spark, folder, "user_idx is not null").select("user_idx", F.explode("candidates").alias("article_idx")).where("article_idx is not null").distinct()
    return rows.select("user_idx", "article_idx", uniform(F.col("user_idx"), F.col("article_idx"), 7).alias("u"))


def zscore_q(spark: SparkSession, folder: str) -> DataFrame:
    rows = pair_table(impressions(spark, folder)).withColumn("x", (F.col("article_idx") % 13).cast("double"))
    return rows.select("imp", "position", F.round(zscore_within(rows, "imp", "x"), 6).alias("z"))


def subsample_groups(spark: SparkSession, folder: str) -> DataFrame:
    imp = impressions(spark, folder)
    kept = imp.where(uniform(F.col("src_row"), F.lit(0), 11) < 0.25).select(F.col("src_row").alias("imp"))
    return pair_table(imp).join(kept, "imp", "left_semi").select("imp", "position", "article_idx")


def digest(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


def scalar_math(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("l_quantity")
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.round(F.sum(F.pow(F.lit(0.5), x / 10)), 6).alias("half"), F.round(F.sum(F.ln(x)), 6).alias("ln"), F.round(F.sum(F.log2(x)), 6).alias("log2"), F.round(F.sum(F.sqrt(x)), 6).alias("root"),
        F.round(F.sum(F.abs(F.lit(25) - x)), 6).alias("far"), F.max(F.greatest(x, F.col("l_discount"))).alias("top"), F.round(F.coalesce(F.try_divide(F.sum("l_tax"), F.sum("l_discount")), F.lit(0.0)), 6).alias("ratio"))


def scalar_string(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("title")
    return articles(spark, folder).where("title is not null").select(
        "idx", F.lower(t).alias("lower"), F.regexp_replace(t, "[0-9]+", "#").alias("digits"), F.size(F.split(t, " ")).alias("words"), F.substring(t, 1, 5).alias("head"), t.endswith("et").alias("ends"),
        t.rlike("[0-9]").alias("has_digit"), F.char_length(t).alias("chars"), F.trim(t).alias("trimmed"))


def scalar_date(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("time")
    rows = impressions(spark, folder, "time is not null")
    return rows.groupBy(F.to_date(t).alias("d")).agg(F.count("*").alias("n"), F.min(t).alias("first"), F.max(t).alias("last"), F.sum(F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), t)).alias("epochs")).select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n", "first", "last", "epochs")


def json_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Labels out of two JSON columns of {"Label": ...} lists, written here from the entity lists and decoded again."""
    kind = "array<struct<Label:string,WikidataId:string>>"
    as_json = F.to_json(F.transform("entities", lambda x: F.struct(x.alias("Label"), F.lit("Q1").alias("WikidataId"))))
    rows = articles(spark, folder).select("idx", as_json.alias("title_entities"), F.when(F.col("premium"), as_json).alias("abstract_entities"))
    labels = lambda c: F.coalesce(F.transform(F.from_json(c, kind), lambda x: x["Label"]), F.array().cast("array<string>"))
    return rows.select("idx", F.array_join(F.array_distinct(F.concat(labels("title_entities"), labels("abstract_entities"))), "|").alias("entities"))


def split_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The spelling `N1-1 N2-0` of shown and clicked candidates, written and taken apart again."""
    imp = impressions(spark, folder, "size(candidates) > 0 and clicked is not null")
    rows = imp.select("src_row", F.array_join(F.transform("candidates", lambda x: F.concat(F.lit("N"), x.cast("string"), F.when(F.array_contains("clicked", x), "-1").otherwise("-0"))), " ").alias("line"))
    items = F.split("line", " ")
    return rows.select("src_row", F.array_join(F.transform(items, lambda x: F.substring(x, F.lit(1), F.length(x) - 2)), " ").alias("candidates"), F.array_join(F.transform(F.filter(items, lambda x: x.endswith("-1")), lambda x: F.substring(x, F.lit(1), F.length(x) - 2)), " ").alias("clicked"))


def parse_datetime(spark: SparkSession, folder: str) -> DataFrame:
    """US 12-hour times: written from the log's and read again."""
    text = F.date_format("time", "M/d/yyyy h:mm:ss a")
    return impressions(spark, folder, "time is not null").select("src_row", F.to_timestamp_ntz(text, F.lit("M/d/yyyy h:mm:ss a")).alias("time"))


QUERIES = {
    "id_map": id_map, "remap_list": remap_list_q, "union_dedup": union_dedup, "explode_with_pos": explode_with_pos, "explode_two": explode_two, "list_setops": list_setops, "list_rank": list_rank_q, "list_lookup": list_lookup_q,
    "format_line": format_line, "list_prefix_suffix": list_prefix_suffix, "text_concat": text_concat, "time_window": time_window, "stable_uniform": stable_uniform, "zscore_within": zscore_q, "subsample_groups": subsample_groups,
    "digest": digest, "scalar_math": scalar_math, "scalar_string": scalar_string, "scalar_date": scalar_date, "json_entities": json_entities, "split_candidates": split_candidates, "parse_datetime": parse_datetime,
}

_RANKS = f"""WITH {IMP}, o AS (SELECT src_row, unnest(candidates) % 7 AS s, unnest(range(len(candidates))) AS pos FROM imp),
r AS (SELECT *, row_number() OVER (PARTITION BY src_row ORDER BY s DESC, pos) AS rank FROM o),
l AS (SELECT src_row, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos) AS ranks FROM r GROUP BY 1) """

ORACLES = {
    "id_map": "SELECT src_id, row_number() OVER (ORDER BY src_id COLLATE \"C\") - 1 AS idx FROM (SELECT DISTINCT src_id FROM articles WHERE src_id IS NOT NULL)".replace(' COLLATE "C"', ""),
    "remap_list": f"""WITH {IMP}, m AS (SELECT idx, row_number() OVER (ORDER BY CAST(idx AS VARCHAR)) - 1 AS id FROM (SELECT DISTINCT idx FROM articles WHERE idx IS NOT NULL)),
        o AS (SELECT src_row, unnest(candidates) AS c, unnest(range(len(candidates))) AS pos FROM imp),
        g AS (SELECT src_row, string_agg(CAST(id AS VARCHAR), ',' ORDER BY pos) AS mapped FROM o JOIN m ON m.idx = o.c GROUP BY 1)
        SELECT imp.src_row, coalesce(mapped, '') AS mapped FROM imp LEFT JOIN g ON g.src_row = imp.src_row""",
    "union_dedup": "SELECT idx, src_id, CAST(total_pageviews AS DOUBLE) AS views, 0 AS source FROM articles QUALIFY row_number() OVER (PARTITION BY idx ORDER BY total_pageviews DESC NULLS LAST, src_id) = 1",
    "explode_with_pos": f"WITH {PAIRS} SELECT imp, CAST(position AS INT) AS position, article_idx, label, round(position / greatest(n_candidates - 1, 1), 9) AS position_frac FROM pairs",
    "explode_two": "WITH h AS (SELECT DISTINCT ON (user_idx) * FROM user_history) SELECT user_idx, unnest(article_idx) AS article_idx, unnest(ts) AS ts FROM h WHERE len(article_idx) = len(ts)",
    "list_setops": f"""WITH {IMP}, b AS (SELECT src_row, candidates AS c, coalesce(clicked, []) AS k FROM imp WHERE candidates IS NOT NULL)
        SELECT src_row, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: list_contains(k, x)))), ',') AS shown_clicked, array_to_string(list_sort(list_distinct(list_filter(c, lambda x: NOT list_contains(k, x)))), ',') AS passed,
        array_to_string(list_concat(c, k)[1:3], ',') AS head, CAST(len(c) AS INT) AS n, list_max(c) AS greatest, CAST(len(list_distinct(c)) AS INT) AS n_distinct, coalesce(list_contains(k, c[1]), false) AS first_clicked FROM b""",
    "list_rank": _RANKS + "SELECT src_row, ranks FROM l",
    "list_lookup": f"""WITH {IMP}, {ARTICLES}, o AS (SELECT src_row, unnest(candidates) AS c, unnest(range(len(candidates))) AS pos FROM imp)
        SELECT src_row, string_agg(CAST(coalesce(total_pageviews, -1) AS VARCHAR), ',' ORDER BY pos) AS scores FROM o LEFT JOIN art ON art.idx = o.c GROUP BY 1""",
    "format_line": _RANKS + "SELECT concat(src_row, ' [', ranks, ']') AS line FROM l",
    "list_prefix_suffix": """WITH h AS (SELECT DISTINCT ON (user_idx) user_idx, article_idx AS a, ts, greatest(len(article_idx) - 2, 1) AS n FROM user_history WHERE len(article_idx) > 0)
        SELECT user_idx, a[1:n] = a[1:n] AS is_prefix, a[len(a) - n + 1:] = a[1:n] AS is_suffix, list_sort(ts) = ts AS ascending FROM h""",
    "text_concat": f"WITH {ARTICLES} SELECT idx, concat_ws(' ', title, abstract) AS text, length(trim(coalesce(abstract, ''))) > 0 AS has_abstract FROM art",
    "time_window": f"WITH {IMP} SELECT src_row, impression_id, user_idx, time FROM imp WHERE time >= TIMESTAMP '{VAL_FROM}' AND time < TIMESTAMP '{TEST_FROM}'",
    "stable_uniform": f"WITH {IMP}, p AS (SELECT DISTINCT user_idx, article_idx FROM (SELECT user_idx, unnest(candidates) AS article_idx FROM imp) WHERE user_idx IS NOT NULL AND article_idx IS NOT NULL) SELECT user_idx, article_idx, "
    + UNIFORM_SQL.format(a="user_idx", b="article_idx", seed=7) + " AS u FROM p",
    "zscore_within": f"""WITH {PAIRS}, x AS (SELECT *, CAST(article_idx % 13 AS DOUBLE) AS x FROM pairs), z AS (SELECT *, avg(x) OVER w AS m, stddev_samp(x) OVER w AS sd FROM x WINDOW w AS (PARTITION BY imp))
        SELECT imp, CAST(position AS INT) AS position, round(coalesce((x - m) / coalesce(nullif(sd, 0), 1), 0), 6) AS z FROM z""",
    "subsample_groups": f"WITH {PAIRS} SELECT imp, CAST(position AS INT) AS position, article_idx FROM pairs WHERE " + UNIFORM_SQL.format(a="imp", b="0", seed=11) + " < 0.25",
    "digest": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "scalar_math": """SELECT l_orderkey, round(sum(pow(0.5, l_quantity / 10)), 6) AS half, round(sum(ln(l_quantity)), 6) AS ln, round(sum(log2(l_quantity)), 6) AS log2, round(sum(sqrt(l_quantity)), 6) AS root,
        round(sum(abs(25 - l_quantity)), 6) AS far, max(greatest(l_quantity, l_discount)) AS top, round(coalesce(sum(l_tax) / nullif(sum(l_discount), 0), 0), 6) AS ratio FROM lineitem GROUP BY 1""",
    "scalar_string": f"""WITH {ARTICLES} SELECT idx, lower(title) AS lower, regexp_replace(title, '[0-9]+', '#', 'g') AS digits, CAST(len(string_split(title, ' ')) AS INT) AS words, substring(title, 1, 5) AS head, ends_with(title, 'et') AS ends,
        regexp_matches(title, '[0-9]') AS has_digit, CAST(length(title) AS INT) AS chars, trim(title) AS trimmed FROM art WHERE title IS NOT NULL""",
    "scalar_date": f"WITH {IMP} SELECT strftime(time, '%Y-%m-%d') AS day, count(*) AS n, min(time) AS first, max(time) AS last, CAST(sum(CAST(epoch(date_trunc('second', time)) AS BIGINT)) AS BIGINT) AS epochs FROM imp WHERE time IS NOT NULL GROUP BY 1",
    "json_entities": f"WITH {ARTICLES}, o AS (SELECT idx, unnest(entities) AS e, unnest(range(len(entities))) AS i FROM art), d AS (SELECT idx, e, min(i) AS i FROM o GROUP BY 1, 2), g AS (SELECT idx, string_agg(e, '|' ORDER BY i) AS entities FROM d GROUP BY 1) SELECT art.idx, coalesce(g.entities, '') AS entities FROM art LEFT JOIN g USING (idx)",
    "split_candidates": f"""WITH {IMP} SELECT src_row, array_to_string(list_transform(candidates, lambda x: concat('N', x)), ' ') AS candidates,
        array_to_string(list_transform(list_filter(candidates, lambda x: list_contains(clicked, x)), lambda x: concat('N', x)), ' ') AS clicked FROM imp WHERE len(candidates) > 0 AND clicked IS NOT NULL""",
    "parse_datetime": f"WITH {IMP} SELECT src_row, date_trunc('second', time) AS time FROM imp WHERE time IS NOT NULL",
}
