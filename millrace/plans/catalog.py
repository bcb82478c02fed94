"""The registered queries of the library's own operators, each with the same in DuckDB's SQL."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import coalesce, col, if_else, lit
from millrace.operators import align, episodes, media, offsets, relational, stats
from millrace.plans.dataset import Dataset
from millrace.plans.row import Row
from millrace.shared import scratch
from millrace.sources import filter_html, from_items, mcap, read_blob, read_commoncrawl, read_commoncrawl_from_index, read_csv, read_files, read_json, read_jsonl, read_lerobot, read_mcap, read_parquet, read_tfrecords, read_videos, read_zarr, task

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet", file_path_column=None)


# --- README shape -------------------------------------------------------------------------


@query("SELECT doc_id, trim(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)) AS text, length(trim(text, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)))::INTEGER AS text_len FROM documents WHERE lang = 'en'")
def clean_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(col("lang") == "en")
    return docs.with_columns(text=col("text").str.strip(), text_len=col("text").str.len()).select("doc_id", "text", "text_len").df


# --- structure ----------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag = 'R'")
def scan_project_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = col("l_quantity").between(10, 20) & (col("l_returnflag") == "R")
    return read_parquet(spark, f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_quantity"], filter=where, file_path_column=None).df


@query("SELECT o_orderkey AS order_id, o_custkey::INTEGER AS o_custkey, o_orderstatus, o_orderpriority FROM orders")
def drop_rename_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").drop("o_totalprice", "o_orderdate").rename(o_orderkey="order_id", absent="x").cast(o_custkey="int32").df


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS a, l_quantity * 2 + 1 AS b, 7::BIGINT AS c, (l_quantity * 2 + 1) * 7 AS d FROM lineitem")
def with_columns_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return d.with_columns(a=col("l_quantity") * 2, b=col("a") + 1, c=7, d=col("b") * col("c")).drop("l_quantity").df


# --- expressions --------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, x // 7 AS q, (x // 7)::DOUBLE AS fd, (x % 7)::DOUBLE AS m, x + 1 AS s, x * 3 AS p, abs(x) AS a
FROM (SELECT l_orderkey, l_linenumber, l_partkey - 1000 AS x FROM lineitem)""")
def expr_arith_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").with_columns(x=col("l_partkey") - 1000)
    return x.with_columns(q=col("x") / 7, fd=col("x") // 7, m=col("x") % 7, s=col("x") + 1, p=col("x") * 3, a=col("x").abs()).select("l_orderkey", "l_linenumber", "q", "fd", "m", "s", "p", "a").df


@query("""SELECT c_custkey, c_acctbal / 7.5 AS q, floor(c_acctbal / 7.5) AS fd, c_acctbal - floor(c_acctbal / 7.5) * 7.5::DOUBLE AS m, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, abs(c_acctbal) AS a,
CASE WHEN c_acctbal = 0 THEN 'NaN'::DOUBLE WHEN c_acctbal > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END AS z FROM customer""")
def expr_arith_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = col("c_acctbal")
    return table(spark, sf_dir, "customer").with_columns(q=b / 7.5, fd=b // 7.5, m=b % 7.5, f=b.floor(), c=b.ceil(), a=b.abs(), z=b / 0.0).select("c_custkey", "q", "fd", "m", "f", "c", "a", "z").df


@query("SELECT p_partkey, round_even(p_retailprice, 0) AS r0, round_even(p_retailprice, 1) AS r1, round_even(p_size + 0.5::DOUBLE, 0) AS half FROM part")
def expr_round_half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.with_columns(r0=col("p_retailprice").round(), r1=col("p_retailprice").round(1), half=(col("p_size") + 0.5).round()).select("p_partkey", "r0", "r1", "half").df


@query("SELECT event_id, least(greatest(value, 10), 50) AS both, greatest(value, 10) AS low, least(value, 50) AS high FROM events")
def expr_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = col("value")
    return table(spark, sf_dir, "events").with_columns(both=v.clip(10.0, 50.0), low=v.clip(min=10.0), high=v.clip(max=50.0)).select("event_id", "both", "low", "high").df


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE event_type END AS t, event_type = 'click' AS gone,
coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE event_type END, 'none') AS filled, coalesce(CASE WHEN event_type = 'click' THEN NULL ELSE event_type END, 'x', 'y') AS first FROM events""")
def expr_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").with_columns(t=col("event_type").null_if("click"))
    return e.with_columns(gone=col("t").is_null(), filled=col("t").fill_null("none"), first=coalesce(col("t"), "x", "y")).select("event_id", "t", "gone", "filled", "first").df


@query("SELECT n_nationkey, n_regionkey IN (1, 3) AS hit, coalesce(nullif(n_regionkey, 2) IN (1, 3), false) AS hit_null FROM nation")
def expr_is_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").with_columns(hit=col("n_regionkey").is_in([1, 3]), hit_null=col("n_regionkey").null_if(2).is_in([1, 3])).select("n_nationkey", "hit", "hit_null").df


@query("SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'part', 'small']) AS hit FROM part")
def expr_is_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").transform(lambda df: df.withColumn("words", F.split("p_name", " ")))
    return p.with_columns(hit=col("words").is_in(["red", "part", "small"])).select("p_partkey", "hit").df


@query("SELECT event_id, CASE WHEN c IS NULL THEN NULL WHEN c THEN 1 ELSE 0 END::BIGINT AS v FROM (SELECT event_id, nullif(event_type, 'view') = 'click' AS c FROM events)")
def expr_if_else_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").with_columns(v=if_else(col("event_type").null_if("view") == "click", 1, 0)).select("event_id", "v").df


@query("SELECT event_id, a AND b AS both, a OR b AS some, NOT a AS no FROM (SELECT event_id, nullif(event_type, 'view') = 'click' AS a, value > 50 AS b FROM events)")
def expr_kleene(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").with_columns(a=col("event_type").null_if("view") == "click", b=col("value") > 50)
    return e.with_columns(both=col("a") & col("b"), some=col("a") | col("b"), no=~col("a")).select("event_id", "both", "some", "no").df


@query("SELECT page_id, lower(url) AS low, upper(url) AS up, length(html)::INTEGER AS n FROM pages")
def str_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").with_columns(low=col("url").str.lower(), up=col("url").str.upper(), n=col("html").str.len()).select("page_id", "low", "up", "n").df


@query("SELECT doc_id, contains(text, 'the') AS c, starts_with(text, 'The') AS s, ends_with(text, '.') AS e, regexp_matches(text, '[0-9]{3}') AS r FROM documents")
def str_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = col("text").str
    return table(spark, sf_dir, "documents").with_columns(c=t.contains("the"), s=t.startswith("The"), e=t.endswith("."), r=t.regex_contains("[0-9]{3}")).select("doc_id", "c", "s", "e", "r").df


@query(r"SELECT page_id, replace(url, '/', '|') AS a, regexp_replace(url, '([a-z]+)://', '\1$:', 'g') AS b FROM pages")
def str_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = col("url").str
    return table(spark, sf_dir, "pages").with_columns(a=u.replace("/", "|"), b=u.regex_replace("([a-z]+)://", r"\1$:")).select("page_id", "a", "b").df


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS d, hour(ts) AS h, ts::DATE AS day FROM events")
def dt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = col("ts").datetime
    return table(spark, sf_dir, "events").with_columns(y=t.year(), m=t.month(), d=t.day(), h=t.hour(), day=t.to_date()).select("event_id", "y", "m", "d", "h", "day").df


# --- callbacks ----------------------------------------------------------------------------


@query("SELECT conv_id, turn, w AS word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations WHERE role = 'system') WHERE w <> ''")
def flat_map_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").filter(col("role") == "system").select("conv_id", "turn", "text")
    return d.flat_map(lambda r: [{"word": w} for w in r["text"].split(" ") if w], dtypes={"word": "string"}).drop("text").df


@query("SELECT conv_id, turn, w AS word FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS w FROM conversations) WHERE w <> ''")
def flat_map_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return d.flat_map(lambda r: [{"word": w} for w in (r["text"] or "").split(" ") if w], dtypes={"word": "string"}).drop("text").df


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey + 100::BIGINT AS y, length(n_name)::BIGINT AS k FROM nation")
def map_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").map(lambda r: {"y": r["n_nationkey"] + 100, "k": len(r["n_name"])}, dtypes={"y": "int64", "k": "int64"}).df


@query("SELECT s_suppkey, round(s_acctbal * 2, 6) AS twice FROM supplier")
def batch_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return d.batch_map(lambda rows: [r.update(twice=round(r["s_acctbal"] * 2, 6)) for r in rows], 16, dtypes={"twice": "float64"}).select("s_suppkey", "twice").df


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def map_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    import pyarrow.compute as pc

    d = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return d.map_table(lambda t: t.filter(pc.equal(pc.subtract(t["c_custkey"], pc.multiply(pc.divide(t["c_custkey"], 3), 3)), 0))).df


async def _upper(row: Row) -> dict:
    return {"up": row["r_name"].upper()}


@query("SELECT r_regionkey, r_name, upper(r_name) AS up FROM region")
def map_async_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").map_async(_upper, max_in_flight=3, dtypes={"up": "string"}).df


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND length(p_name) % 2 = 0")
def filter_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").filter(lambda r: r["p_size"] > 25 and len(r["p_name"]) % 2 == 0).select("p_partkey").df


@query("SELECT r::BIGINT AS rank, (r * r)::BIGINT AS square FROM range(6) t(r)")
def task_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task(spark, lambda rank, n: {"rank": rank, "square": rank * rank}, 6, dtypes={"rank": "int64", "square": "int64"}).df


# --- sources and sinks --------------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    table(spark, sf_dir, "nation").write_jsonl(out).launch_local("jsonl")
    return read_jsonl(spark, f"{out}/*.json", file_path_column=None).select("n_nationkey", "n_name", "n_regionkey").df


@query("SELECT r_regionkey, r_name FROM region")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    table(spark, sf_dir, "region").df.write.option("header", True).csv(out)
    return read_csv(spark, f"{out}/*.csv", file_path_column=None).df


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    table(spark, sf_dir, "supplier").write_parquet(out, compression="zstd").launch_local("parquet")
    return read_parquet(spark, out, file_path_column=None).df


@query("SELECT 'region.parquet' AS name, true AS filled")
def files_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_files(spark, f"{sf_dir}/region.parquet")
    return d.df.select(F.element_at(F.split("file_path", "/"), -1).alias("name"), (F.col("size") > 0).alias("filled"))


# --- alignment ----------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str, kind: str, value: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(col("event_type") == kind).df
    return e.select("user_id", "ts", F.col("value").alias(value), F.col("event_id"))


def _asof(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    p = _events(spark, sf_dir, "purchase", "paid").withColumnRenamed("event_id", "purchase_id")
    c = _events(spark, sf_dir, "click", "clicked")
    return align.asof(p, c, ["user_id"], "ts", ["clicked"], "event_id", method).select("purchase_id", "user_id", "clicked", "clicked_ts")


_BOTH = """p AS (SELECT user_id, ts, event_id AS purchase_id FROM events WHERE event_type = 'purchase'),
c AS (SELECT user_id, ts, value AS clicked, event_id FROM events WHERE event_type = 'click'),
l AS (SELECT p.*, c.ts AS lt, c.clicked AS lv FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts),
r AS (SELECT p.purchase_id, c.ts AS rt, c.clicked AS rv FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts <= c.ts),
b AS (SELECT l.*, rt, rv, epoch_us(ts) - epoch_us(lt) AS gl, epoch_us(rt) - epoch_us(ts) AS gr FROM l JOIN r USING (purchase_id)),
n AS (SELECT *, rt IS NULL OR (lt IS NOT NULL AND gl <= gr AND gr > 0) AS left_ FROM b)"""


@query(f"WITH {_BOTH} SELECT purchase_id, user_id, lv AS clicked, lt AS clicked_ts FROM l")
def asof_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "hold")


@query(f"WITH {_BOTH} SELECT purchase_id, user_id, CASE WHEN left_ THEN lv ELSE rv END AS clicked, CASE WHEN left_ THEN lt ELSE rt END AS clicked_ts FROM n")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "nearest")


@query(f"""WITH {_BOTH} SELECT purchase_id, user_id, round(CASE WHEN lt IS NOT NULL AND rt IS NOT NULL AND gr > 0 AND gl + gr > 0
THEN (1 - gl::DOUBLE / (gl + gr)) * lv + gl::DOUBLE / (gl + gr) * rv WHEN left_ THEN lv ELSE rv END, 6) AS clicked, CASE WHEN left_ THEN lt ELSE rt END AS clicked_ts FROM n""")
def asof_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asof(spark, sf_dir, "interpolate").withColumn("clicked", F.round("clicked", 6))


@query("""WITH e AS (SELECT user_id, date_trunc('day', ts) AS day, event_type, value, (row_number() OVER (PARTITION BY user_id, date_trunc('day', ts), event_type ORDER BY event_id) - 1)::BIGINT AS occurrence FROM events)
SELECT user_id, day, occurrence, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS "view" FROM e WHERE event_type IN ('click', 'view') GROUP BY ALL""")
def sparse_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").df.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return align.sparse_outer({k: e.filter(F.col("event_type") == k) for k in ("click", "view")}, ["user_id"], "day", "event_id", "value")


@query("""SELECT event_id, user_id, sum(CASE WHEN step > INTERVAL 8 HOURS THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session
FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)""")
def session_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.gap_sessions(table(spark, sf_dir, "events").df, ["user_id"], "ts", F.expr("INTERVAL 8 HOURS"), ["event_id"]).select("event_id", "user_id", "session")


@query("""SELECT event_id, user_id, greatest(n - 1, 0)::BIGINT AS session FROM (SELECT *, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS n,
max((event_type = 'signup')::INT) OVER (PARTITION BY user_id) AS any_marker FROM events) WHERE n > 0 OR any_marker = 0""")
def session_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.marker_sessions(table(spark, sf_dir, "events").df, ["user_id"], "ts", F.col("event_type") == "signup").select("event_id", "user_id", "session")


@query("SELECT user_id, round(1 / median(CASE WHEN d > 0 THEN d END), 9) AS fps FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts)) / 1e6 AS d FROM events) GROUP BY user_id")
def infer_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").df.withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return align.infer_fps(e, ["user_id"], F.col("s")).withColumn("fps", F.round("fps", 9))


# --- episodes -----------------------------------------------------------------------------

_SIZES = "SELECT o_orderkey, o_custkey, (o_orderkey % 5 + 1)::BIGINT AS n FROM orders"


@query(f"""WITH o AS (SELECT o_orderkey, n, (sum(n) OVER (ORDER BY o_orderkey) - n)::BIGINT AS low FROM ({_SIZES})), f AS (SELECT unnest(range((SELECT sum(n)::BIGINT FROM o))) AS idx)
SELECT o_orderkey, idx, idx - low AS frame_index FROM o JOIN f ON idx >= low AND idx < low + n""")
def frames_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").df.select("o_orderkey", (F.col("o_orderkey") % 5 + 1).alias("n"))
    e = offsets.running_offsets(o, [], "o_orderkey", "n", "low").withColumn("high", F.col("low") + F.col("n")).withColumn("file", F.lit(0))
    total = e.agg(F.sum("n")).first()[0] or 0
    f = spark.range(total).select(F.col("id").alias("idx"), F.lit(0).alias("file"))
    return episodes.range_join(f, e, ["file"], "idx", "low", "high", ["o_orderkey", "low"]).select("o_orderkey", "idx", (F.col("idx") - F.col("low")).alias("frame_index"))


_TASKS = """t AS (SELECT (p_partkey % 2)::INT AS source, p_type AS task, (dense_rank() OVER (PARTITION BY p_partkey % 2 ORDER BY p_type) - 1)::BIGINT AS i FROM part),
d AS (SELECT DISTINCT source, task, i FROM t), f AS (SELECT task, min({'source': source, 'i': i}) AS o FROM d GROUP BY task),
top AS (SELECT max(i) AS m FROM d WHERE source = 0),
g AS (SELECT task, CASE WHEN o.source = 0 THEN o.i ELSE (SELECT m FROM top) + row_number() OVER (PARTITION BY o.source = 0 ORDER BY o.source, o.i) END::BIGINT AS task_index FROM f)"""


def _tasks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").df.select(F.col("p_partkey"), (F.col("p_partkey") % 2).cast("int").alias("source"), F.col("p_type").alias("task"))
    i = (F.dense_rank().over(Window.partitionBy("source").orderBy("task")) - 1).cast("bigint")
    p = p.withColumn("task_index", i)
    return p, p.select("source", "task", "task_index").distinct()


@query(f"WITH {_TASKS} SELECT task, task_index FROM g")
def task_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.merge_tasks(_tasks(spark, sf_dir)[1], "source", "task", "task_index")[0]


@query(f"WITH {_TASKS} SELECT p_partkey, task_index FROM part JOIN g ON task = p_type")
def task_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tasks = _tasks(spark, sf_dir)
    _, remap = episodes.merge_tasks(tasks, "source", "task", "task_index")
    return episodes.remap_tasks(rows, remap, "source", "task_index").select("p_partkey", "task_index")


@query("""WITH m AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS dup FROM orders)
SELECT o_orderkey, CASE WHEN dup THEN (SELECT max(o_custkey) FROM orders) + row_number() OVER (PARTITION BY dup ORDER BY o_orderkey) ELSE o_custkey END::BIGINT AS episode FROM m""")
def renumber_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.renumber_duplicates(table(spark, sf_dir, "orders").df.select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", "episode").select("o_orderkey", "episode")


_FRAMES = "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS frame_index, value::FLOAT AS v, value FROM events"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = align.numbered(table(spark, sf_dir, "events").df, ["user_id"], ["ts", "event_id"], "frame_index")
    return e.select("user_id", "frame_index", F.col("value").cast("float").alias("v"), "value")


@query(f"""WITH e AS (SELECT *, coalesce(abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY frame_index)), 0) > 90 AS moves FROM ({_FRAMES})),
b AS (SELECT user_id, min(frame_index) FILTER (moves) AS f, max(frame_index) FILTER (moves) AS l, count(*) AS n FROM e GROUP BY user_id)
SELECT user_id, CASE WHEN f IS NOT NULL THEN greatest(0, f - 2) END AS start, CASE WHEN f IS NOT NULL THEN least(n - 1, l + 1) END AS "end", n FROM b""")
def motion_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).withColumn("state", F.array("v"))
    return episodes.motion_bounds(f, ["user_id"], "frame_index", ["state"], 90.0, 1)


@query(f"""WITH e AS (SELECT *, (frame_index * 0.5)::FLOAT AS t, coalesce(abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY frame_index)), 0) > 90 AS moves FROM ({_FRAMES})),
b AS (SELECT user_id, greatest(0, min(frame_index) FILTER (moves) - 1) AS s, max(frame_index) FILTER (moves) AS l FROM e GROUP BY user_id)
SELECT user_id, frame_index - s AS frame_index, (t - (s * 0.5)::FLOAT)::FLOAT AS timestamp, value FROM e JOIN b USING (user_id) WHERE frame_index BETWEEN s AND l""")
def motion_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).select("user_id", "frame_index", "value", F.array("v").alias("state"), (F.col("frame_index") * 0.5).cast("float").alias("timestamp"))
    return episodes.motion_trim(f, ["user_id"], ["state"], 90.0).select("user_id", "frame_index", "timestamp", "value")


@query(f"""WITH w AS (SELECT user_id, frame_index, lag(value) OVER o AS "value_-1", value AS value_0, lead(value) OVER o AS value_1, lag(frame_index) OVER o AS a, lead(frame_index) OVER o AS b
FROM ({_FRAMES}) WINDOW o AS (PARTITION BY user_id ORDER BY frame_index)) SELECT user_id, frame_index, "value_-1", value_0, value_1 FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND frame_index % 2 = 0""")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.frame_windows(_frames(spark, sf_dir), ["user_id"], [-1, 0, 1], ["value"], stride=2).drop("v", "value")


@query(f"SELECT user_id, frame_index // 2 AS frame_index, value FROM ({_FRAMES}) WHERE frame_index % 2 = 0")
def select_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return episodes.select_frames(_frames(spark, sf_dir), F.col("frame_index") % 2 == 0, ["user_id"]).select("user_id", "frame_index", "value")


@query("SELECT o_orderkey, (sum(o_custkey) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - o_custkey)::BIGINT AS low, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS i FROM orders")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = offsets.running_offsets(table(spark, sf_dir, "orders").df.select("o_orderkey", "o_custkey"), [], "o_orderkey", "o_custkey", "low")
    return offsets.global_index(o, "o_orderkey", "i").select("o_orderkey", "low", "i")


@query("SELECT doc_id, (sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS \"offset\", n AS size FROM (SELECT doc_id, source, strlen(text)::BIGINT AS n FROM documents)")
def blob_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").df.select("doc_id", "source", F.octet_length("text").cast("bigint").alias("size"))
    return offsets.running_offsets(d, ["source"], "doc_id", "size", "offset").select("doc_id", "offset", "size")


# --- statistics ---------------------------------------------------------------------------


@query("""SELECT label, dim, min(x) AS min, max(x) AS max, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std, count(*) AS count
FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, dim""")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stats.feature_stats(table(spark, sf_dir, "embeddings").df, ["label"], "embedding")
    return s.withColumns({c: F.round(c, 9) for c in ("mean", "std")})


_Q = "CASE WHEN max(n) < 2 THEN max(mean) ELSE arg_min(CASE WHEN b = 0 THEN lo ELSE lo + w * b + ({q} * n - (cum - c)) / c * w END, b) FILTER (cum >= {q} * n) END"


@query(f"""WITH x AS (SELECT unnest(range(len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT dim, min(x) - 1e-10 AS lo, max(x) + 1e-10 AS hi, count(*) AS n, avg(x) AS mean FROM x GROUP BY dim),
h AS (SELECT dim, lo, n, mean, (hi - lo) / 5000 AS w, least(floor((x - lo) / ((hi - lo) / 5000)), 4999) AS b, count(*) AS c FROM x JOIN s USING (dim) GROUP BY ALL),
r AS (SELECT *, sum(c) OVER (PARTITION BY dim ORDER BY b) AS cum FROM h)
SELECT dim, {", ".join(f"round({_Q.format(q=q)}, 6) AS q{round(q * 100):02d}" for q in stats.QUANTILES)} FROM r GROUP BY dim""")
def feature_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stats.feature_quantiles(table(spark, sf_dir, "embeddings").df, [], "embedding")
    return q.withColumns({c: F.round(c, 6) for c in q.columns if c != "dim"})


@query("SELECT l_returnflag, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, count(*) AS count FROM lineitem GROUP BY l_returnflag")
def stats_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stats.feature_stats(table(spark, sf_dir, "lineitem").df, ["l_returnflag", "l_linestatus"], "l_quantity")
    return stats.merge_stats(parts, ["l_returnflag"]).withColumns({c: F.round(c, 6) for c in ("mean", "std")})


# --- media and crawl ----------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, list({'start': round(greatest(a, 0), 3), 'end': round(greatest(b, 0), 3)} ORDER BY round(greatest(a, 0), 3), round(greatest(b, 0), 3)) AS l FROM
(SELECT user_id, value - 20 AS a, value * 2 - 60 AS b FROM events WHERE event_type = 'error') WHERE round(greatest(b, 0), 3) > round(greatest(a, 0), 3) GROUP BY user_id)
SELECT user_id, i::BIGINT AS i, l[i + 1].start AS start, l[i + 1]."end" AS "end", 'segment ' || (i + 1) AS label FROM (SELECT *, unnest(range(len(l))) AS i FROM s)""")
def segments_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(col("event_type") == "error").df
    seg = F.struct((F.col("value") - 20).alias("start"), (F.col("value") * 2 - 60).alias("end"), F.lit(None).cast("string").alias("label"))
    s = e.groupBy("user_id").agg(F.collect_list(seg).alias("s"))
    return s.select("user_id", F.posexplode(media.normalize_segments(F.col("s"))).alias("i", "x")).select("user_id", F.col("i").cast("bigint").alias("i"), "x.start", "x.end", "x.label")


@query("SELECT o_orderkey, floor(n * 0.5)::BIGINT AS low, ceil(n * 2.5)::BIGINT AS high FROM (SELECT o_orderkey, o_orderkey % 17 AS n FROM orders)")
def clip_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 17).cast("double")
    return table(spark, sf_dir, "orders").df.select("o_orderkey", media.clip_frames(n * 0.25, n * 1.25, F.lit(2.0)).alias("c")).select("o_orderkey", "c.*")


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, 11), lambda i: exp(embedding[i]) * (i - 1) / 9.0)) / list_sum(list_transform(range(1, 11), lambda i: exp(embedding[i]::DOUBLE))), 5) AS progress,
round(1 / (1 + exp(-embedding[11]::DOUBLE)), 6) AS success FROM embeddings""")
def reward_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = media.checked_logits(F.col("embedding").cast("array<double>"))
    return table(spark, sf_dir, "embeddings").df.select("vec_id", F.round(media.reward_progress(v), 5).alias("progress"), F.round(media.reward_success(v), 6).alias("success"))


@query("SELECT page_id FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0")
def html_index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    mime = lambda d: F.when(F.col("page_id") % d == 0, F.lit("text/html")).otherwise(F.lit("application/pdf"))
    p = table(spark, sf_dir, "pages").transform(lambda df: df.withColumns({"content_mime_type": mime(2), "content_mime_detected": mime(3)}))
    return p.filter(filter_html()).select("page_id").df


@query("SELECT role, text, conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.dedup(table(spark, sf_dir, "conversations").df, ["conv_id"], ["turn"]).select("role", "text", "conv_id", "turn")


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 4) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").df.withColumnRenamed("c_nationkey", "n_nationkey")
    j = relational.join(c, table(spark, sf_dir, "nation").df, ["n_nationkey"])
    return relational.group_combine(j, ["n_name"], n=F.count("*"), total=F.round(F.sum("c_acctbal"), 4))


@query("SELECT user_id, event_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def top_k_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").df
    return relational.top_k(e, ["user_id"], [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id", "rank")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def global_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.global_sort(table(spark, sf_dir, "orders").df, F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def salted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").df.select(F.col("l_orderkey").alias("k"), "l_linenumber")  # noqa: E741
    r = table(spark, sf_dir, "orders").df.select(F.col("o_orderkey").alias("k"), "o_custkey")
    return relational.salted_join(l, r, ["k"], 4).select(F.col("k").alias("l_orderkey"), "l_linenumber", "o_custkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey * 2 AS twice FROM orders")
def positional_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").df
    return episodes.positional_merge(o.select("o_orderkey", "o_custkey", "o_totalprice"), o.select("o_orderkey", (F.col("o_orderkey") * 2).alias("twice")), "o_orderkey")


@query("SELECT 'events' AS source, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def union_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").df.select(F.lit("events").alias("source"))
    return relational.value_counts(relational.union(a, table(spark, sf_dir, "orders").df.select(F.lit("orders").alias("source"))), "source")


# --- set operations and groupings ---------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.intersect(table(spark, sf_dir, "customer").df.select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").df.select("s_nationkey"))


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def set_except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.except_(table(spark, sf_dir, "orders").df.select(F.col("o_custkey").alias("k")), table(spark, sf_dir, "customer").df.select("c_custkey"), every=True)


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def set_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct(table(spark, sf_dir, "lineitem").df.select("l_returnflag", "l_linestatus"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_quantity) AS most FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def group_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.cube(table(spark, sf_dir, "lineitem").df, ["l_returnflag", "l_linestatus"], n=F.count("*"), most=F.max("l_quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.rollup(table(spark, sf_dir, "lineitem").df, ["l_returnflag", "l_linestatus"], n=F.count("*"))


# --- more sources and sinks ---------------------------------------------------------------


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def json_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with an array of objects, and one with lines."""
    out = scratch(spark)
    n = table(spark, sf_dir, "nation").df.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))))
    n.coalesce(1).write.text(f"{out}/array")
    r = table(spark, sf_dir, "region").df.select(F.to_json(F.struct(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))))
    r.coalesce(1).write.text(f"{out}/lines")
    return read_json(spark, [f"{out}/array/*.txt", f"{out}/lines/*.txt"], file_path_column=None).select("n_nationkey", "n_name").df


@query("SELECT 1::BIGINT AS a, 'x' AS b UNION ALL SELECT 2, NULL")
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_items(spark, [{"a": 1, "b": "x"}, {"a": 2, "b": None}]).df.select("a", "b")


@query("SELECT 'orders.parquet' AS name, count(*) AS n FROM orders")
def file_path_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_parquet(spark, f"{sf_dir}/orders.parquet", columns=["o_orderkey"])
    return d.df.groupBy(F.regexp_extract("file_path", r"([^/]+\.parquet)", 1).alias("name")).agg(F.count("*").alias("n"))


@query("SELECT (o_orderkey % 3)::BIGINT AS k, count(*) AS n FROM orders GROUP BY ALL")
def directory_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of other suffixes in a directory are passed over."""
    out = scratch(spark)
    o = table(spark, sf_dir, "orders").df
    o.select((F.col("o_orderkey") % 3).alias("k")).write.parquet(out)
    o.select(F.lit("not parquet")).write.mode("append").text(out)
    return read_parquet(spark, out, file_path_column=None).df.groupBy("k").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name || '.mp4' AS video FROM nation")
def video_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sinks import _put

    out = scratch(spark)
    rows = table(spark, sf_dir, "nation").df.select("n_nationkey", "n_name").collect()  # a fixture of 25 files
    _put(out, {f"{r['n_nationkey']}-{r['n_name']}.mp4": b"\0" for r in rows})
    name = F.element_at(F.split("video_path", "/"), -1)
    v = read_videos(spark, f"{out}/*.mp4").df.select(F.url_decode(name).alias("f"))
    return v.select(F.split("f", "-", 2)[0].cast("bigint").alias("n_nationkey"), F.split("f", "-", 2)[1].alias("video"))


@query("SELECT n_nationkey, n_name, NULL::VARCHAR AS gone FROM nation")
def blob_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files bundled into blobs, references read back; files that are not there become null."""
    from millrace.sinks import BlobAssets, _put

    out = scratch(spark)
    n = table(spark, sf_dir, "nation").df.select("n_nationkey", "n_name")
    _put(f"{out}/in", {f"{r['n_nationkey']}.txt": r["n_name"].encode() for r in n.collect()})  # a fixture of 25 files
    d = Dataset(n.select("n_nationkey", F.concat(F.lit(f"{out}/in/"), F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("f"), F.lit(f"{out}/none").alias("gone")))
    d.write_parquet(f"{out}/out", assets=BlobAssets(("f", "gone"), missing_policy="set_null")).launch_local("assets")
    back = read_parquet(spark, f"{out}/out", file_path_column=None)
    return back.map(lambda r: {"n_name": read_blob(r["f"]).decode()}, dtypes={"n_name": "string"}).df.select("n_nationkey", "n_name", F.col("gone").cast("string").alias("gone"))


def _archives(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Pages as web archives, a file a partition, and an index of their records."""
    import pyarrow as pa

    out = scratch(spark)

    def write(batches):
        import uuid

        from millrace.sinks import _put

        for b in batches:
            parts, rows, at, name = [], [], 0, f"{uuid.uuid4().hex}.warc"
            for r in b.to_pylist():
                body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + (r["html"] or "").encode()
                head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {r['url']}\r\nContent-Length: {len(body)}\r\n\r\n".encode()
                parts.append(head + body + b"\r\n\r\n")
                rows.append((r["page_id"], r["url"], name, at, len(parts[-1])))
                at += len(parts[-1])
            _put(out, {name: b"".join(parts)})
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["page_id", "url", "warc_filename", "warc_record_offset", "warc_record_length"])

    pages = table(spark, sf_dir, "pages").df.select("page_id", "url", "html")
    index = pages.mapInArrow(write, "page_id long, url string, warc_filename string, warc_record_offset long, warc_record_length long")
    index.write.parquet(f"{out}/index")
    return out, spark.read.parquet(f"{out}/index")


@query("SELECT url, 200 AS http_status, strlen(html)::BIGINT AS n FROM pages")
def crawl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = _archives(spark, sf_dir)
    return read_commoncrawl(spark, f"{out}/*.warc").df.select("url", "http_status", F.octet_length("content").cast("bigint").alias("n"))


@query("SELECT url, md5(html) AS h FROM pages WHERE page_id % 4 = 1")
def crawl_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = _archives(spark, sf_dir)
    d = read_commoncrawl_from_index(spark, f"{out}/index", out, col("page_id") % 4 == 1)
    return d.df.select("url", F.md5("content").alias("h"))


@query("SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS row_index, len(embedding)::INTEGER AS dims, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def array_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark)
    e = table(spark, sf_dir, "embeddings").df.select("vec_id", F.array(F.col("embedding").cast("array<double>")).alias("x"))
    Dataset(e).write_zarr(out, {"data/x": "x"}, order="vec_id").launch_local("zarr")
    z = read_zarr(spark, out, {"x": "data/x"}, row_ends="meta/episode_ends").df
    return z.select("row_index", F.size(F.get("x", F.lit(0))).alias("dims"), F.round(F.get(F.get("x", F.lit(0)), F.lit(0)), 6).alias("first"))


@query("SELECT n_nationkey, n_name, [n_nationkey / 2.0, 1.5]::FLOAT[] AS v FROM nation")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serialised examples of a fixture of 25 rows, read by the declared features."""
    from millrace.sinks import _put

    def part(number: int, body: bytes) -> bytes:
        return bytes([number << 3 | 2, len(body)]) + body

    def feature(name: str, kind: int, body: bytes) -> bytes:
        return part(1, part(1, name.encode()) + part(2, part(kind, body)))

    out, data = scratch(spark), b""
    for r in table(spark, sf_dir, "nation").df.collect():
        x = part(1, feature("n_nationkey", 3, part(1, bytes([r["n_nationkey"]]))) + feature("n_name", 1, part(1, r["n_name"].encode())) + feature("v", 2, part(1, struct.pack("<2f", r["n_nationkey"] / 2, 1.5))))
        data += struct.pack("<Q", len(x)) + bytes(4) + x + bytes(4)
    _put(out, {"a.tfrecord": data})
    return read_tfrecords(spark, f"{out}/a.tfrecord", {"n_nationkey": "int64", "n_name": "string", "v": "array<float>"}).df


def _log(spark: SparkSession, sf_dir: str) -> str:
    """A robot log of suppliers: their balance at whole seconds, their nation half a second later at every other one."""
    from millrace.sinks import _put

    def record(code: int, body: bytes) -> bytes:
        return bytes([code]) + struct.pack("<Q", len(body)) + body

    def text(s: str) -> bytes:
        return struct.pack("<I", len(s)) + s.encode()

    topics, out = ["/balance", "/nation"], [mcap.MAGIC]
    out += [record(mcap.CHANNEL, struct.pack("<HH", i, 0) + text(t) + text("json") + struct.pack("<I", 0)) for i, t in enumerate(topics)]
    rows = table(spark, sf_dir, "supplier").df.orderBy("s_suppkey").limit(100).collect()  # the fixture's size
    for k, r in enumerate(rows):
        for i, (at, value, there) in enumerate(((r["s_suppkey"], r["s_acctbal"], True), (r["s_suppkey"] + 0.4, r["s_nationkey"], r["s_suppkey"] % 2 == 0))):
            if there:
                out.append(record(mcap.MESSAGE, struct.pack("<HIQQ", i, k, int(at * 1e9), int(at * 1e9)) + json.dumps({"v": value}).encode()))
    folder = scratch(spark)
    _put(folder, {"a.mcap": b"".join([*out, mcap.MAGIC])})
    return f"{folder}/a.mcap"


_LOG_FIELDS = {"balance": ("/balance.v", "double"), "nation": ("/nation.v", "bigint")}
_LOG_ROWS = "s AS (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 100)"


@query(f"WITH {_LOG_ROWS} SELECT s_suppkey::DOUBLE AS at, s_acctbal AS balance, NULL::BIGINT AS nation FROM s UNION ALL SELECT s_suppkey + 0.4::DOUBLE, NULL, s_nationkey FROM s WHERE s_suppkey % 2 = 0")
def log_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_mcap(spark, _log(spark, sf_dir), _LOG_FIELDS).df
    return d.select(F.round(F.col("ts") / 1e9, 3).alias("at"), "balance", "nation")


@query(f"""WITH {_LOG_ROWS} SELECT (row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT AS frame_index, s_acctbal AS balance,
CASE WHEN s_suppkey % 2 = 1 THEN lag(s_nationkey) OVER (ORDER BY s_suppkey) ELSE lag(s_nationkey, 2) OVER (ORDER BY s_suppkey) END::BIGINT AS nation FROM s""")
def log_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_mcap(spark, _log(spark, sf_dir), _LOG_FIELDS, "balance", "hold").df
    return d.select("frame_index", "balance", "nation")


_EPISODES = "e AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS frame_index, value, dense_rank() OVER (ORDER BY user_id) - 1 AS episode_index FROM events)"


def _episode_set(spark: SparkSession, sf_dir: str):
    out = scratch(spark)
    f = _frames(spark, sf_dir).select("user_id", "frame_index", F.array("value").alias("action"))
    users = f.select("user_id").distinct().withColumn("tasks", F.array(F.concat(F.lit("task "), (F.col("user_id") % 3).cast("string"))))
    nested = episodes.nest_frames(users, f, ["user_id"]).withColumn("frames", F.transform("frames", lambda x: F.struct(x["action"].alias("action"))))
    Dataset(offsets.global_index(nested, "user_id", "episode_index")).write_episodes(out, fps=10.0).launch_local("episodes")
    return read_lerobot(spark, out)


@query(f"WITH {_EPISODES} SELECT episode_index::BIGINT AS episode_index, frame_index, (row_number() OVER (ORDER BY user_id, frame_index) - 1)::BIGINT AS index, value FROM e")
def episodes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _episode_set(spark, sf_dir)
    return d.frames.select("episode_index", "frame_index", "index", F.get("action", F.lit(0)).alias("value"))


@query(f"WITH {_EPISODES} SELECT episode_index::BIGINT AS episode_index, count(*) AS length, min(value) AS low, max(value) AS high, round(avg(value), 4) AS mean FROM e GROUP BY ALL")
def episodes_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as they are written beside each episode."""
    e = _episode_set(spark, sf_dir).episodes
    of = lambda k: F.get(f"stats/action/{k}", F.lit(0))
    return e.select("episode_index", "length", of("min").alias("low"), of("max").alias("high"), F.round(of("mean"), 4).alias("mean"))


@query(f"SELECT user_id, frame_index FROM ({_FRAMES}) WHERE user_id % 2 = 1")
def delete_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir).select("user_id", "frame_index")
    users = f.select("user_id").distinct()
    return episodes.delete_episodes(users, f, users.filter("user_id % 2 = 0"), ["user_id"]).frames


@query("SELECT count(*) AS total_episodes, sum(o_orderkey % 5)::BIGINT AS total_frames FROM orders")
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dataset_totals(table(spark, sf_dir, "orders").df.select((F.col("o_orderkey") % 5).alias("length")))


@query("SELECT o_custkey, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY o_custkey")
def key_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ranges(table(spark, sf_dir, "orders").df, ["o_custkey"], "o_orderkey", "o_orderkey")


@query("SELECT p_partkey, CASE WHEN p_size = 1 THEN 30.0 WHEN abs(p_size / 3.0 - round(p_size / 3.0)) < 1e-6 THEN round(p_size / 3.0) ELSE p_size / 3.0 END::DOUBLE AS fps FROM part")
def snapped_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").df.select("p_partkey", align.snap_fps(F.when(F.col("p_size") != 1, F.col("p_size") / 3)).alias("fps"))


@query("SELECT event_id, w.user_id FROM events e JOIN (SELECT user_id, min(ts) AS a FROM events GROUP BY user_id) w ON e.user_id = w.user_id AND ts >= a AND ts < a + INTERVAL 1 DAY")
def window_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").df.select("event_id", "user_id", "ts")
    w = e.groupBy("user_id").agg(F.min("ts").alias("low")).withColumn("high", F.col("low") + F.expr("INTERVAL 1 DAY"))
    return align.windows_of(e, ["user_id"], "ts", w, "low", "high").select("event_id", "user_id")


@query("SELECT s_suppkey, s_nationkey + 1 AS next FROM supplier")
def with_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").with_column("next", col("s_nationkey") + 1).select("s_suppkey", "next").df


__all__ = ["QUERIES", "SQL", "lit"]
