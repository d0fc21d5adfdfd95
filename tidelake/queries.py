"""The registered lake queries and the SQL that each must agree with.

The driver tables stand in for the lake's: an order line is a token transfer (customer to supplier, part as
token), events are calls, readings and partitions by day, orders by nation are catalog shards.
"""

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import blobs, catalog, codecs, compact, flows, frontier, rollups, versions
from .operators import write as layers
from .plans import sql as readonly
from .scratch import children, file_system, new_path, written
from .sources import chain, dated, discovery, klines
from .streaming import holding, paged, pump

QUERIES, SQL = {}, {}

#: Fixed value: lines of a zipped kline archive, and a batch more at most.
ARCHIVE_LINES = 250_000


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact(df: DataFrame, *columns: str) -> DataFrame:
    """Decimal sums in the widest type, as SQL engines give them."""
    return df.withColumns({c: F.col(c).cast("decimal(38,4)") for c in columns})


def money(c: str, scale: int = 4):
    return F.col(c).cast(f"decimal(18,{scale})")


# -- flows and rollups ---------------------------------------------------------------------------------------------


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.to_date("o_orderdate").alias("date"), F.col("l_partkey").alias("token_address"), F.col("o_custkey").alias("from_address"),
        F.col("l_suppkey").alias("to_address"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"),
    )


@query("""
with t as (select cast(o_orderdate as date) as date, l_partkey as token, o_custkey as f, l_suppkey as t, cast(l_extendedprice as decimal(38,2)) as v
           from lineitem join orders on l_orderkey = o_orderkey),
legs as (select date, f as address, token, t as other, -v as s from t union all select date, t, token, f, v from t)
select date, address, count(*) as transfer_count, count(distinct token) as token_count, count(distinct other) as counterparty_count,
       cast(coalesce(sum(case when s > 0 then s end), 0) as decimal(38,2)) as inflow, cast(coalesce(sum(case when s < 0 then -s end), 0) as decimal(38,2)) as outflow,
       cast(sum(s) as decimal(38,2)) as net_flow
from legs group by date, address having count(*) >= 2
""")
def addr_flow_1d(spark, sf_dir):
    return flows.addr_flow_1d(transfers(spark, sf_dir))


@query("select cast(ts as date) as day, count(*) as n, sum(cast(value as decimal(18,4))) as total from events group by 1")
def daily_rollup(spark, sf_dir):
    return exact(rollups.daily_rollup(table(spark, sf_dir, "events"), "ts", money("value")), "total")


@query("select user_id, count(*) as n, sum(cast(value as decimal(18,4))) as total from events group by user_id having count(*) > 5")
def per_entity(spark, sf_dir):
    return exact(rollups.per_entity(table(spark, sf_dir, "events"), "user_id", money("value"), 5), "total")


@query("select event_id, cast(sum(cast(value as decimal(18,4))) over w as double) / count(value) over w as rolling_mean from events window w as (partition by event_type order by ts, event_id rows between 100 preceding and current row)")
def rolling_mean(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    return rollups.rolling_mean(e, "event_type", ["ts", "event_id"], money("value")).select("event_id", "rolling_mean")


@query("select count(*) as n, round(avg(l_quantity), 6) as mean_quantity, max(l_extendedprice) as top_price from lineitem")
def global_agg(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"), F.max("l_extendedprice").alias("top_price"))


@query("select event_type, count(*) as n from events where try_cast(json_extract_string(props, '$.k') as double) > 0 group by event_type")
def safe_cast(spark, sf_dir):
    return table(spark, sf_dir, "events").where(S.safe_double(F.get_json_object("props", "$.k")) > 0).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select cast(floor(epoch(ts) / 86400) as bigint) as day_number, count(*) as n from events group by 1")
def day_bucket(spark, sf_dir):
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").groupBy(S.day_number(seconds).alias("day_number")).agg(F.count(F.lit(1)).alias("n"))


@query("""select event_type, sum(case when event_id % 2 = 0 then cast(value as decimal(18,4)) end) as positive, sum(case when event_id % 2 = 1 then -cast(value as decimal(18,4)) end) as negative
from events group by event_type""")
def signed_split(spark, sf_dir):
    even = F.col("event_id") % 2 == 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(F.when(even, money("value"))).alias("positive"), F.sum(F.when(~even, (-money("value")).cast("decimal(18,4)"))).alias("negative")).withColumns({c: F.col(c).cast("decimal(38,4)") for c in ("positive", "negative")})


@query("select event_id, case when event_id % 2 = 0 then date_trunc('milliseconds', ts) else ts end as ts from events")
def epoch_normalize(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    mixed = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.unix_millis(ts)).otherwise(F.unix_micros(ts)).alias("epoch"))
    return mixed.select("event_id", S.epoch_to_timestamp(F.col("epoch")).alias("ts"))


@query("select p_partkey, regexp_replace(lower(p_name || '-' || p_brand || '.' || p_type), '[^a-z0-9_]', '_', 'g') as identifier from part")
def identifier_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.identifier(F.concat("p_name", F.lit("-"), "p_brand", F.lit("."), "p_type")).alias("identifier"))


@query("""select event_id, k as key, v as value from (
  select event_id, unnest(['type', 'user']) as k, unnest([event_type, cast(user_id as varchar)]) as v from events)""")
def partition_segments(spark, sf_dir):
    path = F.concat(F.lit("lake/type="), "event_type", F.lit("/user="), F.col("user_id").cast("string"), F.lit("/part-0.parquet"))
    return table(spark, sf_dir, "events").select("event_id", F.explode(S.partition_map(path)).alias("key", "value"))


@query("select c_custkey, substr(sha256(c_name), 1, 16) as short_key, substr(sha256(c_name), 1, 32) as long_key from customer")
def digest_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.digest_key(F.col("c_name"), 16).alias("short_key"), S.digest_key(F.col("c_name"), 32).alias("long_key"))


@query("select cast(('0x' || substr(sha256(c_name), 1, 8))::bigint % 4 as bigint) as worker, count(*) as n from customer group by 1")
def ownership_slices(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(S.owner_slice(F.sha2("c_name", 256), 4).alias("worker")).agg(F.count(F.lit(1)).alias("n"))


@query("""with b as (select min(o_orderdate) as lo, max(o_orderdate) as hi from orders),
spine as (select strftime(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), interval 1 month)), '%Y-%m') as month from b)
select spine.month, count(o_orderkey) as n from spine left join orders on strftime(o_orderdate, '%Y-%m') = spine.month group by spine.month""")
def month_spine(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    months = orders.agg(dated.months(F.min("o_orderdate"), F.max("o_orderdate")).alias("names")).select(F.explode("names").alias("month"))
    counts = orders.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return months.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


@query("""with b as (select min(cast(o_orderdate as date)) as lo, max(cast(o_orderdate as date)) as hi from orders),
spine as (select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day from b)
select day from spine where day not in (select cast(o_orderdate as date) from orders)""")
def missing_days(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day"))
    b = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if b["lo"] is None:
        return days.limit(0)
    return dated.days_between(spark, str(b["lo"]), str(b["hi"])).join(days, "day", "left_anti")


@query("select event_type, count(*) as n, count(case when value >= 400 then null else value end) as finite from events group by event_type")
def nan_to_null(spark, sf_dir):
    value = F.when(F.col("value") >= 400, F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(S.finite(value)).alias("finite"))


@query("select c_custkey, '<redacted ' || length(c_name) || ' chars>' as api_key, c_mktsegment as segment from customer")
def redact_params(spark, sf_dir):
    params = S.redacted(F.create_map(F.lit("Api_Key"), "c_name", F.lit("segment"), "c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", params["Api_Key"].alias("api_key"), params["segment"].alias("segment"))


# -- partition trees -----------------------------------------------------------------------------------------------


def dated_events(spark: SparkSession, sf_dir: str) -> str:
    """events as date= partitions, time-sorted zstd files; the tree's root."""
    root = new_path(spark, "lake/ledger/events")
    layers.write(table(spark, sf_dir, "events").withColumn("date", F.to_date("ts")), root, ["date"], "ts")
    return root


def typed_events(spark: SparkSession, sf_dir: str) -> str:
    """events in folders of one type each; half of them lack a column and hold value as text."""
    root = new_path(spark, "market")
    e = table(spark, sf_dir, "events").withColumn("symbol", F.upper("event_type"))
    half = F.col("event_id") % 2 == 0
    e.where(half).withColumn("interval", F.lit("1m")).write.partitionBy("symbol", "interval").parquet(root)
    e.where(~half).withColumn("interval", F.lit("1m")).withColumn("value", F.col("value").cast("string")).drop("props").write.mode("append").partitionBy("symbol", "interval").parquet(root)
    return root


@query("select event_id, user_id, cast(ts as date) as date from events where strftime(ts, '%Y-%m') = '2024-01'")
def scan_month(spark, sf_dir):
    return dated.scan(spark, dated_events(spark, sf_dir), "2024-01").select("event_id", "user_id", F.col("date").cast("date").alias("date"))


@query("""
select 'market_' || event_type || '_1m' as view, event_type as type, '1m' as step, count(*) as n, count(case when event_id % 2 = 0 then props end) as with_props,
  sum(case when event_id % 2 = 0 then length(props) end)::bigint as letters, sum(cast(value as decimal(18,4)))::decimal(38,4) as total,
  sum(event_id)::bigint as ids, count(distinct user_id) as users, min(ts) as first_ts, max(ts) as last_ts
from events group by event_type
""")
def mount_views(spark, sf_dir):
    root = typed_events(spark, sf_dir)
    made = [v for v in discovery.mount_views(spark, root) if v.startswith("market_")]
    kinds = "view string, type string, step string, n long, with_props long, letters long, total decimal(38,4), ids long, users long, first_ts timestamp_ntz, last_ts timestamp_ntz"
    columns = [
        F.lower(F.max("symbol")).alias("type"), F.max("interval").alias("step"), F.count(F.lit(1)).alias("n"), F.count("props").alias("with_props"),
        F.sum(F.length("props")).alias("letters"), F.sum(money("value")).cast("decimal(38,4)").alias("total"), F.sum("event_id").alias("ids"),
        F.count_distinct("user_id").alias("users"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    ]
    return union(spark, [spark.table(v).agg(F.lit(v).alias("view"), *columns) for v in made], kinds)


@query("select distinct 'market_' || event_type || '_1m' as view from events")
def list_views(spark, sf_dir):
    made = set(discovery.mount_views(spark, typed_events(spark, sf_dir)))
    return spark.createDataFrame([(t,) for t in readonly.tables(spark) if t in made], "view string")


def union(spark: SparkSession, frames: list[DataFrame], schema: str) -> DataFrame:
    out = spark.createDataFrame([], schema)
    for f in frames:
        out = out.unionByName(f)
    return out


@query("select count(*) as n, count(case when event_id % 2 = 0 then props end) as with_props, cast(sum(cast(value as decimal(18,4))) as decimal(38,4)) as total from events")
def union_by_name(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    half = F.col("event_id") % 2 == 0
    both = discovery.union_by_name([e.where(half).withColumn("user_id", F.col("user_id").cast("int")), e.where(~half).withColumn("value", F.col("value").cast("string")).drop("props")])
    return both.agg(F.count(F.lit(1)).alias("n"), F.count("props").alias("with_props"), F.sum(money("value")).cast("decimal(38,4)").alias("total"))


@query("select event_type, count(*) as n from events group by event_type")
def strict_concat(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parts = [e.where(F.col("event_id") % 3 == k) for k in range(3)]
    return discovery.strict_concat(parts).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day, count(distinct cast(ts as date)) as days from events")
def partition_span(spark, sf_dir):
    return discovery.partition_span(spark, dated_events(spark, sf_dir))


@query("""select distinct 'status_' || lower(o_orderstatus) as chain, 'orders' as table_name from orders
union all select distinct 'status_' || lower(l_linestatus), 'lineitem' from lineitem""")
def layout_discovery(spark, sf_dir):
    """A chain for each status, with the orders and the lines that have it, each in partitions of its own."""
    root = new_path(spark, "layout")
    for name, status, key in (("orders", "o_orderstatus", "o_orderpriority"), ("lineitem", "l_linestatus", "l_returnflag")):
        rows = table(spark, sf_dir, name)
        for r in rows.select(status).distinct().collect():  # three at most
            part = rows.where(F.col(status) == r[0]).withColumn("part", F.lower(F.left(key, F.lit(1))))
            part.write.partitionBy("part").parquet(f"{root}/status_{r[0].lower()}/{name}")
    return discovery.layout(spark, root).select("chain", F.explode("tables").alias("table_name"))


@query("""with b as (select min(cast(ts as date)) as lo, max(cast(ts as date)) + 5 as hi from events)
select cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as day, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) in (select cast(ts as date) from events) as present,
  (cast(unnest(generate_series(lo, hi, interval 1 day)) as date) in (select cast(ts as date) from events))::int::bigint as files, true as bytes_are_files from b""")
def scan_budget(spark, sf_dir):
    b = table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")), F.date_add(F.max(F.to_date("ts")), 5)).first()
    root = dated_events(spark, sf_dir)
    day = F.regexp_extract("path", r"date=([0-9-]+)", 1).cast("date")
    held = discovery.inventory(spark, root).groupBy(day.alias("day")).agg(F.sum("length").alias("held"))
    previewed = dated.preview(spark, root, str(b[0]), str(b[1])).join(held, "day", "left")
    return previewed.select("day", "present", "files", (F.col("bytes") == F.coalesce("held", F.lit(0))).alias("bytes_are_files"))


@query("""with s as (select event_type as "table", count(distinct cast(ts as date)) as days, count(*) / 1000.0 as gb from events group by event_type)
select 'ledger' as chain, "table" as table_name, case when "table" <> 'view' then round(gb * least(1.0, 7 / days) * 0.3, 9) end as scan_gb from s""")
def scan_estimate(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.lit("ledger").alias("chain"), F.col("event_type").alias("table"))
    span = e.agg(F.count_distinct(F.to_date("ts")).alias("span_days"))
    gb = e.agg((F.count(F.lit(1)) / 1000.0).alias("gb")).where("table <> 'view'")  # one is not measured
    return dated.estimate(gb, span, 7, 0.3).select("chain", F.col("table").alias("table_name"), F.round("scan_gb", 9).alias("scan_gb"))


@query("select count(distinct cast(ts as date)) as files, true as sized, 0 as synthetic from events")
def asset_inventory(spark, sf_dir):
    files = discovery.inventory(spark, dated_events(spark, sf_dir))
    return files.agg(F.count(F.lit(1)).alias("files"), F.min(F.col("length") > 0).alias("sized"), F.count_if("is_synthetic").alias("synthetic"))


@query("select column_name as name, case column_type when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else lower(column_type) end as type from (describe lineitem)")
def schema_describe(spark, sf_dir):
    return discovery.describe(spark, f"{sf_dir}/lineitem.parquet")


@query("select strftime(min(ts), '%Y-%m-%d') as first_day, strftime(max(ts), '%Y-%m-%d') as last_day, count(distinct cast(ts as date)) as days, cast(date '2024-02-02' - max(cast(ts as date)) as int) as days_behind, date '2024-02-02' - max(cast(ts as date)) <= 2 as fresh from events")
def freshness(spark, sf_dir):
    return discovery.freshness(discovery.partition_span(spark, dated_events(spark, sf_dir)), 2, F.lit("2024-02-02").cast("date"))


@query("select 's3_ledger_events_2024_01' as view, count(*) as n from events where strftime(ts, '%Y-%m') = '2024-01'")
def register_prefix(spark, sf_dir):
    root = dated_events(spark, sf_dir).rsplit("/", 2)[0]
    made = dated.register_all(spark, root, [("ledger", "events"), ("ledger", "absent")], "2024-01").where("view is not null").collect()
    return union(spark, [spark.table(r["view"]).agg(F.lit(r["view"]).alias("view"), F.count(F.lit(1)).alias("n")) for r in made], "view string, n long")


@query("select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey between 1000 and 5000")
def block_range(spark, sf_dir):
    return chain.block_range(table(spark, sf_dir, "orders"), 1000, 5000, "o_orderkey").select("o_orderkey", "o_custkey", "o_totalprice")


# -- writing and maintenance ---------------------------------------------------------------------------------------


@query("select cast(ts as date) as date, count(*) as n, min(ts) as first_ts, max(ts) as last_ts, count(distinct user_id) as users from events group by 1")
def layered_write(spark, sf_dir):
    back = spark.read.parquet(dated_events(spark, sf_dir))
    return back.groupBy(F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count_distinct("user_id").alias("users"))


@query("select strftime(ts, '%Y-%m-%d') as date, 0::bigint as written, 'skipped' as status from events group by 1")
def period_load_again(spark, sf_dir):
    path = new_path(spark, "l1/events")
    rows = table(spark, sf_dir, "events").withColumn("date", F.date_format("ts", "yyyy-MM-dd"))
    wanted = written(rows.select("date").distinct(), "wanted")
    layers.load_missing(wanted, rows, path, "date", "ts").count()
    return layers.load_missing(wanted, rows, path, "date", "ts")


@query("select count(*) as rows, min(cast(ts as date)) as first_day, max(cast(ts as date)) as last_day, count(distinct user_id) as entities from events")
def publish_archive(spark, sf_dir):
    path = f"{new_path(spark, 'archive')}/events"
    layers.publish(table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")).sort("ts"), path)
    return layers.written_stats(spark, path, "day", "user_id")


@query("""with b as (select min(cast(ts as date)) as lo, max(cast(ts as date)) + 2 as hi from events),
spine as (select strftime(cast(unnest(generate_series(lo, hi, interval 1 day)) as date), '%Y-%m-%d') as date from b)
select spine.date, count(event_id) as written, case when count(event_id) > 0 then 'written' else 'missing' end as status from spine left join events on strftime(ts, '%Y-%m-%d') = spine.date group by spine.date""")
def copy_days(spark, sf_dir):
    b = table(spark, sf_dir, "events").agg(F.min(F.to_date("ts")), F.date_add(F.max(F.to_date("ts")), 2)).first()
    return layers.copy_days(spark, dated_events(spark, sf_dir), new_path(spark, "copy"), str(b[0]), str(b[1]), "ts")


@query("select count(distinct cast(ts as date)) as files, count(distinct cast(ts as date)) as undersized, count(*) as rows from events")
def dataset_stats(spark, sf_dir):
    return layers.dataset_stats(spark, dated_events(spark, sf_dir)).select("files", "undersized", "rows")


@query("select event_type, count(*) as n, sum(cast(value as decimal(18,4))) as total from events group by event_type")
def compacted_rows(spark, sf_dir):
    root = new_path(spark, "small")
    table(spark, sf_dir, "events").repartition(40).write.parquet(root)
    report = compact.compact(spark, root, "ts")
    if report["failed"]:
        raise RuntimeError(report["failed"])
    return spark.read.parquet(root).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("decimal(38,4)").alias("total"))


@query("""with f as (select event_id % 40 as file, count(*) as n from events group by 1)
select (file // 8)::int as part, count(*) as files, sum(n)::bigint as rows from f group by 1""")
def compaction_plan(spark, sf_dir):
    """Forty files of like size, whose groups may have so many bytes that eight of them fill one."""
    root = new_path(spark, "small")
    e = table(spark, sf_dir, "events").withColumn("file", (F.col("event_id") % 40).cast("int"))
    for_each = e.select("file", F.lit("x" * 10).alias("v")).repartition(40, "file")
    for_each.write.partitionBy("file").parquet(f"{root}/by")
    flat = f"{root}/flat"
    fs, _ = file_system(spark, flat)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(flat))
    for k in range(40):  # one folder of files, whose names tell their order
        made = next(x.getPath() for x in fs.listStatus(path(f"{root}/by/file={k}")) if x.getPath().getName().endswith(".parquet"))
        fs.rename(made, path(f"{flat}/f{k:02d}.parquet"))
    sizes = [r[0] for r in discovery.inventory(spark, flat).select("length").collect()]
    planned = compact.plan(spark, flat, most=8 * max(sizes) if 9 * min(sizes) > 8 * max(sizes) else 0)
    rows = discovery.footers(planned.select("path")).select("path", "rows")
    return planned.join(rows, "path").groupBy("part").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


@query("""select url as key, sha256(html) as sha256, strlen(html) as length, strlen(html) <= 2048 as inline, md5(html) as stored_md5, strlen(html) as stored_length
from (select url, arg_max(html, page_id) as html from pages where html is not null group by url)""")
def blob_pack(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("html is not null")
    put = pages.select(F.col("url").alias("key"), F.lit("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("data"), F.col("page_id").alias("put"))
    path = new_path(spark, "blobs")
    index = blobs.pack(put, path, 2048)
    stored = blobs.read(spark, path).select("key", F.md5("data").alias("stored_md5"), F.octet_length("data").cast("long").alias("stored_length"))
    return index.join(stored, "key").select("key", "sha256", "length", "inline", "stored_md5", "stored_length")


@query("select event_id, user_id, event_type as action, round(value, 1) as duration_ms, substr(props, 1, 300) as detail from events")
def audit_log(spark, sf_dir):
    path = new_path(spark, "audit")
    e = table(spark, sf_dir, "events")
    line = rollups.audit_line(F.col("user_id").cast("string"), F.col("event_type"), F.lit("ok"), F.col("value"), F.col("props"))
    layers.append_log(e.select("event_id", line.alias("l")).select("event_id", "l.*"), path)
    back = spark.read.schema("event_id long, client string, action string, status string, duration_ms double, detail string").option("mode", "DROPMALFORMED").json(path)
    return back.select("event_id", F.col("client").cast("long").alias("user_id"), "action", "duration_ms", "detail")


# -- catalog -------------------------------------------------------------------------------------------------------

SHARDS = """with shards as (select c_nationkey % 7 as layer_no, 'd' || c_nationkey as dataset, c_custkey as updated_at, 'a' || (c_custkey % 5) as account,
  o_orderkey as rows, cast(round(o_totalprice) as bigint) as bytes, cast(o_orderdate as date) as day from orders join customer on o_custkey = c_custkey), """
MERGED = """m as (select dataset, 'l' || max(layer_no) as layer, arg_min(account, updated_at) as account, cast(sum(rows) as bigint) as rows, cast(sum(bytes) as bigint) as bytes, count(*) as files,
  min(day) as time_min, max(day) as time_max, max(updated_at) as updated_at from shards group by dataset) """


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(
        F.concat(F.lit("l"), (F.col("c_nationkey") % 7).cast("string")).alias("layer"), F.concat(F.lit("d"), F.col("c_nationkey").cast("string")).alias("dataset"), F.col("c_custkey").alias("updated_at"),
        F.concat(F.lit("a"), (F.col("c_custkey") % 5).cast("string")).alias("account"), F.col("o_orderkey").alias("rows"), F.round("o_totalprice").cast("long").alias("bytes"),
        F.lit(1).cast("long").alias("files"), F.to_date("o_orderdate").alias("time_min"), F.to_date("o_orderdate").alias("time_max"),
    )


@query(SHARDS + MERGED + "select * from m")
def catalog_merge(spark, sf_dir):
    return catalog.merge(shards(spark, sf_dir))


@query(SHARDS + MERGED + "select dataset, account, rows, time_min, time_max from m")
def catalog_upsert(spark, sf_dir):
    log, all_writes = new_path(spark, "catalog"), shards(spark, sf_dir)
    for k in range(3):
        catalog.record_write(all_writes.where(F.col("updated_at") % 3 == k), log)
    return catalog.merge(spark.read.parquet(log)).select("dataset", "account", "rows", "time_min", "time_max")


@query(SHARDS + MERGED + "select layer, count(*) as datasets, cast(sum(rows) as bigint) as rows, cast(sum(bytes) as bigint) as bytes, cast(sum(files) as bigint) as files from m group by rollup (layer)")
def catalog_summary(spark, sf_dir):
    return catalog.summary(catalog.merge(shards(spark, sf_dir)))


@query(SHARDS + MERGED + """, accounts as (select distinct 'a' || (s_suppkey % 9) as account from supplier)
select accounts.account, count(dataset) as datasets, cast(coalesce(sum(bytes), 0) as bigint) as bytes from accounts left join m using (account) group by accounts.account""")
def placement(spark, sf_dir):
    accounts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), (F.col("s_suppkey") % 9).cast("string")).alias("account")).distinct()
    return catalog.placement(accounts, catalog.merge(shards(spark, sf_dir)))


@query(SHARDS + MERGED + ", accounts as (select distinct 'a' || (s_suppkey % 3) as account from supplier) select dataset, account from m where account not in (select account from accounts)")
def unplaced(spark, sf_dir):
    accounts = table(spark, sf_dir, "supplier").select(F.concat(F.lit("a"), (F.col("s_suppkey") % 3).cast("string")).alias("account")).distinct()
    return catalog.unplaced(accounts, catalog.merge(shards(spark, sf_dir))).select("dataset", "account")


@query("select r_name as chain, n_name as table_name, gb from region join nation on n_regionkey = r_regionkey left join (select s_nationkey, cast(sum(cast(s_acctbal as decimal(18,2))) as double) as gb from supplier group by 1) on s_nationkey = n_nationkey")
def measured_tables(spark, sf_dir):
    layout = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("chain"), F.col("n_name").alias("table"), "n_nationkey")
    gb = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum(money("s_acctbal", 2)).cast("double").alias("gb"))
    sizes = gb.join(layout, F.col("s_nationkey") == F.col("n_nationkey")).select("chain", "table", "gb")
    return catalog.measured(layout.select("chain", "table"), sizes).withColumnRenamed("table", "table_name")


@query("select r_name as chain, round(sum(s_acctbal), 1) as gb from region join nation on n_regionkey = r_regionkey left join (select s_nationkey, sum(s_acctbal) as s_acctbal from supplier group by 1) on s_nationkey = n_nationkey group by rollup (r_name)")
def measured_sizes(spark, sf_dir):
    layout = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("chain"), F.col("n_name").alias("table"), "n_nationkey")
    sizes = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("gb")).join(layout, F.col("s_nationkey") == F.col("n_nationkey")).select("chain", "table", "gb")
    return catalog.size_totals(layout.select("chain", "table"), sizes)


# -- ledgers and usage ---------------------------------------------------------------------------------------------


@query("""select cast(ts as date) as day, cast(user_id as varchar) as account, cast(coalesce(sum(case when event_id % 2 = 0 then cast(round(value) as bigint) end), 0) as bigint) as up,
cast(coalesce(sum(case when event_id % 2 = 1 then cast(round(value) as bigint) end), 0) as bigint) as down,
cast(805306368000 - coalesce(sum(case when event_id % 2 = 0 then cast(round(value) as bigint) end), 0) as bigint) as up_left from events group by 1, 2""")
def transfer_ledger(spark, sf_dir):
    moves = table(spark, sf_dir, "events").select(F.col("ts").alias("time"), F.when(F.col("event_id") % 2 == 0, "up").otherwise("down").alias("direction"), F.col("user_id").cast("string").alias("account"), F.round("value").cast("long").alias("bytes"))
    return rollups.transfer_ledger(moves)


@query("""with d as (select user_id, day, cast(sum(n) as bigint) as calls, cast(least(sum(least(n, 1)), 3) as bigint) as accepted from
      (select user_id, cast(ts as date) as day, date_trunc('minute', ts) as h, count(*) as n from events group by 1, 2, 3) group by 1, 2)
select user_id, day, accepted, calls - accepted as denied from d""")
def quota_usage(spark, sf_dir):
    calls = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("time"), F.col("event_id").alias("call_id"))
    return rollups.quota_usage(calls, 1, 3)


@query("select count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'F') as F, count(*) filter (where o_orderstatus = 'P') as P, count(*) filter (where o_orderstatus = 'X') as X from orders")
def state_counts(spark, sf_dir):
    return rollups.state_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "state"), ["O", "F", "P", "X"])


@query("select (select round(avg(value), 6) from (select value from events order by ts desc, event_id desc limit 200)) as mean_ms, count(*) as requests from events")
def latency_last_n(spark, sf_dir):
    return rollups.latency(table(spark, sf_dir, "events").select(F.col("ts").alias("time"), F.col("event_id").alias("call_id"), F.col("value").alias("ms")))


@query("select event_id, user_id, value as ms from events where value > 100")
def slow_calls(spark, sf_dir):
    return rollups.slow_calls(table(spark, sf_dir, "events").select("event_id", "user_id", F.col("value").alias("ms")), 100.0)


@query("select user_id, date_trunc('minute', ts) as minute, count(*) as calls from events group by 1, 2")
def minute_buckets(spark, sf_dir):
    return rollups.minute_buckets(table(spark, sf_dir, "events"), "user_id", "ts")


@query("select o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) as o_orderkey from orders group by o_custkey")
def latest_record(spark, sf_dir):
    return rollups.latest(table(spark, sf_dir, "orders"), "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("select event_id, ts from events order by ts desc, event_id desc limit 100")
def newest_calls(spark, sf_dir):
    return rollups.newest(table(spark, sf_dir, "events"), "ts", 100, "event_id").select("event_id", "ts")


@query("select c_custkey, row_number() over (order by coalesce(c_acctbal, 0) desc, c_custkey) as place from customer")
def rank_by_size(spark, sf_dir):
    order = [F.coalesce("c_acctbal", F.lit(0.0)).desc(), F.col("c_custkey")]
    ranked = rollups.positioned(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), order)
    return ranked.select("c_custkey", (F.col("position") + 1).alias("place"))


# -- streams -------------------------------------------------------------------------------------------------------


@query("select event_type, count(*) as n, sum(cast(value as decimal(18,4))) as total from events group by event_type")
def pump_rows(spark, sf_dir):
    pages, out, checkpoint = new_path(spark, "pages"), new_path(spark, "pumped"), new_path(spark, "cursor")
    e = table(spark, sf_dir, "events")
    e.where(F.col("event_id") % 2 == 0).repartition(6).write.parquet(pages)
    pump.pump_to(spark, pages, e.schema, checkpoint, out)
    e.where(F.col("event_id") % 2 == 1).repartition(6).write.mode("append").parquet(pages)
    pump.pump_to(spark, pages, e.schema, checkpoint, out)  # goes on behind the pages that are done
    return spark.read.schema(e.schema).parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("decimal(38,4)").alias("total"))


@query("select event_id, user_id from events")
def watch_dedup(spark, sf_dir):
    visits, out, checkpoint = new_path(spark, "visits"), new_path(spark, "watched"), new_path(spark, "seen")
    e = table(spark, sf_dir, "events")
    for k in range(3):  # each visit brings a third again
        e.where((F.col("event_id") % 3 == k) | (F.col("event_id") % 3 == (k + 1) % 3)).repartition(2).write.mode("append").parquet(visits)
    pump.watch(spark, visits, e.schema, checkpoint, out, "event_id", "ts")
    return spark.read.schema(e.schema).parquet(out).select("event_id", "user_id")


@query("select count(*) as n, cast(sum(cast(value as decimal(18,4))) as decimal(38,4)) as total, min(ts) as first_ts, max(ts) as last_ts from events")
def buffered_append(spark, sf_dir):
    arrived, out, checkpoint = new_path(spark, "records"), new_path(spark, "appended"), new_path(spark, "cursor")
    e = table(spark, sf_dir, "events")
    for k in range(2):
        e.where(F.col("event_id") % 2 == k).repartition(3).write.mode("append").parquet(arrived)
        pump.buffered_append(spark, arrived, e.schema, checkpoint, out, "ts")
    back = spark.read.schema(e.schema).parquet(out)
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum(money("value")).cast("decimal(38,4)").alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("""select event_type, count(*) as n, cast(sum(cast(value as decimal(18,4))) as decimal(38,4)) as total, count(props) as with_props,
  sum(event_id)::bigint as ids, min(ts) as first_ts, max(ts) as last_ts from events group by event_type""")
def micro_compaction(spark, sf_dir):
    root, checkpoint = new_path(spark, "arrivals"), new_path(spark, "cursor")
    e, made = table(spark, sf_dir, "events"), []
    for k in range(3):  # each call alone brings too little; all three together make the amount
        e.where(F.col("event_id") % 3 == k).repartition(4).write.mode("append").parquet(root)
        enough = compact.pending(spark, root) + (1 if k < 2 else 0)
        made.append(compact.watch(spark, root, checkpoint, "ts", pending_bytes=enough)["compactions"])
    if made != [0, 0, 1]:
        raise RuntimeError(f"compactions by call: {made}")
    total = F.sum(money("value")).cast("decimal(38,4)").alias("total")
    span = F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    back = spark.read.parquet(root).groupBy("event_type")
    return back.agg(F.count(F.lit(1)).alias("n"), total, F.count("props").alias("with_props"), F.sum("event_id").alias("ids"), *span)


@query("select event_id from events where event_id % 3 <> 0")
def unseen_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return pump.unseen(e.unionByName(e), e.where(F.col("event_id") % 3 == 0), "event_id").select("event_id")


# -- frontier ------------------------------------------------------------------------------------------------------

FRONTIER = """with f as (select substr(sha256('GET ' || url || ' '), 1, 32) as key, min(page_id) as added_at from pages group by url),
w as (select *, cast(('0x' || substr(key, 1, 8))::bigint % 3 as bigint) as worker from f), """
RESERVED = "r as (select *, row_number() over (partition by worker order by added_at, key) <= 20 as taken from w) "


def pages_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", F.lit("get").alias("method"), F.lit(None).cast("string").alias("payload"), F.col("page_id").alias("added_at"))
    return frontier.add(None, p.unionByName(p), 3)


@query(FRONTIER[:-2] + " select key, added_at, worker, 'pending' as state from w")
def frontier_add(spark, sf_dir):
    return pages_frontier(spark, sf_dir).select("key", "added_at", "worker", "state")


@query(FRONTIER + RESERVED + "select key, worker, case when taken then 'running' else 'pending' end as state, cast(taken as int) as attempts from r")
def frontier_reserve(spark, sf_dir):
    return frontier.reserve(pages_frontier(spark, sf_dir), 20, 1000.0).select("key", "worker", "state", "attempts")


@query(FRONTIER + RESERVED + "select key, case when not taken then 'pending' when added_at % 2 = 0 then 'done' else 'pending' end as state from r")
def frontier_finish(spark, sf_dir):
    f = written(frontier.reserve(pages_frontier(spark, sf_dir), 20, 1000.0), "frontier")
    results = f.where("state = 'running'").select("key", (F.col("added_at") % 2 == 0).alias("ok"), F.lit("error").alias("error"))
    return frontier.finish(f, results).select("key", "state")


@query(FRONTIER + RESERVED + "select key, 'pending' as state from r")
def frontier_reclaim(spark, sf_dir):
    return frontier.reclaim(frontier.reserve(pages_frontier(spark, sf_dir), 20, 1000.0), 3600, 1000.0 + 7200).select("key", "state")


# -- SQL surface ---------------------------------------------------------------------------------------------------


def views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def conforms(name: str, text: str, spark_text: str | None = None) -> None:
    """A query over the read-only SQL entry; DuckDB runs ``text``, Spark its own wording where that differs."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir)
        return readonly.readonly(spark, spark_text or text)

    run.__name__ = name
    query(text)(run)


conforms("sql_inner_join", "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name")
conforms("sql_left_join", "select n_nationkey, count(s_suppkey) as n from nation left join supplier on s_nationkey = n_nationkey group by n_nationkey")
conforms("sql_full_join", "select count(*) as n, count(c_custkey) as left_rows, count(s_suppkey) as right_rows from customer full join supplier on c_custkey = s_suppkey * 3")
conforms("sql_semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 1000)")
conforms("sql_anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
conforms("sql_range_join", "select s_suppkey, count(*) as n from supplier join part on p_size between s_suppkey % 10 and s_suppkey % 10 + 5 and p_partkey % 100 = s_suppkey % 100 group by s_suppkey")
conforms("sql_grouping_sets", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by grouping sets ((l_returnflag), (l_linestatus), ())")
conforms("sql_cube", "select l_returnflag, l_linestatus, count(*) as n from lineitem group by cube (l_returnflag, l_linestatus)")
conforms("sql_rollup", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
conforms("sql_filtered_agg", "select o_orderstatus, count(*) filter (where o_totalprice > 1000) as large, count(distinct o_custkey) as customers from orders group by o_orderstatus")
conforms("sql_ranking", "select o_orderkey, rank() over w as r, dense_rank() over w as d, ntile(4) over (partition by o_orderstatus order by o_orderkey) as q from orders window w as (partition by o_orderstatus order by o_orderdate)", "select o_orderkey, cast(rank() over w as bigint) as r, cast(dense_rank() over w as bigint) as d, cast(ntile(4) over (partition by o_orderstatus order by o_orderkey) as bigint) as q from orders window w as (partition by o_orderstatus order by o_orderdate)")
conforms("sql_lead_lag", "select event_id, lag(event_id) over (partition by user_id order by ts, event_id) as before, lead(event_id) over (partition by user_id order by ts, event_id) as after from events")
conforms("sql_range_frame", "select event_id, count(*) over (partition by event_type order by ts range between interval 1 hour preceding and current row) as n from events")
conforms("sql_qualify", "select o_custkey, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r = 1")
conforms("sql_intersect_except", "select c_nationkey as k from customer intersect select s_nationkey from supplier except select n_nationkey from nation where n_regionkey = 1")
conforms("sql_union", "select c_nationkey as k, c_name as name from customer union select s_nationkey, s_name from supplier")
conforms("sql_strings", "select p_partkey, upper(p_name) as u, length(p_brand) as n, replace(p_type, ' ', '_') as t, substr(p_name, 2, 4) as s, concat(p_brand, '/', p_type) as c from part", "select p_partkey, upper(p_name) as u, cast(length(p_brand) as bigint) as n, replace(p_type, ' ', '_') as t, substr(p_name, 2, 4) as s, concat(p_brand, '/', p_type) as c from part")
conforms("sql_dates", "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, cast(date_trunc('month', o_orderdate) as date) as first from orders", "select o_orderkey, cast(year(o_orderdate) as bigint) as y, cast(month(o_orderdate) as bigint) as m, cast(date_trunc('month', o_orderdate) as date) as first from orders")
conforms("sql_json", "select event_id, json_extract_string(props, '$.k') as k from events", "select event_id, get_json_object(props, '$.k') as k from events")
conforms("sql_recursive", "with recursive days(d, n) as (select min(cast(ts as date)), 0 from events union all select d + 1, n + 1 from days where n < 29) select d, (select count(*) from events where cast(ts as date) = d) as n from days", "with recursive days(d, n) as (select min(cast(ts as date)), 0 from events union all select date_add(d, 1), n + 1 from days where n < 29), e as (select cast(ts as date) as day, count(*) as c from events group by 1) select d, coalesce(c, 0) as n from days left join e on d = day")
conforms("sql_pivot", "select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'view') as view from events group by user_id", "select user_id, coalesce(click, 0) as click, coalesce(view, 0) as view from (select user_id, event_type from events) pivot (count(*) for event_type in ('click' as click, 'view' as view))")
conforms(
    "sql_unpivot", "select r_regionkey, what, said from (unpivot (select r_regionkey, r_name as name, upper(r_name) as upper from region) on name, upper into name what value said)",
    "select r_regionkey, what, said from (select r_regionkey, r_name as name, upper(r_name) as upper from region) unpivot (said for what in (name, upper))",
)
conforms(
    "sql_lateral", "select n_name, t.c_custkey from nation, lateral (select c_custkey from customer where c_nationkey = n_nationkey order by c_acctbal desc, c_custkey limit 2) t",
)
conforms(
    "sql_arrays",
    "select o_custkey, list_sort(list(o_orderkey)) as orders, len(list(o_orderkey)) as n, list_sum(list_transform(list(o_orderkey), lambda x: x % 7))::bigint as s, list_contains(list(o_orderkey % 5), 0) as fifth from orders group by o_custkey",
    "select o_custkey, sort_array(collect_list(o_orderkey)) as orders, cast(size(collect_list(o_orderkey)) as bigint) as n, aggregate(transform(collect_list(o_orderkey), x -> x % 7), 0L, (a, x) -> a + x) as s, array_contains(collect_list(o_orderkey % 5), 0L) as fifth from orders group by o_custkey",
)
conforms(
    "sql_maps", "select c_custkey, map(['name', 'segment'], [c_name, c_mktsegment])['segment'] as segment, cardinality(map(['name', 'segment'], [c_name, c_mktsegment]))::bigint as n from customer",
    "select c_custkey, map('name', c_name, 'segment', c_mktsegment)['segment'] as segment, cast(cardinality(map('name', c_name, 'segment', c_mktsegment)) as bigint) as n from customer",
)
conforms(
    "sql_math", "select p_partkey, round(sqrt(p_retailprice), 6) as r, floor(p_retailprice)::bigint as f, ceil(p_retailprice)::bigint as c, abs(p_size - 25) as a, sign(p_size - 25)::int as s, round(ln(p_retailprice), 6) as l, round(power(p_size, 2), 6) as p, p_size % 7 as m from part",
    "select p_partkey, round(sqrt(p_retailprice), 6) as r, floor(p_retailprice) as f, ceil(p_retailprice) as c, abs(p_size - 25) as a, cast(sign(p_size - 25) as int) as s, round(ln(p_retailprice), 6) as l, round(power(p_size, 2), 6) as p, p_size % 7 as m from part",
)
# approximate aggregates, held to their stated error against the exact ones
conforms(
    "sql_approximate", "select l_returnflag, count(distinct l_partkey) as parts, true as near_distinct, true as near_median from lineitem group by l_returnflag",
    # percentile(x, q) <= p, of an element p of x, where more than the ceiling of q * (n - 1) elements are up to p; the other bound likewise
    """with d as (select l_returnflag, count(distinct l_partkey) as parts from lineitem group by l_returnflag),
    a as (select l_returnflag, approx_count_distinct(l_partkey, 0.01) as near, approx_percentile(l_extendedprice, 0.5, 1000) as median from lineitem group by l_returnflag),
    r as (select /*+ broadcast(a) */ a.l_returnflag, first(near) as near, count(l_extendedprice) as n, count_if(l_extendedprice < median) as below, count_if(l_extendedprice <= median) as upto
      from lineitem l join a on l.l_returnflag <=> a.l_returnflag group by a.l_returnflag)
    select /*+ broadcast(r) */ d.l_returnflag, parts, abs(near - parts) <= 0.05 * parts as near_distinct,
      case when n > 0 then ceil(0.498D * (n - 1)) < upto and floor(0.502D * (n - 1)) >= below end as near_median
    from d join r on d.l_returnflag <=> r.l_returnflag""",
)
conforms("sql_subquery", "select p_partkey from part where p_retailprice > (select avg(p_retailprice) from part)")


@query("""select l.event_id, r.o_orderkey from (select event_id, user_id, ts from events) l
asof left join (select o_custkey as user_id, date_add(max(o_orderdate), interval 8400 day) as ts, max(o_orderkey) as o_orderkey from orders group by o_custkey, o_orderdate) r on l.user_id = r.user_id and l.ts >= r.ts""")
def asof_join(spark, sf_dir):
    left = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.expr("o_orderdate + interval 8400 days").alias("ts")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return readonly.asof_join(left, right, "user_id", "ts", ["o_orderkey"]).select("event_id", "o_orderkey")


@query("select * from (select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 5), (select count(*) as row_count from orders)")
def query_summary(spark, sf_dir):
    views(spark, sf_dir)
    return readonly.summarise(readonly.readonly(spark, "select o_orderkey, o_totalprice from orders"), ["o_orderkey"])


@query("select 'count' as probe, count(*)::double as value from lineitem union all select 'one column', round(avg(l_quantity), 6) from lineitem union all select 'two columns', count(*) from lineitem where l_discount > 0.02 union all select 'all columns', count(distinct l_orderkey) from lineitem")
def column_probes(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    probe = lambda name, df, value: df.agg(F.lit(name).alias("probe"), value.cast("double").alias("value"))
    return (
        probe("count", li, F.count(F.lit(1))).unionByName(probe("one column", li, F.round(F.avg("l_quantity"), 6)))
        .unionByName(probe("two columns", li.where("l_discount > 0.02"), F.count(F.lit(1)))).unionByName(probe("all columns", li, F.count_distinct("l_orderkey")))
    )


@query("""select unnest(['uncompressed', 'snappy', 'zstd']) as codec, count(*) as n, sum(l_orderkey)::bigint as orders, sum(l_partkey)::bigint as parts,
  sum(cast(l_extendedprice as decimal(18,2)))::decimal(38,2) as price, count(distinct l_shipdate) as days, sum(length(l_returnflag))::bigint as flags from lineitem""")
def codec_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    out = []
    for codec in ("uncompressed", "snappy", "zstd"):
        path = new_path(spark, codec)
        li.write.option("compression", codec).parquet(path)
        columns = [
            F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"), F.sum("l_partkey").alias("parts"),
            F.sum(money("l_extendedprice", 2)).cast("decimal(38,2)").alias("price"), F.count_distinct("l_shipdate").alias("days"),
            F.sum(F.length("l_returnflag")).alias("flags"),
        ]
        out.append(spark.read.parquet(path).agg(F.lit(codec).alias("codec"), *columns))
    return union(spark, out, "codec string, n long, orders long, parts long, price decimal(38,2), days long, flags long")


@query("select unnest(['uncompressed', 'snappy', 'zstd']) as codec, count(*) as rows, true as measured from lineitem")
def codec_sizes(spark, sf_dir):
    measured = codecs.measure(table(spark, sf_dir, "lineitem"), new_path(spark, "codecs"), "l_quantity")
    told = (F.col("bytes") > 0) & (F.col("write_s") > 0) & (F.col("narrow_s") > 0) & (F.col("full_s") > 0)
    return measured.select("codec", "rows", told.alias("measured"))


# -- sources, periods and state, called as their users call them -----------------------------------------------------


@query("""select event_type as symbol, event_id as trade_count, date_trunc('milliseconds', ts) as open_time, ts as close_time, value as open, value * 2 as volume
from events""")
def kline_archives(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumns({
        "cell": F.floor(F.col("event_id") / 50_000), "opened": F.unix_millis(F.col("ts").cast("timestamp")),
        "closed": F.unix_micros(F.col("ts").cast("timestamp")), "twice": F.col("value") * 2,
    })  # milliseconds and microseconds, as archives of different years have them

    def zipped(rows):
        lines = "".join(f"{o},{v!r},0,0,0,{w!r},{c},0,{k},0,0,{t}\n" for o, v, w, c, k, t in zip(
            rows["opened"], rows["value"], rows["twice"], rows["closed"], rows["event_id"], rows["event_type"], strict=True))
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("klines.csv", lines)
        return pd.DataFrame({"path": [str(rows["event_type"].iloc[0])], "content": [data.getvalue()]})

    archives = written(e.groupBy("event_type", "cell").applyInPandas(zipped, "path string, content binary"), "archives")
    rows = klines.parse(archives)
    types = e.select(F.col("event_id").alias("trade_count"), F.col("event_type").alias("symbol"))
    return rows.join(types, "trade_count").select("symbol", "trade_count", "open_time", "close_time", "open", "volume")


@query("select o_orderkey as hash, o_custkey as block_number, o_orderpriority as sender, o_totalprice as value from orders where o_orderkey % 3 <> 0")
def chain_extract(spark, sf_dir):
    root = new_path(spark, "extracts")
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("hash"), F.col("o_custkey").alias("block_number"), F.col("o_orderpriority").alias("from"), F.lit("x").alias("to"),
        F.col("o_totalprice").alias("value"), F.lit(1).alias("gas_used"), (F.col("o_orderkey") % 3 == 0).alias("is_synthetic"), F.lit(2).alias("other"),
    )
    aside = new_path(spark, "extract")
    o.write.parquet(aside)
    fs, p = file_system(spark, aside)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(path(f"{root}/symbol=ETH"))
    for k, f in enumerate(s.getPath() for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet")):
        fs.rename(f, path(f"{root}/symbol=ETH/eth_transactions_{k}.parquet"))
    back = chain.read(spark, root, "eth", "transactions")
    return back.select("hash", "block_number", F.col("`from`").alias("sender"), "value")


@query("select event_id, user_id, event_type from events order by event_id limit 20")
def sample_records(spark, sf_dir):
    sample = discovery.sample_json(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id"))
    lines = spark.createDataFrame([(x,) for x in sample], "line string")
    return lines.select(F.from_json("line", "event_id long, user_id long, event_type string").alias("r")).select("r.*")


@query("""with d as (select min(cast(ts as date)) as day from events)
select 'copy' as dataset, count(*) as rows, strftime(min(cast(ts as date)), '%Y-%m-%d') as time_min, count(*) as rows_back, min(ts) as first_ts, sum(event_id)::bigint as ids
from events, d where cast(ts as date) = d.day""")
def archived_day(spark, sf_dir):
    day = str(table(spark, sf_dir, "events").agg(F.min(F.to_date("ts"))).first()[0])
    out = f"{new_path(spark, 'archive')}/copy"
    for _ in range(2):  # the second call publishes in the place of the first
        entry = layers.archive_day(spark, dated_events(spark, sf_dir), out, day, "ts")
    back = spark.read.parquet(f"{out}/date={day}").agg(F.count(F.lit(1)).alias("rows_back"), F.min("ts").alias("first_ts"), F.sum("event_id").alias("ids"))
    told = [F.lit(entry[c]).alias(c) for c in ("dataset", "time_min")]
    return back.select(*told, F.lit(entry["rows"]).cast("long").alias("rows"), "rows_back", "first_ts", "ids")


@query("""with t as (select cast(o_orderdate as date) as date, l_partkey as token, o_custkey as f, l_suppkey as t, cast(l_extendedprice as decimal(38,2)) as v
           from lineitem join orders on l_orderkey = o_orderkey where cast(o_orderdate as date) between date '1995-03-01' and date '1995-09-30'),
legs as (select date, f as address, token, t as other, -v as s from t union all select date, t, token, f, v from t)
select date, address, count(*) as transfer_count, count(distinct other) as counterparty_count, cast(sum(s) as decimal(38,2)) as net_flow from legs group by date, address having count(*) >= 1""")
def addr_flow_range(spark, sf_dir):
    flow = flows.addr_flow_1d(transfers(spark, sf_dir), "1995-03-01", "1995-09-30", min_transfers=1)
    return flow.select("date", "address", "transfer_count", "counterparty_count", "net_flow")


@query("select (event_id % 5)::int as batch, max(max(ts)) over (order by event_id % 5) as resume from events group by event_id % 5")
def resume_points(spark, sf_dir):
    e, point, out = table(spark, sf_dir, "events"), None, []
    for k in range(5):
        point = pump.resume_point(e.where(F.col("event_id") % 5 == k), "ts", point)
        out.append((k, point))
    return spark.createDataFrame(out, "batch int, resume timestamp_ntz")


@query("select o_orderkey, o_totalprice, count(*) over () as row_count, true as truncated from (select o_orderkey, o_totalprice from orders order by o_orderkey limit 100)")
def readonly_run(spark, sf_dir):
    views(spark, sf_dir)
    out = readonly.run(spark, "select o_orderkey, o_totalprice from orders order by o_orderkey", max_rows=100, max_seconds=600.0)
    rows = [(r["o_orderkey"], r["o_totalprice"], out["row_count"], out["truncated"]) for r in out["rows"]]
    return spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, row_count long, truncated boolean")


@query("select substr(sha256('GET ' || url || ' '), 1, 32) as key, min(page_id) as added_at from pages group by url having max(page_id % 2) = 1 and min(page_id % 2) = 1")
def frontier_add_again(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("url", F.lit("get").alias("method"), F.lit(None).cast("string").alias("payload"), F.col("page_id").alias("added_at"))
    known = written(frontier.add(None, p.where("added_at % 2 = 0"), 3), "frontier")
    return frontier.add(known, p, 3).select("key", "added_at")


@query("with s as (select event_type, count(*) as n, sum(event_id) as size, cast(sum(cast(value as decimal(18,4))) as double) as s from events group by event_type) select event_type, round(n / greatest(s, 1e-9), 9) as rows_per_s, round(size / 1e6 / greatest(s, 1e-9), 9) as mb_per_s from s")
def throughput(spark, sf_dir):
    sums = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("size"), F.sum(money("value")).cast("double").alias("s"))
    rates = sums.select("event_type", *rollups.throughput(F.col("n"), F.col("size"), F.col("s")))
    return rates.withColumns({c: F.round(c, 9) for c in ("rows_per_s", "mb_per_s")})


# -- paged sources, holding, versions ------------------------------------------------------------------------------


@query("""with o as (select o_orderkey % 6 as page, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total from orders group by 1),
calls(call, status, first, past, position) as (values (1, 'max_pages', 0, 2, '2'), (2, 'max_records', 2, 3, '3'), (3, 'exhausted', 3, 6, 'null'), (4, 'already_exhausted', 6, 6, 'null'))
select call, status, (past - first)::bigint as pages, coalesce((select sum(n) from o where page >= first and page < past), 0)::bigint as records, position,
  (select sum(n) from o where page < past)::bigint as stored, (select cast(sum(total) as decimal(38,2)) from o where page < past) as stored_total from calls""")
def paged_pump(spark, sf_dir):
    """Six pages of orders, drained in calls that end by pages, by records, and at the end; a fourth asks nothing."""
    pages, out, checkpoint = (new_path(spark, x) for x in ("pages", "pumped", "cursor"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_orderkey") % 6).cast("int").alias("page"))
    o.repartition(6, "page").write.partitionBy("page").parquet(pages)
    source, schema = paged.ParquetPages(spark, pages), "o_orderkey long, o_totalprice double"

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/part={number}")  # a page that comes again takes its own place

    told = []
    for call, bounds in enumerate(({"max_pages": 2}, {"max_records": 1}, {"pages_per_batch": 2}, {}), 1):
        r = paged.pump_pages(spark, source, schema, checkpoint, sink, **bounds)
        stored = spark.read.schema(schema).parquet(out).agg(F.count(F.lit(1)), F.sum(money("o_totalprice", 2)).cast("decimal(38,2)")).first()
        told.append((call, r["status"], r["pages"], r["records"], r["cursor"]["position"], *stored))
    return spark.createDataFrame(told, "call int, status string, pages long, records long, position string, stored long, stored_total decimal(38,2)")


@query("""with o as (select o_orderkey % 6 as page, count(*) as n from orders group by 1)
select page + 1 as pages, sum(n) over (order by page)::bigint as records, page = 5 as exhausted, case page when 5 then 'exhausted' else '' end as stop from o""")
def cursor_rows(spark, sf_dir):
    """The cursor's rows after a drain of a page at a time."""
    pages, checkpoint = new_path(spark, "pages"), new_path(spark, "cursor")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 6).cast("int").alias("page"))
    o.repartition(6, "page").write.partitionBy("page").parquet(pages)
    paged.pump_pages(spark, paged.ParquetPages(spark, pages), "o_orderkey long", checkpoint, lambda batch, number: batch.count())
    return paged.cursor_rows(spark, checkpoint).select("pages", "records", "exhausted", "stop")


@query("""with v(visit, lo, hi) as (values (0, 0, 1), (1, 1, 2), (2, 2, 0)), m(mode, bound_s) as (values ('exact', null), ('bounded', 86400))
select mode, bound_s, visit, (select count(*) from events where event_id % 3 in (lo, hi))::bigint as fetched,
  (select count(*) from events where event_id % 3 <= visit + 1)::bigint as stored, (select count(*) from events where event_id % 3 <= visit + 1)::bigint as known from v, m""")
def watch_bounded(spark, sf_dir):
    """Visits that each bring two thirds of the events, watched exactly and with a bound on what is remembered, by watchers of their own."""
    e, told, visits = table(spark, sf_dir, "events"), [], new_path(spark, "visits")
    watchers = [(mode, bound, new_path(spark, "watched"), new_path(spark, "seen")) for mode, bound in (("exact", None), ("bounded", 86400))]
    part, files = F.col("event_id") % 3, max(2, layers.source_bytes(e) // (2 * layers.TASK_BYTES))  # two, or more where events are large
    for k in range(3):
        e.where((part == k) | (part == (k + 1) % 3)).repartition(files).write.mode("append").parquet(visits)
        for mode, bound, out, checkpoint in watchers:
            r = pump.watch(spark, visits, e.schema, checkpoint, out, "event_id", "ts", bound)
            told.append((mode, r["remember_s"], k, r["fetched"], r["stored"], r["known"]))
    return spark.createDataFrame(told, "mode string, bound_s int, visit int, fetched long, stored long, known long")


@query("""with f(part, reason, lo, hi, batches) as (values (0, 'count', 0, 0, 1), (2, 'age', 1, 2, 2), (3, 'size', 3, 3, 1))
select part::bigint as part, reason, batches, (select count(*) from events where event_id % 4 between lo and hi)::bigint as rows,
  (select count(*) from events where event_id % 4 between lo and hi)::bigint as rows_back, (select max(ts) from events where event_id % 4 between lo and hi) as last_ts from f""")
def held_append(spark, sf_dir):
    """Four arrivals: the first is flushed by its count, the next two wait until they are old enough, the last is flushed by its size."""
    e, arrived, out, checkpoint = table(spark, sf_dir, "events"), *(new_path(spark, x) for x in ("records", "appended", "cursor"))
    never = {"flush_bytes": 1 << 60, "flush_rows": 1 << 60, "flush_age_s": 600}
    calls = [(0, 0, {"flush_rows": 1}), (1, 10, {}), (2, 500, {}), (None, 620, {}), (3, 700, {"flush_bytes": 1})]
    for arrival, now, bounds in calls:
        if arrival is not None:
            e.where(F.col("event_id") % 4 == arrival).repartition(2).write.mode("append").parquet(arrived)
        held = holding.Holding(spark, out, e.schema, "ts", clock=lambda now=now: now, **(never | bounds))
        flushed = holding.append_held(held, arrived, checkpoint)
    back = spark.read.parquet(out).groupBy(F.col("part").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("rows_back"), F.max("ts").alias("last_ts"))
    return flushed.select("part", "reason", "batches", "rows").join(back, "part")


@query("""with e as (select count(*) filter (event_id % 2 = 0) as even, count(*) as whole from events)
select step, seen, even_ as rows from (select 1 as step, 1 as seen, even as even_ from e union all select 2, 1, even from e union all select 3, 2, whole from e union all select 4, 3, even from e)""")
def publish_versions(spark, sf_dir):
    """What a reader sees when a version is published, while another is staged, after its pointer is switched, and after a third."""
    e, path, told = table(spark, sf_dir, "events"), f"{new_path(spark, 'published')}/events", []
    even = e.where(F.col("event_id") % 2 == 0)

    def look(step: int) -> None:
        told.append((step, versions.pointers(spark, path)[0][0], versions.read(spark, path).count()))

    versions.publish(even, path)
    look(1)
    folder, _ = versions.stage(e, path)
    look(2)
    versions.switch(spark, path, folder)
    look(3)
    versions.publish(even, path)
    look(4)
    return spark.createDataFrame(told, "step int, seen int, rows long")


@query("""with m as (select distinct strftime(ts, '%Y-%m') as month from events), c(call) as (values (1), (2)), w as (select month from m union all select '1970-01')
select call, month, case when month = '1970-01' then 'missing' when call = 1 then 'written' else 'skipped' end as status,
  (select count(*) from events where strftime(ts, '%Y-%m') = month)::bigint as rows from w, c""")
def kline_loads(spark, sf_dir):
    """Archives of all months of events, a folder each, and of one that is not there, loaded twice."""
    root, out = new_path(spark, "archives"), new_path(spark, "market")
    e = table(spark, sf_dir, "events").select("ts", "value", "event_id")
    at, value, k = (F.coalesce(c.cast("string"), F.lit("")) for c in (F.unix_millis(F.col("ts").cast("timestamp")), F.col("value"), F.col("event_id")))
    line = F.concat_ws(",", at, value, *[F.lit("0")] * 4, at, F.lit("0"), k, *[F.lit("0")] * 3)

    def zipped(batches):
        """Months arrive one after another; of each archive only the zip is held, not its lines.

        The text writer ends each row by a line end, which is the zip's comment.
        """
        month, data, z, member, lines = None, None, None, None, 0

        def finished():
            member.close()
            z.comment = b"\n"
            z.close()
            return pd.DataFrame({"month": [month], "content": [data.getvalue()[:-1]]})

        for batch in batches:
            for name, rows in batch.groupby("month", sort=False, dropna=False):
                name = None if pd.isna(name) else name
                if lines and (name != month or lines >= ARCHIVE_LINES):
                    yield finished()
                    lines = 0
                if not lines:
                    month, data = name, io.BytesIO()
                    z = zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED)
                    member = z.open("klines.csv", "w", force_zip64=True)
                member.write("".join(f"{x}\n" for x in rows["line"]).encode())
                lines += len(rows)
        if lines:
            yield finished()

    # ranges of time, about an archive each: a month is zipped, and its zips are read, by as many tasks as it needs
    tasks = max(1, min(layers.TASKS, -(-e.count() // ARCHIVE_LINES)))
    dealt = e.repartitionByRange(tasks, "ts", "event_id").sortWithinPartitions("ts").select(F.date_format("ts", "yyyy-MM").alias("month"), line.alias("line"))
    archives = dealt.mapInPandas(zipped, "month string, content binary").select("month", F.col("content").cast("string").alias("value"))
    archives.write.partitionBy("month").option("maxRecordsPerFile", 1).option("compression", "none").text(root)  # a zip a file
    folders = [name for name in children(spark, root) if name.startswith("month=")]
    months = [(None if name.endswith("=__HIVE_DEFAULT_PARTITION__") else name.removeprefix("month="), f"{root}/{name}") for name in folders]
    wanted, told = [*months, ("1970-01", f"{root}/none.zip")], []
    for call in (1, 2):
        told += [(call, r["month"], r["status"]) for r in klines.load(spark, wanted, "EVT", "1m", out).collect()]
    back = spark.read.parquet(out).groupBy(F.col("date").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("rows"))
    calls = spark.createDataFrame(told, "call int, month string, status string")
    return calls.join(back, "month", "left").select("call", "month", "status", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"))


@query("""with b as (select url as key, arg_max(html, page_id) as html from pages where html is not null group by url),
k as (select key, html from b order by sha256(key) limit 10)
select key, sha256(html) as sha256, case when strlen(html) <= 2048 then 'inline' else 'large' end as place, md5(html) as got_md5 from k""")
def blob_lookup(spark, sf_dir):
    """Ten blobs found by their keys and read from the files that hold them."""
    pages = table(spark, sf_dir, "pages").where("html is not null")
    put = pages.select(F.col("url").alias("key"), F.lit("text/html").alias("content_type"), F.encode("html", "UTF-8").alias("data"), F.col("page_id").alias("put"))
    path = new_path(spark, "blobs")
    blobs.pack(put, path, 2048)
    keys = [r[0] for r in put.select("key").distinct().orderBy(F.sha2("key", 256)).limit(10).collect()]
    got = blobs.get(spark, path, keys).select("key", F.md5("data").alias("got_md5"))
    return blobs.locate(spark, path, keys).select("key", "sha256", "place").join(got, "key")


@query("""select cast(o_orderdate as date) as date, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as decimal(38,2)) as total
from orders where cast(o_orderdate as date) between date '1994-11-28' and date '1996-02-03' group by 1""")
def scan_range(spark, sf_dir):
    """A range over two year ends, read by the least cover of years, months and days."""
    root = new_path(spark, "ledger/orders")
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), "o_orderkey", "o_totalprice")
    layers.write(o, root, ["date"], "o_orderkey")
    rows = dated.scan_range(spark, root, "1994-11-28", "1996-02-03")
    return rows.groupBy(F.col("date").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.sum(money("o_totalprice", 2)).cast("decimal(38,2)").alias("total"))


@query("""with n as (select event_type, count(*) as rows from events group by event_type)
select event_type, rows, 6 as before, 1 as after from n""")
def compacted_tree(spark, sf_dir):
    """A folder of six files a type, all rewritten by one job."""
    root = new_path(spark, "tree")
    e = table(spark, sf_dir, "events").drop("props")
    spread = e.withColumn("cell", F.pmod(F.xxhash64("event_id"), F.lit(6)).cast("int"))
    for cell in range(6):
        spread.where(F.col("cell") == cell).drop("cell").repartition("event_type").write.mode("append").partitionBy("event_type").parquet(root)

    def files():
        kind = F.regexp_extract("path", "event_type=([^/]+)", 1).alias("event_type")
        return discovery.inventory(spark, root).groupBy(kind).agg(F.count(F.lit(1)).cast("int").alias("files"))

    before = written(files(), "before")
    report = compact.compact(spark, root, "ts")
    if report["failed"] or report["jobs"] != 1:
        raise RuntimeError(str(report))
    rows = spark.read.parquet(root).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
    both = before.withColumnRenamed("files", "before").join(files().withColumnRenamed("files", "after"), "event_type")
    return rows.join(both, "event_type")


@query("""with s as (select o_custkey, cast(floor(sum(cast(o_totalprice as decimal(18,2))) * 1000) as bigint) as bytes from orders group by 1)
select o_custkey, bytes, case when bytes < 209715200 then 1 else greatest(cast(round_even(bytes / 314572800.0, 0) as bigint), cast(ceil(bytes / 524288000.0) as bigint)) end as files,
  bytes < 209715200 as small from s""")
def file_plan(spark, sf_dir):
    """Files of a dataset a customer, planned at once, and held against the plan of each size by itself."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.floor(F.sum(money("o_totalprice", 2)) * 1000).cast("long").alias("bytes"))
    planned = o.select("o_custkey", "bytes", layers.files_of(F.col("bytes")).alias("files"), (F.col("bytes") < layers.LEAST_BYTES).alias("small"))

    def alone(batches):
        for b in batches:
            if any(layers.plan_files(n)[0] != f for n, f in zip(b["bytes"].tolist(), b["files"].tolist(), strict=True)):
                raise ValueError("the plans differ")
            yield b

    return planned.mapInPandas(alone, planned.schema)
