"""Rules that a query over tables does not show: refusals, faults, restarts and plans."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from tidelake.functions import scalars as S
from tidelake.operators import compact, flows, frontier, ranges, rollups
from tidelake.operators import write as layers
from tidelake.plans import sql as readonly
from tidelake.scratch import file_system, new_path
from tidelake.sources import chain, dated, discovery, klines
from tidelake.streaming import pump


@pytest.mark.parametrize("text", ["select 1", "with x as (select 1 as a) select a from x", "(select 1)", "values (1)", "select 1 union select 2", "select explode(array(1, 2))", "select upper('a'), count(*) over w from range(2) window w as (partition by id)", "select x from range(3) as t(x) lateral view explode(array(1)) e as y"])
def test_guard_accepts(spark, text):
    readonly.guard(spark, text)


@pytest.mark.parametrize("text", ["drop table x", "create table x as select 1", "insert into x values (1)", "with a as (select 1) insert into x select * from a", "select 1; drop table x", "set a=b", "cache table x", "refresh table x", "nonsense", "", "explain select 1", "show tables", "create temporary view v as select 1"])
def test_guard_refuses(spark, text):
    with pytest.raises(readonly.Refused):
        readonly.guard(spark, text)


@pytest.mark.parametrize(
    "text",
    [
        "select java_method('java.lang.System', 'setProperty', 'x.y', 'z')", "select reflect('java.lang.System', 'exit', 0)", "select 1 where try_reflect('a', 'b') is null",
        "select * from (select 1 as a) order by java_method('java.lang.System', 'gc')", "with t as (select reflect('a', 'b') as c) select c from t",
        "select (select max(reflect('a', 'b')) from range(2))", "select sum(id) over w from range(3) window w as (order by reflect('a', 'b'))", "select own_function(1)", "select abs(1)",
        "select * from parquet.`/tmp/x`", "select * from `/tmp/x`", "select transform(a) using 'cat' as (b) from (select 1 as a)", "select identifier('abs')(1)",
        "select * from identifier('x')", "execute immediate 'select 1'", "select rand()", "select input_file_name()",
    ],
)
def test_guard_refuses_what_does_more_than_read(spark, text):
    other = spark.newSession()  # with functions of its own, one of them under a built-in name
    for name in ("own_function", "abs"):
        other.udf.register(name, lambda x: x, "int")
    with pytest.raises(readonly.Refused):
        readonly.guard(other, text)


def test_run_caps_rows_and_hides_nan(spark):
    out = readonly.run(spark, "select id, double('NaN') as x from range(20)", max_rows=5)
    assert out["truncated"] and out["row_count"] == 5 and out["columns"] == ["id", "x"]
    assert all("x" not in r for r in out["rows"])


def test_mounting(spark):
    root = new_path(spark, "market")
    assert discovery.mount_views(spark, root) == []
    spark.createDataFrame([(1.0, "a")], "close double, symbol0 string").write.parquet(f"{root}/symbol=BTC-X/interval=1m")
    spark.createDataFrame([(2, "a")], "close int, symbol0 string").write.mode("append").parquet(f"{root}/symbol=BTC-X/interval=1m")
    assert discovery.mount_views(spark, root) == ["market_btc_x_1m"]
    assert discovery.mount_views(spark, root) == ["market_btc_x_1m"]


def test_files_of_one_folder_are_united_by_name(spark):
    root = new_path(spark, "market")
    kinds = ["close double, a string", "close int, b long", "close string"]
    for kind, row in zip(kinds, [(1.5, "x"), (2, 7), ("3", )], strict=True):
        spark.createDataFrame([row], kind).coalesce(1).write.mode("append").parquet(f"{root}/symbol=ETH/interval=1h/deeper")
    assert discovery.mount_views(spark, root) == ["market_eth_1h"]
    rows = spark.table("market_eth_1h").orderBy("close").collect()
    assert [(r["close"], r["a"], r["b"], r["symbol"], r["interval"]) for r in rows] == [("1.5", "x", None, "ETH", "1h"), ("2", None, 7, "ETH", "1h"), ("3", None, None, "ETH", "1h")]


def test_trees_under_one_root_have_names_of_their_own(spark):
    root = new_path(spark, "data")
    one = spark.range(1).coalesce(1)
    for tree in ("market/symbol=BTC/interval=1m", "hypersync_output/symbol=ETHEREUM", "other-tree/day=1", "day=2"):
        one.write.parquet(f"{root}/{tree}")
    one.write.parquet(f"{root}/plain")
    fs, p = file_system(spark, f"{root}/plain")
    path = spark._jvm.org.apache.hadoop.fs.Path
    for s in fs.listStatus(p):
        if s.getPath().getName().endswith(".parquet"):
            fs.rename(s.getPath(), path(f"{root}/plain/a-file.v1.parquet"))
    made = discovery.mount_views(spark, root)
    assert made == ["a_file_v1", "chain_ethereum", "data_2", "market_btc_1m", "other_tree_1"] and all(spark.table(v).count() == 1 for v in made)


def test_union_widens(spark):
    a, b = spark.createDataFrame([(1, "x")], "v int, a string"), spark.createDataFrame([("2", 3)], "v string, b long")
    out = discovery.union_by_name([a, b])
    assert dict(out.dtypes) == {"v": "string", "a": "string", "b": "bigint"} and out.count() == 2
    with pytest.raises(ValueError):
        discovery.strict_concat([a, b])


def test_dated(spark):
    with pytest.raises(ValueError):
        dated.scan(spark, "/nowhere", "2024-1")
    with pytest.raises(ValueError):
        dated.days_between(spark, "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        dated.register_all(spark, "/nowhere", [("eth", "blocks")], "")
    days = spark.createDataFrame([(datetime.date(2024, 1, 1), 10, True)], "day date, bytes long, present boolean")
    with pytest.raises(ValueError):
        dated.within_budget(days, days.limit(0).select("day"), 5)
    assert dated.within_budget(days, days.select("day"), 5).count() == 0
    assert dated.last_months(spark, 3).count() == 3


def test_klines(spark, tmp_path):
    lines = [f"{1735689600000000 + k * 60_000_000},1,2,0.5,1.5,10,{1735689659999999 + k * 60_000_000},15,3,5,7.5,0" for k in (2, 0, 1)]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("k.csv", "\n".join(lines))
    archive = tmp_path / "BTC-1m-2025-01.zip"
    archive.write_bytes(data.getvalue())
    out = new_path(spark, "market")
    wanted = [("2025-01", str(archive)), ("2025-02", str(tmp_path / "none.zip"))]
    assert {r["month"]: r["status"] for r in klines.load(spark, wanted, "BTC", "1m", out).collect()} == {"2025-01": "written", "2025-02": "missing"}
    assert {r["status"] for r in klines.load(spark, wanted, "BTC", "1m", out).collect()} == {"skipped", "missing"}
    rows = spark.read.parquet(out).orderBy("open_time").collect()
    assert len(rows) == 3 and rows[0]["open_time"] == datetime.datetime(2025, 1, 1) and "ignore" not in rows[0].asDict()


def test_both_epochs_are_one_instant(spark):
    rows = spark.createDataFrame([(1735689600000,), (1735689600000000,)], "t long").select(S.epoch_to_timestamp(F.col("t")).alias("t")).distinct().collect()
    assert [r["t"] for r in rows] == [datetime.datetime(2025, 1, 1)]


def test_layers():
    assert layers.dataset_path("/r", "L2", name="addr_flow_1d", date="2024-01") == "/r/features/name=addr_flow_1d/date=2024-01"
    with pytest.raises(ValueError):
        layers.dataset_path("/r", "L1", **{"Bad": "x"})
    assert layers.plan_files(100 * layers.MIB)[0] == 1 and layers.plan_files(100 * layers.MIB)[1]
    assert layers.plan_files(3000 * layers.MIB) == (10, None)
    with pytest.raises(ValueError):
        layers.plan_files(0)
    with pytest.raises(ValueError):
        layers.Source("x", mode="poll", partition_keys=("day",), time_column="t")
    with pytest.raises(ValueError):
        layers.Source("x", mode="in_place")
    layers.Source("x", mode="poll", partition_keys=("day",), time_column="t", strategy="watch")


def test_nothing_empty_is_published(spark):
    path = f"{new_path(spark, 'archive')}/d"
    layers.publish(spark.range(3).toDF("v"), path)
    with pytest.raises(ValueError):
        layers.publish(spark.range(0).toDF("v"), path)
    assert spark.read.parquet(path).count() == 3


def test_a_publish_that_was_cut_off_is_undone(spark):
    path = f"{new_path(spark, 'archive')}/d"
    layers.publish(spark.range(3).toDF("v"), path)
    fs, p = file_system(spark, path)
    fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/_previous-d"))  # ended between both renames
    with pytest.raises(ValueError):
        layers.publish(spark.range(0).toDF("v"), path)
    assert spark.read.parquet(path).count() == 3
    assert layers.publish(spark.range(5).toDF("v"), path) == 5 and spark.read.parquet(path).count() == 5
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/_previous-d"))


def test_one_day_with_all_rows_is_many_files(spark):
    path = new_path(spark, "days")
    rows = spark.range(4000).select(F.lit("2024-01-01").alias("date"), F.col("id").alias("ts"))
    layers.write(rows, path, ["date"], "ts", files=4)
    assert discovery.inventory(spark, path).count() == 4
    assert layers.planned(rows, 3000 * layers.MIB) == 10
    assert layers.planned(rows, 10 * 1024**4) == layers.plan_files(10 * 1024**4)[0] == 34_953  # more than there are shuffle partitions
    spans = [spark.read.parquet(r["path"]).agg(F.min("ts"), F.max("ts")).first() for r in discovery.inventory(spark, path).collect()]
    spans = sorted((a, b) for a, b in spans)
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


def test_days_smaller_than_a_file_are_one_file_each(spark):
    """Also where all of them make several files, and where one of them does; no task sorts many days."""
    rows = spark.range(4000).select(F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 8).cast("string").alias("date"), F.col("id").alias("ts"))
    small = rows.where("ts >= 2000")
    for name, part, files, many in (("small", small, 3, 1), ("large", rows, 4, 2)):
        path, seen = new_path(spark, name), Observation()
        layers.write(part, path, ["date"], "ts", files=files, size=700 * layers.MIB, seen=seen)
        made = discovery.inventory(spark, path).groupBy(F.regexp_extract("path", "date=([^/]*)", 1).alias("d")).count().collect()
        assert {r["d"]: r["count"] for r in made} == {str(k): 1 if k else many for k in range(8)}
        assert spark.read.parquet(path).count() == seen.get["rows"] == part.count()
    path = new_path(spark, "one-file")
    layers.write(small, path, ["date"], "ts", size=160 * layers.MIB)  # planned as one file
    names = [r["path"].rsplit("/", 1)[1][:10] for r in discovery.inventory(spark, path).collect()]
    assert len(names) == 8 and len(set(names)) > 2  # several tasks wrote them


@pytest.mark.parametrize("size", [layers.LEAST_BYTES, layers.GOAL_BYTES, layers.MOST_BYTES, 449 * layers.MIB, 451 * layers.MIB, 749 * layers.MIB, 10**12 + 7])
def test_planned_files_are_near_the_goal(size):
    n, warning = layers.plan_files(size)
    assert warning is None and size / n <= layers.MOST_BYTES and (n == 1 or size / n >= layers.LEAST_BYTES)


def test_rows_are_counted_beyond_the_progress_that_spark_keeps(spark):
    pages, cursor, out = new_path(spark, "pages"), new_path(spark, "cursor"), new_path(spark, "out")
    df = spark.range(0, 220, 1, 110).toDF("i")
    df.write.parquet(pages)
    assert discovery.inventory(spark, pages).count() > 100
    assert pump.pump_to(spark, pages, df.schema, cursor, out, pages_per_batch=1)["rows"] == 220


def test_rolling_mean_over_ranges(spark):
    rows = spark.range(300).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("t"), (F.col("id") * 7 % 11).cast("double").alias("v"))
    line = {k: [(r["t"], r["v"]) for r in rows.where(F.col("k") == k).orderBy("t").collect()] for k in (0, 1)}
    for preceding, tasks in ((5, 7), (40, 60), (400, 3)):  # also frames over several ranges
        dealt = ranges.in_ranges(rows, ["k", "t"], tasks)
        assert dealt.select(ranges.RANGE).distinct().count() > 1
        every = ranges.with_borders(dealt, ["k", "t"], preceding)
        w = Window.partitionBy(ranges.RANGE, "k").orderBy("t").rowsBetween(-preceding, 0)
        got = {r["t"]: r["m"] for r in every.withColumn("m", F.avg("v").over(w)).where("not _guest").collect()}
        for k in (0, 1):
            for i, (t, _) in enumerate(line[k]):
                frame = [v for _, v in line[k][max(0, i - preceding) : i + 1]]
                assert abs(got[t] - sum(frame) / len(frame)) < 1e-9
        assert len(got) == 300
    assert rollups.rolling_mean(rows, "k", ["t"], "v", 5).count() == 300 and rollups.rolling_mean(rows.limit(0), "k", ["t"], "v", 5).count() == 0


def test_compaction_faults(spark):
    root = new_path(spark, "small")
    for part in ([5, 1, 9], [7, 2]):
        spark.createDataFrame([(t, str(t)) for t in part], "ts long, v string").coalesce(1).write.mode("append").parquet(root)
    paths = [r["path"] for r in discovery.inventory(spark, root).select("path").collect()]
    assert compact.compact_group(spark, paths, "ts", dry_run=True)["rows"] == 5
    with pytest.raises(RuntimeError):
        compact.compact_group(spark, paths, "ts", count=lambda df: 4)
    assert discovery.inventory(spark, root).count() == 2  # the inputs are still there
    with pytest.raises(ValueError):
        compact.compact_group(spark, paths[:1], "ts")
    compact.compact_group(spark, paths, "ts")
    assert [r["ts"] for r in spark.read.parquet(root).collect()] == [1, 2, 5, 7, 9]
    other = new_path(spark, "drift")
    spark.createDataFrame([(1, "a")], "ts long, v string").coalesce(1).write.parquet(other)
    spark.createDataFrame([(1, "a", 2)], "ts long, v string, extra long").coalesce(1).write.mode("append").parquet(other)
    assert len(compact.compact(spark, other, "ts")["failed"]) == 1


@pytest.mark.parametrize("mode", ["compact", "alone"])
def test_a_group_is_sorted_by_several_tasks_and_still_one_file(spark, monkeypatch, mode):
    root = new_path(spark, "large")
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 7919 % 20011).alias("ts"), F.md5(F.col("id").cast("string")).alias("v"))
    rows.repartition(5).write.parquet(root)
    paths = [r["path"] for r in discovery.inventory(spark, root).select("path").collect()]
    monkeypatch.setattr(compact, "SORT_BYTES", 200_000)
    asked, once = [], compact._in_pieces
    monkeypatch.setattr(compact, "_in_pieces", lambda *a: asked.append(a[2]) or once(*a))
    report = compact.compact(spark, root, "ts") if mode == "compact" else compact.compact_group(spark, paths, "ts")
    back = spark.read.parquet(root)
    assert report["files"] == 5 and asked and asked[0] > 2 and not report.get("failed")
    assert discovery.inventory(spark, root).count() == 1 and back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    at = [r["ts"] for r in back.orderBy("_metadata.row_index").select("ts").collect()]
    assert at == sorted(at)


def test_compaction_stream(spark):
    root, cursor = new_path(spark, "arrivals"), new_path(spark, "cursor")
    spark.range(100).toDF("ts").repartition(4).write.parquet(root)
    assert compact.watch(spark, root, cursor, "ts", pending_bytes=1)["compactions"] == 1
    assert spark.read.parquet(root).count() == 100 and discovery.inventory(spark, root).count() == 1
    assert compact.watch(spark, root, cursor, "ts", pending_bytes=1)["compactions"] == 0


def test_pump_moves_the_cursor_last(spark):
    pages, cursor = new_path(spark, "pages"), new_path(spark, "cursor")
    df = spark.range(6).toDF("i")
    df.repartition(3).write.parquet(pages)
    got = []

    def failing(batch, n):
        if n == 1:
            raise RuntimeError("sink")
        got.extend(r["i"] for r in batch.collect())

    with pytest.raises(Exception):
        pump.pump(spark, pages, df.schema, cursor, failing)
    done = len(got)
    pump.pump(spark, pages, df.schema, cursor, lambda b, n: got.extend(r["i"] for r in b.collect()))
    assert sorted(got) == list(range(6)) and 0 < done < 6
    assert pump.pump(spark, pages, df.schema, cursor, failing)["batches"] == 0


def test_resume_point_never_retreats(spark):
    df = spark.createDataFrame([(9,), (10,)], "t long")
    assert pump.resume_point(df, "t", None) == 10 and pump.resume_point(df, "t", 11) == 11 and pump.resume_point(df.limit(0), "t", 3) == 3


def test_buffered_append(spark):
    arrived, out, cursor = new_path(spark, "records"), new_path(spark, "out"), new_path(spark, "cursor")
    df = spark.createDataFrame([(3, "a"), (1, "b"), (None, None)], "ts long, v string")
    df.write.parquet(arrived)
    report = pump.buffered_append(spark, arrived, df.schema, cursor, out, "ts")
    assert report[0]["rows"] == 2 and report[0]["undersized"]


def test_frontier(spark):
    c = spark.createDataFrame([("http://a", "get", None, 1), ("http://a", "GET", None, 2), ("http://b", "get", None, 3)], "url string, method string, payload string, added_at long")
    f = frontier.add(None, c, 2)
    assert f.count() == 2 and frontier.add(f, c, 2).count() == 0
    r = frontier.reserve(f, 1, 10.0)
    parts = [frontier.add(None, c, 2, worker=w).count() for w in (0, 1)]
    assert sum(parts) == 2
    with pytest.raises(KeyError):
        frontier.finish(r, spark.createDataFrame([("x", True, None)], "key string, ok boolean, error string"))
    stale = frontier.reclaim(r.withColumn("attempts", F.lit(3)), 5, 100.0)
    assert stale.where("state = 'failed'").count() == r.where("state = 'running'").count()


def test_flow_of_a_self_transfer(spark):
    t = spark.createDataFrame([("2024-01-01", "t", "a", "a", 5), ("2024-01-01", "t", None, "b", 0)], "date string, token_address string, from_address string, to_address string, value int")
    t = t.withColumns({"date": F.to_date("date"), "value": F.col("value").cast("decimal(38,2)")})
    r = {x["address"]: x for x in flows.addr_flow_1d(t, min_transfers=1).collect()}
    assert (r["a"]["transfer_count"], float(r["a"]["net_flow"]), float(r["a"]["inflow"])) == (2, 0, 5)
    assert r["b"]["counterparty_count"] == 0 and r[None]["transfer_count"] == 1


def test_legs_are_exchanged_once_but_for_crowded_addresses(spark, monkeypatch):
    rows = [(f"2024-01-{d:02d}", k % 7, k % 5, 100 + k % 11, k - 20) for d in (1, 2) for k in range(60)] + [("2024-01-01", 1, None, 100, None)]
    t = spark.createDataFrame(rows, "date string, token_address long, from_address long, to_address long, value long")
    t = t.withColumns({"date": F.to_date("date"), "value": F.col("value").cast("decimal(18,2)")})
    monkeypatch.setattr(flows, "TASK_LEGS", 50)
    want = sorted(map(str, flows.addr_flow_1d(t, min_transfers=1).collect()))
    assert flows.addr_flow_1d(t, min_transfers=1)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    monkeypatch.setattr(flows, "CROWD_LEGS", 9)  # five senders of a day are crowded, its receivers are not
    assert sorted(map(str, flows.addr_flow_1d(t, min_transfers=1).collect())) == want and len(want) == 33
    assert flows.addr_flow_1d(t.limit(0)).count() == 0


def test_flow_reads_five_columns(spark, sf_dir):
    path = new_path(spark, "transfers")
    spark.range(5).select(F.current_date().alias("date"), *[F.col("id").alias(c) for c in ("token_address", "from_address", "to_address", "other")], F.col("id").cast("decimal(38,0)").alias("value")).write.parquet(path)
    plan = flows.addr_flow_1d(spark.read.parquet(path), "2024-01-01", "2099-01-01")._jdf.queryExecution().toString()
    assert "other" not in plan.split("ReadSchema")[1].split(">")[0] and "PushedFilters: [IsNotNull(date)" in plan and "Cartesian" not in plan


def test_denied_calls_use_nothing(spark):
    t = [datetime.datetime(2024, 1, 1, 0, 0, s) for s in range(5)] + [datetime.datetime(2024, 1, 1, 0, 1, 0)]
    calls = spark.createDataFrame([("u", x, k) for k, x in enumerate(t)], "user_id string, time timestamp_ntz, call_id int")
    r = rollups.quota_usage(calls, 2, 3).first()
    assert (r["accepted"], r["denied"]) == (3, 3)


def test_synthetic_rows_are_marked(spark):
    df = chain.synthetic(spark, 10, 20)
    assert df.count() == 1000 and df.where("not is_synthetic").count() == 0 and chain.block_range(df, 10, 12).where("block_number > 12").count() == 0


def test_near_median_by_counts_is_near_median_by_percentiles(spark, sf_dir):
    from tidelake import queries as lake

    plan = lake.QUERIES["sql_approximate"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert " percentile(" not in plan  # which takes all values of a flag to one task
    spark.range(500).selectExpr("id % 3 as g", "id * 37 % 101 as x").unionAll(spark.sql("select 9L, 5L")).createOrReplaceTempView("spread")
    rows = spark.sql(
        """with b as (select g, count(*) as n, percentile(x, 0.498) as lo, percentile(x, 0.502) as hi, percentile(x, 0.3) as lo3, percentile(x, 0.7) as hi3 from spread group by g),
        p as (select distinct g, x as p from spread)
        select b.g, p, n, first(lo) <= p and p <= first(hi) as inside, first(lo3) <= p and p <= first(hi3) as inside3, count_if(x < p) as below, count_if(x <= p) as upto
        from p join b on p.g = b.g join spread s on s.g = p.g group by b.g, p, n"""
    )
    met = lambda q, to: F.expr(f"ceil({q}D * (n - 1)) < upto and floor({to}D * (n - 1)) >= below")
    assert rows.where(met(0.498, 0.502) != F.col("inside")).count() == rows.where(met(0.3, 0.7) != F.col("inside3")).count() == 0 < rows.where("inside").count()
