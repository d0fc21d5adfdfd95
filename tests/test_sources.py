"""Paged sources, holding, versions, compaction in one job, footers of other stores, ranges and lookups: faults, bounds and plans."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from tidelake.operators import blobs, compact, frontier, ranges, versions
from tidelake.operators import write as layers
from tidelake.plans import sql as readonly
from tidelake.scratch import children, file_system, new_path, put_text
from tidelake.sources import dated, discovery, klines
from tidelake.streaming import holding, paged, pump


class Numbers:
    """Pages of three numbers; refuses page 2 as often as a file counts down from, and fails at ``broken``."""

    first = 0

    def __init__(self, pages, refusals=None, broken=None):
        self.pages, self.refusals, self.broken = pages, refusals, broken

    def peek(self, position):
        if position == 2 and self.refusals:
            with open(self.refusals) as f:
                left = int(f.read())
            if left:
                with open(self.refusals, "w") as f:
                    f.write(str(left - 1))
                raise paged.RateLimited(0.01)
        return paged.Page(3, position + 1 if position + 1 < self.pages else None)

    def fetch(self, position):
        if position == self.broken:
            raise ValueError("this page is broken")
        return iter([(3 * position + k,) for k in range(3)])


def drain(spark, pages, checkpoint, got, **bounds):
    return paged.pump_pages(spark, pages, "i long", checkpoint, lambda b, n: got.extend(r["i"] for r in b.collect()), **bounds)


def test_pages_are_drained_to_bounds_and_never_again(spark):
    checkpoint, got = new_path(spark, "cursor"), []
    assert paged.cursor(spark, checkpoint) is None
    r = drain(spark, Numbers(7), checkpoint, got, max_pages=2)
    assert (r["status"], r["pages"], r["records"], sorted(got)) == ("max_pages", 2, 6, list(range(6)))
    r = drain(spark, Numbers(7), checkpoint, got, max_records=4)
    assert (r["status"], r["pages"], r["records"]) == ("max_records", 2, 6)  # the page that reaches the bound is the last
    r = drain(spark, Numbers(7), checkpoint, got, deadline_s=0.0)
    assert r["status"] == "deadline"
    r = drain(spark, Numbers(7), checkpoint, got, pages_per_batch=10)
    assert r["status"] == "exhausted" and set(got) == set(range(21)) and r["cursor"]["records"] == 21
    r = drain(spark, Numbers(7), checkpoint, got)
    assert (r["status"], r["pages"]) == ("already_exhausted", 0)


def test_pages_of_a_refusing_source(spark, tmp_path):
    refusals, checkpoint, got = tmp_path / "left", new_path(spark, "cursor"), []
    refusals.write_text("5")
    r = drain(spark, Numbers(4, str(refusals)), checkpoint, got, retries=1)
    assert (r["status"], r["pages"], sorted(got)) == ("rate_limited", 2, list(range(6)))
    r = drain(spark, Numbers(4, str(refusals)), checkpoint, got, retries=1)
    assert (r["status"], r["pages"]) == ("rate_limited", 0)
    r = drain(spark, Numbers(4, str(refusals)), checkpoint, got, retries=5)
    assert (r["status"], sorted(got)) == ("exhausted", list(range(12)))


def test_a_broken_page_or_sink_leaves_the_cursor(spark):
    checkpoint, got = new_path(spark, "cursor"), []
    with pytest.raises(Exception, match="broken"):
        drain(spark, Numbers(4, broken=2), checkpoint, got)
    assert paged.cursor(spark, checkpoint)["pages"] == 2 and sorted(got) == list(range(6))

    def failing(batch, number):
        raise RuntimeError("sink")

    with pytest.raises(Exception, match="sink"):
        paged.pump_pages(spark, Numbers(4), "i long", checkpoint, failing)
    assert paged.cursor(spark, checkpoint)["pages"] == 2
    assert drain(spark, Numbers(4), checkpoint, got)["status"] == "exhausted" and sorted(got) == list(range(12))
    source = paged.FetchedPages(lambda p: ([(p,)], p + 1 if p < 2 else None))
    assert drain(spark, source, new_path(spark, "cursor"), got)["records"] == 3


def test_seen_ids_are_forgotten_only_with_a_bound(spark):
    for bound in (None, 1):
        visits, out, cursor = (new_path(spark, x) for x in ("visits", "out", "cursor"))
        for k in range(3):
            spark.createDataFrame([(1, k), (2 + k, k)], "id long, t long").write.mode("append").parquet(visits)
            r = pump.watch(spark, visits, spark.read.parquet(visits).schema, cursor, out, "id", "t", bound)
            if bound:
                import time

                time.sleep(2.5)
        assert r["remember_s"] == bound and (r["known"] == 4 if bound is None else r["known"] < 4)
        assert r["stored"] == 4 if bound is None else r["stored"] >= 5  # 1 was forgotten and came again


@pytest.mark.parametrize("bound", [None, 1000])
def test_a_watch_takes_small_files_together_and_opens_few_partitions_of_state(spark, bound):
    """Each batch opens and commits every partition of state, whatever it holds."""
    visits, out, cursor = (new_path(spark, x) for x in ("visits", "out", "cursor"))
    before = {name: spark.conf.get(name) for name in (pump.PROVIDER, pump.PARTITIONS)}
    try:
        spark.conf.set(pump.PARTITIONS, "200")
        for k in range(2):
            spark.range(50 * (k + 1)).select("id", F.lit(k).alias("t")).repartition(5).write.mode("append").parquet(visits)
            r = pump.watch(spark, visits, spark.read.parquet(visits).schema, cursor, out, "id", "t", bound)
            assert (r["fetched"], r["stored"], r["known"]) == (50 * (k + 1),) * 3
        assert spark.conf.get(pump.PARTITIONS) == "200" and spark.conf.get(pump.PROVIDER) == before[pump.PROVIDER]
    finally:
        spark.conf.set(pump.PARTITIONS, before[pump.PARTITIONS])
    assert [n for n in children(spark, f"{cursor}/sources/0") if n.isdigit()] == ["0", "1"]  # a batch a call, and not one a file
    states = [n for n in children(spark, f"{cursor}/state/0") if n.isdigit()]
    assert len(states) == max(pump.LEAST_PARTITIONS, 2 * spark.sparkContext.defaultParallelism)


def test_a_watch_goes_on_with_the_state_that_its_checkpoint_has(spark):
    """Begun with state in memory, a file a batch and five partitions."""
    visits, out, cursor = (new_path(spark, x) for x in ("visits", "out", "cursor"))
    before = {name: spark.conf.get(name) for name in (pump.PROVIDER, pump.PARTITIONS)}
    spark.range(50).repartition(3).write.parquet(visits)
    try:
        spark.conf.set(pump.PROVIDER, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
        spark.conf.set(pump.PARTITIONS, "5")
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(visits).dropDuplicates(["id"])
        begun = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", cursor).trigger(availableNow=True).start()
        begun.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    spark.range(80).repartition(3).write.mode("append").parquet(visits)
    r = pump.watch(spark, visits, spark.range(0).schema, cursor, out, "id", "id")
    assert (r["fetched"], r["stored"], r["known"], r["watermark"]) == (80, 80, 80, 79)


def test_holding_is_exact_after_failures(spark):
    out, schema = new_path(spark, "appended"), "t long"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], schema)
    bounds = {"flush_bytes": 1 << 60, "flush_rows": 4, "flush_age_s": 1e9, "clock": lambda: 0.0}
    h = holding.Holding(spark, out, rows(1).schema, "t", **bounds)
    h.arrive(rows(3, 1), 0)
    h.arrive(rows(3, 1), 0)  # the batch comes again
    assert h.due() is None and h.held()[0]["rows"] == 2 and h.flushes().count() == 0
    # lost between writing a part and entering it in the ledger: the part is made anew, nothing is twice
    rows(1, 3).write.parquet(f"{out}/part=0")
    h.arrive(rows(2, 5), 1)
    assert [tuple(r) for r in h.flushes().select("part", "reason", "rows", "batches").collect()] == [(1, "count", 4, 2)]
    assert sorted(r["t"] for r in spark.read.parquet(out).select("t").collect()) == [1, 2, 3, 5] and children(spark, f"{out}/_held") == []
    h.arrive(rows(2, 5), 1)  # the batch of the flush comes again
    assert spark.read.parquet(out).count() == 4
    # lost between the ledger and the deletion: what waits in it is not written again
    rows(7).write.parquet(f"{out}/_held/batch=2")
    put_text(spark, f"{out}/_ledger/held-2", '{"rows": 1, "bytes": 9, "at": 0}')
    rows(7).write.parquet(f"{out}/part=2")
    put_text(spark, f"{out}/_ledger/flushed-2", '{"reason": "age", "rows": 1, "bytes": 9, "batches": [2], "undersized": true}')
    h.arrive(rows(8, None), 3)
    assert h.flush()["rows"] == 1 and sorted(r["t"] for r in spark.read.parquet(out).select("t").collect()) == [1, 2, 3, 5, 7, 8]
    assert h.flush() is None and h.flush_due() is None


def test_bounds_of_a_row_do_not_make_files_of_a_row(spark):
    """What is flushed at once has files by size, not by the bound that made it due."""
    for name, bounds in (("rows", {"flush_rows": 1, "flush_bytes": 1 << 60}), ("bytes", {"flush_rows": 1 << 60, "flush_bytes": 1})):
        out = new_path(spark, name)
        h = holding.Holding(spark, out, spark.range(1).schema, "id", flush_age_s=1e9, **bounds)
        h.arrive(spark.range(300), 0)
        assert spark.read.parquet(out).count() == 300 and discovery.inventory(spark, f"{out}/part=0").count() == 1


def test_versions_are_whole_at_every_step(spark, monkeypatch):
    path = f"{new_path(spark, 'published')}/d"
    with pytest.raises(FileNotFoundError):
        versions.current(spark, path)
    versions.publish(spark.range(3).toDF("v"), path)
    seen = lambda: versions.read(spark, path).count()
    steps = []
    for name in ("stage", "switch", "tidy"):
        def watched(*a, step=getattr(versions, name), **k):
            steps.append(seen())
            made = step(*a, **k)
            steps.append(seen())
            return made

        monkeypatch.setattr(versions, name, watched)
    versions.publish(spark.range(5).toDF("v"), path)
    monkeypatch.undo()
    assert steps == [3, 3, 3, 5, 5, 5]
    with pytest.raises(ValueError):
        versions.publish(spark.range(0).toDF("v"), path)
    put_text(spark, f"{path}/_current/9", "")  # a writer that was lost at its pointer
    assert seen() == 5
    folder, _ = versions.stage(spark.range(6).toDF("v"), path)
    assert versions.switch(spark, path, folder) == 10 and seen() == 6
    assert versions.publish(spark.range(7).toDF("v"), path)["version"] == 11 and seen() == 7
    assert len([n for n in children(spark, path) if n.startswith("_v-")]) == versions.KEPT


def tree(spark, folders):
    root = new_path(spark, "tree")
    for k in range(folders):
        for n in range(3):
            spark.createDataFrame([(10 - n, f"{k}-{n}")], "ts long, v string").coalesce(1).write.mode("append").parquet(f"{root}/k={k}")
    return root


def test_compaction_jobs_do_not_grow_with_groups(spark):
    jobs = []
    for folders in (2, 9):
        root, name = tree(spark, folders), f"compact-{folders}"
        spark.sparkContext.setJobGroup(name, name)
        r = compact.compact(spark, root, "ts")
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)))
        spark.sparkContext.setJobGroup("", "")
        assert r == {"groups": folders, "files": 3 * folders, "rows": 3 * folders, "jobs": 1, "failed": []}
        assert discovery.inventory(spark, root).count() == folders and spark.read.parquet(root).count() == 3 * folders
        path = discovery.inventory(spark, root).first()["path"]
        assert [r["ts"] for r in spark.read.parquet(path).collect()] == [8, 9, 10]
    assert jobs[1] <= jobs[0] + 2, jobs


def test_compaction_faults_stay_with_their_group(spark):
    root = tree(spark, 3)
    fs, p = file_system(spark, f"{root}/k=1/bad.parquet")
    out = fs.create(p)
    out.write(bytearray(b"no parquet at all"))
    out.close()
    spark.createDataFrame([(1, "x", 2)], "ts long, v string, more int").coalesce(1).write.mode("append").parquet(f"{root}/k=2")
    r = compact.compact(spark, root, "ts")
    assert r["groups"] == 1 and sorted(f.rsplit("=", 1)[1] for f, _ in r["failed"]) == ["1", "2"]
    assert discovery.inventory(spark, f"{root}/k=0").count() == 1 and discovery.inventory(spark, f"{root}/k=2").count() == 4
    # a job that loses a group's rows deletes nothing of it; one that fails is done group by group
    root = tree(spark, 2)

    def lossy(*a):
        counts = compact._rewrite(*a)
        return counts | {next(iter(counts)): 1}

    r = compact.compact(spark, root, "ts", rewrite=lossy)
    assert r["groups"] == 1 and len(r["failed"]) == 1 and spark.read.parquet(root).count() == 6

    def failing(*a):
        raise RuntimeError("job")

    assert compact.compact(spark, root, "ts", rewrite=failing)["failed"] == [] and spark.read.parquet(root).count() == 6


def test_footers_of_a_store_that_only_spark_knows(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.shop.link./lake", f"file://{tmp_path}")
    root = "viewfs://shop/lake"
    spark.createDataFrame([(1, 2)], "a int, b int").coalesce(1).write.mode("append").parquet(f"{root}/t/date=2024-01-01")
    spark.createDataFrame([(1.5, "x")], "a double, c string").coalesce(1).write.mode("append").parquet(f"{root}/t/date=2024-01-01")
    told = discovery.footers(discovery.inventory(spark, root).select("path")).collect()
    assert {(r["names"], r["rows"], r["fault"]) for r in told} == {("a,b", 1, None), ("a,c", 1, None)} and all(r["path"].startswith("viewfs://") for r in told)
    assert discovery.mount_views(spark, root) == ["t_2024_01_01"]
    assert dict(spark.table("t_2024_01_01").dtypes) | {"date": ""} == {"a": "double", "b": "int", "c": "string", "date": ""}
    (tmp_path / "t2" / "date=2024-01-01").mkdir(parents=True)
    (tmp_path / "t2" / "date=2024-01-01" / "x.parquet").write_bytes(b"no parquet at all")
    assert discovery.mount_views(spark, root) == ["t_2024_01_01"]  # the bad tree does not hide the other
    with pytest.raises(Exception, match="nowhere"):  # a store that cannot be reached is an error
        discovery.footers(spark.createDataFrame([("viewfs://nowhere/x.parquet",)], "path string"))
    with pytest.raises(Exception):
        discovery.footers(spark.createDataFrame([("file:/nowhere/x.parquet",)], "path string"))


def test_asof_join_of_a_hot_key_over_ranges(spark, monkeypatch):
    r = random.Random(4)
    keys = ["hot"] * 200 + ["a", "b", None] * 20
    right = [(k, 10 * n + r.randint(0, 5), n if n % 7 else None) for n, k in enumerate(keys)]
    left = [(r.choice(keys + ["none"]), r.randint(0, 2700), n) for n in range(300)]
    want = []
    for k, t, n in left:
        before = [(rt, v) for rk, rt, v in right if rk == k and rt <= t]
        want.append((n, max(before)[1] if before else None))
    dealt, tasks = ranges.in_ranges, []

    def many(df, order):
        made = dealt(df, order, 13)
        tasks.append(made.where("k = 'hot'").groupBy(ranges.RANGE).count().count())
        return made

    monkeypatch.setattr(ranges, "in_ranges", many)
    out = readonly.asof_join(spark.createDataFrame(left, "k string, t long, n long"), spark.createDataFrame(right, "k string, t long, v long"), "k", "t", ["v"])
    assert sorted((x["n"], x["v"]) for x in out.collect()) == sorted(want)
    assert tasks[0] > 5  # the hot key's rows lie in many ranges


def test_values_carried_over_ranges(spark):
    r = random.Random(1)
    rows = [(k, t, r.choice([None, None, None, t])) for k in "aab" for t in range(0, 40)]
    rows = [(k, 2 * t + n % 2, v) for n, (k, t, v) in enumerate(rows)]
    df = spark.createDataFrame(rows, "k string, t long, v long").dropDuplicates(["k", "t"])
    want, last = [], {}
    for x in sorted(df.collect()):
        last[x["k"]] = x["v"] if x["v"] is not None else last.get(x["k"])
        want.append((x["k"], x["t"], last[x["k"]]))
    for tasks in (1, 5, 31):
        got = ranges.carried(ranges.in_ranges(df, ["k", "t"], tasks), "k", ["t"], "v").select("k", "t", "v")
        assert sorted(map(tuple, got.collect())) == want


def test_reserve_takes_the_oldest_of_a_hot_worker(spark):
    rows = [(f"k{n:04d}", "pending" if n % 5 else "done", n % 17, 0, 0 if n % 10 else 1) for n in range(500)]
    f = spark.createDataFrame(rows, "key string, state string, added_at long, attempts int, worker int")
    got = {x["key"] for x in frontier.reserve(f, 30, 9.0).where("state = 'running'").collect()}
    want = set()
    for w in (0, 1):
        want |= {k for _, k in sorted((a, k) for k, s, a, _, own in rows if own == w and s == "pending")[:30]}
    assert got == want


def test_lookup_opens_only_the_files_of_its_keys(spark):
    path = new_path(spark, "blobs")
    put = spark.range(2000).select(F.format_string("k%05d", "id").alias("key"), F.lit("t").alias("content_type"), F.encode(F.repeat(F.col("id").cast("string"), 50), "UTF-8").alias("data"), F.col("id").alias("put"))
    blobs.pack(put.unionByName(put.where("id < 3").withColumn("data", F.encode(F.repeat(F.lit("x"), 5000), "UTF-8")).withColumn("put", F.lit(9999))), path, 1000, file_bytes=50_000)
    keys = [f"k{n:05d}" for n in range(100, 110)]
    got = blobs.get(spark, path, [*keys, "unknown"])
    assert sorted(r["key"] for r in got.collect()) == keys
    files = {r["file"] for r in blobs.locate(spark, path, keys).collect()}
    assert {os.path.basename(f) for f in got.inputFiles()} == {os.path.basename(f) for f in files}
    assert len(files) <= 2 < discovery.inventory(spark, f"{path}/inline").count()
    assert blobs.get(spark, path, ["k00001"]).first()["data"] == b"x" * 5000 and blobs.locate(spark, path, ["k00001"]).first()["place"] == "large"
    assert blobs.get(spark, path, ["unknown"]).count() == 0


def test_large_blobs_are_a_row_group_each_in_few_files(spark):
    import pyarrow.parquet as pq

    path = new_path(spark, "blobs")
    put = spark.range(300).select(F.format_string("k%05d", "id").alias("key"), F.lit("t").alias("content_type"), F.encode(F.repeat(F.col("id").cast("string"), 500), "UTF-8").alias("data"), F.col("id").alias("put"))
    blobs.pack(put, path, 100)
    files = [r["path"].removeprefix("file:") for r in discovery.inventory(spark, f"{path}/large").where("length > 0").collect()]
    assert len(files) <= 2 and sum(pq.ParquetFile(f).num_row_groups for f in files) == 300
    got = blobs.get(spark, path, ["k00007", "k00299"]).collect()
    assert {r["key"]: bytes(r["data"]) for r in got} == {"k00007": b"7" * 500, "k00299": b"299" * 500}
    assert blobs.read(spark, path).count() == 300


def test_cover_is_exact_and_least():
    assert dated.cover("2023-12-30", "2025-02-02") == ["2023-12-30", "2023-12-31", "2024", "2025-01", "2025-02-01", "2025-02-02"]
    assert dated.cover("2024-01-01", "2024-12-31") == ["2024"] and dated.cover("2024-02-29", "2024-02-29") == ["2024-02-29"] and dated.cover("2024-02-01", "2024-02-29") == ["2024-02"]
    with pytest.raises(ValueError):
        dated.cover("2024-01-02", "2024-01-01")
    r, start = random.Random(0), datetime.date(2019, 1, 1)
    for _ in range(200):
        a = start + datetime.timedelta(r.randint(0, 900))
        b = a + datetime.timedelta(r.randint(0, 900))
        days = [(start + datetime.timedelta(k)).isoformat() for k in range(1900)]
        cover = dated.cover(a.isoformat(), b.isoformat())
        assert [d for d in days if any(d.startswith(c) for c in cover)] == [d for d in days if a.isoformat() <= d <= b.isoformat()]


def test_range_scans_and_copies_list_only_their_folders(spark):
    root, out = f"{new_path(spark, 'lake')}/t", new_path(spark, "copy")
    days = spark.sql("select explode(sequence(date'2023-12-20', date'2024-03-10')) as d").select(F.date_format("d", "yyyy-MM-dd").alias("date"), F.unix_date("d").cast("long").alias("ts"))
    layers.write(days, root, ["date"], "ts")
    rows = dated.scan_range(spark, root, "2023-12-30", "2024-02-02")
    assert rows.count() == 35 and len({f.split("date=")[1][:10] for f in rows.inputFiles()}) == 35
    fs, p = file_system(spark, f"{root}/date=2024-03-05/bad.parquet")
    fs.create(p).close()  # a file that cannot be read, out of the range
    copied = layers.copy_days(spark, root, out, "2023-12-30", "2024-02-02", "ts")
    assert copied.where("status = 'written'").count() == 35
    assert layers.copy_days(spark, root, out, "2023-12-30", "2024-02-02", "ts").where("status = 'skipped'").count() == 35


def test_missing_periods_are_read_once(spark):
    """Each row of the source passes one counter once, whatever is counted afterwards."""
    seen, path = spark.sparkContext.accumulator(0), new_path(spark, "l1/t")

    def passed(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.range(100).select("id", (F.col("id") % 4).cast("string").alias("k")).mapInPandas(passed, "id long, k string")
    wanted = spark.createDataFrame([(str(k),) for k in range(6)], "k string")
    status = {r["k"]: (r["written"], r["status"]) for r in layers.load_missing(wanted, rows, path, "k", "id").collect()}
    assert status == {str(k): (25, "written") if k < 4 else (0, "missing") for k in range(6)}
    assert seen.value == 100
    assert layers.load_missing(wanted, rows, path, "k", "id").where("status = 'skipped'").count() == 4


def test_months_that_broke_off_are_loaded_again(spark, tmp_path):
    import zipfile

    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("k.csv", "1735689600000,1,2,0.5,1.5,10,1735689659999,15,3,5,7.5,0\n")
    out = new_path(spark, "market")
    fs, p = file_system(spark, f"{out}/symbol=B/interval=1m/date=2025-01/_temporary/0")
    fs.mkdirs(p)
    for status in ("written", "skipped"):
        assert klines.load(spark, [("2025-01", str(archive))], "B", "1m", out).first()["status"] == status
    assert spark.read.parquet(out).count() == 1


def kline_zip(path, opened):
    import zipfile

    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("k.csv", "".join(f"{1735689600000 + t},1,2,0.5,1.5,10,1735689659999,15,3,5,7.5,0\n" for t in opened))


def test_a_month_of_many_rows_is_parsed_and_sorted_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(klines, "SORT_ROWS", 100, raising=False)
    for k in range(8):
        kline_zip(tmp_path / f"of january/{k}.zip", range(k, 400, 8))
    kline_zip(tmp_path / "of january/_half/0.zip", [0])
    kline_zip(tmp_path / "february.zip", range(30, 0, -1))
    out = new_path(spark, "market")
    wanted = [("2025-01", str(tmp_path / "of january")), ("2025-02", str(tmp_path / "february.zip")), ("2025-02", str(tmp_path / "february.zip"))]
    assert [r["status"] for r in klines.load(spark, wanted, "B", "1m", out).collect()] == ["written", "written", "skipped"]
    rows = spark.read.parquet(out)
    assert {r["date"]: r["count"] for r in rows.withColumn("date", F.col("date").cast("string")).groupBy("date").count().collect()} == {"2025-01": 400, "2025-02": 30}
    spans = rows.groupBy("date", F.input_file_name().alias("file")).agg(F.min("open_time").alias("a"), F.max("open_time").alias("b")).orderBy("date", "a").collect()
    of_january = [r for r in spans if str(r["date"]).startswith("2025-01")]
    assert len(of_january) > 2 and len(spans) == len(of_january) + 1
    assert all(x["b"] < y["a"] for x, y in zip(of_january, of_january[1:], strict=False))
    for r in spans:
        times = [x[0] for x in spark.read.parquet(r["file"]).select("open_time").collect()]
        assert times == sorted(times)


def test_a_broken_archive_keeps_no_other_month_back(spark, tmp_path):
    (tmp_path / "a.zip").write_bytes(b"no zip")
    kline_zip(tmp_path / "b.zip", [])
    kline_zip(tmp_path / "c.zip", range(3))
    out = new_path(spark, "market")
    wanted = [(f"2025-0{k}", str(tmp_path / f"{name}.zip")) for k, name in enumerate("abcd", 1)]
    with pytest.raises(ValueError, match="BadZipFile.*2025-01; 0 rows for .*2025-02; not published"):
        klines.load(spark, wanted, "B", "1m", out)
    kline_zip(tmp_path / "a.zip", range(2))
    kline_zip(tmp_path / "b.zip", range(1))
    status = [r["status"] for r in klines.load(spark, wanted, "B", "1m", out).collect()]
    assert status == ["written", "written", "skipped", "missing"] and spark.read.parquet(out).count() == 6


def test_kline_archives_of_a_month_are_bounded(spark, sf_dir, monkeypatch):
    import io
    import zipfile

    from tidelake import queries as lake

    given, load = [], klines.load
    monkeypatch.setattr(lake, "ARCHIVE_LINES", 100, raising=False)
    monkeypatch.setattr(klines, "load", lambda spark, wanted, *a: given.append(wanted) or load(spark, wanted, *a))
    lake.QUERIES["kline_loads"](spark, sf_dir)
    zips, lines = spark.read.format("binaryFile").load([archive for month, archive in given[0] if month != "1970-01"]).collect(), 0
    for r in zips:
        with zipfile.ZipFile(io.BytesIO(r["content"])) as z:
            assert z.testzip() is None
            lines += z.read("klines.csv").count(b"\n")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert lines == events and len(zips) >= events // 100 > 1


def test_waiting_bytes_are_known_without_listing(spark, monkeypatch):
    root, cursor, listed = new_path(spark, "arrivals"), new_path(spark, "cursor"), []
    pending = compact.pending
    monkeypatch.setattr(compact, "pending", lambda *a: listed.append(1) or pending(*a))
    made = []
    for k in range(4):
        spark.range(k * 10, k * 10 + 10).toDF("ts").coalesce(1).write.mode("append").parquet(root)
        small = pending(spark, root)
        made.append(compact.watch(spark, root, cursor, "ts", pending_bytes=small if k == 3 else small + 1)["compactions"])
    assert made == [0, 0, 0, 1] and len(listed) == 3  # at the first batch, before and after the compaction
    assert spark.read.parquet(root).count() == 40 and discovery.inventory(spark, root).count() == 1
