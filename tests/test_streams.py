"""Streams over several micro-batches, restarts and retries."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from adlattice import catalog
from adlattice.operators import chains, profiles, shared
from adlattice.streaming import sightings as ST

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def folder(tmp_path):
    return lambda name: str(tmp_path / f"{name}-{uuid.uuid4().hex}")


def put(spark, path, rows):
    frame = spark.createDataFrame([(u, e, DAY + dt.timedelta(minutes=m)) for u, e, m in rows], "user_id long, event_type string, ts timestamp")
    frame.coalesce(1).write.mode("append").parquet(path)
    return frame.schema


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_toggles_keep_their_state_over_a_restart(spark, folder):
    source, out, state = folder("in"), folder("out"), folder("state")
    first = [(1, "a", 0), (1, "a", 1), (1, "a", 2), (2, "a", 0), (3, "b", 0)]
    schema = put(spark, source, first)
    put(spark, source, [(2, "a", 3)])
    ST.toggle_stream(stream(spark, source, schema), out, state).awaitTermination()
    assert {tuple(r) for r in ST.toggles_on(spark, out).collect()} == {(1, "a"), (3, "b")}
    put(spark, source, [(1, "a", 9), (2, "a", 9), (4, "c", 9), (4, "c", 9)])
    ST.toggle_stream(stream(spark, source, schema), out, state).awaitTermination()  # a new query on the same checkpoint
    assert {tuple(r) for r in ST.toggles_on(spark, out).collect()} == {(2, "a"), (3, "b")}


def test_toggles_are_kept_by_built_in_state(spark, folder):
    source, out, state = folder("in"), folder("out"), folder("state")
    schema = put(spark, source, [(1, "a", 0), (None, "a", 0), (2, None, 0), (None, None, 0)])
    put(spark, source, [(1, "a", 1), (1, "a", 2), (None, None, 1), (3, "b", 1), (3, "b", 2)])
    query = ST.toggle_stream(stream(spark, source, schema), out, state)
    query.awaitTermination()
    # no call of Python for each pair
    assert {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]} == {"stateStoreSave"}
    assert sorted(map(str, map(tuple, ST.toggles_on(spark, out).collect()))) == sorted(map(str, [(1, "a"), (None, "a"), (2, None)]))


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_upsert_writes_only_the_buckets_of_a_batch(spark, folder):
    source, out, state = folder("in"), folder("out"), folder("state")
    rows = [(u, "a", u) for u in range(300)]
    schema = put(spark, source, rows)
    run = lambda: ST.upsert_stream(stream(spark, source, schema), out, state, "user_id", ["event_type"], buckets=16).awaitTermination()
    run()
    assert len([f for f in files(f"{out}/v=0")]) == 16
    for n in (1, 2, 3):
        put(spark, source, [(7, "b", 1000 * n), (7, "b", -n)])
        run()
        assert len(files(f"{out}/v={n}")) == 1  # one key, one bucket
    got = {r.user_id: r for r in ST.snapshot(spark, out).collect()}
    assert len(got) == 300 and got[7].impressions == 7 and got[7].first_seen == DAY - dt.timedelta(minutes=3) and got[7].last_seen == DAY + dt.timedelta(minutes=3000)
    assert got[8].impressions == 1
    # what no manifest names any more is gone: of key 7's bucket the versions 2 and 3 are left
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(7).cast("long")), F.lit(16)).alias("b")).first().b
    assert {int(f.split("/v=")[1].split("/")[0]) for f in files(out) if f"bucket={bucket}/" in f} == {2, 3}
    assert sorted(d for d in os.listdir(f"{out}/manifest") if d.startswith("n=")) == ["n=2", "n=3"]


def test_a_retried_upsert_batch_leaves_the_same_table(spark, folder, monkeypatch):
    source, out, state = folder("in"), folder("out"), folder("state")
    schema = put(spark, source, [(1, "a", 0), (2, "a", 0)])
    put(spark, source, [(1, "a", 5), (3, "a", 6)])
    kept = ST.store.merge_counts
    calls = []

    def once_broken(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return kept(*args)

    monkeypatch.setattr(ST.store, "merge_counts", once_broken)
    with pytest.raises(Exception, match="lost"):
        ST.upsert_stream(stream(spark, source, schema), out, state, "user_id", ["event_type"], buckets=2).awaitTermination()
    ST.upsert_stream(stream(spark, source, schema), out, state, "user_id", ["event_type"], buckets=2).awaitTermination()
    assert {r.user_id: r.impressions for r in ST.snapshot(spark, out).collect()} == {1: 2, 2: 1, 3: 1}


def test_sliding_windows_are_given_once_and_drop_late_rows(spark, folder):
    source, out, state = folder("in"), folder("out"), folder("state")
    schema = put(spark, source, [(1, "a", 30), (1, "a", 90)])
    put(spark, source, [(1, "a", 60 * 24 * 5)])
    put(spark, source, [(1, "a", 60 * 24 * 5 + 1)])
    put(spark, source, [(1, "a", 31), (1, "a", 60 * 24 * 5 + 2)])  # four days behind
    rows = ST.sliding(stream(spark, source, schema), "1 day")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {(r.start - DAY).total_seconds() / 3600: r.n for r in spark.read.parquet(out).collect() if r.start < DAY + dt.timedelta(days=2)}
    assert got == {-23.0: 1, **{float(h): 2 for h in range(-22, 1)}, 1.0: 1}


def test_sessions_are_given_once_they_are_over(spark, folder):
    source, out, state = folder("in"), folder("out"), folder("state")
    schema = put(spark, source, [(1, "a", 0), (1, "a", 20), (1, "a", 60), (2, "a", 10)])
    put(spark, source, [(1, "a", 80), (1, "a", 300)])
    rows = ST.sessions(stream(spark, source, schema), "30 minutes", watermark="1 minute")
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = {(r.user_id, (r.start - DAY).seconds // 60, (r.end - DAY).seconds // 60, r.n) for r in spark.read.parquet(out).collect()}
    assert got == {(1, 0, 50, 2), (1, 60, 110, 2), (2, 10, 40, 1)}  # the one from 300 on may still grow


def test_redirects_are_followed_by_doubling(spark):
    edges = [("s", "a", 301), ("a", "b", 302), ("b", "c", 307), ("c", "d", 308), ("d", "e", 303), ("e", "f", 301)]  # a path
    edges += [("x", "y", 301), ("y", "z", 301), ("z", "y", 301), ("q", "q", 301)]  # a cycle with a tail, a loop
    edges += [("m", "n", 200), ("two", "zz", 301), ("two", "aa", 301), ("bogus", "s", 301), ("to_bogus", "bogus", 301), (None, "a", 301), ("k", None, 301)]
    frame = spark.createDataFrame(edges, "from_url string, to_url string, status int")
    starts = spark.createDataFrame([(u,) for u in ("s", "c", "x", "q", "m", "two", "to_bogus", "nowhere", None, "s", "k")], "url string")
    got = {r.url: (r.final, r.hops, r.chain) for r in chains.follow(frame, starts, 15, lambda u: u == "bogus").collect()}
    assert got["s"] == ("f", 6, list("sabcdef")) and got["c"] == ("f", 3, list("cdef"))
    assert got["x"] == ("z", 2, list("xyz")) and got["q"] == ("q", 0, ["q"]) and got["m"] == ("m", 0, ["m"])
    assert got["two"][0] == "aa" and got["to_bogus"][0] == "bogus" and got["nowhere"] == ("nowhere", 0, ["nowhere"]) and got["k"][1] == 0
    assert len(got) == 9
    for most in (1, 2, 3, 5):
        assert chains.follow(frame, starts, most).where("url = 's'").first().hops == most
    long = spark.createDataFrame([(f"u{i}", f"u{i + 1}") for i in range(40)], "from_url string, to_url string")
    assert {r.url: r.final for r in chains.follow(long, long.select(F.col("from_url").alias("url")), 15).collect()} == {f"u{i}": f"u{min(40, i + 15)}" for i in range(40)}


def test_samples_and_targets(spark):
    sites = spark.createDataFrame([(f"s{i}", f"n{i % 3}") for i in range(60)] * 2 + [(None, "n0"), ("x", None)], "site string, niche string")
    niches = spark.createDataFrame([("US", "n0"), ("US", "n1"), ("US", "n1"), ("DE", "n2"), ("DE", "none")], "geo string, niche string")
    got = profiles.sample_sites(sites, niches, 4, "1").collect()
    assert {(r.geo, r.niche) for r in got} == {("US", "n0"), ("US", "n1"), ("DE", "n2")} and len(got) == 12
    assert sorted(map(str, got)) == sorted(map(str, profiles.sample_sites(sites.repartition(7), niches, 4, "1").collect()))
    assert {r.site for r in got} != {r.site for r in profiles.sample_sites(sites, niches, 4, "2").collect()}
    pages = spark.createDataFrame([("https://a.com/1", "x Taboola"), ("https://b.com/1", "plain"), ("https://c.com/1", "mgid"), ("https://d.com/g", "mgid")], "url string, html string")
    links = spark.createDataFrame([("https://a.com/1",), ("https://b.com/1",), ("https://c.com/1",), ("https://d.com/g?GOOGLE",), ("ftp://a.com",), (None,), ("https://a.com/1",)], "link string")
    known = spark.createDataFrame([("https://c.com/",)], "site string")
    assert [r.site for r in profiles.discover_targets(links, pages, known, ["google"], ["taboola", "mgid"]).collect()] == ["https://a.com/"]


def test_rows_are_numbered_in_ranges(spark):
    ids = [*range(0, 3000, 3), *range(10**12, 10**12 + 500), -5, 2**40, None]
    frame = spark.createDataFrame([(x, f"p{x}") for x in ids], "id long, text string").repartition(7)
    for ranges in (1, 7, 256):
        rows = shared.numbered(frame, "id", "i", ranges).collect()
        order = sorted(x for x in ids if x is not None) + [None]
        assert {r.i: (r.id, r.text) for r in rows} == {i: (x, f"p{x}") for i, x in enumerate(order)} and len(rows) == len(ids)
    assert shared.numbered(frame.where("false"), "id", "i").count() == 0
    assert [r.i for r in shared.numbered(frame.where("id is null"), "id", "i").collect()] == [0]


def test_no_task_holds_all_pages_of_the_targets(spark, sf_dir):
    plan = catalog.queries()["a14_targets"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line]
    # the one that isn't within ranges sums their counts
    assert windows and all("_range" in w for w in windows) and "row_number() windowspecdefinition(page_id" not in plan


def test_matches_of_ads_by_hand(spark):
    rows = [(i, "g1", t, n, 1, d) for i, t, n, d in ((1, "A long title of an ad", "x", 1), (2, " a LONG title of  an ad ", "y", 2), (3, "See: A long title of an ad!", "x", 3), (4, "other", None, 4), (5, "other", "x", 5))]
    rows += [(6, "g2", "A long title of an ad", "z", None, 1), (7, None, "other", "q", 1, 1), (8, "g2", "See: A long title of an ad!", "z", 1, 2), (9, "g2", None, "z", 1, 3)]
    frame = spark.createDataFrame(rows, "id long, advertiser string, title string, network string, impressions int, created_day int")
    got = {r.id: r for r in profiles.intelligence(frame, "advertiser", 3, 2).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 8, 9}
    assert [m.id for m in got[1].matches] == [2, 6, 3] and got[1].match_networks == ["x", "y", "z"] and got[1].cross_network
    assert [m.id for m in got[3].matches] == [8, 1, 2] and [m.id for m in got[6].matches] == [1, 2, 8]
    assert [m.id for m in got[4].matches] == [5, 7] and [x.id for x in got[4].recent] == [5, 4] and got[4].total == 5 and got[4].days == 4
    assert got[9].matches == [] and not got[9].cross_network


def test_scratch_folders_are_removed(spark):
    path = shared.scratch(spark, "some")
    spark.range(1).write.parquet(path)
    shared.remove(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
    shared.remove(spark, path)
