"""Alignment, episodes, statistics and media against small models in plain Python."""

import bisect
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import align, episodes, media, offsets, relational, stats


def model(events, t, method):
    times = [e[0] for e in events]
    if not events:
        return None
    if method == "hold":
        i = bisect.bisect_right(times, t) - 1
        return events[i] if i >= 0 else None
    i = bisect.bisect_left(times, t)
    if i == 0:
        return events[0]
    if i == len(events) or times[i] != t and t - times[i - 1] <= times[i] - t:
        return events[i - 1]
    return events[i]


@pytest.mark.parametrize("method", ["hold", "nearest"])
def test_asof_with_ties_and_nulls(spark, method):
    rng = random.Random(4)
    events = {k: sorted((rng.randint(0, 30), s, rng.choice([None, float(s)])) for s in range(rng.randint(0, 12))) for k in range(12)}
    probes = [(k, rng.randint(-2, 33), n) for n, k in enumerate(rng.choices(range(12), k=150))]
    p = spark.createDataFrame(probes, "k int, ts long, n int")
    e = spark.createDataFrame([(k, t, s, v) for k, es in events.items() for t, s, v in es], "k int, ts long, s long, v double")
    got = {r["n"]: (r["v_ts"], r["v"]) for r in align.asof(p, e, ["k"], "ts", ["v"], "s", method).collect()}
    for k, t, n in probes:
        m = model(events[k], t, method)
        assert got[n] == ((m[0], m[2]) if m else (None, None)), (k, t, method)


def test_interpolate_vectors(spark):
    p = spark.createDataFrame([(0, 0), (0, 5), (0, 10), (0, 20)], "k int, ts long")
    e = spark.createDataFrame([(0, 0, 0, [0.0, 1.0]), (0, 10, 1, [1.0, 3.0]), (0, 18, 2, [9.0])], "k int, ts long, s long, v array<double>")
    got = {r["ts"]: (r["v"], r["v_ts"]) for r in align.asof(p, e, ["k"], "ts", ["v"], "s", "interpolate").collect()}
    assert got == {0: ([0.0, 1.0], 0), 5: ([0.5, 2.0], 0), 10: ([1.0, 3.0], 10), 20: ([9.0], 18)}
    with pytest.raises(ValueError):
        align.asof(p, e, ["k"], "ts", ["v"], "s", "never")


def test_sparse_and_sessions(spark):
    a = spark.createDataFrame([(0, 1, 0, 1.0), (0, 1, 1, 2.0), (0, 3, 2, None)], "k int, ts long, s long, v double")
    b = spark.createDataFrame([(0, 1, 5, 9.0)], "k int, ts long, s long, v double")
    rows = sorted((r["ts"], r["occurrence"], r["a"], r["b"]) for r in align.sparse_outer({"a": a, "b": b}, ["k"], "ts", "s", "v").collect())
    assert rows == [(1, 0, 1.0, 9.0), (1, 1, 2.0, None), (3, 0, None, None)]
    e = spark.createDataFrame([(0, t, t in (3, 7)) for t in (0, 1, 3, 4, 7)] + [(1, 5, False)], "k int, ts long, m boolean")
    gaps = {(r["k"], r["ts"]): r["session"] for r in align.gap_sessions(e, ["k"], "ts", 2, ["ts"]).collect()}
    assert gaps == {(0, 0): 0, (0, 1): 0, (0, 3): 0, (0, 4): 0, (0, 7): 1, (1, 5): 0}
    marks = {(r["k"], r["ts"]): r["session"] for r in align.marker_sessions(e, ["k"], "ts", F.col("m")).collect()}
    assert marks == {(0, 3): 0, (0, 4): 0, (0, 7): 1, (1, 5): 0}


def test_fps(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.1), (0, 0.2), (0, 0.2), (1, 5.0)], "k int, t double")
    got = {r["k"]: r["fps"] for r in align.infer_fps(df, ["k"], F.col("t")).collect()}
    assert got[0] == pytest.approx(10.0) and got[1] is None
    assert spark.range(1).select(align.snap_fps(F.lit(29.9999999)), align.snap_fps(F.lit(None).cast("double")), align.snap_fps(F.lit(29.97))).first()[:] == (30.0, 30.0, 29.97)


def test_motion_trim(spark):
    rows = [(0, i, i * 0.1, [a], [0.0]) for i, a in enumerate([0.0, 0.0, 1.0, 1.0, 1.0])] + [(1, i, i * 0.1, [0.0], [0.0]) for i in range(3)]
    f = spark.createDataFrame(rows, "ep int, frame_index long, timestamp double, action array<double>, state array<double>")
    b = {r["ep"]: (r["start"], r["end"]) for r in episodes.motion_bounds(f, ["ep"], "frame_index", ["action", "state"], 0.25, 1).collect()}
    assert b == {0: (0, 3), 1: (None, None)}
    got = sorted((r["frame_index"], round(r["timestamp"], 6)) for r in episodes.motion_trim(f, ["ep"], ["action", "state"], 0.25, 1).collect())
    assert got == [(0, 0.0), (1, 0.1), (2, 0.2), (3, 0.3)]
    (row,) = spark.sql("SELECT named_struct('uri', 'u', 'from_s', 10D, 'to_s', 12D) AS v").select(episodes.trim_clip(F.col("v"), F.lit(0.0), F.lit(0.4), F.lit(False)).alias("c")).collect()
    assert (row["c"]["from_s"], row["c"]["to_s"]) == (10.0, 10.4)


def test_frame_windows(spark):
    f = spark.createDataFrame([(0, i, float(i)) for i in (0, 1, 2, 4)], "ep int, frame_index long, v double")
    full = episodes.frame_windows(f, ["ep"], [0, 1], ["v"]).collect()
    assert sorted((r["v_0"], r["v_1"]) for r in full) == [(0.0, 1.0), (1.0, 2.0)]
    loose = {r["frame_index"]: r["v_1"] for r in episodes.frame_windows(f, ["ep"], [0, 1], ["v"], 2, drop_incomplete=False).collect()}
    assert loose == {0: 1.0, 2: None, 4: None}


def test_malformed_episodes(spark):
    e = spark.createDataFrame([("r", 0, 0, 7, 0, 2, 2), ("r", 0, 0, 8, 2, 5, 4)], "root string, `data/chunk_index` int, `data/file_index` int, episode_index long, dataset_from_index long, dataset_to_index long, length long")
    f = spark.createDataFrame([("r", 0, 0, i, 99) for i in range(5)], "root string, `data/chunk_index` int, `data/file_index` int, index long, episode_index long")
    good = episodes.frames_of_episodes(e, f, skip_malformed=True)
    assert [r["episode_index"] for r in good.episodes.collect()] == [7] and good.frames.count() == 2
    with pytest.raises(Exception, match="episode 8 has 3 frames"):
        episodes.frames_of_episodes(e, f).episodes.collect()


def test_tasks_and_duplicates(spark):
    t = spark.createDataFrame([(0, "pick", 0), (0, "place", 3), (1, "push", 0), (1, "pick", 1), (2, "pull", 5)], "src int, task string, i long")
    merged, remap = episodes.merge_tasks(t, "src", "task", "i")
    assert {r["task"]: r["i"] for r in merged.collect()} == {"pick": 0, "place": 3, "push": 4, "pull": 5}
    assert sorted((r["src"], r["i"], r["new"]) for r in remap.collect()) == [(1, 0, 4), (1, 1, 0)]
    with pytest.raises(Exception, match="unknown task 9"):
        episodes.check_tasks(spark.createDataFrame([(9,)], "i long"), merged, "i").collect()
    d = spark.createDataFrame([(0, 4), (1, 4), (2, 7), (3, 7), (4, 1)], "seq long, ep long")
    assert {r["seq"]: r["ep"] for r in episodes.renumber_duplicates(d, "ep", "seq").collect()} == {0: 4, 1: 8, 2: 7, 3: 9, 4: 1}
    with pytest.raises(ValueError):
        episodes.positional_merge(d, d.limit(4), "seq")


def test_offsets_equal_a_running_sum(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(0, 9)) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i long, n long")
    got = {r["i"]: r["at"] for r in offsets.running_offsets(df, [], "i", "n", "at", 7).collect()}
    total = 0
    for i, n in sorted(rows):
        assert got[i] == total
        total += n


def quantile(x, q, bins=5000):
    counts, edges = np.histogram(x, bins=np.linspace(min(x) - 1e-10, max(x) + 1e-10, bins + 1))
    cum = np.cumsum(counts)
    i = int(np.searchsorted(cum, q * len(x)))
    return edges[0] if i == 0 else edges[i] + (q * len(x) - cum[i - 1]) / counts[i] * (edges[i + 1] - edges[i])


def test_statistics(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>")
    got = {r["dim"]: r for r in stats.feature_quantiles(df, [], "v").collect()}
    for d in (0, 1):
        for q in stats.QUANTILES:
            assert got[d][f"q{round(q * 100):02d}"] == pytest.approx(quantile(x[:, d], q), abs=1e-9)
    five = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    (q,) = stats.feature_quantiles(five, [], "v").collect()
    assert q["q01"] == pytest.approx(-1e-10) and q["q50"] == pytest.approx(2.0004, abs=1e-4)
    one = stats.feature_quantiles(five.limit(1), [], "v").collect()[0]
    assert one["q01"] == one["q99"] == 0.0


def test_merge_stats(spark):
    df = spark.createDataFrame([(0, 0.0, 2.0, 1.0, 0.5, 3, 1.0), (0, 10.0, 12.0, 11.0, 0.25, 2, 11.0)], "k int, min double, max double, mean double, std double, count long, q50 double")
    r = stats.merge_stats(df, ["k"], ["q50"]).first()
    var = (3 * (0.25 + 16) + 2 * (0.0625 + 36)) / 5
    assert r["mean"] == pytest.approx(5.0) and r["std"] == pytest.approx(math.sqrt(var)) and r["q50"] == pytest.approx(5.0) and r["count"] == 5


def test_media(spark):
    one = spark.sql("SELECT named_struct('uri', 'u', 'from_s', 2D, 'to_s', 6D) AS v, array(cast(0 AS double),0,0,0,0,0,0,0,0,100,0,0,0) AS l")
    c = one.select(media.compose_clip(F.col("v"), F.lit(1.0), F.lit(3.0)).alias("c")).first()["c"]
    assert (c["from_s"], c["to_s"]) == (3.0, 5.0)
    with pytest.raises(Exception, match="outside"):
        one.select(media.compose_clip(F.col("v"), F.lit(1.0), F.lit(9.0)).alias("c")).collect()
    assert one.select(media.sample_indices(F.lit(10), 4), media.sample_indices(F.lit(3), 8), media.sample_indices(F.lit(5), 1), media.sample_indices(F.lit(0), 3)).first()[:] == ([0, 3, 6, 9], [0, 1, 2], [4], [])
    r = one.select(media.reward_progress(F.col("l")).alias("p"), media.reward_success(F.col("l")).alias("s")).first()
    assert r["p"] == pytest.approx(1.0) and r["s"] == 0.5
    s = spark.sql("SELECT array(named_struct('start', 5D, 'end', 6D, 'label', ' b '), named_struct('start', -1D, 'end', 2.00049D, 'label', ''), named_struct('start', 3D, 'end', 3D, 'label', 'x')) AS s")
    assert [tuple(x) for x in s.select(media.normalize_segments(F.col("s")).alias("o")).first()["o"]] == [(0.0, 2.0, "segment 1"), (5.0, 6.0, "b")]
    o = media.overlaps(spark.createDataFrame([(0, 0.0, 2.0), (0, 1.0, 3.0), (0, 3.0, 4.0)], "k int, a double, b double"), ["k"], "a", "b")
    assert [r["overlaps"] for r in o.orderBy("a").collect()] == [False, True, False]
    assert media.image_from_message(bytes([1, 2, 3, 0, 4, 5, 6, 0]), 1, 2, 4, "bgr8") == [[[3, 2, 1]], [[6, 5, 4]]]
    assert media.image_from_message(bytes([1, 1]), 1, 1, 2, "mono16") == [[[1, 1, 1]]]


def test_relational(spark):
    df = spark.createDataFrame([(0, 3, "c"), (0, 1, "a"), (1, 2, "b")], "k int, o int, v string")
    assert sorted((r["k"], r["v"]) for r in relational.dedup(df, ["k"], ["o"]).collect()) == [(0, "a"), (1, "b")]
    assert relational.salted_join(df, df.select("k").distinct(), ["k"], 3).count() == 3
    assert relational.top_k(df, ["k"], [F.desc("o")], 1).count() == 2


def test_running_sums_and_ranges_inside_a_hot_key(spark):
    from millrace.operators import episodes, offsets

    rows = [("hot" if i % 10 else None, i, i % 7 or None) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, i long, n long")
    got = {r["i"]: r["low"] for r in offsets.running_offsets(df, ["k"], "i", "n", "low", slots=16).collect()}
    sums, wanted = {}, {}
    for k, i, n in rows:
        wanted[i] = sums.get(k, 0)
        sums[k] = wanted[i] + (n or 0)
    assert got == wanted
    frames = spark.createDataFrame([(f, i) for f in (0, 1) for i in range(900)], "file int, idx long")
    ranges = spark.createDataFrame([(0, 0, 700, 1), (0, 700, 710, 2), (1, 30, 31, 3), (1, 31, 899, 4)], "file int, low long, high long, e int")
    found = episodes.range_join(frames, ranges, ["file"], "idx", "low", "high", ["e"]).groupBy("file", "e").count().collect()
    assert {(r["file"], r["e"]): r["count"] for r in found} == {(0, 1): 700, (0, 2): 10, (1, 3): 1, (1, 4): 868}


def test_set_operations(spark):
    from millrace.operators import relational

    a, b = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (None,), (3,)], "x int")
    show = lambda df: sorted((r["x"] for r in df.collect()), key=str)
    assert show(relational.intersect(a, b)) == [1, None] and show(relational.except_(a, b)) == [2]
    assert show(relational.except_(a, b, every=True)) == [1, 2] and show(relational.distinct(a)) == [1, 2, None]
    assert relational.rollup(a, ["x"], n=F.count("*")).count() == 4
