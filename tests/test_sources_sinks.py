import gzip
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from millrace import sources as S
from millrace.functions import col
from millrace.sinks import BlobAssets, EpisodeSink, FileAssets, ZarrSink
from millrace.sources import mcap, tfrecord
from millrace.sources.zarr import Store


def test_csv_and_multiline(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"x\ny"\n2,z\n')
    rows = S.read_csv(spark, str(tmp_path / "a.csv"), multiline_rows=True).materialize()
    assert [(r["id"], r["text"]) for r in rows] == [("1", "x\ny"), ("2", "z")] and rows[0]["file_path"].endswith("a.csv")
    (tmp_path / "b.csv").write_text("id,v\n" + "".join(f"{i},{i * 2}\n" for i in range(2500)))
    assert sorted(r["id"] for r in S.read_csv(spark, str(tmp_path / "b.csv"))) == list(range(2500))


def test_json_kinds(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "a": 1\n}')
    (tmp_path / "many.json").write_text('[{"a": 2}, {"a": 3}]')
    (tmp_path / "lines.jsonl").write_text('{"a": 4}\n{"a": 5}\n')
    assert [r["a"] for r in S.read_json(spark, str(tmp_path / "one.json"))] == [1]
    assert sorted(r["a"] for r in S.read_json(spark, str(tmp_path / "many.json"))) == [2, 3]
    assert sorted(r["a"] for r in S.read_jsonl(spark, str(tmp_path / "lines.jsonl"))) == [4, 5]
    every = S.read_json(spark, [str(tmp_path / n) for n in ("one.json", "many.json", "lines.jsonl")]).materialize()
    assert sorted((r["a"], r["file_path"].rpartition("/")[2]) for r in every) == [(1, "one.json"), (2, "many.json"), (3, "many.json"), (4, "lines.jsonl"), (5, "lines.jsonl")]
    for i, wrong in enumerate(("7", '["x"]', "{no")):
        (tmp_path / f"bad{i}.json").write_text(wrong)
        with pytest.raises(Exception, match="bad"):
            S.read_json(spark, str(tmp_path / f"bad{i}.json")).materialize()


def test_directory_suffixes_and_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n')
    (tmp_path / "x.txt").write_text("nothing")
    assert len(S.read_jsonl(spark, str(tmp_path)).materialize()) == 1
    files = S.read_files(spark, str(tmp_path / "*"), content_column="data").materialize()
    assert sorted(r["size"] for r in files) == [7, 9]
    assert S.read_files(spark, str(tmp_path / "x.txt"), decode_fn=lambda b: b.decode().upper(), dtypes={"content": "string"}).materialize()[0]["content"] == "NOTHING"
    assert S.read_videos(spark, str(tmp_path / "x.txt")).output_schema()["video_path"].metadata == {"asset_type": "video"}


def test_parquet_reads_every_row_with_identity(spark, tmp_path):
    pq.write_table(pa.table({"id": list(range(50)), "x": [f"v{i}" for i in range(50)]}), tmp_path / "t.parquet", row_group_size=10)
    d = S.read_parquet(spark, str(tmp_path / "t.parquet"), filter=(col("id") >= 15) & (col("id") < 25), identity=True)
    got = d.df.select("id", "__source_row_id", "__shard_id").collect()
    assert sorted((r["id"], r["__source_row_id"]) for r in got) == [(i, i) for i in range(15, 25)]
    assert all(len(r["__shard_id"]) == 12 for r in got)
    assert "__shard_id" in d.select("id").df.columns and "__shard_id" not in d.select("id").output_schema().names


def test_blobs_and_assets(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"hello")
    df = spark.createDataFrame([(1, str(tmp_path / "a.bin")), (2, str(tmp_path / "none.bin"))], "id int, f string").coalesce(1)
    from millrace.plans import Dataset

    Dataset(df).write_parquet(str(tmp_path / "out"), assets=BlobAssets(("f",), missing_policy="set_null")).launch_local("x")
    rows = {r["id"]: r["f"] for r in S.read_parquet(spark, str(tmp_path / "out"))}
    assert rows[2] is None and S.read_blob(rows[1]) == b"hello"
    with pytest.raises(EOFError):
        S.read_blob({**rows[1], "size": 9})
    with pytest.raises(ValueError):
        S.read_blob({**rows[1], "size": True})
    Dataset(df).write_jsonl(str(tmp_path / "out2"), assets=FileAssets(("f",), missing_policy="drop_row")).launch_local("x")
    (kept,) = S.read_jsonl(spark, str(tmp_path / "out2")).materialize()
    assert open(kept["f"], "rb").read() == b"hello" and kept["f"].endswith("0-a.bin")
    with pytest.raises(Exception, match="none.bin"):
        Dataset(df).write_parquet(str(tmp_path / "out3"), assets=FileAssets(("f",))).launch_local("x")


def warc(kind, url, body):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nX: 1\r\nX: 2\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_archives(spark, tmp_path):
    one = gzip.compress(warc("response", "http://a", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>"))
    two = gzip.compress(warc("conversion", "http://b", "tëxt".encode()))
    (tmp_path / "x.warc.gz").write_bytes(one + gzip.compress(warc("request", "http://c", b"GET")) + two)
    (tmp_path / "plain.warc").write_bytes(warc("response", "http://p", b"HTTP/1.1 404 No\r\n\r\nx"))
    assert [r["http_status"] for r in S.read_commoncrawl(spark, str(tmp_path / "plain.warc"))] == [404]
    rows = {r["url"]: r for r in S.read_commoncrawl(spark, str(tmp_path / "x.warc.gz"))}
    assert rows["http://a"]["http_status"] == 200 and bytes(rows["http://a"]["content"]) == b"<p>" and rows["http://a"]["headers"]["x"] == ["1", "2"]
    assert rows["http://b"]["text"] == "tëxt" and set(rows) == {"http://a", "http://b"}
    index = pa.table({"url": ["http://a", "http://z"], "warc_filename": ["x.warc.gz"] * 2, "warc_record_offset": [0, 0], "warc_record_length": [len(one)] * 2, "content_mime_type": ["text/html", "x"], "content_mime_detected": ["x", "x"]})
    pq.write_table(index, tmp_path / "index.parquet")
    (got,) = S.read_commoncrawl_from_index(spark, str(tmp_path / "index.parquet"), str(tmp_path), S.filter_html()).materialize()
    assert got["url"] == "http://a" and bytes(got["content"]) == b"<p>"


def test_stores_that_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(warc("response", "http://a", b"HTTP/1.1 200 OK\r\n\r\nx")))
    (tmp_path / "l.mcap").write_bytes(log([("/a", 0, {"q": 1}), ("/a", 1, {"q": 2})]))
    monkeypatch.setattr("millrace.sources.blobs.OPENED", ())
    (row,) = S.read_commoncrawl(spark, str(tmp_path / "x.warc.gz"))
    assert row["url"] == "http://a" and bytes(row["content"]) == b"x"
    assert mcap.read_messages(spark, str(tmp_path / "l.mcap")).count() == 2


def test_archives_of_dumps(spark, tmp_path):
    def put(dump, segment, name, url):
        folder = tmp_path / "crawl data" / "crawl-data" / dump / "segments" / segment / "warc"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(gzip.compress(warc("response", url, b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\nx")))

    put("D-1", "s1", "a.warc.gz", "http://1a")
    put("D-1", "s2", "b.warc.gz", "http://1b")
    put("D-2", "s1", "c.warc.gz", "http://2c")
    root = str(tmp_path / "crawl data")
    urls = lambda **k: sorted(r["url"] for r in S.read_commoncrawl(spark, root=root, **k))
    assert urls(dumps=["D-1", "D-2"]) == ["http://1a", "http://1b", "http://2c"]
    assert urls(dumps="D-1", segments="s2") == ["http://1b"]
    assert urls(dumps=["D-1", "D-2"], num_files=2) == ["http://1a", "http://1b"]
    (row,) = S.read_commoncrawl(spark, None, ["url", "X", "Server", "none"], "D-2", root=root, file_path_column="warc_path")
    assert [row[k] for k in ("url", "X", "Server", "none")] == ["http://2c", "1", "s", None] and row["warc_path"].endswith("/c.warc.gz")
    for bad in ({}, {"dumps": []}, {"dumps": "D-1", "num_files": 0}, {"dumps": "D-1", "archive_format": "wat"}, {"inputs": "x", "dumps": "D-1"}):
        with pytest.raises(ValueError):
            S.read_commoncrawl(spark, root=root, **bad)
    with pytest.raises(FileNotFoundError):
        S.read_commoncrawl(spark, dumps="D-3", num_files=1, root=root)


def test_record_streams():
    plain = [b"x" * 376, b"", b"y" * 100_000]  # the first size begins like a zlib stream
    data = b"".join(struct.pack("<Q", len(x)) + b"0000" + x + b"0000" for x in plain)
    for packed in (data, gzip.compress(data), zlib.compress(data)):
        assert list(tfrecord.payloads(io.BytesIO(packed))) == plain
        with pytest.raises(EOFError):
            list(tfrecord.payloads(io.BytesIO(packed[:-9])))
    assert list(tfrecord.payloads(io.BytesIO(b""))) == []


def _msg(number, body, wire=2):
    head = bytes([number << 3 | wire])
    return head + bytes([len(body)]) + body if wire == 2 else head + body


def test_record_files(spark, tmp_path):
    def entry(name, kind, body):
        return _msg(1, _msg(1, name.encode()) + _msg(2, _msg(kind, body)))

    example = _msg(1, entry("id", 3, _msg(1, bytes([5]))) + entry("text", 1, _msg(1, b"hi")) + entry("v", 2, _msg(1, struct.pack("<2f", 1.5, 2.5))))
    data = struct.pack("<Q", len(example)) + b"0000" + example + b"0000"
    (tmp_path / "a.tfrecord").write_bytes(data)
    (tmp_path / "b.tfrecord").write_bytes(gzip.compress(data))
    rows = S.read_tfrecords(spark, str(tmp_path / "*.tfrecord"), {"id": "int64", "text": "string", "v": "array<float>", "none": "string"}).materialize()
    assert [dict(r) for r in rows] == [{"id": 5, "text": "hi", "v": [1.5, 2.5], "none": None}] * 2
    with pytest.raises(EOFError):
        list(tfrecord.payloads(io.BytesIO(data[:-3])))


def test_array_store_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, [[1.0], [2.0]]), (1, [[3.0], [4.0], [5.0]])], "k int, action array<array<double>>")
    ZarrSink(str(tmp_path / "z"), {"data/action": "action"}, {"task": "pick"}, "k").write(df)
    assert Store(str(tmp_path / "z")).array("meta/episode_ends").read().tolist() == [2, 5]
    rows = S.read_zarr(spark, str(tmp_path / "z"), {"action": "data/action"}, {"task": "task"}, row_ends="meta/episode_ends").materialize()
    assert [(r["action"], r["task"]) for r in sorted(rows, key=lambda r: r["row_index"])] == [([[1.0], [2.0]], "pick"), ([[3.0], [4.0], [5.0]], "pick")]
    rows = [(k, [[float(10 * k + i)] * 2 for i in range(k % 4)]) for k in range(25)]  # rows cross chunks of three entries, and some have none
    ZarrSink(str(tmp_path / "c"), {"x": "x"}, order="k", chunk_bytes=48).write(spark.createDataFrame(rows[::-1], "k int, x array<array<double>>").repartition(5))
    assert len(list((tmp_path / "c" / "x").glob("*.0"))) == 12
    back = S.read_zarr(spark, str(tmp_path / "c"), {"x": "x"}, row_ends="meta/episode_ends", dtypes={"x": "array<array<double>>", "row_index": "int64"})
    assert [r["x"] for r in sorted(back, key=lambda r: r["row_index"])] == [x for _, x in rows]
    with zipfile.ZipFile(tmp_path / "c.zarr.zip", "w") as z:
        for f in (tmp_path / "c").rglob("*"):
            z.write(f, f.relative_to(tmp_path / "c"))
    packed = S.read_zarr(spark, str(tmp_path / "c.zarr.zip"), {"x": "x"}, row_ends="meta/episode_ends", dtypes={"x": "array<array<double>>"})
    assert sorted(repr(r["x"]) for r in packed) == sorted(repr(x) for _, x in rows)
    (tmp_path / "c" / "meta" / "episode_ends" / "0").write_bytes(np.array([5, 3, *[25] * 22, 36, *[0] * (65536 - 25)], "<i8").tobytes())
    with pytest.raises(Exception, match="do not rise"):
        S.read_zarr(spark, str(tmp_path / "c"), {"x": "x"}, row_ends="meta/episode_ends", dtypes={"x": "array<array<double>>"}).materialize()
    assert ZarrSink(str(tmp_path / "e"), {"x": "x"}).write(spark.createDataFrame([], "x array<double>"))["rows"] == 0
    assert len(S.read_zarr(spark, str(tmp_path / "z"), {"a": "data/action"}, split_leading_axis=True, leading_axis_row_size=2).materialize()) == 3
    with pytest.raises(ValueError):
        ZarrSink(str(tmp_path / "y"), {"a": "action", "b": "other"}).write(spark.createDataFrame([([[1.0]], [1.0, 2.0])], "action array<array<double>>, other array<double>"))


def log(messages):
    def rec(code, body):
        return bytes([code]) + struct.pack("<Q", len(body)) + body

    def text(s):
        return struct.pack("<I", len(s)) + s.encode()

    topics = list(dict.fromkeys(m[0] for m in messages))
    out = mcap.MAGIC
    for i, t in enumerate(topics):
        out += rec(mcap.CHANNEL, struct.pack("<HH", i, 0) + text(t) + text("json") + struct.pack("<I", 0))
    for k, (t, at, value) in enumerate(messages):
        out += rec(mcap.MESSAGE, struct.pack("<HIQQ", topics.index(t), k, int(at * 1e9), int(at * 1e9)) + json.dumps(value).encode())
    return out + mcap.MAGIC


def test_robot_log(spark, tmp_path):
    (tmp_path / "l.mcap").write_bytes(log([("/state", 2, {"q": [30]}), ("/state", 0, {"q": [10]}), ("/state", 1, {"q": [20]}), ("/target", 0.1, {"u": 1.0}), ("/target", 1.9, {"u": 3.0}), ("/target", 1.1, {"u": 2.0})]))
    fields = {"q": ("/state.q", "array<long>"), "u": ("/target.u", "double")}
    rows = sorted(S.read_mcap(spark, str(tmp_path / "l.mcap"), fields, "q", "nearest", include_skew=True), key=lambda r: r["frame_index"])
    assert [(r["q"], r["u"], round(r["mcap.u.skew_ms"])) for r in rows] == [([10], 1.0, 100), ([20], 2.0, 100), ([30], 3.0, -100)]
    assert len(S.read_mcap(spark, str(tmp_path / "l.mcap"), fields).materialize()) == 6
    held = sorted(S.read_mcap(spark, str(tmp_path / "l.mcap"), fields, "q", "hold"), key=lambda r: r["frame_index"])
    assert [r["u"] for r in held] == [None, 1.0, 3.0]
    every = S.read_mcap(spark, str(tmp_path / "l.mcap"), sync_primary="/state.q")
    assert [(r["/state.q"], r["/target.u"]) for r in sorted(every, key=lambda r: r["frame_index"])] == [([10], 1.0), ([20], 2.0), ([30], 3.0)]
    assert dict(every.df.dtypes)["/target.u"] == "double" and dict(every.df.dtypes)["/state.q"] == "array<bigint>"
    assert mcap.split_source("/a.b.c", ["/a", "/a.b"]) == ("/a.b", ["c"])


def test_episode_dataset_round_trip(spark, tmp_path):
    frames = "array<struct<timestamp:float,action:array<double>>>"
    df = spark.createDataFrame([(0, [(0.0, [1.0]), (0.1, [2.0])], ["pick"]), (1, [(0.0, [3.0])], ["place"]), (1, [(0.0, [4.0]), (0.1, [5.0])], ["pick"])], f"episode_index long, frames {frames}, tasks array<string>")
    EpisodeSink(str(tmp_path / "d"), fps=30.0000000001).write(df)
    info = json.loads((tmp_path / "d/meta/info.json").read_text())
    assert (info["fps"], info["total_episodes"], info["total_frames"], info["total_tasks"]) == (30, 3, 5, 2)
    data = S.read_lerobot(spark, str(tmp_path / "d"))
    assert sorted((r["episode_index"], r["length"]) for r in data.episodes.collect()) == [(0, 2), (1, 1), (2, 2)]
    got = sorted((r["index"], r["episode_index"], r["frame_index"], r["task_index"]) for r in data.frames.collect())
    assert [g[0] for g in got] == [0, 1, 2, 3, 4] and [g[2] for g in got] == [0, 1, 0, 0, 1]
    told = json.loads((tmp_path / "d/meta/stats.json").read_text())["action"]
    assert (told["min"], told["max"], told["mean"], told["count"]) == ([1.0], [5.0], [3.0], [5])
    of = {r["episode_index"]: (r["stats/action/mean"], r["stats/action/std"], r["stats/action/count"]) for r in data.episodes.collect()}
    assert of == {0: ([1.5], [0.5], [2]), 1: ([3.0], [0.0], [1]), 2: ([4.5], [0.5], [2])}
    nested = {r["episode_index"]: len(r["frames"]) for r in data.nested().collect()}
    assert nested == {0: 2, 1: 1, 2: 2}


@pytest.mark.parametrize("call, library", [
    (lambda s: S.read_hdf5(s, "x", {}), "h5py"), (lambda s: S.load_lance(s, "x"), "lance"),
    (lambda s: S.read_hf_dataset(s, "x"), "datasets"), (lambda s: S.read_tfds(s, "x"), "tensorflow_datasets"),
])
def test_absent_libraries_are_named(spark, call, library):
    import importlib.util

    if importlib.util.find_spec(library):
        pytest.skip("installed")
    with pytest.raises(ImportError, match=library):
        call(spark)


def test_numpy_values(spark):
    rows = S.from_items(spark, [{"x": np.arange(3)}, {"x": np.array([7])}]).materialize()
    assert sorted(r["x"] for r in rows) == [[0, 1, 2], [7]]
