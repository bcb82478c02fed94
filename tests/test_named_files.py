import json

import pytest

from millrace.plans import Dataset
from millrace.sinks import NamedFilesSink, Sink


@pytest.mark.parametrize("template", ["{shard_id}.parquet", "{shard_id}-{worker_id}-{x}.parquet", "{shard_id:05}-{worker_id}.jsonl", "{shard_id!r}-{worker_id}.jsonl", "{shard_id}-{worker_id}.csv", "{shard_id"])
def test_templates(template):
    with pytest.raises(ValueError):
        NamedFilesSink("out", template)


def test_named_files(spark, tmp_path):
    out = tmp_path / "named"
    out.mkdir()
    (out / "part-00009-of-77.jsonl").write_text("left by a lost attempt")
    (out / "notes.jsonl").write_text("not ours")
    sink = NamedFilesSink(str(out), "part-{shard_id}-of-{worker_id}.jsonl")
    got = Dataset(spark.range(0, 40, 1, 4).filter("id < 25")).with_sink(sink).launch_local("named")
    assert got["rows"] == 25 and len(got["files"]) == 3
    assert sorted(p.name for p in out.iterdir()) == sorted([*got["files"], "notes.jsonl"])
    assert sorted(json.loads(line)["id"] for f in got["files"] for line in (out / f).read_text().splitlines()) == list(range(25))
    wide = NamedFilesSink(str(tmp_path / "wide")).write(spark.range(9))
    assert wide["rows"] == 9 and spark.read.parquet(str(tmp_path / "wide")).count() == 9
    assert NamedFilesSink(str(tmp_path / "none")).write(spark.range(0)) == {"rows": 0, "output": str(tmp_path / "none"), "files": []}


class Sums(Sink):
    def write_part(self, part, attempt, batches):
        total = sum(sum(b.column(0).to_pylist()) for b in batches)
        if total > 100:
            raise RuntimeError("too much")
        return total

    def commit(self, messages):
        return {"total": sum(messages)}

    def abort(self, error):
        self.failed = "too much" in str(error)


def test_own_sink(spark):
    assert Sums().write(spark.range(0, 10, 1, 3)) == {"rows": 10, "total": 45}
    sink = Sums()
    with pytest.raises(Exception, match="too much"):
        sink.write(spark.range(0, 100, 1, 1))
    assert sink.failed
