import asyncio

import pytest
from pyspark.sql import functions as F

from millrace import inference as I
from millrace.plans import Dataset, Row
from millrace.streaming import read_stream, stream_sessions, windowed_counts


def answer(path, payload):
    return {"choices": [{"message": {"content": payload["messages"].upper() + str(payload.get("temperature"))}}]}


async def ask(row, request):
    return {"out": await request(messages=row["t"], temperature=2)}


def test_generate_text(spark):
    d = Dataset(spark.createDataFrame([("a",), ("b",)], "t string"))
    got = d.map_async(I.generate_text(ask, I.FakeEndpoint(answer), {"temperature": 1}), dtypes={"out": "string"})
    assert sorted(r["out"] for r in got) == ["A2", "B2"]
    with pytest.raises(ValueError):
        I.generate_text(ask, None, max_concurrent_requests=0)


def test_wanted_structure():
    sent = []

    def reply(path, payload):
        sent.append(payload.get("response_format"))
        return {"choices": [{"message": {"content": '{"label": "cut"}'}}]}

    async def label(row, request):
        return (await request(messages="x"))["label"]

    schema = {"title": "Label", "type": "object", "properties": {"label": {"type": "string"}}}
    assert asyncio.run(I.generate_text(label, I.FakeEndpoint(reply), output_schema=schema)(Row({}))) == "cut"
    assert sent == [{"type": "json_schema", "json_schema": {"name": "Label", "schema": schema, "strict": True}}]


def test_subtask_labeling():
    asked = []

    def reply(path, payload):
        asked.append(payload["messages"])
        if payload["messages"] == "2":
            raise I.RequestError(400, "blocked")
        return {"choices": [{"message": {"content": '{"label": "%s"}' % {"0": "  Pick\\n the CUP", "1": " "}[payload["messages"]]}}]}

    given = [{"start": 0.0, "end": 1.0, "label": "a"}, {"start": 1.0, "end": 2.0, "label": "B"}, {"start": 2.0, "end": 3.0, "label": None}]
    run = I.subtask_labeling(I.FakeEndpoint(reply), lambda row, before, own, after: str(int(own["start"])))
    got = asyncio.run(run(Row({"segments": given})))
    assert [x["label"] for x in got["labeled_segments"]] == ["pick the cup", "B", None] and asked == ["0", "1", "2"]
    with pytest.raises(I.RequestError):
        asyncio.run(I.subtask_labeling(I.FakeEndpoint(reply), lambda row, before, own, after: "2", when_blocked="raise")(Row({"segments": given})))
    with pytest.raises(ValueError):
        I.subtask_labeling(None, None, when_blocked="skip")


@pytest.mark.parametrize("status, again", [(408, True), (409, True), (429, True), (500, True), (503, True), (400, False), (404, False), (None, True)])
def test_retries(status, again):
    tries, waits = [], []

    async def call():
        tries.append(1)
        raise I.RequestError(status, "x", {"Retry-After-Ms": "500"} if len(tries) == 1 else {})

    async def sleep(s):
        waits.append(s)

    with pytest.raises(I.RequestError):
        asyncio.run(I.with_retries(call, 2, sleep))
    assert len(tries) == (3 if again else 1) and waits == ([0.5, 4.0] if again else [])


def test_long_waits_are_not_taken():
    assert I.delay(I.RequestError(429, "", {"retry-after": "120"}), 0) == 2.0
    assert I.delay(I.RequestError(429, "", {"retry-after": "7"}), 0) == 7.0


def test_models():
    score = I.reward_score(I.FakeEndpoint(lambda p, x: {"data": [{"data": [0.0] * 9 + [99.0] + [0.0] * 3}]}), lambda r: [], lambda r: "t")
    got = asyncio.run(score(Row()))
    assert got["reward_progress"] == pytest.approx(1.0) and got["reward_success"] == 0.5
    with pytest.raises(ValueError):
        I.track_hands(lambda rows: [])([Row()])
    assert I.service_name({"b": 1, "a": 2}) == I.service_name({"a": 2, "b": 1})


def test_streams(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:0{m}:00") for m in (0, 1, 2, 7)] + [(2, "2024-01-01 00:00:30")]
    batch = spark.createDataFrame(rows, "k int, s string").select("k", F.col("s").cast("timestamp").alias("ts"))
    batch.write.parquet(str(tmp_path / "in"))
    for n, make in enumerate((lambda e: windowed_counts(e, "ts", ["k"], "5 minutes", "10 minutes"), lambda e: stream_sessions(e, "ts", ["k"], "3 minutes", "10 minutes"))):
        q = make(read_stream(spark, str(tmp_path / "in"), batch.schema)).writeStream.outputMode("complete").format("memory").queryName(f"out{n}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    assert sorted((r["k"], r["n"]) for r in spark.table("out0").collect()) == [(1, 1), (1, 3), (2, 1)]
    assert sorted((r["k"], r["n"]) for r in spark.table("out1").collect()) == [(1, 1), (1, 3), (2, 1)]
