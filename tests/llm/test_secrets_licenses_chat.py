import hashlib
import math
import random
import re
import time

from pyspark.sql import functions as F

from millrace.llm import chat, licenses, secrets


def spans_of(t):
    t, out = t or "", []
    for m in re.finditer(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    base = list(out)
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", t):
        run = m[0]
        if any(re.search(p, run) for p in secrets.ALLOWED):
            continue
        least = secrets.THRESHOLDS["hex" if re.fullmatch("[0-9a-fA-F]*", run) else "alnum" if re.fullmatch("[A-Za-z0-9]*", run) else "base64"]
        hits = []
        for i in range(len(run) - secrets.WINDOW + 1):
            w = run[i : i + secrets.WINDOW]
            if -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w)) >= least:
                hits.append(i)
        if hits:
            a, b = m.start() + hits[0], m.start() + hits[-1] + secrets.WINDOW
            if not any(x < b and a < y for x, _, y in base):
                out.append((a, 3, b))
    show = lambda s: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(s))
    return hashlib.sha256(show(base).encode()).hexdigest(), show(out)


def test_secrets(spark):
    rng = random.Random(9)
    parts = ["password", "TOKEN", "api_key", "secret", ":", "=", " ", '"', "é", "\n", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "abc", "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9", "x/y+z=1", "2024-01-02-aaaaaaaaaaaaaaa1", "12345678-1234-1234-1234-123456789abc"]
    texts = [None, "", "secret: token: abcdefgh", "é" * 50 + "AKIA" + "A" * 16] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(250)] + ["n " * 50000 + "token=abcdef"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("secrets", F.lit(1))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    for r in secrets.scan(df).select("text", F.sha2(secrets.listed(base), 256).alias("b"), secrets.listed(F.col("secrets")).alias("s")).collect():
        assert (r["b"], r["s"]) == spans_of(r["text"]), r["text"]
    assert secrets.scan(df.limit(0)).count() == 0


def test_redaction(spark):
    df = spark.createDataFrame([(0, "a token=abcdefg b"), (1, None), (2, "clean"), (3, "password: " + "deadbeef" * 4)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}
    assert got == {0: "a [SECRET] b", 1: None, 2: "clean", 3: "[SECRET]"}


def test_secrets_beside_others(spark, tmp_path):
    rng = random.Random(2)
    key = lambda n=40: "".join(rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", n))
    access, blob, digest = "AKIA" + "Q7" * 8, "deadbeef" * 5, "0123456789abcdef" * 2
    uuid = "12345678-1234-1234-1234-123456789abc"
    cases = [("", access, "/", key()), ("blob/", blob, "/", key()), ("x" * 30 + "/samples/" + "x" * 30 + "/", "", "", key()), ("2024-05-01-", "", "", key()), ("", "", key() + "/", digest + "/" + key())]
    texts = ["".join(c) for c in cases] + [uuid, "example" * 4 + "1", "y" * 30 + "1", access + "/short1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spans = {r["doc_id"]: r["spans"] for r in secrets.op10_secrets(spark, str(tmp_path)).collect()}
    left = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    for i, (*_, last) in enumerate(cases):
        part = last[-40:]
        assert "entropy" in spans[i] and int(spans[i].rsplit(":", 1)[1]) == len(texts[i]), texts[i]
        assert not any(part[k : k + 4] in left[i] for k in range(len(part) - 3)), left[i]
    assert spans[4].count("entropy") == 2  # on both sides of the hex span
    assert [left[i] for i in range(5, 8)] == texts[5:8] and left[8] == "[SECRET]/short1"


def test_secrets_in_long_runs(spark):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    random_run = lambda n: "".join(rng.choice(letters) for _ in range(n))
    mixed = lambda n: "".join(rng.choice(["a" * 25 + "1", random_run(rng.randint(15, 40))]) for _ in range(n))
    texts = ["see " + random_run(511 + k) + " end" for k in (0, 1, 2, 19, 20, 21, 533)] + ["x " + mixed(60) for _ in range(6)] + ["1" + "ab" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan(df).select("text", secrets.listed(F.col("secrets")).alias("s")).collect():
        assert r["s"] == spans_of(r["text"])[1]
    began = time.time()
    (r,) = secrets.scan(spark.createDataFrame([(1, "key " + random_run(1 << 20))], "doc_id long, text string"), parts=True).select(secrets.listed(F.col("secrets")).alias("s")).collect()
    assert r["s"].startswith("entropy:4:") and r["s"].endswith(f":{4 + (1 << 20)}") and time.time() - began < 120


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def found_in(text):
    words = WORD.findall((text or "").translate(UPPER))
    places, labels, score = [], set(), 0.0
    for t in licenses.BASE + licenses.NOTICES:
        own, must = t.text.split(), [(p, w.decode()) for p, w in t.mandatory]
        for a in range(-25, len(words)):
            if all(0 <= a + p < len(words) and words[a + p] == w for p, w in must):
                labels.add(t.label)
                score = max(score, sum(0 <= a + p < len(words) and words[a + p] == w for p, w in enumerate(own)) / len(own))
                if t.base:
                    places.append((a, t.label))
    at = [p for p, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), score)


def test_licenses(spark):
    rng = random.Random(3)
    words = "gnu general public license apache mit cc by nc 4 0 version 2 3 licensed under the permission is hereby granted é this work x".split()
    texts = [None, "", "mit license mit LICENSE", "submit license", "license apache\n\nlicense", "cc by é cc by"] + ["".join(rng.choice(words) + rng.choice([" ", "-", ".\n", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [t.text.title() for t in licenses.NOTICES] + ["w " * 30000 + "gnu general public license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("x"))
    for r in licenses.scan(df).collect():
        assert tuple(r[f] for f in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) == found_in(r["text"]), r["text"]
    assert licenses.scan(df.limit(0)).count() == 0


def test_chat(spark):
    rows = [
        (0, True, 0, "user", "hi"), (0, True, 1, "assistant", "good"), (0, False, 0, "user", "hi"), (0, False, 1, "assistant", "bad"),
        (1, True, 0, "user", "only"), (2, True, 0, None, None), (2, False, 0, None, None), (3, True, 0, "user", "a"), (3, False, 0, "user", "a"), (3, False, 1, "user", "b"),
        (None, True, 0, "user", "lost"), (4, True, None, "user", "first"), (4, True, 0, "assistant", "then"), (4, False, 0, "user", "other"), (4, False, 0, "user", "other"),
    ]
    df = spark.createDataFrame(rows, "p long, c boolean, turn long, role string, text string")
    got = {r["pair_id"]: r for r in chat.preference_pairs(df, F.col("p"), F.col("c")).collect()}
    show = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(got) == {0, 1, 2, 3, 4}
    assert (got[0]["prompt"], got[0]["chosen"], got[0]["rejected"], got[0]["n_prompt_turns"]) == (show("user", "hi"), show("assistant", "good"), show("assistant", "bad"), 1)
    (span,) = got[0]["chosen_mask"]
    assert got[0]["chosen"][span["start"] : span["end"]] == "good<|im_end|>"
    assert got[1]["prompt"] == "" and got[1]["rejected"] is None and got[1]["rejected_mask"] is None
    assert got[2]["prompt"] == show("", "") and got[2]["chosen"] == got[2]["rejected"] == ""
    assert got[3]["prompt"] == show("user", "a") and got[3]["chosen"] == "" and got[3]["rejected"] == show("user", "b")
    assert got[4]["chosen"].startswith(show("user", "first")) and got[4]["rejected"] == show("user", "other") * 2
    assert chat.preference_pairs(df.limit(0), F.col("p"), F.col("c")).count() == 0
