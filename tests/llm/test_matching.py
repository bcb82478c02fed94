import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import decontaminate, jaccard, neighbours, substrings
from millrace.llm.components import components


def distance(item, text):
    row, best = list(range(len(item) + 1)), len(item)
    for c in text:
        new = [0]
        for i, x in enumerate(item, 1):
            new.append(min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (x != c)))
        row, best = new, min(best, new[-1])
    return best


def test_myers():
    rng = random.Random(3)
    for _ in range(400):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 60)))
        assert decontaminate.myers(item, text, 999) == distance(item, text)


def test_decontamination(spark):
    rng = random.Random(6)
    item = lambda: "".join(rng.choice("abcdefgh  ") for _ in range(rng.randint(30, 120)))
    items = [(i, item()) for i in range(12)] + [(50, None), (51, "short"), (52, ""), (53, "be 20 chars exactly?"), (3, None)]
    docs = [(0, None), (1, ""), (2, items[0][1].upper().replace(" ", "\n ")), (3, items[0][1] + " " + items[1][1])]
    docs += [(4, "a SHORT one"), (5, "shorter"), (6, "to be 20 chars\nexactly? no"), (7, "xbe 20 chars exactly?"), (8, "x " * 100000 + items[2][1] + " short")]
    for k in range(60):
        t = list(rng.choice(items[:12])[1])
        for _ in range(rng.randint(0, 9)):
            p = rng.randrange(len(t))
            t[p : p + rng.randint(0, 1)] = rng.choice(["", "z", "zz"])
        docs.append((10 + k, item() + "".join(t) + item()))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("leaks", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = {}
    for i, text in docs:
        for k, t in items:
            t = decontaminate.normal(t or "")
            d = distance(t, decontaminate.normal(text or ""))
            exact = re.search(rf"(?<![^\W_]){re.escape(t)}(?![^\W_])", decontaminate.normal(text or "")) if t else None
            if exact if len(t) < decontaminate.WHOLE_CHARS else d <= len(t) // decontaminate.CHARS_PER_ERROR:
                wanted.setdefault(i, []).append((k, d))
    got = {r["doc_id"]: [tuple(x) for x in r["leaks"]] for r in decontaminate.find(df, bench).collect()}
    assert len(got) == len(docs) and {k: v for k, v in got.items() if v} == wanted
    old, decontaminate.BLOCK_BYTES = decontaminate.BLOCK_BYTES, 300
    try:  # the same in several blocks
        again = {r["doc_id"]: [tuple(x) for x in r["leaks"]] for r in decontaminate.find(df, bench).collect()}
    finally:
        decontaminate.BLOCK_BYTES = old
    assert again == got and decontaminate.find(df, bench.limit(0)).filter(F.size("leaks") > 0).count() == 0
    assert decontaminate.find(df.limit(0), bench).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def groups_of(docs):
    sets = {i: shingle_set(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark):
    rng = random.Random(1)
    vocabulary = [f"w{k}" for k in range(40)]
    base = [rng.choice(vocabulary) for _ in range(60)]
    docs = []
    for i in range(250):
        t = list(base[: rng.choice((4, 5, 6, 8, 9, 12, 20, 40, 60))])
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            t[rng.randrange(len(t))] = rng.choice(vocabulary)
        docs.append((i, " ".join(t)))
    docs += [(500, None), (501, ""), (502, " \n"), (503, "A b"), (504, "a B"), (503, "A b"), (None, "a b"), (505, "x " * 20000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1))
    got = jaccard.link_components(df).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == groups_of(docs)
    assert jaccard.link_components(df.limit(0)).count() == 0


def test_jaccard_of_words_alike(spark):
    word = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    docs = [(1, word), (2, word.translate({97: 98, 98: 97})), (3, word + " "), (4, "z" * 9000), (5, "z" * 8999 + "y"), (6, "z" * 9000)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 4}


def test_keys_are_shared_by_linked_sets():
    rng = np.random.default_rng(8)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        cut = int(rng.integers(0, max(1, len(a) // 9) + 1))
        more = rng.integers(1, 1 << 63, int(rng.integers(0, max(1, len(a) // 9) + 1)), dtype=np.uint64)
        b = np.unique(np.concatenate((np.delete(a, rng.permutation(len(a))[:cut]), more)))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        of, key = jaccard.keys(np.concatenate((a, b)), np.array([len(a), len(b)]))
        assert set(key[of == 0].tolist()) & set(key[of == 1].tolist())
        both = jaccard.sketches(np.concatenate((a, b)), np.array([len(a), len(b)]))
        x, y = jaccard.fold(both, min(map(len, both)))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 98), (7, 7), (None, 3)]
    for most in (0, 1000):  # by rounds, and in one task
        got = {r["id"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long"), most).collect()}
        assert got == {**dict.fromkeys(range(41), 0), 98: 98, 99: 98, 100: 98}
        assert components(spark.createDataFrame([], "a long, b long"), most).count() == 0


def without_repeats(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    first, out = {}, []
    for i, b in rows:
        for p in range(len(b) - 49 if i is not None else 0):
            first.setdefault(b[p : p + 50], i)
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        edge = [p for p in range(len(b) + 1) if (gone[p] if p < len(b) else 0) != (gone[p - 1] if p else 0)]
        out.append((i, len(b), bytes(c for c, g in zip(b, gone, strict=True) if not g), list(zip(edge[::2], edge[1::2], strict=True))))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def test_substrings(spark, monkeypatch):
    rng = random.Random(4)
    piece = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    shared = [piece(n) for n in (30, 48, 50, 51, 90, 300)]
    docs = [(i, "".join(rng.choice([piece(rng.randint(0, 60)), rng.choice(shared)]) for _ in range(rng.randint(0, 6)))) for i in range(120)]
    docs += [(None, "x" * 60), (None, "x" * 60), (-1, None), (-2, ""), (300, "ab" * 100), (301, "ab" * 40), (301, "ab" * 41), (302, "ba" * 25), (303, docs[5][1]), (304, docs[5][1]), (305, "\0" * 70), (306, "\0" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(1))
    show = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    wanted = without_repeats([(i, (t or "").encode()) for i, t in docs])
    for _ in range(2):  # once more with blocks of few strings, and hashes of contents that nearly all collide
        got = [(r["doc_id"], r["n_bytes"], bytes(r["kept"]), [tuple(s) for s in r["spans"]]) for r in substrings.remove_repeats(df).collect()]
        assert show(got) == wanted
        real = substrings.Stretches.hashes
        monkeypatch.setattr(substrings.Stretches, "hashes", lambda *a, real=real: real(*a) & np.uint64(1))
        monkeypatch.setattr(substrings, "BLOCK_STRINGS", 64)
    monkeypatch.undo()
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_substrings_query(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    source.write.parquet(str(tmp_path / "documents.parquet"))
    wanted = {i: (n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, kept, spans in without_repeats([(r["doc_id"], r["text"].encode()) for r in source.collect()])}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.op5_substrings(spark, str(tmp_path)).collect()}
    assert got == wanted


def test_substrings_of_a_long_text(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(4_000_000))
    df = spark.createDataFrame([(1, long), (2, "new " + long[3_999_000:] + " end"), (3, long[:60])], "doc_id long, text string")
    got = {r["doc_id"]: (bytes(r["kept"]).decode(), [tuple(s) for s in r["spans"]]) for r in substrings.remove_repeats(df).collect()}
    assert got == {1: (long, []), 2: ("new  end", [(4, 1004)]), 3: ("", [(0, 60)])}


def test_intervals_of_the_transform():
    rng = random.Random(2)
    for letters in (b"ab", b"abcdefgh"):
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(50, 90))) for _ in range(30)]
        pieces += [p[3:70] for p in pieces[:10] if len(p) > 60] + [b"a" * 80, b"a" * 60, b"ab" * 40]
        low = np.array([rng.randrange(20) for _ in pieces])
        high = low + np.array([rng.choice((0, 0, 3)) for _ in pieces])
        least, most = {}, {}
        for p, a, b in zip(pieces, low.tolist(), high.tolist(), strict=True):
            for i in range(len(p) - 49):
                x = p[i : i + 50]
                least[x], most[x] = min(a, least.get(x, a)), max(b, most.get(x, b))
        got = substrings.least_documents(np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces]), low, high)
        every = [p[i : i + 50] for p in pieces for i in range(len(p) - 49)]
        assert got.tolist() == [least[x] if least[x] != most[x] else np.iinfo(np.int32).max for x in every]


def nearest(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x[q] * x).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_neighbours_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 16)) * 0.5
    x = np.concatenate((x, np.tile(x[7], (900, 1))))  # one very common vector
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    rows = neighbours.usable(df, "vec_id", "embedding")
    index = neighbours.build(rows)
    got = {}
    for r in neighbours.search(rows, rows.filter("id % 20 = 0"), index, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wanted = nearest(ids, x, 20)
    assert set(got) == set(wanted)
    hits = 0
    for q, rows_ in got.items():
        rows_.sort()
        assert [r[0] for r in rows_] == list(range(1, 21)) and rows_ == sorted(rows_, key=lambda r: (-r[2], r[1]))
        hits += len({r[1] for r in rows_} & {i for i, _ in wanted[q]})
    assert hits >= 0.9 * 20 * len(wanted)


def test_neighbours_recall_beside_copies(spark):
    x = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()], np.float64)
    n = len(x)
    for hot in (7, 1234):
        both = np.concatenate((x, np.tile(x[hot], (n // 2, 1))))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>").repartition(4)
        rows = neighbours.usable(df, "vec_id", "embedding")
        index = neighbours.build(rows, 20)
        assert index.rows == len(both) and index.ranked == n + 20
        got = {}
        for r in neighbours.search(rows, rows.filter(F.col("id") % 20 == 0).filter(F.col("id") < n), index, 20).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        wanted = nearest(np.arange(len(both)), both, 20)
        share = [len(got[q] & {i for i, _ in wanted[q]}) / 20 for q in got if q != hot]
        assert len(share) >= n // 20 - 1 and np.mean(share) >= 0.93, (np.mean(share), min(share))


def test_neighbours_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (80, [1.0, None]), (1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    some = neighbours.usable(df, "vec_id", "embedding")
    got = neighbours.search(some, some.filter("id % 20 = 0"), neighbours.build(some), 20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert neighbours.build(some.limit(0)) is None
