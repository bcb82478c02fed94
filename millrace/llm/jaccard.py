"""N-gram Jaccard join by parity sketches.

Every shingle of a document is hashed into one piece of the document's sketch, and the
hashes in a piece are XOR-ed: shingles that two documents share cancel out of their
difference, so that pieces which differ hold a shingle of the symmetric difference, and
there are at most as many of them as it has shingles. Documents are joined in bands of
sizes. A link allows a bounded difference, and a band's sketch has more pieces than that
bound, so that linked documents agree in a piece that is not empty; documents too sparse for this agree
in a shingle of their prefixes. Groups that agree in a piece are resolved by verified links
to one member each; what stays apart is compared by dense bit sketches, whose Hamming
distance is a lower bound of the symmetric difference too, and verified pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import Stretches, checkpointed, frugal, mapped, mixed, sliced, table, units
from millrace.llm.components import components

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Fewest bits of a dense sketch.
LEAST_SKETCH_BITS = 1024
#: Bytes of text hashed at a time in one worker.
HASH_BYTES = 2 << 20
#: Documents that are verified against one other in one task.
STAR_ROWS = 256
#: Ids of documents to verify that are broadcast at most; more are shuffled.
BROADCAST_IDS = 500_000
#: Pairs of two components that are verified in the first rounds; None: all that are left.
FIRST_PAIRS = (1, 16, None)
#: Fewest units, so that small inputs spread too.
LEAST_UNITS = 48

_U = np.uint64
_rng = np.random.default_rng(20240606)
_ODD = [_U(int(x) | 1) for x in _rng.integers(1 << 40, 1 << 62, 10)]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
def shingles(texts: list[str | None], lanes: int = 1) -> tuple[np.ndarray, ...]:
    """The distinct shingle hashes of all texts, ordered by text and hash, and each text's number of them.

    With two ``lanes`` the second hashes of the same shingles come before the numbers: what
    decides that sets or shingles are the same goes by 128 bits.
    """
    raw = [(x or "").encode("utf-8", "replace").lower() for x in texts]
    data = b" ".join(raw)
    if not data:
        return *(np.zeros(0, np.uint64) for _ in range(lanes)), np.zeros(len(raw), np.int64)
    buf = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(_IS_WORD[buf], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    stretches = Stretches(data)
    low = np.cumsum([0, *(len(x) + 1 for x in raw)])
    first = np.searchsorted(starts, low)
    n = np.diff(first)  # words of each text
    # A text's shingles start at all words but the last ones; a short text has one of all its words.
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(raw)), count)
    at = np.repeat(first[:-1] - np.cumsum(count) + count, count) + np.arange(count.sum())
    size = np.minimum(n[text], WORDS)
    short = size < WORDS
    found = []
    for lane in range(lanes):
        word = stretches.hashes(starts, ends, lane)
        h = size.astype(np.uint64) * _ODD[5 + lane]
        for i in range(WORDS):
            if len(word):
                more = mixed(h, lane) + word[np.minimum(at + i, len(word) - 1)]
                h = np.where(short & (size <= i), h, more) if i and short.any() else more
        found.append(mixed(h, lane))
    order = np.lexsort((found[0], text))
    h, text = found[0][order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return *(x[order][new] for x in found), np.bincount(text[new], minlength=len(raw))


def _bands(most: int = 1 << 40) -> list[tuple[int, int]]:
    out, low = [], 1
    while low < most:
        high = max(low, int(low * 1.6))
        out.append((low, high))
        low = high + 1
    return out


BANDS = np.array(_bands())


def difference(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
    """The largest symmetric difference of linked sets of sizes ``a`` and ``b``."""
    return (a + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def pieces(band: np.ndarray) -> np.ndarray:
    most = difference(BANDS[band, 1], BANDS[band, 1])
    return most + 3 + most // 8


def keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set, key) of all sets: two linked sets have a key in common."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    home = np.searchsorted(BANDS[:, 1], n)
    text = np.repeat(np.arange(len(n)), n)
    starts = np.cumsum(n) - n
    for up in (0, 1):
        band = home + up
        # In the next band stand the sets that are large enough for a partner there.
        use = (n > 0) & ((up == 0) | (n * DENOMINATOR >= BANDS[band, 0] * NUMERATOR))
        sets = np.flatnonzero(use)
        if not len(sets):
            continue
        p = np.where(use, pieces(band), 0)
        base = np.cumsum(p) - p
        mine = use[text]
        t, x = text[mine], h[mine]
        at = base[t] + ((x >> _U(20)) % p[t].astype(np.uint64)).astype(np.int64)
        value, full = np.zeros(int(p.sum()), np.uint64), np.zeros(int(p.sum()), bool)
        np.bitwise_xor.at(value, at, mixed(x + _ODD[7]))
        full[at] = True
        owner = np.repeat(np.arange(len(n)), p)
        piece = np.arange(len(value)) - base[owner]
        key = mixed(value + mixed(piece.astype(np.uint64) * _ODD[8] + band[owner].astype(np.uint64)))
        out.append((owner[full], key[full]))
        # Sets with so many empty pieces that the untouched ones might all be empty.
        partner = np.minimum(BANDS[band, 1], n * DENOMINATOR // NUMERATOR)
        empty = p - np.bincount(owner, weights=full, minlength=len(n)).astype(np.int64)
        for i in np.flatnonzero(use & (empty >= p - difference(n, partner))).tolist():
            head = h[starts[i] : starts[i] + n[i] - -(-n[i] * NUMERATOR // DENOMINATOR) + 1]
            out.append((np.full(len(head), i), mixed(head * _ODD[9] + _U(int(band[i])))))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate([o for o, _ in out]), np.concatenate([k for _, k in out])


def sketches(h: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Dense parity sketches of twice as many bits as shingles at least, a power of two of them.

    A sketch folds to fewer bits by XOR of its parts, and stays a parity sketch.
    """
    size = np.maximum(LEAST_SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    ends = np.cumsum(size)
    bits = np.zeros(int(size.sum()), np.uint8)
    of = np.repeat(np.arange(len(n)), n)
    np.bitwise_xor.at(bits, (ends - size)[of] + (h & (size[of] - 1).astype(np.uint64)).astype(np.int64), np.uint8(1))
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[(e - k) // 8 : e // 8] for e, k in zip(ends.tolist(), size.tolist(), strict=True)]


def fold(blobs: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of words, folded to ``size`` bytes each."""
    out = np.empty((len(blobs), size // 8), np.uint64)
    own = np.fromiter(map(len, blobs), np.int64, len(blobs))
    for k in np.unique(own).tolist():
        at = np.flatnonzero(own == k)
        out[at] = np.bitwise_xor.reduce(np.frombuffer(b"".join(blobs[i] for i in at.tolist()), np.uint64).reshape(len(at), k // size, size // 8), axis=1)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], lanes: int = 1) -> Iterator[tuple]:
    """(ids, shingles of each lane, sizes) of a few rows at a time."""
    for b in batches:
        texts = pc.fill_null(b.column(1), "")
        for low, high in sliced(texts, HASH_BYTES):
            yield b.column(0).slice(low, high - low), *shingles(texts.slice(low, high - low).to_pylist(), lanes)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, h, h2, n in _blocks(batches, 2):
        ends = np.cumsum(n)
        sums = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(x)))) for x in (h, h2))
        one, two = (x[ends] - x[ends - n] for x in sums)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sketches(h, n), pa.binary())], ["id", "n", "one", "two", "sketch"])


def _candidates(docs: DataFrame, n_units: int) -> DataFrame:
    """(gid, id) of the documents that have a key in common with another."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids_, h, n in _blocks(batches):
            ids = ids_.to_numpy()
            # Of equal sets met together the first stands for all.
            ends = np.cumsum(n)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(h ^ _ODD[2]))))
            total = sums[ends] - sums[ends - n]
            order = np.lexsort((ids, total, n))
            first = np.ones(len(n), bool)
            first[order[1:]] = (total[order[1:]] != total[order[:-1]]) | (n[order[1:]] != n[order[:-1]])
            keep = first & (n > 0)
            of, key = keys(h[np.repeat(keep, n)], n[keep])
            doc = ids[keep][of]
            unit = (key % _U(n_units)).astype(np.int64)
            value = key // _U(n_units)
            order = np.lexsort((doc, unit))
            unit, doc, value = unit[order], doc[order], value[order]
            cuts = np.flatnonzero(np.diff(unit)) + 1
            rows, names = [], []
            for u, d, v in zip(np.split(unit, cuts), np.split(doc, cuts), np.split(value, cuts), strict=True):
                if len(u):
                    names.append(int(u[0]))
                    rows.append(np.diff(d, prepend=0).tobytes() + v.astype(np.uint32).tobytes() + (v >> _U(32)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(rows, pa.binary())], ["unit", "blob"])

    def meet(rows: pa.Table) -> pa.Table:
        docs_, values = [], []
        for blob in rows["blob"].to_pylist():
            n = len(blob) // 13
            docs_.append(np.cumsum(np.frombuffer(blob, np.int64, n)))
            values.append(np.frombuffer(blob, np.uint32, n, 8 * n) | np.frombuffer(blob, np.uint8, n, 12 * n).astype(np.uint64) << _U(32))
        doc, value = np.concatenate(docs_), np.concatenate(values)
        order = np.lexsort((doc, value))
        doc, value = doc[order], value[order]
        new = np.ones(len(doc), bool)
        new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        doc, value = doc[new], value[new]
        same = value[1:] == value[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        gid = value[keep].astype(np.int64) * n_units + rows["unit"][0].as_py()
        return pa.table({"gid": pa.array(gid, pa.int64()), "id": pa.array(doc[keep], pa.int64())})

    return mapped(docs, send, "unit int, blob binary").groupBy("unit").applyInArrow(frugal(meet), "gid long, id long")


def _common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Marks the shingles of ``a``, by two hashes each, that the set ``b``, ordered by the first, has."""
    if not len(b[0]):
        return np.zeros(len(a[0]), bool)
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return (b[0][at] == a[0]) & (b[1][at] == a[1])


def _linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    both = int(_common(a, b).sum())
    return DENOMINATOR * both >= NUMERATOR * (len(a[0]) + len(b[0]) - both)


def _verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked, and links found beside them.

    The texts of the pairs' documents travel once for each document ``b`` they are verified
    against, those against one ``b`` in as many parts as their number asks for. Of texts
    of one id the smallest counts.
    """
    pairs = checkpointed(pairs.select("a", "b"))
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    members = pairs.join(parts, "b").select(F.col("a").alias("id"), F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    hubs = parts.select(F.col("b").alias("id"), F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    stars = members.union(hubs).join(texts, "id").repartition("hub", "part").sortWithinPartitions("hub", "part")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _runs(batches, ("hub", "part")):
            links: list[tuple[int, int]] = []
            for low, high in _slices(whole, ("hub", "part")):
                links += _star(whole.slice(low, high - low))
            yield _pairs([x for x, _ in links], [x for _, x in links])

    return mapped(stars.select("hub", "part", "id", "text"), check, "a long, b long")


def _star(rows: pa.RecordBatch) -> list[tuple[int, int]]:
    """Links of a hub with its members, and of members without one with all others."""
    hub = rows.column("hub")[0].as_py()
    texts: dict[int, str] = {}
    for i, t in zip(rows.column("id").to_pylist(), rows.column("text").to_pylist(), strict=True):
        texts[i] = min(t or "", texts.get(i, t or ""))
    every = sorted(texts)
    h, h2, n = shingles([texts[i] for i in every], 2)
    cuts = np.cumsum(n)[:-1]
    sets = dict(zip(every, zip(np.split(h, cuts), np.split(h2, cuts), strict=True), strict=True))
    links = [(i, hub) for i in every if i != hub and _linked(sets[i], sets[hub])]
    apart = sorted(set(every) - {hub} - {i for i, _ in links})
    if apart and len(every) > 2:
        begin = np.concatenate(([0], np.cumsum(n)))
        for i in apart:
            inside = np.concatenate(([0], np.cumsum(_common((h, h2), sets[i]))))
            both = inside[begin[1:]] - inside[begin[:-1]]
            hit = np.flatnonzero(DENOMINATOR * both >= NUMERATOR * (n + len(sets[i][0]) - both))
            links += [(i, every[k]) for k in hit.tolist() if every[k] != i]
    return links


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bounds(rows: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in keys:
        x = rows.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _slices(rows: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[tuple[int, int]]:
    at = _bounds(rows, keys).tolist()
    return zip(at, [*at[1:], len(rows)], strict=True)


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a run of equal keys ends, of sorted rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        if held and all(held[-1].column(k)[-1] == b.column(k)[0] for k in keys) and len(_bounds(b, keys)) == 1:
            held.append(b)
            continue
        whole = pa.Table.from_batches([*held, b]).combine_chunks().to_batches()[0]
        last = int(_bounds(whole, keys)[-1])
        if last:
            yield whole.slice(0, last)
        held = [whole.slice(last)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _by_size(rows: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups whose smallest sketches are of one size, and their sketches folded to it."""
    at = _bounds(rows, ("gid",))
    own = np.asarray(pc.binary_length(rows.column("sketch")))
    least = np.repeat(np.minimum.reduceat(own, at), np.diff(at, append=len(rows))) if len(rows) else own
    for size in np.unique(least).tolist():
        some = rows.take(pa.array(np.flatnonzero(least == size)))
        yield some, fold(some.column("sketch").to_pylist(), size)


def _near(n: np.ndarray, m: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Whether sizes and the distance of sketches allow a link."""
    return (np.minimum(n, m) * DENOMINATOR >= np.maximum(n, m) * NUMERATOR) & (distance <= difference(n, m))


def _to_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of each group's members and its first one, where a link is possible."""
    for rows, bits in (x for whole in _runs(batches, ("gid",)) for x in _by_size(whole)):
        at = _bounds(rows, ("gid",))
        ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
        hub = np.repeat(at, np.diff(at, append=len(rows)))
        distance = np.bitwise_count(bits ^ bits[hub]).sum(1).astype(np.int64)
        ok = _near(n, n[hub], distance) & (ids != ids[hub])
        yield pa.RecordBatch.from_arrays([pa.array(ids[ok]), pa.array(ids[hub][ok]), pa.array(distance[ok])], ["a", "b", "distance"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, distance) of all members of a group in different components, where a link is possible."""
    for rows, bits in (x for whole in _runs(batches, ("gid",)) for x in _by_size(whole)):
        ids, part, n = rows.column("id").to_numpy(), rows.column("component").to_numpy(), rows.column("n").to_numpy()
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(3)]
        at = _bounds(rows, ("gid",))
        end = np.append(at[1:], len(rows))
        two = np.flatnonzero(end - at == 2)
        jobs = [(at[two], at[two] + 1)]
        for low, high in zip(at.tolist(), end.tolist(), strict=True):
            if high - low > 2:
                jobs += [(np.full(high - i - 1, i), np.arange(i + 1, high)) for i in range(low, high - 1)]
        for i, j in jobs:
            apart = part[i] != part[j]
            i, j = i[apart], j[apart]
            if len(i):
                distance = np.bitwise_count(bits[i] ^ bits[j]).sum(1).astype(np.int64)
                ok = _near(n[i], n[j], distance)
                for o, x in zip(out, (np.maximum(ids[i], ids[j])[ok], np.minimum(ids[i], ids[j])[ok], distance[ok]), strict=True):
                    o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["a", "b", "distance"])


def link_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``df``.

    ``component_id`` is the smallest id that links reach. Words are what stands between
    ASCII white space, in lower case (A-Z); a set holds the distinct runs of ``WORDS`` words,
    or the one run of all words of a shorter text. Null and empty texts have no shingles and
    link with nothing. Repeated rows give equal rows; of rows of one id with different texts
    the smallest text is verified. A row without an id is given back with a null component.
    Texts are hashed in place; what is shuffled are keys, 13 bytes for about two shingles,
    sketches of documents that have a key in common, and the texts of documents to verify.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = docs.filter("id IS NOT NULL")
    columns = "id long, n long, one long, two long, sketch binary"
    measured = checkpointed(mapped(known, _measure, columns))
    some = measured.filter("n > 0")
    # Equal sets: the smallest id stands for all.
    first = checkpointed(some.groupBy("one", "two", "n").agg(F.min("id").alias("rep")))  # a table of its own, so that the join can split a hot set
    reps = checkpointed(some.select("id", "one", "two", "n").join(first, ["one", "two", "n"]).groupBy("id").agg(F.min("rep").alias("rep")))
    groups = checkpointed(_candidates(known, units(docs, least=LEAST_UNITS)).join(reps, "id").select("gid", F.col("rep").alias("id")).distinct())
    # Of groups of the same documents one is enough.
    marks = groups.groupBy("gid").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("low"), F.max("id").alias("high")).filter("m > 1")
    chosen = marks.groupBy("m", "x", "low", "high").agg(F.min("gid").alias("gid")).select("gid")
    sketch = some.select("id", "n", "sketch").join(reps.filter("id = rep").select("id"), "id").dropDuplicates(["id"])
    groups = checkpointed(groups.join(chosen, "gid").join(sketch, "id").select("gid", "id", "n", "sketch"))
    to_hubs = mapped(groups.repartition("gid").sortWithinPartitions("gid", "id"), _to_hubs, "a long, b long, distance long")
    best = to_hubs.groupBy("a").agg(F.min_by("b", F.struct("distance", "b")).alias("b"))
    copies = reps.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = checkpointed(_verify(known, best).union(copies))
    parts = components(links)
    # Groups that still have several components: all pairs across them that sketches allow.
    placed = groups.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("gid")
    rest = placed.join(apart, "gid").select("gid", "id", "component", "n", "sketch").repartition("gid").sortWithinPartitions("gid", "id")
    pairs = checkpointed(mapped(rest, _across, "a long, b long, distance long").distinct())
    # One link joins two components: the nearest pairs of each two are verified first, then more, then all.
    for most in FIRST_PAIRS:
        ends = [parts.select(F.col("id").alias(c), F.col("component").alias(f"p{c}")) for c in ("a", "b")]
        open_ = pairs.join(ends[0], "a", "left").join(ends[1], "b", "left").withColumns({"pa": F.coalesce("pa", "a"), "pb": F.coalesce("pb", "b")}).filter("pa <> pb")
        two = Window.partitionBy(F.least("pa", "pb"), F.greatest("pa", "pb")).orderBy("distance", "a", "b")
        open_ = checkpointed(open_.select("a", "b", "distance", F.row_number().over(two).alias("k")))
        if not open_.limit(1).count():
            break
        links = checkpointed(links.union(_verify(known, open_ if most is None else open_.filter(F.col("k") <= most))))
        parts = components(links)
        if most is not None:
            pairs = open_.filter(F.col("k") > most).select("a", "b", "distance")
    out = measured.select("id", F.col("n").alias("n_shingles")).join(parts, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    lost = mapped(docs.filter("id IS NULL"), _measure, columns)
    return out.unionByName(lost.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: the size of its set and the smallest document that links reach."""
    return link_components(table(spark, sf_dir, "documents"))
