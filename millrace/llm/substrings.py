"""Removal of byte strings that an earlier document has, by bounded interval expansion on a BWT.

Any string of ``LENGTH`` bytes has one anchor, the place of the least hash among its
``GRAM``-byte parts, and equal strings have equal anchors. A segment is the union of the
neighbouring strings of one anchor. Documents are dealt into chunks. First only hashes of
the chunks' anchors are shuffled, to find those that more than one document has; they
decide nothing else. The segments of such anchors then travel to their anchor's unit, equal
ones of a chunk, compared byte by byte, as one class with its earliest document. A unit joins
its classes to one text, of equal classes one with the range of its documents, builds the
Burrows-Wheeler transform and expands intervals of repeated strings backwards, breadth
first, dropping those of one document, until ``LENGTH`` is reached. Each interval left is
a string that several documents have; all but the earliest lose it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Stretches, frugal, mixed, table, units

LENGTH, GRAM = 50, 20
#: Strings whose anchors are looked for at a time, and bytes transformed at a time, in one worker.
BLOCK_STRINGS, BWT_BYTES = 1 << 16, 1 << 20
#: Steps of the expansion after which intervals of one document are dropped.
DROP_EVERY = 4
#: Fewest chunks and units, so that small inputs spread too.
LEAST_UNITS = 48

_U = np.uint64
_rng = np.random.default_rng(20240517)
_ODD = (_rng.integers(1 << 28, 1 << 31, 6).astype(np.uint32) * np.uint32(2)) | np.uint32(1)
#: Ends a piece; no byte of UTF-8.
_END = 0xFF


def least_parts(data: np.ndarray) -> np.ndarray:
    """For each string of ``data`` the least hash of its parts; the low 5 bits are the part's place modulo 32."""
    n = len(data) - 3
    word = np.empty(n, np.uint32)
    raw = data.tobytes()
    for r in range(4):
        word[r::4] = np.frombuffer(raw, "<u4", len(range(r, n, 4)), r)
    g = n + 4 - GRAM
    h = word[:g] * _ODD[0]
    for i in range(1, GRAM // 4):
        h += word[4 * i : 4 * i + g] * _ODD[i]
    h ^= h >> np.uint32(15)
    h *= _ODD[5]
    h &= np.uint32(0xFFFFFFE0)
    h |= np.arange(g, dtype=np.uint32) & np.uint32(31)
    size, parts = 1, LENGTH - GRAM + 1
    while size < parts:
        shift = min(size, parts - size)
        h = np.minimum(h[:-shift], h[shift:])
        size += shift
    return h


class Chunk:
    """The documents of a chunk, those of the smallest ids first and those without one last.

    Order and segments follow from the rows alone, so that each pass finds the same again.
    """

    def __init__(self, rows: pa.Table):
        rows = rows.select(["id", "text"]).sort_by([("id", "ascending"), ("text", "ascending")])
        self.ids = rows["id"]
        texts = pc.fill_null(rows["text"].cast(pa.large_binary()), b"").combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks or [pa.array([], pa.large_binary())])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        self.data = memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]].tobytes()
        cuts = offsets - offsets[0]
        self.every = cuts
        known = len(rows) - self.ids.null_count
        self.doc = self.ids.slice(0, known).to_numpy()
        self.starts, self.ends = cuts[:known], cuts[1 : known + 1]
        self.stretches = Stretches(self.data)

    def split(self) -> None:
        """The segments' first and last strings, texts and anchors, and the distinct anchors."""
        buf = np.frombuffer(self.data, np.uint8)[: self.ends[-1] if len(self.ends) else 0]
        strings = len(buf) - LENGTH + 1
        long = self.ends - self.starts >= LENGTH
        begin, stop = self.starts[long], self.ends[long] - LENGTH + 1  # of the strings inside a text
        lows, highs, places = ([np.zeros(0, np.int64)] for _ in range(3))
        for a in range(0, strings, BLOCK_STRINGS):
            b = min(a + BLOCK_STRINGS, strings)
            least = least_parts(buf[a : b + LENGTH - 1])
            new = np.empty(b - a, bool)
            new[0] = True
            np.not_equal(least[1:], least[:-1], out=new[1:])
            i, j = np.searchsorted(begin, (a, b)).tolist()
            new[begin[i:j] - a] = True
            m, n = np.searchsorted(stop, (a, b)).tolist()
            new[stop[m:n] - a] = True
            at = np.flatnonzero(new)
            inside = np.searchsorted(begin, at + a, side="right") > np.searchsorted(stop, at + a, side="right")
            until = np.append(at[1:], b - a) - 1
            at, until = at[inside], until[inside]
            lows.append(at + a)
            highs.append(until + a)
            places.append(at + a + ((least[at].astype(np.int64) - at) & 31))
        self.low, self.high, place = (np.concatenate(x) for x in (lows, highs, places))
        self.text = np.searchsorted(self.starts, self.low, side="right") - 1
        word = self.stretches.words
        anchor = mixed(mixed(mixed(word[place]) ^ word[place + 8]) ^ word[place + GRAM - 8])
        order = np.argsort(anchor, kind="stable")  # segments by anchor, in the order of their documents
        self.low, self.high, self.text, anchor = (x[order] for x in (self.low, self.high, self.text, anchor))
        first = np.ones(len(anchor), bool)
        first[1:] = anchor[1:] != anchor[:-1]
        self.head = np.flatnonzero(first)
        self.of = np.cumsum(first) - 1
        self.anchors = anchor[self.head]

    def several(self) -> np.ndarray:
        """Whether more than one document has an anchor."""
        last = np.append(self.head[1:], len(self.text))[: len(self.head)] - 1
        return self.doc[self.text[self.head]] != self.doc[self.text[last]]

    def dealt(self, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(unit, its anchors)."""
        unit = (self.anchors % _U(n)).astype(np.int64)
        order = np.argsort(unit, kind="stable")
        cuts = np.flatnonzero(np.diff(unit[order])) + 1
        for some in np.split(order, cuts) if len(order) else ():
            yield int(unit[some[0]]), some


def classes(stretches: Stretches, group: np.ndarray, low: np.ndarray, high: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the stretches by group, content and document, and marks where a new content begins in it.

    Hashes bring equal contents together and bytes tell whether they are equal; contents of
    one hash that alternate in the order are more than one class each, which costs time only.
    """
    order = np.lexsort((low, doc, stretches.hashes(low, high), group))
    g, a, b = group[order], low[order], high[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | ~stretches.same(a[1:], b[1:], stretches, a[:-1], b[:-1])
    return order, new


def suffixes(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of ``s`` in the order of their first 64 bytes, their places in it, and groups of the first 8 bytes by suffix."""
    n = len(s)
    raw = s.tobytes() + bytes([_END]) * 8
    key = np.empty(n, np.uint64)
    for r in range(8):
        key[r::8] = np.frombuffer(raw, ">u8", len(range(r, n, 8)), r)
    order = np.argsort(key).astype(np.int32)
    key = key[order]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.full(n + 64, n, np.int32)  # the first place of a suffix's group
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    eight = rank[:n].copy()
    for size in (8, 16, 32):
        single = new.copy()
        single[:-1] &= new[1:]
        at = np.flatnonzero(~single)
        if not len(at):
            break
        some = order[at]
        key = rank[some].astype(np.uint64) << _U(32) | rank[some + size].astype(np.uint64)
        by = np.argsort(key)
        key, some = key[by], some[by]
        order[at] = some
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        new[at] = first
        rank[some] = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    return order, place, eight


def least_documents(data: np.ndarray, sizes: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
    """For each string of ``LENGTH`` bytes of each piece, piece by piece, the smallest document that has it.

    A piece stands in documents from ``lowest`` to ``highest`` (numbers from 0). Strings that only one
    document has get the largest int32.
    """
    none = np.iinfo(np.int32).max
    n = int(sizes.sum()) + len(sizes)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    s = np.full(n, _END, np.uint8)
    inside = np.ones(n, bool)
    inside[ends] = False
    s[inside] = data
    suffix, place, eight = suffixes(s)
    before = suffix - 1  # of the first suffix: the last symbol, an end
    bwt, step = s[before], place[before]  # the symbol before each suffix, and where the suffix with it stands
    low, high = (np.repeat(x.astype(np.int32), sizes + 1)[suffix] for x in (lowest, highest))

    # One row for each string, found by its last 8 bytes, grows by the byte before it.
    strings = sizes - LENGTH + 1
    done = np.cumsum(strings)
    end = np.repeat(starts - done + strings, strings) + np.arange(done[-1]) + LENGTH
    mark = np.zeros(n, bool)
    key = np.empty(n, np.int64)
    at = place[end - 8]
    key[at] = eight[end - 8]
    mark[at] = True
    for depth in range(8, LENGTH + 1):
        rows = np.flatnonzero(mark)
        mark[rows] = False
        k = key[rows]
        new = np.ones(len(rows), bool)
        new[1:] = k[1:] != k[:-1]
        interval = np.cumsum(new) - 1
        if depth % DROP_EVERY == 0 or depth == LENGTH:
            begin = np.flatnonzero(new)
            if not len(begin):
                break
            least = np.minimum.reduceat(low[rows], begin)
            keep = (least != np.maximum.reduceat(high[rows], begin))[interval]
            rows, interval = rows[keep], interval[keep]
        if depth == LENGTH:
            break
        to = step[rows]
        key[to] = interval << 8 | bwt[rows]
        mark[to] = True
    out = np.full(int(done[-1]), none, np.int32)
    if len(rows):
        at = suffix[rows]
        owner = np.searchsorted(starts, at, side="right") - 1
        out[at - starts[owner] + (done - strings)[owner]] = least[interval]
    return out


def runs(hit: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of marked places that belong to one ``of``."""
    at = np.flatnonzero(hit)
    cut = np.ones(len(at), bool)
    cut[1:] = (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])
    first = np.flatnonzero(cut)
    return at[first], at[np.append(first[1:], len(at)) - 1] if len(at) else at


def _wire(*arrays: np.ndarray) -> bytes:
    """Arrays after their lengths and kinds."""
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), a.dtype.itemsize, a.dtype.kind == "u"))], np.int64)
    return b"".join([head.tobytes(), *(a.tobytes() for a in arrays)])


def _unwire(blob: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, np.int64, 1)[0])
    head = np.frombuffer(blob, np.int64, 3 * count, 8).reshape(count, 3).tolist()
    out, at = [], 8 + 24 * count
    for n, size, unsigned in head:
        out.append(np.frombuffer(blob, f"{'u' if unsigned else 'i'}{size}", n, at))
        at += n * size
    return out


def expanded(groups: list[tuple[int, list[np.ndarray]]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(chunk, starts, ends) of what is removed, from the classes that a unit has got.

    A chunk sends of its classes the anchors, documents and sizes, their bytes, and of their members
    the class and the place in the chunk.
    """
    anchor, doc, size, data = (np.concatenate([g[1][i] for g in groups]) for i in range(4))
    size = size.astype(np.int64)
    high = np.cumsum(size)
    stretches = Stretches(data.tobytes())
    order, new = classes(stretches, anchor, high - size, high, doc)
    piece = np.empty(len(order), np.int64)  # of each class, the content that stands for it
    piece[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    ids, number = np.unique(doc, return_inverse=True)
    lowest, highest = number[order[first]], number[order[last]]
    low, until = (high - size)[order[first]], high[order[first]]
    a = anchor[order[first]]
    # Pieces of an anchor are transformed together.
    ends = np.append(np.flatnonzero(a[1:] != a[:-1]) + 1, len(a))
    done = np.cumsum(until - low)
    least, at = [], 0
    while at < len(a):
        to = int(ends[min(max(np.searchsorted(done[ends - 1], (done[at - 1] if at else 0) + BWT_BYTES, side="right") - 1, np.searchsorted(ends, at, side="right")), len(ends) - 1)])
        text = b"".join([stretches.data[x:y] for x, y in zip(low[at:to].tolist(), until[at:to].tolist(), strict=True)])
        least.append(least_documents(np.frombuffer(text, np.uint8), (until - low)[at:to], lowest[at:to], highest[at:to]))
        at = to
    flat = np.concatenate(least)
    strings = until - low - LENGTH + 1
    offset = np.cumsum(strings) - strings
    # Each class's strings, and which of them an earlier document has.
    count = strings[piece]
    begin = np.cumsum(count) - count
    of = np.repeat(np.arange(len(count)), count)
    hit = flat[np.repeat(offset[piece] - begin, count) + np.arange(count.sum())] < number[of]
    start, stop = runs(hit, of)
    owner = of[start]
    lo, hi = np.searchsorted(owner, np.arange(len(count) + 1))[:-1], np.searchsorted(owner, np.arange(len(count)), side="right")
    out, base = [], 0
    for chunk, (own, _, _, _, member, where) in groups:
        k = base + member
        n = hi[k] - lo[k]
        run = np.repeat(lo[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shift = np.repeat(where.astype(np.int64) - begin[k], n)
        if len(run):
            out.append((chunk, start[run] + shift, stop[run] + shift + LENGTH))
        base += len(own)
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, kept, spans) of each row: its bytes without those covered by a string of
    ``LENGTH`` bytes that also starts in a row of a smaller id, and the removed runs.

    Texts are whole UTF-8 bytes; a null or empty text is empty and gives an empty rest. Rows
    of one id take nothing from each other; a row without an id keeps everything and takes nothing;
    repeated rows are given back each. Very long texts are looked at in blocks. Equal segments
    of a chunk are one class, so that any number of copies costs a unit one class a chunk.
    Three passes read one shuffle of the texts; anchors are shuffled once, 6 bytes for about
    16 of text, and bytes once, those of anchors that several documents have. The number
    of chunks and units grows with the input. Other columns of ``df`` are not carried.
    """
    n = units(df.select(F.col(f"`{text_col}`").alias("text")), least=LEAST_UNITS)
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))

    def send_anchors(rows: pa.Table) -> pa.Table:
        number = rows["chunk"][0].as_py()
        c = Chunk(rows)
        c.split()
        value = (c.anchors // _U(n)) << _U(1) | c.several().astype(np.uint64)
        return _table([(unit, number, _wire(value[k].astype(np.uint32), (value[k] >> _U(32)).astype(np.uint16))) for unit, k in c.dealt(n)])

    def judge(rows: pa.Table) -> pa.Table:
        unit = rows["unit"][0].as_py()
        chunks, parts = rows["chunk"].to_pylist(), [_unwire(x) for x in rows["blob"].to_pylist()]
        value = np.concatenate([a | b.astype(np.uint64) << _U(32) for a, b in parts])
        order = np.argsort(value >> _U(1), kind="stable")
        v = value[order]
        first = np.ones(len(v), bool)
        first[1:] = v[1:] >> _U(1) != v[:-1] >> _U(1)
        at = np.flatnonzero(first)
        shared = (np.diff(at, append=len(v)) > 1) | (np.maximum.reduceat(v & _U(1), at) > 0)
        needed = np.empty(len(v), bool)
        needed[order] = shared[np.cumsum(first) - 1]
        cuts = np.cumsum([len(a) for a, _ in parts])[:-1]
        return _table([(unit, chunk, np.packbits(x).tobytes()) for chunk, x in zip(chunks, np.split(needed, cuts), strict=True) if x.any()])

    def send_bytes(texts: pa.Table, needs: pa.Table) -> pa.Table:
        if not len(texts) or not len(needs):
            return _table([])
        number = texts["chunk"][0].as_py()
        c = Chunk(texts)
        c.split()
        told = dict(zip(needs["unit"].to_pylist(), needs["blob"].to_pylist(), strict=True))
        needed = np.zeros(len(c.anchors), bool)
        for unit, k in c.dealt(n):
            if unit in told:
                needed[k] = np.unpackbits(np.frombuffer(told[unit], np.uint8), count=len(k)).astype(bool)
        some = np.flatnonzero(needed[c.of])
        low, high, doc, of = c.low[some], c.high[some] + LENGTH, c.doc[c.text[some]], c.of[some]
        order, new = classes(c.stretches, of, low, high, doc)
        low, high, doc, of = (x[order] for x in (low, high, doc, of))
        first = np.flatnonzero(new)
        kind = np.cumsum(new) - 1
        # Members later than the earliest of their class are removed whole.
        gone = doc > doc[first][kind] if len(first) else new
        out = [(number % n, number, b"\0" + _wire(low[gone].astype(np.uint32), high[gone].astype(np.uint32)))]
        member = np.flatnonzero(~gone)
        own = of[first]  # the anchors of the classes, ascending
        for unit, k in c.dealt(n):
            k = k[needed[k]]
            if not len(k):
                continue
            a, b = np.searchsorted(own, k), np.searchsorted(own, k, side="right")
            mine = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
            f = first[mine]
            data = b"".join([c.data[x:y] for x, y in zip(low[f].tolist(), high[f].tolist(), strict=True)])
            lo, hi = np.searchsorted(kind[member], mine), np.searchsorted(kind[member], mine, side="right")
            count = hi - lo
            m = member[np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())]
            out.append((unit, number, b"\1" + _wire(c.anchors[of[f]], doc[f], (high - low)[f].astype(np.uint32), np.frombuffer(data, np.uint8), np.repeat(np.arange(len(mine)), count).astype(np.uint32), low[m].astype(np.uint32))))
        return _table(out)

    def expand(rows: pa.Table) -> pa.Table:
        out, groups = [], []
        for chunk, blob in zip(rows["chunk"].to_pylist(), rows["blob"].to_pylist(), strict=True):
            if blob[:1] == b"\0":
                out.append((0, chunk, blob[1:]))
            else:
                groups.append((chunk, _unwire(blob[1:])))
        if groups:
            out += [(0, chunk, _wire(a.astype(np.uint32), b.astype(np.uint32))) for chunk, a, b in expanded(groups)]
        return _table(out)

    def finish(texts: pa.Table, spans: pa.Table) -> pa.Table:
        if not len(texts):
            return _RESULT.empty_table()
        c = Chunk(texts)
        change = np.zeros(len(c.data) + 1, np.int32)
        for blob in spans["blob"].to_pylist() if len(spans) else ():
            low, high = _unwire(blob)
            np.add.at(change, low, 1)
            np.add.at(change, high, -1)
        removed = np.cumsum(change[:-1]) > 0
        edge = np.flatnonzero(np.diff(removed, prepend=False, append=False))
        # Runs end with their texts.
        inner = np.unique(c.every[(c.every > 0) & (c.every < len(removed))])
        cuts = inner[removed[inner] & removed[inner - 1]]
        begin, end = np.sort(np.concatenate((edge[::2], cuts))), np.sort(np.concatenate((edge[1::2], cuts)))
        of = np.searchsorted(c.every, begin, side="right") - 1
        sizes = np.diff(c.every)
        kept = np.frombuffer(c.data, np.uint8)[~removed]
        left = np.concatenate(([0], np.cumsum(~removed)))[c.every]
        spans_ = pa.StructArray.from_arrays([pa.array(begin - c.every[of]), pa.array(end - c.every[of])], ["start", "end"])
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(sizes) + 1)), pa.int32()), spans_)
        whole = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(left.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
        return pa.table([c.ids, pa.array(sizes, pa.int64()), whole, lists], schema=_RESULT)

    blob = "unit int, chunk int, blob binary"
    anchors = docs.groupBy("chunk").applyInArrow(frugal(send_anchors), blob)
    needs = anchors.groupBy("unit").applyInArrow(frugal(judge), blob)
    sent = docs.groupBy("chunk").cogroup(needs.groupBy("chunk")).applyInArrow(frugal(send_bytes), blob)
    spans = sent.groupBy("unit").applyInArrow(frugal(expand), blob)
    out = docs.groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(frugal(finish), "id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


_BLOB = pa.schema([("unit", pa.int32()), ("chunk", pa.int32()), ("blob", pa.binary())])
_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _table(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_BLOB)], schema=_BLOB)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: sizes of its text and of what is removed, and a hash of the rest."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
