"""Byte-level BPE over whole partitions with a pair occurrence index.

All distinct words of a slice of documents lie in one linked list of symbols. An index
maps each mergeable pair to every position where it stands. Ranks that have positions
are applied in ascending order, each to all of its positions at once, and the lists of
the pairs that a merge creates are extended. A merge can only create pairs of a higher
rank than its own, so one ascending sweep gives what merging word by word gives.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import SLICE_BYTES, Stretches, mapped, sliced, table

#: Distinct words whose encodings a worker keeps at a time.
KEPT_WORDS = 400_000
#: Bytes of text whose words come under one index.
INDEX_BYTES = SLICE_BYTES
#: Bytes of text whose characters are looked at together.
SPLIT_BYTES = SLICE_BYTES // 8

_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pieces of a text inside which merges happen.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _kinds() -> np.ndarray:
    """For each code point 1 for letters, 2 for numbers, 3 for white space, else 0."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in enumerate((r"\p{L}+", r"\p{N}+", f"[{_SPACE}]+"), 1):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    return out


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            out[chr(256 + extra)] = b
            extra += 1
    return out


class Vocabulary:
    """Merges, byte symbols and token bytes of a byte-level BPE file, and the kinds of characters."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], _byte_chars()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        if size > 1 << 16:
            raise ValueError(f"vocabularies of more than {1 << 16} tokens are not supported: {size}")
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.kinds = _kinds()
        self.byte_ids = np.zeros(256, np.int32)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.left = np.array([vocab[a] for a, _ in pairs], np.int32)
        self.right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, -1 where no merge exists."""
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)


def encode_words(vocab: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in a row, and each word's number of tokens."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    sym = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    n = len(sym)
    if not n:
        return sym, lengths
    ends = np.cumsum(lengths)
    full = ends[lengths > 0]
    nxt = np.arange(1, n + 1, dtype=np.int32)
    nxt[full - 1] = -1
    prv = np.arange(-1, n - 1, dtype=np.int32)
    prv[np.concatenate(([0], full[:-1]))] = -1

    # The index: rank of a pair -> arrays of positions of its left symbol.
    at = np.flatnonzero(nxt >= 0).astype(np.int32)
    ranks = vocab.rank(sym[at], sym[at + 1])
    at, ranks = at[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    at, ranks = at[order], ranks[order]
    cuts = np.flatnonzero(np.diff(ranks)) + 1
    index: dict[int, list[np.ndarray]] = {}
    if len(at):
        for r, part in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
            index[r] = [part]
    active = sorted(index)

    while active:
        r = heapq.heappop(active)
        parts = index.pop(r)
        pos = parts[0] if len(parts) == 1 else np.concatenate(parts)
        a, b = vocab.left[r], vocab.right[r]
        q = nxt[pos]
        ok = (sym[pos] == a) & (q >= 0)
        ok &= sym[q] == b
        if not ok.all():
            pos = pos[ok]
        if not len(pos):
            continue
        if len(parts) > 1 or a == b:
            pos = np.unique(pos)
        if a == b and len(pos) > 1:  # of a chain of overlapping pairs every other one, from the left
            joined = nxt[pos[:-1]] == pos[1:]
            if joined.any():
                chain = np.concatenate(([True], ~joined))
                first = np.maximum.accumulate(np.where(chain, np.arange(len(pos)), 0))
                pos = pos[(np.arange(len(pos)) - first) % 2 == 0]
        q = nxt[pos]
        after = nxt[q]
        sym[pos] = vocab.made[r]
        sym[q] = -1
        nxt[q] = -1
        nxt[pos] = after
        has = after >= 0
        prv[after[has]] = pos[has]
        before = prv[pos]
        left = before[before >= 0]
        new = np.concatenate((left, pos[has]))
        if not len(new):
            continue
        ranks = vocab.rank(sym[new], sym[nxt[new]])
        ok = ranks >= 0
        new, ranks = new[ok], ranks[ok]
        if len(new) == 0:
            continue
        if len(new) == 1:
            _extend(index, active, int(ranks[0]), new)
            continue
        order = np.argsort(ranks, kind="stable")
        new, ranks = new[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(new)]
        heads = ranks[cuts[:-1]].tolist()
        for i, k in enumerate(heads):
            _extend(index, active, k, new[cuts[i] : cuts[i + 1]])

    alive = sym >= 0
    counts = np.zeros(len(words), np.int64)
    held = np.concatenate(([0], np.cumsum(alive)))
    counts = held[ends] - held[ends - lengths]
    return sym[alive], counts


def _extend(index: dict[int, list[np.ndarray]], active: list[int], rank: int, at: np.ndarray) -> None:
    if rank in index:
        index[rank].append(at)
    else:
        index[rank] = [at]
        heapq.heappush(active, rank)


def word_starts(kinds: np.ndarray, chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks where the words of ``WORDS`` start; ``first`` marks the first characters of texts."""
    kind = kinds[chars]
    n = len(chars)
    last = np.ones(n, bool)  # of its text
    last[:-1] = first[1:]
    before = np.empty_like(kind)
    before[0], before[1:] = 9, kind[:-1]
    before[first] = 9
    after = np.full(n, 9, np.uint8)
    after[:-1] = kind[1:]
    after[last] = 9
    blank = kind == 3
    spaced = np.zeros(n, bool)  # stands after a space, which belongs to its word
    spaced[1:] = chars[:-1] == 0x20
    spaced &= ~first
    out = np.where(blank, (before != 3) | ((after != 3) & (after != 9)), (before != kind) & ~spaced)
    quote = np.flatnonzero((chars == 0x27) & (before != 0) & ~spaced & (after == 1))
    if len(quote):
        one, two = chars[quote + 1], chars[np.minimum(quote + 2, n - 1)]
        pair = (quote + 2 < n) & ~first[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = pair & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        for at, size in ((quote[short], 2), (quote[long], 3)):
            out[at] = True
            out[at + 1] = False
            if size == 3:
                out[at + 2] = False
            end = at + size
            end = end[end < n]
            attached = (kind[end] == 1) & ~first[end]
            out[end[attached]] = True
    return out


class Encoder:
    """Encodes lists of texts, keeping the encodings of recent words.

    Words are looked up by a hash of their bytes, and their bytes are compared on each hit;
    words whose hash another one has got first are kept by their bytes.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(vocab.special, key=len, reverse=True))) + ")") if vocab.special else None
        self._flat = np.frombuffer(b"".join(vocab.token_bytes), np.uint8)
        self._sizes = np.array([len(x) for x in vocab.token_bytes], np.int64)
        self._at = np.cumsum(self._sizes) - self._sizes
        self._forget()

    def _forget(self) -> None:
        """Only the special tokens stay, a word each in the first rows."""
        special = list(self.vocab.special)
        self._special_row = {x: i for i, x in enumerate(special)}
        self._ids = np.array([self.vocab.special[x] for x in special], np.int32)
        self._counts = np.ones(len(special), np.int64)
        self._starts = np.arange(len(special))
        self._new: list[bytes] = []
        self._hash, self._row = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # ordered by the hash
        self._clash: dict[bytes, int] = {}
        self._data = bytearray()  # bytes of the words that have a hash, in the order of their rows
        self._low = np.zeros(len(special), np.int64)
        self._high = np.zeros(len(special), np.int64)

    def _learn(self) -> None:
        """Encodes the words met since the last call, all under one index."""
        if self._new:
            ids, counts = encode_words(self.vocab, self._new)
            self._ids, self._counts = np.concatenate((self._ids, ids)), np.concatenate((self._counts, counts))
            self._starts = np.cumsum(self._counts) - self._counts
            self._new = []

    def encode(self, slices: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts the token ids of all in a row, and each text's number of ids."""
        if len(self._hash) > KEPT_WORDS:
            self._forget()
        held = [self._rows(texts) for texts in slices]
        self._learn()
        for row, words in held:
            n = self._counts[row]
            done = np.concatenate(([0], np.cumsum(n)))
            ids = self._ids[np.repeat(self._starts[row] - done[:-1], n) + np.arange(done[-1])]
            yield ids, np.diff(done[np.cumsum(words)], prepend=0)

    def _rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word in the order of the texts, and each text's number of words."""
        if self._special is None or not any(map(self._special.search, texts)):
            return self._plain(texts)
        cut = [self._special.split(x) for x in texts]  # what stands at odd places is special
        row, words = self._plain(["" if i % 2 else x for parts in cut for i, x in enumerate(parts)])
        odd = [(k, x) for k, (i, x) in enumerate((i, x) for parts in cut for i, x in enumerate(parts)) if i % 2]
        row = np.insert(row, np.cumsum(words)[[k for k, _ in odd]], [self._special_row[x] for _, x in odd])
        words[[k for k, _ in odd]] = 1
        return row, np.add.reduceat(words, np.cumsum([0, *map(len, cut)])[:-1])

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without special tokens."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(sizes)
        first = np.zeros(len(chars), bool)
        first[(ends - sizes)[sizes > 0]] = True
        start = np.flatnonzero(word_starts(self.vocab.kinds, chars, first))
        data = joined.encode("utf-8", "surrogatepass")
        if len(data) == len(chars):
            low, high = start, np.append(start[1:], len(data))
        else:
            done = np.cumsum((1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF)).astype(np.int32))
            low = np.where(start > 0, done[start - 1], 0).astype(np.int64)
            high = np.append(low[1:], len(data))
        return self._lookup(Stretches(data), low, high), np.diff(np.searchsorted(start, ends), prepend=0)

    def _lookup(self, text: Stretches, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Rows of the words; those met for the first time get the next ones."""
        values, example, which = np.unique(text.hashes(low, high), return_index=True, return_inverse=True)
        row = np.empty(len(values), np.int64)
        near = np.minimum(np.searchsorted(self._hash, values), max(len(self._hash) - 1, 0))
        known = self._hash[near] == values if len(self._hash) else np.zeros(len(values), bool)
        row[known] = self._row[near[known]] if known.any() else 0
        new = np.flatnonzero(~known)
        if len(new):
            words = [text.data[a:b] for a, b in zip(low[example[new]].tolist(), high[example[new]].tolist(), strict=True)]
            row[new] = self._add(words)
            order = np.argsort(merged := np.concatenate((self._hash, values[new])), kind="stable")
            self._hash, self._row = merged[order], np.concatenate((self._row, row[new]))[order]
        out = row[which]
        kept = Stretches(bytes(self._data))
        for i in np.flatnonzero(~text.same(low, high, kept, self._low[out], self._high[out])).tolist():
            word = text.data[low[i] : high[i]]
            if word not in self._clash:
                self._clash[word] = int(self._add([word])[0])
            out[i] = self._clash[word]
        return out

    def _add(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        high = len(self._data) + np.cumsum(sizes)
        rows = len(self._low) + np.arange(len(words))
        self._low, self._high = np.concatenate((self._low, high - sizes)), np.concatenate((self._high, high))
        self._data += b"".join(words)
        self._new += words
        return rows

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The text of each run of ids; bytes that are not UTF-8 become U+FFFD."""
        sizes = self._sizes[ids]
        done = np.concatenate(([0], np.cumsum(sizes)))
        flat = self._flat[np.repeat(self._at[ids] - done[:-1], sizes) + np.arange(done[-1])].tobytes()
        until = done[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [flat[a:b].decode("utf-8", "replace") for a, b in zip(until[:-1], until[1:], strict=True)]


def encode_decode(df: DataFrame, tokenizer_path: str, text_col: str = "text", decode: bool = True) -> DataFrame:
    """``df`` with ``ids`` (little-endian unsigned 32-bit, as binary), ``n_tokens`` and ``decoded``.

    The vocabulary is a file of fixed size: it is read on the driver and broadcast. Narrow:
    no shuffle, one pass. Null texts count as empty (no ids, empty decoded text); repeated
    rows are encoded each by itself; whole texts of any length are encoded. Columns of
    ``df`` named like the new ones are replaced.
    """
    spark = df.sparkSession
    vocab = spark.sparkContext.broadcast(Vocabulary(tokenizer_path))
    keep = [c for c in df.columns if c not in ("ids", "n_tokens", "decoded")]
    given = df.select(*[F.col(f"`{c}`") for c in keep])
    at = keep.index(text_col)
    added = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())] + [T.StructField("decoded", T.StringType())] * decode
    schema = T.StructType([*given.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocab.value)
        for whole in batches:
            texts = pc.fill_null(whole.column(at).cast(pa.string()), "")
            for low, high in sliced(texts, INDEX_BYTES):
                spans = [(low + a, low + b) for a, b in sliced(texts.slice(low, high - low), SPLIT_BYTES)]
                for (start, end), (ids, counts) in zip(spans, encoder.encode([texts.slice(a, b - a).to_pylist() for a, b in spans]), strict=True):
                    flat, until = ids.astype("<u4").tobytes(), (4 * np.concatenate(([0], np.cumsum(counts)))).tolist()
                    new = [pa.array([flat[a:b] for a, b in zip(until[:-1], until[1:], strict=True)], pa.binary()), pa.array(counts, pa.int64())]
                    if decode:
                        new.append(pa.array(encoder.decode(ids, counts), pa.string()))
                    part = whole.slice(start, end - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *(f.name for f in added)])

    return mapped(given, run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its number of tokens, and hashes of its ids and of the decoded text."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
