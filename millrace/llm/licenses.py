"""License scans with a positional index over rare words.

Each template is a sequence of words with mandatory key phrases at fixed places. The index
maps a word to its postings, (template, position), and weighs it by its inverse document
frequency over the templates. The words of the files are looked up in the index, with all
their places. A template is entered through the file's words of its highest-IDF mandatory
word: each place of it gives a start. The places of the next mandatory words, by descending
IDF, are intersected with it by their relative positions, and what is left after the last
has all key phrases in place. Words are bytes, and many texts are scanned at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Stretches, mapped, sliced, table

_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


@dataclass(frozen=True)
class Template:
    """``text`` as lower-case words; ``keys`` are (position, words) that must stand there."""

    label: str
    text: str
    keys: tuple[tuple[int, str], ...] = ()
    base: bool = False

    @property
    def words(self) -> list[bytes]:
        return [w.encode() for w in self.text.split()]

    @property
    def mandatory(self) -> list[tuple[int, bytes]]:
        keys = self.keys or ((0, self.text),)
        return [(at + i, w.encode()) for at, phrase in keys for i, w in enumerate(phrase.split())]


#: The base phrases and their labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
#: Templates of license notices; words outside the key phrases may differ.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", ((3, "apache license version 2 0"),)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ((6, "gnu general public license version 3"),)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ((6, "gnu general public license version 2"),)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ((2, "cc by nc 4 0"),)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ((2, "cc by sa 4 0"),)),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", ((0, "permission is hereby granted"), (8, "any person obtaining a copy"))),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided", ((0, "redistribution and use"), (7, "forms with or without modification"))),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ((6, "mozilla public license"),)),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
        "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
        "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without "
        "warranty of any kind express or implied",
        ((0, "permission is hereby granted free of charge"), (38, "rights to use copy modify merge publish distribute sublicense")),
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies",
        ((0, "permission to use copy modify and or distribute this software"), (13, "with or without fee")),
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        ((0, "redistribution and use in source and binary forms"), (21, "redistributions of source code must retain")),
    ),
    Template(
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy "
        "of the license at http www apache org licenses license 2 0",
        ((0, "licensed under the apache license version 2 0"), (11, "you may not use this file except in compliance with the license")),
    ),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version",
        ((5, "you can redistribute it and or modify it under the terms of the gnu general public license"),),
    ),
    Template(
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ((2, "free and unencumbered software released into the public domain"),),
    ),
)


class Index:
    """Postings of the words of all templates."""

    def __init__(self, templates: tuple[Template, ...] = BASE + NOTICES):
        self.templates = templates
        found: dict[bytes, set[int]] = {}
        for k, t in enumerate(templates):
            for w in t.words:
                found.setdefault(w, set()).add(k)
        every = sorted(found)
        self.idf = {w: math.log(len(templates) / len(ks)) for w, ks in found.items()}
        number = {w: i for i, w in enumerate(every)}
        self.words = [np.array([number[w] for w in t.words]) for t in templates]
        #: Of each template its mandatory (position, word), rarest first; longer words first among equals.
        self.checks = [[(p, number[w]) for p, w in sorted(t.mandatory, key=lambda x: (-self.idf[x[1]], -len(x[1]), x[0]))] for t in templates]
        self.bytes = Stretches(b"".join(every))
        self.high = np.cumsum([len(w) for w in every])
        self.low = self.high - np.array([len(w) for w in every])
        hashes = self.bytes.hashes(self.low, self.high)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for those that no template has."""
        out = np.full(len(starts), -1, np.int64)
        text = Stretches(data)
        hashes = text.hashes(starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        some = np.flatnonzero(self.hashes[at] == hashes)
        word = self.order[at[some]]
        same = text.same(starts[some], ends[some], self.bytes, self.low[word], self.high[word])
        out[some[same]] = word[same]
        return out

    def find(self, data: bytes, starts: np.ndarray, ends: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(template, words at which it starts, shares of its words in place) of all places.

        ``starts`` and ``ends`` are the words' offsets in ``data``, ``doc_of`` their texts.
        """
        number, n = self.numbers(data, starts, ends), len(starts)
        at = np.flatnonzero(number >= 0)
        at = at[np.argsort(number[at], kind="stable")]
        cuts = np.searchsorted(number[at], np.arange(len(self.high) + 1))
        places = [at[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for k, checks in enumerate(self.checks):
            start = places[checks[0][1]] - checks[0][0]
            for p, w in checks[1:]:
                if not len(start):
                    break
                there = places[w]
                near = np.minimum(np.searchsorted(there, start + p), max(len(there) - 1, 0))
                start = start[there[near] == start + p] if len(there) else start[:0]
            first, last = min(p for p, _ in checks), max(p for p, _ in checks)
            start = start[doc_of[start + first] == doc_of[start + last]] if len(start) else start
            if not len(start):
                continue
            place = start[:, None] + np.arange(len(self.words[k]))
            inside = (place >= 0) & (place < n)
            place = place.clip(0, n - 1)
            held = inside & (doc_of[place] == doc_of[start + first][:, None]) & (number[place] == self.words[k])
            yield k, start, held.mean(1)


_FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
])


def _scan(index: Index, texts: list[str]) -> list[list]:
    """A column of ``_FIELDS`` each, over the texts."""
    raw = [x.encode("utf-8", "surrogatepass").lower() for x in texts]
    data = b"\n".join(raw)
    flags = _IS_WORD[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    low = np.cumsum([0, *(len(x) + 1 for x in raw)])
    first = np.searchsorted(starts, low)  # each text's first word
    doc_of = np.searchsorted(low, starts, side="right") - 1
    places: dict[int, list[tuple[int, int, float]]] = {}
    for k, at, shares in index.find(data, starts, ends, doc_of):
        for o, d, share in zip(at.tolist(), doc_of[at + index.checks[k][0][0]].tolist(), shares.tolist(), strict=True):
            places.setdefault(d, []).append((o, k, share))
    rows = []
    for d in range(len(texts)):
        hits = places.get(d, ())
        base = [o - int(first[d]) for o, k, _ in hits if index.templates[k].base]
        names = {index.templates[k].label for _, k, _ in hits if index.templates[k].base}
        every = {index.templates[k].label for _, k, _ in hits}
        rows.append((int(first[d + 1] - first[d]), len(base), min(base, default=None), max(base, default=None), ",".join(sorted(names)), ",".join(sorted(every)), max((s for _, _, s in hits), default=0.0)))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in _FIELDS]


def scan(df: DataFrame, text_col: str = "text", templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """``df`` with what the index finds in each text; narrow, one pass, no shuffle.

    ``n_words``, ``n_base`` (places of base phrases), ``first_word`` and ``last_word`` (their
    smallest and largest start, else null), ``base_labels``, ``labels`` and ``score``, the
    largest share of a template's words that stand in place, 0 without any. Null and empty
    texts have no words, empty labels and score 0. Texts of any length are read whole;
    repeated rows are scanned each by itself; columns of ``df`` with these names are replaced.
    """
    given = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in _FIELDS.fieldNames()])
    at = given.columns.index(text_col)
    schema = T.StructType([*given.schema.fields, *_FIELDS.fields])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for whole in batches:
            texts = pc.fill_null(whole.column(at).cast(pa.string()), "")
            for start, end in sliced(texts):
                found = _scan(index, texts.slice(start, end - start).to_pylist())
                part = whole.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], [*part.schema.names, *_FIELDS.fieldNames()])

    return mapped(given, run, schema)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: words, base phrases with their places, labels and score."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
