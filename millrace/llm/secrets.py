"""Secret scans with DataFrame functions only: fixed patterns and windowed entropy.

Fixed patterns give spans of three kinds. A fourth kind comes from candidate strings, runs
of key characters: a window slides over each run, the counts of its characters are kept
by adding the character that enters and taking off the one that leaves, and from them
the Shannon entropy of the window follows in constant time, whatever the length of the run. Runs whose windows reach the
threshold of their character class are spans, unless the allow-list knows the run or a
fixed pattern has it already. Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import table

KINDS = ("assign", "access", "hex", "entropy")
#: The patterns of the three fixed kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Characters of candidate strings, and the length from which a run of them is one.
RUN = "[A-Za-z0-9+/_=-]"
WINDOW = 20
#: Window starts of a run that are measured together, and numbers that hold a window's counts.
BLOCK, LANES = 512, 7
#: Entropy in bits that a window must reach, by the run's character class.
THRESHOLDS = {"hex": 3.055, "alnum": 3.755, "base64": 3.855}
#: Runs that are no secrets: no digit or no letter in them, placeholders, UUIDs, dates.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)(example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh)",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}",
)

#: With ``parts``, what the whole run must be to be no secret, and what excuses only the stretch that has it.
ALLOWED_RUNS = (*ALLOWED[:2], ALLOWED[3], ALLOWED[4] + "$")
ALLOWED_STRETCH = ALLOWED[2]

_SPAN = "array<struct<start:bigint,end:bigint>>"


def _parts(text: Column, pattern: str, *groups: int) -> list[Column]:
    """For each leftmost match of ``pattern``: what stands before it, itself, its groups.

    The pattern also matches nothing at the end of the text, so that the lazy prefix never
    runs to the end in vain.
    """
    whole = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    return [F.regexp_extract_all(text, whole, F.lit(g)) for g in (1, 2, *groups)]


def _walk(zipped: Column, keep) -> Column:
    """Spans of the matches that ``keep`` accepts, from the lengths of all parts."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, m: Column) -> Column:
        low = acc["at"] + F.length(m["gap"])
        high = low + F.length(m["hit"])
        span = F.array(F.struct(low.cast("bigint").alias("start"), high.cast("bigint").alias("end")))
        return F.struct(high.cast("bigint").alias("at"), F.when((F.length(m["hit"]) > 0) & keep(m), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _spans(text: Column, pattern: str, keep, *groups: int) -> Column:
    """Spans of a pattern; texts without a match are told by the pattern alone."""
    names = ["gap", "hit", "value"]
    zipped = F.arrays_zip(*(c.alias(n) for c, n in zip(_parts(text, pattern, *groups), names, strict=False)))
    return F.when(F.rlike(text, F.lit(pattern)), _walk(zipped, keep)).otherwise(F.array().cast(_SPAN))


def _entropy(run: Column) -> Column:
    """Spans in a run of the windows that reach its class's threshold, those that touch joined.

    A run is measured in blocks of ``BLOCK`` window starts, so that time and memory grow with its
    length and no faster.
    """
    least = F.when(run.rlike("^[0-9a-fA-F]*$"), THRESHOLDS["hex"]).when(run.rlike("^[A-Za-z0-9]*$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    cut = F.lit(f"(?s)(.{{1,{BLOCK}}})(?=(.{{0,{WINDOW - 1}}}))")
    blocks = F.zip_with(F.regexp_extract_all(run, cut, F.lit(1)), F.regexp_extract_all(run, cut, F.lit(2)), lambda a, b: F.concat(a, b))
    moved = lambda b, k: F.transform(_high(b["text"], b["least"]), lambda s: F.struct((s["start"] + k * BLOCK).alias("start"), (s["end"] + k * BLOCK).alias("end")))
    # The threshold goes with each block, so that it is found once.
    known = F.transform(F.array(F.struct(blocks.alias("texts"), least.alias("least"))), lambda x: F.transform(x["texts"], lambda t: F.struct(t.alias("text"), x["least"].alias("least"))))
    return _once(F.flatten(F.transform(F.flatten(known), moved)), _joined)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is found once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joined(spans: Column) -> Column:
    """Sorted spans, those that touch as one."""
    starts = F.filter(spans, lambda s, k: (k == 0) | (F.get(spans, k - 1)["end"] < s["start"]))
    ends = F.filter(spans, lambda s, k: (k == F.size(spans) - 1) | (F.get(spans, k + 1)["start"] > s["end"]))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def _high(text: Column, least: Column) -> Column:
    """Spans in a block of the windows that reach ``least`` bits, those that touch joined.

    The counts of a window's characters are fields of 5 bits, twelve to a number; ``sum`` is the
    sum of c * log2(c) over them. One character in and one out change two of its terms.
    """
    term = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 2)))
    place = lambda c: F.struct(F.floor((F.ascii(c) - 43) / 12).cast("int").alias("lane"), ((F.ascii(c) - 43) % 12 * 5).alias("shift"))
    unit = lambda p: F.call_function("shiftleft", F.lit(1).cast("bigint"), p["shift"])
    full = lambda p: F.struct(p["lane"].alias("lane"), p["shift"].alias("shift"), unit(p).alias("unit"))
    codes = F.transform(F.transform(F.split(text, ""), place), full)
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), LANES).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(_SPAN).alias("out"))

    def walk(codes: Column) -> Column:
        count = lambda counts, p: F.call_function("shiftright", F.get(counts, p["lane"]), p["shift"]).bitwiseAND(31).cast("int")

        def step(acc: Column, i: Column) -> Column:
            came, left = F.get(codes, i), F.get(codes, i - WINDOW)  # null while the first window fills
            was_left = count(acc["counts"], left)
            same = (left["lane"] == came["lane"]) & (left["shift"] == came["shift"])
            was_came = count(acc["counts"], came) - F.when(same, 1).otherwise(0)
            gone = F.coalesce(F.get(term, was_left - 1) - F.get(term, was_left), F.lit(0.0))
            total = acc["sum"] + gone + F.get(term, was_came + 1) - F.get(term, was_came)
            counts = F.transform(acc["counts"], lambda v, k: v + F.when(k == came["lane"], came["unit"]).otherwise(0) - F.when(k == left["lane"], left["unit"]).otherwise(0))
            hit = (i >= WINDOW - 1) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= least)
            low, high, n = (i - (WINDOW - 1)).cast("bigint"), (i + 1).cast("bigint"), F.size(acc["out"])
            before = F.get(acc["out"], n - 1)
            joined = F.when((n > 0) & (before["end"] >= low), F.concat(F.slice(acc["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.struct(before["start"].alias("start"), high.alias("end")))))
            return F.struct(counts.alias("counts"), total.alias("sum"), F.when(hit, F.coalesce(joined, F.concat(acc["out"], F.array(F.struct(low.alias("start"), high.alias("end")))))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["out"])

    return _once(codes, walk)


def _uncovered(run: Column, base: Column) -> Column:
    """array<struct<start, run>> of the stretches of a run, ``WINDOW`` long at least, that no span of the sorted ``base`` covers."""
    end = run["start"] + F.length(run["run"])
    start = F.struct(run["start"].alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, b: Column) -> Column:
        high = F.least(b["start"], end)
        span = F.array(F.struct(acc["at"].alias("start"), high.alias("end")))
        return F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.when(high - acc["at"] >= WINDOW, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    last = F.array(F.struct(end.alias("start"), end.alias("end")))  # what follows the base spans ends with the run
    cut = F.aggregate(F.concat(base, last), start, step, lambda acc: acc["out"])
    return F.transform(cut, lambda s: F.struct(s["start"].alias("start"), F.substring(run["run"], (s["start"] - run["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).alias("run")))


def _candidates(text: Column, allowed: tuple[str, ...] = ALLOWED) -> Column:
    """array<struct<start, run>> of the runs that no allow-list pattern knows."""
    pattern = rf"(?<!{RUN}){RUN}{{{WINDOW},}}"
    gaps, hits = _parts(text, pattern)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,run:string>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        low = (acc["at"] + F.length(m["gap"])).cast("bigint")
        known = F.length(m["hit"]) == 0
        for p in allowed:
            known = known | m["hit"].rlike(p)
        return F.struct((low + F.length(m["hit"])).cast("bigint").alias("at"), F.when(known, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(low.alias("start"), m["hit"].alias("run"))))).alias("out"))

    found = F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<start:bigint,run:string>>"))


def _kind(spans: str, number: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))


def _count(kind: str) -> Column:
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def scan(df: DataFrame, text_col: str = "text", parts: bool = False, name: str = "secrets") -> DataFrame:
    """``df`` with ``secrets``: array<struct<start, kind, end>> in the order of start, then kind.

    Narrow and without Python: each text is scanned whole by itself. A null or empty text
    has no spans; repeated rows are scanned each by itself; columns of ``df`` stay, but one
    that is named ``name`` is replaced.

    A run that touches a fixed pattern's span, or has an allowed word or date anywhere, gives
    no entropy span. With ``parts`` only the covered part of it gives none: the stretches of
    ``WINDOW`` characters or more between the fixed spans are measured by themselves, an
    allowed word excuses only the high stretch it stands in, and a date only a run that is one.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != name]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = df.select(
        *keep,
        _spans(text, ASSIGN, lambda m: F.length(m["value"]) >= LEAST_VALUE, 4).alias("__assign"),
        _spans(text, rf"{ACCESS[:-1]}{{{LEAST_ACCESS - 4},}}", lambda m: F.lit(True)).alias("__access"),
        _spans(text, rf"{HEX[:-1]}{{{LEAST_HEX},}}", lambda m: F.lit(True)).alias("__hex"),
        _candidates(text, ALLOWED_RUNS if parts else ALLOWED).alias("__runs"),
    )
    fixed = F.concat("__assign", "__access", "__hex")
    runs = F.flatten(F.transform("__runs", lambda r: _uncovered(r, F.array_sort(fixed)))) if parts else F.col("__runs")
    measured = F.filter(F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["run"].alias("run"), _entropy(r["run"]).alias("w"))), lambda m: F.size(m["w"]) > 0)
    moved = lambda m, low, high: F.struct((m["start"] + low).cast("bigint").alias("start"), (m["start"] + high).cast("bigint").alias("end"))
    whole = lambda m: moved(m, F.get(m["w"], F.lit(0))["start"], F.get(m["w"], F.size(m["w"]) - 1)["end"])
    if parts:
        words = lambda m, s: F.substring(m["run"], (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).rlike(ALLOWED_STRETCH)
        single = lambda m: F.transform(F.filter(m["w"], lambda s: ~words(m, s)), lambda s: moved(m, s["start"], s["end"]))
        joint = lambda m: F.struct(F.get(m["w"], F.lit(0))["start"].alias("start"), F.get(m["w"], F.size(m["w"]) - 1)["end"].alias("end"))
        high = F.flatten(F.transform(measured, lambda m: F.when(words(m, joint(m)), single(m)).otherwise(F.array(whole(m)))))
    else:
        high = F.filter(F.transform(measured, whole), lambda s: ~F.exists(fixed, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    extra = F.when(F.size("__runs") > 0, high).otherwise(F.array().cast(_SPAN))
    found = found.withColumn("__entropy", extra)
    named = [_kind(f"__{k}", i) for i, k in enumerate(KINDS)]
    out = F.transform(F.array_sort(F.concat(*named)), lambda s: F.struct(s["start"].alias("start"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    return found.select(*keep, out.alias(name))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]", name: str = "secrets") -> DataFrame:
    """``df`` with the spans of :func:`scan` with ``parts`` replaced by ``mark``; overlapping spans count as one; ``name`` is a column of its own meanwhile."""
    text = F.col(f"`{text_col}`")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        low = F.greatest(acc["at"], s["start"])
        new = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (low - acc["at"]).cast("int")), F.when(s["start"] >= acc["at"], F.lit(mark)).otherwise(F.lit("")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["end"] > acc["at"], new).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate(name, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    found = scan(df, text_col, parts=True, name=name)
    return found.withColumn(text_col, F.when(F.size(name) > 0, cut).otherwise(text)).drop(name)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: spans of each fixed kind, their hash, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), parts=True)
    base = F.filter("secrets", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", *map(_count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
