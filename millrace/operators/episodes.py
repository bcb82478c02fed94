"""Operators on episodes, their frames and tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.offsets import global_index, running_offsets, slots_of
from millrace.shared import checkpointed


@dataclass(frozen=True)
class Joined:
    episodes: DataFrame
    frames: DataFrame


@dataclass(frozen=True)
class Tables:
    episodes: DataFrame
    frames: DataFrame
    tasks: DataFrame


# --- frames and episodes ------------------------------------------------------------------


def range_join(frames: DataFrame, episodes: DataFrame, keys: Sequence[str], index: str, low: str, high: str, carry: Sequence[str]) -> DataFrame:
    """Frames with ``carry`` of the episode whose range ``[low, high)`` has their index.

    Ranges of one key do not overlap: instead of joining all ranges of a key with all its
    frames, each frame takes the last range that begins at or before it, by a window over
    the union of both, and is left out where that range has ended. Both sides are dealt to slots by
    approximate quantiles of the index, and a slot begins with the last range of the key's slots
    before, so that a key with very many frames goes to several tasks.
    """
    e = episodes.select(*keys, F.col(low).alias("__at"), F.lit(0).alias("__k"), F.struct(F.col(high).alias("high"), *carry).alias("__e"))
    f = frames.select(*keys, F.col(index).alias("__at"), F.lit(1).alias("__k"), F.struct("*").alias("__f"))
    both = e.unionByName(f, allowMissingColumns=True).withColumn("__key", F.struct(*keys))
    both = both.withColumn("__slot", slots_of(e.select("__at").union(f.select("__at")), "__at", int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    lasts = both.groupBy("__key", "__slot").agg(F.max_by("__e", F.when(F.col("__k") == 0, F.col("__at"))).alias("__last"))
    before = Window.partitionBy("__key").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)  # one row a slot
    base = lasts.select("__key", "__slot", F.last("__last", ignorenulls=True).over(before).alias("__base"))
    w = Window.partitionBy("__key", "__slot").orderBy("__at", "__k").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__e", F.last("__e", ignorenulls=True).over(w)).filter("__k = 1").join(base, ["__key", "__slot"])
    found = seen.withColumn("__e", F.coalesce("__e", "__base")).filter(F.col("__at") < F.col("__e.high"))
    kept = [F.col(f"__f.`{c}`").alias(c) for c in frames.columns if c not in carry]
    return found.select(*kept, *(F.col(f"__e.`{c.strip('`')}`").alias(c.strip("`")) for c in carry))


def frames_of_episodes(episodes: DataFrame, frames: DataFrame, skip_malformed: bool = False) -> Joined:
    """Frames with their episode's index, and episodes that have as many frames as their length."""
    keys = ["root", "data/chunk_index", "data/file_index"]
    keys_ = [f"`{k}`" for k in keys]
    joined = range_join(frames.drop("episode_index"), episodes, keys_, "index", "dataset_from_index", "dataset_to_index", ["episode_index"])
    counts = joined.groupBy("root", "episode_index").agg(F.count("*").alias("__n"))
    checked = episodes.join(counts, ["root", "episode_index"], "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    if skip_malformed:
        good = checked.filter(F.col("__n") == F.col("length")).drop("__n")
        return Joined(good, joined.join(good.select("root", "episode_index"), ["root", "episode_index"], "left_semi"))
    told = F.concat(F.lit("episode "), F.col("episode_index").cast("string"), F.lit(" has "), F.col("__n").cast("string"), F.lit(" frames"))
    good = checked.withColumn("length", F.when(F.col("__n") == F.col("length"), F.col("length")).otherwise(F.raise_error(told).cast("bigint"))).drop("__n")
    return Joined(good, joined)


def nest_frames(episodes: DataFrame, frames: DataFrame, keys: Sequence[str], column: str = "frames") -> DataFrame:
    """Episodes with their frames as an array in the order of ``frame_index``; without frames it is empty."""
    names = [c for c in frames.columns if c not in keys]
    first = F.struct("frame_index", *(F.col(f"`{c}`") for c in names if c != "frame_index"))
    nested = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(first)).alias(column))
    return episodes.join(nested, list(keys), "left").withColumn(column, F.coalesce(column, F.array().cast(nested.schema[column].dataType)))


def explode_frames(df: DataFrame, column: str = "frames", position: str = "frame_index") -> DataFrame:
    """One row a frame, numbered from 0."""
    rest = [c for c in df.columns if c != column]
    out = df.select(*rest, F.posexplode(column).alias(position, "__f"))
    names = [f.name for f in df.schema[column].dataType.elementType if f.name != position]
    return out.select(*rest, F.col(position).cast("bigint").alias(position), *(F.col(f"__f.`{n}`").alias(n) for n in names))


def select_frames(df: DataFrame, keep: Column, keys: Sequence[str], order: str = "frame_index") -> DataFrame:
    """Frames for which ``keep`` is true, numbered anew from 0 in each episode."""
    w = Window.partitionBy(*keys).orderBy(f"__old_{order}")
    kept = df.filter(keep).withColumnRenamed(order, f"__old_{order}")
    return kept.withColumn(order, (F.row_number().over(w) - 1).cast("bigint")).drop(f"__old_{order}")


def delete_episodes(episodes: DataFrame, frames: DataFrame, dropped: DataFrame, keys: Sequence[str]) -> Joined:
    return Joined(episodes.join(dropped, list(keys), "left_anti"), frames.join(dropped, list(keys), "left_anti"))


def synthetic_timestamps(fps: Column, index: str = "frame_index") -> Column:
    return (F.col(index) / fps).cast("float")


def episode_id(c: Column) -> Column:
    """An episode's id as text; "-1" where there is none."""
    return F.coalesce(c.cast("string"), F.lit("-1"))


def concat_states(*states: Column) -> Column:
    """Several state vectors of a frame as one."""
    return F.concat(*states)


# --- motion -------------------------------------------------------------------------------


def motion_energy(vector: Column, keys: Sequence[str], order: str) -> Column:
    """Mean absolute step of a vector from the frame before, in single precision; 0 for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(vector).over(w)
    steps = F.zip_with(vector, before, lambda a, b: F.abs(a.cast("float") - b.cast("float")))
    mean = F.aggregate(steps, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float")) / F.size(vector)
    return F.when(before.isNull(), F.lit(0.0).cast("float")).otherwise(mean.cast("float"))


def motion_bounds(frames: DataFrame, keys: Sequence[str], order: str, vectors: Sequence[str], threshold: float = 0.001, pad_frames: int = 0) -> DataFrame:
    """For each episode ``start``, ``end`` (inclusive) and ``n`` of its frames; null bounds without motion.

    A frame moves where the energy of any vector is above the threshold. The kept part begins
    one frame before the first that moves, less the padding, and ends with the last, plus it.
    """
    if threshold < 0 or pad_frames < 0:
        raise ValueError("threshold and pad_frames are not negative")
    marked = frames
    for i, v in enumerate(vectors):
        marked = marked.withColumn(f"__e{i}", motion_energy(F.col(v), keys, order))
    moves = F.greatest(*(F.col(f"__e{i}") for i in range(len(vectors))), F.lit(0.0).cast("float")) > F.lit(threshold).cast("float")
    active = F.when(moves, F.col(order))
    got = marked.groupBy(*keys).agg(F.min(active).alias("first"), F.max(active).alias("last"), F.count("*").alias("n"))
    return got.select(*keys, F.greatest(F.lit(0), F.col("first") - 1 - pad_frames).alias("__s"), F.least(F.col("n") - 1, F.col("last") + pad_frames).alias("__t"), "n", "first").select(
        *keys, F.when(F.col("first").isNotNull(), F.col("__s")).cast("bigint").alias("start"), F.when(F.col("first").isNotNull(), F.col("__t")).cast("bigint").alias("end"), "n"
    )


def motion_trim(frames: DataFrame, keys: Sequence[str], vectors: Sequence[str], threshold: float = 0.001, pad_frames: int = 0, order: str = "frame_index", timestamp: str = "timestamp") -> DataFrame:
    """Frames between the motion bounds, numbered anew, times shifted to begin at 0 in single precision.

    An episode without motion keeps no frames.
    """
    bounds = motion_bounds(frames, keys, order, vectors, threshold, pad_frames)
    kept = frames.join(bounds, list(keys)).filter(F.col(order).between(F.col("start"), F.col("end")))
    base = F.min(F.col(timestamp).cast("float")).over(Window.partitionBy(*keys))
    shifted = kept.withColumn(timestamp, (F.col(timestamp).cast("float") - base).cast("float"))
    return shifted.withColumn(order, (F.col(order) - F.col("start")).cast("bigint")).drop("start", "end", "n")


def trim_clip(video: Column, start_s: Column, end_s: Column, keeps_tail: Column) -> Column:
    """A video's bounds after a trim, relative to its current view; the old end where the tail is kept."""
    low = F.coalesce(video["from_s"], F.lit(0.0))
    return F.struct(video["uri"].alias("uri"), (low + start_s).alias("from_s"), F.when(keeps_tail, video["to_s"]).otherwise(low + end_s).alias("to_s"))


def frame_windows(frames: DataFrame, keys: Sequence[str], offsets: Sequence[int], values: Sequence[str], stride: int = 1, drop_incomplete: bool = True, order: str = "frame_index") -> DataFrame:
    """For each ``stride``-th frame the values of the frames at ``offsets`` from it, as ``<value>_<offset>``."""
    if stride < 1 or not offsets:
        raise ValueError("stride is positive and offsets are given")
    w = Window.partitionBy(*keys).orderBy(order)
    out, there = frames, F.lit(True)
    for k, o in enumerate(offsets):
        moved = lambda c, o=o: F.lead(c, o).over(w) if o >= 0 else F.lag(c, -o).over(w)
        out = out.withColumn(f"__at{k}", moved(F.col(order)))
        hit = F.coalesce(F.col(f"__at{k}") == F.col(order) + o, F.lit(False))
        there = there & hit
        for v in values:
            out = out.withColumn(f"{v}_{o}", F.when(hit, moved(F.col(v))))
    out = out.withColumn("__there", there).filter(F.col(order) % stride == 0)
    out = out.filter("__there") if drop_incomplete else out
    return out.drop("__there", *(f"__at{k}" for k in range(len(offsets))))


# --- tasks and merging --------------------------------------------------------------------


def merge_tasks(tasks: DataFrame, source: str, text: str, index: str) -> tuple[DataFrame, DataFrame]:
    """The merged dictionary (text, index), and the numbers to change: (source, index, new).

    The first source keeps its numbers; texts of later ones reuse a number or get the next
    ones, by source and old number, both whole numbers.
    """
    order = F.struct(source, index)
    first = tasks.groupBy(text).agg(F.min(order).alias("__o"))
    low = tasks.agg(F.min(source).alias("__low"))
    placed = first.crossJoin(F.broadcast(low)).withColumn("__own", F.col(f"__o.{source}") == F.col("__low"))
    top = placed.filter("__own").agg(F.coalesce(F.max(f"__o.{index}"), F.lit(-1)).alias("__top"))
    at = F.col(f"__o.{source}").cast("decimal(19,0)") * F.lit(1 << 60).cast("decimal(19,0)") + F.col(f"__o.{index}")
    later = global_index(placed.filter("NOT __own").withColumn("__at", at), "__at", "__nth").crossJoin(F.broadcast(top))
    merged = placed.filter("__own").select(text, F.col(f"__o.{index}").cast("bigint").alias(index)).unionByName(later.select(text, (F.col("__top") + 1 + F.col("__nth")).cast("bigint").alias(index)))
    remap = tasks.join(merged.withColumnRenamed(index, "new"), text).filter(F.col(index) != F.col("new")).select(source, index, "new")
    return merged, remap


def remap_tasks(frames: DataFrame, remap: DataFrame, source: str, index: str) -> DataFrame:
    """Frames with the merged task numbers; numbers without a change stay."""
    out = frames.join(remap, [source, index], "left")
    return out.withColumn(index, F.coalesce("new", index)).drop("new")


def check_tasks(frames: DataFrame, tasks: DataFrame, index: str) -> DataFrame:
    """``frames``, failing on a task number that the dictionary does not have; nulls pass."""
    known = frames.join(tasks.select(index).distinct().withColumn("__known", F.lit(True)), index, "left")
    bad = F.col(index).isNotNull() & F.col("__known").isNull()
    return known.withColumn(index, F.when(bad, F.raise_error(F.concat(F.lit("unknown task "), F.col(index).cast("string"))).cast("bigint")).otherwise(F.col(index))).drop("__known")


def renumber_duplicates(df: DataFrame, index: str, order: str, output: str | None = None) -> DataFrame:
    """``df`` with unique numbers: the first row of each keeps it, later ones get the next free ones by ``order``."""
    output = output or index
    nth = F.row_number().over(Window.partitionBy(index).orderBy(order))
    marked = df.withColumn("__dup", (nth > 1).cast("int"))
    top = df.agg(F.max(index).alias("__top"))
    placed = running_offsets(marked, [], order, "__dup", "__k").crossJoin(F.broadcast(top))
    new = F.when(F.col("__dup") == 1, F.col("__top") + 1 + F.col("__k")).otherwise(F.col(index)).cast("bigint")
    return placed.withColumn("__new", new).drop("__dup", "__k", "__top", *([index] if output == index else [])).withColumnRenamed("__new", output)


def positional_merge(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Columns of both sides by row address; every address must be on both sides exactly once."""
    counted = left.select(row, F.lit(1).alias("__l"), F.lit(0).alias("__r")).union(right.select(row, F.lit(0), F.lit(1))).groupBy(row).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    bad = counted.filter("__l <> 1 OR __r <> 1").limit(1).collect()
    if bad:
        raise ValueError(f"row {bad[0][0]} stands {bad[0]['__l']} times on the left and {bad[0]['__r']} times on the right")
    return left.join(right, row)


# --- tables to write ----------------------------------------------------------------------


def feature_map(schema: T.StructType) -> dict:
    """Names of types and shapes for a description; arrays have no fixed length here."""
    kinds = {T.LongType: "int64", T.IntegerType: "int32", T.FloatType: "float32", T.DoubleType: "float64", T.BooleanType: "bool", T.StringType: "string"}
    out = {}
    for f in schema:
        inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else f.dataType
        out[f.name] = {"dtype": kinds.get(type(inner), inner.simpleString()), "shape": [None] if isinstance(f.dataType, T.ArrayType) else [1]}
    return out


def episode_tables(df: DataFrame) -> Tables:
    """Episode, frame and task tables of rows with ``frames`` and ``tasks`` (see ``EpisodeSink``)."""
    if "episode_index" in df.columns:
        keyed = renumber_duplicates(df.withColumn("__seq", F.col("episode_index")), "episode_index", "__seq").drop("__seq")
    else:
        keyed = global_index(checkpointed(df.withColumn("__seq", F.monotonically_increasing_id())), "__seq", "episode_index").drop("__seq")
    keyed = keyed.withColumn("length", F.size("frames").cast("bigint"))
    placed = running_offsets(keyed, [], "episode_index", "length", "dataset_from_index").withColumn("dataset_to_index", F.col("dataset_from_index") + F.col("length"))
    texts = placed.select("episode_index", F.posexplode(F.col("tasks")).alias("__p", "task")).groupBy("task").agg(F.min(F.struct("episode_index", "__p")).alias("__o"))
    numbered = texts.withColumn("__at", F.col("__o.episode_index") * (1 << 20) + F.col("__o.__p"))
    tasks = global_index(numbered, "__at", "task_index").select("task", "task_index")
    frames = explode_frames(placed.select("episode_index", "dataset_from_index", "frames", F.get("tasks", F.lit(0)).alias("__task")))
    frames = frames.withColumn("index", F.col("dataset_from_index") + F.col("frame_index")).drop("dataset_from_index", "task_index")
    frames = frames.join(tasks, frames["__task"] == tasks["task"], "left").drop("__task", "task")
    episodes = placed.drop("frames").withColumn("data/chunk_index", F.lit(0)).withColumn("data/file_index", F.lit(0))
    return Tables(episodes, frames, tasks)
