"""Episode datasets: an episode table, a frame table and a dictionary of tasks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import episodes as ops


@dataclass(frozen=True)
class EpisodeData:
    """Episodes, their frames keyed by ``(root, episode_index)``, and the merged tasks."""

    episodes: DataFrame
    frames: DataFrame
    tasks: DataFrame

    def nested(self, column: str = "frames") -> DataFrame:
        """Episodes with their frames as an array in the order of ``frame_index``."""
        return ops.nest_frames(self.episodes, self.frames, ["root", "episode_index"], column)


def read_lerobot(spark: SparkSession, roots: str | Sequence[str], skip_malformed_rows: bool = False) -> EpisodeData:
    """Several roots as one dataset.

    Frames belong to the episode of their root, chunk and file whose range has their index;
    their ``episode_index`` becomes that episode's. Task dictionaries are merged: the first
    root keeps its numbers, later tasks join by text or get new ones, and frames are
    renumbered. An episode whose frames are not as many as its length is an error, or left
    out if asked for.
    """
    parts = []
    for k, root in enumerate([roots] if isinstance(roots, str) else roots):
        root = root.rstrip("/")
        mark = [F.lit(root).alias("root"), F.lit(k).alias("root_number")]
        episodes = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/meta/episodes").select("*", *mark)
        frames = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/data")
        # A file's numbers are in its path; Spark's own part files all count as file 0.
        chunk, file = (F.coalesce(F.regexp_extract("_metadata.file_path", p, 1).try_cast("int"), F.lit(0)) for p in (r"chunk-(\d+)/", r"/file-(\d+)"))
        frames = frames.select("*", chunk.alias("data/chunk_index"), file.alias("data/file_index"), *mark)
        parts.append((episodes, frames, spark.read.parquet(f"{root}/meta/tasks.parquet").select("task", "task_index", *mark)))
    episodes, frames, tasks = parts[0]
    for e, f, t in parts[1:]:
        episodes, frames, tasks = episodes.unionByName(e, allowMissingColumns=True), frames.unionByName(f, allowMissingColumns=True), tasks.unionByName(t)
    joined = ops.frames_of_episodes(episodes, frames, skip_malformed_rows)
    merged, remap = ops.merge_tasks(tasks, "root_number", "task", "task_index")
    frames = ops.remap_tasks(joined.frames, remap, "root_number", "task_index")
    return EpisodeData(joined.episodes, frames, merged)
