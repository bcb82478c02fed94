"""Readers. Each gives a Dataset over a lazy DataFrame."""

from millrace.sources.blobs import read_blob, with_blobs
from millrace.sources.crawl import filter_domain_suffixes, filter_html, filter_not_truncated, filter_pdf, filter_truncated, read_commoncrawl, read_commoncrawl_from_index
from millrace.sources.episodes import read_lerobot
from millrace.sources.gated import load_lance, read_hdf5, read_hf_dataset, read_tfds
from millrace.sources.mcap import read_mcap
from millrace.sources.memory import from_items, from_source, task
from millrace.sources.tabular import read_csv, read_files, read_json, read_jsonl, read_parquet, read_videos
from millrace.sources.tfrecord import read_tfrecords
from millrace.sources.zarr import read_zarr

__all__ = [
    "filter_domain_suffixes", "filter_html", "filter_not_truncated", "filter_pdf", "filter_truncated", "from_items", "from_source",
    "load_lance", "read_blob", "read_commoncrawl", "read_commoncrawl_from_index", "read_csv", "read_files", "read_hdf5", "read_hf_dataset",
    "read_json", "read_jsonl", "read_lerobot", "read_mcap", "read_parquet", "read_tfds", "read_tfrecords", "read_videos", "read_zarr",
    "task", "with_blobs",
]
