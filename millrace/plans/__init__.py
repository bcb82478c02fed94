"""Datasets: immutable plans over DataFrames."""

from millrace.plans.dataset import Dataset
from millrace.plans.row import Row

__all__ = ["Dataset", "Row"]
