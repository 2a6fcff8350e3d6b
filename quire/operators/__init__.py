"""Operators: functions from DataFrames to DataFrames. Every order is a column; windows are partitioned by document or set."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame


class Result(NamedTuple):
    """What an operator made, and the input that it refused, with a reject_reason each."""

    accepted: DataFrame
    rejected: DataFrame
