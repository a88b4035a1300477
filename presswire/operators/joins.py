"""Join helpers: skew-safe anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame


def anti_loaded_keys(incoming: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """anti_loaded_date: rows of ``incoming`` whose key values are absent from ``target``.

    ``target`` is reduced to its distinct keys first (partial aggregation, so a
    hot key costs one row per partition), then a left-anti join runs.
    """
    done = target.select(*keys).distinct()
    return incoming.join(done, keys, "left_anti")


def anti_visited(links: DataFrame, visited: DataFrame, key: str = "url") -> DataFrame:
    """anti_visited: distinct new links not yet visited."""
    return links.select(key).distinct().join(visited.select(key).distinct(), key, "left_anti")
