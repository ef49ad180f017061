"""Paths and their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.scalars import ancestors


def longest_prefix(rows: DataFrame, path: str, key: list[str], checkouts: DataFrame) -> DataFrame:
    """``key, project``: the name of the checkout (local_path, display_name) whose path is the longest
    prefix of a row's path, on a folder boundary; null if none is.

    Every folder above the path is looked up by equality, so rows grow with the depth of a path and not
    with the number of checkouts."""
    known = checkouts.filter("local_path IS NOT NULL").select(F.regexp_replace("local_path", "/+$", "").alias("_folder"),
        F.coalesce("display_name", F.element_at(F.split(F.regexp_replace("local_path", "/+$", ""), "/"), -1)).alias("_name"))
    known = known.groupBy("_folder").agg(F.min("_name").alias("_name"))
    tried = rows.select(*key, F.explode(ancestors(F.col(path))).alias("_folder"))
    found = tried.join(known, "_folder").groupBy(*key).agg(F.max_by("_name", F.length("_folder")).alias("project"))
    return rows.select(*key).join(found, key, "left")


def display_names(checkouts: DataFrame, key: str = "checkout_id", path: str = "local_path") -> DataFrame:
    """The last part of a path; with its parent before it where several checkouts share it."""
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    rows = checkouts.select(key, path, F.element_at(parts, -1).alias("_base"), F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/").alias("_long"))
    often = rows.groupBy("_base").agg(F.countDistinct(key).alias("_n"))
    return rows.join(often, "_base").select(key, F.when(F.col("_n") > 1, F.col("_long")).otherwise(F.col("_base")).alias("display_name"))


def roles(members: DataFrame, project: str = "project", worktree: str = "is_worktree") -> DataFrame:
    """``lane`` for a worktree, ``orchestrator`` beside lanes of its project, else ``standalone``."""
    lanes = F.bool_or(worktree).over(Window.partitionBy(project))
    return members.withColumn("role", F.when(F.col(worktree), "lane").when(lanes, "orchestrator").otherwise("standalone"))


def checkout_sightings(sightings: DataFrame) -> DataFrame:
    """One row for each distinct checkout with its disambiguated name."""
    once = sightings.groupBy("checkout_id").agg(F.min_by(F.struct("repository_id", "local_path", "non_repo"), "observed_at").alias("s")).select("checkout_id", "s.*")
    return once.join(display_names(once.filter("local_path IS NOT NULL")), "checkout_id", "left")
