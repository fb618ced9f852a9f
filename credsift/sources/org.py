"""The repositories of an owner: which are taken, and their trees as one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_files

#: Repositories listed at most: a hundred pages of a hundred.
MOST = 10_000
LISTING = "array<struct<name:string,clone_url:string,fork:boolean,archived:boolean>>"


def listed(pages: DataFrame) -> DataFrame:
    """name, clone_url, fork, archived from pages of a listing (column ``json``)."""
    rows = pages.select(F.inline(F.from_json("json", LISTING)))
    return rows.select("name", "clone_url", F.coalesce("fork", F.lit(False)).alias("fork"), F.coalesce("archived", F.lit(False)).alias("archived"))


def chosen(repositories: DataFrame, forks: bool = False, archived: bool = False, most: int = MOST) -> DataFrame:
    """Repositories without forks and archived ones unless these are asked for; the first ``most`` by name."""
    rows = repositories.filter(F.lit(forks) | ~F.col("fork")).filter(F.lit(archived) | ~F.col("archived"))
    return rows.orderBy("name").limit(min(most, MOST))


def checked_out(spark: SparkSession, folder: str, owner: str, repositories: DataFrame | None = None, **options) -> DataFrame:
    """repo, path (``owner/name/...``), text of trees checked out below ``folder``, each in a folder of its name; one walk lists them all.

    With ``repositories`` (name) only these. Ignore files of a tree hold for it alone, as they do for folders.
    """
    rows = read_files(spark, folder, **options).withColumn("name", F.substring_index("path", "/", 1)).filter(F.contains("path", F.lit("/")))
    if repositories is not None:
        rows = rows.join(repositories.select("name").distinct(), "name", "left_semi")
    return rows.select(F.concat(F.lit(f"{owner}/"), "name").alias("repo"), F.concat(F.lit(f"{owner}/"), "path").alias("path"), "text")
