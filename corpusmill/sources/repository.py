"""Source trees: a local or remote folder through binaryFile, and a tree of blobs over HTTP as a Python data source."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions import fixed
from corpusmill.functions import scalars as S

_ENDINGS = list(fixed.LANGUAGES)


def ending(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)


def wanted(path: str = "path", size: str = "size") -> Column:
    """Of a path below the root: right ending, no skipped or hidden folder, no tests, a size within the limit."""
    p = F.col(path)
    folders = F.slice(F.split(p, "/"), F.lit(1), F.size(F.split(p, "/")) - 1)
    skipped = F.array(*(F.lit(x) for x in fixed.SKIPPED_FOLDERS))
    folder = F.lower(F.array_join(folders, "/"))
    tests = F.contains(folder, F.lit("test")) & ~F.contains(folder, F.lit("src"))
    pruned = F.exists(folders, lambda f: F.startswith(f, F.lit(".")) | F.array_contains(skipped, f))
    return ending(p).isin(_ENDINGS) & ~pruned & ~tests & ~F.startswith(S.basename(p), F.lit("test_")) & F.col(size).between(1, fixed.MAX_FILE_SIZE)


def first_files(files: DataFrame, most: int) -> DataFrame:
    """Files below src first, small ones first: a top-k."""
    priority = F.when(F.contains(F.lower("path"), F.lit("src")), 0).otherwise(1)
    return files.withColumn("priority", priority).orderBy("priority", "size", "path").limit(most).drop("priority")


def read_folder(spark: SparkSession, root: str, most: int = 50) -> DataFrame:
    """path (below root), size, language, code of the files wanted.  Contents are read for those alone that pass by name and size."""
    root = root if "://" in root else "file://" + os.path.abspath(root)
    below = F.regexp_replace("path", "^.*?" + re.escape(root.split("://", 1)[-1].strip("/")) + "/", "")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    chosen = first_files(listing.select(below.alias("path"), "size", F.col("path").alias("place")).where(wanted()), most)
    places = [r["place"] for r in chosen.collect()]  # ``most`` at most
    if not places:
        return spark.createDataFrame([], "path string, size bigint, language string, code string")
    files = spark.read.format("binaryFile").load(places).select(below.alias("path"), F.col("length").alias("size"), "content")
    return files.select("path", "size", S.language_of_extension(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("code"))


def readme(files: DataFrame) -> DataFrame:
    """The first of the usual names, as one row or none."""
    place = F.array_position(F.array(*(F.lit(n) for n in fixed.READMES)), F.col("path"))
    return files.where(F.col("path").isin(fixed.READMES)).orderBy(place).limit(1).select("path", "code")


class TreeSource(DataSource):
    """Blobs of a remote tree, a partition each: options ``tree`` (URL of a listing {"tree": [{path, type}]}) and ``raw`` (what paths are put behind).

    A list of URLs may be given for either, by spaces: the first listing that can be read is used.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, size bigint, language string, code string, error string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.trees, self.raws, self.most = options["tree"].split(), options["raw"].split(), int(options.get("most", "50"))

    def partitions(self) -> list[InputPartition]:
        error = "no listing"
        for tree, raw in zip(self.trees, self.raws, strict=True):
            try:
                with urlopen(tree, timeout=30) as r:
                    blobs = [b["path"] for b in json.load(r)["tree"] if b["type"] == "blob"]
            except (OSError, ValueError, KeyError) as e:
                error = str(e)
                continue
            some = [p for p in blobs if os.path.splitext(p)[1] in _ENDINGS and not any(x in p.lower() for x in fixed.SKIPPED_REMOTE)]
            return [InputPartition((p, raw + p)) for p in some[: self.most]] or [InputPartition((None, "no files"))]
        return [InputPartition((None, error))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, url = partition.value
        if path is None:
            yield (None, None, None, None, url)
            return
        try:
            with urlopen(url, timeout=30) as r:
                code = r.read().decode("utf-8", "ignore")
        except OSError as e:
            yield (path, None, None, None, str(e))
            return
        if len(code) <= fixed.MAX_FILE_SIZE:
            yield (path, len(code), fixed.LANGUAGES.get(os.path.splitext(path)[1], "unknown"), code, None)


def read_tree(spark: SparkSession, trees: list[str], raws: list[str], most: int = 50) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").options(tree=" ".join(trees), raw=" ".join(raws), most=str(most)).load()


def read_repository(spark: SparkSession, place: str, most: int = 50) -> DataFrame:
    """A folder, or host/owner/name on a site that lists trees: its main branch, else master."""
    if not place.startswith(("http://", "https://")):
        return read_folder(spark, place, most)
    owner, name = place.rstrip("/").removesuffix(".git").split("/")[-2:]
    branches = ("main", "master")
    return read_tree(spark, [f"https://api.github.com/repos/{owner}/{name}/git/trees/{b}?recursive=1" for b in branches], [f"https://raw.githubusercontent.com/{owner}/{name}/{b}/" for b in branches], most)
