"""Pages as files of their own, by a data source, or many to a file in a committed table; pages that did not change are not written again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from tallyforge.sources import versions
from tallyforge.sources.places import cut

SCHEMA = "name string, content string"


@dataclass
class Written(WriterCommitMessage):
    pages: int


class PageWriter(DataSourceWriter):
    """Writes ``content`` to ``<path>/<name>``; a page appears whole, under its name, or not at all."""

    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[Row]) -> Written:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        made: set[str] = set()
        n = 0
        for row in iterator:
            name = row["name"]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"not a page's name: {name!r}")
            folder = "/".join([root.rstrip("/"), *name.split("/")[:-1]])
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            temporary = f"{folder}/.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(temporary) as out:
                out.write((row["content"] or "").encode())
            system.move(temporary, f"{root.rstrip('/')}/{name}")
            n += 1
        return Written(n)


class PageSource(DataSource):
    """``df.write.format("pages").mode("append").save(path)`` of rows (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options["path"])


def write(pages: DataFrame, path: str) -> int:
    """Write the pages (name, content) that are new or have other content than when they were last written; how many.

    What was written is known by hashes in a committed table beside the pages (``<path>/.index``), which is updated after the pages: after
    a failure between the two they are written again. Pages that are no longer among ``pages`` stay. Of several
    pages of one name the smallest content is taken. The pages are computed once; those that changed are kept in the scratch folder.
    """
    spark = pages.sparkSession
    spark.dataSource.register(PageSource)
    ledger = versions.Ledger(spark, f"{path.rstrip('/')}/.index")
    at = versions.At(ledger, ledger.version())
    one = pages.groupBy("name").agg(F.min("content").alias("content")).withColumn("sha256", F.sha2("content", 256))
    known = at.read("pages", "name string, sha256 string").select("name", "sha256")
    changed = cut(one.join(known, ["name", "sha256"], "left_anti"), "changed-pages")
    seen = Observation(f"pages-{uuid.uuid4().hex}")
    changed.observe(seen, F.count(F.lit(1)).alias("n")).select("name", "content").write.format("pages").mode("append").save(path)
    if not (n := int(seen.get["n"])):
        return 0
    ledger.commit({"pages": versions.merge(at, "pages", changed.select("name", "sha256"), ["name"])}, at.version)
    return n


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, content) of the pages below a folder."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    root = path.rstrip("/").split("://")[-1]
    return found.select(F.substring_index(F.url_decode(F.col("_metadata.file_path")), f"{root}/", -1).alias("name"), F.col("value").alias("content"))


# Many pages to a file

#: The committed table, whose rows name the version that wrote them.
TEXTS = "texts"


def _one_each(pages: DataFrame) -> DataFrame:
    """One row a name, of several the smallest content; texts are shuffled only of names that occur twice."""
    twice = cut(pages.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "repeated-pages")
    if twice.isEmpty():
        return pages
    least = pages.join(twice, "name", "left_semi").groupBy("name").agg(F.min("content").alias("content"))
    return pages.join(twice, "name", "left_anti").unionByName(least)


def store(pages: DataFrame, path: str) -> int:
    """Add the pages (name, content) that are new or have other content than the stored ones to a table below ``path``; how many.

    Every page counts as its name and the SHA-256 of both, and only these hashes are shuffled: texts are written where they are made,
    many to a file, so that no list of pages is ever in the driver. Texts that were replaced stay, as older versions do. Of several pages of
    one name the smallest content is taken. ``pages`` are read several times, so dear ones are to be kept in the scratch folder.
    """
    spark = pages.sparkSession
    ledger = versions.Ledger(spark, path)
    base = ledger.version()
    rows = _one_each(pages.select("name", F.coalesce("content", F.lit("")).alias("content")))
    if base:
        digest = F.unhex(F.sha2(F.concat("name", F.lit("\0"), "content"), 256)).alias("_digest")
        held = stored(spark, path, base).select(digest)
        new = cut(rows.select(digest).join(held, "_digest", "left_anti"), "changed-pages")
        if new.isEmpty():
            return 0
        rows = rows.withColumn("_digest", digest).join(new, "_digest", "left_semi").drop("_digest")
    seen = Observation(f"pages-{uuid.uuid4().hex}")
    made = rows.withColumn("version", F.lit(base + 1).cast("long")).observe(seen, F.count(F.lit(1)).alias("n"))
    ledger.commit({TEXTS: versions.Change(made, dealt=True)}, base)
    return int(seen.get["n"])


def stored(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(name, content) of the pages of a table that ``store`` made, as of a version, the newest by default.

    What later versions hold, the changed pages, decides by its names which older texts are left out.
    """
    ledger = versions.Ledger(spark, path)
    version = ledger.version() if version is None else version
    rows = ledger.read(TEXTS, f"{SCHEMA}, version long", version=version)
    if version > 1:
        last = rows.where("version > 1").groupBy(F.col("name").alias("_name")).agg(F.max("version").alias("_last"))
        rows = rows.join(last, F.col("name") == F.col("_name"), "left").where("_last is null or version = _last")
    return rows.select("name", "content")
