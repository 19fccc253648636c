"""Pages, records and logs in files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BODY_LIMIT = 4000
#: Record types that a manifest may load.
TARGETS = {"Subscription", "Merchant", "Statement", "Budget"}
FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"


def read_texts(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, name, text) of whole files below a folder; copies that sync tools leave, with a space in the name, are skipped."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    named = found.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("name"), F.col("value").alias("text"))
    return named.where(~F.col("name").rlike(r" |%20"))


def read_binaries(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modified, length, sha256) of files, hashed where they are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", F.col("modificationTime").alias("modified"), "length", F.sha2("content", 256).alias("sha256"))


def front_matter(text: str | Column) -> Column:
    """Scalar ``key: value`` lines of a page's head as a map; quotes are dropped, nested values left out."""
    text = F.col(text) if isinstance(text, str) else text
    lines = F.filter(F.split(F.regexp_extract(text, FRONT, 1), r"\r?\n"), lambda line: line.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    pair = lambda line: F.struct(F.regexp_extract(line, r"^([\w-]+):", 1).alias("key"), F.regexp_replace(F.regexp_extract(line, r"^[\w-]+:\s*(.*?)\s*$", 1), r"""^["']|["']$""", "").alias("value"))
    return F.map_from_entries(F.array_distinct(F.transform(lines, pair)))


def pages(texts: DataFrame) -> DataFrame:
    """(name, id, meta, body): bodies are cut at BODY_LIMIT, the size of an answer to ``read page``."""
    meta = front_matter("text")
    body = F.left(F.regexp_replace("text", FRONT, ""), F.lit(BODY_LIMIT))
    return texts.select("name", F.coalesce(F.try_element_at(meta, F.lit("id")), F.regexp_replace("name", r"\.md$", "")).alias("id"), meta.alias("meta"), body.alias("body"))


def list_pages(pages_df: DataFrame, kind: str, status: str | None = None) -> DataFrame:
    """Pages of a type, of one status if given, by name."""
    out = pages_df.where(F.try_element_at("meta", F.lit("type")) == kind)
    if status:
        out = out.where(F.try_element_at("meta", F.lit("status")) == status)
    return out.orderBy("name")


def project_pages(pages_df: DataFrame, kind: str, schema: str) -> DataFrame:
    """Pages of a type as rows of a DDL ``schema``, fields taken from the head; what doesn't cast is null."""
    from pyspark.sql import types as T

    fields = T.StructType.fromDDL(schema).fields
    return list_pages(pages_df, kind).select(*(F.try_element_at("meta", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in fields))


@dataclass
class Manifest:
    """How a CSV's columns become a record's fields."""

    target: str
    mapping: dict[str, str]
    required: list[str] = field(default_factory=list)
    allowed: dict[str, list[str]] = field(default_factory=dict)
    numbers: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, given: dict) -> Manifest:
        """From a parsed YAML file; raises ValueError on an unknown target or a missing mapping."""
        if given.get("target_type") not in TARGETS:
            raise ValueError(f"target_type must be one of {sorted(TARGETS)}")
        if not given.get("mapping"):
            raise ValueError("a manifest needs a mapping")
        rules = given.get("validation", {})
        allowed = {k[:-3]: list(v) for k, v in rules.items() if k.endswith("_in")}
        return cls(given["target_type"], dict(given["mapping"]), list(rules.get("required", [])), allowed, list(given.get("numbers", [])))


def read_records(spark: SparkSession, path: str, manifest: Manifest) -> DataFrame:
    """Renamed, trimmed columns of a CSV; blanks are null."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(n) for c, n in manifest.mapping.items()))


def violations(records: DataFrame, manifest: Manifest) -> DataFrame:
    """Records with ``problem``: the first rule that a record breaks, else null."""
    out = F.lit(None).cast("string")
    for c in manifest.numbers:
        out = F.when(F.col(c).isNotNull() & F.col(c).try_cast("double").isNull(), f"{c} is not a number").otherwise(out)
    for c, values in manifest.allowed.items():
        out = F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), f"{c} is not one of {', '.join(values)}").otherwise(out)
    for c in reversed(manifest.required):
        out = F.when(F.col(c).isNull(), f"{c} is required").otherwise(out)
    return records.withColumn("problem", out)


def checked_records(records: DataFrame, manifest: Manifest) -> DataFrame:
    """The records, numbers cast; if any breaks a rule none is loaded: a ValueError names one."""
    judged = violations(records, manifest)
    bad = judged.where("problem is not null").select("problem").limit(1).collect()
    if bad:
        raise ValueError(bad[0]["problem"])
    out = judged.drop("problem")
    for c in manifest.numbers:
        out = out.withColumn(c, F.col(c).cast("double"))
    return out


def graph_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a JSON lines file whose ``kind`` tells them apart."""
    rows = spark.read.schema("kind string, id string, type string, source string, target string").json(path)
    return rows.where("kind = 'node'").select("id", "type"), rows.where("kind = 'edge'").select("source", "target", "type")


def jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, partitions: int = 16, **options: str) -> DataFrame:
    """A table of a database that a JDBC driver on the class path reads.

    With a numeric, date or timestamp ``column`` it is read in ``partitions`` ranges between the column's least and greatest value, which the database
    is asked for first; rows of a null there are in the first range. Filters and columns go to the database. For a session
    that can only read give what the database has for it, such as ``sessionInitStatement``.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if column is None:
        return reader.option("dbtable", table).load()
    low, high = reader.option("dbtable", f"(select min({column}) as low_value, max({column}) as high_value from {table}) bounds").load().first()
    if low is None or low == high:
        return reader.option("dbtable", table).load()
    bounds = {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(partitions)}
    return reader.option("dbtable", table).options(**bounds).load()
