"""Ledger writes as functions from the old table and the new rows to the next table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Scopes that a goal or budget may have.
GOAL_SCOPES = {"savings_account", "category_underspend", "debt_payoff", "custom"}
GOAL_STATUSES = {"active", "achieved", "missed", "paused"}


def insert_new(old: DataFrame, new: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """Rows whose key is free; of several new ones with one key the first to arrive."""
    first = new.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(arrival))).where("_k = 1").drop("_k")
    return old.unionByName(first.join(old.select(*key), key, "left_anti").select(*old.columns))


def skip_known(new: DataFrame, old: DataFrame, key: str = "sha256") -> DataFrame:
    return new.join(old.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The whole row of the highest version of each key; at a tie the new one."""
    every = old.withColumn("_new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("_new", F.lit(1)))
    last = Window.partitionBy(*key).orderBy(F.desc(version), F.desc("_new"))
    return every.withColumn("_k", F.row_number().over(last)).where("_k = 1").select(*old.columns)


def upsert_goals(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (name, target_date): the new row's values under the id that the key had. Unknown scopes and statuses raise."""
    bad = ~F.col("scope_type").isin(*GOAL_SCOPES) | ~F.col("status").isin(*GOAL_STATUSES)
    checked = new.withColumn("status", F.when(bad, F.raise_error(F.concat(F.lit("bad goal "), "id"))).otherwise(F.col("status")))
    key = ["name", "target_date"]
    kept = old.select(*key, F.col("id").alias("_old"))
    renamed = checked.join(kept, key, "left").withColumn("id", F.coalesce("_old", "id")).select(*old.columns)
    return old.join(new.select(*key), key, "left_anti").unionByName(renamed)


def upsert_merchants(old: DataFrame, new: DataFrame, transactions: DataFrame) -> DataFrame:
    """New merchants are added; known ones gain aliases, and their name and category change only while no transaction refers to them.

    Of several new rows of one id the name and category of the first count: by ``arrival`` if there is such a column, else by name.
    """
    came = F.struct(*(F.col(c) for c in ("arrival", "canonical_name", "category_id") if c in new.columns))
    used = transactions.where("merchant_id is not null").select(F.col("merchant_id").alias("id")).distinct().withColumn("_used", F.lit(True))
    fresh = new.groupBy("id").agg(F.min_by("canonical_name", came).alias("_name"), F.min_by("category_id", came).alias("_cat"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("_aliases"))
    both = old.join(fresh, "id", "full").join(used, "id", "left")
    frozen = F.coalesce("_used", F.lit(False)) & F.col("canonical_name").isNotNull()
    none = F.array().cast("array<string>")
    return both.select(
        "id",
        F.when(frozen, F.col("canonical_name")).otherwise(F.coalesce("_name", "canonical_name")).alias("canonical_name"),
        F.when(frozen, F.col("category_id")).otherwise(F.coalesce("_cat", "category_id")).alias("category_id"),
        F.array_distinct(F.concat(F.coalesce("aliases", none), F.coalesce("_aliases", none))).alias("aliases"),
    )


def upsert_patterns(old: DataFrame, new: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The next patterns, and the transactions, which forget a pattern whose row changed."""
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in old.columns if c != "id"]
    alike = same[0]
    for s in same[1:]:
        alike &= s
    changed = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id")).where(~alike).select(F.col("o.id").alias("_p"))
    freed = transactions.join(changed, F.col("pattern_id") == F.col("_p"), "left").withColumn("pattern_id", F.when(F.col("_p").isNull(), F.col("pattern_id"))).drop("_p")
    return old.join(new.select("id"), "id", "left_anti").unionByName(new.select(*old.columns)), freed


def apply_rules(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """Merchant and category from rules (surface, merchant_id, category_id) where a transaction has none."""
    r = rules.select(F.col("surface").alias("raw_description"), F.col("merchant_id").alias("_m"), F.col("category_id").alias("_c"))
    joined = transactions.join(r, "raw_description", "left")
    return joined.withColumn("merchant_id", F.coalesce("merchant_id", "_m")).withColumn("category_id", F.coalesce("category_id", "_c")).select(*transactions.columns)


def unmatched(transactions: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct descriptions that no rule covers."""
    return transactions.select("raw_description").distinct().join(rules.select(F.col("surface").alias("raw_description")), "raw_description", "left_anti")


def new_descriptions(descriptions: DataFrame, merchants: DataFrame, gram: int = 12) -> DataFrame:
    """Distinct descriptions that contain no merchant's name and aren't an alias.

    Aliases match by an equi join. A name is looked up by that of its runs of ``gram`` characters
    which the fewest names have (by all of a shorter one): descriptions are exploded to their
    substrings of those lengths, joined, and the whole name is then checked, so a common
    ending brings no description to every merchant. Empty names match nothing.
    """
    rest = descriptions.select("raw_description").distinct().join(merchants.select(F.explode("aliases").alias("raw_description")), "raw_description", "left_anti")
    size = F.least(F.length("_name"), F.lit(gram))
    names = merchants.select(F.lower("canonical_name").alias("_name")).where("length(_name) > 0").distinct().withColumn("_n", size)
    runs = F.transform(F.sequence(F.lit(1), F.length("_name") - F.col("_n") + 1), lambda i: F.substring(F.col("_name"), i, F.col("_n")))
    parts = names.select("_name", "_n", F.explode(F.array_distinct(runs)).alias("_g"))
    common = parts.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    named = parts.join(common, "_g").groupBy("_name", "_n").agg(F.min_by("_g", F.struct("_c", "_g")).alias("_g"))
    sizes = [r["_n"] for r in named.select("_n").distinct().orderBy("_n").collect()]  # at most ``gram`` rows
    if not sizes:
        return rest
    low = F.lower("raw_description")
    places = F.sequence(F.lit(1), F.greatest(F.length("raw_description"), F.lit(1)))
    cut = lambda n: F.transform(places, lambda i: F.substring(low, i, F.lit(n)))
    grams = F.array_distinct(F.flatten(F.array(*map(cut, sizes))))
    hit = rest.select("raw_description", F.explode(grams).alias("_g")).join(named, "_g").where(F.contains(low, F.col("_name"))).select("raw_description").distinct()
    return rest.join(hit, "raw_description", "left_anti")


def merge_merchant(transactions: DataFrame, merchants: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Transactions repointed from source to target, and merchants without the source, its name and aliases gone to the target."""
    if source == target:
        raise ValueError("source and target are one merchant")
    found = merchants.where(F.col("id").isin(source, target)).select("id", "canonical_name", "aliases").limit(2).collect()
    present = {r["id"]: [*(r["aliases"] or []), r["canonical_name"]] for r in found}
    for m in (source, target):
        if m not in present:
            raise KeyError(m)
    moved = transactions.withColumn("merchant_id", F.when(F.col("merchant_id") == source, F.lit(target)).otherwise(F.col("merchant_id")))
    kept = merchants.where(F.col("id") != source)
    given = F.array(*(F.lit(x) for x in dict.fromkeys(present[source]))).cast("array<string>")
    union = F.sort_array(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), given))
    return moved, kept.withColumn("aliases", F.when(F.col("id") == target, union).otherwise(F.col("aliases")))


def merge_preview(transactions: DataFrame, source: str) -> DataFrame:
    return transactions.where(F.col("merchant_id") == source).agg(F.count(F.lit(1)).alias("affected"))


def prefix_redirects(merchants: DataFrame) -> DataFrame:
    """(old_id, new_id): long ids that go on from a short one after ``_``; the longest short id wins.

    A short id has up to 16 characters, one ``_`` at most and no digit. Each long id is cut at its
    ``_``s and the cuts are joined, so the work is linear in the ids' lengths.
    """
    short = (F.length("id") <= 16) & (F.length("id") - F.length(F.replace("id", F.lit("_"), F.lit(""))) <= 1) & ~F.col("id").rlike(r"\d")
    ids = merchants.select("id").distinct()
    parts = F.split("id", "_")
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    long = ids.where(~short & F.contains("id", F.lit("_"))).select(F.col("id").alias("old_id"), F.explode(cuts).alias("new_id"))
    found = long.join(ids.where(short).select(F.col("id").alias("new_id")), "new_id")
    return found.groupBy("old_id").agg(F.max_by("new_id", F.length("new_id")).alias("new_id"))


def compose_redirects(first: DataFrame, then: DataFrame) -> DataFrame:
    """first followed by then, then's own rows added, without rows that lead to themselves."""
    nxt = then.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_n"))
    chained = first.join(nxt, F.col("new_id") == F.col("_o"), "left").select("old_id", F.coalesce("_n", "new_id").alias("new_id"))
    return chained.unionByName(then.join(first.select("old_id"), "old_id", "left_anti").select("old_id", "new_id")).where("old_id <> new_id")


def redirect(df: DataFrame, redirects: DataFrame, column: str = "merchant_id") -> DataFrame:
    r = redirects.select(F.col("old_id").alias("_o"), F.col("new_id").alias("_n"))
    return df.join(r, F.col(column) == F.col("_o"), "left").withColumn(column, F.coalesce("_n", column)).drop("_o", "_n")


def allocate_ids(existing: DataFrame, names: DataFrame) -> DataFrame:
    """(id, name) of names that are new, numbered on from the largest id in name order.

    Names are dealt by range and numbered within each range, on from the sizes of the ranges
    before it; the ranges are kept, since sampling them anew might cut elsewhere.
    """
    fresh = names.select("name").distinct().join(existing.select("name"), "name", "left_anti")
    cut = fresh.repartitionByRange("name").withColumn("_p", F.spark_partition_id()).persist()
    sizes = cut.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = cut.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy("name")))
    return numbered.join(F.broadcast(starts), F.col("_p") == F.col("_q")).join(F.broadcast(top)).select((F.col("_top") + F.col("_start") + F.col("_k")).cast("int").alias("id"), "name")


def set_status(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """Statuses (id, status) taken over by the pages that have one."""
    c = changes.select("id", F.col("status").alias("_s"))
    return pages.join(c, "id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def accept_once(requests: DataFrame, seen: DataFrame) -> DataFrame:
    """Requests with ``duplicate``: their idempotency_key was seen before, or earlier in the batch."""
    first = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("arrived")) == 1
    known = seen.select("idempotency_key").distinct().withColumn("_seen", F.lit(True))
    return requests.join(known, "idempotency_key", "left").withColumn("duplicate", F.coalesce("_seen", F.lit(False)) | ~first).drop("_seen")
