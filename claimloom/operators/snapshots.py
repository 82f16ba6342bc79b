"""Raw snapshots: content addresses, versions, verification and usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import urls as U


def content_address(df: DataFrame, *, url_col: str = "url", content_col: str = "content") -> DataFrame:
    """``df`` with content_hash, snapshot_id (24 hex digits of URL and hash) and content_bytes."""
    digest = F.concat(F.lit("sha256:"), F.sha2(content_col, 256))
    return df.withColumn("content_hash", digest).withColumns({"snapshot_id": F.substring(F.sha2(F.concat_ws("\n", url_col, "content_hash"), 256), 1, 24), "content_bytes": F.octet_length(content_col).cast("long")})


def dedupe_snapshots(df: DataFrame, *, url_col: str = "url", order: str = "captured_at") -> DataFrame:
    """The first capture of each URL and content."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(url_col, "content_hash").orderBy(order, "snapshot_id"))).where("_k = 1").drop("_k")


def version_chain(df: DataFrame, *, url_col: str = "url", order: str = "captured_at", id_col: str = "snapshot_id") -> DataFrame:
    """``df`` with supersedes (the version before) and outcome."""
    before = F.lag(id_col).over(Window.partitionBy(url_col).orderBy(order, id_col))
    return df.withColumn("supersedes", before).withColumn("outcome", F.when(F.col("supersedes").isNull(), "new_document").otherwise("new_version"))


def store_summary(df: DataFrame, *, run: str, url_col: str = "url") -> DataFrame:
    return df.groupBy(run).agg(
        F.count("*").alias("documents"), F.countDistinct(url_col).alias("urls"), F.count("supersedes").alias("versions"), F.sum("requests").alias("requests"), F.sum("credits").alias("credits"), F.sum("cost").alias("cost"),
    )


def verify_store(df: DataFrame, *, url_col: str = "url", content_col: str = "content") -> DataFrame:
    """(snapshot_id, violation): stored values that differ from recomputed ones, bad ranges, ids and contents (URL and stored hash) that occur again, broken chains."""
    fresh = content_address(df.select(url_col, content_col, F.col("snapshot_id").alias("id"), F.col("content_hash").alias("h"), F.col("content_bytes").alias("n"), "supersedes", "requests", "credits", "cost"), url_col=url_col, content_col=content_col)
    checks = {
        "url": U.canonical(F.col(url_col)).isNull() | (U.canonical(F.col(url_col)) != F.col(url_col)), "hash": F.col("h") != F.col("content_hash"), "id": F.col("id") != F.col("snapshot_id"), "bytes": F.col("n") != F.col("content_bytes"),
        "range": (F.col("requests") < 0) | (F.col("credits") < 0) | (F.col("cost") < 0),
    }
    own = fresh.select("id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))).alias("violation"))
    twice = df.groupBy(F.col("snapshot_id").alias("id")).agg(F.count("*").alias("k")).where("k > 1").select("id", F.lit("duplicate").alias("violation"))
    # of equal contents only the id of one, the smallest, is right
    address = df.groupBy(url_col, "content_hash").agg(F.count("*").alias("k"), F.min("snapshot_id").alias("first")).where("k > 1")
    rows = df.select(url_col, "content_hash", F.col("snapshot_id").alias("id")).join(address.hint("merge"), [url_col, "content_hash"])
    again = rows.groupBy(url_col, "content_hash", "id", "first").agg(F.count("*").alias("n")).where("id <> first or n > 1").select("id", F.lit("content_duplicate").alias("violation"))
    orphan = df.where("supersedes is not null").select(F.col("snapshot_id").alias("id"), "supersedes").join(df.select(F.col("snapshot_id").alias("supersedes")), "supersedes", "left_anti").select("id", F.lit("broken_chain").alias("violation"))
    return own.unionByName(twice).unionByName(again).unionByName(orphan).withColumnRenamed("id", "snapshot_id")


def verify_audit(store: DataFrame, audit: DataFrame, *, same: list[str], usage: list[str]) -> DataFrame:
    """(place, violation): audit rows that do not tell what was stored.

    The event at a ``place`` belongs to the snapshot at that place. Violations: count (one of both is missing), audit (the id, one
    of the columns ``same`` or the action, stored_new_version where a snapshot supersedes another and else stored_new_document,
    differs, or a ``usage`` is negative). Nulls are equal to nulls.
    """
    kept = store.select("place", F.lit(True).alias("_stored"), F.col("supersedes").alias("_s"), *(F.col(c).alias(f"_{c}") for c in ["snapshot_id", *same]))
    j = audit.withColumn("_told", F.lit(True)).join(kept, "place", "full")
    action = F.when(F.col("_s").isNotNull(), "stored_new_version").otherwise("stored_new_document")
    wrong = ~F.col("action").eqNullSafe(action)
    for c in ["snapshot_id", *same]:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    for c in usage:
        wrong = wrong | F.coalesce(F.col(c) < 0, F.lit(False))
    violation = F.when(F.col("_stored").isNull() | F.col("_told").isNull(), "count").when(wrong, "audit")
    return j.select("place", violation.alias("violation")).where("violation is not null")


def verify_summary(stored: DataFrame, fresh: DataFrame, *, run: str) -> DataFrame:
    """(run, violation): runs whose stored summary differs from ``fresh``, what ``store_summary`` makes of the store, or that only one of both has."""
    values = [c for c in fresh.columns if c != run]
    j = stored.select(run, F.struct(*values).alias("_a")).join(fresh.select(run, F.struct(*values).alias("_b")), run, "full")
    return j.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(run, F.lit("summary").alias("violation"))


def merge_waves(previous: DataFrame, current: DataFrame, *, key: str) -> DataFrame:
    """Rows of both waves; where a key is in both, the later wave's row."""
    return current.unionByName(previous.join(current.select(key), key, "left_anti"))


def attach_usage(snapshots: DataFrame, requests: DataFrame, *, key: str) -> DataFrame:
    """Snapshots with the number of requests of their URL, credits (reported, else reserved) and cost; zeros where none."""
    used = requests.groupBy(key).agg(F.count("*").alias("requests"), F.sum(F.coalesce("reported", "reserved")).alias("credits"), F.sum("cost").alias("cost"))
    return snapshots.join(used, key, "left").na.fill(0, ["requests", "credits", "cost"])
