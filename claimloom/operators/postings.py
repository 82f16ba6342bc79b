"""A full-text index as tables: postings by term in buckets, in blocks that know the most they can add to a score."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimloom.sources.scratch import cut, hinted

WORD = r"[\p{L}\p{N}]+"
#: Postings of a block, and of a part of a term's postings that is sorted in one task.
BLOCK, PART = 128, 65_536
K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def weight(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    """What a term adds to a score, but for its rarity: grows with ``tf`` and falls with ``length``."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


@dataclass(frozen=True)
class Index:
    """A written index: ``path``/postings, by bucket, and ``path``/sizes, a row for each addition."""

    spark: SparkSession
    path: str
    buckets: int = 64
    doc_type: str = "bigint"

    def _bucket(self, token: str = "token") -> Column:
        return F.pmod(F.xxhash64(token), F.lit(self.buckets)).cast("int")

    def add(self, docs: DataFrame, *, doc_id: str, text_col: str = "text", only: DataFrame | None = None) -> Index:
        """Append documents that the index does not have. ``only`` (token) limits it to the terms of known queries.

        Texts are split once. A term's postings are sorted by what they add to a score and cut into blocks of BLOCK; a very
        frequent term is dealt into parts of about PART first. Lengths are in the postings, so no search reads a text. The postings are
        written before their sizes: an addition that was broken off is not counted, and must be made again on a new path.
        """
        rows = docs.select(F.col(doc_id).alias("doc"), tokens(F.coalesce(text_col, F.lit(""))).alias("tokens"))
        rows = rows.select("doc", F.size("tokens").alias("length"), F.posexplode_outer("tokens").alias("at", "token"))
        rows = rows.withColumn("first", F.col("at") == 0)
        if only is not None:  # a document without any of the terms still counts for the mean length
            wanted = hinted(only.select("token").distinct().withColumn("known", F.lit(True)), most=1_000_000)
            rows = rows.join(wanted, "token", "left").where("known or at = 0 or at is null").withColumn("token", F.when(F.col("known"), F.col("token")))
        counted = cut(rows.groupBy("doc", "length", "token").agg(F.count("token").alias("tf"), F.bool_or("first").alias("first")), "postings")
        size = counted.agg(F.sum(F.when(F.col("first"), F.col("length"))).alias("words"), F.count_if("first").alias("filled")).withColumn("docs", F.lit(docs.count()))
        size = size.select("docs", F.coalesce("filled", F.lit(0)).alias("filled"), F.coalesce("words", F.lit(0)).cast("long").alias("words"))
        postings = counted.where("token is not null").select("token", "doc", "length", "tf")
        often = postings.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("token", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
        postings = postings.join(hinted(often), "token", "left").withColumn("part", F.pmod(F.xxhash64("doc"), F.coalesce("parts", F.lit(1))).cast("int"))
        # the mean length of the moment only orders postings; bounds are taken from tf and length
        size = cut(size, "size")
        now = size.first()
        order = Window.partitionBy("token", "part").orderBy(F.desc(weight(F.col("tf"), F.col("length"), F.lit(max(1.0, now["words"] / max(1, now["filled"]))), K1, B)), "doc")
        postings = postings.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK))
        blocks = postings.groupBy("token", "part", "block").agg(
            F.count("*").alias("n"), F.max("tf").alias("max_tf"), F.min("tf").alias("min_tf"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
            F.collect_list(F.struct("doc", "tf", "length")).alias("postings"),
        )
        blocks = blocks.withColumns({"addition": F.lit(uuid.uuid4().hex), "bucket": self._bucket()})
        blocks.repartition("bucket", "part").sortWithinPartitions("bucket", "token").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/postings")
        size.write.mode("append").parquet(f"{self.path}/sizes")
        return self

    def blocks(self, wanted: DataFrame) -> DataFrame:
        """Blocks of the terms ``wanted`` (token): only their buckets are read."""
        buckets = [r[0] for r in wanted.select(self._bucket()).distinct().collect()]  # at most ``buckets``
        schema = f"token string, part int, block bigint, n bigint, max_tf bigint, min_tf bigint, min_length int, max_length int, postings array<struct<doc:{self.doc_type},tf:bigint,length:int>>, addition string, bucket int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets))

    def search(self, queries: DataFrame, *, k: int, query_id: str, query_col: str = "text", k1: float = K1, b: float = B, visits: list | None = None) -> DataFrame:
        """(query, doc, score, place): BM25 top ``k``, equal scores by document.

        First only the blocks' bounds are read. A block of k postings or more promises a score to k documents, the best of these promises is a
        query's least. A block is read if it, with the most that the query's other terms can add, reaches that; documents in
        others can't be among the first k, whatever else they have. ``visits`` gets the tables of all blocks and of those read.
        """
        q = cut(queries.select(query_id, F.explode(tokens(F.col(query_col))).alias("token")).distinct(), "query-tokens")
        wanted = cut(q.select("token").distinct(), "wanted")
        size = self.spark.read.schema("docs bigint, filled bigint, words bigint").parquet(f"{self.path}/sizes").agg(F.sum("docs").alias("docs"), F.try_divide(F.sum("words"), F.sum("filled")).alias("mean")).first()
        mean = F.lit(float(size["mean"] or 1.0))
        own = self.blocks(wanted).join(hinted(wanted, most=1_000_000), "token", "left_semi")
        bounds = own.select("token", "addition", "part", "block", "n", "max_tf", "min_length", "min_tf", "max_length")
        df = bounds.groupBy("token").agg(F.sum("n").alias("df"))
        idf = df.select("token", F.log(1 + (float(size["docs"] or 0) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        bounds = bounds.join(hinted(idf, most=1_000_000), "token").select(
            "token", "addition", "part", "block", "idf", (F.col("idf") * weight(F.col("max_tf"), F.col("min_length"), mean, k1, b)).alias("most"),
            F.when(F.col("n") >= k, F.col("idf") * weight(F.col("min_tf"), F.col("max_length"), mean, k1, b)).alias("least"),
        )
        bounds = cut(bounds, "bounds")
        terms = bounds.groupBy("token").agg(F.max("most").alias("top"), F.max("least").alias("least"))
        terms = cut(q.join(hinted(terms, most=1_000_000), "token"), "query-terms")
        whole = terms.groupBy(query_id).agg(F.sum("top").alias("all"), F.coalesce(F.max("least"), F.lit(0.0)).alias("threshold"))
        # a query needs a term's blocks down to a bound; blocks go by the least of these
        needs = cut(terms.join(hinted(whole), query_id).select(query_id, "token", (F.col("threshold") - (F.col("all") - F.col("top")) - 2e-6).alias("from")), "needs")
        least = needs.groupBy("token").agg(F.min("from").alias("from"))
        read = bounds.join(hinted(least, most=1_000_000), "token").where(F.col("most") >= F.col("from")).select("token", "addition", "part", "block", "most", "idf")
        if visits is not None:
            visits += [bounds, read]
        read = own.select("token", "addition", "part", "block", "postings").join(hinted(read, most=1_000_000), ["token", "addition", "part", "block"])
        rows = read.select("token", "most", "idf", F.explode("postings").alias("p")).select("token", "most", "p.doc", (F.col("idf") * weight(F.col("p.tf"), F.col("p.length"), mean, k1, b)).alias("w"))
        met = rows.join(hinted(needs, most=1_000_000), "token").where(F.col("most") >= F.col("from"))
        scored = met.groupBy(query_id, "doc").agg(F.round(F.sum("w"), 6).alias("score"))
        place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), "doc"))
        return scored.withColumn("place", place).where(F.col("place") <= k)
