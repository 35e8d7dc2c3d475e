"""Change history from the order tables: an order is a commit, its lines are the changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Order dates end the day before.
UNTIL = "2001-08-02"
PATTERNS = (r"\burgent\b", r"\bhigh\b")
#: Bytes of line items behind a partition of commits.
PART = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first by ``seq``."""
    o = read(spark, sf_dir, "orders")
    seq = (F.lit(4102444800) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))) * 1000000000 + (F.lit(999999999) - F.col("o_orderkey"))
    return o.select(
        seq.alias("seq"),
        F.col("o_orderkey").cast("string").alias("sha"),
        F.col("o_orderdate").cast("timestamp").alias("when"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("when_iso"),
        F.concat(F.lit("Cust "), "o_custkey").alias("author_name"),
        F.concat(F.lit("Cust"), "o_custkey", F.lit("@X.com")).alias("author_email"),
        F.col("o_orderpriority").alias("message"),
    )


def changes(spark: SparkSession, sf_dir: str, path: str = "part") -> DataFrame:
    """Changes with the path of the part, of the part's brand, or of the supplier."""
    lines = read(spark, sf_dir, "lineitem")
    if path == "supplier":
        lines = lines.withColumn("path", F.concat(F.lit("supp/"), "l_suppkey"))
    else:
        name = F.concat_ws("/", "p_type", "p_brand", "p_name") if path == "part" else F.col("p_brand")
        lines = lines.join(read(spark, sf_dir, "part").select("p_partkey", name.alias("path")), F.col("l_partkey") == F.col("p_partkey"))
    kind = F.when(F.col("l_returnflag") == "A", "added").when(F.col("l_returnflag") == "R", "deleted").otherwise("modified")
    return lines.select(
        F.col("l_orderkey").cast("string").alias("sha"),
        F.col("l_linenumber").cast("int").alias("pos"),
        "path",
        F.lit(None).cast("string").alias("old_path"),
        kind.alias("kind"),
        F.col("l_quantity").cast("long").alias("lines_added"),
        F.round(F.col("l_discount") * 100).cast("long").alias("lines_deleted"),
    )


def history(spark: SparkSession, sf_dir: str, path: str = "part", by_commit: bool = False) -> DataFrame:
    """``by_commit``: in partitions by commit whose number grows with the input, for what looks at whole commits; a
    task's memory then doesn't depend on the session's number of partitions, nor on how those are merged."""
    rows = changes(spark, sf_dir, path)
    if by_commit:
        rows = rows.repartition(parts(read(spark, sf_dir, "lineitem")), "sha")
    return rows.join(commits(spark, sf_dir), "sha")


def parts(table: DataFrame) -> int:
    """By the bytes of the table's files; at least one for each core."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-size // PART))


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one-change commits, with times within the day."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").cast("string").alias("sha"),
        F.lit(1).alias("pos"),
        F.concat(F.lit("k/"), F.get_json_object("props", "$.k")).alias("path"),
        F.lit("modified").alias("kind"),
        F.lit(1).cast("long").alias("lines_added"),
        F.lit(0).cast("long").alias("lines_deleted"),
        F.col("ts").cast("timestamp").alias("when"),
        F.col("user_id").cast("string").alias("author_email"),
        F.col("event_type").alias("message"),
    )


def rename_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth supplier ends a chain of renames."""
    s = read(spark, sf_dir, "supplier").filter("s_suppkey % 4 != 3")
    return s.select(F.col("s_suppkey").alias("seq"), F.lit(0).alias("pos"), F.concat(F.lit("supp/"), "s_suppkey").alias("old_path"), F.concat(F.lit("supp/"), F.col("s_suppkey") + 1).alias("path"))
