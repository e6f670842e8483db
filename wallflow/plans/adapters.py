"""Views of the benchmark tables as logs, rule sets and name lists.

The SQL twins of these expressions are in ``oracles.py``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.operators.dependencies import known_names

# Row keys leave room for this many addresses of a document.
ADDRESSES_PER_DOCUMENT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: Column | str) -> Column:
    """Concatenation of columns and literal texts."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def logs(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """Events as log rows, made by so many tasks; else by as many as read the table, which may be one."""
    k = F.regexp_extract("props", '"k": ([0-9]+)', 1).cast("int")
    events = table(spark, sf_dir, "events")
    events = events.repartition(tasks, *events.columns) if tasks else events
    return events.select(
        text("user-", F.col("user_id")).alias("srcname"),
        F.col("event_type").alias("dstname"),
        text("svc-", k % 5).alias("dstportname"),
        F.col("ts").alias("time"),
        k.alias("rcvd"),
        F.col("value").alias("sent"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("ruleid"),
        "event_id",
    )


LOG_COLUMNS = ["srcname", "dstname", "dstportname", "time", "rcvd", "sent"]


def dirty_logs(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """The same as text, with bad times, bad numbers and missing keys."""
    n = F.col("event_id")
    return logs(spark, sf_dir, tasks).select(
        F.when(n % 79 != 0, F.col("srcname")).alias("srcname"),
        "dstname",
        "dstportname",
        F.when(n % 97 == 0, "bad").otherwise(F.date_format("time", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("time"),
        F.when(n % 89 == 0, "N/A").when(n % 83 == 0, "1d").otherwise(F.col("rcvd").cast("string")).alias("rcvd"),
        F.col("sent").cast("string").alias("sent"),
        "ruleid",
        "event_id",
    )


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    action = F.when(key % 50 == 0, "bogus").when(status == "P", "Allow").when(status == "F", "deny").otherwise("pass")
    comment = (
        F.when(key % 3 == 0, "")
        .when(key % 11 == 0, text("Règle très longue, écrite à la main pour la commande numéro ", key))
        .otherwise(text('Règle "', F.col("o_orderpriority"), '" ', key))
    )
    return table(spark, sf_dir, "orders").select(
        (key + 1).alias("_row"),
        F.when(key % 7 == 0, "").otherwise(text("r-", key % 50)).alias("rule_name"),
        comment.alias("comment"),
        text("cust-", F.col("o_custkey")).alias("from_src"),
        F.when(key % 2 == 0, text(status, ",grp")).otherwise(text("grp,", status)).alias("to_dest"),
        F.col("o_orderpriority").alias("service"),
        action.alias("action"),
        F.when(key % 4 == 0, "local_nat_slot_09").otherwise("local_filter_slot_09").alias("type_slot"),
        F.when(key % 101 == 0, "red").otherwise("").alias("separator_color"),
    )


def interface_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that also name interfaces, some of them as lists."""
    n = F.col("_row")
    one, two = text("if-", n % 25), text("if-", n % 30)
    return rules(spark, sf_dir).select(
        "*",
        F.when(n % 3 == 0, one).when(n % 3 == 1, text(one, " , ", two)).otherwise("Any").alias("from_if"),
        F.when(n % 5 == 0, two).otherwise("").alias("to_if"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 5 != 0)
    orders = table(spark, sf_dir, "orders")
    return (
        customers.select(text("cust-", F.col("c_custkey")).alias("name"))
        .union(orders.select("o_orderstatus").distinct())
        .union(orders.select("o_orderpriority").distinct().filter(F.col("o_orderpriority") != "1-URGENT"))
        .union(table(spark, sf_dir, "region").select(F.lit("grp")).distinct())
    )


def interfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") % 6 != 0)
    return nations.select(text("if-", F.col("n_nationkey")).alias("name"))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return known_names(objects(spark, sf_dir), interfaces(spark, sf_dir))


def flow_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object names among the endpoints of the log."""
    events = table(spark, sf_dir, "events")
    users = events.filter(F.col("user_id") % 3 != 0).select(text("user-", F.col("user_id")).alias("name"))
    types = events.filter(F.col("event_type") != "error").select("event_type")
    ports = events.select(text("svc-", F.col("event_id") % 4))
    return users.union(types).union(ports).distinct()


def address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules between addresses: customers, and addresses found in documents."""
    key = F.col("c_custkey")
    address = text("10.", F.col("c_nationkey"), ".", (key / 256).cast("int") % 300, ".", key % 256)
    customers = table(spark, sf_dir, "customer").select(
        (key * 2).alias("_row"),
        F.when(key % 3 == 0, address).otherwise("").alias("from_src"),
        F.when(key % 5 == 0, text("10.0.0.", key % 290)).otherwise("").alias("source_ip"),
        F.when(key % 4 != 0, address).otherwise("web").alias("source"),
        F.when(key % 7 == 0, text(address, "/", key % 40)).when(key % 7 == 1, text(address, "-", address)).otherwise(
            text("H_10_0_0_", key % 290)).alias("to_dest"),
    )
    pattern = F.lit("([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})")
    found = F.posexplode_outer(F.regexp_extract_all("text", pattern, F.lit(1))).alias("at", "ip")
    # One rule per address; a document without one is a rule without a source.
    documents = table(spark, sf_dir, "documents").select("doc_id", found).select(
        ((F.col("doc_id") * ADDRESSES_PER_DOCUMENT + F.coalesce("at", F.lit(0))) * 2 + 1).alias("_row"),
        F.coalesce("ip", F.lit("")).alias("from_src"),
        F.lit("").alias("source_ip"),
        F.lit("").alias("source"),
        F.lit("any").alias("to_dest"),
    )
    return customers.unionByName(documents)


def final_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule set without every third rule."""
    return rules(spark, sf_dir).filter((F.col("_row") - 1) % 3 != 0)
