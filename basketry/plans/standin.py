"""The library's inputs, derived from the order tables: a customer's purchases are one collection."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from basketry.functions.filters import maybe_in
from basketry.functions.ranking import GIANT_ROWS, group_rank, range_rank
from basketry.sources.tables import save_table, scratch_root, table_path

# Collections per document, and positions per collection in one document: both bound the size of a file.
SLICE = 1000
CHUNK = 1000
HEADER = ("pid", "name", "collaborative", "num_followers", "num_tracks")

PURCHASE_ORDER = (
    "o_orderdate",
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_extendedprice",
    "l_shipdate",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def _orders_and_lines(spark: SparkSession, sf_dir: str, of: Column | None) -> tuple[DataFrame, DataFrame]:
    """Orders with their customer ``pid``, and order lines; with ``of``, only those of the customers for which it holds.

    The lines of other orders are then left out before any shuffle, but for a few that the join with the orders drops.
    """
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "pid")
    if of is None:
        return orders, lines
    orders = orders.where(of)
    return orders, maybe_in(lines, "l_orderkey", orders, "o_orderkey")


def _giants(spark: SparkSession, sf_dir: str, giant_rows: int, root: str, of: Column | None) -> DataFrame | None:
    """Customers with ``giant_rows`` order lines or more, as a written table; None if there are not so many lines at all."""
    orders, lines = _orders_and_lines(spark, sf_dir, of)
    if table(spark, sf_dir, "lineitem").count() < giant_rows:
        return None
    order_sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    sizes = (
        order_sizes.join(orders.select("o_orderkey", "pid"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("pid")
        .agg(F.sum("n").alias("n"))
    )
    return save_table(sizes.where(F.col("n") >= giant_rows).select("pid"), root, f"giants-{uuid4().hex}")


def _purchases(spark: SparkSession, sf_dir: str, giant_rows: int, of: Column | None = None) -> DataFrame:
    """Order lines with customer ``pid`` and 0-based position ``pos`` among the customer's lines.

    Lines are put in order where they meet their order, so that what orders them need not travel on. The lines of giant
    customers are dealt over ranges instead.
    """
    orders, lines = _orders_and_lines(spark, sf_dir, of)
    purchases = lines.join(orders.select("o_orderkey", "o_orderdate", "pid"), F.col("l_orderkey") == F.col("o_orderkey"))
    within = Window.partitionBy("l_orderkey", "pid").orderBy(*PURCHASE_ORDER[2:])
    kept = ("pid", "l_partkey", "l_suppkey", "l_quantity")

    def by_window(rows: DataFrame) -> DataFrame:
        in_order = rows.select(*kept, "o_orderdate", "l_orderkey", F.row_number().over(within).alias("line"))
        return group_rank(in_order, ["pid"], [F.col(c) for c in ("o_orderdate", "l_orderkey", "line")], "position", None)

    root = scratch_root(spark)
    giants = _giants(spark, sf_dir, giant_rows, root, of)
    result = (*kept, (F.col("position") - 1).alias("pos"))
    if giants is None or giants.isEmpty():
        return by_window(purchases).select(*result)
    large = range_rank(purchases.join(giants, "pid", "left_semi"), ["pid"], [F.col(c) for c in PURCHASE_ORDER], "position", root)
    return by_window(purchases.join(giants, "pid", "left_anti")).select(*result).unionByName(large.select(*result))


def _order_sizes(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Orders with lines, their customer ``pid`` and how many lines ``n`` they have, as a written table."""
    orders, lines = _orders_and_lines(spark, sf_dir, None)
    sizes = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    sized = sizes.join(orders.where(F.col("pid").isNotNull()), F.col("l_orderkey") == F.col("o_orderkey"))
    return save_table(sized.select("o_orderkey", "pid", "o_orderdate", "n"), root, f"orders-{uuid4().hex}")


def _placed_lines(
    spark: SparkSession, sf_dir: str, sizes: DataFrame, customers: DataFrame, giant_rows: int, root: str, **looks: Column
) -> DataFrame:
    """The lines and positions of :func:`_purchases`, with ``looks``, which are columns made of a line before it travels.

    A line stands where the lines of its customer's earlier orders end, at its place in its order. So it need not meet
    the customer's other lines: orders and their ``sizes`` do, and a line travels on with its position alone.
    ``customers`` has their numbers of ``rows``.
    """
    lines = table(spark, sf_dir, "lineitem").withColumns(looks)
    kept = ("pid", "l_partkey", "l_suppkey", "l_quantity", *looks)
    earlier = Window.partitionBy("pid").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    # Rows that repeat an order share its start, and their lines are ranked as one.
    repeats = Window.partitionBy("pid", "o_orderdate", "o_orderkey")
    within = Window.partitionBy("l_orderkey", "pid", "start").orderBy(*PURCHASE_ORDER[2:])

    def by_order(orders: DataFrame) -> DataFrame:
        started = orders.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        started = started.withColumn("start", F.min("start").over(repeats)).select("o_orderkey", "pid", "start")
        met = lines.join(started, F.col("l_orderkey") == F.col("o_orderkey"))
        return met.select(*kept, (F.col("start") + F.row_number().over(within) - 1).alias("pos"))

    giants = customers.where(F.col("rows") >= giant_rows).select("pid")
    if giants.isEmpty():
        return by_order(sizes)
    purchases = lines.join(sizes.join(giants, "pid", "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
    large = range_rank(purchases, ["pid"], [F.col(c) for c in PURCHASE_ORDER], "position", root)
    return by_order(sizes.join(giants, "pid", "left_anti")).unionByName(large.select(*kept, (F.col("position") - 1).alias("pos")))


def baskets(spark: SparkSession, sf_dir: str, giant_rows: int = GIANT_ROWS, of: Column | None = None) -> DataFrame:
    """Interactions of customers with parts; of all customers, or of those for which the condition ``of`` on ``pid`` holds."""
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        _purchases(spark, sf_dir, giant_rows, of)
        .join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "pid",
            "pos",
            F.col("l_partkey").alias("track_id"),
            F.col("l_suppkey").alias("artist_id"),
            F.col("p_brand").alias("album_id"),
            F.col("l_quantity").cast("bigint").alias("duration_ms"),
        )
    )


def customer_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their parts, without the columns that need positions or brands."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("track_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("pid", "track_id")


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_partkey").alias("track_id"))


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users and the keys of their events: many repeats inside a collection."""
    key = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("pid"), key.alias("track_id"))


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("pid"), F.col("turn").alias("pos"), F.col("role").alias("track_id")
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer; without purchases the length falls back to 0, there being no declared length."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("pid"), F.col("c_name").alias("name"), F.lit(None).cast("bigint").alias("num_tracks")
    )


def documents(spark: SparkSession, sf_dir: str, giant_rows: int = GIANT_ROWS) -> DataFrame:
    """``source_file, value``: the contents of :func:`nested` as JSON text."""
    return nested(spark, sf_dir, giant_rows).select("source_file", F.to_json(F.struct("playlists")).alias("value"))


def write_documents(spark: SparkSession, sf_dir: str, folder: str, name: str, compression: str = "none") -> None:
    """The same documents as files of their own, whose names begin with ``name`` and end in ``.json``, or ``.json.gz``."""
    contents = nested(spark, sf_dir).select("playlists")
    contents.write.option("maxRecordsPerFile", 1).option("mapreduce.output.basename", name).json(folder, compression=compression)


def _looks() -> dict[str, Column]:
    """What the fields of an item depend on besides its numbers and names, as conditions on an order line."""
    returned, status = F.col("l_returnflag"), F.col("l_linestatus")
    return {
        "padded_before": returned == "R",
        "padded_after": (returned == "A") & (status == "F"),
        "named_late": returned == "N",
        "with_artist": returned != "A",
        "brandless": status == "O",
        "unnamed_album": F.col("l_discount") < 0.03,
        "placed": F.col("l_tax") < 0.08,
    }


def _look() -> Column:
    """All of :func:`_looks` as one number, a bit each; what is unknown does not hold."""
    bits = (F.when(holds, 1 << at).otherwise(0) for at, holds in enumerate(_looks().values()))
    return sum(bits, start=F.lit(0))


def _item(of: Column) -> Column:
    """The fields of an item as they stand in a document, from the numbers and names of an order line."""
    looks = {name: F.getbit(of["look"], F.lit(at)) == 1 for at, name in enumerate(_looks())}
    part_uri = F.concat(F.lit("x:part:"), of["part"].cast("string"))
    supplier, brand, name = of["supplier"].cast("string"), of["p_brand"], of["p_name"]
    return F.struct(
        F.when(looks["padded_before"], F.concat(F.lit(" "), part_uri))
        .when(looks["padded_after"], F.concat(part_uri, F.lit(" ")))
        .otherwise(part_uri)
        .alias("track_uri"),
        F.when(looks["named_late"], F.concat(F.lit("  "), name)).otherwise(name).alias("track_name"),
        F.when(of["quantity"] <= 40, F.concat(F.lit("x:supplier:"), supplier)).alias("artist_uri"),
        F.when(looks["with_artist"], F.concat(F.lit("Supplier "), supplier)).alias("artist_name"),
        F.when(looks["brandless"], F.lit("x:brand:")).otherwise(F.concat(F.lit("x:brand:"), brand)).alias("album_uri"),
        F.when(looks["unnamed_album"], F.lit("   ")).otherwise(brand).alias("album_name"),
        of["quantity"].cast("bigint").alias("duration_ms"),
        F.when(looks["placed"], of["pos"]).alias("pos"),
    )


def nested(spark: SparkSession, sf_dir: str, giant_rows: int = GIANT_ROWS) -> DataFrame:
    """``source_file, playlists``: customers and purchases as nested documents of bounded size.

    The fields carry the irregularities the flattening operators have to deal with: padding, blanks, missing
    ids, missing positions. A collection of more than CHUNK positions continues in further documents.
    """
    root = scratch_root(spark)
    sizes = _order_sizes(spark, sf_dir, root)
    bought = save_table(sizes.groupBy("pid").agg(F.sum("n").alias("rows")), root, f"customers-{uuid4().hex}")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    slice_of = F.floor(F.col("pid") / SLICE) * SLICE
    # Numbers and names travel; the fields are spelled out where the document is complete. A position goes with the look.
    place = F.shiftleft("pos", len(_looks())).bitwiseOR(F.col("look").cast("bigint")).alias("place")
    pos = F.shiftright("place", len(_looks()))
    of_slice = (slice_of.alias("slice"), (F.col("pid") - slice_of).alias("own"))
    fields = {"part": "l_partkey", "supplier": "l_suppkey", "quantity": "l_quantity", "p_name": "p_name", "p_brand": "p_brand"}
    lines = (
        _placed_lines(spark, sf_dir, sizes, bought, giant_rows, root, look=_look())
        .select("pid", "l_partkey", "l_suppkey", "l_quantity", place)
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .select(*of_slice, F.floor(pos / CHUNK).alias("chunk"), "place", *(F.col(column).alias(field) for field, column in fields.items()))
    )
    # A customer heads a collection in each document that its lines reach, or an empty one in the first.
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.struct("*").alias("customer"))
    counted = customers.unionByName(bought, allowMissingColumns=True).withColumn("rows", F.sum("rows").over(Window.partitionBy("pid")))
    last = F.greatest(F.ceil(F.coalesce("rows", F.lit(0)) / CHUNK) - 1, F.lit(0))
    heads = counted.where(F.col("customer").isNotNull()).select(
        *of_slice, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"), "customer"
    )

    def head(column: str) -> Column:
        return F.col(f"customer.{column}")

    playlist = F.struct(
        F.when(head("c_acctbal") >= -900, head("c_custkey")).alias("pid"),
        F.when(head("c_nationkey") == 0, F.lit("  "))
        .when(head("c_nationkey") < 5, F.concat(F.lit("  "), head("c_name"), F.lit(" ")))
        .otherwise(head("c_name"))
        .alias("name"),
        F.when(head("c_nationkey") < 8, "true").when(head("c_nationkey") < 16, "false").alias("collaborative"),
        head("c_nationkey").cast("bigint").alias("num_followers"),
        F.size("lines").cast("bigint").alias("num_tracks"),
        "lines",
    )
    spelled_out = F.transform(
        "playlists", lambda p: F.struct(*(p[c].alias(c) for c in HEADER), F.transform(p["lines"], _item).alias("tracks"))
    )
    look = F.col("place").bitwiseAND(F.lit((1 << len(_looks())) - 1)).cast("int").alias("look")
    line = F.when(F.col("place").isNotNull(), F.struct(pos.alias("pos"), *fields, look))
    return (
        lines.unionByName(heads, allowMissingColumns=True)
        .repartition("slice", "chunk")
        .groupBy("slice", "chunk", "own")
        .agg(F.sort_array(F.collect_list(line)).alias("lines"), F.collect_list("customer").alias("customers"))
        .select("slice", "chunk", "lines", F.explode("customers").alias("customer"))
        .select("slice", "chunk", playlist.alias("playlist"))
        .groupBy("slice", "chunk")
        .agg(F.collect_list("playlist").alias("playlists"))
        .select(
            F.format_string("mpd.slice.%d-%d.%d.json", F.col("slice"), F.col("slice") + SLICE - 1, F.col("chunk")).alias(
                "source_file"
            ),
            spelled_out.alias("playlists"),
        )
    )
