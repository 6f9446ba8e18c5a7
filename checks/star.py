"""Driver tables -> two overlapping raw invoice feeds, and the rules that fit them.

``feed_sources`` builds the feeds with Spark. ``RAW_SQL`` is the same feed as one
SQL text for the comparison side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.plans.staging import check_whole
from tillroll.rules import NON_GOODS_CODES, Rules
from tillroll.sources.feed import read_csv

RULES = Rules(
    home_country="NATION_0",
    unspecified_country="Unspecified",
    listed_export=tuple(f"NATION_{n}" for n in range(3, 13)),
    country_map={"OLD_2": "NATION_2"},
    non_goods_codes=NON_GOODS_CODES,
    test_codes=("TEST001",),
    bulk_quantity=50,
)

# the first source ends where the second has already begun
FIRST_ENDS = "1998-06-10"
SECOND_BEGINS = "1998-06-01"

# each source spells its headers its own way
HEADERS = (
    {
        "invoice_no": "Invoice", "stock_code": "StockCode", "description": "Description",
        "quantity": "Quantity", "invoice_date": "InvoiceDate", "unit_price": "Price",
        "customer_id": "Customer ID", "country": "Country",
    },
    {
        "invoice_no": "InvoiceNo", "stock_code": "StockCode", "description": "Description",
        "quantity": "Quantity", "invoice_date": "InvoiceDate", "unit_price": "UnitPrice",
        "customer_id": "CustomerID", "country": "Country",
    },
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All feed lines with ``src_ord``; lines of the overlap appear once per source."""
    orders = _table(spark, sf_dir, "orders")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nations = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    # orders carry their country before the lines come in: one big join less wide
    placed = (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority", "n_name")
    )
    c = F.col
    returned = c("l_returnflag") == "R"
    cancelled = returned & (c("l_linestatus") == "F") & (c("o_orderstatus") == "F")
    sent_back = returned & (c("l_linestatus") == "O")
    # some sales are undone by a cancellation of their own, hours or days later
    undone = (c("l_returnflag") != "R") & (c("l_linenumber") == 1) & (c("l_partkey") % 37 == 0)
    undo = c("undo") == 1
    units = c("l_quantity").cast("int")
    part_no = c("l_partkey").cast("string")
    order_no = c("l_orderkey").cast("string")
    title = F.upper("p_name")
    sources = F.filter(
        F.array(
            F.when(c("o_orderdate") < F.lit(FIRST_ENDS).cast("timestamp_ntz"), 0),
            F.when(c("o_orderdate") >= F.lit(SECOND_BEGINS).cast("timestamp_ntz"), 1),
        ),
        lambda s: s.isNotNull(),
    )
    return (
        _table(spark, sf_dir, "lineitem")
        # two big sides: a shuffle join at any size worth the name
        .join(placed.hint("merge"), c("l_orderkey") == c("o_orderkey"))
        .join(parts, c("l_partkey") == c("p_partkey"))
        .withColumn("src_ord", F.explode(sources))
        .withColumn(
            "undo", F.explode(F.when(undone, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        )
        .select(
            "src_ord",
            c("l_linenumber").alias("row_ord"),
            F.when(undo, F.concat(F.lit("C"), order_no, F.lit("U")))
            .when(cancelled & (c("l_orderkey") % 2 == 0), F.concat(F.lit("C"), order_no))
            .when(cancelled, F.concat(F.lit("c"), order_no))
            .otherwise(order_no)
            .alias("invoice_no"),
            F.when((c("p_type") == "PROMO") & (c("p_size") <= 5), "POST")
            .when(c("l_partkey") % 200 == 7, "TEST001")
            .when(c("l_linenumber") % 2 == 0, F.concat(part_no, F.lit("b")))
            .otherwise(F.concat(F.lit(" "), part_no, F.lit("B")))
            .alias("stock_code"),
            F.when((c("l_linenumber") == 7) & (c("l_partkey") % 10 == 0), None)
            .when((c("l_linenumber") == 2) & (c("l_partkey") % 70 == 6), part_no)
            .when(c("l_partkey") % 40 == 3, "BLACK  CARRIAGE CLOCK ")
            .when(c("l_partkey") % 50 == 4, F.concat(F.lit("Damaged "), "p_name"))
            .when(c("l_partkey") % 60 == 5, "Carriage charge")
            .when((c("src_ord") == 1) & (c("l_partkey") % 11 == 0), F.concat(title, F.lit(" , NEW")))
            .when(c("l_linenumber") % 3 == 0, F.concat(title, F.lit(" SET")))
            .otherwise(title)
            .alias("description"),
            F.when(cancelled & (c("l_partkey") % 97 == 0), units)
            .when(cancelled | sent_back | undo, -units)
            .otherwise(units)
            .alias("quantity"),
            (
                c("o_orderdate")
                + F.make_dt_interval(
                    F.lit(0),
                    F.lit(0),
                    (c("o_orderkey") % 1440 + c("undo") * (180 + c("o_orderkey") % 3 * 1440)).cast("int"),
                )
            ).alias("invoice_date"),
            F.when(sent_back, F.lit(0.0))
            .when(c("l_linenumber") == 2, c("l_extendedprice") + F.lit(0.0000001))
            .otherwise(c("l_extendedprice"))
            .alias("unit_price"),
            F.when((c("o_orderpriority") == "5-LOW") | (c("n_name") == "NATION_23"), "n/a")
            .otherwise(c("o_custkey").cast("string"))
            .alias("customer_id"),
            F.when(c("n_name") == "NATION_1", " NATION_1  ")
            .when(c("n_name") == "NATION_2", "OLD_2")
            .when(c("n_name") == "NATION_24", "Unspecified")
            .otherwise(c("n_name"))
            .alias("country"),
        )
    )


def _by_source(lines: DataFrame) -> list[tuple[str, DataFrame]]:
    """Written lines under each source's own header spellings; a source may have none."""
    return [
        (name, lines.filter(F.col("src_ord") == i).drop("src_ord").withColumnsRenamed(headers))
        for i, (name, headers) in enumerate(zip(("first", "second"), HEADERS))
    ]


def csv_sources(lines: DataFrame, folder: str) -> list[tuple[str, DataFrame]]:
    """The feed written as delimited files and read back, every value text."""
    lines.write.partitionBy("src_ord").option("header", True).csv(folder)
    kinds = {name: "int" if name == "src_ord" else "string" for name in lines.columns}
    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return _by_source(read_csv(lines.sparkSession, folder, schema=schema))


def write_feeds(spark: SparkSession, sf_dir: str, folder: str) -> T.StructType:
    """One join, two feeds on disk: one folder per source with lines. Returns their schema.

    Lines that the executors wrote where others do not see them would pass for none.
    """
    lines, seen = feed_lines(spark, sf_dir), Observation()
    counted = lines.observe(seen, F.count("*").alias("lines"))
    counted.write.partitionBy("src_ord").option("compression", "zstd").parquet(folder)
    check_whole(spark.read.schema(lines.schema).parquet(folder), seen.get["lines"], folder)
    return lines.schema


def feed_sources(
    spark: SparkSession, folder: str, schema: T.StructType
) -> list[tuple[str, DataFrame]]:
    """The written feeds; the schema is given, as a source without lines has left no folder."""
    return _by_source(spark.read.schema(schema).parquet(folder))


RAW_SQL = """
j AS (
  SELECT l.*, o.o_orderdate, o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderpriority,
         n.n_name, p.p_name, p.p_type, p.p_size,
         (l_returnflag = 'R' AND l_linestatus = 'F' AND o_orderstatus = 'F') AS is_c,
         (l_returnflag = 'R' AND l_linestatus = 'O') AS is_r
  FROM lineitem l
  JOIN orders   o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey  = c.c_custkey
  JOIN nation   n ON c.c_nationkey = n.n_nationkey
  JOIN part     p ON l.l_partkey  = p.p_partkey
), s AS (
  SELECT 0 AS src_ord, j.* FROM j WHERE o_orderdate <  TIMESTAMP '1998-06-10 00:00:00'
  UNION ALL
  SELECT 1 AS src_ord, j.* FROM j WHERE o_orderdate >= TIMESTAMP '1998-06-01 00:00:00'
), u AS (
  SELECT s.*, 0 AS undo FROM s
  UNION ALL
  SELECT s.*, 1 AS undo FROM s
  WHERE l_returnflag <> 'R' AND l_linenumber = 1 AND l_partkey % 37 = 0
), raw AS (
SELECT src_ord,
       CAST(l_linenumber AS BIGINT) AS row_ord,
       CASE WHEN undo = 1 THEN concat('C', CAST(l_orderkey AS STRING), 'U')
            WHEN is_c AND l_orderkey % 2 = 0 THEN concat('C', CAST(l_orderkey AS STRING))
            WHEN is_c THEN concat('c', CAST(l_orderkey AS STRING))
            ELSE CAST(l_orderkey AS STRING) END AS invoice_no,
       CASE WHEN p_type = 'PROMO' AND p_size <= 5 THEN 'POST'
            WHEN l_partkey % 200 = 7 THEN 'TEST001'
            WHEN l_linenumber % 2 = 0 THEN concat(CAST(l_partkey AS STRING), 'b')
            ELSE concat(' ', CAST(l_partkey AS STRING), 'B') END AS stock_code,
       CASE WHEN l_linenumber = 7 AND l_partkey % 10 = 0 THEN NULL
            WHEN l_linenumber = 2 AND l_partkey % 70 = 6 THEN CAST(l_partkey AS STRING)
            WHEN l_partkey % 40 = 3 THEN 'BLACK  CARRIAGE CLOCK '
            WHEN l_partkey % 50 = 4 THEN concat('Damaged ', p_name)
            WHEN l_partkey % 60 = 5 THEN 'Carriage charge'
            WHEN src_ord = 1 AND l_partkey % 11 = 0 THEN concat(upper(p_name), ' , NEW')
            WHEN l_linenumber % 3 = 0 THEN concat(upper(p_name), ' SET')
            ELSE upper(p_name) END AS description,
       CASE WHEN is_c AND l_partkey % 97 = 0 THEN CAST(l_quantity AS INT)
            WHEN is_c OR is_r OR undo = 1 THEN -CAST(l_quantity AS INT)
            ELSE CAST(l_quantity AS INT) END AS quantity,
       o_orderdate + INTERVAL '1' MINUTE *
         (o_orderkey % 1440 + undo * (180 + o_orderkey % 3 * 1440)) AS invoice_date,
       CASE WHEN is_r THEN CAST(0 AS DOUBLE)
            WHEN l_linenumber = 2 THEN l_extendedprice + CAST(0.0000001 AS DOUBLE)
            ELSE l_extendedprice END AS unit_price,
       CASE WHEN o_orderpriority = '5-LOW' OR n_name = 'NATION_23' THEN 'n/a'
            ELSE CAST(o_custkey AS STRING) END AS customer_id,
       CASE WHEN n_name = 'NATION_1' THEN ' NATION_1  '
            WHEN n_name = 'NATION_2' THEN 'OLD_2'
            WHEN n_name = 'NATION_24' THEN 'Unspecified'
            ELSE n_name END AS country
FROM u
)"""
