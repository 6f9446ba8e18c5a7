"""Column layout of the raw feed and of the cleaned fact."""

from __future__ import annotations

from pyspark.sql import types as T

from tillroll.rules import HEADER_ALIASES

# the eight business columns every source must bring, in canonical order
RAW_COLUMNS: tuple[str, ...] = tuple(dict.fromkeys(HEADER_ALIASES.values()))

# where a raw line came from: source name and position, file position, line position
ORIGIN_COLUMNS: tuple[str, ...] = ("source", "src_ord", "file_ord", "row_ord")

MONEY = T.DecimalType(18, 2)

FACT_SCHEMA = T.StructType(
    [
        T.StructField("invoice_no", T.StringType()),
        T.StructField("customer_id", T.LongType()),
        T.StructField("stock_code", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("invoice_date", T.TimestampNTZType()),
        T.StructField("month_start", T.DateType()),
        T.StructField("quantity", T.IntegerType()),
        T.StructField("unit_price", MONEY),
        T.StructField("line_revenue", MONEY),
        T.StructField("line_type", T.StringType()),
        T.StructField("is_merchandise", T.BooleanType()),
        T.StructField("is_guest", T.BooleanType()),
        T.StructField("is_bulk", T.BooleanType()),
    ]
)

FACT_COLUMNS: tuple[str, ...] = tuple(FACT_SCHEMA.fieldNames())
