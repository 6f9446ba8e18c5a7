"""Rows and builders that the tests of the library share."""

import datetime as dt
from decimal import Decimal

from tillroll.schema import FACT_SCHEMA


def moment(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


NORTH = [
    ("70001", "A100", "OAK SHELF", 3, "2012-02-01 08:15", 20.0, 501.0, "United Kingdom"),
    ("70001", "A100", "OAK SHELF", 3, "2012-02-01 08:15", 20.0, 501.0, "United Kingdom"),
    ("70002", "B200", None, 2, "2012-02-01 09:00", 4.5, 502.0, "EIRE"),
    ("70003", "B200", "BRASS HOOK", 10, "2012-02-02 10:00", 4.5, 503.0, "  Norway "),
    ("70004", "B200", "BRASS HOOK", 1, "2012-02-02 11:00", 4.5, None, "Norway"),
    ("70005", "B200", "HOOK, BRASS", 1, "2012-02-03 11:00", 4.5, 503.0, "Norway"),
    ("C70006", "A100", "OAK SHELF", -1, "2012-02-04 12:00", 20.0, 501.0, "United Kingdom"),
    ("C70007", "B200", "BRASS HOOK", -4, "2012-02-04 12:30", 4.5, 503.0, "Norway"),
    ("70008", "C300", "lost in store", -30, "2012-02-05 07:00", 0.0, None, "United Kingdom"),
    ("70009", "D400", "LINEN", -6, "2012-02-05 07:30", 2.5, None, "Unspecified"),
    ("70010", "POST", "POSTAGE", 1, "2012-02-06 10:00", 12.0, 502.0, "EIRE"),
    ("70011", "M", "Manual", 2, "2012-02-06 11:00", 7.0, 502.0, "EIRE"),
    ("70012", "TEST001", "trial", 1, "2012-02-07 10:00", 1.0, 504.0, "Sweden"),
    ("70013", "TEST002", "trial", 4, "2012-02-07 10:05", 1.0, 504.0, "Sweden"),
    ("70014", "E500", "CARRIAGE LANTERN", 1, "2012-02-08 10:00", 35.0, 504.0, "Sweden"),
    ("70015", "F600", None, 1, "2012-02-09 10:00", 1.0, 504.0, "Sweden"),
]
SOUTH = [
    ("80001", "A100", "OAK SHELF", 5, "2012-03-01 09:00", 20.0, 501.0, "United Kingdom"),
    ("70014", "E500", "CARRIAGE LANTERN", 1, "2012-02-08 10:00", 35.0, 504.0, "Sweden"),
    ("C80002", "E500", "CARRIAGE LANTERN", -1, "2012-03-02 09:00", 35.0, 504.0, "Sweden"),
]
FIRST_HEADERS = "Invoice string, StockCode string, Description string, Quantity int, InvoiceDate string, Price double, `Customer ID` double, Country string, row_ord int"
SECOND_HEADERS = "InvoiceNo string, StockCode string, Description string, Quantity int, InvoiceDate string, UnitPrice double, CustomerID double, Country string, row_ord int"


def numbered(rows):
    return [(str(row[0]), *row[1:], position) for position, row in enumerate(rows)]


FACT_LINES = [
    ("K1", 11, "p", "2013-05-03 10:00", 4, 5.0, "sale", True),
    ("K2", 11, "q", "2013-05-20 10:00", 2, 15.0, "sale", True),
    ("K3", 12, "p", "2013-05-20 16:00", 6, 5.0, "sale", True),
    ("K4", None, "q", "2013-06-02 12:00", 1, 15.0, "sale", True),
    ("K5", 12, "q", "2013-06-11 16:00", 3, 14.0, "sale", True),
    ("K6", 13, "p", "2013-07-01 09:00", 10, 4.0, "sale", True),
    ("CK7", 12, "p", "2013-06-15 09:00", -2, 5.0, "cancellation", True),
    ("CK8", 13, "p", "2013-08-02 09:00", -1, 4.0, "cancellation", True),
    ("K9", None, "q", "2013-07-09 09:00", -5, 0.0, "return", True),
    ("K10", 13, "SHIP", "2013-07-01 09:00", 1, 9.0, "sale", False),
]
BULK_LINE = ("K11", 14, "p", "2013-07-15 10:00", 30000, 2.0, "sale", True)


def build_fact(spark, lines, countries=None):
    """Fact rows from (invoice, customer, code, moment, quantity, price, type, goods)."""
    rows = []
    for i, (invoice, customer, code, at, quantity, price, kind, goods) in enumerate(lines):
        when, cents = moment(at), Decimal(str(price)).quantize(Decimal("0.01"))
        rows.append(
            (
                invoice, customer, code, f"{code} desc",
                countries[i] if countries else "United Kingdom",
                when, when.date().replace(day=1), quantity, cents, quantity * cents, kind, goods,
                customer is None, quantity >= 20000,
            )
        )
    return spark.createDataFrame(rows, FACT_SCHEMA)
