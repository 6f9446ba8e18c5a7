"""Business rules and labels: everything about the feed that is data, not code.

Every operator that needs a word list, a threshold or a label takes a
:class:`Rules`, so another shop is another ``Rules`` and no operator changes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# --- fixed values: header spellings of the feeds --------------------------------
HEADER_ALIASES: dict[str, str] = {
    "Invoice": "invoice_no",
    "InvoiceNo": "invoice_no",
    "StockCode": "stock_code",
    "Description": "description",
    "Quantity": "quantity",
    "InvoiceDate": "invoice_date",
    "Price": "unit_price",
    "UnitPrice": "unit_price",
    "Customer ID": "customer_id",
    "CustomerID": "customer_id",
    "Country": "country",
}

# --- fixed values: codes booked as charges or corrections, not goods ------------
NON_GOODS_CODES: tuple[str, ...] = (
    "POST", "DOT", "C2", "M", "D", "S", "ADJUST", "ADJUST2", "B", "CRUK",
    "BANK CHARGES", "AMAZONFEE",
)

# --- fixed value: words that mark a non-goods line, whole words, any case -------
NON_GOODS_PATTERN: str = (
    r"\b(?:postage|carriage(?!\s+(?:clock|lantern))|manual|discount|samples?"
    r"|damaged?s?|missing|adjust\w*|bad debt|dotcom|amazon|cruk)\b"
)

# --- fixed values: test items, bulk border, country spelling --------------------
TEST_CODES: tuple[str, ...] = ("TEST001", "TEST002")
BULK_QUANTITY: int = 20000
COUNTRY_MAP: dict[str, str] = {"EIRE": "Ireland"}
HOME_COUNTRY: str = "United Kingdom"
UNSPECIFIED_COUNTRY: str = "Unspecified"

# --- fixed values: export countries of Europe and the Middle East ---------------
LISTED_EXPORT: tuple[str, ...] = (
    "Germany", "France", "Spain", "Italy", "Netherlands", "Belgium", "Portugal",
    "Sweden", "Switzerland", "Austria", "Denmark", "Finland", "Norway", "Ireland",
    "Poland", "Czech Republic", "Greece", "Cyprus", "Malta", "Hungary", "Romania",
    "Sardinia", "European Community", "United Arab Emirates", "Saudi Arabia",
    "Lebanon", "Bahrain", "Qatar", "Oman", "Israel", "Channel Islands", "Isle of Man",
)

# --- fixed values: a line's identity for de-duplication -------------------------
BUSINESS_KEY: tuple[str, ...] = (
    "invoice_no", "stock_code", "invoice_date", "quantity", "unit_price",
)


@dataclass(frozen=True)
class Labels:
    """Words shown in results. ``Labels.russian()`` gives the Russian set."""

    home: str = "home"
    listed_export: str = "export: Europe and Middle East"
    other_export: str = "export: other countries"
    unspecified: str = "country not given"
    no_description: str = "<not recovered>"
    goods: str = "goods"
    non_goods: str = "non-goods"
    non_goods_reason: str = "non-goods items"
    core: str = "core"
    loyal: str = "loyal"
    fresh: str = "fresh"
    cooling: str = "cooling"
    costly_churn: str = "costly_churn"
    churn: str = "churn"
    other: str = "other"

    @classmethod
    def russian(cls) -> Labels:
        # fixed values
        return cls(
            home="Великобритания",
            listed_export="Экспорт: Европа и Ближний Восток",
            other_export="Экспорт: прочие страны",
            unspecified="Страна не указана",
            no_description="<не удалось восстановить>",
            goods="товар",
            non_goods="нетоварная позиция",
            non_goods_reason="нетоварные позиции",
            core="ядро",
            loyal="лояльные",
            fresh="свежие",
            cooling="остывают",
            costly_churn="дорогой отток",
            churn="отток",
            other="прочее",
        )


@dataclass(frozen=True)
class Rules:
    non_goods_codes: tuple[str, ...] = NON_GOODS_CODES
    non_goods_pattern: str = NON_GOODS_PATTERN
    test_codes: tuple[str, ...] = TEST_CODES
    bulk_quantity: int = BULK_QUANTITY
    country_map: Mapping[str, str] = field(default_factory=lambda: dict(COUNTRY_MAP))
    home_country: str = HOME_COUNTRY
    unspecified_country: str = UNSPECIFIED_COUNTRY
    listed_export: tuple[str, ...] = LISTED_EXPORT
    labels: Labels = Labels()
