"""Scalar Column expressions shared by the operators (all JVM-side, codegen-able)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockroom.schemas import LINE_VALUE, LOW_STOCK_LIMIT, MONEY, MONEY_SUM

# --- fixed values (texts and formats that must equal the source's) ------------
# Templates: {placeholders} are filled from columns by fill().
SOLD_TEMPLATE = "Sold {quantity} x {name} for {total}"
OUT_OF_STOCK_TEMPLATE = "{name} is OUT OF STOCK!"
INSUFFICIENT_TEMPLATE = "Only {stock} units available."
DEFAULT_EMAIL_TEMPLATE = "info@{supplier}.com"
PRODUCT_OPTION_TEMPLATE = "{name} - {price} (Stock: {quantity})"
LOW_STOCK_ITEM_TEMPLATE = "{name} ({quantity} left)"
NOTIFICATION_TEMPLATE = "{kind}: {names}"
NOT_FOUND_MESSAGE = "Product not found"
INVALID_SALE_MESSAGE = "Please select a product and valid quantity"
REQUIRED_FIELDS_MESSAGE = "Please fill all required fields"
DUPLICATE_USERNAME_MESSAGE = "Username already exists"
ALL_HEALTHY_MESSAGE = "All stock levels are healthy."
ROLE_LABELS = {"admin": "Admin", "owner": "Owner"}
ROLE_LABEL_OTHER = "Cashier"
STATUS_PASSWORD_REQUIRED = "Password required"
STATUS_ACTIVE = "Active"
# Stock status labels of the inventory view.
OUT_OF_STOCK = "OUT OF STOCK"
LOW_STOCK = "LOW STOCK"
STOCK_OK = "OK"
# Currency prefix of every money text (Maluti).
CURRENCY = "M"
# Placeholder printed for a missing supplier / contact.
MISSING = "-"
# Characters JavaScript's \s and String.prototype.trim treat as white space.
JS_SPACE_CLASS = ("[\\t\\n\\u000B\\f\\r \\u00A0\\u1680\\u2000-\\u200A"
                  "\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]")
# Clock format of the cashier's sale list.
CLOCK_FORMAT = "h:mm:ss a"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


_SLOT = re.compile(r"\{(\w+)\}")


def fill(template: str, **values) -> Column:
    """Fill a ``{name}`` template with Columns (or column names) → concat."""
    parts: list[Column] = []
    pos = 0
    for m in _SLOT.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(_c(values[m.group(1)]).cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def line_value(quantity, price) -> Column:
    """Quantity × price as an exact DECIMAL(20,2)."""
    return (_c(quantity).cast("decimal(10,0)") * _c(price)).cast(LINE_VALUE)


def sale_total(unit_price, quantity) -> Column:
    """Generated ``total_amount`` = unit_price × quantity, kept at DECIMAL(10,2).

    ANSI cast raises on overflow, like the strict-mode generated column."""
    return (_c(unit_price) * _c(quantity).cast("decimal(10,0)")).cast(MONEY)


def stock_status(quantity) -> Column:
    """CASE quantity = 0 → OUT OF STOCK, < 10 → LOW STOCK, else OK."""
    q = _c(quantity)
    return (F.when(q == 0, F.lit(OUT_OF_STOCK))
            .when(q < LOW_STOCK_LIMIT, F.lit(LOW_STOCK))
            .otherwise(F.lit(STOCK_OK)))


def is_low_stock(quantity) -> Column:
    """Dashboard rule: 0 < quantity < 10 (negative stock is neither low nor out)."""
    q = _c(quantity)
    return (q > 0) & (q < LOW_STOCK_LIMIT)


def is_out_of_stock(quantity) -> Column:
    return _c(quantity) == 0


def money_sum(x) -> Column:
    return F.sum(_c(x)).cast(MONEY_SUM)


def money_text(x) -> Column:
    """``M`` + value rounded HALF_UP to 2 decimals, no thousands separator."""
    return F.concat(F.lit(CURRENCY), F.round(_c(x), 2).cast("decimal(38,2)").cast("string"))


def falsy_default(x, default) -> Column:
    """JavaScript ``x || default`` for text: NULL and '' fall back."""
    d = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(_c(x), F.lit("")), d)


def dash_if_missing(x) -> Column:
    return falsy_default(x, MISSING)


def js_trim(x) -> Column:
    """String.prototype.trim (Spark's trim only strips ASCII spaces)."""
    pat = f"^{JS_SPACE_CLASS}+|{JS_SPACE_CLASS}+$"
    return F.regexp_replace(_c(x), pat, "")


def strip_spaces(x) -> Column:
    """Remove every JavaScript white-space character (``replace(/\\s/g, '')``)."""
    return F.regexp_replace(_c(x), JS_SPACE_CLASS, "")


def default_contact_email(supplier) -> Column:
    """``info@<lower-cased name without white space>.com``."""
    return fill(DEFAULT_EMAIL_TEMPLATE, supplier=strip_spaces(F.lower(_c(supplier))))


def parse_int(text) -> Column:
    """parseInt(text) — leading integer prefix (a ``0x`` prefix is read as
    hexadecimal, as JavaScript does without a radix); NULL where JS gives NaN."""
    t = _c(text)
    hexa = F.regexp_extract(t, f"^{JS_SPACE_CLASS}*([+-]?)0[xX]([0-9a-fA-F]+)", 2)
    sign = F.regexp_extract(t, f"^{JS_SPACE_CLASS}*([+-]?)0[xX][0-9a-fA-F]", 1)
    from_hex = F.conv(hexa, 16, 10).try_cast("bigint") * F.when(sign == "-", -1).otherwise(1)
    digits = F.regexp_extract(t, f"^{JS_SPACE_CLASS}*([+-]?[0-9]+)", 1)
    bare = F.regexp_like(t, F.lit(f"^{JS_SPACE_CLASS}*[+-]?0[xX]([^0-9a-fA-F]|$)"))       # '0x' alone is NaN
    return F.when(hexa != "", from_hex).when(~bare | t.isNull(), F.nullif(digits, F.lit("")).try_cast("bigint"))


def parse_float(text) -> Column:
    """parseFloat(text) — leading decimal literal or ±Infinity, NULL where JS gives NaN."""
    t = _c(text)
    lit = F.regexp_extract(
        t, f"^{JS_SPACE_CLASS}*([+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?)", 1)
    inf = F.regexp_extract(t, f"^{JS_SPACE_CLASS}*([+-]?)Infinity", 1)
    is_inf = F.regexp_like(t, F.lit(f"^{JS_SPACE_CLASS}*[+-]?Infinity"))
    return (F.when(is_inf, F.when(inf == "-", F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
            .otherwise(F.nullif(lit, F.lit("")).try_cast("double")))


def clock_text(ts) -> Column:
    """X11: wall-clock text of a timestamp."""
    return F.date_format(_c(ts), CLOCK_FORMAT)


def utc_date(ts) -> Column:
    """Calendar date of a timestamp (timestamps are stored without zone = UTC)."""
    return F.to_date(_c(ts))


def sold_message(quantity, name, total) -> Column:
    """Confirmation text of an accepted sale."""
    return fill(SOLD_TEMPLATE, quantity=quantity, name=name, total=money_text(total))


def out_of_stock_message(name) -> Column:
    return fill(OUT_OF_STOCK_TEMPLATE, name=name)


def insufficient_message(stock) -> Column:
    return fill(INSUFFICIENT_TEMPLATE, stock=stock)




__all__ = [
    "fill", "SOLD_TEMPLATE", "OUT_OF_STOCK_TEMPLATE", "INSUFFICIENT_TEMPLATE", "DEFAULT_EMAIL_TEMPLATE",
    "PRODUCT_OPTION_TEMPLATE", "LOW_STOCK_ITEM_TEMPLATE", "NOTIFICATION_TEMPLATE", "ROLE_LABELS",
    "ROLE_LABEL_OTHER", "STATUS_PASSWORD_REQUIRED", "STATUS_ACTIVE", "OUT_OF_STOCK", "LOW_STOCK", "STOCK_OK", "CURRENCY", "MISSING", "JS_SPACE_CLASS",
    "line_value", "sale_total", "stock_status", "is_low_stock",
    "is_out_of_stock", "money_sum", "money_text", "falsy_default", "dash_if_missing",
    "js_trim", "strip_spaces", "default_contact_email", "parse_int", "parse_float",
    "clock_text", "utc_date", "sold_message", "out_of_stock_message", "insufficient_message",
    "NOT_FOUND_MESSAGE", "INVALID_SALE_MESSAGE", "REQUIRED_FIELDS_MESSAGE",
    "DUPLICATE_USERNAME_MESSAGE", "ALL_HEALTHY_MESSAGE",
]
