"""Exchange JSON payloads to typed rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlewright.operators.validate import split_valid_invalid
from candlewright.schemas import CANDLE_FIELDS

# Order of the values in one candle element.
ELEMENT_FIELDS = ["timestamp", "low", "high", "open", "close", "volume"]

PRODUCT = (
    "product_id string, base_currency_id string, quote_currency_id string, base_min_size string, "
    "base_max_size string, quote_increment string, trading_disabled boolean"
)


def _kind(element: Column) -> Column:
    """Text, number or something else; a variant keeps what quoting would lose."""
    name = F.schema_of_variant(element)
    return (
        F.when(name == "STRING", "text")
        .when(name.isin("BIGINT", "DOUBLE", "FLOAT") | name.startswith("DECIMAL"), "number")
        .otherwise("other")
    )


def _value_text(element: Column) -> Column:
    """Strings as they are, numbers with eight decimals."""
    number = F.format_string("%.8f", F.try_variant_get(element, "$", "double"))
    return F.when(_kind(element) == "text", F.try_variant_get(element, "$", "string")).when(
        _kind(element) == "number", number)


def parse_candle_payload(payloads: DataFrame, column: str = "payload"):
    """(raw candles, payloads that are not an array of arrays).

    Elements need exactly six entries in the order time, low, high, open,
    close, volume; the time must be a JSON number and the rest numbers or text.
    Other elements are skipped.
    """
    keep = [c for c in payloads.columns if c != column]
    opened = payloads.withColumn("_rows", F.try_variant_get(
        F.try_parse_json(column), "$", "array<array<variant>>"))
    broken = opened.where(F.col("_rows").isNull()).drop("_rows")
    e = [F.get(F.col("_e"), F.lit(i)) for i in range(6)]
    usable = F.forall(F.slice("_e", 2, 5), lambda v: _kind(v) != "other")
    rows = (
        opened.where(F.col("_rows").isNotNull())
        .select(*keep, F.explode("_rows").alias("_e"))
        .where((F.size("_e") == 6) & (_kind(e[0]) == "number") & usable)
        .select(
            *keep,
            F.timestamp_seconds(F.try_variant_get(e[0], "$", "double").cast("bigint")).alias("timestamp"),
            *[_value_text(e[ELEMENT_FIELDS.index(f)]).alias(f) for f in CANDLE_FIELDS])
    )
    return rows, broken


def normalise_candles(raw: DataFrame):
    """(typed candles, rejects with the first broken rule)."""
    return split_valid_invalid(raw)


def parse_products(products: DataFrame, column: str = "product") -> DataFrame:
    """Product documents to trading pairs."""
    p = products.select(F.from_json(column, PRODUCT).alias("p")).select("p.*")
    parts = F.split("product_id", "-", -1)
    two = F.size(parts) == 2
    return p.select(
        F.col("product_id").alias("symbol"),
        F.when(two, F.get(parts, F.lit(0))).otherwise(F.col("base_currency_id")).alias("base_asset"),
        F.when(two, F.get(parts, F.lit(1))).otherwise(F.col("quote_currency_id")).alias("quote_asset"),
        (~F.coalesce("trading_disabled", F.lit(False))).alias("active"),
        F.col("base_min_size").alias("min_volume"), F.col("base_max_size").alias("max_volume"),
        F.col("quote_increment").alias("price_step"))
