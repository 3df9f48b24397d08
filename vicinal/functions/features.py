"""Transactions as vectors of fourteen normalised features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import clamp01, quantise, round_half_away

# Risk by merchant category; other categories have DEFAULT_RISK.
MCC_RISK = {"5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80, "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50}
DEFAULT_RISK = 0.50
# What a feature of 1 stands for.
FULL_AMOUNT, FULL_INSTALLMENTS, FULL_RATIO, FULL_MINUTES, FULL_KM, FULL_COUNT = 10000.0, 12.0, 10.0, 1440.0, 1000.0, 20.0

PAYLOAD = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("transaction", T.StructType([T.StructField("amount", T.DoubleType()), T.StructField("installments", T.IntegerType()), T.StructField("requested_at", T.StringType())])),
    T.StructField("customer", T.StructType([T.StructField("avg_amount", T.DoubleType()), T.StructField("tx_count_24h", T.IntegerType()), T.StructField("known_merchants", T.ArrayType(T.StringType()))])),
    T.StructField("merchant", T.StructType([T.StructField("id", T.StringType()), T.StructField("mcc", T.StringType()), T.StructField("avg_amount", T.DoubleType())])),
    T.StructField("terminal", T.StructType([T.StructField("is_online", T.BooleanType()), T.StructField("card_present", T.BooleanType()), T.StructField("km_from_home", T.DoubleType())])),
    T.StructField("last_transaction", T.StructType([T.StructField("timestamp", T.StringType()), T.StructField("km_from_current", T.DoubleType())])),
])


def instant(text: Column) -> Column:
    """Seconds since the epoch of an ISO 8601 text in UTC; its first 19 characters count. Null if they are no time."""
    return F.unix_timestamp(F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")))


def minutes_between(earlier: Column, later: Column) -> Column:
    """Whole minutes, cut towards zero."""
    gap = instant(later) - instant(earlier)
    return (F.signum(gap.cast("double")) * F.floor(F.abs(gap) / 60)).cast("long")


def mcc_risk(mcc: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MCC_RISK.items() for x in pair])
    return F.coalesce(F.element_at(table, mcc), F.lit(DEFAULT_RISK))


def ratio(amount: Column, average: Column) -> Column:
    """amount / average; an average of 0 counts as infinite, 0 / 0 as 0."""
    return F.when(average == 0, F.when(amount > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(amount / F.when(average != 0, average))


def feature_columns() -> list[Column]:
    """The features in order, from the nested columns of a payload."""
    c = F.col
    day = F.try_to_timestamp(F.substring("transaction.requested_at", 1, 10), F.lit("yyyy-MM-dd"))
    hour = F.substring("transaction.requested_at", 12, 2).try_cast("int")
    minutes = minutes_between(c("last_transaction.timestamp"), c("transaction.requested_at"))
    none = c("last_transaction").isNull() | c("last_transaction.timestamp").isNull() | (minutes < 0)
    return [
        clamp01(c("transaction.amount") / FULL_AMOUNT), clamp01(c("transaction.installments") / FULL_INSTALLMENTS), clamp01(ratio(c("transaction.amount"), c("customer.avg_amount")) / FULL_RATIO),
        hour / F.lit(23.0), F.weekday(day) / F.lit(6.0), F.when(none, F.lit(-1.0)).otherwise(clamp01(minutes / F.lit(FULL_MINUTES))), F.when(none, F.lit(-1.0)).otherwise(clamp01(c("last_transaction.km_from_current") / FULL_KM)),
        clamp01(c("terminal.km_from_home") / FULL_KM), clamp01(c("customer.tx_count_24h") / FULL_COUNT), F.when(c("terminal.is_online"), 1.0).otherwise(0.0), F.when(c("terminal.card_present"), 1.0).otherwise(0.0),
        F.when(F.array_contains("customer.known_merchants", c("merchant.id")), 0.0).otherwise(1.0), mcc_risk(c("merchant.mcc")), clamp01(c("merchant.avg_amount") / FULL_AMOUNT),
    ]


def vectorise(payloads: DataFrame) -> DataFrame:
    """payloads (columns of PAYLOAD) with vec, the features on the grid, and q, their grid steps."""
    made = payloads.withColumn("vec", F.array(*[round_half_away(x.cast("double")) for x in feature_columns()]))
    return made.withColumn("q", quantise(F.col("vec")))


#: Fields without which a payload is malformed; the last transaction may be missing as a whole.
REQUIRED = tuple(f"{part.name}.{f.name}" for part in PAYLOAD if isinstance(part.dataType, T.StructType) and part.name != "last_transaction" for f in part.dataType)


def parse(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """bodies with the payload's columns and malformed, true where a body is no whole JSON payload.

    Every field but those of the last transaction is required, of which both or
    none have to be there; times have to be times. No body stops the batch.
    """
    made = bodies.withColumn("_p", F.from_json(body_col, PAYLOAD, {"mode": "PERMISSIVE"}))
    last = F.col("_p.last_transaction")
    missing = [F.col(f"_p.{f}").isNull() for f in REQUIRED]
    half = last.isNotNull() & (instant(last["timestamp"]).isNull() | last["km_from_current"].isNull())
    bad = F.col("_p").isNull() | half | instant(F.col("_p.transaction.requested_at")).isNull()
    for one in missing:
        bad = bad | one
    return made.select("*", *[F.col(f"_p.{f.name}").alias(f.name) for f in PAYLOAD if f.name not in bodies.columns], F.coalesce(bad, F.lit(True)).alias("malformed")).drop("_p")
