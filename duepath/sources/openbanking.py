"""Bank-feed payloads as flat rows: transactions, balances, mandates, accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duepath.functions import clean

_TEXT, _NUM = T.StringType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


MANDATE = _struct(name=_TEXT, merchant_name=_TEXT, amount=_NUM, transaction_category=_TEXT)
PAYLOAD = _struct(
    case_id=_TEXT,
    as_of=_TEXT,
    accounts=T.ArrayType(_struct(
        account_id=_TEXT,
        account_type=_TEXT,
        transactions=T.ArrayType(_struct(
            transaction_id=_TEXT, normalised_provider_transaction_id=_TEXT, transaction_type=_TEXT, timestamp=_TEXT,
            amount=_NUM, description=_TEXT, merchant_name=_TEXT, transaction_category=_TEXT)),
        balances=T.ArrayType(_struct(current=_NUM, available=_NUM, update_timestamp=_TEXT, timestamp=_TEXT)),
        direct_debits=T.ArrayType(MANDATE),
        standing_orders=T.ArrayType(MANDATE),
    )),
    declared=T.MapType(_TEXT, _TEXT),
)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOAD).json(path)


def parse_payloads(texts: DataFrame, column: str = "payload") -> DataFrame:
    return texts.select(F.from_json(column, PAYLOAD).alias("p")).select("p.*")


def local_date(stamp: Column) -> Column:
    """The date written in the stamp itself, whatever its offset."""
    return F.substring(stamp, 1, 10).try_cast("date")


def accounts(payloads: DataFrame) -> DataFrame:
    return payloads.select("case_id", F.col("as_of").try_cast("date").alias("as_of"), F.explode_outer("accounts").alias("a"))


def transactions(payloads: DataFrame) -> DataFrame:
    """Canonical transactions: money out is positive, the payee is normalised text."""
    t = F.col("t")
    rows = accounts(payloads).select("case_id", F.col("a.account_id").alias("account_id"), F.explode("a.transactions").alias("t"))
    return rows.select(
        "case_id", "account_id",
        t["transaction_id"].alias("txn_id"),
        t["timestamp"].alias("ts_text"),
        local_date(t["timestamp"]).alias("tdate"),
        (-F.coalesce(t["amount"], F.lit(0.0))).alias("amount"),
        F.coalesce(
            F.nullif(clean.payee(t["merchant_name"], t["description"], t["transaction_category"]), F.lit("")), F.lit("unknown")
        ).alias("payee"),
        t["transaction_category"].alias("hint"),
    )


def balances(payloads: DataFrame) -> DataFrame:
    """Balance rows: current else available, the newest stamp else the decision date."""
    b = F.col("b")
    rows = accounts(payloads).select(
        "case_id", "as_of", F.col("a.account_id").alias("account_id"),
        clean.account_kind(F.coalesce(F.col("a.account_type"), F.lit("TRANSACTION"))).alias("acct_type"),
        F.explode("a.balances").alias("b"),
    )
    return rows.select(
        "case_id", "account_id", "acct_type",
        F.coalesce(local_date(F.nullif(b["update_timestamp"], F.lit(""))), local_date(b["timestamp"]), F.col("as_of")).alias("bdate"),
        F.coalesce(b["current"], b["available"], F.lit(0.0)).alias("balance"),
    )


def mandates(payloads: DataFrame) -> DataFrame:
    """Direct debits and standing orders with a payee and a positive amount."""
    acct = accounts(payloads)
    both = acct.select("case_id", F.explode("a.direct_debits").alias("m")).unionByName(
        acct.select("case_id", F.explode("a.standing_orders").alias("m"))
    )
    m = F.col("m")
    return both.select(
        "case_id",
        clean.payee(m["merchant_name"], m["name"], m["transaction_category"]).alias("payee"),
        F.coalesce(m["amount"], F.lit(0.0)).alias("amount"),
    ).filter((F.col("payee") != "") & (F.col("amount") > 0))


def identity_key(df: DataFrame) -> Column:
    """What makes two fetched rows the same transaction."""
    def part(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")

    ident = F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("transaction_id", "normalised_provider_transaction_id") if c in df.columns],
                       F.lit(None).cast("string"))
    return F.coalesce(ident, F.concat_ws("|", part("timestamp"), part("amount"), part("description"), part("transaction_type")))


def deduplicate(df: DataFrame, scope: list[str], sequence: str) -> DataFrame:
    """Keep the row fetched last per transaction. max_by combines before the shuffle, so a
    row repeated a billion times still costs one row per task."""
    columns = df.columns
    keyed = df.withColumn("_id", identity_key(df))
    best = keyed.groupBy(*scope, "_id").agg(F.max_by(F.struct(*columns), F.struct(sequence)).alias("r"))
    return best.select("r.*")


def thickness(payloads: DataFrame) -> DataFrame:
    """How much a connection returned per case."""
    a = F.col("a")

    def length(name: str) -> Column:
        return F.coalesce(F.size(a[name]), F.lit(0))

    credit = F.upper(F.coalesce(a["account_type"], F.lit(""))).isin("CREDIT_CARD", "CARD", "LOAN", "MORTGAGE")
    return accounts(payloads).groupBy("case_id").agg(
        # an account that comes on several pages counts once
        (F.count_distinct(a["account_id"]) + F.count_if(a.isNotNull() & a["account_id"].isNull())).alias("accounts"),
        (F.count_distinct(F.when(credit, a["account_id"])) + F.count_if(credit & a["account_id"].isNull())).alias("credit_accounts"),
        F.sum(F.greatest(length("direct_debits"), F.lit(0)) + F.greatest(length("standing_orders"), F.lit(0))).alias("mandates"),
        F.sum(F.greatest(length("transactions"), F.lit(0))).alias("transactions"),
    )
