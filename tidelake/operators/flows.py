"""Per-address daily token flow."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Legs that a task is given; an address with more than CROWD_LEGS in a day is dealt by its tokens and counterparties; addresses that are watched for it.
TASK_LEGS, CROWD_LEGS, WATCHED = 250_000, 500_000, 10_000


def addr_flow_1d(transfers: DataFrame, first: str | None = None, last: str | None = None, min_transfers: int = 2) -> DataFrame:
    """Counts and in-, out- and net flow of each address and day with at least ``min_transfers`` transfers.

    transfers: date, token_address, from_address, to_address, value (decimal). Both legs of a transfer
    come from one scan; a transfer to oneself gives two rows, net 0. A null address is a group of its own,
    null counterparties are not counted. Crowded addresses are found by a pass before, which exchanges sketches only.
    """
    narrow = transfers.select("date", "token_address", "from_address", "to_address", "value")
    if first is not None or last is not None:
        span = F.lit(first or "0001-01-01").cast("date"), F.lit(last or "9999-12-31").cast("date")
        narrow = narrow.where(F.col("date").between(*span))

    token, sender, receiver = (F.col(c) for c in ("token_address", "from_address", "to_address"))
    if len({narrow.schema[c].dataType.simpleString() for c in ("token_address", "from_address", "to_address")}) > 1:
        token, sender, receiver = (c.cast("string") for c in (token, sender, receiver))

    def legs(*of_transfer: str) -> DataFrame:
        """Two rows a transfer: one of what leaves the sender, one of what comes to the receiver."""
        out, into = -F.col("value"), F.col("value")
        sent = F.struct(sender.alias("address"), token.alias("token"), receiver.alias("other"), out.alias("signed"))
        got = F.struct(receiver.alias("address"), token.alias("token"), sender.alias("other"), into.alias("signed"))
        return narrow.select("date", F.inline(F.array(sent, got))).withColumn("_key", F.xxhash64("date", "address")).select("date", "address", *of_transfer)

    def by_item(each: DataFrame) -> DataFrame:
        """The distinct tokens, which have the amounts, and counterparties of each address and day."""
        of_token = F.struct(F.lit(True).alias("of_token"), F.col("token").alias("item"), F.col("signed").alias("signed"))
        of_other = F.struct(F.lit(False).alias("of_token"), F.col("other").alias("item"), F.lit(None).cast(each.schema["signed"].dataType).alias("signed"))
        signed = F.col("signed")
        return each.select("date", "address", F.inline(F.array(of_token, of_other))).groupBy("date", "address", "of_token", "item").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.when(signed > 0, signed)).alias("inflow"), F.sum(F.when(signed < 0, -signed)).alias("outflow"), F.sum("signed").alias("net_flow")
        )

    def by_day(items: DataFrame) -> DataFrame:
        return items.groupBy("date", "address").agg(
            F.sum(F.when(F.col("of_token"), F.col("n"))).alias("transfer_count"), F.count(F.when(F.col("of_token"), F.col("item"))).alias("token_count"),
            F.count(F.when(~F.col("of_token"), F.col("item"))).alias("counterparty_count"), *[F.sum(c).alias(c) for c in ("inflow", "outflow", "net_flow")],
        )

    # a leg is exchanged once, to its address and day; those of a crowded address are combined before either of two exchanges instead, so that
    # an address with most legs of a day is no single task
    top, n = legs("_key").agg(F.expr(f"approx_top_k(_key, {WATCHED // 10}, {WATCHED})"), F.count(F.lit(1))).first()
    crowded = [r["item"] for r in top or [] if r["count"] >= CROWD_LEGS]
    every = legs("token", "other", "signed", "_key")
    is_crowded = F.col("_key").isin(crowded) if crowded else F.lit(False)
    grouped = by_day(by_item(every.where(~is_crowded).drop("_key").repartition(-(-n // TASK_LEGS) or 1, "date", "address")))
    if crowded:
        grouped = grouped.unionByName(by_day(by_item(every.where(is_crowded).drop("_key"))))
    zero = F.lit(0).cast("decimal(38,2)")
    amount = {c: F.coalesce(F.col(c).cast("decimal(38,2)"), zero) for c in ("inflow", "outflow")}
    kept = grouped.where(F.col("transfer_count") >= min_transfers).withColumns(amount | {"net_flow": F.col("net_flow").cast("decimal(38,2)")})
    return kept.withColumn("address", F.col("address").cast(transfers.schema["from_address"].dataType))
