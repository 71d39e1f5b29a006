"""Laundering-channel operators (OP-15 … OP-18): cross-chain swaps, decoded
token logs, native-value proxies and their per-day combination."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_FLOOR, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wide
from ..functions.double_sum import double_sum, sum_of
from ..functions.predicates import window_predicate
from ..functions.scalars import lit_number, round_scaled, scale_units
from .series import bucket_flow
from .transfers import raw_floor


def large_swaps(df: DataFrame, *, from_pattern: str, to_pattern: str, min_usd,
                time_col: str = "block_timestamp", start=None, end=None,
                from_asset: str = "from_asset", to_asset: str = "to_asset",
                usd: str = "from_amount_usd") -> DataFrame:
    """OP-15: swaps whose asset pair matches two case-sensitive LIKE patterns
    and whose USD value is strictly above ``min_usd``, in ``[start, end)``."""
    return df.where(window_predicate(time_col, start, end)
                    & F.col(from_asset).like(from_pattern)
                    & F.col(to_asset).like(to_pattern)
                    & (F.col(usd) > F.lit(min_usd)))


def swap_values(swaps: DataFrame, *, time_col: str = "block_timestamp",
                usd: str = "from_amount_usd", sent: str = "from_amount",
                 received: str = "to_amount", round_rows: bool = False) -> DataFrame:
    """Row-level part of :func:`swap_daily`: time, USD and the two amounts,
    each swap rounded first (USD to 2, amounts to 4) when ``round_rows``."""
    if round_rows:
        vals = [F.round(usd, 2).alias("_usd"), F.round(sent, 4).alias("_sent"),
                F.round(received, 4).alias("_recv")]
    else:
        vals = [F.col(usd).alias("_usd"), F.col(sent).alias("_sent"),
                F.col(received).alias("_recv")]
    return swaps.select(F.col(time_col), *vals)


SWAP_AGGS = {"swap_count": ("count", None), "_usd": ("sum", "_usd"),
             "_sent": ("sum", "_sent"), "_recv": ("sum", "_recv")}


def finish_swaps(daily: DataFrame, exact: bool = False) -> DataFrame:
    """Rounding of the per-day swap sums (millions of USD to 3 places,
    amounts to 4)."""
    return (daily.withColumn("total_swap_usd_m", round_scaled("_usd", 6, 3, exact))
            .withColumn("total_sent", F.round("_sent", 4))
            .withColumn("total_received", F.round("_recv", 4))
            .drop("_usd", "_sent", "_recv"))


def _daily(values: DataFrame, time_col: str, aggs: dict, unit: str, bucket: str) -> DataFrame:
    """One leg on its own: a plain GROUP BY (a NULL bucket keeps its sums)."""
    measures = {name: F.count(F.lit(1)) if func == "count" else sum_of(values, value)
                for name, (func, value) in aggs.items()}
    return bucket_flow(values, time_col, unit, measures, bucket=bucket)


def swap_daily(swaps: DataFrame, *, time_col: str = "block_timestamp",
               usd: str = "from_amount_usd", sent: str = "from_amount",
               received: str = "to_amount", round_rows: bool = False, exact: bool = False,
               unit: str = "date", bucket: str = "day_bucket") -> DataFrame:
    """Per-day swap count and volumes.

    ``round_rows=False`` sums then rounds (USD to 2 … millions to 3 places,
    amounts to 4). ``round_rows=True`` rounds each swap first (USD to 2,
    amounts to 4) and then the sums, which is not the same number.
    """
    values = swap_values(swaps, time_col=time_col, usd=usd, sent=sent, received=received,
                         round_rows=round_rows)
    return finish_swaps(_daily(values, time_col, SWAP_AGGS, unit, bucket), exact)


def decode_token_transfers(logs: DataFrame, *, contract: bytes, topic0: bytes,
                           decimals: int = 6, exact: bool = False, min_amount=None,
                           date_col: str = "block_date", start=None, end=None,
                           time_col: str = "block_time", data: str = "data",
                           contract_col: str = "contract_address",
                           topic_col: str = "topic0",
                           keep: Sequence[str] | None = None) -> DataFrame:
    """OP-16: token Transfer logs of one contract -> ``(block_time, …keep,
    raw, amount)``. ``raw`` is the big-endian payload word with all its 256
    bits (:mod:`..functions.wide`); ``amount`` is scaled by ``10^decimals``:
    a double, or with ``exact`` a decimal that is NULL from 2^126 on (sum and
    compare ``raw`` instead). Payloads that are no such word have neither
    (:func:`unreadable_logs`). ``min_amount`` keeps amounts strictly above it,
    compared as bytes before anything is decoded. ``keep`` defaults to the
    hash, sender and receiver of the transaction, as far as the logs have
    them. Date bounds are half-open and hit the partition column; contract and
    topic are binary equalities pushed into the scan."""
    kept = logs.where(window_predicate(date_col, start, end)
                      & (F.col(contract_col) == F.lit(contract))
                      & (F.col(topic_col) == F.lit(topic0)))
    if min_amount is not None:
        kept = kept.where(wide.above_word(data, raw_bound(min_amount, decimals)))
    if keep is None:
        keep = [c for c in ("tx_hash", "tx_from", "tx_to") if c in logs.columns]
    raw = kept.select(F.col(time_col), *keep, wide.limbs(data).alias("raw"))
    amount = scale_units(wide.to_decimal("raw"), decimals, exact=True) if exact else \
        wide.to_double("raw") / F.lit(float(10 ** decimals))
    return raw.withColumn("amount", amount)


def raw_bound(minimum, decimals: int) -> int:
    """The integer b with ``raw / 10^decimals > minimum`` for raw > b only."""
    return int(Decimal(str(minimum)).scaleb(decimals).to_integral_value(rounding=ROUND_FLOOR))


def unreadable_logs(logs: DataFrame, data: str = "data") -> DataFrame:
    """Logs whose payload is present but no integer of 256 bits: kept aside
    for inspection, as their transfers are not in any sum."""
    return logs.where(F.col(data).isNotNull() & wide.word(data).isNull())


def large_transfer_daily(transfers: DataFrame, min_amount=None, *, exact: bool = False,
                         decimals: int = 6, time_col: str = "block_time",
                         unit: str = "date", bucket: str = "day_bucket") -> DataFrame:
    """Per-day count and volume (millions, 3 places) of decoded transfers,
    strictly above ``min_amount`` if given.

    In exact mode the integers are compared and summed as limbs and scaled
    once per day: exactly up to 2^126 raw units a day, beyond that to a
    double's precision. Without ``exact``, doubles are summed.
    """
    if not exact:
        kept = transfers if min_amount is None else transfers.where(F.col("amount") > F.lit(min_amount))
        daily = bucket_flow(kept, time_col, unit, {
            "transfer_count": F.count(F.lit(1)), "_vol": sum_of(kept, "amount")}, bucket=bucket)
        return daily.withColumn("total_volume_m", round_scaled("_vol", 6, 3)).drop("_vol")
    kept = transfers
    if min_amount is not None:
        bound = raw_bound(min_amount, decimals)
        kept = transfers.where(F.col("raw") > wide.literal(bound) if bound >= 0 else F.col("raw.l0").isNotNull())
    daily = bucket_flow(kept, time_col, unit, {
        "transfer_count": F.count(F.lit(1)), "_vol": wide.sum_limbs("raw")}, bucket=bucket)
    daily = wide.carry(daily, "_vol")
    volume = F.coalesce(
        round_scaled(wide.to_decimal("_vol", carried=True), decimals + 6, 3, True).cast("double"),
        F.round(wide.to_double("_vol", carried=True) / F.lit(float(10 ** (decimals + 6))), 3))
    return daily.withColumn("total_volume_m", volume).drop("_vol")


def native_value_proxy(txs: DataFrame, *, min_units, price, decimals: int = 6,
                       exact: bool = False, date_col: str = "block_date", start=None,
                       end=None, value: str = "value", success: str = "success",
                       bucket: str = "day_bucket") -> DataFrame:
    """OP-17: per-day count and estimated USD (millions, 3 places) of
    successful native transfers above ``min_units`` whole coins, priced at a
    constant ``price``. Half-open date bounds on the partition column.

    Exact mode compares and sums raw integers; the scan gets the threshold
    (:func:`raw_floor`), and scaling and price are applied once per day."""
    kept = txs.where(window_predicate(date_col, start, end)
                     & (F.col(success) == F.lit(True))
                     & raw_floor(value, min_units, decimals, exact))
    if exact:
        daily = bucket_flow(kept, date_col, "date", {
            "tx_count": F.count(F.lit(1)), "_raw": F.sum(F.col(value).cast("decimal(38,0)"))}, bucket=bucket)
        usd = round_scaled(F.col("_raw") * lit_number(price, True), decimals + 6, 3, True)
        return daily.withColumn("value_usd_m", usd).drop("_raw")
    units = scale_units(value, decimals)
    daily = bucket_flow(kept.where(units > F.lit(min_units)), date_col, "date", {
        "tx_count": F.count(F.lit(1)), "_usd": double_sum(units * lit_number(price, False))}, bucket=bucket)
    return daily.withColumn("value_usd_m", round_scaled("_usd", 6, 3)).drop("_usd")


def combine_channels(aligned: DataFrame, parts: Sequence[str], out: str,
                     digits: int = 3) -> DataFrame:
    """OP-18: per-bucket total across channels, NULL as zero, rounded."""
    total = None
    for p in parts:
        term = F.coalesce(F.col(p), F.lit(0))
        total = term if total is None else total + term
    return aligned.withColumn(out, F.round(total, digits))
