import datetime as dt
from decimal import Decimal

from flowtrace.operators import (combine_channels, decode_token_transfers, large_swaps,
                                 large_transfer_daily, native_value_proxy, swap_daily)
from flowtrace.plans import constants as K

T = dt.datetime(2026, 4, 19, 3, 0)


def test_like_patterns_are_case_sensitive_substrings(spark):
    rows = [("ETH.ETH", "BTC.BTC"), ("ETH.USDC", "BTC.BTC"), ("eth", "BTC.BTC"),
            ("BTC.BTC", "BTC.BTC")]
    df = spark.createDataFrame([(T, a, b, 600000.0) for a, b in rows],
                               "block_timestamp timestamp, from_asset string, to_asset string, "
                               "from_amount_usd double")
    got = [r.from_asset for r in large_swaps(df, from_pattern="%ETH%", to_pattern="%BTC%",
                                             min_usd=500000).collect()]
    assert got == ["ETH.ETH", "ETH.USDC"]


def test_rounding_rows_first_differs(spark):
    rows = [(T, Decimal("0.004"), Decimal("0.00004"), Decimal("0.00004"))] * 3
    df = spark.createDataFrame(rows, "block_timestamp timestamp, from_amount_usd decimal(10,3), "
                                     "from_amount decimal(10,5), to_amount decimal(10,5)")
    v2 = swap_daily(df, exact=True).first()
    v1 = swap_daily(df, exact=True, round_rows=True).first()
    assert v2.swap_count == v1.swap_count == 3
    assert v2.total_sent == Decimal("0.0001") and v1.total_sent == Decimal("0.0000")


def test_decode_filters_contract_and_topic(spark):
    word = bytes.fromhex("00" * 27 + "e8d4a51000")  # 1,000,000 USDT
    big = (2_000_000 * 10 ** 6).to_bytes(32, "big")
    d = dt.date(2026, 4, 19)
    rows = [(T, d, b"\x01", word, K.TRON_USDT_CONTRACT, K.ERC20_TRANSFER_TOPIC),
            (T, d, b"\x02", big, K.TRON_USDT_CONTRACT, K.ERC20_TRANSFER_TOPIC),
            (T, d, b"\x03", big, b"\x41" + b"\x00" * 20, K.ERC20_TRANSFER_TOPIC),
            (T, d, b"\x04", big, K.TRON_USDT_CONTRACT, b"\x00" * 32)]
    logs = spark.createDataFrame(rows, "block_time timestamp, block_date date, tx_hash binary, "
                                       "data binary, contract_address binary, topic0 binary")
    dec = decode_token_transfers(logs, contract=K.TRON_USDT_CONTRACT,
                                 topic0=K.ERC20_TRANSFER_TOPIC, start=d, end=d + dt.timedelta(1))
    assert sorted(r.amount for r in dec.collect()) == [1_000_000.0, 2_000_000.0]
    daily = large_transfer_daily(dec, K.USDT_MIN_TRANSFER).collect()
    assert [(r.day_bucket, r.transfer_count, r.total_volume_m) for r in daily] == [(d, 1, 2.0)]


def test_native_proxy_and_channel_total(spark):
    d = dt.date(2026, 4, 19)
    rows = [(d, Decimal(2_000_000 * 10 ** 6), True), (d, Decimal(2_000_000 * 10 ** 6), False),
            (d, Decimal(999_999 * 10 ** 6), True), (d, None, True)]
    txs = spark.createDataFrame(rows, "block_date date, value decimal(38,0), success boolean")
    out = native_value_proxy(txs, min_units=K.TRX_MIN_UNITS, price=K.TRX_PRICE, exact=True,
                             start=d, end=d + dt.timedelta(1)).first()
    assert out.tx_count == 1 and out.value_usd_m == Decimal("0.240")
    both = spark.createDataFrame([(d, Decimal("1.5"), None)], "d date, a decimal(10,3), b decimal(10,3)")
    assert combine_channels(both, ["a", "b"], "t").first().t == Decimal("1.500")


def test_payloads_of_256_bits_are_summed_and_longer_ones_reported(spark):
    from flowtrace.operators.channels import (decode_token_transfers, large_transfer_daily,
                                              unreadable_logs)
    day = dt.datetime(2026, 4, 20, 5)
    words = [2 ** 200, 2 ** 70, 7 * 10 ** 12, 9 * 10 ** 6, 10 ** 7, 10 ** 7 + 1]
    data = [w.to_bytes(32, "big") for w in words] + [b"\x01" + bytes(32), None, bytes(8) + (5 * 10 ** 12).to_bytes(32, "big")]
    rows = [(day, day.date(), bytes([i]), b"a", b"b", d, b"c", b"t") for i, d in enumerate(data)]
    logs = spark.createDataFrame(
        rows, "block_time timestamp, block_date date, tx_hash binary, tx_from binary, tx_to binary, "
              "data binary, contract_address binary, topic0 binary")
    decoded = decode_token_transfers(logs, contract=b"c", topic0=b"t", exact=True)
    assert {"tx_from", "tx_to", "raw", "amount"} <= set(decoded.columns)
    total = 2 ** 200 + 2 ** 70 + 7 * 10 ** 12 + 10 ** 7 + 1 + 5 * 10 ** 12
    for kept, bound in ((decoded, 10), (decode_token_transfers(
            logs, contract=b"c", topic0=b"t", exact=True, min_amount=10), None)):
        out = large_transfer_daily(kept, bound, exact=True).collect()
        assert [r.transfer_count for r in out] == [5]  # 10 itself is not above 10
        assert abs(out[0].total_volume_m - total / 1e12) <= 1e-15 * total / 1e12
    small = large_transfer_daily(decoded.where("raw.l3 = 0"), 10, exact=True).first()
    assert small.total_volume_m == float(round(Decimal(total - 2 ** 200).scaleb(-12), 3))
    assert [bytes(r.tx_hash) for r in unreadable_logs(logs).collect()] == [b"\x06"]
    doubles = decode_token_transfers(logs, contract=b"c", topic0=b"t")
    assert doubles.where("tx_hash = X'00'").first().amount == 2 ** 200 / 1e6
    assert large_transfer_daily(doubles, 10).first().transfer_count == 5
