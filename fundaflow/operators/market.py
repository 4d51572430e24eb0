"""Prices, traded value and security seeds from daily bars."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NO_CIK = "0000000000"


def usable_bars(bars: DataFrame, symbols: Sequence[str] | None = None) -> DataFrame:
    rows = bars.filter((F.col("close") > 0) & (F.col("volume") >= 0))
    return rows if symbols is None else rows.filter(F.col("symbol").isin(list(symbols)))


def latest_master(master: DataFrame) -> DataFrame:
    """Later rows replace earlier ones of the same symbol (`row_order` is the file order)."""
    values = [c for c in master.columns if c not in ("symbol", "row_order")]
    return master.groupBy("symbol").agg(F.max_by(F.struct(*values), "row_order").alias("m")).select("symbol", "m.*")


#: Rows that a worker holds before it reduces them, and parts that a symbol's reduced rows meet in before they meet as one.
HELD, SALTS = 200_000, 64


def _newest(rows: DataFrame, window_bars: int) -> DataFrame:
    """Per task and symbol the newest `window_bars` rows, the newest of which carries the `bars` of all.

    Rows of its input carry the bars that they stand for, so the function can be applied again to its own
    output: it is the partial and the merging step of one aggregate.  Newest first is (time, close, volume)
    falling, nulls last and NaN first, as Spark orders them.
    """
    columns = rows.columns

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def reduced(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            symbol = pc.dictionary_encode(t.column("symbol"), null_encoding="encode").combine_chunks()
            number = symbol.indices if isinstance(symbol, pa.DictionaryArray) else symbol.chunk(0).indices
            keys = pa.table({"symbol": number, "time": t.column("time"), "nc": pc.is_nan(t.column("close")), "close": t.column("close"),
                             "nv": pc.is_nan(t.column("volume")), "volume": t.column("volume")})
            order = pc.sort_indices(keys, sort_keys=[("symbol", "ascending"), *((k, "descending") for k in ("time", "nc", "close", "nv", "volume"))])
            sorted_symbol = number.take(order).to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, np.diff(sorted_symbol) != 0))
            sizes = np.diff(np.append(begins, len(sorted_symbol)))
            age = np.arange(len(sorted_symbol)) - np.repeat(begins, sizes)
            carried = np.zeros(len(sorted_symbol), np.int64)
            carried[begins] = np.add.reduceat(t.column("bars").take(order).to_numpy(), begins)
            keep = pa.array(np.flatnonzero(age < window_bars))
            out = t.take(order.take(keep)).set_column(columns.index("bars"), "bars", pa.array(carried).take(keep))
            return out.combine_chunks().to_batches()[0]

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= HELD:
                held = [reduced(held)]
                size = held[0].num_rows
                if size > HELD // 2:  # many symbols: hand them on
                    yield held.pop()
                    size = 0
        if held:
            yield reduced(held)

    return rows.mapInArrow(reduce, rows.schema)


def bar_statistics(bars: DataFrame, window_bars: int) -> DataFrame:
    """Bar count, newest time and close, and mean traded value of the newest bars per symbol, from one scan.

    One mergeable state per symbol, its count and its newest `window_bars` rows, is built in the scan's tasks,
    merged in SALTS parts of each symbol, then as one.  A symbol with most of all bars sends at most
    `window_bars` rows a task, and no task holds more than its state.
    """
    rows = bars.select("symbol", "time", F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"), F.lit(1).cast("long").alias("bars"))
    partial = _newest(rows, window_bars).withColumn("salt", F.pmod(F.xxhash64("time", "close", "volume"), F.lit(SALTS)))
    merged = _newest(partial.repartition("symbol", "salt").drop("salt"), window_bars)
    newest_first = W.partitionBy("symbol").orderBy(F.col("time").desc(), F.col("close").desc(), F.col("volume").desc())
    ranked = merged.withColumns({"age": F.row_number().over(newest_first), "bar_count": F.sum("bars").over(W.partitionBy("symbol"))}).filter(F.col("age") <= window_bars)
    return ranked.groupBy("symbol").agg(
        F.max("bar_count").alias("bar_count"), F.max(F.struct("time", "close", "volume")).alias("newest"),
        F.sum((F.col("close") * F.col("volume")).cast("decimal(38,10)")).alias("traded"), F.count("*").alias("window_count"),
    ).select(
        "symbol", "bar_count", F.col("newest.time").alias("latest_bar_time"), F.col("newest.close").alias("price_usd"),
        (F.col("traded").cast("double") / F.col("window_count")).alias("adv_usd"),
    )


def security_seeds(master: DataFrame, bars: DataFrame, symbols: Sequence[str] | None, window_bars: int,
                   investable: bool = True) -> DataFrame:
    """Seed rows of the symbols that have a master row, an issuer id and bars."""
    stats = bar_statistics(usable_bars(bars, symbols), window_bars)
    known = latest_master(master).filter(F.col("cik") != NO_CIK)
    return known.join(stats, "symbol").select(
        "symbol", "cik", "issuer_name", "price_usd", "adv_usd",
        F.lit(investable).alias("investable"),
        F.lit("").alias("peer_group"), F.lit("").alias("sector"), F.lit("").alias("industry"),
        "shares_outstanding",
        F.when(F.col("shares_outstanding") > 0, F.col("price_usd") * F.col("shares_outstanding")).otherwise(F.lit(0.0)).alias("market_cap_usd"),
        "latest_bar_time", "bar_count",
    )


def seed_gaps(symbols: DataFrame, master: DataFrame, bars: DataFrame) -> DataFrame:
    """First thing missing per requested symbol: master row, issuer id, then bars."""
    known = latest_master(master).select("symbol", F.col("cik").alias("known_cik"))
    traded = usable_bars(bars).select("symbol").distinct().withColumn("has_bars", F.lit(True))
    missing = (
        F.when(F.col("known_cik").isNull(), F.lit("security_master"))
        .when(F.col("known_cik") == NO_CIK, F.lit("cik"))
        .when(F.col("has_bars").isNull(), F.lit("ohlcv"))
    )
    return (
        symbols.select("symbol").distinct()
        .join(known, "symbol", "left")
        .join(traded, "symbol", "left")
        .select("symbol", missing.alias("missing"))
        .filter(F.col("missing").isNotNull())
    )
