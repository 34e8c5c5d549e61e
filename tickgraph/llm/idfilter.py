"""A bitmap of hashed ids of bounded size, so that a scan leaves out most rows that a later join would drop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BITS, MOST_BITS, BLOCK = 1 << 16, 1 << 28, 1 << 18


class IdFilter:
    """Of the values of one long column: may(bitmap, places) is true for each of them and for few others.

    Eight bits for each value, at most 2^28 (32 MB) whatever the input; beyond that more others pass, which what follows
    must drop. The bits are gathered on executors in blocks of 2^18, so the driver gets nothing but the bitmap.
    """

    def __init__(self, ids: DataFrame, column: str):
        count = ids.count()
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(8 * count).bit_length()))
        block = min(BLOCK, self.bits)

        def gather(frame: pd.DataFrame) -> pd.DataFrame:
            flags = np.zeros(block, bool)
            flags[frame["p"].to_numpy() % block] = True
            return pd.DataFrame({"b": [int(frame["b"].iloc[0])], "bits": [np.packbits(flags, bitorder="little").tobytes()]})

        spots = ids.select(self.place(column).alias("p")).distinct().withColumn("b", F.floor(F.col("p") / block))
        whole = np.zeros(self.bits // 8, np.uint8)
        for b, bits in spots.groupBy("b").applyInPandas(gather, "b long, bits binary").collect():
            whole[b * block // 8 : (b + 1) * block // 8] = np.frombuffer(bits, np.uint8)
        self.bitmap = ids.sparkSession.sparkContext.broadcast(whole)

    def place(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.bits))

    @staticmethod
    def may(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
        return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
