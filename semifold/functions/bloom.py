"""Bloom filters over a column, built by Spark's own distributed sketch aggregate."""

from __future__ import annotations

import math
import struct

from pyspark import SparkContext
from pyspark.sql import DataFrame

#: Nominal false-positive probability.
DEFAULT_FPP = 0.03


def optimal_bits(n: int, fpp: float) -> int:
    return max(1, math.ceil(-max(1, n) * math.log(fpp) / math.log(2) ** 2))


def optimal_hashes(n: int, bits: int) -> int:
    return max(1, round(bits / max(1, n) * math.log(2)))


class Bloom:
    """put / might_contain / merge / estimate over a JVM sketch; no false negatives."""

    def __init__(self, sketch):
        self._s = sketch

    @classmethod
    def of(cls, df: DataFrame, column: str, expected: int, fpp: float = DEFAULT_FPP) -> Bloom:
        return cls(df._jdf.stat().bloomFilter(column, int(max(1, expected)), float(fpp)))

    @classmethod
    def empty(cls, spark, expected: int, fpp: float = DEFAULT_FPP) -> Bloom:
        return cls(spark._jvm.org.apache.spark.util.sketch.BloomFilter.create(int(max(1, expected)), float(fpp)))

    def put(self, value) -> bool:
        return self._s.putLong(value) if isinstance(value, int) else self._s.putString(value)

    def might_contain(self, value) -> bool:
        return self._s.mightContainLong(value) if isinstance(value, int) else self._s.mightContainString(value)

    def merge(self, other: Bloom) -> Bloom:
        self._s = self._s.mergeInPlace(other._s)
        return self

    def estimate(self) -> float:
        """How many distinct values were put, from the share of bits that are set."""
        out = SparkContext._jvm.java.io.ByteArrayOutputStream()
        self._s.writeTo(out)
        data = bytes(out.toByteArray())
        version, hashes = struct.unpack(">ii", data[:8])
        words = data[12 if version == 1 else 16 :]
        ones, bits = sum(b.bit_count() for b in words), 8 * len(words)
        return -bits / hashes * math.log1p(-ones / bits) if ones < bits else math.inf

    def bits(self) -> int:
        return self._s.bitSize()
