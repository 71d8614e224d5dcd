"""Words and tables that the operators of this package share."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: space and the control characters tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text in order; an empty array for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, SPACE_PATTERN)).otherwise(F.array().cast("array<string>"))



class WordHashes(dict):
    """64-bit hashes of words, kept for the frequent ones of a Python worker up to a fixed number."""

    known = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.known:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def chain(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """Order-dependent 64-bit hash of aligned arrays."""
    out = np.full(parts[0].shape, seed, dtype=np.uint64)
    for part in parts:
        out ^= part
        out *= _MIX
        out ^= out >> np.uint64(29)
    return out
