"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rewardloom.session import scratch_table_path

#: Entries after which a worker's word cache starts afresh.
CACHE_ENTRIES = 150_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared scratch folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(mod))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    train: Column,
    rows_per_class: int,
    max_chars: int,
) -> DataFrame:
    """A sample (doc_id, text, label, weight) of the labelled training rows.

    About ``rows_per_class`` rows of either class, chosen by a hash of the id,
    of texts of at most ``max_chars`` characters. The chosen ids, at most a few
    times ``rows_per_class``, are the only rows broadcast. A row's weight is the
    number of labelled rows that it stands for.

    :param train: condition on ``doc_id`` that a row must meet.
    """
    known = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & train)
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col("label") == value, F.lit(min(1.0, rows_per_class / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    # A doc_id with several labels takes the smallest.
    chosen = known.where(place < share).withColumn("weight", F.try_divide(F.lit(1.0), share)).groupBy("doc_id").agg(
        F.min("label").alias("label"), F.max("weight").alias("weight")
    )
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    return texts.join(F.broadcast(chosen), "doc_id")


class WordCodes(dict):
    """Memo from a space-separated word to the bytes that stand for it.

    ``code`` must depend on the word alone. When full, the memo becomes the old
    one and a new one starts, into which words still in use move back; its memory
    is bounded and its content never changes a result.
    """

    def __init__(self, code: Callable[[str], bytes], limit: int = CACHE_ENTRIES):
        super().__init__()
        self.code, self.limit = code, limit
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = self.code(word)
        self.put(word, out)
        return out

    def put(self, word: str, code: bytes) -> None:
        if len(word) > 64:
            return
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[word] = code

    def put_all(self, words: list[str], codes: list[bytes]) -> None:
        """Keeps words of at most 64 characters, fewer than the limit."""
        if len(self) + len(words) > self.limit:
            self.old = dict(self)
            self.clear()
        self.update(zip(words, codes))

    def held(self, words: list[str]) -> list[bytes | None]:
        """The code of each word, or None; distinct words of the old memo move back."""
        codes = list(map(self.get, words))
        back = [k for k, code in enumerate(codes) if code is None and words[k] in self.old] if self.old else []
        for k in back:
            codes[k] = self.old[words[k]]
        self.put_all([words[k] for k in back], [codes[k] for k in back])
        return codes

    def of(self, words: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, words))


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each run, and the end of the last."""
    out = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=out[1:])
    return out
