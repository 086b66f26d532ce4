"""Text to vectors: hashed TF-IDF as Spark jobs, and any user-supplied encoder.

One pass over the texts gives ``terms``: per row the buckets of its tokens and their counts. That pass and everything
made from it is narrow; only document frequencies are aggregated, and they hold at most one row per bucket. The dense
vectors fold the buckets into ``dim``. The text similarity join keys tokens by 64 bits instead (``keyed_terms``), so
that no two words share a weight; its document frequencies are a table, not an array of fixed width.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siftwatch.functions import arrays
from siftwatch.staging import stage

DIM = 384
# Tokens, terms and vector numbers that a task works on at once.
BATCH_VALUES = 500_000
# A multiple of DIM, so that a wide bucket modulo DIM is the bucket the token has in DIM dimensions.
WIDE = DIM * 1024


def token_buckets(text, width: int) -> Column:
    """Bucket of every token: the first 8 hex digits of its md5, modulo ``width``."""
    c = F.col(text) if isinstance(text, str) else text
    tokens = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    hashed = F.transform(
        tokens,
        lambda t: F.pmod(
            F.conv(F.substring(F.md5(t.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(width)
        ).cast("int"),
    )
    return F.coalesce(hashed, F.array().cast("array<int>"))


def token_keys(text) -> Column:
    """64-bit key of every token, XXH64 of its text: a term dictionary without a fixed width."""
    c = F.col(text) if isinstance(text, str) else text
    tokens = F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda t: t != "")
    return F.coalesce(F.transform(tokens, lambda t: F.xxhash64(t)), F.array().cast("array<bigint>"))


def keyed_terms(df: DataFrame, text: str = "description") -> DataFrame:
    """``(row_id, idx, tf)``: distinct token keys in ascending order with their counts; blank text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays.release()
        for batch in arrays.bounded(batches, 1, most=BATCH_VALUES):
            row, key = arrays.ragged(batch.column(1))
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else np.zeros(0, np.int64)
            n = np.diff(np.r_[starts, len(row)])
            lengths = np.bincount(row[starts], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), arrays.lists(key[starts].astype(np.int64), lengths), arrays.lists(n.astype(np.int32), lengths)],
                names=["row_id", "idx", "tf"],
            )

    return df.select("row_id", token_keys(text).alias("k")).mapInArrow(count, "row_id bigint, idx array<bigint>, tf array<int>")


def term_counts(df: DataFrame, text: str = "description", width: int = WIDE) -> DataFrame:
    """``(row_id, idx, tf)``: distinct buckets in ascending order with their counts; blank text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in arrays.bounded(batches, 1, most=BATCH_VALUES):
            row, bucket = arrays.ragged(batch.column(1))
            key, n = np.unique(row * width + bucket, return_counts=True)
            lengths = np.bincount(key // width, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    arrays.lists((key % width).astype(np.int32), lengths),
                    arrays.lists(n.astype(np.int32), lengths),
                ],
                names=["row_id", "idx", "tf"],
            )

    return df.select("row_id", token_buckets(text, width).alias("b")).mapInArrow(
        count, "row_id bigint, idx array<int>, tf array<int>"
    )


@dataclass(frozen=True)
class Idf:
    """Inverse document frequencies: ``ln((N+1)/(df+1))`` per bucket."""

    dim: int
    n_rows: int
    df: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return np.log((self.n_rows + 1) / (self.df + 1.0))


def fit_idf(terms: DataFrame, dim: int = DIM) -> Idf:
    """Row and document frequencies in one aggregate; the driver receives at most ``dim + 1`` rows."""
    folded = F.array_distinct(F.transform("idx", lambda b: F.pmod(b, F.lit(dim))))
    # Bucket -1 occurs once in every row and so counts the rows, blank ones included.
    counts = (
        terms.select(F.explode(F.concat(F.array(F.lit(-1)), folded)).alias("b"))
        .groupBy("b")
        .agg(F.count(F.lit(1)).alias("n"))
        .toArrow()
    )
    bucket = counts.column("b").to_numpy()
    n = counts.column("n").to_numpy()
    seen = np.zeros(dim + 1, dtype=np.int64)
    seen[bucket + 1] = n
    return Idf(dim, int(seen[0]), seen[1:])


def dense_vectors(terms: DataFrame, idf: Idf, name: str = "embedding") -> DataFrame:
    """``(row_id, vector)``: unit TF-IDF vectors of length ``idf.dim``; rows without tokens get zeros."""
    dim, weights = idf.dim, idf.weights

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_VALUES // dim)
        for whole in arrays.bounded(batches, 1, most=BATCH_VALUES):
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                row, bucket = arrays.ragged(batch.column(1))
                _, tf = arrays.ragged(batch.column(2))
                bucket = bucket % dim
                flat = np.bincount(row * dim + bucket, weights=tf * weights[bucket], minlength=batch.num_rows * dim)
                unit = arrays.unit_rows(flat.reshape(batch.num_rows, dim))
                yield pa.RecordBatch.from_arrays([batch.column(0), arrays.vectors(unit)], names=["row_id", name])

    return terms.select("row_id", "idx", "tf").mapInArrow(fill, f"row_id bigint, {name} array<double>")


def embed_text(df: DataFrame, text: str = "description", dim: int = DIM, name: str = "embedding") -> DataFrame:
    """``(row_id, vector)``: the TF-IDF vectors of ``text``; frequencies come from the table itself. Neither texts nor
    vectors are shuffled."""
    terms = stage(term_counts(df, text, _width(dim)))
    return dense_vectors(terms, fit_idf(terms, dim), name)


def _width(dim: int) -> int:
    return dim * max(1, WIDE // dim)


def embed_with(
    df: DataFrame,
    encoder: Callable[[], Callable[[list[str]], np.ndarray]],
    dim: int,
    text: str = "description",
    name: str = "embedding",
    batch_size: int = 32,
) -> DataFrame:
    """``(row_id, vector)`` from a user's encoder, in one narrow pass. ``encoder`` is called once per task and returns
    the batch function, so a model is loaded once per task; blank and missing texts never reach it and get zeros."""
    schema = f"row_id bigint, {name} array<double>"

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for frame in frames:
            written = np.flatnonzero(frame["t"].notna())
            texts = frame["t"].iloc[written].tolist()
            out = np.zeros((len(frame), dim))
            for at in range(0, len(texts), batch_size):
                out[written[at : at + batch_size]] = model(texts[at : at + batch_size])
            yield pd.DataFrame({"row_id": frame["row_id"], name: list(out)})

    written = F.when(F.col(text).rlike(r"\S"), F.col(text))
    return df.select("row_id", written.alias("t")).mapInPandas(encode, schema)
