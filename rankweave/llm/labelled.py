"""Bounded training samples of labelled documents."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .shared import stash


def held_out(modulus: int, remainder: int, doc_id="doc_id"):
    """Whether crc32 of the document id as text has this remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, learn, each: int, cut: Callable[[pa.Array, list[int]], list[bytes]]) -> list[Row]:
    """label, order, text (a hash of it), x = ``cut`` of the text, of at most ``each`` texts per label value.

    Only label rows for which ``learn`` holds count; ids whose rows disagree are left out. Ids come by the smallest
    hash, a bounded number of them, broadcast to one scan of docs. ``cut`` makes each text, however long, a row of
    bounded size (null counts as empty), and repeated rows of an id are one, so what the driver gets is bounded.
    """
    named = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    agreed = named.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("doc_id", "label", F.xxhash64("doc_id").alias("order"))
    chosen = [agreed.where(F.col("label") == v).orderBy("order", "doc_id").limit(each) for v in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")

    def pieces(batches):
        for b in batches:
            x = cut(b.column("body"), b.column("order").to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("label", "order", "text")), pa.array(x, pa.binary())], names=["label", "order", "text", "x"])

    rows = rows.select("label", "order", F.xxhash64("body").alias("text"), "body").mapInArrow(pieces, "label int, order long, text long, x binary")
    rows = stash(rows.dropDuplicates(["label", "order", "text"]), "sample")
    return [r for v in (0, 1) for r in rows.where(F.col("label") == v).orderBy("order", "text").limit(each).collect()]


def drawn(n: int, most: int, seed: int) -> np.ndarray:
    """Which of n pieces of a text to learn from, in order: all, or ``most`` of them by a seeded draw."""
    if n <= most:
        return np.arange(n)
    return np.sort(np.random.default_rng(seed % 2**63).choice(n, most, replace=False))
