"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often ids meet.

Both tokenizers run over the same bytes (a text with a space before it). Ends of tokens are running sums of their
lengths; ends that both have cut the text into groups, and an A and a B token are linked where their ranges overlap.
All of it is array work over a batch of documents side by side: ``cumsum`` for the ends, ``intersect1d`` for the common
cuts, ``searchsorted`` for group labels and for the run of B tokens that each A token meets, ``repeat`` to spread the runs.

A document leaves the first pass with its distinct id pairs and how many links each has. Pairs are counted over the
corpus by a shuffle in two stages, salted first, so that no pair's rows meet in one task. Their counts then go back to
the documents in blocks of at most BLOCK_PAIRS pairs, each broadcast in turn, so nothing grows with the corpus but their number,
and that only until all pairs of the two vocabularies that can meet have met.

Defined cases: texts that are null or empty, or whose tokens of either side don't give the text back (a byte that one
tokenizer rewrites), have no tokens and only zeros; strings of special tokens are plain text; very long texts are
aligned whole; repeated rows count as often as they come; input columns of any name are kept, but for those that are added.
"""

from __future__ import annotations

import functools
import json
import math

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op11_bpe, textkit
from .shared import packed, stash, table, unpacked, with_fields

SALTS = 32
BLOCK_PAIRS = 1_000_000
SPACE = "▁"


class Bytes:
    """A byte-level BPE tokenizer file, without special tokens."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        names, level = file["model"]["vocab"], op11_bpe.byte_level()
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.bytes = [b""] * (1 + max([*names.values(), *(t["id"] for t in file["added_tokens"])]))
        for name, i in names.items():
            self.bytes[i] = bytes(level[c] for c in name)
        made = [names["".join(m.split(" ") if isinstance(m, str) else m)] for m in file["model"]["merges"]]
        #: where ids are in the order of merges they serve as ranks, which a faster library takes
        self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(self.bytes) if b}, special_tokens={}) if made == sorted(set(made)) else None

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is None or not text.isascii() and op11_bpe.unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.ranked.encode_ordinary(text), np.uint32)


class Pieces:
    """A sentencepiece model that adds a space in front."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(SPACE, " ").encode() for i, n in enumerate(names)]

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, num_threads=1), np.uint32)


@functools.lru_cache(2)
def sides(a_path: str | None = None, b_path: str | None = None) -> tuple[Bytes, Pieces]:
    """Both tokenizers, at paths that all machines have, loaded once a worker; unless given, the installed ones of 50,257 and 32,000 ids."""
    import public_tokenizers

    return Bytes(a_path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN), Pieces(b_path or public_tokenizers.path("piece_bpe_32k.model"))


class Side:
    """Tokens of one tokenizer over documents side by side: ids, starts and ends in bytes, documents."""

    def __init__(self, ids: list[np.ndarray], lengths: np.ndarray):
        self.n = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(ids)), self.n)
        self.ends = np.cumsum(lengths[self.ids])
        self.starts = self.ends - lengths[self.ids]


class Alignment:
    """Groups and links of documents side by side."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.cuts = np.intersect1d(a.ends, b.ends, assume_unique=True)
        self.group_a, self.group_b = np.searchsorted(self.cuts, a.ends), np.searchsorted(self.cuts, b.ends)
        first, end = np.searchsorted(b.ends, a.starts, "right"), np.searchsorted(b.starts, a.ends, "left")
        many = end - first
        self.of_a = np.repeat(np.arange(len(many)), many)
        self.of_b = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(self.of_a))

    def n_groups(self) -> np.ndarray:
        last = np.searchsorted(self.group_a, np.arange(len(self.cuts) + 1))[1:] - 1
        return np.bincount(self.a.doc[last], minlength=len(self.a.n))

    def n_links(self) -> np.ndarray:
        return np.bincount(self.a.doc[self.of_a], minlength=len(self.a.n))

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pairs a * width + b, links of each, first pair of each document and the end)."""
        every = self.a.doc[self.of_a], self.a.ids[self.of_a] * width + self.b.ids[self.of_b]
        order = np.lexsort(every[::-1])
        doc, pair = (x[order] for x in every)
        new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1]))[: len(doc)])
        return pair[new], np.diff(np.append(new, len(doc))), np.searchsorted(doc[new], np.arange(len(self.a.n) + 1))

    def texts(self, said: list[str]) -> list[str]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``; said: every id with each of the three marks."""
        n_a, n_b = len(self.a.ids), len(self.b.ids)
        upto_a, upto_b = (np.searchsorted(g, np.arange(len(self.cuts) + 1)) for g in (self.group_a, self.group_b))
        shown, mark = np.empty(n_a + n_b, np.int64), np.zeros(n_a + n_b, np.int64)
        at_a, at_b = np.arange(n_a) + upto_b[self.group_a], np.arange(n_b) + upto_a[self.group_b + 1]
        shown[at_a], shown[at_b] = self.a.ids, self.b.ids
        mark[at_a[upto_a[1:] - 1]], mark[at_b[upto_b[1:] - 1]] = 1, 2
        parts = list(map(said.__getitem__, (3 * shown + mark).tolist()))
        cuts = np.append(0, np.cumsum(self.a.n + self.b.n)).tolist()
        return ["".join(parts[i:j])[:-1] for i, j in zip(cuts, cuts[1:], strict=False)]


def _tokens(texts: list[str | None], own: tuple[Bytes, Pieces]) -> list[list[np.ndarray]]:
    """Ids of both sides; none where one of them doesn't give the text back."""
    out, none = ([], []), np.zeros(0, np.uint32)
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ids = (own[0].encode(" " + text), own[1].encode(text)) if text else (none, none)
        same = all(b"".join(map(t.bytes.__getitem__, x.tolist())) == whole for t, x in zip(own, ids, strict=True))
        for side, x in zip(out, ids, strict=True):
            side.append(x if same else none)
    return list(out)


ADDED = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def linked(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """row (docs' columns but ``text``), ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups`` (text), ``pairs`` (a id * B's size + b id) and their ``times``."""
    rows = packed(docs, "text").select("row", "text")

    def aligned(batches):
        own = sides(a_path, b_path)
        lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in own]
        said = [f"{i}{mark}" for i in range(max(len(t.bytes) for t in own)) for mark in ",|;"]
        for batch in batches:
            for lo, hi, _, _ in textkit.slices(batch.column("text")):
                a, b = (Side(x, n) for x, n in zip(_tokens(batch.column("text").slice(lo, hi - lo).to_pylist(), own), lengths, strict=True))
                both = Alignment(a, b)
                pairs, times, first = both.pairs(len(own[1].bytes))
                lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), x) for x in (pa.array(pairs), pa.array(times, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, hi - lo), *(pa.array(x) for x in (a.n, b.n, both.n_groups(), both.n_links())), pa.array(both.texts(said), pa.string()), *lists],
                    names=["row", *(f.split(" ")[0] for f in ADDED.split(", "))],
                )

    return rows.mapInArrow(aligned, with_fields(rows.select("row"), ADDED))


def pair_counts(pairs: DataFrame, width: int) -> DataFrame:
    """pair, count, best (whether no other pair of its B id counts more) over all rows (uid, pair, times)."""
    salted = pairs.groupBy("pair", F.pmod(F.shiftright("uid", 33), F.lit(SALTS)).alias("salt")).agg(F.sum("times").alias("times"))
    counts = stash(salted.groupBy("pair").agg(F.sum("times").alias("count")), "pairs")
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("highest"))
    return counts.withColumn("b", F.col("pair") % width).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))


def scored(rows: DataFrame, width: int) -> DataFrame:
    """rows (written; with ``uid``, ``pairs`` and ``times``) and ``n_best`` and ``count_sum`` in place of pairs and times."""
    pairs = rows.select("uid", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    counts = stash(pair_counts(pairs, width), "counts")
    blocks = max(1, math.ceil(counts.count() / BLOCK_PAIRS))
    found = None
    for i in range(blocks):
        own = lambda df, i=i: df.where(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == i) if blocks > 1 else df
        part = own(pairs).join(F.broadcast(own(counts)), "pair").select("uid", F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"), (F.col("times") * F.col("count")).alias("count_sum"))
        found = part if found is None else found.unionByName(part)
    sums = found.groupBy("uid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    held = rows.drop("pairs", "times").join(sums, "uid", "left")
    return held.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, shown=None) -> DataFrame:
    """docs but for ``text``, with n_a, n_b, n_groups, n_links, groups, n_best and count_sum.

    shown: a column made of ``groups`` that is kept in its place, so that long group texts needn't be written.
    """
    rows = linked(docs, a_path, b_path).withColumn("groups", F.col("groups") if shown is None else shown)
    rows = stash(rows.withColumn("uid", F.monotonically_increasing_id()), "linked")
    kept = [c for c in docs.columns if c.lower() != "text"]
    return unpacked(scored(rows, len(sides(a_path, b_path)[1].bytes)), kept, "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return aligned(docs, shown=digest).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))
