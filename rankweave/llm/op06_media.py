"""Media columns as a deduplicated chunk store with ordered chunk lists.

A payload is a run of 8-bit samples. A rolling gear hash cuts it where the content says so: after MIN_CHUNK
samples, at the first place whose hash has CUT_BITS leading zeros, at MAX_CHUNK at the latest. A chunk's
digest names it. Joins on digests and ids find one owner for each distinct chunk; only owners send theirs to
the store, as one compressed frame each. A media item is named by the digest of its ordered chunk list (by the
chunk's, if it is one), so equal payloads are one item. To read an item back its list is joined with the store
and the frames stream by in order; hash, tail and features are computed on the samples read, and compared with
the payload's own hash.

Frames are zstd with a dictionary trained on a bounded sample: the starts of SAMPLE documents by hash of their
ids. An item of one chunk is read right from its store row. Only chunks of longer items move again, by item.

Defined cases: a null or empty text is one unit of padding; a null id is a row like any other; repeated rows
share one item; very long payloads are never assembled, they stream chunk by chunk; an empty table gives an
empty store and result.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import released_shuffles, shared_dir, stash, table

UNIT = 192
MIN_CHUNK, CUT_BITS, MAX_CHUNK = 8 << 10, 13, 64 << 10
LEVEL = 6  # of compression
#: The dictionary's sample: so many documents, so many bytes of each at most.
SAMPLE, SAMPLE_BYTES, DICTIONARY = 1500, 8 << 10, 64 << 10
LAST = 2**63 - 1
_GEAR = np.random.default_rng(606).integers(0, 2**32, 256, dtype=np.uint32)


def padded(text: bytes) -> bytes:
    """The payload of a text: its bytes and spaces, up to a positive multiple of UNIT."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT)


def cut(payload: bytes) -> list[bytes]:
    """The content-defined chunks of a payload."""
    if len(payload) <= MIN_CHUNK:
        return [payload]
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after it, h[i] is the gear hash of the 32 samples up to i
        h[k:] += h[:-k] << np.uint32(k)
    ends = (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist()
    out, at, i = [], 0, 0
    while at < len(payload):
        while i < len(ends) and ends[i] < at + MIN_CHUNK:
            i += 1
        to = min(ends[i] if i < len(ends) else len(payload), at + MAX_CHUNK, len(payload))
        out.append(payload[at:to])
        at = to
    return out


def dictionary(docs: DataFrame) -> bytes | None:
    """A compression dictionary for texts like these; None where there is too little to learn from."""
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    starts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", F.left(F.col("text"), F.lit(SAMPLE_BYTES)).alias("text")).where("text IS NOT NULL")
    rows = starts.groupBy("doc_id").agg(F.min("text").alias("text")).collect()  # one row an id, however often it is repeated
    texts = [t.encode()[:SAMPLE_BYTES] for _, t in sorted((r["doc_id"], r["text"]) for r in rows)]
    size = min(DICTIONARY, sum(map(len, texts)) // 20)
    if len(texts) < 50 or size < 1024:
        return None
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # texts too much alike
        return None


def _codec(kind, words: bytes | None, **how):
    return kind(dict_data=zstandard.ZstdCompressionDict(words), **how) if words else kind(**how)


def chunked(docs: DataFrame, words: bytes | None = None, frames: bool = False) -> DataFrame:
    """at (doc_id, LAST for null), media, and doc_id, n_bytes, payload_bytes, payload_sha256, digests (null for one chunk); or frames."""
    tail = [("frames", pa.list_(pa.binary()))] if frames else [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.binary()), ("digests", pa.list_(pa.binary()))]
    schema = pa.schema([("at", pa.int64()), ("media", pa.binary()), *tail])

    def chunks(batches):
        pack = _codec(zstandard.ZstdCompressor, words, level=LEVEL)
        for b in batches:
            column = b.column("text").cast(pa.large_binary())
            for lo in range(0, b.num_rows, 500):
                rows = []
                for i in range(lo, min(lo + 500, b.num_rows)):
                    text = column[i].as_py() or b""
                    own = padded(text)
                    parts = cut(own)
                    digests = [hashlib.sha256(x).digest() for x in parts]
                    doc = b.column("doc_id")[i].as_py()
                    row = {"at": LAST if doc is None else doc, "media": digests[0] if len(parts) == 1 else hashlib.sha256(b"".join(digests)).digest()}
                    row |= {"frames": [pack.compress(x) for x in parts]} if frames else {"doc_id": doc, "n_bytes": len(text), "payload_bytes": len(own), "payload_sha256": hashlib.sha256(own).digest(), "digests": digests if len(parts) > 1 else None}
                    rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, schema)

    types = "frames array<binary>" if frames else "doc_id long, n_bytes long, payload_bytes long, payload_sha256 binary, digests array<binary>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(chunks, f"at long, media binary, {types}")


class _Reading:
    """Features of a stream of samples."""

    def __init__(self):
        self.plain, self.stored = hashlib.sha256(), hashlib.sha256()
        self.n = self.stored_n = self.crossings = 0
        self.tail, self.counts, self.last = b"", np.zeros(256, np.int64), None

    def add(self, frame: bytes, samples: bytes) -> None:
        self.stored.update(frame)
        self.plain.update(samples)
        self.n, self.stored_n = self.n + len(samples), self.stored_n + len(frame)
        self.tail = (self.tail + samples[-16:])[-16:]
        x = np.frombuffer(samples, np.uint8)
        self.counts += np.bincount(x, minlength=256)
        high = x >= 96
        self.crossings += int(np.count_nonzero(high[1:] != high[:-1])) + int(self.last is not None and bool(high[0]) != self.last)
        self.last = bool(high[-1])

    def row(self, media: bytes) -> dict:
        p = self.counts / max(self.n, 1)
        mean = float(p @ np.arange(256))
        std = math.sqrt(max(0.0, float(p @ (np.arange(256) - mean) ** 2)))
        q = p[p > 0]
        feature = f"mean={mean:.4f} std={std:.4f} entropy={-float(q @ np.log2(q)):.4f} crossings={self.crossings}"
        return {"media": media, "read_sha256": self.plain.digest(), "read_bytes": self.n, "tail_crc32": zlib.crc32(self.tail), "media_bytes": self.stored_n, "media_sha256": self.stored.hexdigest(), "feature": feature}


_READ = "media binary, read_sha256 binary, read_bytes long, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_READ_ARROW = pa.schema([("media", pa.binary()), ("read_sha256", pa.binary()), ("read_bytes", pa.int64()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _readings(words: bytes | None):
    """Features of items (``media``) whose frames follow each other in order."""

    def read(batches):
        unpack = _codec(zstandard.ZstdDecompressor, words)
        at, reading = None, None
        for b in batches:
            rows = []
            for media, frame in zip(b.column("media"), b.column("frame"), strict=True):
                media, frame = media.as_py(), frame.as_py()
                if media != at:
                    if reading is not None:
                        rows.append(reading.row(at))
                    at, reading = media, _Reading()
                reading.add(frame, unpack.decompress(frame))
            yield pa.RecordBatch.from_pylist(rows, _READ_ARROW)
        if reading is not None:
            yield pa.RecordBatch.from_pylist([reading.row(at)], _READ_ARROW)

    return read


def store(docs: DataFrame, words: bytes | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write the chunk store. Returns (items, lists, store).

    items: a row for each row of docs; lists: media, idx, digest of each distinct item of several chunks; store:
    digest, frame, and whether the chunk is an item alone (``solo``) and ``part`` of an item of several.
    """
    spark = docs.sparkSession
    items = stash(chunked(docs), "items")
    distinct = items.groupBy("media").agg(F.min(F.struct("at", "digests")).alias("m"))
    lists = distinct.select("media", F.col("m.at").alias("at"), F.posexplode(F.coalesce("m.digests", F.array("media"))).alias("idx", "digest"), F.greatest(F.coalesce(F.size("m.digests"), F.lit(0)), F.lit(0)).alias("n"))
    lists = stash(lists, "lists")
    owners = lists.groupBy("digest").agg(F.min(F.struct("at", "media", "idx")).alias("o"), (F.max("n") > 1).alias("part"), (F.min("n") < 1).alias("solo"))
    owned = owners.groupBy("o.at", "o.media").agg(F.collect_list(F.struct(F.col("o.idx").alias("idx"), "digest", "part", "solo")).alias("owned"))
    sent = chunked(docs, words, frames=True).join(owned, ["at", "media"]).dropDuplicates(["at", "media"])
    rows = sent.select("frames", F.explode("owned").alias("o")).select("o.digest", F.element_at("frames", F.col("o.idx") + 1).alias("frame"), "o.solo", "o.part")
    path = f"{shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    with released_shuffles(spark):
        rows.write.option("compression", "none").partitionBy("part").parquet(path)
    schema = rows.select("digest", "frame", "solo", "part").schema
    return items, lists.where("n > 1").select("media", "idx", "digest"), spark.read.schema(schema).parquet(path)


def read_back(lists: DataFrame, chunks: DataFrame, words: bytes | None) -> DataFrame:
    """media and what is computed from its stored samples (columns of _READ)."""
    alone = chunks.where("solo").select(F.col("digest").alias("media"), "frame").mapInArrow(_readings(words), _READ)
    many = lists.join(chunks.where("part").select("digest", "frame"), "digest")
    many = many.repartition("media").sortWithinPartitions("media", "idx").select("media", "frame").mapInArrow(_readings(words), _READ)
    return alone.unionByName(many)


def media(docs: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, text) with the sizes, hashes and features of its stored payload.

    A payload that doesn't read back as it was written fails the query.
    """
    words = dictionary(docs)
    items, lists, chunks = store(docs, words)
    read = stash(read_back(lists, chunks, words), "read")
    same = (F.col("read_sha256") == F.col("payload_sha256")) & (F.col("read_bytes") == F.col("payload_bytes"))
    checked = F.when(same, F.lower(F.hex("read_sha256"))).otherwise(F.raise_error(F.lit("a stored payload differs from the one written")))
    out = items.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media").join(read, "media", "left")
    return out.select("doc_id", "n_bytes", "payload_bytes", checked.alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", F.lower(F.hex("media")).alias("media"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(table(spark, sf_dir, "documents"))
