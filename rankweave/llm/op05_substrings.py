"""Repeated passages: difference-cover anchors find them, window hashes settle them.

A window is WINDOW consecutive words. Positions are numbered inside each document, and COVER is a difference
cover of the residues modulo PERIOD: for any two positions i and j some k < PERIOD brings both i + k and
j + k onto cover residues. ANCHOR + PERIOD - 1 <= WINDOW, so two equal windows always share an equal anchor
(ANCHOR words at a cover position) at the same place inside them. So only anchors, about a third of all
positions, are hashed and counted over the corpus; a window is looked at further only if an anchor inside
it occurs elsewhere too. Those windows are extended to their full hashes, and the first occurrence of each
(by document id, then place) is found; all others are removed.

Everything is exchanged between batches of documents and buckets of hashes, as packed arrays. A batch sends
each hash once, however often it has it, so a passage that very many documents share costs one entry a
batch. Buckets are split by further hash bits, level by level, until one fits a task. Replies go back to the
batches, which read the documents again. Texts equal as a whole are settled before, by their hashes.

Defined cases: null and empty texts have no words; a null id comes after all ids; rows that repeat an id and
text are judged alike and don't count as earlier than each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .shared import numbered, stash, table

WINDOW, ANCHOR, PERIOD, COVER = 20, 8, 13, (0, 1, 3, 9)
BATCH_BYTES, BUCKET_BYTES = 6 << 20, 8 << 20
#: A batch sends to at most 2**LEVEL_BITS buckets at once; more buckets take more levels.
LEVEL_BITS = 12
LAST = 2**63 - 1

_ONE, _TWO = textkit.Hasher(501, lower=False), textkit.Hasher(502, lower=False)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)

Fields = dict[str, np.dtype]
ANCHORS: Fields = {"h": np.dtype("<u8"), "batch": np.dtype("<i4"), "many": np.dtype("i1")}
WINDOWS: Fields = ANCHORS | {"h2": np.dtype("<u8"), "at": np.dtype("<i8"), "pos": np.dtype("<i4")}


def _packed(bucket: int, arrays: dict[str, np.ndarray], rows: slice) -> dict:
    return {"bucket": bucket, **{k: v[rows].tobytes() for k, v in arrays.items()}}


def _batch_of(rows: list[dict], fields: Fields, key: str = "bucket") -> pa.RecordBatch:
    schema = pa.schema([(key, pa.int64()), *((k, pa.binary()) for k in fields)])
    return pa.RecordBatch.from_pylist(rows, schema)


def _ddl(fields: Fields, key: str = "bucket") -> str:
    return ", ".join([f"{key} long", *(f"{k} binary" for k in fields)])


def _split(arrays: dict[str, np.ndarray], bits: int) -> list[dict]:
    """Packed rows of the buckets that the top bits of ``h`` give. arrays are sorted by h."""
    bucket = (arrays["h"] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(arrays["h"]), np.int64)
    cut = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist() + [len(bucket)]
    return [_packed(int(bucket[i]), arrays, slice(i, j)) for i, j in zip(cut, cut[1:], strict=False)]


def _joined(column_of, fields: Fields) -> dict[str, np.ndarray]:
    return {k: np.frombuffer(b"".join(x for x in column_of(k).to_pylist() if x), t) for k, t in fields.items()}


def _exchanged(sent: DataFrame, fields: Fields, bits: int, level_bits: int) -> DataFrame:
    """Rows by bucket of ``bits`` bits, of rows by bucket of the first level's bits."""
    have = min(bits, level_bits)
    while have < bits:
        have = min(bits, have + level_bits)

        def finer(batches, have=have):
            for b in batches:
                arrays = _joined(b.column, fields)
                order = np.argsort(arrays["h"], kind="stable")
                if len(order):
                    yield _batch_of(_split({k: v[order] for k, v in arrays.items()}, have), fields)

        sent = sent.repartition("bucket").mapInArrow(finer, _ddl(fields))
    return sent


class _Words:
    """The words of a batch of documents."""

    def __init__(self, t: pa.Table):
        self.data, offsets = textkit.flat(t.column("text"))
        self.data, self.offsets = self.data[offsets[0] : offsets[-1]] if len(offsets) else self.data, offsets - offsets[0]
        self.starts, self.ends, self.begin = textkit.spans(self.data, self.offsets, textkit.SPACES)
        self.n = np.diff(self.begin)
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.pos = np.arange(len(self.starts)) - self.begin[:-1][self.row]
        self.left = self.n[self.row] - self.pos  # words from this one to its document's end

    def hashed(self, hasher: textkit.Hasher) -> np.ndarray:
        return hasher.words(self.data, self.starts, self.ends)

    def anchors(self, words: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every anchor of rows that have windows and aren't copies as a whole."""
        at = np.flatnonzero(_IN_COVER[self.pos % PERIOD] & (self.left >= ANCHOR) & ((self.n >= WINDOW) & alone)[self.row])
        return at, _ONE.windows(words, ANCHOR, at)

    def windows(self, alone: np.ndarray) -> np.ndarray:
        return (self.left >= WINDOW) & alone[self.row]


def _alone(docs: pa.Table, told: pa.Table) -> np.ndarray:
    """Whether each row isn't a copy, as a whole, of an earlier one."""
    return ~np.isin(docs.column("own").to_numpy(), told.column("copy").drop_null().to_numpy())


def _sorted_once(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices of one entry for each value, in order; whether the value occurs again)."""
    order = np.argsort(h, kind="stable")
    new = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0)
    return order[new], np.diff(np.append(new, len(order))) > 1


def _send_anchors(bits: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows:
            docs = docs.combine_chunks()
            w = _Words(docs)
            _, h = w.anchors(w.hashed(_ONE), _alone(docs, told))
            if len(h):
                one, many = _sorted_once(h)
                rows = _split({"h": h[one], "batch": np.full(len(one), docs.column("batch")[0].as_py(), "<i4"), "many": many.astype("i1")}, bits)
        return pa.Table.from_batches([_batch_of(rows, ANCHORS)])

    return send


def _reply(batch: np.ndarray, order: np.ndarray, arrays: dict[str, np.ndarray], fields: Fields) -> pa.Table:
    """Rows by batch of the given entries."""
    order = order[np.argsort(batch[order], kind="stable")]
    own = batch[order]
    cut = np.flatnonzero(np.diff(own, prepend=-1)).tolist() + [len(own)]
    rows = [{"batch": int(own[i]), **{k: v[order[i:j]].tobytes() for k, v in arrays.items()}} for i, j in zip(cut, cut[1:], strict=False)]
    return pa.Table.from_batches([_batch_of(rows, fields, "batch")])


def _repeated_anchors(t: pa.Table) -> pa.Table:
    """For each batch, its anchors that occur in another batch too, or more than once in it."""
    a = _joined(t.column, ANCHORS)
    order = np.argsort(a["h"], kind="stable")
    group = np.cumsum(np.diff(a["h"][order], prepend=a["h"][order[:1]]) != 0)
    votes = np.bincount(group, 1 + a["many"][order])
    return _reply(a["batch"], order[votes[group] > 1], {"h": a["h"]}, {"h": ANCHORS["h"]})


def _send_windows(bits: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        rows = []
        if docs.num_rows and told.num_rows:
            docs = docs.combine_chunks()
            w, alone = _Words(docs), _alone(docs, told)
            words = w.hashed(_ONE)
            at, h = w.anchors(words, alone)
            at = at[np.isin(h, _joined(told.column, {"h": ANCHORS["h"]})["h"])]
            # the windows that hold an anchor start at most PERIOD - 1 words before it
            edges = np.zeros(len(words) + 1, np.int32)
            np.add.at(edges, np.maximum(at - PERIOD + 1, w.begin[w.row[at]]), 1)
            np.add.at(edges, at + 1, -1)
            start = np.flatnonzero((np.cumsum(edges[:-1]) > 0) & w.windows(alone))
            if len(start):
                h = _ONE.windows(words, WINDOW, start)
                ids = docs.column("at").to_numpy()[w.row[start]]
                early = np.lexsort((w.pos[start], ids))
                one, many = _sorted_once(h[early])
                start, h = start[early][one], h[early][one]
                h2 = _TWO.windows(w.hashed(_TWO), WINDOW, start)
                own = {"h": h, "batch": np.full(len(h), docs.column("batch")[0].as_py(), "<i4"), "many": many.astype("i1"), "h2": h2, "at": docs.column("at").to_numpy()[w.row[start]], "pos": w.pos[start].astype("<i4")}
                rows = _split(own, bits)
        return pa.Table.from_batches([_batch_of(rows, WINDOWS)])

    return send


REPLY: Fields = {"h": WINDOWS["h"], "own": np.dtype("i1"), "at": WINDOWS["at"], "pos": WINDOWS["pos"]}


def _settled_windows(t: pa.Table) -> pa.Table:
    """For each batch, its windows that occur more than once, with their first occurrence where the batch has it."""
    a = _joined(t.column, WINDOWS)
    order = np.lexsort((a["pos"], a["at"], a["h2"], a["h"]))
    h, h2 = a["h"][order], a["h2"][order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    group = np.cumsum(new) - 1
    votes = np.bincount(group, 1 + a["many"][order])
    own = np.zeros(len(order), "i1")
    own[order[new]] = 1
    arrays = {"h": a["h"], "own": own, "at": np.where(own, a["at"], 0), "pos": np.where(own, a["pos"], 0).astype("<i4")}
    return _reply(a["batch"], order[votes[group] > 1], arrays, REPLY)


def _remove(docs: pa.Table, told: pa.Table) -> pa.Table:
    """doc_id, n_words, n_removed, kept_sha256 of a batch's documents."""
    docs = docs.combine_chunks()
    w, alone, ids = _Words(docs), _alone(docs, told), docs.column("at").to_numpy()
    r = _joined(told.column, REPLY)
    start = np.flatnonzero(w.windows(alone))
    again = np.zeros(0, np.int64)
    if len(start) and len(r["h"]):
        again = start[np.isin(_ONE.windows(w.hashed(_ONE), WINDOW, start), r["h"])]
        own = r["own"] == 1
        first = textkit.mix(textkit.mix(r["at"][own].view(np.uint64)) + r["pos"][own].astype(np.uint64))
        mine = textkit.mix(textkit.mix(ids[w.row[again]].view(np.uint64)) + w.pos[again].astype(np.uint64))
        again = again[~np.isin(mine, first)]
    edges = np.zeros(len(w.starts) + 1, np.int32)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + WINDOW, -1)
    gone = (np.cumsum(edges[:-1]) > 0) | ((w.n >= WINDOW) & ~alone)[w.row]
    kept = np.flatnonzero(~gone)
    # the bytes of kept words, and a space after each but a document's last
    take = np.zeros(len(w.data) + 1, np.int8)
    take[w.starts[kept]] += 1
    take[w.ends[kept]] -= 1
    take = np.cumsum(take[:-1], dtype=np.int8).astype(bool)
    data = w.data.copy()
    follows = np.flatnonzero(w.row[kept][1:] == w.row[kept][:-1])
    data[w.ends[kept[follows]]] = 0x20
    take[w.ends[kept[follows]]] = True
    cut = np.concatenate([[0], np.cumsum(take)])[w.offsets]
    out = data[take].tobytes()
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_words": pa.array(w.n),
            "n_removed": pa.array(np.bincount(w.row, gone, len(w.n)).astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(out[i:j]).hexdigest() for i, j in zip(cut, cut[1:], strict=False)], pa.string()),
            "n": docs.column("n"),
        }
    )


def deduplicated(docs: DataFrame, level_bits: int = LEVEL_BITS, batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs (columns doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("at"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(size / batch_bytes))
    bits = max(0, math.ceil(math.log2(max(1, size / bucket_bytes))))
    first = min(bits, level_bits)
    rows = rows.withColumns({"x1": F.xxhash64("text"), "x2": F.xxhash64(F.lit(3), "text")})
    rows = rows.withColumns({"own": F.xxhash64("at", "x1"), "batch": F.pmod(F.xxhash64("at", "x1"), F.lit(batches))})
    # rows that repeat an id and text are one until the end, so they don't fill a batch
    light = rows.select("x1", "x2", "at", "own", "batch")
    again = stash(light.groupBy("at", "x1", "x2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    key = ["at", "x1", "x2"]
    repeated = rows.join(again, key).dropDuplicates(key)
    rows = rows.join(again, key, "left_anti").withColumn("n", F.lit(1).cast("long")).select(*repeated.columns).unionByName(repeated)
    # of texts that are equal as a whole only the first has to be searched
    same = light.groupBy("x1", "x2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last")
    copies = stash(light.join(same, ["x1", "x2"]).where("at <> first").select("batch", F.col("own").alias("copy")).distinct(), "copies")
    texts = rows.select("doc_id", "text", "at", "own", "batch", "n").groupBy("batch")

    anchors = texts.cogroup(copies.groupBy("batch")).applyInArrow(_send_anchors(first), _ddl(ANCHORS))
    anchors = _exchanged(anchors, ANCHORS, bits, level_bits).groupBy("bucket").applyInArrow(_repeated_anchors, "batch long, h binary")
    anchors = stash(anchors, "anchors", "none")
    told = anchors.unionByName(copies, allowMissingColumns=True)
    windows = texts.cogroup(told.groupBy("batch")).applyInArrow(_send_windows(first), _ddl(WINDOWS))
    windows = _exchanged(windows, WINDOWS, bits, level_bits).groupBy("bucket").applyInArrow(_settled_windows, _ddl(REPLY, "batch"))
    windows = stash(windows, "windows", "none")
    told = windows.unionByName(copies, allowMissingColumns=True)
    out = texts.cogroup(told.groupBy("batch")).applyInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, n long")
    return numbered(out, "n", "at").select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, p, array_to_string(w[p:p + {WINDOW - 1}], ' ') AS t FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS p FROM d WHERE len(w) >= {WINDOW})),
f AS (SELECT t, min((doc_id, p)) AS first FROM x GROUP BY t HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS q FROM x JOIN f USING (t) WHERE (doc_id, p) > first),
k AS (SELECT d.r, count(g.q) AS n_removed, string_agg(u.word, ' ' ORDER BY u.q) FILTER (g.q IS NULL) AS kept
      FROM d, LATERAL (SELECT unnest(d.w) AS word, unnest(range(1, len(d.w) + 1)) AS q) u LEFT JOIN g ON g.r = d.r AND g.q = u.q GROUP BY d.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
