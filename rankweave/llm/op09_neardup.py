"""Near-duplicate documents by a multi-index Hamming join of b-bit minwise signatures.

A document's set of distinct shingles (``words`` words each) gets a signature of PARTS values of 8 bits, each
equal between two sets with their Jaccard similarity as probability. Linked sets differ in REACH values at most
(a sum of PARTS draws; the share of links at the very threshold that lie further is about one in 100,000, and
falls steeply above it). The query op9_neardup links from 3 words and 85 percent; a lower threshold needs more
values and a longer reach (``Law``). The signature is split into CHUNKS chunks, and since REACH < 2 * CHUNKS some chunk of any
such pair has one error at most. So for every chunk each single value in turn is masked, which enumerates all
allowed errors on both sides: equal masked chunks find every pair within REACH. Candidates are confirmed on
the full shingle sets.

Groups may be very large, so pairs inside a bucket are never listed. Equal sets become one class first;
buckets with the same members are merged; then every member is compared with one hub, first the smallest id,
then the member with most links. Buckets whose members are connected are done. Only what is still apart
is compared member by member, in blocks: first signatures alone, so strangers that met in a bucket never move
their texts, then, of members with a partner within REACH, the full sets as bit rows, and only
links that join components come out. Connecting links are all that components need; no pair of members of
different components is skipped.

Defined cases: null and empty texts have no shingles and are linked with nothing; rows with the same id are
one document, linked with whatever one of them is, and of a kept one's rows the one with the smallest hash
stays; a null id has no component (null) and is kept; repeated rows are all returned by ``components``; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .components import contract, merged
from .shared import packed, stash, table, unpacked

WORDS, PERCENT = 3, 85
PARTS, CHUNKS, REACH = 64, 12, 23
HUB_ROWS, BLOCK_ROWS = 256, 1024
#: Signatures that one task masks: about 16 MB of keys for each.
MASK_ROWS = 1 << 14
SLAB = 1 << 14  # shingles that a bit row holds at once

_HASH = textkit.Hasher(909, lower=True)
#: Least percent, PARTS and CHUNKS of a signature that holds there; the reach is 2 * CHUNKS - 1.
SHAPES = ((PERCENT, PARTS, CHUNKS), (80, 85, 17))


@lru_cache
def _drawn(parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the minwise hashes, and a hash of each value at each place."""
    rng = np.random.default_rng(910)
    return rng.integers(0, 2**63, parts, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, (parts, 256), dtype=np.uint64)


class Law(NamedTuple):
    """What a link is (shingles of so many words, similar to so many percent), and the signature that finds all."""

    words: int
    percent: int
    parts: int
    chunks: int

    @property
    def reach(self) -> int:
        return 2 * self.chunks - 1

    @property
    def chunk_of(self) -> np.ndarray:
        return np.arange(self.parts) * self.chunks // self.parts


def law(words: int = WORDS, percent: int = PERCENT) -> Law:
    for least, parts, chunks in SHAPES:
        if percent >= least:
            return Law(words, percent, parts, chunks)
    raise ValueError(f"no signature holds at {percent} percent; the least is {SHAPES[-1][0]}")


OP9 = law()
_CHUNK_OF = OP9.chunk_of


def sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, row after row and in order inside a row, and each row's first (and the end)."""
    starts, ends, begin = textkit.spans(data, offsets, textkit.SPACES)
    own, rows = _HASH.words(data, starts, ends), len(offsets) - 1
    counts = np.diff(begin)
    row = np.repeat(np.arange(rows), counts)
    grams = _HASH.windows(own, words)
    inside = np.arange(len(grams)) + words <= begin[1:][row[: len(grams)]]
    grams, of = grams[inside], row[: len(grams)][inside]
    for k in range(1, words):  # a shorter text is one shingle
        short = begin[:-1][counts == k]
        if len(short):
            grams, of = np.append(grams, _HASH.windows(own, k, short)), np.append(of, row[short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], np.searchsorted(of[new], np.arange(rows + 1))


def sign(grams: np.ndarray, begin: np.ndarray, parts: int = PARTS) -> np.ndarray:
    """Signatures of the rows that have shingles."""
    at = begin[:-1][np.diff(begin) > 0]
    out = np.empty((len(at), parts), np.uint8)
    if len(at):
        for i, f in enumerate(_drawn(parts)[0]):
            out[:, i] = (textkit.mix(np.minimum.reduceat(grams * f, at)) >> np.uint64(56)).astype(np.uint8)
    return out


def signatures(docs: DataFrame, by: Law = OP9) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (s1, s2), and the signature (null without shingles)."""

    def signed(batches):
        for b in batches:
            for lo, hi, data, offsets in textkit.slices(b.column("text")):
                grams, begin = sets(data, offsets, by.words)
                n = np.diff(begin)
                full = np.flatnonzero(n > 0)
                digests = np.zeros((2, hi - lo), np.uint64)
                for i, salt in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    if len(full):
                        digests[i][full] = textkit.mix(np.add.reduceat(textkit.mix(grams ^ np.uint64(salt)), begin[:-1][full]))
                sig = np.full(hi - lo, None, object)
                sig[full] = [s.tobytes() for s in sign(grams, begin, by.parts)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(n), *(pa.array(d.view(np.int64)) for d in digests), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "s1", "s2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(signed, "doc_id long, n_shingles long, s1 long, s2 long, sig binary")


def _matrix(column, parts: int) -> np.ndarray:
    data, offsets = textkit.flat(column)
    return data[offsets[0] : offsets[-1]].reshape(-1, parts)


def _masks(sig: np.ndarray, by: Law) -> np.ndarray:
    """A key for each value of each signature (rows): its chunk without that value."""
    values = _drawn(by.parts)[1][np.arange(by.parts), sig]
    totals = np.add.reduceat(values, np.searchsorted(by.chunk_of, np.arange(by.chunks)), axis=1)
    return textkit.mix(totals[:, by.chunk_of] - values + np.arange(1, by.parts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def masked(reps: DataFrame, by: Law = OP9) -> DataFrame:
    """key, rid: every chunk of every signature with each of its values masked in turn."""

    def keys(batches):
        for b in batches:
            key = _masks(_matrix(b.column("sig"), by.parts), by)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1)), pa.array(np.repeat(b.column("rid").to_numpy(), by.parts))], names=["key", "rid"])

    tasks = max(1, math.ceil(reps.count() / MASK_ROWS))
    return reps.select("rid", "sig").repartition(tasks, "rid").mapInArrow(keys, "key long, rid long")


def buckets(reps: DataFrame, by: Law = OP9) -> DataFrame:
    """key, rid of the masked chunks that several classes share; one key for each set of members."""
    keys = masked(reps, by)
    mark = (F.bit_xor(F.xxhash64("rid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(5), "rid")).alias("x2"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *mark).where("n > 1")
    return keys.join(shared.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key").hint("merge"), "key")


def near(pairs: DataFrame, reps: DataFrame, by: Law = OP9) -> DataFrame:
    """The pairs (a, b) whose set sizes and signatures allow a link."""
    side = lambda c: reps.select(F.col("rid").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sig").alias(f"sig_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= by.percent * F.greatest("n_a", "n_b"))

    def within(batches):
        for b in batches:
            yield b.filter(pa.array((_matrix(b.column("sig_a"), by.parts) != _matrix(b.column("sig_b"), by.parts)).sum(1) <= by.reach)).select(["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(within, "a long, b long").distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, by: Law = OP9) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Pairs are grouped by ``b``, HUB_ROWS at a time: a hub's text comes once for each such part and its members' texts
    follow, in one sorted stream for each task.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")))
    members = dealt.select(F.col("b").alias("hub"), "part", F.col("a").alias("rid"), F.lit(1).alias("role")).join(texts, "rid")
    hubs = parts.select(F.col("b").alias("hub"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("b").alias("rid"), F.lit(0).alias("role")).join(texts, "rid")
    rows = members.unionByName(hubs)
    spread = F.pmod(F.xxhash64("hub", "part"), F.lit(1 << 30)).alias("deal")
    rows = rows.select("hub", "part", "rid", "role", "text", spread).repartition("deal").sortWithinPartitions("hub", "part", "role")

    def verified(batches):
        at, held = None, []
        for b in batches:
            names = [b.column(c).to_pylist() for c in ("hub", "part", "rid", "role")]
            out: list[tuple[int, int]] = []
            for lo, _, data, offsets in textkit.slices(b.column("text")):
                grams, begin = sets(data, offsets, by.words)
                for r in range(len(begin) - 1):
                    hub, part, rid, role = (v[lo + r] for v in names)
                    if at != (hub, part):
                        at, held = (hub, part), []
                    own = grams[begin[r] : begin[r + 1]]
                    if role == 0:
                        held.append(own.copy())
                        continue
                    for other in held:
                        common = np.count_nonzero(other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own) if len(other) else 0
                        if common and 100 * common >= by.percent * (len(own) + len(other) - common):
                            out.append((rid, hub))
                            break
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return rows.select("hub", "part", "rid", "role", "text").mapInArrow(verified, "a long, b long").distinct()


def _apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """key, rid, c of the buckets whose members aren't yet all in one component."""
    named = members.join(label.withColumnRenamed("v", "rid"), "rid", "left").select("key", "rid", F.coalesce("c", "rid").alias("c"))
    named = stash(named, "named")
    open_ = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key")
    return stash(named.join(open_, "key"), "apart")


def _shared(grams: np.ndarray, begin: np.ndarray, asking: np.ndarray, partners: list[np.ndarray]) -> list[np.ndarray]:
    """For each asking row, how many shingles it shares with each of its partners."""
    _, column, counts = np.unique(grams, return_inverse=True, return_counts=True)
    both = counts > 1  # a shingle of one row is in no intersection
    column = np.where(both, np.cumsum(both) - 1, -1)[column]
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    out = [np.zeros(len(j), np.int64) for j in partners]
    for lo in range(0, int(both.sum()), SLAB):
        inside = (column >= lo) & (column < lo + SLAB)
        bits = np.zeros((len(begin) - 1, SLAB), bool)
        bits[row[inside], column[inside] - lo] = True
        bits = np.packbits(bits, axis=1).view(np.uint64)
        for i, j, n in zip(asking, partners, out, strict=True):
            n += np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)
    return out


def _compare(t: pa.Table, by: Law = OP9) -> pa.Table:
    """Links that join components among the members (rid, c, text, own) of a block, or between two blocks, of a bucket.

    Members of the commonest component needn't ask for partners, as all others ask for theirs.
    """
    t = t.combine_chunks()
    parts, base = [], 0
    for _, _, data, offsets in textkit.slices(t.column("text")):
        grams, begin = sets(data, offsets, by.words)
        parts.append((grams, begin[:-1] + base))
        base += len(grams)
    grams, begin = np.concatenate([g for g, _ in parts]), np.append(np.concatenate([b for _, b in parts]), base)
    n = np.diff(begin)
    rid, c, side = (t.column(x).to_numpy() for x in ("rid", "c", "own"))
    sig = np.zeros((len(n), by.parts), np.uint8)
    sig[n > 0] = sign(grams, begin, by.parts)
    within = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
    names, counts = np.unique(c, return_counts=True)
    asking = np.flatnonzero((c != names[np.argmax(counts)]) & (n > 0))
    partners = []
    for i in asking:
        j = np.flatnonzero((c != c[i]) & (within | (side != side[i])) & (n > 0) & (100 * np.minimum(n, n[i]) >= by.percent * np.maximum(n, n[i])))
        partners.append(j[(sig[j] != sig[i]).sum(1) <= by.reach])
    own: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := own.get(x, x)) != x:
            x = up
        return x

    found = []
    for i, j, common in zip(asking, partners, _shared(grams, begin, asking, partners), strict=True):
        j = j[100 * common >= by.percent * (n[j] + n[i] - common)]
        for other, at in zip(*np.unique(c[j], return_index=True), strict=True):
            x, y = root(int(c[i])), root(int(other))
            if x != y:
                own[max(x, y)] = min(x, y)
                found.append(sorted((int(rid[i]), int(rid[j[at]]))))
    return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})


def _partnered(t: pa.Table, by: Law = OP9) -> pa.Table:
    """The members of a block pair whose sizes and signatures allow a link with a member of another component.

    Near members meet in many buckets. A pair counts only in that of its smallest common key, which is the bucket's
    own key, as the one kept for buckets with the same members is the smallest; that bucket is still open while its
    members are apart.
    """
    n, c, side = (t.column(x).to_numpy() for x in ("n_shingles", "c", "own"))
    sig = _matrix(t.column("sig"), by.parts)
    within = t.column("lo")[0].as_py() == t.column("hi")[0].as_py()
    names, counts = np.unique(c, return_counts=True)
    keys, here, found = _masks(sig, by), t.column("key")[0].as_py(), np.zeros(len(n), bool)
    for i in np.flatnonzero(c != names[np.argmax(counts)]):
        j = np.flatnonzero((c != c[i]) & (within | (side != side[i])) & (100 * np.minimum(n, n[i]) >= by.percent * np.maximum(n, n[i])))
        j = j[(sig[j] != sig[i]).sum(1) <= by.reach]
        j = j[np.where(keys[j] == keys[i], keys[j], np.iinfo(np.int64).max).min(1) == here] if len(j) else j
        if len(j):
            found[j] = found[i] = True
    return t.filter(pa.array(found)).select(["key", "lo", "hi", "own", "rid", "c"])


def _across(apart: DataFrame, reps: DataFrame, texts: DataFrame, by: Law = OP9) -> DataFrame:
    """Links (a, b) that join what is apart in a bucket. Blocks of BLOCK_ROWS members meet pair by pair, a task each."""
    sizes = apart.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).alias("blocks"))
    rows = apart.join(sizes, "key").join(reps, "rid").withColumn("own", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")})
    rows = rows.select("key", "lo", "hi", "own", "rid", "c", "n_shingles", "sig")
    met = rows.groupBy("key", "lo", "hi").applyInArrow(lambda t: _partnered(t, by), "key long, lo long, hi long, own long, rid long, c long")
    met = stash(met.distinct(), "met").join(texts, "rid")
    return met.select("key", "lo", "hi", "own", "rid", "c", "text").groupBy("key", "lo", "hi").applyInArrow(lambda t: _compare(t, by), "a long, b long").distinct()


def _texts(docs: DataFrame, signed: DataFrame, ids: DataFrame) -> DataFrame:
    """rid, text of these ids, each text of an id once."""
    again = stash(signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("rid")), "again")
    rows = docs.select(F.col("doc_id").alias("rid"), "text").join(ids.hint("merge"), "rid", "left_semi")
    repeated = rows.join(again, "rid", "left_semi").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(9), "text")})
    return rows.join(again, "rid", "left_anti").unionByName(repeated.dropDuplicates(["rid", "h1", "h2"]).select("rid", "text"))


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, earlier: DataFrame | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; linked from ``percent`` of their ``words``-word shingles.

    earlier: components (doc_id, component_id) by another law, whose members are linked as well.
    """
    by = law(words, percent)
    signed = stash(signatures(docs, by), "signed")
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stash(known.groupBy("s1", "s2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("r")).select("s1", "s2", "n_shingles", F.col("r.doc_id").alias("rid"), F.col("r.sig").alias("sig")), "classes")
    reps = classes.select("rid", "n_shingles", "sig")
    members = stash(buckets(reps, by), "members")
    of_class = signed.join(classes.select("s1", "s2", "n_shingles", "rid"), ["s1", "s2", "n_shingles"], "left")
    # rows with one id but different texts are one document
    ids = of_class.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("rid").alias("a"), F.max("rid").alias("m"), F.count_if(F.col("rid").isNull()).alias("empty"))
    several = ids.where("a <> m").select("doc_id", "a")
    links = of_class.join(several, "doc_id").where("rid <> a").select("a", F.col("rid").alias("b")).distinct()
    if earlier is not None:
        held = of_class.where("rid IS NOT NULL").join(earlier.select("doc_id", "component_id").distinct(), "doc_id").select("component_id", F.col("rid").alias("b")).distinct()
        first = held.groupBy("component_id").agg(F.min("b").alias("a"))
        links = links.unionByName(held.join(first, "component_id").where("a <> b").select("a", "b")).distinct()
    links = stash(links, "links")
    label = contract(links)
    apart = members if earlier is None else _apart(members, label)
    texts = stash(_texts(docs, signed, apart.select("rid").distinct()), "texts")
    for how in ("smallest", "linked", "apart"):
        if how == "apart":
            fresh = _across(apart, reps, texts, by)
        else:
            if how == "smallest":
                hubs = apart.groupBy("key").agg(F.min("rid").alias("hub"))
            else:
                degree = links.select(F.explode(F.array("a", "b")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("degree"))
                hubs = apart.join(degree, "rid", "left").groupBy("key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.col("rid")).alias("r"))).alias("m")).select("key", (-F.col("m.r")).alias("hub"))
            pairs = apart.join(hubs, "key").where("rid <> hub").select(F.col("rid").alias("a"), F.col("hub").alias("b")).distinct()
            fresh = confirmed(stash(near(pairs, reps, by), "pairs"), texts, by)
        fresh = stash(fresh, "links")
        links = links.unionByName(fresh)
        label = merged(label, fresh)
        if how == "apart":
            break
        apart = _apart(apart.select("key", "rid"), label)
        if not apart.limit(1).count():
            break
    # a row without words goes with the other rows of its id
    partly = ids.where("a IS NOT NULL AND empty > 0").select("doc_id", "a")
    named = of_class.join(partly, "doc_id", "left").withColumn("rid", F.coalesce("rid", "a")).join(label.withColumnRenamed("v", "rid"), "rid", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "rid", "doc_id")).alias("component_id"))


def kept():
    return F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))


def deduplicated(docs: DataFrame, laws: tuple[tuple[int, int], ...] = ((WORDS, PERCENT),)) -> DataFrame:
    """The rows of docs, with their columns, of the first document of each component; a document's repeated rows are one.

    Documents are linked by any of the laws (words, percent). Rows without an id stay.
    """
    found = None
    for words, percent in laws:
        found = components(docs, words, percent, found)
        if len(laws) > 1:
            found = stash(found, "found")
    # of the rows of an id the one with the smallest hash stays, whatever order they come in
    names = docs.columns
    nulls = F.array(*(F.col("row").getField(c).isNull() for c in names))
    rows = packed(docs).select("row", F.col("row").getField("doc_id").alias("id")).withColumns({"h1": F.xxhash64(F.col("row").getField("text"), "row", nulls), "h2": F.xxhash64(F.lit(4), nulls, "row")})
    own = rows.where("id IS NOT NULL").groupBy("id", "h1", "h2").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.min(F.struct("h1", "h2", "n")).alias("m"))
    ids = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    chosen = stash(own.join(ids, "id", "left_semi").select("id", "m.h1", "m.h2", "m.n"), "kept")
    kept = rows.join(chosen, ["id", "h1", "h2"])
    once, more = kept.where("n = 1").select("row"), kept.where("n > 1").groupBy("id").agg(F.first("row").alias("row")).select("row")
    return unpacked(once.unionByName(more).unionByName(rows.where("id IS NULL").select("row")), names)


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return components(docs).select("doc_id", "n_shingles", "component_id", kept().alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM d WHERE doc_id IS NOT NULL),
n AS (SELECT r, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS m FROM g x JOIN g y ON x.s = y.s AND x.r < y.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * m >= 85 * (na.n + nb.n - m)
      UNION SELECT first, r FROM (SELECT r, min(r) OVER (PARTITION BY doc_id) AS first FROM d WHERE doc_id IS NOT NULL) WHERE first < r),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k(v, c) AS (SELECT r, doc_id FROM d UNION SELECT e.b, k.c FROM k JOIN e ON e.a = k.v),
t AS (SELECT v, min(c) AS c FROM k GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, t.c AS component_id, t.c = d.doc_id AS kept
FROM d JOIN t ON t.v = d.r LEFT JOIN n ON n.r = d.r
"""
