"""Mixing sources to target weights by balanced sampling: the cube method.

A source whose target is r times its size takes every document floor(r) times and some of them once more,
each with probability r - floor(r). Which ones is drawn by the cube method: the vector of probabilities
walks through the null space of two constraints, the source's number of documents and its number of words,
until all but a few entries are 0 or 1 (flight); of all ways to round the last LANDING ones, the way that keeps
both totals best is taken (landing).

Units are distinct rows, known by a hash: n identical rows that are each taken with probability p are one unit
that is taken floor(n * p) times for sure and once more with the probability that is left, which is what the
walk decides. So units are light, whatever the rows carry, and copies of one row never share a chunk with
more than themselves. The rows themselves are only joined to what was decided.

The flight runs in chunks of a source, which are small however large the source; what is still fractional,
two units a chunk at most, flies again in chunks of its own, level by level, until one chunk is left to
land. Large documents fly first and in pairs of like size, so the rounding falls on small ones. All draws come from
seeded hashes of a unit and of its chunk, so a task that runs again, and a rerun, decide alike.

Defined cases: a null text has size 0; null sources form a source of their own, ordered last; repeated rows
are taken alike, but for one time more or less; a source without words has target 0; an empty table gives an
empty result; input columns named ``size``, ``source_size``, ``target`` or ``copies`` are replaced.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import numbered, packed, quoted, small, stash, table, unpacked

WEIGHTS = (5, 2, 1)
MOST = 3  # times a document or a source may be repeated
CHUNK_ROWS = 2048
LANDING = 12  # entries that are still fractional when a source lands
LARGE = 1 / 10  # share of the open words from which a document is settled before all others
MEND = 0.005  # share of a source's words that a landing may be off
EPS = 1e-9


def n_words():
    return F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row for each ``source``: units, source_size, target. units: ``source``, ``size``, ``n`` (rows).

    Shares are by weight; a target stops at MOST times its source, which fixes the level at which all others
    share what is left. Sources are ordered by code point; this table has one row for each source.
    """
    by = units.groupBy("source").agg(F.count(F.lit(1)).alias("units"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").startswith("n"), "source")) - 1, F.lit(len(weights)))
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    total = by.agg(F.sum("source_size")).first()[0] or 0
    order = Window.orderBy("ratio", "source")
    ranked = by.withColumn("ratio", MOST * F.col("source_size") / F.col("w"))
    full = F.coalesce(F.sum(MOST * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.lit(total) - full) / rest).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "source"))).first()[0] or 0.0
    return by.withColumn("target", F.least((MOST * F.col("source_size")).cast("double"), F.col("w") * level))


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """p after the flight (and landing): sums of p and of p * size are kept while three entries are open."""
    wanted = float(p @ size)
    p = _settle_large(np.array(p, float), size, rng)
    p, size = p.tolist(), size.tolist()
    draws = iter(rng.random(2 * len(p) + 8).tolist())
    waiting = deque(i for i, v in enumerate(p) if EPS < v < 1 - EPS)  # largest first
    anchor, active = None, []
    while True:
        # Two of like size trade places while the smallest, the anchor, makes up their difference: so no large one is left last.
        if anchor is None and waiting:
            anchor = waiting.pop()
            active.append(anchor)
        while len(active) < 3 and waiting:
            active.append(waiting.popleft())
        if land and len(active) + len(waiting) <= LANDING:
            return _mended(np.array(_land(p, size, [*active, *waiting])), np.array(size), wanted)
        if len(active) < 2:
            break
        s = [size[i] for i in active]
        if len(s) == 3:
            u = [s[1] - s[2], s[2] - s[0], s[0] - s[1]]
            if not any(u):
                u = [1, -1, 0]
        elif s[0] == s[1]:
            u = [1, -1]
        else:
            break
        ahead = back = float("inf")
        for i, v in zip(active, u, strict=True):
            if v:
                up, down = (1 - p[i]) / abs(v), p[i] / abs(v)
                ahead, back = min(ahead, up if v > 0 else down), min(back, down if v > 0 else up)
        step = ahead if next(draws) * (ahead + back) < back else -back
        for i, v in zip(active, u, strict=True):
            p[i] += step * v
        done = [i for i in active if not EPS < p[i] < 1 - EPS]
        for i in done:
            p[i] = float(round(p[i]))
        active = [i for i in active if i not in done]
        anchor = None if anchor in done else anchor
    return np.array(p)


def _settle_large(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """p with every entry of over LARGE of the open words at 0 or 1, in order of size.

    Each walks along the projection of its own axis on the null space, so what it gains or gives all others share;
    a partner or two couldn't make up for it.
    """
    for i in np.lexsort((np.arange(len(p)), -size)):
        while EPS < p[i] < 1 - EPS:
            at = np.flatnonzero((p > EPS) & (p < 1 - EPS))
            own = size[at].astype(float)
            if len(at) < 4 or size[i] <= LARGE * own.sum():
                return p
            a = np.array([np.ones(len(at)), own / own.mean()])
            u = (at == i) - a.T @ np.linalg.lstsq(a @ a.T, a[:, np.searchsorted(at, i)], rcond=None)[0]
            if abs(u[np.searchsorted(at, i)]) < EPS:
                return p
            u[np.abs(u) < 1e-12] = 0
            moves = u != 0
            up, down = (1 - p[at][moves]) / np.abs(u[moves]), p[at][moves] / np.abs(u[moves])
            ahead, back = np.where(u[moves] > 0, up, down).min(), np.where(u[moves] > 0, down, up).min()
            p[at] += (ahead if rng.random() * (ahead + back) < back else -back) * u
            p[at] = np.where(p[at] <= EPS, 0.0, np.where(p[at] >= 1 - EPS, 1.0, p[at]))
    return p


def _mended(p: np.ndarray, size: np.ndarray, wanted: float) -> np.ndarray:
    """While the landed words are off by over MEND, the landing takes LANDING more entries, the largest that can help.

    That happens where numbers of documents and words can't both be kept, as a document holds most of a source.
    """
    while abs(off := wanted - p @ size) > MEND * wanted:
        state = 0.0 if off > 0 else 1.0
        at = np.flatnonzero((p == state) & (size > 0) & (size < 2 * abs(off)))[:LANDING]
        if not len(at):
            break
        ways = (np.arange(2 ** len(at))[:, None] >> np.arange(len(at))) & 1
        best = np.argmin(np.abs(ways @ size[at].astype(float) - abs(off)))
        p[at[ways[best] == 1]] = 1 - state
    return p


def _land(p: list[float], size: list[int], open_: list[int]) -> list[float]:
    """p with the open entries at 0 or 1: of all ways, the one whose word and document totals come nearest."""
    if open_:
        ways = (np.arange(2 ** len(open_))[:, None] >> np.arange(len(open_))) & 1
        own, want = np.array([size[i] for i in open_], float), np.array([p[i] for i in open_])
        off = np.abs(ways @ own - want @ own) + 0.1 * own.mean() * np.abs(ways.sum(1) - want.sum())
        for i, v in zip(open_, ways[np.argmin(off)].tolist(), strict=True):
            p[i] = float(v)
    return p


def _decided(light: DataFrame, seed: int, weights: tuple[int, ...]) -> DataFrame:
    """r1, r2, n, size, source_size, target, times (how often the unit's n rows are taken in all)."""
    shares = stash(targets(light, weights), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # n * ratio is rounded, so that a unit that is taken a whole number of times isn't left a sliver of a time
    units = light.join(small(shares.select("source", "units", "source_size", "target")), "source").withColumn("times", F.round(F.col("n") * ratio, 9))
    units = units.withColumn("p", F.col("times") - F.floor("times")).withColumn("times", F.floor("times"))
    schema = ", ".join(f"{c} {t}" for c, t in units.dtypes)
    done, level = None, 0
    while True:
        chunks = F.ceil(F.col("units") / CHUNK_ROWS)
        chunk = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "r1", "r2"), chunks)
        flown = units.withColumns({"chunks": chunks, "chunk": chunk}).groupBy("source", "chunk").applyInArrow(_flight(units.columns, seed, level), schema)
        flown = stash(flown, f"flown{level}")
        open_ = flown.where(f"p > {EPS} AND p < 1 - {EPS}")
        decided = flown.where(f"NOT (p > {EPS} AND p < 1 - {EPS})")
        done = decided if done is None else done.unionByName(decided)
        left = open_.groupBy("source").agg(F.count(F.lit(1)).alias("units"))
        if not open_.limit(1).count():
            break
        units, level = open_.drop("units").join(small(left), "source").select(*units.columns), level + 1
    return done.select("r1", "r2", "n", "size", "source_size", "target", (F.col("times") + F.round("p")).cast("long").alias("times"))


def _units(docs: DataFrame, size, source: str, seed: int, weights: tuple[int, ...]) -> DataFrame:
    """``row`` (docs' columns), ``n`` identical rows of it (1, or all of them in one), and what is decided of them."""
    row = packed(docs)
    nulls = F.array(*(F.col("row").getField(c).isNull() for c in docs.columns))
    marks = [F.xxhash64("row", nulls).alias("r1"), F.xxhash64(F.lit(seed), nulls, "row").alias("r2")]
    light = docs.select(F.struct(*(quoted(c) for c in docs.columns)).alias("row"), size.alias("size"), F.coalesce(F.concat(F.lit("v"), quoted(source)), F.lit("n")).alias("source"))
    light = stash(light.select(*marks, "size", "source").groupBy("r1", "r2", "size", "source").agg(F.count(F.lit(1)).alias("n")), "units")
    met = row.select("row", *marks).join(_decided(light, seed, weights), ["r1", "r2"])
    once = met.where("n = 1").drop("r1", "r2")
    more = met.where("n > 1").groupBy("r1", "r2").agg(*(F.first(c).alias(c) for c in once.columns)).drop("r1", "r2")
    return once.unionByName(more)


def mix(docs: DataFrame, size, source: str = "source", seed: int = 1, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """docs, all columns, with ``size``, ``source_size``, ``target`` and ``copies`` (0 to MOST). size: a long column."""
    rows = numbered(_units(docs, size, source, seed, weights), "n", "at")
    copies = F.floor(F.col("times") / F.col("n")) + (F.col("at") < F.pmod("times", "n")).cast("int")
    return unpacked(rows.withColumn("copies", copies.cast("int")), docs.columns, "size", "source_size", "target", "copies")


def _flight(names: list[str], seed: int, level: int):
    def flight(t: pa.Table) -> pa.Table:
        size, p, tie = (t.column(c).to_numpy() for c in ("size", "p", "r1"))
        order = np.lexsort((t.column("r2").to_numpy(), tie, -size))
        t, size, p = t.take(pa.array(order)), size[order], p[order]
        key = zlib.crc32(t.column("source")[0].as_py().encode("utf-8", "surrogatepass"))
        rng = np.random.default_rng([seed, level, key, int(t.column("chunk")[0].as_py())])
        p = fly(p, size, rng, t.column("chunks")[0].as_py() == 1)
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).select(names)

    return flight


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as many times as it is taken, with the columns of docs."""
    return unpacked(numbered(_units(docs, n_words(), "source", 1, WEIGHTS).drop("n"), "times", "at"), docs.columns)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("words"))
    return mix(stash(units, "units"), F.col("words")).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
