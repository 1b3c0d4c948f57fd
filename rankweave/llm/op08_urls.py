"""URL filters: Bloom filter cascades over every key that the corpus can ask for.

A page asks for the keys ``host suffix + path prefix`` whose shapes (labels in the host, length of the path)
some rule has. The set of all asked keys is the universe. Level one of a cascade encodes the listed keys;
the universe's false positives are encoded by level two; the listed keys that level two wrongly holds by
level three, and so on until a level has no error. A key of the universe is listed exactly if the first
level that doesn't hold it is an even one (counting from one; past the last level, if that one is odd): no join, and no wrong answer for these pages.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; repeated
pages are judged alike; a key that is both allowed and blocked is blocked; no rules or no pages give no
filter levels; an input column named ``host``, ``path``, ``rule`` or ``verdict`` is replaced.

Keys are dealt to parts by a hash, as many as keep a level's bits within MAX_BITS, and each part has cascades of its
own. Pages stream by the parts one after another, and each part answers the keys that are its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import packed, stash, table, unpacked

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY, PROBES = 8, 4
#: 32 MB: about what one level of a part's cascade takes in every executor.
MAX_BITS = 1 << 28
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def parsed(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.substr("url", F.instr("url", "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def asked(rules: list[tuple[str, str, str]]):
    """An array column of the keys that a page asks for, longest first."""
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    keys = [F.concat(F.substring_index("host", ".", -k), F.left(F.col("path"), F.lit(n))) for k in labels for n in lengths]
    longest = F.expr("array_sort(array_distinct(_keys), (a, b) -> CASE WHEN length(a) <> length(b) THEN length(b) - length(a) WHEN a < b THEN -1 WHEN a > b THEN 1 ELSE 0 END)")
    return F.array(*keys), longest


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> list[np.ndarray]:
    odd = h2 | np.uint64(1)
    return [((h1 + np.uint64(level * PROBES + i) * odd) >> np.uint64(7)) % np.uint64(bits) for i in range(PROBES)]


def _holds(level: np.ndarray, no: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    out = np.ones(len(h1), bool)
    for at in _positions(h1, h2, no, len(level) * 8):
        out &= (level[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def _listed(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Parity of the first level that doesn't hold a key; past the last level a key is what that level encodes."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.ones(len(h1), bool)
    for no, level in enumerate(levels):
        held = _holds(level, no, h1, h2)
        out[open_ & ~held] = no % 2 == 1
        open_ &= held
    return out


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))


def _encode(keys: DataFrame, n: int, no: int) -> np.ndarray:
    """The bits of one level. Each task ORs its own keys' bits; the driver ORs one bitmap a task."""
    size = max(8, n * BITS_PER_KEY // 8 + 8)

    def bitmaps(batches):
        own = np.zeros(size, np.uint8)
        for b in batches:
            h1, h2 = (np.asarray(b.column(c)).view(np.uint64) for c in ("h1", "h2"))
            for at in _positions(h1, h2, no, size * 8):
                np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["bits"])

    out = np.zeros(size, np.uint8)
    for row in keys.select("h1", "h2").coalesce(8).mapInArrow(bitmaps, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def cascade(universe: DataFrame, listed: DataFrame) -> list[np.ndarray]:
    """The levels for these listed keys, exact on the universe (both: column ``key``)."""
    good, bad = _hashed(listed.distinct()), _hashed(universe.join(listed, "key", "left_anti"))
    levels: list[np.ndarray] = []
    while n := good.count():
        levels.append(level := _encode(good, n, no := len(levels)))

        def wrong(batches, level=level, no=no):
            for b in batches:
                yield b.filter(pa.array(_holds(level, no, *(np.asarray(b.column(c)).view(np.uint64) for c in ("h1", "h2")))))

        good, bad = stash(bad.mapInArrow(wrong, "key string, h1 long, h2 long"), f"level{no}"), good
    return levels


def _answers(part: int, parts: int, levels: dict[str, list[np.ndarray]]):
    """Adds, to the last two columns, which of a page's keys this part's cascades list to block and to allow."""

    def answered(batches):
        for b in batches:
            lengths = b.column("keys").value_lengths()
            h1, h2 = (b.column(c).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
            mine = np.flatnonzero(h1 % np.uint64(parts) == part)
            offsets = np.append(0, np.cumsum(lengths.to_numpy(zero_copy_only=False))).astype(np.int32)
            out = []
            for v in ("block", "allow"):
                held = b.column(v).flatten().to_numpy(zero_copy_only=False).astype(bool)
                held[mine] = _listed(levels[v], h1[mine], h2[mine])
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(held)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *out], names=b.schema.names)

    return answered


def judge(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages with host, path, rule (null if none fits) and verdict. rules: (allow or block, host, path)."""
    spark = pages.sparkSession
    columns = pages.columns
    keys, ordered = asked(rules)
    asking = parsed(packed(pages).select("row", F.col("row").getField("url").alias("url"))).withColumn("_keys", keys).select("row", "host", "path", ordered.alias("keys"))
    universe = stash(asking.select(F.explode("keys").alias("key")).distinct(), "universe")
    part_of = lambda p, n: F.expr(f"CAST(conv(hex(xxhash64(key)), 16, 10) AS DECIMAL(20, 0)) % {n} = {p}") if n > 1 else F.lit(True)
    lists = {v: spark.createDataFrame([(h + p,) for a, h, p in rules if a == v], "key string").distinct() for v in ("block", "allow")}
    # the second level holds false positives of the first: a small share of the universe
    parts = max(1, math.ceil(max(len(rules), universe.count() // 16) * BITS_PER_KEY / MAX_BITS))
    no = F.transform("keys", lambda k: F.lit(False))
    asking = asking.select("row", "host", "path", "keys", F.transform("keys", lambda k: F.xxhash64(k)).alias("h1"), F.transform("keys", lambda k: F.xxhash64(F.lit(7), k)).alias("h2"), no.alias("block"), no.alias("allow"))
    schema = asking.schema
    for part in range(parts):
        own = universe.where(part_of(part, parts))
        levels = {v: cascade(own, k.where(part_of(part, parts))) for v, k in lists.items()}
        asking = asking.mapInArrow(_answers(part, parts, levels), schema)
    hits = F.filter(F.arrays_zip("keys", "block", "allow"), lambda x: x["block"] | x["allow"])
    asking = asking.withColumn("hit", F.try_element_at(hits, F.lit(1)))
    verdict = F.when(F.col("hit.block"), F.lit("block")).otherwise(F.lit("allow"))
    return unpacked(asking, columns, "host", "path", F.col("hit.keys").alias("rule"), verdict.alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url under RULES; the longest fitting rule decides, and no rule allows."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
q AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(verdict, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)}),
b AS (SELECT q.host, q.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM (SELECT DISTINCT host, path FROM q) q JOIN r ON (q.host = rhost OR ends_with(q.host, '.' || rhost)) AND starts_with(q.path, rpath) GROUP BY 1, 2)
SELECT page_id, q.host, q.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM q LEFT JOIN b ON q.host = b.host AND q.path = b.path
"""
