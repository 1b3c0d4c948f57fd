"""BPE encoding and decoding by per-prefix dynamic programming.

Merging in rank order gives every prefix of a pretoken exactly one last token. An automaton of the vocabulary (its
state after a byte is the longest suffix that begins a token, its suffix links lead to all tokens that end there)
names the candidates; a candidate is the last token if it starts the pretoken or if it is compatible with the last
token of the prefix before it: no merge would have crossed the border between the two before the merges that use up
its sides. So each prefix's last token is stored once, and back-pointers (a token's length) give the ids. Work is linear
in the text but for the number of tokens that end at one byte, whatever the merges.

Texts are cut into pretokens by the tokenizer's pattern, a run of text at a time, and frequent pretokens are kept.
Decoding joins the ids' bytes. Both map batches where they lie; nothing is shuffled.

Defined cases: null counts as empty, which has no ids; strings of special tokens in a text become their ids with
``special=True`` and are plain text without; very long texts and pretokens are encoded whole; repeated rows are encoded
alike; bytes that aren't UTF-8 decode as U+FFFD; input columns named like those that are added are replaced.
"""

from __future__ import annotations

import functools
import json
import math
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .shared import quoted, table, with_fields

#: Code points of a text that are cut into pretokens at once; only a longer stretch without white space takes more.
STRETCH = 1 << 18
#: Pretokens of at most so many code points are kept, so many of them; and so many judged token pairs.
KEPT_LENGTH, KEPT_WORDS, KEPT_PAIRS = 48, 250_000, 1_000_000


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, 256 and up the rest."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def unassigned() -> np.ndarray:
    """For each code point whether the interpreter's tables don't know it; classes of such differ between libraries."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


class Vocabulary:
    """Tokens, merges and automaton of a byte-level BPE tokenizer file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, level = file["model"], byte_level()
        names = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"] if t["content"] not in names}
        self.bytes = [b""] * (1 + max([*names.values(), *self.special.values()]))
        for name, i in names.items():
            self.bytes[i] = bytes(level[c] for c in name)
        for name, i in self.special.items():
            self.bytes[i] = name.encode()
        self.packed = [i.to_bytes(4, "little") for i in range(len(self.bytes))]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.after: dict[int, dict[int, int]] = {}  # token: {token after it: rank of their merge}
        for r, (a, b) in enumerate(pairs):
            self.after.setdefault(names[a], {})[names[b]] = r
        self.edges: tuple[dict, dict] = ({}, {})
        self.made = {names[a + b]: (names[a], names[b], r) for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.automaton = ahocorasick.Automaton()
        reached = {i for i in names.values() if len(self.bytes[i]) == 1}
        for i, (a, b, r) in sorted(self.made.items(), key=lambda m: m[1][2]):
            # a token that merging its bytes never gives isn't a candidate: another merge crosses its parts' border first
            if a in reached and b in reached and not self._crossed(a, b, r):
                reached.add(i)
        for i in reached:
            self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self.cutter = Tokenizer.from_file(path).pre_tokenizer
        self.specials = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.judged: dict[tuple[int, int], bool] = {}
        self.words = _Words(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b, side by side, stay two tokens: no merge crosses their border while its two parts are there."""
        if len(self.judged) >= KEPT_PAIRS:
            self.judged.clear()
        fits = self.judged[a, b] = not self._crossed(a, b)
        return fits

    def _crossed(self, a: int, b: int, below: float = math.inf) -> bool:
        """Whether a merge of a rank below this crosses the border of a and b."""
        starts = self.edges[0].get(b) or self._edge(b, 0)
        for x, until_x in self.edges[1].get(a) or self._edge(a, 1):
            follow = self.after.get(x)
            if follow:
                for y, until_y in starts:
                    rank = follow.get(y)
                    if rank is not None and rank < below and rank < until_x and rank <= until_y:
                        return True
        return False

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts that lie at one end of a token while it is built, each with the rank of the merge that uses it up."""
        found, part, until = [], token, math.inf
        while True:
            found.append((part, until))
            if part not in self.made:
                self.edges[side][token] = found
                return found
            *parts, until = self.made[part]
            part = parts[side]

    def pretoken(self, word: str) -> bytes:
        """The ids of one pretoken, little-endian 32 bits each."""
        data = word.encode().decode("latin-1")
        judged, last, length = self.judged, [0] * (len(data) + 1), [0] * (len(data) + 1)
        for end, (token, n) in self.automaton.iter(data):
            end += 1
            if not length[end]:
                if n != end:
                    before = last[end - n]
                    fits = judged.get((before, token))
                    if not (self.compatible(before, token) if fits is None else fits):
                        continue
                last[end], length[end] = token, n
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= length[at]
        return b"".join([self.packed[i] for i in reversed(ids)])

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """The pretokens of a text in order, in lists; a list ends before white space that follows something else."""
        if not text.isascii() and unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            yield [text[a:b] for _, (a, b) in self.cutter.pre_tokenize_str(text)]
            return
        at = 0
        while at < len(text):
            cut = _BORDER.search(text, at + STRETCH) if len(text) - at > STRETCH else None
            to = cut.end() if cut else len(text)
            yield self.pattern.findall(text, at, to) if at or cut else self.pattern.findall(text)
            at = to

    def encode(self, text: str, special: bool = True) -> bytes:
        """The ids of a text, little-endian 32 bits each."""
        out, at = [], 0
        for m in self.specials.finditer(text) if special and self.specials else ():
            out += [b"".join(map(self.words.__getitem__, w)) for w in self.pretokens(text[at : m.start()])]
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        out += [b"".join(map(self.words.__getitem__, w)) for w in self.pretokens(text[at:] if at else text)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Between these two characters a pretoken always ends, whatever stands around them.
_BORDER = regex.compile(r"\S(?=\s)")


class _Words(dict):
    """Ids of pretokens met lately: when it is full, those looked up since it was full last stay within reach."""

    def __init__(self, own: Vocabulary):
        super().__init__()
        self.own, self.earlier = own, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.earlier.get(word) or self.own.pretoken(word)
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.earlier = dict(self)
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(2)
def vocabulary(path: str | None = None) -> Vocabulary:
    """The tokenizer at a path that all machines have, loaded once a worker; unless given, the installed one of 50,257 ids."""
    import public_tokenizers

    return Vocabulary(path or public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _mapped(df: DataFrame, source: str, added: str, convert) -> DataFrame:
    """df without ``source`` and with the columns ``added``, made by ``convert`` from runs of source's values of some MB."""
    new = [f.split(" ")[0] for f in added.split(", ")]
    kept = [c for c in df.columns if c.lower() not in (source, *new)]
    rows = df.select(*(quoted(c) for c in kept), F.col(source))

    def converted(batches):
        for b in batches:
            for lo, hi, _, _ in textkit.slices(b.column(len(kept))):
                made = convert(b.column(len(kept)).slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in b.columns[:-1]), *made], names=[*kept, *new])

    return rows.mapInArrow(converted, with_fields(rows.drop(source), added))


def encoded(docs: DataFrame, path: str | None = None, special: bool = True) -> DataFrame:
    """docs with ``n_tokens`` and ``ids`` (little-endian 32 bits each) in place of ``text``; ``decoded`` gives the text back."""

    def convert(texts):
        own = vocabulary(path)
        ids = [own.encode(t or "", special) for t in texts]
        return pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())

    return _mapped(docs, "text", "n_tokens long, ids binary", convert)


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows with ``text`` in place of ``ids``."""

    def convert(ids):
        own = vocabulary(path)
        return (pa.array([own.decode(x or b"").decode("utf-8", "replace") for x in ids], pa.string()),)

    return _mapped(rows, "ids", "text string", convert)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("ids_sha256", F.sha2("ids", 256))
    return decoded(rows).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
