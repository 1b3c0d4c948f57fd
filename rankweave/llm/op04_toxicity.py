"""Toxicity: a two-state linear-chain conditional random field over words, scored by forward-backward marginals.

Labelled tokens come from labelled documents: words and affixes that stand in toxic documents too often for
chance, and in few clean ones, mark their tokens; near copies vote as one. The field learns emissions,
transitions and start from those marks by the gradient of its likelihood, with hashed features of each token
(whole word, prefixes, suffixes, shape), so it also tags words that it never saw but that are built alike.
Per-token marginals give the offending spans; their largest, their sum and their share give the document's
score by a logistic layer with slopes of 0 or more, learned from the document labels.

Defined cases: null and empty texts have no tokens and get the score of a document without evidence, which is
below 0.5 for any model; without toxic training documents every score is 0; repeated rows are scored alike
(and learned from once); very long texts are tagged whole, and learned from in TRAIN_PIECES drawn runs; an
input column named ``score`` or ``spans`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op09_neardup, textkit
from .chain import marginals, odds, pair_counts
from .labelled import drawn, held_out, sample
from .shared import quoted, table, with_fields

#: The training sample: so many documents of each label at most; of a longer one so many runs of so many words (and bytes at most).
TRAIN_EACH, TRAIN_PIECES, PIECE, PIECE_BYTES = 1200, 4, 512, 1 << 15
#: A word or affix is toxic if so many toxic documents have it, and at most this share as many of the clean ones, by rates.
SUPPORT, CLEAN_SHARE = 4, 0.1
BUCKETS = 1 << 18
TOXIC_FROM, SPAN_FROM = 0.5, 0.5
#: The least marginal, and share of toxic tokens, that counts as evidence.
FLOOR = 1e-3
#: The most that the log odds of a document without evidence can be.
BLANK = -0.5
RUN = 1 << 17
#: Runs of a minwise signature, one of which two near copies share; the weight that holds transitions near 1.
BANDS, TIGHT = 16, 10.0

_HASH = textkit.Hasher(404, lower=True)
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 4, 5)
#: Kinds of features that rounds of training use in turn: all, then affixes and shape, so that affixes learn to do
#: without the words, and prefixes and suffixes without each other.
_P, _S, _SHAPE = list(range(1, 1 + len(PREFIXES))), list(range(1 + len(PREFIXES), 1 + len(PREFIXES) + len(SUFFIXES))), [1 + len(PREFIXES) + len(SUFFIXES)]
VIEWS = ([0, *_P, *_S, *_SHAPE], [*_P, *_SHAPE], [*_P, *_S, *_SHAPE], [*_P, *_SHAPE], [0, *_S, *_SHAPE])
#: The feature of what isn't there; its weight stays 0.
NONE = textkit.U64(0)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashed features of each token, one row a kind: word, prefixes, suffixes, shape. An affix not shorter than its word is NONE."""
    kinds = [(starts, ends)]
    kinds += [(starts, np.minimum(starts + k, ends)) for k in PREFIXES]
    kinds += [(np.maximum(ends - k, starts), ends) for k in SUFFIXES]
    sums = np.zeros(len(data) + 1, textkit.U64)
    np.cumsum(_HASH.values[data] * _HASH.powers(pow(_HASH.base, -1, 2**64), len(data)), out=sums[1:])
    powers = _HASH.powers(_HASH.base, len(data) + 1)
    rows = [textkit.mix((sums[e] - sums[s]) * powers[s] + textkit.U64(no)) for no, (s, e) in enumerate(kinds)]
    for no, k in enumerate((*PREFIXES, *SUFFIXES), 1):
        rows[no][ends - starts <= k] = NONE
    length = np.minimum(ends - starts, 15)
    upper = (data[starts] >= 0x41) & (data[starts] <= 0x5A)
    rows.append(textkit.mix((length * 2 + upper).astype(np.uint64) + textkit.U64(1 << 40)))
    return np.array(rows)


def tagged(model: dict, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Marginals of some rows' tokens; begin: each row's first token, and the end."""
    first = np.zeros(len(starts) + 1, bool)
    first[begin[:-1]] = True
    emission = model["w"][(features(data, starts, ends) & textkit.U64(BUCKETS - 1)).astype(np.int64)].sum(0)
    return marginals(np.exp(np.clip(emission + model["bias"], -30, 30)), first[:-1], model["a"], model["start"])


def evidence(p: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each row: the log odds of its largest marginal, the log of the expected number of toxic tokens, and of their share.

    All three are above a floor, which a row without tokens has: there they are 0.
    """
    clipped = np.clip(p, 1e-9, 1 - 1e-9)
    padded, counted = np.append(clipped, 0.0), np.append(np.where(clipped > 0.05, clipped, 0.0), 0.0)
    n = np.diff(begin)
    at, none = np.minimum(begin[:-1], len(p)), n == 0
    top = np.where(none, 0.0, np.maximum.reduceat(padded, at))
    total = np.where(none, 0.0, np.add.reduceat(counted, at))
    top = np.clip(top, FLOOR, 1 - FLOOR)
    least = np.log(FLOOR / (1 - FLOOR))
    return np.array([np.log(top / (1 - top)) - least, np.log1p(total), np.log1p(total / np.maximum(n, 1) / FLOOR)]).T


def _groups(texts: pa.Array) -> np.ndarray:
    """For each training document the first one of its group of near copies, which vote together.

    Near copies share one of BANDS runs of their minwise signatures; documents of under three words are alike as a whole.
    """
    own = np.arange(len(texts))

    def root(i: int) -> int:
        while own[i] != i:
            i = own[i]
        return i

    seen: dict[tuple[int, bytes], int] = {}
    for lo, _, data, offsets in textkit.slices(texts):
        grams, begin = op09_neardup.sets(data, offsets)
        full = np.flatnonzero(np.diff(begin) > 0)
        for i, signature in zip((full + lo).tolist(), op09_neardup.sign(grams, begin), strict=True):
            for k, band in enumerate(signature.reshape(BANDS, -1)):
                x, y = sorted((root(i), root(seen.setdefault((k, band.tobytes()), i))))
                own[y] = x
    return np.array([root(i) for i in range(len(texts))])


def _once(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class _Sample:
    """The words of the training documents by form (a word in one spelling of its initial), and which tokens are toxic.

    A word or affix marks its tokens in toxic documents if it is in too many toxic groups of documents for chance (a
    Chernoff bound on its split between toxic and clean ones, against the number of candidates) and in few clean ones.
    """

    def __init__(self, texts: list, y: np.ndarray):
        column = pa.array(texts, pa.large_binary())
        keys, forms, kinds, lengths, counts, base = [np.zeros(0, textkit.U64)], [], [], [], [np.zeros(0, np.int64)], 0
        for _, _, data, offsets in textkit.slices(column):
            starts, ends, begin = textkit.spans(data, offsets, textkit.ALNUM)
            upper = (data[starts] >= 0x41) & (data[starts] <= 0x5A)
            key, one, form = np.unique(_HASH.words(data, starts, ends) ^ upper, return_index=True, return_inverse=True)
            keys.append(key)
            forms.append(form + base)
            kinds.append(features(data, starts[one], ends[one]))
            lengths.append((ends - starts)[one])
            counts.append(np.diff(begin))
            base += len(key)
        _, one, form = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        self.form = form.astype(np.int32)[np.concatenate(forms)]
        self.features = np.concatenate(kinds, axis=1)[:, one]
        length, counts = np.concatenate(lengths)[one], np.concatenate(counts)
        self.begin = np.append(0, np.cumsum(counts))
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        self.first = np.zeros(len(doc) + 1, bool)
        self.first[self.begin[:-1]] = True
        self.first = self.first[:-1]
        # each form once a group of near copies and label
        label = (y == 1).astype(np.int64)
        _, group = np.unique(_groups(column) * 2 + label, return_inverse=True)
        toxic = np.zeros(group.max() + 1, np.int64)
        toxic[group] = label
        pairs = _once(self.form.astype(np.int64) * len(toxic) + group[doc])
        form, of = pairs // len(toxic), pairs % len(toxic)
        n = np.array([(toxic == 0).sum(), toxic.sum()])
        found, tried = [], 0
        for no, k in enumerate((0, *PREFIXES, *SUFFIXES)):
            usable = length > max(k, 2)
            at = np.flatnonzero(usable[form])
            value, inverse = np.unique(self.features[no], return_inverse=True)
            both = _once(inverse[form[at]].astype(np.int64) * len(toxic) + of[at])
            votes = np.bincount(both // len(toxic) * 2 + toxic[both % len(toxic)], minlength=2 * len(value)).reshape(-1, 2)
            tried += int((votes.sum(1) >= SUPPORT).sum())
            found.append((usable, inverse, votes))
        mark = np.zeros(len(one), bool)
        rate = (n[1] + 0.5) / (n.sum() + 1)
        for usable, inverse, votes in found:
            c, t = votes.T
            share = np.clip(t / np.maximum(t + c, 1), 1e-12, 1)
            bound = (t + c) * (share * np.log(share / rate) + (1 - share) * np.log(np.maximum(1 - share, 1e-12) / (1 - rate)))
            odds = c / max(n[0], 1) / np.maximum(t / max(n[1], 1), 1e-12)
            mark |= usable & ((t >= SUPPORT) & (odds <= CLEAN_SHARE) & (bound > np.log(max(tried, 1))) & (share > rate))[inverse]
        self.mark = mark[self.form] & (label[doc] == 1)

    def runs(self) -> list[tuple[int, int]]:
        """Ranges of tokens of whole documents, of about RUN tokens each; what training holds at once."""
        cut = np.unique(np.append(self.begin[:-1][np.append(True, np.diff(self.begin[:-1] // RUN) > 0)], len(self.form)))
        return list(zip(cut.tolist(), cut[1:].tolist(), strict=False))


def fit(texts: list, y: np.ndarray, rounds: int = 30, rate: float = 0.5, decay: float = 1e-6) -> dict | None:
    """Train the field by gradient steps on the likelihood of the marked tokens, then the logistic layer.

    Emissions, transitions and the start are all learned. Tokens of one form share their features, so the gradient is
    summed by form first.
    """
    if not (y == 1).any():
        return None
    own = _Sample(texts, y)
    at = (own.features & textkit.U64(BUCKETS - 1)).astype(np.int32)
    first, m, runs = own.first, own.mark.astype(np.float32), own.runs()
    seen = np.bincount((own.mark[:-1] * 2 + own.mark[1:])[~first[1:]], minlength=4).reshape(2, 2)
    base = (m.sum() + 1) / (len(m) + 2)
    bias, w, grow = np.log(base / (1 - base)) / 2, np.zeros(BUCKETS), np.full(BUCKETS, 1e-3)
    log_a, grow_a, start, grow_s = np.zeros((2, 2)), np.ones((2, 2)), 0.0, 1.0
    for turn in range(rounds if len(m) else 0):
        use = at[VIEWS[turn % len(VIEWS)]]
        a, s, forms = np.exp(log_a), float(np.exp(start)), np.exp(np.clip(w[use].sum(0) + bias, -30, 30))
        step, ga, gs = np.zeros(at.shape[1]), seen - TIGHT * log_a, -TIGHT * start
        for lo, hi in runs:
            x, begins = forms[own.form[lo:hi]], first[lo:hi]
            known = odds(x, begins, a, s)
            both = known[0] * known[1]
            error = m[lo:hi] - both / (1 + both)
            step += np.bincount(own.form[lo:hi], error, at.shape[1])
            ga = ga - pair_counts(x, begins, a, s, known)
            gs += error[begins].sum()
        g = -decay * len(m) * w
        for row in use:
            g += np.bincount(row, step, BUCKETS)
        g[int(NONE)] = 0
        grow, grow_a, grow_s = grow + g * g, grow_a + ga * ga, grow_s + gs * gs
        w, log_a, start = w + rate * g / np.sqrt(grow), log_a + rate * ga / np.sqrt(grow_a), start + rate * gs / np.sqrt(grow_s)
    model = {"w": w.astype(np.float32), "bias": bias, "a": np.exp(log_a), "start": float(np.exp(start))}
    forms, p = np.exp(np.clip(model["w"][at].sum(0) + bias, -30, 30)), np.zeros(len(m))
    for lo, hi in runs:
        p[lo:hi] = marginals(forms[own.form[lo:hi]], first[lo:hi], model["a"], model["start"])
    return model | {"layer": _logistic(evidence(p, own.begin), y)}


def _logistic(e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps.

    Slopes are 0 or more, so more toxicity never lowers a score; the intercept is at most BLANK, so no evidence is clean.
    """
    x = np.hstack([e, np.ones((len(e), 1))])
    free = [True] * (x.shape[1] - 1)
    while True:
        use = np.append(np.flatnonzero(free), x.shape[1] - 1)
        z, ridge, b = x[:, use], np.append(np.full(sum(free), 0.1), 0.01), np.zeros(len(use))
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge)
            b += np.clip(np.linalg.solve(h, z.T @ (y - p) - ridge * b), -2, 2)
        low = int(np.argmin(b[:-1])) if len(b) > 1 else 0
        if len(b) == 1 or b[low] >= 0:
            out = np.zeros(x.shape[1])
            out[use] = b
            out[-1] = min(out[-1], BLANK)
            return out
        free[use[low]] = False


def pieces(column, orders: list[int]) -> list[bytes]:
    """Each text, or TRAIN_PIECES drawn runs of PIECE words of a longer one."""
    out = []
    for lo, hi, data, offsets in textkit.slices(column):
        starts, ends, begin = textkit.spans(data, offsets, textkit.ALNUM)
        for r in range(hi - lo):
            n = int(begin[r + 1] - begin[r])
            runs = drawn(-(-n // PIECE), TRAIN_PIECES, orders[lo + r])
            cut = [data[starts[begin[r] + k * PIECE] : ends[begin[r] + min((k + 1) * PIECE, n) - 1]][:PIECE_BYTES].tobytes() for k in runs.tolist()]
            out.append(b" ".join(cut))
    return out


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """A model from a bounded sample of the labels that aren't held out."""
    rows = sample(docs, labels, "toxic", ~held_out(5, 0), TRAIN_EACH, pieces)
    return fit([bytes(r["x"]) for r in rows], np.array([r["label"] for r in rows], np.int64))


def _scored(model: dict | None, column) -> tuple[np.ndarray, list[list[dict]]]:
    """Scores and offending spans (start and end in code points, marginal) of an Arrow text column."""
    out, found = np.zeros(len(column)), [[] for _ in range(len(column))]
    if model is None:
        return out, found
    for lo, hi, data, offsets in textkit.slices(column):
        starts, ends, begin = textkit.spans(data, offsets, textkit.ALNUM)
        p = tagged(model, data, starts, ends, begin)
        e = np.hstack([evidence(p, begin), np.ones((hi - lo, 1))])
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(e @ model["layer"], -30, 30)))
        hot = np.flatnonzero(p >= SPAN_FROM)
        if len(hot):
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            row = np.searchsorted(begin, hot, "right") - 1
            for t, r in zip(hot.tolist(), row.tolist(), strict=True):
                zero = points[offsets[r]]
                found[lo + r].append({"start": int(points[starts[t]] - zero), "end": int(points[ends[t]] - zero), "p": float(p[t])})
    return out, found


SPANS = "array<struct<start: long, end: long, p: double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with ``score`` and ``spans`` in place of ``text`` (and of columns of these names)."""
    kept = [c for c in docs.columns if c.lower() not in ("text", "score", "spans")]

    def scored(batches):
        for b in batches:
            s, spans = _scored(model, b.column(len(kept)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array(spans, _SPANS)], names=[*kept, "score", "spans"])

    rows = docs.select(*(quoted(c) for c in kept), "text")
    return rows.mapInArrow(scored, with_fields(rows.drop("text"), f"score double, spans {SPANS}"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "spans")
