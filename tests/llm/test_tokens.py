"""Encoding, resampling and alignment against the tokenizer libraries and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rankweave.llm import op11_bpe, op12_resample, op13_align

PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "é", "ß", "中", "文", "​", "😀", "'s", "'ll", "1", "23", "<|endoftext|>", "<|endof", "</s>", "<0x41>", "<unk>", "\0", "\x1c", "\x85", "　", "՘", "Ɽ", "\U000105c0", "aaaa", "====", "é", "\r\n", "!?", "�", "▁"]


def texts(n, seed, longest=40):
    rng = random.Random(seed)
    out = ["".join(rng.choices(PARTS, k=rng.randint(0, longest))) for _ in range(n)]
    return out + [rng.choice("abz= .中") * rng.randint(1, 200) for _ in range(n // 4)] + ["word " * 3000, "x" * 5000, " ", "", None, "a ", "  a  b "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def digest(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_gives_the_librarys_ids(library):
    own = op11_bpe.vocabulary()
    for text in texts(1500, 1):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == want
        assert own.decode(own.encode(text or "")).decode() == (text or "") == library.decode(want, skip_special_tokens=False)


def test_bpe_of_vocabulary_and_long_stretches(library, monkeypatch):
    own = op11_bpe.vocabulary()
    for i in range(0, 50256, 7):
        text = own.bytes[i].decode("utf-8", "replace")
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(op11_bpe, "STRETCH", 5)
    for text in texts(300, 2):
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_pair_tests_on_made_up_merges(tmp_path):
    """Random small vocabularies, merged naively: lowest rank first, leftmost first."""
    import json

    rng = random.Random(4)
    level = {b: c for c, b in op11_bpe.byte_level().items()}
    for _ in range(20):
        vocab, merges = {level[b]: b for b in range(256)}, []
        names = list("abc")
        while len(merges) < 25:
            a, b = rng.choice(names), rng.choice(names)
            if a + b not in vocab and len(a + b) < 9:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
                names.append(a + b)
        path = tmp_path / f"{rng.random()}.json"
        path.write_text(json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}}))
        own, library = op11_bpe.Vocabulary(str(path), public_tokenizers.PATTERN), Tokenizer.from_file(str(path))
        for _ in range(200):
            text = "".join(rng.choices("abc", k=rng.randint(1, 25)))
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text).ids, (merges, text)


def test_bpe_rows(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(texts(60, 3))] + [(None, "the", "x"), (1, "again", "x"), (1, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    found = op11_bpe.encoded(docs)
    assert found.columns == ["doc_id", "n_tokens", "ids"]
    want = Counter((d, len(e), digest(e)) for d, t, _ in rows for e in [library.encode(t or "", add_special_tokens=False).ids])
    assert Counter((r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest()) for r in found.collect()) == want
    back = op11_bpe.decoded(op11_bpe.encoded(docs.drop("ids"))).collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((d, t or "") for d, t, _ in rows)
    assert op11_bpe.decoded(op11_bpe.encoded(docs.limit(0))).count() == 0
    plain = op11_bpe.encoded(docs.where("text LIKE '%<|endoftext|>%'"), special=False)
    assert all(50256 not in np.frombuffer(r["ids"], "<u4") for r in plain.collect())


# ---- resampling ------------------------------------------------------------------------------------------


def ngrams(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def resampled(docs, items, percent=5, least=20):
    """doc_id, n_features, weight, score and whether drawn, by the contract."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    source, target = (Counter(bucket(f) for t in side for f in ngrams(t)[1]) for side in ([t for _, t in docs], items))
    s_all, t_all = source.total(), target.total()
    gain = lambda b: math.floor(1000 * math.log((target[b] + 1) * (s_all + 10000) / ((source[b] + 1) * (t_all + 10000))))
    out = []
    for d, t in docs:
        words, found = ngrams(t)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        out.append((d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    order = sorted((i for i, r in enumerate(out) if r[4]), key=lambda i: (-out[i][3], out[i][0] is None, out[i][0]))
    rank = {i: n for n, i in enumerate(order[: len(order) * percent // 100], 1)}
    return [(*r[:4], rank.get(i)) for i, r in enumerate(out)]


def corpus(n=300):
    rng = random.Random(5)
    vocab = ["".join(rng.choices("abcdéÀ中", k=rng.randint(1, 6))) for _ in range(80)] + ["w" * 70, "ABC", "x" * 300]
    docs = [(i, rng.choice([" ", ", ", "\n-"]).join(rng.choices(vocab, k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "Word " * 5000), (None, "a b c " * 9), docs[7], docs[7], (n + 4, "z" * 70000 + " b c")]
    return docs, [" ".join(rng.choices(vocab[:20], k=30)) for _ in range(6)] + [None]


@pytest.mark.parametrize("rows", [13, 250_000])
def test_resampling(spark, rows, monkeypatch):
    monkeypatch.setattr(op12_resample, "MERGE_ROWS", rows)
    docs, items = corpus()
    given = spark.createDataFrame([(*d, "x", 1.0) for d in docs], "doc_id long, text string, row string, weight double").repartition(7)
    target = spark.createDataFrame([(t,) for t in items], "text string")
    for percent in (5, 60):
        found = op12_resample.resampled(given, target, percent)
        assert found.columns == ["doc_id", "row", "n_features", "weight", "score", "rank"]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()), key=key) == sorted(resampled(docs, items, percent), key=key)


def test_resampling_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op12_resample.resampled(docs, docs).count() == 0
    few = spark.createDataFrame([(1, "a b"), (2, None)], docs.schema)
    assert {(r["doc_id"], r["n_features"], r["rank"]) for r in op12_resample.resampled(few, docs).collect()} == {(1, 3, None), (2, 0, None)}


def test_tournament():
    rng = random.Random(6)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randint(0, 20), i, j) for j in range(rng.randint(0, 9))) for i in range(k)]
        assert list(op12_resample.Tournament([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


# ---- alignment -------------------------------------------------------------------------------------------


def alignment(docs):
    """doc_id and the seven columns, by walking over all pairs of tokens of a document."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    level = op11_bpe.byte_level()
    rows, counts = [], Counter()
    for d, text in docs:
        groups, links = [], []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            parts = [bytes(level[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids[1])]
            if b"".join(parts[0]) == b"".join(parts[1]) == (" " + text).encode():
                spans = []
                for side in parts:
                    at, own = 0, []
                    for p in side:
                        own.append((at, at + len(p)))
                        at += len(p)
                    spans.append(own)
                j = 0
                for i, (s, e) in enumerate(spans[0]):
                    while spans[1][j][1] <= s:
                        j += 1
                    k = j
                    while k < len(spans[1]) and spans[1][k][0] < e:
                        links.append((ids[0][i], ids[1][k]))
                        k += 1
                cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
                at = [0, 0]
                for cut in cuts:
                    said = []
                    for side in (0, 1):
                        first = at[side]
                        while at[side] < len(spans[side]) and spans[side][at[side]][1] <= cut:
                            at[side] += 1
                        said.append(",".join(map(str, ids[side][first : at[side]])))
                    groups.append("|".join(said))
                rows.append((d, len(ids[0]), len(ids[1]), groups, links))
        if not groups:
            rows.append((d, 0, 0, [], []))
        counts.update(links)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return [(d, n, m, len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, n, m, g, k in rows]


@pytest.mark.parametrize("block", [50, 1_000_000])
def test_alignment(spark, block, monkeypatch, tmp_path):
    monkeypatch.setattr(op13_align, "BLOCK_PAIRS", block)
    docs = [(i, t) for i, t in enumerate(texts(100, 7))] + [(None, "the end"), (3, "Twice."), (3, "Twice.")]
    plain = [(200 + i, " ".join(random.Random(i).choices(["Über", "naïve", "tokenization", "l'été", "don't", "42", "x" * 30, "日本"], k=30))) for i in range(40)]
    spark.createDataFrame(docs + plain, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    found = op13_align.op13_align(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter(map(tuple, found.collect())) == Counter(alignment(docs + plain))


def test_alignment_interface(spark):
    docs = spark.createDataFrame([(1, "tokenization", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, groups string").withColumn("uid", F.lit(5))
    rows = {r["doc_id"]: r for r in op13_align.aligned(docs).collect()}
    a, b = op13_align.sides()
    left, right = (x.split(",") for x in rows[1]["groups"].rsplit(";", 1)[-1].split("|"))
    assert b"".join(a.bytes[int(i)] for i in left).endswith(b"ization") or b"".join(b.bytes[int(i)] for i in right)
    assert rows[1]["uid"] == 5 and rows[2]["groups"] == rows[3]["groups"] == "" and rows[2]["n_links"] == 0
    assert op13_align.aligned(docs.limit(0)).count() == 0
