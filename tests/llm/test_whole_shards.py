"""op3_shards deals the documents themselves, not measures of them."""

from rankweave.llm import op03_shards


def test_query_deals_whole_documents(spark, tmp_path, monkeypatch):
    rows = [(i, None if i == 3 else "" if i == 4 else f"wörd {i} " * i, "en", "s", i) for i in range(60)] + [(7, "wörd 7 " * 7, "en", "s", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    dealt, plain = [], op03_shards.shard
    monkeypatch.setattr(op03_shards, "shard", lambda records, *a, **k: dealt.append((records.columns, plain(records, *a, **k))) or dealt[-1][1])
    got = op03_shards.op3_shards(spark, str(tmp_path)).collect()
    columns, out = dealt[0]
    assert columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(repr, (tuple(r)[:5] for r in out.collect()))) == sorted(map(repr, rows))
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((r.doc_id, r["size"]) for r in got) == sorted((r[0], size(r[1])) for r in rows)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s in range(40) for k in range(2 if s < 21 else 1)]
