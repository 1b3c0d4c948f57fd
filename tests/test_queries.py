"""Every registered query of the engine with an oracle, against DuckDB on the smallest tables (a sample of them by default)."""

import glob
import os

import pytest

from rankweave.plans.registry import ORACLE_SQL, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("RANKWEAVE_TEST_DIR", "/root/testdata/sf0.001")
SOME = ["tok_path_improved", "ext_module_paths", "chunk_words", "bm25_lucene", "tfidf_cosine", "cochange_symmetric", "expand_graph", "rrf_missing_penalty", "two_stage", "ndcg_at_k", "wilcoxon_repo", "asof_commit", "lexical_evaluation"]
NAMES = sorted(ORACLE_SQL) if os.environ.get("RANKWEAVE_ALL_QUERIES") else SOME


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame):
    clean = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in r)) for r in clean.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(con.sql(ORACLE_SQL[name]).df())
