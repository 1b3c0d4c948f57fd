"""Sources and sinks: line-delimited JSON, nested JSON files, qrels, and committed writes with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_jsonl(spark: SparkSession, path: str, schema: str, lenient: bool = False) -> DataFrame:
    """One JSON object a line; blank lines are skipped. Lenient: malformed lines (a truncated tail) are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if lenient else "FAILFAST").json(path)


def scan_filetree(spark: SparkSession, folder: str) -> DataFrame:
    """repo, path of a folder of one JSON document a repo."""
    trees = spark.read.schema("repo string, all_files array<string>, py_files array<string>").option("multiLine", "true").json(f"{folder}/*.json")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    return trees.select(F.coalesce("repo", name).alias("repo"), F.explode(F.coalesce("py_files", "all_files")).alias("path"))


def scan_depgraph(spark: SparkSession, folder: str) -> DataFrame:
    """repo, src, dst, kind of ``<repo>_rels.json`` files (or folders of files) with import and call maps; calls count by the file before ':'."""
    raw = spark.read.text(f"{folder}/*_rels.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/=]+)_rels\.json(?:/[^/]*)?$", 1).alias("repo"), F.from_json("value", "struct<file_imports: map<string, array<string>>, call_graph: map<string, array<string>>>").alias("j"))
    file = lambda c: F.split_part(c, F.lit(":"), F.lit(1))
    edges = lambda c, kind: raw.select("repo", F.explode(f"j.{c}").alias("s", "ds")).select("repo", file("s").alias("src"), F.explode("ds").alias("d")).select("repo", "src", file("d").alias("dst"), F.lit(kind).alias("kind"))
    return edges("file_imports", "import").unionByName(edges("call_graph", "call").where("src <> dst")).distinct()


def scan_repo_walk(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of every .py file below a folder, without dot-directories and caches."""
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py").text(folder, wholetext=True)
    return found.select(F.input_file_name().alias("path"), F.col("value").alias("content")).where(~F.col("path").rlike(r"/\.[^/]+/|/__pycache__/"))


def scan_qrels(spark: SparkSession, path: str) -> DataFrame:
    """query_id, corpus_id, score of a TSV with a header; only positive scores."""
    rows = spark.read.option("sep", "\t").option("header", "true").csv(path).toDF("query_id", "corpus_id", "score")
    return rows.select("query_id", "corpus_id", F.col("score").cast("int").alias("score")).where("score > 0")


def sink_atomic(rows: DataFrame, path: str, expected: int) -> None:
    """Write rows, in one committed job, only if there are as many as expected."""
    if (n := rows.count()) != expected:
        raise ValueError(f"{n} rows, {expected} expected: nothing is written")
    rows.write.mode("errorifexists").parquet(path)


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't done yet: what a resumed run still has to do."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")


def sink_beir(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, folder: str) -> None:
    """corpus, queries and qrels in BEIR layout; refuses a used folder and qrels that point at nothing."""
    for ids, key in ((corpus.select(F.col("_id").alias("corpus_id")), "corpus_id"), (queries.select(F.col("_id").alias("query_id")), "query_id")):
        if qrels.join(ids, key, "left_anti").limit(1).count():
            raise ValueError(f"qrels name a {key} that isn't there")
    corpus.write.mode("errorifexists").json(f"{folder}/corpus")
    queries.write.mode("errorifexists").json(f"{folder}/queries")
    qrels.write.mode("errorifexists").option("sep", "\t").option("header", "true").csv(f"{folder}/qrels")


def sink_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header in every part; refuses a used folder."""
    rows.write.mode("errorifexists").option("header", "true").csv(path)
