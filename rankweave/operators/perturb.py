"""Structure-preserving path perturbations: hashing as expressions, permutations as two ranked orders joined on their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions import text as t


def sha(c: Column, n: int) -> Column:
    return F.left(F.sha2(c, 256), F.lit(n))


def hash_path(c: str | Column, n: int = 16, salt: Column | None = None) -> Column:
    """Directories become d_<hash>, the .py leaf m_<hash>.py; empty components drop out. The rule goes by place."""
    parts = F.filter(F.split(t._col(c), "/"), lambda x: x != "")
    salted = (lambda x: F.concat(salt, F.lit("/"), x)) if salt is not None else (lambda x: x)
    last = F.size(parts) - 1
    leaf = lambda x: F.concat(F.lit("m_"), sha(salted(x), n), F.lit(".py"))
    return F.array_join(F.transform(parts, lambda x, i: F.when((i == last) & x.endswith(".py"), leaf(x)).otherwise(F.concat(F.lit("d_"), sha(salted(x), n)))), "/")


def shuffled(names: DataFrame, group: list[str], name: str, seed: str = "42") -> DataFrame:
    """group, name, new: names permuted inside each group; the same names in hash order take the places in name order."""
    own = names.select(*group, name).distinct()
    w = Window.partitionBy(*group)
    by_name = own.withColumn("_i", F.row_number().over(w.orderBy(name)))
    by_hash = own.withColumn("_i", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *group, name)), name))).withColumnRenamed(name, "new")
    return by_name.join(by_hash, [*group, "_i"]).drop("_i")


def flatten_dirs(files: DataFrame) -> DataFrame:
    """repo, path, new: base names; of equal ones the second and further get _1, _2, ..."""
    n = F.row_number().over(Window.partitionBy("repo", "_base").orderBy("path")) - 1
    out = files.withColumn("_base", t.basename("path")).withColumn("_n", n)
    return out.select("repo", "path", F.when(F.col("_n") == 0, F.col("_base")).otherwise(F.concat(F.regexp_replace("_base", r"\.py$", ""), F.lit("_"), F.col("_n").cast("string"), F.lit(".py"))).alias("new"))


def masked(c: str | Column, hit) -> Column:
    """The path with those underscore parts hashed for which ``hit`` holds."""
    one = lambda x: F.array_join(F.transform(F.split(x, "_"), lambda y: F.when(hit(y), sha(y, 8)).otherwise(y)), "_")
    bare = t.strip_py(c)
    return F.concat(F.array_join(F.transform(F.split(bare, "/"), one), "/"), F.lit(".py"))
