"""Queries of perturbation, negative mining, set construction, splits and audits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rankweave.functions import text as t
from rankweave.operators import curate as c
from rankweave.operators import perturb as p
from rankweave.sources.fixtures import changes, draw, files, imports, issue_texts, issues, lists, ranked

from .base import joined, query

KEY = ["repo", "issue_id"]
_DIR, _BASE = "regexp_extract({0}, '^(.*)/[^/]*$', 1)", "string_split({0}, '/')[-1]"


def _hash(n: int, salt: str = "") -> str:
    return f"array_to_string(list_transform(string_split(path, '/'), lambda x, i: CASE WHEN i = len(string_split(path, '/')) THEN 'm_' || left(sha256({salt}x), {n}) || '.py' ELSE 'd_' || left(sha256({salt}x), {n}) END), '/')"


@query("pathswap_sha16", f"SELECT repo, path, {_hash(16)} AS alias FROM files")
def _sha16(s, d):
    return files(s, d).select("repo", "path", p.hash_path("path", 16).alias("alias"))


@query("pathswap_sha8", f"SELECT repo, path, {_hash(8)} AS alias FROM files")
def _sha8(s, d):
    return files(s, d).select("repo", "path", p.hash_path("path", 8).alias("alias"))


@query("pathswap_sha8_repo", f"SELECT repo, path, {_hash(8, 'repo || chr(47) || ')} AS alias FROM files")
def _sha8_repo(s, d):
    return files(s, d).select("repo", "path", p.hash_path("path", 8, F.col("repo")).alias("alias"))


@query("join_alias_lookup", f"SELECT r.issue_id, r.path, coalesce(a.alias, {_hash(16).replace('path', 'r.path')}) AS alias FROM ra r LEFT JOIN (SELECT repo, path, 'known/' || md5(path) AS alias FROM files WHERE length(path) % 2 = 0) a ON a.repo = r.repo AND a.path = r.path")
def _alias(s, d):
    known = files(s, d).where(F.length("path") % 2 == 0).select("repo", "path", F.concat(F.lit("known/"), F.md5("path")).alias("alias"))
    return ranked(s, d, "a").join(known, ["repo", "path"], "left").select("issue_id", "path", F.coalesce("alias", p.hash_path("path", 16)).alias("alias"))


def _perm(group: str, name: str) -> str:
    return f"SELECT {group}, a.n AS old, b.n AS new FROM (SELECT {group}, n, row_number() OVER (PARTITION BY {group} ORDER BY n) AS i FROM x) a JOIN (SELECT {group}, n, row_number() OVER (PARTITION BY {group} ORDER BY md5('42|' || {name}), n) AS i FROM x) b USING ({group}, i)"


@query("shuffle_filenames", f"+x AS (SELECT DISTINCT repo, {_DIR.format('path')} AS dir, {_BASE.format('path')} AS n FROM files), y AS ({_perm('repo, dir', chr(39).join(['repo || ', '|', ' || dir || ', '|', ' || n']))}) SELECT repo, dir || '/' || old AS path, dir || '/' || new AS new FROM y")
def _names(s, d):
    f = files(s, d).select("repo", t.dirname("path").alias("dir"), t.basename("path").alias("name"))
    return p.shuffled(f, ["repo", "dir"], "name").select("repo", F.concat_ws("/", "dir", "name").alias("path"), F.concat_ws("/", "dir", "new").alias("new"))


@query("shuffle_dirs", f"+x AS (SELECT DISTINCT repo, {_DIR.format('path')} AS n FROM files), y AS ({_perm('repo', chr(39).join(['repo || ', '|', ' || n']))}) SELECT f.repo, f.path, y.new || '/' || {_BASE.format('f.path')} AS new FROM files f JOIN y ON y.repo = f.repo AND y.old = {_DIR.format('f.path')}")
def _dirs(s, d):
    f = files(s, d).withColumn("dir", t.dirname("path"))
    return f.join(p.shuffled(f, ["repo"], "dir"), ["repo", "dir"]).select("repo", "path", F.concat_ws("/", "new", t.basename("path")).alias("new"))


@query("flatten_dirs", f"SELECT repo, path, CASE WHEN n = 0 THEN b ELSE regexp_replace(b, '\\.py$', '') || '_' || n || '.py' END AS new FROM (SELECT repo, path, {_BASE.format('path')} AS b, row_number() OVER (PARTITION BY repo, {_BASE.format('path')} ORDER BY path) - 1 AS n FROM files)")
def _flat(s, d):
    return p.flatten_dirs(files(s, d))


_MASK = "array_to_string(list_transform(string_split(regexp_replace(path, '\\.py$', ''), '/'), lambda x: array_to_string(list_transform(string_split(x, '_'), lambda y: CASE WHEN {hit} THEN left(sha256(y), 8) ELSE y END), '_')), '/') || '.py'"


@query("remove_module_names", f"SELECT repo, path, {_MASK.format(hit=chr(39).join(['list_contains([', 'brand', ', ', 'economy', ', ', 'small', '], y)']))} AS new FROM files")
def _remove(s, d):
    return files(s, d).select("repo", "path", p.masked("path", lambda y: y.isin("brand", "economy", "small")).alias("new"))


@query("delexicalize", f"SELECT repo, issue_id, {_MASK.format(hit='length(y) >= 3 AND contains(lower(text), lower(y))')} AS new FROM texts")
def _delex(s, d):
    return issue_texts(s, d).select("repo", "issue_id", p.masked("path", lambda y: (F.length(y) >= 3) & F.lower("text").contains(F.lower(y))).alias("new"))


@query("deleak_issue", f"SELECT repo, issue_id, replace(replace(text, path, '[FILE]'), {_BASE.format('path')}, '[FILE]') AS text FROM texts")
def _deleak(s, d):
    """Longest names first: the path, then the file name."""
    return issue_texts(s, d).select("repo", "issue_id", F.replace(F.replace("text", F.col("path"), F.lit("[FILE]")), t.basename("path"), F.lit("[FILE]")).alias("text"))


@query("anonymize_ids", "SELECT issue_id, path, 'file_' || lpad((row_number() OVER (PARTITION BY issue_id ORDER BY md5('7|' || issue_id || '|' || path), path) - 1)::VARCHAR, 4, '0') || '.py' AS alias FROM ra")
def _ids(s, d):
    n = F.row_number().over(Window.partitionBy("issue_id").orderBy(F.md5(F.concat_ws("|", F.lit("7"), "issue_id", "path")), "path")) - 1
    return ranked(s, d, "a").select("issue_id", "path", F.concat(F.lit("file_"), F.lpad(n.cast("string"), 4, "0"), F.lit(".py")).alias("alias"))


@query("anonymize_dirs", f"SELECT repo, path, 'dir' || lpad((dense_rank() OVER (PARTITION BY repo ORDER BY {_DIR.format('path')}) - 1)::VARCHAR, 3, '0') || '/' || left(md5({_BASE.format('path')}), 8) || '.py' AS alias FROM files")
def _anon(s, d):
    n = F.dense_rank().over(Window.partitionBy("repo").orderBy(t.dirname("path"))) - 1
    return files(s, d).select("repo", "path", F.concat(F.lit("dir"), F.lpad(n.cast("string"), 3, "0"), F.lit("/"), F.left(F.md5(t.basename("path")), F.lit(8)), F.lit(".py")).alias("alias"))


@query("infer_repo_roots", "SELECT repo, string_agg(DISTINCT split_part(path, '/', 1), ' ' ORDER BY split_part(path, '/', 1)) AS roots FROM files GROUP BY repo")
def _roots(s, d):
    return files(s, d).groupBy("repo").agg(joined(F.array_sort(F.collect_set(F.split_part("path", F.lit("/"), F.lit(1))))).alias("roots"))


@query("hard_only_hash", f"+h AS (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY score, path) AS i, count(*) OVER (PARTITION BY issue_id) AS n FROM ra) SELECT issue_id, path, CASE WHEN i <= floor(n * 0.3) THEN {_hash(8)} ELSE path END AS new FROM h")
def _hard(s, d):
    w = Window.partitionBy("issue_id")
    i, n = F.row_number().over(w.orderBy("score", "path")), F.count(F.lit(1)).over(w)
    return ranked(s, d, "a").select("issue_id", "path", F.when(i <= F.floor(n * 0.3), p.hash_path("path", 8)).otherwise(F.col("path")).alias("new"))


# ---- negatives, cleaning, splits, audits -------------------------------------------------------------------


@query("neg_sampler_mix", "+s AS (SELECT repo, issue_id, path, 'bm25' AS source, 0 AS o FROM ra WHERE NOT gt UNION ALL SELECT repo, issue_id, path, 'dense', 1 FROM rb WHERE NOT gt), f AS (SELECT repo, issue_id, path, arg_min(source, o) AS source FROM s GROUP BY ALL) SELECT issue_id, path, source FROM (SELECT *, row_number() OVER (PARTITION BY issue_id, source ORDER BY md5('42|' || issue_id || '|' || path), path) AS n FROM f) WHERE n <= CASE source WHEN 'bm25' THEN 4 ELSE 2 END")
def _sampler(s, d):
    side = lambda m, name: ranked(s, d, m).where("NOT gt").select(*KEY, "path", F.lit(name).alias("source"))
    return c.quota(side("a", "bm25").unionByName(side("b", "dense")), {"bm25": 4, "dense": 2}).select("issue_id", "path", "source")


_STEM = "split_part(" + _BASE.format("{0}") + ", '_', 1)"


@query("neg_confusable", f"+k AS (SELECT r.issue_id, g.path AS truth, r.path, r.rank, CASE WHEN {_DIR.format('r.path')} = {_DIR.format('g.path')} AND {_STEM.format('r.path')} = {_STEM.format('g.path')} THEN 1 WHEN {_DIR.format('r.path')} = {_DIR.format('g.path')} THEN 2 WHEN {_STEM.format('r.path')} = {_STEM.format('g.path')} THEN 3 END AS kind FROM ra r JOIN changes g USING (issue_id) WHERE NOT r.gt) SELECT issue_id, truth, path, kind FROM (SELECT *, row_number() OVER (PARTITION BY issue_id, truth ORDER BY kind, rank) AS n FROM k WHERE kind IS NOT NULL) WHERE n <= 8")
def _confusable(s, d):
    """Up to eight wrong candidates for every true file: of its folder and stem, of its folder, of its stem, in list order.

    Candidates and true files meet by folder and by stem, not each with each.
    """
    marks = lambda p: (t.dirname(p).alias("dir"), F.split_part(t.basename(p), F.lit("_"), F.lit(1)).alias("stem"))
    true = changes(s, d).select(*KEY, F.col("path").alias("truth"), *marks("path"))
    wrong = ranked(s, d, "a").where("NOT gt").select(*KEY, "path", "rank", *marks("path"))
    by_dir = true.join(wrong.withColumnRenamed("stem", "other"), [*KEY, "dir"]).select(*KEY, "truth", "path", "rank", F.when(F.col("stem") == F.col("other"), 1).otherwise(2).alias("kind"))
    by_stem = true.join(wrong.withColumnRenamed("dir", "other"), [*KEY, "stem"]).where("dir <> other").select(*KEY, "truth", "path", "rank", F.lit(3).alias("kind"))
    order = Window.partitionBy("issue_id", "truth").orderBy("kind", "rank")
    return by_dir.unionByName(by_stem).withColumn("n", F.row_number().over(order)).where("n <= 8").select("issue_id", "truth", "path", "kind")


_ON_DISK = "('0x' || left(md5('disk|' || repo || '|' || path), 6))::BIGINT / 16777216 >= 0.1"


@query("clean_rows", f"+g AS (SELECT issue_id, count(*) AS n_gt, count(*) FILTER ({_ON_DISK}) AS here FROM changes GROUP BY ALL), p AS (SELECT issue_id, count(*) AS n, count(*) FILTER (gt AND {_ON_DISK}) AS h, count(*) FILTER (NOT ({_ON_DISK})) AS gone FROM ra GROUP BY ALL) SELECT CASE WHEN n_gt IS NULL THEN 'empty_gt' WHEN here = 0 THEN 'no_gt_on_disk' WHEN coalesce(n, 0) < 5 THEN 'few_candidates' WHEN h = 0 THEN 'gt_not_in_candidates' WHEN gone > 5 THEN 'candidates_missing' ELSE 'kept' END AS reason, count(*) AS n FROM issues LEFT JOIN g USING (issue_id) LEFT JOIN p USING (issue_id) GROUP BY 1")
def _clean(s, d):
    """The first of five reasons against an issue's row. A file of the made-up repos is on disk or not by a hash."""
    disk = draw(F.lit("disk"), "repo", "path") >= 0.1
    gt = changes(s, d).groupBy("issue_id").agg(F.count(F.lit(1)).alias("n_gt"), F.count_if(disk).alias("here"))
    pool = ranked(s, d, "a").groupBy("issue_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt") & disk).alias("h"), F.count_if(~disk).alias("gone"))
    x = issues(s, d).select("issue_id").join(gt, "issue_id", "left").join(pool, "issue_id", "left").na.fill(0)
    why = c.reasons(("empty_gt", F.col("n_gt") == 0), ("no_gt_on_disk", F.col("here") == 0), ("few_candidates", F.col("n") < 5), ("gt_not_in_candidates", F.col("h") == 0), ("candidates_missing", F.col("gone") > 5))
    return x.groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("dedup_priority", "SELECT issue_id, path, arg_min(m, m) AS source FROM ranked GROUP BY ALL")
def _dedup(s, d):
    """An issue's three lists are in one row; a file goes to the first list that holds it."""
    paths = lambda m: F.transform(f"top_{m}", lambda x: x["path"]).alias(m)
    top = lists(s, d, "abc").select("issue_id", *(paths(m) for m in "abc"))
    own = {"a": F.col("a"), "b": F.array_except("b", "a"), "c": F.array_except(F.array_except("c", "a"), F.col("b"))}
    tagged = lambda m: F.transform(own[m], lambda p: F.struct(p.alias("path"), F.lit(m).alias("source")))
    named = F.concat(*map(tagged, own))
    return top.select("issue_id", F.explode_outer(named).alias("x")).where("x IS NOT NULL").select("issue_id", "x.path", "x.source")


@query("split_repo_heldout", "SELECT repo, count(*) AS n FROM issues WHERE split = 'test' GROUP BY repo ORDER BY n DESC, repo LIMIT 15")
def _heldout(s, d):
    return c.heldout_groups(issues(s, d).where("split = 'test'"), "repo", 15)


@query("split_static_heldout", "SELECT repo IN ('r1', 'r2', 'r3') AS held_out, count(*) AS n FROM issues GROUP BY 1")
def _static(s, d):
    return issues(s, d).groupBy(F.col("repo").isin("r1", "r2", "r3").alias("held_out")).agg(F.count(F.lit(1)).alias("n"))


@query("split_full_minus_lite", "SELECT issue_id FROM issues WHERE split = 'train' EXCEPT SELECT issue_id FROM issues WHERE priority = '1-URGENT'")
def _minus(s, d):
    i = issues(s, d)
    return i.where("split = 'train'").select("issue_id").join(i.where("priority = '1-URGENT'").select("issue_id"), "issue_id", "left_anti")


@query("audit_split_field", "SELECT split, count(*) AS n FROM issues GROUP BY split")
def _field(s, d):
    return issues(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("audit_temporal", "SELECT repo, max(ts) FILTER (split = 'train') < min(ts) FILTER (split = 'test') AS ordered FROM issues GROUP BY repo")
def _temporal(s, d):
    return issues(s, d).groupBy("repo").agg((F.max(F.when(F.col("split") == "train", F.col("ts"))) < F.min(F.when(F.col("split") == "test", F.col("ts")))).alias("ordered"))


_EDGE = "SELECT DISTINCT x.repo, x.path AS a, y.path AS b FROM changes x JOIN changes y ON x.issue_id = y.issue_id AND x.path < y.path WHERE x.split = '{0}'"


@query("audit_edge_provenance", f"SELECT repo, count(*) AS n FROM ({_EDGE.format('test')} EXCEPT {_EDGE.format('train')}) GROUP BY repo")
def _edges(s, d):
    """Co-change edges that only test issues have."""
    ch = changes(s, d).select(*KEY, "path", "split")
    pair = ch.withColumnRenamed("path", "a").join(ch.select(*KEY, F.col("path").alias("b")), KEY).where("a < b")
    side = lambda x: pair.where(F.col("split") == x).select("repo", "a", "b").distinct()
    return side("test").join(side("train"), ["repo", "a", "b"], "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query("audit_gt_reachability", "+n AS (SELECT repo, src AS path FROM imports WHERE src <> dst UNION SELECT repo, dst FROM imports WHERE src <> dst), tr AS (SELECT DISTINCT repo, path FROM changes WHERE split = 'train') SELECT n.path IS NOT NULL AS is_node, tr.path IS NOT NULL AS in_train, count(*) AS n FROM (SELECT repo, path FROM changes WHERE split = 'test') g LEFT JOIN n USING (repo, path) LEFT JOIN tr USING (repo, path) GROUP BY 1, 2")
def _reach(s, d):
    e = imports(s, d).where("src <> dst")
    node = e.select("repo", F.col("src").alias("path")).unionByName(e.select("repo", F.col("dst").alias("path"))).distinct().withColumn("x", F.lit(1))
    ch = changes(s, d)
    train = ch.where("split = 'train'").select("repo", "path").distinct().withColumn("y", F.lit(1))
    g = ch.where("split = 'test'").select("repo", "path").join(node, ["repo", "path"], "left").join(train, ["repo", "path"], "left")
    return g.groupBy(F.col("x").isNotNull().alias("is_node"), F.col("y").isNotNull().alias("in_train")).agg(F.count(F.lit(1)).alias("n"))


@query("audit_id_overlap", "SELECT count(*) AS n FROM (SELECT path FROM changes WHERE split = 'train' INTERSECT SELECT path FROM changes WHERE split = 'test')")
def _overlap(s, d):
    ch = changes(s, d)
    return ch.where("split = 'train'").select("path").intersect(ch.where("split = 'test'").select("path")).agg(F.count(F.lit(1)).alias("n"))


@query("gates_pool", "SELECT count(*) AS n, count(*) >= 100 AS enough, avg(n_c) >= 5 AS wide, avg((h > 0)::INTEGER) >= 0.7 AS covered FROM (SELECT issue_id, count(*) AS n_c, count(*) FILTER (gt) AS h FROM ra GROUP BY issue_id)")
def _gates(s, d):
    per = ranked(s, d, "a").groupBy("issue_id").agg(F.count(F.lit(1)).alias("n_c"), F.count_if("gt").alias("h"))
    return per.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 100).alias("enough"), (F.avg("n_c") >= 5).alias("wide"), (F.avg((F.col("h") > 0).cast("int")) >= 0.7).alias("covered"))


@query("digest_canonical", "SELECT repo, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM (SELECT repo, sha256(repo || '|' || path) AS h FROM files) GROUP BY repo")
def _digest(s, d):
    return c.digest(files(s, d), "repo")


@query("challenge_same_dir", f"SELECT g.issue_id, count(*) AS n FROM (SELECT repo, issue_id, min(path) AS g FROM changes GROUP BY ALL) g JOIN files f ON f.repo = g.repo AND {_DIR.format('f.path')} = {_DIR.format('g.g')} AND f.path <> g.g GROUP BY g.issue_id HAVING count(*) >= 3")
def _same_dir(s, d):
    """Issues whose first file has three or more neighbours in its directory: a directory's files are counted once, and g is one of them."""
    g = changes(s, d).groupBy(*KEY).agg(F.min("path").alias("g")).select("repo", "issue_id", t.dirname("g").alias("dir"))
    per = files(s, d).groupBy("repo", t.dirname("path").alias("dir")).agg((F.count(F.lit(1)) - 1).alias("n"))
    return g.join(per, ["repo", "dir"]).groupBy("issue_id").agg(F.sum("n").alias("n")).where("n >= 3")


@query("challenge_same_stem", f"SELECT DISTINCT g.issue_id FROM changes g JOIN ra r ON r.issue_id = g.issue_id AND NOT r.gt AND split_part({_BASE.format('r.path')}, '_', 1) = split_part({_BASE.format('g.path')}, '_', 1)")
def _same_stem(s, d):
    name = F.split_part(t.basename("path"), F.lit("_"), F.lit(1)).alias("name")
    return changes(s, d).select("issue_id", name).join(ranked(s, d, "a").where("NOT gt").select("issue_id", name), ["issue_id", "name"], "left_semi").select("issue_id").distinct()


@query("group_kfold", "SELECT repo, ('0x' || left(md5(repo), 8))::BIGINT % 5 AS fold FROM (SELECT DISTINCT repo FROM issues)")
def _kfold(s, d):
    return issues(s, d).select("repo").distinct().select("repo", (F.conv(F.left(F.md5("repo"), F.lit(8)), 16, 10).cast("long") % 5).alias("fold"))


@query("stratified_sample", "+n AS (SELECT repo, count(*) AS n FROM issues GROUP BY repo), q AS (SELECT repo, floor(200.0::DOUBLE * n / sum(n) OVER ()) AS q FROM n) SELECT issue_id FROM (SELECT i.repo, i.issue_id, row_number() OVER (PARTITION BY i.repo ORDER BY md5('42|' || issue_id), issue_id) AS r FROM issues i) JOIN q USING (repo) WHERE r <= q")
def _stratified(s, d):
    """About 200 issues in proportion to the repos' sizes, by hash order (a sampling operator: the size is the feature)."""
    i = issues(s, d)
    n = i.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    q = n.crossJoin(F.broadcast(total)).select("repo", F.floor(200.0 * F.col("n") / F.col("t")).alias("q"))
    r = F.row_number().over(Window.partitionBy("repo").orderBy(F.md5(F.concat_ws("|", F.lit("42"), "issue_id")), "issue_id"))
    return i.withColumn("r", r).join(q, "repo").where("r <= q").select("issue_id")
