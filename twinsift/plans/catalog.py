"""The registered queries of the engine's own operators, each with the SQL that it is checked against."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import embedding
from ..chunker import parse_files
from ..functions import scalars
from ..operators import cache, changes, exclusions, knn, ranking, status
from ..sources.globs import GlobSet
from ..sources.repository import worktree_paths
from . import sources
from .tables import CHUNKS_SQL, DOCUMENTS_SQL, RULES, THRESHOLD, TOKENS_SQL, chunks, combined_sql, distance_sql, documents, jaccard_sql, related_sql, table, tier_sql

Query = Callable[[SparkSession, str], DataFrame]

PAIR_COLUMNS = ["a_id", "b_id", "raw_distance", "jaccard", "distance", "similarity"]

# --- scan ---------------------------------------------------------------------------------------------------------


def scan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scan(chunks(spark, sf_dir), THRESHOLD, top=None).select(*PAIR_COLUMNS)


def scan_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scan(chunks(spark, sf_dir), THRESHOLD).select(*PAIR_COLUMNS)


def scan_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scan(chunks(spark, sf_dir), THRESHOLD, top=None, rules=RULES).select(*PAIR_COLUMNS)


def neighbours_sql(queries: str, index: str, k: int) -> str:
    return f"""(SELECT * FROM (SELECT q.id AS q_id, n.id AS n_id, {distance_sql('q.v', 'n.v')} AS d,
       row_number() OVER (PARTITION BY q.id ORDER BY {distance_sql('q.v', 'n.v')}, n.id) AS r FROM {queries} q CROSS JOIN {index} n) WHERE r <= {k})"""


def scan_sql(where: str = "true", query_where: str = "true", tail: str = "") -> str:
    return f"""
WITH {CHUNKS_SQL},
queries AS (SELECT * FROM chunks q WHERE {query_where}),
near AS (SELECT * FROM {neighbours_sql('queries', 'chunks', ranking.SCAN_NEIGHBOURS)} WHERE d <= {THRESHOLD} AND q_id <> n_id),
kept AS (SELECT DISTINCT least(q.id, n.id) AS a_id, greatest(q.id, n.id) AS b_id, d FROM near JOIN chunks q ON q.id = q_id JOIN chunks n ON n.id = n_id
         WHERE NOT {related_sql('q', 'n')} AND {where}),
scored AS (SELECT a_id, b_id, d AS raw_distance, {jaccard_sql('a.tokens', 'b.tokens')} AS jaccard FROM kept JOIN chunks a ON a.id = a_id JOIN chunks b ON b.id = b_id),
final AS (SELECT *, {combined_sql('raw_distance', 'jaccard')} AS distance FROM scored)
SELECT a_id, b_id, raw_distance, jaccard, distance, {tier_sql('distance')} AS similarity FROM final {tail}
"""


_PAIR = lambda a, b: f"(least({a}, {b}), greatest({a}, {b}))"
_SIGNATURES_KEPT = f"{_PAIR('q.signature_hash', 'n.signature_hash')} NOT IN (('fn_0', 'fn_1'))"
_FILES_KEPT = f"{_PAIR('q.file_path', 'n.file_path')} NOT IN (('src2', 'src3'), ('src0', 'src5'), ('src0', 'src0'))"
_NOT_IGNORED = "NOT ({0}.file_path LIKE 'src1_' AND {0}.file_path <> 'src12')"

# --- nearest neighbours -------------------------------------------------------------------------------------------

K = 10


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return knn.knn(vectors.where("id % 100 = 0"), vectors, K)


def knn_topk_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return knn.knn(vectors, vectors, K, broadcast_values=0)


def knn_topk_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return knn.knn_sql(vectors.where("id % 100 = 0"), vectors, K)


def knn_oracle(where: str) -> str:
    return f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), qs AS (SELECT * FROM e WHERE {where})
SELECT q_id AS query_id, n_id AS id, d AS distance, CAST(r AS INTEGER) AS rank FROM {neighbours_sql('qs', 'e', K)}
"""


def threshold_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.threshold_join(_vectors(spark, sf_dir), THRESHOLD)


THRESHOLD_SQL = f"""
WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.id AS a_id, b.id AS b_id, {distance_sql('a.v', 'b.v')} AS distance FROM e a JOIN e b ON a.id < b.id WHERE {distance_sql('a.v', 'b.v')} <= {THRESHOLD}
"""

# --- query --------------------------------------------------------------------------------------------------------

QUERY_LIMIT = 0.8
CANDIDATES = ["query_id", "id", "rank", "raw_distance", "jaccard", "distance", "similarity"]


def query_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = chunks(spark, sf_dir)
    return ranking.query(index.where("id % 100 = 0"), index, threshold=QUERY_LIMIT).select(*CANDIDATES)


def query_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = chunks(spark, sf_dir)
    return ranking.query(index, index, threshold=QUERY_LIMIT, rules=RULES).select(*CANDIDATES)


def query_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = chunks(spark, sf_dir)
    found = ranking.nested(index, ranking.query(index, index, threshold=THRESHOLD - 0.1))
    return found.select("id", F.size("candidates").cast("long").alias("candidates"), F.array_join(F.transform("candidates", lambda c: c["id"].cast("string")), ",").alias("ids"))


def query_sql(queries: str, limit: float, where: str = "true", body: str | None = None) -> str:
    body = body or "SELECT query_id, id, rank, raw_distance, jaccard, distance, similarity FROM best"
    return f"""
WITH {CHUNKS_SQL},
queries AS (SELECT * FROM chunks WHERE {queries}),
near AS (SELECT * FROM {neighbours_sql('queries', 'chunks', ranking.OVERFETCH * ranking.QUERY_TOP)} WHERE d <= {limit} AND q_id <> n_id),
scored AS (SELECT q_id AS query_id, n_id AS id, d AS raw_distance, {jaccard_sql('q.tokens', 'n.tokens')} AS jaccard FROM near JOIN chunks q ON q.id = q_id JOIN chunks n ON n.id = n_id
           WHERE NOT {related_sql('q', 'n')} AND {where}),
mixed AS (SELECT *, {combined_sql('raw_distance', 'jaccard')} AS distance FROM scored),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, raw_distance, id) AS INTEGER) AS rank FROM mixed),
best AS (SELECT *, {tier_sql('distance')} AS similarity FROM ranked WHERE rank <= {ranking.QUERY_TOP})
{body}
"""


NESTED_SQL = query_sql("true", THRESHOLD - 0.1, body="SELECT c.id, count(b.id) AS candidates, coalesce(string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.rank), '') AS ids FROM chunks c LEFT JOIN best b ON b.query_id = c.id GROUP BY c.id")

# --- tiers and display --------------------------------------------------------------------------------------------

BOUNDS = [0.0, 0.01, 0.010001, 0.05, 0.0500001, 0.12, 0.1200001, 0.2, 0.2000001, 1.0]


def similarity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.by_tier(ranking.scan(chunks(spark, sf_dir), THRESHOLD, top=None))


TIERS_SQL = f"SELECT similarity, CAST(list_position({scalars.TIER_ORDER!r}, similarity) AS INTEGER) AS tier_rank, count(*) AS pairs FROM ({scan_sql()}) GROUP BY similarity"


def tier_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in BOUNDS], "distance double").withColumn("similarity", scalars.tier(F.col("distance"))).withColumn("percent", scalars.similarity_percent(F.col("distance")))


BOUNDS_SQL = f"SELECT distance, {tier_sql('distance')} AS similarity, CAST(trunc((1 - distance) * 100) AS INTEGER) AS percent FROM (SELECT unnest(CAST({BOUNDS} AS DOUBLE[])) AS distance)"

# --- scalars ------------------------------------------------------------------------------------------------------


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", "content_hash")


def _signature_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = F.array(F.struct(F.lit("a").alias("name"), F.col("p_type").alias("type")), F.struct(F.lit("b").alias("name"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("type")))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_name").alias("name"), params.alias("params"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("return_type"), "p_size")


def signature_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _signature_inputs(spark, sf_dir)
    return rows.select("p_partkey", scalars.signature_hash(F.col("name"), F.col("params"), F.col("return_type")).alias("signature_hash"), scalars.signature_text(F.col("params"), F.col("return_type")).alias("signature"))


_TYPE = lambda value, missing: f"lower(regexp_replace(coalesce({value}, '{missing}'), '\\s+', '', 'g'))"
SIGNATURE_SQL = f"""
WITH p AS (SELECT *, CASE WHEN p_size > 25 THEN p_brand END AS second, CASE WHEN p_size % 2 = 0 THEN p_brand END AS ret FROM part)
SELECT p_partkey, substr(sha256(lower(trim(p_name)) || '(' || {_TYPE('p_type', 'any')} || ',' || {_TYPE('second', 'any')} || '):' || {_TYPE('ret', 'void')}), 1, 16) AS signature_hash,
       '(a' || coalesce(': ' || p_type, '') || ', b' || coalesce(': ' || second, '') || ')' || coalesce(' => ' || ret, '') AS signature
FROM p
"""


def chunk_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    end = F.col("p_size") * 2 - 20
    return rows.select("p_partkey", scalars.chunk_id(F.col("p_brand"), F.col("p_name"), F.col("p_size")).alias("id"), scalars.line_count(F.col("p_size"), end).alias("lines"))


CHUNK_ID_SQL = "SELECT p_partkey, p_brand || ':' || p_name || ':' || p_size AS id, CAST(greatest(p_size * 2 - 20 - p_size, 0) + 1 AS INTEGER) AS lines FROM part"


def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumn("tokens", scalars.tokens_of(F.col("text")))
    return rows.select("id", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


TOKEN_SETS_SQL = f"WITH t AS (SELECT doc_id AS id, list_sort({TOKENS_SQL}) AS tokens FROM documents) SELECT id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5 FROM t"


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    found = knn.knn(rows, rows, ranking.SCAN_NEIGHBOURS).where("query_id < id")
    tokens = ranking.tokens_of(rows, rows.select("id"))
    both = found.join(tokens.select(F.col("id").alias("query_id"), F.col("tokens").alias("x")), "query_id").join(tokens, "id")
    return ranking.with_jaccard(both, "x", "tokens").select(F.col("query_id").alias("a_id"), F.col("id").alias("b_id"), "jaccard")


JACCARD_SQL = f"""
WITH {CHUNKS_SQL}, near AS (SELECT * FROM {neighbours_sql('chunks', 'chunks', ranking.SCAN_NEIGHBOURS)} WHERE q_id < n_id)
SELECT q_id AS a_id, n_id AS b_id, {jaccard_sql('a.tokens', 'b.tokens')} AS jaccard FROM near JOIN chunks a ON a.id = q_id JOIN chunks b ON b.id = n_id
"""

# --- exclusions ---------------------------------------------------------------------------------------------------


def _neighbour_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir)
    found = knn.knn(rows, rows, ranking.SCAN_NEIGHBOURS).where("query_id <> id").select("query_id", "id", "distance")
    return found.join(ranking.info(rows, "q_", "query_id"), "query_id").join(ranking.info(rows, "n_", "id"), "id")


def exclude_signature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = exclusions.Exclusions(pairs=RULES.pairs)
    return ranking.apply_rules(_neighbour_pairs(spark, sf_dir), rules, "q_", "n_").select("query_id", "id", "distance")


def exclude_file_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = exclusions.Exclusions(file_pairs=RULES.file_pairs)
    return ranking.apply_rules(_neighbour_pairs(spark, sf_dir), rules, "q_", "n_").select("query_id", "id", "distance")


def exclude_pairs_sql(where: str) -> str:
    return f"""
WITH {CHUNKS_SQL}, near AS (SELECT * FROM {neighbours_sql('chunks', 'chunks', ranking.SCAN_NEIGHBOURS)} WHERE q_id <> n_id)
SELECT q_id AS query_id, n_id AS id, d AS distance FROM near JOIN chunks q ON q.id = q_id JOIN chunks n ON n.id = n_id WHERE {where}
"""


GLOBS = GlobSet(["# pages", "fr/", "m.*", "!m.ththth.example.net"])


def exclude_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("excluded", GLOBS.matches(F.col("path")))


GLOBS_SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
s AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, path, CASE WHEN parts[len(parts)] LIKE 'm.%' AND parts[len(parts)] <> 'm.ththth.example.net' THEN true
       WHEN list_contains(parts[1:len(parts) - 1], 'fr') THEN true
       WHEN parts[1] = 'm.ththth.example.net' THEN false ELSE parts[1] LIKE 'm.%' END AS excluded FROM s
"""


def related_chunk_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbour_pairs(spark, sf_dir).select("query_id", "id", F.coalesce(ranking.is_related("q_", "n_"), F.lit(False)).alias("related"))


RELATED_SQL = f"""
WITH {CHUNKS_SQL}, near AS (SELECT * FROM {neighbours_sql('chunks', 'chunks', ranking.SCAN_NEIGHBOURS)} WHERE q_id <> n_id)
SELECT q_id AS query_id, n_id AS id, {related_sql('q', 'n')} AS related FROM near JOIN chunks q ON q.id = q_id JOIN chunks n ON n.id = n_id
"""


def related_in_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs of a file's chunks are related, for each file; all pairs by name, not by text."""
    rows = documents(spark, sf_dir)
    names = rows.groupBy("file_path", "chunk_type", "function_name", "context").agg(F.count(F.lit(1)).alias("n"))
    side = lambda p: names.select(F.col("file_path").alias("file"), *(F.col(c).alias(f"{p}{c}") for c in ("file_path", "chunk_type", "function_name", "context", "n")))
    pairs = side("a_").join(side("b_"), "file").where(ranking.is_related("a_", "b_"))
    return pairs.groupBy(F.col("file").alias("file_path")).agg(F.sum(F.col("a_n") * F.col("b_n")).alias("related"))


RELATED_FILE_SQL = f"""
WITH {DOCUMENTS_SQL}, names AS (SELECT file_path, chunk_type, function_name, context, count(*) AS n FROM docs GROUP BY ALL)
SELECT a.file_path, CAST(sum(a.n * b.n) AS BIGINT) AS related FROM names a JOIN names b ON a.file_path = b.file_path WHERE {related_sql('a', 'b')} GROUP BY a.file_path
"""


def stale_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exclusions between neighbouring documents of the old snapshot, against what the new one still has."""
    rows = documents(spark, sf_dir)
    old = rows.select("id", F.substring("content_hash", 1, 16).alias("signature_hash"))
    pairs = old.select(F.col("id"), F.col("signature_hash").alias("a_hash")).join(old.select((F.col("id") - 1).alias("id"), F.col("signature_hash").alias("b_hash")), "id")
    known = old.where("id % 5 <> 0").select("signature_hash")
    return exclusions.stale(pairs, known)


STALE_SQL = f"""
WITH {DOCUMENTS_SQL}, old AS (SELECT id, substr(content_hash, 1, 16) AS h FROM docs), pairs AS (SELECT a.h AS a_hash, b.h AS b_hash FROM old a JOIN old b ON b.id = a.id + 1)
SELECT signature_hash FROM (SELECT a_hash AS signature_hash FROM pairs UNION SELECT b_hash FROM pairs) WHERE signature_hash NOT IN (SELECT h FROM old WHERE id % 5 <> 0)
"""


def file_group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation")
    existing = nations.join(table(spark, sf_dir, "region"), nations["n_regionkey"] == F.col("r_regionkey"))
    existing = existing.where("n_name <> r_name").select(F.least("n_name", "r_name").alias("lo"), F.greatest("n_name", "r_name").alias("hi"))
    return exclusions.group_pairs(nations, existing, "n_name", "n_regionkey")


GROUP_PAIRS_SQL = """
SELECT DISTINCT a.n_name AS lo, b.n_name AS hi FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name
WHERE (a.n_name, b.n_name) NOT IN (SELECT (least(n_name, r_name), greatest(n_name, r_name)) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name <> r_name)
"""

# --- changes ------------------------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Current and tracked files: each document is a file; some are new, gone, edited, or only touched."""
    n, text = F.col("doc_id"), F.col("text")
    rows = table(spark, sf_dir, "documents").select(n, text, F.concat(F.lit("docs/"), n.cast("string")).alias("file_path"))
    current = rows.where(n % 13 != 0).select("file_path", scalars.content_hash(text).alias("content_hash"), (n + F.when((n % 5 == 0) | (n % 11 == 0), 1).otherwise(0)).alias("mtime_ms"))
    tracked = rows.where(n % 7 != 0).select("file_path", scalars.content_hash(F.when(n % 5 == 0, F.concat(text, F.lit("x"))).otherwise(text)).alias("content_hash"), n.alias("mtime_ms"))
    return current, tracked


SNAPSHOTS_SQL = """
rows AS (SELECT doc_id AS n, text, 'docs/' || doc_id AS file_path FROM documents),
cur AS (SELECT file_path, sha256(text) AS content_hash, n + CASE WHEN n % 5 = 0 OR n % 11 = 0 THEN 1 ELSE 0 END AS mtime_ms FROM rows WHERE n % 13 <> 0),
trk AS (SELECT file_path, sha256(CASE WHEN n % 5 = 0 THEN text || 'x' ELSE text END) AS content_hash, n AS mtime_ms FROM rows WHERE n % 7 <> 0),
changes AS (SELECT coalesce(c.file_path, t.file_path) AS file_path, CASE WHEN c.file_path IS NULL THEN 'deleted' WHEN t.file_path IS NULL THEN 'added'
            WHEN c.mtime_ms = t.mtime_ms OR c.content_hash = t.content_hash THEN 'unchanged' ELSE 'modified' END AS status FROM cur c FULL JOIN trk t ON c.file_path = t.file_path)"""


def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.file_changes(*_snapshots(spark, sf_dir))


def change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.change_counts(file_changes(spark, sf_dir))


def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    current, tracked = _snapshots(spark, sf_dir)
    vector = F.array(F.lit(0.5).cast("float"))
    old = tracked.select(F.concat("file_path", F.lit(":f:1")).alias("id"), "file_path", F.lit(None).cast("string").alias("source_text"), F.lit(3).alias("end_line"), "content_hash", vector.alias("embedding"))
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("source_text"))
    diff = changes.file_changes(current, tracked)
    fresh = texts.join(diff.where("status in ('added', 'modified')"), "file_path", "left_semi").select(F.concat("file_path", F.lit(":f:1")).alias("id"), "file_path", "source_text", F.lit(3).alias("end_line"))
    fresh = fresh.withColumns({"content_hash": F.sha2("source_text", 256)})
    return changes.merge_chunks(old, fresh, diff).select("id", "file_path", "content_hash", F.col("embedding").isNotNull().alias("has_embedding"))


MERGE_SQL = f"""
WITH {SNAPSHOTS_SQL}
SELECT file_path || ':f:1' AS id, file_path, content_hash, true AS has_embedding FROM trk JOIN changes USING (file_path) WHERE status = 'unchanged'
UNION ALL SELECT file_path || ':f:1', file_path, sha256(text), false FROM rows JOIN changes USING (file_path) WHERE status IN ('added', 'modified')
"""


def _diff_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = F.col("id")
    rows = documents(spark, sf_dir).withColumn("name", F.concat(F.lit("f"), (n / 20).cast("long").cast("string")))
    columns = ["file_path", "name", "content_hash", "position", "chunk_type"]
    old = rows.where(n % 7 != 0).withColumns({"position": n, "content_hash": F.when(n % 5 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("content_hash"))}).select(*columns)
    return old, rows.where(n % 13 != 0).withColumn("position", n).select(*columns)


def diff_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.compare_chunks(*_diff_sides(spark, sf_dir))


DIFF_SQL = f"""{DOCUMENTS_SQL},
rows AS (SELECT *, 'f' || CAST(floor(id / 20) AS BIGINT) AS name FROM docs),
old0 AS (SELECT file_path, name, chunk_type, id AS position, CASE WHEN id % 5 = 0 THEN sha256(text || 'x') ELSE content_hash END AS h FROM rows WHERE id % 7 <> 0),
old1 AS (SELECT *, CASE WHEN chunk_type = 'block' THEN h ELSE name END AS key FROM old0),
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, chunk_type, key ORDER BY position DESC) AS r FROM old1) WHERE r = 1),
new AS (SELECT file_path, name, chunk_type, content_hash AS h, CASE WHEN chunk_type = 'block' THEN content_hash ELSE name END AS key FROM rows WHERE id % 13 <> 0),
diff AS (SELECT coalesce(n.file_path, o.file_path) AS file_path, coalesce(n.name, o.name) AS name, CASE WHEN n.h IS NULL THEN 'removed' WHEN o.h IS NULL THEN 'added'
         WHEN n.h = o.h THEN 'unchanged' ELSE 'modified' END AS status FROM new n FULL JOIN old o ON n.file_path = o.file_path AND n.chunk_type = o.chunk_type AND n.key = o.key)"""


def removed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = diff_functions(spark, sf_dir).where("status = 'removed'")
    rows = documents(spark, sf_dir).select("id", "file_path", F.concat(F.lit("f"), (F.col("id") / 20).cast("long").cast("string")).alias("function_name"))
    return changes.without_removed(rows, removed)


REMOVED_SQL = f"""
WITH {DIFF_SQL}
SELECT id, file_path, name AS function_name FROM rows r WHERE NOT EXISTS (SELECT 1 FROM diff d WHERE d.status = 'removed' AND d.file_path = r.file_path AND d.name = r.name)
"""

LISTING = ["A\tsrc/new.ts", "M\tsrc/edited.rs", "D\tsrc/gone.py", "R100\tsrc/old.js\tsrc/moved.js", "C075\ta.ts\tb.ts", "T\tlink.ts", "A", "", "R100\tonly-one.ts"]


def name_status_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.name_status(spark.createDataFrame([(line,) for line in LISTING], "value string"))


NAME_STATUS_SQL = f"""
WITH l AS (SELECT string_split(line, chr(9)) AS p FROM (SELECT unnest([{', '.join("replace('" + x.replace(chr(9), '|') + "', '|', chr(9))" for x in LISTING)}]) AS line))
SELECT p[2] AS path, CASE p[1] WHEN 'A' THEN 'Added' WHEN 'M' THEN 'Modified' ELSE 'Deleted' END AS status FROM l WHERE p[1] IN ('A', 'M', 'D') AND len(p) >= 2
UNION ALL SELECT p[2], 'Deleted' FROM l WHERE p[1] LIKE 'R%' AND len(p) >= 3 UNION ALL SELECT p[3], 'Added' FROM l WHERE p[1] LIKE 'R%' AND len(p) >= 3
"""

WORKTREES = "worktree /a/main\nHEAD 1f\nbranch refs/heads/main\n\nworktree /a/side\nHEAD 2e\ndetached\n\nworktree /a/bare\nbare\n"


def worktree_list_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worktree_paths(spark.createDataFrame([(line,) for line in WORKTREES.split("\n")], "value string"))


WORKTREES_SQL = f"SELECT substr(line, 10) AS path FROM (SELECT unnest(string_split('{WORKTREES}', chr(10))) AS line) WHERE line LIKE 'worktree %'"

# --- cache and status ---------------------------------------------------------------------------------------------


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that has the contents of most documents, and some of old ones."""
    rows = documents(spark, sf_dir)
    known = rows.where("id % 4 <> 0").select("content_hash").distinct()
    old = rows.where("id % 10 = 0").select(F.sha2(F.concat("text", F.lit("old")), 256).alias("content_hash")).distinct()
    return known.union(old).withColumn("embedding", F.array(F.lit(1.0).cast("float")))


CACHE_SQL = f"""{DOCUMENTS_SQL},
cache AS (SELECT DISTINCT content_hash FROM docs WHERE id % 4 <> 0 UNION ALL SELECT DISTINCT sha256(text || 'old') FROM docs WHERE id % 10 = 0)"""


def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.split(documents(spark, sf_dir), _cache(spark, sf_dir)).select("id", F.col("cached").isNotNull().alias("hit"))


def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).withColumnRenamed("text", "source_text")
    return cache.misses(rows, _cache(spark, sf_dir)).select("content_hash")


def cache_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    used = cache.referenced([rows.where("id % 3 = 0"), rows.where("id % 5 = 0")])
    return cache.prune(_cache(spark, sf_dir), used).select("content_hash")


def cache_prune_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    return cache.prune_summary(_cache(spark, sf_dir), cache.referenced([rows.where("id % 3 = 0"), rows.where("id % 5 = 0")]))


_USED = "(SELECT content_hash FROM docs WHERE id % 3 = 0 OR id % 5 = 0)"


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.exact_duplicates(documents(spark, sf_dir))


def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    rows = status.chunk_counts(documents(spark, sf_dir).join(vectors, "id", "left"))
    labels = table(spark, sf_dir, "labels").agg(F.count(F.lit(1)).alias("labels"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"))
    return rows.crossJoin(labels)  # one row each


STATUS_SQL = f"""
WITH {DOCUMENTS_SQL}
SELECT count(*) AS chunks, count(embedding) AS embedded, count(*) - count(embedding) AS unembedded, count(DISTINCT file_path) AS files, count(DISTINCT content_hash) AS contents,
       (SELECT count(*) FROM labels) AS labels, (SELECT CAST(coalesce(sum(toxic), 0) AS BIGINT) FROM labels) AS toxic FROM docs LEFT JOIN embeddings ON vec_id = id
"""

SOURCES = [
    ("a.ts", "export const load = async (id: string): Promise<Row> => {\n  const row = await db.find(id);\n  return row;\n};\n"),
    ("b.jsx", "export default function App({ a }) {\n  return (\n    <p>{a}</p>\n  );\n}\n"),
    ("c.rs", "impl S {\n    fn load(&self, path: &str) -> u8 {\n        self.read(path)\n    }\n}\n"),
    ("d.py", "def greet(name: str) -> str:\n    text = hello(name)\n    return text\n"),
    ("e.go", "package main"),
]


def chunk_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of every language; no SQL form."""
    return parse_files(spark.createDataFrame(SOURCES, "file_path string, source string"))


def embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all distinct contents, whole, by the local embedder, which needs no limit; no SQL form."""
    texts = documents(spark, sf_dir).groupBy("content_hash").agg(F.min("text").alias("source_text"))
    return embedding.embed_texts(texts, embedding.HashingEmbedder(max_bytes=sys.maxsize))


def set_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by content for chunks that have none."""
    rows = documents(spark, sf_dir).withColumn("embedding", F.when(F.col("id") % 5 == 0, F.array(F.lit(9.0).cast("float"))))
    made = rows.where("id % 2 = 0").groupBy("content_hash").agg(F.array(F.min("id").cast("float")).alias("embedding"))
    return changes.with_embeddings(rows, made).select("id", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


SET_EMBEDDINGS_SQL = f"""
WITH {DOCUMENTS_SQL}, made AS (SELECT content_hash, min(id) AS v FROM docs WHERE id % 2 = 0 GROUP BY content_hash)
SELECT id, CAST(CASE WHEN id % 5 = 0 THEN 9 ELSE v END AS DOUBLE) AS first_value FROM docs LEFT JOIN made USING (content_hash)
"""


def cut_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("id", scalars.cut_bytes(F.col("text"), F.col("id") % 60).alias("cut"))


CUT_TEXTS_SQL = f"""
WITH {DOCUMENTS_SQL}
SELECT id, left(text, list_max(list_filter(range(0, id % 60 + 1), lambda k: strlen(left(text, k)) <= id % 60))) AS cut FROM docs
"""


def display_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, distance = F.col("id"), (F.col("id") % 101) / 100
    params = F.when(n % 3 == 0, F.expr("array(named_struct('name', 'a', 'type', 'T'), named_struct('name', 'b', 'type', cast(null as string)))")).otherwise(F.expr("cast(array() as array<struct<name:string,type:string>>)"))
    path = F.concat(F.when(n % 2 == 0, "/work/p/").otherwise("/work/pq/"), F.col("file_path"))
    return documents(spark, sf_dir).select(
        "id",
        scalars.display_name(F.col("function_name"), F.col("chunk_type"), F.col("context")).alias("shown"),
        scalars.similarity_text(distance).alias("similarity"),
        scalars.relative_path(path, "/work/p").alias("path"),
        scalars.signature_text(params, F.when(n % 4 == 0, "R")).alias("signature"),
        scalars.block_signature((n % 30).cast("int")).alias("block_signature"),
        scalars.line_count(n % 9, n % 20).alias("lines"),
    )


DISPLAY_SQL = f"""
WITH {DOCUMENTS_SQL}
SELECT id, function_name || CASE WHEN chunk_type = 'block' AND context IS NOT NULL THEN ' in ' || context ELSE '' END AS shown, printf('%.2f', (100 - id % 101) / 100.0::DOUBLE) AS similarity,
       CASE WHEN id % 2 = 0 THEN file_path ELSE '/work/pq/' || file_path END AS path, CASE WHEN id % 3 = 0 THEN '(a: T, b)' ELSE '()' END || CASE WHEN id % 4 = 0 THEN ' => R' ELSE '' END AS signature,
       '<block> (' || (id % 30) || ' lines)' AS block_signature, greatest(id % 20 - id % 9, 0) + 1 AS lines FROM docs
"""

CATALOG: dict[str, tuple[Query, str | None]] = {
    "scan_pairs": (scan_pairs, scan_sql()),
    "scan_top": (scan_top, scan_sql(tail=f"ORDER BY distance, a_id, b_id LIMIT {ranking.SCAN_TOP}")),
    "scan_excluded": (scan_excluded, scan_sql(f"{_SIGNATURES_KEPT} AND {_FILES_KEPT} AND {_NOT_IGNORED.format('n')}", _NOT_IGNORED.format("q"))),
    "knn_topk": (knn_topk, knn_oracle("id % 100 = 0")),
    "knn_topk_blocks": (knn_topk_blocks, knn_oracle("true")),
    "knn_topk_sql": (knn_topk_sql, knn_oracle("id % 100 = 0")),
    "threshold_join": (threshold_join, THRESHOLD_SQL),
    "query_rerank": (query_rerank, query_sql("id % 100 = 0", QUERY_LIMIT)),
    "query_excluded": (query_excluded, query_sql("true", QUERY_LIMIT, f"{_SIGNATURES_KEPT} AND {_FILES_KEPT} AND {_NOT_IGNORED.format('n')}")),
    "query_nested": (query_nested, NESTED_SQL),
    "similarity_tiers": (similarity_tiers, TIERS_SQL),
    "tier_bounds": (tier_bounds, BOUNDS_SQL),
    "content_hash": (content_hash, f"WITH {DOCUMENTS_SQL} SELECT id, content_hash FROM docs"),
    "signature_hash": (signature_hash, SIGNATURE_SQL),
    "chunk_id": (chunk_id, CHUNK_ID_SQL),
    "token_sets": (token_sets, TOKEN_SETS_SQL),
    "jaccard_pairs": (jaccard_pairs, JACCARD_SQL),
    "exclude_signature_pairs": (exclude_signature_pairs, exclude_pairs_sql(_SIGNATURES_KEPT)),
    "exclude_file_pairs": (exclude_file_pairs, exclude_pairs_sql(_FILES_KEPT)),
    "exclude_globs": (exclude_globs, GLOBS_SQL),
    "related_chunk_filter": (related_chunk_filter, RELATED_SQL),
    "related_in_file": (related_in_file, RELATED_FILE_SQL),
    "stale_exclusions": (stale_exclusions, STALE_SQL),
    "file_group_pairs": (file_group_pairs, GROUP_PAIRS_SQL),
    "file_changes": (file_changes, f"WITH {SNAPSHOTS_SQL} SELECT file_path, status FROM changes"),
    "change_counts": (change_counts, f"WITH {SNAPSHOTS_SQL} SELECT status, count(*) AS files FROM changes GROUP BY status"),
    "merge_upsert": (merge_upsert, MERGE_SQL),
    "diff_functions": (diff_functions, f"WITH {DIFF_SQL} SELECT file_path, name, status FROM diff"),
    "removed_filter": (removed_filter, REMOVED_SQL),
    "name_status_parse": (name_status_parse, NAME_STATUS_SQL),
    "worktree_list_parse": (worktree_list_parse, WORKTREES_SQL),
    "cache_split": (cache_split, f"WITH {CACHE_SQL} SELECT id, content_hash IN (SELECT content_hash FROM cache) AS hit FROM docs"),
    "cache_misses": (cache_misses, f"WITH {CACHE_SQL} SELECT DISTINCT content_hash FROM docs WHERE content_hash NOT IN (SELECT content_hash FROM cache)"),
    "cache_prune": (cache_prune, f"WITH {CACHE_SQL} SELECT content_hash FROM cache WHERE content_hash IN {_USED}"),
    "cache_prune_summary": (cache_prune_summary, f"WITH {CACHE_SQL}, m AS (SELECT content_hash IN {_USED} AS used FROM cache) SELECT count(*) AS entries_before, count(*) FILTER (NOT used) AS entries_removed, count(*) FILTER (used) AS entries_kept FROM m"),
    "exact_duplicates": (exact_duplicates, f"WITH {DOCUMENTS_SQL} SELECT content_hash, count(*) AS copies, min(id) AS first_id FROM docs GROUP BY content_hash HAVING count(*) > 1"),
    "index_status": (index_status, STATUS_SQL),
    "set_embeddings": (set_embeddings, SET_EMBEDDINGS_SQL),
    "cut_texts": (cut_texts, CUT_TEXTS_SQL),
    "display_texts": (display_texts, DISPLAY_SQL),
    "chunk_sources": (sources.chunk_sources, sources.CHUNK_SOURCES_SQL),
    "chunk_errors": (sources.chunk_errors, sources.CHUNK_ERRORS_SQL),
    "chunk_functions": (chunk_functions, None),
    "embed_documents": (embed_documents, None),
}
