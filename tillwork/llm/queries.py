"""The registered queries of this subpackage, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwork.llm import bisector_clusters, dag_manifest, rank_bpe
from tillwork.llm.decontamination import contamination
from tillwork.llm.embedding_join import similar_vectors
from tillwork.llm.hmm import score
from tillwork.llm.hyperminhash import near_duplicates
from tillwork.llm.language_id import identify, learn_languages
from tillwork.llm.license_scan import scan as scan_licenses
from tillwork.llm.merkle import audit, manifest
from tillwork.llm.packing import cut_documents, pack
from tillwork.llm.secret_scan import scan
from tillwork.llm.training_order import read_shards, write_shards
from tillwork.sources.scratch import new_path


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def op1_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return scan_licenses(_table(spark, root, "documents")).drop("spans")


def op2_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return pack(cut_documents(_table(spark, root, "documents"))).drop("ids")


def op3_embedding_join(spark: SparkSession, root: str) -> DataFrame:
    return similar_vectors(_table(spark, root, "embeddings"))


def op4_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = _table(spark, root, "documents")
    return identify(docs, learn_languages(docs))


def op5_hidden_markov(spark: SparkSession, root: str) -> DataFrame:
    return score(_table(spark, root, "documents"))


def op6_merkle_audit(spark: SparkSession, root: str) -> DataFrame:
    """The pages against a replica in which some have lost their last character and some are gone."""
    pages = _table(spark, root, "pages")
    damaged = F.concat(F.expr("substr(html, 1, char_length(html) - 1)"), F.lit("~"))
    held = F.when(F.col("page_id") % 97 == 13, damaged).otherwise(F.col("html"))
    replica = pages.where("page_id % 389 <> 7 OR page_id IS NULL").withColumn("html", held)
    return audit(manifest(pages), manifest(replica))


def op7_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return scan(_table(spark, root, "documents"))


def op8_hyperminhash(spark: SparkSession, root: str) -> DataFrame:
    # The contract's shingles have four words.
    return near_duplicates(_table(spark, root, "documents"), words=4)


def op9_training_order(spark: SparkSession, root: str) -> DataFrame:
    path = new_path(spark, "shards")
    write_shards(_table(spark, root, "documents"), path)
    return read_shards(spark.read.parquet(path))


def op10_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return contamination(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


def op11_bpe_round_trip(spark: SparkSession, root: str) -> DataFrame:
    documents = _table(spark, root, "documents").select("doc_id", "text")
    found = rank_bpe.encoded(documents, back="decoded")
    return found.select("doc_id", *rank_bpe.digests(found))


def op12_dag_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Proofs of all documents; those of every third id (by crc32) are checked with a tampered text."""
    docs = _table(spark, root, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = dag_manifest.leaf_of(docs, text=dag_manifest.lower_cased(docs["text"]))
    leaves = docs.select(
        "doc_id", "lang", dag_manifest.leaf_of(docs).alias("leaf"), F.when(tampered, changed).alias("presented"))
    proved = dag_manifest.proofs(dag_manifest.build(leaves))
    checked = proved.select(
        "doc_id", "leaf", "subroot", "root",
        dag_manifest.digest(dag_manifest.siblings_of(F.col("path"))).alias("proof_sha256"),
        dag_manifest.folded(F.coalesce("presented", "leaf"), F.col("path")).alias("folded_root"))
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_bisector_clusters(spark: SparkSession, root: str) -> DataFrame:
    found = bisector_clusters.cluster(_table(spark, root, "embeddings"))
    numbers = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return bisector_clusters.with_inertia(found).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(numbers.cast("binary"), 256).alias("centroid_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_embedding_join": op3_embedding_join,
    "op4_language_id": op4_language_id,
    "op5_hidden_markov": op5_hidden_markov,
    "op6_merkle_audit": op6_merkle_audit,
    "op7_secret_scan": op7_secret_scan,
    "op8_hyperminhash": op8_hyperminhash,
    "op9_training_order": op9_training_order,
    "op10_decontamination": op10_decontamination,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_dag_manifest": op12_dag_manifest,
    "op13_bisector_clusters": op13_bisector_clusters,
}

_PAGES = """
WITH page AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
         CASE WHEN page_id % 97 = 13 THEN left(html, length(html) - 1) || '~' ELSE html END AS held
  FROM pages),
record AS (
  SELECT page_id,
         'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
           || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS gap, html, held
  FROM page),
hashed AS (
  SELECT page_id, strlen(head || strlen(html) || gap || html || gap) AS size,
         sha256(head || strlen(html) || gap || html || gap) AS primary_hash,
         sha256(head || strlen(held) || gap || held || gap) AS replica_hash
  FROM record),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY page_id, primary_hash) - 1 AS record_no,
         coalesce(sum(size) OVER (ORDER BY page_id, primary_hash
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM hashed)
SELECT record_no, "offset", size, page_id, primary_hash,
       CASE WHEN page_id % 389 = 7 THEN NULL ELSE replica_hash END AS replica_hash,
       CASE WHEN page_id % 389 = 7 THEN 'missing' ELSE 'corrupt' END AS status
FROM numbered
WHERE page_id % 389 = 7 OR primary_hash <> replica_hash
"""

_DECONTAMINATION = """
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k,
         array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS s FROM item WHERE len(w) > 0)),
width AS (SELECT DISTINCT k FROM win),
place AS (
  SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM doc, width WHERE len(w) >= k),
found AS (
  SELECT doc_id, item_id, s, win.k
  FROM place JOIN win ON win.k = place.k AND win.phrase = array_to_string(w[s:s + place.k - 1], ' ')),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM found) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_NEAR_DUPLICATES = """
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS s FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingle x JOIN shingle y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b
  WHERE 100 * c >= 80 * (s.n + t.n - c)),
reach AS (
  SELECT a AS doc_id, a AS other FROM link
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other),
component AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, doc_id) AS component_id,
       coalesce(low, doc_id) = doc_id AS kept
FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN component USING (doc_id)
"""

_VECTORS = """
WITH RECURSIVE vec AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM vec x JOIN vec y
  ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND list_dot_product(x.v, y.v)
    / (sqrt(list_dot_product(x.v, x.v)) * sqrt(list_dot_product(y.v, y.v))) >= 0.9),
reach AS (
  SELECT a AS vec_id, a AS other FROM link
  UNION
  SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other),
component AS (SELECT vec_id, min(other) AS low FROM reach GROUP BY vec_id),
degree AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(low, vec_id) AS component_id,
       coalesce(low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degree USING (vec_id) LEFT JOIN component USING (vec_id)
"""

def _field(column: str) -> str:
    value = f"{column}::VARCHAR"
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


_HEAD = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))

# The remainders of CRC-32 are made from its polynomial. A tree is named by its language, the one
# above them by 'top'; the path of a leaf runs through both.
_MANIFEST = f"""
WITH RECURSIVE remainder AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) AS r(i)),
crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
             string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
           lambda c, b: xor(c >> 8, t[((xor(c, b)) & 255) + 1])), 4294967295::BIGINT) AS crc
  FROM documents, remainder),
leaf AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_HEAD} || {_field("text")}) AS h,
         CASE WHEN crc % 3 = 0 THEN sha256({_HEAD} || {_field(
             "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})
              ELSE sha256({_HEAD} || {_field("text")}) END AS shown
  FROM crc),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS no FROM leaf),
level AS (
  SELECT 0 AS lvl, tree, no, h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT lvl + 1, tree, no, h, count(*) OVER (PARTITION BY tree) FROM (
    SELECT lvl, tree, no // 8 AS no, sha256(string_agg(h, '' ORDER BY no)) AS h
    FROM level WHERE n > 1 GROUP BY lvl, tree, no // 8)),
subroot AS MATERIALIZED (
  SELECT tree, h, lvl, row_number() OVER (ORDER BY tree) - 1 AS no FROM level WHERE n = 1),
above AS (
  SELECT 0 AS lvl, no, h, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT lvl + 1, no, h, count(*) OVER () FROM (
    SELECT lvl, no // 8 AS no, sha256(string_agg(h, '' ORDER BY no)) AS h
    FROM above WHERE n > 1 GROUP BY lvl, no // 8)),
node AS MATERIALIZED (
  SELECT s.tree, level.lvl AS step, level.no, level.h FROM level JOIN subroot s USING (tree) WHERE n > 1
  UNION ALL
  SELECT s.tree, s.lvl + above.lvl, above.no, above.h FROM above, subroot s WHERE n > 1),
place AS (
  SELECT p.doc_id, p.tree, p.no AS leaf_no, 0 AS step, p.no, p.shown AS h, s.lvl, s.no AS top_no, '' AS proof
  FROM placed p JOIN subroot s USING (tree)
  UNION ALL
  SELECT any_value(place.doc_id), place.tree, place.leaf_no, place.step + 1,
         any_value(CASE WHEN place.step + 1 = place.lvl THEN place.top_no
                        WHEN place.step = place.lvl THEN place.top_no // 8 ELSE place.no // 8 END),
         sha256(string_agg(CASE WHEN node.no = place.no THEN place.h ELSE node.h END, '' ORDER BY node.no)),
         any_value(place.lvl), any_value(place.top_no),
         any_value(place.proof) || coalesce(string_agg(node.h, '' ORDER BY node.no) FILTER (node.no <> place.no), '')
  FROM (SELECT place.* REPLACE (CASE WHEN step = lvl THEN top_no ELSE no END AS no) FROM place) AS place
  JOIN node ON node.tree = place.tree AND node.step = place.step AND node.no // 8 = place.no // 8
  GROUP BY place.tree, place.leaf_no, place.step),
last AS (SELECT tree, leaf_no, arg_max(h, step) AS folded_root, arg_max(proof, step) AS proof FROM place GROUP BY ALL)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, folded_root,
       folded_root = r.h AS verified
FROM placed p JOIN subroot s USING (tree) JOIN last ON last.tree = p.tree AND last.leaf_no = p.no,
     (SELECT h FROM above WHERE n = 1) AS r
"""


def _clusters(clusters: int, rounds: int) -> str:
    """The rounds written out: distances of all pairs, then floored means by component."""
    ctes = [f"""
vec AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v
  FROM (SELECT * FROM vec ORDER BY sha256('2:' || vec_id) LIMIT {clusters}))"""]
    for k in range(rounds + 1):
        ctes.append(f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, any_value(vec.v) AS v, min({{'d': (list_dot_product(vec.v, vec.v) - 2 * list_dot_product(vec.v, c.v)
           + list_dot_product(c.v, c.v))::BIGINT, 'c': c.c}}) AS best
  FROM vec, c{k} AS c GROUP BY vec_id)""")
        if k < rounds:
            ctes.append(f"""
c{k + 1} AS MATERIALIZED (
  SELECT old.c, coalesce(new.v, old.v) AS v
  FROM c{k} AS old LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS v FROM (
      SELECT best.c AS c, i, sum(v[i]::BIGINT) AS s, count(*) AS n FROM a{k}, range(1, 65) AS r(i) GROUP BY ALL)
    GROUP BY c) AS new ON new.c = old.c)""")
    return "WITH" + ",".join(ctes) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance,
       (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON c.c = best.c
"""


SQL: dict[str, str] = {
    "op3_embedding_join": _VECTORS,
    "op6_merkle_audit": _PAGES,
    "op8_hyperminhash": _NEAR_DUPLICATES,
    "op10_decontamination": _DECONTAMINATION,
    "op12_dag_manifest": _MANIFEST,
    "op13_bisector_clusters": _clusters(bisector_clusters.CLUSTERS, bisector_clusters.ROUNDS),
}
