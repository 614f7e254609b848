"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm.bpe import encode_documents
from tapeline.llm.common import table
from tapeline.llm.decontaminate import leak_report
from tapeline.llm.hamming import nearest_report
from tapeline.llm.jaccard import similarity_classes
from tapeline.llm.language import language_report
from tapeline.llm.pages import extract_pages
from tapeline.llm.pseudonyms import pseudonymize, secret_key
from tapeline.llm.quality import quality_report
from tapeline.llm.sharding import shard_documents
from tapeline.llm.substrings import cut_repeats


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents"), secret_key(spark), keep=["doc_id", "text"])


def op4_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_report(table(spark, sf_dir, "embeddings"), k=10)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_sharding": op1_sharding, "op2_language": op2_language, "op3_pseudonyms": op3_pseudonyms, "op4_hamming": op4_hamming, "op5_substrings": op5_substrings, "op6_bpe": op6_bpe, "op7_quality": op7_quality, "op8_main_text": op8_main_text, "op9_decontaminate": op9_decontaminate, "op10_jaccard": op10_jaccard}


#: op4: all distances of the asking rows, ranked by distance and id.
OP4_SQL = """
WITH bits AS (
  SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT a.vec_id, b.vec_id AS neighbour,
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CASE WHEN (x[1] > 0) <> (x[2] > 0) THEN 1 ELSE 0 END)) AS distance
  FROM bits a JOIN bits b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank, neighbour, distance FROM pairs
)
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(rank AS BIGINT) AS rank, CAST(neighbour AS BIGINT) AS neighbour, CAST(distance AS BIGINT) AS distance
FROM ranked WHERE rank <= 10
"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: op5: windows by their text; places that a repeated window covers.
OP5_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS MATERIALIZED (SELECT doc_id, k, array_to_string(ws[k:k + 34], ' ') AS t FROM w, unnest(range(1, len(ws) - 33)) u(k)),
twice AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, j FROM win JOIN twice USING (t), unnest(range(k, k + 35)) u(j)),
words AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(range(1, len(ws) + 1)) u(j)),
kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.j) AS kept FROM words a ANTI JOIN gone g ON g.doc_id = a.doc_id AND g.j = a.j GROUP BY a.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""

#: op9: windows of the items joined with windows of the documents by their text.
OP9_SQL = (
    r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(@, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(@, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
pat AS MATERIALIZED (SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[k:k + least(len(ws), 10) - 1], ' ') AS t FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) u(k) WHERE len(ws) > 0),
size AS (SELECT DISTINCT m FROM pat),
win AS MATERIALIZED (SELECT doc_id, m, k, array_to_string(ws[k:k + m - 1], ' ') AS t FROM w, size, unnest(range(1, len(ws) - m + 2)) u(k)),
met AS MATERIALIZED (SELECT doc_id, k, m, item_id FROM win JOIN pat USING (m, t)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM met, unnest(range(k, k + m)) u(j) GROUP BY doc_id),
names AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(names.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN names USING (doc_id)
"""
).replace("@", _FOLD)

#: op10: common shingles counted for all pairs that have one, then reachability.
OP10_SQL = (
    r"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(@, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[k:k + 3], ' ') AS t FROM w, unnest(range(1, len(ws) - 2)) u(k) WHERE len(ws) >= 4
  UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM sh a JOIN sh b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT w.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(l.y, w.doc_id)) AS component_id
FROM w LEFT JOIN size USING (doc_id) LEFT JOIN least_of l ON l.x = w.doc_id
"""
).replace("@", _FOLD)


def oracle_sql() -> dict[str, str]:
    return {"op4_hamming": OP4_SQL, "op5_substrings": OP5_SQL, "op9_decontaminate": OP9_SQL, "op10_jaccard": OP10_SQL}
