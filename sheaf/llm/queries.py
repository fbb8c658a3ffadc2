"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import fingerprints, lines, mixing, neardup, packing, pii, quality, search, secrets, toxicity
from sheaf.llm.common import checkpoint_dir
from sheaf.session import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark, f"{checkpoint_dir(spark)}/sheaf-ledger-{uuid.uuid4().hex}")
    return secrets.digest(table(spark, sf_dir, "documents"), ledger)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents")))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "n_lines", "n_removed")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": op1_near_dedup,
        "op2_secret_scans": op2_secret_scans,
        "op3_mixing": op3_mixing,
        "op4_line_dedup": op4_line_dedup,
        "op5_packing": op5_packing,
        "op6_top_k": op6_top_k,
        "op7_pii": op7_pii,
        "op8_toxicity": op8_toxicity,
        "op9_quality": op9_quality,
        "op10_fingerprints": op10_fingerprints,
    }


#: Ten best integer inner products of each query; ties to the smaller vec_id.
OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The rules of the secret scan in the other engine's syntax; \\b stands for a look behind.
_SECRETS = {
    "assign": "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "private_key": "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----",
    "github": r"\bgh[oprsu]_[A-Za-z0-9]{36,}",
}
_VALUE = r"""^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?"""
#: Every rule's matches with the text between them; places are sums of both lengths.
OP2_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {place} AS place, '{kind}' AS kind, unnest(m) AS found, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS g FROM d)"
        for place, (kind, p) in enumerate(_SECRETS.items())
    )
    + "), s AS (SELECT doc_id, place, kind, found, (sum(length(gap) + length(found)) OVER (PARTITION BY doc_id, place ORDER BY i))::BIGINT AS \"end\" FROM m), "
    + f"t AS (SELECT doc_id, place, kind, \"end\" - length(found) AS start, kind || ':' || (\"end\" - length(found)) || ':' || \"end\" AS said FROM s WHERE kind <> 'assign' OR length(regexp_replace(found, '{_VALUE}', '')) >= 6), "
    + "a AS (SELECT doc_id, "
    + ", ".join(f"count_if(kind = '{k}')::BIGINT AS n_{k}" for k in secrets.BASE)
    + ", string_agg(said, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(said, ',' ORDER BY start, place) AS spans FROM t GROUP BY doc_id) "
    + "SELECT doc_id, "
    + ", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secrets.BASE)
    + ", sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(text) AS blob_sha256 FROM d LEFT JOIN a USING (doc_id)"
)

#: Lines on five sites or more go, but for their first place.
OP4_SQL = f"""
WITH l AS (SELECT doc_id, text, coalesce(source, '') AS site, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM (SELECT *, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS key FROM l),
b AS (SELECT key, min((doc_id, place)) AS first FROM k WHERE length(key) >= {lines.MIN_CHARS} GROUP BY key HAVING count(DISTINCT site) >= {lines.MIN_SITES}),
r AS (SELECT k.*, coalesce((doc_id, place) <> first, false) AS gone FROM k LEFT JOIN b USING (key))
SELECT doc_id, CASE WHEN any_value(text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '') END AS text,
  CASE WHEN any_value(text) IS NULL THEN 0 ELSE count(*) END::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_removed
FROM r GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scans": OP2_SQL, "op4_line_dedup": OP4_SQL, "op6_top_k": OP6_SQL}
