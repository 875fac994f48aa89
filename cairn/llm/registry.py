"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import encode
from .common import table
from .crf import assess
from .dac import encode_tokens
from .langid import identify
from .licenses import licenses
from .ngram_join import similar_classes
from .packing import pack
from .secrets import scan
from .unigram import token_counts
from .winnow import fingerprints

Query = Callable[[SparkSession, str], DataFrame]



def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", wide=True)


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": lambda s, d: encode(_texts(s, d)),
    "op2_ngram_join": lambda s, d: similar_classes(table(s, d, "documents")),
    "op3_fingerprints": lambda s, d: fingerprints(_texts(s, d)),
    "op4_quality_rules": lambda s, d: assess(_texts(s, d), table(s, d, "labels")),
    "op5_language_id": lambda s, d: identify(_texts(s, d)),
    "op6_token_counts": lambda s, d: token_counts(_texts(s, d)),
    "op7_license_scans": lambda s, d: licenses(_texts(s, d)),
    "op8_packing": lambda s, d: pack(_texts(s, d)),
    "op9_token_codes": lambda s, d: encode_tokens(_texts(s, d)),
    "op10_secret_scans": lambda s, d: scan(_texts(s, d)),
}

_WORDS = r"list_filter(string_split_regex(lower(text), '[^0-9a-z\x{80}-\x{10FFFF}]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op2_ngram_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS s FROM g GROUP BY doc_id),
r AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY s) AS rep FROM s),
h AS (SELECT g.doc_id, g.g, r.n FROM g JOIN r ON r.doc_id = g.doc_id WHERE r.rep = r.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM h a JOIN h b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
      HAVING count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.5),
c(x, root) AS (SELECT DISTINCT rep, rep FROM r UNION SELECT p.y, c.root FROM c JOIN p ON p.x = c.x),
k AS (SELECT x, min(root) AS class_id FROM c GROUP BY x),
l AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(l.n_links, 0) AS n_links
FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.x = r.rep LEFT JOIN l ON l.x = r.rep""",
}
