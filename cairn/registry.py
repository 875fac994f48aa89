"""Queries of the artifact operators and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cairn import oracle
from cairn.functions import paths, rules, text
from cairn.functions.dialect import DUCK, Cols, Dialect, add, nest, settle
from cairn.functions.dialect import SPARK as _SPARK
from cairn.operators import classify, dedup, discovery, frontmatter, ledger, meta, policy, reconcile, skills
from cairn.plans import pipeline
from cairn.session import table
from cairn.sources import archives, tree, virtual

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def flat(df: DataFrame) -> DataFrame:
    """Lists as text joined by '|': the same on both sides of a comparison."""
    return df.select(*(F.array_join(f.name, "|").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema.fields))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual.artifacts(table(spark, sf_dir, "documents", wide=True))


def project(name: str, steps: Sequence[Cols], columns: str, where: str | None = None, source: Callable[[SparkSession, str], DataFrame] = artifacts, sql: str = virtual.SQL) -> None:
    """Registers columns of a projection and their SQL; a column that ends in [] is a list."""
    names = [c.removesuffix("[]") for c in columns.split()]
    sql_columns = ", ".join(f"array_to_string({c[:-2]}, '|') AS {c[:-2]}" if c.endswith("[]") else c for c in columns.split())

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = add(source(spark, sf_dir), *steps)
        return flat((settle(df, where) if where else df).select(*names))

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {sql_columns} FROM ({nest(sql, *steps)}) q" + (f" WHERE {where}" if where else "")


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE[name] = sql


P = classify.PARTS
HEADER = [text.split_header, text.header_convention]

project("content_hash", [text.content_hash], "doc_id content_hash")
project("token_estimate", [text.token_estimate], "doc_id token_estimate")
project("path_parts", P, "doc_id path base ext parent depth")
project("snake_stem", [*P, paths.stem], "doc_id base snake_stem")
project("title", [*P, paths.title], "doc_id title")
project("normalize_filename", [*P, paths.filename, lambda d: {"changed": "normalized_name <> base"}], "doc_id normalized_name changed")
project("path_validity", [lambda d: {"path": "CASE WHEN doc_id % 9 = 0 THEN '/' || path WHEN doc_id % 9 = 1 THEN replace(path, '/', '//') WHEN doc_id % 9 = 2 THEN '../' || path WHEN doc_id % 9 = 3 THEN path || '/' ELSE path END"}, paths.validity], "doc_id path path_issue")
project("sharing_scope", [*P, paths.scope()], "doc_id sharing_scope")
project("namespace_resolve", [*P, classify.found, paths.stem, paths.folder, paths.scope(), paths.namespace("main", (("skills/**", "craft"), ("docs/*", "manual"))), lambda d: {"artifact_type": "'source'"}, paths.header_id], "doc_id namespace sharing_scope primitive_folder header_id")
project("artifact_id", [lambda d: {"artifact_id": f"'inv-' || substring({d.sha('path')}, 1, 16)"}], "doc_id artifact_id")
project("classify", [*P, *classify.TYPE_STEPS], "doc_id artifact_type confidence family signals[]")
project("family", [*P, classify.found, classify.family], "doc_id family")
project("signals", [*P, classify.found, classify.signals], "doc_id signals[]")
project("semantic_class", [*P, classify.semantic], "doc_id semantic_class semantic_confidence semantic_signal")
project("inventory_type", [*P, classify.inventory, classify.unknowns, classify.mime], "doc_id inventory_type inventory_confidence evidence unknowns mime_type")
project("injection_strategy", [*P, classify.strategy], "doc_id strategy line_prefix block_open block_close")
project("header_convention", HEADER, "doc_id header_convention fence_end")
project("strip_frontmatter", [text.split_header, text.stripped, lambda d: {"body_hash": d.sha("clean_body")}], "doc_id body_hash")
project("scan_profile", [*P, *HEADER, text.body_structure, lambda d: {"has_header": "fence_end > 0"}], "doc_id path size_bytes header_convention body_structure has_header")
project("extract_fields", [*HEADER, text.extract_fields], "doc_id role objective output_format model_target constraints[] validation_gates[] stop_conditions[] phase_model[] input_variables[]")
project("omit_filter", [paths.parts, policy.omit(("vendor/", "*.zzz", "!vendor/pkg/x*"))], "doc_id path omitted")
project("extension_filter", P, "doc_id path", where="lext = '.md'")
project("skill_entrypoints", [lambda d: {"path": "CASE WHEN doc_id % 10 = 0 THEN 'skills/a' || doc_id || '/SKILL.md' ELSE path END"}, paths.parts, paths.more_parts], "doc_id path", where="lbase = 'skill.md'")
project("discovery_ledger", [*P, classify.strategy, policy.omit(("vendor/",)), policy.disposition(), policy.reasons], "doc_id path disposition reason size_bytes")
project("eligible_files", [*P, classify.strategy, policy.omit(("vendor/",)), policy.disposition()], "doc_id path", where="disposition = 'eligible'")
ALLOW = ("skills/**", "docs/**/*.md", "notes/**")
project("carrier_decision", [*P, *classify.TYPE_STEPS, classify.strategy, policy.carrier(ALLOW)], "doc_id path carrier carrier_reason carrier_rule")
project("placement_plan", [*P, classify.semantic, policy.placement("out/./x")], "doc_id semantic_class layer target_directory target_path quarantined placement_namespace")
project("taxonomy_map", [*P, *classify.TYPE_STEPS, classify.taxonomy, classify.semantic, classify.inventory, classify.coarse], "doc_id artifact_type mcp_primitive callable injectable semantic_coarse inventory_coarse")
project("authority_candidates", [*P, policy.authority_candidate], "doc_id path suspicious_name", where="authority_candidate")

project("build_meta", meta.META_STEPS, "doc_id id title artifact_type mcp_primitive callable retrievable injectable namespace sharing_scope source_path content_hash token_cost_estimate authority created_or_detected_at h_family description activation_signals[] input_contract output_contract h_validation_gates[] h_stop_conditions[] h_role h_objective h_input_variables[] h_output_format h_model_target h_constraints[] h_phase_model[] governs decision_drivers applies_to_domains owner")
project("meta_v3", [*meta.META_STEPS, classify.semantic, policy.placement(), meta.flat_planes], "doc_id semantic_class semantic_confidence " + " ".join(f"{p}_{f}" for p, fields in meta.planes(DUCK).items() for f in fields))
project("v3_completeness", [*meta.META_STEPS, classify.semantic, policy.placement(), meta.complete], "doc_id complete")
project("prompt_library", meta.META_STEPS, "doc_id id h_role h_objective", where="artifact_type = 'prompt'")
project("primitive_library", meta.META_STEPS, "doc_id id artifact_type h_family", where="artifact_type <> 'prompt' AND injectable")
project("coverage_skips", [*meta.META_STEPS, lambda d: {"skip_reason": "CASE WHEN strategy = 'skip-binary' THEN 'binary' ELSE 'taxonomy_non_injectable' END"}], "doc_id path skip_reason artifact_type confidence", where="strategy = 'skip-binary' OR NOT injectable")
project("yaml_header", [*meta.META_STEPS, meta.yaml_inner, text.fenced], "doc_id yaml_header")
project("comment_block", [*meta.META_STEPS, meta.yaml_inner, text.fenced, text.comment_block], "doc_id strategy block", where="strategy IN ('line-comment', 'block-comment')")
project("verify", [*meta.META_STEPS, *meta.HEADER_STEPS, meta.checks, meta.issues], "doc_id header_valid body_preserved taxonomy_valid scope_valid prompt_complete issues[]", where="strategy <> 'skip-binary' AND injectable")
project("injection_plan", [*meta.META_STEPS, *meta.HEADER_STEPS, meta.injection], "doc_id target strategy expected_hash actual_hash would_change", where="strategy <> 'skip-binary' AND injectable")
project("inventory_records", meta.RECORD_STEPS, "doc_id " + " ".join(meta.RECORD_COLUMNS))
project("inventory_header", [*meta.RECORD_STEPS, meta.inventory_header], "doc_id id title artifact_type mcp_primitive callable retrievable injectable namespace sharing_scope source_path header_hash token_cost_estimate authority inventory_type inventory_confidence evidence_text")
FIELDS = (meta.Field("id", "artifact_id", required=True), meta.Field("kind", "inventory_type", "unknown"), meta.Field("folder", "parent", "root"), meta.Field("mime", "mime_type", required=True), meta.Field("owner", None, "nobody"), meta.Field("reviewed"))
project("schema_projection", [*meta.RECORD_STEPS, meta.schema_projection(FIELDS)], "doc_id m_id m_kind m_folder m_mime m_owner m_reviewed missing_required[]")
project("csv_rows", [*meta.RECORD_STEPS, lambda d: {"excerpt": f"'see {chr(34)}' || base || '{chr(34)}, or not'"}, meta.csv_row(("path", "base", "extension", "inventory_type", "size_bytes", "content_hash", "depth", "excerpt", "notes"))], "doc_id csv")


# --- relations: each in Spark by DataFrames, in SQL written apart ---


def originals(spark: SparkSession, sf_dir: str, wide: bool = True) -> DataFrame:
    """The documents' own texts under their virtual paths, with hashes and sizes. What is read several times isn't dealt (``wide``) each time."""
    docs = table(spark, sf_dir, "documents", wide=wide).where("doc_id IS NOT NULL")
    return add(docs.select("doc_id", "text"), virtual.artifact).select("doc_id", "path", F.coalesce("text", F.lit("")).alias("body")).select("*", F.sha2("body", 256).alias("content_hash"), F.expr("octet_length(body)").alias("size_bytes"), F.lit(False).alias("is_dir"))


ORIGINALS = f"SELECT doc_id, path, coalesce(text, '') AS body, sha256(coalesce(text, '')) AS content_hash, strlen(coalesce(text, '')) AS size_bytes FROM ({nest('SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL', virtual.artifact)})"
CLUSTERS = f"SELECT content_hash, count(*) AS n, (count(*) - 1) * min(size_bytes) AS wasted_bytes, (list(path ORDER BY length(path), path))[1] AS keeper FROM ({ORIGINALS}) GROUP BY content_hash HAVING count(*) > 1"
NEAR_T = 0.5


def _near_sql(t: float) -> str:
    return f"""
WITH d AS (SELECT content_hash AS h, any_value(body) AS body FROM ({ORIGINALS}) GROUP BY content_hash),
s AS (SELECT DISTINCT h, unnest({text.shingle_list(DUCK)}) AS g FROM d),
n AS (SELECT h, count(*) AS n FROM s GROUP BY h),
p AS (SELECT a.h AS ha, b.h AS hb, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.h < b.h GROUP BY ALL),
k AS (SELECT content_hash, (list(path ORDER BY length(path), path))[1] AS path FROM ({ORIGINALS}) GROUP BY content_hash),
j AS (SELECT ha, hb, c / (x.n + y.n - c) AS sim FROM p JOIN n x ON x.h = ha JOIN n y ON y.h = hb WHERE c / (x.n + y.n - c) >= {t})
SELECT least(a.path, b.path) AS path_a, greatest(a.path, b.path) AS path_b, floor(sim * 1000 + 0.5) / 1000 AS similarity
FROM j JOIN k a ON a.content_hash = ha JOIN k b ON b.content_hash = hb"""


register("duplicate_clusters", lambda s, d: dedup.duplicate_clusters(originals(s, d)), CLUSTERS)
register("top_clusters", lambda s, d: dedup.top_clusters(dedup.duplicate_clusters(originals(s, d))), f"{CLUSTERS} ORDER BY wasted_bytes DESC, n DESC, content_hash LIMIT 100")
register("cluster_members", lambda s, d: dedup.members(originals(s, d), dedup.duplicate_clusters(originals(s, d))), f"SELECT o.content_hash, path, path = keeper AS keeps FROM ({ORIGINALS}) o JOIN ({CLUSTERS}) c ON c.content_hash = o.content_hash")
register("recoverable_bytes", lambda s, d: dedup.recoverable(dedup.duplicate_clusters(originals(s, d))), f"SELECT count(*) AS clusters, coalesce(sum(wasted_bytes), 0)::BIGINT AS wasted_bytes FROM ({CLUSTERS})")
register("exact_twins", lambda s, d: dedup.exact_twins(originals(s, d)), f"SELECT content_hash, n, path FROM (SELECT content_hash, path, count(*) OVER (PARTITION BY content_hash) AS n FROM ({ORIGINALS})) WHERE n > 1")
register("near_duplicates", lambda s, d: dedup.near_duplicates(originals(s, d, wide=False), NEAR_T), _near_sql(NEAR_T))
register(
    "dedup_summary", lambda s, d: dedup.summary(originals(s, d, wide=False), dedup.THRESHOLD),
    f"SELECT sum(n)::BIGINT AS total, count(*) AS unique_count, count(*) FILTER (n > 1) AS twin_groups, (SELECT count(*) FROM ({_near_sql(dedup.THRESHOLD)})) AS near_pairs FROM (SELECT count(*) AS n FROM ({ORIGINALS}) GROUP BY content_hash)",
)
register("shingle_counts", lambda s, d: originals(s, d).select("doc_id", F.size(F.array_distinct(F.expr(text.shingle_list(_SPARK)))).alias("n")), f"SELECT doc_id, len(list_distinct({text.shingle_list(DUCK)})) AS n FROM ({ORIGINALS})")


def _jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against the next one by id."""
    x = originals(spark, sf_dir).select("doc_id", F.array_distinct(F.expr(text.shingle_list(_SPARK))).alias("s"))
    y = x.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t"))
    return x.join(y, "doc_id").select("doc_id", dedup.rounded(dedup.jaccard("s", "t")).alias("similarity"))


register("jaccard_pairs", _jaccard_pairs, f"""
WITH x AS (SELECT doc_id, list_distinct({text.shingle_list(DUCK)}) AS s FROM ({ORIGINALS})),
p AS (SELECT a.doc_id, len(a.s) AS n, len(b.s) AS m, len(list_intersect(a.s, b.s)) AS c FROM x a JOIN x b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, CASE WHEN n = 0 OR m = 0 THEN 0.0 ELSE floor(c / (n + m - c) * 1000 + 0.5) / 1000 END AS similarity FROM p""")

GATE = [lambda d: {"output_path": f"hint_dir || '/' || {d.ex('path', '[.][^./]*$')} || {d.text('doc_id % 400')}"}]


def _gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.gate(add(originals(spark, sf_dir), classify.domain, *GATE), "doc_id").select("doc_id", "output_path", "dedup_status")


_GATED = f"SELECT *, CASE WHEN row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 THEN 'duplicate' WHEN row_number() OVER (PARTITION BY output_path ORDER BY doc_id) > 1 THEN 'collision' ELSE 'unique' END AS dedup_status FROM ({nest(ORIGINALS, classify.domain, *GATE)})"
register("dedup_gate", _gate, f"SELECT doc_id, output_path, dedup_status FROM ({_GATED})")
TEXT_EXT = tuple("." + x for x in "cfg ini json md py toml txt yaml yml".split())
MOVE = [*P, classify.domain, lambda d: {"dest": f"CASE WHEN hint_confidence < 0.6 THEN '{rules.LOW_CONFIDENCE}' ELSE hint_dir END || '/' || base", "is_text": d.isin("lext", TEXT_EXT), "stamped": d.has("substring(body, 1, 500)", "status: active")}]
register(
    "move_map",
    lambda s, d: add(originals(s, d), *MOVE).withColumn("dedup_status", F.expr("CASE WHEN row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'unique' END")).select("path", "content_hash", "hint_type", "hint_domain", F.lit("unknown").alias("node_name"), "dest", "base", F.format_number("hint_confidence", 2).alias("confidence"), "dedup_status"),
    f"SELECT path, content_hash, hint_type, hint_domain, 'unknown' AS node_name, dest, base, printf('%.2f', hint_confidence) AS confidence, CASE WHEN row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'unique' END AS dedup_status FROM ({nest(ORIGINALS, *MOVE)})",
)
register(
    "stamp_plan",
    lambda s, d: dedup.gate(add(artifacts(s, d).withColumn("content_hash", F.sha2("body", 256)), *MOVE).withColumn("output_path", F.col("dest")), "doc_id").select("doc_id", F.expr("CASE WHEN NOT is_text THEN 'not text' WHEN dedup_status = 'duplicate' THEN 'duplicate' WHEN stamped THEN 'stamped' ELSE 'stamp' END").alias("plan")),
    f"SELECT doc_id, CASE WHEN NOT is_text THEN 'not text' WHEN row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) > 1 THEN 'duplicate' WHEN stamped THEN 'stamped' ELSE 'stamp' END AS plan FROM (SELECT *, sha256(body) AS content_hash FROM ({nest(virtual.SQL, *MOVE)}))",
)
BROKEN = [lambda d: {"source_path": "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE path END", "output_path": "CASE WHEN doc_id % 23 = 0 THEN '' ELSE path END"}]
register(
    "manifest_gate",
    lambda s, d: flat(ledger.manifest_gate(add(originals(s, d), *BROKEN), ("source_path", "content_hash", "output_path")).select("doc_id", "lacks")),
    f"SELECT doc_id, concat_ws('|', CASE WHEN coalesce(source_path, '') = '' THEN 'source_path' END, CASE WHEN coalesce(output_path, '') = '' THEN 'output_path' END) AS lacks FROM ({nest(ORIGINALS, *BROKEN)}) WHERE coalesce(source_path, '') = '' OR coalesce(output_path, '') = ''",
)

# distributions and summaries
register("type_distribution", lambda s, d: add(artifacts(s, d), *P, classify.inventory).groupBy("inventory_type").agg(F.count("*").alias("n")), f"SELECT inventory_type, count(*) AS n FROM ({nest(virtual.SQL, *P, classify.inventory)}) GROUP BY 1")
register("strategy_distribution", lambda s, d: add(artifacts(s, d), *P, *classify.TYPE_STEPS, classify.strategy).groupBy("strategy", "artifact_type").agg(F.count("*").alias("n")), f"SELECT strategy, artifact_type, count(*) AS n FROM ({nest(virtual.SQL, *P, *classify.TYPE_STEPS, classify.strategy)}) GROUP BY 1, 2")
LEDGER = [*P, classify.strategy, policy.omit(("vendor/",)), policy.disposition()]
register(
    "discovery_summary", lambda s, d: policy.discovery_summary(add(artifacts(s, d), *LEDGER)),
    f"SELECT e.disposition, e.disposition IN ({', '.join(DUCK.q(x) for x in rules.BLOCKING)}) AS blocking, count(l.doc_id) AS n FROM (SELECT unnest([{', '.join(DUCK.q(x) for x in rules.DISPOSITIONS)}]) AS disposition) e LEFT JOIN ({nest(virtual.SQL, *LEDGER)}) l USING (disposition) GROUP BY 1",
)
CHECKED = [*meta.META_STEPS, *meta.HEADER_STEPS, meta.checks, meta.issues, lambda d: {"is_binary": "strategy = 'skip-binary'", "n_issues": d.size("issues")}]
register(
    "verification_summary", lambda s, d: add(artifacts(s, d), *CHECKED).select("is_binary", "injectable", "n_issues").agg(F.expr("count_if(NOT is_binary AND injectable)").alias("total"), F.expr("count_if(NOT is_binary AND injectable AND n_issues = 0)").alias("clean"), F.expr("count_if(NOT is_binary AND injectable AND n_issues > 0)").alias("with_issues"), F.expr("coalesce(bool_and(is_binary OR NOT injectable OR n_issues = 0), true)").alias("passed")),
    f"SELECT count(*) AS total, count(*) FILTER (n_issues = 0) AS clean, count(*) FILTER (n_issues > 0) AS with_issues, coalesce(bool_and(n_issues = 0), true) AS passed FROM ({nest(virtual.SQL, *CHECKED)}) WHERE NOT is_binary AND injectable",
)
COVER = [*meta.META_STEPS, lambda d: {"fate": "CASE WHEN strategy = 'skip-binary' THEN 'binary' WHEN injectable THEN 'injected' ELSE 'non_injectable' END"}]
register(
    "coverage_summary", lambda s, d: add(artifacts(s, d), *COVER).select("fate").agg(F.count("*").alias("scanned"), *(F.expr(f"count_if(fate = '{x}')").alias(x) for x in ("injected", "binary", "non_injectable"))),
    f"SELECT count(*) AS scanned, count(*) FILTER (fate = 'injected') AS injected, count(*) FILTER (fate = 'binary') AS binary, count(*) FILTER (fate = 'non_injectable') AS non_injectable FROM ({nest(virtual.SQL, *COVER)})",
)
register(
    "metrics_counters", lambda s, d: table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.expr("count_if(value IS NULL OR isnan(value) OR value < 0)").alias("failures"), F.countDistinct("user_id").alias("users")),
    "SELECT event_type, count(*) AS calls, count(*) FILTER (value IS NULL OR isnan(value) OR value < 0) AS failures, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
register(
    "latency_percentiles", lambda s, d: table(s, d, "events").groupBy("event_type").agg(*(F.expr(f"percentile_disc(0.{p}) WITHIN GROUP (ORDER BY value)").alias(f"p{p}") for p in ("50", "95"))),
    "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1",
)

# the index and what is held against it
SUBJECTS = [*meta.META_STEPS, policy.carrier(ALLOW)]


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add(artifacts(spark, sf_dir), *SUBJECTS)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _planned(spark, sf_dir)
    subjects = df.select("path", "artifact_type", "content_hash", "id", "title", "namespace", "sharing_scope", "token_cost_estimate", "carrier")
    return ledger.index_rows(subjects)


_SUBJECTS_SQL = nest(virtual.SQL, *SUBJECTS)
_RECORDS_SQL = f"SELECT '{ledger.SCHEMA}' AS schema, path, artifact_type, content_hash, id, title, namespace, sharing_scope, token_cost_estimate, carrier FROM ({_SUBJECTS_SQL}) WHERE carrier <> 'hard_skip'"
_METADATA = ("id", "title", "namespace", "sharing_scope", "token_cost_estimate")
_LINES_SQL = f"SELECT path, to_json({{'artifact_type': artifact_type, 'carrier': carrier, 'content_hash': content_hash, 'metadata': {{{', '.join(f'{DUCK.q(c)}: {c}' for c in sorted(_METADATA))}}}, 'path': path, 'schema': schema}})::VARCHAR AS line FROM ({_RECORDS_SQL})"
register("index_records", _records, _RECORDS_SQL)
register("canonical_index", lambda s, d: ledger.canonical_lines(_records(s, d), _METADATA), _LINES_SQL)
register(
    "index_digest", lambda s, d: ledger.digest(ledger.canonical_lines(_records(s, d), _METADATA)),
    f"""WITH l AS (SELECT path, sha256(line) AS h, substring(sha256(path), 1, 6) AS b FROM ({_LINES_SQL})),
e AS (SELECT b, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY path)) AS d FROM l GROUP BY b),
f AS (SELECT substring(b, 1, 4) AS b, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY e.b)) AS d FROM e GROUP BY substring(b, 1, 4)),
g AS (SELECT substring(b, 1, 2) AS b, sum(n) AS n, sha256(string_agg(d, chr(10) ORDER BY f.b)) AS d FROM f GROUP BY substring(b, 1, 2))
SELECT coalesce(sum(n), 0)::BIGINT AS records, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM g""",
)
_STATE = "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN md5(path) ELSE content_hash END"
register(
    "drift",
    lambda s, d: ledger.drift(originals(s, d).selectExpr("path", "content_hash AS hash"), originals(s, d).selectExpr("path", f"{_STATE} AS hash").where("hash IS NOT NULL")),
    f"SELECT path, CASE WHEN a IS NULL THEN 'missing' ELSE 'stale' END AS kind, content_hash AS expected_hash, a AS actual_hash FROM (SELECT *, {_STATE} AS a FROM ({ORIGINALS})) WHERE a IS NULL OR a <> content_hash",
)
register(
    "snapshot_diff",
    lambda s, d: ledger.snapshot_diff(originals(s, d).where("doc_id % 13 <> 1"), originals(s, d).where("doc_id % 13 <> 0").withColumn("content_hash", F.expr(_STATE)), ("content_hash", "size_bytes")),
    f"SELECT path, CASE WHEN doc_id % 13 = 1 THEN 'added' WHEN doc_id % 13 = 0 THEN 'removed' ELSE 'changed' END AS change FROM ({ORIGINALS}) WHERE doc_id % 13 IN (0, 1) OR doc_id % 17 = 0",
)
register("tree_snapshot", lambda s, d: originals(s, d).select("path", F.lit("file").alias("kind"), "size_bytes", "content_hash"), f"SELECT path, 'file' AS kind, size_bytes, content_hash FROM ({ORIGINALS})")
register(
    "coverage_mismatch",
    lambda s, d: ledger.coverage_mismatch(artifacts(s, d), add(table(s, d, "labels").where("doc_id IS NOT NULL").withColumn("text", F.lit("")), virtual.artifact)),
    f"SELECT path, 'missing' AS problem FROM ({virtual.SQL}) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL) UNION ALL SELECT path, 'extra' FROM ({nest(chr(83) + 'ELECT doc_id, ' + chr(39) * 2 + ' AS text FROM labels WHERE doc_id IS NOT NULL', virtual.artifact)}) WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)",
)
register("duplicate_paths", lambda s, d: ledger.repeated(originals(s, d).withColumn("base", F.expr("lower(regexp_extract(path, '[^/]*$', 0))")).withColumn("base", F.regexp_replace("base", "[0-9]", "")), "base"), f"SELECT base, count(*) AS n FROM (SELECT regexp_replace(lower(regexp_extract(path, '[^/]*$')), '[0-9]', '', 'g') AS base FROM ({ORIGINALS})) GROUP BY 1 HAVING count(*) > 1")
INLINE = [*meta.META_STEPS, policy.carrier(ALLOW), *meta.HEADER_STEPS, meta.injection]
project("inline_plans", INLINE, "doc_id target expected_hash actual_hash would_change", where="carrier = 'inline_managed' AND strategy = 'yaml-frontmatter'")
project("operation_plan", INLINE, "doc_id path carrier carrier_rule artifact_type strategy content_hash would_change", where="carrier <> 'hard_skip'")
register(
    "mutation_intents", lambda s, d: ledger.intents(add(artifacts(s, d), *INLINE)),
    f"SELECT path, actual_hash IS NOT NULL AS expected_exists, actual_hash AS expected_state, expected_hash AS new_hash FROM ({nest(virtual.SQL, *INLINE)}) WHERE carrier = 'inline_managed' AND would_change",
)


# metadata values
def _field_rows(d: Dialect) -> dict[str, str]:
    """Existing and incoming values of some fields, made from the id and the text."""
    rows = {
        "description": ("CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE body END", "CASE WHEN doc_id % 2 = 0 THEN body || ' ' || body ELSE body END"),
        "activation_signals": ("CASE WHEN doc_id % 2 = 0 THEN 'alpha, beta' ELSE 'Unknown' END", "CASE WHEN doc_id % 4 = 0 THEN 'beta' ELSE 'beta, gamma, beta' END"),
        "content_hash": ("'stale'", d.sha("body")),
        "owner": ("NULL", "'nobody'"),
    }
    items = [d.struct({"field": f"'{f}'", "old": f"CAST({o} AS {'VARCHAR' if d.duck else 'STRING'})", "new": n}) for f, (o, n) in rows.items()]
    return {"rows": f"[{', '.join(items)}]" if d.duck else f"array({', '.join(items)})", "mark": "CASE WHEN doc_id % 11 = 0 THEN 'true' END", "superseded_by": "CASE WHEN doc_id % 31 = 0 THEN 'doc' END", "status": "CASE WHEN doc_id % 29 = 0 THEN 'Retired' ELSE 'active' END"}


FIELD_STEPS = [_field_rows, reconcile.deprecation]


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = add(originals(spark, sf_dir), *FIELD_STEPS)
    return df.select("doc_id", "path", "deprecated", F.explode("rows").alias("r")).select("doc_id", "path", "deprecated", "r.*").withColumn("has_old", F.col("old").isNotNull())


_FIELDS_SQL = f"SELECT doc_id, path, deprecated, r.field AS field, r.old AS old, r.new AS new, r.old IS NOT NULL AS has_old FROM (SELECT *, unnest(rows) AS r FROM ({nest(ORIGINALS, *FIELD_STEPS)}))"
_RECONCILED = nest(_FIELDS_SQL, reconcile.action, reconcile.explained)
register("reconcile", lambda s, d: reconcile.reconcile(_fields(s, d)).select("doc_id", "field", "action", "merged", "reason"), f"SELECT doc_id, field, action, merged, reason FROM ({_RECONCILED})")
register("reconcile_llm", lambda s, d: reconcile.reconcile_with(_fields(s, d)).select("doc_id", "field", "action", "merged", "path"), f"SELECT doc_id, field, action, merged, 'heuristic' AS path FROM ({_RECONCILED})")
register(
    "diff_log", lambda s, d: reconcile.diff_log(reconcile.reconcile(_fields(s, d))),
    f"SELECT path, string_agg('- field: ' || field || chr(10) || '  action: ' || action || chr(10) || '  old: ' || coalesce(old, 'null') || chr(10) || '  new: ' || coalesce(new, 'null'), chr(10) ORDER BY field) AS log FROM ({_RECONCILED}) GROUP BY path",
)
DESCRIBED = [lambda d: {"description": "CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'Does a thing' WHEN doc_id % 4 = 2 THEN body ELSE 'Use when a plan needs a second reader: ' || body END", "proposal": "'Use when needed: ' || body"}]
project("good_value", [*DESCRIBED, lambda d: {"good": text.good_value("description", d)}], "doc_id good")
project("use_when", [*DESCRIBED, lambda d: {"signal": f"coalesce({reconcile.use_when('description', d)}, false)"}], "doc_id signal")
project("skills_plan", [*DESCRIBED, reconcile.skills], "doc_id state revise")
project("list_union", [lambda d: {"a": "CASE WHEN doc_id % 3 = 0 THEN 'Unknown' WHEN doc_id % 7 = 0 THEN 'x, Unknown, y' ELSE 'x, y,' || doc_id % 5 END", "b": "CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'y , z,, ' || doc_id % 7 END"}, lambda d: {"joined": reconcile.union("a", "b", d)}], "doc_id joined")
project("signal_list", [lambda d: {"raw": d.rep("body", "[.!?]", ";")}, reconcile.signal_list], "doc_id parsed[]")
project("normalize_record", [lambda d: {"value": f"CASE WHEN doc_id % 3 = 0 THEN ' ' || {d.text('doc_id - 50')} WHEN doc_id % 3 = 1 THEN 'true' ELSE 'false ' END"}, meta.normalized, lambda d: {"number_text": d.text("number"), "truth_text": d.text("truth")}], "doc_id value number_text truth_text")
project("materiality_reply", [lambda d: {"field": "'description'", "old": "body", "new": "'Use when needed: ' || body", "reply": "CASE WHEN doc_id % 3 = 0 THEN ' Yes, it does' WHEN doc_id % 3 = 1 THEN 'no' END"}, reconcile.materiality], "doc_id question verdict")
project("assist_prompt", [reconcile.assist_prompt], "doc_id prompt")
SURFACE = [*P, lambda d: {"body": "CASE WHEN doc_id % 3 = 0 THEN 'run: cairn check' || " + d.char(10) + " || body WHEN doc_id % 3 = 1 THEN body || " + d.char(10) + " || 'node ./tools/verify-meta.js > out/meta.json # x-meta' ELSE body END"}, lambda d: {"suspicious_name": "doc_id % 2 = 0"}]
register("authority_evidence", lambda s, d: reconcile.authority_evidence(add(artifacts(s, d), *SURFACE)), rf"""
WITH f AS ({nest(virtual.SQL, *SURFACE)}),
k AS (SELECT * FROM (VALUES
 ('canonical_invocation', 'canonical-invocation', '(?im)(^|[\s`"])cairn([\s`"/:]|$)'),
 ('writer_invocation', 'writer-invocation', '(?im)(^|[\s`"])((python3?|node|bash|sh)\s+)?(\./)?[^\s`"]*(inject|verify)[-_]?meta[^\s`"]*'),
 ('writer_script', 'writer-name-with-write', '(?i)(writeFile(Sync)?|write_(text|bytes)\s*\(|fs\.write|yaml\.safe_dump|json\.dump|>\s*[^\n]*meta)'),
 ('legacy_marker', 'marker-x-meta', 'x-meta')) v(kind, rule, pattern)),
h AS (SELECT f.*, k.*, instr(body, regexp_extract(body, pattern)) AS pos FROM f, k WHERE regexp_matches(body, pattern)
 AND (kind <> 'writer_script' OR suspicious_name) AND (kind <> 'legacy_marker' OR regexp_matches(body, '(?i)(writeFile(Sync)?|write_(text|bytes)\s*\(|fs\.write|yaml\.safe_dump|json\.dump|>\s*[^\n]*meta)')))
SELECT path, kind, rule, len(string_split(substring(body, 1, pos - 1), chr(10))) AS line,
 substring(trim(string_split(substring(body, 1, pos - 1), chr(10))[-1] || string_split(substring(body, pos), chr(10))[1]), 1, 240) AS excerpt FROM h""")


# the cascades against SQL of another make: rules as ranked rows
for _name, _sql in (("classify", oracle.classify), ("family", oracle.family), ("signals", oracle.signals), ("semantic_class", oracle.semantic), ("inventory_type", oracle.inventory), ("injection_strategy", oracle.strategy), ("omit_filter", oracle.omitted), ("carrier_decision", oracle.carrier)):
    ORACLE[_name] = _sql(virtual.SQL)
_FIELDS = oracle.reconciled(_FIELDS_SQL)
ORACLE["reconcile"] = f"SELECT doc_id, field, action, merged, reason FROM ({_FIELDS})"
ORACLE["reconcile_llm"] = f"SELECT doc_id, field, action, merged, 'heuristic' AS path FROM ({_FIELDS})"
ORACLE["list_union"] = f"SELECT doc_id, {oracle.union_of('a', 'b')} AS joined FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' WHEN doc_id % 7 = 0 THEN 'x, Unknown, y' ELSE 'x, y,' || doc_id % 5 END AS a, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE 'y , z,, ' || doc_id % 7 END AS b FROM ({virtual.SQL}))"

PLAN = [*pipeline.steps(ALLOW, ("vendor/",)), pipeline.fate]
project("pipeline_report", PLAN, "doc_id " + " ".join(pipeline.REPORT))

# a tree with all kinds of entries; the SQL is written by itself, from the rules' own words
_ENTRIES = f"""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN '.hidden/' || path WHEN doc_id % 17 = 0 THEN 'a/node_modules/' || path WHEN doc_id % 7 = 1 THEN path || '.dat9' ELSE path END AS path,
 CASE WHEN doc_id % 23 = 0 THEN 'symlink' WHEN doc_id % 29 = 0 THEN 'other' WHEN doc_id % 19 = 0 THEN 'directory' ELSE 'file' END AS kind, doc_id % 31 = 0 AS lost, body FROM ({virtual.SQL})"""
register("tree_dispositions", lambda s, d: discovery.tree_ledger(virtual.entries(table(s, d, "documents")), ("vendor/", "*.zzz")).select("path", "kind", "disposition"), f"""
WITH e AS (SELECT *, regexp_extract(path, '[^/]*$') AS base, lower(regexp_extract(path, '[.][^./]*$')) AS ext FROM ({_ENTRIES})),
w AS (SELECT * FROM e WHERE NOT starts_with(path, '.hidden/') AND NOT starts_with(path, '.github/') AND NOT starts_with(path, 'a/node_modules/') AND NOT starts_with(path, 'vendor/'))
SELECT path, kind, CASE WHEN kind = 'symlink' THEN 'symlink' WHEN lost AND kind IN ('directory', 'other') THEN 'unreadable'
 WHEN kind = 'directory' AND ext = '.zzz' THEN 'omitted' WHEN kind = 'directory' THEN 'traversed_directory' WHEN kind = 'other' THEN 'unsupported_entry'
 WHEN ext = '.zzz' THEN 'omitted' WHEN ext = '.png' THEN 'known_binary' WHEN ext IN ('.md', '.py', '.ts', '.yaml', '.html') THEN 'eligible'
 WHEN lost THEN 'unreadable' WHEN doc_id % 3 <> 0 AND doc_id % 5 = 0 AND strlen(body) < 8192 THEN 'binary_detected'
 WHEN doc_id % 3 = 0 THEN 'unsupported_encoding' ELSE 'eligible' END AS disposition FROM w""")
register(
    "content_hash_bytes", lambda s, d: meta.inventory_records(virtual.entries(table(s, d, "documents")).where("kind = 'file'").select("path", F.lit("").alias("body"), "size_bytes", F.lit(False).alias("is_dir"), F.sha2("content", 256).alias("bytes_hash"))).select("path", "content_hash"),
    f"SELECT path, CASE WHEN NOT lost THEN sha256(CASE WHEN doc_id % 3 = 0 THEN unhex('FF') || encode(body) WHEN doc_id % 5 = 0 THEN encode(body) || unhex('00') ELSE encode(body) END) END AS content_hash FROM ({_ENTRIES}) WHERE kind = 'file'",
)
register(
    "index_parity", lambda s, d: ledger.parity(settle(_records(s, d), "token_cost_estimate % 7 <> 0"), _planned(s, d).withColumn("carrier", F.expr("CASE WHEN token_estimate % 5 = 0 THEN 'inventory_only' ELSE carrier END")).select("path", "carrier")),
    f"SELECT path, in_index, decided FROM (SELECT path, CASE WHEN carrier <> 'hard_skip' AND token_cost_estimate % 7 <> 0 THEN carrier END AS in_index, CASE WHEN token_cost_estimate % 5 = 0 THEN 'inventory_only' WHEN carrier <> 'hard_skip' THEN carrier END AS decided FROM ({_SUBJECTS_SQL})) WHERE in_index IS DISTINCT FROM decided",
)
_SKILL = "'---' || chr(10) || 'name: s' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'description: short one' || chr(10) ELSE 'description: Use when a plan needs a second reader and nobody else has time' || chr(10) END || '---' || chr(10) || text"


def _skill_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill entry points of the documents' texts, with a stand-in for a model that knows one answer."""
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").selectExpr("'skills/a' || doc_id || '/SKILL.md' AS path", f"{_SKILL.replace('chr(', 'char(')} AS body")

    def ask(questions):
        return questions.map(lambda q: "plan, review" if q and q.endswith("Signals:") else "Reads a plan line by line. Use when a plan needs a reader." if q else None)

    return skills.plan(docs, ask).select("path", "changed", "description_action", "description", F.array_join("signals", "|").alias("signals"))


register("skills_run", _skill_run, """
SELECT 'skills/a' || doc_id || '/SKILL.md' AS path, true AS changed, CASE doc_id % 3 WHEN 0 THEN 'add' WHEN 1 THEN 'revise' END AS description_action,
 CASE WHEN doc_id % 3 < 2 THEN 'Reads a plan line by line. Use when a plan needs a reader.' END AS description, 'plan|review' AS signals
FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND doc_id >= 0""")
project("confidence_number", [*P, *classify.TYPE_STEPS, classify.confidence_number], "doc_id confidence confidence_number")

# Python text surgery and bytes: no SQL beside them
register("frontmatter_inspect", lambda s, d: frontmatter.inspect_headers(artifacts(s, d), key="doc_id").drop("header"))
register("parse_header", lambda s, d: frontmatter.inspect_headers(artifacts(s, d), key="doc_id").select("doc_id", F.explode("header").alias("key", "value")))
register("text_probe", lambda s, d: tree.text_probe(artifacts(s, d).select("doc_id", F.encode("body", "UTF-8").alias("content"))).select("doc_id", "probe"), f"SELECT doc_id, CASE WHEN contains(body, chr(0)) THEN 'binary' ELSE 'text' END AS probe FROM ({virtual.SQL})")


def _zips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A zip of each document's text, by its source."""

    def run(batches):
        import io
        import zipfile

        import pandas as pd

        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(zipfile.ZipInfo(f"text/{i}.md"), t or "")
                rows.append((f"{i}.zip", data.getvalue()))
            yield pd.DataFrame(rows, columns=["path", "content"])

    return table(spark, sf_dir, "documents", wide=True).where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(run, "path string, content binary")


register("archive_members", lambda s, d: archives.expand(_zips(s, d), content=False).select("archive", "member", "depth", "size_bytes", "problem"), "SELECT doc_id || '.zip' AS archive, 'text/' || doc_id || '.md' AS member, 1 AS depth, strlen(coalesce(text, '')) AS size_bytes, NULL::VARCHAR AS problem FROM documents WHERE doc_id IS NOT NULL")


def _roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each index line read and written again."""
    inner = ", ".join(f"{c}: {'bigint' if c == 'token_cost_estimate' else 'string'}" for c in sorted(_METADATA))
    schema = f"struct<artifact_type: string, carrier: string, content_hash: string, metadata: struct<{inner}>, path: string, schema: string>"
    lines = ledger.canonical_lines(_records(spark, sf_dir), _METADATA)
    return lines.select("path", (F.to_json(F.from_json("line", schema), {"ignoreNullFields": "false"}) == F.col("line")).alias("canonical"))


register("index_roundtrip", _roundtrip, f"SELECT path, true AS canonical FROM ({_RECORDS_SQL})")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["pipeline_report"](spark, sf_dir)
