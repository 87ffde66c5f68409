"""Scopes of notes, eligible models, bundles and context over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.operators import bundles, communities, eligibility
from siltstone.plans.market import query, table

_PATH = "concat(source, CASE doc_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '/deep/' ELSE '\\' END, lang, '-', doc_id, '.md')"


@query(f"""
    WITH p AS (SELECT doc_id, {_PATH} AS path, replace({_PATH}, '\\', '/') AS f FROM documents)
    SELECT doc_id, coalesce(NOT (starts_with(f, 'src1/deep/') OR starts_with(f, 'src2/')) AND (starts_with(f, 'src1/') OR starts_with(f, 'src2/') OR starts_with(f, 'src3/') OR starts_with(f, 'src10/')), FALSE) AS in_scope,
           f LIKE 'src_/%de-%' OR regexp_matches(f, '^src1[0-2]/.*[13579][.]md$') AS evergreen FROM p""")
def note_scopes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    middle = F.when(F.col("doc_id") % 3 == 0, "/").when(F.col("doc_id") % 3 == 1, "/deep/").otherwise("\\")
    path = F.concat("source", middle, "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))
    scope = paths.in_scope(F.col("path"), ["src1", "src2", "src3/", "src10"], ["src1/deep", "src2/"])
    return docs.select("doc_id", path.alias("path")).select("doc_id", scope.alias("in_scope"), paths.matches_glob(F.col("path"), ["src?/*de-*", "src1[0-2]/*[13579].md"]).alias("evergreen"))


_MODELS = """
    ('small', array('1d', '1h'), array('AUTOMOBILE', 'BUILDING'), array('Open', 'close'), 1000, 24, 48),
    ('large', array('1d'), array('AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD'), array('open', 'high', 'volume'), 4000, 10, 30),
    ('bare', array('1d', '1h', '5m'), array('FURNITURE', 'BUILDING'), array(), 0, 5, 5)"""
_MODEL_COLUMNS = "id, intervals, asset_classes, required, min_bars, default_horizon, max_horizon"
_REQUESTS = """
    SELECT c_custkey, (['small', 'large', 'bare', 'none'])[c_custkey % 4 + 1] AS model_id, c_mktsegment AS asset_class, (['1d', '1h', '5m'])[c_custkey % 3 + 1] AS "interval",
           CAST(round(c_acctbal) AS INT) AS bars, CASE c_custkey % 5 WHEN 0 THEN ['OPEN', 'HIGH', 'CLOSE'] WHEN 1 THEN ['open', 'high', 'volume', 'close'] WHEN 2 THEN ['close', 'volume', 'open', 'high'] WHEN 3 THEN ['close'] END AS features,
           CASE WHEN c_custkey % 7 < 5 THEN CAST(c_custkey % 7 * 12 AS INT) END AS horizon FROM customer"""


def _models(spark):
    return spark.sql(f"SELECT id, intervals, asset_classes, CAST(required AS array<string>) AS required, min_bars, default_horizon, max_horizon FROM VALUES {_MODELS} AS m({_MODEL_COLUMNS})")


@query(f"""
    WITH m({_MODEL_COLUMNS}) AS (VALUES {_MODELS.replace("array()", "CAST([] AS VARCHAR[])").replace("array(", "[").replace("),\n", "@").replace("')", "']").replace("@", "),\n")}), r AS ({_REQUESTS}),
    j AS (SELECT r.*, m.*, coalesce(r.horizon, default_horizon) AS h, list_filter(required, lambda x: NOT list_contains(list_transform(coalesce(features, []), lambda y: lower(y)), lower(x))) AS lacking FROM r LEFT JOIN m ON m.id = r.model_id),
    f AS (SELECT *, CASE WHEN id IS NULL THEN 'UNKNOWN_MODEL' WHEN NOT list_contains(intervals, "interval") THEN 'UNSUPPORTED_INTERVAL' WHEN NOT list_contains(asset_classes, asset_class) THEN 'UNSUPPORTED_ASSET'
        WHEN len(lacking) > 0 THEN 'MISSING_FEATURES' WHEN coalesce(bars, 0) < min_bars THEN 'INSUFFICIENT_HISTORY' WHEN h NOT BETWEEN 1 AND max_horizon THEN 'HORIZON_OUT_OF_RANGE' END AS reason FROM j)
    SELECT c_custkey, reason, CASE WHEN reason = 'MISSING_FEATURES' THEN array_to_string(lacking, ',') END AS missing, CASE WHEN reason IS NULL THEN h END AS horizon FROM f""")
def model_eligibility(spark, sf_dir):
    k = F.col("c_custkey")
    have = F.when(k % 5 == 0, F.array(*map(F.lit, ("OPEN", "HIGH", "CLOSE")))).when(k % 5 == 1, F.array(*map(F.lit, ("open", "high", "volume", "close"))))
    have = have.when(k % 5 == 2, F.array(*map(F.lit, ("close", "volume", "open", "high")))).when(k % 5 == 3, F.array(F.lit("close")))
    requests = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.get(F.array(*map(F.lit, ("small", "large", "bare", "none"))), (k % 4).cast("int")).alias("model_id"),
        F.col("c_mktsegment").alias("asset_class"),
        F.get(F.array(*map(F.lit, ("1d", "1h", "5m"))), (k % 3).cast("int")).alias("interval"),
        F.round("c_acctbal").cast("int").alias("bars"),
        have.alias("features"),
        F.when(k % 7 < 5, (k % 7 * 12).cast("int")).alias("horizon"),
    )
    got = eligibility.eligibility(requests, _models(spark))
    return got.select("c_custkey", "reason", F.array_join("missing", ",").alias("missing"), "horizon")


@query("""
    WITH t AS (SELECT DISTINCT upper(trim(kind)) AS ticker FROM (SELECT unnest([' click', 'VIEW ', 'Purchase', 'absent', 'view', ' ']) AS kind) WHERE trim(kind) <> ''),
    s AS (SELECT upper(event_type) AS ticker, count(*) AS n, max(ts) AS most_recent_at FROM events WHERE ts >= TIMESTAMP '2024-01-25' AND event_type <> 'view' GROUP BY 1)
    SELECT ticker, coalesce(n, 0) AS available_count, most_recent_at, n IS NULL AS needs_context FROM t LEFT JOIN s USING (ticker)""")
def context_status(spark, sf_dir):
    asked = spark.createDataFrame([(x,) for x in (" click", "VIEW ", "Purchase", "absent", "view", " ")], "ticker string")
    items = table(spark, sf_dir, "events").where("event_type <> 'view'").select(F.upper("event_type").alias("ticker"), F.col("ts").alias("captured_at"))
    return bundles.context_status(asked, items, F.lit("2024-01-25").cast("timestamp"))


@query()
def bundle_truncation(spark, sf_dir):
    """Each source is a bundle: its documents are excerpts, those of one language in four evaluations. The tests fold every bundle in plain Python."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.col("lang") == "de", "evaluation").otherwise("evidence")
    items = docs.select(F.col("source").alias("bundle"), kind.alias("kind"), F.when(F.col("lang") == "de", (F.col("doc_id") % 4).cast("int")).alias("card"), F.col("doc_id").alias("at"), (F.col("n_chars") % 97).cast("double").alias("score"), "text")
    kept = bundles.truncated(items, 6000)
    return kept.select("bundle", "kind", "at", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query()
def louvain_communities(spark, sf_dir):
    """Customers' nations and the suppliers' nations of their orders; the tests hold modularity against the best of all partitions."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = lines.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count(F.lit(1)).alias("weight"))
    return communities.louvain(pairs)
