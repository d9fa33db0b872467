"""State tables derived from the driver's tables, and the same derivations in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import FORMAT, PREFIX, json_object, json_string, text_hash
from ..operators.judging import triage_rule
from ..sources.inputs import row_inputs

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _content(approvals, blockers, segment):
    return json_object(approvals=approvals.cast("string"), blockers=blockers.cast("string"), segment=json_string(segment))


def customer_signals(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return c.withColumn("blockers", (F.col("c_acctbal") < 0).cast("int")).withColumn("approvals", (F.col("c_acctbal") >= 5000).cast("int"))


def customer_inputs(spark, sf_dir) -> DataFrame:
    d = customer_signals(spark, sf_dir)
    return row_inputs(d, "c_custkey", _content(F.col("approvals"), F.col("blockers"), F.col("c_mktsegment")), F.lit("2"), text_hash(F.lit("contract-2")))


def customer_state(spark, sf_dir) -> DataFrame:
    """Judgments of an earlier version of customer: some missing, changed, stale or of an older contract."""
    d = customer_signals(spark, sf_dir).where("c_custkey % 11 <> 0")
    k = F.col("c_custkey")
    old = F.when(k % 7 == 0, 1 - F.col("approvals")).otherwise(F.col("approvals"))
    contract = F.when(k % 19 == 0, text_hash(F.lit("contract-1"))).otherwise(text_hash(F.lit("contract-2")))
    rows = row_inputs(d.withColumn("approvals", old), "c_custkey", _content(F.col("approvals"), F.col("blockers"), F.col("c_mktsegment")), F.lit("1"), F.lit(None).cast("string"))
    keyed = d.select(k.cast("string").alias("sid"), k.alias("id"), contract.alias("contract"), F.when(k % 13 == 0, "source_update").when(k % 17 == 0, "manual").alias("stale_reason"), triage_rule(F.col("blockers"), old).alias("j"))
    body = json_object(confidence=json_string(F.col("j.confidence")), decision=json_string(F.col("j.decision")))
    return rows.join(keyed, rows["subject_id"] == keyed["sid"]).select(
        "id", "subject_id", body.alias("body"), F.col("j.decision").alias("decision"), "content_hash", F.col("contract").alias("contract_hash"), "source_hash", F.col("stale_reason").isNotNull().alias("stale"), "stale_reason", F.col("id").alias("updated_at")
    )


def _sql_content(approvals: str) -> str:
    return f"""'{{"approvals":' || ({approvals})::varchar || ',"blockers":' || blockers::varchar || ',"segment":"' || c_mktsegment || '"}}'"""


def _sql_identity(kind: str, text: str) -> str:
    return f"""'{PREFIX}' || sha256('{{"format":"{FORMAT}","kind":"{kind}","value":' || {text} || '}}')"""


SQL = f"""
signals AS (SELECT c_custkey, c_mktsegment, (c_acctbal < 0)::int AS blockers, (c_acctbal >= 5000)::int AS approvals FROM customer),
inputs AS (SELECT c_custkey::varchar AS subject_id, c_custkey AS k, {_sql_identity("semantic_content", _sql_content("approvals"))} AS content_hash, sha256('contract-2') AS contract_hash,
  {_sql_identity("semantic_source", "'[' || " + _sql_content("approvals") + " || ',2]'")} AS source_hash FROM signals),
olds AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 1 - approvals ELSE approvals END AS o FROM signals WHERE c_custkey % 11 <> 0),
judgments AS (SELECT c_custkey::varchar AS subject_id, c_custkey AS id,
  CASE WHEN blockers > 0 THEN 'flag' WHEN o > 0 THEN 'pass' ELSE 'unclear' END AS decision,
  {_sql_identity("semantic_content", _sql_content("o"))} AS content_hash,
  CASE WHEN c_custkey % 19 = 0 THEN sha256('contract-1') ELSE sha256('contract-2') END AS contract_hash,
  {_sql_identity("semantic_source", "'[' || " + _sql_content("o") + " || ',1]'")} AS source_hash,
  CASE WHEN c_custkey % 13 = 0 THEN 'source_update' WHEN c_custkey % 17 = 0 THEN 'manual' END AS stale_reason FROM olds),
verdicts AS (SELECT i.subject_id, i.k, j.decision, CASE
    WHEN i.content_hash = j.content_hash AND i.contract_hash = j.contract_hash AND j.stale_reason IS NULL THEN 'content_hash_match'
    WHEN i.content_hash = j.content_hash AND i.contract_hash = j.contract_hash AND j.stale_reason = 'source_update' THEN 'revalidated_after_benign_update' END AS freshness_basis,
  CASE WHEN i.contract_hash <> j.contract_hash THEN 'contract_changed' ELSE coalesce(j.stale_reason, 'content_revalidation_pending') END AS why
  FROM inputs i JOIN judgments j USING (subject_id)),
current_rows AS (SELECT subject_id, k, decision, freshness_basis IS NOT NULL AS is_fresh, CASE WHEN freshness_basis IS NULL THEN why END AS stale_reason, freshness_basis FROM verdicts),
states AS (SELECT i.subject_id, i.k, CASE WHEN c.is_fresh AND c.decision = 'flag' THEN 'fresh_match' WHEN c.is_fresh THEN 'fresh_non_match' WHEN i.k % 5 = 0 THEN 'in_flight' WHEN c.is_fresh IS NULL THEN 'missing' ELSE 'stale' END AS state, c.stale_reason AS why
  FROM inputs i LEFT JOIN current_rows c USING (subject_id)),
jobs AS (SELECT o_orderkey AS id, 'task_' || substr(o_orderpriority, 1, 1) AS task, o_custkey AS subject, CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'complete' END WHEN 'O' THEN 'queued' ELSE CASE WHEN o_orderkey % 9 = 0 THEN 'cancel_requested' ELSE 'running' END END AS status,
  o_orderdate AS created_at, o_orderkey % 3 AS retries, o_orderkey % 600 AS queue_ms, o_orderkey % 3600 AS run_ms, o_orderkey % 600 + o_orderkey % 3600 + o_orderkey % 7 AS total_ms FROM orders),
receipts AS (SELECT l_orderkey AS job_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS attempt, (l_quantity * 100)::bigint AS generate_ms, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'passed' END AS validation, l_linestatus FROM lineitem),
cases AS (SELECT d.doc_id, lang, source, d.n_chars, quality::varchar AS expected, toxic, v.variant,
  CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.n_chars > v.floor THEN '1' ELSE '0' END AS observed, d.doc_id % 6 = 0 AS escalated, (d.doc_id % 900 + 100)::bigint AS latency_ms
  FROM labels l JOIN documents d USING (doc_id), (VALUES ('baseline', 200), ('candidate', 800)) v(variant, floor)),
pairs AS (SELECT a.p_partkey AS left_id, b.p_partkey AS right_id, a.p_partkey::varchar || ':' || b.p_partkey::varchar AS subject_id, (a.p_brand = b.p_brand)::int AS shared, (a.p_type <> b.p_type)::int AS conflicting
  FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey),
must AS (SELECT p_partkey AS left_id, nxt AS right_id FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part) WHERE nxt IS NOT NULL AND p_partkey % 4 <> 0),
cannot AS (SELECT p_partkey AS left_id, nxt AS right_id FROM (SELECT p_partkey, lead(p_partkey, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nxt FROM part) WHERE nxt IS NOT NULL AND p_partkey % 3 = 0)
"""


def jobs(spark, sf_dir) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", F.when(k % 10 == 0, "failed").otherwise("complete")).when(F.col("o_orderstatus") == "O", "queued").otherwise(F.when(k % 9 == 0, "cancel_requested").otherwise("running"))
    return o.select(k.alias("id"), F.concat(F.lit("task_"), F.substring("o_orderpriority", 1, 1)).alias("task"), F.col("o_custkey").alias("subject"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (k % 3).alias("retries"), (k % 600).alias("queue_ms"), (k % 3600).alias("run_ms"), (k % 600 + k % 3600 + k % 7).alias("total_ms"))


def receipts(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    d = table(spark, sf_dir, "lineitem").withColumn("attempt", F.row_number().over(order))
    return d.select(F.col("l_orderkey").alias("job_id"), "attempt", F.when(F.col("attempt") == 1, "cheap").otherwise("strong").alias("role"), (F.col("l_quantity") * 100).cast("bigint").alias("generate_ms"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("passed").alias("validation"), "l_linestatus")


def cases(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id")
    v = d.withColumn("v", F.explode(F.array(F.struct(F.lit("baseline").alias("variant"), F.lit(200).alias("floor")), F.struct(F.lit("candidate").alias("variant"), F.lit(800).alias("floor")))))
    seen = F.when(F.col("doc_id") % 17 == 0, None).when(F.col("n_chars") > F.col("v.floor"), "1").otherwise("0")
    return v.select("doc_id", "lang", "source", "n_chars", F.col("quality").cast("string").alias("expected"), "toxic", "v.variant", seen.alias("observed"), (F.col("doc_id") % 6 == 0).alias("escalated"), (F.col("doc_id") % 900 + 100).alias("latency_ms")).withColumn("abstained", F.col("observed") == "0")


def pairs(spark, sf_dir) -> DataFrame:
    from ..sources.inputs import candidate_pairs

    c = candidate_pairs(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_size", carried=("p_brand", "p_type"))
    return c.select("subject_id", "left_id", "right_id", (F.col("left_p_brand") == F.col("right_p_brand")).cast("int").alias("shared"), (F.col("left_p_type") != F.col("right_p_type")).cast("int").alias("conflicting"))


def _following(spark, sf_dir, by: int) -> DataFrame:
    """(left_id, right_id): each part and the one that follows it by so many places within its brand."""
    from pyspark.sql import Window

    nxt = F.lead("p_partkey", by).over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("left_id"), nxt.alias("right_id")).where("right_id is not null")


def must_links(spark, sf_dir) -> DataFrame:
    return _following(spark, sf_dir, 1).where("left_id % 4 <> 0")


def cannot_links(spark, sf_dir) -> DataFrame:
    return _following(spark, sf_dir, 2).where("left_id % 3 = 0")
