from decimal import Decimal

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidentia.functions import identity, jsonx
from evidentia.operators import actions, freshness, graph, observability, planning, queue
from evidentia.sources.inputs import bounded
from evidentia.streaming import changes

json_values = st.recursive(st.none() | st.booleans() | st.integers(-1000, 1000) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@given(json_values)
def test_canonical_text_is_idempotent_and_holds_itself(value):
    import json

    parsed = jsonx.loads(json.dumps(value))
    text = jsonx.canonical(parsed)
    assert jsonx.canonical(jsonx.loads(text)) == text
    assert jsonx.contains(parsed, parsed)
    assert jsonx.difference(parsed, parsed) == []


def test_numbers_and_violations():
    assert jsonx.canonical(jsonx.loads('{"b":1.50,"a":[1.0,1e2]}')) == '{"a":[1,100],"b":1.5}'
    assert jsonx.violations(jsonx.loads('{"a":2,"z":1}'), {"type": "object", "required": ["b"], "additionalProperties": False, "properties": {"a": {"type": "integer", "maximum": 1}}}) == ["$.b:required", "$.a:range", "$.z:additional"]
    assert jsonx.evidence_counts({"a": ["x", "y"], "b": " ", "c": True, "d": Decimal(0)}, ("a", "b", "c", "d", "e")) == {"a": 2, "b": 0, "c": 1, "d": 1, "e": 0}


@pytest.mark.parametrize(
    ("content", "contract", "source", "stale", "reason", "expected"),
    [
        (True, True, True, False, None, (True, None, "mvcc_match")),
        (True, True, False, False, None, (True, None, "content_hash_match")),
        (True, True, False, True, "source_update", (True, None, "revalidated_after_benign_update")),
        (True, True, True, True, "manual", (False, "manual", None)),
        (True, False, True, False, None, (False, "contract_changed", None)),
        (False, True, True, False, None, (False, "content_revalidation_pending", None)),
        (True, True, True, False, "semantic_correction", (True, None, "manual_correction")),
        (True, True, False, False, "semantic_correction", (False, "semantic_correction", None)),
    ],
)
def test_freshness_table(spark, content, contract, source, stale, reason, expected):
    row = spark.range(1).select(freshness.freshness(F.lit(content), F.lit(contract), F.lit(source), F.lit(stale), F.lit(reason).cast("string")).alias("f")).first()["f"]
    assert tuple(row) == expected


def test_plan_paths(spark):
    counts = spark.createDataFrame([(0, 0, 0, 0, 0), (5, 5, 0, 0, 0), (5, 3, 1, 1, 0), (5, 4, 0, 0, 1)], "total long, fresh long, stale long, missing long, inflight long")
    assert [r["path"] for r in planning.plan(counts).collect()] == ["lookup", "lookup", "bounded_infer_now", "wait_for_refresh"]
    assert {r["path"] for r in planning.plan(counts, force=True).collect()} == {"lookup_fail_closed"}
    assert planning.plan(counts.limit(3), max_rows=0).collect()[2]["path"] == "queue_refresh"


def test_caps_refuse(spark):
    with pytest.raises(ValueError):
        bounded(spark.range(11), 10)
    edges = spark.createDataFrame([(1, 2), (2, 3)], "left_id long, right_id long")
    assert graph.conflicts(edges, spark.createDataFrame([(1, 3), (1, 9)], "left_id long, right_id long")).orderBy("right_id").collect() == [(1, 3, "conflict"), (1, 9, "consistent")]
    assert graph.conflicts(edges, edges, most_cannot=1).first()["status"] == "analysis_limit_exceeded"


def test_key_change_and_backoff(spark):
    d = spark.createDataFrame([("t", "a", "b", 1, 1), ("t", None, "c", 1, 2), ("t", "d", None, 1, 3)], "table string, old_id string, new_id string, ts long, seq long")
    assert sorted((r["subject_id"], r["reason"]) for r in changes.split_key_changes(d).collect()) == [("a", "source_delete"), ("b", "source_update"), ("c", "source_update"), ("d", "source_delete")]
    assert [r[0] for r in spark.range(1, 6).select(changes.backoff_ms(F.col("id"), 100, 800)).collect()] == [100, 200, 400, 800, 800]


def test_stream_drops_late_rows_and_counts(spark, tmp_path):
    """Three batches: the second moves the watermark beyond the first window, so that the third's row in it is dropped."""
    schema = "ts timestamp, kind string"
    batches = [["2024-01-01 00:10:00", "2024-01-01 00:50:00"], ["2024-01-01 05:10:00"], ["2024-01-01 00:20:00", "2024-01-01 05:20:00"], ["2024-01-01 09:00:00"]]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for k, times in enumerate(batches):
        spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts"), F.lit("a").alias("kind")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = changes.tumbling(stream, "1 hour", "10 minutes").writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = sorted((str(r["start"])[11:16], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("00:00", 2), ("05:00", 2)]  # three rows fell into the first hour; the late one is not counted


def test_changes_coalesce_in_a_stream(spark, tmp_path):
    """One pending row a subject, kept as state over micro-batches: its latest reason, and how many changes it stands for."""
    schema = "table string, subject_id string, reason string, ts timestamp, seq long"
    (tmp_path / "in").mkdir()
    stream = changes.coalesced(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    seen = {}

    def sink(batch, _):
        seen.update({r["subject_id"]: (r["reason"], r["generation"]) for r in batch.collect()})

    for rows in ([("t", "a", "source_update", 1), ("t", "b", "source_update", 2)], [("t", "a", "source_delete", 3)], [("t", "a", "source_update", 2)]):
        spark.createDataFrame([(t, i, r, f"2024-01-01 00:00:0{n}", n) for t, i, r, n in rows], "table string, subject_id string, reason string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(60)
    assert seen == {"a": ("source_delete", 3), "b": ("source_update", 1)}  # the late change counts and decides nothing


def test_sessions_by_gap(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-01 00:00:00")], "u string, t string").select("u", F.col("t").cast("timestamp").alias("ts"))
    assert sorted((r["u"], r["n"]) for r in changes.sessions(rows, "u", "10 minutes").collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_claim_takes_turns_and_takes_over_expired_leases(spark):
    rows = [(i, "ab"[i > 7], "queued", f"2024-01-01 00:00:{i:02}", 0, None) for i in range(10)]
    rows += [(20, "b", "running", "2024-01-02 00:00:00", 1, "2024-01-01 00:00:00"), (21, "b", "running", "2023-01-01 00:00:00", 1, "2025-01-01 00:00:00"), (22, "c", "cancel_requested", "2024-01-01 00:00:00", 2, None), (23, "c", "complete", "2020-01-01 00:00:00", 0, None)]
    jobs = spark.createDataFrame(rows, "id long, task string, status string, created_at string, retries int, leased_until string").withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "leased_until")})
    as_of = F.lit("2024-01-03 00:00:00").cast("timestamp")
    ids = lambda **o: [r["id"] for r in queue.claim(jobs, 6, as_of, **o).orderBy("job_rank", "task_rank").collect()]
    assert ids() == [0, 20, 22, 1, 8, 2]
    assert ids(cursor="a") == [20, 22, 0, 8, 1, 9] and ids(slots=2) == [0, 20] and ids(slots=0) == []
    got = queue.claim(jobs, 9, as_of, lease=60_000).where("id = 20").first()
    assert got["fence"] == 2 and str(got["leased_until"]) == "2024-01-03 00:01:00"


def test_lease_and_attempt(spark):
    row = spark.range(1).select(queue.attempt_ms(F.lit(None).cast("long"), 500).alias("a"), queue.attempt_ms(F.lit(-3), 500).alias("b"), queue.attempt_ms(F.lit(900), 500).alias("c"), queue.lease_ms(F.lit(10), F.lit(20)).alias("d"), queue.lease_ms(F.lit(90_000), F.lit(20)).alias("e")).first()
    assert tuple(row) == (500, 1, 500, 30_020, 90_000)


def test_failure_precedence(spark):
    cases = [
        (("canceled", "attempt_timeout", None, None, None, None), "canceled"), (("failed", "attempt_timeout", "claim_lost", None, None, None), "attempt_timeout"), (("failed", "boom", " Claim_Lost", None, None, None), "claim_lost"),
        (("failed", None, None, "strong_attempt_failed", "failed", None), "runtime_failed"), (("rejected", None, None, None, "failed", None), "decision_rejected"), (("failed", None, None, None, "failed", "r"), "output_validation_failed"),
        (("failed", None, None, None, None, "r"), "runtime_failed"), (("failed", "", None, None, None, None), "unclassified"), (("complete", "attempt_timeout", None, None, None, None), None), (("failed", "my_error:artifact_rejected:x:y", None, None, None, None), "artifact_rejected"),
    ]
    rows = spark.createDataFrame([(k, *c) for k, (c, _) in enumerate(cases)], "k int, a string, b string, c string, d string, e string, f string")
    got = {r["k"]: r["code"] for r in rows.select("k", observability.failure_code(*(F.col(x) for x in "abcdef")).alias("code")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}
    assert observability.taxonomy(spark).count() == 16


def test_schema_errors_in_order():
    error = lambda text, schema: jsonx.first_error(jsonx.loads(text), jsonx.loads(__import__("json").dumps(schema)))
    assert error("3", {"enum": [1, 2]}) == "$ is not one of the allowed values" and error("3", {"const": 4}) == "$ does not match const" and error("3", {"type": "string"}) == "$ must be string"
    assert error("3.5", {"type": "integer"}) == "$ must be an integer" and error("3.0", {"type": "integer"}) is None and error('"x"', {"type": "number"}) == "$ must be a number"
    assert error('{"b":1,"z":2}', {"required": ["a"], "properties": {"b": {}}, "additionalProperties": False}) == "$ is missing required property a"
    assert error('{"b":1,"z":2}', {"properties": {"b": {}}, "additionalProperties": False}) == "$ has unsupported property z" and error('{"b":1}', {"minProperties": 2}) == "$ has too few properties"
    assert error("[1,2,3]", {"maxItems": 2}) == "$ has too many items" and error('[1,"x"]', {"items": {"type": "number"}}) == "$[1] must be a number"
    assert error('"abc"', {"maxLength": 2}) == "$ is longer than maxLength" and error("3", {"exclusiveMinimum": 3}) == "$ is not above exclusiveMinimum" and error("3", {"exclusiveMaximum": 3}) == "$ is not below exclusiveMaximum"
    assert error("true", {"type": "number"}) == "$ must be a number" and error('{"a":{"b":[9]}}', {"properties": {"a": {"properties": {"b": {"items": {"maximum": 5}}}}}}) == "$.a.b[0] is above maximum"


def test_staleness_folds_micro_batches(spark):
    state = spark.createDataFrame([(str(i), False, None) for i in range(4)], "subject_id string, stale boolean, stale_reason string")
    deps = spark.createDataFrame([("1", "t", "9", "subject_id"), ("2", "u", "9", "other_id")], "dependent string, table string, subject_id string, field string")
    own = state.select(F.col("subject_id").alias("dependent"), F.lit("t").alias("table"), "subject_id", F.lit("subject_id").alias("field"))
    versions = {-1: state}
    fold = changes.fold_staleness(lambda: versions[max(versions)], lambda df, n: versions.__setitem__(n, df), deps.unionByName(own))
    batch = lambda *rows: spark.createDataFrame(rows, "table string, subject_id string, reason string, ts long, seq long")
    fold(batch(("t", "0", "source_update", 1, 1), ("t", "0", "source_delete", 2, 2)), 0)
    fold(batch(("t", "9", "source_update", 3, 3), ("u", "9", "source_update", 3, 4)), 1)
    assert sorted((r["subject_id"], r["stale_reason"]) for r in versions[1].collect()) == [("0", "source_delete"), ("1", "source_update"), ("2", "content_revalidation_pending"), ("3", None)]


def test_dry_run_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "a", 2.0)], "k long, name string, x double")
    ask = spark.createDataFrame([(1, "i", "1", "name", "b", "9" * 64), (2, "j", "1", "x", "3", "0"), (3, "k", "5", "name", "b", "0")], "action_id long, idempotency_key string, target string, column string, value string, before_hash string")
    none = spark.createDataFrame([], "idempotency_key string")
    import hashlib

    good = ask.withColumn("before_hash", F.lit(hashlib.sha256(b"a").hexdigest()))
    new, report = actions.applied(rows, "k", good, ["name"], none, dry_run=True)
    assert new.collect() == rows.collect() and [r["outcome"] for r in report.orderBy("action_id").collect()] == ["applied", "column_not_allowed", "row_missing"]
    assert actions.applied(rows, "k", good, ["name"], none)[0].first()["name"] == "b" and actions.applied(rows, "k", ask, ["name"], none)[0].first()["name"] == "a"


def test_containment_of_scalars_in_arrays():
    holds = lambda a, b: jsonx.contains(jsonx.loads(a), jsonx.loads(b))
    assert holds("[1,2]", "1") and holds("[1,2]", "[2]") and not holds('{"a":[1,2]}', '{"a":1}') and holds('{"a":[1,2]}', '{"a":[1]}')
    assert not holds("[[1,2]]", "1") and not holds("[[1,2]]", "[1]") and holds("[[1,2]]", "[[1]]") and holds('[{"a":1,"b":2}]', '[{"a":1}]') and not holds("1", "[1]") and not holds("true", "1")


def test_columns_and_functions_write_the_same_canonical_text(spark):
    values = ["plain", 'quote " and \\ slash', "tab\tnew\nline\r\b\f", "\x00\x1f", "é 日本 \u2028", "", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    got = {r["i"]: r["t"] for r in rows.select("i", identity.json_object(b=identity.json_string(F.col("v")), a=F.lit("1"), c=F.lit(None)).alias("t")).collect()}
    for i, v in enumerate(values):
        assert got[i] == jsonx.canonical({"a": Decimal(1), "b": v, "c": None})
        assert jsonx.canonical(jsonx.loads(got[i])) == got[i]
