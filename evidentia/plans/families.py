"""Scalar, array, JSON, text, time and set functions, a query for each family of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import sets
from . import fixtures as X
from .catalog import query

_T = "timestamp"


def _events(s, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    doc = F.concat(F.lit('{"a":{"b":'), k.cast("string"), F.lit('},"k":'), k.cast("string"), F.lit(',"n":null,"t":"x'), k.cast("string"), F.lit('"}'))
    return X.table(s, d, "events").select("event_id", "user_id", "event_type", "ts", "value", k.alias("k"), doc.alias("doc"), F.concat(F.lit("["), k.cast("string"), F.lit(","), (k + 1).cast("string"), F.lit(",\"z\"]")).alias("arr"))


_EVENTS = """(SELECT event_id, user_id, event_type, ts, value, k, '{"a":{"b":' || k || '},"k":' || k || ',"n":null,"t":"x' || k || '"}' AS doc, '[' || k || ',' || (k + 1) || ',"z"]' AS arr FROM (SELECT *, json_extract_string(props, '$.k')::bigint AS k FROM events))"""


@query(f"""SELECT event_id, json_extract(doc, '$.a')::varchar AS field, json_extract_string(doc, '$.t') AS field_text, json_extract(doc, '$.a.b')::varchar AS path, json_extract_string(doc, '$.a.b') AS path_text, json_exists(doc, '$.n') AS has_key, json_exists(doc, '$.a') AND json_exists(doc, '$.z') AS has_all, json_exists(doc, '$.a') OR json_exists(doc, '$.z') AS has_any, array_to_string(json_keys(doc), ',') AS keys, json_exists(doc, '$.a.b') AS path_exists FROM {_EVENTS}""")
def json_access(s, d):
    """-> ->> #> #>> ? ?& ?| jsonb_object_keys, jsonb_path_exists."""
    doc = F.col("doc")
    keys = F.json_object_keys(doc)
    has = lambda k: F.array_contains(keys, k)
    return _events(s, d).select(
        "event_id", F.get_json_object(doc, "$.a").alias("field"), F.get_json_object(doc, "$.t").alias("field_text"), F.get_json_object(doc, "$.a.b").alias("path"), F.get_json_object(doc, "$.a.b").alias("path_text"),
        has("n").alias("has_key"), (has("a") & has("z")).alias("has_all"), (has("a") | has("z")).alias("has_any"), F.array_join(keys, ",").alias("keys"), F.get_json_object(doc, "$.a.b").isNotNull().alias("path_exists"),
    )


@query(f"""SELECT event_id, '{{"a":{{"b":' || k || '}},"k":' || k || ',"t":"x' || k || '"}}' AS stripped, '{{"a":{{"b":0}},"k":' || k || ',"n":null,"t":"x' || k || '"}}' AS replaced, '{{"a":{{"b":' || k || '}},"k":' || k || ',"n":null,"new":[1],"t":"x' || k || '"}}' AS added, '{{"a":{{"b":' || k || '}},"n":null,"t":"x' || k || '"}}' AS removed, json_type(doc, '$.a') = 'OBJECT' AND json_type(doc, '$.n') = 'NULL' AS typed, '[' || k || ']' AS queried FROM {_EVENTS}""")
def json_changes(s, d):
    """jsonb_set, jsonb_strip_nulls, - key, jsonb_typeof, jsonb_path_query_array."""
    doc = F.col("doc")
    return _events(s, d).select(
        "event_id", jsonx.strip_nulls(doc).alias("stripped"), jsonx.set_path(doc, "0", "a", "b").alias("replaced"), jsonx.set_path(doc, "[1]", "new").alias("added"), jsonx.without_keys(doc, "k").alias("removed"),
        ((jsonx.type_of(F.get_json_object(doc, "$.a")) == "object") & (jsonx.member_type(doc, "n") == "null")).alias("typed"), jsonx.path_values(doc, "a", "b").alias("queried"),
    )


@query(f"""SELECT event_id, (nth - 1)::int AS nth, json_array_length(arr)::int AS size, element FROM (SELECT event_id, arr, unnest(json_extract_string(arr, '$[*]')) AS element, generate_subscripts(json_extract_string(arr, '$[*]'), 1) AS nth FROM {_EVENTS})""")
def json_elements(s, d):
    """jsonb_array_elements, jsonb_array_elements_text with ordinality, jsonb_array_length."""
    rows = _events(s, d).select("event_id", F.json_array_length("arr").alias("size"), F.posexplode(F.from_json("arr", "array<string>")).alias("nth", "element"))
    return rows.select("event_id", "nth", "size", "element")


@query(f"""SELECT event_id, name, CASE name WHEN 'a' THEN '{{"b":' || k || '}}' WHEN 'k' THEN k::varchar WHEN 't' THEN 'x' || k END AS value FROM {_EVENTS}, (VALUES ('a'), ('k'), ('n'), ('t')) v(name)""")
def json_members(s, d):
    """jsonb_each, jsonb_each_text."""
    return _events(s, d).select("event_id", F.explode(F.from_json("doc", "map<string,string>")).alias("name", "value"))


@query(f"SELECT event_id, k::int AS k, 'x' || k AS t, NULL::varchar AS absent FROM {_EVENTS}")
def json_record(s, d):
    """jsonb_populate_record."""
    return _events(s, d).select("event_id", F.from_json("doc", "k int, t string, absent string").alias("r")).select("event_id", "r.*")


@query("SELECT p_partkey, length(p_name)::int AS chars, strlen(p_name)::int AS bytes, trim('  ' || p_name || ' ') AS trimmed, lower(p_brand) AS lowered, left(p_name, 3) AS first3, right(p_name, 3) AS last3, substr(p_name, 2, 4) AS middle, replace(p_name, 'a', '_') AS replaced, split_part(p_type, ' ', 2) AS second, p_brand || ': ' || p_size::varchar || '%' AS formatted, strpos(p_name, 'e')::int AS place, lower(hex(p_brand)) AS hexed, md5(p_name) AS digest, lpad(p_size::varchar, 4, '0') AS padded, concat_ws('/', p_brand, p_type) AS joined FROM part")
def text_functions(s, d):
    """length, char_length, octet_length, btrim, lower, left, right, substr, replace, split_part, format, position, strpos, convert_to, encode, md5, lpad, concat_ws, ||."""
    n, b = F.col("p_name"), F.col("p_brand")
    return X.table(s, d, "part").select(
        "p_partkey", F.char_length(n).alias("chars"), F.octet_length(n).alias("bytes"), F.btrim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.lower(b).alias("lowered"), F.left(n, F.lit(3)).alias("first3"),
        F.right(n, F.lit(3)).alias("last3"), F.substr(n, F.lit(2), F.lit(4)).alias("middle"), F.replace(n, F.lit("a"), F.lit("_")).alias("replaced"), F.split_part("p_type", F.lit(" "), F.lit(2)).alias("second"),
        F.format_string("%s: %s%%", b, F.col("p_size").cast("string")).alias("formatted"), F.position(F.lit("e"), n).alias("place"), F.lower(F.hex(F.encode(b, "UTF-8"))).alias("hexed"), F.md5(n).alias("digest"),
        F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"), F.concat_ws("/", b, "p_type").alias("joined"),
    )


@query(r"""SELECT page_id, regexp_matches(url, '^https?://') AS matches, NOT regexp_matches(url, '[0-9]') AS lacks, len(regexp_extract_all(url, '/'))::int AS slashes, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, regexp_extract(url, '://([^/]*)', 1) AS host, url LIKE '%.com%' AS com FROM pages""")
def regex_functions(s, d):
    """~, !~, regexp_count, regexp_replace, substring by a pattern, LIKE."""
    u = F.col("url")
    return X.table(s, d, "pages").select("page_id", u.rlike("^https?://").alias("matches"), (~u.rlike("[0-9]")).alias("lacks"), F.regexp_count(u, F.lit("/")).alias("slashes"), F.regexp_replace(u, "[0-9]+", "#").alias("masked"), F.regexp_extract(u, "://([^/]*)", 1).alias("host"), u.like("%.com%").alias("com"))


@query("SELECT page_id, unnest(regexp_extract_all(url, '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(url, '[a-z]+'), 1)::int - 1 AS nth FROM pages")
def regex_matches(s, d):
    """regexp_matches with the g flag, as rows."""
    return X.table(s, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("url", F.lit("[a-z]+"), F.lit(0))).alias("nth", "word"))


@query("""SELECT doc_id, nullif(regexp_extract(raw, '"match"\\s*:\\s*"(same_entity|different_entity|unclear)"', 1), '') AS raw_match, nullif(regexp_extract(raw, '"confidence"\\s*:\\s*"(low|medium|high)"', 1), '') AS raw_confidence FROM (SELECT doc_id, '{"match" : "' || CASE doc_id % 4 WHEN 0 THEN 'same_entity' WHEN 1 THEN 'unclear' ELSE 'other' END || '", "confidence":"' || CASE WHEN doc_id % 3 = 0 THEN 'low' ELSE 'sure' END || '", broken' AS raw FROM documents)""")
def malformed_output(s, d):
    """Fields that can still be read from an answer that is no JSON."""
    i = F.col("doc_id")
    raw = F.concat(F.lit('{"match" : "'), F.when(i % 4 == 0, "same_entity").when(i % 4 == 1, "unclear").otherwise("other"), F.lit('", "confidence":"'), F.when(i % 3 == 0, "low").otherwise("sure"), F.lit('", broken'))
    return X.table(s, d, "documents").select("doc_id", jsonx.salvaged(raw, "match", "same_entity", "different_entity", "unclear").alias("raw_match"), jsonx.salvaged(raw, "confidence", "low", "medium", "high").alias("raw_confidence"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(l_extendedprice - 5000)::bigint AS cut, floor(l_extendedprice - 5000)::bigint AS low, ceil(l_extendedprice - 5000)::bigint AS high, abs(l_extendedprice - 5000) AS size, power(l_linenumber, 2)::double AS square, l_quantity BETWEEN 10 AND 20 AS middling, greatest(l_linenumber, 3) AS most, least(l_linenumber, 3) AS least, nullif(l_linenumber, 1) AS some FROM lineitem")
def number_functions(s, d):
    """trunc, floor, ceil, abs, power, BETWEEN, greatest, least, nullif."""
    x = F.col("l_extendedprice") - 5000
    n = F.col("l_linenumber")
    return X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.cast("bigint").alias("cut"), F.floor(x).alias("low"), F.ceil(x).alias("high"), F.abs(x).alias("size"), F.pow(n, F.lit(2)).alias("square"), F.col("l_quantity").between(10, 20).alias("middling"), F.greatest(n, F.lit(3)).alias("most"), F.least(n, F.lit(3)).alias("least"), F.nullif(n, F.lit(1)).alias("some"))


@query("SELECT p_partkey, array_to_string(list_append([p_size, 7], p_partkey::int), ',') AS appended, array_to_string(list_filter([p_size, 7, p_size], lambda x: x <> 7), ',') AS removed, coalesce(list_position([p_size, 7], 7), 0)::bigint AS place, list_has_all([1, 7, p_size], [p_size, 7]) AS contained, list_has_any([p_size], [7, 9, 11]) AS overlaps, p_size NOT IN (7, 9, 11) AS apart, p_size IN (7, 9, 11) AS member, 3::int AS cardinality FROM part")
def array_functions(s, d):
    """array_append, array_remove, array_position, <@, &&, <> ALL, = ANY, cardinality."""
    z = F.col("p_size")
    of = lambda *xs: F.array(*(x if not isinstance(x, int) else F.lit(x) for x in xs))
    return X.table(s, d, "part").select(
        "p_partkey", F.array_join(F.array_append(of(z, 7), F.col("p_partkey").cast("int")).cast("array<string>"), ",").alias("appended"), F.array_join(F.array_remove(of(z, 7, z), 7).cast("array<string>"), ",").alias("removed"), F.array_position(of(z, 7), 7).alias("place"),
        (F.size(F.array_except(of(z, 7), of(1, 7, z))) == 0).alias("contained"), F.arrays_overlap(of(z), of(7, 9, 11)).alias("overlaps"), (~F.array_contains(of(7, 9, 11), z)).alias("apart"), F.array_contains(of(7, 9, 11), z).alias("member"), F.cardinality(of(z, 7, z)).alias("cardinality"),
    )


@query("SELECT o_orderkey, epoch(o_orderdate)::bigint AS seconds, strftime(o_orderdate + to_seconds(o_orderkey % 1000), '%Y-%m-%d %H:%M:%S') AS later, year(o_orderdate)::int AS year, dayofweek(o_orderdate)::int + 1 AS weekday, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS text, o_orderdate <= now()::timestamp AS past FROM orders")
def time_functions(s, d):
    """extract, make_interval, to_char, now, statement_timestamp, clock_timestamp."""
    t = F.col("o_orderdate")
    return X.table(s, d, "orders").select("o_orderkey", t.cast(_T).cast("bigint").alias("seconds"), F.date_format(t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 1000).cast("decimal(18,6)")), "yyyy-MM-dd HH:mm:ss").alias("later"), F.extract(F.lit("YEAR"), t).alias("year"), F.dayofweek(t).alias("weekday"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("text"), (t <= F.current_timestamp()).alias("past"))


@query("SELECT lang, bool_or(n_chars > 5000) AS any_long, bool_and(n_chars > 0) AS all_filled, quantile_cont(n_chars, 0.5)::double AS median, quantile_disc(n_chars, 0.5)::bigint AS middle, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) FILTER (n_chars > 5000) AS long, count(DISTINCT source) AS kinds FROM documents GROUP BY lang")
def aggregate_functions(s, d):
    """bool_or, bool_and, percentile_cont, percentile_disc, array_agg and string_agg of distinct values in order, FILTER."""
    n = F.col("n_chars")
    return X.table(s, d, "documents").groupBy("lang").agg(
        F.bool_or(n > 5000).alias("any_long"), F.bool_and(n > 0).alias("all_filled"), F.expr("percentile_cont(0.5) within group (order by n_chars)").alias("median"), F.expr("cast(percentile_disc(0.5) within group (order by n_chars) as bigint)").alias("middle"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.count_if(n > 5000).alias("long"), F.countDistinct("source").alias("kinds"),
    )


@query("""SELECT lang, '{' || string_agg('"' || source || '":' || n, ',' ORDER BY source) || '}' AS histogram FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang""")
def histogram_object(s, d):
    """jsonb_object_agg of a histogram, its keys in order."""
    n = X.table(s, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.groupBy("lang").agg(jsonx.object_of(F.col("source"), F.col("n")).alias("histogram"))


@query("SELECT doc_id, (lang IS NOT NULL)::int + (nullif(source, 'web') IS NOT NULL)::int + (nullif(n_chars % 2, 1) IS NOT NULL)::int AS filled, coalesce(nullif(n_chars % 2, 1), -1) AS value, lang IS DISTINCT FROM nullif(lang, 'en') AS english FROM documents")
def null_functions(s, d):
    """num_nonnulls, coalesce, nullif, IS DISTINCT FROM."""
    odd = F.nullif(F.col("n_chars") % 2, F.lit(1))
    filled = sum((c.isNotNull().cast("int") for c in (F.col("lang"), F.nullif("source", F.lit("web")), odd)), F.lit(0))
    return X.table(s, d, "documents").select("doc_id", filled.alias("filled"), F.coalesce(odd, F.lit(-1)).alias("value"), (~F.col("lang").eqNullSafe(F.nullif("lang", F.lit("en")))).alias("english"))


@query("SELECT count(DISTINCT doc_id) AS ids, true AS apart, true AS well_formed, true AS in_range FROM documents")
def random_functions(s, d):
    """gen_random_uuid, random: what holds of every draw."""
    r = X.table(s, d, "documents").select("doc_id", F.uuid().alias("u"), F.rand().alias("r"))
    return r.agg(F.countDistinct("doc_id").alias("ids"), (F.approx_count_distinct("u", 0.05) > 0.8 * F.count("*")).alias("apart"), F.bool_and(F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")).alias("well_formed"), F.bool_and(F.col("r").between(0, 1)).alias("in_range"))


@query("SELECT n.n_name AS name FROM nation n WHERE n.n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def except_rows(s, d):
    """EXCEPT."""
    n = X.table(s, d, "nation")
    rich = X.table(s, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")).join(n, "n_nationkey").select("n_name")
    return n.select("n_name").subtract(rich).withColumnRenamed("n_name", "name")


@query("SELECT v AS pair, CASE v WHEN 'customers' THEN (SELECT count(*) = 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) ELSE (SELECT count(*) = 0 FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AND (SELECT count(*) = 0 FROM (SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) EXCEPT SELECT l_orderkey FROM lineitem)) END AS equal FROM (VALUES ('customers'), ('lines')) x(v)")
def set_equality(s, d):
    """Equality of two sets: neither has a member that the other lacks."""
    o, line, c = X.table(s, d, "orders"), X.table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), X.table(s, d, "customer")
    known = o.select(F.col("o_orderkey").alias("k")).join(line, "k", "left_semi")
    a = sets.equal(c.select(F.col("c_custkey").alias("k")), o.select(F.col("o_custkey").alias("k")).join(c.select(F.col("c_custkey").alias("k")), "k", "left_semi"), "k")
    return a.select(F.lit("customers").alias("pair"), "equal").unionByName(sets.equal(line, known, "k").select(F.lit("lines").alias("pair"), "equal"))


_SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "object", "properties": {"b": {"type": "integer", "maximum": 50}}}, "k": {"type": "integer", "minimum": 5}, "n": {"type": "null"}, "t": {"type": "string", "maxLength": 2}}, "additionalProperties": False, "maxProperties": 4}


@query(f"SELECT event_id, CASE WHEN k > 50 THEN '$.a.b is above maximum' WHEN k < 5 THEN '$.k is below minimum' WHEN k > 9 THEN '$.t is longer than maxLength' END AS error FROM {_EVENTS}")
def schema_error(s, d):
    """json_schema_validation_error: the first breach, as text."""
    return _events(s, d).select("event_id", jsonx.schema_error(F.col("doc"), _SCHEMA).alias("error"))


@query("""SELECT * FROM (VALUES ('$', 'oneOf', '$ uses unsupported keyword oneOf'), ('$.properties.a', 'type', '$.properties.a.type text is unsupported')) v(schema_path, keyword, error)""")
def schema_support(s, d):
    """json_schema_support_report of a schema with two unsupported parts."""
    return s.createDataFrame(jsonx.schema_support({"type": "object", "oneOf": [], "properties": {"a": {"type": "text"}, "b": {"type": "string"}}}), "schema_path string, keyword string, error string")


@query(f"SELECT event_id, 3::int AS depth, 6::bigint AS nodes, 5::bigint AS identifiers FROM {_EVENTS}")
def json_complexity(s, d):
    """bounded_jsonb_complexity."""
    return _events(s, d).select("event_id", jsonx.complexity(F.col("doc"), 8, 100).alias("c")).select("event_id", "c.*")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'same_entity' WHEN 1 THEN 'different_entity' WHEN 2 THEN 'unclear' END AS answer, CASE WHEN p_size % 4 = 2 THEN 'flag' END AS decision, 'low,high' AS allowed FROM part")
def declared_answers(s, d):
    """action_declared_answer, output_schema_enum_values."""
    from ..operators import actions

    z = F.col("p_size") % 4
    kind = F.when(z == 0, "merge_candidate").when(z == 1, "new_entity").when(z == 2, "review_flag").otherwise("update_row")
    schema = F.lit('{"properties":{"confidence":{"enum":["low","high"]}}}')
    return X.table(s, d, "part").select("p_partkey", actions.declared_answer(kind, "match").alias("answer"), actions.declared_answer(kind, "decision").alias("decision"), F.array_join(F.from_json(F.get_json_object(schema, "$.properties.confidence.enum"), "array<string>"), ",").alias("allowed"))


@query(r"""SELECT vec_id, 'a\\b\n' || vec_id || '\t?' AS readable FROM embeddings""")
def readable_tokens(s, d):
    """trace_readable_token_text: escapes made visible."""
    raw = F.concat(F.lit("a\\b\n"), F.col("vec_id").cast("string"), F.lit("\t\x01"))
    return X.table(s, d, "embeddings").select("vec_id", jsonx.readable(raw).alias("readable"))


@query(f"""SELECT event_id, path, old_value, new_value FROM (SELECT event_id, k, unnest(['/a/b', '/gone~1x~0', '/k', '/n', '/new', '/t']) AS path FROM {_EVENTS}) p, LATERAL (SELECT CASE path WHEN '/a/b' THEN k::varchar WHEN '/k' THEN k::varchar WHEN '/gone~1x~0' THEN '1' WHEN '/t' THEN '"x' || k || '"' WHEN '/n' THEN 'null' END AS old_value, CASE path WHEN '/a/b' THEN (k + k % 2)::varchar WHEN '/k' THEN k::varchar WHEN '/new' THEN '[2]' WHEN '/t' THEN '"x' || k || '"' WHEN '/n' THEN 'null' END AS new_value) WHERE old_value IS DISTINCT FROM new_value""")
def pointer_diff(s, d):
    """workload_revision_diff: JSON pointers at which two documents differ."""
    k = F.col("k").cast("string")
    doc = lambda b, tail: F.concat(F.lit('{"a":{"b":'), b, F.lit('},"k":'), k, F.lit(',"n":null,"t":"x'), k, F.lit('"'), F.lit(tail))
    rows = _events(s, d).select("event_id", F.explode(jsonx.pointer_differences(doc(k, ',"gone/x~":1}'), doc((F.col("k") + F.col("k") % 2).cast("string"), ',"new":[2]}'))).alias("x"))
    return rows.select("event_id", "x.*")


@query(f"SELECT event_id, '[[\"a\",\"b\"]]' AS kept FROM {_EVENTS}")
def evidence_links(s, d):
    """decision_evidence_path_links: the cited paths that the shaped input holds and the allow-list admits."""
    return _events(s, d).select("event_id", jsonx.evidence_links(F.col("doc"), F.lit('[["a","b"],["k"],["a","zz"]]'), ["a", "t"]).alias("kept"))


@query(f"SELECT event_id, '{{\"a\":{{\"b\":\"[REDACTED]\"}},\"k\":' || k || ',\"n\":null,\"t\":\"[REDACTED]\"}}' AS clean, k % 2 = 0 AS allowed FROM {_EVENTS}")
def redaction(s, d):
    """Recursive redaction by key, and the allow-list of source fields."""
    from ..sources.inputs import field_allowed

    fields = F.when(F.col("k") % 2 == 0, F.array(F.lit("a"), F.lit("t"))).otherwise(F.array(F.lit("a"), F.lit("q")))
    return _events(s, d).select("event_id", jsonx.redacted(F.col("doc"), "b", "t").alias("clean"), field_allowed(fields, ["a", "t"]).alias("allowed"))
