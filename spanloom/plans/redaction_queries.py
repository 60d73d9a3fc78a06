"""Registered queries over redaction, and over the store's side tables, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import redaction
from spanloom.plans.trace_queries import register
from spanloom.sources import store
from spanloom.sources.shared import folder

_REDACTED = """WITH q AS (SELECT 'v' || conv_id AS trace_id, 'v' || conv_id || '-' || turn AS span_id, conv_id, turn, role, text, turn % 5 = 4 AS broken FROM conversations)"""
_RULES = (
    redaction.Rule("drop.token", 90, '*.json*["token"]', "drop"),
    redaction.Rule("hash.role", 80, '*.json*["role"]', "hash"),
    redaction.Rule("cut.note", 70, 'spans[*].attributes["note"]', "truncate", max_length=20),
    redaction.Rule("mask.state", 60, "*.trace_state", "mask"),
    redaction.Rule("hash.link", 50, 'spans[*].links[*].attributes["id"]', "hash"),
    redaction.Rule("drop.key", 40, "metadata.attribute_key", "drop", value_regex="^private"),
)
_POLICY = redaction.Policy(_RULES, max_depth=4, max_value_bytes=4096, inspect_json_paths=('spans[*].attributes["body"]',))


def _spans_with_content(spark, sf_dir):
    """Conversation turns as spans that carry JSON, notes, private attributes and a link to the turn before."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    c, text = F.col, lambda x: F.col(x).cast("string")
    trace, ident = F.concat(F.lit("v"), text("conv_id")), F.concat(F.lit("v"), text("conv_id"), F.lit("-"), text("turn"))
    body = F.format_string('{"z":{"token":"t%d","role":"%s","n":[1,2.50,{"token":1}]},"id":%d%s', c("turn"), c("role"), c("conv_id"), F.when(c("turn") % 5 == 4, "").otherwise("}"))
    attribute = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.lit(kind).alias("value_type"), value.cast("string").alias("value"))
    own = F.array(attribute("body", "str", body), attribute("note", "str", F.col("text")), attribute("private.x", "str", F.lit("x")), attribute("turn", "int", F.col("turn")))
    zero = F.lit(0).cast("bigint")
    link = F.struct(trace.alias("trace_id"), F.concat(F.lit("v"), text("conv_id"), F.lit("-"), (c("turn") - 1).cast("string")).alias("span_id"), F.when(c("turn") % 2 == 0, "k=v").otherwise("").alias("trace_state"), F.array(attribute("id", "int", F.col("turn"))).alias("attributes"), zero.alias("dropped_attributes_count"), zero.alias("flags"))
    spans = rows.select(trace.alias("trace_id"), ident.alias("span_id"), F.when(c("turn") > 0, F.concat(F.lit("v"), text("conv_id"), F.lit("-"), (c("turn") - 1).cast("string"))).alias("parent_span_id"), F.lit("turn").alias("name"), (c("turn") + 1).cast("bigint").alias("ord"), own.alias("attributes"), F.array(link).alias("links"))
    return spans.withColumn("kind", F.lit(0)).withColumn("status", F.lit(0)).withColumn("started_ns", F.col("ord")).withColumn("ended_ns", F.col("ord") + 1).withColumn("duration_ns", F.lit(1).cast("bigint")).withColumn("dropped_attributes_count", F.lit(2).cast("bigint")).withColumn("dropped_links_count", F.lit(0).cast("bigint"))


_DIGEST = "'sha256:v1:' || sha256('spanloom:redaction:v1' || chr(0) || {0})"
#: longest valid head of at most 17 bytes, then an ellipsis, of texts over 20 bytes
_CUT = "CASE WHEN strlen(text) <= 20 THEN text ELSE left(text, (SELECT max(k)::INT FROM range(0, 18) r(k) WHERE strlen(left(text, k::INT)) <= 17)) || '…' END"


@register("F2_F3_F5_redact_spans", f"""{_REDACTED} SELECT trace_id, span_id, CASE WHEN broken THEN NULL ELSE '{{"id":' || conv_id || ',"z":{{"n":[1,2.50,{{}}],"role":"' || {_DIGEST.format('role')} || '"}}}}' END AS body,
  CASE WHEN broken THEN NULL ELSE 'json' END AS body_type, {_CUT} AS note, turn::VARCHAR AS turn, CASE WHEN turn % 2 = 0 THEN '‹redacted›' ELSE '' END AS trace_state, {_DIGEST.format('turn::VARCHAR')} AS link_id,
  CASE WHEN broken THEN 2 ELSE 3 END::INT AS n_attributes FROM q""")
def redact_spans(spark, sf_dir):
    found = redaction.redact_spans(_spans_with_content(spark, sf_dir), _POLICY)
    value = lambda key: F.get(F.filter("attributes", lambda x: x["key"] == key), F.lit(0))
    return found.select(
        "trace_id", "span_id", value("body")["value"].alias("body"), value("body")["value_type"].alias("body_type"), value("note")["value"].alias("note"), value("turn")["value"].alias("turn"),
        F.col("links")[0]["trace_state"].alias("trace_state"), F.col("links")[0]["attributes"][0]["value"].alias("link_id"), F.size("attributes").alias("n_attributes"),
    )


@register("F6_M6_D11_preview_summary", f"""{_REDACTED}, s AS (SELECT *, turn % 2 = 0 AS state FROM q)
  SELECT trace_id, sum(4 + CASE WHEN broken THEN 1 ELSE 6 END + 1 + state::INT)::BIGINT AS fields, sum(2 + CASE WHEN broken THEN 0 ELSE 3 END)::BIGINT AS retained,
    sum(state::INT)::BIGINT AS masked, sum(1 + CASE WHEN broken THEN 0 ELSE 1 END)::BIGINT AS hashed, count(*)::BIGINT AS truncated, sum(1 + CASE WHEN broken THEN 1 ELSE 2 END)::BIGINT AS dropped, sum(broken::INT)::BIGINT AS unknown
  FROM s GROUP BY trace_id""")
def preview_summary(spark, sf_dir):
    return redaction.decision_summary(redaction.redaction_preview(_spans_with_content(spark, sf_dir), _POLICY))


@register("C1_C3_diagnostics_and_links", """SELECT 'v' || conv_id AS trace_id, 'v' || conv_id || '-' || turn AS span_id, 2::BIGINT AS dropped_attributes_count, 1::INT AS n_links, 'v' || conv_id || '-' || (turn - 1) AS linked_span_id,
  turn::VARCHAR AS link_id, 'user ' || conv_id || CASE WHEN conv_id % 2 = 0 THEN ' ‹redacted-email›' ELSE '' END AS run_label FROM conversations""")
def diagnostics(spark, sf_dir):
    spans = _spans_with_content(spark, sf_dir)
    label = F.when(F.substring("trace_id", -1, 1).cast("int") % 2 == 0, " a@b.org").otherwise("")
    labels = spans.select("trace_id").distinct().select("trace_id", F.concat(F.lit("user "), F.substring(F.col("trace_id"), 2, 40), label).alias("run_label"))
    path = folder(spark, "diagnostics")
    store.write_spans(spans, path, "tests", grain="year", labels=labels)
    back = store.read_spans(spark, path).select("trace_id", "span_id", "dropped_attributes_count", F.size("links").alias("n_links"), F.col("links")[0]["span_id"].alias("linked_span_id"), F.col("links")[0]["attributes"][0]["value"].alias("link_id"))
    return back.join(store.read_traces(spark, path).select("trace_id", "run_label"), "trace_id")


_FIELD = """'["<field:' || substr(sha256('spanloom:redaction:v1' || chr(0) || '{0}'), 1, 12) || '>"]'"""
_BODY = f"root || '.attributes' || {_FIELD.format('body')}"
_INNER = f"{_BODY} || '.json' || {_FIELD.format('z')} || "
#: the default decision on what no rule speaks of
_KEPT = "'implicit.retain', 'retain'"


def _row(when: str, kind: str, path: str, rule: str, value_type: str, size: str, preview: str, precedence: str, digest: str = "NULL", reason: str = "NULL", category: str = "''") -> str:
    status = "'known'" if reason == "NULL" else "'unknown'"
    return f"SELECT trace_id, span_id, '{kind}', {path}, {rule}, '{value_type}', {size}::INT, {preview}, {reason}, {digest}, {category}, {precedence}, {status} FROM q WHERE {when}"


def _retained(when: str, kind: str, path: str, value_type: str, size: str) -> str:
    return _row(when, kind, path, _KEPT, value_type, size, "'<retained>'", "'priority=-1;literal=0;wildcards=1;rule_id=implicit.retain'", category="'custom'")


_TOKEN, _ROLE = "'priority=90;literal=14;wildcards=2;rule_id=drop.token'", "'priority=80;literal=13;wildcards=2;rule_id=hash.role'"
_TEXT = """'{"z":{"token":"t' || turn || '","role":"' || role || '","n":[1,2.50,{"token":1}]},"id":' || conv_id"""
_DECISIONS = " UNION ALL ".join([
    "SELECT NULL::VARCHAR AS trace_id, NULL::VARCHAR AS span_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS path, NULL::VARCHAR AS rule, NULL::VARCHAR AS action, NULL::VARCHAR AS value_type, NULL::INT AS original_bytes, "
    "NULL::VARCHAR AS preview, NULL::VARCHAR AS reason, NULL::VARCHAR AS digest, NULL::VARCHAR AS category, NULL::VARCHAR AS precedence, NULL::VARCHAR AS status WHERE false",
    _retained("true", "name", "root || '.name'", "str", "4"),
    _retained("true", "attribute", f"root || '.attributes' || {_FIELD.format('turn')}", "int", "length(turn::VARCHAR)"),
    _row("broken", "attribute", _BODY, "'implicit.malformed-json', 'drop'", "json", f"strlen({_TEXT})", "'<dropped:unknown>'", "'implicit fail-closed safety bound'", reason="'malformed_json'", category="'unknown'"),
    _retained("NOT broken", "attribute", f"{_BODY} || '.json' || {_FIELD.format('id')}", "json-number", "length(conv_id::VARCHAR)"),
    _retained("NOT broken", "attribute", f"{_INNER} {_FIELD.format('n')} || '[0]'", "json-number", "1"),
    _retained("NOT broken", "attribute", f"{_INNER} {_FIELD.format('n')} || '[1]'", "json-number", "4"),
    _row("NOT broken", "attribute", f"{_INNER} {_FIELD.format('n')} || '[2]' || {_FIELD.format('token')}", "'drop.token', 'drop'", "json-number", "1", "'<dropped>'", _TOKEN),
    _row("NOT broken", "attribute", f"{_INNER} {_FIELD.format('role')}", "'hash.role', 'hash'", "json-string", "strlen(role)", "NULL", _ROLE, digest=_DIGEST.format("role")),
    _row("NOT broken", "attribute", f"{_INNER} {_FIELD.format('token')}", "'drop.token', 'drop'", "json-string", "1 + length(turn::VARCHAR)", "'<dropped>'", _TOKEN),
    _row("true", "attribute", f"root || '.attributes' || {_FIELD.format('note')}", "'cut.note', 'truncate'", "str", "strlen(text)", f"'<truncated:' || strlen(text) || 'B->' || strlen({_CUT}) || 'B>'", "'priority=70;literal=26;wildcards=1;rule_id=cut.note'"),
    _row("true", "attribute", "'<redacted-field:' || substr(sha256('spanloom:redaction:v1' || chr(0) || 'private.x'), 1, 12) || '>'", "'drop.key', 'drop'", "field-key", "9", "'<dropped>'", "'priority=40;literal=22;wildcards=0;rule_id=drop.key'"),
    _row("turn % 2 = 0", "trace_state", "root || '.links[0].trace_state'", "'mask.state', 'mask'", "str", "3", "'‹redacted›'", "'priority=60;literal=12;wildcards=1;rule_id=mask.state'"),
    _row("true", "link_attribute", f"root || '.links[0].attributes' || {_FIELD.format('id')}", "'hash.link', 'hash'", "int", "length(turn::VARCHAR)", "NULL", "'priority=50;literal=32;wildcards=2;rule_id=hash.link'", digest=_DIGEST.format("turn::VARCHAR")),
])


@register("F6_decisions", f"WITH q AS (SELECT *, 'spans[' || turn || ']' AS root FROM ({_REDACTED} SELECT * FROM q)) {_DECISIONS}")
def decisions(spark, sf_dir):
    """Every decision with what its rule says of itself (explanations are checked by tests)."""
    return redaction.redaction_preview(_spans_with_content(spark, sf_dir), _POLICY).drop("provenance", "explanation")
