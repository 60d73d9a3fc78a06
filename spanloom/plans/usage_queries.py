"""Registered queries over the model-call projection, with their DuckDB SQL."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.operators import ledger, timeline, tree
from spanloom.plans.projections import sql, view
from spanloom.plans.trace_queries import register
from spanloom.sources import rates
from spanloom.sources.shared import folder, materialize


def _calls(spark, sf_dir, rows=None, more=None):
    """Calls as spans; `more` gives further attributes from the builder of one."""
    rows = view(spark, sf_dir, "td_usage") if rows is None else rows
    attr = lambda key, kind, value: F.struct(F.lit(key).alias("key"), F.lit(kind).alias("value_type"), value.cast("string").alias("value"))
    attributes = F.array(
        attr("gen_ai.provider.name", "str", F.col("provider")), attr("gen_ai.request.model", "str", F.lit("m1")), attr("gen_ai.usage.input_tokens", "int", F.col("input_tokens")),
        attr("gen_ai.usage.output_tokens", "int", F.col("output_tokens")), attr("spanloom.usage.mode", "str", F.col("mode")), attr("spanloom.usage.series", "str", F.lit("s")),
        attr("gen_ai.usage.cache_read.input_tokens", "int", F.lit(0)), attr("gen_ai.usage.cache_creation.input_tokens", "int", F.lit(0)), attr("gen_ai.usage.reasoning.output_tokens", "int", F.lit(0)),
        attr("spanloom.context.window.limit_tokens", "int", F.lit(100_000)), *(more(attr) if more else ()),
    )
    return rows.select("trace_id", "span_id", F.col("prev").alias("parent_span_id"), "started_ns", F.col("started_ns").alias("ended_ns"), F.col("started_ns").alias("ord"), attributes.alias("attributes"))


_ADDED = f"""{sql('td_usage')}, a AS (SELECT *, CASE WHEN mode = 'delta' THEN input_tokens WHEN input_tokens >= coalesce(lag(input_tokens) OVER w, 0) THEN input_tokens - coalesce(lag(input_tokens) OVER w, 0) END AS i,
    CASE WHEN mode = 'delta' THEN output_tokens WHEN output_tokens >= coalesce(lag(output_tokens) OVER w, 0) THEN output_tokens - coalesce(lag(output_tokens) OVER w, 0) END AS o
    FROM td_usage WINDOW w AS (PARTITION BY trace_id ORDER BY started_ns))"""


@register("E7_cumulative_delta", f"{_ADDED} SELECT trace_id, span_id, i AS input, o AS output FROM a")
def cumulative(spark, sf_dir):
    rows = ledger.contributions(ledger.usage_rows(_calls(spark, sf_dir)))
    return rows.select("trace_id", "span_id", F.col("added_input.value").alias("input"), F.col("added_output.value").alias("output"))


_TOTALS = f"""{_ADDED}, t AS (SELECT trace_id, count(*) AS span_count, CASE WHEN count(*) = count(i) THEN sum(i)::BIGINT END AS input, CASE WHEN count(*) = count(o) THEN sum(o)::BIGINT END AS output FROM a GROUP BY trace_id)"""


@register("K6_usage_ledger", f"""{_TOTALS} SELECT trace_id, span_count, span_count AS usage_rows, 0 AS tool_calls, 0 AS retry_attempts, input, output, CASE WHEN output IS NULL THEN 'incomplete_contributions' END AS output_reason,
  input + output AS total, 100000 AS context_limit, (input + output)::DOUBLE / 100000 AS context_ratio FROM t""")
def usage(spark, sf_dir):
    summary = ledger.usage_ledger(_calls(spark, sf_dir))[1]
    return summary.select("trace_id", "span_count", "usage_rows", "tool_calls", "retry_attempts", "input", "output", "output_reason", "total", "context_limit", "context_ratio")


@register("K6_usage_issues", f"{_ADDED} SELECT trace_id, span_id, 'cumulative_decrease' AS code FROM a WHERE o IS NULL")
def usage_issues(spark, sf_dir):
    return ledger.usage_ledger(_calls(spark, sf_dir))[2].select("trace_id", "span_id", "code")


@register("K7_validate_ledger", "SELECT '' AS trace_id, '' AS span_id, '' AS violation WHERE false")
def valid(spark, sf_dir):
    return ledger.validate(ledger.usage_ledger(_calls(spark, sf_dir))[0])


@register("D9_estimate_cost", f"""{_ADDED}, c AS (SELECT trace_id, i * (CASE provider WHEN 'openai' THEN 2500 ELSE 3000 END) + o * (CASE provider WHEN 'openai' THEN 10000 ELSE 15000 END) AS nano FROM a)
  SELECT trace_id, CASE WHEN count(*) = count(nano) THEN sum(nano)::BIGINT END AS cost_nano, CASE WHEN count(*) > count(nano) THEN 'unknown tokens' END AS reason FROM c GROUP BY trace_id""")
def cost(spark, sf_dir):
    prices = [("openai", {"input": "2.5", "output": "10"}), ("anthropic", {"input": "3", "output": "15", "cache_read_input": "0.3", "cache_write_input": "3.75"})]
    doc = {"schema": rates.SCHEMA, "as_of": "2026-01-01", "currency": "USD", "rates": [{"provider": p, "model": "m1", "per_million_tokens": x} for p, x in prices]}
    path = folder(spark, "rates")
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.text(path)
    found = ledger.estimate_cost(ledger.usage_ledger(_calls(spark, sf_dir))[0], rates.load_rates(spark, path).rates)
    return found.select("trace_id", (F.col("cost").cast("decimal(38,9)") * 1_000_000_000).cast("bigint").alias("cost_nano"), "reason")


#: a book of rates, as (provider, input, output) per million tokens
_BOOK = (("anthropic", "3", "15"), ("openai", "2.5", "10"), ("unused", "1", "1"))


@register("A11_D18_N4_rate_book", f"""{sql('td_usage')}, book AS (SELECT * FROM (VALUES ('anthropic', 0, '3'), ('openai', 1, '2.5')) q(provider, position, rate))
  SELECT trace_id, span_id, u.provider || '/m1' AS rate_key, position, rate AS input_rate FROM td_usage u JOIN book b ON b.provider = u.provider""")
def rated_calls(spark, sf_dir):
    """Every call with its entry in a rate file, and the entry's place among the sorted keys."""
    entries = [{"provider": p, "model": "m1", "per_million_tokens": {"input": i, "output": o}} for p, i, o in _BOOK]
    path = folder(spark, "rates")
    spark.createDataFrame([(json.dumps({"schema": rates.SCHEMA, "as_of": "2026-01-01", "currency": "USD", "rates": entries}),)], "value string").coalesce(1).write.text(path)
    book = rates.load_rates(spark, path)
    # a book is bounded by the size of its file
    keys = book.keys().withColumn("position", F.row_number().over(Window.orderBy("rate_key")) - 1)
    rated = book.rates.select("provider", F.concat_ws("/", "provider", "model").alias("rate_key"), F.regexp_replace(F.regexp_replace(F.col("input").cast("string"), "0+$", ""), r"\.$", "").alias("input_rate"))
    calls = view(spark, sf_dir, "td_usage").select("trace_id", "span_id", "provider")
    return calls.join(F.broadcast(rated.join(keys, "rate_key")), "provider").select("trace_id", "span_id", "rate_key", "position", "input_rate")


@register("K7_broken_ledger", f"{_ADDED} SELECT trace_id, span_id, unnest(CASE WHEN o IS NULL THEN ['observed_input: negative'] ELSE ['observed_input: negative', 'added_output: value and reason'] END) AS violation FROM a")
def broken(spark, sf_dir):
    """Ledger rows whose input was made negative and whose known output lost its value."""
    rows = ledger.usage_ledger(_calls(spark, sf_dir))[0]
    rows = rows.withColumn("observed_input", F.col("observed_input").withField("value", F.lit(-1).cast("bigint"))).withColumn("added_output", F.col("added_output").withField("value", F.lit(None).cast("bigint")))
    return ledger.validate(rows.withColumn("added_output", F.col("added_output").withField("reason", F.when(F.col("added_output.reason").isNotNull(), F.col("added_output.reason")))))


@register("D13_H5_issue_order", f"""{_ADDED}, i AS (SELECT trace_id, span_id, 'cumulative_decrease' AS code FROM a WHERE o IS NULL)
  SELECT i.trace_id, span_id, code, row_number() OVER (PARTITION BY i.trace_id ORDER BY code, span_id) - 1 AS position, 'cumulative_decrease' AS codes FROM i""")
def issue_order(spark, sf_dir):
    issues = materialize(ledger.usage_ledger(_calls(spark, sf_dir))[2], "issues")
    codes = timeline.issue_codes(issues).select("trace_id", F.array_join("codes", ",").alias("codes"))
    return timeline.ordered_issues(issues).select("trace_id", "span_id", "code", "position").join(codes, "trace_id")


@register("D15_D16_usage_by_branch", f"""{_ADDED} SELECT trace_id, CASE WHEN prev IS NULL THEN '' ELSE trace_id || '-1' END AS branch_span_id, count(*) AS calls, sum(i)::BIGINT AS input,
  CASE WHEN count(*) = count(o) THEN sum(o)::BIGINT END AS output, CASE WHEN count(*) > count(o) THEN 'incomplete_contributions' END AS output_reason,
  CASE WHEN count(*) = count(o) THEN sum(i)::BIGINT + sum(o)::BIGINT END AS total, 'gen_ai.usage.output_tokens' AS sources FROM a GROUP BY ALL""")
def usage_by_branch(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    placed = tree.span_positions(calls)[0].select("trace_id", "span_id", "branch_span_id")
    found = ledger.usage_by(ledger.usage_ledger(calls)[0].join(placed, ["trace_id", "span_id"]), "branch_span_id")
    return found.select(
        "trace_id", "branch_span_id", "calls", F.col("input.value").alias("input"), F.col("output.value").alias("output"), F.col("output.reason").alias("output_reason"),
        F.col("total.value").alias("total"), F.array_join("output.sources", ",").alias("sources"),
    )


#: four turns are attempts of one call: some unknown, some beyond what a sum can hold, every sixth a roll-up
_MOST = 9223372036854775807
_RETRIES = f"""{sql('td_usage')}, u AS (SELECT *, started_ns // 1000 AS turn FROM td_usage),
  r AS (SELECT trace_id, span_id, trace_id || '-call' || (turn // 4) AS logical_call_id, CASE WHEN turn % 9 <> 8 THEN turn % 4 + 1 END AS attempt, turn % 6 = 5 AS rolled,
    CASE WHEN turn % 7 = 3 THEN NULL WHEN turn % 5 = 4 THEN {_MOST} ELSE input_tokens END AS i, output_tokens AS o FROM u)"""


def _retries(spark, sf_dir):
    rows, turn = view(spark, sf_dir, "td_usage"), F.call_function("div", F.col("started_ns"), F.lit(1000))
    call = F.concat("trace_id", F.lit("-call"), F.call_function("div", turn, F.lit(4)).cast("string"))
    rows = rows.withColumn("mode", F.when(turn % 6 == 5, "rollup").otherwise("delta"))
    rows = rows.withColumn("input_tokens", F.when(turn % 7 == 3, "many").when(turn % 5 == 4, str(_MOST)).otherwise(F.col("input_tokens").cast("string")))

    def more(attr):
        return attr("spanloom.retry.logical_call_id", "str", call), attr("spanloom.retry.attempt", "int", F.when(turn % 9 != 8, turn % 4 + 1).otherwise(0))

    return ledger.usage_ledger(_calls(spark, sf_dir, rows, more))[0]


@register("D16_usage_by_retry", f"""{_RETRIES}, g AS (SELECT trace_id, logical_call_id, count(*) AS calls, count(*) FILTER (NOT rolled) AS contributing, count(attempt) AS attempts,
    count(*) FILTER (NOT rolled AND i IS NULL) AS gaps, sum(i::HUGEINT) FILTER (NOT rolled) AS i, sum(o)::BIGINT AS all_o, sum(o) FILTER (NOT rolled)::BIGINT AS o FROM r GROUP BY ALL),
  v AS (SELECT *, CASE WHEN contributing = 0 THEN 'no_observations' WHEN i > {_MOST} THEN 'overflow' WHEN gaps > 0 THEN 'incomplete_contributions' END AS why FROM g)
  SELECT trace_id, logical_call_id, calls, contributing, attempts, CASE WHEN why IS NULL THEN i::BIGINT END AS input, why AS input_reason, o AS output,
    CASE WHEN contributing > 0 THEN 'gen_ai.usage.input_tokens' ELSE '' END AS input_sources, CASE WHEN why IS NULL AND i + o <= {_MOST} THEN (i + o)::BIGINT END AS total,
    CASE WHEN why IS NOT NULL THEN 'input_or_output_unknown' WHEN i + o > {_MOST} THEN 'overflow' END AS total_reason FROM v""")
def usage_by_retry(spark, sf_dir):
    found = ledger.usage_by(_retries(spark, sf_dir), "logical_call_id")
    return found.select(
        "trace_id", "logical_call_id", "calls", "contributing", "attempts", F.col("input.value").alias("input"), F.col("input.reason").alias("input_reason"), F.col("output.value").alias("output"),
        F.array_join("input.sources", ",").alias("input_sources"), F.col("total.value").alias("total"), F.col("total.reason").alias("total_reason"),
    )


@register("D17_K5_retry_attempts", f"""{_RETRIES} SELECT trace_id, logical_call_id, span_id, attempt, NOT rolled AS contributes, i AS input, CASE WHEN i IS NULL THEN 'rejected_observation' END AS input_reason,
  o AS output, 5 AS n_sources, 'gen_ai.usage.cache_creation.input_tokens' AS first_source FROM r""")
def retry_attempts(spark, sf_dir):
    found = ledger.retry_attempts(_retries(spark, sf_dir))
    return found.select(
        "trace_id", "logical_call_id", "span_id", "attempt", "contributes", F.col("input.value").alias("input"), F.col("input.reason").alias("input_reason"), F.col("output.value").alias("output"),
        F.size("sources").alias("n_sources"), F.col("sources")[0]["attribute"].alias("first_source"),
    )


@register("C8_K4_reconcile_rollups", f"""{sql('td_usage')}, t AS (SELECT trace_id, span_id, started_ns // 1000 AS turn, input_tokens, output_tokens FROM td_usage),
  b AS (SELECT r.trace_id, r.span_id, any_value(r.input_tokens) - sum(s.input_tokens) AS input, any_value(r.output_tokens) - sum(s.output_tokens) AS output
    FROM t r JOIN t s ON s.trace_id = r.trace_id AND s.turn > r.turn AND s.turn % 3 <> 0 AND (r.turn >= 3 OR s.turn < 3) WHERE r.turn % 3 = 0 GROUP BY r.trace_id, r.span_id)
  SELECT trace_id, span_id, 'unexplained_delta' AS code, 'input' AS signal, input::BIGINT AS delta FROM b WHERE input <> 0
  UNION ALL SELECT trace_id, span_id, 'unexplained_delta', 'output', output::BIGINT FROM b WHERE output <> 0""")
def rollups(spark, sf_dir):
    """Every third turn is a roll-up of those below it; the parent of the fourth is lost."""
    rows = view(spark, sf_dir, "td_usage")
    lost = F.when(F.col("started_ns") == 3000, F.lit("lost")).otherwise(F.col("prev"))
    rows = rows.withColumn("prev", lost).withColumn("mode", F.when(F.col("started_ns") % 3000 == 0, "rollup").otherwise("delta"))
    calls = _calls(spark, sf_dir, rows)
    return ledger.reconcile_rollups(calls, ledger.usage_ledger(calls)[0])


def _responses(spans):
    """The calls as responses: every turn but each third names the one before it."""
    attr = lambda key, value: F.struct(F.lit(key).alias("key"), F.lit("str").alias("value_type"), value.cast("string").alias("value"))
    return F.array(
        attr("gen_ai.operation.name", F.lit("chat")), attr("gen_ai.response.id", F.col("span_id")), attr("gen_ai.request.previous_response.id", F.when(F.col("started_ns") % 3000 != 0, F.col("prev"))),
        attr("gen_ai.conversation.compacted", F.when(F.col("compacted"), F.lit("true"))), attr("gen_ai.usage.input_tokens", F.col("output_tokens")), attr("gen_ai.usage.output_tokens", F.col("input_tokens")),
    )


_LINKS = "array<struct<trace_id:string,span_id:string,trace_state:string,attributes:array<struct<key:string,value_type:string,value:string>>,dropped_attributes_count:bigint,flags:bigint>>"


@register("L6_compaction_report", f"""{sql('td_usage')}, o AS (SELECT *, CASE WHEN started_ns % 3000 <> 0 THEN prev END AS p FROM td_usage)
  SELECT o.trace_id, row_number() OVER (PARTITION BY o.trace_id ORDER BY o.started_ns) AS sequence, o.span_id, o.p AS previous_id, CASE WHEN o.p IS NULL THEN 'root' ELSE 'linked' END AS chain_status,
    CASE WHEN o.compacted THEN 'detected' ELSE 'unknown' END AS compaction, o.output_tokens - b.output_tokens AS input_shift,
    CASE WHEN NOT o.compacted OR b.span_id IS NULL THEN 'unknown' WHEN o.output_tokens < b.output_tokens THEN 'detected' ELSE 'not_detected' END AS context_reset
  FROM o LEFT JOIN o b ON b.span_id = o.p""")
def compaction(spark, sf_dir):
    from spanloom.operators import chain

    rows = view(spark, sf_dir, "td_usage")
    zero = F.lit(0).cast("bigint")
    spans = rows.select("trace_id", "span_id", F.col("started_ns").cast("bigint").alias("started_ns"), _responses(rows).alias("attributes"), F.array().cast(_LINKS).alias("links"), zero.alias("dropped_attributes_count"), zero.alias("dropped_links_count"))
    found = chain.compaction_report(spans)[0]
    return found.select("trace_id", "sequence", "span_id", "previous_id", "chain_status", "compaction", "input_shift", "context_reset")


#: fixed values: patterns and replacements of the default policy's masks
_MASKS = [
    ("AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}", "‹redacted›"),
    (r"(?i)Bearer\s+[A-Za-z0-9._~+/-]{8,}={0,2}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "‹redacted›"),
    (r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", "‹redacted-email›"),
    (r"/Users/[^/\s]+|/home/[^/\s]+", "/home/‹redacted›"),
]


def _nested(text: str) -> str:
    for pattern, new in _MASKS:
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return text


@register("F8_redact_text", f"""{sql('td_text')} SELECT id, CASE WHEN {' OR '.join(f"regexp_matches(text, '{p}')" for p, _ in _MASKS)} THEN 'mask' WHEN text IS NOT NULL THEN 'retain' END AS action,
  sha256({_nested('text')}) AS digest FROM td_text""")
def redact_text(spark, sf_dir):
    from spanloom.operators import redaction

    # whole texts: the policy's bound is for attributes
    policy = dataclasses.replace(redaction.DEFAULT_POLICY, max_value_bytes=16 << 20)
    found = redaction.redact_column(view(spark, sf_dir, "td_text"), "text", policy)
    return found.select("id", F.col("redacted_action").alias("action"), F.sha2(F.col("redacted_value").cast("binary"), 256).alias("digest"))
