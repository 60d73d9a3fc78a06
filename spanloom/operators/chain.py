"""Chains of model responses and what compaction did to them, for all traces at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.scan import position, scan
from spanloom.operators.tree import climb
from spanloom.sources.shared import materialize

#: prefix of the attributes that the tracer itself writes
OWN = "spanloom"
_RESPONSE = "gen_ai.response.id"
#: fixed values: texts that count as booleans
TRUE = ("1", "t", "T", "TRUE", "true", "True")
FALSE = ("0", "f", "F", "FALSE", "false", "False")


def _first(attributes: Column, key: str) -> Column:
    """The first value of a key; absent and empty count alike."""
    value = F.get(F.filter(attributes, lambda a: a["key"] == key), F.lit(0))["value"]
    return F.when(value != "", value)


def observations(spans: DataFrame, own: str = OWN) -> DataFrame:
    """Recognised model spans with ids, tokens, compaction state and `warnings` (array of codes).

    spans: trace_id, span_id, started_ns, attributes, links, dropped_attributes_count,
    dropped_links_count.
    """
    a = F.col("attributes")
    of = lambda key: _first(a, key)
    provider_id, provider_prev = of(f"{own}.openai.response.id"), of(f"{own}.openai.previous_response_id")
    item, context = of(f"{own}.openai.output_item.type") == "compaction", of(f"{own}.openai.context_management.type") == "compaction"
    df = spans.select(
        "trace_id", "span_id", "started_ns", "links", "dropped_links_count", "dropped_attributes_count", of("gen_ai.operation.name").alias("operation"), of("gen_ai.provider.name").alias("provider"), of("gen_ai.conversation.id").alias("conversation_id"),
        of(_RESPONSE).alias("own_id"), of("gen_ai.request.previous_response.id").alias("own_prev"), of("gen_ai.conversation.compacted").alias("raw"), provider_id.alias("other_id"), provider_prev.alias("other_prev"),
        F.coalesce(item, F.lit(False)).alias("item"), F.coalesce(context, F.lit(False)).alias("armed"), of("gen_ai.usage.input_tokens").try_cast("bigint").alias("input_tokens"), of("gen_ai.usage.output_tokens").try_cast("bigint").alias("output_tokens"),
        F.coalesce(*(F.when(of(f"{own}.compaction.answer.{k}").isNotNull(), F.struct(F.lit(k).alias("kind"), of(f"{own}.compaction.answer.{k}").alias("value"))) for k in ("label", "hash", "fingerprint"))).alias("answer"),
    )
    known = reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in ("operation", "own_id", "own_prev", "raw", "other_id", "other_prev")])
    df = df.where(known | F.col("item") | F.col("armed"))
    yes, no = F.col("raw").isin(*TRUE), F.col("raw").isin(*FALSE)
    codes = {
        "provider_conflict": (F.col("own_id") != F.col("other_id")) | F.coalesce(F.col("own_prev") != F.col("other_prev"), F.lit(False)),
        "invalid_compaction_flag": ~yes & ~no,
        "nonconformant_false_compaction": no,
        "truncated_attributes": F.col("dropped_attributes_count") > 0,
        "truncated_links": F.col("dropped_links_count") > 0,
        "truncated_link_attributes": F.exists("links", lambda x: x["dropped_attributes_count"] > 0),
    }
    warnings = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in codes.items())))
    state = F.when(F.coalesce(yes, F.lit(False)) | F.col("item"), "detected").otherwise("unknown")
    return df.select(
        "trace_id", "span_id", "started_ns", "operation", "provider", "conversation_id", "links", "dropped_links_count", F.coalesce("own_id", "other_id").alias("response_id"), F.coalesce("own_prev", "other_prev").alias("previous_id"),
        state.alias("compaction"), "armed", "input_tokens", "output_tokens", "answer", warnings.alias("warnings"),
    )


def link_ancestry(obs: DataFrame) -> DataFrame:
    """Fill `previous_id` from a single span link; several possible ones make it ambiguous.

    Links to observations of the same trace go first; then links to other traces that
    carry a response id.
    """
    links = obs.select("trace_id", "span_id", F.explode("links").alias("l"))
    targets = obs.select("trace_id", F.col("span_id").alias("t_span"), F.col("response_id").alias("t_response")).dropDuplicates(["trace_id", "t_span"])
    inside = links.where("l.trace_id = trace_id").select("trace_id", "span_id", F.col("l.span_id").alias("t_span")).join(targets, ["trace_id", "t_span"])
    inside = inside.groupBy("trace_id", "span_id").agg(F.count("*").alias("n_in"), F.min("t_span").alias("in_span"), F.min("t_response").alias("in_response"), F.collect_set("t_response").alias("in_responses"))
    outside = links.where("l.trace_id <> trace_id").select("trace_id", "span_id", F.col("l.span_id").alias("o_span"), _first(F.col("l.attributes"), _RESPONSE).alias("o_response")).where("o_response IS NOT NULL")
    outside = outside.groupBy("trace_id", "span_id").agg(F.count("*").alias("n_out"), F.min("o_span").alias("out_span"), F.min("o_response").alias("out_response"))
    df = obs.join(inside, ["trace_id", "span_id"], "left").join(outside, ["trace_id", "span_id"], "left").na.fill(0, ["n_in", "n_out"])
    one_in, one_out = F.col("n_in") == 1, (F.col("n_in") == 0) & (F.col("n_out") == 1)
    many = (F.col("n_in") > 1) | ((F.col("n_in") == 0) & (F.col("n_out") > 1))
    df = df.withColumn("linked_span_id", F.when(one_in, F.col("in_span")).when(one_out, F.col("out_span")))
    df = df.withColumn("previous_id", F.coalesce("previous_id", F.when(one_in, F.col("in_response")).when(one_out, F.col("out_response"))))
    df = df.withColumn("ambiguous", many).withColumn("external", one_out)
    conflict = F.col("linked_span_id").isNotNull() & F.col("previous_id").isNotNull() & F.exists(F.coalesce("in_responses", F.array().cast("array<string>")), lambda r: r != F.col("previous_id"))
    df = df.withColumn("link_conflict", conflict)
    more = F.array_compact(F.array(F.when(many, F.lit("ambiguous_span_links"))))
    return df.withColumn("warnings", F.concat("warnings", more)).drop("n_in", "n_out", "in_span", "in_response", "in_responses", "out_span", "out_response", "links")


def response_order(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add `sequence`, a topological order by previous ids with (started_ns, span_id) as priority.

    A node's key is the array of right-to-left maxima of (started_ns, span_id) on its way
    from the root; nodes on or below a cycle come last and are returned as the second
    DataFrame (trace_id, span_id).
    """
    ids = obs.where("response_id IS NOT NULL").groupBy("trace_id", "response_id").agg(F.count("*").alias("n"), F.min("span_id").alias("p_span"))
    ids = ids.where("n = 1").select("trace_id", F.col("response_id").alias("previous_id"), "p_span")
    linked = obs.join(ids, ["trace_id", "previous_id"], "left").withColumn("up", F.when(F.col("p_span") != F.col("span_id"), F.col("p_span")))
    state = linked.select("trace_id", "span_id", "up", F.array(F.struct("started_ns", "span_id")).alias("path"))
    found = climb(state, {"path": F.concat})
    key = F.aggregate("path", F.array().cast("array<struct<started_ns:bigint,span_id:string>>"), lambda acc, x: F.concat(F.filter(acc, lambda y: y > x), F.array(x)))
    keys = found.select("trace_id", "span_id", key.alias("chain_key"))
    df = obs.join(keys, ["trace_id", "span_id"], "left")
    df = materialize(df.withColumn("lost", F.col("chain_key").isNull()), "keys")
    df = scan(df, ["trace_id"], ["lost", "chain_key", "started_ns", "span_id"], sequence=position())
    df = materialize(df.withColumn("sequence", F.col("sequence") + 1), "chain")
    return df.drop("chain_key", "lost"), df.where("chain_key IS NULL").select("trace_id", "span_id")


def compaction_report(spans: DataFrame, own: str = OWN) -> tuple[DataFrame, DataFrame]:
    """Ordered observations with chain status, token shifts, resets and drift; and warnings."""
    obs = materialize(link_ancestry(observations(spans, own)), "observations")
    df, cyclic = response_order(obs)
    counts = obs.where("response_id IS NOT NULL").groupBy("trace_id", "response_id").agg(F.count("*").alias("n_same"))
    before = df.join(counts.where("n_same = 1"), ["trace_id", "response_id"]).select("trace_id", F.col("response_id").alias("previous_id"), F.col("span_id").alias("p_span"), F.col("input_tokens").alias("p_in"), F.col("output_tokens").alias("p_out"), F.col("answer").alias("p_answer"))
    kids = obs.where("previous_id IS NOT NULL").groupBy("trace_id", "previous_id").agg(F.count("*").alias("n_children"))
    df = df.join(counts.withColumnRenamed("response_id", "previous_id"), ["trace_id", "previous_id"], "left").join(kids, ["trace_id", "previous_id"], "left").join(before, ["trace_id", "previous_id"], "left")
    own_row = F.col("p_span") == F.col("span_id")
    for c in ("p_in", "p_out", "p_answer"):
        df = df.withColumn(c, F.when(~own_row, F.col(c)))
    prev = F.col("previous_id")
    status = (
        F.when(F.col("ambiguous"), "ambiguous").when(prev.isNull() & (F.col("dropped_links_count") > 0), "unknown").when(prev.isNull(), "root").when(F.col("external"), "linked_external")
        .when(F.col("n_same") > 1, "ambiguous").when(F.col("n_same").isNull(), "missing_ancestry").when(F.col("n_children") > 1, "branched").otherwise("linked")
    )
    codes = F.array_compact(F.array(
        F.when(~F.col("ambiguous") & prev.isNotNull() & ~F.col("external") & (F.col("n_same") > 1), F.lit("ambiguous_previous_response")),
        F.when(~F.col("ambiguous") & prev.isNotNull() & ~F.col("external") & F.col("n_same").isNull(), F.lit("missing_previous_response")),
        F.when(~F.col("ambiguous") & F.col("link_conflict"), F.lit("link_attribute_conflict")),
    ))
    df = df.withColumn("warnings", F.concat("warnings", codes)).withColumn("chain_status", F.when(F.col("link_conflict") & ~F.col("ambiguous"), "conflict").otherwise(status))
    reset = F.when(F.col("compaction") != "detected", "unknown").when(F.col("input_tokens").isNull() | F.col("p_in").isNull(), "unknown").when(F.col("input_tokens") < F.col("p_in"), "detected").otherwise("not_detected")
    same = F.col("answer.kind") == F.col("p_answer.kind")
    drift = F.when(F.coalesce(same, F.lit(False)), F.when(F.col("answer.value") != F.col("p_answer.value"), "changed").otherwise("unchanged")).otherwise("unknown")
    out = df.select(
        "trace_id", "sequence", "span_id", "started_ns", "operation", "provider", "conversation_id", "response_id", "previous_id", "linked_span_id", "chain_status", "compaction", "armed", "input_tokens", "output_tokens",
        (F.col("input_tokens") - F.col("p_in")).alias("input_shift"), (F.col("output_tokens") - F.col("p_out")).alias("output_shift"), reset.alias("context_reset"), drift.alias("answer_drift"), "warnings",
    )
    out = materialize(out, "compaction")
    warned = out.select("trace_id", "span_id", F.explode("warnings").alias("code"))
    warned = warned.unionByName(cyclic.withColumn("code", F.lit("response_chain_cycle")))
    silent = spans.select("trace_id").distinct().join(obs.select("trace_id").distinct(), "trace_id", "left_anti")
    return out.drop("warnings"), warned.unionByName(silent.select("trace_id", F.lit(None).cast("string").alias("span_id"), F.lit("no_gen_ai_observations").alias("code")))
