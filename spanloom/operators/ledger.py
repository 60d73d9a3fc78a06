"""Token ledgers of model calls for all traces at once.

A count is struct<value, reason, sources>: the value is null while unknown, and the
reason says why.  Sources are the attributes behind it.  Per-row work is plain column
expressions; cumulative series are one window, totals one aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.scan import last_before, scan
from spanloom.operators.tree import marked_ancestors
from spanloom.sources.shared import materialize

SIGNALS = ("input", "output", "cache_read", "cache_write", "reasoning", "tool_input")
#: prefix of the attributes that the tracer itself writes
OWN = "spanloom"
#: fixed values: attribute names by signal, as (family, name); openai and anthropic count for that provider alone
KEYS = {
    "input": (("otel", "gen_ai.usage.input_tokens"), ("otel_deprecated", "gen_ai.usage.prompt_tokens"), ("openai", "openai.usage.input_tokens")),
    "output": (("otel", "gen_ai.usage.output_tokens"), ("otel_deprecated", "gen_ai.usage.completion_tokens"), ("openai", "openai.usage.output_tokens"), ("anthropic", "anthropic.usage.output_tokens")),
    "cache_read": (("otel", "gen_ai.usage.cache_read.input_tokens"), ("openai", "openai.usage.input_tokens_details.cached_tokens"), ("anthropic", "anthropic.usage.cache_read_input_tokens")),
    "cache_write": (("otel", "gen_ai.usage.cache_creation.input_tokens"), ("anthropic", "anthropic.usage.cache_creation_input_tokens")),
    "reasoning": (("otel", "gen_ai.usage.reasoning.output_tokens"), ("openai", "openai.usage.output_tokens_details.reasoning_tokens")),
    "tool_input": (("own", "{own}.usage.tool.input_tokens"),),
}
ANTHROPIC_INPUT = ("anthropic.usage.input_tokens", "anthropic.usage.cache_read_input_tokens", "anthropic.usage.cache_creation_input_tokens")
_SOURCE = "struct<attribute:string,value:string,value_type:string,family:string>"
_ISSUE = "struct<code:string,attribute:string>"


def _issue(code, attribute) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_col(code).cast("string").alias("code"), as_col(attribute).cast("string").alias("attribute"))


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _candidate(attrs: Column, key: str, family: str, provider: Column) -> Column:
    """What one attribute says: present, value (null if rejected), sources, issues."""
    a = attrs[key]
    present = a.isNotNull()
    if family in ("openai", "anthropic"):
        present = present & (provider == family)
    number = F.when(F.regexp_like(a["value"], F.lit(r"^[+-]?[0-9]+$")), a["value"].try_cast("bigint"))
    code = F.when(a["value_type"] != "int", "invalid_attribute_type").when(number.isNull(), "invalid_integer").when(number < 0, "negative_count")
    return F.struct(
        present.alias("present"), F.when(present & code.isNull(), number).alias("value"),
        F.when(present, F.array(F.struct(F.lit(key).alias("attribute"), a["value"].alias("value"), a["value_type"].alias("value_type"), F.lit(family).alias("family")))).otherwise(_none(_SOURCE)).alias("sources"),
        F.when(present & code.isNotNull(), F.array(_issue(code, key))).otherwise(_none(_ISSUE)).alias("issues"),
    )


def _anthropic_input(attrs: Column, provider: Column) -> Column:
    """Anthropic counts cached tokens apart, so they are added to its input."""
    parts = [_candidate(attrs, key, "anthropic", provider) for key in ANTHROPIC_INPUT]
    base, rest = parts[0], parts[1:]
    good = reduce(lambda x, y: x & y, [~p["present"] | p["value"].isNotNull() for p in rest], base["value"].isNotNull())
    total = reduce(lambda x, y: F.try_add(x, y), [F.coalesce(p["value"], F.lit(0)) for p in rest], base["value"])
    overflow = F.when(good & total.isNull(), F.array(_issue("count_overflow", ANTHROPIC_INPUT[0]))).otherwise(_none(_ISSUE))
    followed = base["value"].isNotNull()
    sources = F.when(followed, F.concat(*(p["sources"] for p in parts))).otherwise(base["sources"])
    issues = F.when(followed, F.concat(*(p["issues"] for p in parts))).otherwise(base["issues"])
    return F.struct(base["present"].alias("present"), F.when(good, total).alias("value"), sources.alias("sources"), F.concat(issues, overflow).alias("issues"))


def resolve(candidates: Column, signal: str) -> tuple[Column, Column]:
    """One count from all candidates (a rejected one, a conflict or none: unknown), and issues."""
    seen = F.filter(candidates, lambda c: c["present"])
    values = F.array_distinct(F.transform(seen, lambda c: c["value"]))
    rejected = F.exists(seen, lambda c: c["value"].isNull())
    reason = F.when(F.size(seen) == 0, "missing").when(rejected, "rejected_observation").when(F.size(values) > 1, "conflict")
    count = F.struct(F.when(reason.isNull(), F.get(values, F.lit(0))).alias("value"), reason.alias("reason"), F.flatten(F.transform(seen, lambda c: c["sources"])).alias("sources"))
    code = F.when(reason == "conflict", "conflicting_usage").when(reason.isNull() & (F.size(seen) > 1), "duplicate_usage")
    return count, F.when(code.isNotNull(), F.array(_issue(code, signal))).otherwise(_none(_ISSUE))


def added_counts(a: Column, b: Column, unknown: str) -> Column:
    """Sum of two counts: unknown for the reason `unknown` if one is, or beyond 64 bits; sources of both, sorted."""
    known = a["value"].isNotNull() & b["value"].isNotNull()
    value = F.try_add(a["value"], b["value"])
    reason = F.when(~known, unknown).when(value.isNull(), "overflow")
    return F.struct(value.alias("value"), reason.alias("reason"), F.array_sort(F.concat(a["sources"], b["sources"])).alias("sources"))


def merged_count(count: Column, counts: Column) -> Column:
    """Aggregate: the sum of a count over the rows where `counts` holds and something was said.

    One unknown among them makes it unknown, and so does a sum beyond 64 bits.  `sources`
    are the attributes behind it, distinct and sorted.
    """
    seen = counts & (F.size(count["sources"]) > 0)
    total = F.sum(F.when(seen, count["value"]).cast("decimal(38,0)"))
    fits = total <= F.lit("9223372036854775807").cast("decimal(38,0)")
    reason = F.when(F.count_if(seen) == 0, "no_observations").when(~fits, "overflow").when(F.count_if(seen & count["value"].isNull()) > 0, "incomplete_contributions")
    names = F.collect_set(F.when(seen, F.transform(count["sources"], lambda x: x["attribute"])))
    return F.struct(F.when(reason.isNull(), total.try_cast("bigint")).alias("value"), reason.alias("reason"), F.array_sort(F.array_distinct(F.flatten(names))).alias("sources"))


def row_sources(prefix: str = "observed") -> Column:
    """The distinct attributes, with their values, behind all counts of a ledger row, sorted."""
    return F.array_sort(F.array_distinct(F.concat(*(F.col(f"{prefix}_{s}.sources") for s in SIGNALS))))


def _unknown(count: Column, reason: str) -> Column:
    return F.struct(F.lit(None).cast("bigint").alias("value"), F.lit(reason).alias("reason"), count["sources"].alias("sources"))


def _invariants(df: DataFrame, prefix: str) -> DataFrame:
    """Subsets stay within their totals; `<prefix>_total` is input plus output.  Adds to `issues`."""
    c = lambda s: F.col(f"{prefix}_{s}")
    for part, whole, code in (("cache_read", "input", "cache_read_exceeds_input"), ("cache_write", "input", "cache_write_exceeds_input")):
        df = _subset(df, prefix, part, whole, code)
    over = F.coalesce(F.try_add(c("cache_read.value"), c("cache_write.value")) > c("input.value"), c("cache_read.value").isNotNull() & c("cache_write.value").isNotNull() & c("input.value").isNotNull())
    df = df.withColumn("_over", over)
    for part in ("cache_read", "cache_write"):
        df = df.withColumn(f"{prefix}_{part}", F.when(F.col("_over"), _unknown(c(part), "impossible_partition")).otherwise(c(part)))
    df = _note(df, F.col("_over"), "cache_subsets_exceed_input").drop("_over")
    df = _subset(df, prefix, "reasoning", "output", "reasoning_exceeds_output")
    df = _subset(df, prefix, "tool_input", "input", "tool_input_exceeds_input")
    df = df.withColumn(f"{prefix}_total", added_counts(c("input"), c("output"), "input_or_output_unknown"))
    return _note(df, c("total.reason") == "overflow", "count_overflow")


def _note(df: DataFrame, when: Column, code: str) -> DataFrame:
    return df.withColumn("issues", F.when(F.coalesce(when, F.lit(False)), F.concat("issues", F.array(_issue(code, F.lit(None))))).otherwise(F.col("issues")))


def _subset(df: DataFrame, prefix: str, part: str, whole: str, code: str) -> DataFrame:
    a, b = F.col(f"{prefix}_{part}"), F.col(f"{prefix}_{whole}")
    df = df.withColumn("_over", F.coalesce(a["value"] > b["value"], F.lit(False)))
    return _note(df.withColumn(f"{prefix}_{part}", F.when(F.col("_over"), _unknown(a, "impossible_subset")).otherwise(a)), F.col("_over"), code).drop("_over")


def usage_rows(spans: DataFrame, own: str = OWN) -> DataFrame:
    """One row a span: observed counts, mode, series, model, retry, and `issues` (array).

    spans: trace_id, span_id, started_ns, ended_ns, attributes.  The last attribute of a
    key counts; text attributes need the tag `str`.
    """
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform("attributes", lambda a: a["key"])), lambda k: F.struct(k.alias("key"), F.element_at(F.filter("attributes", lambda a: a["key"] == k), -1).alias("a"))))
    df = spans.withColumn("attrs", last)
    text = lambda key: F.coalesce(F.when(F.col("attrs")[key]["value_type"] == "str", F.col("attrs")[key]["value"]), F.lit(""))
    model = text("gen_ai.response.model")
    df = df.withColumn("provider", text("gen_ai.provider.name")).withColumn("model", F.when(model != "", model).otherwise(text("gen_ai.request.model")))
    df = df.withColumn("operation", text("gen_ai.operation.name")).withColumn("series", text(f"{own}.usage.series")).withColumn("mode", text(f"{own}.usage.mode"))
    df = df.withColumn("tool_call", (F.col("operation") == "execute_tool") | (text("gen_ai.tool.name") != "")).withColumn("logical_call_id", text(f"{own}.retry.logical_call_id"))
    attrs, provider = F.col("attrs"), F.col("provider")
    issues, bearing = [], []
    for signal in SIGNALS:
        found = [_candidate(attrs, key.format(own=own), family, provider) for family, key in KEYS[signal]]
        if signal == "input":
            found.append(_anthropic_input(attrs, provider))
        df = df.withColumn(f"_{signal}", F.array(*found))
        count, more = resolve(F.col(f"_{signal}"), signal)
        df = df.withColumn(f"observed_{signal}", count)
        issues += [F.flatten(F.transform(f"_{signal}", lambda c: c["issues"])), more]
        bearing.append(F.exists(f"_{signal}", lambda c: c["present"]))
    attempt, limit = (_candidate(attrs, f"{own}.{key}", "own", provider) for key in ("retry.attempt", "context.window.limit_tokens"))
    for name, c, code in (("attempt", attempt, "invalid_retry_attempt"), ("limit", limit, "invalid_context_limit")):
        df = df.withColumn(f"_{name}", c)
        bad = F.col(f"_{name}.present") & (~F.coalesce(F.col(f"_{name}.value") > 0, F.lit(False)) if name == "attempt" else F.coalesce(F.col(f"_{name}.value") <= 0, F.lit(False)))
        issues += [F.col(f"_{name}.issues"), F.when(bad, F.array(_issue(code, f"{own}.{name}"))).otherwise(_none(_ISSUE))]
        df = df.withColumn(name, F.when(F.col(f"_{name}.value") > 0, F.col(f"_{name}.value")))
    # anthropic cache counts alone make a row bear usage too
    df = df.withColumn("usage_bearing", reduce(lambda x, y: x | y, bearing))
    unknown_mode = ~F.col("mode").isin("", "delta", "cumulative", "rollup")
    issues.append(F.when(unknown_mode, F.array(_issue("invalid_usage_mode", f"{own}.usage.mode"))).otherwise(_none(_ISSUE)))
    df = df.withColumn("issues", F.concat(*issues)).withColumn("mode", F.when(F.col("mode") == "", "delta").when(unknown_mode, "invalid").otherwise(F.col("mode")))
    df = df.drop("attrs", "attributes", "_attempt", "_limit", *(f"_{s}" for s in SIGNALS))
    return _invariants(df, "observed")


def contributions(rows: DataFrame) -> DataFrame:
    """Add what every row adds to its trace: as observed, or the step of a cumulative series."""
    cumulative, delta = F.col("mode") == "cumulative", F.col("mode") == "delta"
    why = F.when(cumulative & (F.col("series") == ""), "missing_cumulative_series").when(F.col("mode") == "rollup", "rollup_excluded").when(F.col("mode") == "invalid", "invalid_usage_mode")
    before = {f"before_{s}": last_before(F.struct(F.col(f"observed_{s}.value").alias("value"))) for s in SIGNALS}
    rows = materialize(rows.withColumn("_summed", cumulative & (F.col("series") != "")), "observed")
    df = scan(rows, ["trace_id", "provider", "model", "series", "_summed"], ["started_ns", "ended_ns", "span_id"], **before).drop("_summed").withColumn("why", why)
    for s in SIGNALS:
        now, last = F.col(f"observed_{s}"), F.col(f"before_{s}")
        prior = F.when(last.isNull(), F.lit(0).cast("bigint")).otherwise(last["value"])
        fell = cumulative & F.col("why").isNull() & (now["value"] < prior)
        reason = F.when(now["value"].isNull(), now["reason"]).when(prior.isNull(), "previous_cumulative_unknown").when(fell, "cumulative_decrease")
        step = F.struct(F.when(reason.isNull(), now["value"] - prior).alias("value"), reason.alias("reason"), now["sources"].alias("sources"))
        void = F.struct(F.lit(None).cast("bigint").alias("value"), F.col("why").alias("reason"), _none(_SOURCE).alias("sources"))
        df = df.withColumn(f"added_{s}", F.when(F.col("why").isNotNull(), void).when(delta, now).otherwise(step))
        df = _note(df, fell, "cumulative_decrease")
    df = _note(df, F.col("why") == "missing_cumulative_series", "missing_cumulative_series")
    kept = df.drop(*(f"before_{s}" for s in SIGNALS)).withColumn("contributes", F.col("usage_bearing") & F.col("why").isNull()).drop("why")
    return _invariants(kept, "added")


def usage_ledger(spans: DataFrame, own: str = OWN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows, summaries and issues of every trace.

    A total is the sum over contributing rows that say something about the signal; one
    unknown among them makes it unknown.  Without such rows the roll-up rows speak.
    """
    rows = materialize(contributions(usage_rows(spans, own)), "ledger")
    aggs = [F.count("*").alias("span_count"), F.count_if("usage_bearing").alias("usage_rows"), F.count_if("tool_call").alias("tool_calls"), F.count("attempt").alias("retry_attempts")]
    for s in SIGNALS:
        rolled = F.when(F.col("mode") == "rollup", F.col(f"observed_{s}.value"))
        aggs += [merged_count(F.col(f"added_{s}"), F.col("contributes")).alias(f"{s}_sum"), F.min(rolled).alias(f"{s}_low"), F.max(rolled).alias(f"{s}_high")]
    aggs += [F.min("limit").alias("limit_low"), F.max("limit").alias("limit_high")]
    total = rows.groupBy("trace_id").agg(*aggs)
    found = {}
    for s in SIGNALS:
        spoken = F.coalesce(F.col(f"{s}_sum.reason"), F.lit("")) != "no_observations"
        rolled = F.when(F.col(f"{s}_low") == F.col(f"{s}_high"), F.col(f"{s}_low"))
        found[s] = F.when(spoken, F.col(f"{s}_sum.value")).otherwise(rolled)
        found[f"{s}_reason"] = F.when(spoken, F.col(f"{s}_sum.reason")).when(F.col(f"{s}_low").isNull(), "no_observations").when(rolled.isNull(), "conflict")
    total = total.withColumns(found)
    total = total.withColumn("total", F.try_add("input", "output")).withColumn("context_limit", F.when(F.col("limit_low") == F.col("limit_high"), F.col("limit_low")))
    total = total.withColumn("context_ratio", F.col("total").cast("double") / F.col("context_limit").cast("double"))
    summary = total.select("trace_id", "span_count", "usage_rows", "tool_calls", "retry_attempts", *SIGNALS, *(f"{s}_reason" for s in SIGNALS), "total", "context_limit", "context_ratio")
    issues = rows.select("trace_id", "span_id", F.explode("issues").alias("i")).select("trace_id", "span_id", "i.code", "i.attribute")
    return rows, summary, issues


def reconcile_rollups(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """`unexplained_delta` issues: roll-up rows that differ from the sum of their descendants.

    Descendants are found over parents, also below orphans and on cycles.
    """
    below = marked_ancestors(spans, rows.where("mode = 'rollup'")).withColumnRenamed("ancestor_id", "rollup")
    tops = rows.where("mode = 'rollup'").select("trace_id", F.col("span_id").alias("rollup"), *(F.col(f"observed_{s}.value").alias(f"top_{s}") for s in SIGNALS))
    parts = rows.where("contributes").select("trace_id", "span_id", *(F.struct(F.col(f"added_{s}.value").alias("v"), (F.size(F.col(f"added_{s}.sources")) > 0).alias("seen")).alias(s) for s in SIGNALS))
    joined = below.join(tops, ["trace_id", "rollup"]).join(parts, ["trace_id", "span_id"])
    seen = lambda s: F.col(f"{s}.seen")
    sums = [
        F.struct(
            F.first(f"top_{s}").alias("top"), F.sum(F.when(seen(s), F.col(f"{s}.v")).cast("decimal(38,0)")).alias("sum"),
            F.count_if(seen(s)).alias("n"), F.count_if(seen(s) & F.col(f"{s}.v").isNull()).alias("gaps"),
        ).alias(s)
        for s in SIGNALS
    ]
    found = joined.groupBy("trace_id", "rollup").agg(*sums)
    each = F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).alias("c")) for s in SIGNALS))
    found = found.select("trace_id", F.col("rollup").alias("span_id"), F.explode(each).alias("x")).where("x.c.n > 0 AND x.c.gaps = 0 AND x.c.top IS NOT NULL AND x.c.top <> x.c.sum")
    return found.select("trace_id", "span_id", F.lit("unexplained_delta").alias("code"), "x.signal", (F.col("x.c.top") - F.col("x.c.sum")).cast("bigint").alias("delta"))


def estimate_cost(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """(trace_id, cost, reason): exact cost by rates per million tokens, null with the first row's reason if one fails.

    rates: provider, model, input, output, cache_read, cache_write, reasoning as decimals
    of at most nine digits before and after the point; the last three may be null and
    fall back to input and output.  Rounded half up at nine places.
    """
    unit = lambda c: (F.col(c).cast("decimal(18,9)") * F.lit(1_000_000_000).cast("decimal(10,0)")).cast("decimal(18,0)")
    book = rates.select("provider", "model", F.lit(True).alias("rated"), unit("input").alias("r_in"), unit("output").alias("r_out"), *(F.coalesce(unit(c), unit(d)).alias(n) for c, d, n in (("cache_read", "input", "r_read"), ("cache_write", "input", "r_write"), ("reasoning", "output", "r_think"))))
    five = ("input", "output", "cache_read", "cache_write", "reasoning")
    said = reduce(lambda x, y: x | y, [F.size(F.col(f"observed_{s}.sources")) > 0 for s in five])
    df = rows.where(said & (F.col("mode") != "rollup")).join(book, ["provider", "model"], "left")
    v = lambda s: F.col(f"added_{s}.value")
    big = lambda x: x.cast("decimal(19,0)")
    fresh = v("input") - v("cache_read") - v("cache_write")
    plain = v("output") - v("reasoning")
    unknown = reduce(lambda x, y: x | y, [v(s).isNull() for s in five])
    reason = F.when(~F.col("contributes"), "row does not contribute").when(F.col("rated").isNull(), "missing rate").when(unknown, "unknown tokens")
    money = sum((big(n) * F.col(r) for n, r in ((v("cache_read"), "r_read"), (v("cache_write"), "r_write"), (plain, "r_out"), (v("reasoning"), "r_think"))), big(fresh) * F.col("r_in"))
    order = F.struct("started_ns", "ended_ns", "span_id")
    found = df.withColumn("reason", reason).withColumn("money", money.cast("decimal(38,0)")).groupBy("trace_id").agg(F.try_sum(F.when(F.col("reason").isNull(), F.col("money"))).alias("money"), F.count_if(F.col("reason").isNull()).alias("n"), F.min_by("reason", F.when(F.col("reason").isNotNull(), order)).alias("reason"))
    found = found.withColumn("reason", F.coalesce("reason", F.when(F.col("money").isNull() & (F.col("n") > 0), F.lit("overflow"))))
    # units of 1e-15; rounded to units of 1e-9
    nano = F.round("money", -6).cast("decimal(38,0)").cast("string")
    digits = F.lpad(nano, 40, "0")
    text = F.concat(F.regexp_replace(F.substring(digits, 1, 25), "^0+(?=.)", ""), F.lit("."), F.substring(digits, 26, 9))
    cost = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return found.select("trace_id", F.when(F.col("reason").isNull(), cost).alias("cost"), "reason")


def usage_by(rows: DataFrame, key: str) -> DataFrame:
    """Token totals of every branch, retry group or other key of a trace, as counts.

    `calls` are the rows that bear usage, `contributing` those that add to their trace,
    `attempts` those with a valid number.  Every signal is a count (see `merged_count`),
    `total` is input plus output.
    """
    aggs = [F.count("*").alias("calls"), F.count_if("contributes").alias("contributing"), F.count("attempt").alias("attempts")]
    found = rows.where("usage_bearing").groupBy("trace_id", key).agg(*aggs, *(merged_count(F.col(f"added_{s}"), F.col("contributes")).alias(s) for s in SIGNALS))
    return found.withColumn("total", added_counts(F.col("input"), F.col("output"), "input_or_output_unknown"))


def retry_attempts(rows: DataFrame) -> DataFrame:
    """Every attempt of every logical call, also those that do not contribute or are unknown, a row each.

    Counts as observed; `sources` are the distinct attributes behind the row, sorted.
    """
    own = rows.where("logical_call_id <> ''")
    return own.select("trace_id", "logical_call_id", "attempt", "span_id", "mode", "contributes", *(F.col(f"observed_{s}").alias(s) for s in (*SIGNALS, "total")), row_sources().alias("sources"))


def validate(rows: DataFrame) -> DataFrame:
    """Broken ledger invariants as rows; none if all hold."""
    broken = []
    for name in (f"{prefix}_{s}" for s in SIGNALS for prefix in ("observed", "added")):
        c = F.col(name)
        broken += [F.when(c["value"].isNotNull() == c["reason"].isNotNull(), f"{name}: value and reason"), F.when(c["value"] < 0, f"{name}: negative")]
    return rows.select("trace_id", "span_id", F.explode(F.array_compact(F.array(*broken))).alias("violation"))
