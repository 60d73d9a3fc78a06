"""Rules of the operators on hand-made rows."""

import random

from pyspark.sql import functions as F

from spanloom.functions import scalars as S
from spanloom.operators import chain, critical, json_redaction, ledger, redaction, timeline, tree
from spanloom.sources import readers

SPAN = "trace_id string, span_id string, parent_span_id string, name string, kind int, status int, started_ns long, ended_ns long, duration_ns long, ord long"


def spans(spark, rows):
    return spark.createDataFrame([("t", i, p, i, 1, 1, a, b, b - a, k) for k, (i, p, a, b) in enumerate(rows, 1)], SPAN)


def one(spark, value, kind, make):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first().x


def test_scalar_formats(spark):
    for ns, text in ((1_820_000_000, "1.82s"), (19_999_999, "19ms"), (404_999, "404µs"), (5, "5ns"), (0, "0ns"), (-7, "-7ns")):
        assert one(spark, ns, "long", S.format_duration) == text
    assert one(spark, -3_000_000, "long", S.signed_duration) == "-3ms" and one(spark, 0, "long", S.signed_duration) == "0"
    assert one(spark, "a   b\tc ", "string", lambda c: S.clean_label(c, 4)) == "a b…"
    assert one(spark, "ééé", "string", lambda c: S.truncate_utf8(c, 5)) == "é…" and one(spark, "abcdef", "string", lambda c: S.truncate_utf8(c, 2)) == ".."
    assert one(spark, "2024-01-02T03:04:05.123456789Z", "string", S.event_time_ns) == 1704164645123456789
    assert one(spark, "soon", "string", S.event_time_ns) == 0
    assert one(spark, " 10, x,2,10,-1", "string", lambda c: S.parse_unblocks(c)[0]) == [10, 2]
    assert one(spark, " 10, x,2,10,-1", "string", lambda c: S.parse_unblocks(c)[1]) == ["x", "-1"]
    assert one(spark, float("nan"), "double", S.seconds_to_ns) == 0 and one(spark, 1e12, "double", S.seconds_to_ns) == 9 * 10**18
    assert one(spark, "Client", "string", S.parse_kind) == 3 and one(spark, "9", "string", S.parse_kind) is None
    for a, b, want in ((0, 100, (0, 10)), (95, 100, (9, 1)), (100, 100, (9, 1)), (-5, 3, (0, 1))):
        df = spark.createDataFrame([(a, b)], "a long, b long")
        o, w = S.bar_geometry(F.col("a"), F.col("b"), F.lit(0), F.lit(100), 10)
        got = tuple(df.select(o, w).first())
        assert got == want, (a, b, got)


def test_tree_drops_what_has_no_way_to_the_root(spark):
    rows = [("r", None, 0, 100), ("b", "r", 50, 60), ("a", "r", 10, 20), ("a1", "a", 11, 12), ("r2", None, 0, 5), ("x", "r2", 0, 1), ("o", "gone", 0, 1), ("s", "s", 0, 1), ("c1", "c2", 0, 1), ("c2", "c1", 0, 1), ("c3", "c1", 0, 1), ("a", "b", 0, 1)]
    got = [(r.span_id, r.depth) for r in tree.preorder(tree.assemble_tree(spans(spark, rows))).orderBy("position").collect()]
    assert got == [("r", 0), ("a", 1), ("a1", 2), ("b", 1)]


def test_positions_keep_orphans_and_cycles(spark):
    rows = [("r", None, 0, 9), ("k", "r", 1, 9), ("kk", "k", 2, 9), ("o", "gone", 3, 9), ("o1", "o", 4, 9), ("x", "y", 6, 9), ("y", "z", 5, 9), ("z", "x", 7, 9), ("below", "x", 8, 9)]
    placed, issues = tree.span_positions(spans(spark, rows))
    got = {r.span_id: (r.depth, r.branch_span_id) for r in placed.collect()}
    # the earliest span into the cycle is y: its parent z is one step away, x two
    assert got == {"r": (0, ""), "k": (1, "k"), "kk": (2, "k"), "o": (0, "o"), "o1": (1, "o1"), "z": (1, "z"), "x": (2, "z"), "y": (3, "z"), "below": (3, "z")}
    assert sorted((r.code, r.span_id) for r in issues.collect()) == [("orphan_span", "o"), ("parent_cycle", "y")]


def test_waterfall_of_a_small_build(spark):
    rows = [("root", None, 0, 600), ("compile", "root", 0, 400), ("parse", "compile", 0, 100), ("codegen", "compile", 200, 400), ("link", "root", 500, 550)]
    got = [(r.span_id, r.depth, r.offset, r.width) for r in timeline.waterfall(spans(spark, rows), 60, 20).orderBy("position").collect()]
    assert got == [("root", 0, 0, 60), ("compile", 1, 0, 40), ("parse", 2, 0, 10), ("gap:compile:0", 2, 10, 10), ("codegen", 2, 20, 20), ("gap:root:0", 1, 40, 10), ("link", 1, 50, 5), ("gap:root:1", 1, 55, 5)]
    many = [("root", None, 0, 600)] + [(f"u{i}", "root", 10 * i, 10 * i + 5 + i) for i in range(6)] + [("deep", "u0", 0, 1)]
    found = timeline.waterfall(spans(spark, many), 60, 3, with_gaps=False).orderBy("position").collect()
    assert [r.span_id for r in found] == ["root", "rollup:root", "u4", "u5"]
    assert (found[1].name, found[1].work_ns, found[1].bar_duration_ns) == ("(+4 more)", 5 + 6 + 7 + 8, 38)


def units(spark, rows):
    return spark.createDataFrame([("t", f"s{k}", k, d, u, b) for k, (u, d, b) in enumerate(rows)], "trace_id string, span_id string, ord long, duration_ns long, unit_text string, unblocks_text string")


def report_of(spark, rows):
    report, path, issues = critical.critical_path(units(spark, rows))
    return report.first(), [r.unit for r in path.orderBy("position").collect()], sorted((r.code, r.unit) for r in issues.collect())


def test_critical_paths(spark):
    r, path, issues = report_of(spark, [("0", 100, "1,2"), ("1", 300, "3"), ("2", 50, "3"), ("3", 100, None)])
    assert (r.status, r.critical_ns, r.total_work_ns, r.edge_count, path, issues) == ("ok", 500, 550, 4, [0, 1, 3], [])
    r, path, issues = report_of(spark, [("0", 1, "1"), ("1", 1, "0"), ("2", 5, None)])
    assert (r.status, r.critical_ns, path, issues) == ("cyclic", None, [], [("cycle", 0), ("cycle", 1)])
    r, _, issues = report_of(spark, [("0", 1, "99"), ("1", 1, None)])
    assert (r.status, issues) == ("missing", [("missing_unit", 99)])
    r, _, issues = report_of(spark, [("0", 1, "1,x"), ("0", 1, "1"), ("1", 1, None), ("bad", 1, None), (None, 1, "1")])
    assert r.status == "malformed" and {c for c, _ in issues} == {"invalid_unblocks", "duplicate_unit", "invalid_unit", "unblocks_without_unit"}
    r, path, _ = report_of(spark, [(None, 5, None)])
    assert (r.status, path) == ("no_edge", [])
    r, path, _ = report_of(spark, [("0", 5, "2"), ("1", 5, "2"), ("2", 1, None), ("3", 6, None)])
    assert (r.critical_ns, path) == (6, [0, 2])  # ties: smaller end unit, smaller predecessor


def test_longest_paths_of_random_graphs(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for t in range(25):
        n = rng.randint(1, 9)
        d = [rng.randint(1, 50) for _ in range(n)]
        edges = {u: [v for v in range(u + 1, n) if rng.random() < 0.4] for u in range(n)}
        best = [0] * n
        for v in range(n):
            best[v] = d[v] + max((best[u] for u in range(v) if v in edges[u]), default=0)
        want[f"t{t}"] = max(best)
        rows += [(f"t{t}", f"s{u}", u, d[u], str(u), ",".join(map(str, edges[u])) or None) for u in range(n)]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, ord long, duration_ns long, unit_text string, unblocks_text string")
    assert {r.trace_id: r.critical_ns for r in critical.critical_path(df)[0].collect()} == want
    assert {r.trace_id: r.critical_ns for r in critical.critical_path_lenient(df).collect()} == want


CALL = "trace_id string, span_id string, parent_span_id string, started_ns long, ended_ns long, attributes array<struct<key:string,value_type:string,value:string>>"


def call(span, at, provider="openai", **counts):
    attrs = [("gen_ai.provider.name", "str", provider), *((k.replace("__", "."), "int", str(v)) for k, v in counts.items())]
    return ("t", span, None, at, at, attrs)


def test_ledger_rules(spark):
    rows = [
        call("a", 1, gen_ai__usage__input_tokens=10, gen_ai__usage__prompt_tokens=11),
        call("b", 2, gen_ai__usage__input_tokens=-4),
        call("c", 3, "anthropic", anthropic__usage__input_tokens=5, anthropic__usage__cache_read_input_tokens=2, anthropic__usage__output_tokens=1),
        call("d", 4, gen_ai__usage__input_tokens=3, gen_ai__usage__cache_read__input_tokens=9, gen_ai__usage__output_tokens=2),
    ]
    led, summary, issues = ledger.usage_ledger(spark.createDataFrame(rows, CALL))
    got = {r.span_id: r for r in led.collect()}
    assert got["a"].observed_input.reason == "conflict" and got["b"].observed_input.reason == "rejected_observation"
    assert got["c"].observed_input.value == 7 and got["c"].observed_total.value == 8
    assert got["d"].observed_cache_read.reason == "impossible_subset" and got["d"].observed_total.value == 5
    s = summary.first()
    assert (s.input, s.input_reason, s.output) == (None, "incomplete_contributions", 3)
    codes = sorted((r.span_id, r.code) for r in issues.collect())
    assert codes == [("a", "conflicting_usage"), ("b", "negative_count"), ("d", "cache_read_exceeds_input")]
    assert ledger.validate(led).count() == 0


def test_cost_is_exact(spark):
    rows = [call("a", 1, gen_ai__usage__input_tokens=3, gen_ai__usage__output_tokens=1, gen_ai__usage__cache_read__input_tokens=1, gen_ai__usage__cache_creation__input_tokens=0, gen_ai__usage__reasoning__output_tokens=0)]
    led = ledger.usage_ledger(spark.createDataFrame(rows, CALL))[0]
    rates = spark.createDataFrame([("openai", "", "0.0015", "2", "0.5", None, None)], "provider string, model string, input string, output string, cache_read string, cache_write string, reasoning string")
    # 2 * 0.0015 + 0.5 + 2 millionths
    assert ledger.estimate_cost(led, rates).first().cost == "0.000002503"
    assert ledger.estimate_cost(led, rates.limit(0)).first().reason == "missing rate"


OBS = "trace_id string, span_id string, started_ns long, attributes array<struct<key:string,value_type:string,value:string>>, links array<struct<trace_id:string,span_id:string,trace_state:string,attributes:array<struct<key:string,value_type:string,value:string>>,dropped_attributes_count:bigint,flags:bigint>>, dropped_attributes_count long, dropped_links_count long"


def response(span, at, rid=None, prev=None, links=(), dropped=0, **more):
    attrs = [("gen_ai.response.id", "str", rid), ("gen_ai.request.previous_response.id", "str", prev), *((k.replace("__", "."), "str", v) for k, v in more.items())]
    return ("t", span, at, [a for a in attrs if a[2]], [("t", x, "", [], 0, 0) for x in links], 0, dropped)


def test_chain_statuses(spark):
    rows = [
        response("s1", 1, "r1", gen_ai__usage__input_tokens="100"), response("s2", 2, "r2", "r1", gen_ai__usage__input_tokens="40", gen_ai__conversation__compacted="true"), response("s3", 3, "r3", "r2"),
        response("s4", 4, "r4", "r2"), response("s5", 5, "r5", "nowhere"), response("s6", 6, "dup"), response("s7", 7, "dup"), response("s8", 8, "r8", "dup"), response("s9", 9, "r9", links=["s1"]),
        response("s10", 10, "r10", "r2", links=["s1"]), response("s11", 11, "r11", dropped=1), response("s12", 12, "r12", "r13"), response("s13", 13, "r13", "r12"),
    ]
    found, warnings = chain.compaction_report(spark.createDataFrame(rows, OBS))
    got = {r.span_id: r for r in found.collect()}
    status = {k: r.chain_status for k, r in got.items()}
    assert status == {
        "s1": "root", "s2": "branched", "s3": "branched", "s4": "branched", "s5": "missing_ancestry", "s6": "root", "s7": "root", "s8": "ambiguous", "s9": "branched", "s10": "conflict", "s11": "unknown", "s12": "linked", "s13": "linked",
    }
    assert (got["s2"].input_shift, got["s2"].context_reset) == (-60, "detected")
    assert sorted(r.code for r in warnings.collect()) == ["ambiguous_previous_response", "link_attribute_conflict", "missing_previous_response", "response_chain_cycle", "response_chain_cycle", "truncated_links"]
    assert [r.span_id for r in found.orderBy("sequence").collect()][-2:] == ["s12", "s13"]


def test_redaction_of_spans(spark):
    attrs = [("http.authorization", "str", "abc"), ("gen_ai.usage.input_tokens", "int", "5"), ("gen_ai.input.messages", "str", "hello"), ("note", "str", "mail me@x.org $1"), ("raw", "bytes", "00ff"), ("db.url", "str", "http://h/p?k=v#f"), ("odd", "what", "x")]
    row = [("t", "s", None, "GET /home/joe/x", 1, 1, 0, 1, 1, 1, attrs)]
    df = spark.createDataFrame(row, SPAN + ", attributes array<struct<key:string,value_type:string,value:string>>")
    out = redaction.redact_spans(df).first()
    got = {a.key: (a.value_type, a.value) for a in out.attributes}
    digest = json_redaction.digest("00ff")
    assert out.name == "GET /home/‹redacted›/x"
    assert got == {"http.authorization": ("str", "‹redacted›"), "gen_ai.usage.input_tokens": ("int", "5"), "note": ("str", "mail ‹redacted-email› $1"), "raw": ("str", digest), "db.url": ("str", "http://h/p?‹redacted›#f")}
    seen = {r.path: r.action for r in redaction.redaction_preview(df).collect()}
    path = lambda key: json_redaction.safe_path(f'spans[0].attributes["{key}"]')
    assert seen[path("gen_ai.input.messages")] == "drop" and seen[path("odd")] == "drop"
    again = redaction.redact_spans(spark.createDataFrame([out], df.schema)).first()
    assert again == out


def test_build_and_test_reports(spark):
    page = 'x const UNIT_DATA = [\n{"i":0,"name":"a","version":"1","start":0.5,"duration":2,"target":" ","unblocked_units":[1],"sections":[["front",{"start":0,"end":9}]]},\n{"i":1,"name":"b","version":"2","start":3,"duration":1,"target":"build \\"];\\"","unblocked_units":[],"sections":null}\n];'
    found = readers.cargo_spans(readers.cargo_units(spark.createDataFrame([("r", page)], "run_id string, value string")), spark.createDataFrame([("r", 100, 10**12)], "run_id string, started_ns long, ended_ns long"))
    got = {(r.ord, r.section): (r.name, r.started_ns, r.ended_ns, [a.key for a in r.attributes]) for r in found.collect()}
    assert got[0, None] == ("a v1", 500000100, 2500000100, ["cargo.unit", "cargo.unblocks"])
    assert got[0, 0] == ("front", 500000100, 2500000100, ["cargo.section"]) and got[1, None][0] == 'b v2 (build "];")'
    bare = '<testsuite name="" time="3"><testcase name="x" time="1"><failure/></testcase><testcase name="y" time="1"><skipped/></testcase></testsuite>'
    rows = readers.junit_cases(spark.createDataFrame([("r", bare)], "run_id string, value string")).orderBy("case_no").collect()
    assert [(r.case_name, r.failed, r.suite_seconds) for r in rows] == [("x", True, 3.0), ("y", False, 3.0)]


def test_retry_groups_forget_no_attempt(spark):
    def call(span, turn, value, mode="delta", call="c1"):
        attributes = [("gen_ai.usage.input_tokens", "int", value), ("gen_ai.usage.output_tokens", "int", "1"), ("spanloom.usage.mode", "str", mode), ("spanloom.retry.logical_call_id", "str", call), ("spanloom.retry.attempt", "int", str(turn))]
        return ("t", span, turn, turn, attributes)

    most = str(2**63 - 1)
    rows = [call("a", 1, "5"), call("b", 2, "many"), call("c", 3, "7", "rollup"), call("d", 1, most, call="c2"), call("e", 2, "1", call="c2"), call("f", 1, "3", "rollup", "c3")]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, started_ns long, ended_ns long, attributes array<struct<key:string,value_type:string,value:string>>")
    found = ledger.usage_ledger(spans)[0]
    got = {r.logical_call_id: (r.calls, r.contributing, r.attempts, r.input.value, r.input.reason, r.output.value, r.total.reason, list(r.input.sources)) for r in ledger.usage_by(found, "logical_call_id").collect()}
    key = ["gen_ai.usage.input_tokens"]
    assert got == {
        "c1": (3, 2, 3, None, "incomplete_contributions", 2, "input_or_output_unknown", key),
        "c2": (2, 2, 2, None, "overflow", 2, "input_or_output_unknown", key),
        "c3": (1, 0, 1, None, "no_observations", None, "input_or_output_unknown", []),
    }
    attempts = {(r.logical_call_id, r.attempt): (r.input.value, r.input.reason, r.contributes, [s.attribute for s in r.sources]) for r in ledger.retry_attempts(found).collect()}
    both = ["gen_ai.usage.input_tokens", "gen_ai.usage.output_tokens"]
    assert attempts["c1", 1] == (5, None, True, both) and attempts["c1", 2] == (None, "rejected_observation", True, both) and attempts["c1", 3] == (7, None, False, both)
    assert len(attempts) == 6
