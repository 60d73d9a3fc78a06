"""Operator 7: quality rules kept as a bitmask ledger.

`ledger` reads every text once and stores its measurements and one bit per failed
rule.  Policies are sets of rules named by version; `apply_policy` turns a ledger
into verdicts with one bitwise AND, and `ablation` counts, for every rule of a
policy, what it rejects and what it alone rejects, without reading a text again.

Defined results: a null or blank text has no words, so its measures are 0 and it
fails `few_words`.  Rows are judged one by one, so repeated rows and null ids pass
through unchanged; rules are exact comparisons of whole numbers, so there are no ties.
An empty table gives an empty ledger.  Further columns of the input are not read by
`ledger` and returned unchanged by `passing`.  Windows of words are compared by 64-bit
hashes.  A long text is measured whole and takes some thirty times its size while it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK, slices, span_hashes, sums, table, text_bytes, text_column, window_hashes, word_bounds

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True

#: name -> condition under which a text fails; the position is the bit.  Append only:
#: stored ledgers rely on the positions.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)
BASE = ("few_words", "repeated_windows")
#: version -> rules that reject; versions are never changed, only added
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "word_length"),
}
DEFAULT_POLICY = "v1"


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(rules) -> int:
    return sum(bit(x) for x in rules)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The measurements of every text of an Arrow column."""
    data, at = text_bytes(column)
    starts, ends, first = word_bounds(data, at)
    n = len(at) - 1
    words = span_hashes(data, starts, ends)
    windows, heads, begin = window_hashes(words, first, 3)
    owner = np.repeat(np.arange(n, dtype=np.uint64), np.diff(begin))
    _, which, count = np.unique(windows + owner * np.uint64(0xD6E8FEB86659FD93), return_inverse=True, return_counts=True)
    hit = np.zeros(len(words), bool)
    again = heads[count[which] > 1] if len(windows) else heads
    for j in range(3):
        hit[again + j] = True
    lines, repeated = np.zeros(n, np.int64), np.zeros(n, np.int64)
    whole = data.tobytes()
    for i in range(n):
        full = [x for x in whole[at[i] : at[i + 1]].split(b"\n") if x.strip()]
        lines[i], repeated[i] = len(full), len(full) - len(set(full))
    return {
        "n_words": np.diff(first),
        "word_chars": sums(~BLANK[data] & ((data & 0xC0) != 0x80), at),
        "n_symbols": sums(_SYMBOLS[data], at),
        "n_dup_lines": repeated,
        "n_repeat_words": sums(hit, first),
        "n_lines": lines,
    }


def _measures(text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                found = measure(text_column(part, text))
                yield pa.RecordBatch.from_arrays([part.column("row"), *map(pa.array, found.values())], ["row", *found])

    return run


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of `docs` whole, as the struct `row`, beside its measurements and `fail_bits`."""
    whole = docs.select(F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("row"))
    columns = ", ".join(f"{x} bigint" for x in (*MEASURES, "n_lines"))
    found = whole.mapInArrow(_measures(text_col), f"row {whole.schema['row'].dataType.simpleString()}, {columns}")
    bits = " + ".join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(RULES))
    return found.withColumn("fail_bits", F.expr(f"CAST({bits} AS BIGINT)"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements and `fail_bits` over all RULES."""
    return measured(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))).select(
        F.col("row.id").alias(id_col), *MEASURES, "n_lines", "fail_bits"
    )


def passing(docs: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows of `docs` that the policy keeps, with all their columns."""
    return apply_policy(measured(docs), policy).where("kept").select("row.*")


def apply_policy(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Add `kept`: no rule of the policy failed."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0)


def ablation(rows: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """Per rule of a policy: documents it rejects, and those nothing else in the policy rejects."""
    rules = POLICIES[policy]
    found = F.col("fail_bits").bitwiseAND(F.lit(mask(rules)))
    counts = rows.select(found.alias("f")).groupBy("f").count()
    pick = [F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in rules]
    return (
        counts.select("f", "count", F.explode(F.array(*pick)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("f").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("rejected"),
            F.sum(F.when(F.col("f") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("rejected_alone"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(mask(BASE))) != 0).alias("base_failed"), "kept", "fail_bits",
    )


#: The base in DuckDB SQL: words and lines as lists, windows by their three words.
ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
r AS (SELECT doc_id, count(*) AS n FROM (
        SELECT DISTINCT doc_id, i + j AS p FROM (SELECT doc_id, i FROM g2 WHERE c > 1) q, (VALUES (0), (1), (2)) v(j)) q GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, (@BITS@)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (fail_bits & @BASE@) <> 0 AS base_failed, (fail_bits & @MASK@) = 0 AS kept, fail_bits FROM b
"""
ORACLE = (
    ORACLE.replace("@BITS@", " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, (_, c) in enumerate(RULES)))
    .replace("@BASE@", str(mask(BASE)))
    .replace("@MASK@", str(mask(POLICIES[DEFAULT_POLICY])))
)
