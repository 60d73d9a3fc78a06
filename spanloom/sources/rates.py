"""Rate books: versioned prices per million tokens from one small JSON file."""

from __future__ import annotations

import datetime
import hashlib
import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "spanloom.rates.v1"
#: a rate file is written by hand; a larger one is refused before it is read
MOST_BYTES = 16 << 20
#: field of the file -> column of the book
PRICES = {"input": "input", "output": "output", "cache_read_input": "cache_read", "cache_write_input": "cache_write", "reasoning_output": "reasoning"}
_DECIMAL = re.compile(r"\d+(\.\d+)?")


@dataclass(frozen=True)
class RateBook:
    #: provider, model and a decimal column for every price, null where the file has none
    rates: DataFrame
    path: str
    sha256: str
    schema: str
    as_of: str
    currency: str

    def keys(self) -> DataFrame:
        """provider/model in order, one a row."""
        return self.rates.select(F.concat_ws("/", "provider", "model").alias("rate_key")).orderBy("rate_key")


def _only(found: dict, fields: set[str], where: str) -> None:
    if extra := set(found) - fields:
        raise ValueError(f"{where}: unknown fields {sorted(extra)}")


def _checked(doc: dict, schema: str) -> list[tuple]:
    _only(doc, {"schema", "as_of", "currency", "rates"}, "rate file")
    if doc.get("schema") != schema:
        raise ValueError(f"the schema must be {schema}")
    datetime.datetime.fromisoformat(doc.get("as_of") or "")
    if not (doc.get("currency") or "").strip() or not doc.get("rates"):
        raise ValueError("currency and at least one rate are required")
    rows, seen = [], set()
    for k, entry in enumerate(doc["rates"]):
        _only(entry, {"provider", "model", "per_million_tokens"}, f"rates[{k}]")
        prices = entry.get("per_million_tokens") or {}
        _only(prices, set(PRICES), f"rates[{k}]")
        key = (entry.get("provider") or "", entry.get("model") or "")
        if not all(x.strip() for x in key) or key in seen:
            raise ValueError(f"rates[{k}] lacks provider or model, or repeats them")
        seen.add(key)
        if not prices.get("input") or not prices.get("output"):
            raise ValueError(f"rates[{k}] requires input and output")
        if bad := [x for x in prices if prices[x] and not _DECIMAL.fullmatch(prices[x])]:
            raise ValueError(f"rates[{k}].{bad[0]} must be a decimal string of no sign")
        rows.append((*key, *(prices.get(x) or None for x in PRICES)))
    return rows


def load_rates(spark: SparkSession, path: str, schema: str = SCHEMA) -> RateBook:
    """The book of a file that any of Spark's file systems holds; ValueError if anything is amiss."""
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).first()
    if size.n != 1 or size.bytes > MOST_BYTES:
        raise ValueError(f"{path}: one file of at most {MOST_BYTES} bytes is wanted")
    raw = bytes(files.first().content)
    doc = json.loads(raw)
    rows = _checked(doc, schema)
    text = spark.createDataFrame(rows, "provider string, model string, " + ", ".join(f"{c} string" for c in PRICES.values()))
    rates = text.select("provider", "model", *(F.col(c).cast("decimal(18,9)").alias(c) for c in PRICES.values()))
    return RateBook(rates, path, hashlib.sha256(raw).hexdigest(), doc["schema"], doc["as_of"], doc["currency"])
