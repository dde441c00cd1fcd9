"""Requests as rows: bodies in, answers or errors out, in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import blank

MOST_TEXT = 65_536
MOST_BODY = 524_288
STATUS = {"invalid_json": 400, "unsupported_media_type": 415, "empty_input": 400, "request_too_large": 413, "input_too_large": 413, "not_found": 404, "method_not_allowed": 405}


def validate_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `error`: empty_input for a blank or missing text, input_too_large beyond MOST_TEXT bytes, else null."""
    t = F.col(text)
    return docs.withColumn("error", F.when(t.isNull() | blank(t), "empty_input").when(F.octet_length(t) > MOST_TEXT, "input_too_large"))


def check(requests: DataFrame) -> DataFrame:
    """requests (id, method, path, content_type, body) with text, code and status; code is null for a good one.

    The order of checks: path, method, body size, content type, JSON (an object with the string `text` and no other
    field), text.
    """
    body = F.col("body")
    raw = F.from_json(body, "map<string,string>")
    typed = F.from_json(body, "struct<text:string>")
    is_string = F.get_json_object(F.to_json(F.struct(typed["text"].alias("t"))), "$.t").isNotNull() & body.rlike('"text"\\s*:\\s*"')
    shaped = raw.isNotNull() & (F.size(F.map_keys(raw)) == 1) & F.map_contains_key(raw, "text") & is_string
    text = F.when(F.col("path") == "/api/analyze", typed["text"])
    return (
        requests.withColumns({"__shaped": F.coalesce(shaped, F.lit(False)), "text": text})
        .withColumn(
            "code",
            F.when(~F.col("path").isin("/api/analyze", "/api/health"), "not_found")
            .when(F.col("path") == "/api/health", F.when(F.col("method") != "GET", "method_not_allowed"))
            .when(F.col("method") != "POST", "method_not_allowed")
            .when(F.octet_length(body) > MOST_BODY, "request_too_large")
            .when(~F.coalesce(F.lower("content_type"), F.lit("")).startswith("application/json"), "unsupported_media_type")
            .when(~F.col("__shaped"), "invalid_json")
            .when(blank(F.col("text")), "empty_input")
            .when(F.octet_length("text") > MOST_TEXT, "input_too_large"),
        )
        .withColumn("status", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in STATUS.items() for x in p]), F.col("code")), F.lit(200)))
        .drop("__shaped")
    )
