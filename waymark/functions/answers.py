"""Parsing of stored model answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark import fixed_values as V
from waymark.functions.text import _col, strip
from waymark.functions.urls import first_url, sanitize_url

SELECTION_TYPE = "struct<url:string,confidence:string,reasoning:string>"
_STRICT = {"allowSingleQuotes": "false"}
_ANSWER = "selected_url string, confidence string, reasoning string"
_RESPONSE = (
    "output_text string, "
    "output array<struct<type:string,content:array<struct<type:string,text:string>>>>"
)


def selection(url: Column | str, confidence: Column, reasoning: Column | str) -> Column:
    """A selection struct from its three parts; plain strings are literals."""
    return F.struct(
        (F.lit(url) if isinstance(url, str) else url).alias("url"),
        confidence.cast("string").alias("confidence"),
        (F.lit(reasoning) if isinstance(reasoning, str) else reasoning).alias("reasoning"),
    ).cast(SELECTION_TYPE)


def parse_selection(c: Column | str) -> Column:
    """Model answer text to a selection struct.

    A JSON object gives its own fields (URL normalised or ``NOT_FOUND``);
    anything else is searched for a first link, at low confidence.  The object
    is parsed inside a one-element array because ``from_json`` alone accepts
    text after the closing brace; the struct reading takes the last of
    duplicate keys, the map reading tells an absent key from a null one.
    """
    raw = _col(c)
    wrapped = F.concat(F.lit("["), raw, F.lit("]"))
    as_maps = F.from_json(wrapped, "array<map<string,string>>", _STRICT)
    is_object = (
        raw.rlike(r"\A[ \t\r\n]*\{[\s\S]*\}[ \t\r\n]*\z")
        & (F.size(as_maps) == 1)
        & as_maps[0].isNotNull()
    )
    answer = F.from_json(raw, _ANSWER, _STRICT)
    reasoning = F.when(
        F.map_contains_key(as_maps[0], "reasoning"), answer["reasoning"]
    ).otherwise(F.lit(""))
    from_object = selection(
        F.coalesce(sanitize_url(answer["selected_url"]), F.lit(V.NOT_FOUND)),
        answer["confidence"],
        reasoning,
    )
    from_text = selection(
        F.coalesce(sanitize_url(first_url(raw)), F.lit(V.NOT_FOUND)),
        F.lit(V.MALFORMED_CONFIDENCE),
        V.REASON_MALFORMED,
    )
    missing = selection(V.ERROR_NOT_FOUND, F.lit(None), V.REASON_NO_RESPONSE)
    return (
        F.when(raw.isNull() | (raw == ""), missing)
        .when(F.coalesce(is_object, F.lit(False)), from_object)
        .otherwise(from_text)
    )


def response_text(c: Column | str) -> Column:
    """Answer text of a stored API response (JSON)."""
    body = F.from_json(_col(c), _RESPONSE)
    messages = F.filter(F.coalesce(body["output"], F.array()), lambda m: m["type"] == "message")
    parts = F.flatten(F.transform(messages, lambda m: F.coalesce(m["content"], F.array())))
    texts = F.transform(
        F.filter(parts, lambda p: p["type"] == "output_text"),
        lambda p: F.coalesce(p["text"], F.lit("")),
    )
    return strip(
        F.coalesce(F.nullif(body["output_text"], F.lit("")), F.array_join(texts, ""), F.lit(""))
    )
