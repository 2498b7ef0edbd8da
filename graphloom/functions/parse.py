"""Parsing of model responses: tags and tolerant JSON.

Tags are cut out by Column expressions.  Whether a text is JSON is asked of
Python's parser in a vectorised UDF, as Spark's accepts other texts.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, StringType

from .text import strip

FENCE = re.compile(r"```(?:json)?", re.I)
TAGS = re.compile(r"</?(?:thinking|output)>", re.I)
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
OBJECT = re.compile(r"\{.*\}", re.S)


def repair_json(text: str | None) -> str | None:
    """The outermost object of a response after repairs, as strict JSON text;
    null if there is none.  Fences, tags and control characters go, long dashes
    become hyphens, and commas before a closing bracket go, inside strings too."""
    if text is None:
        return None
    clean = CONTROL.sub("", TAGS.sub("", FENCE.sub("", text))).translate({0x2013: "-", 0x2014: "-"})
    found = OBJECT.search(clean)
    if not found:
        return None
    body = re.sub(r",\s*\]", "]", re.sub(r",\s*\}", "}", found[0]))
    return body if strict_json(body) else None


def strict_json(text: str | None) -> bool:
    """Whether a text is JSON to Python, the literal null aside."""
    if text is None or not text.strip():
        return False
    try:
        return json.loads(text) is not None
    except (ValueError, RecursionError):
        return False


def pretty(text: str | None) -> str | None:
    """JSON text with an indent of two, as Python writes it; null if it is no JSON."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, indent=2) if text is not None else None
    except (ValueError, RecursionError):
        return None


def canonical(text: str | None) -> str | None:
    """JSON text with sorted keys and no spaces: equal values, equal texts."""
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":")) if text is not None else None
    except (ValueError, RecursionError):
        return None


def outermost_object(text: str | None) -> str | None:
    """From the first ``{`` to the last ``}`` after fences are gone, if that is strict JSON."""
    if text is None:
        return None
    clean = text.replace("```json", "").replace("```", "")
    s, e = clean.find("{"), clean.rfind("}")
    return clean[s : e + 1] if 0 <= s < e and strict_json(clean[s : e + 1]) else None


def _vectorised(function, kind: DataType):
    flags = isinstance(kind, BooleanType)

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: function(None if x is None or x != x else x)).astype(bool if flags else object)

    return run


robust_parse = _vectorised(repair_json, StringType())
is_json = _vectorised(strict_json, BooleanType())
pretty_json = _vectorised(pretty, StringType())
canonical_json = _vectorised(canonical, StringType())
extract_object = _vectorised(outermost_object, StringType())


def _find(haystack: Column, needle: str) -> Column:
    """Zero-based position, -1 if absent."""
    return F.instr(haystack, needle) - 1


def _locate(needle: str, haystack: Column, start: Column) -> Column:
    """Zero-based position from ``start`` on, -1 if absent."""
    rest = F.instr(F.substring(haystack, start + 1, F.length(haystack)), needle)
    return F.when(rest > 0, start + rest - 1).otherwise(-1)


def _slice(c: Column, start: Column, end: Column) -> Column:
    return F.substring(c, start + 1, F.greatest(end - start, F.lit(0)))


def split_trace(response: Column) -> Column:
    """``struct(cot, json_text)`` of a response with thinking and output tags.

    A trace without end runs to the output tag or the end; an output without
    end runs to the end; without output tag the text after the trace counts,
    nothing if the trace has no end, and the whole text if there is no trace."""
    s = strip(response)
    low, n = F.lower(s), F.length(s)
    think, out = _find(low, "<thinking>"), _find(low, "<output>")
    body = think + len("<thinking>")
    close = _locate("</thinking>", low, body)
    end = F.when(close >= 0, close).when(out >= 0, out).otherwise(n)
    begin = out + len("<output>")
    stop = _locate("</output>", low, begin)
    answer = (
        F.when(out >= 0, _slice(s, begin, F.when(stop >= 0, stop).otherwise(n)))
        .when(think < 0, s)
        .when(close >= 0, _slice(s, close + len("</thinking>"), n))
        .otherwise("")
    )
    return F.struct(F.when(think >= 0, strip(_slice(s, body, end))).otherwise("").alias("cot"), strip(answer).alias("json_text"))


def tagged_response(response: Column) -> Column:
    """``struct(cot, object_text)``: the first think block, and the outermost
    braces of the first output block or of the whole text; null without any."""
    cot = strip(F.regexp_extract(response, r"(?is)<think>(.*?)</think>", 1))
    whole = F.when(response.rlike(r"(?is)<output>.*?</output>"), F.regexp_extract(response, r"(?is)<output>(.*?)</output>", 1)).otherwise(response)
    clean = F.replace(F.replace(whole, F.lit("```json"), F.lit("")), F.lit("```"), F.lit(""))
    body = F.regexp_extract(clean, r"(?s)\{.*\}", 0)
    return F.struct(cot.alias("cot"), F.when(body != "", body).alias("object_text"))


def relations_of(relations: Column, relationships: Column) -> Column:
    """The relation list under either of its names; null without both."""
    return F.coalesce(relations, relationships)


def response_text(parts: Column) -> Column:
    """Non-empty texts of the first candidate's parts, a line each."""
    return strip(F.array_join(F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != "")), "\n"))


def answer_and_thoughts(parts: Column, fallback: Column) -> Column:
    """``struct(answer, thoughts)`` of parts with ``text`` and ``thought``."""
    good = F.filter(parts, lambda p: F.coalesce(p["text"], F.lit("")) != "")
    answer = strip(F.array_join(F.transform(F.filter(good, lambda p: ~F.coalesce(p["thought"], F.lit(False))), lambda p: p["text"]), ""))
    thoughts = F.filter(F.transform(F.filter(good, lambda p: F.coalesce(p["thought"], F.lit(False))), lambda p: strip(p["text"])), lambda t: t != "")
    return F.struct(F.when(answer != "", answer).otherwise(F.coalesce(fallback, F.lit(""))).alias("answer"), F.array_join(thoughts, "\n").alias("thoughts"))


def nonempty(first: Column, second: Column) -> Column:
    """The first text unless it is null or empty."""
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(second)
