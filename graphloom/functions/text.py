"""Text functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's ``str.split`` sees it.
SPACE = r"(?U)[\s\x1c-\x1f]"

#: Boundaries at which a text may be cut, in the order they compete.
CUT_MARKERS = ["\n\n", "\n### ", "\n## ", "\n- ", "\n", ". ", ".\n", "。", "；", "; "]
#: Share of the limit below which a boundary is not worth taking.
CUT_SHARE = 0.7

#: Id prefixes by entity label.
LABEL_PREFIXES = {
    "Disease": "D",
    "Symptom": "S",
    "Diagnostic Criteria": "DC",
    "Interview Tool": "IT",
    "Patient Information": "PI",
    "Medication": "M",
    "Communication Method": "CM",
    "Risk Information": "R",
}
OTHER_PREFIX = "E"

#: Error classes and the words that name them; the first class that matches counts.
ERROR_WORDS = [
    ("network", ["timed out", "timeout", "handshake", "connection", "ssl", "dns", "proxy"]),
    ("rate_limit", ["429", "resource_exhausted"]),
    ("auth", ["401", "403", "api key", "permission", "unauthorized", "forbidden"]),
    ("not_found", ["404", "not found"]),
]

#: Role names of other chat formats.
ROLE_NAMES = {"human": "user", "gpt": "assistant"}


def text(c: Column) -> Column:
    """As a string, null as empty."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+$", "")


def normalize_key(c: Column) -> Column:
    """Lower case, stripped, white space runs as one space."""
    return F.trim(F.regexp_replace(F.lower(c), f"{SPACE}+", " "))


def concat_fields(*fields: Column, separator: str = "\n") -> Column:
    """Fields that are neither null nor empty, joined."""
    return F.concat_ws(separator, *(F.when(f != "", f) for f in fields))


def labelled_text(title: Column, definition: Column, criteria: Column, narrower: Column) -> Column:
    """Title, definition, criteria and a list of narrower terms as paragraphs.
    The list is written as JSON with a space after each comma."""
    terms = F.when(F.size(narrower) > 0, F.concat(F.lit("Narrower terms: ["), F.array_join(F.transform(narrower, lambda t: F.concat(F.lit('"'), F.regexp_replace(t, r'(["\\])', r"\\$1"), F.lit('"'))), ", "), F.lit("]")))
    return F.concat_ws("\n\n", *(F.when(f != "", f) for f in (title, definition, criteria, terms)))


def rfind(haystack: Column, needle: str) -> Column:
    """Zero-based start of the last occurrence, -1 if there is none."""
    back = F.instr(F.reverse(haystack), needle[::-1])
    return F.when(back > 0, F.length(haystack) - back - len(needle) + 1).otherwise(-1)


def truncate(c: Column, limit: int | Column) -> Column:
    """At most ``limit`` characters, cut after a boundary if one lies in the
    last part.  A boundary counts with its marker less trailing white space,
    and has to begin beyond the best cut so far."""
    if isinstance(limit, int):
        if limit <= 0:
            return c
        limit = F.lit(limit)
    window = F.substring(c, F.lit(1), limit)
    # a fold, so that each marker is looked up once
    cut = F.aggregate(
        F.array(*(F.struct(rfind(window, m).alias("at"), F.lit(len(m.rstrip())).alias("keep")) for m in CUT_MARKERS)),
        F.lit(-1),
        lambda best, m: F.when(m["at"] > best, m["at"] + m["keep"]).otherwise(best),
    )
    short = F.when(cut >= F.floor(limit * F.lit(CUT_SHARE)), F.substring(window, F.lit(1), cut)).otherwise(window)
    return F.when(F.length(c) <= limit, c).otherwise(rstrip(short))


def reference_keys(ref: Column) -> Column:
    """A reference and its last path segment; none for an empty one."""
    tail = F.element_at(F.split(F.regexp_replace(ref, "/+$", ""), "/"), -1)
    return F.when(text(ref) == "", F.array().cast("array<string>")).otherwise(F.filter(F.array(ref, tail), lambda k: k != ""))


def scoped_id(scope: Column, own: Column) -> Column:
    return F.when(text(own) == "", F.lit("")).otherwise(F.concat_ws("_", scope, own))


def _lookup(c: Column, names: dict[str, str], other: Column) -> Column:
    out = None
    for key, value in names.items():
        out = F.when(c == key, value) if out is None else out.when(c == key, value)
    return out.otherwise(other)


def label_prefix(label: Column) -> Column:
    return _lookup(label, LABEL_PREFIXES, F.lit(OTHER_PREFIX))


def normalize_role(role: Column) -> Column:
    clean = F.lower(strip(role))
    return _lookup(clean, ROLE_NAMES, clean)


def rewrite_think_tags(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<thinking>"), F.lit("<think>")), F.lit("</thinking>"), F.lit("</think>"))


def infer_style(style: Column, file_name: Column, fallback: str) -> Column:
    """The record's own style if it is a known one, else by the file's name."""
    name = F.lower(file_name)
    return F.when(style.isin("template", "specific"), style).when(name.contains("specific"), "specific").when(name.contains("standard") | name.contains("template"), "template").otherwise(fallback)


def csv_list(c: Column) -> Column:
    """Comma-separated items, trimmed; null if there is none."""
    items = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.when(F.size(items) > 0, items)


def classify_error(message: Column) -> Column:
    """The class of an error message."""
    low, out = F.lower(message), None
    for kind, words in ERROR_WORDS:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("other")


def looks_truncated(c: Column) -> Column:
    """Whether a text opens an object and closes fewer than it opens."""
    s = strip(c)
    count = lambda x: F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))
    return s.startswith("{") & (count("{") > count("}"))


def error_text(kind: Column, error: Column, message: Column) -> Column:
    return F.concat(kind, F.lit("["), error, F.lit("]: "), message)
