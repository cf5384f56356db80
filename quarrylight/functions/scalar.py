"""Scalar building blocks: hashes, paths, lists, text and confidence.

Every function takes and returns Columns and compiles to JVM expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A changed element keeps this share of its confidence.
DECAY = 0.85
LOW, STALE = 0.5, 0.2


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes, in hex."""
    return F.sha2(content.cast("binary"), 256)


def token_hash(tokens: Column) -> Column:
    """SHA-256 of an array of canonical tokens joined by spaces."""
    return F.sha2(F.array_join(tokens, " "), 256)


def short_id(*parts: Column) -> Column:
    """The first 12 hex digits of the SHA-256 of the parts, one after another."""
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 12)


def decayed(confidence: Column, times: Column | int = 1) -> Column:
    """The confidence after so many changes, never below zero."""
    factor = F.pow(F.lit(DECAY), times if isinstance(times, Column) else F.lit(times))
    return F.greatest(F.lit(0.0), confidence * factor)


def confidence_tag(confidence: Column, stale: Column | None = None) -> Column:
    """How far a summary can be trusted, for display."""
    tag = F.when(confidence < STALE, "LIKELY STALE").when(confidence < LOW, "LOW CONFIDENCE").otherwise("")
    return tag if stale is None else F.when(stale, "STALE").otherwise(tag)


def confidence_bucket(confidence: Column) -> Column:
    """full, high, low or stale: the bands of the status report."""
    return F.when(confidence >= 1.0, "full").when(confidence >= LOW, "high").when(confidence >= STALE, "low").otherwise("stale")


def token_estimate(text: Column) -> Column:
    """Four characters count as one token."""
    return F.floor(F.char_length(text) / 4).cast("long")


def path_parent(path: Column) -> Column:
    """The folder of a path; '.' at the top level."""
    return F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def path_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_suffix(path: Column) -> Column:
    """The extension with its dot; empty for none and for dot files."""
    return F.regexp_extract(path_name(path), r"^.+?(\.[^.]*)$", 1)


def path_prefixes(path: Column) -> Column:
    """All folders above a path, outermost first; none at the top level."""
    parts = F.split(path, "/")
    depth = F.size(parts) - 1
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def normal_path(path: Column) -> Column:
    """'.' and '..' folded away; '..' above the root is ignored."""

    def step(done: Column, part: Column) -> Column:
        return (
            F.when(part.isin("", "."), done)
            .when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.concat(done, F.array(part)))
        )

    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step, lambda parts: F.array_join(parts, "/"))


def json_list(text: Column) -> Column:
    """A JSON array of strings; null and malformed texts give an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def json_length(text: Column) -> Column:
    return F.coalesce(F.json_array_length(text), F.lit(0))


def ordered_union(first: Column, second: Column) -> Column:
    """Both lists without repeats; the first occurrence keeps its place."""
    return F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))


def patched(new: Column, old: Column) -> Column:
    """The new value unless it is null or empty."""
    return F.coalesce(F.nullif(new, F.lit("")), old)


def head_list(items: Column, n: int) -> Column:
    return F.array_join(F.slice(items, 1, n), ", ")


def short_hash(value: Column) -> Column:
    return F.substring(F.coalesce(value, F.lit("?")), 1, 7)


def file_of(function_id: Column) -> Column:
    """The path in a function id, which is path::name."""
    return F.substring_index(function_id, "::", 1)


def percent(part: Column, whole: Column) -> Column:
    """Zero where there is nothing."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)) * 100, F.lit(0.0))


def stripped_answer(text: Column) -> Column:
    """A model's answer without code fences and their language tag."""
    inner = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.trim(inner)


def taint_warning(tainted: Column, source: Column, name: Column, class_name: Column, file: Column) -> Column:
    """Why a function is suspect: by no known source, by a known function, or
    by the id of one that is gone. Null where it is not tainted."""
    who = F.concat(F.when(class_name.isNotNull(), F.concat(class_name, F.lit("."))).otherwise(""), name, F.lit("() in "), file)
    text = (
        F.when(source.isNull(), F.lit("A dependency has changed."))
        .when(name.isNotNull(), F.concat(F.lit("Depends on "), who, F.lit(", which has changed.")))
        .otherwise(F.concat(F.lit("Depends on "), source, F.lit(", which has changed.")))
    )
    return F.when(tainted, text)


def source_slice(text: Column, first: Column, last: Column) -> Column:
    """The lines first..last (counted from 1) of a text."""
    start = F.greatest(first, F.lit(1))
    return F.when(last >= start, F.array_join(F.slice(F.split(text, "\n"), start, last - start + 1), "\n")).otherwise("")
