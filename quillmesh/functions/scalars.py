"""Scalar functions on ids, paths, hashes and text, as Spark columns."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hash16(text: Column | str) -> Column:
    """The first 16 hex digits of the SHA-256 of the text."""
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def edge_id(from_id: Column | str, kind: Column | str, to_id: Column | str) -> Column:
    return F.concat_ws("::", _c(from_id), _c(kind), _c(to_id))


def step_id(func: Column | str, number: Column | str) -> Column:
    return F.concat(_c(func), F.lit("::step-"), _c(number))


def envelope_id(func: Column | str) -> Column:
    return F.concat(_c(func), F.lit("@workflow"))


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def camel_to_snake(name: Column | str) -> Column:
    return F.lower(F.regexp_replace(_c(name), "(?<=[a-z0-9])(?=[A-Z])", "_"))


def first_sentence(text: Column | str) -> Column:
    """The first line that says something, up to its first full stop, exclamation or question mark."""
    line = F.regexp_extract(_c(text), r"(?m)^\s*([^\s#>|*`-][^\n]*)$", 1)
    return F.coalesce(F.nullif(F.regexp_extract(line, r"^(.*?[.!?])(\s|$)", 1), F.lit("")), F.trim(line))


def dotted(path: Column | str) -> Column:
    """A path of a source file as a dotted module name: a/b/__init__.py is a.b."""
    p = F.regexp_replace(_c(path), r"\.[A-Za-z]+$", "")
    return F.replace(F.regexp_replace(p, r"/(__init__|index)$", ""), F.lit("/"), F.lit("."))


def level3(location: Column | str) -> Column:
    """struct(path, line_start, line_end) of `path#L10-L45`; the lines are null where the location names none."""
    c = _c(location)
    pattern = r"^(.*?)(?:#L(\d+)(?:-L?(\d+))?)?$"
    start = F.regexp_extract(c, pattern, 2)
    end = F.regexp_extract(c, pattern, 3)
    first = F.when(start != "", start.cast("int"))
    return F.struct(F.regexp_extract(c, pattern, 1).alias("path"), first.alias("line_start"), F.coalesce(F.when(end != "", end.cast("int")), first).alias("line_end"))


def lines_between(text: Column | str, start: Column, end: Column) -> Column:
    """Lines start to end, 1-based and inclusive."""
    return F.array_join(F.slice(F.split(_c(text), "\n"), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def location_prefix(location: Column | str, depth: int = 2) -> Column:
    parts = F.filter(F.split(F.replace(F.coalesce(_c(location), F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.lit("(no-location)")).otherwise(F.array_join(F.slice(parts, 1, depth), "/"))


_LIKE = {"*": "%", "?": "_", "%": r"\%", "_": r"\_", "\\": r"\\"}


def glob_to_like(glob: str) -> str:
    """`*` and `**` match anything, `?` one character; the wild cards of LIKE are taken literally."""
    return re.sub(r"(?s)\*+|.", lambda m: _LIKE.get(m[0][0], m[0]), glob)


def glob_to_regex(glob: str) -> str:
    """An fnmatch pattern as an anchored regular expression."""
    import fnmatch

    return "^" + fnmatch.translate(glob).replace("(?s:", "(?s)(?:").replace("\\Z", "$").replace("\\z", "$")


def last_part(node_id: Column | str) -> Column:
    return F.element_at(F.split(_c(node_id), "::"), -1)


def short_name(node_id: Column | str) -> Column:
    """The last name of an id without its envelope suffix."""
    return F.regexp_replace(F.regexp_extract(last_part(node_id), r"([^.]*)$", 1), "@(workflow|machine)$", "")


def step_parts(number: Column | str) -> Column:
    """A dotted step number as integers; [0] where it is none."""
    parts = F.transform(F.split(_c(number), r"\."), lambda x: x.try_cast("int"))
    return F.when(F.exists(parts, lambda x: x.isNull()) | _c(number).isNull(), F.array(F.lit(0))).otherwise(parts)


def embedding_hash(level_1: Column | str, level_2: Column | str) -> Column:
    return hash16(F.concat(F.coalesce(_c(level_1), F.lit("")), F.lit("\n"), F.coalesce(_c(level_2), F.lit(""))))


def test_vector(text: Column | str, width: int = 384) -> Column:
    """A deterministic stand-in for an embedding, made of the bytes of the SHA-256 of the text."""
    digest = F.sha2(_c(text), 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (byte(i).bitwiseXOR(i.bitwiseAND(F.lit(255))) / F.lit(128.0) - 1).cast("float"))


def strip_html(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_c(text), "<[^>]+>", ""))


def strip_id_links(markdown: Column | str) -> Column:
    """Markdown links to node ids shrink to their text."""
    return F.regexp_replace(_c(markdown), r"\[([^\]]*)\]\(([^)]*::[^)]*)\)", "$1")


def lines_added(old: Column | str, new: Column | str) -> Column:
    a, b = F.split(F.coalesce(_c(old), F.lit("")), "\n"), F.split(F.coalesce(_c(new), F.lit("")), "\n")
    return F.size(F.filter(b, lambda x: ~F.array_contains(a, x)))


STEPS = "array<struct<step_num:double,name:string,purpose:string,inputs:string,outputs:string,critical:string>>"


def steps_to_json(steps: Column | str) -> Column:
    return F.to_json(_c(steps))


def json_to_steps(text: Column | str) -> Column:
    """Steps of their JSON; null for what is none."""
    return F.from_json(_c(text), STEPS)


def vector_bytes(vec: Column | str) -> Column:
    """A vector of floats as little-endian bytes of four each."""
    @F.pandas_udf("binary")
    def packed(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return packed(_c(vec))
