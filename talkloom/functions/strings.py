"""String rules shared by the operators; all lengths and positions are code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space in the sense of Python's str.strip and re's \s: the Unicode property
# plus the four separators U+001C to U+001F.
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Drop white space at both ends; the look-behind keeps long inner runs linear."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}++|(?<!{SPACE}){SPACE}++\z", "")


def last_line(text: Column) -> Column:
    """The part behind the last newline, stripped."""
    return strip(F.substring_index(text, "\n", -1))


def split_lines(text: Column) -> Column:
    """All parts between line ends, the one behind the last included."""
    # The plain newline split needs no regular expression.
    return F.when(F.contains(text, F.lit("\r")), F.split(text, r"\r\n|\r|\n", -1)).otherwise(
        F.split(text, "\n", -1)
    )


def strip_markup(html: Column) -> Column:
    """Remove tags and every white space character."""
    return F.regexp_replace(html, rf"(?U)<[^>]++>|{SPACE}", "")


def truncate(text: Column, limit: int = 300) -> Column:
    """The first ``limit`` code points."""
    return F.substring(text, 1, limit)


def route_by_length(query: Column, limit: int = 512) -> Column:
    """``l2`` for queries longer than ``limit``, else ``cosine``."""
    return F.when(F.length(query) > limit, F.lit("l2")).otherwise(F.lit("cosine"))


def number_sources(texts: Column) -> Column:
    """Prefix each text with its running number from 1."""
    return F.transform(
        texts, lambda text, i: F.concat(F.lit("来源"), (i + 1).cast("string"), F.lit(":"), text)
    )


def allowed_value(value: Column, allowed: list[str], user: str = "旅行者") -> Column:
    """``struct(emotion, user)`` for a value of the fixed set, else null."""
    return F.when(
        value.isin(*allowed), F.struct(value.alias("emotion"), F.lit(user).alias("user"))
    )


def json_result(result: Column) -> Column:
    """JSON text of a function result; no result is the text ``null``."""
    return F.coalesce(F.to_json(result, {"ignoreNullFields": "false"}), F.lit("null"))
