"""Column expressions that turn raw files, pages and rows into documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source types, review states, and spellings of "yes".
TYPES = ("jd", "project_logs", "interview", "resume", "user_profile")
REVIEW_STATES = ("reviewed", "pending", "rejected")
YES = ("1", "true", "yes")


def source_type(path: Column) -> Column:
    """The first folder of a relative path; null if it is no source type."""
    first = F.split_part(path, F.lit("/"), F.lit(1))
    return F.when(first.isin(*TYPES), first)


def front_matter(text: Column) -> Column:
    """``key: value`` lines between two ``---`` lines at the start, as an array of structs; lines without a colon are
    passed over."""
    block = F.regexp_extract(text, "^---\\n((?s).*?)\\n---\\n", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    return F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("key"), F.trim(F.array_join(F.slice(F.split(x, ":"), F.lit(2), F.size(F.split(x, ":"))), ":")).alias("value")))


def body(text: Column) -> Column:
    """The text after its front matter."""
    return F.regexp_replace(text, "^---\\n(?s).*?\\n---\\n", "")


def review_state(state: Column) -> Column:
    low = F.lower(F.trim(state))
    return F.when(low.isin(*REVIEW_STATES), low).otherwise("unreviewed")


def is_yes(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*YES), F.lit(False))


def job_title(company: Column, title: Column) -> Column:
    return F.concat(company, F.lit(" - "), title)


def job_document(company: Column, title: Column, description: Column, requirements: Column) -> Column:
    """A posting as a Markdown document with two sections."""
    return F.concat(F.lit("# "), job_title(company, title), F.lit("\n\n## Description\n"), F.coalesce(description, F.lit("")), F.lit("\n\n## Requirements\n"), F.coalesce(requirements, F.lit("")))


def segment(text: Column, begin: str, end: str) -> Column:
    """What stands between the first ``begin`` and the next ``end`` (or the text's end), without blanks at its end; null
    where ``begin`` does not occur."""
    rest = F.array_join(F.slice(F.split(text, begin), F.lit(2), F.size(F.split(text, begin))), begin)
    return F.when(F.contains(text, F.lit(begin)), F.rtrim(F.substring_index(rest, end, 1)))


def tagged(text: Column, tag: str) -> Column:
    """What the first ``<tag>`` encloses."""
    return F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)


def sections(text: Column, least: int = 80) -> Column:
    """Markdown sections at headings of two or three signs, those of at least ``least`` characters."""
    parts = F.split(F.regexp_replace(text, "(^|\\n)(##{1,2}\\s)", "$1\x01$2"), "\x01")
    return F.filter(F.transform(parts, lambda x: F.trim(x, F.lit(" \n\r"))), lambda x: F.length(x) >= least)


def markdown_title(text: Column, path: Column) -> Column:
    """The first heading of one or two signs, else the file's name."""
    heading = F.nullif(F.regexp_extract(text, "(?:^|\\n)#{1,2}[ \\t]+([^\\n\\r]+)", 1), F.lit(""))
    return F.coalesce(heading, F.element_at(F.split(path, "/"), -1))


def without_images(text: Column) -> Column:
    """Without images, and with two line ends at most in a row."""
    plain = F.regexp_replace(F.regexp_replace(text, "<img[^>]*>", ""), "!\\[[^\\]]*\\]\\([^)]*\\)", "")
    return F.trim(F.regexp_replace(plain, "\\n{3,}", "\n\n"), F.lit(" \n"))


def vector_literal(v: Column) -> Column:
    """A vector as text, ten significant digits a number: ``[0.5,-0.25]``."""
    short = lambda s: F.regexp_replace(F.regexp_replace(s, "(\\.\\d*?)0+(e|$)", "$1$2"), "\\.(e|$)", "$1")
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: short(F.format_string("%.10g", x.cast("double")))), ","), F.lit("]"))


def fingerprint(settings: Column) -> Column:
    """A hash of a map of settings, whatever their order."""
    entries = F.array_sort(F.map_entries(settings))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)


def error_kind(message: Column) -> Column:
    """``(kind, transient)`` of a failed call by its message."""
    low = F.lower(message)
    status = F.regexp_extract(low, "http\\s+(\\d{3})", 1).try_cast("int")
    refused = status.isin(401, 403) | F.contains(low, F.lit("api_key")) | F.contains(low, F.lit("auth"))
    kind = F.when(F.coalesce(refused, F.lit(False)) | F.contains(low, F.lit("api_key")) | F.contains(low, F.lit("auth")), "authentication_error").when(status == 429, "rate_limited").when(status.between(500, 599), "provider_5xx").when(F.contains(low, F.lit("connection")), "connection_error").otherwise("provider_error")
    return F.struct(kind.alias("kind"), kind.isin("rate_limited", "provider_5xx", "connection_error").alias("transient"))
