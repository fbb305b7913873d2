"""Scalar functions on text and numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whitespace_tokens(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")).cast("long")


def estimate_tokens(text: Column) -> Column:
    """Bytes over four, rounded up."""
    return F.floor((F.octet_length(text) + 3) / 4).cast("long")


def never_worse(raw: Column, filtered: Column) -> Column:
    """The shorter of the two by estimated tokens; ties keep the raw text."""
    return F.when(estimate_tokens(filtered) >= estimate_tokens(raw), raw).otherwise(filtered)


def savings(raw: Column, filtered: Column) -> Column:
    return F.when(raw == 0, F.lit(0.0)).otherwise((raw - filtered).cast("double") / raw * 100)


def short_number(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fK", n / 1e3)).otherwise(n.cast("string"))


def truncate_command(command: Column, width: int = 40) -> Column:
    return F.when(F.length(command) > width, F.concat(F.substring(command, 1, width - 3), F.lit("..."))).otherwise(command)


def strip_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;?]*[A-Za-z]", "")


def strip_timestamp(line: Column) -> Column:
    """Without a leading ISO or syslog time."""
    return F.regexp_replace(line, r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9:.,]+(Z|[+-][0-9:]+)? *|[A-Z][a-z]{2} [ 0-9][0-9] [0-9:]{8} *)", "")


def output_paths(text: Column) -> Column:
    """The files that the output of a diff or a status names, in order."""
    line = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"^\s*diff --git .*? b/(.+?)\s*$", 1), F.lit("")), F.nullif(F.regexp_extract(x, r"^\s*(?:modified|new file|deleted):\s*(.+?)\s*$", 1), F.lit("")))
    return F.array_compact(F.transform(F.split(text, "\r?\n"), line))


def snippet(content: Column, terms: list[str], width: int = 64) -> Column:
    """``width`` words around the first match of a query's terms (the last one as a prefix), matches in >>> and <<<."""
    word = lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    hit = lambda x: word(x).isin(*terms[:-1]) | word(x).startswith(terms[-1]) if terms[:-1] else word(x).startswith(terms[-1])
    words = F.filter(F.split(content, r"\s+"), lambda x: x != "")
    at = F.greatest(F.array_position(F.transform(words, hit), F.lit(True)).cast("int"), F.lit(1))
    start = F.greatest(at - width // 4, F.lit(1))
    shown = F.array_join(F.transform(F.slice(words, start, F.lit(width)), lambda x: F.when(hit(x), F.concat(F.lit(">>>"), x, F.lit("<<<"))).otherwise(x)), " ")
    return F.concat(F.when(start > 1, F.lit("...")).otherwise(""), shown, F.when(start + width <= F.size(words), F.lit("...")).otherwise(""))


def hotspot_hint(hotspots: Column, commits: Column, least: int = 10) -> Column:
    """Why a list of hotspots is empty; null where it isn't."""
    few = F.format_string(f"too little history: %d commits, {least} are needed", commits)
    return F.when(hotspots == 0, F.when(commits < least, few).otherwise(F.lit("no file changed in the last 30 days")))


def tool_path(body: Column) -> Column:
    """The file that a tool call names, wherever its JSON has it."""
    return F.coalesce(*(F.get_json_object(body, p) for p in ("$.tool_input.file_path", "$.tool_input.path", "$.file_path", "$.path")))


def scip_name(symbol: Column) -> Column:
    """The last identifier of a SCIP symbol."""
    plain = F.regexp_replace(symbol, r"(\(.*\))?[.#:/!]*$", "")
    return F.regexp_extract(plain, r"([^.#:/!`\s()]+)`?$", 1)


def vector_similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def rrf(weight: float, rank: Column, k: int = 60) -> Column:
    """A reciprocal-rank term; ranks start at 1."""
    return F.lit(weight) / (k + rank)
