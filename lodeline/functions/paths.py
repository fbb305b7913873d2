"""Path predicates and path functions as Columns.

The seven test predicates differ on purpose: each surface has its own, and results depend on it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by extension.
LANGUAGES = {
    "rs": "rust", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "json": "json", "toml": "toml", "yaml": "yaml", "yml": "yaml",
    "sh": "bash", "bash": "bash", "zsh": "bash", "html": "html", "css": "css", "scss": "css",
}
FAMILIES = {"rust": "rust", "go": "go", "python": "python", "typescript": "ts", "tsx": "ts", "javascript": "ts", "c": "c", "cpp": "c", "java": "java", "bash": "bash"}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[key]


def canonical(path: Column, workspace: str = "") -> Column:
    """Forward slashes, without the workspace prefix."""
    plain = F.translate(path, "\\", "/")
    return F.when(plain.startswith(workspace.rstrip("/") + "/"), F.substr(plain, F.lit(len(workspace.rstrip("/")) + 2))).otherwise(plain) if workspace else plain


def dir_of(path: Column) -> Column:
    """Through the last slash; empty at the root."""
    return F.regexp_extract(path, "^(.*/)", 1)


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))


def language(path: Column) -> Column:
    return _lookup(LANGUAGES, extension(path))


def family(lang: Column) -> Column:
    return F.coalesce(_lookup(FAMILIES, lang), F.lit(""))


def _has(path: Column, *parts: str) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(path, F.lit(part))
    return found


def is_test_callers(path: Column) -> Column:
    return _has(path, "_test.", "/test/", "/tests/", ".test.", ".spec.")


def is_test_context(path: Column) -> Column:
    return is_test_callers(F.lower(path))


def is_test_candidate(path: Column) -> Column:
    return F.lower(path).rlike(r"_test\.|\.test\.|\.spec\.|(^|/)(test|tests|__tests__|playground)/")


def is_test_fulltext(path: Column) -> Column:
    """An unescaped LIKE: the underscore stands for any character."""
    return F.lower(path).rlike(r"(?s).test\.|\.test\.|/test|/__tests__/")


def is_test_fusion(path: Column) -> Column:
    return _has(path, "_test.", ".test.", "/test/", "/__tests__/", "/tests/")


def is_test_metric(path: Column) -> Column:
    return F.lower(path).rlike(r"(?s).test\.|/test/|\.test\.|\.spec\.")


def is_test_entry(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(tests|__tests__)/")


def is_doc(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)(docs_src|docs|examples|tutorials?)/")


# What marks a generated file.
GENERATED = ("DO NOT EDIT", "@generated", "<auto-generated", "Generated by the protocol buffer compiler")


def is_generated(content: Column) -> Column:
    """A marker within the first 40 lines and 2048 characters."""
    head = F.array_join(F.slice(F.split(F.substring(content, 1, 2048), "\n"), 1, 40), "\n")
    return _has(head, *GENERATED)


def distance(a: Column, b: Column) -> Column:
    """Segments in either path that are not in their common prefix."""
    x, y = F.split(a, "/"), F.split(b, "/")
    same = F.aggregate(
        F.zip_with(x, y, lambda s, t: F.coalesce(s == t, F.lit(False))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, eq: F.struct((acc["n"] + F.when(acc["on"] & eq, 1).otherwise(0)).alias("n"), (acc["on"] & eq).alias("on")),
        lambda acc: acc["n"],
    )
    return F.size(x) + F.size(y) - 2 * same


def normalize(path: Column) -> Column:
    """Without ``.`` and empty segments; ``..`` takes one off."""
    kept = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, s: F.when((s == ".") | (s == ""), acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    return F.array_join(kept, "/")


def common_prefix(low: Column, high: Column) -> Column:
    """The longest common prefix of a set, from its smallest and largest member, cut back to a slash."""
    n = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.length(low), F.length(high)), F.lit(1))),
        F.lit(0),
        lambda acc, i: F.when((acc == i - 1) & (F.substr(low, i, F.lit(1)) == F.substr(high, i, F.lit(1))), i).otherwise(acc),
    )
    return F.regexp_extract(F.substr(low, F.lit(1), n), "^(.*/)", 1)


# Directory names that say nothing about a module.
BORING = ("packages", "crates", "libs", "src", "lib", "app", "apps", "services", "modules", "internal")


def module_segment(path: Column) -> Column:
    """The first directory with a telling name."""
    dirs = F.filter(F.split(dir_of(path), "/"), lambda s: (s != "") & ~s.isin(*BORING))
    return F.get(dirs, F.lit(0))
