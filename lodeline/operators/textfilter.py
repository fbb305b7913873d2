"""Declarative output filters compiled to Columns, and text columns that need no Python."""

from __future__ import annotations

import os
import tomllib
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.scalars import estimate_tokens, never_worse, savings, strip_ansi, strip_timestamp


@dataclass(frozen=True)
class Rule:
    """A filter: which commands it takes, and its eight stages (None or empty: skipped)."""

    match_command: str
    strip_ansi: bool = False
    replace: tuple[tuple[str, str], ...] = ()
    match_output: tuple[tuple[str, str, str | None], ...] = ()  # pattern, message, unless
    strip_lines: tuple[str, ...] = ()
    keep_lines: tuple[str, ...] = ()
    truncate: int | None = None
    head: int | None = None
    tail: int | None = None
    most: int | None = None
    on_empty: str | None = None


_BLANK = r"^\s*$"
# The built-in filters.
BUILTIN = {
    "make": Rule(r"^make\b", True, strip_lines=(r"^make\[\d+\]:", _BLANK, "Nothing to be done"), most=50, on_empty="make: ok"),
    "docker-build": Rule(r"^docker build\b", True, strip_lines=(r"^(Step \d+/\d+ :|--->|Removing intermediate)", _BLANK), tail=30, most=50, on_empty="docker build: ok"),
    "npm-install": Rule(r"^(npm|pnpm|yarn) install\b", True, strip_lines=("^npm warn", _BLANK, r"^added \d+ packages"), most=20, on_empty="install: ok"),
    "pip-install": Rule(r"^pip3? install\b", True, strip_lines=("^Collecting ", "^  Downloading ", "^  Using cached ", _BLANK), most=20, on_empty="pip install: ok"),
    "pytest": Rule(r"^pytest\b", True, strip_lines=("^=+ ", "^plugins:", "^platform ", "^cachedir:"), most=80),
    "go-test": Rule(r"^go test\b", strip_lines=(_BLANK,), most=60, on_empty="go test: ok"),
    "kubectl": Rule(r"^kubectl\b", truncate=200, most=80),
    "cargo-clippy": Rule(r"^cargo clippy\b", True, keep_lines=(r"^(error|warning)\b", r"^\s*-->"), most=60, on_empty="clippy: clean"),
    "cargo-fmt": Rule(r"^cargo fmt\b", True, strip_lines=(_BLANK,), most=30, on_empty="fmt: clean"),
    "apt-install": Rule(r"^(sudo )?(apt|apt-get|dnf|yum|brew) install\b", True, strip_lines=("^(Get|Hit|Ign):", "^(Reading|Building|Unpacking|Setting up|Processing|Selecting)", _BLANK), tail=10, most=20, on_empty="install: ok"),
    "curl": Rule(r"^curl\b", truncate=200, most=80),
    "tree": Rule(r"^tree\b", True, most=60),
    "rustc-output": Rule(r"^(cargo build|rustc)\b", True, strip_lines=(_BLANK, r"^\s*= note:", r"^\s*= help: for further"), most=60, on_empty="build: ok"),
}
#: What no filter takes: its first and last lines.
FALLBACK, FALLBACK_FROM = Rule(".", head=40, tail=20), 80


def lines_of(text: Column) -> Column:
    """Lines without a last empty one."""
    return F.split(F.regexp_replace(text, "\r?\n\\z", ""), "\r?\n")


def _any(line: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (line.rlike(p) for p in patterns))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def head_tail(lines: Column, head: int | None, tail: int | None) -> Column:
    return lines if head is None and tail is None else bound(lines, lambda x: _head_tail(x, head, tail))


def _head_tail(lines: Column, head: int | None, tail: int | None) -> Column:
    n = F.size(lines)
    mark = lambda text, count: F.array(F.format_string(text, count))
    first = lambda k: F.slice(lines, 1, k)
    last = lambda k: F.slice(lines, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
    if head is not None and tail is not None:
        return F.when(n > head + tail, F.concat(first(head), mark("... (%d lines skipped)", n - head - tail), last(tail))).otherwise(lines)
    if head is not None:
        return F.when(n > head, F.concat(first(head), mark("... (%d more lines)", n - head))).otherwise(lines)
    return F.when(n > tail, F.concat(mark("... (%d lines before)", n - tail), last(tail))).otherwise(lines)


def compile_rule(rule: Rule, text: Column) -> Column:
    """The eight stages as one expression over the text; no shuffle, no Python."""
    raw = strip_ansi(text) if rule.strip_ansi else text
    for pattern, replacement in rule.replace:
        raw = F.regexp_replace(raw, pattern, replacement)
    return bound(raw, lambda x: _stages(rule, x)) if rule.match_output else _stages(rule, raw)


def _stages(rule: Rule, raw: Column) -> Column:
    lines = lines_of(raw)
    if rule.strip_lines:
        lines = F.filter(lines, lambda x: ~_any(x, rule.strip_lines))
    if rule.keep_lines:
        lines = F.filter(lines, lambda x: _any(x, rule.keep_lines))
    if rule.truncate is not None:
        lines = F.transform(lines, lambda x: F.when(F.length(x) > rule.truncate, F.concat(F.substring(x, 1, rule.truncate), F.lit("..."))).otherwise(x))
    lines = head_tail(head_tail(lines, rule.head, rule.tail), rule.most, None)
    out = F.array_join(lines, "\n")
    if rule.on_empty is not None:
        out = bound(out, lambda x: F.when(F.trim(x, F.lit(" \t\n\r")) == "", F.lit(rule.on_empty)).otherwise(x))
    for pattern, message, unless in reversed(rule.match_output):
        hit = raw.rlike(f"(?m){pattern}") & (~raw.rlike(f"(?m){unless}") if unless else F.lit(True))
        out = F.when(hit, F.lit(message)).otherwise(out)
    return out


def load_rules(path: str, trusted: str | None = None) -> dict[str, Rule]:
    """Rules of a TOML file, merged over the built-in ones by name.

    Filters change what people see, so a file counts only if its SHA-256 stands in
    the sidecar ``trusted`` or the environment says to trust it.
    """
    import hashlib

    body = Path(path).read_bytes()
    known = Path(trusted).read_text().split() if trusted and Path(trusted).exists() else []
    if hashlib.sha256(body).hexdigest() not in known and os.environ.get("LODELINE_TRUST_FILTERS") != "1":
        return dict(BUILTIN)
    try:
        found = tomllib.loads(body.decode()).get("filters", {})
    except (tomllib.TOMLDecodeError, UnicodeDecodeError):
        return dict(BUILTIN)
    made = {}
    for name, spec in found.items():
        pairs = tuple((r["pattern"], r.get("replacement", "")) for r in spec.get("replace", []))
        outputs = tuple((r["pattern"], r["message"], r.get("unless")) for r in spec.get("match_output", []))
        made[name] = Rule(spec["match_command"], spec.get("strip_ansi", False), pairs, outputs, tuple(spec.get("strip_lines_matching", ())), tuple(spec.get("keep_lines_matching", ())), spec.get("truncate_lines_at"), spec.get("head_lines"), spec.get("tail_lines"), spec.get("max_lines"), spec.get("on_empty"))
    return BUILTIN | made


def route(command: Column, text: Column, rules: dict[str, Rule] = BUILTIN) -> Column:
    """The first rule by name that takes the command; else long texts are cut."""
    cut = F.when(F.size(lines_of(text)) > FALLBACK_FROM, compile_rule(FALLBACK, text)).otherwise(text)
    for name in sorted(rules, reverse=True):
        cut = F.when(command.rlike(rules[name].match_command), compile_rule(rules[name], text)).otherwise(cut)
    return cut


def filtered(runs: DataFrame, rules: dict[str, Rule] = BUILTIN) -> DataFrame:
    """``runs`` (command, text) with output, raw_tokens, filtered_tokens and savings_pct; never longer than the raw text."""
    out = runs.withColumn("output", never_worse(F.col("text"), route(F.col("command"), F.col("text"), rules)))
    counted = out.withColumn("raw_tokens", estimate_tokens(F.col("text"))).withColumn("filtered_tokens", estimate_tokens(F.col("output")))
    return counted.withColumn("savings_pct", savings(F.col("raw_tokens"), F.col("filtered_tokens")))


# ---- grouped lines -----------------------------------------------------------------------------------------------


def dedup_lines(lines: DataFrame, shown: int = 40) -> DataFrame:
    """Lines (id, pos, line) without their times, each once with its number, in first-seen order."""
    keyed = lines.select("id", "pos", strip_timestamp(F.col("line")).alias("line")).where("line <> ''")
    counted = keyed.groupBy("id", "line").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("first_pos"))
    return counted.withColumn("place", place).where(F.col("place") <= shown)


def by_key(lines: DataFrame, key: Column, top: int) -> DataFrame:
    """Counts by a key of the line, the most frequent first."""
    counted = lines.select("id", key.alias("key")).where("key is not null").groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "key"))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def grep_summary(lines: DataFrame, files: int = 10, each: int = 5) -> DataFrame:
    """Matches (id, pos, file:line:text) by file: the files with most of them, and the first matches of each."""
    file = F.regexp_extract("line", r"^([^:]*[./][^:]*):", 1)
    named = lines.select("id", "pos", "line", file.alias("file")).where("file <> ''")
    # No more than ``each`` matches of a file leave the aggregation.
    counted = named.groupBy("id", "file").agg(F.count(F.lit(1)).alias("n"))
    best = counted.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "file"))).where(F.col("place") <= files)
    first = named.withColumn("nth", F.row_number().over(Window.partitionBy("id", "file").orderBy("pos"))).where(F.col("nth") <= each)
    return first.join(best, ["id", "file"]).select("id", "place", "file", "n", "nth", "line")


def diff_context(lines: DataFrame) -> DataFrame:
    """Diff lines (id, pos, line) that stay: changes and hunk heads, and context within a budget after a change."""
    changed = F.substring("line", 1, 1).isin("+", "-")
    whole, so_far = Window.partitionBy("id"), Window.partitionBy("id").orderBy("pos")
    total = F.count_if(changed).over(whole)
    budget = F.when(total > 200, 0).when(total > 50, 1).otherwise(2)
    keeps = changed | F.col("line").startswith("@@")
    run = F.count_if(keeps).over(so_far)
    marked = lines.select("id", "pos", "line", keeps.alias("keeps"), budget.alias("budget"), run.alias("run"))
    after = F.row_number().over(Window.partitionBy("id", "run").orderBy("pos"))
    return marked.withColumn("after", after).where(F.col("keeps") | ((F.col("run") > 0) & (F.col("after") - 1 <= F.col("budget")))).select("id", "pos", "line")


# ---- interception ------------------------------------------------------------------------------------------------

# Programs whose output is worth filtering, and programs that are never touched.
FILTERED = "git cargo npm pnpm yarn npx pytest python python3 go make gmake docker kubectl pip pip3 uv terraform helm mvn gradle gradlew eslint ruff tsc mypy flake8 ls find grep rg ag cat head tail wc".split()
UNTOUCHED = "cd exit vim vi nano emacs htop top less more man ssh scp rsync".split()


def rewrite(command: Column, wrapper: str = "lodeline proxy") -> Column:
    """The command with the wrapper before each program it filters; null if nothing changes.

    Compound commands are taken apart at && and ;, commands with substitutions or here-documents stay.
    """
    own = wrapper.split()[0]

    def one(part: Column) -> Column:
        program = F.regexp_extract(part, r"^(\S+)", 1)
        opaque = part.contains("$(") | part.contains("`") | part.contains("<<") | part.contains("||")
        fits = ~opaque & program.isin(*FILTERED) & ~program.isin(*UNTOUCHED) & ~part.startswith(f"{own} ")
        return F.when(fits, F.concat(F.lit(f"{wrapper} "), part)).otherwise(part)

    words = lambda text, sep: F.filter(F.transform(F.split(text, sep), lambda w: F.trim(w)), lambda x: x != "")
    plain = F.trim(command)
    compound = F.array_join(F.transform(words(plain, "&&"), lambda seg: F.array_join(F.transform(words(seg, ";"), one), "; ")), " && ")
    is_compound = plain.contains("&&") | plain.contains(";") | plain.contains("||")
    made = F.when(is_compound, compound).otherwise(one(plain))
    changed = F.when(is_compound, made.contains(f"{wrapper} ") & ~plain.startswith(f"{own} ")).otherwise(made != plain)
    return F.when(changed & ~plain.startswith(f"{own} "), made)


# ---- savings -----------------------------------------------------------------------------------------------------


def gain_totals(tracking: DataFrame) -> DataFrame:
    raw, kept = F.sum("raw_tokens"), F.sum("filtered_tokens")
    pct = F.when(raw > 0, (raw - kept).cast("double") / raw * 100).otherwise(F.lit(0.0))
    return tracking.agg(F.count(F.lit(1)).alias("commands"), raw.alias("raw"), kept.alias("filtered"), (raw - kept).alias("saved"), F.round(pct, 6).alias("pct"))


def gain_top(tracking: DataFrame, limit: int = 10) -> DataFrame:
    """Commands by tokens saved; the percentage is the mean over their runs."""
    pct = savings(F.col("raw_tokens"), F.col("filtered_tokens"))
    rows = tracking.groupBy("command").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("raw_tokens") - F.col("filtered_tokens")).alias("saved"), F.round(F.avg(pct), 6).alias("pct"))
    return rows.orderBy(F.desc("saved"), "command").limit(limit)


def gain_daily(tracking: DataFrame, days: int = 30) -> DataFrame:
    """Saved tokens by day, the newest days first, two weeks at most."""
    rows = tracking.groupBy(F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("raw_tokens") - F.col("filtered_tokens")).alias("saved"))
    return rows.orderBy(F.desc("day")).limit(min(days, 14))


def tee(runs: DataFrame, mode: str, folder: str, least: int = 500, keep: int = 50) -> DataFrame:
    """Writes raw outputs worth keeping (failures, always, never) and returns the newest that a retention of ``keep`` retains."""
    wanted = {"failures": F.col("exit_code") != 0, "always": F.lit(True), "never": F.lit(False)}[mode]
    kept = runs.where(wanted & (F.octet_length("text") >= least)).select("at", "command", "text").orderBy(F.desc("at")).limit(keep)
    kept.write.mode("overwrite").parquet(folder)
    return runs.sparkSession.read.parquet(folder)


def with_defaults(rule: Rule, **changes) -> Rule:
    return replace(rule, **changes)


@dataclass(frozen=True)
class Sections:
    """Failure sections of one tool's output: what begins and what ends one, and how much of them is shown."""

    begins: str
    ends: str | None = None
    each: int | None = None  # lines of a section, its first one counted
    lines: int | None = None  # further lines of all sections; first lines are always shown


# Sections by tool.
FAILURES = {
    "go test": Sections("^--- FAIL:", r"^(--- |=== )", lines=30),
    "pytest": Sections("^(FAILED |___)", each=15),
    "jest": Sections("^(● |FAIL )", each=11),
}


def failure_sections(lines: DataFrame, tools: dict[str, Sections] = FAILURES) -> DataFrame:
    """id, section, nth, pos, line: the failure sections of outputs given as (id, tool, pos, line), as far as they are shown.

    Gaps and islands: a running count of the lines that begin a section numbers
    them, the last line that begins or ends one tells whether a line is inside, and row
    numbers cap a section or the output. A window holds the lines of one output.
    """
    text = F.trim(F.regexp_replace("line", "\t", " "))
    pick = lambda get, plain: reduce(lambda out, x: F.when(F.col("tool") == x[0], get(x[1])).otherwise(out), tools.items(), plain)
    never, least = F.lit(False), F.lit(1 << 30)
    rows = lines.where(F.col("tool").isin(*tools)).withColumn("line", text)
    rows = rows.withColumn("begins", pick(lambda s: F.col("line").rlike(s.begins), never)).withColumn("ends", pick(lambda s: F.col("line").rlike(s.ends) if s.ends else never, never))
    order = Window.partitionBy("id").orderBy("pos")
    sofar = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.count_if("begins").over(sofar)).withColumn("inside", F.last(F.when(F.col("begins"), True).when(F.col("ends"), False), ignorenulls=True).over(sofar))
    inside = rows.where("inside").withColumn("nth", F.row_number().over(Window.partitionBy("id", "section").orderBy("pos"))).withColumn("of_all", F.row_number().over(order))
    shown = (F.col("nth") <= pick(lambda s: F.lit(s.each or 1 << 30), least)) & (F.col("begins") | (F.col("of_all") <= pick(lambda s: F.lit(s.lines or 1 << 30), least)))
    return inside.where(shown).select("id", "section", "nth", "pos", "line")
