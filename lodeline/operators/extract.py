"""Symbols, references, chunks and complexity from source text.

Python is parsed exactly with the standard library; other languages are read from
tokens (``languages``) behind the same interface, so a grammar-based parser can be
put in their place (``PARSERS``). Files are independent:
one Arrow pass, no shuffle; what doesn't parse gives a single module chunk.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lodeline.operators.languages import READERS, read

#: Lines of a chunk: aimed at, and at most.
TARGET, MOST = 40, 100
BIG_FILE, ENTRY_HEAD = 1 << 20, 8192


@dataclass
class Found:
    """What a file holds. Lines count from 0, ends are inclusive."""

    symbols: list[tuple[str, str, int, int, str | None]] = field(default_factory=list)  # name, kind, line, end, scope
    refs: list[tuple[int, str | None, str, str | None, str | None, str]] = field(default_factory=list)  # line, in symbol, name, qualifier, receiver, kind
    complexity: int = 1
    is_entry: bool = False
    failed: bool = False


# Calls that say nothing about a project, by language.
PY_BUILTINS = frozenset("print len range str int float bool list dict set tuple isinstance issubclass type super getattr setattr hasattr repr sorted enumerate zip map filter open min max sum any all abs round iter next format id hash input vars dir callable staticmethod classmethod property object bytes bytearray frozenset reversed slice divmod pow ord chr hex oct bin exec eval compile globals locals".split())
TYPING = frozenset("Generic Protocol TypedDict NamedTuple Enum ABC object Exception".split())


class _Python(ast.NodeVisitor):
    def __init__(self) -> None:
        self.found, self.scopes, self.types = Found(), [], [{}]

    def _inside(self) -> str | None:
        return self.scopes[-1][0] if self.scopes else None

    def _owner(self) -> str | None:
        return next((n for n, k in reversed(self.scopes) if k == "class"), None)

    def _ref(self, node, name: str, qualifier: str | None, kind: str, receiver: str | None = None) -> None:
        self.found.refs.append((node.lineno - 1, self._inside(), name, qualifier, receiver, kind))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        self.found.symbols.append((node.name, "class", node.lineno - 1, node.end_lineno - 1, self._owner()))
        self.scopes.append((node.name, "class"))
        for base in node.bases:
            base = base.value if isinstance(base, ast.Subscript) else base
            name, qualifier = (base.id, None) if isinstance(base, ast.Name) else (base.attr, ast.unparse(base.value)) if isinstance(base, ast.Attribute) else (None, None)
            if name and name not in TYPING:
                self._ref(node, name, qualifier, "inherit")
        for child in [*node.decorator_list, *node.keywords, *node.body]:
            self.visit(child)
        self.scopes.pop()

    def _function(self, node) -> None:
        in_class = bool(self.scopes) and self.scopes[-1][1] == "class"
        self.found.symbols.append((node.name, "method" if in_class else "function", node.lineno - 1, node.end_lineno - 1, self._owner() if in_class else None))
        self.scopes.append((node.name, "function"))
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        known = {a.arg: a.annotation.id for a in args if isinstance(a.annotation, ast.Name)}
        if in_class and args and args[0].arg in ("self", "cls"):
            known[args[0].arg] = self._owner()
        self.types.append(self.types[-1] | known)
        for a in [*args, node.args.vararg, node.args.kwarg]:
            if a is not None and a.annotation is not None:
                self._type(a.annotation)
        if node.returns is not None:
            self._type(node.returns)
        for child in [*node.decorator_list, *node.args.defaults, *[d for d in node.args.kw_defaults if d], *node.body]:
            self.visit(child)
        self.types.pop()
        self.scopes.pop()

    visit_FunctionDef = visit_AsyncFunctionDef = _function

    def _type(self, node) -> None:
        for part in ast.walk(node):
            if isinstance(part, ast.Name) and part.id not in PY_BUILTINS and part.id[:1].isupper():
                self._ref(part, part.id, None, "type_ref")

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._type(node.annotation)
        if isinstance(node.target, ast.Name) and isinstance(node.annotation, ast.Name):
            self.types[-1][node.target.id] = node.annotation.id
        if node.value is not None:
            self.visit(node.value)

    def visit_Assign(self, node: ast.Assign) -> None:
        made = node.value.func.id if isinstance(node.value, ast.Call) and isinstance(node.value.func, ast.Name) else None
        for target in node.targets:
            if isinstance(target, ast.Name):
                if made and made[:1].isupper():
                    self.types[-1][target.id] = made
                if not self.scopes:
                    self.found.symbols.append((target.id, "const" if target.id.isupper() else "variable", node.lineno - 1, node.end_lineno - 1, None))
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name) and f.id not in PY_BUILTINS:
            self._ref(node, f.id, None, "call")
        elif isinstance(f, ast.Attribute):
            receiver = self.types[-1].get(f.value.id) if isinstance(f.value, ast.Name) else None
            self._ref(node, f.attr, ast.unparse(f.value), "call", receiver)
        self.generic_visit(node)

    def visit_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            self._ref(node, alias.name, None, "import")

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self._ref(node, module, None, "import")
        for alias in node.names:
            if alias.name != "*":
                self._ref(node, alias.asname or alias.name, module, "import_binding")

    def generic_visit(self, node) -> None:
        if isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)):
            self.found.complexity += 1
        elif isinstance(node, ast.BoolOp):
            self.found.complexity += len(node.values) - 1
        super().generic_visit(node)


def parse_python(text: str) -> Found:
    tree = ast.parse(text)
    visitor = _Python()
    visitor.visit(tree)
    visitor.found.is_entry = any(isinstance(n, ast.If) and "__name__" in ast.unparse(n.test) and "__main__" in ast.unparse(n.test) for n in tree.body)
    return visitor.found


_BRANCH = re.compile(r"\b(?:if|for|while|case|catch|match|elif)\b|&&|\|\||\?\s")
_NOISE = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])'|//[^\n]*|/\*.*?\*/", re.S)
_HASH_NOISE = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'|(?:^|(?<=\s))#[^\n]*")
_MAIN = re.compile(r"^\s*(?:pub\s+)?(?:async\s+)?(?:fn|func)\s+main\s*\(|\bstatic\s+(?:public\s+)?void\s+main\s*\(|^int\s+main\s*\(", re.M)


def _blank(match: re.Match) -> str:
    return re.sub(r"[^\n]", " ", match[0])


def parse_by_tokens(language: str) -> Callable[[str], Found]:
    def run(text: str) -> Found:
        symbols, refs = read(language, text)
        plain = (_HASH_NOISE if language == "bash" else _NOISE).sub(_blank, text)
        symbols.sort(key=lambda s: (s[2], s[0]))
        return Found(symbols, refs, 1 + len(_BRANCH.findall(plain)), bool(_MAIN.search(plain[:ENTRY_HEAD])))

    return run


#: Language -> parser. Replace an entry to plug in another one.
PARSERS: dict[str, Callable[[str], Found]] = {"python": parse_python} | {lang: parse_by_tokens(lang) for lang in (*READERS, "bash")}


def parse(language: str | None, text: str | None) -> Found:
    parser = PARSERS.get(language or "")
    if parser is None or not text:
        return Found()
    try:
        found = parser(text)
        found.is_entry &= len(text) <= BIG_FILE
        return found
    except (SyntaxError, ValueError, RecursionError):
        return Found(failed=True)


def chunk(found: Found, lines: list[str]) -> list[tuple[int, int, str, str | None]]:
    """(start, end, kind, scope): top-level definitions, long ones cut, small neighbours put together, gaps as blocks."""
    tops, covered = [], -1
    for name, kind, start, end, scope in sorted(found.symbols, key=lambda s: (s[2], -s[3])):
        if start > covered and kind not in ("variable", "const"):
            tops.append((start, end, "class" if kind in ("class", "struct", "interface", "enum") else "function", scope))
            covered = max(covered, end)
    parts, at = [], 0
    for start, end, kind, scope in [*tops, (len(lines), len(lines), "", None)]:
        if start > at and any(x.strip() for x in lines[at:start]):
            parts.append((at, start - 1, "import" if re.match(r"\s*(import|from|use|#include)\b", next(x for x in lines[at:start] if x.strip())) else "block", None))
        if kind:
            parts += [(s, min(s + MOST - 1, end), kind, scope) for s in range(start, end + 1, MOST)]
        at = max(at, end + 1)
    merged: list[tuple[int, int, str, str | None]] = []
    for part in parts:
        last = merged[-1] if merged else None
        if last and last[3] == part[3] and (last[2] == part[2] == "import" or part[1] - last[0] + 1 <= TARGET):
            kind = part[2] if part[2] in ("function", "class") else last[2]
            merged[-1] = (last[0], part[1], kind, last[3])
        else:
            merged.append(part)
    return merged or [(0, max(0, len(lines) - 1), "module", None)]


SCHEMA = "file_id long, kind string, name string, what string, line int, end_line int, scope string, qualifier string, receiver string, content string, number int"


def extract(files: DataFrame, generated_refs: bool = False) -> DataFrame:
    """Rows of all sorts in one pass over (id, content, language, generated); ``symbols``, ``refs``, ``chunks``, ``metrics`` pick theirs."""

    def run(frames):
        for frame in frames:
            rows = []
            for file_id, content, language, generated in frame[["id", "content", "language", "generated"]].itertuples(index=False):
                found, lines = parse(language, content), (content or "").split("\n")
                rows += [(file_id, "symbol", n, k, a, b, s, None, None, None, None) for n, k, a, b, s in found.symbols]
                if generated_refs or not generated:
                    rows += [(file_id, "ref", n, k, a, None, s, q, r, None, None) for a, s, n, q, r, k in found.refs]
                for a, b, k, s in chunk(found, lines):
                    body = "\n".join(lines[a : b + 1])
                    rows.append((file_id, "chunk", None, k, a, b, s, None, None, body, len(body.split())))
                longest = max((b - a + 1 for _, k, a, b, _ in found.symbols if k in ("function", "method")), default=0)
                rows.append((file_id, "metric", None, "entry" if found.is_entry else "", longest, None, "failed" if found.failed else None, None, None, None, found.complexity))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            yield out.astype({"line": "Int32", "end_line": "Int32", "number": "Int32"})

    return files.select("id", "content", "language", "generated").mapInPandas(run, SCHEMA)


def observed(rows: DataFrame, observation: Observation) -> DataFrame:
    """``rows`` that, when written, also count files and those that failed to parse."""
    file = F.col("kind") == "metric"
    return rows.observe(observation, F.count_if(file).alias("files"), F.count_if(file & (F.coalesce("scope", F.lit("")) == "failed")).alias("errors"))


def _numbered(df: DataFrame, *key: str) -> DataFrame:
    return df.withColumn("id", F.xxhash64(*key).bitwiseAND((1 << 53) - 1))


def symbols(rows: DataFrame) -> DataFrame:
    return _numbered(rows.where("kind = 'symbol'"), "file_id", "name", "what", "line").select("id", "file_id", "name", F.col("what").alias("kind"), "line", "end_line", "scope")


def refs(rows: DataFrame) -> DataFrame:
    picked = _numbered(rows.where("kind = 'ref'"), "file_id", "name", "what", "line", "qualifier", "scope").dropDuplicates(["id"])
    return picked.select("id", F.col("file_id").alias("source_file_id"), F.col("line").alias("source_line"), F.col("scope").alias("source_symbol"), F.col("name").alias("target_name"), F.col("qualifier").alias("target_qualifier"), F.col("receiver").alias("receiver_type"), F.col("what").alias("kind"))


def chunks(rows: DataFrame) -> DataFrame:
    return _numbered(rows.where("kind = 'chunk'"), "file_id", "line", "end_line").select("id", "file_id", "content", F.col("what").alias("kind"), F.col("line").alias("start_line"), "end_line", "scope", F.col("number").alias("token_count"))


def metrics(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'metric'").select("file_id", F.col("number").cast("double").alias("cyclomatic"), F.col("line").alias("max_func_lines"), (F.col("what") == "entry").alias("is_entry"))
