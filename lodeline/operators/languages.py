"""Symbols and references of Rust, Go, TypeScript, JavaScript, Java, C, C++ and shell sources, read from tokens.

One walk over the tokens of a file, without comments, keeps a stack of open
definitions. A header (``fn f(x: T)``) waits for its brace; the names it and later
declarations give a type to are what method calls look their receiver up in.
Languages differ in how definitions, imports and types look, which the subclasses say.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: name, kind, first line, last line, owner; and line, enclosing symbol, name, qualifier, receiver type, kind.
Symbol = tuple[str, str, int, int, str | None]
Reference = tuple[int, str | None, str, str | None, str | None, str]

_COMMENT = r"(?P<skip>\s+|//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z))"
_REST = r"(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>::|->|=>|:=|\?\.|\.\.\.|&&|\|\||\S)"
_DOUBLE, _CHAR = r"\"(?:\\.|[^\"\\])*\"", r"'(?:\\.[^'\n]{0,8}|[^'\\\n])'"
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


@dataclass
class _Scope:
    name: str
    kind: str
    symbol: int | None
    types: dict[str, str] = field(default_factory=dict)
    depth: int = 0


class Reader:
    """The walk; subclasses handle what is particular to a language."""

    STRINGS = f"{_DOUBLE}|{_CHAR}"
    KEYWORDS: frozenset[str] = frozenset()
    BUILTINS: frozenset[str] = frozenset()
    LINKS = (".", "::", "->", "?.")
    THIS = ("this", "self")

    def __init__(self, text: str):
        self.text: list[str] = []
        self.kind: list[str] = []
        self.line: list[int] = []
        line = 0
        for m in re.compile(f"{_COMMENT}|(?P<string>{self.STRINGS})|{_REST}").finditer(text):
            if m.lastgroup != "skip":
                self.text.append(m[0])
                self.kind.append(m.lastgroup)
                self.line.append(line)
            line += m[0].count("\n")
        self.symbols: list[list] = []
        self.refs: list[Reference] = []
        self.scopes: list[_Scope] = []
        self.pending: _Scope | None = None
        self.depth = self.parens = 0
        self.last = line

    # -- tokens --

    def at(self, i: int) -> str:
        return self.text[i] if 0 <= i < len(self.text) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.text) and self.kind[i] == "name" and self.text[i] not in self.KEYWORDS

    def close_of(self, i: int) -> int:
        """The token that closes the bracket at ``i``."""
        depth = 0
        for k in range(i, len(self.text)):
            if self.text[k] in _OPEN:
                depth += 1
            elif self.text[k] in _CLOSE:
                depth -= 1
                if depth == 0:
                    return k
        return len(self.text) - 1

    def after_generics(self, i: int) -> int:
        """The place after <...> at ``i``, if that is what stands there."""
        depth, k = 0, i
        while self.at(k) and k < i + 60:
            depth += {"<": 1, ">": -1}.get(self.text[k], 0)
            if self.text[k] in ";{}":
                break
            k += 1
            if depth == 0:
                return k
        return i

    # -- what is found --

    def inside(self) -> str | None:
        return next((s.name for s in reversed(self.scopes) if s.kind in ("function", "method")), self.scopes[0].name if self.scopes and self.scopes[0].kind != "impl" else None)

    def owner(self) -> str | None:
        """The class whose body is open, not that of a function within."""
        return self.scopes[-1].name if self.scopes and self.scopes[-1].kind in ("class", "struct", "interface", "enum", "impl") else None

    def symbol(self, i: int, kind: str, owner: str | None = None) -> int:
        self.symbols.append([self.text[i], kind, self.line[i], self.line[i], owner])
        return len(self.symbols) - 1

    def define(self, i: int, kind: str, owner: str | None = None) -> None:
        """A definition whose body, if it has one, is in the next braces."""
        self.pending = _Scope(self.text[i], kind, self.symbol(i, kind, owner))

    def ref(self, i: int, kind: str, qualifier: str | None = None, receiver: str | None = None, name: str | None = None) -> None:
        inside = None if kind.startswith("import") else self.pending.name if self.pending and self.pending.symbol is not None else self.inside()
        self.refs.append((self.line[i], inside, name or self.text[i], qualifier, receiver, kind))

    def type_ref(self, i: int) -> None:
        name = self.text[i]
        if name not in self.BUILTINS and len(name) > 1:
            self.ref(i, "type_ref", self.text[i - 2] if self.at(i - 1) in (".", "::") and self.is_name(i - 2) else None)

    def declare(self, name: str, type_name: str) -> None:
        scope = self.pending or next((s for s in reversed(self.scopes) if s.kind in ("function", "method")), None)
        if scope and type_name not in self.BUILTINS:
            scope.types[name] = type_name

    def type_of(self, name: str) -> str | None:
        if name in self.THIS:
            return next((s.name for s in reversed(self.scopes) if s.kind in ("class", "struct", "impl")), None) or next((self.symbols[s.symbol][4] for s in reversed(self.scopes) if s.kind == "method" and s.symbol is not None), None)
        return next((s.types[name] for s in reversed(self.scopes) if name in s.types), None)

    def chain(self, i: int) -> tuple[str | None, bool]:
        """What stands before the name at ``i`` and its link, and whether that is a single name."""
        k, parts = i - 1, []
        if self.at(k) not in self.LINKS:
            return None, False
        while k >= 0 and self.text[k] in self.LINKS:
            parts.append(self.text[k])
            k -= 1
            while k >= 0 and self.text[k] in (")", "]"):
                depth, stop = 0, k
                while k >= 0:
                    depth += (self.text[k] in _CLOSE) - (self.text[k] in _OPEN)
                    parts.append(self.text[k])
                    k -= 1
                    if depth == 0 or stop - k > 60:
                        break
            if k >= 0 and self.kind[k] in ("name", "string", "number"):
                parts.append(self.text[k])
                k -= 1
            else:
                break
        found = "".join(reversed(parts[1:]))
        return found or None, bool(re.fullmatch(r"[\w$]+", found))

    def call(self, i: int) -> None:
        qualifier, single = self.chain(i)
        if qualifier is None and self.text[i] in self.BUILTINS or self.skip_call(i, qualifier):
            return
        self.ref(i, "call", qualifier, self.type_of(qualifier) if single and qualifier else None)

    def skip_call(self, i: int, qualifier: str | None) -> bool:
        return False

    # -- the walk --

    def run(self) -> tuple[list[Symbol], list[Reference]]:
        i = 0
        while i < len(self.text):
            word = self.text[i]
            if self.kind[i] == "op":
                if word == "{":
                    self.depth += 1
                    if self.pending and self.parens == 0:
                        self.pending.depth = self.depth
                        self.scopes.append(self.pending)
                        self.pending = None
                elif word == "}":
                    while self.scopes and self.scopes[-1].depth >= self.depth:
                        done = self.scopes.pop()
                        if done.symbol is not None:
                            self.symbols[done.symbol][3] = self.line[i]
                    self.depth = max(0, self.depth - 1)
                elif word in "([":
                    self.parens += 1
                elif word in ")]":
                    self.parens = max(0, self.parens - 1)
                elif word == ";" and self.parens == 0:
                    if self.pending and self.pending.symbol is not None:
                        self.symbols[self.pending.symbol][3] = self.line[i]
                    self.pending = None
            elif self.kind[i] == "name":
                i = self.name(i)
                continue
            i += 1
        for scope in self.scopes:
            if scope.symbol is not None:
                self.symbols[scope.symbol][3] = self.last
        return [tuple(s) for s in self.symbols], self.refs

    def name(self, i: int) -> int:
        """Handles the name at ``i``; the next token to look at."""
        raise NotImplementedError

    def plain(self, i: int) -> int:
        """A name that opens nothing: a call, or what ``other`` makes of it."""
        if self.is_name(i):
            if self.at(i + 1) == "(":
                self.call(i)
            else:
                self.other(i)
        return i + 1

    def other(self, i: int) -> None:
        pass


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


class Go(Reader):
    STRINGS = f"{_DOUBLE}|`[^`]*`|{_CHAR}"
    KEYWORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
    # Functions and types of the language itself.
    BUILTINS = _words("len cap make new append copy delete close panic recover print println complex real imag min max clear int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string bool byte rune error any comparable nil true false iota")
    THIS = ()

    def name(self, i: int) -> int:
        word = self.text[i]
        if word == "import":
            last = self.close_of(i + 1) if self.at(i + 1) == "(" else i + 2
            for k in range(i + 1, min(last + 1, len(self.text))):
                if self.kind[k] == "string":
                    self.ref(k, "import", name=self.text[k][1:-1])
            return last + 1
        if word == "func" and self.depth == 0:
            owner, k = None, i + 1
            receiver = {}
            if self.at(k) == "(":
                end = self.close_of(k)
                inner = [j for j in range(k + 1, end) if self.is_name(j)]
                base = next((j for j in inner if self.at(j - 1) in ("*", "(") and self.at(j + 1) in (")", "[") or self.is_name(j - 1)), None)
                owner = self.text[base] if base is not None else None
                if owner and inner[0] != base:
                    receiver[self.text[inner[0]]] = owner
                k = end + 1
            if self.is_name(k):
                self.define(k, "method" if owner else "function", owner)
                self.pending.types |= receiver
                return k + 1
            return k
        if word == "type" and self.is_name(i + 1):
            k = self.close_of(i + 2) + 1 if self.at(i + 2) == "[" and self.is_name(i + 3) else i + 2
            kind = self.at(k) if self.at(k) in ("struct", "interface") else "type"
            if kind == "type":
                self.symbol(i + 1, kind)
            else:
                self.define(i + 1, kind)
            return i + 2
        if word in ("const", "var") and self.depth == 0:
            if self.at(i + 1) == "(":
                end, k = self.close_of(i + 1), i + 2
                while k < end:
                    if self.is_name(k) and self.line[k] != self.line[k - 1]:
                        self.symbol(k, "const" if word == "const" else "variable")
                    k = self.close_of(k) + 1 if self.text[k] in _OPEN else k + 1
            elif self.is_name(i + 1):
                self.symbol(i + 1, "const" if word == "const" else "variable")
        return self.plain(i)

    def other(self, i: int) -> None:
        after, before = self.at(i + 1), self.at(i - 1)
        if after == ":=":
            k = i + 3 if self.at(i + 2) == "&" else i + 2
            if self.is_name(k):
                tail = k + 2 if self.at(k + 1) == "." and self.is_name(k + 2) else k
                if self.at(tail + 1) == "{":
                    self.declare(self.text[i], self.text[tail])
                elif self.at(tail + 1) == "(" and re.match(r"New[A-Z]", self.text[tail]):
                    self.declare(self.text[i], self.text[tail][3:])
        elif after == "{" and self.text[i][0].isupper() or before in ("*", "]") and self.text[i][0].isupper():
            self.type_ref(i)
        elif self.is_name(i - 1) or before == "." and self.is_name(i - 2) and (self.is_name(i - 3) or self.at(i - 3) == "*" or after == "{"):
            # ``x T``, ``x *T`` and ``x pkg.T``.
            if self.is_name(i - 1) and after != ".":
                if self.text[i][0].isupper() or self.text[i] not in self.BUILTINS and self.line[i] == self.line[i - 1]:
                    self.type_ref(i)
                    self.declare(self.text[i - 1], self.text[i])
            elif before == ".":
                self.type_ref(i)
                k = i - 4 if self.at(i - 3) == "*" else i - 3
                if self.is_name(k):
                    self.declare(self.text[k], self.text[i])
        if before == "*" and self.is_name(i - 2) and after != ".":
            self.declare(self.text[i - 2], self.text[i])


class Rust(Reader):
    STRINGS = rf"b?r#*\"(?:.|\n)*?\"#*|b?{_DOUBLE}|b?{_CHAR}"
    KEYWORDS = _words("as async await break const continue dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type unsafe use where while true false")
    # The prelude, containers and primitive types.
    BUILTINS = _words("Some None Ok Err Box Vec String Option Result Self HashMap HashSet BTreeMap BTreeSet VecDeque Rc Arc Cell RefCell Mutex RwLock Cow Path PathBuf Default Clone Copy Debug Display Iterator IntoIterator From Into AsRef Send Sync Sized Fn FnMut FnOnce Drop Eq PartialEq Ord PartialOrd Hash ToString drop u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64 bool char str")
    THIS = ("self", "Self")

    def _uses(self, i: int, end: int, prefix: str) -> Iterator[tuple[int, str, str | None]]:
        """(token, path, bound name) of every leaf of a use tree in tokens i..end."""
        parts, k = [prefix] if prefix else [], i
        while k < end:
            if self.text[k] == "{":
                close, low = self.close_of(k), k + 1
                depth = 0
                for j in range(k + 1, close + 1):
                    depth += (self.text[j] in _OPEN) - (self.text[j] in _CLOSE)
                    if self.text[j] == "," and depth == 0 or j == close:
                        if low < j:
                            yield from self._uses(low, j, "::".join(parts))
                        low = j + 1
                return
            if self.text[k] == "as":
                break
            if self.text[k] != "::":
                parts.append(self.text[k])
            k += 1
        leaf = parts[-1] if parts else ""
        if leaf in ("self", "*"):
            yield i, "::".join(parts[:-1]), None
        elif parts:
            yield min(k, end) - 1, "::".join(parts), self.text[k + 1] if k < end and self.text[k] == "as" else leaf

    def name(self, i: int) -> int:
        word, after = self.text[i], i + 1
        if word == "use":
            end = next((k for k in range(i, len(self.text)) if self.text[k] == ";"), len(self.text))
            for k, path, bound in self._uses(i + 1, end, ""):
                self.ref(k, "import", name=path)
                if bound and "::" in path:
                    self.ref(k, "import_binding", path.rpartition("::")[0], name=bound)
            return end
        if word == "fn" and self.is_name(after):
            owner = self.owner()
            self.define(after, "method" if owner else "function", owner)
            return after + 1
        if word in ("struct", "enum", "trait", "union") and self.is_name(after):
            self.define(after, {"trait": "interface", "union": "struct"}.get(word, word))
            return after + 1
        if word in ("const", "static") and self.at(after + (self.at(after) == "mut") + 1) == ":":
            self.symbol(after + (self.at(after) == "mut"), "const", self.owner())
        elif word == "type" and self.is_name(after):
            self.symbol(after, "type", self.owner())
            return after + 1
        elif word == "mod" and self.is_name(after):
            self.symbol(after, "module")
        elif word == "impl" and self.parens == 0 and self.pending is None:
            # ``impl<T> Trait for Type``: methods belong to the type.
            start = k = self.after_generics(after) if self.at(after) == "<" else after
            names, depth = [], 0
            while k < len(self.text) and self.text[k] not in ("{", ";", "where"):
                depth += {"<": 1, ">": -1}.get(self.text[k], 0)
                if self.text[k] == "for" and depth == 0:
                    if names:
                        self.ref(names[-1], "type_ref", None)
                    names = []
                elif depth == 0 and self.is_name(k) and self.at(k + 1) != "::":
                    names.append(k)
                k += 1
            if names:
                self.pending = _Scope(self.text[names[-1]], "impl", None)
            return max(k, start)
        return self.plain(i)

    def plain(self, i: int) -> int:
        if self.is_name(i) and self.at(i + 1) == "::" and self.at(i + 2) == "<":
            end = self.after_generics(i + 2)
            if self.at(end) == "(":
                self.call(i)
                return end
        return super().plain(i)

    def other(self, i: int) -> None:
        word, before, after = self.text[i], self.at(i - 1), self.at(i + 1)
        if after == ":" and self.at(i - 1) not in ("::", "."):
            k = i + 2
            while self.at(k) in ("&", "mut", "'", "dyn", "impl") or self.at(k - 1) == "'":
                k += 1
            while self.is_name(k) and self.at(k + 1) == "::":
                k += 2
            if self.is_name(k) and self.text[k][0].isupper():
                self.declare(word, self.text[k])
        elif after == "=" and (before in ("let", "mut")) and self.is_name(i + 2) and self.text[i + 2][0].isupper() and self.at(i + 3) in ("::", "{", "("):
            self.declare(word, self.text[i + 2])
        if word[0].isupper() and not (word.isupper() and len(word) > 1) and (before in (":", "->", "<", "&", "mut", "dyn", "impl", "as", "+", ",", "(", "'") or after == "{" or before == "::" and after != "::") and after != "::":
            if before not in (",", "(") or self.pending or after in (">", ",", ")") and before == ",":
                self.type_ref(i)


class TypeScript(Reader):
    STRINGS = rf"{_DOUBLE}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    KEYWORDS = _words("abstract any as async await break case catch class const continue debugger declare default delete do else enum export extends finally for from function get if implements import in infer instanceof interface is keyof let namespace new of override private protected public readonly return satisfies set static super switch this throw try type typeof undefined unique var void while with yield true false null")
    # Functions and types of the runtime.
    BUILTINS = _words("parseInt parseFloat isNaN isFinite require setTimeout setInterval clearTimeout clearInterval encodeURIComponent decodeURIComponent fetch Set Map WeakSet WeakMap Promise Error Date RegExp Array Object Number String Boolean Symbol Function BigInt ArrayBuffer Iterator AsyncIterator Record Partial Required Readonly Pick Omit Exclude Extract NonNullable ReturnType Parameters string number boolean unknown never object symbol bigint")
    THIS = ("this",)

    def _module(self, i: int) -> int | None:
        """The string that ends an import or export statement at ``i``."""
        for k in range(i + 1, min(i + 400, len(self.text))):
            if self.kind[k] == "string" and self.at(k - 1) in ("from", "import", "("):
                return k
            if self.text[k] in (";", "=") or self.text[k] in ("function", "class", "const", "interface") and k > i + 1:
                return None
        return None

    def _bindings(self, low: int, high: int, module: str) -> None:
        k = low
        while k < high:
            if self.text[k] not in ("type", "default", "from", "*", "as") and self.kind[k] == "name" and not (self.at(k + 1) == "as"):
                self.ref(k, "import_binding", module)
            k += 1

    def name(self, i: int) -> int:
        word, after = self.text[i], i + 1
        if word == "import" and self.at(after) != "(" and self.at(i - 1) != ".":
            end = after if self.at(after) and self.kind[after] == "string" else self._module(i)
            if end is not None:
                module = self.text[end][1:-1]
                self.ref(end, "import", name=module)
                self._bindings(after, end, module)
                return end + 1
        if word == "export" and self.at(after) in ("{", "*"):
            end = self._module(i)
            if end is not None:
                module = self.text[end][1:-1]
                self.ref(end, "import", name=module)
                self._bindings(after, end, module)
                return end + 1
            return self.close_of(after) + 1 if self.at(after) == "{" else after
        if word in ("class", "interface", "enum") and self.is_name(after) and self.at(i - 1) != ".":
            self.define(after, word)
            k = after + 1
            kind = None
            while k < len(self.text) and self.text[k] not in ("{", ";"):
                if self.text[k] in ("extends", "implements"):
                    kind = "inherit"
                elif self.text[k] == "<":
                    end = self.after_generics(k)
                    for j in range(k, end):
                        if self.is_name(j) and self.text[j][0].isupper():
                            self.type_ref(j)
                    k = max(end, k + 1)
                    continue
                elif kind and self.is_name(k) and self.at(k + 1) != "." and self.text[k] not in self.BUILTINS:
                    self.ref(k, kind, self.text[k - 2] if self.at(k - 1) == "." else None)
                k += 1
            return k
        if word == "function":
            k = after + (self.at(after) == "*")
            if self.is_name(k):
                self.define(k, "function")
                return k + 1
        if word == "type" and self.is_name(after) and self.at(after + 1) in ("=", "<"):
            self.symbol(after, "type")
            return after + 1
        if word in ("const", "let", "var") and self.is_name(after):
            self._variable(word, after)
            return after + 1
        if word == "new" and self.is_name(after):
            k = after
            while self.at(k + 1) == "." and self.is_name(k + 2):
                k += 2
            if self.text[k] not in self.BUILTINS:
                self.ref(k, "call", self.chain(k)[0])
            return k + 1
        owner = self.owner()
        if owner and self.depth == self.scopes[-1].depth and self.parens == 0 and self.pending is None and self.kind[i] == "name" and (self.is_name(i) or word in ("get", "set", "delete", "of", "from") and self.at(after) == "("):
            k = self.after_generics(after) if self.at(after) == "<" else after
            if self.at(k) == "(":
                end = self.close_of(k)
                tail = end + 1
                if self.at(tail) in ("{", ":") or self.scopes[-1].kind == "interface":
                    self.define(i, "method", owner)
                    return k
            elif self.at(after) in (":", "=", "?", "!"):
                arrow = next((j for j in range(after, min(after + 40, len(self.text))) if self.text[j] in ("=>", ";", "{")), None)
                if arrow and self.text[arrow] == "=>" and self.at(after) == "=":
                    self.define(i, "method", owner)
                    return after
        return self.plain(i)

    def _variable(self, word: str, i: int) -> None:
        k = i + 1
        if self.at(k) == ":":
            if self.is_name(k + 1) and self.text[k + 1][0].isupper():
                self.declare(self.text[i], self.text[k + 1])
            k = next((j for j in range(k, min(k + 40, len(self.text))) if self.text[j] in ("=", ";")), k)
        if self.at(k) == "=":
            if self.at(k + 1) == "new" and self.is_name(k + 2):
                self.declare(self.text[i], self.text[k + 2])
            if self.at(k + 1) == "require" and self.at(k + 2) == "(" and self.kind[min(k + 3, len(self.kind) - 1)] == "string":
                self.ref(k + 3, "import", name=self.text[k + 3][1:-1])
                self.ref(i, "import_binding", self.text[k + 3][1:-1])
            j = k + 1 + (self.at(k + 1) == "async")
            arrow = self.close_of(j) + 1 if self.at(j) == "(" else j + 1
            if self.at(arrow) == ":":
                arrow = next((x for x in range(arrow, min(arrow + 20, len(self.text))) if self.text[x] in ("=>", ";", "{")), arrow)
            if self.at(arrow) == "=>" or self.at(j) == "function":
                self.define(i, "function", None)
                return
        if not self.scopes:
            self.symbol(i, "const" if word == "const" else "variable")

    def other(self, i: int) -> None:
        word, before, after = self.text[i], self.at(i - 1), self.at(i + 1)
        if after in (":", "?") and before in ("(", ","):
            k = i + (3 if after == "?" else 2)
            if self.is_name(k) and self.text[k][0].isupper():
                self.declare(word, self.text[k])
        if word[0].isupper():
            if before in (":", "|", "&", "as", "is", "keyof", "satisfies", "extends") and after != "(":
                self.type_ref(i)
            elif before == "<" or before == "." and self._jsx(i):
                if after in (">", "/", ".") or self.at(i + 1) and self.kind[i + 1] == "name" or before == ".":
                    if after != ".":
                        generic = self.is_name(i - 2) or self.at(i - 2) == "."
                        self.ref(i, "type_ref" if generic and before == "<" else "call", self.text[i - 2] if before == "." else None)
                elif after in (",", "[", "|", "<"):
                    self.type_ref(i)

    def _jsx(self, i: int) -> bool:
        """Whether the dotted name that ends at ``i`` opens an element."""
        k = i
        while self.at(k - 1) == "." and self.is_name(k - 2):
            k -= 2
        return k < i and self.at(k - 1) == "<" and not self.is_name(k - 2)


class Java(Reader):
    KEYWORDS = _words("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public record return short static strictfp super switch synchronized this throw throws transient try var void volatile while true false null yield sealed permits")
    # Types that every program knows.
    BUILTINS = _words("String Object Integer Long Double Float Boolean Character Byte Short Number Void List Map Set Collection Optional Override Deprecated SuppressWarnings Exception RuntimeException Throwable Error Iterable Iterator Comparable Runnable Class System Math")
    THIS = ("this",)

    def name(self, i: int) -> int:
        word, after = self.text[i], i + 1
        if word in ("import", "package"):
            end = next((k for k in range(i, len(self.text)) if self.text[k] == ";"), len(self.text))
            path = "".join(t for t in self.text[after:end] if t != "static")
            if word == "import":
                self.ref(i, "import", name=path)
                if not path.endswith("*"):
                    self.ref(i, "import_binding", path, name=path.rpartition(".")[2])
            return end
        if word in ("class", "interface", "enum", "record") and self.is_name(after) and self.at(i - 1) != ".":
            self.define(after, "class" if word == "record" else word, self.owner())
            k, kind = after + 1, None
            if self.at(k) == "(":
                k = self.close_of(k) + 1
            while k < len(self.text) and self.text[k] not in ("{", ";"):
                if self.text[k] in ("extends", "implements"):
                    kind = "inherit"
                elif self.text[k] == "<":
                    k = max(self.after_generics(k), k + 1)
                    continue
                elif kind and self.is_name(k) and self.at(k + 1) != "." and self.text[k] not in self.BUILTINS:
                    self.ref(k, kind)
                k += 1
            return k
        if word == "new" and self.is_name(after):
            k = after
            while self.at(k + 1) == "." and self.is_name(k + 2):
                k += 2
            if self.text[k] not in self.BUILTINS:
                self.ref(k, "call")
            return k + 1
        owner = self.owner()
        if owner and self.is_name(i) and self.at(after) == "(" and self.depth == self.scopes[-1].depth and self.parens == 0 and self.at(i - 1) not in (".", "=", "@", "new"):
            self.define(i, "method", owner)
            return after
        return self.plain(i)

    def other(self, i: int) -> None:
        word, before = self.text[i], self.at(i - 1)
        if not word[0].isupper() or word.isupper() and len(word) > 1 or before in (".", "@"):
            return
        k = self.after_generics(i + 1) if self.at(i + 1) == "<" else i + 1
        while self.at(k) == "[" and self.at(k + 1) == "]":
            k += 2
        if self.is_name(k) and self.at(k + 1) in (";", "=", ",", ")", ":"):
            self.declare(self.text[k], word)
            self.type_ref(i)
        elif self.is_name(k) or before in ("<", "instanceof", "throws", "?", "extends", "super") or before == "(" and self.at(k) == ")" or before == "," and self.at(k) == ">":
            self.type_ref(i)


class C(Reader):
    KEYWORDS = _words("auto break case catch char class const const_cast constexpr continue decltype default delete do double dynamic_cast else enum explicit extern final float for friend goto if inline int long mutable namespace new noexcept operator override private protected public register reinterpret_cast return short signed sizeof static static_cast struct switch template this throw try typedef typename union unsigned using virtual void volatile while bool true false nullptr NULL")
    # The standard library's everyday names.
    BUILTINS = _words("printf fprintf sprintf snprintf scanf malloc calloc realloc free memcpy memset memmove memcmp strlen strcmp strncmp strcpy strncpy strcat strchr strstr exit abort assert sizeof fopen fclose fread fwrite fgets puts size_t ssize_t int8_t int16_t int32_t int64_t uint8_t uint16_t uint32_t uint64_t FILE string vector map set unique_ptr shared_ptr make_unique make_shared move pair optional")
    THIS = ("this",)

    def __init__(self, text: str):
        includes = [(m.start(1), m[1]) for m in re.finditer(r"^[ \t]*#[ \t]*include[ \t]*\"([^\"\n]+)\"", text, re.M)]
        plain = re.sub(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", "", text, flags=re.M) if "#" in text else text
        # Directives leave empty lines, so that lines keep their numbers.
        if plain.count("\n") != text.count("\n"):
            plain = re.sub(r"^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", lambda m: "\n" * m[0].count("\n"), text, flags=re.M)
        super().__init__(plain)
        self.refs += [(text.count("\n", 0, at), None, name, None, None, "import") for at, name in includes]

    def name(self, i: int) -> int:
        word, after = self.text[i], i + 1
        if word in ("struct", "class", "union", "enum"):
            k = after + (self.at(after) == "class")
            if self.is_name(k):
                stops = ("{", ";") if ":" in (self.at(k + 1), self.at(k + 2)) else ("{", ";", "(", ")", "=", "*", ",", ">")
                end = next((j for j in range(k, min(k + 80, len(self.text))) if self.text[j] in stops), k)
                if self.at(end) == "{":
                    self.define(k, "class" if word == "class" else "enum" if word == "enum" else "struct")
                    if word != "enum":
                        for j in range(k + 1, end):
                            if self.is_name(j) and self.at(j + 1) in (",", "{", "<") and self.at(j - 1) in (":", ",", "public", "private", "protected", "virtual", "::"):
                                self.ref(j, "inherit", self.text[j - 2] if self.at(j - 1) == "::" else None)
                    return end
                self.type_ref(k)
                self._declared(k)
                return k + 1
        if word == "namespace" and self.is_name(after):
            end = next((j for j in range(after, min(after + 20, len(self.text))) if self.text[j] in ("{", ";", "=")), after)
            return end
        if word == "new" and self.is_name(after):
            if self.text[after] not in self.BUILTINS:
                self.ref(after, "call")
            return after + 1
        if self.is_name(i) and self.at(after) == "(" and self.parens == 0 and self._outside():
            end = self.close_of(after)
            tail = end + 1
            while self.at(tail) in ("const", "override", "noexcept", "final", "volatile"):
                tail += 1
            if self.at(tail) == ":" or self.at(tail) == "->":
                tail = next((j for j in range(tail, min(tail + 200, len(self.text))) if self.text[j] in ("{", ";")), tail)
            if self.at(tail) == "{":
                owner = self.text[i - 2] if self.at(i - 1) == "::" and self.is_name(i - 2) else self.owner()
                self.define(i, "method" if owner else "function", owner)
                return after
            if self.at(tail) in (";", "=") and self.owner():
                self.symbol(i, "method", self.owner())
                return after
            if self.at(tail) == ";" and (self.is_name(i - 1) or self.at(i - 1) == "*" or self.at(i - 1) in self.KEYWORDS):
                return after
        return self.plain(i)

    def _outside(self) -> bool:
        return not any(s.kind in ("function", "method") for s in self.scopes) and self.pending is None

    def skip_call(self, i: int, qualifier: str | None) -> bool:
        return qualifier is not None and (qualifier == "std" or qualifier.startswith("std::"))

    def _declared(self, i: int) -> bool:
        """``T x``, ``T *x`` or ``T& x`` at ``i``: the variable gets its type."""
        k = self.after_generics(i + 1) if self.at(i + 1) == "<" else i + 1
        while self.at(k) in ("*", "&", "const", "&&"):
            k += 1
        if self.is_name(k) and self.at(k + 1) in (";", "=", ",", ")", "[", "{", ":", "(") and k > i:
            self.declare(self.text[k], self.text[i])
            return True
        return False

    def other(self, i: int) -> None:
        if self.at(i + 1) == "::" or self.at(i - 1) in (".", "->") or self.at(i - 1) == "::" and self.at(i - 2) == "std":
            return
        if self.text[i] not in self.BUILTINS and (self._declared(i) or self.text[i][0].isupper() and self.at(i - 1) in ("<", ",") and self.at(i + 1) in (">", ",", "*") and not self.text[i].isupper()):
            self.type_ref(i)


# What scripts call that isn't theirs.
_SHELL = _words("echo cd ls mkdir rm ln mv cp find grep sed awk cat head tail sort uniq wc set unset export source exit return true false test read printf eval exec shift trap kill jobs fg bg wait sleep date dirname basename realpath mktemp tar curl wget git cargo npm node python python3 bash sh zsh local declare typeset readonly alias command type pushd popd break continue touch chmod chown xargs tr cut tee env")
_SHELL_WORDS = _words("if then elif else fi for while until do done case esac in function select time")


def read_shell(text: str) -> tuple[list[Symbol], list[Reference]]:
    """Functions, and plain commands that are nobody else's."""
    plain = re.sub(r"\\\n", lambda m: " " * len(m[0]), text)
    plain = re.sub(r"'[^']*'|\"(?:\\.|[^\"\\])*\"|(?:^|(?<=\s))#[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), plain, flags=re.M)
    symbols, refs, open_at, depth = [], [], [], 0
    for number, line in enumerate(plain.split("\n")):
        head = re.match(r"\s*(?:function\s+([\w.:-]+)\s*(?:\(\s*\))?|([\w.:-]+)\s*\(\s*\))\s*(\{?)", line)
        rest = line
        if head and (head[1] or head[2]):
            symbols.append([head[1] or head[2], "function", number, number, None])
            open_at.append((len(symbols) - 1, depth))
            rest = " " * head.end(2 if head[2] else 1) + re.sub(r"[()]", " ", line[head.end(2 if head[2] else 1) :], count=2)
        inside = symbols[open_at[-1][0]][0] if open_at else None
        for part in re.split(r"\|\||&&|[;|&()`]|(?:^|\s)\{", rest.replace("$(", "(")):
            words = part.split()
            while words and (words[0] in _SHELL_WORDS or words[0] in ("!", "{", "}") or re.match(r"\w+=", words[0])):
                if words[0] in ("for", "case", "select", "in", "function"):
                    words = []
                    break
                words.pop(0)
            if words and re.fullmatch(r"[A-Za-z_][\w-]*", words[0]) and words[0] not in _SHELL:
                refs.append((number, inside, words[0], None, None, "call"))
            elif len(words) > 1 and words[0] in (".", "source") and re.fullmatch(r"[\w./-]+", words[1]):
                refs.append((number, None, words[1], None, None, "import"))
        depth += line.count("{") - line.count("}")
        while open_at and depth <= open_at[-1][1] and ("}" in line):
            symbols[open_at.pop()[0]][3] = number
    return [tuple(s) for s in symbols], refs


READERS = {"go": Go, "rust": Rust, "typescript": TypeScript, "tsx": TypeScript, "javascript": TypeScript, "java": Java, "c": C, "cpp": C}


def read(language: str, text: str) -> tuple[list[Symbol], list[Reference]]:
    return read_shell(text) if language == "bash" else READERS[language](text).run()
