"""Reference resolution: twelve tiers in one pass.

Every tier's condition reads columns that the cascade never changes, so the
tiers are independent: each proposes a target in a column of its own, and the
lowest tier of the row wins, without a shuffle by reference. Candidates are reduced to one row
per key before they meet the references (how many files, which symbol first),
so common names fan nothing out and leave no skew on the candidates' side.
The cascade shuffles the references once, by name: every table that they meet
has the name in its key and lies in the same partitions, held as a hash table
of the partition's names while references stream by. Files and what they import
are held by every task, up to a checked number, and met after that shuffle. What has
another key (types of receivers, the inheritance walk) is found for what is asked,
once for equal asks, and brought under the name first.

Columns. files: id, path, dir, lang_family. symbols: id, file_id, name, kind,
scope. refs: id, source_file_id, target_name, target_qualifier, receiver_type,
kind. bindings: source_file_id, target_name, target_file_id.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.tables import cut, in_place
from lodeline.functions.paths import is_doc, is_test_candidate, normalize

# Names of the runtime that must not resolve to a user's type.
TS_BUILTINS = "Set Map WeakSet WeakMap Promise Error Date RegExp Array Object Number String Boolean Symbol Function BigInt ArrayBuffer Iterator AsyncIterator".split()
RUST_BUILTINS = "Vec HashMap BTreeMap HashSet BTreeSet VecDeque Box Rc Arc Cell RefCell Mutex RwLock Option Result String Path PathBuf Cow".split()
SELF_LIKE = ("this", "self", "cls", "super")
TYPE_KINDS = ("class", "struct", "interface", "enum")
SKIPPED = ("import", "import_binding")

#: Rows up to which a table goes whole to every task, whatever Spark's own threshold; beyond, Spark chooses the join.
HELD = 200_000

TIERS = {"l0": (0, 0.95), "l0c": (1, 0.95), "l0d": (2, 0.95), "l0e": (3, 0.95), "l0b": (4, 0.95), "l1": (5, 1.0), "l2": (6, 0.95), "l3": (7, 0.9), "l4": (8, 0.8), "l4a": (9, 0.6), "l4b": (10, 0.6), "l5": (11, 0.5)}


def guarded() -> Column:
    """Not a name of the source language's runtime."""
    qualifier = F.coalesce("target_qualifier", F.lit(""))
    ts = (F.col("family") == "ts") & F.col("target_name").isin(*TS_BUILTINS)
    rust = (F.col("family") == "rust") & (F.col("target_name").isin(*RUST_BUILTINS) | qualifier.isin(*RUST_BUILTINS))
    return ~ts & ~rust


def self_like() -> Column:
    q = F.col("target_qualifier")
    return q.isin(*SELF_LIKE) | q.startswith("super(")


def same_file_first() -> Column:
    """Calls on oneself whose name the file has are left to the same-file tier."""
    return ~(F.coalesce(self_like(), F.lit(False)) & F.col("own").isNotNull())


def production(placed: DataFrame) -> Column:
    """Neither a test nor documentation."""
    return ~is_test_candidate(F.col("path")) & ~is_doc(F.col("path"))


# A symbol and its file; the smallest symbol comes first.
def _symbol() -> Column:
    return F.struct("id", "file_id")



def _held(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= HELD else table


def _bound(bindings: DataFrame, name: str) -> DataFrame:
    """The file that a name is bound to in a file: the smallest, where several bindings disagree."""
    return bindings.where("target_file_id is not null").groupBy("source_file_id", F.col("target_name").alias(name)).agg(F.min("target_file_id").alias("owner"))


def _neighbours(placed: DataFrame) -> DataFrame:
    """Per directory, family and name: the number of files, the first symbols of its two first files, and of its two first production files."""
    keys = ["source_dir", "family", "target_name"]
    per_file = placed.groupBy(F.col("dir").alias("source_dir"), "family", F.col("name").alias("target_name"), "file_id").agg(F.min("id").alias("id"), F.first("prod").alias("prod"))
    within = Window.partitionBy(*keys)
    ranked = per_file.select("*", F.row_number().over(within.orderBy("id", "file_id")).alias("k"), F.row_number().over(within.orderBy(F.desc("prod"), "id", "file_id")).alias("p"))
    at = lambda when, name: F.max(F.when(when, _symbol())).alias(name)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("dir_files"), at(F.col("k") == 1, "dir_1"), at(F.col("k") == 2, "dir_2"), at(F.col("prod") & (F.col("p") == 1), "near_1"), at(F.col("prod") & (F.col("p") == 2), "near_2"))


class Ladder:
    """The references with a column per tier: the symbol and file it proposes, or null.

    Each rung adds its column to the same frame, by joins with tables of one row
    per key; references are read once, and a rung that isn't asked for costs nothing.
    A rung ``alone`` drops the references it proposes nothing for as it joins;
    all together meet references and tables dealt by name.
    """

    def __init__(self, refs: DataFrame, files: DataFrame, symbols: DataFrame, bindings: DataFrame, mro: DataFrame | None = None, alone: bool = False):
        self.refs, self.files, self.symbols, self.bindings, self.mro, self.alone = refs, files, symbols, bindings, mro, alone
        source = files.select(F.col("id").alias("source_file_id"), F.col("dir").alias("source_dir"), F.col("lang_family").alias("family"), F.lit(True).alias("placed"))
        if alone:
            self.frame = self._opened(refs, source).where("open")
            return
        imported = cut(self._imported(), "imported")
        small = max(files.count(), imported.count()) <= HELD
        if small:
            source, imported = F.broadcast(source), F.broadcast(imported)
        self.apart = self._opened(refs, source)
        # Held tables leave references where they are, so that what they add needn't be shuffled.
        self.frame = self._opened(refs.repartition("target_name"), source) if small else self.apart
        self.frame = self.frame.join(imported, ["source_file_id", "target_qualifier"], "left")
        self.frame = self.frame if small else self.frame.repartition("target_name")

    def _opened(self, refs: DataFrame, source: DataFrame) -> DataFrame:
        return refs.join(source, "source_file_id", "left").withColumn("open", F.coalesce(~F.col("kind").isin(*SKIPPED), F.lit(True)) & F.col("placed").isNotNull())

    def _by(self, table: DataFrame, name: str) -> DataFrame:
        """Groups whose keys have the name stay where they are, and so do joins by them."""
        return table if self.alone else table.repartition(name)

    # Written once, when a rung first derives its table from them.
    @cached_property
    def placed(self) -> DataFrame:
        placed = self.symbols.join(self.files.select(F.col("id").alias("file_id"), "path", "dir", F.col("lang_family").alias("family")), "file_id")
        return self._by(cut(placed.withColumn("prod", production(placed)), "placed"), "name")

    @cached_property
    def owned(self) -> DataFrame:
        return self._by(cut(self.symbols.groupBy("file_id", "name").agg(F.min(_symbol()).alias("s")), "owned"), "name")

    def _owned(self, file: str) -> DataFrame:
        """The first symbol of each name in each file."""
        return self.owned.select(F.col("file_id").alias(file), F.col("name").alias("target_name"), "s")

    def _propose(self, tier: str, when: Column, what: Column, *scratch: str) -> None:
        self.frame = self.frame.withColumn(tier, F.when(F.col("open") & when, what)).drop(*scratch)

    def _left(self, right: DataFrame, *keys: str) -> None:
        self.frame = self.frame.join(right if self.alone else right.hint("shuffle_hash"), list(keys), "left")

    def _meet(self, right: DataFrame, *keys: str) -> None:
        """What a rung can't do without: by itself, it needs no other references."""
        if self.alone:
            self.frame = self.frame.join(right, list(keys))
        else:
            self._left(right, *keys)

    def _own(self, needed: bool = False) -> None:
        """The first symbol of the reference's own file that has the name."""
        if "own" not in self.frame.columns:
            (self._meet if needed else self._left)(self._owned("source_file_id").withColumnRenamed("s", "own"), "source_file_id", "target_name")

    def l0(self) -> None:
        """The receiver's type is the scope of the name in one file."""
        owners = self.placed.where("scope is not null").groupBy(F.col("name").alias("target_name"), F.col("scope").alias("receiver_type"), "family").agg(F.min("file_id").alias("a"), F.max("file_id").alias("b"), F.min(_symbol()).alias("s"))
        self._meet(owners, "target_name", "receiver_type", "family")
        self._own()
        self._propose("l0", (F.col("a") == F.col("b")) & same_file_first(), F.col("s"), "a", "b", "s")

    def _typed(self) -> None:
        """What the files of the receiver's type have of the name, for the two tiers that look at them."""
        if "bound" in self.frame.columns:
            return
        asks = self.apart.where("open and receiver_type is not null").select("source_file_id", "receiver_type", "family", "target_name")
        asks = asks.repartition("source_file_id", "receiver_type").distinct()
        bound = _bound(self.bindings.repartition("source_file_id", "target_name"), "receiver_type")
        types = _held(cut(self._types(), "types")).withColumnsRenamed({"typed": "receiver_type", "owner": "definer"})
        asks = asks.join(bound.hint("shuffle_hash"), ["source_file_id", "receiver_type"], "left").join(types, ["receiver_type", "family"], "left")
        asks = asks.where("owner is not null or definer is not null").drop("family").repartition("target_name")
        for file, found in (("owner", "bound"), ("definer", "defined")):
            asks = asks.join(self._owned(file).withColumnRenamed("s", found).hint("shuffle_hash"), [file, "target_name"], "left").drop(file)
        self._left(asks.where("bound is not null or defined is not null"), "source_file_id", "receiver_type", "target_name")

    def l0c(self) -> None:
        """The receiver's type is imported, and its file has the name."""
        if not self.alone:
            self._typed()
            self._own()
            return self._propose("l0c", same_file_first(), F.col("bound"))
        self._meet(_bound(self.bindings, "receiver_type"), "source_file_id", "receiver_type")
        self._meet(self._owned("owner"), "owner", "target_name")
        self._own()
        self._propose("l0c", same_file_first(), F.col("s"), "owner", "s")

    def _types(self) -> DataFrame:
        """Types defined in one file of the family."""
        return self.placed.where(F.col("kind").isin(*TYPE_KINDS)).groupBy(F.col("name").alias("typed"), "family").agg(F.min("file_id").alias("owner"), F.max("file_id").alias("last")).where("owner = last").drop("last")

    def l0d(self) -> None:
        """The receiver's type is defined in one file, which has the name."""
        if not self.alone:
            self._typed()
            self._own()
            return self._propose("l0d", same_file_first(), F.col("defined"))
        self.frame = self.frame.withColumn("typed", F.col("receiver_type"))
        self._meet(self._types(), "typed", "family")
        self._meet(self._owned("owner"), "owner", "target_name")
        self._own()
        self._propose("l0d", same_file_first(), F.col("s"), "typed", "owner", "s")

    def l0e(self) -> None:
        """What the inheritance walk found; equal calls find the same."""
        if self.mro is not None:
            keys = ["id" if self.alone else "source_file_id", "receiver_type", "target_name"]
            found = self._by(self.mro, "target_name").withColumnRenamed("ref_id", "id").groupBy(*keys)
            self._meet(found.agg(F.min(F.struct(F.col("symbol_id").alias("id"), "file_id")).alias("s")), *keys)
            self._propose("l0e", F.col("kind") == "call", F.col("s"), "s")
        else:
            self._own()
            self._propose("l0e", F.lit(False), F.col("own"))

    def l0b(self) -> None:
        """A bare name that an import binds; the symbol may be unknown."""
        bound = _bound(self._by(self.bindings, "target_name"), "target_name")
        self._meet(bound, "source_file_id", "target_name")
        self._left(self._owned("owner"), "owner", "target_name")
        self._propose("l0b", F.col("target_qualifier").isNull() & F.col("owner").isNotNull(), F.struct(F.col("s.id").alias("id"), F.col("owner").alias("file_id")), "owner", "s")

    def l1(self) -> None:
        """A name of the same file, bare or on oneself."""
        self._own(needed=True)
        bare = F.col("receiver_type").isNull() & F.col("target_qualifier").isNull()
        self._propose("l1", bare | F.coalesce(self_like(), F.lit(False)), F.col("own"))

    def l2(self) -> None:
        """One other file of the directory has the name."""
        self._by_directory()
        self._own()
        bare = F.col("target_qualifier").isNull()
        fits = F.col("receiver_type").isNull() & guarded() & (bare | (F.col("family") != "rust")) & (bare | F.col("own").isNull())
        # The source's own file may be one of two; with three, more than one other is left.
        one = (F.col("dir_files") == 1) & (F.col("dir_1.file_id") != F.col("source_file_id")) | (F.col("dir_files") == 2) & F.col("source_file_id").isin(F.col("dir_1.file_id"), F.col("dir_2.file_id"))
        self._propose("l2", fits & one, F.when(F.col("dir_1.file_id") != F.col("source_file_id"), F.col("dir_1")).otherwise(F.col("dir_2")))

    def _imported(self) -> DataFrame:
        """What a file may call the paths that it imports."""
        last = F.explode(F.array_distinct(F.array("target_name", F.regexp_extract("target_name", r"([^/]*)$", 1), F.regexp_extract("target_name", r"([^.]*)$", 1))))
        return self.refs.where("kind = 'import'").select("source_file_id", last.alias("target_qualifier")).distinct().withColumn("imported", F.lit(True))

    def l3(self) -> None:
        """The qualifier is an imported path's last part, and a directory or file of that name has the symbol once."""
        stem, leaf = F.regexp_extract("path", r"([^/.]*)\.[^/]*$", 1), F.regexp_extract("dir", r"([^/]+)/$", 1)
        named = self.placed.withColumn("q", F.explode(F.array_distinct(F.array(stem, leaf)))).where("q <> ''")
        groups = named.groupBy(F.col("name").alias("target_name"), "family", F.col("q").alias("target_qualifier")).agg(F.min("file_id").alias("a"), F.max("file_id").alias("b"), F.min(_symbol()).alias("s"))
        if self.alone:
            self._meet(self._imported(), "source_file_id", "target_qualifier")
        self._meet(groups, "target_name", "family", "target_qualifier")
        self._propose("l3", F.col("imported").isNotNull() & (F.col("a") == F.col("b")), F.col("s"), "imported", "a", "b", "s")

    def _by_directory(self) -> None:
        """Candidates of the directory, for the two tiers that look at them."""
        if "dir_files" not in self.frame.columns:
            self._meet(_neighbours(self.placed), "source_dir", "family", "target_name")

    def _by_name(self) -> None:
        """Production candidates of the family, for the two tiers that look at them."""
        if "only" not in self.frame.columns:
            member = F.bool_or(F.col("scope").isNotNull() | (F.col("kind") == "method")).alias("member")
            groups = self.placed.where("prod").groupBy(F.col("name").alias("target_name"), "family").agg(F.min("file_id").alias("a"), F.max("file_id").alias("b"), F.min(_symbol()).alias("first"), member)
            self._meet(groups.select("target_name", "family", "first", "member", (F.col("a") == F.col("b")).alias("only")), "target_name", "family")

    def l4(self) -> None:
        """One production file of the family has the name; on a receiver it must be a member."""
        self._by_name()
        self._propose("l4", F.col("receiver_type").isNull() & guarded() & F.col("only") & (F.col("target_qualifier").isNull() | F.col("member")), F.col("first"))

    def l4a(self) -> None:
        """Any reference to a name of the same file."""
        self._own(needed=True)
        self._propose("l4a", F.lit(True), F.col("own"))

    def l4b(self) -> None:
        """Any production candidate elsewhere in the directory."""
        self._by_directory()
        self._propose("l4b", guarded(), F.when(F.col("near_1.file_id") != F.col("source_file_id"), F.col("near_1")).otherwise(F.col("near_2")))

    def l5(self) -> None:
        """Any production candidate of the family."""
        self._by_name()
        self._propose("l5", guarded(), F.col("first"))

    def climb(self, *names: str) -> DataFrame:
        for name in names or TIERS:
            getattr(self, name)()
        return self.frame


def tiers(refs: DataFrame, files: DataFrame, symbols: DataFrame, bindings: DataFrame, mro: DataFrame | None = None, names: Iterable[str] = TIERS) -> dict[str, DataFrame]:
    """The proposals of every tier, or of those named, by itself; ``mro`` has those of the inheritance walk."""

    def alone(name: str) -> DataFrame:
        order, confidence = TIERS[name]
        rows = Ladder(refs, files, symbols, bindings, mro, alone=True).climb(name).where(F.col(name).isNotNull())
        return rows.select(F.col("id").alias("ref_id"), F.lit(order).alias("tier"), F.col(f"{name}.id").cast("long").alias("symbol_id"), F.col(f"{name}.file_id").cast("long").alias("file_id"), F.lit(confidence).alias("confidence"))

    return {name: alone(name) for name in names if name != "l0e" or mro is not None}


def settled(refs: DataFrame, files: DataFrame, symbols: DataFrame, bindings: DataFrame, mro: DataFrame | None = None) -> DataFrame:
    """``cascade`` before it is run; one shuffle of the references serves all its joins if it is run ``in_place``."""
    made = Ladder(refs, files, symbols, bindings, mro).climb()
    choice = lambda c, n: F.struct(F.lit(TIERS[n][0]).alias("tier"), c["id"].cast("long").alias("id"), c["file_id"].cast("long").alias("file_id"), F.lit(TIERS[n][1]).alias("confidence"))
    best = F.coalesce(*(F.when(F.col(n).isNotNull(), choice(F.col(n), n)) for n in TIERS))
    kept = [c for c in refs.columns if c not in ("target_file_id", "target_symbol_id", "confidence", "tier")]
    return made.select(*kept, best.alias("best")).select(*kept, F.col("best.tier").alias("tier"), F.col("best.id").alias("target_symbol_id"), F.col("best.file_id").alias("target_file_id"), F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"))


def cascade(refs: DataFrame, files: DataFrame, symbols: DataFrame, bindings: DataFrame, mro: DataFrame | None = None) -> DataFrame:
    """References with tier, target_symbol_id, target_file_id and confidence (0 if nothing fits), as a stored table."""
    with in_place(refs.sparkSession):
        return cut(settled(refs, files, symbols, bindings, mro), "cascade")


# ---- modules to files --------------------------------------------------------------------------------------------


def suffixes(files: DataFrame) -> DataFrame:
    """suffix, file_id where exactly one path ends with ``/suffix`` (or is it)."""
    parts = F.split("path", "/")
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/")))
    return files.select(F.col("id").alias("file_id"), tails.alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("file_id").alias("file_id")).where("n = 1").select("suffix", "file_id")


def probe(wanted: DataFrame, files: DataFrame, candidates: Column) -> DataFrame:
    """For each row of ``wanted`` (id, ...) the first of an array of candidate paths that exists: id, target_file_id."""
    each = wanted.select("id", F.posexplode(candidates).alias("nth", "path"))
    found = each.join(files.select("path", F.col("id").alias("target_file_id")), "path")
    return found.groupBy("id").agg(F.min_by("target_file_id", "nth").alias("target_file_id"))


def ts_candidates(base: Column) -> Column:
    """Files that a relative module may mean, in order."""
    stem = F.regexp_replace(base, r"\.(m|c)?jsx?$", "")
    tails = [".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
    swapped = F.when(stem != base, F.array(F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(base), swapped, F.array(*(F.concat(base, F.lit(t)) for t in tails)))


def python_candidates(module: Column) -> Column:
    base = F.translate(module, ".", "/")
    return F.array(*(F.concat(base, F.lit(t)) for t in (".py", ".pyi", "/__init__.py", "/__init__.pyi")))


def rust_candidates(path: Column) -> Column:
    """A module's file, or the module that has the last part as an item."""
    parts = F.split(path, "::")
    join = lambda drop: F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - drop, F.lit(0))), "/")
    return F.array(*(F.concat(join(drop), F.lit(t)) for drop in (0, 1) for t in (".rs", "/mod.rs")))


def java_candidates(name: Column) -> Column:
    return F.array(F.concat(F.translate(name, ".", "/"), F.lit(".java")))


def module_candidates(family: Column, module: Column, directory: Column) -> Column:
    """Paths that an imported module may mean in its language, in order; empty where a language imports no names."""
    here = F.regexp_replace(directory, "/$", "")
    up = lambda n: F.array_join(F.slice(F.split(here, "/"), F.lit(1), F.greatest(F.size(F.split(here, "/")) - n, F.lit(0))), "/")
    joined = lambda a, b: F.regexp_replace(F.concat_ws("/", F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))), "/+", "/")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    tail = F.translate(F.regexp_replace(module, r"^\.+", ""), ".", "/")
    python = python_candidates(F.when(dots > 0, joined(up(dots - 1), tail)).otherwise(tail))
    ts = ts_candidates(normalize(F.when(module.startswith("."), F.concat(directory, module)).otherwise(F.regexp_replace(module, "^[@~]/", ""))))
    above = F.size(F.split(module, "super::", -1)) - 1
    inner = F.regexp_replace(module, r"^(crate|self|(super::)*super)(::|$)", "")
    root = F.regexp_extract(directory, r"^(.*?src/)", 1)
    path = F.translate(F.regexp_replace(inner, "::", "/"), ":", "/")
    local = F.when(module.startswith("crate"), F.concat(root, path)).when(module.startswith("super"), joined(up(above - 1), path)).when(module.startswith("self"), joined(here, path)).otherwise(path)
    rust = rust_candidates(F.regexp_replace(local, "/", "::"))
    return F.when(family == "python", python).when(family == "ts", ts).when(family == "rust", rust).when(family == "java", java_candidates(module)).otherwise(F.array().cast("array<string>"))


def resolve_modules(wanted: DataFrame, files: DataFrame, candidates: Column, by_suffix: bool = True) -> DataFrame:
    """id, target_file_id: exact candidates first, then a suffix that only one path has."""
    exact = probe(wanted, files, candidates)
    if not by_suffix:
        return exact
    left = wanted.join(exact, "id", "left_anti").select("id", F.posexplode(candidates).alias("nth", "suffix"))
    tail = left.join(suffixes(files), "suffix").groupBy("id").agg(F.min_by("file_id", "nth").alias("target_file_id"))
    return exact.unionByName(tail)


def chase_barrels(bindings: DataFrame, symbols: DataFrame, hops: int = 5) -> DataFrame:
    """Bindings whose file lacks the name follow that file's own binding of it, a few hops.

    Where a (file, name) leads is a function of its few files without the name; it is
    raised to the power ``hops`` by joining it with itself, and met once by all bindings.
    """
    owned = symbols.select(F.col("file_id").alias("at"), F.col("name").alias("target_name")).distinct()
    onward = bindings.where("target_file_id is not null").groupBy(F.col("source_file_id").alias("at"), "target_name").agg(F.min("target_file_id").alias("to"))
    step = cut(onward.where("to <> at").join(owned, ["at", "target_name"], "left_anti"))

    def then(one: DataFrame, two: DataFrame) -> DataFrame:
        two = two.select(F.col("at").alias("to"), "target_name", F.col("to").alias("further"))
        return one.join(two, ["to", "target_name"], "left").select("at", "target_name", F.coalesce("further", "to").alias("to"))

    power, left = None, hops
    while left:
        if left & 1:
            power = step if power is None else then(power, step)
        left >>= 1
        step = then(step, step) if left else step
    if power is None:
        return bindings
    moved = bindings.join(power.withColumnRenamed("at", "target_file_id"), ["target_file_id", "target_name"], "left")
    return moved.select(*(F.coalesce("to", "target_file_id").alias(c) if c == "target_file_id" else F.col(c) for c in bindings.columns))


def mro(refs: DataFrame, files: DataFrame, symbols: DataFrame, inherits: DataFrame, depth: int = 6) -> DataFrame:
    """Proposals of the Python inheritance walk for calls with a known receiver type.

    Depth first over base classes, left base first; a file that defines a base is
    asked for the name, nearest to the call first, and the bases of the farthest one
    come next. The nearest file of the receiver's own class starts.

    One walk serves all calls of a file on one type. A level is one join: each
    class that a walk meets there has the place of its first meeting in the
    walk's order as a key (distances and positions, one after the other), so
    a walk has at most a row for each class name and level, and the smallest key
    of what has a call's name is what a walk would have found first. A name
    that a walk has met on the way to itself is not followed again. Where a
    class is met deep at first and less deep later, its bases are looked at
    within the depth of either.

    ``inherits`` has source_file_id, source_symbol (the class), target_name (the
    base), id, and may have target_qualifier: qualified bases don't count.
    """
    order, confidence = TIERS["l0e"]
    longs = lambda *c: F.array(*(x.cast("long") for x in c))
    python = files.where("lang_family = 'python'").select(F.col("id").alias("file_id"), F.split("path", "/").alias("parts"), F.length("path").alias("chars"))
    classes = symbols.where("kind = 'class'").groupBy(F.col("name").alias("base"), "file_id").agg(F.min("id").alias("class_id"))
    classes = cut(classes.join(python, "file_id"), "classes")
    if "target_qualifier" in inherits.columns:
        inherits = inherits.where("target_qualifier is null")
    above = inherits.where("source_symbol is not null").groupBy(F.col("source_file_id").alias("file_id"), F.col("source_symbol").alias("base"), F.col("target_name").alias("next")).agg(F.min("id").alias("nth"))
    above = cut(above, "bases")
    calls = refs.where("kind = 'call' and receiver_type is not null").select(F.col("id").alias("ref_id"), "source_file_id", "receiver_type", "target_name")
    calls = cut(calls.join(python.select(F.col("file_id").alias("source_file_id"), F.col("parts").alias("source")), "source_file_id"), "calls")

    # Same leading parts of two paths: they differ from the first other one on.
    short = F.least(F.size("source"), F.size("parts"))
    other = F.filter(F.sequence(F.lit(1), short), lambda i: F.get("source", i - 1) != F.get("parts", i - 1))
    same = F.coalesce(F.get(other, F.lit(0)) - 1, short)
    near = longs(F.size("source") + F.size("parts") - 2 * same, F.col("chars"), F.col("class_id"))

    def defined(met: DataFrame) -> DataFrame:
        """The files that define the classes met, and how near they are to the call."""
        return cut(met.join(classes, "base").select("source_file_id", "receiver_type", "source", "base", "key", "names", "file_id", near.alias("near")), "mro")

    walks = calls.groupBy("source_file_id", "receiver_type").agg(F.any_value("source").alias("source"))
    at = defined(walks.select("*", F.col("receiver_type").alias("base"), longs().cast("array<long>").alias("key"), F.array().cast("array<string>").alias("names")))
    asked = []
    for level in range(1, depth + 1):
        # Files of the receiver's class are begun nearest first; those of a base are asked in that order, but the last one's bases come first.
        place = F.col("near") if level == 1 else F.transform("near", lambda x: -x)
        names = F.col("names") if level == 1 else F.array_append("names", F.col("base"))
        step = at.join(above, ["file_id", "base"]).select("source_file_id", "receiver_type", "source", "next", F.concat("key", place, longs(F.col("nth"))).alias("key"), names.alias("names"))
        step = step.where(~F.array_contains("names", F.col("next")))
        at = defined(step.groupBy("source_file_id", "receiver_type", F.col("next").alias("base")).agg(F.any_value("source").alias("source"), F.min("key").alias("key"), F.min_by("names", "key").alias("names")))
        if at.isEmpty():
            break
        asked.append(at)
    schema = "ref_id long, source_file_id long, receiver_type string, target_name string, tier int, symbol_id long, file_id long, confidence double"
    if not asked:
        return refs.sparkSession.createDataFrame([], schema)
    # A class itself is asked before its bases are: a number below all others follows its key. Calls meet the place in that order, not the keys.
    asked = reduce(DataFrame.unionByName, asked).select("source_file_id", "receiver_type", "file_id", F.concat("key", longs(F.lit(-(2**62))), "near").alias("key"))
    asked = asked.select("source_file_id", "receiver_type", "file_id", F.rank().over(Window.partitionBy("source_file_id", "receiver_type").orderBy("key")).alias("place"))
    owned = symbols.groupBy("file_id", F.col("name").alias("target_name")).agg(F.min("id").alias("symbol_id"))
    hits = asked.join(calls.drop("source"), ["source_file_id", "receiver_type"]).join(owned, ["file_id", "target_name"])
    call = ["ref_id", "source_file_id", "receiver_type", "target_name"]
    first = hits.groupBy(*call).agg(F.min(F.struct("place", "symbol_id", "file_id")).alias("hit"))
    return first.select(*call, F.lit(order).alias("tier"), "hit.symbol_id", "hit.file_id", F.lit(confidence).alias("confidence"))
