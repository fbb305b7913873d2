"""Architecture facts: layer hints and fusion, roles, modules and their labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.functions.paths import module_segment
from lodeline.tables import cut

PATH_WEIGHT, NAME_WEIGHT, OVERRIDE_WEIGHT = 0.4, 0.2, 0.5
_TAIL = r"(/|$|[._-])"

# The words that place a path in a layer. An "s" may follow where `plural` is set; `dir` words must be whole segments.
_WORDS = [
    ("domain", "auth authz authn login session jwt oauth credential", "plural"),
    ("api", "handler controller router api rest graphql rpc grpc endpoint route", "plural"),
    ("infra", "repo repository dao store storage persist persistence model entity schema migration", "plural"),
    ("util", "util utils helper helpers common shared lib pkg internal", ""),
    ("vendor", "vendor node_modules third_party external deps", "dir"),
    ("api", "middleware", "plural"),
    ("api", "route routing", "plural"),
    ("domain", "service", "plural"),
    ("api", "gateway proxy", "plural"),
    ("infra", "adapter adaptor", "plural"),
    ("infra", "queue mq kafka rabbitmq pubsub", "plural"),
    ("domain", "event eventbus event_bus", "plural"),
    ("infra", "cache redis memcache memcached", ""),
    ("infra", "scheduler cron job worker", "plural"),
    ("util", "validator validation", "plural"),
    ("util", "error", "plural"),
    ("util", "log logger logging", ""),
    ("infra", "db database", "plural"),
    ("test", "seed fixture", "plural"),
    ("api", "context request response session", "plural"),
    ("domain", "app server", "plural"),
    ("ui", "editor buffer view term tui pane window mode keymap syntax", "plural"),
    ("build", "bundler resolver plugin transformer compiler transpiler loader", "plural"),
    ("build", "resolve transform transpile", ""),
]
# The layers whose rules are more than words.
_PATTERNS = [
    ("entry", r"(^|/)(cmd|bin)(/|$)|(^|/)main\.(go|rs|py)$|(^|/)app\.py$|(^|/)index\.(ts|js|tsx|jsx)$|(^|/)__main__\.py$"),
    ("test", r"(^|/)(test|tests|spec|__tests__|fixture|fixtures|mock|mocks)(/|$)|_test\.|\.test\.|\.spec\."),
    ("config", r"(^|/)(config|conf|settings|env)(s)?(/|$|[._-])|(^|/)\.env(\.|$)"),
    ("generated", r"(^|/)(generated|gen)(/|$)|_pb2(\.|$)|\.pb\.|grpc_gen|protoc"),
    ("util", r"(^|/)(metric(s)?|telemetry|observ[a-z]*)(/|$|[._-])"),
]
_SOURCE = "(go|ts|tsx|js|jsx|java|py|rs|kt|cs|cc|cpp)"
# What file names say.
NAME_RULES = [
    ("api", rf"(Handler|Controller)\.{_SOURCE}$"),
    ("domain", rf"(Service|Manager|Factory|Builder)\.{_SOURCE}$"),
    ("infra", rf"(Repository|Repo|Store|Dao)\.{_SOURCE}$"),
    ("test", r"(_test\.go|_test\.py|\.test\.(ts|tsx|js|jsx)|Test\.java|\.Spec\.[a-z]+|Spec\.(ts|tsx|js|jsx|java|kt|cs|rs|py|go))$"),
    ("test", r"(^|[._-])(Mock|Fake|Stub|Fixture)([._-]|[A-Z]|\.[a-z]+$)"),
    ("generated", r"(\.pb\.go|\.pb\.ts|_pb2\.py)$"),
]


def _word_rule(words: str, form: str) -> str:
    inner = "|".join(words.split())
    return rf"(^|/)({inner})(/|$)" if form == "dir" else rf"(^|/)({inner}){'(s)?' if form == 'plural' else ''}{_TAIL}"


PATH_RULES = [(layer, _word_rule(words, form)) for layer, words, form in _WORDS] + _PATTERNS


def hints(path: Column, overrides: list[tuple[str, str, float]] = ()) -> Column:
    """Every rule that matches, as an array of (layer, weight); ``overrides`` are (segment, layer, weight)."""
    name = F.substring_index(path, "/", -1)
    one = lambda when, layer, weight: F.when(when, F.struct(F.lit(layer).alias("layer"), F.lit(weight).alias("weight")))
    found = [one(path.rlike(f"(?i){p}"), layer, PATH_WEIGHT) for layer, p in PATH_RULES]
    found += [one(name.rlike(f"(?i){p}"), layer, NAME_WEIGHT) for layer, p in NAME_RULES]
    found += [one(F.array_contains(F.split(path, "/"), segment), layer, weight) for segment, layer, weight in overrides]
    return F.array_compact(F.array(*found))


def fuse_layers(files: DataFrame, overrides: list[tuple[str, str, float]] = ()) -> DataFrame:
    """id, layer, layer_conf: the heaviest layer (ties: by name) and its share; entry files are sure.

    ``files`` has id, path and is_entry. Rules cost much more than rows are long: a table in one
    split is dealt to all cores first.
    """
    files = files.select("id", "path", "is_entry").repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "id")
    layers = sorted({layer for layer, _ in PATH_RULES + NAME_RULES} | {o[1] for o in overrides})
    weighed = files.select("id", "is_entry", hints(F.col("path"), overrides).alias("h"))
    weight = lambda layer: F.round(F.aggregate(F.filter("h", lambda x: x["layer"] == layer), F.lit(0.0), lambda a, x: a + x["weight"]), 6)
    # Largest weight first; among equals the name that comes first, by its negated place.
    best = F.array_max(F.array(*(F.struct(weight(layer).alias("w"), F.lit(-i).alias("k"), F.lit(layer).alias("layer")) for i, layer in enumerate(layers))))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x["weight"])
    chosen = weighed.select("id", "is_entry", best.alias("b"), total.alias("t"))
    layer = F.when(F.col("is_entry"), F.lit("entry")).when(F.col("t") > 0, F.col("b.layer")).otherwise(F.lit("unknown"))
    sure = F.when(F.col("is_entry"), F.lit(1.0)).when(F.col("t") > 0, F.round(F.col("b.w") / F.col("t"), 6)).otherwise(F.lit(0.0))
    return chosen.select("id", layer.alias("layer"), sure.alias("layer_conf"))


def p80(df: DataFrame, column: str) -> DataFrame:
    """The value at place floor(0.8 n) of the sorted column, as a one-row frame (no row for an empty column).

    Counts per value are dealt by ranges; the driver sees how many rows each range has, and
    only the range with the wanted place is sorted.
    """
    counts = df.groupBy(F.col(column).alias("threshold")).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counts.repartitionByRange("threshold").withColumn("range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["range"], r["n"]) for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect())
    place, before, chosen = min(total := sum(n for _, n in sizes), int(0.8 * total) + 1), 0, -1
    for number, n in sizes:
        if before + n >= place:
            chosen = number
            break
        before += n
    below = F.sum("n").over(Window.partitionBy("range").orderBy("threshold")) + before
    return ranged.where(F.col("range") == chosen).withColumn("below", below).where(F.col("below") >= place).groupBy("range").agg(F.min("threshold").alias("threshold")).select("threshold")


def role(in_degree: Column, out_degree: Column, centrality: Column, threshold: Column, scc_size: Column, is_entry: Column) -> Column:
    """Rules in order; the first that holds decides."""
    return (
        F.when(is_entry, F.lit("entry_point"))
        .when(scc_size >= 3, F.lit("bridge"))
        .when((in_degree == 0) & (out_degree > 0), F.lit("entry_point"))
        .when((out_degree == 0) & (in_degree > 0), F.lit("leaf"))
        .when((in_degree == 0) & (out_degree == 0), F.lit("orphan"))
        .when((centrality >= threshold) & (in_degree >= 3) & (out_degree >= 3), F.lit("core"))
        .otherwise(F.lit("leaf"))
    )


def facts(files: DataFrame, layers: DataFrame, degrees: DataFrame, ranks: DataFrame, sccs: DataFrame) -> DataFrame:
    """One row per file: layer, role, centrality, degrees. Files outside the graph have zeros."""
    threshold = p80(ranks, "centrality")
    joined = reduce(lambda a, b: a.join(b, "id", "left"), (layers, degrees, ranks, sccs), files.select("id", "path", "is_entry")).join(F.broadcast(threshold), how="left")
    zero = lambda c, v=0: F.coalesce(F.col(c), F.lit(v))
    chosen = role(zero("in_degree"), zero("out_degree"), zero("centrality", 0.0), zero("threshold", 0.0), zero("scc_size", 1), F.col("is_entry"))
    return joined.select("id", "path", "layer", "layer_conf", chosen.alias("role"), zero("centrality", 0.0).alias("centrality"), zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"))


def modules(members: DataFrame) -> DataFrame:
    """module_id, file_count, dominant_layer (most files, ties by name), centroid_path (highest centrality, ties by path)."""
    layers = members.groupBy("module_id", "layer").agg(F.count(F.lit(1)).alias("n"))
    dominant = layers.groupBy("module_id").agg(F.sum("n").alias("file_count"), F.min_by("layer", F.struct(-F.col("n"), "layer")).alias("dominant_layer"))
    centre = members.groupBy("module_id").agg(F.min_by("path", F.struct(-F.col("centrality"), "path")).alias("centroid_path"))
    return dominant.join(centre, "module_id")


def labels(members: DataFrame, small: int = 8) -> DataFrame:
    """module_id, label: telling segment of the members' common directory; else by the members' own segments.

    A small module takes the segment of its single most central member, a large one
    the segment with more than half of the centrality, or of the members; what is
    left is numbered. The larger of two modules with one label keeps it.
    """
    rows = members.withColumn("segment", module_segment(F.col("path")))
    spans = rows.groupBy("module_id").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count(F.lit(1)).alias("file_count"), F.count("segment").alias("known"), F.sum(F.when(F.col("segment").isNotNull(), F.col("centrality"))).alias("mass"), F.max(F.when(F.col("segment").isNotNull(), F.col("centrality"))).alias("peak"))
    from lodeline.functions.paths import common_prefix

    shared = module_segment(common_prefix(F.col("low"), F.col("high")))
    by_segment = rows.where("segment is not null").groupBy("module_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.sum("centrality").alias("m"))
    heaviest = by_segment.groupBy("module_id").agg(F.min_by(F.struct("segment", "m"), F.struct(-F.col("m"), "segment")).alias("by_mass"), F.min_by(F.struct("segment", "n"), F.struct(-F.col("n"), "segment")).alias("by_count"))
    peaks = rows.join(spans.select("module_id", "peak"), "module_id").where(F.col("segment").isNotNull() & (F.col("centrality") == F.col("peak"))).groupBy("module_id").agg(F.count(F.lit(1)).alias("at_peak"), F.min("segment").alias("peak_segment"))
    all_known = spans.join(heaviest, "module_id", "left").join(peaks, "module_id", "left")
    label = F.coalesce(
        shared,
        F.when((F.col("known") < small) & (F.col("at_peak") == 1) & (F.col("peak") > 0), F.col("peak_segment")),
        F.when((F.col("mass") > 0) & (F.col("by_mass.m") * 2 > F.col("mass")), F.col("by_mass.segment")),
        F.when(F.col("by_count.n") * 2 > F.col("known"), F.col("by_count.segment")),
        F.concat(F.when(F.col("known") > 0, F.lit("cluster-")).otherwise(F.lit("unlabelled-")), F.col("module_id").cast("string")),
    )
    named = all_known.select("module_id", "file_count", label.alias("label"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("file_count"), "module_id"))
    return named.select("module_id", "file_count", F.when(nth == 1, F.col("label")).otherwise(F.concat_ws("-", "label", F.col("module_id").cast("string"))).alias("label"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
