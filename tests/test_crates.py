"""Two crates of a workspace, a third outside it, and what paths in them mean."""

import pytest

from lodeline.operators import crates

MANIFESTS = {
    "Cargo.toml": "[workspace]\nresolver = \"2\"\nmembers = [\"crates/*\", \"tools/gen\"]\nexclude = ['crates/old']\n\n[workspace.package]\nname = \"no\"\n",
    "crates/cli/Cargo.toml": "[package]\nname = \"the-cli\"\nversion = \"1\"\n\n[dependencies]\nname = \"wrong\"\n",
    "crates/util/Cargo.toml": "# x\n[package]\nedition = '2021'\nname = 'util'\n",
    "tools/gen/Cargo.toml": "[package]\nname = \"gen\"\n",
    "vendor/util/Cargo.toml": "[package]\nname = \"util\"\n",
    "vendor/far/Cargo.toml": "[package]\nname = \"far\"\n",
}
FILES = ["crates/cli/src/main.rs", "crates/cli/src/args.rs", "crates/cli/src/cmd/mod.rs", "crates/cli/src/cmd/run.rs", "crates/util/src/lib.rs", "crates/util/src/text/mod.rs", "crates/util/src/text/trim.rs", "tools/gen/main.rs", "tools/gen/out.rs", "vendor/util/src/text.rs", "vendor/far/src/deep.rs", "vendor/far/src/lib.rs", "src/old.rs"]
CASES = [
    ("crates/cli/src/cmd/", "crate::args", "crates/cli/src/args.rs"),
    ("crates/cli/src/cmd/", "crate", "crates/cli/src/main.rs"),
    ("crates/cli/src/cmd/", "super::run", "crates/cli/src/cmd/run.rs"),
    ("crates/cli/src/cmd/", "super::super::args", "crates/cli/src/args.rs"),
    ("crates/cli/src/cmd/", "self::run", "crates/cli/src/cmd/run.rs"),
    ("crates/cli/src/", "cmd::run", "crates/cli/src/cmd/run.rs"),
    ("crates/cli/src/", "util::text", "crates/util/src/text/mod.rs"),
    ("crates/cli/src/", "util::text::trim", "crates/util/src/text/trim.rs"),
    ("crates/cli/src/", "util", "crates/util/src/lib.rs"),
    ("crates/util/src/text/", "the_cli::args", "crates/cli/src/args.rs"),
    ("vendor/util/src/", "util::text", None),
    ("vendor/util/src/", "crate::text", "vendor/util/src/text.rs"),
    ("crates/cli/src/", "far::deep", "vendor/far/src/deep.rs"),
    ("tools/gen/", "crate::out", "tools/gen/out.rs"),
    ("tools/gen/", "util::text", "crates/util/src/text/mod.rs"),
    ("crates/cli/src/", "old", "src/old.rs"),
    ("crates/cli/src/", "serde::de", None),
    ("", "crate::old", "src/old.rs"),
    ("crates/cli/src/", "super::super::super::super::super::nothing", None),
]


@pytest.fixture(scope="module")
def manifests(spark):
    return spark.createDataFrame(list(MANIFESTS.items()), "path string, content string")


def test_crates_and_workspaces(manifests):
    got = {r.folder: (r.name, r.workspace) for r in crates.crates(manifests).collect()}
    assert got == {"": (None, ""), "crates/cli": ("the_cli", ""), "crates/util": ("util", ""), "tools/gen": ("gen", ""), "vendor/util": ("util", "vendor/util"), "vendor/far": ("far", "vendor/far")}


def test_paths_across_crates(spark, manifests):
    files = spark.createDataFrame(list(enumerate(FILES)), "id long, path string")
    wanted = spark.createDataFrame([(i, d, m) for i, (d, m, _) in enumerate(CASES)], "id long, dir string, module string")
    got = {r.id: FILES[r.target_file_id] for r in crates.modules(wanted, files, manifests).collect()}
    want = {i: path for i, (_, _, path) in enumerate(CASES)}
    want[10] = "vendor/util/src/text.rs"  # its own crate, by name
    assert {i: got.get(i) for i in want} == want


def test_no_manifests(spark, manifests):
    files = spark.createDataFrame([(1, "src/a.rs")], "id long, path string")
    wanted = spark.createDataFrame([(1, "src/", "crate::a"), (2, "src/", "b::c")], "id long, dir string, module string")
    assert [(r.id, r.target_file_id) for r in crates.modules(wanted, files, manifests.limit(0)).collect()] == [(1, 1)]
