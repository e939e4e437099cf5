"""Scans of source trees: ignore files as git reads them, folders that are never entered, parts of even size, filters; and what hints add."""

import json
import os
import shutil
import subprocess

import pytest
from loomgraph.jobs import index
from loomgraph.sources import scan, tree


def make(root, files):
    for path, text in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def paths(spark, root, **options):
    return sorted(r["path"] for r in scan.scan_files(spark, str(root), **options).select("path").collect())


RULES = {
    ".gitignore": "# made\n*.rs\n!keep.rs\n/top.py\nlogs/\n**/gen/*.py\na/**/z.py\n\\#odd.py\nspace.py  \nx[0-9].py\ny[!a].py\ndoc/*.py\n!doc/b.py\nhidden_again/\n",
    "sub/.gitignore": "!top.py\n*.go\n!main.go\n/only.py\n", "sub/deep/.ignore": "!lib.go\nkeep.rs\n", "hidden_again/.gitignore": "!back.py\n",
}
FILES = [
    "top.py", "sub/top.py", "a.rs", "keep.rs", "sub/keep.rs", "sub/deep/keep.rs", "logs/a.py", "sub/logs/a.py", "logs.py", "gen/a.py", "sub/gen/b.py", "gen/c/d.py", "a/z.py", "a/b/c/z.py", "b/z.py", "#odd.py", "space.py", "x1.py", "xa.py", "ya.py", "yb.py",
    "doc/a.py", "doc/b.py", "doc/c/a.py", "sub/x.go", "sub/main.go", "sub/deep/lib.go", "sub/deep/y.go", "x.go", "sub/only.py", "sub/deep/only.py", "hidden_again/back.py", "UP.PY", "noext", "read.me",
]


def test_ignore_files_of_many_folders(spark, tmp_path):
    make(tmp_path, RULES | {f: "x\n" for f in FILES})
    got = paths(spark, tmp_path)
    want = [
        "UP.PY", "a.rs", "b/z.py", "doc/b.py", "doc/c/a.py", "gen/c/d.py", "keep.rs", "logs.py", "sub/deep/lib.go", "sub/deep/only.py", "sub/keep.rs", "sub/main.go", "sub/top.py", "x.go", "xa.py", "ya.py",
    ]
    assert got == sorted(set(want) - {"a.rs"})
    assert "a.rs" in paths(spark, tmp_path, ignore_files=[])
    assert "xa.py" not in paths(spark, tmp_path, ignore_text="xa.py\nkeep.rs\n") and "keep.rs" in paths(spark, tmp_path, ignore_text="keep.rs\n")


@pytest.mark.skipif(shutil.which("git") is None, reason="needs git")
def test_rules_are_those_of_git(tmp_path):
    rules = {k: v for k, v in RULES.items() if k.endswith(".gitignore")}
    make(tmp_path, rules | {f: "x\n" for f in FILES})
    env = {**os.environ, "GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull}
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, env=env)
    listed = subprocess.run(["git", "-C", str(tmp_path), "ls-files", "-co", "--exclude-standard", "-z"], check=True, capture_output=True, text=True, env=env).stdout.split("\0")
    found = [p for p, _ in tree.walk(tree.Files(str(tmp_path)), frozenset(), [".gitignore"], [], lambda path: True)]
    assert sorted(found) == sorted(p for p in listed if p and ".gitignore" not in p)


def test_what_is_denied_is_never_opened(spark, tmp_path, monkeypatch):
    make(tmp_path, {"node_modules/x/huge.py": "y" * 2_000_000, "src/a.py": "x = 1\n", ".hidden/b.py": "", "vendor/c.py": "", "src/target/d.py": "", "build.py": "z\n"})
    os.symlink(tmp_path / "src" / "a.py", tmp_path / "link.py")
    os.symlink(tmp_path / "src", tmp_path / "again")
    (tmp_path / "locked").mkdir(mode=0o000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        rows = {r["path"]: r for r in scan.scan_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        (tmp_path / "locked").chmod(0o700)
    assert sorted(rows) == ["build.py", "src/a.py"] and (rows["src/a.py"]["line_count"], rows["src/a.py"]["size_bytes"], rows["src/a.py"]["lang"]) == (1, 6, "python")
    entered = []
    whole = tree.Files.list
    monkeypatch.setattr(tree.Files, "list", lambda self, folder: entered.append(folder) or whole(self, folder))
    list(tree.walk(tree.Files(str(tmp_path)), frozenset(scan.DENIED), scan.IGNORE_FILES, [], lambda p: True, lambda f: f != "other/"))
    assert sorted(entered) == ["", "locked/", "src/"]


def test_parts_have_as_many_bytes():
    sizes = [(f"f{k}", 1_000_000 if k < 3 else 10_000) for k in range(303)]
    parts = tree.dealt(sizes, 2_000_000)
    loads = [sum(dict(sizes)[p] for p in part) for part in parts]
    assert sorted(p for part in parts for p in part) == sorted(p for p, _ in sizes) and len(parts) == 3 and max(loads) < 1.1 * min(loads)
    assert tree.dealt([], 10) == [] and tree.dealt([("a", 0), ("b", 0)], 10) == [["a", "b"]]


def test_a_part_of_a_tree(spark, tmp_path):
    make(tmp_path, {"src/a.py": "x", "src/b.rs": "y", "lib/c.py": "z", "src/deep/d.py": "w", "srcs/e.py": "v", ".gitignore": "a.py\n"})
    assert paths(spark, tmp_path, below="src", languages=["python", "go"], partition_bytes=1) == ["src/deep/d.py"]
    assert paths(spark, tmp_path, below="src/deep/d.py") == ["src/deep/d.py"] and paths(spark, tmp_path, languages=["rust"]) == ["src/b.rs"] and paths(spark, tmp_path, below="none") == []
    assert scan.scan_files(spark, str(tmp_path), ignore_files=[], partition_bytes=1).rdd.getNumPartitions() == 5


def test_no_files_and_no_root(spark, tmp_path):
    assert paths(spark, tmp_path) == []
    with pytest.raises(Exception, match="No such file"):
        paths(spark, tmp_path / "none")


def test_hints_of_every_kind(spark, tmp_path):
    hints = {"macro_expansions": [{"pattern": "MAKE_IT", "resolves_to": "made"}, {"pattern": "half"}], "di_annotations": ["@MyInject", " Wire "], "extra_calls": [{"from": "boot", "to": "kernel"}, {"from": "x"}]}
    make(tmp_path, {".context/hints/java.json": json.dumps(hints), ".context/hints/go.json": "{broken", ".context/hints/_template.json": json.dumps(hints)})
    make(tmp_path, {"A.java": "class A {\n  void boot() { run(); }\n  @MyInject private Repo repo;\n  @Other private Users users;\n}\n", "B.java": "class B {\n  void kernel() { }\n  void made() { }\n}\nclass Repo { }\nclass Users { }\n", "c.py": "def boot():\n    pass\n"})
    found = scan.tree_hints(spark, str(tmp_path))
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("java", "macro", "MAKE_IT", "made"), ("java", "call", "boot", "kernel"), ("java", "annotation", "MyInject", None), ("java", "annotation", "Wire", None)]))
    files = scan.scan_files(spark, str(tmp_path))
    full = index.build(files, hints=found)
    names = {r["id"]: r["qualified_name"] for r in full.symbols.collect()}
    edges = sorted((names[r["source_id"]], names[r["target_id"]], r["kind"]) for r in full.edges.collect())
    assert edges == [("A", "B.made", "MACRO_EXPAND"), ("A", "Repo", "DI_INJECT"), ("A.boot", "B.kernel", "CALLS"), ("B", "B.made", "MACRO_EXPAND")]
    stored = index.StoredIndex(spark, str(tmp_path / "store"), found)
    stored.apply(files.where("path <> 'B.java'").select("path", "lang", "content_hash", "text"))
    stored.apply(files.select("path", "lang", "content_hash", "text"))
    assert sorted(map(tuple, stored.edges.collect())) == sorted(map(tuple, full.edges.collect()))
