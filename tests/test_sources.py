"""Scans, rule texts, extraction and the index job over a small tree."""

import pytest

from loomgraph.jobs import index
from loomgraph.sources import scan

PYTHON = '''import os


# Runs all.
def run_all():
    helper()
    other_file()


class Box:
    def open_box(self):
        return run_all()


def helper():
    return os.getcwd()
'''


@pytest.fixture
def tree(tmp_path):
    for path, text in {"a.py": PYTHON, "sub/b.py": "def other_file():\n    return 1\n", "node_modules/x.js": "function no() {}", ".hidden/y.py": "def no(): pass", "c.rs": "/// Says it.\npub fn say_it() {\n    helper();\n}\n", "d.txt": "no"}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / path).write_text(text)
    return tmp_path


def test_scan(spark, tree):
    rows = {r["path"]: r for r in scan.scan_files(spark, str(tree)).collect()}
    assert sorted(rows) == ["a.py", "c.rs", "sub/b.py"]
    assert rows["c.rs"]["lang"] == "rust" and rows["c.rs"]["line_count"] == 4 and rows["a.py"]["size_bytes"] == len(PYTHON)


def edges(found):
    names = {r["id"]: r["name"] for r in found.symbols.collect()}
    return sorted((names[r["source_id"]], names[r["target_id"]], r["confidence"]) for r in found.edges.collect())


def test_incremental_is_full(spark, tree):
    first = index.build(scan.scan_files(spark, str(tree)))
    assert edges(first) == [("open_box", "run_all", "exact"), ("run_all", "helper", "exact"), ("run_all", "other_file", "name_match"), ("say_it", "helper", "name_match")]
    assert {r["name"]: r["doc"] for r in first.symbols.collect()}["say_it"] == "Says it."
    (tree / "sub" / "b.py").unlink()
    (tree / "e.py").write_text("def other_file():\n    helper()\n")
    (tree / "a.py").write_text(PYTHON.replace("class Box", "class Chest"))
    files = scan.scan_files(spark, str(tree))
    again, full = index.build(files, first), index.build(files)
    assert edges(again) == edges(full)
    assert sorted(map(tuple, again.symbols.select(*full.symbols.columns).collect())) == sorted(map(tuple, full.symbols.collect()))


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("java", "class A {\n  @Autowired\n  private UserRepo repo;\n  @Inject(\"x\") @Lazy final Box b = null;\n  @Column\n  private Other o;\n  // @Inject Foo f;\n}\n", [(3, "UserRepo", "DI_INJECT"), (4, "Box", "DI_INJECT")]),
        ("csharp", "class A {\n  [Inject] public IMail Mail { get; set; }\n  [Other] IFoo f;\n  [Inject]\n  private IBar _b;\n}\n", [(2, "IMail", "DI_INJECT"), (5, "IBar", "DI_INJECT")]),
        ("php", "class A {\n  #[Inject]\n  private Mail $mail;\n  #[Id] private $n;\n}\n", [(3, "mail", "DI_INJECT")]),
        ("kotlin", "class A {\n  @Inject lateinit var repo: Repo\n  @Other val x = 1\n}\n", [(2, "repo", "DI_INJECT")]),
        ("dart", "class A {\n  @Inject()\n  final Repo repo;\n}\n", [(3, "repo", "DI_INJECT")]),
        ("swift", "class A {\n  @Environment(\\.theme) private var theme\n  @State var x = 1\n}\n", [(2, "theme", "FRAMEWORK_LINK")]),
        ("ruby", "class A\n  has_many :posts\n  belongs_to(:owner)\n  puts :x\nend\n", [(2, "posts", "FRAMEWORK_LINK"), (3, "owner", "FRAMEWORK_LINK")]),
        ("go", "type A struct {\n\tBase\n\t*Log\n\tstore Store `json:\"s\"` // kept\n\tp *Far\n\tx interface{}\n}\n", [(2, "Base", "DI_INJECT"), (3, "Log", "DI_INJECT"), (4, "Store", "DI_INJECT")]),
        ("tsx", "const a = require('./a');\nconst b = await import(\"lib/b\");\nload('c');\n", [(1, "./a", "DYNAMIC_IMPORT"), (2, "lib/b", "DYNAMIC_IMPORT")]),
    ],
)
def test_bridges(language, text, want):
    from loomgraph.sources import extract

    sites = extract.pattern_symbols(text, language)[1]
    assert [s for s in sites if s[2] != "CALLS" and s[1] != "require"] == want


def test_macro_hints(spark, tree):
    from loomgraph.jobs.api import Workspace

    (tree / ".context" / "hints").mkdir(parents=True)
    (tree / ".context" / "hints" / "rust.json").write_text('{"macro_expansions": [{"pattern": "no_such!", "resolves_to": "run_all"}]}')
    found = Workspace.build_graph(type("W", (), {"g": type("G", (), {"spark": spark})})(), str(tree))
    names = {r["id"]: r["name"] for r in found.symbols.collect()}
    assert [(names[r["source_id"]], names[r["target_id"]]) for r in found.edges.where("kind = 'MACRO_EXPAND'").collect()] == [("say_it", "run_all")]


def test_rules(spark, tmp_path):
    (tmp_path / "style.txt").write_text("# no\n\nAUTH_1: warn : Check it: twice\nhint_db: Use the pool\nPlain words\nNote: this one\n")
    got = sorted((r["code"], r["severity"], r["statement"]) for r in scan.read_rules(spark, str(tmp_path / "style.txt")).collect())
    assert got == [("AUTH_1", "WARNING", "Check it: twice"), ("HINT_DB", "INFO", "Use the pool"), ("STYLE_0005", "INFO", "Plain words"), ("STYLE_0006", "INFO", "Note: this one")]


def test_records_and_hints(spark, tmp_path):
    (tmp_path / "one.md").write_text('---\ncode: A-1\nstatement: "Do it"\n---\nText\n')
    (tmp_path / "two.md").write_text("nothing\n")
    (tmp_path / "h.json").write_text('{"macro_expansions": [{"pattern": "m!", "resolves_to": "f"}]}')
    assert [(r["code"], r["severity"], r["statement"]) for r in scan.read_records(spark, str(tmp_path)).collect()] == [("A-1", "INFO", "Do it")]
    assert [tuple(r) for r in scan.read_hints(spark, str(tmp_path / "h.json")).collect()] == [("h", "macro", "m!", "f")]


def test_globs():
    import re

    assert re.match(scan.glob_pattern("src/*.py"), "src/a.py") and not re.match(scan.glob_pattern("src/*.py"), "src/x/a.py") and re.match(scan.glob_pattern("src/**/*.py"), "src/x/y/a.py")


def test_ignore_files(spark, tree):
    (tree / ".gitignore").write_text("# made\nsub/\n*.rs\n!c.rs\n")
    (tree / "d.rs").write_text("fn no() {}")
    assert sorted(r["path"] for r in scan.scan_files(spark, str(tree)).collect()) == ["a.py", "c.rs"]


def test_sources_that_cannot_be_parsed(spark, tree):
    (tree / "deep.py").write_text("x = " + "-" * 20_000 + "1\n")
    (tree / "broken.py").write_text("def f(:\n")
    found = index.build(scan.scan_files(spark, str(tree)))
    errors = {r["path"]: r for r in found.errors.collect()}
    assert sorted(errors) == ["broken.py", "deep.py"] and errors["broken.py"]["error"] == "SyntaxError" and errors["broken.py"]["line"] == 1
    assert len(edges(found)) == 4


def test_rust_items():
    from loomgraph.sources import extract

    symbols, calls = extract.pattern_symbols("impl<T> Show for Box<T> {\n}\npub type Id = u64;\nconst MAX: usize = 3;\nfn go() {\n    println!(\"x\");\n}\n", "rust")
    assert [s[:2] for s in symbols] == [("Box", "impl"), ("Id", "type_alias"), ("MAX", "const"), ("go", "function")] and (6, "println", "CALLS") in calls


def test_knowledge_of_a_tree(spark, tmp_path):
    from loomgraph.sources import imports

    (tmp_path / "rules").mkdir()
    (tmp_path / "_index.md").write_text("---\ncovers: [user_accounts/_index.md, 'billing/_index.md', _x/y]\n---\ncovers: [no/_index.md]\n")
    (tmp_path / "rules" / "_index.md").write_text("* **Check-in first:** Do it\n- **Note:** no\n* **Empty:**\nplain\n- **Log all** : Always\n")
    assert sorted((r["name"], list(r["keywords"])) for r in imports.tree_domains(spark, str(tmp_path)).collect()) == [("Billing", ["billing"]), ("User Accounts", ["user", "accounts"])]
    assert sorted(tuple(r) for r in imports.tree_rules(spark, str(tmp_path)).collect()) == [("RULES.CHECK_IN_FIRST", "WARNING", "Do it"), ("RULES.LOG_ALL", "WARNING", ": Always")]
    assert imports.tree_domains(spark, str(tmp_path / "none")).count() == imports.tree_rules(spark, str(tmp_path / "none")).count() == 0


def test_registry_records_and_export(spark, tmp_path):
    from loomgraph.sources import imports

    where = str(tmp_path / "registry.json")
    assert imports.load_registry(spark, where).count() == 0
    given = spark.createDataFrame([("a", "/w/a", 3, "t0"), ("b", "/w/b", 0, None)], "name string, path string, symbol_count long, last_indexed string")
    first = imports.registered(imports.load_registry(spark, where), given)
    imports.save_registry(first, where)
    again = imports.load_registry(spark, where)
    assert sorted((r["name"], r["path"], r["symbol_count"]) for r in again.collect()) == [("a", "/w/a", 3), ("b", "/w/b", 0)]
    next_one = imports.registered(again, given.where("name = 'a'").selectExpr("name", "path", "9L as symbol_count", "'t1' as last_indexed"))
    assert sorted((r["name"], r["symbol_count"], r["last_indexed"]) for r in next_one.collect()) == [("a", 9, "t1"), ("b", 0, None)]
    (tmp_path / "docs" / "adr").mkdir(parents=True)
    (tmp_path / "own").mkdir()
    root = str(tmp_path)
    assert [p.removeprefix(root) for p in imports.record_folders(spark, root)] == ["/docs/adr"] and [p.removeprefix(root) for p in imports.record_folders(spark, root, configured=["own", "no"])] == ["/own"]
    assert imports.record_folders(spark, root, given="no") == []
    for form in ("json", "csv", "parquet"):
        imports.export(spark.createDataFrame([(1, ["x", "y"])], "id long, names array<string>"), f"{root}/out-{form}", form)
    assert spark.read.option("header", True).csv(f"{root}/out-csv").first()["names"] == '["x","y"]' and spark.read.parquet(f"{root}/out-parquet").count() == spark.read.json(f"{root}/out-json").count() == 1


def test_stems():
    from loomgraph.functions.stem import stem

    want = dict(zip("caresses ponies ties cats feed agreed plastered motoring sing conflated hopping tanned falling hissing filing happy sky relational conditional valenci digitizer radically vileli operator feudalism decisiveness hopefulness formaliti sensitibiliti triplicate formative formalize electrical hopeful goodness revival allowance inference airliner adjustable replacement adoption communism activate effective probate rate cease controll roll is".split(),
                    "caress poni ti cat feed agre plaster motor sing conflat hop tan fall hiss file happi sky relat condit valenc digit radic vile oper feudal decis hope formal sensit triplic form formal electr hope good reviv allow infer airlin adjust replac adopt commun activ effect probat rate ceas control roll is".split(), strict=True))
    assert {w: stem(w) for w in want} == want
