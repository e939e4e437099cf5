"""Definitions, their ends and calls of every language, with decoys in comments, strings and the like; texts that don't fit."""

import pytest

from loomgraph.sources import extract, lexing

SOURCES = {
    "rust": (
        '''/* fn no() { /* nested fn no2() {} */ } */
//! struct No;
pub mod net {
    /// Sends it.
    pub struct Client<'a> { name: &'a str }
    impl<'a> Client<'a> {
        pub fn send(&self, c: char) -> Result<(), Error> {
            let s = r#"fn fake() { "quoted" }"#; let q = '{'; let e = '\\'';
            helper(s); self.flush_all(); net::deep::call_it::<u8>(1); println!("fn x() {{");
            Ok(())
        }
    }
}
pub trait Show { fn show(&self) -> String; const N: usize; }
enum Kind { A(u8), B }
type Id = u64;
const MAX: usize = 3;
async fn last<T>(t: T) -> impl Fn() -> T
where T: Copy {
    move || t
}
''',
        [("net", "module", 3, 13), ("net.Client", "struct", 5, 5), ("net.Client", "impl", 6, 12), ("net.Client.send", "function", 7, 11), ("Show", "trait", 14, 14), ("Show.show", "function", 14, 14), ("Show.N", "const", 14, 14), ("Kind", "enum", 15, 15), ("Id", "type_alias", 16, 16), ("MAX", "const", 17, 17), ("last", "function", 18, 21)],
        {"helper", "flush_all", "call_it", "println", "Ok"}, "fn a() { (1 }\n",
    ),
    "typescript": (
        '''// function no() {}
interface Shape { area(): number; name: string }
type Id = string | number
enum Kind { A, B }
export default class Store<T> extends Base<T> {
  private items: T[] = [];
  constructor(x: number) { super(); boot(x) }
  async find(id: Id): Promise<{ a: T }> {
    const re = /function fake\\(\\) {/g; const s = `class No { ${render(id)} {`
    if (id) { return this.lookup(id) }
    return "function no2() {"
  }
  get size() { return count(this.items) }
}
export function main<T>(a: T, cb = (x) => x): void {
  run(() => { inner(a) }); new Store(1); await import("./mod")
}
const pick = async (x: number, y?: string): Promise<void> => {
  go(x)
}
const sum = x => x + 1
''',
        [("Shape", "interface", 2, 2), ("Id", "type_alias", 3, 3), ("Kind", "enum", 4, 4), ("Store", "class", 5, 14), ("Store.constructor", "method", 7, 7), ("Store.find", "method", 8, 12), ("Store.size", "method", 13, 13), ("main", "function", 15, 17), ("pick", "const", 18, 20), ("sum", "const", 21, 21)],
        {"boot", "render", "lookup", "count", "run", "inner", "go"}, "function f() { return [1, 2 }\n",
    ),
    "go": (
        '''package main
// func no() {}
type Server struct { *Base; mu sync.Mutex }
type (
	Reader interface { Read() int }
	ID int
)
const Max = 3
const (
	A = iota
	B
)
func New(opts map[string]interface{}) (*Server, error) {
	s := `func fake() {`
	return build(s), nil
}
func (s *Server) Run(f func() struct{}) struct{} {
	go s.loop("type X struct {")
	return f()
}
''',
        [("Server", "type", 3, 3), ("Reader", "type", 5, 5), ("ID", "type", 6, 6), ("Max", "const", 8, 8), ("A", "const", 10, 10), ("B", "const", 11, 11), ("New", "function", 13, 16), ("Run", "method", 17, 20)],
        {"build", "loop", "f"}, "func f() {\n\tx(]\n}\n",
    ),
    "c": (
        '''#include <x.h>
#define MAKE(n) int n(void) { \\
  return 0; }
/* int no(void) { } */
typedef struct node { int v; struct node *next; } node_t;
typedef unsigned long word;
enum color { RED, BLUE };
static int add(int a, int b)
{
    char c = '{'; const char *s = "int fake(void) {";
    return sub(a, b) + ops->apply(a);
}
int declared(int a);
struct point { int x; };
struct point *make(void) { if (ready()) { return 0; } return mk(); }
''',
        [("node_t", "type_alias", 5, 5), ("node_t.node", "struct", 5, 5), ("word", "type_alias", 6, 6), ("color", "enum", 7, 7), ("add", "function", 8, 12), ("point", "struct", 14, 14), ("make", "function", 15, 15)],
        {"sub", "apply", "ready", "mk"}, "int f(void) { return 1;\n",
    ),
    "cpp": (
        '''// class No {};
namespace app {
class Widget : public Base {
 public:
  Widget(int a) : a_(a), b_{1} { init(); }
  ~Widget() { release(); }
  int size() const override { return R"(int fake() { )"[0]; }
  void later();
};
struct Pod { int x; };
enum class Mode : int { A };
void Widget::later() { detail::work(1); obj.touch(); }
template <typename T> T pick(T a) noexcept { return std::max<T>(a, a); }
}
''',
        [("app", "namespace", 2, 14), ("app.Widget", "class", 3, 9), ("app.Widget.Widget", "method", 5, 5), ("app.Widget.Widget", "destructor", 6, 6), ("app.Widget.size", "method", 7, 7), ("app.Pod", "struct", 10, 10), ("app.Mode", "enum", 11, 11), ("app.later", "method", 12, 12), ("app.pick", "function", 13, 13)],
        {"init", "release", "work", "touch"}, "class A { void f() { ; };\n",
    ),
    "java": (
        '''/** class No {} */
package a;
public interface Api { int ask(String q) throws IOException; default void ok() { yes(); } }
enum Level { LOW(1), HIGH(2); Level(int n) { keep(n); } }
@Service("x")
public class Users extends Base implements Api {
    private final Map<String, List<Integer>> m = make();
    @Inject
    Users(@Named("class Fake {") Repo r) { super(r); this.r = r; }
    @Override
    public <T extends Api> List<T> find(String s, int[] xs) throws A, B {
        String t = """
            void fake() {
            """;
        return repo.query(s, new Thing(t), x -> { hook(x); return 1; });
    }
    public int[] grid() { return null; }
}
''',
        [("Api", "interface", 3, 3), ("Api.ask", "method", 3, 3), ("Api.ok", "method", 3, 3), ("Level", "enum", 4, 4), ("Level.Level", "constructor", 4, 4), ("Users", "class", 6, 18), ("Users.Users", "constructor", 8, 9), ("Users.find", "method", 10, 16), ("Users.grid", "method", 17, 17)],
        {"yes", "keep", "make", "query", "hook"}, "class A { void f() { g(; }\n",
    ),
    "csharp": (
        '''#region class No { }
namespace App {
    // class No2 { }
    public interface IShop { Task<int> Buy(string id); }
    enum Kind { A, B }
    public class Shop : IShop {
        public string Name { get; set; }
        public int Size => items.Count();
        public Shop(int a) : base(a) { Init(a); }
        public async Task<int> Buy(string id) {
            var s = @"class Fake { "" "; var c = '{';
            return await store.Load(id, new Thing());
        }
        private T Pick<T>(T a) where T : class { return a; }
    }
}
''',
        [("IShop", "interface", 4, 4), ("IShop.Buy", "method", 4, 4), ("Kind", "enum", 5, 5), ("Shop", "class", 6, 15), ("Shop.Name", "property", 7, 7), ("Shop.Size", "property", 8, 8), ("Shop.Shop", "constructor", 9, 9), ("Shop.Buy", "method", 10, 13), ("Shop.Pick", "method", 14, 14)],
        {"Count", "Init", "Load"}, "class A { int X { get; }\n",
    ),
    "ruby": (
        '''=begin
class No; end
=end
module Shop
  # def no; end
  class Cart < Base
    def initialize(a)
      @a = a if a
      puts "def fake; end"
    end

    def total?
      items.each do |x|
        next unless x
        add x
      end
      while busy do
        wait_for(1)
      end
      text = <<~SQL
        class Fake
      SQL
      /class \\d/.match(text)
    end

    def self.build(x) = new_one(x)
    def name=(v)
      @v = v
    end
  end
end
''',
        [("Shop", "module", 4, 31), ("Shop.Cart", "class", 6, 30), ("Shop.Cart.initialize", "method", 7, 10), ("Shop.Cart.total?", "method", 12, 24), ("Shop.Cart.build", "method", 26, 26)],
        {"puts", "each", "add", "wait_for", "match", "new_one"}, "class A\n  def f\n  end\n",
    ),
    "php": (
        '''<html>function no() {}</html>
<?php
# class No {}
interface Api { public function ask($q); }
trait Logs { function log($m) { write_log($m); } }
abstract class Shop extends Base implements Api {
    public function ask($q) {
        $s = "function fake() {"; $h = <<<EOT
class Fake {
EOT;
        return $this->find($q) + Shop::make($q) + new Thing($q);
    }
}
function helper(int $a): array { return array_map(fn($x) => twice($x), [$a]); }
?>
function no2() {}
''',
        [("Api", "interface", 4, 4), ("Api.ask", "method", 4, 4), ("Logs", "trait", 5, 5), ("Logs.log", "method", 5, 5), ("Shop", "class", 6, 13), ("Shop.ask", "method", 7, 12), ("helper", "function", 14, 14)],
        {"write_log", "find", "array_map", "twice"}, "<?php function f() { g(1; }\n",
    ),
    "kotlin": (
        '''/* fun no() { /* class No2 */ } */
interface Api { fun ask(q: String): Int }
data class User(val name: String, val age: Int = compute())
class Shop(private val r: Repo) : Base(), Api {
    companion object Factory { fun make() = Shop(repo()) }
    override fun ask(q: String): Int {
        val s = """fun fake() { """
        return find(q)
    }
    fun <T> List<T>.second(): T = this[1]
}
object Single { val x = 1 }
fun main() {
    launch { go() }
}
''',
        [("Api", "class", 2, 2), ("Api.ask", "function", 2, 2), ("User", "class", 3, 3), ("Shop", "class", 4, 11), ("Shop.Factory", "companion", 5, 5), ("Shop.Factory.make", "function", 5, 5), ("Shop.ask", "function", 6, 9), ("Shop.second", "function", 10, 10), ("Single", "object", 12, 12), ("main", "function", 13, 15)],
        {"compute", "Shop", "repo", "find", "launch", "go"}, "fun f() { g( }\n",
    ),
    "swift": (
        '''/* func no() { /* class No2 {} */ } */
protocol Api { func ask(_ q: String) -> Int }
struct Point { var x = 0 }
enum Kind { case a, b }
actor Bank { func pay() async { charge() } }
final class Shop: Base, Api {
    class func shared() -> Shop { make() }
    func ask(_ q: String) -> Int {
        let s = """
        func fake() {
        """; let r = #"class Fake { "x" "#
        return finder.find(q)
    }
}
func main<T>(_ a: T) where T: Api { run(a) }
''',
        [("Api", "protocol", 2, 2), ("Point", "struct", 3, 3), ("Kind", "enum", 4, 4), ("Bank", "actor", 5, 5), ("Bank.pay", "function", 5, 5), ("Shop", "class", 6, 14), ("Shop.shared", "function", 7, 7), ("Shop.ask", "function", 8, 13), ("main", "function", 15, 15)],
        {"charge", "make", "find", "run"}, "func f() { [1 }\n",
    ),
    "lua": (
        '''--[[ function no() end ]]
-- function no2() end
local function helper(a)
  if a then return wrap(a) elseif b then return 2 else return 3 end
end
function M.run(x)
  for i = 1, 3 do
    repeat step(i) until done()
  end
  local s = [[function fake() end]]
  obj:fire(s)
  require "mod"
end
M.close = function(a)
  return finish(a)
end
''',
        [("helper", "function", 3, 5), ("run", "function", 6, 13), ("close", "method", 14, 16)],
        {"wrap", "step", "done", "fire", "require", "finish"}, "function f()\n  if x then\n",
    ),
    "dart": (
        """/* class No { /* nested */ } */
mixin Walks { void walk() { step(); } }
extension Extra on String { int twice() => count(this); }
enum Level { low, high }
abstract class Shop extends Base with Walks {
  Shop(this.a);
  final int a = init();
  int ask(String q);
  Future<List<int>> find(String q) async {
    var s = '''class Fake { void no() {} '''; var r = r'void {';
    return repo.load(q, (x) { hook(x); });
  }
  @override
  String toString() => render("void fake() {");
}
void main() { run(Shop(1)); }
""",
        [("Walks", "mixin", 2, 2), ("Walks.walk", "method", 2, 2), ("Extra", "extension", 3, 3), ("Extra.twice", "method", 3, 3), ("Level", "enum", 4, 4), ("Shop", "class", 5, 15), ("Shop.ask", "method", 8, 8), ("Shop.find", "method", 9, 12), ("Shop.toString", "method", 13, 14), ("main", "function", 16, 16)],
        {"step", "count", "init", "load", "hook", "render", "run"}, "void f() { g(; }\n",
    ),
    "python": (
        '''"""
def no(): pass
"""
class Shop(Base):
    # def no2(): pass
    def ask(self, q):
        def inner(): return deep()
        return find(q, "class Fake: pass")

async def main():
    await Shop().ask(1)
''',
        [("Shop", "class", 4, 8), ("Shop.ask", "function", 6, 8), ("Shop.ask.inner", "function", 7, 7), ("main", "function", 10, 11)],
        {"deep", "find", "Shop", "ask"}, "def f(:\n",
    ),
}
SOURCES["tsx"] = (SOURCES["typescript"][0] + "const View = (p: Props) => <div onClick={() => p.fire(1)}>{label(p)}</div>\n", [*SOURCES["typescript"][1], ("View", "const", 22, 22)], SOURCES["typescript"][2] | {"fire", "label"}, "function f() { return <A x={g(1}/>; }\n")
DECOYS = {"no", "no2", "fake", "No", "No2", "Fake", "x", "MAKE", "declared"}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_definitions_and_calls(language):
    text, want, called, _ = SOURCES[language]
    if language == "python":
        symbols, calls = extract.python_symbols(text)
        errors = []
    else:
        symbols, calls, errors = extract.source_symbols(text, language)
    assert sorted((q, kind, start, end) for _, kind, start, end, _, _, q in symbols) == sorted(want)
    names = {name for _, name, kind in calls if kind in ("CALLS", "DYNAMIC_IMPORT")}
    assert called <= names and not names & {"no", "no2", "fake", "No", "No2", "Fake", "if", "while", "return"}
    assert errors == []
    assert not {s[0] for s in symbols} & DECOYS


def test_all_languages_and_their_errors(spark):
    rows = [(f"{k}.{w}", k, t) for k, (good, _, _, bad) in SOURCES.items() for w, t in (("good", good), ("bad", bad), ("null", None), ("empty", ""))]
    rows += [("none", None, "x {"), ("other", "cobol", "IF {")]
    errors = extract.errors_in(extract.parsed(spark.createDataFrame(rows, "path string, lang string, text string"))).collect()
    assert {r["path"] for r in errors} == {f"{k}.bad" for k in SOURCES}
    assert {r["lang"] for r in errors} == set(SOURCES) and all(r["error"] == "SyntaxError" and r["line"] and r["message"] for r in errors)
    assert len(SOURCES) == 15


@pytest.mark.parametrize(
    ("language", "text", "want"),
    [
        ("rust", "fn a() {}\n/* never closed\nfn b() {}", [(2, "/* is not closed")]), ("kotlin", "/* a /* b */ fun c() {}", [(1, "/* is not closed")]), ("go", "func a() {}\n}\n", [(2, "} closes nothing")]), ("ruby", "def a\nend\nend\n", [(3, "end closes nothing")]),
        ("lua", "local s = [==[ function a() end ]]", [(1, "[==[ is not closed")]), ("java", "class A { int f() { g(1; }\n}", [(1, "( is not closed")]), ("typescript", "const a = `x ${y}\n", [(1, "` is not closed")]),
    ],
)
def test_what_does_not_close(language, text, want):
    assert lexing.code_of(text, language).errors == want


def test_places_stay():
    for language, (text, *_) in SOURCES.items():
        if language in ("python", "typescript", "tsx"):  # code in templates gets brackets of its own
            continue
        code = lexing.code_of(text, language)
        assert len(code.text) == len(text) and [len(x) for x in code.text.split("\n")] == [len(x) for x in text.split("\n")]


def test_long_and_deep_texts():
    many = "fn a_{0}() {{ b_{0}(); }}\n"
    symbols, calls, errors = extract.source_symbols("".join(many.format(k) for k in range(20_000)), "rust")
    assert len(symbols) == len(calls) == 20_000 and not errors and symbols[-1][2:4] == (20_000, 20_000)
    symbols, _, errors = extract.source_symbols("class A { void f() {" + "{" * 50_000 + "}" * 50_000 + "} }", "java")
    assert [s[6] for s in symbols] == ["A", "A.f"] and not errors
    assert len(extract.source_symbols("{" * 50_000, "java")[2]) == 50_000
