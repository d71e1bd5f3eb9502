import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.sources import extract
from lacuna.sources.extract_python import clean_call_name

REGISTRY = extract.Registry()


def run(language, text):
    path = "x" + REGISTRY.extractors[language][0][0]
    rows = extract.extract_one(REGISTRY.extractors[language][1], text.encode(), path)
    return {name: (kind, line, {k: set(v) for k, v in features.items()}) for kind, name, line, features in rows}


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("foo", "foo"),
        ("self.update", "self.update"),
        ("parse(None::<&str>).unwrap", "parse(...).unwrap"),
        ("a(b(c), d).e(f)", "a(...).e(f)"),
        ("broken(", "broken("),
    ],
)
def test_clean_call_name(text, shown):
    assert clean_call_name(text) == shown


def test_python():
    found = run(
        "python",
        '''import x
__all__ = ["f"]

@app.route("/x")
@audit
def f(a: int, *args, b=1, **kw) -> str:
    """Doc."""
    log.info("é", request_id=a)
    def nested(): inner()

class C(Base, mod.Other, metaclass=Meta):
    @property
    def v(self): return 1
    async def __post_init__(self, x: int): pass
''',
    )
    assert found["__module__"] == ("module", 1, {"has_all_export": {"__all__"}})
    kind, line, features = found["f"]
    assert (kind, line) == ("function", 6)
    assert features == {
        "decorator": {"@app.route", "@audit"},
        "calls": {"log.info", "inner"},
        "call_kwargs": {"request_id="},
        "has_docstring": {"docstring"},
        "has_return_type": {"return type"},
        "has_param_types": set(),
    }
    assert found["C"][2] == {"decorator": set(), "parent_class": {"Base", "mod.Other"}, "has_docstring": set(), "has_post_init": {"__post_init__"}}
    assert found["C.v"][0] == "method" and found["C.v"][2]["has_param_types"] == {"param types"}
    assert "nested" not in found


def test_python_that_does_not_parse():
    found = run("python", "def ok():\n    pass\nclass C:\n    def m(self):\n        x = (\n")
    assert {n: k for n, (k, _, _) in found.items()} == {"__module__": "module", "ok": "function", "C": "class", "C.m": "method"}


CASES = {
    "javascript": (
        "import x from 'y';\nexport function go(a) { helper(a); api.call(); }\nconst run = async (x) => { work(x); };\nclass A extends B {\n  m() { this.z(); }\n}\n// function no() {}\n",
        {"go": ("function", {"calls": {"helper", "api.call"}}), "run": ("function", {"calls": {"work"}}), "A": ("class", {"parent_class": {"B"}}), "A.m": ("method", {"calls": {"this.z"}})},
    ),
    "typescript": (
        "@Injectable()\nexport class S extends Base implements One, Two<X> {\n  @Get()\n  find(id: string): Promise<X> { return this.repo.find(id); }\n}\ninterface I extends J { a: string }\n",
        {"S": ("class", {"decorator": {"@Injectable"}, "parent_class": {"Base", "One", "Two"}}), "S.find": ("method", {"decorator": {"@Get"}, "calls": {"this.repo.find"}}), "I": ("interface", {"decorator": set(), "parent_class": {"J"}})},
    ),
    "rust": (
        '#[derive(Debug)]\npub struct Foo { a: String }\nfn top() { println!("hi"); other::go(); }\ntrait T: A + B { fn sig(&self); }\nimpl T for Foo { #[inline]\n fn sig(&self) { self.x(); } }\nimpl Foo { pub fn new() -> Self { Self } }\n',
        {
            "Foo": ("struct", {"decorator": {"#[derive]"}, "parent_class": set()}),
            "top": ("function", {"decorator": set(), "calls": {"println!", "other::go"}}),
            "T": ("trait", {"decorator": set(), "parent_class": {"A", "B"}}),
            "Foo (impl T)": ("impl", {"decorator": set(), "parent_class": {"T"}}),
            "Foo (impl)": ("impl", {"decorator": set(), "parent_class": set()}),
            "Foo.sig": ("method", {"decorator": {"#[inline]"}, "calls": {"self.x"}}),
            "Foo.new": ("method", {"decorator": set(), "calls": set()}),
        },
    ),
    "go": (
        "package main\ntype P struct { N string }\ntype R interface { Read() }\ntype Alias = int\nfunc standalone() {\n\thelper()\n}\nfunc (p *P) Greet() string {\n\treturn fmt.Sprintf(\"hi\")\n}\n",
        {"P": ("struct", {}), "R": ("interface", {}), "standalone": ("function", {"calls": {"helper"}}), "P.Greet": ("method", {"calls": {"fmt.Sprintf"}})},
    ),
    "java": (
        "package a;\n@Service\npublic class A extends B implements C, D {\n  @Override\n  public String run(int x) throws E { new Thing(); return db.find(x); }\n  A() { init(); }\n}\ninterface I extends J {}\nenum K { X }\n",
        {
            "A": ("class", {"decorator": {"@Service"}, "parent_class": {"B", "C", "D"}}),
            "A.run": ("method", {"decorator": {"@Override"}, "calls": {"new Thing", "db.find"}}),
            "A.A": ("method", {"decorator": set(), "calls": {"init"}}),
            "I": ("interface", {"decorator": set(), "parent_class": {"J"}}),
            "K": ("enum", {"decorator": set(), "parent_class": set()}),
        },
    ),
    "ruby": (
        "module M\n  class Cat < Animal\n    include Greet\n    def greet(x)\n      helper.call(x)\n      save\n    end\n    def self.make\n    end\n  end\nend\n",
        {"M": ("module", {"parent_class": set()}), "Cat": ("class", {"parent_class": {"Animal", "Greet"}}), "Cat.greet": ("method", {"calls": {"helper.call", "save"}}), "Cat.make": ("method", {"calls": set()})},
    ),
    "csharp": (
        "namespace N {\n  [ApiController]\n  public class A : Base, IThing {\n    [HttpGet]\n    public string Get(int id) { return svc.Find(id); }\n  }\n  public record R(int X);\n}\n",
        {"A": ("class", {"decorator": {"[ApiController]"}, "parent_class": {"Base", "IThing"}}), "A.Get": ("method", {"decorator": {"[HttpGet]"}, "calls": {"svc.Find"}}), "R": ("record", {"decorator": set(), "parent_class": set()})},
    ),
    "swift": (
        "@objc class V: Base, P {\n  func draw() { paint() }\n}\nstruct S {}\nextension V: Q {\n  func more() { a.b() }\n}\nprotocol P {}\nfunc top() { go() }\n",
        {"V.draw": ("method", {"decorator": set(), "calls": {"paint"}}), "S": ("struct", {"decorator": set(), "parent_class": set()}), "V.more": ("method", {"decorator": set(), "calls": {"a.b"}}), "P": ("protocol", {"decorator": set(), "parent_class": set()}), "top": ("function", {"decorator": set(), "calls": {"go"}})},
    ),
    "c": (
        "#include <x.h>\nstruct node { int a; };\nstatic int add(int a, int b)\n{\n  log_it(a);\n  if (a) return b;\n  return a;\n}\nint proto(void);\n",
        {"node": ("struct", {}), "add": ("function", {"calls": {"log_it"}})},
    ),
    "cpp": (
        "namespace n {\nclass A : public B, private C {\n public:\n  int get() const { return f(); }\n};\nint A::out(int x) { return g(x); }\nvoid top() { h::k(); }\n}\n",
        {"A": ("class", {"parent_class": {"B", "C"}}), "A.get": ("method", {"calls": {"f"}}), "A.out": ("method", {"calls": {"g"}}), "top": ("function", {"calls": {"h::k"}})},
    ),
    "php": (
        "<?php\nnamespace X;\n#[Route('/x')]\nclass A extends B implements C {\n  public function go($x) { $this->svc->find($x); Foo::bar(); new Thing(); }\n}\nfunction top() { helper(); }\n",
        {"A": ("class", {"decorator": {"#[Route]"}, "parent_class": {"B", "C"}}), "A.go": ("method", {"decorator": set(), "calls": {"find", "Foo.bar", "new Thing"}}), "top": ("function", {"decorator": set(), "calls": {"helper"}})},
    ),
    "kotlin": (
        "@Service\nclass A(val x: Int) : Base(x), Face {\n  @Get\n  fun go(y: Int): Int { return api.call(y) }\n}\ndata class D(val a: Int)\nobject O { fun z() = work() }\nfun top() { helper() }\n",
        {"A": ("class", {"decorator": {"@Service"}, "parent_class": {"Base", "Face"}}), "A.go": ("method", {"decorator": {"@Get"}, "calls": {"api.call"}}), "D": ("data_class", {"decorator": set(), "parent_class": set()}), "O.z": ("method", {"decorator": set(), "calls": {"work"}}), "top": ("function", {"decorator": set(), "calls": {"helper"}})},
    ),
    "scala": (
        "package a\nclass A(x: Int) extends Base(x) with Face {\n  def go(y: Int): Int = { api.call(y) }\n}\ntrait T { def z(): Unit }\nobject O { def w() = { run() } }\n",
        {"A": ("class", {"decorator": set(), "parent_class": {"Base", "Face"}}), "A.go": ("method", {"decorator": set(), "calls": {"api.call"}}), "T": ("trait", {"decorator": set(), "parent_class": set()}), "O.w": ("method", {"decorator": set(), "calls": {"run"}})},
    ),
    "lua": (
        "local M = {}\nfunction helper()\n  print('hi')\nend\nfunction M.greet(n)\n  do_thing(n)\nend\nfunction M:render()\nend\nM.go = function(x)\n  if x then M.greet(x) end\nend\n",
        {"helper": ("function", {"calls": {"print"}}), "M.greet": ("function", {"calls": {"do_thing"}}), "M.render": ("method", {"calls": set()}), "M.go": ("method", {"calls": {"M.greet"}})},
    ),
    "bash": (
        "#!/bin/bash\nsetup() {\n  mkdir -p x\n  if grep -q a b; then echo hi; fi\n}\nfunction run { setup | tee log; }\n",
        {"setup": ("function", {"calls": {"mkdir", "grep", "echo"}}), "run": ("function", {"calls": {"setup", "tee"}})},
    ),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_language(language):
    text, expected = CASES[language]
    found = run(language, text)
    for name, (kind, features) in expected.items():
        assert name in found, (name, found)
        assert found[name][0] == kind, (name, found[name])
        assert found[name][2] == features, (name, found[name])
    assert "no" not in found and "Alias" not in found and "proto" not in found


@pytest.mark.parametrize("language", sorted(REGISTRY.extractors))
@settings(max_examples=15, deadline=None)
@given(data=st.binary(max_size=600))
def test_any_bytes(language, data):
    rows = REGISTRY.extractors[language][1](data, "x")
    assert all(line > 0 and isinstance(features, dict) for _, _, line, features in rows)


def test_dispatch_and_plugins():
    mine = extract.Registry({"python": ((".py",), lambda content, path: [("function", "own", 1, {})])})
    assert mine.by_extension()[".py"] == "python" and len(mine.extractors) == 17
    assert extract.extract_one(mine.extractors["python"][1], b"", "a.py") == [("function", "own", 1, {})]
    assert set(extract.Registry().by_extension(["go", "c"])) == {".go", ".c", ".h"}
