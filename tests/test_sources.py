from topoweave.plans.ask import ask
from topoweave.operators.graph import PropertyGraph
from topoweave.sources.files import comment_above, read_project, snippets
from topoweave.operators.resolve import resolve_targets
from topoweave.sources.pysource import exported, extract, file_rows, relationships, symbols
from tests_helpers import edges, ids, nodes

from pyspark.sql import functions as F

ENGINE = '''"""Engine."""
import functools
from shop.store import Store as S, helper
from . import util

LIMIT = 10

def deco(f):
    return f

class Base:
    def save(self): return LIMIT

class Engine(Base):
    kind: str = "x"

    def __init__(self, pool):
        self.pool = pool
        self.items: list = []

    @deco
    async def run(self, n, *rest, flag=True, **more):
        total = n
        total += LIMIT
        self.save()
        helper(total)
        self.pool.submit(util.work, n)
        def inner(q):
            return S(q)
        return total
'''


def rows():
    return file_rows("shop.engine", "shop/engine.py", ENGINE)


def test_symbols_of_a_file():
    got = {r["id"]: r["symbol_type"] for r in rows() if r["kind"] == "node"}
    for name, kind in {
        "shop.engine": "module", "shop.engine.LIMIT": "variable", "shop.engine.deco": "function", "shop.engine.Engine": "class", "shop.engine.Engine.kind": "variable", "shop.engine.Engine.pool": "variable",
        "shop.engine.Engine.run": "method", "shop.engine.Engine.run.n": "parameter", "shop.engine.Engine.run.rest": "parameter", "shop.engine.Engine.run.more": "parameter", "shop.engine.Engine.run.total": "variable", "shop.engine.Engine.run.inner": "function",
    }.items():
        assert got[name] == kind, name
    assert "shop.engine.Engine.run.self" not in got
    sig = next(r["signature"] for r in rows() if r.get("id") == "shop.engine.Engine.run" and r["kind"] == "node")
    assert sig == "async def run(self, n, *rest, flag=True, **more)"


def test_relationships_of_a_file():
    got = {(r["source"], r["target"], r["edge_type"]) for r in rows() if r["kind"] == "edge"}
    run = "shop.engine.Engine.run"
    assert {
        ("shop.engine", "shop.store.Store", "imports"), ("shop.engine", "shop.util", "imports"), ("shop.engine.Engine", "Base", "inherits"), ("deco", run, "calls"), ("shop.engine.Engine", run, "contains"),
        (run, "shop.engine.Engine.save", "calls"), (run, "shop.store.helper", "calls"), (run, "shop.util.work", "calls"), (run, "shop.store.Store", "calls"), (run, f"{run}.total", "writes"), (run, f"{run}.total", "reads"), (run, f"{run}.total", "returns"),
        ("shop.engine.Engine.__init__", "shop.engine.Engine.pool", "writes"),
    } <= got


def test_broken_files_give_nothing_and_names_resolve(spark):
    assert file_rows("m", "m.py", "def (") == [] and file_rows("m", "m.py", "a\0") == []
    data = [(1, "shop/engine.py", None, ENGINE, None), (2, "shop/store.py", "shop.store", "class Store: pass\ndef helper(x): pass\n", None), (3, "bad.py", None, "(", None), (4, "none.py", None, None, None)]
    r = extract(spark.createDataFrame(data, "file_id bigint, path string, module string, content string, mtime timestamp_ntz"))
    n = symbols(r)
    got = {tuple(x)[:3] for x in relationships(r, n).collect()}
    assert ("shop.engine.Engine", "shop.engine.Base", "inherits") in got and ("shop.engine.Engine.run", "shop.store.Store", "calls") in got
    assert ("shop.engine.Engine.run", "shop.engine.LIMIT", "reads") in got and extract(spark.createDataFrame([], "file_id bigint, path string, module string, content string, mtime timestamp_ntz")).count() == 0


def test_project_folder(spark, tmp_path):
    for p, text in {"a/__init__.py": "\n", "a/b.py": "# one\n# two\ndef f():\n    return 1\n", "build/x.py": "x = 1", "a/.venv/y.py": "", "a/n.txt": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    files = read_project(spark, str(tmp_path))
    assert {r.path: r.module for r in files.collect()} == {"a/__init__.py": "a", "a/b.py": "a.b"}
    n = spark.createDataFrame([("a.b.f", "a/b.py", 3, 4), ("zz", "a/b.py", 0, 2)], "id string, file_path string, line_start int, line_end int")
    assert [r.snippet for r in snippets(n, files).collect()] == ["def f():\n    return 1"]
    assert files.where("path = 'a/b.py'").select(comment_above(F.col("content"), F.lit(3))).first()[0] == "# one\n# two"


def test_phrases(spark):
    n = nodes(spark, module="m", **{"class": "m.K", "function": "m.f m.g", "method": "m.K.run", "parameter": "m.f.p"})
    g = PropertyGraph(n, edges(spark, "m.f>m.g m.K.run>m.g m.f>ext.x m.f>m.f.p:contains m>os:imports"))
    assert ids(ask(g, "Callers of m.g")) == ["m.K.run", "m.f"] and ids(ask(g, "callees of m.f")) == ["m.g"]
    assert ids(ask(g, "params of f")) == ["m.f.p"] and ids(ask(g, "external calls in m.f"), "target") == ["ext.x"]
    assert ids(ask(g, "methods")) == ["m.K.run", "m.f", "m.g"] and ids(ask(g, "classes in m")) == ["m.K"]
    assert ids(ask(g, "imports of m"), "target") == ["os"] and ids(ask(g, "RUN")) == ["m.K.run"] and ids(ask(g, "dead functions")) == []
    assert ids(ask(g, "callers of nobody here")) == []


SHAPES = '''
from typing import Optional
class Result:
    def describe(self): return "r"
class State:
    def activate(self): pass
class Engine:
    def __init__(self, state: State):
        self.state = state
    def run(self) -> Result:
        return Result()
class Fast(Engine):
    def boost(self): return self.run()
class Conn:
    def execute(self, q): pass
class Pool:
    async def __aenter__(self) -> "Conn": pass
    def each(self) -> list[Conn]: pass
class Failed(Exception):
    def explain(self): pass
def make():
    e = Fast(State())
    return e
'''
USES = '''
from shop.shapes import Engine, Fast as Quick, Pool, make, Failed, Optional
import shop.shapes as sh
def chained(engine: Engine):
    engine.state.activate()
def propagated():
    r = Quick(None).run()
    q = r
    q.describe()
    d = {}
    d.items()
def looped(engines: "list[Engine]", pool: Optional[Pool]):
    for e in engines:
        e.run()
    [x.run() for x in engines]
    for c in pool.each():
        c.execute("q")
async def entered():
    async with Pool() as conn:
        conn.execute("q")
    try:
        made = make()
        made.boost()
    except Failed as err:
        err.explain()
def walrus():
    if (w := make()):
        w.run()
    sh.make().boost()
def hidden(engine):
    engine.run()
class Left:
    def execute(self): pass
class Right:
    def execute(self): pass
class Diamond(Left, Right):
    def execute(self):
        super().execute()
        def inner():
            self.other()
        inner()
    def other(self): pass
def fact(n):
    return fact(n - 1)
'''
AGAIN = "from shop.uses import Engine as E\n__all__ = ['start', 'gone']\ndef start():\n    return E(None)\n"
FILES = "file_id bigint, path string, module string, content string, mtime timestamp_ntz"


def test_calls_resolve_by_types(spark):
    r = extract(spark.createDataFrame([(1, "shop/shapes.py", None, SHAPES, None), (2, "shop/uses.py", None, USES, None), (3, "shop/again.py", None, AGAIN, None)], FILES)).cache()
    n = symbols(r).cache()
    got = {(x.source.removeprefix("shop.uses."), x.target.removeprefix("shop.")) for x in relationships(r, n).where("edge_type = 'calls'").collect()}
    for pair in [
        ("chained", "shapes.State.activate"), ("propagated", "shapes.Result.describe"), ("looped", "shapes.Engine.run"), ("looped", "shapes.Conn.execute"), ("entered", "shapes.Conn.execute"),
        ("entered", "shapes.Fast.boost"), ("entered", "shapes.Failed.explain"), ("walrus", "shapes.Engine.run"), ("walrus", "shapes.Fast.boost"), ("Diamond.execute", "uses.Left.execute"),
        ("Diamond.execute", "uses.Diamond.execute.inner"), ("Diamond.execute.inner", "uses.Diamond.other"), ("shop.shapes.Fast.boost", "shapes.Engine.run"), ("shop.again.start", "shapes.Engine"), ("hidden", "engine.run"),
    ]:
        assert pair in got, (pair, sorted(got))
    assert not any(t.endswith("items") for _, t in got) and ("Diamond.execute", "uses.Right.execute") not in got
    reads = {(x.source, x.target) for x in r.where("kind = 'edge' and edge_type = 'reads'").collect()}
    assert not any(t in ("self", "super") or t.startswith("super.") for _, t in reads)
    assert ids(exported(r)) == ["shop.again.gone", "shop.again.start"]


def test_names_resolve_with_guards(spark):
    n = nodes(spark, **{"class": "a.m.K"}, module="a.m b.m", function="a.m.fact a.m.log b.m.log b.m.get a.m.near", method="a.m.K.log")
    e = edges(spark, "a.m.fact>fact a.m.fact>log b.m.near>log a.m.fact>get a.m.fact>unknown.log a.m.fact>K.log near>b.m.log near>unknown.log a.m.log>log")
    got = {(r.source, r.target): (r.resolved_source, r.resolved) for r in resolve_targets(e, n).collect()}
    assert got == {
        ("a.m.fact", "fact"): ("a.m.fact", "a.m.fact"), ("a.m.fact", "log"): ("a.m.fact", "a.m.log"), ("b.m.near", "log"): ("b.m.near", "b.m.log"), ("a.m.fact", "get"): ("a.m.fact", "get"),
        ("a.m.fact", "unknown.log"): ("a.m.fact", "unknown.log"), ("a.m.fact", "K.log"): ("a.m.fact", "a.m.K.log"), ("near", "b.m.log"): ("a.m.near", "b.m.log"), ("near", "unknown.log"): ("near", "unknown.log"), ("a.m.log", "log"): ("a.m.log", "a.m.K.log"),
    }
