"""Class orders against Python's own, and member lookup."""

import random

from pyspark.sql import functions as F

from weftline.operators import members


def test_orders_equal_pythons_own(spark):
    r = random.Random(3)
    texts, want = [], {}
    for f in range(12):
        lines, names = [], []
        for i in range(14):
            bases = r.sample(names, min(len(names), r.choice([0, 1, 1, 2, 3])))
            lines.append(f"class K{i}({', '.join(bases)}): pass")
            scope: dict = {}
            try:
                exec("\n".join(lines), scope)
            except TypeError:
                want[f"f{f}.py", f"K{i}"] = None  # no consistent order: what inherits from it is not tried in Python
                lines.pop()
                texts.append((f"f{f}.py", f"class K{i}({', '.join(bases)}): pass"))
                continue
            names.append(f"K{i}")
            want[f"f{f}.py", f"K{i}"] = [f"f{f}.py:{c.__name__}" for c in scope[f"K{i}"].__mro__[:-1]]
        texts.append((f"f{f}.py", "\n".join(lines)))
    by: dict[str, str] = {}
    for p, t in texts:
        by[p] = by.get(p, "") + t + "\n"
    files = spark.createDataFrame(list(by.items()), "path string, content string")
    got = {(x.path, x["class"]): (x.mro, x.status) for x in members.orders(members.classes(files), files).collect()}
    assert any(v is None for v in want.values())
    assert got == {k: (v, "ok") if v else ([f"{k[0]}:{k[1]}"], "conflict") for k, v in want.items()}


def test_bases_across_files_cycles_and_lookup(spark):
    files = [
        ("pkg/__init__.py", "from .base import Base as Root"),
        ("pkg/base.py", "class Base:\n    def go(self): pass\n    def __init__(self):\n        self.size = 1\n        self.x.y = 2\n    class Inner: pass"),
        ("pkg/mid.py", "from . import base\nfrom .base import Base as B\nimport pkg.base\nclass A(base.Base): pass\nclass C(B, Generic[int]):\n    def own(self): pass\nclass D(pkg.base.Base.Inner): pass\nclass E(A, C): pass\nclass F(call()): pass"),
        ("loop.py", "class P(Q): pass\nclass Q(P): pass\nclass R(P): pass\nclass S(S): pass"),
        ("bad.py", "class ("),
    ]
    f = spark.createDataFrame(files, "path string, content string")
    found = members.classes(f)
    orders = members.orders(found, f)
    got = {(r.path, r["class"]): (r.mro, r.status) for r in orders.collect()}
    assert got["pkg/mid.py", "E"] == (["pkg/mid.py:E", "pkg/mid.py:A", "pkg/mid.py:C", "pkg/base.py:Base", "Generic"], "ok")
    assert got["pkg/mid.py", "D"][0] == ["pkg/mid.py:D", "pkg/base.py:Base.Inner"] and got["pkg/mid.py", "F"][0] == ["pkg/mid.py:F"]
    assert {k: v for k, v in got.items() if k[0] == "loop.py"} == {("loop.py", c): ([f"loop.py:{c}"], "cycle") for c in "PQRS"}
    refs = [("pkg/mid.py", "E", "own"), ("pkg/mid.py", "E", "size"), ("pkg/mid.py", "E", "y"), ("pkg/mid.py", "D", "any"), ("pkg/mid.py", "No", "x"), ("pkg/base.py", "Base", "go")]
    told = {(r.path, r["class"], r.member): (r.status, r.owner) for r in members.lookup(spark.createDataFrame(refs, "path string, class string, member string"), found, orders).collect()}
    assert [told[x] for x in refs] == [("member", "pkg/mid.py:C"), ("member", "pkg/base.py:Base"), ("absent", None), ("assumed", None), ("no class", None), ("member", "pkg/base.py:Base")]
    row = orders.where("class = 'E'").select(members.inherits_from(F.array(F.lit("A")), F.col("mro"), "GENERIC").alias("a"), members.inherits_from(F.array(F.lit("A")), F.col("mro"), "zzz").alias("b")).first()
    assert row.a and not row.b


def test_no_classes(spark):
    f = spark.createDataFrame([("a.py", "x = 1")], "path string, content string")
    assert members.orders(members.classes(f), f).count() == 0
