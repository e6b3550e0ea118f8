from __future__ import annotations

import time

import pandas as pd
import pytest

from lorespan.operators import extract
from lorespan.operators.extract import symbols_of

BROKEN = """import os

@cached
def before(x):
    \'\'\'Said.\'\'\'
    return helper(x)

def broken(a, b:
    return other(a

class Kept:
    def method(self):
        return before(1)

def torn(:
    pass

async def after():
    "Later."
    return Kept()
"""


def test_a_python_file_with_errors_keeps_its_other_symbols():
    found = {s["name"]: s for s in symbols_of("a.py", BROKEN)}
    assert list(found) == ["before", "broken", "Kept", "method", "torn", "after"]
    assert found["before"]["docstring"] == "Said." and found["before"]["calls"] == ["helper"]
    assert (found["method"]["line_start"], found["method"]["line_end"], found["method"]["calls"]) == (12, 13, ["before"])
    assert found["after"]["docstring"] == "Later." and found["after"]["calls"] == ["Kept"] and found["after"]["line_end"] == 20
    assert found["broken"]["calls"] == ["other"] and found["broken"]["kind"] == "Function"


@pytest.mark.parametrize(
    ("path", "text", "names"),
    [
        ("a.rs", "fn one() { a(); }\nfn two( { b();\n}\nstruct S { x: u32 }\nfn three() { c(); }\n", ["one", "two", "S", "three"]),
        ("a.go", "func one() { a() }\nfunc two() { b()\n\nfunc three() { c() }\n", ["one", "two", "three"]),
        ("a.ts", "class A { m() { return f(1) } }\nfunction torn( { x }\nfunction last() { g() }\n", ["A", "m", "torn", "last"]),
    ],
)
def test_other_languages_with_errors_keep_their_other_symbols(path, text, names):
    assert [s["name"] for s in symbols_of(path, text)] == names


def test_expressions_of_any_depth():
    text = "def f():\n    return " + "+".join(["g(1)"] * 3000) + "\n"
    assert [s["name"] for s in symbols_of("a.py", text)] == ["f"]


@pytest.mark.parametrize("path", ["a.rs", "a.py", "a.ts"])
def test_work_is_in_proportion_to_the_file(path):
    one = {"a.rs": "/// Says.\npub fn f{0}(x: u32) -> u32 {{\n    g(x)\n}}\n\n", "a.py": "def f{0}(x):\n    return g(x)\n\n", "a.ts": "// Says.\nclass C{0} {{\n  m(a: string) {{ return g(a) }}\n}}\n"}[path]

    def seconds(n):
        text, best = "".join(one.format(i) for i in range(n)), 1e9
        for _ in range(3):
            began = time.process_time()
            found = len(symbols_of(path, text))
            best = min(best, time.process_time() - began)
        return found, best

    (few, short), (many, long) = seconds(1000), seconds(8000)
    assert many == 8 * few and long < 8 * 2.5 * short + 0.05


def test_rows_of_a_large_file_leave_in_parts():
    """the symbols of a batch's files are given in order, a bounded number of rows at a time."""
    text = "".join(f"fn f{i}() {{ g{i}() }}\n" for i in range(extract._ROWS + 10))
    batch = pd.DataFrame({"file_path": ["a.rs", None, "b.rs", "c.none"], "content": [text, "fn x() {}", "fn last() {}", "fn y() {}"]})
    parts = list(extract._extract(iter([batch])))
    assert [len(p) for p in parts] == [extract._ROWS, 10, 1]
    assert [n for p in parts for n in p["name"]] == [*(f"f{i}" for i in range(extract._ROWS + 10)), "last"] and parts[1]["seq"].iloc[-1] == extract._ROWS + 9
