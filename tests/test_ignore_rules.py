from __future__ import annotations

from lorespan.sources import source_files

ROOT = "# made by tools\n\n*.gen.py\n!keep.gen.py\n/top.py\nout/\nlogs/**\n!logs/kept.py\nlib/*/old.py\n\\!odd.py\n[ab]x.py\n"
FILES = {
    "a.gen.py": False, "keep.gen.py": True, "deep/er/b.gen.py": False, "deep/keep.gen.py": True,
    "top.py": False, "deep/top.py": True, "out/c.py": False, "deep/out/d.py": False, "outer/out.py": True,
    "logs/e.py": False, "logs/kept.py": True, "logs/sub/f.py": False, "lib/x/old.py": False, "lib/old.py": True, "lib/x/y/old.py": True,
    "!odd.py": False, "ax.py": False, "cx.py": True,
    "sub/g.py": False, "sub/special.py": True, "sub/in/h.gen.py": True, "sub/in/g.py": False, "out/keep.gen.py": False,
}


def test_rules_in_order_with_exceptions_and_nested_files(spark, tmp_path):
    """The last match wins, inner files come after outer ones, and nothing below an ignored folder comes back."""
    for name in FILES:
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x = 1\n")
    (tmp_path / "tree/.gitignore").write_text(ROOT)
    (tmp_path / "tree/sub/.gitignore").write_text("g.py\n")
    (tmp_path / "tree/sub/in/.gitignore").write_text("!*.gen.py\n")
    (tmp_path / "tree/out/.gitignore").write_text("!*\n")
    root = str(tmp_path / "tree")
    found = {r["file_path"].split("/tree/")[1] for r in source_files(spark, root).select("file_path").collect()}
    assert found == {name for name, kept in FILES.items() if kept}
    fewer = {r["file_path"].split("/tree/")[1] for r in source_files(spark, root, ["special.py", "lib/"]).select("file_path").collect()}
    assert fewer == {name for name, kept in FILES.items() if kept and name != "sub/special.py" and not name.startswith("lib/")}
