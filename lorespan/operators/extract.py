"""Source text to symbols and calls, one row per symbol, for 15 language variants.

Python is parsed, and where a file has an error its top-level blocks are, one by one, so that the others keep their
symbols; a broken block has what its headers say. The other languages are scanned: comments and strings are blanked,
declarations found by each language's patterns, and bodies by brackets matched once for the file (Ruby: by the
indentation of ``end``). Lines are found by bisection and owners on a stack of open bodies, so the work on a file is in
proportion to its length. Every file is handled on its own, so the operator is one map over files.
"""

from __future__ import annotations

import ast
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorespan import functions as fn

C = F.col
SCHEMA = "file_path string, language string, seq int, kind string, name string, line_start int, line_end int, signature string, docstring string, checksum string, calls array<string>"
_ENDINGS = {e: name for name, endings in fn.LANGUAGES.items() for e in endings}
_BLOCK = r"/\*.*?\*/"
_QUOTED = r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\''
#: What is blanked before scanning.
_NOISE = {
    "rust": rf'//[^\n]*|{_BLOCK}|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\\n])\'',
    "go": rf"//[^\n]*|{_BLOCK}|`[^`]*`|{_QUOTED}",
    "ruby": rf"#[^\n]*|{_QUOTED}",
    "bash": rf"(?<!\S)#[^\n]*|{_QUOTED}",
    "php": rf"//[^\n]*|#[^\n]*|{_BLOCK}|{_QUOTED}",
}
_SCRIPT = rf"//[^\n]*|{_BLOCK}|`[^`]*`|{_QUOTED}"
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "function", "else", "new", "sizeof", "match", "loop", "do", "try", "using", "lock", "when", "await", "throw", "super", "defer", "range", "select", "case"}
_CALLERS = {"rust", "typescript", "tsx", "javascript", "jsx", "go", "c", "cpp", "python"}


def _rules(language: str) -> list[tuple[str, re.Pattern]]:
    """(kind, pattern with group ``name``); kinds starting with ``in `` need an enclosing type."""
    generics, params = r"(?:<[^{}()]*?>)?", r"\([^{};]*?\)"
    typed = r"(?:[\w.$]+(?:<[^{}();]*>)?(?:\[\])*\??\s+)"
    script = [
        ("Function", rf"(?:\basync\s+)?\bfunction\b\s*\*?\s*(?P<name>\w+)\s*{generics}\s*\("),
        ("Class", r"(?:\babstract\s+)?\bclass\s+(?P<name>\w+)"),
        ("Interface", r"\binterface\s+(?P<name>\w+)"),
        ("Type", r"\btype\s+(?P<name>\w+)\s*(?:<[^=;{}]*>)?\s*="),
        ("Enum", r"(?:\bconst\s+)?\benum\s+(?P<name>\w+)"),
        ("in Method", rf"^[ \t]*(?:(?:public|private|protected|static|async|get|set|override|readonly)\s+)*\*?(?P<name>[\w$#]+)\s*{generics}\s*{params}\s*(?::[^;{{}}]+)?(?=\{{)|(?<=\{{)[ \t]*(?P<name2>[\w$#]+)\s*{params}\s*(?::[^;{{}}]+)?(?=\{{)"),
    ]
    java = rf"(?:^|(?<=[;{{}}]))\s*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|synchronized|native|sealed|partial|default)\s+)*(?:<[^{{}}();]*>\s*)?{typed}(?P<name>\w+)\s*{params}\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])"
    table = {
        "rust": [
            ("Function", rf"(?:\bpub(?:\([^)]*\))?\s+)?(?:\b(?:async|const|unsafe)\s+|\bextern\s+)*\bfn\s+(?P<name>\w+)\s*{generics}\s*\("),
            ("Class", r"(?:\bpub(?:\([^)]*\))?\s+)?\bstruct\s+(?P<name>\w+)"),
            ("Enum", r"(?:\bpub(?:\([^)]*\))?\s+)?\benum\s+(?P<name>\w+)"),
            ("Interface", r"(?:\bpub(?:\([^)]*\))?\s+)?\btrait\s+(?P<name>\w+)"),
            ("Class", r"\b(?P<impl>impl)\b\s*(?:<[^{}]*?>\s*)?(?:[^{};]+?\s+for\s+)?(?P<name>[^{};\s][^{};]*?)\s*(?=\{|\bwhere\b)"),
            ("Type", r"(?:\bpub(?:\([^)]*\))?\s+)?\btype\s+(?P<name>\w+)"),
            ("Module", r"(?:\bpub(?:\([^)]*\))?\s+)?\bmod\s+(?P<name>\w+)"),
        ],
        "go": [
            ("Function", rf"^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*\("),
            ("Method", rf"^func\s*\([^)]*\)\s*(?P<name>\w+)\s*\("),
            ("Class", r"\b(?:type\s+)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s+struct\b"),
            ("Interface", r"\b(?:type\s+)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\s+interface\b"),
            ("Type", r"^type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)[\w\[\]*.(]"),
        ],
        "java": [("Class", r"\bclass\s+(?P<name>\w+)"), ("Interface", r"(?<!@)\binterface\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("in Method", java)],
        "csharp": [("Class", r"\b(?:class|struct)\s+(?P<name>\w+)"), ("Interface", r"\binterface\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)"), ("in Method", java)],
        "c": [
            ("Function", rf"^(?!\s*(?:else|return|typedef)\b)[ \t]*(?:[\w]+[\s*]+)+?\**(?P<name>\w+\s*{params})\s*(?=\{{)"),
            ("Class", r"\bstruct\s+(?P<name>\w+)(?=\s*\{)"), ("Enum", r"\benum\s+(?P<name>\w+)(?=\s*\{)"), ("Type", r"\btypedef\b[^;{}]*(?:\{[^{}]*\})?[^;{}]*?(?P<name>\w+)\s*(?=;)"),
        ],
        "cpp": [
            ("Function", rf"(?:^|(?<=[;{{}}]))[ \t]*(?!\s*(?:else|return|typedef|using)\b)(?:[\w:<>,&*~]+[\s*&]+)+?(?P<name>[\w:~]+\s*{params})\s*(?:const|noexcept|override)?\s*(?=\{{)"),
            ("Class", r"\b(?:class|struct)\s+(?P<name>\w+)(?=[^;(){}]*\{)"), ("Enum", r"\benum\s+(?:class\s+|struct\s+)?(?P<name>\w+)(?=[^;(){}]*\{)"),
        ],
        "ruby": [("Method", r"^[ \t]*def\s+(?:self\.)?(?P<name>[\w?!=\[\]+*<>-]+)"), ("Class", r"^[ \t]*class\s+(?P<name>[A-Z][\w:]*)"), ("Module", r"^[ \t]*module\s+(?P<name>[A-Z][\w:]*)")],
        "bash": [("Function", r"^[ \t]*(?:function\s+(?P<name>[\w-]+)\s*(?:\(\s*\))?|(?P<name2>[\w-]+)\s*\(\s*\))\s*(?=\{)")],
        "php": [
            ("Function", r"(?:\b(?:public|private|protected|static|final|abstract)\s+)*\bfunction\s+&?(?P<name>\w+)\s*\("),
            ("Class", r"(?:\b(?:abstract|final)\s+)*\bclass\s+(?P<name>\w+)"), ("Interface", r"\b(?:interface|trait)\s+(?P<name>\w+)"),
        ],
        "swift": [("Function", rf"\bfunc\s+(?P<name>\w+)\s*{generics}\s*\("), ("Class", r"\b(?:class|struct|actor)\s+(?!func\b)(?P<name>\w+)"), ("Interface", r"\bprotocol\s+(?P<name>\w+)"), ("Enum", r"\benum\s+(?P<name>\w+)")],
    }
    return [(k, re.compile(p, re.M)) for k, p in table.get(language, script if language in ("typescript", "tsx", "javascript", "jsx") else [])]


@dataclass
class Symbol:
    kind: str
    name: str
    start: int
    body: int
    end: int
    signature: str = ""
    docstring: str | None = None
    calls: list[str] = field(default_factory=list)


def _blanked(text: str, language: str) -> str:
    spaces = lambda m: re.sub(r"[^\n]", " ", m.group())
    return re.sub(_NOISE.get(language, _SCRIPT if language in ("typescript", "tsx", "javascript", "jsx") else rf"//[^\n]*|{_BLOCK}|{_QUOTED}"), spaces, text, flags=re.S)


def _brackets(clean: str) -> dict[int, int]:
    """The end of each body by the place of its opening bracket; one that is never closed reaches to the end."""
    ends, open_ = {}, []
    for m in re.finditer(r"[{}]", clean):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            ends[open_.pop()] = m.end()
    return ends


def _body(clean: str, at: int, language: str, ends: dict[int, int]) -> tuple[int, int]:
    """(start of the body or -1, end) of a declaration whose header's match ends at ``at``."""
    if language == "ruby":
        line = clean.rfind("\n", 0, at) + 1
        indent = re.compile(r"[ \t]*").match(clean, line).group()
        close = re.compile(rf"^{indent}end\b", re.M).search(clean, at)
        return clean.find("\n", at), close.end() if close else len(clean)
    before = at - 1
    while before >= 0 and clean[before].isspace():
        before -= 1
    depth = 1 if before >= 0 and clean[before] == "(" else 0
    for m in re.compile(r"[()\[\]{};]").finditer(clean, at):
        c = m.group()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == ";" and depth <= 0:
            return -1, m.end()
        elif c in "{}" and depth <= 0 or c == "}":  # a closing bracket ends even a header that lacks one of its own
            return (m.start(), ends.get(m.start(), len(clean))) if c == "{" else (-1, m.start())
    return -1, len(clean)


def _comment_before(text: str, start: int) -> str | None:
    """The comment lines that end right above a declaration."""
    end = text.rfind("\n", 0, start)  # of the line above

    def above() -> str:
        return text[text.rfind("\n", 0, end) + 1 : end]

    out: list[str] = []
    while end >= 0 and re.match(r"\s*(#\[|@\w)", above()):
        end = text.rfind("\n", 0, end)
    if end >= 0 and above().rstrip().endswith("*/"):
        while end >= 0:
            out.append(above())
            end = text.rfind("\n", 0, end)
            if "/*" in out[-1]:
                break
    else:
        while end >= 0 and re.match(r"\s*(///?|#(?!!))", above()):
            out.append(above())
            end = text.rfind("\n", 0, end)
    said = [re.sub(r"^\s*(///?!?|/\*\*?|\*/|\*(?!/)|#+)\s?|\s*\*/\s*$", "", x).strip() for x in reversed(out)]
    joined = "\n".join(x for x in said if x)
    return joined or None


_CALL = re.compile(r"(?<![\w$:])([A-Za-z_$][\w$]*(?:::[A-Za-z_$][\w$]*)*)\s*\(")


def _calls(clean: str, start: int, end: int, declared: set[int]) -> list[str]:
    """Names called in a range: what stands before a bracket, after the last dot; declarations are no calls."""
    return [m.group(1) for m in _CALL.finditer(clean, start, end) if m.start() not in declared and m.group(1) not in _NOT_NAMES]


def scan(text: str, language: str) -> list[Symbol]:
    clean, found, declared = _blanked(text, language), [], set()
    ends = _brackets(clean)
    for kind, pattern in _rules(language):
        for m in pattern.finditer(clean):
            groups = m.groupdict()
            name = groups.get("name") or groups.get("name2")
            declared.add(m.start("name") if groups.get("name") else m.start("name2"))
            if not name or (kind.startswith("in ") or language in ("c", "cpp")) and name.split("(")[0].strip() in _NOT_NAMES:
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            body, end = _body(clean, m.end(), language, ends)
            shown = "impl " + name.strip() if groups.get("impl") else re.sub(r"\s+", " ", text[m.start("name") : m.end("name")] if groups.get("name") else name)
            head = text[start:body].rstrip() if body > start else text[start:end].split("\n")[0]
            found.append(Symbol(kind, shown, start, body, end, head))
    kept: list[Symbol] = []
    open_: list[Symbol] = []
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        open_ = [t for t in open_ if t.end > s.start]
        around = [t for t in open_ if t.body < s.start and s.end <= t.end]
        if s.body >= 0:
            open_.append(s)
        owners = [t for t in around if t.kind in ("Class", "Interface", "Enum")]
        if s.kind.startswith("in "):
            # a method named like its type is a constructor
            if not owners or owners[-1].name == s.name or any(t.kind in ("Function", "Method", s.kind) for t in around):
                continue
            s.kind = s.kind[3:]
        elif language == "php" and s.kind == "Function" and owners:
            s.kind = "Method"
        if kept and kept[-1].start == s.start and kept[-1].name == s.name:
            continue
        s.docstring = None if language == "bash" else _comment_before(text, s.start)
        if language in _CALLERS and s.body >= 0 and s.kind != "Interface":
            s.calls = _calls(clean, s.body, s.end, declared)
        kept.append(s)
    return kept


def _called(func: ast.expr) -> str:
    """The last name of what is called."""
    return func.attr if isinstance(func, ast.Attribute) else func.id if isinstance(func, ast.Name) else ast.unparse(func).split(".")[-1]


def _parsed(text: str, at: int = 0) -> list[Symbol] | None:
    """Symbols of a part of a file that begins at ``at``; None where it does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = [0]
    for line in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    ascii_only = text.isascii()

    def place(line: int, column: int) -> int:
        if ascii_only:
            return starts[line - 1] + column
        return starts[line - 1] + len(text[starts[line - 1] : starts[line]].encode()[:column].decode(errors="ignore"))

    out: list[Symbol] = []
    waiting: list[ast.AST] = [tree]
    while waiting:  # in source order, however deep
        node = waiting.pop()
        waiting.extend(reversed(list(ast.iter_child_nodes(node))))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "Class" if isinstance(node, ast.ClassDef) else "Function"
            start, end = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
            body = place(node.body[0].lineno, node.body[0].col_offset)
            calls = [_called(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)]
            doc = ast.get_docstring(node)
            if node.decorator_list:
                above = place(node.decorator_list[0].lineno, 0)
                above = text.find("@", above)
                out.append(Symbol(kind, node.name, at + above, -1, at + end, text[above:end].split("\n")[0], doc, calls))
            out.append(Symbol(kind, node.name, at + start, at + body, at + end, text[start:body].rstrip(), doc, calls))
    return out


_BLOCK_START = re.compile(r"^(?=[^\s#)\]}'\"])(?!(?:else|elif|except|finally)\b)", re.M)
_HEADER = re.compile(r"^[ \t]*(?:async[ \t]+)?(?P<what>def|class)[ \t]+(?P<name>\w+)[^\n]*", re.M)
_PYTHON_NOISE = re.compile(r'"""(?:\\.|[^\\])*?"""|\'\'\'(?:\\.|[^\\])*?\'\'\'|#[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)


def _headers(text: str, at: int) -> list[Symbol]:
    """What the headers of a block that does not parse say, the last only if something follows it; a body ends before the next line that is indented no deeper."""
    clean = _PYTHON_NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    out, open_ = [], []
    for m in _HEADER.finditer(clean):
        if m.group().rstrip().endswith(":") and not clean[m.end() :].strip():
            continue
        start = m.end() - len(m.group().lstrip())
        open_.append(Symbol("Class" if m["what"] == "class" else "Function", m["name"], start, m.end(), len(text), text[start : m.end()].rstrip()))
    declared = {m.start("name") for m in _HEADER.finditer(clean)}
    for s in open_:
        indent = s.start - (clean.rfind("\n", 0, s.start) + 1)
        after = re.compile(rf"^[ \t]{{0,{indent}}}(?=[^\s)])", re.M).search(clean, s.body)
        s.end = after.start() if after else len(text)
        s.end = s.start + len(text[s.start : s.end].rstrip())
        s.calls = _calls(clean, min(s.body, s.end), s.end, declared)
        out.append(Symbol(s.kind, s.name, at + s.start, at + s.body, at + s.end, s.signature, None, s.calls))
    return out


def scan_python(text: str) -> list[Symbol]:
    """Functions and classes in source order; a decorated one comes twice, with and without its decorators.

    A file with an error is taken by its top-level blocks, decorators with what they decorate.
    """
    whole = _parsed(text)
    if whole is not None:
        return whole
    places, last = [], ""
    for m in _BLOCK_START.finditer(text):
        if last != "@":
            places.append(m.start())
        last = text[m.start()]
    out: list[Symbol] = []
    for a, b in zip(places, [*places[1:], len(text)], strict=True):
        found = _parsed(text[a:b], a)
        out += _headers(text[a:b], a) if found is None else found
    return out


def _each_symbol(path: str, text: str) -> Iterator[dict]:
    language = _ENDINGS.get(path.rsplit(".", 1)[-1]) if "." in path.rsplit("/", 1)[-1][1:] else None
    if language is None:
        return
    ends = array("q", (m.start() for m in re.finditer("\n", text)))
    for i, s in enumerate(scan_python(text) if language == "python" else scan(text, language)):
        first, last = (bisect_left(ends, x) + 1 for x in (s.start, s.end))
        yield {"file_path": path, "language": language, "seq": i, "kind": s.kind, "name": s.name, "line_start": first, "line_end": last, "signature": s.signature, "docstring": s.docstring, "checksum": hashlib.md5(text[s.start : s.end].encode()).hexdigest(), "calls": s.calls}


def symbols_of(path: str, text: str) -> list[dict]:
    """Symbols of one file; none for unknown endings."""
    return list(_each_symbol(path, text))


#: Symbols that a worker holds as rows at a time.
_ROWS = 4096


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        for path, text in zip(batch["file_path"], batch["content"], strict=True):
            found = _each_symbol(path, text) if path and text else iter(())
            while rows := list(islice(found, _ROWS)):
                yield pd.DataFrame(rows, columns=names)


def symbols(files: DataFrame) -> DataFrame:
    """files (file_path, content): one row per symbol. Null paths and contents and unknown languages give none."""
    return files.select("file_path", "content").mapInPandas(_extract, SCHEMA)


def index(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, raw edges): nodes with ids, skeletons and hashes; edges (from_id, to_name), the table of record.

    Resolved edges are derived from raw ones by a join, so that they come back when a missing symbol does.
    """
    found = symbols(files)
    ids = found.withColumns({"id": fn.node_id(C("file_path"), C("name"), C("signature")), "signature_hash": fn.signature_hash(C("signature")), "skeleton": F.concat_ws("\n", "signature", "docstring")})
    latest = F.row_number().over(Window.partitionBy("id").orderBy(C("seq").desc()))
    nodes = ids.withColumn("_l", latest).filter("_l = 1").drop("_l", "calls")
    return nodes, ids.select(C("id").alias("from_id"), F.explode("calls").alias("to_name"))


def resolved(raw: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_id, to_id, kind, weight, confidence): of several symbols with a name the last by file and place counts."""
    last = nodes.groupBy(C("name").alias("to_name")).agg(F.max_by("id", F.struct("file_path", "seq")).alias("to_id"))
    pairs = raw.join(last, "to_name").select("from_id", "to_id").distinct()
    return pairs.select("from_id", "to_id", F.lit("Calls").alias("kind"), F.lit(1.0).alias("weight"), F.lit("heuristic").alias("confidence"))
