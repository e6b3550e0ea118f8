"""Scalar functions of the engine, as column expressions."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters with diacritics and what they fold to.
FOLD_FROM = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
FOLD_TO = "aaaaaaeeeeiiiiooooouuuuncyy"
#: File extensions by language.
LANGUAGES = {
    "rust": ("rs",), "python": ("py", "pyi"), "typescript": ("ts",), "tsx": ("tsx",), "javascript": ("js", "mjs", "cjs"), "jsx": ("jsx",),
    "go": ("go",), "java": ("java",), "csharp": ("cs",), "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"), "ruby": ("rb",),
    "bash": ("sh", "bash"), "php": ("php",), "swift": ("swift",),
}
#: What the search syntax gives a meaning to.
SEARCH_SYNTAX = "\"'()*+-:^{}"


def extension(path: Column) -> Column:
    """What follows the last dot of the last path part; null without one, or if the dot comes first."""
    found = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.when(found != "", found)


def language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for name, endings in LANGUAGES.items() for e in endings for x in (e, name)])
    return F.try_element_at(table, extension(path))


def route(path: Column) -> Column:
    """doc, code or skip."""
    return F.when(extension(path).isin("md", "markdown"), "doc").when(language(path).isNotNull(), "code").otherwise("skip")


def token_estimate(text: Column) -> Column:
    """A quarter of the UTF-8 bytes."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def node_id(path: Column, name: Column, signature: Column) -> Column:
    return F.md5(F.concat_ws("\x00", path, name, signature))


def signature_hash(signature: Column) -> Column:
    return F.substring(F.md5(collapse(signature)), 1, 8)


def note_hash(anchor_type: Column, anchor_value: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.sha2(F.concat_ws("|", F.coalesce(anchor_type, empty), F.coalesce(anchor_value, empty), F.lower(collapse(text))), 256)


def identifier_words(name: Column) -> Column:
    """``getUserById`` becomes ``getUserById get user by id``; a name of one part stays as it is."""
    apart = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.filter(F.split(F.lower(F.regexp_replace(apart, r"[^A-Za-z0-9]+", " ")), " "), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.concat_ws(" ", name, F.array_join(parts, " "))).otherwise(name)


def sanitise(query: Column) -> Column:
    """The search syntax's characters become spaces, and spaces are collapsed."""
    return F.trim(F.regexp_replace(F.translate(query, SEARCH_SYNTAX, " " * len(SEARCH_SYNTAX)), r"\s+", " "))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits, diacritics folded."""
    return F.regexp_extract_all(F.translate(F.lower(text), FOLD_FROM, FOLD_TO), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_test_path(path: Column) -> Column:
    return F.lower(path).rlike("test|spec")


def is_node_id(value: Column) -> Column:
    return value.rlike("^[0-9a-fA-F]{32}$")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def recency(at: Column, as_of: Column) -> Column:
    """exp(-0.01 * hours); the future counts as now."""
    return F.exp(F.greatest(F.lit(0.0), (as_of - at) / F.lit(3600.0)) * F.lit(-0.01))


def normalised_levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.try_divide(F.levenshtein(a, b).cast("double"), longest))


def jaccard(a: Column, b: Column) -> Column:
    """0 if both arrays are empty."""
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def nearest_rank(values: Column, percent: float) -> Column:
    """The value at round(percent / 100 * (n - 1)) of a sorted array; 0 if empty."""
    place = F.round(F.lit(percent / 100) * (F.size(values) - 1)).cast("int") + 1
    return F.when(F.size(values) == 0, F.lit(0.0)).otherwise(F.try_element_at(values, place))


def one_star_glob(value: Column, pattern: str) -> Column:
    """A glob with at most one ``*``."""
    head, star, tail = pattern.partition("*")
    if not star:
        return value == pattern
    return value.startswith(head) & value.endswith(tail) & (F.length(value) >= len(head) + len(tail))


def is_ignored(path: Column, pattern: str) -> Column:
    """Whether a path has a part, or a run of parts, that an ignore pattern names; ``*`` stays within a part, ``**`` does not."""
    inner = pattern.strip().strip("/")
    star = {"**/": "(.*/)?", "/**": "(/.*)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    text = re.sub(r"\*\*/|/\*\*|\*\*|\*|\?|[^*?/]+|/", lambda m: star.get(m.group(), re.escape(m.group())), inner)
    return path.rlike(f"(^|/){text}(/|$)")


def ignore_rule(line: str, base: str = "") -> tuple[str, bool, bool] | None:
    """(pattern of a path below the root, exception, folders only) of a line of the ignore file in the folder ``base``.

    None for comments and blank lines. A rule with a slash, but at its end, holds from its folder on, another at any depth
    below; ``*`` and ``?`` stay within a part of the path, ``**`` spans parts, ``[...]`` is one character of a set.
    """
    text = re.sub(r"(?<!\\\\) +$", "", line.rstrip("\r\n"))
    if not text or text[0] == "#":
        return None
    exception = text[0] == "!"
    text = text[1:] if exception else text[1:] if text[:2] in ("\\#", "\\!") else text
    folder, inner = text.endswith("/"), text.strip("/")
    if not inner:
        return None
    star = {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    one = lambda m: star.get(m.group()) or (f"[{m.group()[1:-1].replace('!', '^', 1) if m.group()[1] == '!' else m.group()[1:-1]}]" if m.group()[0] == "[" else re.escape(m.group()))
    pattern = re.sub(r"\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]/]+\]|[^*?/\[]+|/|\[", one, inner)
    head = re.escape(base.strip("/") + "/") if base.strip("/") else ""
    anywhere = "" if "/" in text.rstrip("/") else "(?:.*/)?"
    return f"^{head}{anywhere}{pattern}$", exception, folder


def ignored_by(path: Column, rules: list[tuple[str, bool, bool]]) -> Column:
    """Whether a file's path below the root is ignored by rules in order: of those that match the last one counts, and what is
    below an ignored folder is ignored whatever exceptions say."""
    parts = F.split(path, "/")
    whole = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("p"), (i < F.size(parts)).alias("folder")))

    def verdict(x: Column) -> Column:
        out = F.lit(False)
        for pattern, exception, folder in rules:
            out = F.when(x["p"].rlike(pattern) & (x["folder"] if folder else F.lit(True)), F.lit(not exception)).otherwise(out)
        return out

    return F.exists(whole, verdict) if rules else F.lit(False)


def branch_name(name: Column) -> Column:
    """Characters that file names do not take become underscores."""
    return F.regexp_replace(name, r'[/\\:*?"<>|]', "_")


#: Pairs compared at once, so that the arrays of a batch stay small.
PAIRS = 4096


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a row each, 0 after a text's end; lengths)."""
    lengths = np.array([len(x) for x in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.uint32)
    inside = np.arange(out.shape[1]) < lengths[:, None]
    out[inside] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, lengths


def jaro_winkler_pairs(a: list[str], b: list[str]) -> np.ndarray:
    """Similarity of each pair; a prefix of up to four characters counts where the Jaro similarity is over 0.7.

    All pairs go together, one character of the left texts at a time: it takes the first free equal character of
    the right text within reach.
    """
    (x, n), (y, m) = _codes(a), _codes(b)
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    place = np.arange(y.shape[1])
    taken, matched = np.zeros(y.shape, bool), np.zeros(x.shape, bool)
    for i in range(x.shape[1]):
        rows = np.flatnonzero(n > i)
        near = np.abs(place - i) <= reach[rows, None]
        free = (y[rows] == x[rows, i : i + 1]) & near & ~taken[rows] & (place < m[rows, None])
        hit = free.any(axis=1)
        taken[rows[hit], free[hit].argmax(axis=1)] = True
        matched[rows[hit], i] = True
    found = matched.sum(axis=1)
    # the matched characters of either side in order: the k-th of one against the k-th of the other
    of = np.repeat(np.arange(len(n)), found)
    unlike = np.bincount(of[x[matched] != y[taken]], minlength=len(n)) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(found > 0, (found / n + found / m + (found - unlike) / found) / 3, 0.0)
    jaro = np.where((n == 0) & (m == 0), 1.0, jaro)
    width = min(4, x.shape[1], y.shape[1])
    equal = (x[:, :width] == y[:, :width]) & (np.arange(width) < np.minimum(n, m)[:, None])
    same = np.cumprod(equal, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * same * (1 - jaro), jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of each distinct pair of a batch, once; null where either is null."""
    out = pd.Series(np.nan, index=a.index, dtype="float64")
    known = a.notna() & b.notna()
    if not known.any():
        return out.where(known, None)
    pairs = pd.MultiIndex.from_arrays([a[known], b[known]])
    number, distinct = pairs.factorize()
    left, right = distinct.get_level_values(0).tolist(), distinct.get_level_values(1).tolist()
    parts = [jaro_winkler_pairs(left[i : i + PAIRS], right[i : i + PAIRS]) for i in range(0, len(left), PAIRS)]
    out[known] = np.concatenate(parts)[number]
    return out.where(known, None)
