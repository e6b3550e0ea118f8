"""Small documents with every awkward case, and the rules of the contracts in plain Python."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that an operator might use itself.
CLASH = ("k", "t", "key", "copy", "gone", "h", "word_", "component", "node", "x", "y")


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice(['', '.', ',', 'é'])}" for _ in range(n))


def edited(rng: random.Random, text: str, share: float) -> str:
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty, short and long texts, ties, copies, near copies, passages."""
    rng = random.Random(seed)
    passage, base = prose(rng, 70), prose(rng, 160)
    texts: list[str | None] = [None, "", "   \n\t ", "one", "one two", "one  two", "ONE two", "a b 　c", "\n\n#*$\n\n#*$\n", "<|endoftext|> and <|endoftext|>", "x" * 3000, "the " * 800, prose(rng, 3000)]
    for i in range(n):
        kind = i % 6
        texts.append([prose(rng, rng.randrange(1, 150)), base, edited(rng, base, 0.01), edited(rng, base, 0.03), prose(rng, 30) + "\n" + passage + " " + prose(rng, 20), passage][kind])
    texts += [base.upper(), base.replace(" ", "\n"), "line one\nline one\nline two\n\n line one\nline one"]
    order = [*range(len(texts))]
    rng.shuffle(order)
    return [(d * 3 + 1, texts[i], ["en", "fr", None][i % 3], f"s{i % 2}", len(texts[i] or "")) for d, i in enumerate(order)]


def frame(spark, rows=None, clash: bool = False):
    """The awkward documents, a repeated row and a null id; with ``clash`` also columns named as operators might."""
    rows = awkward() if rows is None else rows
    extra = [rows[5], (None, "a null id has text", "en", "s0", 18)] if rows else []
    out = spark.createDataFrame([*rows, *extra], SCHEMA).repartition(3)
    if clash:
        from pyspark.sql import functions as F

        out = out.withColumns({c: F.lit(7) for c in CLASH})
    return out


def shingles(text: str | None, size: int) -> frozenset:
    w = BLANK.findall((text or "").translate(LOWER))
    if len(w) >= size:
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def components(sets: dict[int, frozenset], num: int, den: int) -> dict[int, int]:
    root = {k: k for k in sets}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in ids}


def gone_words(rows: list[tuple[int, str]], window: int = 50) -> dict[int, tuple[list[str], list[bool]]]:
    """By id: words, and which are covered by a window that starts in a document of smaller id."""
    first: dict[tuple, int] = {}
    out = {}
    for k, text in sorted(rows):
        w = BLANK.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), k) < k:
                gone[i : i + window] = [True] * window
        out[k] = w, gone
    return out
