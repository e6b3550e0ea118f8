"""Quality by weak supervision: rules vote good, bad or abstain; EM weighs them; a posterior decides.

The rules' measures come from whole texts. A vote pattern has one of 3**rules codes, so the corpus is
pre-aggregated to pattern counts; expectation-maximisation runs on those counts (all documents, a bounded
number of values), and the posteriors go back as a broadcast table of the same size.

Rules do not fail independently: a kind of junk trips some rules together and leaves others alone. The label
model therefore has one class of good documents and one class of junk for each rule, which begins as the junk
that the rule was written for; within a class votes are independent, and every rate is estimated. A bad vote
that comes alone is then explained by the rule's own error among good documents if that is likelier.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm import text as T
from lorespan.llm.store import settle

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_blank_words", "n_ended_lines")
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: What ends a sentence, also before a closing quotation mark (the last byte of a curly one).
_TERMINAL = np.zeros(256, bool)
_TERMINAL[[*b".!?\"", 0x9D]] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets])


def repeat_words(words: T.Words, size: int = 3) -> np.ndarray:
    """By text: words inside a window of ``size`` words that the text holds twice or more."""
    whole = T.whole_window(words, size)
    at = np.flatnonzero(whole)
    counts = np.zeros(len(words.counts), np.int64)
    if not len(at):
        return counts
    of = words.text_of()
    key = T.mix(T.windows(words.hashes(), size)[at] + of[at].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, which, times = np.unique(key, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    hit = at[times[which] > 1]
    np.add.at(edges, hit, 1)
    np.add.at(edges, hit + size, -1)
    covered = np.cumsum(edges[:-1]) > 0
    return np.bincount(of[covered], minlength=len(counts))


def line_counts(raw: np.ndarray, offsets: np.ndarray, words: T.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By text, of lines with a word: those that equal an earlier line, all, and those whose last word ends a sentence."""
    lines = T.Words(raw, offsets, _LINE)
    before = np.searchsorted(words.starts, lines.ends)  # words up to each line's end
    real = before > np.searchsorted(words.starts, lines.starts)
    of = lines.text_of()[real]
    key = T.mix(lines.hashes()[real] + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    n = len(offsets) - 1
    total = np.bincount(of, minlength=n)
    _, first = np.unique(key, return_index=True)
    ended = _TERMINAL[raw[words.ends[before[real] - 1] - 1]]
    return total - np.bincount(of[first], minlength=n), total, np.bincount(of[ended], minlength=n)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, raw, offsets in T.slices(batches, "t"):
        words = T.Words(raw, offsets, T.BLANK_SEPARATED)
        dup, lines, ended = line_counts(raw, offsets, words)
        in_word = T.BLANK_SEPARATED[raw]
        letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(_LETTER[raw], out=letters[1:])
        no_letter = letters[words.ends] == letters[words.starts]
        columns = [
            words.counts,
            _per_text(in_word & T.code_points(raw), offsets),
            _per_text(_SYMBOL[raw], offsets),
            dup,
            repeat_words(words),
            lines,
            _per_text(_UPPER[raw], offsets),
            _per_text(_LETTER[raw] & T.code_points(raw), offsets),
            np.bincount(words.text_of()[no_letter], minlength=len(words.counts)),
            ended,
        ]
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *MEASURES])


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the rules' measures of each text; null and empty texts have zeros."""
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return T.mapped(rows, _measure, ", ".join([f"doc_id {kind}", *(f"{m} long" for m in MEASURES)]))


def _vote(good: Column | None, bad: Column) -> Column:
    """2 good, 0 bad, 1 abstain; bad wins over good and nulls abstain. Without ``good`` a rule never votes so."""
    vote = F.when(bad, 0)
    return (vote if good is None else vote.when(good, 2)).otherwise(1)


def votes() -> dict[str, Column]:
    """Each rule's vote on the measures. Ratios are compared as products, so no text divides by zero.

    The rules named ``mostly_`` are the strict forms of others, for texts of hardly anything else: where both vote
    bad they support each other, while a text that only just fails a rule has one bad vote.
    """
    c = F.col
    return {
        "length": _vote(c("n_words") >= 80, c("n_words") < 50),
        "word_length": _vote((c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 10 * c("n_words")) & (c("n_words") > 0), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words"))),
        "symbols": _vote(20 * c("n_symbols") <= c("n_words"), 10 * c("n_symbols") > 3 * c("n_words")),
        "lines": _vote(20 * c("n_dup_lines") <= c("n_lines"), 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repetition": _vote(10 * c("n_repeat_words") <= 2 * c("n_words"), 2 * c("n_repeat_words") > c("n_words")),
        "case": _vote(10 * c("n_upper") <= c("n_letters"), 2 * c("n_upper") > c("n_letters")),
        "letters": _vote(10 * c("n_blank_words") <= c("n_words"), 10 * c("n_blank_words") > 3 * c("n_words")),
        "spelling": _vote(20 * c("n_letters") >= 17 * c("word_chars"), 10 * c("n_letters") < 7 * c("word_chars")),
        "endings": _vote(10 * c("n_ended_lines") >= 5 * c("n_lines"), 10 * c("n_ended_lines") < c("n_lines")),
        "mostly_symbols": _vote(None, c("n_symbols") > c("n_words")),
        "mostly_repeated_lines": _vote(None, 10 * c("n_dup_lines") > 7 * c("n_lines")),
        "mostly_capitals": _vote(None, 10 * c("n_upper") > 7 * c("n_letters")),
        "mostly_letterless": _vote(None, 10 * c("n_blank_words") > 7 * c("n_words")),
    }


#: Where the estimation starts: how often a rule votes bad on good documents (or as often as over all, if that is more: such
#: a rule tells little) and on the junk it is meant for, and the share of good ones.
START_GOOD, START_JUNK, START_SHARE = 0.1, 0.8, 0.7


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, settled: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """(share of each class, probabilities[class, rule, vote]) by EM on distinct patterns of votes 0, 1, 2.

    Class 0 is good; class 1 + j is a kind of junk that at first only rule j tells from any document.
    Rounds end when no posterior moves by more than ``settled``. Every estimate has one pseudo-count, so no
    probability is zero and a kind of junk that does not occur fades to nothing.
    """
    rules = patterns.shape[1]
    one_hot = (patterns[:, :, None] == np.arange(3)).astype(float)
    share = np.array([START_SHARE, *[(1 - START_SHARE) / rules] * rules])
    overall = (np.einsum("p,prv->rv", counts, one_hot) + 1 / 3) / (counts.sum() + 1)
    p = np.tile(overall, (1 + rules, 1, 1))
    for c, r, bad in [*((0, r, max(START_GOOD, overall[r, 0])) for r in range(rules)), *((1 + r, r, START_JUNK) for r in range(rules))]:
        p[c, r] = [bad, *(1 - bad) * overall[r, 1:] / overall[r, 1:].sum()]
    before = np.zeros((len(patterns), 1 + rules))
    for _ in range(rounds):
        classes = class_posteriors(patterns, share, p)
        weights = classes * counts[:, None]
        share = (weights.sum(axis=0) + 1) / (counts.sum() + 1 + rules)
        soft = np.einsum("pc,prv->crv", weights, one_hot) + 1 / 3
        p = soft / soft.sum(axis=2, keepdims=True)
        if len(patterns) == 0 or np.abs(classes - before).max() <= settled:
            break
        before = classes
    return share, p


def class_posteriors(patterns: np.ndarray, share: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Probability of each class (columns) given each pattern (rows)."""
    rules = np.arange(patterns.shape[1])
    logs = np.log(share) + np.stack([np.log(own[rules, patterns]).sum(axis=1) for own in p], axis=1)
    odds = np.exp(logs - logs.max(axis=1, keepdims=True))
    return odds / odds.sum(axis=1, keepdims=True)


def judge(docs: DataFrame, min_posterior: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: measures, base verdict, the votes' code, ``quality`` (posterior of the good class) and ``kept``.

    base_failed: under 50 words, or more than half of the words in repeated three-word windows; such a
    document is never kept. The model is fitted to the votes of all documents. Null text counts as empty
    (base_failed); repeated rows stay and count each; other columns are left out; an empty table gives no rows.
    """
    rules = votes()
    code = sum((v * 3**k for k, v in enumerate(rules.values())), F.lit(0))
    rows = settle(measures(docs, id_col, text_col).withColumn("votes", code.cast("int")))
    counted = rows.groupBy("votes").count().orderBy("votes").toArrow()  # of 3**rules patterns, those that occur
    codes, counts = (counted.column(x).to_numpy() for x in ("votes", "count"))
    patterns = codes[:, None] // 3 ** np.arange(len(rules)) % 3
    good = class_posteriors(patterns, *fit_label_model(patterns, counts.astype(float)))[:, 0]
    table = docs.sparkSession.createDataFrame(pa.table({"votes": codes, "quality": good}))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = rows.join(F.broadcast(table), "votes").withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= min_posterior))
