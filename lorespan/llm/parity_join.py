"""N-gram Jaccard self-join by parity sketches, up to connected components.

A document's set of word shingles is XOR-hashed into a bit sketch: each shingle flips one bit, so two
sketches differ in at most as many bits as the sets' symmetric difference has members. Sets of similar size
(a size band) share a sketch of so many blocks that a pair at the threshold, whose difference is at most D,
leaves blocks untouched. Untouched blocks hold the same shingles in both documents; a block's key also
carries the XOR of its shingles' 64-bit hashes and their number. Whatever fixed order keys have, a pair at
the threshold has a common one among the first D + 1 of each document's keys (prefix argument). That is
used twice:

1. blocks with most shingles first: D + 1 keys of every document meet, and documents that share none are done;
2. for the others, all their blocks' keys, rarest first. Keys of one document only come before the others,
   so a document with more than D of those is done, as is nearly every one that shares a mere passage.

Members of a key are never paired with each other at once. Equal member sets under many keys are kept once; each
document is verified against the key's smallest member, components are formed, and only keys whose members still
lie in different components stay open. Those of few members are paired; the members of the others (boilerplate that
many unlike documents share) are dealt again by single shingles of theirs, rarest first: a pair at the threshold
meets under the first shingle that both have, and the shingles before it are differences, so members that come too
late in the order to be within D of any other member go. Pairs of different components are compared first, inside
the join, by the Hamming distance of their sketches, which leaves few others than links, then by their sets. Every
linked pair is thus either verified or joined already by other links.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorespan.llm import text as T
from lorespan.llm.components import connected_components
from lorespan.llm.store import discard, settle, split_by_ids
from lorespan.llm.substrings import exact_copies, without_copies

#: 64-bit words of the sketch that is compared bit by bit.
SKETCH_WORDS = 16
#: Open members of a key up to which they are paired without being dealt again.
FEW = 16
_U = np.uint64


@dataclass(frozen=True)
class Similarity:
    """Shingles of ``shingle`` words; linked at intersection / union >= num / den. ``growth``: size ratio of a band."""

    shingle: int = 5
    num: int = 8
    den: int = 10
    growth: float = 1.5
    slack: float = 1.2

    def __post_init__(self):
        if not 0 < self.num <= self.den or self.shingle < 1 or self.growth * self.num < self.den:
            raise ValueError("0 < num <= den, shingle >= 1 and growth >= den / num are needed")

    def most_difference(self, size: np.ndarray) -> np.ndarray:
        """Largest symmetric difference of a set of this size with any set linked to it."""
        return (size + size * self.den // self.num) * (self.den - self.num) // (self.den + self.num)

    def bands(self, largest: int) -> np.ndarray:
        """First size of each band, up to one beyond ``largest``."""
        out = [1]
        while out[-1] <= largest:
            out.append(max(out[-1] + 1, int(np.ceil(out[-1] * self.growth))))
        return np.array([*out, int(np.ceil(out[-1] * self.growth)) + 1])


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes text after text, number of each text).

    A text of fewer words than a shingle has its whole sequence as one; one without words has none.
    """
    words = T.Words(raw, offsets, T.BLANK_SEPARATED, lower=True)
    hashes = words.hashes()
    grams = T.windows(hashes, size)
    out, counts = [], np.zeros(len(words.counts), np.int64)
    for d, n in enumerate(words.counts.tolist()):
        a = words.first[d]
        if n >= size:
            own = np.sort(grams[a : a + n - size + 1])
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n:
            own = T.windows(hashes[a : a + n], n, seed=100 + n)
        else:
            continue
        out.append(own)
        counts[d] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, _U)), counts


@dataclass
class Keys:
    """One entry a key: its text, the group of bands it is for, and the document's D and blocks in that group."""

    key: np.ndarray
    text: np.ndarray
    group: np.ndarray
    most: np.ndarray
    blocks: np.ndarray


def block_keys(tokens: np.ndarray, counts: np.ndarray, like: Similarity, every: bool = False) -> Keys:
    """Keys of sets given one after another: of the D + 1 fullest blocks, or of every block.

    A group is named by the smaller document's band, so a document belongs to its own band's group and, if
    smaller linked documents may lie in the band below, to that one's.
    """
    parts = [[np.zeros(0, _U)], *([np.zeros(0, np.int64)] for _ in range(4))]
    bands = like.bands(int(counts.max(initial=0)))
    top = np.searchsorted(bands, counts, "right") - 1
    low = np.searchsorted(bands, -(-counts * like.num // like.den), "right") - 1
    spot = T.mix(tokens ^ _U(0x5851F42D4C957F2D)) >> _U(32)
    of = np.repeat(np.arange(len(counts)), counts)
    for group, chosen in ((top, counts > 0), (low, (counts > 0) & (low < top))):
        own = np.flatnonzero(chosen)
        if not len(own):
            continue
        most = like.most_difference(bands[group[own] + 1] - 1)
        allowed = np.minimum(like.most_difference(counts[own]), most)
        blocks = np.ceil(like.slack * (most + 1)).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(blocks)])
        place = np.full(len(counts), -1)
        place[own] = np.arange(len(own))
        mine = np.flatnonzero(chosen[of])
        p = place[of[mine]]
        at = base[p] + ((spot[mine] * blocks[p].astype(_U)) >> _U(32)).astype(np.int64)
        word, held = np.zeros(base[-1], _U), np.bincount(at, minlength=base[-1])
        np.bitwise_xor.at(word, at, tokens[mine])
        of_block = np.repeat(np.arange(len(own)), blocks)
        number = np.arange(base[-1]) - base[of_block]
        b = np.arange(base[-1])
        if not every:
            b = np.argsort((of_block << 39) | ((0x7FFF - np.minimum(held, 0x7FFF)) << 24) | number)
            b = b[np.arange(base[-1]) - base[of_block] <= allowed[of_block]]
        label = (number[b] + (group[own][of_block[b]] << 40)).astype(_U) * _U(0x9E3779B97F4A7C15) + held[b].astype(_U)
        found = T.mix(word[b] ^ T.mix(label)), own[of_block[b]], group[own][of_block[b]], allowed[of_block[b]], blocks[of_block[b]]
        for part, x in zip(parts, found, strict=True):
            part.append(x)
    return Keys(*map(np.concatenate, parts))


def sketches(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A parity sketch of 64 * SKETCH_WORDS bits of each set."""
    out = np.zeros((len(counts), SKETCH_WORDS), _U)
    bit = (T.mix(tokens ^ _U(0xA0761D6478BD642F)) >> _U(32)) * _U(64 * SKETCH_WORDS) >> _U(32)
    at = np.repeat(np.arange(len(counts)), counts) * SKETCH_WORDS + (bit >> _U(6)).astype(np.int64)
    np.bitwise_xor.at(out.reshape(-1), at, _U(1) << (bit & _U(63)))
    return out


def _sizes(like: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in T.slices(batches, "t"):
            _, counts = shingle_sets(raw, offsets, like.shingle)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts)], names=["k", "n_shingles"])

    return run


def _keys(like: Similarity, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in T.slices(batches, "t"):
            keys = block_keys(*shingle_sets(raw, offsets, like.shingle), like, every)
            columns = [T.signed(keys.key), part.column(0).take(pa.array(keys.text))]
            if every:
                columns += [pa.array(x, pa.int32()) for x in (keys.group, keys.most, keys.blocks)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "k", "grp", "most", "blocks"][: len(columns)])

    return run


def _sets(like: Similarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw, offsets in T.slices(batches, "t"):
            tokens, counts = shingle_sets(raw, offsets, like.shingle)
            bits = sketches(tokens, counts)
            edges = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), T.signed(tokens))
            marks = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * SKETCH_WORDS), T.signed(bits.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column(0), marks, lists], names=["k", "sketch", "tokens"])

    return run


def _may_link(like: Similarity, x: str, y: str) -> Column:
    """Whether sizes and sketches (structs ``x`` and ``y`` of n, w0, w1, ...) allow a link: never false for linked sets."""
    a, b = F.col(f"{x}.n"), F.col(f"{y}.n")
    hamming = sum((F.bit_count(F.col(f"{x}.w{i}").bitwiseXOR(F.col(f"{y}.w{i}"))) for i in range(SKETCH_WORDS)), F.lit(0))
    return (like.den * F.least(a, b) >= like.num * F.greatest(a, b)) & (hamming * (like.den + like.num) <= (a + b) * (like.den - like.num))


def _marks(sets: DataFrame) -> DataFrame:
    """Of each set (an id may have several): ``k``, ``s`` (its number) and ``mark`` (size and sketch)."""
    words = [F.col("sketch")[i].alias(f"w{i}") for i in range(SKETCH_WORDS)]
    return sets.select("k", F.xxhash64("tokens").alias("s"), F.struct(F.size("tokens").cast("long").alias("n"), *words).alias("mark"))


def _rarest_shingles(sets: DataFrame, like: Similarity) -> DataFrame:
    """Of each set: as many of its shingles as a linked set may lack, and one more, those of fewest sets first, and their ``place``."""
    each = sets.select("k", F.xxhash64("tokens").alias("s"), F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count("*").alias("often"))
    place = F.row_number().over(Window.partitionBy("k", "s").orderBy("often", "token"))
    lacking = F.col("n") - F.expr(f"(n * {like.num} + {like.den - 1}) div {like.den}")
    return each.join(often, "token").withColumn("place", place).filter(F.col("place") <= lacking + 1).select("k", "s", "n", "token", "place")


def _dealt_again(members: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """members (key, k, s, c) by shingles of theirs: (key, token, k, s, c, place), without those that no other can be linked with.

    A member has each of its shingles once, however many keys it was under: what met under a key meets under a shingle.
    """
    each = members.select("k", "s", "c").distinct()
    keyed = each.join(_rarest_shingles(sets.join(each.select("k").distinct(), "k", "left_semi"), like), ["k", "s"])
    by_component = keyed.groupBy("token", "c").agg(F.min("place").alias("least"))
    met = by_component.groupBy("token").agg(F.min("least").alias("least"), F.count("*").alias("n_c")).filter("n_c > 1").drop("n_c")
    apart = F.expr(f"(n + n * {like.den} div {like.num}) * {like.den - like.num} div {like.den + like.num}")
    near = keyed.join(met, "token").filter(F.col("place") - 1 + F.col("least") - 1 <= apart)
    return near.select(F.lit(0).cast("long").alias("key"), "token", "k", "s", "c", "place")


def _unlike_pairs(members: DataFrame, like: Similarity) -> DataFrame:
    """(x, y) of members of one key and token, of different components, that sizes, places and sketches allow to be linked.

    Where one component holds most members, only the others look for partners. The shingles before the first common one
    are differences, so a linked pair passes by its places there; under later ones it need not.
    """
    by = ["key", "token"]
    sizes = members.groupBy(*by, "c").agg(F.count("*").alias("n_c"))
    main = sizes.groupBy(*by).agg(F.max_by("c", "n_c").alias("main"), F.count("*").alias("n_c")).filter("n_c > 1").drop("n_c")
    x, y = (members.select(*by, F.col("k").alias(n), F.col("c").alias(f"c{n}"), F.col("place").alias(f"p{n}"), F.col("mark").alias(f"m{n}")) for n in "xy")
    first = (F.col("px") + F.col("py") - 2) * (like.den + like.num) <= (F.col("mx.n") + F.col("my.n")) * (like.den - like.num)
    apart = (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") > F.col("y"))) & first & _may_link(like, "mx", "my")
    found = x.join(main, by).filter("cx <> main").join(y, by).filter(apart)
    return found.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, like: Similarity) -> DataFrame:
    """The pairs (x, y) whose sets are linked."""
    own = sets.select("k", F.col("tokens"))
    both = pairs.join(own.toDF("x", "a"), "x").join(own.toDF("y", "b"), "y")
    a, b, common = F.size("a").cast("long"), F.size("b").cast("long"), F.size(F.array_intersect("a", "b")).cast("long")
    return both.filter(like.den * common >= like.num * (a + b - common)).select("x", "y")


def links(docs: DataFrame, like: Similarity) -> DataFrame:
    """docs (k, t): pairs (x, y) of linked ids whose components are those of all linked pairs."""
    docs = docs.filter(F.col("k").isNotNull() & F.col("t").rlike("[^\\x20\\x09-\\x0D]"))
    kind = docs.schema["k"].dataType.simpleString()
    copies = exact_copies(docs)
    live = without_copies(docs, copies)

    def several(keys: DataFrame) -> DataFrame:
        return keys.groupBy("key").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", "n")

    keys = T.mapped(live, _keys(like, False), f"key long, k {kind}")
    ids = settle(keys.join(several(keys).drop("n"), "key").select("k").distinct())
    near = split_by_ids(live, "k", ids)[0].join(ids, "k", "left_semi")

    keys = settle(T.mapped(near, _keys(like, True), f"key long, k {kind}, grp int, most int, blocks int"))
    met = keys.join(several(keys), "key")
    text = Window.partitionBy("k", "grp")
    rank = F.row_number().over(text.orderBy("n", "key"))
    own = F.col("blocks") - F.count("*").over(text)  # keys that no other document has
    shared = settle(met.withColumn("rank", rank).withColumn("own", own).filter("own + rank <= most + 1").select("key", "k"))

    discard(keys, ids)
    seen = shared.groupBy("key").agg(F.min("k").alias("hub"), F.max("k").alias("last"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("k")).alias("sum")).filter("hub < last")
    once = seen.groupBy("hub", "last", "n", "sum").agg(F.min("key").alias("key"), F.count("*").alias("weight")).select("key", "hub", "weight")
    members = settle(shared.join(once, "key"))
    discard(shared)
    ids = members.select("k").distinct()
    near = split_by_ids(live, "k", ids)[0].join(ids, "k", "left_semi")
    sets = settle(T.mapped(near, _sets(like), f"k {kind}, sketch array<long>, tokens array<long>"))

    tried = members.filter("k > hub").groupBy("k", "hub").agg(F.sum("weight").alias("w")).groupBy("k").agg(F.max(F.struct("w", "hub")).alias("best"))
    tried = settle(tried.select(F.col("k").alias("x"), F.col("best.hub").alias("y")))
    sure = settle(_verified(tried, sets, like))
    own = connected_components(sure)

    placed = members.join(own, members["k"] == own["node"], "left").select("key", "k", F.coalesce("component", "k").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("key", (F.col("n") > FEW).alias("many"))
    marks = _marks(sets)
    open_ = settle(placed.join(split, "key").join(marks.select("k", "s").distinct(), "k"))
    few, many = (open_.filter(x).drop("many") for x in ("not many", "many"))
    dealt = settle(_dealt_again(many, sets, like).unionByName(few.withColumns({"token": F.lit(0).cast("long"), "place": F.lit(1)})))
    rest = _unlike_pairs(dealt.join(marks, ["k", "s"]), like).join(tried, ["x", "y"], "left_anti")
    found = settle(_verified(rest, sets, like))
    discard(members, sets, tried, own, open_, dealt)
    return sure.unionByName(found).unionByName(copies.select(F.col("k").alias("x"), F.col("first").alias("y")))


def similar_groups(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: ``doc_id``, ``n_shingles`` (set size) and ``component_id`` (smallest linked id).

    Words are what white space separates, with A-Z lowered. Null and empty texts have no shingles and link
    with nothing; a null id has a null component. Rows that share an id share a component, which holds what
    any of their texts links with. Further columns are left out; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    sizes = T.mapped(rows, _sizes(like), f"k {kind}, n_shingles long")
    found = connected_components(links(rows, like))
    out = sizes.join(found, sizes["k"] == found["node"], "left")
    return out.select(F.col("k").alias("doc_id"), "n_shingles", F.coalesce("component", "k").alias("component_id"))


def one_of_each_group(docs: DataFrame, like: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that no smaller linked id stands for; all columns. Of equal ids all rows stay."""
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").cast("string").alias("t"))
    gone = settle(connected_components(links(rows, like)).select(F.col("node").alias(id_col)))
    listed, others = split_by_ids(docs, id_col, gone)
    return others.union(listed.join(gone, listed[f"`{id_col}`"] == gone[f"`{id_col}`"], "left_anti"))
