from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorespan.llm import turns

SOLID = re.compile(r"[^\x20\x09-\x0D]")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def _damage(rows):
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how = zlib.crc32(key.encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        yield from [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """(cost, audit, repaired) by search over all edits, from the left."""

    @lru_cache(maxsize=None)
    def best(i, initials, inserted):
        """initials: what matters of the sequence so far, its last letter and whether it can end here."""
        options = []
        if i == len(rows) and GRAMMAR.fullmatch(initials):
            options.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if viable(now := initials + role[0]):
                    cost, audit, rest = best(i, shortened(now), inserted + 1)
                    options.append((cost + 3, "I" + audit, ((role, ""), *rest)))
        if i < len(rows):
            role, text = rows[i][2:]
            more = 3 if faults[i] == "truncated" else 0
            cost, audit, rest = best(i + 1, initials, 0)
            options.append((cost + 4, "D" + audit, rest))
            if faults[i] not in ("blank", "duplicate"):
                for edit, name, price in [("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)]:
                    if name and viable(now := initials + name[0]):
                        cost, audit, rest = best(i + 1, shortened(now), 0)
                        options.append((cost + price + more, edit + audit, ((name, text), *rest)))
        return min(options, default=(10**9, "", ()))

    def viable(x):
        return any(GRAMMAR.fullmatch(x + more) for more in ("", "a", "ua"))

    def shortened(x):
        return x if len(x) < 3 else {"a": "ua", "u": "u"}[x[-1]] if x[-1] in "au" else x

    return best(0, "", 0)


def _report(rows, every):
    out = {}
    for conv in every:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        faults = Counter(f := _faults(own))
        timed = {r[1] for r in own if r[1] is not None}
        pairs = [(a[2][:1] + b[2][:1]) for a, b in zip(own, own[1:])]
        cost, audit, repaired = _cheapest(tuple(own), tuple(f)) if own else (0, "", ())
        gaps = max(timed) - min(timed) + 1 - len(timed) if timed else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)
    return out


def _conversations(rng, n, longest=7):
    texts = ["Yes.", "No!", "Well", "One two. three", "  ", "", None, "why?\n", "ü. 　", "Long " * 300 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "admin", "User"]
    rows = []
    for conv in [*range(n), None]:
        turn = rng.choice([0, 1, 5])
        for _ in range(rng.randrange(0, longest)):
            rows.append((conv, None if rng.random() < 0.05 and all(r[1] is not None or r[0] != conv for r in rows) else turn, rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([1, 1, 1, 2, 9])
    return rows


@pytest.mark.parametrize("fragment", [None, 3])
def test_reports_equal_a_search_of_all_edits(spark, fragment):
    rows = _conversations(random.Random(8), 120)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "7 AS k", "7 AS kind", "7 AS `first`", "7 AS h").repartition(4)
    if fragment:  # conversations lie in several fragments and ranges
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = turns.repair_report(turns.damaged(table), table).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    every = {r[0] for r in rows}
    assert len(out) == len(every)
    assert {r["conv_id"]: tuple(r)[1:] for r in out} == _report(list(_damage(rows)), every)


def test_rebuilt_turns_follow_the_grammar(spark):
    rows = _conversations(random.Random(9), 60)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {}
    for r in sorted(turns.repaired_turns(turns.damaged(table)).collect(), key=lambda r: r["position"]):
        found.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in turns.repair_report(turns.damaged(table), table).collect()}
    for conv, digest in hashes.items():
        own = found.get(conv, [])
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == digest


def test_one_conversation_over_many_fragments_and_tasks(spark):
    """9,000 turns of one conversation: every fragment is entered as the whole walk leaves the one before it."""
    rng = random.Random(3)
    rows = [(1, i, rng.choice(["user", "assistant", "assistant"]), rng.choice([f"Line {i}.", f"Line {i}", "Same."])) for i in range(9000)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")] + [(3, 4, "user", "Copy.")] * 5000
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: r for r in turns.repair_report(table).collect()}
    codes, seen = bytearray(), set()
    for _, _, role, text in rows[:9000]:
        fault = turns.DUPLICATE if (role, text) in seen else 0 if text.endswith(".") else turns.CUT
        seen.add((role, text))
        codes.append("sua".index(role[0]) + 4 * fault)
    state, audit, _ = turns.walk(bytes(codes), turns.FINAL, turns.START)
    audit += "I" * (state == turns.USER)
    assert out[1]["audit"] == audit
    vectors, bases = turns.backward(bytes(codes), turns.FINAL)
    assert out[1]["cost"] == vectors[0][turns.START] + bases[0] and out[1]["gaps"] == 0
    assert out[2]["audit"] == "KK"
    assert (out[3]["audit"], out[3]["duplicate"], out[3]["cost"]) == ("K" + "D" * 4999 + "I", 4999, 19999)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=40), st.lists(st.integers(0, 40), max_size=4))
def test_maps_of_parts_compose(codes, cuts):
    codes = bytes(codes)
    places = [0, *sorted(min(c, len(codes)) for c in cuts), len(codes)]
    after = turns.FINAL
    for a, b in reversed(list(zip(places, places[1:]))):
        m = turns.cost_map(codes[a:b])
        after = tuple(min(m[4 * s + e] + after[e] for e in range(4)) for s in range(4))
    vectors, bases = turns.backward(codes, turns.FINAL)
    assert after == tuple(c + bases[0] for c in vectors[0])


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.repair_report(turns.damaged(none), none).count() == 0 and turns.repaired_turns(none).count() == 0
