from __future__ import annotations

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorespan.llm import language, licenses, quality, sharding
from lorespan.llm.decontamination import contaminated_documents, found_passages, index_shards, without_passages
from lorespan.llm.fm_index import FMIndex, suffix_array
from tests.llm.helpers import ALNUM, BLANK, LOWER, SCHEMA, awkward, frame, prose


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=6), st.lists(st.integers(1, 5), min_size=1, max_size=4))
def test_fm_index_finds_every_occurrence(segments, pattern):
    symbols = np.array([x for s in segments for x in [*s, 0]])
    index = FMIndex(symbols, 6, sample=4)
    lo, hi = index.search(np.array([pattern]))
    found = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
    assert found == [i for i in range(len(symbols) - len(pattern) + 1) if symbols[i : i + len(pattern)].tolist() == pattern]
    again, more = FMIndex.from_bytes(index.to_bytes(extra=np.arange(3)))
    assert more["extra"].tolist() == [0, 1, 2] and again.search(np.array([pattern]))[0][0] == lo[0] and sorted(again.locate(np.arange(lo[0], hi[0])).tolist()) == found
    order = suffix_array(symbols)
    unlike = [*range(-int((symbols == 0).sum()), 0)]  # separators differ and come first
    text = [unlike.pop(0) if x == 0 else x for x in symbols.tolist()]
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def _hits(items, text, window=13):
    words = ALNUM.findall((text or "").translate(LOWER))
    hit, own = [False] * len(words), set()
    for i, t in items:
        w = ALNUM.findall(t.translate(LOWER))
        n = min(window, len(w))
        for a in range(len(w) - n + 1) if n else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[a : a + n]:
                    own.add(str(i))
                    hit[j : j + n] = [True] * n
    return len(words), sum(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(words)


@pytest.mark.parametrize("block_words", [1, 1 << 20])
def test_contamination_equals_brute_force(spark, block_words):
    rng = random.Random(4)
    items = [(i, prose(rng, 5 + 9 * i).upper()) for i in range(4)] + [(10, "One."), (11, ""), (12, "w1 w2"), (13, "w1 w2")]
    rows = awkward(n=30)
    rows += [(1000 + i, f"{prose(rng, 20)} {items[i % 4][1].lower()} {prose(rng, 5 * i)}", "en", "s", 1) for i in range(12)]
    benchmark = spark.createDataFrame([*items, (None, "w1"), (14, None)], "item_id long, text string")
    docs = frame(spark, rows, clash=True)
    out = contaminated_documents(docs, benchmark, keep=docs.columns, block_words=block_words)
    assert out.columns[: len(docs.columns)] == docs.columns
    texts = {r[0]: r[1] for r in rows}
    for r in out.collect():
        if r["doc_id"] is not None:
            assert r["text"] == texts[r["doc_id"]]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == _hits(items, texts[r["doc_id"]])
            assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == r["n_hit"]
    assert contaminated_documents(spark.createDataFrame([], SCHEMA), benchmark).count() == 0
    empty = contaminated_documents(docs, spark.createDataFrame([], "item_id long, text string")).agg({"n_hit": "sum"}).first()
    assert empty[0] == 0


def test_removal_spans_are_cut(spark):
    rng = random.Random(5)
    item, other = prose(rng, 20, 10**6), prose(rng, 16, 10**6)
    filler = [prose(rng, 600, 10**6) for _ in range(3)]
    rows = [(1, f"{filler[0]} {item} {filler[1]}. {other}!", 0), (2, f"{item} and", 1), (3, filler[2], 2), (4, None, 3), (5, "", 4), (5, "", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").selectExpr("*", "row as n_words", "'x' as spans")
    benchmark = spark.createDataFrame([(7, item), (8, other), (8, other)], "item_id long, text string")
    assert [tuple(s) for s in contaminated_documents(docs, benchmark).filter("doc_id = 1").first()["spans"]] == [(600, 619), (1220, 1235)]
    out = without_passages(docs, benchmark)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"], ALNUM.findall(r["text"] or "")) for r in out.collect()) == [(1, ALNUM.findall(f"{filler[0]} {filler[1]}")), (3, ALNUM.findall(filler[2])), (4, []), (5, []), (5, [])]
    assert {r["text"] for r in out.filter("doc_id > 2").collect()} == {filler[2], None, ""}


def test_one_index_serves_other_benchmarks_and_windows(spark):
    rows = awkward(n=18)
    docs = frame(spark, rows)
    shards = index_shards(docs, ["doc_id"])
    texts = {r[0]: r[1] for r in rows}
    for window, items in ((13, [(1, rows[4][1] or "w1"), (2, "one two")]), (3, [(3, prose(random.Random(1), 9, 50))])):
        found = {r["row"]: r for r in found_passages(shards, spark.createDataFrame(items, "item_id long, text string"), window).collect()}
        for r in shards.filter("k0 is not null").collect():
            n = sum(s["last"] - s["first"] + 1 for s in found[r["row"]]["spans"]) if r["row"] in found else 0
            assert (r["n_words"], n) == _hits(items, texts[r["k0"]], window)[:2]


def test_languages(spark):
    rng = random.Random(7)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}
    speak = lambda lang, n: " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    rows = [(i, speak(lang, rng.randrange(5, 80)), lang) for i, lang in enumerate(rng.choices(list(alphabets), k=300))]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", None), (902, "12 34 !!", "bb"), (903, "zzz " * 200, None), (904, "x", None)], "doc_id long, text string, lang string")
    docs = docs.withColumn("held", language.held_out())
    model = language.fit(docs.filter("not held"), language.Settings(sample=50))
    out = {r["doc_id"]: r for r in language.identify(docs, model, ["doc_id", "lang", "text"]).collect()}
    held = [i for i, _, _ in rows if __import__("zlib").crc32(str(i).encode()) % 4 == 2]
    assert held and np.mean([out[i]["lang_pred"] == rows[i][2] for i in held]) > 0.98
    assert all(out[i]["lang_pred"] == "und" and out[i]["rejected"] and out[i]["score"] == 0 for i in (900, 901, 902))
    assert out[903]["rejected"] and not any(out[i]["rejected"] for i, _, _ in rows)
    assert all(0 <= r["score"] <= 1 for r in out.values()) and all(out[i]["text"] == t for i, t, _ in rows)
    again = language.fit(docs.filter("not held").repartition(5), language.Settings(sample=50))
    assert np.allclose(again.centroids, model.centroids)
    with pytest.raises(ValueError):
        language.fit(spark.createDataFrame([], SCHEMA))
    assert language.identify(spark.createDataFrame([], SCHEMA), model, ["doc_id"]).count() == 0


def _plain_cosines(model, text):
    """Cosine with each centroid, trigram by trigram."""
    folded = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in text.encode())
    counts = Counter(folded[i : i + 3] for i in range(len(folded) - 2) if folded[i : i + 3] != b"   ")
    vector: dict[int, float] = Counter()
    for gram, n in counts.items():
        vector[(int.from_bytes(gram, "little") * 0x9E3779B1 % 2**32) >> (32 - model.settings.bits)] += n
    weights = {slot: (1 + np.log(n)) * float(model.idf[slot]) for slot, n in vector.items()}
    norm = np.sqrt(sum(w * w for w in weights.values())) or 1.0
    return [sum(w / norm * float(column[slot]) for slot, w in weights.items()) for column in model.centroids.T]


def test_predictions_equal_brute_force(spark):
    rng = random.Random(12)
    speak = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))
    learned = [(i, speak(letters, 60), x) for i in range(90) for x, letters in [[("aa", "abcdef"), ("bb", "defghi"), ("cc", "ghijké")][i % 3]]]
    model = language.fit(spark.createDataFrame(learned, "doc_id long, text string, lang string"), language.Settings(bits=10, clusters=2))
    texts = [None, "", "a", "12 !", speak("abcdef", 30_000), speak("defgh", 5), "ZZ zz", *[speak("abcdefghijké", n) for n in (1, 2, 3, 40)]]
    rows = [(i, t, "lang") for i, t in enumerate(texts)] + [(5, texts[5], "lang")]  # a repeated row
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string").selectExpr("*", "1 AS k0", "2 AS t", "3 AS lettered")
    out = language.identify(docs, model, ["doc_id", "k0", "t", "lettered"]).collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[r["doc_id"]] or ""
        cosines = _plain_cosines(model, text)
        assert (r["k0"], r["t"], r["lettered"]) == (1, 2, 3)
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        else:
            assert abs(r["score"] - max(cosines)) < 1e-4
            best = {model.labels[i // 2] for i, c in enumerate(cosines) if c > max(cosines) - 1e-5}
            assert r["lang_pred"] in best
    tie = language.Model(model.settings, ["xx", "yy"], model.idf, np.hstack([model.centroids[:, :2]] * 2), np.zeros((2, 41)))
    assert {r["lang_pred"] for r in language.identify(docs.filter("doc_id = 4"), tie, ["doc_id"]).collect()} == {"xx"}


def test_a_language_left_out_of_training_is_rejected(spark):
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 9)))
    common, letters = [word("aeiorstn") for _ in range(60)], {"aa": "aeiourstnlmd", "bb": "aeiorstnkwzhg", "cc": "aeiorstnpqvjxy"}
    own = {x: [word(y) for _ in range(300)] for x, y in letters.items()}
    rows = [(i, " ".join(rng.choice(own[x] if rng.random() < 0.8 else common) for _ in range(rng.randrange(60, 400))), x) for i, x in enumerate(sorted(own) * 100)]
    odd = [(1000 + i, " ".join("".join(rng.choice("bcfghjklmpqwxyz") for _ in range(5)) for _ in range(60 << i % 3)), ["aa", "bb"][i % 2]) for i in range(3)]  # one odd text in a length class
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    held = F.col("doc_id") % 3 == F.floor(F.col("doc_id") / 3) % 3
    model = language.fit(docs.filter(F.col("lang") != "cc").filter(~held))
    out = {r["doc_id"]: r["rejected"] for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert np.mean([out[i] for i, _, x in rows if x == "cc"]) > 0.95
    assert np.mean([out[i] for i, _, x in rows if x != "cc"]) < 0.05


def _base(text):
    words = BLANK.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if BLANK.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in quality.SYMBOLS for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_measures_equal_brute_force(spark):
    rows = awkward()
    texts = {r[0]: r[1] for r in rows} | {None: "a null id has text"}
    out = quality.judge(frame(spark, rows, clash=True)).collect()
    assert len(out) == len(rows) + 2
    for r in out:
        lines = [x for x in (texts[r["doc_id"]] or "").split("\n") if BLANK.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == _base(texts[r["doc_id"]])
        assert (r["n_lines"], r["n_ended_lines"]) == (len(lines), sum(BLANK.findall(x)[-1][-1] in '.!?"' for x in lines))
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def _brute_quality(patterns):
    """Posterior of the good class of each row of votes, by EM over the rows one by one (production start values)."""
    rules = len(patterns[0])
    share = [0.7] + [0.3 / rules] * rules
    overall = [tuple((sum(votes[r] == v for votes in patterns) + 1 / 3) / (len(patterns) + 1) for v in range(3)) for r in range(rules)]
    start = lambda r, bad: (bad, *((1 - bad) * x / (1 - overall[r][0]) for x in overall[r][1:]))
    p = [[start(r, max(0.1, overall[r][0])) for r in range(rules)]] + [[start(r, 0.8) if r == j else overall[r] for r in range(rules)] for j in range(rules)]
    before = None
    for _ in range(500):
        rows = []
        for votes in patterns:
            like = [share[c] * np.prod([p[c][r][v] for r, v in enumerate(votes)]) for c in range(1 + rules)]
            rows.append([x / sum(like) for x in like])
        sums = [sum(r[c] for r in rows) for c in range(1 + rules)]
        share = [(x + 1) / (len(patterns) + 1 + rules) for x in sums]
        p = [[tuple((sum(w[c] for w, votes in zip(rows, patterns, strict=True) if votes[r] == v) + 1 / 3) / (sums[c] + 1) for v in range(3)) for r in range(rules)] for c in range(1 + rules)]
        if before and max(abs(x - y) for r, s in zip(rows, before, strict=True) for x, y in zip(r, s, strict=True)) <= 1e-7:
            break
        before = rows
    return [r[0] for r in rows]


def _drawn_votes(n, seed=1):
    """(votes, whether good, what the true rates say) of good documents and of two kinds of junk that trip different rules, not always with a bad vote."""
    rng = np.random.default_rng(seed)
    kind = rng.choice(3, n, p=[0.8, 0.12, 0.08])
    good, off = (0.02, 0.08, 0.9), (0.55, 0.4, 0.05)
    rates = np.array([[good] * 6, [off] * 3 + [good] * 3, [good] * 3 + [off] * 3])
    draws = rng.random((n, 6))
    edges = rates[kind].cumsum(axis=2)
    votes = (draws[:, :, None] > edges[:, :, :2]).sum(axis=2)
    likely = np.stack([q * np.prod(r[np.arange(6), votes], axis=1) for q, r in zip((0.8, 0.12, 0.08), rates, strict=True)])
    return votes, kind == 0, likely[0] >= likely[1] + likely[2]


def test_label_model_equals_brute_force():
    votes, _, _ = _drawn_votes(60)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    good = quality.class_posteriors(patterns, *quality.fit_label_model(patterns, counts.astype(float)))[:, 0]
    assert np.allclose(good[which.reshape(-1)], _brute_quality(votes.tolist()), atol=1e-4)


def test_posterior_beats_all_must_pass():
    votes, truth, best = _drawn_votes(20000)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, p = quality.fit_label_model(patterns, counts.astype(float))
    kept = (quality.class_posteriors(patterns, share, p)[:, 0] >= 0.5)[which.reshape(-1)]
    no_bad_vote = (votes > 0).all(axis=1)
    assert abs(share[0] - 0.8) < 0.02 and np.abs(p[0] - (0.02, 0.08, 0.9)).max() < 0.02
    assert np.mean(kept == truth) > np.mean(best == truth) - 0.003 > np.mean(no_bad_vote == truth) + 0.05
    assert kept[(votes == [0, 2, 2, 2, 2, 2]).all(axis=1)].all(), "one bad vote alone is the rule's error"
    assert not kept[(votes == [1, 1, 1, 2, 2, 2]).all(axis=1)].any(), "junk need not have a bad vote"


def test_text_ids_and_quoted_columns(spark):
    rows = [(f"d {i}", prose(random.Random(i), 90)) for i in range(4)]
    docs = spark.createDataFrame(rows, "`a key` string, `the text` string")
    out = quality.judge(docs, id_col="a key", text_col="the text")
    assert {r["doc_id"]: r["n_words"] for r in out.collect()} == {k: 90 for k, _ in rows}


def test_clean_and_broken_texts_are_told_apart(spark):
    rng = random.Random(2)

    def junk(i: int) -> str:
        words = prose(rng, 120).split()
        for on, change in ((i % 2, lambda w: w + "###"), (i % 3 == 0, str.upper), (i % 5 == 0 or not (i % 2 or i % 3 == 0), lambda w: "".join(c for c in w if not c.isalpha()) + "7")):
            words = [change(w) for w in words] if on else words
        return " ".join(words)

    rows = [(i, prose(rng, 150), None, None, 1) for i in range(300)] + [(1000 + i, junk(i), None, None, 1) for i in range(60)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[1000 + i] for i in range(60))


def test_lookup_table_equals_its_sql_and_is_even(spark):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 211)
    counts = Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 211)
    assert sum(a != b and a != 6 for a, b in zip(table, fewer, strict=True)) < 211 * 0.35
    rows = [r[:2] for r in awkward(n=20)]
    docs = frame(spark, awkward(n=20), clash=True)
    out = {r["doc_id"]: (r["slot"], r["shard"]) for r in sharding.place_on_shards(docs, shards, 211).collect()}
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents AS SELECT unnest($1) AS doc_id", [[k for k, _ in rows]])
    assert {r[0]: r[1:] for r in duck.execute(sharding.duckdb_sql(shards, 211)).fetchall()} == {k: v for k, v in out.items() if k is not None}
    assert out[None] == (None, None)
    odd = spark.createDataFrame([("a", 1), ("a", 1)], "slot string, shard int")
    assert [r["key"] for r in sharding.place_on_shards(odd, shards, 211, "slot").collect()] == ["a", "a"]
    assert sharding.place_on_shards(odd, shards, 211, "shard").columns == ["key", "slot", "shard"]
    assert sharding.place_on_shards(spark.createDataFrame([], SCHEMA), shards, 211).count() == 0
    for bad in ((shards, 210), ([], 211), (["a", "a"], 211)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_licenses(spark):
    rows = [
        (1, "Some prose. Released under the MIT License.\nMore prose"),
        (2, "x\nThis work is licensed under the GNU General Public License, version 2."),
        (3, "This work is licensed under the GNU General Public License, version 7."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "He lost his driving license on the way to town and could not say why it had happened to him of all people."),
        (6, None), (7, ""), (8, "nothing here"), (9, "license " * 3000), (None, "All rights reserved."),
        (10, "Veröffentlicht. Licensed under the Apache Licence, Version 2.0, gladly."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS t", "3 AS first")
    out = {r["doc_id"]: r for r in licenses.license_notices(docs).collect()}
    text = dict(rows)
    assert {k: r["license_id"] for k, r in out.items() if r["confirmed"]} == {1: "MIT", 2: "GPL-2.0", 4: "CC-BY-NC-4.0", None: "all-rights-reserved", 10: "Apache-2.0"}
    assert set(out) == {1, 2, 3, 4, 5, 9, 10, None}
    assert "+2" in out[3]["differences"] or "-7" in out[3]["differences"]
    assert out[10]["differences"] and text[10].encode()[out[10]["first"] :][: out[10]["length"]].decode().startswith("Licensed")
    assert [x["reduction"] for x in out[1]["ranking"]] == sorted((x["reduction"] for x in out[1]["ranking"]), reverse=True)
    assert licenses.license_notices(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_whole_license_texts_and_parts(spark):
    texts = licenses.Scan().texts
    flat = {k: " ".join(v.split()) for k, v in texts.items()}
    grant = flat["MIT"][: flat["MIT"].index("The above")].strip()
    commented = "\n".join(f" * {x}" for x in texts["BSD-3-Clause"].splitlines())
    bulleted = texts["BSD-2-Clause"].replace("1. ", "* ").replace("2. ", "* ")
    header = flat["GPL-3.0"][flat["GPL-3.0"].index("This program is free software") :][:190]
    wrapped = header.replace("either version 3 ", "either version\n# 3 ")
    rows = [(i, f"Some prose about boats.\n\nCopyright (c) 2020 A\n\n{v}\nint main") for i, v in enumerate(texts.values())]
    rows += [(100, grant), (101, f"/*\n * Copyright (c) 2020, A.\n{commented}\n */\nint x;"), (102, bulleted), (103, wrapped), (104, wrapped.replace("3", "7"))]
    rows += [(105, f"{texts['MIT']}\n\n{texts['Apache-2.0']}"), (106, f"{texts['GPL-3.0']}\n\n{texts['MIT']}")]
    rows += [(107, "the terms of the work in the case of a boat, any person obtaining a copy of it may do as they like with the sails and the rest of it")]
    out: dict = {}
    for r in licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault(r["doc_id"], []).append(r)
    sure = {k: {r["license_id"] for r in v if r["confirmed"] and r["n_words"] >= 20} for k, v in out.items()}
    for i, (name, text) in enumerate(texts.items()):
        whole = [r for r in out[i] if r["confirmed"] and r["license_id"] == name and r["n_words"] > 0.8 * len(text.split())]
        assert len(whole) == 1, name
    assert sure[100] == {"MIT"} and sure[101] == {"BSD-3-Clause"} and sure[102] == {"BSD-2-Clause"} and sure[103] == {"GPL-3.0"}
    assert not sure.get(104) and {"MIT", "Apache-2.0"} <= sure[105] and {"GPL-3.0", "MIT"} <= sure[106] and not sure.get(107)


def _fewest(block, template):
    """Insertions and deletions that make the block a passage of the template."""
    row = [0] * (len(template) + 1)
    for i, x in enumerate(block, 1):
        new = [i]
        for j, y in enumerate(template, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] if x == y else len(block) + len(template)))
        row = new
    return min(row)


def test_ranking_and_verdict_equal_brute_force(spark):
    scan = licenses.Scan()
    mit = " ".join(scan.texts["MIT"].split())
    blocks = [
        "Released under the MIT License", "Licensed under the Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 9.",
        "All rights reserved. Copyright", "no licence for fishing without a copyright on it", mit[mit.index("Permission") :][:400], "license license license license",
    ]
    params = zstandard.ZstdCompressionParameters.from_level(scan.level, write_checksum=0, write_content_size=0, write_dict_id=0)
    scanner = licenses.Scanner(scan)
    for block in blocks:
        words, raw = licenses.words_of(block), block.encode()
        plain = len(zstandard.ZstdCompressor(compression_params=params).compress(raw))
        gains, tried = {}, []
        for whole, templates in ((False, scan.templates), (True, scan.texts))[: 2 if len(words) >= licenses.SHORT else 1]:
            own = {}
            for name, text in templates.items():
                text = licenses.undecorated(text) if whole else text
                known = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                own[name] = 1 - len(zstandard.ZstdCompressor(compression_params=params, dict_data=known).compress(raw)) / plain
                gains[name] = max(gains.get(name, -9), own[name])
            for name in sorted(own, key=lambda n: (-own[n], n))[: scan.finalists]:
                known = licenses.words_of(licenses.undecorated(templates[name]) if whole else templates[name])
                if own[name] >= scan.least and len(words) - len(known) <= scan.tolerance * len(words):
                    tried.append((_fewest(words, known), -own[name], name))
        verdict = scanner.judge(raw)
        assert [(r["license_id"], r["reduction"]) for r in verdict["ranking"]] == sorted(gains.items(), key=lambda x: (-x[1], x[0]))
        assert verdict["n_words"] == len(words) and (verdict["license_id"] is None) == (not tried)
        if tried:
            assert (verdict["n_differences"], verdict["license_id"]) in {(n, name) for n, _, name in tried}
            assert verdict["n_differences"] == len(verdict["differences"])
            if verdict["confirmed"]:
                assert verdict["n_differences"] == min(n for n, _, _ in tried) <= scan.tolerance * len(words)
    assert [scanner.judge(b.encode())["confirmed"] for b in blocks] == [True, True, False, True, False, True, False]


def test_repeated_rows_and_ties_of_licenses(spark):
    text = "Released under the MIT License. Then prose. All rights reserved."
    rows = [(1, text), (1, text), (2, text)]
    out = [tuple(r) for r in licenses.license_notices(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "first", "length", "license_id", "confirmed").collect()]
    assert len(out) == 6 and sorted(out)[0] == sorted(out)[1] and {r[1:] for r in out if r[0] == 2} == {r[1:] for r in out if r[0] == 1}
    same = licenses.Scan(templates={"b": "Shared under odd terms of the license.", "a": "Shared under odd terms of the license."}, texts={})
    tied = licenses.license_notices(spark.createDataFrame([(1, "Shared under odd terms of the license.")], "doc_id long, text string"), same).first()
    assert tied["license_id"] == "a" and [r["license_id"] for r in tied["ranking"]] == ["a", "b"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("abc"), max_size=6))
def test_differences_are_fewest(block, template):
    def distance(a, b):
        row = [*range(len(b) + 1)]
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] if x == y else 99))
            row = new
        return row[-1]

    best = min(distance(block, template[i:j]) for i in range(len(template) + 1) for j in range(i, len(template) + 1))
    assert len(licenses.differences(block, template)) == best


def test_the_most_frequent_of_too_many_labels_are_learned(spark):
    """300 labels, a dirty column: 256 of them are learned, the two real ones among them, and nothing stops."""
    rng = random.Random(12)
    rows = [(i, f"{'die und der nicht' if i % 2 else 'the and of not'} {prose(rng, 8)}", ["en", "de"][i % 2]) for i in range(60)]
    rows += [(1000 + i, f"x{i} y{i}", f"dirt{i:03}") for i in range(298)]
    model = language.fit_if_labelled(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.labels) == 256 and {"en", "de", "dirt000", "dirt253"} <= set(model.labels) and "dirt254" not in model.labels
