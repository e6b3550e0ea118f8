"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm import decontamination, hmm, language, lexical, licenses, packed_output, parity_join, quality, sharding, substrings, transducer, turns, vector_packing

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
SHARDS = [f"shard-{i:02d}" for i in range(24)]
SLOTS = 2039
#: Prefix language modelling: the first half of a document, at most 512 tokens, is context, the rest bears loss. A
#: sequence takes few documents and an eighth of context at least.
PACKING = {"limits": vector_packing.Limits(tokens=1024, segments=4, loss_tokens=896), "prefix_share": 0.5, "prefix_most": 512}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_output.packed_ids(_documents(spark, sf_dir), BYTE_BPE)


def op2_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("held_out", language.held_out())
    model = language.fit_if_labelled(docs.filter("not held_out"))
    return language.identify(docs, model, ["doc_id", "held_out"])


def op3_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_notices(_documents(spark, sf_dir))


def op4_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_examples(_documents(spark, sf_dir), BYTE_BPE, **PACKING)


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontamination.contaminated_documents(_documents(spark, sf_dir), benchmark)
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat(s["first"].cast("string"), F.lit("-"), s["last"].cast("string"))))
    return out.drop("item_ids").withColumn("spans", spans)


def op6_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.similar_groups(_documents(spark, sf_dir), parity_join.Similarity(shingle=3, num=9, den=10))


def op7_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(_documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_shard_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place_on_shards(_documents(spark, sf_dir), SHARDS, SLOTS)


def op9_token_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.token_counts(_documents(spark, sf_dir), BYTE_BPE)


def op10_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(_documents(spark, sf_dir))


def op11_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(_documents(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.repair_report(turns.damaged(rows), rows)


def op13_quantised_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_matrix,
        op2_nearest_centroid,
        op3_license_compression,
        op4_vector_packing,
        op5_fm_index,
        op6_parity_sketch_join,
        op7_weak_supervision,
        op8_shard_lookup,
        op9_token_transducer,
        op10_difference_cover,
        op11_hidden_markov,
        op12_turn_repair,
        op13_quantised_search,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANK = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM benchmark),
sized AS (SELECT item_id, ws, least(13, len(ws)) AS size FROM b WHERE len(ws) > 0),
bw AS (SELECT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT *, unnest(range(1, len(ws) - size + 2)) AS i FROM sized)),
dw AS (SELECT doc_id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS w FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) s WHERE len(ws) >= size)),
found AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, w)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) - 1 AS j FROM found),
spans AS (SELECT doc_id, min(j) AS a, max(j) AS b FROM (SELECT doc_id, j, j - row_number() OVER (PARTITION BY doc_id ORDER BY j) AS g FROM hit) GROUP BY doc_id, g),
hits AS (SELECT doc_id, sum(b - a + 1)::BIGINT AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS spans FROM spans GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS h FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, coalesce(own.h, sha256('')) AS items_sha256,
  coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(d.ws) AS contaminated, coalesce(hits.spans, '') AS spans
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN own USING (doc_id)"""

_SIMILARITY_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_BLANK}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 2], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON l.x = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY 1"""

_REPEATS_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS ws FROM documents),
w AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
f AS (SELECT h, min(doc_id) AS lo FROM w GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM w JOIN f USING (h) WHERE doc_id > lo),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, len(d.ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)"""

_TURNS_SQL = r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS codes FROM conversations),
how AS (SELECT k.*, xor(list_reduce([4294967295] || codes, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 20 AS how FROM keyed k, steps),
damaged AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM how, range(2) copies(copy) WHERE how <> 0 AND (how = 3 OR copy = 0)),
ordered AS (SELECT *, row_number() OVER w AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role) || ':' || role || text))),
faulty AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, left(role, 1) AS initial FROM ordered),
priced AS (SELECT *, CASE fault WHEN 'truncated' THEN 3 WHEN 'blank' THEN 1000000000 WHEN 'duplicate' THEN 1000000000 ELSE 0 END AS more FROM faulty),
sized AS (SELECT conv_id, count(*) AS n FROM priced GROUP BY 1),
back AS (SELECT conv_id, n + 1 AS i, [0, 6, 3, 0]::BIGINT[] AS v FROM sized
  UNION ALL SELECT conv_id, i, [least(c[1], 3 + c[3], 6 + c[4]), least(c[2], 3 + c[3], 6 + c[4]), least(c[3], 3 + c[4]), least(c[4], 3 + c[3])]::BIGINT[] FROM (
    SELECT p.conv_id, p.i, [least(4 + v[1], CASE initial WHEN 's' THEN v[2] + more WHEN 'u' THEN v[3] + more ELSE 1000000000 END, 3 + more + v[3]),
      least(4 + v[2], CASE initial WHEN 'u' THEN v[3] + more ELSE 1000000000 END, 3 + more + v[3]),
      least(4 + v[3], CASE initial WHEN 'a' THEN v[4] + more ELSE 1000000000 END, 3 + more + v[4]),
      least(4 + v[4], CASE initial WHEN 'u' THEN v[3] + more ELSE 1000000000 END, 3 + more + v[3])] AS c
    FROM back b JOIN priced p ON p.conv_id IS NOT DISTINCT FROM b.conv_id AND p.i = b.i - 1)),
walk AS (SELECT conv_id, 1::BIGINT AS i, 1 AS s, '' AS audit, [] ::VARCHAR[] AS lines FROM sized
  UNION ALL SELECT conv_id, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE chosen END, audit || edit,
      CASE edit WHEN 'D' THEN lines WHEN 'K' THEN lines || [role || ':' || text] ELSE lines || [CASE chosen WHEN 3 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END] END FROM (
    SELECT w.*, p.initial, p.role, p.text, [3, 3, 4, 3][w.s] AS chosen,
      CASE WHEN p.i IS NOT NULL AND 4 + a.v[w.s] = b.v[w.s] THEN 'D' WHEN 3 + b.v[[3, 3, 4, 3][w.s]] = b.v[w.s] THEN 'I'
        WHEN p.more + CASE WHEN w.s = 1 AND initial = 's' THEN a.v[2] WHEN w.s <> 3 AND initial = 'u' THEN a.v[3] WHEN w.s = 3 AND initial = 'a' THEN a.v[4] END = b.v[w.s] THEN 'K' ELSE 'R' END AS edit
    FROM walk w JOIN back b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i LEFT JOIN priced p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i LEFT JOIN back a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i + 1
    WHERE p.i IS NOT NULL OR w.s IN (2, 3))),
done AS (SELECT w.conv_id, audit, lines FROM walk w JOIN sized s ON s.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = s.n + 1 AND w.s IN (1, 4)),
pairs AS (SELECT conv_id, turn, fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair, i FROM priced),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1)
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(d.audit, '') AS audit, sha256(coalesce(array_to_string(d.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN back b ON b.conv_id IS NOT DISTINCT FROM o.conv_id AND b.i = 1"""

_SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM documents),
size AS (SELECT (count(*) FILTER (len(ws) > 0))::BIGINT AS many, sum(len(ws))::BIGINT AS total FROM d),
postings AS (SELECT r, w, count(*) AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY 1, 2),
df AS (SELECT w, count(*) AS df FROM postings GROUP BY 1),
asked AS (SELECT q, item_id, w, count(*) AS times FROM (SELECT q, item_id, unnest(ws) AS w FROM (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_ALNUM}') AS ws FROM benchmark)) GROUP BY 1, 2, 3),
weighed AS (SELECT q, item_id, w, times * floor(1000 * ln((2 * many + 2) / (2 * df + 1)))::BIGINT AS weight FROM asked JOIN df USING (w), size),
lengths AS (SELECT r, doc_id, 75 + (25 * len(ws)::BIGINT * many) // greatest(total, 1) AS m FROM d, size),
scored AS (SELECT q, item_id, doc_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM weighed JOIN postings USING (w) JOIN lengths USING (r) GROUP BY 1, 2, 3, 4),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20"""

#: The other operators' models, encodings and packings are not SQL's: tests/llm hold them against brute force.
ORACLE_SQL = {
    "op5_fm_index": _CONTAMINATION_SQL,
    "op6_parity_sketch_join": _SIMILARITY_SQL,
    "op8_shard_lookup": sharding.duckdb_sql(SHARDS, SLOTS),
    "op10_difference_cover": _REPEATS_SQL,
    "op12_turn_repair": _TURNS_SQL,
    "op13_quantised_search": _SEARCH_SQL,
}
