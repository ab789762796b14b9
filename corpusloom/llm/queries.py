"""The registered queries of the operators, and the SQL that checks those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    byte_bpe,
    decontaminate,
    exact_dedup,
    filter_audit,
    hilbert_shards,
    html_text,
    language_id,
    lm_score,
    merkle,
    quality_fm,
    simhash_dedup,
    substring_dedup,
    warc_archive,
)
from corpusloom.llm.common import fold, table


def op1_text_density(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op2_anchor_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_dedup.components(table(spark, folder, "documents"))
    # bigint to hex: two's complement digits, which are those of the unsigned value.
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_elias_fano_lm(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm_score.score(table(spark, folder, "documents"), learn=fold() != 1)
    return scored.select("doc_id", (fold() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_shards.assign(table(spark, folder, "documents"), shards=24)


VOCABULARY = "byte_bpe_50k.tiktoken"


def bpe_tokenizer(spark: SparkSession) -> byte_bpe.Tokenizer:
    return byte_bpe.Tokenizer(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op5_matrix_bpe(spark: SparkSession, folder: str) -> DataFrame:
    tokenized = bpe_tokenizer(spark).round_trip(table(spark, folder, "documents"), keep=["doc_id"])
    return tokenized.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op6_byte_gru(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    predicted = language_id.predict(docs, language_id.fit(docs))
    return predicted.select("doc_id", (fold() == 0).alias("held_out"), "lang_pred", "score")


def op7_quality_fm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality_fm.score(docs, quality_fm.fit(docs, table(spark, folder, "labels")))
    predicted = (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted")
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", predicted)


def op8_suffix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_streaming_dedup(spark: SparkSession, folder: str) -> DataFrame:
    decided = exact_dedup.deduplicate(table(spark, folder, "documents"))
    return decided.select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op10_super_kmers(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


def op11_warc_shards(spark: SparkSession, folder: str) -> DataFrame:
    archive = warc_archive.write(table(spark, folder, "pages"))
    found = warc_archive.read(spark, archive)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_merkle_levels(spark: SparkSession, folder: str) -> DataFrame:
    found = merkle.manifest(table(spark, folder, "documents"), merkle.every_third(), merkle.lower_az())
    proof = merkle.proof_hash(F.col("path")).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM d
"""

_LOWER_AZ = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"coalesce(regexp_extract_all({_LOWER_AZ}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
  items AS (SELECT item_id::VARCHAR AS item, ws, least(len(ws), 10) AS n
            FROM (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
  windows AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS k
              FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM items)),
  sizes AS (SELECT DISTINCT n FROM windows),
  places AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
             FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d CROSS JOIN sizes)),
  found AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, k)),
  hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
  named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
            FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
  windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k
              FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
  later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n
           FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN gone USING (doc_id, p)
           GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS size FROM pages),
  best AS (SELECT *, CASE WHEN size >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS response FROM p)
SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM best
"""

OP12_SQL = r"""
WITH RECURSIVE
  d AS (SELECT doc_id, lang,
      [CASE WHEN v IS NULL THEN '-' ELSE octet_length(encode(v)) || ':' || v END
       FOR v IN [doc_id::VARCHAR, source, lang, n_chars::VARCHAR]] AS told,
      text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS changed,
      xor(4294967295, list_reduce(
        [4294967295] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')],
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) AS crc
    FROM documents),
  l AS (SELECT doc_id, coalesce('=' || lang, '') AS grp,
      sha256(array_to_string(told, '') || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
      CASE WHEN crc % 3 = 0 THEN sha256(array_to_string(told, '') || coalesce(octet_length(encode(changed)) || ':' || changed, '-')) END AS changed
    FROM d),
  n AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS size FROM l),
  tree(grp, lv, pos, size, h) AS (
    SELECT grp, 0, pos, size, leaf FROM n
    UNION ALL
    SELECT grp, lv + 1, pos // 8, any_value((size + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE size > 1 GROUP BY grp, lv, pos // 8),
  subroots AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS size FROM tree WHERE size = 1),
  crown(lv, pos, size, h) AS (
    SELECT 0, pos, size, subroot FROM subroots
    UNION ALL
    SELECT lv + 1, pos // 8, any_value((size + 7) // 8), sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE size > 1 GROUP BY lv, pos // 8),
  runs AS (SELECT grp, lv, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tree WHERE size > 1 GROUP BY ALL),
  crown_runs AS (SELECT lv, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM crown WHERE size > 1 GROUP BY ALL),
  climbed(doc_id, leaf, grp, start, lv, pos, x, proof) AS (
    SELECT doc_id, leaf, grp, pos, 0, pos, coalesce(changed, leaf), '' FROM n
    UNION ALL
    SELECT doc_id, leaf, grp, start, lv + 1, run,
      sha256(array_to_string(hs[:pos % 8], '') || x || array_to_string(hs[pos % 8 + 2:], '')),
      proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
    FROM (SELECT *, pos // 8 AS run FROM climbed) JOIN runs USING (grp, lv, run)),
  inside AS (SELECT * FROM climbed QUALIFY row_number() OVER (PARTITION BY grp, start ORDER BY lv DESC) = 1),
  crowned(doc_id, leaf, grp, start, subroot, lv, pos, x, proof) AS (
    SELECT doc_id, leaf, grp, start, subroot, 0, s.pos, x, proof FROM inside JOIN subroots s USING (grp)
    UNION ALL
    SELECT doc_id, leaf, grp, start, subroot, lv + 1, run,
      sha256(array_to_string(hs[:pos % 8], '') || x || array_to_string(hs[pos % 8 + 2:], '')),
      proof || array_to_string(hs[:pos % 8], '') || array_to_string(hs[pos % 8 + 2:], '')
    FROM (SELECT *, pos // 8 AS run FROM crowned) JOIN crown_runs USING (lv, run)),
  done AS (SELECT * FROM crowned QUALIFY row_number() OVER (PARTITION BY grp, start ORDER BY lv DESC) = 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = h AS verified
FROM done CROSS JOIN (SELECT h FROM crown WHERE size = 1)
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
  w AS (SELECT *, coalesce(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), []) AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
  f AS (SELECT doc_id, part,
          (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
          + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
          + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < doc_id, false)::INT AS mask FROM w),
  marks AS (SELECT doc_id, bool_or(quality = 1)::INT AS good, bool_or(toxic = 1)::INT AS toxic FROM labels GROUP BY doc_id),
  m AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN marks USING (doc_id)),
  letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS x(letter, bit)),
  orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
               [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
             FROM letters a, letters b, letters c, letters d, letters e
             WHERE len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
  steps AS (SELECT filter_order, i AS step, bits[i] AS own, coalesce(list_sum(bits[:i - 1]), 0)::INT AS before
            FROM orders, unnest(range(1, 6)) AS r(i)),
  counts AS (SELECT part, filter_order, step, own,
      count(*) FILTER (mask & (own | before) = 0) AS kept,
      count(*) FILTER (mask & own > 0 AND mask & before = 0) AS removed,
      count(*) FILTER (mask & own > 0 AND mask & before > 0) AS redundant,
      count(*) FILTER (mask = own) AS unique_fails,
      coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost,
      coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
    FROM m CROSS JOIN steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counts
"""

QUERIES = {
    "op1_text_density": op1_text_density,
    "op2_anchor_simhash": op2_anchor_simhash,
    "op3_elias_fano_lm": op3_elias_fano_lm,
    "op4_hilbert_shards": op4_hilbert_shards,
    "op5_matrix_bpe": op5_matrix_bpe,
    "op6_byte_gru": op6_byte_gru,
    "op7_quality_fm": op7_quality_fm,
    "op8_suffix_decontamination": op8_suffix_decontamination,
    "op9_streaming_dedup": op9_streaming_dedup,
    "op10_super_kmers": op10_super_kmers,
    "op11_warc_shards": op11_warc_shards,
    "op12_merkle_levels": op12_merkle_levels,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {
    "op8_suffix_decontamination": OP8_SQL,
    "op9_streaming_dedup": OP9_SQL,
    "op10_super_kmers": OP10_SQL,
    "op11_warc_shards": OP11_SQL,
    "op12_merkle_levels": OP12_SQL,
    "op13_filter_audit": OP13_SQL,
}
