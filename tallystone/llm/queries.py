"""The queries of this subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm.common import table
from tallystone.llm.labelled import doc_crc
from tallystone.llm.license_scan import TEMPLATES

#: Documents with a score below these are rejected (quality) or from there on (toxicity).
TOXIC_FROM, GOOD_FROM = 0.7, 0.3


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.vector_links import vector_links

    return vector_links(table(spark, sf_dir, "embeddings"), 0.93)


def op2_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.tag_paths import extract_text

    pages = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    found = extract_text(pages, id_col="page")
    return found.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"), 16)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.packing import pack_texts

    return pack_texts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), 4096, 1)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), 4096)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.subword_toxicity import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), doc_crc(F.col("doc_id")) % 3 != 1)
    scored = predict(docs, model, TOXIC_FROM)
    return scored.select("doc_id", (doc_crc(F.col("doc_id")) % 3 == 1).alias("held_out"), "score", "predicted")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.compression_quality import fit, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), doc_crc(F.col("doc_id")) % 5 != 0)
    scored = predict(docs, model, GOOD_FROM)
    return scored.select("doc_id", (doc_crc(F.col("doc_id")) % 5 == 0).alias("held_out"), "score", "predicted")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.ngram_join import near_classes

    return near_classes(table(spark, sf_dir, "documents"), 0.8, 5)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.piece_codec import encode_texts

    outputs = ("n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes")
    return encode_texts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), outputs, add_eos=True)


def op10_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.telephony import store_texts

    outputs = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "pcm_sha256")
    return store_texts(table(spark, sf_dir, "documents"), outputs)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.conversation_repair import repair_conversations

    return repair_conversations(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallystone.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_vector_links, op2_tag_paths, op3_label_shards, op4_packing, op5_token_counts, op6_toxicity, op7_quality, op8_ngram_join, op9_piece_codec, op10_telephony, op11_conversation_repair, op12_license_scan, op13_filter_audit)
}
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": r"""
WITH RECURSIVE crcs AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) AS r(i))),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS key
  FROM conversations),
hit AS (SELECT n.*, xor(list_reduce(key, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS kind FROM named AS n, crcs),
dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit WHERE kind <> 0),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dam),
fault AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \t-\r]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][ \t-\r]*\z') THEN 't' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM pos),
ro AS (
  SELECT conv_id, i, n, role, text, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS more, left(role, 1) AS r FROM fault),
tally AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM fault GROUP BY conv_id),
f AS (
  SELECT conv_id, n AS i, CAST(0 AS BIGINT) AS c0, CAST(6 AS BIGINT) AS cs, CAST(3 AS BIGINT) AS cu, CAST(0 AS BIGINT) AS ca FROM ro WHERE i = n
  UNION ALL
  SELECT conv_id, i, least(m0, least(mu, ma + 3) + 3), least(ms, least(mu, ma + 3) + 3), least(mu, ma + 3), least(ma, mu + 3) FROM (
    SELECT f.conv_id, f.i - 1 AS i,
      least(c0 + 4, CASE WHEN gone THEN 1000000 ELSE more + least(cu + 3, CASE r WHEN 's' THEN cs WHEN 'u' THEN cu ELSE 1000000 END) END) AS m0,
      least(cs + 4, CASE WHEN gone THEN 1000000 ELSE more + least(cu + 3, CASE r WHEN 'u' THEN cu ELSE 1000000 END) END) AS ms,
      least(cu + 4, CASE WHEN gone THEN 1000000 ELSE more + least(ca + 3, CASE r WHEN 'a' THEN ca ELSE 1000000 END) END) AS mu,
      least(ca + 4, CASE WHEN gone THEN 1000000 ELSE more + least(cu + 3, CASE r WHEN 'u' THEN cu ELSE 1000000 END) END) AS ma
    FROM f JOIN ro ON ro.conv_id IS NOT DISTINCT FROM f.conv_id AND ro.i = f.i) AS q),
cells AS (SELECT conv_id, i, [c0, cs, cu, ca] AS c FROM f),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 1 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS texts FROM cells WHERE i = 0
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND s = 1 AND r = 's' THEN 2 ELSE nxt END, audit || e,
    CASE e WHEN 'D' THEN texts WHEN 'K' THEN list_append(texts, role || ':' || text) ELSE list_append(texts, CASE WHEN nxt = 3 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT w.*, ro.role, ro.text, ro.r, CASE WHEN s = 3 THEN 4 ELSE 3 END AS nxt,
      CASE WHEN b.c IS NOT NULL AND 4 + b.c[s] = a.c[s] THEN 'D' WHEN 3 + a.c[CASE WHEN s = 3 THEN 4 ELSE 3 END] = a.c[s] THEN 'I' WHEN b.c IS NULL THEN NULL
        WHEN r = CASE WHEN s = 3 THEN 'a' ELSE 'u' END AND more + b.c[CASE WHEN s = 3 THEN 4 ELSE 3 END] = a.c[s] THEN 'K' WHEN r = 's' AND s = 1 AND more + b.c[2] = a.c[1] THEN 'K' ELSE 'R' END AS e
    FROM walk AS w JOIN cells AS a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.i
      LEFT JOIN cells AS b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.i + 1
      LEFT JOIN ro ON ro.conv_id IS NOT DISTINCT FROM w.conv_id AND ro.i = w.i + 1) AS q
  WHERE e IS NOT NULL),
done AS (SELECT conv_id, max_by(audit, length(audit)) AS audit, max_by(texts, length(audit)) AS texts FROM walk GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
  sha256(array_to_string(coalesce(texts, []), chr(10))) AS repaired_sha256
FROM ids LEFT JOIN tally ON tally.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
  LEFT JOIN cells ON cells.conv_id IS NOT DISTINCT FROM ids.conv_id AND cells.i = 0
""",
    "op12_license_scan": rf"""
WITH t(label, words) AS (
  SELECT label, list_distinct(string_split(words, ' ')) FROM (VALUES {", ".join(f"('{label}', '{words}')" for label, words in TEMPLATES)}) AS v(label, words)),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{_CAPITALS}', '{_SMALL}') AS low FROM documents),
w AS (SELECT rid, doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
p AS (
  SELECT *, list_filter(range(1, len(w)), lambda i: w[i] = 'cc' AND w[i + 1] = 'by') AS cc,
    list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS gpl,
    list_filter(range(1, len(w) - 1), lambda i: w[i] = 'all' AND w[i + 1] = 'rights' AND w[i + 2] = 'reserved') AS reserved
  FROM w),
b AS (
  SELECT rid, doc_id, len(w) AS n_words, len(cc) + len(gpl) + len(reserved) AS n_base, list_min(cc || gpl || reserved) - 1 AS first_word, list_max(cc || gpl || reserved) - 1 AS last_word,
    CASE WHEN len(cc) > 0 THEN ['cc-by'] ELSE [] END || CASE WHEN len(gpl) > 0 THEN ['gpl'] ELSE [] END || CASE WHEN len(reserved) > 0 THEN ['reserved'] ELSE [] END AS base
  FROM p),
s AS (SELECT rid, unnest(string_split_regex(low, '\n|[.!?][\t-\r ]')) AS piece FROM d),
v AS (SELECT rid, regexp_extract_all(piece, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM s),
r AS (SELECT rid, w, unnest(range(1, greatest(2, len(w) - 31), 32)) AS k FROM v),
x AS (SELECT rid, list_distinct(w[k:k + 63]) AS have FROM r),
m AS (
  SELECT rid, label, len(list_intersect(have, words)) / len(words) AS containment
  FROM x CROSS JOIN t WHERE 10 * len(list_intersect(have, words)) >= 9 * len(words)),
g AS (SELECT rid, list(label) AS own, max(containment) AS best, count(*) AS n FROM m GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(base || coalesce(own, []))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score, CAST(coalesce(n, 0) AS BIGINT) AS n_matches
FROM b LEFT JOIN g USING (rid)
""",
    "op1_vector_links": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS x,
    coalesce(list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))), false) AND coalesce(list_sum(list_transform(embedding, lambda c: abs(c))), 0) > 0 AS fine
  FROM embeddings),
l AS (
  SELECT a.rid AS a, b.rid AS b FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid
  WHERE a.fine AND b.fine AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT rid, rid AS reached FROM v UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.reached),
k AS (SELECT r.rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.reached GROUP BY 1),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, k.component_id, v.vec_id = k.component_id AS kept
FROM v JOIN k USING (rid) LEFT JOIN n USING (rid)
""",
    "op8_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\r\f]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g
  FROM d),
e AS (SELECT rid, len(g) AS n, unnest(g) AS gram FROM s),
c AS (SELECT a.rid AS a, b.rid AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM e a JOIN e b ON a.gram = b.gram AND a.rid <> b.rid GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 5 * common >= 4 * (n + m - common)),
r AS (SELECT rid, rid AS reached FROM s UNION SELECT r.rid, l.b FROM r JOIN l ON l.a = r.reached),
k AS (SELECT r.rid, min(s.doc_id) AS class_id FROM r JOIN s ON s.rid = r.reached GROUP BY 1),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY 1)
SELECT s.doc_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, k.class_id, s.doc_id = k.class_id AS kept
FROM s JOIN k USING (rid) LEFT JOIN n USING (rid)
""",
    "op13_filter_audit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
least AS (SELECT text, min(doc_id) AS least FROM d GROUP BY 1),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM d JOIN least USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT letter AS filter_order, 1 AS step, 0 AS gone, bit FROM f
  UNION ALL SELECT filter_order || letter, step + 1, gone | o.bit, f.bit FROM o JOIN f ON (gone | o.bit) & f.bit = 0),
whole AS (SELECT w.filter_order, o.step, o.gone, o.bit FROM o AS w JOIN o ON starts_with(w.filter_order, o.filter_order) WHERE w.step = 5),
r AS (
  SELECT part, filter_order, step, any_value(bit) AS bit, sum(CASE WHEN mask & (gone | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & gone > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & gone = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c CROSS JOIN whole GROUP BY 1, 2, 3)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
""",
}
