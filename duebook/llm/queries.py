"""The operators as queries over whole tables, and the SQL that states their results where SQL can."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from duebook.llm import bpe, collide, divergence, idfiles, jaccard, mixing, quality, repair, suffixes, tokens, topk, warc, winnowing
from duebook.llm.common import numbered, table, whole_text
from duebook.session import materialise


def op1_token_counts(spark, folder):
    return tokens.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@lru_cache(maxsize=1)
def _decimals(size: int) -> list[bytes]:
    return [b"%d" % i for i in range(size)]


def decimal_sha256(ids: bytes) -> str:
    """Digest of the ids as decimal numbers with a blank between them."""
    found = np.frombuffer(ids, dtype="<i4")
    table = _decimals(1 << max(16, int(found.max(initial=0)).bit_length()))
    return hashlib.sha256(b" ".join(map(table.__getitem__, found.tolist()))).hexdigest()


def op2_bpe_round_trip(spark, folder):
    """Sizes and digests of ids and of the texts that they decode to."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.encode(table(spark, folder, "documents"), tokenizer, decoded=True, digest=decimal_sha256)
    return decoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.col("digest").alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))


def op3_quality(spark, folder):
    """Evidence, priors, score and decision of every document."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    scored = quality.classify(documents, table(spark, folder, "labels"))
    return scored.select("doc_id", "source", "lang", "quality_evidence", "quality_host", "quality_path", "quality_score", "quality_keep")


def op4_fingerprints(spark, folder):
    return winnowing.fingerprints(table(spark, folder, "documents"))


def op5_token_id_files(spark, folder):
    """What the files hold of every document."""
    read = idfiles.round_trip(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_repeated_passages(spark, folder):
    """Sizes and digests of what is left of every text."""
    documents = table(spark, folder, "documents").select("doc_id", whole_text().alias("text"))
    cut = suffixes.remove_repeats(documents, 400)
    return cut.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
                      (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("left").alias("text"))


def op7_mix_to_targets(spark, folder):
    return mixing.mix(table(spark, folder, "documents"))


def op8_exact_top_k(spark, folder):
    vectors = materialise(numbered(topk.quantised(table(spark, folder, "embeddings")), "id", "v"), "vectors")
    return topk.top_k(vectors, vectors.where("id % 20 = 0"), 20)


def op9_warc_derivatives(spark, folder):
    """Every derived record: what it refers to, its digests, size, links, text."""
    records = warc.build_derivatives(table(spark, folder, "pages"))
    header = F.col("headers")
    return records.select(
        header["WARC-Source-Id"].cast("long").alias("page_id"), "type", "record_id", "refers_to", "uri", "date",
        header["WARC-Concurrent-To"].alias("concurrent_to"), header["WARC-Source-Payload-Digest"].alias("payload_digest"),
        header["WARC-Block-Digest"].alias("block_digest"), F.octet_length("block").cast("long").alias("n_bytes"),
        header["Source-Links"].cast("long").alias("n_links"), F.decode("block", "UTF-8").alias("content"))


def op10_ngram_jaccard_join(spark, folder):
    return jaccard.similarity_join(table(spark, folder, "documents")).drop("text_key")


def op11_source_divergence(spark, folder):
    return divergence.source_divergence(table(spark, folder, "documents"))


def op12_conversation_repair(spark, folder):
    """Repair of conversations whose turns were damaged by the checksum of their place: left out, emptied, without ends of sentences, repeated, given to the user."""
    turns = repair.standing(table(spark, folder, "conversations"))
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(place.cast("binary")) % 20
    damaged = turns.withColumn("kind", kind).withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return repair.repair(damaged.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("row") * 2 + F.col("copy")).alias("row"),
                                        (F.col("kind") != 0).alias("there")), numbered_rows=True)


def op13_near_vectors(spark, folder):
    vectors = materialise(numbered(collide.usable(table(spark, folder, "embeddings")), "id", "v", "norm"), "vectors")
    return collide.nearest(vectors, vectors.where("id % 20 = 0"), 20)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe_round_trip, op3_quality, op4_fingerprints, op5_token_id_files, op6_repeated_passages, op7_mix_to_targets, op8_exact_top_k, op9_warc_derivatives,
                                 op10_ngram_jaccard_join, op11_source_divergence, op12_conversation_repair, op13_near_vectors)}
SQL: dict[str, str] = {
    "op6_repeated_passages": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT r, n, part, substr(h, 400 * part + 1, 1200) AS h FROM (SELECT r, h, length(h) // 2 AS n, unnest(range(0, length(h) // 400 + 1)) AS part FROM d)),
p AS (SELECT r, 200 * part + i AS pos, substr(h, 2 * i + 1, 800) AS s FROM (SELECT r, n, part, h, unnest(range(0, 200)) AS i FROM c) WHERE 200 * part + i + 400 <= n),
k AS (SELECT r, pos, hash(s) AS a, md5_number(s) AS b FROM p),
g AS (SELECT a, b FROM k GROUP BY a, b HAVING count(*) > 1),
m AS (SELECT r, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY r ORDER BY pos) <= 400 THEN 0 ELSE 1 END AS fresh FROM k SEMI JOIN g USING (a, b)),
n AS (SELECT r, pos, sum(fresh) OVER (PARTITION BY r ORDER BY pos) AS span FROM m),
e AS (SELECT r, min(pos) AS low, max(pos) + 400 AS high FROM n GROUP BY r, span),
f AS (SELECT r, low, high, coalesce(lag(high) OVER (PARTITION BY r ORDER BY low), 0) AS before FROM e),
t AS (SELECT r, sum(high - low) AS gone, count(*) AS spans, max(high) AS last,
  string_agg(substr(h, 2 * before + 1, 2 * (low - before)), '' ORDER BY low) AS kept,
  string_agg(regexp_replace(regexp_replace(substr(h, 2 * before + 1, 2 * (low - before)), '^([89AB].)+', ''), '(C.|D.|E.([89AB].)?|F.([89AB].){0,2})$', ''),
    '' ORDER BY low) AS whole FROM f JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(from_hex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * last + 1) END)) AS kept_sha256,
  decode(from_hex(CASE WHEN kept IS NULL THEN h ELSE whole || regexp_replace(substr(h, 2 * last + 1), '^([89AB].)+', '') END)) AS text
FROM d LEFT JOIN t USING (r)""",
    "op8_exact_top_k": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r, q.id AS query_id, c.id AS vec_id, c.r AS c, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.id % 20 = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM p
WINDOW best AS (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, c) QUALIFY row_number() OVER best <= 20""",
    "op10_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN []
  ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT r, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.r AS a, b.r AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM e AS a JOIN e AS b ON a.x = b.x AND a.r <> b.r GROUP BY 1, 2),
l AS (SELECT a, b, k = na AND k = nb AS same FROM c WHERE 5 * k >= 4 * (na + nb - k)),
reach AS (SELECT r AS a, r AS b FROM s UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
class AS (SELECT reach.a AS r, min(s.doc_id) AS class_id FROM reach JOIN s ON reach.b = s.r GROUP BY 1),
copies AS (SELECT a AS r, min(s.doc_id) AS copy_id FROM l JOIN s ON l.b = s.r WHERE same GROUP BY 1),
links AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY 1)
SELECT doc_id, class_id, least(doc_id, coalesce(copy_id, doc_id)) AS copy_id, coalesce(n_links, 0) AS n_links, len(s) AS n_shingles
FROM s JOIN class USING (r) LEFT JOIN copies USING (r) LEFT JOIN links USING (r)""",
    "op11_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(any_value(v.v), 0) AS v, coalesce(sum(c.n), 0) AS total
  FROM g LEFT JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (s.total + s.v) AS p
  FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
l AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(any_value(x.value), 0) AS BIGINT) AS value
  FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
    FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) AS x
  ON x.lang = a.lang AND x.source = a.source AND x.item = b.source GROUP BY ALL),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - l.q) * (p.p - l.q) // l.q AS BIGINT) AS value
  FROM p JOIN l USING (lang, term) WHERE p.n > 0 AND p.p > l.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200""",
    "op12_conversation_repair": r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY i) AS t FROM range(256) AS x(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
    list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM d),
f AS (SELECT conv_id, turn, role, text, i, CASE WHEN last = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n, count_if(fault = 1) AS blank,
    count_if(fault = 2) AS duplicate, count_if(fault = 3) AS truncated,
    count_if(before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
steps AS (SELECT * FROM (VALUES ('e', 's', 's'), ('e', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')) AS v(x, c, y)),
fits AS (SELECT * FROM (VALUES ('e', 'u', 'user'), ('s', 'u', 'user'), ('a', 'u', 'user'), ('u', 'a', 'assistant')) AS v(x, y, role)),
ins AS (SELECT x, x AS y, 0 AS cost, '' AS edits, '' AS lines FROM (VALUES ('e'), ('s'), ('u'), ('a')) AS v(x)
  UNION ALL SELECT x, y, 3, 'I', role || ':' || chr(10) FROM fits
  UNION ALL SELECT p.x, q.y, 6, 'II', p.role || ':' || chr(10) || q.role || ':' || chr(10) FROM fits AS p JOIN fits AS q ON p.y = q.x),
best(conv_id, i, x, cost, audit, lines) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 'e', CAST(0 AS BIGINT), '', '' FROM a
  UNION ALL
  SELECT conv_id, i, y, got.cost, got.audit, got.lines FROM (
    SELECT b.conv_id, f.i, e.y, min(struct_pack(cost := CAST(b.cost + ins.cost + e.cost AS BIGINT), audit := b.audit || ins.edits || e.edit, lines := b.lines || ins.lines || e.line)) AS got
    FROM best AS b JOIN ins ON b.x = ins.x JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1,
    LATERAL (SELECT ins.y AS y, 4 AS cost, 'D' AS edit, '' AS line
      UNION ALL SELECT s.y, CASE WHEN f.fault = 3 THEN 3 ELSE 0 END, 'K', f.role || ':' || f.text || chr(10) FROM steps AS s WHERE s.x = ins.y AND s.c = f.c AND f.fault NOT IN (1, 2)
      UNION ALL SELECT t.y, CASE WHEN f.fault = 3 THEN 6 ELSE 3 END, 'R', t.role || ':' || f.text || chr(10) FROM fits AS t WHERE t.x = ins.y AND f.fault NOT IN (1, 2)) AS e
    GROUP BY b.conv_id, f.i, e.y)),
done AS (SELECT a.conv_id, min(struct_pack(cost := b.cost + ins.cost, audit := b.audit || ins.edits, lines := b.lines || ins.lines)) AS got
  FROM a JOIN best AS b ON b.conv_id IS NOT DISTINCT FROM a.conv_id AND b.i = a.n JOIN ins ON b.x = ins.x AND ins.y IN ('e', 'a') GROUP BY a.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(done.got.cost, 0) AS cost, coalesce(done.got.audit, '') AS audit,
  sha256(coalesce(left(done.got.lines, length(done.got.lines) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS c LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id""",
}
