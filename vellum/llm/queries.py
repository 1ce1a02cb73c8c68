"""The registered queries op1 to op13 and the pipeline, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embeddings, html, minhash, mixing, negatives, quality, secrets, sentencepiece, sharding, suffixes, tries, warc
from .common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(table(spark, sf_dir, "documents")).drop("kept")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest version holds after eight arrivals, each compacted: every document once, its bytes and their hash.

    Runs have made-up names, so where a row lies isn't part of the result; ShardStore.located() says it.
    """
    docs = table(spark, sf_dir, "documents")
    store = sharding.sharded(docs)
    text = F.coalesce("text", F.lit(""))
    rows = store.read() if store.version() else docs.limit(0)
    return rows.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives its text again."""
    docs = table(spark, sf_dir, "documents")
    return sentencepiece.decode(sentencepiece.encode(docs)).select("doc_id", "n_tokens", "token_ids", F.sha2("text", 256).alias("decoded_sha256"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("removed_lines")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(docs, secrets.trained(docs, sf_dir))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, written into packages and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_html_extraction,
        op3_sharding,
        op4_sentencepiece,
        op5_chat_formatting,
        op6_embedding_near_dedup,
        op7_minhash_near_dedup,
        op8_quality_rules,
        op9_secret_scan,
        op10_source_mixing,
        op11_conversation_trie,
        op12_warc,
        op13_hard_negatives,
    )
}



def _found(kind: str, pattern: str, where: str = "true") -> str:
    """SQL for a pattern's matches with their places, from table d(rid, text)."""
    pattern = pattern.replace("'", "''")
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda z: length(z))), 0)::BIGINT"
    return f"""
  SELECT rid, {secrets.KINDS.index(kind)} AS rank, '{kind}' AS kind, a AS a, a + length(m) AS b, m FROM (
    SELECT rid, {length("parts[1:k]")} + {length("ms[1:k - 1]")} AS a, ms[k] AS m FROM (
      SELECT rid, parts, ms, unnest(range(1, len(ms) + 1)) AS k FROM (
        SELECT rid, string_split_regex(text, '{pattern}') AS parts, regexp_extract_all(text, '{pattern}') AS ms FROM d WHERE regexp_matches(text, '{pattern}'))))
  WHERE {where}"""


_WORD = r"[^\x20\x09-\x0D]+"

_ASSIGN = secrets._ASSIGN.replace("'", "''")
_PAIRS = "SELECT CASE WHEN j = 1 THEN '^' ELSE token[j - 1:j - 1] END AS a, token[j:j] AS b, count(*) AS n FROM (SELECT token, unnest(range(1, length(token) + 1)) AS j FROM {}) GROUP BY ALL"

ORACLE = {
    # Texts as hex, two characters a byte; every string of 50 bytes and the smallest document that has it.
    "op1_suffix_dedup": """
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT rid, doc_id, h, unnest(range(n - 49)) AS p FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS doc FROM w GROUP BY g),
m AS (SELECT w.rid, w.p FROM w JOIN f ON w.g = f.g WHERE f.doc < w.doc_id),
r AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM m),
s AS (SELECT rid, min(p) AS a, max(p) + 50 AS b FROM (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS run FROM r) GROUP BY rid, run),
t AS (SELECT s.*, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s),
k AS (SELECT t.rid, sum(t.b - t.a)::BIGINT AS removed, count(*) AS spans, max(t.b) AS stop, string_agg(substr(d.h, 2 * t.before + 1, 2 * (t.a - t.before)), '' ORDER BY t.a) AS kept FROM t JOIN d ON d.rid = t.rid GROUP BY t.rid)
SELECT d.doc_id, d.n AS n_bytes, coalesce(k.removed, 0) AS n_removed, coalesce(k.spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.rid IS NULL THEN d.h ELSE k.kept || substr(d.h, 2 * k.stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.rid = d.rid""",
    # For pages whose article is marked: its blocks are what stands between paragraph and heading tags.
    "op2_html_extraction": r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'),
                                      '(?is)<article[^>]*>(.*?)</article>', 1) AS body
  FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(body, '(?i)</?(?:p|h1)(?:\s[^>]*)?>'), lambda x:
    trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))),
    lambda x: x <> '') AS parts
  FROM a)
SELECT page_id, url, array_to_string(parts, chr(10) || chr(10)) AS text, length(array_to_string(parts, chr(10) || chr(10)))::BIGINT AS n_chars FROM b""",
    "op3_sharding": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "op5_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role = 'system', false) AS system, replace(coalesce(text, ''), '<|im_', '< |im_') AS text,
         CASE WHEN role IS NULL THEN 'unknown' WHEN role = 'unknown' THEN '"unknown"'
              ELSE regexp_replace(replace(role, '<|im_', '< |im_'), '[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]+', ' ', 'g') END AS name
  FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, name, sha256(text)) - 1 AS place FROM t),
p AS (SELECT DISTINCT conv_id, name AS speaker FROM t WHERE NOT system),
s AS (
  SELECT o.conv_id, p.speaker, place, NOT system AND name = speaker AS own,
         '<|im_start|>' || CASE WHEN system THEN 'system' WHEN name = speaker THEN 'assistant' ELSE 'user name=' || name END || chr(10) AS head, text || '<|im_end|>' AS body
  FROM o JOIN p ON o.conv_id IS NOT DISTINCT FROM p.conv_id),
a AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, speaker ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start
  FROM s)
SELECT conv_id, speaker, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
       coalesce(string_agg(start || ':' || (start + length(body)), ',' ORDER BY place) FILTER (WHERE own), '') AS mask,
       count(*) AS n_turns, coalesce(sum(length(body)) FILTER (WHERE own), 0)::BIGINT AS n_trained
FROM a GROUP BY conv_id, speaker""",
    "op6_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.m AS component_id, e.vec_id = m.m AS kept
FROM embeddings e
JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) m ON m.a = e.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id""",
    # All pairs of documents that share a shingle, and what their links reach.
    "op7_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], chr(1)) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY a""",
    "op8_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words
  FROM documents),
grams AS (
  SELECT rid, i, array_to_string(words[i:i + 7], chr(1)) AS gram
  FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1),
repeats AS (
  SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, i + unnest(range(8)) AS j FROM twice) GROUP BY rid),
lines AS (
  SELECT rid, source, line, len(regexp_extract_all(line, '{_WORD}')) AS n,
         trim(regexp_replace(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g'), ' ') AS even
  FROM (SELECT rid, source, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
-- Documents with the same lines are one document of their host.
document AS (SELECT rid, source, md5(string_agg(DISTINCT even, chr(10) ORDER BY even)) AS doc FROM lines GROUP BY rid, source),
hosts AS (SELECT source, count(DISTINCT doc) AS n FROM document GROUP BY source),
frequent AS (
  SELECT l.source, l.even FROM lines l JOIN document USING (rid) JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
  GROUP BY l.source, l.even HAVING count(DISTINCT doc) > greatest(10, 0.1 * any_value(h.n))),
removed AS (
  SELECT l.rid, sum(l.n) AS n FROM lines l JOIN frequent f ON l.even = f.even AND l.source IS NOT DISTINCT FROM f.source GROUP BY l.rid),
base AS (
  SELECT rid, doc_id, len(words)::BIGINT AS n_words,
         (length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         coalesce(removed.n, 0)::BIGINT AS gone
  FROM d LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN removed USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - gone >= 10 AND n_words - gone >= 0.2 * n_words) AS kept
FROM base""",
    "op9_secret_scan": rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, coalesce(text, '') AS text FROM documents),
chosen AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL ORDER BY doc_id LIMIT {secrets.SAMPLE_DOCS}),
words AS (SELECT w, w[i + 1] AS x, coalesce(w[i + 2], 'x') AS y, i FROM (
  SELECT w, unnest(range(len(w))) AS i FROM (SELECT regexp_extract_all(text, '[A-Za-z]{{2,}}') AS w FROM documents JOIN chosen USING (doc_id)))),
ordinary AS (SELECT CASE i % 9 WHEN 0 THEN x WHEN 1 THEN lower(x) WHEN 2 THEN lower(x) || '_' || lower(y) WHEN 3 THEN lower(x) || upper(y[1:1]) || lower(y[2:])
    WHEN 4 THEN upper(x[1:1]) || lower(x[2:]) || upper(y[1:1]) || lower(y[2:]) WHEN 5 THEN upper(x) || '_' || upper(y) WHEN 6 THEN lower(x) || '-' || lower(y) || '/' || lower(x)
    WHEN 7 THEN lower(x) || '_' || (i % 100) ELSE upper(x) END AS token FROM words),
random AS (SELECT CASE id % 4 WHEN 0 THEN e WHEN 1 THEN regexp_replace(e, '[+/=]', '', 'g') WHEN 2 THEN upper(regexp_replace(e, '[+/=]', '', 'g')) ELSE h END AS token
  FROM (SELECT id, h, base64(unhex(h)) AS e FROM (SELECT id, sha256(id::VARCHAR) AS h FROM range({secrets.SAMPLE_RANDOM}) t(id)))),
r AS ({_PAIRS.format("random")}), o AS ({_PAIRS.format("ordinary")}),
letters AS (SELECT unnest(string_split('{secrets.ALPHABET}', '')) AS b),
states AS (SELECT '^' AS a UNION ALL SELECT b FROM letters),
rt AS (SELECT s.a, coalesce(sum(n), 0) + {len(secrets.ALPHABET)} AS t FROM states s LEFT JOIN r USING (a) GROUP BY s.a),
ot AS (SELECT s.a, coalesce(sum(n), 0) + {len(secrets.ALPHABET)} AS t FROM states s LEFT JOIN o USING (a) GROUP BY s.a),
weights AS (SELECT s.a, l.b, round(ln((coalesce(r.n, 0) + 1) / rt.t) - ln((coalesce(o.n, 0) + 1) / ot.t), 6) AS x
  FROM states s CROSS JOIN letters l LEFT JOIN r ON r.a = s.a AND r.b = l.b LEFT JOIN o ON o.a = s.a AND o.b = l.b JOIN rt ON rt.a = s.a JOIN ot ON ot.a = s.a),
base AS ({_found("assign", secrets._ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
  UNION ALL {_found("access", secrets._ACCESS, "length(m) >= 20")}
  UNION ALL {_found("hex", secrets._HEX)}),
tokens AS (SELECT *, row_number() OVER () AS tid FROM ({_found("random", secrets._TOKEN, "regexp_matches(m, '[A-Za-z]')")}) t
  WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = t.rid AND base.a < t.b AND base.b > t.a)),
scored AS (SELECT tid, sum(x) AS score FROM (SELECT tid, CASE WHEN j = 1 THEN '^' ELSE m[j - 1:j - 1] END AS a, m[j:j] AS b FROM (SELECT tid, m, unnest(range(1, length(m) + 1)) AS j FROM tokens)) JOIN weights USING (a, b) GROUP BY tid),
odd AS (SELECT t.* FROM tokens t JOIN scored USING (tid) WHERE score > {secrets.MARGIN}),
listed AS (SELECT rid, kind || ':' || a || ':' || b AS span, a, rank FROM base),
every AS (SELECT * FROM listed UNION ALL SELECT rid, kind || ':' || a || ':' || b, a, rank FROM odd)
SELECT d.doc_id, coalesce(n.n_assign, 0) AS n_assign, coalesce(n.n_access, 0) AS n_access, coalesce(n.n_hex, 0) AS n_hex,
       sha256(coalesce(l.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans, coalesce(q.n, 0) AS n_random
FROM d
LEFT JOIN (SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex FROM base GROUP BY rid) n USING (rid)
LEFT JOIN (SELECT rid, string_agg(span, ',' ORDER BY a, rank) AS spans FROM listed GROUP BY rid) l USING (rid)
LEFT JOIN (SELECT rid, string_agg(span, ',' ORDER BY a, rank) AS spans FROM every GROUP BY rid) e USING (rid)
LEFT JOIN (SELECT rid, count(*) AS n FROM odd GROUP BY rid) q USING (rid)""",
    # The CRC-32 of an id's digits bit by bit; a prefix is the list of its turns' hashes.
    "op11_conversation_trie": f"""
WITH t AS (
  SELECT conv_id AS c, sha256(coalesce(role, '') || chr(0) || coalesce(text, '')) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(struct_pack(x := x, n := n) ORDER BY k) AS turns FROM t GROUP BY c),
crc AS (
  SELECT c, turns, xor(list_reduce(list_prepend({0xFFFFFFFF}::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, {0xEDB88320}) ELSE v // 2 END)), {0xFFFFFFFF}) % 9 AS h
  FROM own),
built AS (SELECT a.c, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns FROM crc a LEFT JOIN own b ON b.c = a.c - a.c % 5),
prefix AS (SELECT c, d, len(turns) AS most, coalesce(turns[d].n, 0) AS n, array_to_string(list_transform(turns[1:d], lambda z: z.x), ',') AS p FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
node AS (SELECT d, p, min(c) AS c, count(*) AS members, any_value(n) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE most = d), '') AS ends FROM prefix GROUP BY d, p),
child AS (SELECT DISTINCT a.d, a.p, b.p AS over FROM prefix a JOIN prefix b ON a.c = b.c AND a.d = b.d + 1),
kids AS (SELECT d - 1 AS d, over AS p, count(*) AS n FROM child GROUP BY ALL),
path AS (SELECT DISTINCT a.d, a.p, b.d AS d2, b.p AS p2 FROM prefix a JOIN prefix b ON a.c = b.c AND a.d <= b.d),
sums AS (
  SELECT path.d, path.p, count(*) FILTER (WHERE kids.n IS NULL) AS leaves, sum((node.members - 1) * node.n)::BIGINT AS saved
  FROM path JOIN node ON node.d = d2 AND node.p = p2 LEFT JOIN kids ON kids.d = d2 AND kids.p = p2 GROUP BY path.d, path.p)
SELECT node.c AS conv_id, node.d AS depth, up.c AS parent_conv_id, node.members AS n_convs, coalesce(kids.n, 0) AS n_children,
       sums.leaves AS n_leaves, sums.saved AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN sums USING (d, p) LEFT JOIN kids USING (d, p) LEFT JOIN child ON child.d = node.d AND child.p = node.p LEFT JOIN node up ON up.d = node.d - 1 AND up.p = child.over""",
    "op12_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
s AS (SELECT payload AS same, max(page_id) AS most FROM p WHERE octet_length(encode(payload)) >= {warc.LEAST} GROUP BY payload)
SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN most IS NULL OR page_id IS NOT DISTINCT FROM most THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM most THEN most END AS refers_to
FROM p LEFT JOIN s ON payload = same""",
    # Products of whole numbers, which doubles hold exactly.
    "op13_hard_negatives": f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e, row_number() OVER () AS rid
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {negatives.EVERY} = 0 AND a.rid <> b.rid AND len(a.e) = len(b.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS nth FROM s WHERE same QUALIFY nth <= {negatives.POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.rid, p.nth ORDER BY s.score DESC, s.vec_id NULLS LAST)::INTEGER AS rank,
       s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= {negatives.NEGATIVES}""",
}
