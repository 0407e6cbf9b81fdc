"""The registered queries of this package, each over its whole tables, and their oracle SQL."""

import corpus_pipeline
import public_tokenizers
from marketlens.llm import (
    conversations,
    dart,
    decontam,
    fm_dedup,
    katz,
    merkle,
    packing,
    simhash,
    suffix_dedup,
    syncmers,
    tokenfiles,
    toxicity,
    warc,
)
from marketlens.llm.runtime import table
from pyspark.sql import functions as F

#: Tokenizer files are read where they are installed.
PACKING_TOKENIZER = "byte_bpe_50k.json"
FILE_TOKENIZER = "word_bpe_49k.json"


def op1_warc(spark, folder):
    records = warc.archive_round_trip(table(spark, folder, "pages"))
    return records.select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    hits = decontam.contamination(docs, table(spark, folder, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_suffix_dedup(spark, folder):
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).drop("removed")


def op4_near_duplicates(spark, folder):
    return dart.near_duplicates(table(spark, folder, "documents"))


def _crc(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary"))


def _toxicity_rows(doc_id):
    return _crc(doc_id) % 5 != 0


def op5_toxicity(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    classifier = toxicity.fit(docs, table(spark, folder, "labels"), _toxicity_rows)
    rows = toxicity.scored(docs, classifier)
    held_out = F.coalesce(_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_packing(spark, folder):
    path = public_tokenizers.path(PACKING_TOKENIZER)
    return packing.pack(table(spark, folder, "documents"), path, end_id=0)


def op7_syncmers(spark, folder):
    return syncmers.edit_fingerprints(table(spark, folder, "documents"))


def op8_token_files(spark, folder):
    path = public_tokenizers.path(FILE_TOKENIZER)
    return tokenfiles.token_file_round_trip(table(spark, folder, "documents"), path, end_id=1)


def op9_katz(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(_crc(F.col("doc_id")) % 7 == 2, F.lit(False))
    rows = katz.scores(docs, ~held_out, reread=True)
    return rows.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_fm_dedup(spark, folder):
    return fm_dedup.remove_repeats(table(spark, folder, "documents")).drop("removed")


def op11_repair(spark, folder):
    rows = conversations.damaged(table(spark, folder, "conversations"))
    return conversations.repaired(rows).audits


def op12_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op13_merkle(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"), merkle.without_line_breaks)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_syncmers": op7_syncmers,
    "op8_token_files": op8_token_files,
    "op9_katz": op9_katz,
    "op10_fm_dedup": op10_fm_dedup,
    "op11_repair": op11_repair,
    "op12_simhash": op12_simhash,
    "op13_merkle": op13_merkle,
    "pipeline": corpus_pipeline.run,
}

_WARC_SQL = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), f AS (
    SELECT payload, min(page_id) AS first_id FROM p WHERE octet_length(payload) >= 100 GROUP BY payload
)
SELECT page_id,
       octet_length(p.payload) AS payload_bytes,
       sha256(p.payload) AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload = f.payload
"""

_DECONTAMINATION_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS size,
           array_to_string(words[i + 1 : i + least(len(words), 10)], ' ') AS part
    FROM b, LATERAL unnest(range(greatest(len(words) - 10, 0) + 1)) AS t(i)
    WHERE len(words) > 0
), sizes AS (SELECT DISTINCT size FROM item_windows),
doc_windows AS (
    SELECT doc_id, i, size, array_to_string(words[i + 1 : i + size], ' ') AS part
    FROM d, sizes, LATERAL unnest(range(len(words) - size + 1)) AS t(i)
    WHERE len(words) >= size
), hits AS (
    SELECT doc_id, i, size, item_id FROM doc_windows JOIN item_windows USING (size, part)
), hit_words AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_hit
    FROM hits, LATERAL unnest(range(size)) AS t(k) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL = {"op1_warc": _WARC_SQL, "op2_decontamination": _DECONTAMINATION_SQL}

# Bytes as pairs of hexadecimal digits; a byte is covered if the last repeated string that has
# begun reaches it.
_SUFFIX_SQL = """
WITH d AS (
    SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n
    FROM documents
), windows AS (
    SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS part
    FROM d, LATERAL unnest(range(n - 99)) AS t(i) WHERE n >= 100
), repeated AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY part ORDER BY doc_id, i) AS k FROM windows)
    WHERE k > 1
), bytes AS (
    SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS digits FROM d, LATERAL unnest(range(n)) AS t(p)
), marked AS (
    SELECT b.doc_id, p, digits, coalesce(p - max(r.i) OVER (PARTITION BY b.doc_id ORDER BY p) < 100, FALSE) AS gone
    FROM bytes b LEFT JOIN repeated r ON r.doc_id = b.doc_id AND r.i = b.p
), spans AS (
    SELECT *, gone AND NOT lag(gone, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY p) AS begins FROM marked
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
           string_agg(digits, '' ORDER BY p) FILTER (NOT gone) AS digits
    FROM spans GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(digits, ''))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_FM_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
    SELECT doc_id, i, md5_number(array_to_string(words[i + 1 : i + 35], ' ')) AS part
    FROM d, LATERAL unnest(range(len(words) - 34)) AS t(i) WHERE len(words) >= 35
), repeated AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY part) AS k FROM windows) WHERE k > 1
), places AS (
    SELECT doc_id, p, words[p + 1] AS word FROM d, LATERAL unnest(range(len(words))) AS t(p)
), marked AS (
    SELECT b.doc_id, p, word, coalesce(p - max(r.i) OVER (PARTITION BY b.doc_id ORDER BY p) < 35, FALSE) AS gone
    FROM places b LEFT JOIN repeated r ON r.doc_id = b.doc_id AND r.i = b.p
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept
    FROM marked GROUP BY doc_id
)
SELECT d.doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_NEAR_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), named AS (
    SELECT *, CASE WHEN len(words) = 0 THEN 'text ' || text ELSE 'words ' || array_to_string(words, ' ') END AS content
    FROM d
), twins AS (
    SELECT doc_id, words, min(doc_id) OVER (PARTITION BY content) AS twin_id FROM named
), shingles AS (
    SELECT doc_id, md5_number(array_to_string(words[i + 1 : i + 5], ' ')) AS part, count(*) AS n
    FROM twins, LATERAL unnest(range(greatest(len(words) - 4, 1))) AS t(i)
    WHERE len(words) > 0 AND doc_id = twin_id GROUP BY ALL
), sizes AS (SELECT doc_id, sum(n) AS size FROM shingles GROUP BY doc_id),
links AS (
    SELECT a, b FROM (
        SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS shared
        FROM shingles x JOIN shingles y ON x.part = y.part AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 10 * shared >= 8 * (s.size + t.size - shared)
), reached(a, b) AS (
    SELECT doc_id, doc_id FROM twins WHERE doc_id = twin_id
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), classes AS (SELECT a, min(b) AS class_id FROM reached GROUP BY a)
SELECT doc_id, class_id, twin_id FROM twins JOIN classes ON a = twin_id
"""

ORACLE_SQL |= {
    "op3_suffix_dedup": _SUFFIX_SQL,
    "op4_near_duplicates": _NEAR_SQL,
    "op10_fm_dedup": _FM_SQL,
}

# CRC-32 of a short text: the table of one byte's remainders, then byte by byte.
_CRC_TABLE = """crc_steps(i, k, v) AS (
    SELECT i, 0, i FROM range(256) AS t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
    FROM crc_steps WHERE k < 8
), crc AS (SELECT list(v ORDER BY i) AS remainders FROM crc_steps WHERE k = 8)"""


def _crc_sql(text):
    bytes_of = f"list_transform(range(strlen({text})), lambda i: CAST(ascii(substr({text}, i + 1, 1)) AS BIGINT))"
    return (
        f"xor(list_reduce({bytes_of}, lambda v, b: xor(remainders[1 + (xor(v, b) & 255)], v >> 8), 4294967295),"
        " 4294967295)"
    )


# `nodes` holds all levels of all trees; source trees first, then, from their roots, the tree -1.
_MERKLE_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, d AS (
    SELECT row_number() OVER () AS no, doc_id, source, {_crc_sql("CAST(doc_id AS VARCHAR)")} AS check_sum,
           concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
                  coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                  coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-')) AS begun, text
    FROM documents, crc
), leaves AS (
    SELECT no, doc_id, sha256(begun || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           CASE WHEN check_sum % 2 = 0 THEN sha256(begun || coalesce(
               strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))
           ELSE sha256(begun || coalesce(strlen(text) || ':' || text, '-')) END AS start,
           dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS place,
           count(*) OVER (PARTITION BY source) AS n
    FROM d
), low(tree, level, place, digest, n) AS (
    SELECT tree, 0, place, leaf, n FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
    FROM low WHERE n > 1 GROUP BY tree, level, place // 3, n
), subroots AS (
    SELECT tree, digest, count(*) OVER () AS n FROM low WHERE n = 1
), high(tree, level, place, digest, n) AS (
    SELECT -1, 0, tree, digest, n FROM subroots
    UNION ALL
    SELECT tree, level + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), (n + 2) // 3
    FROM high WHERE n > 1 GROUP BY tree, level, place // 3, n
), nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
runs AS (
    SELECT tree, level, place // 3 AS run, n, list(digest ORDER BY place) AS run_nodes
    FROM nodes GROUP BY tree, level, place // 3, n
), climb(no, tree, level, place, proof, folded) AS (
    SELECT no, tree, 0, place, '', start FROM leaves
    UNION ALL
    SELECT no, CASE WHEN r.n > 1 THEN c.tree ELSE -1 END, CASE WHEN r.n > 1 THEN c.level + 1 ELSE 0 END,
           CASE WHEN r.n > 1 THEN r.run ELSE c.tree END,
           CASE WHEN r.n > 1 THEN proof || coalesce(list_aggregate(
               run_nodes[: c.place % 3] || run_nodes[c.place % 3 + 2 :], 'string_agg', ''), '') ELSE proof END,
           CASE WHEN r.n > 1 THEN sha256(list_aggregate(
               run_nodes[: c.place % 3] || [folded] || run_nodes[c.place % 3 + 2 :], 'string_agg', '')) ELSE folded END
    FROM climb c JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.run = c.place // 3
    WHERE c.tree >= 0 OR r.n > 1
), ends AS (SELECT no, max_by(coalesce(proof, ''), (tree < 0, level)) AS proof, max_by(folded, (tree < 0, level)) AS folded
            FROM climb GROUP BY no)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = r.digest AS verified
FROM leaves l JOIN ends USING (no) JOIN subroots s USING (tree), high r WHERE r.n = 1
"""

ORACLE_SQL |= {"op13_merkle": _MERKLE_SQL}

# `best` holds, after i rows, the cheapest edits to each state (0 empty, 1 system, 2 user, 3
# assistant); `replay` applies the edits one by one.
_REPAIR_SQL = f"""
WITH RECURSIVE {_CRC_TABLE}, named AS (
    SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role,
           coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
    FROM conversations
), chances AS (
    SELECT named.*, {_crc_sql("name")} % 20 AS chance FROM named, crc
), damaged AS (
    SELECT c, turn, CASE WHEN chance = 4 THEN 'user' ELSE role END AS role,
           CASE chance WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM chances, LATERAL unnest(range(CASE chance WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(k)
), ends AS (
    SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
           right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last_char
    FROM damaged
), judged AS (
    SELECT *, CASE WHEN last_char = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
    FROM ends
), letters AS (
    SELECT c, i, turn, role, text, fault, left(role, 1) AS own, coalesce(fault IN ('blank', 'duplicate'), FALSE) AS goes,
           CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS cut,
           left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS pair
    FROM judged
), sums AS (
    SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM letters GROUP BY c
), inserts(q, added, q1) AS (
    VALUES (0, '', 0), (0, 'I', 2), (0, 'II', 3), (1, '', 1), (1, 'I', 2), (1, 'II', 3),
           (2, '', 2), (2, 'I', 3), (3, '', 3), (3, 'I', 2)
), best(c, i, q, way) AS (
    SELECT c, CAST(0 AS BIGINT), 0, {{'cost': 0, 'edits': ''}} FROM sums
    UNION ALL
    SELECT b.c, l.i, e.q2, min({{'cost': b.way.cost + 3 * len(added) + e.cost, 'edits': b.way.edits || added || e.edit}})
    FROM best b JOIN inserts USING (q) JOIN letters l ON l.c = b.c AND l.i = b.i + 1,
         LATERAL (
             SELECT q1 AS q2, 4 AS cost, 'D' AS edit
             UNION ALL SELECT CASE own WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, cut, 'K'
             WHERE NOT goes AND (own = 's' AND q1 = 0 OR own = 'u' AND q1 <> 2 OR own = 'a' AND q1 = 2)
             UNION ALL SELECT CASE WHEN q1 = 2 THEN 3 ELSE 2 END, cut + 3, 'R' WHERE NOT goes) e
    GROUP BY b.c, l.i, e.q2
), chosen AS (
    SELECT b.c, min({{'cost': b.way.cost + 3 * len(added), 'edits': b.way.edits || added}}) AS way
    FROM best b JOIN sums s ON s.c = b.c AND s.n = b.i JOIN inserts USING (q) WHERE q1 IN (0, 3) GROUP BY b.c
), replay(c, t, i, q, edits, text) AS (
    SELECT c, 0, CAST(0 AS BIGINT), 0, way.edits, CAST(NULL AS VARCHAR) FROM chosen
    UNION ALL
    SELECT r.c, t + 1, CASE WHEN edit = 'I' THEN r.i ELSE r.i + 1 END,
           CASE WHEN edit = 'D' THEN q WHEN edit = 'K' AND own = 's' AND q = 0 THEN 1 WHEN q = 2 THEN 3 ELSE 2 END,
           edits,
           CASE WHEN edit = 'D' THEN r.text ELSE concat_ws(chr(10), r.text,
                CASE WHEN edit = 'K' THEN l.role WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':'
                || CASE WHEN edit = 'I' THEN '' ELSE l.text END) END
    FROM (SELECT *, substr(edits, t + 1, 1) AS edit FROM replay WHERE t < len(edits)) r
         LEFT JOIN letters l ON l.c = r.c AND l.i = r.i + 1
)
SELECT n.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0) AS cost,
       coalesce(way.edits, '') AS audit, sha256(coalesce(r.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM named) n LEFT JOIN sums USING (c) LEFT JOIN chosen USING (c)
     LEFT JOIN replay r ON r.c = n.c AND r.t = len(r.edits)
"""

ORACLE_SQL |= {"op11_repair": _REPAIR_SQL}
