"""The registered queries of this subpackage. Those whose results plain SQL can state have SQL that DuckDB runs on small tables;
the others depend on hashes, learned weights or byte offsets, and are tested against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm.byte_bpe import op2_byte_bpe
from fleetlens.llm.fingerprints import op1_fingerprints
from fleetlens.llm.hamming_search import op8_hamming_search
from fleetlens.llm.jaccard_join import op4_jaccard_join
from fleetlens.llm.language_id import op7_language_id
from fleetlens.llm.merkle import op13_merkle_manifest
from fleetlens.llm.phrases import op12_phrases
from fleetlens.llm.pii import op9_pii
from fleetlens.llm.repeats import op10_repeats
from fleetlens.llm.secret_scan import op5_secret_scan
from fleetlens.llm.source_mix import op3_source_mix
from fleetlens.llm.stream_bpe import op11_stream_bpe
from fleetlens.llm.toxicity import op6_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_byte_bpe, op3_source_mix, op4_jaccard_join, op5_secret_scan, op6_toxicity, op7_language_id, op8_hamming_search, op9_pii, op10_repeats, op11_stream_bpe, op12_phrases, op13_merkle_manifest)}


#: Lower-cases A-Z alone; a row for each shingle; links by counted intersections; the least id reachable.
JACCARD_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2])) END AS s FROM words),
rows_ AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rows_ a JOIN rows_ b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.b, s.doc_id)) AS component_id FROM sets s LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = s.doc_id
"""

#: A level at a time, every row beside its ancestor's digest: first by place in its language, then by place of the language.
MERKLE_SQL = r"""
WITH RECURSIVE sums AS (SELECT *, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ord(ch) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS crc FROM documents),
texts AS (SELECT *, concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-')) AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS changed FROM sums),
leaves AS (SELECT doc_id, lang, sha256(concat(head, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-'), tail)) AS leaf, sha256(concat(head, coalesce(strlen(CAST(changed AS VARCHAR)) || ':' || CAST(changed AS VARCHAR), '-'), tail)) AS claimed FROM texts),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
low AS (
  SELECT CAST(1 AS BIGINT) AS w, doc_id, g, i, n, leaf, leaf AS node, claimed AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT w * 2, doc_id, g, i, n, leaf, sha256(concat(a, b)), CASE WHEN i // w % 2 = 0 THEN sha256(concat(folded, b)) ELSE sha256(concat(a, folded)) END, concat(proof, CASE WHEN i // w % 2 = 0 THEN coalesce(b, '') ELSE a END)
  FROM (SELECT *, max(CASE WHEN i // w % 2 = 0 THEN node END) OVER (PARTITION BY g, i // (2 * w)) AS a, max(CASE WHEN i // w % 2 = 1 THEN node END) OVER (PARTITION BY g, i // (2 * w)) AS b FROM low WHERE n > w) q),
tops AS (SELECT doc_id, g, leaf, node AS subroot, folded, proof, (SELECT count(DISTINCT g) FROM placed) AS m FROM low WHERE n <= w),
high AS (
  SELECT CAST(1 AS BIGINT) AS w, doc_id, g, m, leaf, subroot, subroot AS node, folded, proof FROM tops
  UNION ALL
  SELECT w * 2, doc_id, g, m, leaf, subroot, sha256(concat(a, b)), CASE WHEN g // w % 2 = 0 THEN sha256(concat(folded, b)) ELSE sha256(concat(a, folded)) END, concat(proof, CASE WHEN g // w % 2 = 0 THEN coalesce(b, '') ELSE a END)
  FROM (SELECT *, max(CASE WHEN g // w % 2 = 0 THEN node END) OVER (PARTITION BY g // (2 * w)) AS a, max(CASE WHEN g // w % 2 = 1 THEN node END) OVER (PARTITION BY g // (2 * w)) AS b FROM high WHERE m > w) q)
SELECT doc_id, leaf, subroot, node AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = node AS verified FROM high WHERE m <= w
"""

#: All phrases of up to four words counted outright; a candidate's cuts, and the candidates that longer ones hide, by joins on the text.
PHRASES_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS p FROM words, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, p, count(*) AS f FROM grams GROUP BY lang, k, p),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
found AS (SELECT lang, k, p, string_split(p, ' ') AS w, f AS a FROM f WHERE k >= 2 AND f >= 30),
cuts AS (SELECT c.lang, c.p, c.a, i, x.f AS l, y.f AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS i FROM found) c JOIN f x ON x.lang = c.lang AND x.p = array_to_string(c.w[1 : i], ' ') JOIN f y ON y.lang = c.lang AND y.p = array_to_string(c.w[i + 1 : c.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, i) = 1),
inside AS (SELECT DISTINCT lang, array_to_string(w[i : j], ' ') AS p, a FROM (SELECT *, unnest(range(i, k + 1)) AS j FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM found) q) q WHERE j - i + 1 < k AND j > i),
hidden AS (SELECT DISTINCT b.lang, b.p FROM best b JOIN inside i ON i.lang = b.lang AND i.p = b.p AND 100 * i.a >= 80 * b.a),
kept AS (SELECT b.* FROM best b ANTI JOIN hidden h ON h.lang = b.lang AND h.p = b.p)
SELECT * FROM (SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score FROM kept k JOIN total t ON t.lang = k.lang) q WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": JACCARD_SQL, "op12_phrases": PHRASES_SQL, "op13_merkle_manifest": MERKLE_SQL}
