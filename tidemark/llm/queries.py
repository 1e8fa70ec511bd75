"""Named queries of the operators, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import capture_index, exact_dedup, license_scan, line_dedup, merkle_manifest, ngram_join, packing, periodic_runs, quality_classifier, quality_rules, sentencepieces, sharding, token_counts
from tidemark.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

QUERIES["op1_hypergeometric_shards"] = lambda spark, sf_dir: sharding.placed_documents(table(spark, sf_dir, "documents"))

QUERIES["op2_exact_dedup"] = lambda spark, sf_dir: exact_dedup.marked_documents(spark, f"{sf_dir}/documents.parquet")
ORACLES["op2_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW best AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST)
"""

QUERIES["op3_mcd_quality"] = lambda spark, sf_dir: quality_rules.statistics_and_verdicts(table(spark, sf_dir, "documents"))

QUERIES["op6_length_buckets"] = lambda spark, sf_dir: packing.packed_documents(table(spark, sf_dir, "documents"))

QUERIES["op7_line_windows"] = lambda spark, sf_dir: line_dedup.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")
ORACLES["op7_line_windows"] = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL
), f AS (
  SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line FROM l
), w AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER p AS b, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS body
  FROM f WHERE line <> '' WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), later AS (
  SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, a) AS k FROM w WHERE b IS NOT NULL) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM later
), done AS (
  SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL) AS text
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.i = gone.i GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::INTEGER AS n_lines, coalesce(n_removed, 0)::INTEGER AS n_removed, CASE WHEN d.text IS NOT NULL THEN coalesce(done.text, '') END AS text
FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
"""

QUERIES["op8_compression_classifier"] = lambda spark, sf_dir: quality_classifier.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

QUERIES["op5_capture_index"] = lambda spark, sf_dir: capture_index.archived_pages(table(spark, sf_dir, "pages"))
ORACLES["op5_capture_index"] = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
m AS (SELECT page_id, octet_length(body) AS payload_bytes, upper(sha1(body)) AS digest, max(page_id) OVER (PARTITION BY body) AS best FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(digest, ((k // 4) * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (k % 4))::BIGINT) & 31) + 1)::INTEGER, 1)), '') AS base32 FROM m
)
SELECT page_id, payload_bytes, base32 AS payload_digest, CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM b
"""

QUERIES["op9_prefix_tree_join"] = lambda spark, sf_dir: ngram_join.near_duplicates(table(spark, sf_dir, "documents"))
ORACLES["op9_prefix_tree_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS shingles FROM d
), t AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, m.b AS component_id FROM s JOIN (SELECT a, min(b) AS b FROM r GROUP BY a) m ON m.a = s.doc_id
"""

#: Vocabulary file of op10; any SentencePiece BPE model with byte fallback will do.
PIECES_FILE = "/opt/tokenizers/piece_bpe_32k.model"
QUERIES["op10_sentencepiece"] = lambda spark, sf_dir: sentencepieces.encoded_documents(table(spark, sf_dir, "documents"), PIECES_FILE)

QUERIES["op4_license_scan"] = lambda spark, sf_dir: license_scan.licensed_documents(table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in license_scan.TEMPLATES.items())
    split = r"""list_filter(regexp_split_to_array(translate(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.,;:!?()[]"''', ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""
    return f"""
WITH t AS (SELECT license, {split} AS w FROM (VALUES {values}) v(license, text)),
tn AS (SELECT license, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS shingle FROM t),
ts AS (SELECT *, count(*) OVER (PARTITION BY license) AS n FROM tn),
d AS (SELECT doc_id, {split} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d),
m AS (SELECT doc_id, license, n, greatest(1, n // 4) AS stride, i - 1 AS i, shingle FROM (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS shingle FROM p) JOIN ts USING (shingle)),
s AS (SELECT doc_id, license, n, shingle, unnest(range(((greatest(0, i - (n + stride - 2)) + stride - 1) // stride) * stride, i + 1, stride)) AS start FROM m),
x AS (SELECT doc_id, license, n, start, count(DISTINCT shingle) AS matched FROM s GROUP BY ALL)
SELECT doc_id, license, count(*) AS windows, min(start)::INTEGER AS first_word, max(matched)::INTEGER AS matched, max(matched / n) AS containment
FROM x WHERE 100 * matched >= 80 * n GROUP BY doc_id, license
"""


ORACLES["op4_license_scan"] = _license_sql()

#: Vocabulary file of op13: BPE with word ends.
WORDS_FILE = "/opt/tokenizers/word_bpe_49k.json"
QUERIES["op13_token_counts"] = lambda spark, sf_dir: token_counts.counted_documents(table(spark, sf_dir, "documents"), WORDS_FILE)

QUERIES["op11_periodic_runs"] = lambda spark, sf_dir: periodic_runs.runs_of_documents(table(spark, sf_dir, "documents"))

QUERIES["op12_merkle_manifest"] = lambda spark, sf_dir: merkle_manifest.proven_documents(table(spark, sf_dir, "documents"))


def _merkle_sql() -> str:
    fields = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
    # the nodes of all levels; a level of one node is the last
    climb = "SELECT k, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY i)) FROM {t} WHERE n > 1 GROUP BY k, level, i // 3, n"
    # siblings of row x at each level, as what stands left and right of it
    steps = """SELECT x.row, t.level, coalesce(string_agg(t.hash, '' ORDER BY t.i) FILTER (WHERE t.i < x.i // pow(3, t.level)::BIGINT), '') AS l,
    coalesce(string_agg(t.hash, '' ORDER BY t.i) FILTER (WHERE t.i > x.i // pow(3, t.level)::BIGINT), '') AS r
  FROM {x} x JOIN {t} t ON t.k IS NOT DISTINCT FROM x.k AND t.n > 1 AND t.i // 3 = x.i // pow(3, t.level + 1)::BIGINT GROUP BY x.row, t.level"""
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source AS k, {fields.format(text="text")} AS leaf, {fields.format(text="replace(text, chr(10), '')")} AS cut,
    list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) & 1 = 1 AS even
  FROM documents
), x AS (
  SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM d
), t AS (SELECT k, 0 AS level, i, n, leaf AS hash FROM x UNION ALL {climb.format(t="t")}),
g AS (SELECT k AS source, 0 AS k, hash, row_number() OVER () AS row, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT k, 0 AS level, i, n, hash FROM g UNION ALL {climb.format(t="u")}),
p AS ({steps.format(x="x", t="t")}),
q AS ({steps.format(x="g", t="u")}),
inner_path AS (SELECT row, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM p GROUP BY row),
outer_path AS (SELECT row, list({{'l': l, 'r': r}} ORDER BY level) AS path FROM q GROUP BY row),
w AS (
  SELECT x.doc_id, x.leaf, g.hash AS subroot, (SELECT hash FROM u WHERE n = 1) AS root, coalesce(ip.path, []) || coalesce(op.path, []) AS path, CASE WHEN even THEN cut ELSE leaf END AS found
  FROM x JOIN g ON g.source IS NOT DISTINCT FROM x.k LEFT JOIN inner_path ip ON ip.row = x.row LEFT JOIN outer_path op ON op.row = g.row
), z AS (
  SELECT *, list_reduce(list_prepend({{'l': found, 'r': ''}}, path), lambda a, s: {{'l': sha256(s.l || a.l || s.r), 'r': ''}}).l AS folded_root FROM w
)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z
"""


ORACLES["op12_merkle_manifest"] = _merkle_sql()
