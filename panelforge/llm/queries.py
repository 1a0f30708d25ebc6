"""The queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(common.table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import secret_digests

    return secret_digests(common.table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_jaccard import jaccard_components

    return jaccard_components(common.table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .token_files import read_shards, write_shards

    return read_shards(write_shards(common.table(spark, sf_dir, "documents"), tokenizer or common.tokenizer_file("word_bpe_49k.json")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import document_files, licensed

    return licensed(document_files(common.table(spark, sf_dir, "documents")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_blocks import extracted

    return extracted(common.table(spark, sf_dir, "pages"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(common.table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    from .bpe import bpe_digests

    return bpe_digests(common.table(spark, sf_dir, "documents"), tokenizer or common.tokenizer_file("byte_bpe_50k.json"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_license_scan": op5_license_scan,
    "op6_html_extraction": op6_html_extraction,
    "op7_media_columns": op7_media_columns,
    "op8_bpe": op8_bpe,
    "op9_secret_scan": op9_secret_scan,
    "op10_ngram_jaccard": op10_ngram_jaccard,
}

WORD = r"[^\x20\x09-\x0D]+"


def _secret_sql() -> str:
    """One part per rule: matches, the pieces between them, and the starts that both give."""
    from .secret_scan import RULES

    parts = []
    for i, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(
            f"""SELECT doc_id, {i} AS kind, '{r.kind}' AS name, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s, length(m[i]) AS n, length(g[i]) AS t, {r.least} AS least
            FROM (SELECT doc_id, m, g, b, unnest(generate_series(1, len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {r.group}) AS g, string_split_regex(t, '{pattern}') AS b FROM d))"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS ({" UNION ALL ".join(parts)}),
k AS (SELECT doc_id, kind, s, name || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT) AS told FROM a WHERE t >= least)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(told, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(told, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN k ON d.doc_id = k.doc_id GROUP BY d.doc_id"""


def _license_sql() -> str:
    """Passages and their words as rows, joined to the templates' vectors."""
    from .license_scan import FILE_SHARE, LEAST, TEMPLATES, TRADE, VERSIONS, template_vectors

    vectors, idf, other = template_vectors()
    trade = TRADE.removeprefix("(?i)")
    vector_rows = ", ".join(f"({i}, '{w}', {x})" for i, v in enumerate(vectors) for w, x in v.items())
    idf_rows = ", ".join(f"('{w}', {x})" for w, x in idf.items())
    name_rows = ", ".join(f"({i}, '{n}', {f"'{VERSIONS[n]}'" if n in VERSIONS else 'NULL'})" for i, (n, _) in enumerate(TEMPLATES))
    return f"""
WITH v(i, w, x) AS (VALUES {vector_rows}), f(w, x) AS (VALUES {idf_rows}), n(i, name, version) AS (VALUES {name_rows}),
d AS (SELECT doc_id, concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), CASE WHEN doc_id % 4 > 0 THEN CAST(floor(doc_id / 10000) AS BIGINT) END, CASE WHEN doc_id % 4 > 1 THEN CAST(floor(doc_id / 1000) AS BIGINT) END, CASE WHEN doc_id % 4 > 2 THEN CAST(floor(doc_id / 100) AS BIGINT) END) AS home, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, unnest(range(1, len(ls) + 1)) AS k, unnest(ls) AS line FROM (SELECT doc_id, t, string_split(t, chr(10)) AS ls FROM d WHERE regexp_matches(t, '{trade}', 'i'))),
p AS (SELECT doc_id, k, regexp_extract_all(lower(line), '[a-z0-9]+') AS ws FROM l WHERE regexp_matches(line, '{trade}', 'i')),
u AS (SELECT doc_id, k, len(ws) AS words, unnest(ws) AS w FROM p),
q AS (SELECT u.doc_id, k, words, u.w, count(*) * coalesce(any_value(f.x), {other}) AS x FROM u LEFT JOIN f ON f.w = u.w GROUP BY u.doc_id, k, words, u.w),
z AS (SELECT doc_id, k, sqrt(sum(x * x)) AS norm FROM q GROUP BY doc_id, k),
c AS (SELECT q.doc_id, q.k, words, v.i, round(sum(q.x * v.x) / any_value(norm), 6) AS score FROM q JOIN z ON z.doc_id = q.doc_id AND z.k = q.k JOIN v ON v.w = q.w GROUP BY q.doc_id, q.k, words, v.i),
ok AS (SELECT c.* FROM c JOIN n ON n.i = c.i WHERE version IS NULL OR EXISTS (SELECT 1 FROM q WHERE q.doc_id = c.doc_id AND q.k = c.k AND q.w = version)),
b AS (SELECT doc_id, score, i, words FROM ok QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i, words DESC) = 1),
o AS (SELECT d.doc_id, home, home || '/' || CAST(d.doc_id AS VARCHAR) AS path, name, score, words >= {FILE_SHARE} * len(regexp_split_to_array(trim(t, ' '), '[ \t\n\x0B\f\r]+')) AS is_file
      FROM d LEFT JOIN (SELECT * FROM b WHERE score >= {LEAST}) AS b ON b.doc_id = d.doc_id LEFT JOIN n ON n.i = b.i),
g AS (SELECT home, name FROM o WHERE name IS NOT NULL AND is_file QUALIFY row_number() OVER (PARTITION BY home ORDER BY path, name) = 1),
h AS (SELECT DISTINCT home FROM o),
up AS (SELECT home, k, array_to_string(string_split(home, '/')[1:k], '/') AS above FROM (SELECT home, unnest(range(0, len(string_split(home, '/')) + 1)) AS k FROM h)),
near AS (SELECT up.home, g.name, g.home AS at FROM up JOIN g ON g.home = up.above QUALIFY row_number() OVER (PARTITION BY up.home ORDER BY k DESC) = 1)
SELECT o.doc_id, o.path, coalesce(o.name, near.name) AS license, CASE WHEN o.name IS NOT NULL THEN 'own' WHEN near.name IS NOT NULL THEN 'inherited' ELSE 'none' END AS how, o.score,
  CASE WHEN o.name IS NULL AND near.name IS NOT NULL THEN near.at END AS license_dir
FROM o LEFT JOIN near ON near.home = o.home"""


SQL = {
    "op1_substring_dedup": rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
g AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 12], ' ')) AS win FROM p WHERE i + 12 <= len(ws)),
f AS (SELECT win, min(doc_id) AS m FROM g GROUP BY win),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i FROM g JOIN f USING (win) WHERE m < doc_id),
k AS (SELECT p.doc_id, count(*) AS n, count(gone.i) AS r, coalesce(string_agg(p.ws[p.i], ' ' ORDER BY p.i) FILTER (gone.i IS NULL), '') AS kept
      FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i GROUP BY p.doc_id)
SELECT w.doc_id, coalesce(k.n, 0) AS n_words, coalesce(k.r, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id""",
    "op10_ngram_jaccard": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM o JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r AS (SELECT DISTINCT x AS doc_id, x AS near FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.near),
m AS (SELECT doc_id, min(near) AS near FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.near, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id""",
    "op9_secret_scan": _secret_sql(),
    "op5_license_scan": _license_sql(),
}
