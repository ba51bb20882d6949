"""Registered queries of the training-data operators, with production parameters.

Each reads its whole table and returns its operator's rows; ``ORACLE`` has DuckDB SQL
for those that SQL can express. The others are tested in ``tests/llm`` against
brute force, an exact round trip or held-out accuracy.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobsift.llm.bpe_codec import bpe_encode, digests
from jobsift.llm.cap_filters import embedding_dedup
from jobsift.llm.decontaminate import contaminated
from jobsift.llm.fill_in_middle import MIDDLE, PREFIX, SUFFIX, fill_in_middle, restored
from jobsift.llm.html_extract import extract_pages
from jobsift.llm.license_scan import PHRASES, TEMPLATES, license_scan, templates_of
from jobsift.llm.line_dedup import MIN_PAGES, RATIO, line_dedup
from jobsift.llm.minhash import minhash_dedup
from jobsift.llm.ngram_lm import score, train, training_row
from jobsift.llm.periodic_runs import periodic_runs, plant_run
from jobsift.llm.store import table
from jobsift.llm.token_counts import token_counts
from jobsift.llm.token_files import read_tokens, write_tokens
from jobsift.llm.toxicity import learn, score_toxicity, training_fold

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~training_fold(F.col("doc_id"), 3, 1)).alias("held_out"), "score", "predicted")


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return read_tokens(spark, path, with_ids=False)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents"), distinct=True).select("doc_id", "text", "n_lines", "n_dropped")


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op8_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs.where(training_row(F.col("doc_id")))))
    return scored.select("doc_id", (~training_row(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=plant_run)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
                        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_toxicity": op3_toxicity,
    "op4_bpe_codec": op4_bpe_codec,
    "op5_token_files": op5_token_files,
    "op6_line_dedup": op6_line_dedup,
    "op7_cap_filters": op7_cap_filters,
    "op8_ngram_lm": op8_ngram_lm,
    "op9_decontaminate": op9_decontaminate,
    "op10_html_extract": op10_html_extract,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_license_scan": op13_license_scan,
}


def _license_sql() -> str:
    """Operator 13 in SQL: every window of a width with every template of it, and no filters."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    sets = templates_of(TEMPLATES)
    words = ", ".join(f"({i}, {quoted(w.decode())}, {w in t.must})" for i, t in enumerate(sets) for w in sorted(t.words))
    heads = ", ".join(f"({i}, {quoted(t.label)}, {t.width}, {t.need}, {len(t.words)}, {len(t.must)})" for i, t in enumerate(sets))
    hits = " UNION ALL ".join(
        f"SELECT doc_id, pos, {quoted(label)} AS label FROM w WHERE "
        + " AND ".join(f"{'word' if i == 0 else f'w{i}'} = {quoted(x)}" for i, x in enumerate(text.split()))
        for text, label in PHRASES)
    most = max(len(text.split()) for text, _ in PHRASES)
    ahead = ", ".join(f"lead(word, {i}) OVER (PARTITION BY doc_id ORDER BY pos) AS w{i}" for i in range(1, most))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
u AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM d),
w AS (SELECT doc_id, word, pos, {ahead} FROM u),
hits AS ({hits}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY doc_id),
template_words(template, word, required) AS (VALUES {words}),
template_heads(template, label, width, need, size, musts) AS (VALUES {heads}),
held AS (SELECT u.doc_id, u.pos, u.word, t.required, h.* FROM u JOIN template_words t ON u.word = t.word JOIN template_heads h ON t.template = h.template),
windows AS (SELECT *, pos // (width // 2) - k AS number FROM held, (VALUES (0), (1)) AS x(k)),
shares AS (SELECT doc_id, label, count(DISTINCT word) / size AS share FROM windows WHERE number >= 0
  GROUP BY doc_id, number, template, label, size, need, musts
  HAVING count(DISTINCT word) >= need AND count(DISTINCT CASE WHEN required THEN word END) = musts),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM shares GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(b.n_base, 0) AS BIGINT) AS n_base, CAST(b.first_word AS BIGINT) AS first_word,
  CAST(b.last_word AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
  CAST(CASE WHEN b.n_base > 0 THEN 1 ELSE coalesce(f.share, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base b ON d.doc_id = b.doc_id LEFT JOIN found f ON d.doc_id = f.doc_id"""


ORACLE: dict[str, str] = {
    "op6_line_dedup": f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
pages AS (SELECT DISTINCT source, coalesce(text, '') AS text FROM documents),
total AS (SELECT source, count(*) AS n FROM pages GROUP BY source),
page_lines AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))))) AS line FROM pages),
common AS (SELECT l.source, list(l.line) AS drop_lines
  FROM (SELECT source, line, count(*) AS pages FROM page_lines WHERE line <> '' GROUP BY source, line) l
  JOIN total t ON l.source IS NOT DISTINCT FROM t.source
  WHERE l.pages >= {MIN_PAGES} AND l.pages > CAST({RATIO} AS DOUBLE) * t.n GROUP BY l.source),
kept AS (SELECT d.doc_id, d.text, d.lines,
  list_filter(d.lines, lambda x: NOT list_contains(coalesce(c.drop_lines, []), trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)))) AS kept
  FROM d LEFT JOIN common c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(array_to_string(kept, chr(10)), '') END AS text,
  CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped FROM kept""",
    "op11_fill_in_middle": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
draws AS (SELECT *, length(text) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS x FROM d),
formed AS (SELECT *, CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR x[3] % 100 >= 90 THEN 'plain'
  WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b FROM draws),
cut AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM formed),
made AS (SELECT *, CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
  WHEN 'spm' THEN '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m ELSE text END AS output FROM cut),
parts AS (SELECT *, regexp_split_to_array(output, '<[PSM]>') AS q FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'psm' THEN q[2] || q[4] || q[3] WHEN 'spm' THEN q[3] || q[4] || q[2] ELSE output END) AS restored_sha256 FROM parts""",
    "op13_license_scan": _license_sql(),
}
