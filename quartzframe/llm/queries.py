"""The queries of this subpackage: opN_<name>(spark, sf_dir) over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quartzframe.llm import common, html_extract, license_scan, mixing, packing, pii, quality_model, quality_rules, simhash, suffix_dedup, topk


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pii_key(spark: SparkSession) -> str:
    """The session's quartzframe.pii.key. Without one, a key that everybody knows: enough for synthetic tables only."""
    return spark.conf.get("quartzframe.pii.key", None) or "published-demonstration-key"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.read(spark, sf_dir, "documents"), tokenizer_path())


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(common.read(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(common.read(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(common.read(spark, sf_dir, "documents")).drop("source")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(common.read(spark, sf_dir, "pages"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(common.read(spark, sf_dir, "documents"), pii_key(spark))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.read(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(common.read(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_topk": op2_topk,
        "op3_license_scan": op3_license_scan,
        "op4_mixing": op4_mixing,
        "op5_html_extract": op5_html_extract,
        "op6_pii": op6_pii,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_quality_model": op8_quality_model,
        "op9_quality_rules": op9_quality_rules,
        "op10_simhash": op10_simhash,
    }


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.rid <> c.rid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INT AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""

def _op3_sql() -> str:
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in license_scan.PHRASES.items())
    rows = license_scan.rules()
    texts = ", ".join(f"({i}, '{r['label']}', {r['need']}, {r['span']}, {r['tokens']}, {r['telling']}::VARCHAR[])" for i, r in enumerate(rows))
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT rid, doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs),
phrase(p, label) AS (VALUES {phrases}),
place AS (
  SELECT rid, label, i - 1 AS place_no FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM words), phrase
  WHERE w[i] = string_split(p, ' ')[1] AND list_slice(w, i, i + len(string_split(p, ' ')) - 1) = string_split(p, ' ')),
based AS (
  SELECT rid, count(*) AS n_base, min(place_no) AS first_word, max(place_no) AS last_word, list(DISTINCT label) AS found FROM place GROUP BY rid),
template(id, label, need, span, t, telling) AS (VALUES {texts}),
near AS (SELECT rid, w, template.* FROM words, template WHERE len(list_intersect(w, t)) >= need),
place_of AS (SELECT * FROM (SELECT rid, id, t, span, unnest(w) AS word, unnest(range(len(w))) AS pos FROM near) WHERE list_contains(t, word)),
hit AS (
  SELECT rid, id, list_distinct(list(word) OVER (PARTITION BY rid, id ORDER BY pos RANGE BETWEEN CURRENT ROW AND span - 1 FOLLOWING)) AS held FROM place_of),
matched AS (
  SELECT rid, list(DISTINCT label) AS found, max(len(held) / len(t)) AS containment FROM hit JOIN template USING (id)
  WHERE len(held) >= need AND list_has_all(held, telling) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(list_sort(coalesce(b.found, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.found, []), coalesce(m.found, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.containment, 0)::DOUBLE END AS score
FROM words LEFT JOIN based b USING (rid) LEFT JOIN matched m USING (rid)
"""


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::BIGINT AS weight
  FROM sized GROUP BY source),
capped AS (
  SELECT *, weight * ((1.5::DOUBLE * total - cap_before) / (total_weight - weight_before)) > cap AS is_capped FROM (
    SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS total_weight, source_size * 2 AS cap,
           coalesce(sum(source_size * 2) OVER f, 0)::BIGINT AS cap_before, coalesce(sum(weight) OVER f, 0)::BIGINT AS weight_before
    FROM src
    WINDOW f AS (ORDER BY (source_size * 2)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))),
target AS (
  SELECT source, source_size, CASE WHEN is_capped THEN cap::DOUBLE ELSE
    weight * ((1.5::DOUBLE * total - coalesce(sum(cap) FILTER (is_capped) OVER (), 0)::BIGINT)
              / (total_weight - coalesce(sum(weight) FILTER (is_capped) OVER (), 0)::BIGINT)) END AS target
  FROM capped),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS epochs,
         floor(target + 0.5)::BIGINT - (CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END) * source_size AS rest
  FROM target),
ordered AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.epochs, b.rest,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key))::BIGINT AS upto,
         (sum(s.size) OVER (PARTITION BY s.source, s.key))::BIGINT AS tied
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       epochs * size + CASE WHEN upto <= rest THEN size WHEN upto - tied < rest THEN (rest - upto + tied) * size // tied ELSE 0 END AS taken
FROM ordered
"""


OP9_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS lines FROM docs),
line AS (
  SELECT rid, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) AS normal
  FROM (SELECT rid, source, unnest(lines) AS line FROM split)),
boiler AS (
  SELECT source, normal FROM (SELECT DISTINCT l.source, normal, text FROM line l JOIN docs USING (rid)) WHERE normal <> ''
  GROUP BY source, normal HAVING count(*) >= 10),
removed AS (
  SELECT rid, sum(n) AS n FROM line l JOIN boiler b ON l.source IS NOT DISTINCT FROM b.source AND l.normal = b.normal
  GROUP BY rid),
win AS (
  SELECT rid, i, list_slice(words, i, i + 7) AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) > 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM win) WHERE n > 1),
rep AS (
  SELECT rid, sum(least(8, coalesce(next, i + 8) - i)) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next FROM twice)
  GROUP BY rid),
dup AS (SELECT rid, sum(n - 1) AS n FROM (SELECT rid, line, count(*) AS n FROM line WHERE n > 0 GROUP BY rid, line) GROUP BY rid),
figures AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words, (len(words) - coalesce(removed.n, 0))::BIGINT AS n_left_words
  FROM split LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN removed USING (rid))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_left_words >= 20 AND n_left_words >= 0.2 * n_words AS kept
FROM figures
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op3_license_scan": _op3_sql(), "op4_mixing": OP4_SQL, "op9_quality_rules": OP9_SQL}
