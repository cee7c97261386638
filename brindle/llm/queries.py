"""The registered queries of the training-data operators: whole tables in, contract columns out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, divergence, huffman, language, licenses, lines, neardup, packing, pii, repeats, rules, tiff, whitening
from .workspace import Workspace


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_languages(_table(spark, sf_dir, "documents"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(_table(spark, sf_dir, "documents"), flips=None)


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Workspace(spark, "token-ids").path("files")
    huffman.write_ids(_table(spark, sf_dir, "documents"), path)
    return huffman.read_digest(spark, path)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_matches(_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeats of at least 50 bytes themselves, with all their places, within one document too."""
    return repeats.repeat_groups(_table(spark, sf_dir, "documents"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media_digest(_table(spark, sf_dir, "documents"))


def tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per page of the stored texts; samples by their digest."""
    stored = Workspace(spark, "tiff-pages").write(tiff.store_texts(_table(spark, sf_dir, "documents")), "media", "none")
    return tiff.tiff_pages(stored).withColumn("sha256", F.sha2("data", 256)).drop("data")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2, threshold=80)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_lines": op2_lines,
    "op3_token_ids": op3_token_ids,
    "op4_licenses": op4_licenses,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_repeats": op8_repeats,
    "op9_tiff": op9_tiff,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_whitening": op11_whitening,
    "op12_divergence": op12_divergence,
    "op13_quality": op13_quality,
    "repeat_groups": repeat_groups,
    "tiff_pages": tiff_pages,
    "pipeline": pipeline,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TEMPLATES = [(name, licenses.words_of(text)) for name, text in licenses.TEMPLATES.items()]
_SIZED = [(name, w, min(licenses.SHINGLE, len(w))) for name, w in _TEMPLATES]
_TEMPLATE_ROWS = ", ".join(f"('{name}', '{' '.join(w)}', {k}, {(len(licenses.shingles_of(w, k)) - 1).bit_length()})" for name, w, k in _SIZED)

ORACLE_SQL: dict[str, str] = {
    "op4_licenses": f"""
WITH t AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) v(license, body, size, power)),
tr AS (SELECT license, size, 1 << power step, len(runs) n, unnest(runs) run
       FROM (SELECT *, list_distinct([array_to_string(b[i:i + size - 1], ' ') for i in range(1, len(b) - size + 2)]) runs FROM (SELECT *, string_split(body, ' ') b FROM t))),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') w FROM documents),
ds AS (SELECT doc_id, size, p, array_to_string(w[p + 1:p + size], ' ') run FROM (SELECT doc_id, size, w, unnest(range(0, len(w) - size + 1)) p FROM d, (SELECT DISTINCT size FROM t) WHERE len(w) >= size)),
h AS (SELECT doc_id, license, n, run, step, unnest([p // step * step, p // step * step - step]) b FROM ds JOIN tr USING (size, run)),
m AS (SELECT doc_id, license, b, n, count(DISTINCT run) x FROM h WHERE b >= 0 GROUP BY doc_id, license, b, n)
SELECT doc_id, license, max(x / n) containment, count(DISTINCT b) n_windows, min(b) first_word FROM m WHERE 100 * x >= 80 * n GROUP BY doc_id, license""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item_id, array_to_string(w[p:p + 9], ' ') g, least(len(w), 10) n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) p FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) p FROM d, lens WHERE len(w) >= n)),
h AS (SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT q) n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) q FROM h) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) s FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_near_duplicates": f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+'), lambda x: true) w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) g FROM t),
e AS (SELECT doc_id, len(g) n, unnest(g) x FROM s),
p AS (SELECT a.doc_id u, b.doc_id v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
y AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
r(d, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT y.v, r.c FROM r JOIN y ON y.u = r.d)
SELECT s.doc_id, CAST(len(g) AS BIGINT) n_shingles, min(c) component_id, s.doc_id = min(c) kept FROM s JOIN r ON r.d = s.doc_id GROUP BY s.doc_id, len(g)""",
    "op12_divergence": f"""
WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source, row_number() OVER () r, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') w FROM documents),
c AS (SELECT lang, source, term, count(*) n, count(DISTINCT r) docs FROM (SELECT lang, source, r, unnest(w) term FROM d) GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) total FROM c GROUP BY lang, term HAVING sum(docs) >= 3),
kc AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term),
lv AS (SELECT lang, count(*) v, sum(total) of_lang FROM k GROUP BY lang),
ng AS (SELECT lang, source, sum(n) of_group FROM kc GROUP BY lang, source),
g AS (SELECT DISTINCT lang, source FROM d),
gs AS (SELECT g.lang, g.source, v, of_lang, coalesce(of_group, 0) of_group FROM g JOIN lv ON g.lang = lv.lang LEFT JOIN ng ON ng.lang = g.lang AND ng.source = g.source),
e AS (SELECT gs.lang, gs.source, k.term, coalesce(kc.n, 0) n, 1 + 1000000000::HUGEINT * (coalesce(kc.n, 0) + 1) // (of_group + v) p, 1 + 1000000000::HUGEINT * (total + 1) // (of_lang + v) q
      FROM gs JOIN k ON gs.lang = k.lang LEFT JOIN kc ON kc.lang = gs.lang AND kc.source = gs.source AND kc.term = k.term),
s AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) value FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT x.lang, x.source, 'pair' part, y.source item, coalesce(value, 0) value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
        LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM e WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) "value", CAST(rank AS INTEGER) "rank"
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) rank FROM r) WHERE part = 'pair' OR rank <= 200""",
}
