"""Driver-facing queries of the corpus operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import decontam, licenses, linededup, media, mixing, neardup, pii, quality, tokens, toxicity

#: Pseudonyms of this key; a deployment passes its own.
PII_KEY = "trackloom-demonstration-key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    """The public tokenizer of the contract; its path is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def decontaminated(spans: DataFrame) -> DataFrame:
    digest = F.sha2(F.array_join("items", ","), 256)
    n_hit, n_words = F.col("n_hit"), F.col("n_words")
    return spans.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontam.contaminated(n_hit, n_words).alias("contaminated"))


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminated(decontam.removal_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def held_out(doc_id) -> object:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    scored = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, similarity=(80, 100))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return linededup.apply_bitmaps(docs, linededup.line_bitmaps(docs), with_text=False).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_output(table(spark, sf_dir, "documents"), tokenizer_file()).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_decontam, op3_mixing, op4_quality, op5_toxicity, op6_neardup, op7_linededup, op8_licenses, op9_media, op10_tokens)}


_OP2 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS s FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, pos.n, i, item FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM d, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), k AS (SELECT s, row_number() OVER (ORDER BY s) AS k FROM (SELECT s FROM sh GROUP BY s HAVING count(*) > 1)), e AS (SELECT doc_id, k FROM sh JOIN k USING (s)),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)), u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS comp FROM n UNION SELECT u.y, r.comp FROM r JOIN u ON r.node = u.x AND r.comp < u.y), m AS (SELECT node, min(comp) AS comp FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.comp, doc_id) AS component_id, coalesce(m.comp, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = doc_id
"""

_OP7 = r"""
WITH l AS (SELECT doc_id, i, part, translate(regexp_replace(regexp_replace(part, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS part, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
h AS (SELECT k, max(doc_id) AS last FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT doc_id, i, part, last IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN h USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""


def _op8() -> str:
    quoted = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses.TEMPLATES.items())
    cut = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    return f"""
WITH t(template, text) AS (VALUES {quoted}),
ts AS (SELECT DISTINCT template, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM (SELECT template, {cut} AS w FROM t), unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS x(i)),
m AS (SELECT template, count(*) AS m FROM ts GROUP BY template),
ds AS (SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s FROM (SELECT doc_id, {cut} AS w FROM documents), unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS x(i) WHERE len(w) > 0),
g AS (SELECT doc_id, template FROM ds JOIN ts USING (s) JOIN m USING (template) GROUP BY doc_id, template, m HAVING 5 * count(*) >= 4 * m)
SELECT doc_id, count(template) AS n_licenses, coalesce(string_agg(template, ',' ORDER BY template), '') AS licenses FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontam": _OP2, "op6_neardup": _OP6, "op7_linededup": _OP7, "op8_licenses": _op8()}
