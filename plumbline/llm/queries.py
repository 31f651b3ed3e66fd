"""The queries opN_<name> of the training-data operators, and SQL for those that SQL can express.

Each one applies its operator, with production parameters, to the whole of its table and derives
the columns that are asked for from what the operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, language, line_dedup, minhash, pieces, secrets, sharding, token_counts, token_output
from .common import documents
from .quality import METRICS, RULES, STOP_WORDS, quality


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file lies; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return sharding.shuffled(documents(spark, sf_dir), 24).select(
        "doc_id",
        (sharding.text_size(text) + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = token_output.TokenOutput(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, end=50256)
    path = made.scratch.path("out")
    made.write(path)
    # Slots and checksums are those of the files; what the files don't say is joined to them.
    stored = token_output.Reader(spark, path).records(F.crc32, "tokens_crc32")
    return stored.join(made.sequences(tokens=False), "slot", "left").select("slot", "shard", "sequence", "doc_ids", F.size("doc_ids").cast("long").alias("n_docs"), "tokens_crc32")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = lambda x: F.concat_ws(":", x["line"].cast("string"), x["last"].cast("string"))
    return line_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_deleted", F.coalesce(F.array_join(F.transform("runs", span), ","), F.lit("")).alias("deleted_runs"), "text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "markov")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return secrets.scan(documents(spark, sf_dir)).select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("markov").alias("n_markov")
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), limit=1024)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(documents(spark, sf_dir))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), size=5, percent=85)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    found = decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir)).select("doc_id", *METRICS, "base_failed", "kept")


def _quality_sql() -> str:
    stops = ", ".join(f"'{y}'" for y in sorted({y for x in STOP_WORDS for y in (x, x.capitalize(), x.upper())}))
    tests = []
    for r in RULES:
        test = " AND ".join([f"100 * {r.numerator} >= {r.low} * {r.denominator}"] * (r.low is not None) + [f"100 * {r.numerator} <= {r.high} * {r.denominator}"] * (r.high is not None))
        tests.append(f"(n_words < {r.least} OR ({test}))" if r.least else f"({test})")
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM d, unnest(range(1, len(w) - 3)) AS u(i)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(5) AS r(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: x IN ({stops}))) AS BIGINT) AS n_stop,
    CAST(length(regexp_replace(t, '[^!]', '', 'g')) AS BIGINT) AS n_exclaims,
    CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_filter(l, lambda x: substr(ltrim(x, ' '), 1, 2) IN ('- ', '* ', '• '))) AS BIGINT) AS n_bullets,
    CAST(len(list_filter(l, lambda x: rtrim(x, ' ').ends_with('...') OR rtrim(x, ' ').ends_with('…'))) AS BIGINT) AS n_ellipsis
  FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b"""


def _line_dedup_sql(least: int = line_dedup.MIN_WORDS) -> str:
    return rf"""
WITH l AS (
  SELECT doc_id, i - 1 AS i, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS p, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM l WHERE n > 0),
-- the shortest runs of {least} words from each line and to each line
r AS (
  SELECT a.doc_id, a.p, min(b.p) AS q FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {least - 1} AND b.upto - a.upto + a.n >= {least} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.p) AS p, b.p AS q FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {least - 1} AND b.upto - a.upto + a.n >= {least} GROUP BY b.doc_id, b.p),
c AS (SELECT r.doc_id, r.p, r.q, min(s.i) AS line, max(s.i) AS last, string_agg(x, chr(10) ORDER BY s.i) AS content FROM r JOIN s ON s.doc_id = r.doc_id AND s.p BETWEEN r.p AND r.q GROUP BY ALL),
f AS (SELECT *, min(struct_pack(d := doc_id, p := p)) OVER (PARTITION BY content) AS first FROM c),
gone AS (SELECT DISTINCT l.doc_id, l.i FROM f JOIN l ON l.doc_id = f.doc_id AND l.i BETWEEN line AND last WHERE struct_pack(d := f.doc_id, p := f.p) > first),
isle AS (SELECT doc_id, min(i) AS a, max(i) AS b, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id, g),
runs AS (SELECT doc_id, sum(n) AS n_deleted, string_agg(a || ':' || b, ',' ORDER BY a) AS deleted_runs FROM isle GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(x, chr(10) ORDER BY l.i) AS text FROM l ANTI JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT d.doc_id, CAST(CASE WHEN length(d.text) > 0 THEN len(string_split(d.text, chr(10))) ELSE 0 END AS BIGINT) AS n_lines, CAST(coalesce(n_deleted, 0) AS BIGINT) AS n_deleted,
  coalesce(deleted_runs, '') AS deleted_runs, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _decontamination_sql(window: int = decontaminate.WINDOW) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, w, least({window}, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, list_slice(w, k, k + n - 1) AS g FROM b, unnest(range(1, len(w) - n + 2)) AS u(k)),
spot AS (SELECT doc_id, k, n, list_slice(w, k, k + n - 1) AS g FROM d, (SELECT DISTINCT n FROM win) AS x, unnest(range(1, len(w) - n + 2)) AS u(k)),
hit AS (SELECT doc_id, k, spot.n, item_id FROM spot JOIN win ON win.n = spot.n AND win.g = spot.g),
covered AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hit, unnest(range(n)) AS v(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _minhash_sql(size: int = 5, percent: int = 85) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, k, k + {size - 1}) AS g FROM d, unnest(range(1, greatest(len(w) - {size - 1}, 1) + 1)) AS u(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
-- texts with equal sets stand for one another
c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS rep FROM (SELECT doc_id, string_agg(CAST(g AS VARCHAR), chr(10) ORDER BY g) AS h FROM s GROUP BY doc_id)),
t AS (SELECT s.doc_id, g FROM s JOIN c USING (doc_id) WHERE rep = doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS m FROM t x JOIN t y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {100 + percent} * m >= {percent} * (x.n + y.n)),
links AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
comp AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least, d.doc_id) AS component_id, coalesce(least, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN comp ON comp.a = c.rep"""


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_token_output": op2_token_output,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_line_dedup": op4_line_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_token_counts": op6_token_counts,
    "op7_language": op7_language,
    "op8_minhash": op8_minhash,
    "op9_decontamination": op9_decontamination,
    "op10_quality_rules": op10_quality_rules,
}
ORACLE_SQL = {
    "op4_line_dedup": _line_dedup_sql(),
    "op8_minhash": _minhash_sql(),
    "op9_decontamination": _decontamination_sql(),
    "op10_quality_rules": _quality_sql(),
}
