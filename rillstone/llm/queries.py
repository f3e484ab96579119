"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import POINTS, RATES
from .shared import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    tables = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(tables.unionByName(own)))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    placed = sharding.interleaved(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.personal_data(table(spark, sf_dir, "documents"))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffixes

    return suffixes.repeats(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judged(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lines

    return lines.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_chat, op2_shards, op3_personal_data, op4_repeats, op5_toxicity, op6_quality, op7_jaccard_join, op8_line_dedup, op9_packing, op10_decontamination)
}

_CTL = r"(\\*)(### |</turn>)"
_WORDS = r"[^ \x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RATE = {rate: f"{count} / greatest(n_words, 1)" for rate, count in RATES.items()}
_QUANTILES = ", ".join(f"quantile_disc(s_{r}, {POINTS}) AS p_{r}" for r in RATES)


def _limit(rate: str) -> str:
    points = f"""
    SELECT lang, source, n AS w, unnest(p_{rate}) AS v FROM g
    UNION ALL SELECT g.lang, g.source, 20, unnest(l.p_{rate}) FROM g JOIN l ON l.lang IS NOT DISTINCT FROM g.lang
    UNION ALL SELECT g.lang, g.source, 20, unnest(e.p_{rate}) FROM g CROSS JOIN e"""
    summed = f"SELECT *, sum(w) OVER (PARTITION BY lang, source ORDER BY v) AS c, sum(w) OVER (PARTITION BY lang, source) AS t FROM ({points})"
    return f"m_{rate} AS (SELECT lang, source, b * pow(b / a, 2.0) AS m_{rate} FROM (SELECT lang, source, min(v) FILTER (4 * c >= t) AS a, min(v) FILTER (4 * c >= 3 * t) AS b FROM ({summed}) GROUP BY lang, source))"


_LIMITS = ",\n".join(map(_limit, RATES))
_JOINS = " ".join(f"LEFT JOIN m_{r} ON m_{r}.lang IS NOT DISTINCT FROM r.lang AND m_{r}.source IS NOT DISTINCT FROM r.source" for r in RATES)
_RULES = ", ".join(f"CASE WHEN NOT base_failed AND {r} > m_{r} THEN '{r}' END" for r in RATES)

ORACLES: dict[str, str] = {
    "op1_chat": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(replace(replace(role, '%', '%25'), '#', '%23'), '<', '%3C'), chr(10), '%0A') AS mark,
    regexp_replace(text, '{_CTL}', '\\\1\2', 'g') AS body FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(mark) + length(body) + 14) AS BIGINT) AS formatted_chars, true AS round_trip
FROM marked GROUP BY conv_id""",
    "op8_line_dedup": r"""
WITH split AS (
  SELECT doc_id, hash(text) AS t, i - 1 AS i, x, regexp_matches(x, '[^ \x09-\x0D]') AS has_word
  FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
windows AS (
  SELECT doc_id, i AS i0, lead(i, 1) OVER w AS i1, lead(i, 2) OVER w AS i2, x AS x0, lead(x, 1) OVER w AS x1, lead(x, 2) OVER w AS x2
  FROM split WHERE has_word WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, i0, i1, i2 FROM windows WHERE x2 IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY x0, x1, x2 ORDER BY doc_id, i0) > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM later),
kept AS (
  SELECT s.doc_id, count(*) FILTER (s.has_word) AS n_lines, count(g.i) AS n_removed,
    string_agg(s.x, chr(10) ORDER BY s.i) FILTER (g.i IS NULL) AS text
  FROM split s LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.i = g.i GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents d LEFT JOIN kept k USING (doc_id)""",
    "op10_decontamination": rf"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all({_LOWER}, '{_WORDS}') FROM benchmark),
s AS (
  SELECT DISTINCT kind, id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n AS n_shingles, count(*) AS n_found
FROM s d JOIN s i ON d.s = i.s AND d.kind = 0 AND i.kind = 1 JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n HAVING count(*) * 100 >= n.n * 75""",
    "op4_repeats": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i - 1 AS i, array_to_string(w[i:i + 49], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
rep AS (
  SELECT doc_id, i, first(doc_id) OVER p AS fd, first(i) OVER p AS fi, count(*) OVER (PARTITION BY x) AS n
  FROM win WINDOW p AS (PARTITION BY x ORDER BY doc_id, i)),
cut AS (
  SELECT *, (doc_id <> fd OR i <> fi) AS later, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM rep WHERE n > 1),
span AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM cut),
dup AS (
  SELECT doc_id, s, CAST(sum(least(50, coalesce(i - before, 50))) AS BIGINT) AS n
  FROM (SELECT doc_id, s, i, lag(i) OVER (PARTITION BY doc_id, s ORDER BY i) AS before FROM span WHERE later) GROUP BY doc_id, s)
SELECT doc_id, min(i) AS start_word, max(i) + 50 - min(i) AS n_words, coalesce(any_value(dup.n), 0) AS n_duplicate,
  arg_min(fd, i) AS first_doc_id, arg_min(fi, i) AS first_word
FROM span LEFT JOIN dup USING (doc_id, s) GROUP BY doc_id, s""",
    "op6_quality": rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS n FROM win) WHERE n > 1),
again AS (SELECT doc_id, CAST(sum(least(5, coalesce(i - before, 5))) AS BIGINT) AS n FROM twice GROUP BY doc_id),
c AS (
  SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words
  FROM (SELECT *, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^ \x09-\x0D]')] AS l FROM d) d LEFT JOIN again USING (doc_id)),
r AS (
  SELECT *, {", ".join(f"{x} AS {r}, ({RATES[r]} + 1) / greatest(n_words, 1) AS s_{r}" for r, x in _RATE.items())},
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
g AS (SELECT lang, source, count(*) AS n, {_QUANTILES} FROM r WHERE NOT base_failed GROUP BY lang, source),
l AS (SELECT lang, {_QUANTILES} FROM r WHERE NOT base_failed GROUP BY lang),
e AS (SELECT {_QUANTILES} FROM r WHERE NOT base_failed),
{_LIMITS},
j AS (SELECT r.*, concat_ws(',', {_RULES}) AS failed_rules FROM r {_JOINS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM j""",
    "op7_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a, b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS both_n FROM s l JOIN s r ON l.s = r.s AND l.doc_id <> r.doc_id GROUP BY ALL)
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, b FROM reach JOIN link ON link.a = other)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
}
