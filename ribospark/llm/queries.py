"""The registered queries of this subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import LITERAL, MARK, NAME, NUM, UNIT, UNITS, leaks
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .licenses import END, ENDS, FAR, LEADERS, MAX_GAP, OTHER, RULES, SENTENCES, pattern, scan_licenses
from .mixing import mix
from .quality import fit_quality, score_quality
from .sharding import shard_documents
from .suffix_dedup import remove_repeats
from .url_filter import filter_urls
from .warc import archive_pages


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_licenses, op3_jaccard_join, op4_hash_tree, op5_exact_dedup, op6_decontaminate, op7_url_filter, op8_suffix_dedup, op9_mix, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op2_licenses": LICENSES, "op5_exact_dedup": EXACT_DEDUP, "op6_decontaminate": DECONTAMINATE}


#: A-Z are lowered one by one: DuckDB's lower() would change other letters as well.
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, {LOWERED} AS norm FROM documents)
WINDOW same AS (PARTITION BY norm)
"""

_KNOWN = ", ".join(f"('{i}', '{x}')" for i, x in SENTENCES)
_RULES = ", ".join(f"('{name}', '{pattern(ids)}')" for name, ids in RULES)

LICENSES = rf"""
WITH known(sentence_id, sentence) AS (VALUES {_KNOWN}), rules(license, pattern) AS (VALUES {_RULES}),
texts AS (SELECT DISTINCT doc_id, text FROM documents),
cut AS (SELECT doc_id, text, string_split(regexp_replace(regexp_replace(regexp_replace(lower(text), '{LEADERS}', '\1', 'g'), '{ENDS}', '{END}', 'g'), '{OTHER}', ' ', 'g'), '{END}') AS ss FROM texts),
parts AS (SELECT doc_id, text, unnest(range(len(ss))) AS place, unnest(ss) AS s FROM cut),
tried AS (SELECT doc_id, text, place, unnest(range(len(c))) AS sub, regexp_replace(unnest(c), '^[ .\n]+|[ .\n]+$', '', 'g') AS sentence FROM
  (SELECT doc_id, text, place, list_concat([regexp_replace(s, ' *\n *', ' ', 'g')], CASE WHEN contains(s, chr(10)) THEN string_split(s, chr(10)) ELSE [] END) AS c FROM parts)),
found AS (SELECT doc_id, text, place, sub, sentence_id, lag(place) OVER (PARTITION BY doc_id, text ORDER BY place, sub) AS before FROM tried JOIN known USING (sentence)),
seq AS (SELECT doc_id, text, CAST(count(*) AS INTEGER) AS known_sentences, '|' || string_agg(CASE WHEN place - before > {MAX_GAP} THEN '{FAR}' ELSE '' END || sentence_id || '|', '' ORDER BY place, sub) AS ids FROM found GROUP BY doc_id, text),
hit AS (SELECT * FROM seq JOIN rules ON contains(ids, pattern))
SELECT DISTINCT doc_id, known_sentences, license FROM hit h
WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.doc_id = h.doc_id AND o.text = h.text AND o.pattern <> h.pattern AND contains(o.pattern, h.pattern))
"""


def _windows(source: str, key: str, widths: tuple[int, ...]) -> str:
    """SQL of the forms of the windows of ``text``, named by their words instead of a hash; ``s`` holds the values of placeholders."""
    blank = r"[ \t\n\x0B\f\r]"
    bare = f"list_transform(w, lambda x: replace(x, '{MARK}', ''))"
    names = f"list_transform(w, lambda x: CASE WHEN starts_with(x, '{MARK}') THEN '{NAME}' ELSE x END)"
    numbers = f"len(list_filter(w, lambda x: x IN ('{NUM}', '{UNIT}')))"
    named = f"len(list_filter(w, lambda x: starts_with(x, '{MARK}')))"
    forms = []
    for width in widths:
        whole = "OR i = 0" if width == max(widths) else ""
        most = max(width - LITERAL, 0)
        sliced = f"SELECT {key}, n, i AS pos, t[i + 1 : i + {width}] AS w, r[i + 1 : i + {width}] AS r FROM (SELECT *, unnest(range(len(t))) AS i FROM ready) WHERE i <= len(t) - {width} {whole}"
        value = lambda test: f"list_transform(list_zip(w, r), lambda x: CASE WHEN {test} THEN x[2] END)"
        forms.append(f"SELECT {key}, n, pos, array_to_string(CASE WHEN {numbers} <= {most} THEN {bare} ELSE r END, ' ') AS h, CASE WHEN {numbers} <= {most} THEN {value(f"x[1] IN ('{NUM}', '{UNIT}')")} ELSE [] END AS s FROM ({sliced})")
        forms.append(f"SELECT {key}, n, pos, array_to_string({names}, ' ') AS h, {value(f"x[1] IN ('{NUM}', '{UNIT}') OR starts_with(x[1], '{MARK}')")} AS s FROM ({sliced}) WHERE {named} > 0 AND {named} + {numbers} <= {most}")
    return rf"""
    WITH cut AS (SELECT {key}, trim(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(^|[^\p{{L}}\p{{N}}])(\p{{Lu}}\p{{Ll}})', '\1{MARK}\2', 'g'),
        '[^\p{{L}}\p{{N}}{MARK} \t\n\x0B\f\r]+', '', 'g'), '{blank}+', ' ', 'g'))) AS plain FROM {source}),
    ready AS (SELECT {key}, string_split(regexp_replace(regexp_replace(plain, '[^ ]*[0-9][^ ]*', '{NUM}', 'g'), '{NUM} ({UNITS})( |$)', '{NUM} {UNIT}\2', 'g'), ' ') AS t,
        string_split(replace(plain, '{MARK}', ''), ' ') AS r, greatest(len(string_split(plain, ' ')) - {max(widths) - 1}, 1) AS n FROM cut WHERE plain <> '')
    {" UNION ALL ".join(forms)}"""


DECONTAMINATE = rf"""
WITH items AS ({_windows("benchmark", "item_id", (5,))}), found AS ({_windows("documents", "doc_id", (3, 4, 5))}),
hits AS (SELECT DISTINCT doc_id, item_id, items.n AS n_windows, found.pos - items.pos AS diagonal, items.pos AS ipos, items.s AS i, found.s AS d FROM found JOIN items USING (h)),
slots AS (SELECT DISTINCT doc_id, item_id, diagonal, i, d FROM (SELECT doc_id, item_id, diagonal, unnest(i) AS i, unnest(d) AS d FROM hits WHERE len(i) = len(d)) WHERE i IS NOT NULL OR d IS NOT NULL),
lines AS (SELECT doc_id, item_id, diagonal, count(*) AS pairs, count(DISTINCT i) AS own, bool_or(i <> d) AS changed FROM slots GROUP BY ALL),
good AS (SELECT hits.*, coalesce(changed, false) AS changed FROM hits LEFT JOIN lines USING (doc_id, item_id, diagonal) WHERE pairs IS NULL OR pairs = own)
SELECT doc_id, item_id, CAST(n_windows AS INTEGER) AS n_windows, CAST(count(DISTINCT ipos) AS INTEGER) AS matched, bool_or(changed) AS changed
FROM good GROUP BY doc_id, item_id, n_windows HAVING count(DISTINCT ipos) >= 0.8 * n_windows
"""
