"""Registered queries of the training-data operators, with their production
parameters, each over its whole table, and the DuckDB statements for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (decontamination, html_text, licenses, mixing, packing, periodic_runs, prefix_hash,
                         quality_model, quality_rules, secrets, simhash, url_rules, whitening)
from tessera.llm.common import table

# The listed rules of the URL filter: (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
             ("org", "/fr/", "allow")]


def encoder() -> Callable:
    import public_tokenizers as P

    return packing.byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256})


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"), width=3, max_bits=2).select(
        "doc_id", "fingerprint", "component_id")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict", "confidence")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), encoder(), capacity=1024)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                        (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprint_neighbours(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_url_filter, op3_packing, op4_quality_model, op5_mixing, op6_licenses,
                            op7_html_text, op8_quality_rules, op9_secrets, op10_prefix_hash, op11_whitening,
                            op12_periodic_runs, op13_decontamination)}

SPACES = r"[\x20\x09-\x0D]"
CHARS = "regexp_replace(t, '" + SPACES + "', '', 'g')"


def _symbols(chars: str) -> str:
    return f"(length(t) - length(regexp_replace(t, '{chars}', '', 'g')))"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


ORACLE: dict[str, str] = {
    "op6_licenses": r"""
WITH RECURSIVE tw AS (SELECT license, form, list_filter(regexp_split_to_array(lower(body), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
            FROM (VALUES """ + ", ".join(f"({', '.join(map(_text, t))})" for t in licenses.TEMPLATES) + r""") v(license, form, body)),
tb AS (SELECT license, form, len(w) - 1 AS total, unnest(range(0, len(w) - 1)) AS o,
              unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM tw),
tpl AS (SELECT license, form, total, g, count(*) AS c, CASE WHEN count(*) = 1 THEN min(o) END AS o
        FROM tb GROUP BY license, form, total, g),
dw AS (SELECT row_number() OVER () AS r, doc_id,
              list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
own AS (SELECT r, len(w) - 1 AS size, unnest(range(0, len(w) - 1)) AS pos,
               unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM dw WHERE len(w) > 1),
near AS (SELECT r, size, pos, license, form, total, g, c, o FROM own JOIN tpl USING (g)),
shift AS (SELECT DISTINCT r, license, form, total, size, pos - o AS s FROM near WHERE o IS NOT NULL),
win AS (SELECT DISTINCT r, license, form, x.total, greatest(x.s, 0) AS st, least(y.s + y.total, y.size) AS en
        FROM shift x JOIN shift y USING (r, license, form)
        WHERE least(y.s + y.total, y.size) - greatest(x.s, 0) BETWEEN x.total * 2 / 3 - 1e-9 AND x.total * 3 / 2 + 1e-9),
com AS (SELECT r, license, form, total, st, en, sum(least(n, c)) AS i
        FROM (SELECT r, license, form, win.total, st, en, g, c, count(*) AS n FROM win JOIN near USING (r, license, form)
              WHERE pos >= st AND pos < en GROUP BY r, license, form, win.total, st, en, g, c)
        GROUP BY r, license, form, total, st, en),
alike AS (SELECT r, license, form, st, en, en - st - 2 * i AS o, 2 * i / (en - st + total)::DOUBLE AS d FROM com
          WHERE 2 * i / (en - st + total)::DOUBLE >= 0.8),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY o, d DESC, st, en, license, form) AS k FROM alike),
pick AS (SELECT r, 0::BIGINT AS k, []::STRUCT(s BIGINT, e BIGINT)[] AS taken, false AS best
         FROM (SELECT DISTINCT r FROM ranked)
         UNION ALL
         SELECT r, k, CASE WHEN fits THEN list_append(taken, {'s': st::BIGINT, 'e': en::BIGINT}) ELSE taken END, fits
         FROM (SELECT x.r, x.k, p.taken, st, en, len(list_filter(p.taken, lambda t: t.s <= x.en AND x.st <= t.e)) = 0 AS fits
               FROM pick p JOIN ranked x ON x.r = p.r AND x.k = p.k + 1))
SELECT doc_id, st::INTEGER AS start, (en + 1)::INTEGER AS "end", license, form, d AS dice, best
FROM ranked JOIN pick USING (r, k) JOIN dw USING (r)""",
    "op8_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
        FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
starts AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, sum(least(8, i - before)) AS n
        FROM (SELECT r, i, lag(i, 1, i - 8) OVER (PARTITION BY r ORDER BY i) AS before FROM starts) GROUP BY r),
s AS (SELECT doc_id, t, w, len(w)::BIGINT AS n_words, length({CHARS})::BIGINT AS word_chars,
             {_symbols('[#*$%&|<>]')}::BIGINT AS n_symbols,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines,
             len(string_split(t, chr(10))) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (r)),
f AS (SELECT *, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
             (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 4 * n_symbols > n_words OR 2 * {_symbols('[A-Z]')} > word_chars
            OR 4 * {_symbols('!')} > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 20 * list_sum(list_transform(range(1, greatest(len(w), 1) + 1, 32768),
                                            lambda i: len(list_distinct(w[i:i + 32767])))) < n_words OR 2 * n_dup_lines > n_lines
            OR 2 * {_symbols('[0-9]')} > word_chars) AS kept
FROM f""",
    "op13_decontamination": r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k,
               unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g
        FROM item WHERE len(w) > 0),
doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM documents),
own AS (SELECT r, k, unnest(range(0, len(w) - k + 1)) AS i,
               unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
        FROM doc CROSS JOIN (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
occ AS (SELECT DISTINCT r, i, k, item_id FROM own JOIN win USING (k, g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM occ) GROUP BY r),
held AS (SELECT r, count(*) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS s
         FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(held.n, 0) AS n_items,
       coalesce(held.s, sha256('')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN held USING (r)""",
}
