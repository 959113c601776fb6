"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_extract, line_dedup, minhash, ngram_join, packing, periodic_runs, ppm, quality, spelling, substring_dedup, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op5_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.verdict(found)


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), spelling.misspelt)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(periodic_runs.planted(table(spark, sf_dir, "documents")))


def op13_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ppm_scoring": op5_ppm_scoring,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_ngram_jaccard_join": op13_ngram_jaccard_join,
}

#: Line feeds and the other white space of the word rule.
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')"

_QUALITY = rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\f\r]')) AS l
  FROM documents),
grams AS (
  SELECT doc_id, i, struct_pack(a := w[i], b := w[i + 1], c := w[i + 2]) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 3) AS r(k) GROUP BY doc_id),
counted AS (
  SELECT doc_id, source, text, len(w) AS n_words,
         length(regexp_replace(text, '[ \t\n\x0b\f\r]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM base LEFT JOIN covered USING (doc_id)),
lines AS (
  SELECT doc_id, source, s, trim(regexp_replace(lower(s), '[ \t\x0b\f\r]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS s FROM base)),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY source),
frequent AS (
  SELECT source, norm
  FROM (SELECT source, norm, count(DISTINCT doc_id) AS n FROM lines WHERE norm <> '' GROUP BY source, norm) c
  JOIN hosts USING (source) WHERE n >= 5 AND n > 0.1 * docs),
gone AS (
  SELECT doc_id, count(*) AS n_lines_removed, sum(length(s)) AS removed_chars
  FROM lines JOIN frequent USING (source, norm) GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * coalesce(removed_chars, 0) <= length(text) AS kept,
       CAST(coalesce(n_lines_removed, 0) AS BIGINT) AS n_lines_removed, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars
FROM counted LEFT JOIN gone USING (doc_id)
"""

_SUBSTRING = rf"""
WITH base AS (SELECT doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM base)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(g) ORDER BY doc_id, i) AS k FROM starts) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM later, range(0, 20) AS r(k)),
each AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM base)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (doc_id)
"""

_ALNUM = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
bw AS (
  SELECT item_id, n, i AS j, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, j, n, item_id FROM dw JOIN bw USING (n, g)),
same AS (
  SELECT doc_id, item_id, i, j, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run
  FROM (SELECT doc_id, unnest(w) AS g, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN (SELECT item_id, unnest(w) AS g, unnest(range(1, len(w) + 1)) AS j FROM b) USING (g)),
stretches AS (
  SELECT doc_id, item_id, count(*) AS m, min(i) - 1 AS start, min(j) - 1 AS item_start
  FROM same GROUP BY doc_id, item_id, i - j, run),
longest AS (
  SELECT doc_id, m AS longest_match, start AS longest_start, item_id AS longest_item
  FROM stretches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY m DESC, start, item_id) = 1),
locations AS (
  SELECT doc_id, count(*) AS n_locations, string_agg(start || ',' || m || ',' || item_id || ',' || item_start || chr(10), '' ORDER BY start, m, item_id, item_start) AS l
  FROM stretches JOIN (SELECT item_id, len(w) AS n FROM b) USING (item_id) WHERE m >= least(13, n) GROUP BY doc_id),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(longest_match, 0) AS longest_match, longest_start, longest_item, coalesce(n_locations, 0) AS n_locations, sha256(coalesce(l, '')) AS locations_sha256
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN locations USING (doc_id)
"""

#: crc32 in SQL: eight shifts for each value of a byte, then one look-up for each byte of the UTF-8 text.
_CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def _crc32(text: str) -> str:
    octets = f"list_transform(range(CAST(length(hex(encode({text}))) // 2 AS BIGINT)), lambda i: CAST('0x' || hex(encode({text}))[2 * i + 1 : 2 * i + 2] AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_SPELLING = rf"""
WITH RECURSIVE {_CRC},
runs AS (
  SELECT doc_id, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents)
  WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (SELECT w, n, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM runs, crc),
vocabulary AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM hashed)
  GROUP BY word HAVING length(word) >= 7 AND sum(n) >= 2),
less AS (SELECT word, i, word[: i] || word[i + 2 :] AS v FROM (SELECT word, unnest(range(length(word))) AS i FROM vocabulary)),
half AS (
  SELECT a.word AS a, b.word AS b FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word < b.word
  UNION SELECT a.word, b.word FROM vocabulary a JOIN less b ON a.word = b.v),
near AS (SELECT a, b FROM half UNION SELECT b, a FROM half),
best AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS f, max(n) AS top
  FROM near JOIN vocabulary ON word = b GROUP BY a),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN f END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n FROM vocabulary LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root, 0 AS k FROM formed UNION ALL SELECT p.word, f.form, k + 1 FROM path p JOIN formed f ON p.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, arg_max(root, k) AS root FROM path GROUP BY word) USING (word)
"""

_LOWER = r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = rf"""
WITH RECURSIVE base AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM base WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common c JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c.n >= 80 * (p.n + q.n - c.n)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": _SPELLING,
    "op13_ngram_jaccard_join": _JACCARD,
    "op8_benchmark_decontamination": _DECONTAMINATION,
    "op1_quality_rules": _QUALITY,
    "op4_substring_dedup": _SUBSTRING,
}
