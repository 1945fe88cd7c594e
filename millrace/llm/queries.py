"""The queries of this subpackage, for the driver's registry: one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import conversations, language_model, media, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, resampling, suffix_dedup, token_counts, url_filter
from .common import table


def url_rules(spark, sf_dir: str) -> DataFrame:
    """What the rules alone say of every page's address: the part of ``op6_url_filter`` that SQL can express."""
    return url_filter.apply_rules(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"))


def token_bytes(spark, sf_dir: str) -> DataFrame:
    """What of ``op2_token_counts`` SQL can express: the bytes of every text."""
    return token_counts.op2_counts(spark, sf_dir).select("doc_id", "n_bytes")


def quality_folds(spark, sf_dir: str) -> DataFrame:
    """What of ``op3_quality_classifier`` SQL can express: who is held out, and that scores and predictions agree."""
    return quality_classifier.op3_quality(spark, sf_dir).select("doc_id", "held_out", ((F.col("score") >= 0.5).cast("int") == F.col("predicted")).alias("agrees"), F.col("score").between(0, 1).alias("in_range"))


def lm_base(spark, sf_dir: str) -> DataFrame:
    """What of ``op4_lm_scoring`` SQL can express: all but the model's own score."""
    return language_model.op4_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def queries() -> dict[str, Callable[..., DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_packing,
        "op2_token_counts": token_counts.op2_counts,
        "op3_quality_classifier": quality_classifier.op3_quality,
        "op4_lm_scoring": language_model.op4_scores,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_url_filter": url_filter.op6_urls,
        "op7_media_columns": media.op7_media,
        "op8_minhash_near_dedup": near_dedup.op8_near_dedup,
        "op9_quality_rules": quality_rules.op9_rules,
        "op10_source_mixing": mixing.op10_mixing,
        "op11_importance_resampling": resampling.op11_resampling,
        "op12_conversation_repair": conversations.op12_repair,
        "op13_pii": pii.op13_pii,
        "url_rules": url_rules,
        "token_bytes": token_bytes,
        "quality_folds": quality_folds,
        "lm_base": lm_base,
    }


_REPEATS = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
  w AS (SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS i FROM h)),
  f AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
  g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM f),
  r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
  spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY doc_id, k),
  p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM spans),
  cut AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n, max(z) AS last, string_agg(substr(x, CAST(2 * y + 1 AS BIGINT), CAST(2 * (a - y) AS BIGINT)), '' ORDER BY a) AS front FROM p JOIN h USING (doc_id) GROUP BY doc_id)
  SELECT h.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(front, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)"""

_URL_RULES = """WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', ['h', 'p']) AS u FROM pages), s AS (SELECT page_id, lower(u.h) AS host, u.p AS path FROM u),
  v AS (SELECT *, CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM s)
  SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM v"""

_NEAR = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
  g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END) AS s FROM w),
  n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * m >= 85 * (x.n + y.n - m)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
  SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, k.c AS component_id, d.doc_id = k.c AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) k ON k.a = d.doc_id"""

# crc32 of a text by its bytes: the table by rule, a byte at a time.
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def _crc32(x: str) -> str:
    """SQL for the crc32 of the text ``x``, where ``crc`` is in reach."""
    byte = f"CAST('0x' || substr(hex(encode({x})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex(encode({x}))) // 2), lambda i: {byte})), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_RESAMPLING = f"""WITH {_CRC_TABLE},
  d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_ASCII_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
  b AS (SELECT regexp_extract_all({_ASCII_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM benchmark),
  x AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL), y AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY ALL),
  k AS (SELECT w, {_crc32("w")} % 10000 AS k FROM (SELECT DISTINCT w FROM x UNION SELECT w FROM y), crc),
  s AS (SELECT k, sum(n) AS s FROM x JOIN k USING (w) GROUP BY k), t AS (SELECT k, sum(n) AS t FROM y JOIN k USING (w) GROUP BY k),
  g AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM x) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM y) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.k = t.k),
  m AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight FROM x JOIN k USING (w) JOIN g USING (k) GROUP BY r),
  z AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN m USING (r)),
  o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS o FROM z)
  SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND o <= (SELECT 10 * count(*) // 100 FROM z WHERE n_features >= 20) THEN o END AS rank FROM o"""

_QUALITY_FOLDS = f"WITH {_CRC_TABLE} SELECT doc_id, {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 1 AS held_out, true AS agrees, true AS in_range FROM documents, crc"

_LM_BASE = f"""WITH {_CRC_TABLE}, d AS (SELECT doc_id, {_crc32('CAST(doc_id AS VARCHAR)')} % 10 = 0 AS held_out, list_append(list_filter(string_split_regex({_ASCII_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), '') AS ws FROM documents, crc),
  t AS (SELECT doc_id, held_out, unnest(ws) AS w FROM d), c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c)
  SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(n AS BIGINT) AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))), 4) AS base_score FROM t LEFT JOIN c USING (w), n GROUP BY doc_id, held_out, n"""

_SPACED = "[\\x20\\x09-\\x0D]"
_TO = "CASE s WHEN 2 THEN 3 ELSE 2 END"  # the state that an inserted turn, or a role given, leads to
_REPAIR = f"""WITH RECURSIVE {_CRC_TABLE},
  k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k FROM conversations, crc),
  d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
  o AS (SELECT conv_id, turn, role, text, row_number() OVER w AS i, left(role, 1) AS r, lag(left(role, 1)) OVER w AS before
    FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
  f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?]{_SPACED}*\\z') THEN 'truncated' END AS fault FROM o),
  n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
  c AS (SELECT DISTINCT conversations.conv_id, coalesce(n, 0) AS n FROM conversations LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM conversations.conv_id),
  v AS (SELECT conv_id, n + 1 AS i, [0, 4, 2, 0] AS v FROM c UNION ALL
    SELECT conv_id, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])] FROM (
      SELECT conv_id, i, [least(3 + v[1], CASE WHEN ok THEN 2 + t + v[3] END, CASE WHEN ok AND r = 'u' THEN t + v[3] WHEN ok AND r = 's' THEN t + v[2] END), least(3 + v[2], CASE WHEN ok THEN 2 + t + v[3] END, CASE WHEN ok AND r = 'u' THEN t + v[3] END),
        least(3 + v[3], CASE WHEN ok THEN 2 + t + v[4] END, CASE WHEN ok AND r = 'a' THEN t + v[4] END), least(3 + v[4], CASE WHEN ok THEN 2 + t + v[3] END, CASE WHEN ok AND r = 'u' THEN t + v[3] END)] AS w FROM (
        SELECT v.conv_id, f.i, v.v, f.r, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS ok, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM v JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i - 1))),
  e AS (SELECT v.conv_id, v.i, v.v, u.v AS u, f.role, f.text, f.r, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS ok, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t
    FROM v LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.i = v.i LEFT JOIN v u ON u.conv_id IS NOT DISTINCT FROM v.conv_id AND u.i = v.i + 1),
  p AS (SELECT conv_id, 1 AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM c UNION ALL
    SELECT conv_id, CASE WHEN x = 'I' THEN i ELSE i + 1 END, CASE WHEN x = 'D' THEN s WHEN x = 'K' AND r = 's' THEN 1 ELSE {_TO} END, audit || x,
      CASE WHEN x = 'D' THEN said ELSE list_append(said, CASE WHEN x = 'K' THEN role WHEN s = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END) END FROM (
      SELECT p.conv_id, p.i, s, audit, said, r, role, text, CASE WHEN 3 + u[s + 1] = v[s + 1] THEN 'D' WHEN 2 + v[{_TO} + 1] = v[s + 1] THEN 'I'
        WHEN ok AND t + CASE WHEN r = 's' AND s = 0 THEN u[2] WHEN r = CASE s WHEN 2 THEN 'a' ELSE 'u' END THEN u[{_TO} + 1] END = v[s + 1] THEN 'K' WHEN ok AND 2 + t + u[{_TO} + 1] = v[s + 1] THEN 'R' END AS x
      FROM p JOIN e ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.i = p.i) WHERE x IS NOT NULL)
  SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(v.v[1] AS BIGINT) AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
  FROM c JOIN v ON v.conv_id IS NOT DISTINCT FROM c.conv_id AND v.i = 1 JOIN (SELECT conv_id, arg_max(audit, length(audit)) AS audit, arg_max(said, length(audit)) AS said FROM p GROUP BY conv_id) q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id"""

_RULE_SQL = {
    "symbols_per_word": "n_symbols / n_words", "duplicate_lines": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END", "repeated_words": "n_repeat_words / n_words",
    "capitals": "capitals / word_chars", "exclamations_per_word": "exclamations / n_words", "mean_word_length": "word_chars / n_words",
}


def _rules_sql() -> str:
    """Base counts, the tuned cutoffs, the policies certified by the exact tail, and the verdict."""
    rules, risk, delta = quality_rules.RULES, quality_rules.RISK, quality_rules.DELTA
    steps = range(quality_rules.LOOSEST + 1)
    passed = ", ".join("(" + " + ".join(f"CAST({_RULE_SQL[r]} <= {c} AS INT)" for c in cs) + f") AS v{k}" for k, (r, cs) in enumerate(rules.items()))
    tuned = ", ".join("(" + " + ".join(f"CAST(count(*) FILTER (WHERE v{k} <= {j}) <= count(*) * {risk / len(rules)} AS INT)" for j in range(len(cs))) + f") - 1 AS i{k}" for k, cs in enumerate(rules.values()))
    margin = "greatest(" + ", ".join(f"CASE WHEN i{k} >= 0 THEN i{k} - v{k} END" for k in range(len(rules))) + ")"
    tail = f"list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk}))))"
    return f"""WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS x FROM documents),
  b AS (SELECT doc_id, lang, x, list_filter(string_split_regex(x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')) AS ls FROM t),
  win AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b)),
  twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY 1),
  s AS (SELECT doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(x, '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(x, '[^!]', '', 'g')) AS exclamations
      FROM b LEFT JOIN rep USING (doc_id)),
  f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s),
  p AS (SELECT doc_id, lang, {passed} FROM f WHERE NOT base_failed),
  good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
  held AS (SELECT p.*, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS tunes FROM p WHERE doc_id IN (SELECT doc_id FROM good)),
  tuned AS (SELECT lang, {tuned} FROM held WHERE tunes GROUP BY lang),
  m AS (SELECT h.lang, {margin} AS m FROM held h JOIN tuned t ON h.lang IS NOT DISTINCT FROM t.lang WHERE NOT tunes),
  counts AS (SELECT lang, s, count(*) AS n, count(*) FILTER (WHERE m >= s) AS k FROM m, (SELECT unnest({list(steps)}) AS s) GROUP BY ALL),
  policy AS (SELECT lang, min(s) AS looser FROM counts WHERE k <= n * {risk} AND {tail} <= {delta} / (SELECT count(*) FROM (SELECT DISTINCT lang FROM counts)) GROUP BY lang),
  broken AS (SELECT DISTINCT p.doc_id FROM p JOIN tuned t ON p.lang IS NOT DISTINCT FROM t.lang JOIN policy q ON p.lang IS NOT DISTINCT FROM q.lang WHERE {margin} >= looser)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT EXISTS (SELECT 1 FROM broken x WHERE x.doc_id = f.doc_id) AS kept FROM f"""


def oracle_sql() -> dict[str, str]:
    """For the operators that SQL can express; the others are tested against brute force."""
    return {"op5_suffix_dedup": _REPEATS, "url_rules": _URL_RULES, "op8_minhash_near_dedup": _NEAR, "op9_quality_rules": _rules_sql(), "op11_importance_resampling": _RESAMPLING, "op12_conversation_repair": _REPAIR,
            "token_bytes": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents", "quality_folds": _QUALITY_FOLDS, "lm_base": _LM_BASE}
