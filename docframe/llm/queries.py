"""The queries opN_<name> and `pipeline`, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.llm import bpe, chat, decontaminate, importance, langid, minhash, pii, rules, substrings, toxicity
from docframe.llm.vocab import vocabulary


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_decontamination(spark, sf_dir):
    """One row for each document and benchmark item that it contains."""
    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_pii(spark, sf_dir):
    return pii.spans(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_quality_rules(spark, sf_dir):
    return rules.judged(_table(spark, sf_dir, "documents"))


def _each(form: str, between: str = ", ") -> str:
    return between.join(form.format(n=n, limit=limit) for n, limit in rules.LIMITS.items())


OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT r, unnest(w) AS t, generate_subscripts(w, 1) AS j FROM d),
n AS (SELECT r, j, length(t) AS c, hash(t) AS h0, {", ".join(f"lead(hash(t), {k}) OVER o AS h{k}" for k in range(1, max(rules.LIMITS)))} FROM u WINDOW o AS (PARTITION BY r ORDER BY j)),
k AS (SELECT r, j, c, CASE WHEN h2 IS NOT NULL THEN hash(h0, h1, h2) END AS k3, {", ".join(f"CASE WHEN h{n - 1} IS NOT NULL THEN hash({', '.join(f'h{k}' for k in range(n))}) END AS k{n}" for n in rules.LIMITS)} FROM n),
f AS (SELECT r, j, c, k3 IS NOT NULL AND count(*) OVER (PARTITION BY r, k3) > 1 AS l3, {_each("k{n} IS NOT NULL AND row_number() OVER (PARTITION BY r, k{n} ORDER BY j) > 1 AS l{n}")} FROM k),
g AS (SELECT r, c, coalesce(max(CASE WHEN l3 THEN j END) OVER (PARTITION BY r ORDER BY j ROWS UNBOUNDED PRECEDING) > j - 3, false) AS c3, {_each("coalesce(max(CASE WHEN l{n} THEN j END) OVER (PARTITION BY r ORDER BY j ROWS UNBOUNDED PRECEDING) > j - {n}, false) AS c{n}")} FROM f),
m AS (SELECT r, count(*) AS n_words, sum(c) AS word_chars, count_if(c3) AS n_repeat_words, {_each("coalesce(sum(c) FILTER (c{n}), 0) AS s{n}")} FROM g GROUP BY r),
l AS (SELECT r, count(*) AS n_dup_lines, sum(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS line_chars FROM (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY i) AS n FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d) x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) y WHERE n > 1 GROUP BY r),
o AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(line_chars, 0) <= {rules.LINE_LIMIT} * greatest(1, coalesce(word_chars, 0)) AND {_each("coalesce(s{n}, 0) <= {limit} * greatest(1, coalesce(word_chars, 0))", " AND ")} AS good FROM d LEFT JOIN m USING (r) LEFT JOIN l USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < {rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND good AS kept FROM o
"""


def op8_importance_resampling(spark, sf_dir):
    """Every document with its weight, its key and whether it is drawn."""
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op1_chat_formatting(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(turns.unionByName(more))


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, 24 + length(regexp_replace(role, '\\|<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]', '\0-', 'g'))
    + length(regexp_replace(text, '\\|<s>|</s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]', '\0-', 'g')) AS n FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_rewrites
FROM e GROUP BY conv_id
"""


def op2_suffix_array_dedup(spark, sf_dir):
    return substrings.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, hash(substring(x, CAST(2 * i + 1 AS BIGINT), 400)) AS h FROM (SELECT r, x, unnest(range(0, CAST(length(x) / 2 AS BIGINT) - 199)) AS i FROM d)),
again AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hits AS (SELECT r, i, max(i) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w SEMI JOIN again USING (h)),
islands AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS n FROM hits),
spans AS (SELECT r, n, min(i) AS a, max(i) + 200 AS b FROM islands GROUP BY r, n),
gaps AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL SELECT d.r, coalesce(max(s.b), 0), any_value(length(x)) // 2 FROM d LEFT JOIN spans s USING (r) GROUP BY d.r),
kept AS (SELECT g.r, string_agg(substring(x, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS x FROM gaps g JOIN d USING (r) GROUP BY g.r)
SELECT doc_id, CAST(length(d.x) // 2 AS BIGINT) AS n_bytes, CAST((length(d.x) - length(k.x)) // 2 AS BIGINT) AS n_removed, CAST((SELECT count(*) FROM spans s WHERE s.r = d.r) AS BIGINT) AS n_spans, sha256(unhex(k.x)) AS kept_sha256
FROM d JOIN kept k USING (r)
"""


def op3_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


OP3_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])
                                    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w
), one AS (SELECT doc_id, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id
  JOIN sets sa ON sa.doc_id = a.doc_id JOIN sets sb ON sb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, len(sa.s), len(sb.s)
  HAVING 100 * count(*) >= 85 * (len(sa.s) + len(sb.s) - count(*))
), both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(u, v) AS (SELECT u, v FROM both_ways UNION SELECT r.u, b.v FROM reach r JOIN both_ways b ON r.v = b.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.v, s.doc_id)) AS component_id, s.doc_id <= coalesce(m.v, s.doc_id) AS kept
FROM sets s LEFT JOIN (SELECT u, min(v) AS v FROM reach GROUP BY u) m ON m.u = s.doc_id
"""


def op10_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"), vocabulary())


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_suffix_array_dedup, op3_minhash_near_dedup, op4_decontamination, op5_pii, op6_toxicity, op7_quality_rules, op8_importance_resampling, op9_language_id, op10_bpe, pipeline)}
ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op2_suffix_array_dedup": OP2_SQL, "op3_minhash_near_dedup": OP3_SQL, "op7_quality_rules": OP7_SQL}
