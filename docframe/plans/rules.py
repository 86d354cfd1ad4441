"""Rules of documents and their layout as SQL over the shared tables: derivations, selections, lookups, ordered rows.

Both engines run the same text where their dialects agree. Sequences are the events of a user in order of time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docframe.plans.registry import query, sql_query, table

# The sizes that a size step goes through, and names of faces of each class.
SIZES = (5.0, 6.0, 7.0, 8.0, 9.0, 10.0, 10.5, 11.0, 12.0, 14.0, 16.0, 18.0, 20.0, 22.0, 24.0, 26.0, 28.0, 36.0, 48.0, 72.0)
POP, ROUND, SCHOOL, BRUSH = ("pop", "ﾎﾟｯﾌﾟ", "ポップ"), ("丸ｺﾞ", "丸ゴ", "まるご", "maru", "rounded"), ("教科書", "kyokasho"), ("楷書", "行書", "毛筆", "勘亭", "隷書", "草書", "正楷", "手書", "ペン字", "古印", "宋朝")
GOTHIC = ("ゴシック", "ｺﾞｼｯｸ", "gothic", "丸ゴ", "メイリオ", "meiryo", "游ゴ", "ui gothic", "arial", "helvetica", "sans", "ヒラギノ角", "角ゴ")


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_EVENTS = "SELECT user_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {events}"

# Derivations

sql_query(
    "q48_face_class",
    f"""WITH f AS (SELECT p_partkey, lower(name) AS n, name FROM (SELECT p_partkey, CASE p_size % 9 WHEN 0 THEN 'MS Gothic' WHEN 1 THEN 'HG丸ｺﾞｼｯｸM-PRO' WHEN 2 THEN 'HG教科書体' WHEN 3 THEN 'HG行書体' WHEN 4 THEN 'HGS創英角ﾎﾟｯﾌﾟ体' WHEN 5 THEN 'Meiryo UI' WHEN 6 THEN 'JustUnitMark' WHEN 7 THEN concat('Sans ', p_type) ELSE p_type END AS name FROM {{part}}) t)
    SELECT p_partkey, CASE WHEN {_any('n', POP)} THEN 5 WHEN {_any('n', ROUND)} THEN 2 WHEN {_any('n', SCHOOL)} THEN 3 WHEN {_any('n', BRUSH)} THEN 4 WHEN {_any('n', GOTHIC)} THEN 1 ELSE 0 END AS face,
      {_any('n', GOTHIC)} AS gothic, name LIKE 'Just%' AND contains(name, 'Mark') AS mark FROM f""",
)
sql_query(
    "q49_page_geometry",
    """WITH s AS (SELECT p_partkey, CAST(p_size * 900 + 2000 AS DOUBLE) / 100 AS w0, CAST(p_partkey % 300 * 100 + 3000 AS DOUBLE) / 100 AS h0, CAST(p_size % 7 * 1500 AS DOUBLE) / 100 AS t0, CAST(p_size % 5 * 1500 AS DOUBLE) / 100 AS b0,
        CAST(p_partkey % 6 * 1000 AS DOUBLE) / 100 AS l0, CAST(p_partkey % 4 * 1000 AS DOUBLE) / 100 AS r0, p_partkey % 3 = 0 AS vertical, p_partkey % 5 = 0 AS two_up, p_partkey % 90 AS half_chars, p_size % 45 AS lines,
        p_partkey % 11 * 60 AS gap, round(CAST(p_size * 20 AS DOUBLE) / 35.2778 * 2) / 2 AS font0 FROM {part}),
    paper AS (SELECT *, w0 BETWEEN 50 AND 1500 AND h0 BETWEEN 50 AND 1500 AS fits FROM s),
    sized AS (SELECT *, CASE WHEN fits THEN w0 ELSE 210.0 END AS w1, CASE WHEN fits THEN h0 ELSE 297.0 END AS h1 FROM paper),
    margins AS (SELECT *, t0 + b0 < h1 * 0.9 AS okv, l0 + r0 < w1 * 0.9 AS okh, two_up AND NOT vertical AND w1 > h1 AS halved FROM sized),
    chosen AS (SELECT *, CASE WHEN okv THEN t0 ELSE 30.0 END AS t1, CASE WHEN okv THEN b0 ELSE 30.0 END AS b1, CASE WHEN okh THEN l0 ELSE 30.0 END AS l1, CASE WHEN okh THEN r0 ELSE 30.0 END AS r1, CASE WHEN halved THEN w1 / 2 ELSE w1 END AS w2 FROM margins),
    turned AS (SELECT *, CASE WHEN vertical THEN h1 ELSE w2 END AS w, CASE WHEN vertical THEN w2 ELSE h1 END AS h, CASE WHEN vertical THEN r1 ELSE t1 END AS t, CASE WHEN vertical THEN l1 ELSE b1 END AS b, CASE WHEN vertical THEN t1 ELSE l1 END AS l, CASE WHEN vertical THEN b1 ELSE r1 END AS r,
        CASE WHEN font0 BETWEEN 4 AND 100 THEN font0 ELSE 10.5 END AS font, CAST(least(400, greatest(4, floor(half_chars / 2))) AS DOUBLE) AS chars FROM chosen),
    filled AS (SELECT *, greatest(h - (t + b), 10) * 72.0 / 25.4 AS text_pt, font0 * (1.0 + CAST(gap AS DOUBLE) / 1000.0) AS want, CAST(greatest(lines, 1) AS DOUBLE) AS n FROM turned),
    counted AS (SELECT *, CAST(least(400, greatest(2, CASE WHEN gap > 0 AND gap < 5000 AND want > 0 AND text_pt / n > 2.0 * want THEN floor(text_pt / want) ELSE n END)) AS DOUBLE) AS per_page, (w - (l + r)) * 72.0 / 25.4 AS between FROM filled),
    wide AS (SELECT *, CASE WHEN between > font * 2 THEN between ELSE chars * font END AS text_w FROM counted)
    SELECT p_partkey, round(w * 72.0 / 25.4, 4) AS page_w, round(h * 72.0 / 25.4, 4) AS page_h, round(text_w, 4) AS text_w, round(CASE WHEN between > font * 2 THEN l * 72.0 / 25.4 ELSE greatest(10.0, (w * 72.0 / 25.4 - text_w) / 2) END, 4) AS left_pt,
      round(text_w / chars, 4) AS cell, round(least(4.0, greatest(0.5, text_w / chars / font)), 4) AS spread, round((h - b - t) * 72.0 / 25.4 / per_page, 4) AS pitch, round(text_w / chars / 4, 4) AS unit, CAST(per_page AS BIGINT) AS lines_per_page FROM wide""",
)
sql_query(
    "q50_style_defaults",
    """SELECT p_partkey, p_size AS id, CASE WHEN p_size IN (1, 3, 8) THEN CAST(65535 AS BIGINT) WHEN p_size IN (2, 4, 5, 13, 18, 19, 20) THEN CAST(0 AS BIGINT) WHEN p_size IN (15, 16) THEN CAST(4294967295 AS BIGINT) END AS neutral,
      CASE WHEN p_size BETWEEN 4 AND 7 OR p_size BETWEEN 9 AND 12 THEN 1 WHEN p_size IN (15, 16, 17, 20) THEN 4 ELSE 2 END AS length FROM {part}""",
)
sql_query(
    "q52_keys_switched_off",
    """SELECT p_partkey, array_join(array_sort(map_keys(map_filter(map_from_arrays(k0, transform(k0, x -> p_size % (x + 1))), (k, v) -> NOT array_contains(k1, k) AND ((k IN (1, 3, 8) AND v <> 65535) OR (k IN (2, 4, 5, 13, 18, 19, 20) AND v <> 0))))), ',') AS keys
    FROM (SELECT p_partkey, p_size, filter(array(1, 2, 3, 4, 5, 6, 13, 20), x -> p_partkey % (x + 1) < 2) AS k0, filter(array(1, 2, 3, 4, 5, 6, 13, 20), x -> p_partkey % (x + 2) < 2) AS k1 FROM {part}) t""",
    """SELECT p_partkey, coalesce(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) FILTER (p_partkey % (k + 1) < 2 AND NOT p_partkey % (k + 2) < 2 AND ((k IN (1, 3, 8) AND p_size % (k + 1) <> 65535) OR (k IN (2, 4, 5, 13, 18, 19, 20) AND p_size % (k + 1) <> 0))), '') AS keys
    FROM {part}, (VALUES (1), (2), (3), (4), (5), (6), (13), (20)) v(k) GROUP BY p_partkey""",
)
_CONTROLS = [c for c in range(32)]


def _escaped(column: str, spark: bool) -> str:
    for c in _CONTROLS:
        slash = "\\\\" if spark else "\\"
        column = f"replace({column}, {'char' if spark else 'chr'}({c}), '{slash}x{c:02x}')"
    return column


sql_query(
    "q53_escaped_controls",
    f"SELECT conv_id, turn, role, md5({_escaped('text', True)}) AS digest, CAST(length({_escaped('text', True)}) - length(text) AS BIGINT) AS added FROM {{conversations}}",
    f"SELECT conv_id, turn, role, md5({_escaped('text', False)}) AS digest, CAST(length({_escaped('text', False)}) - length(text) AS BIGINT) AS added FROM {{conversations}}",
)
_SIZE_LIST = ", ".join(f"{s:.1f}D" for s in SIZES)
sql_query(
    "q54_size_steps",
    f"SELECT p_partkey, coalesce(array_min(filter(s, x -> x > cur + 0.01D)), cur) AS larger, coalesce(array_max(filter(s, x -> x < cur - 0.01D)), cur) AS smaller FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * 1.5D AS cur, array({_SIZE_LIST}) AS s FROM {{part}}) t",
    f"SELECT p_partkey, coalesce(min(CASE WHEN s > cur + 0.01 THEN s END), cur) AS larger, coalesce(max(CASE WHEN s < cur - 0.01 THEN s END), cur) AS smaller FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) * 1.5 AS cur FROM {{part}}) t, (SELECT unnest([{_SIZE_LIST.replace('D', '::DOUBLE')}]) AS s) v GROUP BY p_partkey, cur",
)
sql_query(
    "q55_limits_from_json",
    """SELECT p_partkey, CAST(coalesce(nullif(l.maxBytes, 0), 268435456) AS BIGINT) AS max_bytes, CAST(coalesce(nullif(l.maxPages, 0), 2000) AS BIGINT) AS max_pages, CAST(coalesce(nullif(l.maxSheets, 0), 64) AS BIGINT) AS max_sheets
    FROM (SELECT p_partkey, from_json(concat('{{"maxBytes":', p_size, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(',"maxPages":', p_partkey % 4) END, ',"other":"x"}}'), 'maxBytes BIGINT, maxPages BIGINT, maxSheets BIGINT') AS l FROM {part}) t""",
    """SELECT p_partkey, coalesce(nullif(CAST(j ->> 'maxBytes' AS BIGINT), 0), 268435456) AS max_bytes, coalesce(nullif(CAST(j ->> 'maxPages' AS BIGINT), 0), 2000) AS max_pages, CAST(coalesce(nullif(CAST(j ->> 'maxSheets' AS BIGINT), 0), 64) AS BIGINT) AS max_sheets
    FROM (SELECT p_partkey, CAST(concat(chr(123), '"maxBytes":', p_size, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(',"maxPages":', p_partkey % 4) END, ',"other":"x"', chr(125)) AS JSON) AS j FROM {part}) t""",
)
sql_query(
    "q56_rule_lines",
    """WITH r AS (SELECT user_id, event_id, n, CAST(floor(value) AS BIGINT) % 4 * 16 + event_id % 4 AS style, event_id % 5 AS a, CAST(floor(value) AS BIGINT) % 3 * 16 + user_id % 4 AS b, event_id % 9 AS dist FROM (SELECT * FROM (""" + _EVENTS + """) e WHERE n <= 16) e),
    c AS (SELECT *, 1 + CAST(coalesce(sum(a + dist + 2) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS centre FROM r)
    SELECT user_id, event_id, centre, CASE WHEN style % 4 <> 0 THEN centre END AS vertical, CASE WHEN b >= 16 AND b % 4 <> 0 THEN centre + a + 1 END AS own_end,
      CASE WHEN style >= 32 AND a > 0 THEN centre + a + 1 WHEN style >= 32 AND b < 16 THEN centre + a + dist + 2 END AS below_to, CASE WHEN b >= 32 THEN centre + a + dist + 2 END AS next_below_to FROM c""",
)
sql_query(
    "q57_affine_move",
    "SELECT vec_id, round(m[0], 5) AS x1, round(m[1], 5) AS y1, round(m[2], 5) AS x2, round(m[3], 5) AS y2 FROM (SELECT vec_id, transform(slice(embedding, 1, 4), x -> CAST(x AS DOUBLE) + label) AS m FROM {embeddings}) t",
    "SELECT vec_id, round(m[1], 5) AS x1, round(m[2], 5) AS y1, round(m[3], 5) AS x2, round(m[4], 5) AS y2 FROM (SELECT vec_id, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE) + label) AS m FROM {embeddings}) t",
)

# Selections

sql_query(
    "q58_headers_of_pages",
    """WITH h AS (SELECT n_nationkey AS doc, p.place, n_nationkey % 3 AS align, n_nationkey % 2 = 1 AS vertical, concat(n_name, ' ?') AS body FROM {nation} CROSS JOIN (SELECT 2 AS place UNION ALL SELECT 3 UNION ALL SELECT 6) p WHERE n_nationkey % p.place <> 1),
    k AS (SELECT *, max(CASE WHEN place = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc) + max(CASE WHEN place = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc) = 2 AS paired FROM h)
    SELECT doc, pg.page, place, replace(body, '?', CAST(pg.page + 1 AS STRING)) AS body, CASE WHEN align = 1 THEN 'center' WHEN (align = 2 AND NOT vertical) OR (align = 0 AND vertical) THEN 'right' ELSE 'left' END AS align
    FROM k CROSS JOIN (SELECT 0 AS page UNION ALL SELECT 1 UNION ALL SELECT 2) pg WHERE NOT (paired AND ((place = 3 AND pg.page % 2 = 0) OR (place = 2 AND pg.page % 2 = 1)))""",
)
sql_query("q59_past_the_bottom", "SELECT user_id, count(*) AS shown, round(min(value), 6) AS top, round(max(value), 6) AS bottom, CAST(count_if(value - 0.88 * (event_id % 20) > 60) AS BIGINT) AS cut FROM {events} WHERE value - 0.88 * (event_id % 20) <= 90 GROUP BY user_id")

@query(r"SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\p{Z}\p{Cc}\p{Cf}]', '', 'g')) AS BIGINT) AS n_spaces FROM documents")
def q60_space_test(spark, sf_dir):
    """Characters of the classes of separators, controls and format characters."""
    bare = F.regexp_replace("text", r"[\p{Z}\p{Cc}\p{Cf}]", "")
    return table(spark, sf_dir, "documents").select("doc_id", (F.length("text") - F.length(bare)).cast("bigint").alias("n_spaces"))


sql_query(
    "q61_manifest",
    """WITH lines AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN concat('# ', url) WHEN page_id % 13 = 0 THEN '' WHEN page_id % 3 = 0 THEN concat(url, char(9), url, '.docx') ELSE url END AS line FROM {pages}),
    m AS (SELECT split_part(line, char(9), 1) AS doc_url, nullif(split_part(line, char(9), 2), '') AS pair_url FROM lines WHERE trim(line) <> '' AND line NOT LIKE '#%'),
    wanted AS (SELECT doc_url AS url FROM m UNION SELECT pair_url FROM m WHERE pair_url IS NOT NULL)
    SELECT url FROM wanted WHERE url NOT IN (SELECT concat(url, '.docx') FROM {pages} WHERE page_id % 2 = 0)""",
    """WITH lines AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN concat('# ', url) WHEN page_id % 13 = 0 THEN '' WHEN page_id % 3 = 0 THEN concat(url, chr(9), url, '.docx') ELSE url END AS line FROM {pages}),
    m AS (SELECT split_part(line, chr(9), 1) AS doc_url, nullif(split_part(line, chr(9), 2), '') AS pair_url FROM lines WHERE trim(line) <> '' AND line NOT LIKE '#%'),
    wanted AS (SELECT doc_url AS url FROM m UNION SELECT pair_url FROM m WHERE pair_url IS NOT NULL)
    SELECT url FROM wanted WHERE url NOT IN (SELECT concat(url, '.docx') FROM {pages} WHERE page_id % 2 = 0)""",
)
sql_query(
    "q62_page_cap",
    """SELECT doc_id, CAST(least(pages, 20) AS BIGINT) AS pages, pages > 20 AS truncated FROM (SELECT doc_id, floor((n_chars + 399) / 400) AS pages FROM {documents}) t""",
)

# Lookups

sql_query(
    "q63_file_pairs",
    """WITH f AS (SELECT concat('/files/', page_id, '.jtd') AS path FROM {pages} UNION ALL SELECT concat('/files/', page_id, '.docx') FROM {pages} WHERE page_id % 3 = 0 UNION ALL SELECT concat('/other/', page_id, '.docx') FROM {pages} WHERE page_id % 3 = 1)
    SELECT a.path AS doc, b.path AS twin FROM f a JOIN f b ON a.path LIKE '%.jtd' AND b.path LIKE '%.docx' AND regexp_replace(a.path, '[.][a-z]+$', '') = regexp_replace(b.path, '[.][a-z]+$', '')""",
)
sql_query(
    "q64_lookup_fallback",
    """WITH one AS (SELECT o_custkey, min(o_orderkey) AS k FROM {orders} WHERE o_orderstatus = 'P' GROUP BY o_custkey), two AS (SELECT o_custkey, max(o_orderkey) AS k FROM {orders} GROUP BY o_custkey)
    SELECT c_custkey, coalesce(one.k, two.k) AS content, one.k IS NULL AS preview FROM {customer} LEFT JOIN one ON one.o_custkey = c_custkey LEFT JOIN two ON two.o_custkey = c_custkey WHERE coalesce(one.k, two.k) IS NOT NULL""",
)
sql_query("q65_join_on_expression", "SELECT r_regionkey, r_name, n_name FROM {region} JOIN {nation} ON r_regionkey + 1 = n_nationkey WHERE n_name <> ''")
sql_query(
    "q66_sheet_names",
    """WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM {orders}),
    names AS (SELECT l_orderkey % 1000 AS o_custkey, row_number() OVER (PARTITION BY l_orderkey % 1000 ORDER BY l_orderkey) AS k, concat('N', l_orderkey) AS name FROM (SELECT DISTINCT l_orderkey FROM {lineitem} WHERE l_linenumber = 3) l)
    SELECT s.o_custkey, o_orderkey, CASE WHEN s.k = 1 AND n = 1 THEN 'Sheet 1' ELSE coalesce(name, concat('Sheet ', CAST(s.k AS STRING))) END AS name FROM s LEFT JOIN names ON names.o_custkey = s.o_custkey AND names.k = s.k""",
)
sql_query(
    "q67_anchored_frames",
    """WITH a AS (SELECT user_id, n, CAST(floor(value) AS BIGINT) * 7 % 1000 AS part FROM (""" + _EVENTS + """) e)
    SELECT user_id, CAST(n AS BIGINT) AS n, part, p_name, CAST(row_number() OVER (PARTITION BY user_id ORDER BY n) AS BIGINT) AS place FROM a JOIN {part} ON p_partkey = part""",
)
sql_query("q68_indexed_lookup", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN get(array('Mincho', 'Gothic', 'Kaisho', 'Meiryo'), p_size % 12) END, 'Mincho') AS face FROM {part}", "SELECT p_partkey, coalesce(CASE WHEN p_size % 2 = 0 THEN (['Mincho', 'Gothic', 'Kaisho', 'Meiryo'])[p_size % 12 + 1] END, 'Mincho') AS face FROM {part}")
sql_query("q69_directory_sizes", "SELECT o_orderkey, o_orderpriority, CAST(n AS BIGINT) AS size FROM {orders} JOIN (SELECT l_orderkey, count(*) AS n FROM {lineitem} WHERE l_quantity > 5 GROUP BY l_orderkey) c ON l_orderkey = o_orderkey")
sql_query(
    "q70_first_link",
    """WITH links AS (SELECT l_partkey AS old, l_orderkey AS new, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey FROM {lineitem}) l)
    SELECT p_partkey, new, p_brand FROM {part} JOIN links ON old = p_partkey AND n = 1""",
)

# Aggregates that keep the first or the last of equals

_FLAGS = "SELECT user_id, event_type, CAST(floor(value / 10) AS BIGINT) AS size, n FROM (" + _EVENTS + ") e"
sql_query(
    "q71_dominant_size",
    f"""WITH s AS (SELECT user_id, size, sum(1 + n % 3) AS weight, min(n) AS first FROM ({_FLAGS}) f GROUP BY user_id, size)
    SELECT user_id, size, CAST(weight AS BIGINT) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, first DESC) AS r FROM s) t WHERE r = 1""",
)
sql_query(
    "q72_most_used_width",
    f"""WITH s AS (SELECT user_id, size AS width, count(*) AS uses, min(n) AS first FROM ({_FLAGS}) f WHERE size > 0 GROUP BY user_id, size)
    SELECT user_id, width, uses FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY uses DESC, first DESC) AS r FROM s) t WHERE r = 1""",
)
sql_query(
    "q73_first_seen_order",
    f"SELECT user_id, array_join(transform(array_sort(collect_list(struct(first, event_type))), x -> x.event_type), ',') AS names FROM (SELECT user_id, event_type, min(n) AS first FROM ({_FLAGS}) f GROUP BY user_id, event_type) t GROUP BY user_id",
    f"SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS names FROM (SELECT user_id, event_type, min(n) AS first FROM ({_FLAGS}) f GROUP BY user_id, event_type) t GROUP BY user_id",
)
sql_query("q74_extremes", "SELECT round(max(value), 6) AS slowest, round(max(value / (1 + length(props))), 6) AS per_byte, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, CAST(count_if(value > 100) AS BIGINT) AS heavy FROM {events}")
sql_query("q75_left_after_deletions", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(replace(text, 'e', ''))) AS BIGINT) AS left_over, CAST(count_if(length(replace(text, 'e', '')) < length(text) * 0.9) AS BIGINT) AS thinned FROM {conversations} GROUP BY conv_id")

# Running state

sql_query(
    "q76_context_of_previous",
    "SELECT user_id, event_id, CASE WHEN before = 'view' THEN previous END AS context FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY n) AS before, lag(event_id) OVER (PARTITION BY user_id ORDER BY n) AS previous FROM (" + _EVENTS + ") e) t WHERE event_type = 'click'",
)
sql_query(
    "q77_between_neighbours",
    """WITH m AS (SELECT user_id, event_id, n, CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT) END AS hit FROM (""" + _EVENTS + """) e),
    b AS (SELECT *, max(CASE WHEN hit IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS lo_n, min(CASE WHEN hit IS NOT NULL THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi_n FROM m)
    SELECT b.user_id, b.event_id, coalesce(lo.hit + 1, 0) AS lo, coalesce(hi.hit, 1000) AS hi FROM b LEFT JOIN m lo ON lo.user_id = b.user_id AND lo.n = b.lo_n LEFT JOIN m hi ON hi.user_id = b.user_id AND hi.n = b.hi_n WHERE b.hit IS NULL""",
)
sql_query(
    "q78_insert_runs",
    """WITH r AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, event_type ORDER BY n) AS run FROM (""" + _EVENTS + """) e)
    SELECT user_id, event_id, CAST(max(CASE WHEN value > 50 THEN n END) OVER (PARTITION BY user_id, run) AS BIGINT) AS closes_until FROM r WHERE event_type = 'click'""",
)
sql_query(
    "q79_header_in_effect",
    """WITH t AS (SELECT user_id, n, event_id, CASE event_type WHEN 'purchase' THEN 'end' WHEN 'view' THEN 'header' ELSE 'text' END AS kind, value > 95 AS row_end FROM (""" + _EVENTS + """) e),
    l AS (SELECT *, coalesce(sum(CASE WHEN kind = 'end' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line FROM t),
    f AS (SELECT *, min(CASE WHEN kind = 'text' THEN n END) OVER (PARTITION BY user_id, line) AS first_text FROM l),
    s AS (SELECT user_id, CAST(line AS BIGINT) AS line, max(CASE WHEN kind = 'header' AND (first_text IS NULL OR n < first_text) THEN n END) AS own, max(CASE WHEN kind = 'header' AND n > first_text THEN n END) AS carry, max(CASE WHEN kind = 'end' AND row_end THEN 1 ELSE 0 END) AS by_row FROM f GROUP BY user_id, line)
    SELECT user_id, line, CAST(coalesce(own, lag(CASE WHEN by_row = 0 THEN carry END) OVER (PARTITION BY user_id ORDER BY line)) AS BIGINT) AS header FROM s""",
)
sql_query(
    "q80_line_and_its_header",
    """WITH t AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS line FROM (""" + _EVENTS + """) e)
    SELECT user_id, event_id, CAST(line AS BIGINT) AS line, CAST(max(CASE WHEN event_type = 'view' THEN n END) OVER (PARTITION BY user_id, line ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS header FROM t""",
)
sql_query(
    "q81_glyph_groups",
    """WITH g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id, event_type ORDER BY n) AS run FROM (""" + _EVENTS + """) e),
    i AS (SELECT user_id, event_type AS look, min(n) AS first, count(*) AS glyphs, round(sum(value), 4) AS width FROM g GROUP BY user_id, event_type, run)
    SELECT user_id, CAST(first AS BIGINT) AS first, look, glyphs, width, CASE WHEN look = 'view' THEN width END AS underline, CASE WHEN look = 'click' AND glyphs > 1 THEN round(width / (glyphs - 1), 4) END AS spread FROM i""",
)

# Orders

sql_query(
    "q82_sort_by_parts",
    """SELECT path, CAST(row_number() OVER (ORDER BY main DESC, number, path) AS BIGINT) AS place FROM (SELECT path, CASE WHEN path LIKE '%/main/%' THEN 1 ELSE 0 END AS main, coalesce(CAST(nullif(regexp_extract(path, 'layout ([0-9]+)', 1), '') AS BIGINT), 0) AS number
    FROM (SELECT concat(CASE WHEN n_nationkey % 4 = 0 THEN '/main/' ELSE '/box/' END, CASE WHEN n_nationkey % 3 = 0 THEN 'x' ELSE concat('layout ', n_nationkey * 7 % 30) END, '/', n_name) AS path FROM {nation}) p) t""",
)
sql_query("q83_stable_insertions", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 3, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS place FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM {lineitem}) t")
sql_query(
    "q84_widest_span",
    """WITH i AS (SELECT user_id, CAST(floor(value) AS BIGINT) AS a FROM {events}), g AS (SELECT user_id, a, lag(a) OVER (PARTITION BY user_id ORDER BY a) AS before FROM i), f AS (SELECT user_id, before + 1 AS lo, a AS hi FROM g WHERE a > before + 1)
    SELECT user_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY hi - lo DESC, lo DESC) AS r FROM f) t WHERE r = 1""",
)
