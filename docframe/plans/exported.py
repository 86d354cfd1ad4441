"""Queries that assemble decoded paragraphs to documents again."""

from __future__ import annotations

from docframe.plans.decoded import decoded_paragraphs, doc_id
from docframe.plans.registry import query
from docframe.sources import exports

_LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
k AS (SELECT *, max(CASE WHEN line <> '' THEN i ELSE 1 END) OVER (PARTITION BY doc_id) AS last FROM l)"""


@query(_LINES + " SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS body FROM k WHERE i <= last GROUP BY doc_id")
def d06_plain_text(spark, sf_dir):
    return exports.plain_text(decoded_paragraphs(spark, sf_dir)).select(doc_id(), "body")


@query(_LINES + " SELECT doc_id, string_agg(replace(line, '|', '\\|'), chr(10) || chr(10) ORDER BY i) AS body FROM k WHERE i <= last GROUP BY doc_id")
def d07_markdown(spark, sf_dir):
    return exports.markdown(decoded_paragraphs(spark, sf_dir)).select(doc_id(), "body")


@query(_LINES + """ SELECT doc_id, string_agg('<p>' || CASE WHEN line = '' THEN '<br>' ELSE replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') END || '</p>', chr(10) ORDER BY i) AS body FROM k WHERE i <= last GROUP BY doc_id""")
def d08_html(spark, sf_dir):
    return exports.html(decoded_paragraphs(spark, sf_dir)).select(doc_id(), "body")
