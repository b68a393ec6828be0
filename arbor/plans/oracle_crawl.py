"""DuckDB oracle texts for the crawl, extraction and data-quality queries."""

from __future__ import annotations

from arbor.plans.oracle_listings import LISTING, chain, long_cols, q, short_cols, with_listing

# Patterns and constants of these texts are their own, not the operators'.
LI = r"(?s)<li(?:\s[^>]*)?>(.*?)</li>"
UL = r"(?s)<ul(?:\s[^>]*)?>(.*?)</ul>"
FIELDS = {
    "title": r"(?s)<h1(?:\s[^>]*)?>(.*?)</h1>",
    "description": r"(?s)<p(?:\s[^>]*)?>(.*?)</?(?:p|div|article|section|main|body|header|footer|ul|ol|table"
                   r"|h[1-6])[\s>]",
    "price": r'(?s)<span class="txt-bold"[^>]*>(.*?)</span>',
}
REQUIRED = ("title", "description")
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\u00a0"),
            ("&copy;", "©"), ("&middot;", "·"), ("&euro;", "€"), ("&ndash;", "–"), ("&mdash;", "—"),
            ("&hellip;", "…"), ("&amp;", "&")]
SEED = r"regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1)"
BODY = r"regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"


def text_of(inner: str) -> str:
    no_tags = rf"regexp_replace({inner}, '\s*<[^>]*>\s*', '', 'g')"
    return f"regexp_replace({chain(no_tags, ENTITIES)}, '^\\s+|\\s+$', '', 'g')"


def first(expr: str, pattern: str) -> str:
    return f"NULLIF(regexp_extract({expr}, {q(pattern)}, 1), '')"


LP = rf"""lp AS (SELECT {SEED} AS neighborhood_id, regexp_extract(url, '^https?://([^/]+/[a-z]+)/', 1) AS list_id, page_id,
  coalesce(TRY_CAST(NULLIF(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS INTEGER), 1) AS page_index, html FROM pages),
numbered AS (SELECT *, dense_rank() OVER (PARTITION BY list_id ORDER BY page_index) AS place FROM lp),
kept AS (SELECT *, page_index = max(page_index) OVER (PARTITION BY list_id) AS is_last
  FROM (SELECT * FROM numbered WHERE page_index = place) a)"""


def items_sql(src: str) -> str:
    return f"""SELECT neighborhood_id, page_id, CAST(pos AS INTEGER) AS item_pos,
  {first('lis[pos + 1]', 'href="([^"]*)"')} AS property_id, {text_of('lis[pos + 1]')} AS item_text
FROM (SELECT *, unnest(range(len(lis))) AS pos FROM (
  SELECT neighborhood_id, page_id, regexp_extract_all({BODY}, {q(LI)}, 1) AS lis FROM {src}) a) b"""


def _records_cte() -> str:
    cols = {name: text_of(first(BODY, pattern)) for name, pattern in FIELDS.items()}
    nested = (f"list_transform(regexp_extract_all({BODY}, {q(UL)}, 1), lambda ul: "
              f"list_transform(regexp_extract_all(ul, {q(LI)}, 1), lambda li: {text_of('li')}))")
    missing = "concat_ws(',', " + ", ".join(
        f"CASE WHEN {cols[name]} IS NULL OR {cols[name]} = '' THEN {q(name)} END"
        for name in REQUIRED) + ")"
    sel = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return f"""rec AS (SELECT page_id AS id, url, {SEED} AS neighborhood, {sel},
  {nested} AS features, flatten({nested}) AS info_features, {missing} AS missing FROM pages)"""


FP_DOCS = "docs AS (SELECT doc_id, lang, source, n_chars, text FROM documents)"

ORACLE = {
    "ext_frontier": f"""
WITH seeds AS (SELECT DISTINCT {SEED} AS neighborhood_id FROM pages WHERE {SEED} <> '')
SELECT neighborhood_id, CAST(i AS INTEGER) AS page_index,
  '/' || neighborhood_id || '/' || printf('pagina-%d.htm', i) AS page_link
FROM (SELECT neighborhood_id, unnest(range(1, 61)) AS i FROM seeds)""",
    "crawl_pages": f"WITH {LP}\nSELECT neighborhood_id, list_id, page_id, page_index, is_last FROM kept",
    "crawl_items": f"WITH {LP}\n{items_sql('kept')}",
    "ext_items": f"WITH {LP}\n{items_sql('lp')}",
    "crawl_records": f"""WITH {_records_cte()}
SELECT id, neighborhood, {', '.join(FIELDS)}, features, info_features
FROM rec WHERE missing = ''""",
    "ext_error_rows": f"""WITH {_records_cte()}
SELECT id, url AS page_link, 'missing: ' || missing AS error FROM rec WHERE missing <> ''""",
    "dq_duplicate_report": """
SELECT d.doc_id, d.lang, d.source, d.n_chars, c.copies FROM documents d
JOIN (SELECT text, COUNT(*) AS copies FROM documents GROUP BY text HAVING COUNT(*) > 1) c
  ON d.text = c.text""",
    "win_dedupe_first": """
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""",
    "win_duplicated": """
SELECT doc_id, doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicated FROM documents""",
    "dq_null_rows": with_listing(f"SELECT id, features FROM raw_el WHERE {long_cols()['year_built']} IS NULL"),
    "dq_sentinel": with_listing(f"SELECT id, features FROM raw_el WHERE {short_cols()['floor']} = '404'"),
    "agg_distinct_values": with_listing(f"SELECT DISTINCT {short_cols()['floor']} AS floor FROM raw_el"),
    "lim_head": with_listing("SELECT id, title, price FROM raw_listing ORDER BY ingest_seq LIMIT 5"),
    "lim_tail": with_listing("SELECT id, title, price FROM raw_listing ORDER BY ingest_seq DESC LIMIT 5"),
}


# Spark type names of the structured listing, as ``DataFrame.dtypes`` gives them.
_STRUCTURED_TYPES = {
    "id": "bigint", "property_type": "string", "address": "string", "neighborhood": "string",
    "city": "string", "price": "double", "sq_m_built": "int", "sq_m_floor_area": "double",
    "n_bedrooms": "int", "bathrooms": "int", "floor": "int", "year_built": "double",
    "central_heating": "string", "heating_type": "string", "consumption_kwh_m2_year": "double",
    "emissions_kgco2_m2_year": "double", "orientation": "string",
}

ORACLE["dq_info"] = with_listing("\nUNION ALL\n".join(
    f"SELECT {q(c)} AS \"column\", {q(_STRUCTURED_TYPES.get(c, 'boolean'))} AS dtype, "
    f"COUNT({c}) AS non_null, COUNT(*) AS rows FROM structured"
    for c in LISTING))
