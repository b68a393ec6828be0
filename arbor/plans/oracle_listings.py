"""DuckDB oracle texts for the listing queries (``re_*``, listing ``dq_*``).

The SQL states every rule and column list anew, so that a wrong value in the
library shows as a difference, with DuckDB functions (``regexp_extract`` where
``regexp_matches``, 1-based list indexing, ``quantile_cont`` for interpolated
quantiles, unions for long forms).
"""

from __future__ import annotations

# What the listing rules say, stated apart from the library.
LISTING = ["id", "property_type", "address", "neighborhood", "city", "price", "sq_m_built",
           "sq_m_floor_area", "n_bedrooms", "bathrooms", "floor", "year_built", "exterior", "lift",
           "terrace", "balcony", "second_hand", "needs_renovating", "parking", "swimming_pool",
           "garden", "air_conditioning", "heating", "central_heating", "heating_type",
           "consumption_kwh_m2_year", "emissions_kgco2_m2_year", "orientation"]
SPARSE = {"sq_m_floor_area", "central_heating", "heating_type", "consumption_kwh_m2_year",
          "emissions_kgco2_m2_year", "orientation"}
NUMBERS = ["price", "sq_m_built", "floor", "n_bedrooms", "bathrooms", "year_built"]
PLACES = ["property_type", "neighborhood", "city"]
DENSITY = ["price", "sq_m_built", "floor"]
PRICE_HIST = {"price": 100, "log_price": 30}
NUMBER_HIST = {"price": 100, "sq_m_built": 36, "floor": 26, "n_bedrooms": 18, "bathrooms": 11, "year_built": 100}
# flag: the condition on t, the feature text in lower case
FLAGS = {"terrace": "contains(t, 'terrace')", "balcony": "contains(t, 'balcony')",
         "exterior": "contains(t, 'exterior')", "heating": "NOT contains(t, 'no heating')",
         "lift": "contains(t, 'with lift')", "second_hand": "contains(t, 'second hand')",
         "air_conditioning": "contains(t, 'air conditioning')",
         "needs_renovating": "contains(t, 'needs renovating')",
         "parking": "contains(t, 'parking space included')",
         "swimming_pool": "contains(t, 'swimming pool')", "garden": "contains(t, 'garden')"}
# extracted column: the pattern whose group is the value, and how it is read
AMOUNT = r"(\d*,*\d*)"
VALUES = {"sq_m_built": (AMOUNT + " m² built", "thousands"),
          "sq_m_floor_area": (AMOUNT + " m² floor area", "thousands"),
          "bedrooms": (r"(\d*) bedroom", "zero"), "bathrooms": (r"(\d*) bathroom", "zero"),
          "year_built": (r"built in (\d*)", "number"), "central_heating": (r"(\w*) heating", "text"),
          "heating_type": (r"heating: (\w*)", "text"),
          "consumption_kwh_m2_year": (f"consumption:{AMOUNT} kwh/m² year", "decimal"),
          "emissions_kgco2_m2_year": (f"emissions:{AMOUNT} kg co2/m² year", "decimal"),
          "orientation": (r"orientation (\w*)", "text")}
SHORT_FLOOR = [("Mezzanine", "1 floor"), ("Basement", "-1 floor"), ("Semi-basement", "-1 floor"),
               ("Floor -1", "-1 floor"), ("Floor -2", "-2 floor"), ("Ground", "0")]
SHORT_NOISE = ["exterior without lift", "interior with lift", "exterior with lift", "with lift",
               "Parking included", "exterior", "interior without lift", "without lift"]

RAW_LISTING = r"""raw_listing AS (SELECT p_partkey AS id, p_partkey AS ingest_seq,
  concat(p_type, ' home for sale in ', p_name) AS title,
  concat(p_brand, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE ', City ' END,
    CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(p_size % 5 AS VARCHAR) END) AS neighborhood,
  concat(CAST(100 + p_size AS VARCHAR), ',', CAST(100 + p_partkey % 900 AS VARCHAR)) AS price,
  concat('[''', CAST(10 * p_size AS VARCHAR), ' m² built'', ''',
    CASE WHEN p_size % 6 = 0 THEN 'no bedroom' ELSE concat(CAST(p_size % 6 AS VARCHAR), ' bedrooms') END,
    ''', ''', CAST(p_partkey % 9 AS VARCHAR), 'th floor ',
    CASE WHEN p_partkey % 2 = 0 THEN 'with' ELSE 'without' END, ' lift''',
    CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(', ''Built in ', CAST(1950 + p_size AS VARCHAR), '''') END,
    ', ''Consumption:', CAST(p_size AS VARCHAR), ',', CAST(p_partkey % 10 AS VARCHAR),
    ' kWh/m² year'']') AS features FROM part)"""


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def chain(expr: str, pairs) -> str:
    for a, b in pairs:
        expr = f"replace({expr}, {q(a)}, {q(b)})"
    return expr


def remove(expr: str, tokens) -> str:
    return chain(expr, [(t, "") for t in tokens])


def first_word(expr: str) -> str:
    return f"string_split_regex(trim({expr}), '\\s+')[1]"


def contains(expr: str, kw: str, lower=True, na=False) -> str:
    s = f"lower({expr})" if lower else expr
    hit = f"contains({s}, {q(kw)})"
    return hit if na is None else f"coalesce({hit}, {'true' if na else 'false'})"


# ---------------------------------------------------------------- short path
_EL = "list_transform(string_split(translate(features, '[]', ''), ', '), lambda x: regexp_replace(trim(x), '^''|''$', '', 'g'))"


def short_cols() -> dict[str, str]:
    c0, c1, c2 = "el[1]", "el[2]", "el[3]"
    size = f"TRY_CAST({first_word(remove(c0, ['\'', ',']))} AS INTEGER)"
    bed = f"CASE WHEN {contains(c1, 'bed', lower=False)} THEN {c1} END"
    n_bed = f"TRY_CAST(coalesce({first_word(remove(bed, ['\'']))}, '0') AS INTEGER)"
    src = f"(CASE WHEN {contains(c1, 'bed', lower=False)} OR {c1} = '' THEN {c2} ELSE {c1} END)"
    fl = f"split_part({chain(src, SHORT_FLOOR)}, ' floor', 1)"
    fl = remove(remove(fl, SHORT_NOISE), ["st", "nd", "th", "rd"])
    return {"size_in_m2": size, "n_bedrooms": n_bed, "floor": f"coalesce({fl}, '404')",
            "exterior": contains(src, "exterior"), "lift": contains(src, "with lift")}


# ---------------------------------------------------------------- long path
_TEXT = r"lower(regexp_replace(features, '[\[\]'']', '', 'g'))"


def group(expr: str, pattern: str) -> str:
    """The group of the first match; NULL without one."""
    return f"(CASE WHEN regexp_matches({expr}, {q(pattern)}) THEN regexp_extract({expr}, {q(pattern)}, 1) END)"


def _value(pattern: str, kind: str) -> str:
    """A value of the long text; an empty group is no number, or zero where
    the rule says so."""
    got = group(_TEXT, pattern)
    return {"thousands": f"TRY_CAST(replace({got}, ',', '') AS DOUBLE)",
            "decimal": f"TRY_CAST(replace({got}, ',', '.') AS DOUBLE)",
            "zero": f"TRY_CAST(CASE {got} WHEN '' THEN '0' ELSE {got} END AS INTEGER)",
            "number": f"TRY_CAST({got} AS DOUBLE)", "text": got}[kind]


def long_cols() -> dict[str, str]:
    out = {name: f"({said.replace('(t,', '(lower(features),')})" for name, said in FLAGS.items()}
    out |= {name: _value(*rule) for name, rule in VALUES.items()}
    number = group(f"replace({_TEXT}, ' m² floor area', '')", r"(\d*\w*) floor")
    out["floor"] = f"""CASE WHEN contains(lower(features), 'floor -2') THEN -2
  WHEN contains(lower(features), 'floor -1') THEN -1
  WHEN contains(lower(features), 'mezzanine') THEN 1
  WHEN {number} IS NULL THEN 0
  ELSE TRY_CAST(trim(regexp_replace(replace({number}, 'ground', '0'), 'st|nd|rd|th', '', 'g')) AS INTEGER) END"""
    return out


def head_cols() -> dict[str, str]:
    ptype = f"trim({group('title', '(.*) for sale')})"
    addr = group("title", "in (.*)")
    parts = "string_split(neighborhood, ', ')"
    return {"price": "TRY_CAST(replace(price, ',', '') AS DOUBLE)", "property_type": ptype,
            "address": addr, "neighborhood": f"{parts}[1]", "city": f"{parts}[2]"}


def _sel(cols: dict[str, str]) -> str:
    return ",\n  ".join(f"{v} AS {k}" for k, v in cols.items())


RAW_EL = f"raw_el AS (SELECT *, {_EL} AS el FROM raw_listing)"


def structured_cte() -> str:
    short, long_, head = short_cols(), long_cols(), head_cols()
    pick = {**long_, **head, "sq_m_built": f"TRY_CAST({long_['sq_m_built']} AS INTEGER)",
            "n_bedrooms": short["n_bedrooms"], "exterior": short["exterior"],
            "lift": short["lift"]}
    cols = {c: pick[c] for c in LISTING[1:]}
    return f"structured AS (SELECT id, {_sel(cols)}, ingest_seq FROM raw_el)"


def analysis_ctes() -> str:
    keep = [c for c in LISTING if c not in SPARSE]
    sel = ", ".join("year_built2 AS year_built" if c == "year_built" else
                    ("city1 AS city" if c == "city" else
                     ("neighborhood1 AS neighborhood" if c == "neighborhood" else c))
                    for c in keep)
    return f"""deduped AS (SELECT * FROM structured
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingest_seq) = 1),
backfilled AS (SELECT *, coalesce(city, neighborhood) AS city1,
  CASE WHEN coalesce(city, neighborhood) IS NULL THEN address ELSE neighborhood END AS neighborhood1
  FROM deduped),
medians AS (SELECT neighborhood1 AS nb, quantile_cont(year_built, 0.5) AS med
  FROM backfilled WHERE neighborhood1 IS NOT NULL AND year_built IS NOT NULL GROUP BY neighborhood1),
imputed AS (SELECT b.*, CASE WHEN b.neighborhood1 IS NULL THEN NULL
  ELSE coalesce(CAST(b.year_built AS DOUBLE), m.med) END AS year_built2
  FROM backfilled b LEFT JOIN medians m ON b.neighborhood1 = m.nb),
analysis AS (SELECT {sel} FROM imputed WHERE year_built2 IS NOT NULL),
analysis_log AS (SELECT *, ln(1 + price) AS log_price FROM analysis)"""


def with_listing(body: str, extra: str = "") -> str:
    ctes = [RAW_LISTING, RAW_EL, structured_cte(), analysis_ctes()]
    if extra:
        ctes.append(extra.strip())
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


# ---------------------------------------------------------------- statistics
def unpivot(table: str, cols, name="series", value="value", cast="DOUBLE") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {q(c)} AS {name}, CAST({c} AS {cast}) AS {value} FROM {table}" for c in cols)


def describe_sql(table: str, cols) -> str:
    return f"""
SELECT series AS "column", COUNT(*) AS count, round(avg(value), 6) AS mean,
  round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
  round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50,
  round(quantile_cont(value, 0.75), 6) AS q75, round(max(value), 6) AS max
FROM ({unpivot(table, cols)}) lv WHERE value IS NOT NULL GROUP BY series"""


def hist_ctes(table: str, spec: dict[str, int], prefix: str = "h") -> str:
    bins = " UNION ALL ".join(f"SELECT {q(k)} AS series, {v} AS nbins" for k, v in spec.items())
    return f"""{prefix}_lv AS (SELECT * FROM ({unpivot(table, list(spec))}) x WHERE value IS NOT NULL),
{prefix}_bins AS ({bins}),
{prefix}_bounds AS (SELECT m.series, b.nbins,
  CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
  FROM (SELECT series, min(value) AS mn, max(value) AS mx FROM {prefix}_lv GROUP BY series) m
  JOIN {prefix}_bins b ON m.series = b.series),
{prefix}_counts AS (SELECT v.series,
  least(CAST(floor((v.value - b.lo) / ((b.hi - b.lo) / b.nbins)) AS INTEGER), b.nbins - 1) AS bin,
  COUNT(*) AS cnt FROM {prefix}_lv v JOIN {prefix}_bounds b ON v.series = b.series GROUP BY 1, 2),
{prefix}_grid AS (SELECT series, lo, hi, nbins, unnest(range(0, nbins)) AS bin FROM {prefix}_bounds),
{prefix}_hist AS (SELECT g.series, CAST(g.bin AS INTEGER) AS bin,
  round(g.lo + g.bin * ((g.hi - g.lo) / g.nbins), 6) AS lo,
  round(CASE WHEN g.bin = g.nbins - 1 THEN g.hi ELSE g.lo + (g.bin + 1) * ((g.hi - g.lo) / g.nbins) END, 6) AS hi,
  CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
  FROM {prefix}_grid g LEFT JOIN {prefix}_counts c ON g.series = c.series AND g.bin = c.bin)"""


KDE_SELECT = """SELECT series, point, round(x, 6) AS x, round(sum(d), 12) AS density
FROM dens GROUP BY series, point, x"""


def kde_ctes(table: str, cols, grid: int = 200) -> str:
    return f"""k_lv AS (SELECT * FROM ({unpivot(table, list(cols))}) x WHERE value IS NOT NULL),
mom AS (SELECT series, COUNT(*) AS n, stddev_samp(value) * pow(CAST(COUNT(*) AS DOUBLE), -0.2) AS bw,
  min(value) AS mn, max(value) AS mx FROM k_lv GROUP BY series HAVING min(value) < max(value)),
centres AS (SELECT v.series, (floor(v.value / pow(2.0, floor(log2(m.bw / 4)))) + 0.5) * pow(2.0, floor(log2(m.bw / 4))) AS c,
  COUNT(*) AS count FROM k_lv v JOIN mom m ON v.series = m.series GROUP BY 1, 2),
pts AS (SELECT c.series, c.c, c.count, m.n, m.bw, m.mn, m.mx, unnest(range(0, {grid})) AS point
  FROM centres c JOIN mom m ON c.series = m.series),
dens AS (SELECT series, CAST(point AS INTEGER) AS point, mn + point * (mx - mn) / {grid - 1} AS x,
  count * exp(-0.5 * ((mn + point * (mx - mn) / {grid - 1} - c) / bw) * ((mn + point * (mx - mn) / {grid - 1} - c) / bw))
  / (n * bw * {(2 * 3.141592653589793) ** 0.5!r}) AS d FROM pts)"""


def box_sql(src: str, groups, value: str) -> str:
    g = ", ".join(groups)
    notnull = " AND ".join(f"{c} IS NOT NULL" for c in list(groups) + [value])
    on = " AND ".join(f"b.{c} = q.{c}" for c in groups)
    gq = ", ".join(f"b.{c}" for c in groups)
    inside = f"(b.{value} >= q.q1 - 1.5 * (q.q3 - q.q1) AND b.{value} <= q.q3 + 1.5 * (q.q3 - q.q1))"
    return f"""box_base AS (SELECT {g}, CAST({value} AS DOUBLE) AS {value} FROM {src} WHERE {notnull}),
box_q AS (SELECT {g}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
  quantile_cont({value}, 0.75) AS q3 FROM box_base GROUP BY {g}),
box AS (SELECT {gq}, COUNT(*) AS n, round(q.q1, 6) AS q1, round(q.median, 6) AS median,
  round(q.q3, 6) AS q3,
  round(min(CASE WHEN {inside} THEN b.{value} END), 6) AS whisker_lo,
  round(max(CASE WHEN {inside} THEN b.{value} END), 6) AS whisker_hi,
  COUNT(*) FILTER (WHERE NOT {inside}) AS outliers
  FROM box_base b JOIN box_q q ON {on} GROUP BY {gq}, q.q1, q.median, q.q3)"""


def _corr_rows() -> str:
    cols = NUMBERS
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            rows.append(f"SELECT {q(a)} AS col_a, {q(b)} AS col_b, round(corr({b}, {a}), 6) AS r FROM analysis")
            if a != b:
                rows.append(f"SELECT {q(b)} AS col_a, {q(a)} AS col_b, round(corr({b}, {a}), 6) AS r FROM analysis")
    return "\nUNION ALL\n".join(rows)


def _flags_long() -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {q(f)} AS feature, CAST({f} AS VARCHAR) AS value, log_price FROM analysis_log"
        for f in FLAGS)


ORACLE = {
    "re_info_features": with_listing(f"SELECT id, {_sel(short_cols())} FROM raw_el"),
    "re_features": with_listing(f"SELECT id, {_sel(long_cols())} FROM raw_el"),
    "re_price_title_place": with_listing(f"SELECT id, {_sel(head_cols())} FROM raw_listing"),
    "re_reconcile_merge": with_listing("SELECT * EXCLUDE (ingest_seq) FROM structured"),
    "dq_reconcile": with_listing("""
SELECT attribute, id, left_value, right_value FROM (
  SELECT 'size' AS attribute, id, CAST(s_size AS VARCHAR) AS left_value, CAST(l_size AS VARCHAR) AS right_value,
    NOT coalesce(s_size = l_size, false) AS differs FROM pairs
  UNION ALL SELECT 'bedrooms', id, CAST(s_bed AS VARCHAR), CAST(l_bed AS VARCHAR),
    NOT coalesce(s_bed = l_bed, false) FROM pairs
  UNION ALL SELECT 'lift', id, CAST(s_lift AS VARCHAR), CAST(l_lift AS VARCHAR),
    NOT coalesce(s_lift = l_lift, false) FROM pairs
  UNION ALL SELECT 'exterior', id, CAST(s_ext AS VARCHAR), CAST(l_ext AS VARCHAR),
    NOT coalesce(s_ext = l_ext, false) FROM pairs) x WHERE differs""",
        f"""pairs AS (SELECT id, {short_cols()['size_in_m2']} AS s_size,
  TRY_CAST({long_cols()['sq_m_built']} AS INTEGER) AS l_size,
  {short_cols()['n_bedrooms']} AS s_bed, {long_cols()['bedrooms']} AS l_bed,
  {short_cols()['lift']} AS s_lift, {long_cols()['lift']} AS l_lift,
  {short_cols()['exterior']} AS s_ext, {long_cols()['exterior']} AS l_ext FROM raw_el)"""),
    "re_clean": with_listing("SELECT * FROM analysis"),
    "re_describe": with_listing(describe_sql("analysis", NUMBERS)),
    "re_value_counts": with_listing(f"""
SELECT series AS "column", value, COUNT(*) AS count
FROM ({unpivot('analysis', PLACES, cast='VARCHAR')}) x WHERE value IS NOT NULL GROUP BY 1, 2"""),
    "dq_nunique": with_listing("\nUNION ALL\n".join(
        f"SELECT {q(c)} AS \"column\", COUNT(DISTINCT CAST({c} AS VARCHAR)) AS nunique FROM structured"
        for c in ["id", "property_type", "address", "neighborhood", "city", "price"])),
    "dq_null_counts": with_listing("\nUNION ALL\n".join(
        f"SELECT {q(c)} AS \"column\", COUNT(*) FILTER (WHERE {c} IS NULL) AS nulls FROM structured"
        for c in LISTING)),
    "re_price_distribution": with_listing("SELECT * FROM h_hist", hist_ctes("analysis_log", PRICE_HIST)),
    "re_empirical_rule": with_listing("""
SELECT round(m, 6) AS mean_log, round(s, 6) AS std_log, round(exp(m - s) - 1, 2) AS lo_68,
  round(exp(m + s) - 1, 2) AS hi_68, round(exp(m - 2 * s) - 1, 2) AS lo_95, round(exp(m + 2 * s) - 1, 2) AS hi_95
FROM (SELECT avg(ln(1 + price)) AS m, stddev_samp(ln(1 + price)) AS s FROM analysis)"""),
    "re_characteristics_hist": with_listing("SELECT * FROM h_hist",
                                            hist_ctes("analysis", NUMBER_HIST)),
    "re_feature_counts": with_listing(f"""
SELECT feature, CAST(value AS BOOLEAN) AS value, COUNT(*) AS count FROM ({_flags_long()}) x
WHERE value IS NOT NULL GROUP BY 1, 2"""),
    "re_corr_matrix": with_listing(_corr_rows()),
    "re_price_by_feature": with_listing("SELECT * FROM box",
                                        f"flags AS ({_flags_long()}),\n" + box_sql("flags", ["feature", "value"], "log_price")),
    "re_price_by_type": with_listing("SELECT * FROM box", box_sql("analysis_log", ["property_type"], "log_price")),
    "re_price_by_city": with_listing("SELECT * FROM box", box_sql("analysis_log", ["city"], "log_price")),
    "re_price_by_place": with_listing("""
SELECT b.city_neighborhood, round(m.median_price, 6) AS median_price, b.n, b.q1, b.median, b.q3,
  b.whisker_lo, b.whisker_hi, b.outliers
FROM box b JOIN (SELECT city_neighborhood, quantile_cont(price, 0.5) AS median_price FROM keyed
  WHERE city_neighborhood IS NOT NULL AND price IS NOT NULL GROUP BY 1) m
  ON b.city_neighborhood = m.city_neighborhood
ORDER BY median_price, b.city_neighborhood""",
        "keyed AS (SELECT *, city || ' - ' || neighborhood AS city_neighborhood FROM analysis_log),\n"
        + box_sql("keyed", ["city_neighborhood"], "log_price")),
    "re_city_counts": with_listing("""
SELECT 'city' AS level, city, CAST(NULL AS VARCHAR) AS neighborhood, COUNT(*) AS count
FROM analysis WHERE city IS NOT NULL GROUP BY city
UNION ALL
SELECT 'neighborhood', city, neighborhood, COUNT(*) FROM analysis
WHERE city IS NOT NULL AND neighborhood IS NOT NULL GROUP BY city, neighborhood"""),
}


ORACLE["re_price_kde"] = with_listing(KDE_SELECT, kde_ctes("analysis_log", list(PRICE_HIST)))
ORACLE["re_characteristics_kde"] = with_listing(KDE_SELECT, kde_ctes("analysis", DENSITY))
