"""Reference SQL for the registered queries, written for DuckDB and independent of the library."""

from __future__ import annotations

from queries.catalog import SQL_TEXTS
from queries.views import (
    DIRTY_COLUMNS, DIRTY_ORDERS, DIRTY_TYPES, LINEITEM_NUMBERS, SPARSE_ORDERS, WIDE_LINEITEM, WIDE_NUMBERS, WRITTEN_ORDERS,
)

ORACLES: dict[str, str] = dict(SQL_TEXTS)

DIRTY = f"WITH d AS ({DIRTY_ORDERS})"
SPARSE = f"WITH d AS ({SPARSE_ORDERS})"
WRITTEN = f"WITH d AS ({WRITTEN_ORDERS})"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
REPORT_WORDS = "('','na','n/a','nan','none','null','nil','missing','unknown','?','-')"
SCHEMA_WORDS = "('','na','n/a','nan','none','null','nil','missing','unknown','-','--')"
CLEANING_WORDS = "('','na','n/a','nan','none','null','nil','missing','unknown','?','-','--')"
TEXT_COLUMNS = ("order_id", "status", "price", "order_date", "priority", "is_urgent", "channel", "market")


def q(s: str) -> str:
    return "'" + s + "'"


def trim(c: str) -> str:
    return f"trim(CAST({c} AS STRING), {BLANKS})"


def missing(c: str) -> str:
    """Missing or missing-like, as anomaly and quality reports count it."""
    return f"({c} IS NULL OR lower({trim(c)}) IN {REPORT_WORDS})"


def number(c: str) -> str:
    return f"(CASE WHEN regexp_full_match({trim(c)}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST({trim(c)} AS DOUBLE) END)"


def date(c: str) -> str:
    return f"TRY_STRPTIME({trim(c)}, '%Y-%m-%d')"


def iso(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"


def pct(part: str, whole: str, digits: int = 2) -> str:
    return f"round(COALESCE(100.0 * ({part}) / NULLIF({whole}, 0), 0.0), {digits})"


def each(columns, form, join=" UNION ALL ") -> str:
    return join.join(form(c) for c in columns)


def of_type(*kinds: str) -> list[str]:
    return [c for c in DIRTY_COLUMNS if DIRTY_TYPES[c] in kinds]


# -- schema inference -----------------------------------------------------------------

def _orders_profile(c: str, kind: str, numeric: int, dated: int) -> str:
    numbers = kind == "'Numerical'"
    summary = (
        f"round(min({c}), 3) AS min, round(max({c}), 3) AS max, round(avg({c}), 3) AS mean, "
        f"round(median({c}), 3) AS median, round(stddev_samp({c}), 3) AS std"
        if numbers else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, NULL::DOUBLE AS median, NULL::DOUBLE AS std"
    )
    span = (f"{iso(f'min({c})')} AS date_min, {iso(f'max({c})')} AS date_max"
            if dated else "NULL::VARCHAR AS date_min, NULL::VARCHAR AS date_max")
    return f"""SELECT '{c}' AS "column", {kind} AS detected_type, count(*) - count({c}) AS missing,
        count({c}) AS non_null, count(DISTINCT {c}) AS "unique", round(1 - count({c}) / count(*), 4) AS missing_ratio,
        round(count(DISTINCT {c}) / count({c}), 4) AS unique_ratio, 0::BIGINT AS null_like_count,
        0.0::DOUBLE AS null_like_ratio, {numeric}.0::DOUBLE AS numeric_parse_ratio,
        {dated}.0::DOUBLE AS datetime_parse_ratio, NULL::VARCHAR AS date_format, {summary}, {span} FROM orders"""


ORACLES["schema_profile_orders"] = " UNION ALL ".join([
    _orders_profile("o_orderkey", "CASE WHEN count(DISTINCT o_orderkey) >= 0.98 * count(o_orderkey) THEN 'Identifier' ELSE 'Numerical' END", 1, 0),
    _orders_profile("o_custkey", "'Numerical'", 1, 0),
    _orders_profile("o_orderstatus", "CASE WHEN count(DISTINCT o_orderstatus) <= 20 THEN 'Categorical' ELSE 'Text' END", 0, 0),
    _orders_profile("o_totalprice", "'Numerical'", 1, 0),
    _orders_profile("o_orderdate", "'Datetime'", 0, 1),
    _orders_profile("o_orderpriority", "CASE WHEN count(DISTINCT o_orderpriority) <= 20 THEN 'Categorical' ELSE 'Text' END", 0, 0),
])

# The same table profiled part by part; the median comes from a sketch there and is left out.
ORACLES["incremental_profile"] = f'SELECT * EXCLUDE (median) FROM ({ORACLES["schema_profile_orders"]})'


def _cascade(c: str) -> str:
    """The type cascade for a text column of the dirty view, whose only date format is ISO."""
    lenient = number(f"regexp_replace({c}, '[,$₹€£%]', '', 'g')")
    return f"""SELECT '{c}' AS "column", count(*) AS n_rows, count({c}) AS non_null, count(DISTINCT {c}) AS uniques,
        count(*) FILTER (WHERE lower({trim(c)}) IN {SCHEMA_WORDS}) AS null_like,
        count({lenient}) / count({c}) AS numbers, count({date(c)}) / count({c}) AS dates,
        avg(length({trim(c)})) AS len,
        bool_and(lower({trim(c)}) IN ('true','yes','y','1','on','active','enabled','false','no','n','0','off','inactive','disabled')) AS words,
        bool_or(lower({trim(c)}) IN ('true','yes','y','1','on','active','enabled')) AS t,
        bool_or(lower({trim(c)}) IN ('false','no','n','0','off','inactive','disabled')) AS f,
        avg(CASE WHEN regexp_full_match({trim(c)}, '[A-Za-z]*[-_]?[0-9]+[A-Za-z0-9_-]*') THEN 1.0 ELSE 0.0 END) AS structured,
        {str(c.endswith('_id')).upper()} AS id_name, {str('date' in c).upper()} AS date_name,
        TRUE AS is_text FROM d WHERE TRUE"""


def _whole(c: str, id_name: bool) -> str:
    return f"""SELECT '{c}', count(*), count({c}), count(DISTINCT {c}), 0, 1.0, 0.0, avg(length(CAST({c} AS STRING))),
        bool_and({c} IN (0, 1)), bool_or({c} = 1), bool_or({c} = 0), 1.0, {str(id_name).upper()}, FALSE, FALSE FROM d"""


ORACLES["schema_profile_dirty"] = f"""{DIRTY}, s AS (
    {each(TEXT_COLUMNS, _cascade)} UNION ALL {_whole('customer_id', True)} UNION ALL {_whole('quantity', False)})
SELECT "column",
    CASE WHEN non_null = 0 THEN 'Empty' WHEN words AND t AND f THEN 'Boolean' WHEN id_name THEN 'Identifier'
         WHEN NOT is_text THEN 'Numerical' WHEN dates >= 0.90 AND date_name THEN 'Datetime' WHEN dates >= 0.98 THEN 'Datetime'
         WHEN numbers >= 0.95 THEN 'Numerical' WHEN len >= 40 THEN 'Text'
         WHEN uniques <= 20 OR (uniques <= 100 AND uniques / non_null <= 0.2)
              OR (non_null >= 50 AND uniques / non_null <= 0.05) THEN 'Categorical'
         WHEN non_null >= 5 AND uniques / non_null >= 0.95 AND structured >= 0.8 THEN 'Identifier'
         ELSE 'Text' END AS detected_type,
    n_rows - non_null AS missing, non_null, uniques AS "unique", round((n_rows - non_null) / n_rows, 4) AS missing_ratio,
    round(uniques / non_null, 4) AS unique_ratio, null_like AS null_like_count,
    round(null_like / n_rows, 4) AS null_like_ratio, round(numbers, 4) AS numeric_parse_ratio,
    round(dates, 4) AS datetime_parse_ratio,
    CASE WHEN dates >= 0.90 THEN '%Y-%m-%d' END AS date_format, round(len, 2) AS average_text_length FROM s"""

ORACLES["columns_by_type"] = """
WITH u AS (SELECT count(*) AS n, count(DISTINCT l_orderkey) AS a, count(DISTINCT l_partkey) AS b,
                  count(DISTINCT l_suppkey) AS c FROM lineitem),
t AS (SELECT 1 AS place, 'l_orderkey' AS col, CASE WHEN a >= 0.98 * n THEN 'Identifier' ELSE 'Numerical' END AS kind FROM u
      UNION ALL SELECT 2, 'l_partkey', CASE WHEN b >= 0.98 * n THEN 'Identifier' ELSE 'Numerical' END FROM u
      UNION ALL SELECT 3, 'l_suppkey', CASE WHEN c >= 0.98 * n THEN 'Identifier' ELSE 'Numerical' END FROM u
      UNION ALL SELECT 4, 'l_linenumber', 'Numerical' UNION ALL SELECT 5, 'l_quantity', 'Numerical'
      UNION ALL SELECT 6, 'l_extendedprice', 'Numerical' UNION ALL SELECT 7, 'l_discount', 'Numerical'
      UNION ALL SELECT 8, 'l_tax', 'Numerical' UNION ALL SELECT 9, 'l_returnflag', 'Categorical'
      UNION ALL SELECT 10, 'l_linestatus', 'Categorical' UNION ALL SELECT 11, 'l_shipdate', 'Datetime'),
k AS (SELECT unnest(['Identifier','Boolean','Datetime','Numerical','Categorical','Text','Empty']) AS kind)
SELECT k.kind AS detected_type, COALESCE(string_agg(t.col, ',' ORDER BY t.place), '') AS columns
FROM k LEFT JOIN t ON k.kind = t.kind GROUP BY k.kind"""

ORACLES["boolean_detect"] = """
SELECT 'doc_id' AS "column", 'Identifier' AS detected_type, count(DISTINCT doc_id) AS "unique" FROM labels UNION ALL
SELECT 'quality', CASE WHEN bool_and(quality IN (0, 1)) AND min(quality) = 0 AND max(quality) = 1 THEN 'Boolean' ELSE 'Numerical' END,
       count(DISTINCT quality) FROM labels UNION ALL
SELECT 'toxic', CASE WHEN bool_and(toxic IN (0, 1)) AND min(toxic) = 0 AND max(toxic) = 1 THEN 'Boolean' ELSE 'Numerical' END,
       count(DISTINCT toxic) FROM labels"""

ORACLES["null_like_values"] = f"""{DIRTY} SELECT "column", value, count(*) AS n FROM (
    {each(TEXT_COLUMNS, lambda c: f'''SELECT '{c}' AS "column", {trim(c)} AS value FROM d WHERE lower({trim(c)}) IN {SCHEMA_WORDS}''')})
    GROUP BY 1, 2"""

ORACLES["top_values"] = f"""SELECT "column", value, n, CAST(place AS INTEGER) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS place FROM (
    {each(("p_name", "p_brand", "p_type"), lambda c: f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS n FROM part GROUP BY {c}")}
    )) WHERE place <= 10"""

_FORMATS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%m-%d-%Y", "%m/%d/%Y", "%Y-%m-%d %H:%M:%S",
            "%Y/%m/%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%d-%m-%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%Y-%m", "%Y/%m",
            "%b %d %Y", "%B %d %Y", "%d %b %Y", "%d %B %Y")
ORACLES["date_format_counts"] = WRITTEN + " " + " UNION ALL ".join(
    f"SELECT 'placed' AS \"column\", '{f}' AS format, count(TRY_STRPTIME(placed, '{f}')) AS parsed FROM d" for f in _FORMATS
) + " UNION ALL SELECT 'placed', 'mixed', count(COALESCE(TRY_STRPTIME(placed, '%d/%m/%Y'), TRY_STRPTIME(placed, '%m/%d/%Y'))) FROM d"

_LENIENT = number("regexp_replace(amount, '[,$₹€£%]', '', 'g')")
ORACLES["numeric_parse"] = f"""{WRITTEN} SELECT count(amount) AS non_null, count({number('amount')}) AS plain,
    count({_LENIENT}) AS lenient, sum({_LENIENT}) AS total FROM d"""

ORACLES["text_length_profile"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", CASE WHEN '{c}' = 'text' OR avg(length({trim(c)})) >= 40 THEN 'Text'
        WHEN count(DISTINCT {c}) <= 20 THEN 'Categorical' ELSE 'Text' END AS detected_type,
        round(avg(length({trim(c)})), 2) AS average_text_length FROM documents""" for c in ("text", "lang", "source"))

# -- anomalies ----------------------------------------------------------------------------

_MISSING_ROWS = each(DIRTY_COLUMNS, lambda c: f"""SELECT '{c}' AS "column", count(*) AS n_rows,
    count(*) FILTER (WHERE {missing(c)}) AS m FROM d""")
_SEVERITY = """CASE WHEN 100.0 * m / n_rows >= 50 THEN 'high' WHEN 100.0 * m / n_rows >= 20 THEN 'medium'
    WHEN m > 0 THEN 'low' ELSE 'none' END"""
ORACLES["missing_by_column"] = f"""{DIRTY}, m AS ({_MISSING_ROWS})
SELECT "column", n_rows AS "rows", m AS missing_values, {pct('m', 'n_rows')} AS missing_percentage, {_SEVERITY} AS severity FROM m"""


def _outliers(columns, source: str, num) -> str:
    """Per column: count, quartiles, fences and the outlier counts (an IQR of 0 has none)."""
    quart = each(columns, lambda c: f"""SELECT '{c}' AS "column", count({num(c)}) AS n,
        quantile_cont({num(c)}, 0.25) AS q1, quantile_cont({num(c)}, 0.5) AS med, quantile_cont({num(c)}, 0.75) AS q3 FROM {source}""")
    cells = each(columns, lambda c: f"""SELECT '{c}' AS "column", {num(c)} AS x FROM {source}""")
    return f"""qs AS ({quart}), fences AS (
        SELECT *, q3 - q1 AS iqr, CASE WHEN q3 = q1 THEN q1 ELSE q1 - 1.5 * (q3 - q1) END AS lo,
            CASE WHEN q3 = q1 THEN q3 ELSE q3 + 1.5 * (q3 - q1) END AS hi,
            CASE WHEN q3 = q1 THEN q1 ELSE q1 - 3.0 * (q3 - q1) END AS xlo,
            CASE WHEN q3 = q1 THEN q3 ELSE q3 + 3.0 * (q3 - q1) END AS xhi FROM qs WHERE n >= 4),
    cells AS ({cells}),
    outs AS (SELECT f."column", f.n, f.q1, f.med, f.q3, f.iqr, f.lo, f.hi, f.xlo, f.xhi,
        count(*) FILTER (WHERE f.iqr > 0 AND (x < f.lo OR x > f.hi)) AS o,
        count(*) FILTER (WHERE f.iqr > 0 AND (x < f.xlo OR x > f.xhi)) AS e
        FROM fences f JOIN cells c ON f."column" = c."column" GROUP BY ALL)"""


_OUTLIER_SELECT = f"""SELECT "column", n AS values_checked, o AS outliers, e AS extreme_outliers, {pct('o', 'n')} AS outlier_percentage,
    round(q1, 2) AS q1, round(med, 2) AS median, round(q3, 2) AS q3, round(iqr, 2) AS iqr, round(lo, 2) AS lower_bound,
    round(hi, 2) AS upper_bound, round(xlo, 2) AS extreme_lower_bound, round(xhi, 2) AS extreme_upper_bound FROM outs"""
_DIRTY_NUMBERS = of_type("Numerical")
_DIRTY_OUTLIERS = _outliers(_DIRTY_NUMBERS, "d", number)
ORACLES["iqr_outliers"] = f"{DIRTY}, {_DIRTY_OUTLIERS} {_OUTLIER_SELECT}"
ORACLES["iqr_outliers_lineitem"] = f"WITH {_outliers(LINEITEM_NUMBERS, 'lineitem', lambda c: f'CAST({c} AS DOUBLE)')} {_OUTLIER_SELECT}"
_TOTALS = f"""SELECT CAST(sum(n) AS BIGINT) AS values_checked, CAST(sum(o) AS BIGINT) AS outliers, CAST(sum(e) AS BIGINT) AS extreme_outliers,
    {pct('sum(o)', 'sum(n)')} AS outlier_percentage FROM outs"""
ORACLES["outlier_totals"] = f"{DIRTY}, {_DIRTY_OUTLIERS} {_TOTALS}"
ORACLES["outlier_values"] = f"{DIRTY}, {_DIRTY_OUTLIERS} " + each(_DIRTY_NUMBERS, lambda c: f"""
    SELECT row_id, '{c}' AS "column", {number(c)} AS value, ({number(c)} < xlo OR {number(c)} > xhi) AS extreme
    FROM d, fences WHERE fences."column" = '{c}' AND iqr > 0 AND ({number(c)} < lo OR {number(c)} > hi)""")

_CATEGORIES = of_type("Categorical", "Boolean")
_IDENTIFIERS = of_type("Identifier")


def _freq(columns) -> str:
    return each(columns, lambda c: f"""SELECT '{c}' AS "column", CAST({c} AS STRING) AS value, count(*) AS n
        FROM d WHERE NOT {missing(c)} GROUP BY 2""")


_RARE = f"""cats AS ({_freq(_CATEGORIES)}), rated AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total,
    n <= 5 AND n / sum(n) OVER (PARTITION BY "column") <= 0.01 AS rare FROM cats)"""
ORACLES["rare_categories"] = f"""{DIRTY}, {_RARE} SELECT "column", value, n, {pct('n', 'total')} AS percentage FROM rated WHERE rare"""
ORACLES["rare_category_summary"] = f"""{DIRTY}, {_RARE} SELECT "column", count(*) AS unique_categories,
    count(*) FILTER (WHERE rare) AS rare_category_count, CAST(COALESCE(sum(n) FILTER (WHERE rare), 0) AS BIGINT) AS rare_rows
    FROM rated GROUP BY 1"""

_IDS = f"""ids AS ({_freq(_IDENTIFIERS)}), idm AS ({each(_IDENTIFIERS, lambda c: f'''SELECT '{c}' AS "column",
    count(*) FILTER (WHERE NOT {missing(c)}) AS v, count(*) FILTER (WHERE {missing(c)}) AS m FROM d''')}),
    idr AS (SELECT "column", count(*) FILTER (WHERE n > 1) AS vals, CAST(COALESCE(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS dup
            FROM ids GROUP BY 1)"""
ORACLES["identifier_dups"] = f"""{DIRTY}, {_IDS} SELECT idm."column", v AS values_checked, m AS missing_identifiers,
    COALESCE(vals, 0) AS duplicate_identifier_values, COALESCE(dup, 0) AS duplicate_identifier_rows
    FROM idm LEFT JOIN idr ON idm."column" = idr."column" """
ORACLES["duplicate_identifier_values"] = f"{DIRTY}, {_IDS} SELECT * FROM ids WHERE n > 1"
_DATES = f"""SELECT count(*) FILTER (WHERE NOT {missing('order_date')}) AS v,
    count(*) FILTER (WHERE NOT {missing('order_date')} AND {date('order_date')} IS NULL) AS bad,
    min({date('order_date')}) AS lo, max({date('order_date')}) AS hi FROM d"""
ORACLES["datetime_parse"] = f"""{DIRTY} SELECT 'order_date' AS "column", v AS values_checked, bad AS invalid_dates,
    {pct('bad', 'v')} AS invalid_percentage, {iso('lo')} AS minimum_date, {iso('hi')} AS maximum_date FROM ({_DATES})"""


def _missing_sum(columns) -> str:
    return " + ".join(f"CAST({missing(c)} AS INTEGER)" for c in columns)


_SPARSE_COLUMNS = ("status", "price", "order_date", "priority")
ORACLES["row_missingness"] = f"""{SPARSE} SELECT row_id, CAST(m AS BIGINT) AS missing_columns, round(100.0 * m / 4, 2) AS missing_percentage
    FROM (SELECT row_id, {_missing_sum(_SPARSE_COLUMNS)} AS m FROM d) WHERE m >= 2"""

_LOWVAR = f"""allf AS ({_freq(DIRTY_COLUMNS)}), lv AS (
    SELECT "column", CASE WHEN count(*) = 1 THEN 'constant' ELSE 'near_constant' END AS kind, count(*) AS k,
        max(n) AS top, sum(n) AS total FROM allf GROUP BY 1 HAVING count(*) = 1 OR max(n) / sum(n) >= 0.95)"""
ORACLES["low_variance"] = f"""{DIRTY}, {_LOWVAR} SELECT "column", kind AS type, k AS unique_values,
    {pct('top', 'total')} AS dominant_percentage FROM lv"""
_GROUPS = f"SELECT {', '.join(DIRTY_COLUMNS)}, count(*) AS n FROM d GROUP BY {', '.join(DIRTY_COLUMNS)}"
_DUPS = f"""dups AS (SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n - 1) AS BIGINT) AS surplus,
    CAST(COALESCE(sum(n) FILTER (WHERE n > 1), 0) AS BIGINT) AS affected FROM ({_GROUPS}))"""
ORACLES["duplicate_rows"] = f"""{DIRTY}, {_DUPS} SELECT total AS "rows", surplus AS duplicate_rows,
    {pct('surplus', 'total')} AS duplicate_percentage, affected AS affected_rows FROM dups"""


def _row_points() -> str:
    points = [f"CASE WHEN 2 * ({_missing_sum(DIRTY_COLUMNS)}) >= {len(DIRTY_COLUMNS)} THEN 2 ELSE 0 END"]
    for c in _DIRTY_NUMBERS:
        fence = lambda f: f"(SELECT {f} FROM fences WHERE \"column\" = '{c}')"
        for lo, hi in (("lo", "hi"), ("xlo", "xhi")):
            points.append(f"CASE WHEN {fence('iqr')} > 0 AND ({number(c)} < {fence(lo)} OR {number(c)} > {fence(hi)}) THEN 1 ELSE 0 END")
    points += [f"CASE WHEN {missing(c)} THEN 2 ELSE 0 END" for c in _IDENTIFIERS]
    points += [f"CASE WHEN NOT {missing(c)} AND {date(c)} IS NULL THEN 2 ELSE 0 END" for c in of_type("Datetime")]
    points += [f"CASE WHEN NOT {missing(c)} AND count(*) OVER (PARTITION BY {c}) > 1 THEN 1 ELSE 0 END" for c in _IDENTIFIERS]
    points += [f"CASE WHEN (SELECT bool_or(rare) FROM rated WHERE \"column\" = '{c}' AND value = CAST(d.{c} AS STRING)) THEN 1 ELSE 0 END"
               for c in _CATEGORIES]
    points.append(f"CASE WHEN count(*) OVER (PARTITION BY {', '.join(DIRTY_COLUMNS)}) > 1 THEN 1 ELSE 0 END")
    return " + ".join(points)


def _row_issues() -> str:
    found = [(None, "mostly_empty", 2, f"2 * ({_missing_sum(DIRTY_COLUMNS)}) >= {len(DIRTY_COLUMNS)}")]
    for c in _DIRTY_NUMBERS:
        fence = lambda f: f"(SELECT {f} FROM fences WHERE \"column\" = '{c}')"
        for issue, lo, hi in (("outlier", "lo", "hi"), ("extreme_outlier", "xlo", "xhi")):
            found.append((c, issue, 1, f"{fence('iqr')} > 0 AND ({number(c)} < {fence(lo)} OR {number(c)} > {fence(hi)})"))
    found += [(c, "missing_cell", 0, missing(c)) for c in DIRTY_COLUMNS]
    found += [(c, "missing_identifier", 2, missing(c)) for c in _IDENTIFIERS]
    found += [(c, "invalid_date", 2, f"NOT {missing(c)} AND {date(c)} IS NULL") for c in of_type("Datetime")]
    found += [(c, "shared_identifier", 1, f"NOT {missing(c)} AND count(*) OVER (PARTITION BY {c}) > 1") for c in _IDENTIFIERS]
    found += [(c, "rare_category", 1, f"(SELECT bool_or(rare) FROM rated WHERE \"column\" = '{c}' AND value = CAST(d.{c} AS STRING))")
              for c in _CATEGORIES]
    found.append((None, "duplicate_row", 1, f"count(*) OVER (PARTITION BY {', '.join(DIRTY_COLUMNS)}) > 1"))
    hits = ", ".join(f"{hit} AS h{i}" for i, (*_, hit) in enumerate(found))
    rows = " UNION ALL ".join(
        f"SELECT row_id, {q(c) if c else 'NULL::VARCHAR'} AS \"column\", '{issue}' AS issue, {points}::BIGINT AS points FROM hits WHERE h{i}"
        for i, (c, issue, points, _) in enumerate(found))
    return f"hits AS (SELECT row_id, {hits} FROM d) {rows}"


ORACLES["row_issues"] = f"{DIRTY}, {_DIRTY_OUTLIERS}, {_RARE}, {_row_issues()}"
_SUSPICIOUS = f"{_DIRTY_OUTLIERS}, {_RARE}, sus AS (SELECT row_id, {_row_points()} AS score FROM d)"
ORACLES["suspicious_rows"] = f"""{DIRTY}, {_SUSPICIOUS} SELECT row_id, CAST(score AS BIGINT) AS anomaly_score,
    CASE WHEN score >= 5 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS severity FROM sus WHERE score > 0"""

_SUMMARY = f"""{_DIRTY_OUTLIERS}, {_RARE}, {_IDS}, {_LOWVAR}, {_DUPS}, mis AS ({_MISSING_ROWS}), bad AS ({_DATES}),
cs AS (SELECT mis."column" AS col, mis.n_rows, mis.m, {pct('mis.m', 'mis.n_rows')} AS mp, COALESCE(outs.o, 0) AS o, COALESCE(outs.e, 0) AS e,
    COALESCE({pct('outs.o', 'outs.n')}, 0.0) AS op,
    COALESCE((SELECT count(*) FROM rated WHERE rare AND rated."column" = mis."column"), 0) AS rc,
    COALESCE(idm.m, 0) AS im, COALESCE(idr.dup, 0) AS idd,
    CASE WHEN mis."column" = 'order_date' THEN (SELECT bad FROM bad) ELSE 0 END AS bd, lv.kind AS lv
    FROM mis LEFT JOIN outs ON mis."column" = outs."column" LEFT JOIN idm ON mis."column" = idm."column"
    LEFT JOIN idr ON mis."column" = idr."column" LEFT JOIN lv ON mis."column" = lv."column"),
tagged AS (SELECT *, list_filter([CASE WHEN m > 0 THEN 'missing_values' END, CASE WHEN o > 0 THEN 'numeric_outliers' END,
    CASE WHEN e > 0 THEN 'extreme_numeric_outliers' END, CASE WHEN rc > 0 THEN 'rare_categories' END,
    CASE WHEN im > 0 THEN 'missing_identifiers' END, CASE WHEN idd > 0 THEN 'duplicate_identifiers' END,
    CASE WHEN bd > 0 THEN 'invalid_dates' END, lv], lambda t: t IS NOT NULL) AS tags FROM cs)"""
ORACLES["anomaly_column_summary"] = f"""{DIRTY}, {_SUMMARY} SELECT col AS "column", array_to_string(tags, ',') AS issues,
    CAST(len(tags) AS BIGINT) AS issue_count, m AS missing_values, mp AS missing_percentage, o AS outliers, e AS extreme_outliers,
    op AS outlier_percentage, rc AS rare_categories, im AS missing_identifiers, idd AS duplicate_identifier_rows,
    bd AS invalid_dates, lv AS low_variance FROM tagged"""
_ISSUES = """iss AS (
    SELECT 'duplicate_rows' AS type, NULL AS "column", 'medium' AS severity, format('{} fully duplicated row(s)', surplus) AS message FROM dups WHERE surplus > 0
    UNION ALL SELECT 'high_missingness', col, 'high', format('{}: {:.2f}% missing', col, mp) FROM cs WHERE mp >= 50
    UNION ALL SELECT 'moderate_missingness', col, 'medium', format('{}: {:.2f}% missing', col, mp) FROM cs WHERE mp >= 20 AND mp < 50
    UNION ALL SELECT 'extreme_numeric_outliers', col, 'high', format('{}: {} extreme outlier(s)', col, e) FROM cs WHERE e > 0
    UNION ALL SELECT 'numeric_outliers', col, 'medium', format('{}: {} outlier(s)', col, o) FROM cs WHERE e = 0 AND o > 0
    UNION ALL SELECT 'rare_categories', col, 'low', format('{}: {} rare value(s)', col, rc) FROM cs WHERE rc > 0
    UNION ALL SELECT 'missing_identifiers', col, 'high', format('{}: {} identifier(s) missing', col, im) FROM cs WHERE im > 0
    UNION ALL SELECT 'duplicate_identifiers', col, 'medium', format('{}: {} row(s) share an identifier', col, idd) FROM cs WHERE idd > 0
    UNION ALL SELECT 'invalid_dates', col, 'medium', format('{}: {} value(s) do not parse as a date', col, bd) FROM cs WHERE bd > 0
    UNION ALL SELECT 'constant_column', col, 'medium', format('{}: holds a single value', col) FROM cs WHERE lv = 'constant'
    UNION ALL SELECT 'near_constant_column', col, 'low', format('{}: almost always the same value', col) FROM cs WHERE lv = 'near_constant')"""
ORACLES["anomaly_issues"] = f"{DIRTY}, {_SUMMARY}, {_ISSUES} SELECT * FROM iss"
_SUS_COUNTS = f"sus AS (SELECT row_id, {_row_points()} AS score FROM d)"
ORACLES["anomaly_summary"] = f"""{DIRTY}, {_SUMMARY}, {_ISSUES}, {_SUS_COUNTS} SELECT total AS "rows", {len(DIRTY_COLUMNS)}::BIGINT AS columns,
    (SELECT CAST(sum(o) AS BIGINT) FROM outs) AS numeric_outliers, (SELECT CAST(sum(e) AS BIGINT) FROM outs) AS extreme_numeric_outliers,
    surplus AS duplicate_rows, (SELECT count(*) FROM sus WHERE score > 0) AS suspicious_rows,
    (SELECT count(*) FROM sus WHERE score >= 5) AS high_risk_rows, (SELECT count(*) FROM iss) AS total_issues,
    (SELECT count(*) FROM iss WHERE severity = 'high') AS high_severity_issues,
    (SELECT count(*) FROM iss WHERE severity = 'medium') AS medium_severity_issues,
    (SELECT count(*) FROM iss WHERE severity = 'low') AS low_severity_issues FROM dups"""

# -- quality ------------------------------------------------------------------------------

def score(value: str) -> str:
    return f"round(greatest(0.0, least(100.0, {value})), 2)"


_COMPLETE = f"comp AS (SELECT \"column\" AS col, n_rows, m FROM ({_MISSING_ROWS}))"
ORACLES["completeness"] = f"""{DIRTY}, {_COMPLETE} SELECT col AS "column", n_rows AS "rows", m AS missing_values,
    {pct('m', 'n_rows')} AS missing_percentage, {score('100 - 100.0 * m / n_rows')} AS score FROM comp"""
ORACLES["completeness_total"] = f"""{DIRTY}, {_COMPLETE} SELECT CAST(sum(m) AS BIGINT) AS missing_cells, CAST(sum(n_rows) AS BIGINT) AS total_cells,
    {pct('sum(m)', 'sum(n_rows)')} AS missing_percentage, {score('100 - 100.0 * sum(m) / sum(n_rows)')} AS score FROM comp"""
_RATE = "COALESCE(100.0 * COALESCE(idr.dup, 0) / NULLIF(idm.v, 0), 0.0)"
_PENALTY = f"pen AS (SELECT avg({_RATE}) AS p FROM idm LEFT JOIN idr ON idm.\"column\" = idr.\"column\")"


def _uniq_score(share: str) -> str:
    return score(f"0.6 * (100 - {share}) + 0.4 * (100 - p)")


ORACLES["uniqueness"] = f"""{DIRTY}, {_IDS}, {_DUPS}, {_PENALTY} SELECT surplus AS duplicate_rows, {pct('surplus', 'total')} AS duplicate_percentage,
    round(p, 2) AS identifier_penalty_percentage, {_uniq_score('100.0 * surplus / total')} AS score FROM dups, pen"""
ORACLES["identifier_uniqueness"] = f"""{DIRTY}, {_IDS} SELECT idm."column", v AS values_checked, COALESCE(dup, 0) AS duplicate_identifier_rows,
    round({_RATE}, 2) AS duplicate_percentage, {score(f'100 - {_RATE}')} AS score FROM idm LEFT JOIN idr ON idm."column" = idr."column" """


def _invalid(c: str) -> str:
    kind = DIRTY_TYPES[c]
    if kind == "Numerical":
        return f"{number(c)} IS NULL"
    if kind == "Datetime":
        return f"{date(c)} IS NULL"
    if kind == "Boolean":
        return f"lower({trim(c)}) NOT IN ('true','false','yes','no','y','n','1','0','t','f')"
    return f"{trim(c)} = ''"


_VALID = "val AS (" + each(DIRTY_COLUMNS, lambda c: f"""SELECT '{c}' AS col, '{DIRTY_TYPES[c]}' AS kind,
    count(*) FILTER (WHERE NOT {missing(c)}) AS v, count(*) FILTER (WHERE NOT {missing(c)} AND {_invalid(c)}) AS bad FROM d""") + ")"
_VALID_SCORE = f"CASE WHEN v = 0 THEN 100.0 ELSE {score('100.0 * (v - bad) / v')} END"
ORACLES["validity"] = f"""{DIRTY}, {_VALID} SELECT col AS "column", kind AS semantic_type, v AS checked_values, bad AS invalid_values,
    {_VALID_SCORE} AS validity_score FROM val"""


def _mixed(c: str) -> str:
    return f"""(SELECT COALESCE(sum(n), 0) FROM (SELECT count(*) AS n FROM d WHERE NOT {missing(c)}
        GROUP BY lower({trim(c)}) HAVING count(DISTINCT CAST({c} AS STRING)) > 1))"""


_CONSIST = "con AS (SELECT * FROM (" + each(DIRTY_COLUMNS, lambda c: f"""SELECT '{c}' AS col, count(*) FILTER (WHERE NOT {missing(c)}) AS v,
    CAST({_mixed(c) if c in _CATEGORIES else 0} AS BIGINT) AS bad FROM d""") + ") WHERE v > 0)"
_CONSIST_SELECT = f"""SELECT col AS "column", v AS checked_values, bad AS inconsistent_values,
    {score('100.0 * (v - bad) / v')} AS consistency_score FROM con"""
ORACLES["consistency"] = f"{DIRTY}, {_CONSIST} {_CONSIST_SELECT}"
ORACLES["consistency_text"] = f"""{WRITTEN}, con AS (
    SELECT 'placed' AS col, count(placed) AS v, 0::BIGINT AS bad FROM d UNION ALL
    SELECT 'amount', count(amount), CAST({_mixed('amount')} AS BIGINT) FROM d UNION ALL
    SELECT 'note', count(*) FILTER (WHERE NOT {missing('note')}),
           count(*) FILTER (WHERE NOT {missing('note')} AND note <> {trim('note')}) FROM d) {_CONSIST_SELECT}"""
_ANOMALY = f"""{_SUMMARY}, {_SUS_COUNTS}, tot AS ({_TOTALS}), sc AS (SELECT count(*) FILTER (WHERE score > 0) AS s,
    count(*) FILTER (WHERE score >= 5) AS h FROM sus),
pens AS (SELECT tot.*, s, h, 100.0 * s / total AS sp, 100.0 * h / total AS hp, least(30.0, outlier_percentage * 0.6) AS p1,
    least(25.0, COALESCE(100.0 * extreme_outliers / NULLIF(values_checked, 0), 0) * 1.5) AS p2,
    least(20.0, 100.0 * s / total * 0.3) AS p3, least(25.0, 100.0 * h / total) AS p4 FROM tot, sc, dups)"""
_ANOMALY_SCORE = score("100 - (p1 + p2 + p3 + p4)")
ORACLES["anomaly_quality"] = f"""{DIRTY}, {_ANOMALY} SELECT values_checked, outliers, extreme_outliers, outlier_percentage,
    s AS suspicious_rows, h AS high_risk_rows, round(sp, 2) AS suspicious_row_percentage, round(hp, 2) AS high_risk_row_percentage,
    round(p1, 2) AS outlier_penalty, round(p2, 2) AS extreme_penalty, round(p3, 2) AS suspicious_penalty,
    round(p4, 2) AS high_risk_penalty, round(p1 + p2 + p3 + p4, 2) AS total_penalty, {_ANOMALY_SCORE} AS score FROM pens"""
_COLUMN_ANOMALY = score("100 - least(60.0, op * 0.75 + e * 2.0 + len(tags) * 2.0)")
ORACLES["column_anomaly_quality"] = f"""{DIRTY}, {_SUMMARY} SELECT col AS "column", o AS outliers, e AS extreme_outliers,
    op AS outlier_percentage, CAST(len(tags) AS BIGINT) AS issue_count, {_COLUMN_ANOMALY} AS anomaly_quality_score FROM tagged"""
_COLUMN_QUALITY = f"""{_VALID}, {_CONSIST}, uni AS ({each(DIRTY_COLUMNS, lambda c: f"SELECT '{c}' AS col, count(DISTINCT {c}) AS u FROM d")}),
cq AS (SELECT t.col, val.kind, t.n_rows, t.m, t.mp, {score('100 - 100.0 * t.m / t.n_rows')} AS cscore, u,
    round(COALESCE(u / NULLIF(t.n_rows - t.m, 0), 0.0), 2) AS ur, CASE WHEN val.v = 0 THEN 100.0 ELSE {score('100.0 * (val.v - val.bad) / val.v')} END AS vs,
    COALESCE({score('100.0 * (con.v - con.bad) / con.v')}, 100.0) AS ks, o, e, op, {_COLUMN_ANOMALY} AS aq
    FROM tagged t JOIN val ON t.col = val.col LEFT JOIN con ON t.col = con.col JOIN uni ON t.col = uni.col)"""
ORACLES["quality_columns"] = f"""{DIRTY}, {_SUMMARY}, {_COLUMN_QUALITY} SELECT col AS "column", kind AS semantic_type, n_rows AS "rows",
    m AS missing_values, mp AS missing_percentage, cscore AS completeness_score, u AS unique_values, ur AS unique_ratio,
    vs AS validity_score, ks AS consistency_score, o AS outliers, e AS extreme_outliers, op AS outlier_percentage,
    aq AS anomaly_quality_score FROM cq"""
_TOTAL_SCORE = lambda t: f"(SELECT {score('100.0 * (sum(v) - sum(bad)) / sum(v)')} FROM {t})"


def _components(anomaly: str, share: str) -> str:
    return f"""parts AS (
    SELECT 'completeness' AS component, (SELECT {score('100 - 100.0 * sum(m) / sum(n_rows)')} FROM comp) AS score, 0.30 AS weight
    UNION ALL SELECT 'uniqueness', (SELECT {_uniq_score(share)} FROM dups, pen), 0.15
    UNION ALL SELECT 'validity', {_TOTAL_SCORE('val')}, 0.20
    UNION ALL SELECT 'consistency', {_TOTAL_SCORE('con')}, 0.15
    UNION ALL SELECT 'anomaly_quality', {anomaly}, 0.20)"""


_OVERALL = """SELECT overall_score, CASE WHEN overall_score >= 95 THEN 'Excellent' WHEN overall_score >= 85 THEN 'Very Good'
    WHEN overall_score >= 75 THEN 'Good' WHEN overall_score >= 60 THEN 'Fair' WHEN overall_score >= 40 THEN 'Poor'
    ELSE 'Critical' END AS rating FROM (SELECT round(sum(score * CAST(weight AS DOUBLE)) / sum(CAST(weight AS DOUBLE)), 2) AS overall_score FROM parts)"""
_WITH = _components(f"(SELECT {_ANOMALY_SCORE} FROM pens)", pct("surplus", "total"))
_WITHOUT = _components("100.0", "100.0 * surplus / total")
_ALL = f"{_ANOMALY}, {_COMPLETE}, {_VALID}, {_CONSIST}, {_PENALTY}"
ORACLES["quality_components"] = f"{DIRTY}, {_ALL}, {_WITH} SELECT component, CAST(score AS DOUBLE) AS score, CAST(weight AS DOUBLE) AS weight FROM parts"
ORACLES["quality_score"] = f"{DIRTY}, {_ALL}, {_WITH} {_OVERALL}"
ORACLES["quality_explanations"] = f"""{DIRTY}, {_ALL}
    SELECT 'completeness' AS component, CASE WHEN sum(m) = 0 THEN 'no missing cells' ELSE printf('%.2f%% of all cells are missing', {pct('sum(m)', 'sum(n_rows)')}) END AS explanation FROM comp
    UNION ALL SELECT 'uniqueness', CASE WHEN surplus = 0 AND round(p, 2) = 0 THEN 'no duplicate rows or identifiers'
        ELSE printf('%d duplicate row(s); on average %.2f%% of identifiers are shared', surplus, round(p, 2)) END FROM dups, pen
    UNION ALL SELECT 'validity', CASE WHEN sum(bad) = 0 THEN 'every value fits its type' ELSE printf('%d value(s) do not fit their type', sum(bad)::BIGINT) END FROM val
    UNION ALL SELECT 'consistency', CASE WHEN sum(bad) = 0 THEN 'no mixed spellings' ELSE printf('%d value(s) are written in more than one way', sum(bad)::BIGINT) END FROM con
    UNION ALL SELECT 'anomaly_quality', CASE WHEN outliers + extreme_outliers + s = 0 THEN 'no anomalies'
        ELSE printf('%d outlier(s), %d of them extreme, and %d suspicious row(s)', outliers, extreme_outliers, s) END FROM pens"""
ORACLES["quality_score_without_anomalies"] = f"{DIRTY}, {_IDS}, {_DUPS}, {_COMPLETE}, {_VALID}, {_CONSIST}, {_PENALTY}, {_WITHOUT} {_OVERALL}"
_GRADE = lambda cond: f"CASE WHEN {cond} THEN 'high' ELSE 'medium' END"
_QUALITY_ISSUES = f"""qi AS (
    SELECT 'duplicate_rows' AS type, NULL AS "column", {_GRADE(pct('surplus', 'total') + ' >= 10')} AS severity,
        format('{{}} duplicated row(s), {{:.2f}}%', surplus, {pct('surplus', 'total')}) AS message FROM dups WHERE surplus > 0
    UNION ALL SELECT 'duplicate_identifiers', idm."column", {_GRADE(f'round({_RATE}, 2) >= 10')},
        format('{{}}: {{}} row(s) share an identifier, {{:.2f}}%', idm."column", dup, round({_RATE}, 2))
        FROM idm JOIN idr ON idm."column" = idr."column" WHERE dup > 0
    UNION ALL SELECT 'high_missingness', col, 'high', format('{{}}: {{:.2f}}% missing', col, mp) FROM cq WHERE mp >= 50
    UNION ALL SELECT 'moderate_missingness', col, 'medium', format('{{}}: {{:.2f}}% missing', col, mp) FROM cq WHERE mp >= 20 AND mp < 50
    UNION ALL SELECT 'invalid_values', col, {_GRADE('vs < 70')}, format('{{}}: validity {{:.2f}} of 100', col, vs) FROM cq WHERE vs < 90
    UNION ALL SELECT 'inconsistent_values', col, {_GRADE('ks < 70')}, format('{{}}: consistency {{:.2f}} of 100', col, ks) FROM cq WHERE ks < 90
    UNION ALL SELECT 'extreme_outliers', col, 'high', format('{{}}: {{}} extreme outlier(s)', col, e) FROM cq WHERE e > 0
    UNION ALL SELECT 'high_outlier_rate', col, {_GRADE('op >= 25')}, format('{{}}: {{:.2f}}% outliers', col, op) FROM cq WHERE e = 0 AND op >= 10)"""
ORACLES["quality_issues"] = f"{DIRTY}, {_SUMMARY}, {_COLUMN_QUALITY}, {_QUALITY_ISSUES} SELECT * FROM qi"
ORACLES["priority_findings"] = f"""{DIRTY}, {_SUMMARY}, {_COLUMN_QUALITY}, {_QUALITY_ISSUES} SELECT * FROM qi
    ORDER BY list_position(['high','medium','low'], severity), COALESCE("column", ''), type LIMIT 10"""

# -- cleaning -------------------------------------------------------------------------------

_CLEAN = ", ".join(
    f"CASE WHEN lower({trim(c)}) NOT IN {CLEANING_WORDS} THEN {trim(c)} END AS {c}" if c in TEXT_COLUMNS else c
    for c in DIRTY_COLUMNS)
_NORMAL = f"norm AS (SELECT row_id, {_CLEAN} FROM d)"
_UNIQUE = f"uq AS (SELECT min(row_id) AS row_id, {', '.join(DIRTY_COLUMNS)} FROM norm GROUP BY {', '.join(DIRTY_COLUMNS)})"


def _typed(c: str) -> str:
    kind = DIRTY_TYPES[c]
    if c in TEXT_COLUMNS and kind == "Numerical":
        return f"{number(c)} AS {c}"
    if kind == "Datetime":
        return f"{date(c)} AS {c}"
    if kind == "Boolean":
        return f"""CASE WHEN lower({trim(c)}) IN ('true','yes','y','1','t') THEN TRUE
            WHEN lower({trim(c)}) IN ('false','no','n','0','f') THEN FALSE END AS {c}"""
    return c


_TYPED = f"ty AS (SELECT row_id, {', '.join(_typed(c) for c in DIRTY_COLUMNS)} FROM uq)"
_POSITIVE = """pos AS (SELECT * REPLACE (CASE WHEN price >= 0 THEN price END AS price, CASE WHEN quantity >= 0 THEN quantity END AS quantity) FROM ty)"""
_CLEANING = f"{DIRTY}, {_NORMAL}, {_UNIQUE}, {_TYPED}, {_POSITIVE}"
ORACLES["clean_null_tokens"] = f"{DIRTY} " + each(TEXT_COLUMNS, lambda c: f"""SELECT '{c}' AS "column",
    count(*) FILTER (WHERE lower({trim(c)}) IN {CLEANING_WORDS}) AS count FROM d""")
ORACLES["clean_duplicates"] = f"{_CLEANING} SELECT * FROM uq"
ORACLES["clean_types"] = f"{_CLEANING} SELECT * FROM ty"
ORACLES["clean_booleans"] = f"""{DIRTY} SELECT CASE WHEN lower({trim('is_urgent')}) IN ('true','yes','y','1','t') THEN TRUE
    WHEN lower({trim('is_urgent')}) IN ('false','no','n','0','f') THEN FALSE END AS is_urgent, count(*) AS n FROM d GROUP BY 1"""
ORACLES["clean_negatives"] = f"{_CLEANING} SELECT row_id, price, quantity FROM pos"


def _number_fill(c: str) -> str:
    x = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS col, 'Numerical' AS kind, count(*) - count({c}) AS m, count(*) AS n_rows,
        CASE WHEN count({c}) = 0 OR (count(*) - count({c})) / count(*) > 0.6 THEN 'keep' WHEN count({c}) = 1 THEN 'single_value'
             WHEN min({c}) = max({c}) THEN 'constant' WHEN abs(skewness({x})) > 0.75 OR count({c}) < 10 THEN 'median' ELSE 'mean' END AS strategy,
        CAST(round(CASE WHEN abs(skewness({x})) > 0.75 THEN median({x}) ELSE avg({x}) END, 3) AS STRING) AS fill FROM pos"""


def _category_fill(c: str) -> str:
    return f"""SELECT '{c}', 'Categorical', m, n_rows, s, CASE WHEN s = 'mode' THEN mode_value ELSE 'Unknown' END FROM (
        SELECT *, CASE WHEN v = 0 OR (u > 50 AND u / v > 0.5) OR m / n_rows > 0.3 OR top / v < 0.4 THEN 'Unknown' ELSE 'mode' END AS s
        FROM (SELECT count(*) - count({c}) AS m, count(*) AS n_rows, count({c}) AS v, count(DISTINCT {c}) AS u,
            (SELECT max(n) FROM (SELECT count(*) AS n FROM pos WHERE {c} IS NOT NULL GROUP BY {c})) AS top,
            (SELECT {c} FROM pos WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS mode_value FROM pos))"""


def _boolean_fill(c: str) -> str:
    return f"""SELECT '{c}', 'Boolean', m, n_rows, CASE WHEN m / n_rows <= 0.1 AND greatest(y, v - y) / v >= 0.7 THEN 'mode' ELSE 'keep' END,
        CASE WHEN m / n_rows <= 0.1 AND greatest(y, v - y) / v >= 0.7 THEN CAST(y > v - y AS STRING) END
        FROM (SELECT count(*) - count({c}) AS m, count(*) AS n_rows, count({c}) AS v, count(*) FILTER (WHERE {c}) AS y FROM pos)"""


def _no_fill(c: str) -> str:
    return f"SELECT '{c}', '{DIRTY_TYPES[c]}', count(*) - count({c}), count(*), 'keep', NULL FROM pos"


_FILLS = "fills AS (SELECT * FROM (" + " UNION ALL ".join(
    [_number_fill(c) for c in of_type("Numerical")] + [_category_fill(c) for c in of_type("Categorical")]
    + [_boolean_fill(c) for c in of_type("Boolean")] + [_no_fill(c) for c in of_type("Identifier", "Datetime")]) + ") WHERE m > 0)"
ORACLES["clean_fills"] = f"""{_CLEANING}, {_FILLS} SELECT col AS "column", kind AS detected_type, m AS missing, strategy, fill AS fill_value FROM fills"""


def _filled(c: str) -> str:
    kind, fill = DIRTY_TYPES[c], f"(SELECT fill FROM fills WHERE col = '{c}' AND strategy <> 'keep')"
    if kind == "Numerical":
        return f"round(COALESCE(CAST({c} AS DOUBLE), CAST({fill} AS DOUBLE)), 3) AS {c}"
    if kind == "Boolean":
        return f"COALESCE({c}, CAST({fill} AS BOOLEAN)) AS {c}"
    return f"COALESCE({c}, {fill}) AS {c}" if kind == "Categorical" else c


ORACLES["clean_result"] = f"{_CLEANING}, {_FILLS} SELECT row_id, {', '.join(_filled(c) for c in DIRTY_COLUMNS)} FROM pos"
_LOST = {c: f"(SELECT count({c}) FROM uq) - (SELECT count({c}) FROM ty)" for c in DIRTY_COLUMNS}
_NEGATIVE = {c: f"(SELECT count({c}) FROM ty) - (SELECT count({c}) FROM pos)" for c in of_type("Numerical")}
_LOG_PARTS = (
    [f"SELECT '{c}' AS \"column\", 'null_normalization' AS operation, count(*) AS count, NULL AS strategy FROM d WHERE lower({trim(c)}) IN {CLEANING_WORDS}" for c in TEXT_COLUMNS]
    + ["SELECT NULL, 'duplicate_removal', (SELECT count(*) FROM d) - (SELECT count(*) FROM uq), NULL"]
    + ["SELECT 'order_date', 'datetime_conversion', count(*), NULL FROM uq", "SELECT 'is_urgent', 'boolean_standardization', count(*), NULL FROM uq"]
    + [f"SELECT '{c}', 'numeric_conversion', {_LOST[c]}, NULL" for c in of_type("Numerical")]
    + [f"SELECT '{c}', 'invalid_datetime', {_LOST[c]}, NULL" for c in of_type("Datetime")]
    + [f"SELECT '{c}', 'invalid_boolean', {_LOST[c]}, NULL" for c in of_type("Boolean")]
    + [f"SELECT '{c}', 'invalid_negative', {_NEGATIVE[c]}, NULL" for c in of_type("Numerical")]
    + ["""SELECT col, CASE WHEN strategy = 'keep' THEN 'missing_preserved' WHEN kind = 'Numerical' THEN 'numeric_imputation'
        WHEN kind = 'Boolean' THEN 'boolean_imputation' ELSE 'categorical_imputation' END, m, NULLIF(strategy, 'keep') FROM fills"""])
ORACLES["clean_log"] = f"{_CLEANING}, {_FILLS} SELECT * FROM ({' UNION ALL '.join(_LOG_PARTS)}) WHERE count > 0"
_NULLS = lambda t: "(SELECT CAST(" + " + ".join(f"(count(*) - count({c}))" for c in DIRTY_COLUMNS) + f" AS BIGINT) FROM {t})"
_DISTINCT = lambda t, cols=", ".join(DIRTY_COLUMNS): f"(SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {t}))"
ORACLES["clean_summary"] = f"""{_CLEANING}, {_FILLS}, res AS (SELECT {', '.join(_filled(c) for c in DIRTY_COLUMNS)} FROM pos)
SELECT (SELECT count(*) FROM d) AS original_rows, (SELECT count(*) FROM uq) AS final_rows,
    (SELECT count(*) FROM d) - (SELECT count(*) FROM uq) AS rows_removed, {len(DIRTY_COLUMNS)}::BIGINT AS original_columns,
    {len(DIRTY_COLUMNS)}::BIGINT AS final_columns, {_NULLS('d')} AS original_missing_values,
    {_NULLS('norm')} - {_NULLS('d')} AS normalized_null_like_values, {_NULLS('pos')} AS missing_before_imputation,
    (SELECT CAST(sum(m) AS BIGINT) FROM fills WHERE strategy <> 'keep') AS missing_values_filled,
    {_NULLS('res')} AS remaining_missing_values, (SELECT count(*) FROM d) - {_DISTINCT('d')} AS original_duplicate_rows,
    (SELECT count(*) FROM d) - (SELECT count(*) FROM uq) AS duplicate_rows_removed,
    (SELECT count(*) FROM res) - {_DISTINCT('res')} AS remaining_duplicate_rows,
    {_NULLS('pos')} - {_NULLS('ty')} AS invalid_values_converted_to_missing"""

# -- exploration ------------------------------------------------------------------------------

ORACLES["overview"] = f"""{DIRTY}, {_DUPS} SELECT total AS "rows", {len(DIRTY_COLUMNS)}::BIGINT AS columns,
    total * {len(DIRTY_COLUMNS)} AS total_cells, {_NULLS('d')} AS total_missing,
    round(100.0 * {_NULLS('d')} / (total * {len(DIRTY_COLUMNS)}), 6) AS missing_percentage, surplus AS duplicate_rows,
    round(100.0 * surplus / total, 6) AS duplicate_percentage FROM dups"""
ORACLES["semantic_type_counts"] = f"SELECT lower(detected_type) AS detected_type, count(*) AS columns FROM ({ORACLES['schema_profile_dirty']}) GROUP BY 1"
_SPARSE_NULLS = each(_SPARSE_COLUMNS, lambda c: f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS missing_count FROM d")
ORACLES["missing_values_by_column"] = f"{SPARSE} SELECT *, {pct('missing_count', '\"rows\"', 6)} AS missing_percentage FROM ({_SPARSE_NULLS})"
ORACLES["high_missing_columns"] = f"""{SPARSE} SELECT "column", {pct('missing_count', '"rows"', 6)} AS missing_percentage
    FROM ({_SPARSE_NULLS}) WHERE 100.0 * missing_count / "rows" >= 30"""
_SPARSE_PAIRS = [(a, b) for i, a in enumerate(_SPARSE_COLUMNS) for b in _SPARSE_COLUMNS[i + 1:]]
ORACLES["co_missing"] = f"""{SPARSE} SELECT column_1, column_2, both_missing, round(both_missing / any_missing, 6) AS jaccard_similarity FROM (""" + " UNION ALL ".join(
    f"""SELECT '{a}' AS column_1, '{b}' AS column_2, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS both_missing,
        count(*) FILTER (WHERE {a} IS NULL OR {b} IS NULL) AS any_missing FROM d""" for a, b in _SPARSE_PAIRS
) + ") WHERE both_missing > 0 AND both_missing / any_missing >= 0.5"


def _numeric_profile(c: str, x: str, source: str, digits: int) -> str:
    r = lambda e: f"round({e}, {digits})"
    sk = "CASE WHEN sk IS NULL OR isnan(sk) THEN 0 ELSE sk END"
    return f"""SELECT '{c}' AS "column", n AS count, t - n AS missing_count, {r('100.0 * (t - n) / t')} AS missing_percentage, u AS unique_values,
        {r('mean')} AS mean, {r('med')} AS median, {r('lo')} AS min, {r('hi')} AS max, {r('hi - lo')} AS range, {r('sd')} AS std,
        {f'round(var, {-2 if source == chr(100) else digits})'} AS variance, {r('q1')} AS q1, {r('q3')} AS q3, {r('q3 - q1')} AS iqr, {r('sk')} AS skewness, {r('ku')} AS kurtosis,
        CASE WHEN {sk} > 1 THEN 'highly right-skewed' WHEN {sk} > 0.5 THEN 'moderately right-skewed' WHEN {sk} < -1 THEN 'highly left-skewed'
             WHEN {sk} < -0.5 THEN 'moderately left-skewed' ELSE 'approximately symmetric' END AS distribution_shape,
        {r('abs(sd / mean)')} AS coefficient_of_variation, z AS zero_count, {r('100.0 * z / n')} AS zero_percentage,
        neg AS negative_count, {r('100.0 * neg / n')} AS negative_percentage, p AS positive_count, {r('100.0 * p / n')} AS positive_percentage,
        {r('q1 - 1.5 * (q3 - q1)')} AS lower_bound, {r('q3 + 1.5 * (q3 - q1)')} AS upper_bound,
        (SELECT count(*) FROM {source} WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS outlier_count,
        {r(f'100.0 * (SELECT count(*) FROM {source} WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) / n')} AS outlier_percentage
    FROM (SELECT count(*) AS t, count({x}) AS n, count(DISTINCT {x}) AS u, avg({x}) AS mean, median({x}) AS med, min({x}) AS lo, max({x}) AS hi,
        stddev_samp({x}) AS sd, var_samp({x}) AS var, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3,
        skewness({x}) AS sk, kurtosis({x}) AS ku, count(*) FILTER (WHERE {x} = 0) AS z, count(*) FILTER (WHERE {x} < 0) AS neg,
        count(*) FILTER (WHERE {x} > 0) AS p FROM {source})"""


ORACLES["numeric_profile"] = each(LINEITEM_NUMBERS, lambda c: _numeric_profile(c, f"CAST({c} AS DOUBLE)", "lineitem", 4))
ORACLES["numeric_profile_dirty"] = f"{DIRTY} " + each(_DIRTY_NUMBERS, lambda c: _numeric_profile(c, number(c), "d", 3))
ORACLES["categorical_profile"] = f"""{DIRTY}, f AS ({each(_CATEGORIES, lambda c: f'''SELECT '{c}' AS col, {c} AS value, count(*) AS n FROM d
    WHERE {c} IS NOT NULL GROUP BY {c}''')}), t AS (SELECT count(*) AS t FROM d),
e AS ({each(_CATEGORIES, lambda c: f"SELECT '{c}' AS col, entropy({c}) AS h FROM d")}),
g AS (SELECT col, CAST(sum(n) AS BIGINT) AS v, count(*) AS u, max(n) AS top,
      first(value ORDER BY n DESC, value) AS mode FROM f GROUP BY col)
SELECT g.col AS "column", v AS count, t - v AS missing_count, round(100.0 * (t - v) / t, 6) AS missing_percentage, u AS unique_values,
    round(u / v, 6) AS cardinality_ratio, (u >= 100 OR u / v >= 0.5) AS high_cardinality, mode AS most_common, top AS most_common_count,
    round(100.0 * top / v, 6) AS dominance_percentage, round(h, 6) AS entropy,
    round(CASE WHEN u <= 1 THEN 0.0 ELSE h / log2(u) END, 6) AS normalized_entropy FROM g JOIN e ON g.col = e.col, t"""
ORACLES["exact_quantiles"] = """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median,
    round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1"""
ORACLES["exact_quantiles_by_part"] = ORACLES["exact_quantiles"].replace("l_returnflag", "l_partkey")

FACTS = """WITH d AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate,
    l_extendedprice * (1 - l_discount) AS net_price,
    CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 15 THEN 'standard' ELSE 'small' END AS size_class,
    CASE WHEN l_quantity >= 40 THEN 'pallet' ELSE 'parcel' END AS packing,
    date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) * 10.0 + l_quantity AS ship_index FROM lineitem)"""
FACT_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "ship_index")
FACT_CATEGORIES = ("l_returnflag", "l_linestatus", "size_class", "packing")
_PAIRS = [(a, b) for i, a in enumerate(FACT_NUMBERS) for b in FACT_NUMBERS[i + 1:]]
_CORR = "r AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, corr({a}, {b}) AS c, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM d"
    for a, b in _PAIRS) + ")"
_STRENGTH = lambda c: f"""CASE WHEN abs({c}) >= 0.8 THEN 'very strong' WHEN abs({c}) >= 0.6 THEN 'strong' WHEN abs({c}) >= 0.4 THEN 'moderate'
    WHEN abs({c}) >= 0.2 THEN 'weak' ELSE 'very weak' END"""  # noqa: E731
_RANKED = f"""SELECT column_1, column_2, round(c, 6) AS correlation, round(abs(c), 6) AS absolute_correlation, {_STRENGTH('round(c, 6)')} AS strength,
    CASE WHEN round(c, 6) > 0 THEN 'positive' WHEN round(c, 6) < 0 THEN 'negative' ELSE 'none' END AS direction, n AS observations FROM r"""
ORACLES["correlations"] = f"{FACTS}, {_CORR} {_RANKED}"
ORACLES["strongest_correlations"] = f"{FACTS}, {_CORR} {_RANKED} WHERE abs(c) >= 0.4"
_MATRIX = f"""{_CORR}, m AS (SELECT column_1 AS x, column_2 AS y, round(c, 4) AS correlation FROM r UNION ALL
    SELECT column_2, column_1, round(c, 4) FROM r UNION ALL SELECT unnest([{', '.join(map(q, FACT_NUMBERS))}]) AS x, x, 1.0)"""
ORACLES["heatmap_matrix"] = f"{FACTS}, {_MATRIX} SELECT * FROM m"
ORACLES["heatmap_pivot"] = f"{FACTS}, {_MATRIX} SELECT y, " + ", ".join(
    f"max(correlation) FILTER (WHERE x = '{c}') AS {c}" for c in FACT_NUMBERS) + " FROM m GROUP BY y"
ORACLES["strongest_pair"] = f"{FACTS}, {_CORR} SELECT column_1 AS x, column_2 AS y, round(c, 4) AS correlation FROM r ORDER BY abs(c) DESC LIMIT 1"
_GROUPED = "g AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS cat, CAST({c} AS STRING) AS category, '{x}' AS num, count({x}) AS n, avg({x}) AS mean, median({x}) AS med,
        stddev_samp({x}) AS sd, min({x}) AS lo, max({x}) AS hi FROM d GROUP BY {c} HAVING count({x}) >= 2"""
    for c in FACT_CATEGORIES for x in FACT_NUMBERS) + ")"
ORACLES["category_numeric_groups"] = f"""{FACTS}, {_GROUPED} SELECT cat AS categorical_column, category, num AS numerical_column, n AS count,
    round(mean, 3) AS mean, round(med, 3) AS median, round(sd, 3) AS std, round(lo, 3) AS min, round(hi, 3) AS max FROM g"""
_EFFECTS = f"""{_GROUPED}, mu AS (SELECT cat, num, sum(n * mean) / sum(n) AS mu FROM g GROUP BY ALL),
eff AS (SELECT g.cat, g.num, sum(n * (mean - mu) ** 2) / (sum(n * (mean - mu) ** 2) + sum((n - 1) * sd ** 2)) AS e,
    arg_max(category, mean) AS hi, arg_min(category, mean) AS lo, max(mean) - min(mean) AS diff
    FROM g JOIN mu ON g.cat = mu.cat AND g.num = mu.num GROUP BY ALL)"""
ORACLES["category_numeric_effect"] = f"""{FACTS}, {_EFFECTS} SELECT cat AS categorical_column, num AS numerical_column, round(e, 6) AS effect_size,
    hi AS highest_mean_group, lo AS lowest_mean_group, round(diff, 6) AS mean_difference FROM eff"""
_CAT_PAIRS = [(a, b) for i, a in enumerate(FACT_CATEGORIES) for b in FACT_CATEGORIES[i + 1:]]
_CELLS = "x AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS column_1, '{b}' AS column_2, {a} AS value_1, {b} AS value_2, count(*) AS n FROM d GROUP BY {a}, {b}"
    for a, b in _CAT_PAIRS) + ")"
ORACLES["crosstabs"] = f"{FACTS}, {_CELLS} SELECT * FROM x"
# Chi square by the textbook sum over all cells, empty ones included.
_CRAMER = f"""{_CELLS}, a AS (SELECT column_1, column_2, value_1, sum(n) AS r FROM x GROUP BY ALL),
b AS (SELECT column_1, column_2, value_2, sum(n) AS c FROM x GROUP BY ALL), t AS (SELECT column_1, column_2, sum(n) AS t FROM x GROUP BY ALL),
v AS (SELECT a.column_1, a.column_2, sqrt(sum((COALESCE(x.n, 0) - r * c / t) ** 2 / (r * c / t)) / max(t)
        / (least(count(DISTINCT a.value_1), count(DISTINCT b.value_2)) - 1)) AS v
    FROM a JOIN b ON a.column_1 = b.column_1 AND a.column_2 = b.column_2 JOIN t ON a.column_1 = t.column_1 AND a.column_2 = t.column_2
    LEFT JOIN x ON x.column_1 = a.column_1 AND x.column_2 = a.column_2 AND x.value_1 = a.value_1 AND x.value_2 = b.value_2
    GROUP BY ALL)"""
ORACLES["cramers_v"] = f"""{FACTS}, {_CRAMER} SELECT column_1, column_2, round(v, 6) AS cramers_v,
    CASE WHEN round(v, 6) >= 0.5 THEN 'strong' WHEN round(v, 6) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM v"""
ORACLES["datetime_profile"] = f"""{DIRTY} SELECT 'order_date' AS "column", v AS valid_dates, t - v AS missing_dates,
    round(100.0 * (t - v) / t, 6) AS missing_percentage, u AS unique_dates, {iso('lo')} AS earliest, {iso('hi')} AS latest,
    date_diff('day', lo, hi) AS range_days FROM (SELECT count(*) AS t, count({date('order_date')}) AS v,
    count(DISTINCT {date('order_date')}) AS u, min({date('order_date')}) AS lo, max({date('order_date')}) AS hi FROM d)"""


def _trends(numbers, source: str, ts: str, digits: int) -> str:
    parts = " UNION ALL ".join(
        f"""SELECT '{ts}' AS dc, '{x}' AS nc, count(*) AS n, corr(epoch(ts), m) AS r, arg_min(m, ts) AS a, arg_max(m, ts) AS z
        FROM (SELECT {ts} AS ts, avg({x}) AS m FROM {source} WHERE {x} IS NOT NULL GROUP BY {ts})""" for x in numbers)
    return f"tr AS (SELECT * FROM ({parts}) WHERE n >= 3)"


_TREND_SELECT = f"""SELECT dc AS datetime_column, nc AS numerical_column, n AS observations, round(r, 6) AS trend_correlation,
    {_STRENGTH('round(r, 6)')} AS trend_strength, CASE WHEN round(r, 6) >= 0.3 THEN 'increasing' WHEN round(r, 6) <= -0.3 THEN 'decreasing'
    ELSE 'stable_or_irregular' END AS direction, round(a, 6) AS first_value, round(z, 6) AS last_value,
    round(z - a, 6) AS absolute_change, round(100 * (z - a) / nullif(abs(a), 0), 6) AS percentage_change FROM tr"""
_FACT_TRENDS = _trends(FACT_NUMBERS, "d", "l_shipdate", 3)
ORACLES["time_trend"] = f"{FACTS}, {_FACT_TRENDS} {_TREND_SELECT}"
ORACLES["time_trend_events"] = f"WITH {_trends(['value'], 'events', 'ts', 3)} {_TREND_SELECT}"
_RELATIONS = f"""{_CORR}, {_EFFECTS}, {_CRAMER}, {_FACT_TRENDS}, rel AS (
    SELECT 'numeric_correlation' AS type, column_1, column_2, abs(c) AS score FROM r WHERE abs(c) >= 0.4
    UNION ALL SELECT 'category_numeric', cat, num, e FROM eff WHERE e >= 0.1
    UNION ALL SELECT 'categorical_association', column_1, column_2, v FROM v WHERE v >= 0.2
    UNION ALL SELECT 'time_trend', dc, nc, abs(r) FROM tr WHERE abs(r) >= 0.3)"""
ORACLES["important_relationships"] = f"""{FACTS}, {_RELATIONS} SELECT type, column_1, column_2, round(score, 6) AS score FROM rel
    ORDER BY score DESC LIMIT 25"""
ORACLES["eda_flags"] = f"""{DIRTY}, {_DUPS}, {_outliers(_DIRTY_NUMBERS, 'd', number)},
nul AS ({each(DIRTY_COLUMNS, lambda c: f"SELECT '{c}' AS col, 100.0 * (count(*) - count({c})) / count(*) AS p FROM d")}),
neg AS ({each(_DIRTY_NUMBERS, lambda c: f"SELECT '{c}' AS col, 100.0 * count(*) FILTER (WHERE {number(c)} < 0) / count({number(c)}) AS p FROM d")}),
cat AS ({each(_CATEGORIES, lambda c: f"SELECT '{c}' AS col, count(DISTINCT {c}) AS u, count({c}) AS v, (SELECT max(n) FROM (SELECT count(*) AS n FROM d WHERE {c} IS NOT NULL GROUP BY {c})) AS top FROM d")})
SELECT 'duplicate_rows' AS type, NULL AS "column", 'medium' AS severity, printf('%.2f%% of rows are duplicates', 100.0 * surplus / total) AS message FROM dups WHERE 100.0 * surplus / total >= 5
UNION ALL SELECT 'high_missingness', col, CASE WHEN p >= 50 THEN 'high' ELSE 'medium' END, printf('%s: %.2f%% missing', col, p) FROM nul WHERE p >= 30
UNION ALL SELECT 'outliers', "column", CASE WHEN 100.0 * o / n >= 15 THEN 'high' ELSE 'medium' END, printf('%s: %.2f%% outliers', "column", 100.0 * o / n) FROM outs WHERE 100.0 * o / n >= 5
UNION ALL SELECT 'negative_values', col, 'info', printf('%s: %.2f%% negative', col, p) FROM neg WHERE p > 0
UNION ALL SELECT 'high_cardinality', col, 'info', printf('%s: %d categories', col, u) FROM cat WHERE u >= 100 OR u / v >= 0.5
UNION ALL SELECT 'dominant_category', col, 'info', printf('%s: %.2f%% are one category', col, 100.0 * top / v) FROM cat WHERE 100.0 * top / v >= 90"""
ORACLES["chart_recommendations"] = f"""{FACTS}, {_RELATIONS},
five AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY round(score, 6) DESC, column_1, column_2) AS k FROM rel)
SELECT 'histogram' AS chart, unnest([{', '.join(map(q, FACT_NUMBERS))}]) AS x, NULL AS y, 'distribution' AS intent
UNION ALL SELECT 'bar', unnest([{', '.join(map(q, FACT_CATEGORIES))}]), 'count', 'category_frequency'
UNION ALL SELECT CASE type WHEN 'numeric_correlation' THEN 'scatter' WHEN 'category_numeric' THEN 'box' ELSE 'line' END, column_1, column_2,
    CASE type WHEN 'numeric_correlation' THEN 'relationship' WHEN 'category_numeric' THEN 'group_comparison' ELSE 'time_trend' END
    FROM five WHERE k <= 5 AND type <> 'categorical_association'"""

# -- charts --------------------------------------------------------------------------------------

ORACLES["category_frequency"] = f"""{DIRTY} SELECT COALESCE(priority, 'Missing') AS priority, count(*) AS count FROM d GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 15"""
ORACLES["usable_categories"] = f"""SELECT * FROM ({each(("p_name", "p_brand", "p_type"), lambda c: f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS unique_values FROM part")})
    WHERE unique_values BETWEEN 2 AND 15"""
ORACLES["numeric_test"] = f"{DIRTY} " + each(DIRTY_COLUMNS, lambda c: f"""SELECT '{c}' AS "column",
    count({number(c)}) / count({c}) >= 0.6 AS is_numeric FROM d""")


def _histogram(c: str, source: str) -> str:
    return f"""WITH s AS (SELECT min({c}) AS lo, max({c}) AS hi, CAST(least(20, greatest(5, floor(sqrt(count({c}))))) AS INTEGER) AS k FROM {source}),
    b AS (SELECT unnest(range(k)) AS i, lo, hi, k, (hi - lo) / k AS w FROM s),
    e AS (SELECT i, CASE WHEN i = 0 THEN lo - (hi - lo) * 0.001 ELSE lo + i * w END AS l, CASE WHEN i = k - 1 THEN hi ELSE lo + (i + 1) * w END AS r FROM b)
    SELECT CAST(i AS INTEGER) AS bin_index, round(l, 4) AS "left", round(r, 4) AS "right", count({c}) AS frequency
    FROM e LEFT JOIN {source} ON {c} > l AND {c} <= r GROUP BY ALL"""


ORACLES["histogram"] = _histogram("p_retailprice", "part")
ORACLES["histogram_lineitem"] = _histogram("l_extendedprice", "lineitem")
_BOX = f"""SELECT quantile_cont({number('price')}, 0.25) AS q1, median({number('price')}) AS med, quantile_cont({number('price')}, 0.75) AS q3,
    min({number('price')}) AS lo, max({number('price')}) AS hi FROM d"""
ORACLES["box_stats"] = f"""{DIRTY}, b AS ({_BOX}), o AS (SELECT row_id, {number('price')} AS x FROM d, b
    WHERE {number('price')} < q1 - 1.5 * (q3 - q1) OR {number('price')} > q3 + 1.5 * (q3 - q1))
SELECT 'price' AS "column", lo AS min, round(q1, 4) AS q1, round(med, 4) AS median, round(q3, 4) AS q3, hi AS max,
    round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound,
    (SELECT string_agg(CAST(CAST(x AS BIGINT) AS STRING), ',' ORDER BY row_id) FROM (SELECT * FROM o ORDER BY row_id LIMIT 100)) AS outliers,
    (SELECT count(*) FROM o) AS outlier_count FROM b"""
_GROUP_BOX = """SELECT {g}, count({x}) AS count, round(min({x}), 4) AS min, round(quantile_cont({x}, 0.25), 4) AS q1,
    round(median({x}), 4) AS median, round(quantile_cont({x}, 0.75), 4) AS q3, round(max({x}), 4) AS max FROM {t} GROUP BY 1"""
ORACLES["box_by_group"] = _GROUP_BOX.format(g="o_orderpriority", x="o_totalprice", t="orders")
ORACLES["box_by_part"] = _GROUP_BOX.format(g="CAST(l_partkey AS VARCHAR) AS l_partkey", x="l_extendedprice", t="lineitem")
ORACLES["category_numeric_by_part"] = """SELECT CAST(l_partkey AS VARCHAR) AS l_partkey, round(avg(l_extendedprice), 3) AS mean,
    round(median(l_extendedprice), 3) AS median, count(l_extendedprice) AS count FROM lineitem GROUP BY 1"""
ORACLES["scatter_sample"] = """SELECT l_quantity, l_extendedprice FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL
    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 500"""
ORACLES["category_numeric"] = """SELECT o_orderpriority, round(avg(o_totalprice), 3) AS mean, round(median(o_totalprice), 3) AS median,
    count(o_totalprice) AS count FROM orders GROUP BY 1"""
ORACLES["group_mean_variation"] = """SELECT round(least(1.0, (max(m) - min(m)) / abs(avg(m))), 6) AS mean_variation
    FROM (SELECT avg(o_totalprice) AS m FROM orders GROUP BY o_orderpriority)"""
ORACLES["composition"] = f"""{DIRTY} SELECT COALESCE(priority, 'Missing') AS priority, COALESCE(is_urgent, 'Missing') AS is_urgent,
    count(*) AS count FROM d GROUP BY 1, 2"""
ORACLES["time_series"] = "SELECT o_orderdate, round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY 1"
ORACLES["date_axis"] = f"""{DIRTY} SELECT row_id, CAST(CAST({date('order_date')} AS DATE) AS STRING) AS order_date FROM d WHERE {date('order_date')} IS NOT NULL"""
ORACLES["bar_by_category"] = """SELECT p_brand, round(avg(p_retailprice), 3) AS p_retailprice FROM part GROUP BY 1
    ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 15"""
ORACLES["result_chart"] = "SELECT o_orderpriority, round(avg(o_totalprice), 3) AS average_o_totalprice FROM orders GROUP BY 1"
ORACLES["result_chart_violin"] = ORACLES["box_by_group"]
ORACLES["result_chart_source"] = _GROUP_BOX.format(g="o_orderstatus", x="o_totalprice", t="orders")

# -- findings and summaries ------------------------------------------------------------------------

_FIND = [
    "SELECT 'dataset_summary' AS type, 'info' AS importance, NULL AS \"column\", NULL AS column_2, count(*)::DOUBLE AS value FROM d",
    "SELECT 'missing_values', 'low', NULL, NULL, 0.0",
    """SELECT 'duplicates', 'medium', NULL, NULL, s FROM (SELECT (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS s) WHERE s > 0""",
]
for _x in FACT_NUMBERS:
    _FIND.append(f"SELECT 'numeric_summary', 'info', '{_x}', NULL, round(round(avg({_x}), 4), 2) FROM d")
    _FIND.append(f"SELECT 'skewness', 'medium', '{_x}', NULL, round(skewness({_x}), 2) FROM d HAVING abs(skewness({_x})) >= 1")
for _x in FACT_CATEGORIES:
    _FIND.append(f"""SELECT 'category_distribution', CASE WHEN 100.0 * max(n) / sum(n) >= 70 THEN 'medium' ELSE 'info' END, '{_x}', NULL,
        round(100.0 * max(n) / sum(n), 2) FROM (SELECT count(*) AS n FROM d GROUP BY {_x})""")
_FIND.append("""SELECT 'correlation', CASE WHEN abs(c) >= 0.7 THEN 'high' ELSE 'medium' END, column_1, column_2, round(c, 2) FROM
    (SELECT * FROM r ORDER BY abs(c) DESC LIMIT 5) WHERE abs(c) >= 0.5""")
_FIND.append(f"""SELECT 'quality', CASE WHEN s < 60 THEN 'high' WHEN s < 80 THEN 'medium' ELSE 'low' END, NULL, NULL, s
    FROM (SELECT overall_score AS s FROM ({ORACLES['quality_score_without_anomalies']}))""")
ORACLES["statistical_findings"] = f"{FACTS}, {_CORR} {' UNION ALL '.join(_FIND)}"
ORACLES["result_summary"] = """WITH r AS (SELECT l_shipdate AS d, avg(l_extendedprice) AS m FROM lineitem GROUP BY 1)
SELECT 'highest' AS kind, (SELECT count(*) FROM r) AS "rows", 'average_l_extendedprice' AS metric, CAST(arg_max(d, m) AS STRING) AS label, round(max(m), 3) AS value FROM r
UNION ALL SELECT 'lowest', (SELECT count(*) FROM r), 'average_l_extendedprice', CAST(arg_min(d, m) AS STRING), round(min(m), 3) FROM r"""
ORACLES["result_summary_metric"] = " UNION ALL ".join(
    f"""SELECT '{k}' AS kind, count(*) AS "rows", 'l_extendedprice' AS metric, NULL::VARCHAR AS label, round({f}(l_extendedprice), 3) AS value FROM lineitem"""
    for k, f in (("minimum", "min"), ("maximum", "max"), ("mean", "avg")))
ORACLES["result_summary_category"] = f"""{DIRTY} SELECT 'most_frequent' AS kind, (SELECT count(*) FROM d) AS "rows", 'priority' AS metric,
    label, value FROM (SELECT COALESCE(priority, 'Missing') AS label, count(*)::DOUBLE AS value FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""
_CONTEXT = f"""SELECT 'numerical' AS section, 'l_quantity' AS "column", 'count' AS metric, CAST(count(l_quantity) AS STRING) AS value FROM d
""" + "".join(f" UNION ALL SELECT 'numerical', 'l_quantity', '{k}', printf('%.4f', round(round({f}(l_quantity), 6), 4)) FROM d"
              for k, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max"), ("std", "stddev_samp"))) + """
UNION ALL SELECT 'categorical', 'l_returnflag', 'unique_values', CAST(count(DISTINCT l_returnflag) AS STRING) FROM d
UNION ALL SELECT 'categorical', 'l_returnflag', 'most_common', v FROM (SELECT l_returnflag AS v, count(*) AS n FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
UNION ALL SELECT 'categorical', 'l_returnflag', 'most_common_count', CAST(max(n) AS STRING) FROM (SELECT count(*) AS n FROM d GROUP BY l_returnflag)
UNION ALL SELECT 'datetime', 'l_shipdate', 'valid_dates', CAST(count(l_shipdate) AS STRING) FROM d
UNION ALL SELECT 'datetime', 'l_shipdate', 'missing_dates', CAST(count(*) - count(l_shipdate) AS STRING) FROM d
UNION ALL SELECT 'datetime', 'l_shipdate', 'earliest', strftime(min(l_shipdate), '%Y-%m-%dT%H:%M:%S') FROM d
UNION ALL SELECT 'datetime', 'l_shipdate', 'latest', strftime(max(l_shipdate), '%Y-%m-%dT%H:%M:%S') FROM d
UNION ALL SELECT 'datetime', 'l_shipdate', 'range_days', CAST(date_diff('day', min(l_shipdate), max(l_shipdate)) AS STRING) FROM d
UNION ALL SELECT 'distribution', 'l_returnflag', l_returnflag, CAST(count(*) AS STRING) FROM d GROUP BY l_returnflag"""
ORACLES["profile_context"] = f"{FACTS} {_CONTEXT}"
ORACLES["profile_context_correlations"] = f"""{FACTS}, {_CORR} SELECT 'correlation' AS section, column_1 || ' vs ' || column_2 AS "column",
    'interpretation' AS metric, CASE WHEN abs(c) >= 0.7 THEN 'strong' WHEN abs(c) >= 0.4 THEN 'moderate' ELSE 'weak' END || ' ' ||
    CASE WHEN c > 0 THEN 'positive' ELSE 'negative' END AS value FROM r WHERE column_1 = 'l_quantity' OR column_2 = 'l_quantity'"""

# -- templates ------------------------------------------------------------------------------------------

ORACLES |= {
    "q_count": "SELECT count(*) AS total_rows FROM orders",
    "q_distinct": "SELECT DISTINCT o_orderpriority FROM orders",
    "q_count_by": "SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY 1",
    "q_avg_by": "SELECT o_orderpriority, round(avg(o_totalprice), 3) AS average_o_totalprice FROM orders GROUP BY 1",
    "q_avg": "SELECT round(avg(o_totalprice), 3) AS average_o_totalprice FROM orders",
    "q_max": "SELECT max(o_totalprice) AS maximum_o_totalprice FROM orders",
    "q_min": "SELECT min(o_totalprice) AS minimum_o_totalprice FROM orders",
    "q_project": "SELECT o_orderkey, o_totalprice FROM orders",
    "q_project_some": "SELECT least(count(*), 5000) AS total_rows FROM orders",
    "q_preview": "SELECT least(count(*), 100) AS total_rows FROM orders",
    "schema_context": """SELECT column_name AS "column", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
        WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS type,
        array_to_string(samples[1:5], '|') AS samples FROM (SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name,
                     unnest(['BIGINT','BIGINT','VARCHAR','DOUBLE','TIMESTAMP','VARCHAR']) AS data_type,
                     unnest([list_sort(list(DISTINCT CAST(o_orderkey AS STRING))), list_sort(list(DISTINCT CAST(o_custkey AS STRING))),
                         list_sort(list(DISTINCT o_orderstatus)), list_sort(list(DISTINCT CAST(o_totalprice AS STRING))),
                         list_sort(list(DISTINCT CAST(o_orderdate AS STRING))), list_sort(list(DISTINCT o_orderpriority))]) AS samples FROM orders)""",
    "describe_table": """SELECT unnest(['o_orderkey','o_custkey','o_orderstatus','o_totalprice','o_orderdate','o_orderpriority']) AS column_name,
        unnest(['bigint','bigint','string','double','timestamp_ntz','string']) AS column_type FROM (SELECT count(*) FROM orders)""",
    "json_records": """SELECT CAST(o_orderkey AS STRING) AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate,
        o_orderpriority, CAST(o_custkey AS STRING) AS o_custkey, CAST(o_totalprice AS STRING) AS o_totalprice FROM orders""",
    "csv_round_trip": """SELECT o_orderkey, o_orderkey + 9000000000000000000 AS long_id, '99' || CAST(o_orderkey + 1000000000000000000 AS STRING) AS beyond,
        o_totalprice, o_orderstatus FROM orders""",
    "ask_average": """WITH r AS (SELECT o_orderstatus AS s, avg(o_totalprice) AS m FROM orders GROUP BY 1)
        SELECT 'highest' AS kind, count(*) AS "rows", 'average_price' AS metric, arg_max(s, m) AS label, round(max(m), 3) AS value FROM r
        UNION ALL SELECT 'lowest', count(*), 'average_price', arg_min(s, m), round(min(m), 3) FROM r""",
}

_WIDE_PAIRS = [(a, b) for i, a in enumerate(WIDE_NUMBERS) for b in WIDE_NUMBERS[i + 1:]]
_WIDE = f"""WITH d AS ({WIDE_LINEITEM}), w AS (SELECT unnest([""" + ", ".join(
    f"{{'column_1': '{a}', 'column_2': '{b}', 'c': corr({a}, {b}), 'observations': count(*)}}" for a, b in _WIDE_PAIRS
) + "], recursive := true) FROM d)"
ORACLES["wide_correlations"] = f"{_WIDE} SELECT column_1, column_2, round(c, 6) AS correlation, observations FROM w"
ORACLES["wide_pivot"] = f"""{_WIDE}, cells AS (SELECT column_1 AS x, column_2 AS y, round(c, 4) AS c FROM w
    UNION ALL SELECT column_2, column_1, round(c, 4) FROM w UNION ALL SELECT column_1, column_1, 1.0 FROM w GROUP BY column_1
    UNION ALL SELECT '{WIDE_NUMBERS[-1]}', '{WIDE_NUMBERS[-1]}', 1.0)
SELECT y, """ + ", ".join(f"max(c) FILTER (WHERE x = '{c}') AS {c}" for c in WIDE_NUMBERS) + " FROM cells GROUP BY y"
ORACLES["flat_correlations"] = f"SELECT column_1 || ' vs ' || column_2 AS pair, correlation FROM ({ORACLES['correlations']})"
ORACLES["distributions"] = f"SELECT \"column\", skewness, distribution_shape AS shape FROM ({ORACLES['numeric_profile']})"
ORACLES["skipped_categories"] = """SELECT 'l_suppkey' AS "column", 'fewer than 2 or more than 30 groups' AS reason FROM lineitem
    HAVING count(DISTINCT l_suppkey) NOT BETWEEN 2 AND 30"""
ORACLES["quoted_names"] = "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 1000"
ORACLES["result_chart_kpi"] = "SELECT 'kpi' AS kind, round(avg(o_totalprice), 3) AS value FROM orders"
ORACLES["result_chart_line"] = "SELECT o_orderdate, round(avg(o_totalprice), 6) AS average_o_totalprice FROM orders GROUP BY 1"
ORACLES["result_chart_histogram"] = ORACLES["histogram"]
ORACLES["result_chart_scatter"] = """SELECT o_custkey::DOUBLE AS o_custkey, o_totalprice FROM orders WHERE o_totalprice IS NOT NULL AND o_custkey IS NOT NULL
    ORDER BY o_orderkey LIMIT 500"""
_WHOLE_PAIRS = [(a, b) for i, a in enumerate(LINEITEM_NUMBERS) for b in LINEITEM_NUMBERS[i + 1:]]
ORACLES["result_chart_heatmap"] = " UNION ALL ".join(
    f"SELECT '{x}' AS x, '{y}' AS y, round(corr({a}, {b}), 4) AS correlation FROM lineitem" for a, b in _WHOLE_PAIRS for x, y in ((a, b), (b, a)))
ORACLES["result_chart_heatmap"] = f"{ORACLES['result_chart_heatmap']} UNION ALL SELECT unnest([{', '.join(map(q, LINEITEM_NUMBERS))}]) AS x, x, 1.0"
ORACLES["result_chart_stacked"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS count FROM orders GROUP BY ALL"
ORACLES["result_chart_empty"] = "SELECT count(*) AS orders, count(*) FILTER (WHERE o_totalprice < 0) = 0 AS no_chart FROM orders"

ORACLES["bundle_versions"] = "SELECT 1 AS version, c_name AS name FROM customer UNION ALL SELECT 2, s_name FROM supplier"
ORACLES["bundle_read_back"] = "SELECT * FROM orders"

# -- prepared datasets -----------------------------------------------------------------------------

# The cleaned table as text again, so that the checks of the raw one apply to it.
_CLEANED = f"""WITH d AS (SELECT row_id, order_id, customer_id, status, CAST(price AS STRING) AS price, strftime(order_date, '%Y-%m-%d') AS order_date,
    priority, CAST(is_urgent AS STRING) AS is_urgent, quantity, channel, market FROM ({ORACLES["clean_result"]}))"""


def _scores(rows: str) -> str:
    return f"""({rows}, {_ALL}, {_WITH} SELECT component, CAST(score AS DOUBLE) AS score FROM parts
        UNION ALL SELECT 'overall', CAST(overall_score AS DOUBLE) FROM ({_OVERALL}))"""


ORACLES["score_delta"] = f"""SELECT component, b.score AS before, a.score AS after, round(a.score - b.score, 2) AS change
    FROM {_scores(DIRTY)} b JOIN {_scores(_CLEANED)} a USING (component)"""
ORACLES["prepared_bundle"] = f"""SELECT 'orders' AS name, (SELECT count(*) FROM ({DIRTY_ORDERS})) AS original_rows, (SELECT count(*) FROM ({ORACLES["clean_result"]})) AS rows,
    {len(DIRTY_COLUMNS) + 1}::INTEGER AS columns, before AS score_before, after AS score_after, change AS quality_improvement
    FROM ({ORACLES["score_delta"]}) WHERE component = 'overall'"""

# -- automatic charts of the part table: its type is the only category with few enough values ---------

_PART_NUMBERS = ("p_size", "p_retailprice")
_VARIATION = lambda x: f"(SELECT least(1.0, (max(m) - min(m)) / abs(avg(m))) FROM (SELECT avg({x}) AS m FROM part GROUP BY p_type))"
_OUTSIDE = lambda x: f"""(SELECT count(*) FROM part, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM part)
    WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1))"""  # noqa: E731
_PART_CORRELATION = "(SELECT corr(p_size, p_retailprice) FROM part)"
_TYPES = "(SELECT count(DISTINCT p_type) FROM part)"
_CANDIDATES = (
    [f"SELECT 0 AS nth, 'bar' AS chart_type, 'p_type' AS x, 'count' AS y, 'category_distribution' AS family, 'p_type' AS names, "
     f"58 + CASE WHEN {_TYPES} <= 8 THEN 8 ELSE 0 END AS score, 'distribution' AS intent, {_TYPES} AS points"]
    + [f"SELECT {1 + i}, 'histogram', 'bin', 'frequency', 'numeric_distribution', '{x}', 52, 'distribution', "
       f"least(20, greatest(5, floor(sqrt((SELECT count({x}) FROM part)))))" for i, x in enumerate(_PART_NUMBERS)]
    + [f"SELECT {3 + i}, 'box', '{x}', '{x}', 'numeric_box', '{x}', 45 + least(20.0, least(100, {_OUTSIDE(x)}) / 5), 'outlier', 1" for i, x in enumerate(_PART_NUMBERS)]
    + [f"SELECT 5, 'heatmap', 'x', 'y', 'correlation_heatmap', NULL, 72 + round(abs({_PART_CORRELATION}), 4) * 15, 'correlation', 4",
       f"""SELECT 6, 'scatter', 'p_size', 'p_retailprice', 'scatter', 'p_size|p_retailprice', 65 + abs({_PART_CORRELATION}) * 25, 'relationship',
           least(500, (SELECT count(*) FROM part)) WHERE abs({_PART_CORRELATION}) >= 0.30"""]
    + [f"SELECT {7 + i}, 'bar', 'p_type', 'mean', 'category_numeric', 'p_type|{x}', 68 + least(15.0, {_VARIATION(x)} * 15), 'comparison', {_TYPES}" for i, x in enumerate(_PART_NUMBERS)]
    + [f"SELECT {9 + i}, 'box', 'p_type', '{x}', 'grouped_box', 'p_type|{x}', 64, 'group_distribution', {_TYPES}" for i, x in enumerate(_PART_NUMBERS)]
)
_CHOSEN = f"""WITH c AS ({" UNION ALL ".join(_CANDIDATES)}), placed AS (
    SELECT row_number() OVER (ORDER BY nth) - 1 AS place, chart_type, x, y, family, concat_ws('|', family, names) AS signature,
        CAST(printf('%.3f', CAST(score AS DOUBLE)) AS DOUBLE) AS score, intent, points FROM c)
    SELECT * FROM placed ORDER BY score DESC, place LIMIT 10"""
ORACLES["chart_ranking"] = f"SELECT place::INTEGER AS place, chart_type, x, y, NULL::VARCHAR AS color, family, signature, score, intent FROM ({_CHOSEN})"
ORACLES["automatic_charts"] = f"SELECT signature, points::BIGINT AS points FROM ({_CHOSEN})"
