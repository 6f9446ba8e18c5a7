"""SQL twins of the registered queries, for DuckDB over the driver tables.

Every text starts from the same raw feed (``star.RAW_SQL``) and states the measure in
its own terms; nothing is shared with the Spark side but names and fixed values.
"""

from __future__ import annotations

from checks.queries import COUNTRIES, CUTOFF, FILTERS, LAST_MONTH, MATCH_DAYS, SAMPLE, YEARS
from checks.star import RAW_SQL, RULES
from tillroll.operators.audit import PROBE_WORDS
from tillroll.rules import BUSINESS_KEY
from tillroll.schema import FACT_COLUMNS


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def _d(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _round(expression: str, places: int) -> str:
    return f"round({_d(expression)}, {places})"


def _share(part: str, whole: str) -> str:
    return f"({_d(part)} / nullif({_d(whole)}, 0))"


def _collapsed(column: str) -> str:
    return rf"nullif(trim(regexp_replace({column}, '\s+', ' ', 'g')), '')"


L = RULES.labels

# RE2 has no lookahead: hide "carriage clock" and "carriage lantern" first
_HIDDEN = (
    r"regexp_replace(coalesce(description, ''), '(?i)\bcarriage\s+(clock|lantern)', '_', 'g')"
)
_WORDS = (
    r"(?i)\b(postage|carriage|manual|discount|samples?|damaged?s?|missing|adjust\w*"
    r"|bad debt|dotcom|amazon|cruk)\b"
)

TYPED = f"""{RAW_SQL}, typed AS (
  SELECT src_ord, row_ord, upper(trim(invoice_no)) AS invoice_no,
         upper(trim(stock_code)) AS stock_code,
         {_collapsed('description')} AS description, quantity, invoice_date,
         CAST(round_even(unit_price * 100, 0) / 100 AS DECIMAL(18,2)) AS unit_price,
         TRY_CAST(customer_id AS BIGINT) AS customer_id,
         CASE WHEN {_collapsed('country')} = 'OLD_2' THEN 'NATION_2'
              ELSE {_collapsed('country')} END AS country
  FROM raw
)"""

TAGGED = f"""{TYPED}, tagged AS (
  SELECT *,
         CASE WHEN left(invoice_no, 1) = 'C' THEN 'cancellation'
              WHEN quantity < 0 THEN 'return' ELSE 'sale' END AS line_type,
         NOT (stock_code IN ({_quoted(RULES.non_goods_codes)})
              OR regexp_matches({_HIDDEN}, '{_WORDS}')) AS is_merchandise,
         customer_id IS NULL AS is_guest,
         quantity >= {RULES.bulk_quantity} AS is_bulk
  FROM typed
)"""

UNIQUE = f"""{TAGGED}, uniq AS (
  SELECT * FROM tagged
  QUALIFY row_number() OVER (
    PARTITION BY {', '.join(BUSINESS_KEY)}
    ORDER BY src_ord, row_ord, description NULLS LAST, customer_id NULLS LAST) = 1
)"""

FILLED = f"""{UNIQUE}, names AS (
  SELECT stock_code, description AS usual
  FROM uniq WHERE is_merchandise AND description IS NOT NULL AND stock_code <> 'TEST001'
  GROUP BY stock_code, description
  QUALIFY row_number() OVER (PARTITION BY stock_code ORDER BY count(*) DESC, description) = 1
), filled AS (
  SELECT u.* REPLACE (coalesce(u.description, n.usual) AS description),
         u.description IS NULL AND n.usual IS NOT NULL AS is_backfilled
  FROM uniq u LEFT JOIN names n ON u.stock_code = n.stock_code
  WHERE u.stock_code <> 'TEST001'
)"""

FACT = f"""{FILLED}, fact AS (
  SELECT invoice_no, customer_id, stock_code,
         coalesce(description, '{L.no_description}') AS description, country, invoice_date,
         CAST(date_trunc('month', invoice_date) AS DATE) AS month_start, quantity, unit_price,
         CAST(quantity * unit_price AS DECIMAL(18,2)) AS line_revenue, line_type,
         is_merchandise, is_guest, is_bulk, is_backfilled
  FROM filled
)"""

GOODS = f"""{FACT}, goods AS (
  SELECT *, CAST(invoice_date AS DATE) AS day, strftime(month_start, '%Y-%m') AS month
  FROM fact WHERE is_merchandise
), sold AS (SELECT * FROM goods WHERE line_type = 'sale'),
known AS (SELECT * FROM sold WHERE customer_id IS NOT NULL),
undone AS (SELECT * FROM goods WHERE line_type <> 'sale')"""

_REGION = f"""CASE WHEN country = '{RULES.home_country}' THEN '{L.home}'
  WHEN country = '{RULES.unspecified_country}' THEN '{L.unspecified}'
  WHEN country IN ({_quoted(RULES.listed_export)}) THEN '{L.listed_export}'
  ELSE '{L.other_export}' END"""

_MONEY_FACT = ", ".join(
    f"{_d(c)} AS {c}" if c in ("unit_price", "line_revenue") else c for c in FACT_COLUMNS
)
_DAY_LINE = _MONEY_FACT.replace(
    "invoice_date", "CAST(invoice_date AS DATE) AS invoice_date"
)
_DAY_SALE = _DAY_LINE.replace(" line_type, is_merchandise,", "")

# ---------------------------------------------------------------- shared reports
MONTHLY = f"""{GOODS}, firsts AS (
  SELECT customer_id, min(month_start) AS month_start FROM known GROUP BY 1
), fresh AS (SELECT month_start, count(*) AS n FROM firsts GROUP BY 1
), kpi AS (
  SELECT s.month_start, s.month, sum(line_revenue) AS cash,
         count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_id) AS customers,
         CAST(sum(quantity) AS BIGINT) AS units, coalesce(any_value(f.n), 0) AS new_customers
  FROM sold s LEFT JOIN fresh f ON f.month_start = s.month_start GROUP BY 1, 2
)"""

COHORT = f"""{GOODS}, born AS (
  SELECT customer_id, min(month_start) AS cohort_month FROM known GROUP BY 1
), life AS (
  SELECT strftime(cohort_month, '%Y-%m') AS cohort, cohort_month,
         date_diff('month', cohort_month, month_start) AS month_number,
         count(DISTINCT k.customer_id) AS active_customers, sum(line_revenue) AS cash
  FROM known k JOIN born b ON b.customer_id = k.customer_id GROUP BY 1, 2, 3
), sizes AS (SELECT cohort_month, count(*) AS cohort_size FROM born GROUP BY 1
), retention AS (
  SELECT cohort, cohort_month, month_number, cohort_size, active_customers,
         {_round(_share('active_customers', 'cohort_size'), 4)} AS retention
  FROM life JOIN sizes USING (cohort_month)
), earning AS (
  SELECT cohort, month_number, {_round('cash', 2)} AS revenue,
         {_round(_share('cash', 'sum(cash) OVER (PARTITION BY cohort)'), 4)} AS revenue_share
  FROM life
)"""


def _score(measure: str) -> str:
    return " + ".join(
        f"CAST({_d(measure)} > (SELECT quantile_cont({_d(measure)}, {q}::DOUBLE) FROM people) AS INTEGER)"
        for q in (0.2, 0.4, 0.6, 0.8)
    )


PEOPLE = f"""{GOODS}, people AS (
  SELECT customer_id,
         date_diff('day', max(day), (SELECT max(day) FROM sold)) AS recency_days,
         count(DISTINCT invoice_no) AS frequency, sum(line_revenue) AS monetary,
         min(day) AS first_purchase, max(day) AS last_purchase
  FROM known GROUP BY 1
)"""

RFM = f"""{PEOPLE}, points AS (
  SELECT *, 5 - ({_score('recency_days')}) AS r_score, 1 + ({_score('frequency')}) AS f_score,
         1 + ({_score('monetary')}) AS m_score
  FROM people
), rfm AS (
  SELECT customer_id, recency_days, frequency, {_d('monetary')} AS monetary, first_purchase,
         last_purchase, r_score, f_score, m_score,
         {_round(_share('monetary', 'frequency'), 2)} AS avg_order_value,
         r_score + f_score + m_score AS rfm_score,
         CASE WHEN r_score > 3 THEN
                CASE WHEN f_score > 3 AND m_score > 3 THEN '{L.core}'
                     WHEN f_score > 2 THEN '{L.loyal}' ELSE '{L.fresh}' END
              WHEN r_score = 3 THEN
                CASE WHEN f_score > 2 THEN '{L.cooling}' ELSE '{L.other}' END
              WHEN m_score > 3 THEN '{L.costly_churn}' ELSE '{L.churn}' END AS segment
  FROM points
), segments AS (
  SELECT segment, count(*) AS customers,
         {_round(_share('count(*)', '(SELECT count(*) FROM rfm)'), 4)} AS customers_share,
         {_d('sum(CAST(monetary AS DECIMAL(28,2)))')} AS revenue,
         {_round(_share('sum(CAST(monetary AS DECIMAL(28,2)))',
                        '(SELECT sum(monetary) FROM people)'), 4)} AS revenue_share,
         {_round(_share('sum(CAST(monetary AS DECIMAL(28,2)))', 'count(*)'), 2)}
           AS avg_revenue_per_customer,
         {_round(_share('sum(frequency)', 'count(*)'), 2)} AS avg_orders,
         {_round(_share('sum(recency_days)', 'count(*)'), 0)} AS avg_recency_days
  FROM rfm GROUP BY 1
)"""

MOMENT_GAPS = f"""{GOODS}, gaps AS (
  SELECT customer_id,
         date_sub('day', lag(invoice_date) OVER w, invoice_date) AS gap_days
  FROM (SELECT DISTINCT customer_id, invoice_date FROM known)
  WINDOW w AS (PARTITION BY customer_id ORDER BY invoice_date)
)"""

BY_MONEY = f"""{GOODS}, spent AS (
  SELECT customer_id, sum(line_revenue) AS cash FROM known GROUP BY 1
), pareto AS (
  SELECT customer_id, {_d('cash')} AS revenue, cash,
         sum(cash) OVER (ORDER BY cash DESC, customer_id ROWS UNBOUNDED PRECEDING) AS upto,
         sum(cash) OVER () AS total, count(*) OVER () AS n,
         row_number() OVER (ORDER BY cash DESC, customer_id) AS rank
  FROM spent
)"""

_PARETO = f"""SELECT customer_id, revenue, {_round(_share('cash', 'total'), 6)} AS share,
  {_round(_share('upto', 'total'), 6)} AS cum_share, rank,
  {_round(_share('rank', 'n'), 6)} AS customer_share FROM pareto"""

_USUAL = """(SELECT {code}, description FROM {lines} GROUP BY {code}, description
  QUALIFY row_number() OVER (PARTITION BY {code} ORDER BY count(*) DESC, description) = 1)"""


def _usual(lines: str, code: str = "stock_code") -> str:
    return _USUAL.format(lines=lines, code=code)


def _slice_monthly(where: str, unrestricted: bool = False, own_history: bool = False) -> str:
    seen = where if own_history else "true"
    link = "" if unrestricted else (
        "WHERE EXISTS (SELECT 1 FROM cut c WHERE c.customer_id = f.customer_id"
        " AND c.month_start = f.month_start)"
    )
    return f"""{GOODS}, firsts AS (
  SELECT customer_id, min(month_start) AS month_start FROM known WHERE {seen} GROUP BY 1
), cut AS (SELECT * FROM sold WHERE {where}), back AS (
  SELECT month_start, sum(line_revenue) AS reversed FROM undone WHERE {where} GROUP BY 1
), fresh AS (
  SELECT f.month_start, count(*) AS n FROM firsts f {link} GROUP BY 1
), m AS (
  SELECT month_start, month, sum(line_revenue) AS cash, count(DISTINCT invoice_no) AS orders,
         count(DISTINCT customer_id) AS customers, CAST(sum(quantity) AS BIGINT) AS units
  FROM cut GROUP BY 1, 2
) SELECT m.month_start, m.month, {_d('m.cash')} AS revenue, m.orders, m.customers, m.units,
  coalesce(n, 0) AS new_customers, m.customers - coalesce(n, 0) AS returning_customers,
  {_round(_share('m.cash', 'm.orders'), 6)} AS aov,
  {_round(_share('m.cash', 'm.customers'), 6)} AS revenue_per_customer,
  {_d('coalesce(reversed, 0)')} AS reversal_value,
  {_d('m.cash + coalesce(reversed, 0)')} AS net_revenue,
  {_round(_share('m.cash', 'p.cash') + ' - 1', 6)} AS mom_revenue,
  {_round(_share('m.cash', 'y.cash') + ' - 1', 6)} AS yoy_revenue
FROM m LEFT JOIN fresh USING (month_start) LEFT JOIN back USING (month_start)
LEFT JOIN m p ON p.month_start = m.month_start - INTERVAL 1 MONTH
LEFT JOIN m y ON y.month_start = m.month_start - INTERVAL 12 MONTH"""


def _top_products(by: str) -> str:
    return f"""{GOODS}, best AS (
  SELECT stock_code, sum(line_revenue) AS cash, CAST(sum(quantity) AS BIGINT) AS units,
         count(DISTINCT invoice_no) AS orders
  FROM sold GROUP BY 1 ORDER BY {by} DESC, stock_code LIMIT 25
) SELECT stock_code, description, {_d('cash')} AS revenue, units, orders,
  {_round(_share('cash', 'units'), 6)} AS avg_price,
  {_round(_share('cash', '(SELECT sum(line_revenue) FROM sold)'), 6)} AS revenue_share
FROM best JOIN {_usual('sold')} USING (stock_code)"""


_COUNTRY = f"""{GOODS}, ours AS (
  SELECT country, sum(line_revenue) AS cash, count(DISTINCT invoice_no) AS orders,
         count(DISTINCT customer_id) AS customers FROM sold GROUP BY 1
), again AS (
  SELECT country, avg(CAST(n > 1 AS DOUBLE)) AS rate
  FROM (SELECT country, customer_id, count(DISTINCT invoice_no) AS n FROM known GROUP BY 1, 2)
  GROUP BY 1
)"""

_ROLLUP = f"""SELECT country, {_d('cash')} AS revenue, orders, customers,
  {_share('cash', 'sum(cash) OVER ()')} AS revenue_share, rate AS repeat_rate
FROM ours LEFT JOIN again USING (country)"""

_REVERSED_TOP = f"""SELECT stock_code, description, lines AS reversal_lines,
  {_round('cash', 2)} AS reversal_value, units AS units_back
FROM (SELECT stock_code, count(*) AS lines, sum(line_revenue) AS cash,
             CAST(-sum(quantity) AS BIGINT) AS units
      FROM undone GROUP BY 1 ORDER BY cash, stock_code LIMIT %d)
JOIN {_usual('undone')} USING (stock_code)"""


def _years(cutoff: str | None) -> str:
    until = f"AND strftime(day, '%m-%d') <= '{cutoff}'" if cutoff else ""
    old, new = YEARS
    return f"""{GOODS}, firsts AS (
  SELECT customer_id, min(month_start) AS first FROM known GROUP BY 1
), cut AS (
  SELECT s.*, year(day) AS y, s.month_start = f.first AS is_first
  FROM sold s LEFT JOIN firsts f USING (customer_id)
  WHERE year(day) IN ({old}, {new}) {until}
), m AS (
  SELECT y, month_start, sum(line_revenue) AS cash, count(DISTINCT invoice_no) AS orders,
         count(DISTINCT customer_id) FILTER (WHERE is_first) AS fresh,
         count(DISTINCT customer_id) FILTER (WHERE NOT is_first) AS back
  FROM cut GROUP BY 1, 2
), t AS (
  SELECT y, {_d('sum(cash)')} AS revenue, {_d('sum(orders)')} AS orders,
         {_d('sum(fresh)')} AS new_customers, {_d('sum(back)')} AS returning_customers,
         {_d('sum(cash)')} / {_d('sum(orders)')} AS aov
  FROM m GROUP BY 1
), l AS (
  UNPIVOT t ON revenue, orders, new_customers, returning_customers, aov
  INTO NAME measure VALUE amount
), w AS (
  SELECT measure, max(amount) FILTER (WHERE y = {old}) AS a,
         max(amount) FILTER (WHERE y = {new}) AS b
  FROM l GROUP BY 1
) SELECT measure, round(a, 4) AS earlier, round(b, 4) AS later,
  round((b / a - 1) * 100, 1) AS change_pct FROM w"""


def _log_line(rule: str, rows: str, note: str) -> str:
    return f"SELECT '{rule}' AS rule, CAST({rows} AS BIGINT) AS rows, {note} AS note"


def _change_log() -> str:
    source = """SELECT 'source ' || CASE src_ord WHEN 0 THEN 'first' ELSE 'second' END || ' read'
  AS rule, count(*) AS rows, strftime(min(invoice_date), '%Y-%m-%d') || ' - ' ||
  strftime(max(invoice_date), '%Y-%m-%d') AS note FROM raw GROUP BY src_ord"""

    def of(table: str, condition: str = "true") -> str:
        return f"(SELECT count(*) FROM {table} WHERE {condition})"

    free = of("fact", "line_type = 'return' AND unit_price = 0")
    returns = of("fact", "line_type = 'return'")
    parts = [
        source,
        _log_line("exact duplicates removed", f"{of('raw')} - {of('uniq')}",
                  f"'key: {', '.join(BUSINESS_KEY)}'"),
        _log_line("test items removed", of("uniq", "stock_code = 'TEST001'"), "'TEST001'"),
        _log_line("description filled from stock_code", of("fact", "is_backfilled"),
                  "'empty descriptions'"),
        _log_line("country mapped by lookup", of("raw", "trim(country) = 'OLD_2'"),
                  "'OLD_2 -> NATION_2'"),
        _log_line("non-goods lines flagged, not removed", of("fact", "NOT is_merchandise"),
                  "'postage, manual bookings, write-offs and the like'"),
        _log_line("country not recovered", of("fact", "country = 'Unspecified'"),
                  "'Unspecified kept as its own category'"),
        _log_line("lines without customer_id flagged as guests", of("fact", "is_guest"),
                  "'count in revenue, not in retention'"),
        _log_line("bulk lines flagged", of("fact", "is_bulk"), "'quantity >= 50'"),
        _log_line("returns kept as they are", returns,
                  f"'zero prices: ' || {free} || ' of ' || {returns}"),
    ]
    return f"{FACT} " + " UNION ALL ".join(parts)


def _cleaning() -> dict[str, str]:
    line = "src_ord, row_ord"
    source = "CASE src_ord WHEN 0 THEN 'first' ELSE 'second' END"
    price = f"{_d('unit_price')} AS unit_price"
    typed = f"* REPLACE ({price})"
    return {
        "ingest_union": f"{RAW_SQL} SELECT *, {source} AS source FROM raw",
        "ingest_log": f"""{RAW_SQL} SELECT 'source ' || {source} || ' read' AS rule,
  count(*) AS rows, strftime(min(invoice_date), '%Y-%m-%d') || ' - ' ||
  strftime(max(invoice_date), '%Y-%m-%d') AS note FROM raw GROUP BY src_ord""",
        "normalize_ids": f"{TYPED} SELECT {line}, invoice_no, stock_code FROM typed",
        "normalize_text": f"""{RAW_SQL} SELECT {line}, {_collapsed('description')} AS description,
  {_collapsed('country')} AS country FROM raw""",
        "normalize_types": f"{TYPED} SELECT {typed} FROM typed",
        "map_country": f"{TYPED} SELECT country, count(*) AS lines FROM typed GROUP BY 1",
        "map_country_lookup": f"""{RAW_SQL}, entries AS (
  SELECT 'OLD_2' AS value, 'NATION_2' AS mapped
  UNION ALL SELECT n_name, 'REGION_' || n_regionkey FROM nation WHERE n_nationkey % 3 = 1
), lines AS (SELECT {_collapsed('country')} AS country FROM raw)
SELECT coalesce(mapped, country) AS country, count(*) AS lines
FROM lines LEFT JOIN entries ON country = value GROUP BY 1""",
        "tag_line_type": f"{TAGGED} SELECT {line}, invoice_no, quantity, line_type FROM tagged",
        "tag_merchandise":
            f"{TAGGED} SELECT {line}, stock_code, description, is_merchandise FROM tagged",
        "tag_guest_bulk":
            f"{TAGGED} SELECT {line}, customer_id, quantity, is_guest, is_bulk FROM tagged",
        "dedup_business_key": f"{UNIQUE} SELECT {typed} FROM uniq",
        "drop_test_rows": f"""{TAGGED} SELECT stock_code, count(*) AS lines FROM tagged
  WHERE stock_code <> 'TEST001' GROUP BY 1""",
        "backfill_description": f"""{FILLED}
  SELECT {line}, invoice_no, stock_code, description, is_backfilled FROM filled""",
        "fill_sentinel": f"""{FILLED} SELECT {line}, invoice_no, stock_code,
  coalesce(description, '{L.no_description}') AS description FROM filled""",
        "derive_measures": f"""{TYPED} SELECT {line}, quantity, {price},
  {_d('CAST(quantity * unit_price AS DECIMAL(18,2))')} AS line_revenue, invoice_date,
  CAST(date_trunc('month', invoice_date) AS DATE) AS month_start FROM typed""",
        "clean_fact": f"{FACT} SELECT {_MONEY_FACT} FROM fact",
        "dq_change_log": _change_log(),
        "fact_summary": f"""{FACT} SELECT count(*) AS lines,
  {_d("sum(line_revenue) FILTER (WHERE is_merchandise AND line_type = 'sale')")} AS revenue,
  count(DISTINCT invoice_no) FILTER (WHERE is_merchandise AND line_type = 'sale') AS invoices,
  count(DISTINCT customer_id) FILTER (WHERE is_merchandise AND line_type = 'sale') AS customers,
  CAST(min(invoice_date) AS DATE) AS first_day, CAST(max(invoice_date) AS DATE) AS last_day
FROM fact""",
        "write_fact": f"{FACT} SELECT {_MONEY_FACT} FROM fact",
        "write_change_log": _change_log(),
        "normalize_types_csv": f"{TYPED} SELECT {typed} FROM typed",
    }


def _base() -> dict[str, str]:
    start, end = FILTERS["period"]
    return {
        "sales_all": f"{GOODS} SELECT {_DAY_SALE} FROM sold",
        "sales_id": f"{GOODS} SELECT {_DAY_SALE} FROM known",
        "all_lines": f"{FACT} SELECT {_DAY_LINE} FROM fact",
        "snapshot": f"{GOODS} SELECT max(day) AS as_of FROM sold",
        "apply_filters": f"""{FACT} SELECT {_MONEY_FACT} FROM fact
  WHERE CAST(invoice_date AS DATE) BETWEEN DATE '{start}' AND DATE '{end}'
    AND country IN ({_quoted(FILTERS['countries'])}) AND is_merchandise AND NOT is_bulk
    AND customer_id IS NOT NULL""",
        "sales": f"{FACT} SELECT {_MONEY_FACT} FROM fact WHERE line_type = 'sale'",
        "reversals": f"{FACT} SELECT {_MONEY_FACT} FROM fact WHERE line_type <> 'sale'",
        "region_of": f"""{FACT} SELECT country, {_REGION} AS region, count(*) AS lines
  FROM fact GROUP BY 1, 2""",
    }


def _marts() -> dict[str, str]:
    every = "fact"
    return {
        "monthly_kpi": f"""{MONTHLY} SELECT month, month_start, {_round('cash', 2)} AS revenue,
  orders, customers, units, new_customers, customers - new_customers AS returning_customers,
  {_round(_share('cash', 'orders'), 2)} AS aov,
  {_round(_share('cash', 'customers'), 2)} AS revenue_per_customer,
  {_d('lag(cash) OVER w')} AS revenue_prev_month,
  {_d('lag(cash, 12) OVER w')} AS revenue_same_month_last_year
FROM kpi WINDOW w AS (ORDER BY month_start)""",
        "cohort_retention": f"{COHORT} SELECT * FROM retention",
        "cohort_revenue": f"{COHORT} SELECT * FROM earning",
        "rfm": f"{RFM} SELECT * FROM rfm",
        "rfm_segments": f"{RFM} SELECT * FROM segments",
        "country_stats": f"""{_COUNTRY} SELECT country, {_round('cash', 2)} AS revenue,
  {_round(_share('cash', 'sum(cash) OVER ()'), 4)} AS revenue_share, orders, customers,
  {_round(_share('cash', 'orders'), 2)} AS aov, {_round('rate', 4)} AS repeat_rate
FROM ours JOIN again USING (country)""",
        "region_stats": f"""{GOODS} SELECT {_REGION} AS region, month,
  {_round('sum(line_revenue)', 2)} AS revenue, count(DISTINCT invoice_no) AS orders,
  count(DISTINCT customer_id) AS customers FROM sold GROUP BY 1, 2""",
        "product_stats": f"""{GOODS}, item AS (
  SELECT stock_code, sum(line_revenue) AS cash, CAST(sum(quantity) AS BIGINT) AS units,
         count(DISTINCT invoice_no) AS orders, count(DISTINCT customer_id) AS buyers
  FROM sold GROUP BY 1
) SELECT stock_code, description, {_round('cash', 2)} AS revenue,
  {_round(_share('cash', 'sum(cash) OVER ()'), 4)} AS revenue_share, units, orders, buyers,
  {_round(_share('cash', 'units'), 2)} AS avg_unit_price,
  {_round(_share('sum(cash) OVER (ORDER BY cash DESC, stock_code ROWS UNBOUNDED PRECEDING)',
                 'sum(cash) OVER ()'), 4)} AS cum_revenue_share
FROM item JOIN {_usual('sold')} USING (stock_code)""",
        "customer_concentration": f"""{BY_MONEY}, hit AS (
  SELECT min(rank) FILTER (WHERE upto * 2 >= total) AS half,
         min(rank) FILTER (WHERE upto * 5 >= total * 4) AS most, count(*) AS n FROM pareto
) SELECT half AS customers_for_half_of_revenue, most AS customers_for_80_of_revenue,
  n AS total_customers, {_round(_share('half', 'n'), 4)} AS share_for_50pct,
  {_round(_share('most', 'n'), 4)} AS share_for_80pct FROM hit""",
        "purchase_gaps": f"""{GOODS}, g AS (
  SELECT lead(day) OVER (PARTITION BY customer_id ORDER BY day, invoice_no) - day AS gap
  FROM (SELECT DISTINCT customer_id, day, invoice_no FROM known)
) SELECT count(gap) AS gaps_observed, {_round(_share('sum(gap)', 'count(gap)'), 1)} AS avg_gap_days,
  round(quantile_cont({_d('gap')}, 0.25), 1) AS p25_gap_days,
  round(quantile_cont({_d('gap')}, 0.5), 1) AS median_gap_days,
  round(quantile_cont({_d('gap')}, 0.75), 1) AS p75_gap_days,
  {_round(_share('count(*) FILTER (WHERE gap <= 30)', 'count(gap)'), 4)} AS share_gaps_up_to_30d,
  {_round(_share('count(*) FILTER (WHERE gap > 180)', 'count(gap)'), 4)} AS share_gaps_over_180d
FROM g""",
        "weekday_profile": f"""{GOODS} SELECT dayname(day) AS weekday,
  CAST(dayofweek(day) AS BIGINT) AS dow, count(DISTINCT invoice_no) AS orders,
  {_round('sum(line_revenue)', 2)} AS revenue,
  {_round(_share('sum(line_revenue)', 'count(DISTINCT invoice_no)'), 2)} AS aov
FROM sold GROUP BY 1, 2""",
        "reversal_monthly": f"""{FACT}, m AS (
  SELECT month_start, count(*) FILTER (WHERE line_type = 'cancellation') AS cancellation_lines,
    count(*) FILTER (WHERE line_type = 'return') AS return_lines,
    coalesce(sum(line_revenue) FILTER (WHERE line_type <> 'sale'), 0) AS off,
    coalesce(sum(line_revenue) FILTER (WHERE line_type = 'sale' AND is_merchandise), 0) AS cash
  FROM {every} GROUP BY 1
) SELECT strftime(month_start, '%Y-%m') AS month, month_start, cancellation_lines, return_lines,
  {_round('off', 2)} AS reversal_value, {_round('cash', 2)} AS sales_value,
  {_round(_share('-off', 'cash'), 4)} AS reversal_share FROM m""",
        "reversal_breakdown": f"""{FACT} SELECT line_type,
  if(is_merchandise, '{L.goods}', '{L.non_goods}') AS kind, count(*) AS lines,
  {_round('sum(line_revenue)', 2)} AS value FROM fact WHERE line_type <> 'sale' GROUP BY 1, 2""",
        "reversed_products": f"{GOODS} {_REVERSED_TOP % 25}",
        "non_merchandise_breakdown": f"""{FACT}, other AS (SELECT * FROM fact WHERE NOT is_merchandise)
SELECT stock_code, description, lines, value, sales_value FROM (
  SELECT stock_code, count(*) AS lines, {_round('sum(line_revenue)', 2)} AS value,
    {_round("coalesce(sum(line_revenue) FILTER (WHERE line_type = 'sale'), 0)", 2)} AS sales_value
  FROM other GROUP BY 1) JOIN {_usual('other')} USING (stock_code)""",
        "data_quality": f"""{FACT} SELECT count(*) AS lines_total,
  count(DISTINCT invoice_no) AS invoices, count(DISTINCT customer_id) AS customers,
  count_if(line_type = 'cancellation')::BIGINT AS cancellation_lines,
  count_if(line_type = 'return')::BIGINT AS return_lines,
  count_if(NOT is_merchandise)::BIGINT AS non_merchandise_lines,
  count_if(is_guest)::BIGINT AS guest_lines, count_if(is_bulk)::BIGINT AS bulk_lines,
  count_if(description = '{L.no_description}')::BIGINT AS description_missing,
  count_if(country = 'Unspecified')::BIGINT AS country_unspecified,
  CAST(min(invoice_date) AS DATE) AS first_day, CAST(max(invoice_date) AS DATE) AS last_day
FROM fact""",
    }


def _slices() -> dict[str, str]:
    in_countries = f"country IN ({_quoted(COUNTRIES)})"
    start, end = FILTERS["period"]
    in_period = f"day BETWEEN DATE '{start}' AND DATE '{end}'"
    pct = "round({0} * 100, 1)"
    return {
        "summary": f"""{GOODS}, bills AS (
  SELECT invoice_no, sum(line_revenue) AS cash FROM sold GROUP BY 1
), c AS (
  SELECT (SELECT sum(line_revenue) FROM sold) AS cash, (SELECT sum(line_revenue) FROM undone) AS off,
    (SELECT count(*) FROM bills) AS orders, (SELECT count(*) FROM sold) AS lines,
    (SELECT quantile_cont({_d('cash')}, 0.5) FROM bills) AS mid,
    (SELECT count(DISTINCT customer_id) FROM sold) AS customers,
    (SELECT count(*) FROM sold WHERE is_guest) AS guests,
    (SELECT CAST(sum(quantity) AS BIGINT) FROM sold) AS units,
    (SELECT count(*) FROM goods WHERE line_type = 'cancellation') AS cancellations,
    (SELECT count(*) FROM goods WHERE line_type = 'return') AS returns
) SELECT {_d('cash')} AS revenue, {_d('off')} AS reversal_value, {_d('cash + off')} AS net_revenue,
  orders, {_round(_share('cash', 'orders'), 4)} AS aov, round(mid, 4) AS median_order, customers,
  {_round(_share('guests', 'lines'), 4)} AS guest_share, lines, units, cancellations, returns
FROM c""",
        "monthly": _slice_monthly("true"),
        "monthly_in_countries": _slice_monthly(in_countries),
        "monthly_unrestricted": _slice_monthly(in_countries, unrestricted=True),
        "monthly_own_history": _slice_monthly(in_period, own_history=True),
        "monthly_kpi_calendar": f"""{MONTHLY} SELECT k.month, k.month_start,
  {_round('k.cash', 2)} AS revenue, k.orders, k.customers, k.units, k.new_customers,
  k.customers - k.new_customers AS returning_customers,
  {_round(_share('k.cash', 'k.orders'), 2)} AS aov,
  {_round(_share('k.cash', 'k.customers'), 2)} AS revenue_per_customer,
  {_d('p.cash')} AS revenue_prev_month, {_d('y.cash')} AS revenue_same_month_last_year
FROM kpi k LEFT JOIN kpi p ON p.month_start = k.month_start - INTERVAL 1 MONTH
LEFT JOIN kpi y ON y.month_start = k.month_start - INTERVAL 12 MONTH""",
        "country_rollup": f"""{_COUNTRY} SELECT * REPLACE (round(revenue_share, 6) AS revenue_share,
  round(repeat_rate, 6) AS repeat_rate) FROM ({_ROLLUP})""",
        "region_monthly": f"""{GOODS} SELECT {_REGION} AS region, month,
  {_d('sum(line_revenue)')} AS revenue, count(DISTINCT invoice_no) AS orders,
  count(DISTINCT customer_id) AS customers FROM sold GROUP BY 1, 2""",
        "top_products": _top_products("cash"),
        "top_products_by_units": _top_products("units"),
        "top_products_by_orders": _top_products("orders"),
        "cancellations_monthly": f"""{GOODS} SELECT month_start, u.month, cancellations, returns,
  {_d('off')} AS reversal_value, {_d('cash')} AS revenue,
  {_round(_share('-off', 'cash'), 6)} AS share_of_sales
FROM (SELECT month_start, month, count(*) FILTER (WHERE line_type = 'cancellation') AS cancellations,
        count(*) FILTER (WHERE line_type = 'return') AS returns, sum(line_revenue) AS off
      FROM undone GROUP BY 1, 2) u
LEFT JOIN (SELECT month_start, sum(line_revenue) AS cash FROM sold GROUP BY 1) s
  USING (month_start)""",
        "reversal_reasons": f"""{FACT} SELECT
  if(is_merchandise, description, '{L.non_goods_reason}') AS reason,
  {_d('sum(line_revenue)')} AS value, count(*) AS lines
FROM fact WHERE line_type <> 'sale' GROUP BY 1 ORDER BY value, reason LIMIT 12""",
        "customer_revenue": f"""{GOODS} SELECT customer_id, {_d('sum(line_revenue)')} AS revenue,
  count(DISTINCT invoice_no) AS orders, min(invoice_date) AS first_purchase,
  max(invoice_date) AS last_purchase FROM known GROUP BY 1""",
        "pareto": f"{BY_MONEY} {_PARETO}",
        "concentration": f"{BY_MONEY} " + " UNION ALL ".join(
            f"""SELECT {t}::DOUBLE AS target, {_round(_share(
                f'least(count(*) FILTER (WHERE upto < total * {t}) + 1, count(*))', 'count(*)'), 6)}
  AS share_of_customers FROM pareto""" for t in ("0.5", "0.8", "1.0")
        ),
        "purchase_gap_days":
            f"{MOMENT_GAPS} SELECT customer_id, gap_days FROM gaps WHERE gap_days IS NOT NULL",
        "cohort_pivot": _wide("retention"),
        "cohort_pivot_active": _wide("active_customers"),
        "repeat_stats": f"""{GOODS}, p AS (
  SELECT customer_id, count(DISTINCT invoice_date) AS n,
         date_sub('day', min(invoice_date), max(invoice_date)) AS days FROM known GROUP BY 1
) SELECT count(*) AS customers, {_round(_share('count(*) FILTER (WHERE n > 1)', 'count(*)'), 6)}
    AS repeat_rate,
  {_round('1 - ' + _share('count(*) FILTER (WHERE n > 1)', 'count(*)'), 6)} AS one_time_share,
  round(quantile_cont({_d('days')}, 0.5) FILTER (WHERE n > 1), 6) AS median_gap_days,
  round(quantile_cont({_d('days')}, 0.75) FILTER (WHERE n > 1), 6) AS p75_gap_days,
  {_round(_share('sum(n)', 'count(*)'), 6)} AS avg_orders FROM p""",
        "countries_by_revenue": f"""{FACT} SELECT country, {_d('sum(line_revenue)')} AS revenue
FROM fact WHERE line_type = 'sale' GROUP BY 1""",
        "first_month":
            f"{GOODS} SELECT customer_id, min(month_start) AS first_month FROM known GROUP BY 1",
        "net_delta": f"""{GOODS} SELECT {_round(_share(
            'sum(line_revenue)', "sum(line_revenue) FILTER (WHERE line_type = 'sale')")
            + ' - 1', 6)} AS net_delta FROM goods""",
        "top_countries": f"""{_COUNTRY} SELECT country, revenue, orders, customers,
  {pct.format('revenue_share')} AS revenue_share_pct, {pct.format('repeat_rate')} AS repeat_rate_pct
FROM ({_ROLLUP}) ORDER BY revenue DESC, country LIMIT 10""",
        "region_totals": f"""{GOODS}, r AS (
  SELECT {_REGION} AS region, sum(line_revenue) AS cash FROM sold GROUP BY 1
) SELECT region, {_d('cash')} AS revenue,
  {_round(_share('cash', '(SELECT sum(cash) FROM r)'), 6)} AS revenue_share FROM r""",
        "retention_curve": f"""{COHORT} SELECT month_number,
  {_round(_share('sum(CAST(retention AS DECIMAL(18,4)))', 'count(*)'), 6)} AS retention
FROM retention GROUP BY 1""",
        "gap_quantiles": f"""{MOMENT_GAPS} SELECT
  quantile_cont({_d('gap_days')}, 0.5) AS median_gap_days,
  quantile_cont({_d('gap_days')}, 0.75) AS p75_gap_days FROM gaps""",
        "gap_histogram": f"""{MOMENT_GAPS} SELECT
  CAST(least(gap_days, 365) // 8 * 8 AS BIGINT) AS bin_start,
  CAST(least(gap_days, 365) // 8 * 8 + 8 AS BIGINT) AS bin_end, count(*) AS gaps
FROM gaps WHERE gap_days IS NOT NULL GROUP BY 1, 2""",
        "segment_share_long": f"""{RFM}
SELECT segment, 'customers' AS metric, customers_share AS share FROM segments
UNION ALL SELECT segment, 'revenue', revenue_share FROM segments""",
        "rfm_sample": f"""{RFM} SELECT customer_id, recency_days, monetary, segment FROM rfm
ORDER BY md5('7:' || customer_id), customer_id LIMIT {SAMPLE}""",
        "top_reversed": f"{GOODS} {_REVERSED_TOP % 10}",
        "fact_extent": f"""{FACT} SELECT CAST(min(invoice_date) AS DATE) AS first_day,
  CAST(max(invoice_date) AS DATE) AS last_day, count(*) AS lines,
  count(DISTINCT invoice_no) AS invoices FROM fact""",
    }


def _audits() -> dict[str, str]:
    source = "CASE src_ord WHEN 0 THEN 'first' ELSE 'second' END AS source"
    full = "invoice_no, stock_code, description, quantity, invoice_date, unit_price, customer_id, country"
    key = ", ".join(BUSINESS_KEY)
    cents = "CAST(quantity * CAST(round_even(unit_price * 100, 0) / 100 AS DECIMAL(18,2)) AS DECIMAL(18,2))"
    in_window = """CAST(invoice_date AS DATE) BETWEEN
    (SELECT CAST(max(a) AS DATE) FROM span) AND (SELECT CAST(min(b) AS DATE) FROM span)"""
    words = " UNION ALL ".join(f"SELECT '{w}' AS word" for w in PROBE_WORDS)
    raw_nulls, typed_nulls = (
        " UNION ALL ".join(
            f"""SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls,
  {_round(_share(f'(count(*) - count({c})) * 100', 'count(*)'), 1)} AS percent FROM {table}"""
            for c in full.split(", ")
        )
        for table in ("raw", "typed")
    )
    return {
        "source_profile": f"""{RAW_SQL} SELECT {source}, count(*) AS rows,
  min(invoice_date) AS first_moment, max(invoice_date) AS last_moment FROM raw GROUP BY src_ord""",
        "overlap_by_day": f"""{RAW_SQL}, span AS (
  SELECT min(invoice_date) AS a, max(invoice_date) AS b FROM raw GROUP BY src_ord
) SELECT CAST(invoice_date AS DATE) AS day, count(*) AS lines FROM raw WHERE {in_window} GROUP BY 1""",
        "duplicate_counts": f"""{RAW_SQL} SELECT
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT {full} FROM raw))
    AS by_all_columns,
  (SELECT count(*) FROM raw) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM raw))
    AS by_business_key""",
        "conflicting_duplicates": f"""{RAW_SQL} SELECT {full} FROM (
  SELECT *, count(*) OVER (PARTITION BY {key}) AS same_key,
         count(*) OVER (PARTITION BY {full}) AS same_line FROM raw)
WHERE same_key > 1 AND same_line = 1""",
        "negative_split": f"""{RAW_SQL} SELECT count(*) FILTER (WHERE quantity < 0) AS negative_lines,
  count(*) FILTER (WHERE quantity < 0 AND invoice_no LIKE 'C%') AS in_cancelled_invoices,
  count(*) FILTER (WHERE quantity < 0 AND invoice_no NOT LIKE 'C%') AS in_normal_invoices,
  count(*) FILTER (WHERE invoice_no LIKE 'C%') AS cancelled_lines FROM raw""",
        "positive_cancellations": f"""{RAW_SQL} SELECT invoice_no, stock_code, description, quantity,
  unit_price FROM raw WHERE invoice_no LIKE 'C%' AND quantity > 0""",
        "return_price_audit": f"""{RAW_SQL} SELECT count(*) AS return_lines,
  count(*) FILTER (WHERE unit_price = 0) AS zero_price_lines,
  {_d(f'sum({cents})')} AS value, CAST(sum(quantity) AS BIGINT) AS units
FROM raw WHERE quantity < 0 AND invoice_no NOT LIKE 'C%'""",
        "nonstandard_codes": rf"""{RAW_SQL}, odd AS (
  SELECT *, {cents} AS cents FROM raw WHERE NOT regexp_matches(stock_code, '^\d{{5,6}}$')
), named AS (SELECT * FROM odd WHERE description IS NOT NULL)
SELECT stock_code, lines, coalesce(description, '-') AS description, {_d('amount')} AS amount
FROM (SELECT stock_code, count(*) AS lines, sum(cents) AS amount FROM odd GROUP BY 1
      ORDER BY amount, stock_code LIMIT 14)
LEFT JOIN {_usual('named')} USING (stock_code)""",
        "word_audit": f"""{RAW_SQL}, probe AS ({words}), hit AS (
  SELECT word, description, count(*) AS n
  FROM probe JOIN raw ON contains(lower(description), word) GROUP BY 1, 2
), best AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY n DESC, description) AS place,
         sum(n) OVER (PARTITION BY word) AS total FROM hit QUALIFY place <= 2
) SELECT word, CAST(coalesce(total, 0) AS BIGINT) AS lines, CAST(place AS INTEGER) AS place,
  description, n AS description_lines FROM probe LEFT JOIN best USING (word)""",
        "numeric_descriptions":
            rf"{RAW_SQL} SELECT {full} FROM raw WHERE regexp_matches(description, '^\d+$')",
        "null_profile": f"{RAW_SQL} SELECT * FROM ({raw_nulls}) WHERE nulls > 0",
        "null_profile_typed": f"{TYPED} SELECT * FROM ({typed_nulls}) WHERE nulls > 0",
        "country_audit": f"""{RAW_SQL} SELECT country, count(*) AS lines,
  (SELECT count(DISTINCT country) FROM raw) AS countries_in_feed
FROM raw WHERE country IN ('OLD_2', 'NATION_0', 'Unspecified') GROUP BY 1""",
        "code_type_profile": rf"""{RAW_SQL} SELECT
  count(*) FILTER (WHERE regexp_matches(invoice_no, '^\d+$')) AS numeric_invoices,
  count(*) FILTER (WHERE NOT regexp_matches(invoice_no, '^\d+$')) AS text_invoices,
  count(*) FILTER (WHERE regexp_matches(stock_code, '^\d+$')) AS numeric_codes,
  count(*) FILTER (WHERE NOT regexp_matches(stock_code, '^\d+$')) AS text_codes,
  count(*) FILTER (WHERE stock_code <> upper(stock_code)) AS codes_not_upper FROM raw""",
        "price_noise": f"""{RAW_SQL}, noisy AS (
  SELECT unit_price FROM raw WHERE unit_price <> round_even(unit_price * 100, 0) / 100
) SELECT count(*) AS noisy_lines, min(unit_price) AS example_price FROM noisy""",
        "before_after": f"""{FACT} SELECT 'raw' AS state, count(*) AS lines,
  {_d(f'sum({cents})')} AS revenue, count(DISTINCT invoice_no) AS invoices,
  count(DISTINCT TRY_CAST(customer_id AS BIGINT)) AS customers,
  CAST(min(invoice_date) AS DATE) AS first_day, CAST(max(invoice_date) AS DATE) AS last_day FROM raw
UNION ALL SELECT 'cleaned', count(*),
  {_d("sum(line_revenue) FILTER (WHERE is_merchandise AND line_type = 'sale')")},
  count(DISTINCT invoice_no), count(DISTINCT customer_id),
  CAST(min(invoice_date) AS DATE), CAST(max(invoice_date) AS DATE) FROM fact""",
    }


def _matched(days: int) -> str:
    return f"""{FACT}, undo AS (
  SELECT customer_id, stock_code, abs(quantity) AS units, invoice_date AS cancelled_at,
         max(invoice_no) AS cancellation_no, count(*) AS cancelled_lines
  FROM fact WHERE line_type = 'cancellation' AND quantity < 0 AND customer_id IS NOT NULL
  GROUP BY ALL
) SELECT customer_id, stock_code, units, cancellation_no, cancelled_at, cancelled_lines,
  invoice_no AS sale_no, invoice_date AS sold_at,
  date_sub('minute', invoice_date, cancelled_at) AS minutes
FROM (SELECT u.*, f.invoice_no, f.invoice_date, row_number() OVER (
        PARTITION BY u.customer_id, u.stock_code, u.units, u.cancelled_at
        ORDER BY f.invoice_date DESC, f.invoice_no DESC) AS nth
      FROM undo u JOIN fact f ON f.customer_id = u.customer_id AND f.stock_code = u.stock_code
        AND f.quantity = u.units AND f.line_type = 'sale' AND f.invoice_date <= u.cancelled_at
        AND f.invoice_date >= u.cancelled_at - INTERVAL {days} DAY)
WHERE nth = 1"""


def _region_yoy(cutoff: str | None) -> str:
    old, new = YEARS
    until = f"AND strftime(day, '%m-%d') <= '{cutoff}'" if cutoff else ""
    by_year = ", ".join(
        f"""{_d(f'sum(line_revenue) FILTER (WHERE year(day) = {y})')} AS revenue_{when},
  count(DISTINCT invoice_no) FILTER (WHERE year(day) = {y}) AS orders_{when}"""
        for when, y in (("earlier", old), ("later", new))
    )
    return f"""{GOODS}, t AS (
  SELECT {_REGION} AS region, {by_year} FROM sold WHERE year(day) IN ({old}, {new}) {until} GROUP BY 1
) SELECT region, revenue_earlier, revenue_later, orders_earlier, orders_later,
  round((revenue_later / revenue_earlier - 1) * 100, 1) AS revenue_change_pct,
  round(({_d('orders_later')} / orders_earlier - 1) * 100, 1) AS orders_change_pct,
  round(((revenue_later / orders_later) / (revenue_earlier / orders_earlier) - 1) * 100, 1)
    AS aov_change_pct FROM t"""


def _reports() -> dict[str, str]:
    return {
        "yearly_totals": f"""{MONTHLY} SELECT left(month, 4) AS year,
  {_d('sum(cash)')} AS revenue, CAST(sum(orders) AS BIGINT) AS orders,
  CAST(sum(new_customers) AS BIGINT) AS new_customers,
  CAST(sum(customers - new_customers) AS BIGINT) AS returning_customers FROM kpi GROUP BY 1""",
        "year_over_year": _years(None),
        "year_over_year_cutoff": _years(CUTOFF),
        "cohort_revenue_curve": f"""{COHORT} SELECT month_number,
  {_round(_share('sum(CAST(revenue_share AS DECIMAL(18,4)))', 'count(*)'), 4)} AS revenue_share
FROM earning WHERE month_number < 24 GROUP BY 1""",
        "pareto_head": f"{BY_MONEY} {_PARETO} WHERE rank <= 8",
        "matched_cancellations": _matched(MATCH_DAYS),
        "matched_cancellations_one_day": _matched(1),
        "score_group_sizes": f"{RFM} SELECT f_score, count(*) AS customers FROM rfm GROUP BY 1",
        "customer_coverage": f"""{FACT}, p AS (
  SELECT customer_id, count(*) FILTER (WHERE is_merchandise AND line_type = 'sale') AS goods_sales,
         count(*) FILTER (WHERE is_merchandise) AS goods_lines,
         count(*) FILTER (WHERE line_type = 'sale') AS sale_lines
  FROM fact WHERE customer_id IS NOT NULL GROUP BY 1
) SELECT count(*) AS customers, count(*) FILTER (WHERE goods_sales > 0) AS with_goods_sales,
  count(*) FILTER (WHERE goods_sales = 0) AS without_goods_sales,
  count(*) FILTER (WHERE goods_lines = 0) AS only_non_goods,
  count(*) FILTER (WHERE sale_lines = 0) AS only_reversals FROM p""",
        "region_yoy": _region_yoy(None),
        "region_yoy_cutoff": _region_yoy(CUTOFF),
    }


def _wide(value: str) -> str:
    """Cells as columns, one per month from 0 to the declared last month."""
    months = ", ".join(
        f"max({value}) FILTER (WHERE month_number = {n}) AS m{n:02d}" for n in range(LAST_MONTH + 1)
    )
    return f"{COHORT} SELECT cohort, {months} FROM retention GROUP BY cohort"


#: columns of the marts in the order of their names; ``:d`` marks doubles
MART_FIELDS = {
    "monthly_kpi": (
        "aov:d customers month month_start new_customers orders returning_customers "
        "revenue:d revenue_per_customer:d revenue_prev_month:d "
        "revenue_same_month_last_year:d units"
    ),
    "cohort_retention": "active_customers cohort cohort_month cohort_size month_number retention:d",
    "cohort_revenue": "cohort month_number revenue:d revenue_share:d",
    "rfm": (
        "avg_order_value:d customer_id f_score first_purchase frequency last_purchase "
        "m_score monetary:d r_score recency_days rfm_score segment"
    ),
    "rfm_segments": (
        "avg_orders:d avg_recency_days:d avg_revenue_per_customer:d customers "
        "customers_share:d revenue:d revenue_share:d segment"
    ),
    "country_stats": "aov:d country customers orders repeat_rate:d revenue:d revenue_share:d",
    "region_stats": "customers month orders region revenue:d",
    "product_stats": (
        "avg_unit_price:d buyers cum_revenue_share:d description orders revenue:d "
        "revenue_share:d stock_code units"
    ),
    "customer_concentration": (
        "customers_for_80_of_revenue customers_for_half_of_revenue share_for_50pct:d "
        "share_for_80pct:d total_customers"
    ),
    "purchase_gaps": (
        "avg_gap_days:d gaps_observed median_gap_days:d p25_gap_days:d p75_gap_days:d "
        "share_gaps_over_180d:d share_gaps_up_to_30d:d"
    ),
    "weekday_profile": "aov:d dow orders revenue:d weekday",
    "reversal_monthly": (
        "cancellation_lines month month_start return_lines reversal_share:d "
        "reversal_value:d sales_value:d"
    ),
    "reversal_breakdown": "kind line_type lines value:d",
    "reversed_products": "description reversal_lines reversal_value:d stock_code units_back",
    "non_merchandise_breakdown": "description lines sales_value:d stock_code value:d",
    "data_quality": (
        "bulk_lines cancellation_lines country_unspecified customers description_missing "
        "first_day guest_lines invoices last_day lines_total non_merchandise_lines "
        "return_lines"
    ),
}


def _as_text(mart: str) -> str:
    """One text per row, as ``queries.as_text`` writes it."""
    parts = []
    for field in MART_FIELDS[mart].split():
        name, _, double = field.partition(":")
        value = f'CAST("{name}" AS DECIMAL(38,4))' if double else f'"{name}"'
        parts.append(f"coalesce(CAST({value} AS VARCHAR), '~')")
    return f"concat_ws('|', {', '.join(parts)})"


def all_sql() -> dict[str, str]:
    groups = (_cleaning(), _base(), _marts(), _slices(), _audits(), _reports())
    found = {name: f"WITH {sql}" for group in groups for name, sql in group.items()}
    # a fact that grew source by source is the fact of one run
    found["clean_fact_appended"] = found["clean_fact"]
    found["change_log_appended"] = found["dq_change_log"]
    found["write_marts"] = " UNION ALL ".join(
        f"SELECT '{name}' AS mart, {_as_text(name)} AS row FROM ({found[name]})" for name in _marts()
    )
    return found
