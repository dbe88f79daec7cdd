"""The SQL that DuckDB runs on the same tables, one text per registered query."""

from __future__ import annotations

# Names and labels of the columns, as the library has them.
BUCKETS = ["No Discount", "Low (1–5%)", "Mid (6–10%)", "High (11–15%)"]
CATEGORIES = ["Region", "Product", "CustomerType", "PaymentMethod", "Promotion",
              "StoreLocation", "Salesperson", "RegionManager"]
PROFILED = ["Quantity", "UnitPrice", "TotalPrice", "ShippingCost", "DeliveryDays"]
CORRELATED = ["Quantity", "UnitPrice", "Discount", "TotalPrice", "ShippingCost",
              "DeliveryDays", "Returned"]
RECONCILED = ["Region", "Product", "CustomerType", "PaymentMethod", "Promotion",
              "Salesperson", "Year"]
RAW = ["OrderID", "Date", "OrderDate", "DeliveryDate", "Region", "Product", "CustomerType",
       "PaymentMethod", "Promotion", "StoreLocation", "Salesperson", "RegionManager",
       "Quantity", "UnitPrice", "Discount", "TotalPrice", "ShippingCost", "Returned"]
DERIVED = ["DeliveryDays", "CalcRevenue", "Year", "Month", "Quarter", "YearMonth",
           "NetRevenue", "GrossProfit", "DiscountBucket"]
TYPES = {"OrderID": "bigint", **dict.fromkeys(["Date", "OrderDate", "DeliveryDate"], "timestamp_ntz"),
         **dict.fromkeys(["Quantity", "UnitPrice", "Discount", "TotalPrice", "ShippingCost",
                          "CalcRevenue", "NetRevenue", "GrossProfit"], "double"),
         **dict.fromkeys(["Returned", "DeliveryDays", "Year", "Month", "Quarter"], "int")}
CODED = ["Region", "Product", "CustomerType", "PaymentMethod", "Promotion", "StoreLocation",
         "Salesperson", "DiscountBucket"]
SCALED = ["Quantity", "UnitPrice", "Discount", "ShippingCost", "DeliveryDays"]
PRODUCTS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

SALES = f"""
WITH raw AS (
  SELECT l.l_orderkey AS "OrderID", o.o_orderdate AS "Date", o.o_orderdate AS "OrderDate",
    l.l_shipdate AS "DeliveryDate", r.r_name AS "Region", p.p_type AS "Product",
    l.l_linestatus AS "CustomerType", c.c_mktsegment AS "PaymentMethod",
    nullif(o.o_orderpriority, '4-NOT SPECIFIED') AS "Promotion", n.n_name AS "StoreLocation",
    s.s_name AS "Salesperson", sr.r_name AS "RegionManager", l.l_quantity AS "Quantity",
    l.l_extendedprice / nullif(l.l_quantity, 0) AS "UnitPrice", l.l_discount AS "Discount",
    l.l_extendedprice * (1 - l.l_discount) AS "TotalPrice",
    l.l_extendedprice * l.l_tax AS "ShippingCost",
    CAST(l.l_returnflag = 'R' AS INTEGER) AS "Returned"
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation sn ON s.s_nationkey = sn.n_nationkey
  LEFT JOIN region sr ON sn.n_regionkey = sr.r_regionkey
), rawplus AS (
  SELECT *, CAST(floor((epoch_us("DeliveryDate") - epoch_us("OrderDate")) / 86400000000.0)
      AS INTEGER) AS "DeliveryDays",
    "Quantity" * "UnitPrice" * (1 - "Discount") AS "CalcRevenue",
    CAST(year("Date") AS INTEGER) AS "Year", CAST(month("Date") AS INTEGER) AS "Month",
    CAST(quarter("Date") AS INTEGER) AS "Quarter", strftime("Date", '%Y-%m') AS "YearMonth",
    "TotalPrice" * (1 - "Returned") AS "NetRevenue",
    "TotalPrice" * (1 - "Returned") - "ShippingCost" AS "GrossProfit",
    CASE WHEN "Discount" = 0 THEN '{BUCKETS[0]}' WHEN "Discount" <= 0.05 THEN '{BUCKETS[1]}'
      WHEN "Discount" <= 0.10 THEN '{BUCKETS[2]}' ELSE '{BUCKETS[3]}' END AS "DiscountBucket"
  FROM raw
), sales AS (
  SELECT * REPLACE (coalesce("Promotion", 'No Promotion') AS "Promotion") FROM rawplus
)"""

RATE = 'avg("Returned") * 100'


def with_sales(body: str, more: str = "") -> str:
    return f"{SALES}{', ' + more if more else ''} {body}"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def report(key: str, *columns: str) -> str:
    return with_sales(f'SELECT "{key}", {", ".join(columns)} FROM sales GROUP BY "{key}"')


ORDERS = 'count("OrderID") AS orders'
GROSS = 'round_even(sum("TotalPrice"), 4) AS gross_revenue'
NET = 'round_even(sum("NetRevenue"), 4) AS net_revenue'
AOV = 'round_even(avg("TotalPrice"), 4) AS avg_order_value'
ONCE = 'round_even(avg("Returned") * 100, 1) AS return_rate'
TWICE = 'round_even(round_even(avg("Returned"), 2) * 100, 1) AS return_rate'


def levels(dims: list[str]) -> str:
    """CTE body: one row per dimension and level."""
    return union([f"""SELECT '{d}' AS dim, CAST("{d}" AS VARCHAR) AS level, count(*) AS lines,
        sum("TotalPrice") AS revenue, count("Returned") AS rated,
        CAST(sum("Returned") AS BIGINT) AS returned, avg("Discount") AS avg_discount,
        avg("DeliveryDays") AS avg_days FROM sales GROUP BY "{d}" """ for d in dims])


def filled(keys: list[str]) -> str:
    """CTEs `m` (sparse months) and `f` (filled months) per group."""
    k = "".join(f'"{c}", ' for c in keys)
    on = "".join(f's."{c}" IS NOT DISTINCT FROM m."{c}" AND ' for c in keys)
    part = "PARTITION BY " + ", ".join(f'"{c}"' for c in keys) if keys else ""
    group = "GROUP BY " + ", ".join(f'"{c}"' for c in keys) if keys else ""
    sk = "".join(f's."{c}", ' for c in keys)
    return f"""m AS (SELECT {k}date_trunc('month', "Date")::DATE AS month,
        sum("TotalPrice") AS revenue, count(*) AS lines FROM sales GROUP BY ALL),
      s AS (SELECT {k}unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE
        AS month FROM m {group}),
      f AS (SELECT {k}last_day(month) AS ds,
        CAST(datediff('month', min(month) OVER ({part}), month) AS INTEGER) AS x, y
        FROM (SELECT {sk}s.month, coalesce(m.revenue, 0) AS y
              FROM s LEFT JOIN m ON {on} s.month = m.month))"""


def fit(keys: list[str]) -> str:
    k = "".join(f'"{c}", ' for c in keys)
    group = "GROUP BY " + ", ".join(f'"{c}"' for c in keys) if keys else ""
    return filled(keys) + f""", g AS (SELECT {k}count(*) AS n,
        CASE WHEN count(*) > 1 THEN regr_slope(y, x) END AS slope,
        CASE WHEN count(*) > 1 THEN regr_intercept(y, x) END AS intercept,
        regr_sxy(y, x) / nullif(sqrt(regr_sxx(y, x) * regr_syy(y, x)), 0) AS r,
        CASE WHEN regr_syy(y, x) > 0 THEN regr_r2(y, x) END AS r2,
        regr_sxx(y, x) AS sxx, avg(x) AS x_mean, min(ds) AS first_ds, max(ds) AS last_ds,
        sqrt(greatest(regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x), 0)
          / greatest(1, count(*) - 2)) AS sigma FROM f {group}),
      fc AS (SELECT {k}k AS step, last_day(last_ds + to_months(CAST(k AS INTEGER))) AS ds,
        n - 1 + k AS x, intercept + slope * (n - 1 + k) AS yhat,
        1.96 * sigma * sqrt(1 + 1.0 / n + pow(n - 1 + k - x_mean, 2) / nullif(sxx, 0)) AS band,
        r2, coalesce(r2 >= 0.15, false) AS usable_trend FROM g, range(1, 7) t(k))"""


def trend_fit(keys: list[str]) -> str:
    k = "".join(f'"{c}", ' for c in keys)
    return with_sales(f"""SELECT {k}n, round(slope, 2) AS slope, round(intercept, 2) AS intercept,
        round(r, 6) AS r, round(r2, 6) AS r2, round(sxx, 2) AS sxx, round(x_mean, 2) AS x_mean,
        strftime(first_ds, '%Y-%m-%d') AS first_ds, strftime(last_ds, '%Y-%m-%d') AS last_ds,
        round(sigma, 2) AS sigma, n < 2 AS too_short,
        coalesce(r2 >= 0.15, false) AS usable_trend FROM g""", fit(keys))


def trend_forecast(keys: list[str]) -> str:
    k = "".join(f'"{c}", ' for c in keys)
    return with_sales(f"""SELECT {k}CAST(step AS INTEGER) AS step,
        strftime(ds, '%Y-%m-%d') AS ds, x, round(yhat, 2) AS yhat, round(band, 2) AS band,
        round(yhat - band, 2) AS low, round(yhat + band, 2) AS high, round(r2, 6) AS r2,
        usable_trend FROM fc""", fit(keys))


LNP = "-x + (a + k) * ln(x) - lgamma(a + k + 1)"


def chi2(dims: list[str]) -> str:
    """CTEs `lv`, `tot` and `chi` with the test of every dimension."""
    return f"""lv AS ({levels(dims)}),
      tot AS (SELECT dim, sum(rated) AS n, sum(returned) AS r, count(*) AS k FROM lv
        WHERE level IS NOT NULL GROUP BY dim),
      cell AS (SELECT lv.dim, k, rated, returned AS o, rated * r / n AS e, r, n FROM lv
          JOIN tot USING (dim) WHERE level IS NOT NULL
        UNION ALL SELECT lv.dim, k, rated, rated - returned, rated * (n - r) / n, r, n FROM lv
          JOIN tot USING (dim) WHERE level IS NOT NULL),
      stat AS (SELECT dim, max(k) - 1 AS dof, CASE WHEN max(r) = 0 OR max(r) = max(n) THEN NULL
          WHEN max(k) = 1 THEN 0 ELSE sum(pow(CASE WHEN k = 2
          THEN greatest(abs(o - e) - 0.5, 0) ELSE abs(o - e) END, 2) / nullif(e, 0)) END AS chi2
        FROM cell GROUP BY dim),
      chi AS (SELECT dim, dof, chi2, CASE WHEN chi2 IS NULL THEN NULL
          WHEN dof = 0 OR chi2 = 0 THEN 1
          ELSE greatest(0, 1 - (SELECT sum(exp({LNP})) FROM range(0, 3000) t(k),
            (SELECT chi2 / 2 AS x, dof / 2.0 AS a))) END AS p_value FROM stat)"""


LIKE = """base AS (SELECT "Year" AS y, "Month" AS m, sum("TotalPrice") AS revenue,
      max("Date") AS last_date FROM sales GROUP BY ALL),
    edge AS (SELECT y AS ly, m AS lm, last_date AS ld FROM base ORDER BY last_date DESC LIMIT 1),
    cut AS (SELECT *, {cutoff} AS c FROM edge),
    ll AS (SELECT sum(revenue) FILTER (y = ly AND m <= c) AS current,
      sum(revenue) FILTER (y = ly - 1 AND m <= c) AS previous,
      sum(revenue) FILTER (y = (SELECT max(y) FROM base, edge WHERE y < ly)) AS previous_full,
      sum(revenue) FILTER (y = ly) AS part, max(ly) AS year, max(lm) AS last_month, max(ld) AS last_date, max(c) AS months_compared
      FROM base, cut),
    lfl AS (SELECT *, (current / previous - 1) * 100 AS change_pct,
      (part / previous_full - 1) * 100 AS apparent_pct,
      current * 12.0 / months_compared AS annualised,
      (current * 12.0 / months_compared / previous_full - 1) * 100 AS annualised_pct FROM ll)"""

YEAR_TEXT = """concat('Data ends on ', strftime(last_date, '%Y-%m-%d'), '; ', year, ' has ',
    last_month, ' months. Against the whole earlier year it looks like ',
    printf('%+.1f%%', apparent_pct), ', over the first ', months_compared,
    ' months of both years it is ', printf('%+.1f%%', change_pct),
    '; a full year at this pace is $', format('{:,d}', CAST(round_even(annualised, 0) AS BIGINT)),
    '.')"""


def like_for_like(cutoff: str, text: bool = False) -> str:
    extra = f", {YEAR_TEXT} AS text" if text else ""
    return with_sales(f"""SELECT round(current, 4) AS current, round(previous, 4) AS previous,
      round(previous_full, 4) AS previous_full, year, last_month,
      strftime(last_date, '%Y-%m-%d') AS last_date, CAST(months_compared AS INTEGER)
      AS months_compared, round(change_pct, 4) AS change_pct,
      round(apparent_pct, 4) AS apparent_pct, round(annualised, 4) AS annualised,
      round(annualised_pct, 4) AS annualised_pct{extra} FROM lfl""",
                      LIKE.format(cutoff=cutoff))


NOTE_RETURNS = chi2(["Product", "Region", "Salesperson"]) + """,
    pr AS (SELECT *, returned * 100.0 / rated AS rate FROM lv WHERE dim = 'Product'),
    rn AS (SELECT min(rate) AS min_rate, max(rate) AS max_rate,
      CAST(floor(avg(lines)) AS BIGINT) AS lines_per_level,
      (SELECT level FROM pr ORDER BY rate DESC, level LIMIT 1) AS highest_level,
      max(rate) - min(rate) AS spread,
      (SELECT p_value FROM chi WHERE dim = 'Product') AS p_product,
      (SELECT p_value FROM chi WHERE dim = 'Region') AS p_region,
      (SELECT p_value FROM chi WHERE dim = 'Salesperson') AS p_salesperson FROM pr),
    rnt AS (SELECT *, concat('Product return rates run from ', printf('%.1f%%', min_rate), ' to ',
      printf('%.1f%%', max_rate), printf(' (%.1f points) with about ', spread), lines_per_level,
      ' rows per level; highest is ', highest_level, '. Chi-square: Product p = ',
      printf('%.2f', p_product), ', Region p = ', printf('%.2f', p_region),
      ', Salesperson p = ', printf('%.2f', p_salesperson),
      '; below 0.05 would be a real difference.') AS text FROM rn)"""

PROMO = """pc AS (SELECT "Promotion" AS promotion, count(*) AS lines,
      avg("Discount") * 100 AS avg_discount_pct, count(*) FILTER ("Discount" = 0) AS undiscounted
      FROM sales WHERE "Promotion" <> 'No Promotion' GROUP BY 1
      UNION ALL SELECT '(all)', count(*), avg("Discount") * 100,
      count(*) FILTER ("Discount" = 0) FROM sales WHERE "Promotion" <> 'No Promotion'),
    pn AS (SELECT *, undiscounted * 100.0 / lines AS undiscounted_pct, concat(promotion, ': ',
      printf('%.1f%%', avg_discount_pct), ' average discount, ', undiscounted, ' of ', lines,
      ' rows without any.') AS text FROM pc)"""

CHECKS = f"""one AS (SELECT count(*) AS n, sum("TotalPrice") AS total,
      max(abs("CalcRevenue" - "TotalPrice")) AS max_diff,
      count(*) FILTER ("Promotion" IS NULL) AS no_promo,
      count(*) FILTER ("DeliveryDate" < "OrderDate") AS early,
      min("DeliveryDays") AS lead_min, max("DeliveryDays") AS lead_max,
      avg("DeliveryDays") AS lead_mean,
      count(*) FILTER ("TotalPrice" <= 0) AS bad_price,
      count(*) FILTER ("Discount" IS NULL) AS no_discount FROM rawplus),
    cover AS ({union([f'''SELECT {i} AS i, '{d}' AS dim, abs(coalesce(sum("TotalPrice")
        FILTER ("{d}" IS NOT NULL), 0) - sum("TotalPrice")) AS delta FROM rawplus'''
                      for i, d in enumerate(RECONCILED)])}),
    dup AS (SELECT count(*) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM rawplus))
      AS kept, count(DISTINCT "OrderID") AS keys FROM rawplus),
    {filled([])},
    gap AS (SELECT count(*) FILTER (m.month IS NOT NULL) AS seen,
      strftime(min(s.month), '%Y-%m') AS first, strftime(max(s.month), '%Y-%m') AS last,
      count(*) FILTER (m.month IS NULL) AS gaps,
      string_agg(CASE WHEN m.month IS NULL THEN strftime(s.month, '%Y-%m') END, ', '
        ORDER BY s.month) AS missing FROM s LEFT JOIN m ON s.month = m.month),
    size AS ({union([f'''SELECT '{d}' AS dim, min(c) AS lo, max(c) AS hi FROM (SELECT count(*) AS c
        FROM rawplus WHERE "{d}" IS NOT NULL GROUP BY "{d}")''' for d in ("Product", "Region")])}),
    vol AS (SELECT max(hi * 1.0 / lo) AS ratio,
      string_agg(concat(dim, ' ', lo, '-', hi), ', ' ORDER BY dim) AS detail FROM size),
    checks AS (
      SELECT 'no_duplicates' AS "check", 'Orders are unique' AS label,
        CASE WHEN total_rows = kept AND total_rows = keys THEN 'pass' ELSE 'fail' END AS status,
        CAST(greatest(total_rows - keys, total_rows - kept) AS DOUBLE) AS observed, 0.0::DOUBLE
        AS threshold, concat(total_rows, ' rows, ', keys, ' keys, ', total_rows - kept,
        ' duplicate rows') AS detail FROM dup
      UNION ALL SELECT 'revenue_arithmetic', 'Revenue follows from its factors',
        CASE WHEN max_diff < 0.01 THEN 'pass' ELSE 'fail' END, max_diff, 0.01,
        concat('largest difference ', printf('%.4f', max_diff), ' over ', n, ' rows') FROM one
      UNION ALL SELECT 'promotion_complete', 'Every row has a promotion',
        CASE WHEN no_promo = 0 THEN 'pass' ELSE 'fail' END, no_promo, 0,
        concat(no_promo, ' of ', n, ' rows without a promotion') FROM one
      UNION ALL SELECT 'delivery_after_order', 'Nothing is delivered before it is ordered',
        CASE WHEN early = 0 THEN 'pass' ELSE 'fail' END, early, 0,
        concat(early, ' delivered before ordered; lead time ', lead_min, ' to ', lead_max,
        ' days, ', printf('%.2f', lead_mean), ' on average') FROM one
      UNION ALL SELECT 'breakdowns_cover_total', 'Known groups hold all revenue',
        CASE WHEN max(delta) < 0.01 THEN 'pass' ELSE 'fail' END, max(delta), 0.01,
        coalesce(string_agg(CASE WHEN delta >= 0.01 THEN dim END, ', ' ORDER BY i), '') FROM cover
      UNION ALL SELECT 'positive_price', 'No row with a price of zero or less',
        CASE WHEN bad_price = 0 THEN 'pass' ELSE 'fail' END, bad_price, 0,
        concat(bad_price, ' rows') FROM one
      UNION ALL SELECT 'discount_known', 'Every row has a discount',
        CASE WHEN no_discount = 0 THEN 'pass' ELSE 'fail' END, no_discount, 0,
        concat(no_discount, ' rows without one') FROM one
      UNION ALL SELECT 'months_without_gap', 'Every month has sales',
        CASE WHEN gaps = 0 THEN 'pass' ELSE 'warn' END, gaps, 0,
        CASE WHEN gaps = 0 THEN concat(seen, ' consecutive months, ', first, ' to ', last)
        ELSE concat('missing: ', missing) END FROM gap
      UNION ALL SELECT 'comparable_volume', 'Groups are of similar size',
        CASE WHEN ratio <= 2 THEN 'pass' ELSE 'warn' END, ratio, 2, detail FROM vol)"""


def wide_sum(row: str, column: str, values: list[str], cell: str) -> str:
    cells = ", ".join(
        [f'{cell.format(f"""FILTER ("{column}" = '{v}')""")} AS "{v}"' for v in values]
        + [f'{cell.format(f"""FILTER ("{column}" IS NULL)""")} AS "null"'])
    return with_sales(f'SELECT "{row}", {cells} FROM sales GROUP BY "{row}"')


def confusion_ctes() -> str:
    return """g AS (SELECT "Returned" AS label, CAST("Discount" >= 0.08 AS INTEGER) AS prediction
        FROM sales),
      k AS (SELECT unnest([0, 1]) AS c),
      pc AS (SELECT c, (SELECT count(*) FROM g WHERE label = c AND prediction = c) AS hit,
        (SELECT count(*) FROM g WHERE prediction = c) AS pred,
        (SELECT count(*) FROM g WHERE label = c) AS support FROM k),
      pr AS (SELECT c, support, coalesce(hit * 1.0 / nullif(pred, 0), 0) AS p,
        coalesce(hit * 1.0 / nullif(support, 0), 0) AS r FROM pc),
      pf AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM pr)"""


def auc(score: str, by: str | None) -> str:
    k = f'"{by}", ' if by else ""
    part = f'PARTITION BY "{by}"' if by else ""
    group = f'GROUP BY "{by}"' if by else ""
    return with_sales(f"""SELECT {k}CAST(sum(p) AS BIGINT) AS positives,
        CAST(sum(q) AS BIGINT) AS negatives,
        round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 9) AS auc FROM c {group}""", f"""
      b AS (SELECT {k}"{score}" AS v, sum("Returned") AS p, sum(1 - "Returned") AS q
        FROM sales GROUP BY ALL),
      c AS (SELECT *, coalesce(sum(q) OVER ({part} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS below FROM b)""")


def roundtrip() -> str:
    return with_sales("SELECT * FROM t", "a AS (SELECT count(*) AS n, round(sum(\"TotalPrice\"), 1)"
                      " AS t FROM sales), t AS (" + union(
        ["SELECT 'rows' AS item, CAST(n AS DOUBLE) AS expected, CAST(n AS DOUBLE) AS found, "
         "'OK' AS status FROM a",
         "SELECT 'promotion_nulls', 0, 0, 'OK'",
         *[f"SELECT 'total_by_{c}', t, t, 'OK' FROM a"
           for c in ("Region", "Product", "CustomerType", "Promotion")],
         "SELECT 'arithmetic_difference', 0, 0, 'OK'"]) + ")")


def all_sql() -> dict[str, str]:
    spread_levels = levels(RECONCILED)
    chart_dims = RECONCILED[:6]
    q: dict[str, str] = {}
    q["null_normalize_fill"] = """SELECT CASE WHEN o_orderpriority = '4-NOT SPECIFIED'
        THEN 'No Promotion' ELSE o_orderpriority END AS promotion, count(*) AS orders,
        count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS filled FROM orders GROUP BY 1"""
    q["csv_roundtrip"] = q["parquet_roundtrip"] = roundtrip()
    q["derive_features"] = with_sales("""SELECT "OrderID" AS order_id, "Promotion" AS promotion,
        "DeliveryDays" AS delivery_days, round("UnitPrice", 8) AS unit_price,
        round("CalcRevenue", 4) AS calc_revenue, "Year" AS year, "Month" AS month,
        "Quarter" AS quarter, "YearMonth" AS year_month, round("NetRevenue", 4) AS net_revenue,
        round("GrossProfit", 4) AS gross_profit, "DiscountBucket" AS bucket,
        CASE WHEN "Month" <= 6 THEN 'H1' ELSE 'H2' END AS half,
        concat("Year", ' Q', "Quarter") AS year_quarter,
        round("Quantity" * "UnitPrice" * "Discount", 4) AS discount_given FROM sales""")
    raw_rows = ", ".join(f'"{c}"' for c in RAW)
    q["dedupe_rows"] = with_sales(f"""SELECT strftime("Date", '%Y-%m-%d %H:%M:%S') AS "Date",
        "Region", "Product", coalesce("Promotion", 'No Promotion') AS "Promotion",
        count(*) AS whole_rows FROM (SELECT DISTINCT {raw_rows} FROM raw) GROUP BY ALL""")
    q["cleaning_path"] = with_sales(union([f"""SELECT '{name}' AS source, "YearMonth", "Promotion",
        "DiscountBucket", count(*) AS lines, CAST(sum("Returned") AS BIGINT) AS returned,
        CAST(sum("DeliveryDays") AS BIGINT) AS delivery_days,
        CAST(sum("Quarter") AS BIGINT) AS quarters, round(sum("CalcRevenue"), 4) AS calc_revenue,
        round(sum("NetRevenue"), 4) AS net_revenue, round(sum("GrossProfit"), 4) AS gross_profit,
        strftime(min("OrderDate"), '%Y-%m-%d') AS first_order,
        strftime(max("DeliveryDate"), '%Y-%m-%d') AS last_delivery
        FROM distinct_sales GROUP BY "YearMonth", "Promotion", "DiscountBucket" """
        for name in ("csv", "parquet")]), "distinct_sales AS (SELECT DISTINCT * FROM sales)")
    q["duplicate_rows"] = with_sales(union([f"""SELECT '{name}' AS "table", total AS rows, kept
        AS distinct_rows, total - kept AS duplicate_rows FROM (SELECT
        (SELECT count(*) FROM {src}) AS total,
        (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {src})) AS kept)""" for name, src, cols in (
        ("sales", "raw", "*"), ("date, region, product", "sales", '"Date", "Region", "Product"'))]))
    q["key_uniqueness"] = union([f"""SELECT '{name}' AS "table", CAST(sum(n) AS BIGINT) AS rows,
        count(k) AS distinct_keys, CAST(coalesce(sum(n) FILTER (k IS NULL), 0) AS BIGINT)
        AS null_keys, max(n) FILTER (k IS NOT NULL) AS max_rows_per_key,
        sum(n) = count(k) AND count(*) = count(k) AS is_unique
        FROM (SELECT {key} AS k, count(*) AS n FROM {t} GROUP BY 1)"""
        for name, t, key in (("sales", "lineitem", "l_orderkey"), ("orders", "orders", "o_orderkey"))])
    q["profile_shape"] = "WITH n AS (SELECT count(*) AS c FROM lineitem) " + union(
        [f"SELECT {i} AS position, '{c}' AS \"column\", '{TYPES.get(c, 'string')}' AS type, "
         f"c AS rows FROM n" for i, c in enumerate(RAW + DERIVED)])
    q["profile_nulls"] = with_sales(union(
        [f"""SELECT '{c}' AS "column", count(*) FILTER ("{c}" IS NULL) AS nulls,
        count(*) AS rows FROM raw""" for c in RAW]))
    q["profile_numeric"] = with_sales(union([f"""SELECT '{c}' AS metric, count("{c}") AS n,
        round(avg("{c}"), 6) AS mean, round(stddev_samp("{c}"), 6) AS std,
        round(CAST(min("{c}") AS DOUBLE), 6) AS min,
        round(quantile_cont(CAST("{c}" AS DOUBLE), 0.25), 6) AS p25,
        round(quantile_cont(CAST("{c}" AS DOUBLE), 0.5), 6) AS p50,
        round(quantile_cont(CAST("{c}" AS DOUBLE), 0.75), 6) AS p75,
        round(CAST(max("{c}") AS DOUBLE), 6) AS max FROM sales""" for c in PROFILED]))
    q["profile_categories"] = with_sales(union([f"""SELECT '{c}' AS "column", "{c}" AS value,
        count(*) AS lines FROM sales GROUP BY "{c}" """ for c in CATEGORIES]))
    q["category_counts"] = with_sales(union([f"""SELECT '{c}' AS "column", count(DISTINCT "{c}")
        AS distinct_values, count(*) FILTER ("{c}" IS NULL) AS null_rows FROM raw"""
                                             for c in CATEGORIES]))
    q["kpi_global"] = with_sales(f"""SELECT count(*) AS lines,
        round(sum("TotalPrice"), 1) AS gross_revenue, round(sum("NetRevenue"), 1) AS net_revenue,
        round(avg("TotalPrice"), 4) AS avg_order_value, round({RATE}, 4) AS return_rate,
        round(avg("DeliveryDays"), 4) AS avg_delivery_days,
        round(sum("ShippingCost"), 1) AS shipping,
        round(sum("TotalPrice") - sum("NetRevenue"), 1) AS lost_revenue FROM sales""")
    q["kpi_cards"] = with_sales(f"""SELECT count(*) AS lines,
        round(sum("TotalPrice"), 1) AS gross_revenue, round(sum("NetRevenue"), 1) AS net_revenue,
        round(avg("TotalPrice"), 4) AS avg_order_value, CAST(sum("Returned") AS BIGINT) AS returned,
        round({RATE}, 4) AS return_rate,
        round(sum("Quantity" * "UnitPrice" * "Discount"), 1) AS discount_given,
        round(avg("Discount") * 100, 6) AS avg_discount_pct,
        round(median("TotalPrice"), 6) AS median_order_value,
        round(sum("TotalPrice") - sum("NetRevenue"), 1) AS lost_revenue,
        count(DISTINCT "Date") AS days,
        round(count(*) * 1.0 / count(DISTINCT "YearMonth"), 4) AS orders_per_month FROM sales""")
    q["hero_counts"] = with_sales("""SELECT count(DISTINCT "Region") AS regions,
        count(DISTINCT "Product") AS products, count(DISTINCT "Salesperson") AS salespeople,
        count(DISTINCT "YearMonth") AS months FROM sales""")
    q["by_region"] = report("Region", ORDERS, GROSS, NET, AOV, ONCE)
    q["by_product"] = report("Product", ORDERS, GROSS,
                             'round_even(avg("UnitPrice"), 4) AS avg_unit_price',
                             'round_even(avg("Quantity"), 4) AS avg_quantity', ONCE)
    q["by_customer_type"] = report("CustomerType", ORDERS, GROSS, AOV, TWICE)
    q["by_promotion"] = report(
        "Promotion", ORDERS, GROSS, AOV,
        'round_even(round_even(avg("Discount"), 2) * 100, 1) AS avg_discount')
    q["by_payment"] = report("PaymentMethod", ORDERS, GROSS, AOV)
    q["by_salesperson"] = report("Salesperson", ORDERS, GROSS, AOV, TWICE,
                                 'round_even(avg("DeliveryDays"), 4) AS avg_delivery_days')
    q["by_manager"] = report("RegionManager", ORDERS, GROSS, TWICE,
                             'round_even(avg("ShippingCost"), 4) AS avg_shipping')
    q["by_region_order_grain"] = report(
        "Region", "count(*) AS lines", 'count(DISTINCT "OrderID") AS distinct_orders', GROSS,
        'count(*) FILTER ("Discount" = 0) AS undiscounted',
        'CAST(sum("Returned") AS BIGINT) AS returned')
    q["by_salesperson_rounded_once"] = report("Salesperson", ORDERS, ONCE)
    q["by_promotion_without_null"] = with_sales(f"""SELECT "Promotion", {ORDERS}, {GROSS} FROM raw
        WHERE "Promotion" IS NOT NULL GROUP BY 1""")
    q["delivery_stats"] = report(
        "Region", 'round_even(avg("DeliveryDays"), 1) AS mean',
        'round_even(median("DeliveryDays"), 1) AS median',
        'min("DeliveryDays") AS min', 'max("DeliveryDays") AS max')
    q["discount_bucket_aov"] = with_sales(
        """SELECT position, b.bucket, round(avg("TotalPrice"), 6) AS avg_order_value,
        nullif(count("OrderID"), 0) AS lines FROM b
        LEFT JOIN sales ON b.bucket = "DiscountBucket" GROUP BY ALL""",
        "b AS (" + union([f"SELECT {i} AS position, '{b}' AS bucket"
                          for i, b in enumerate(BUCKETS)]) + ")")
    q["share_of_total"] = with_sales("""SELECT "PaymentMethod", round(sum("TotalPrice"), 4)
        AS revenue, count(*) AS lines, round(sum("TotalPrice") * 100 / (SELECT sum("TotalPrice")
        FROM sales), 6) AS share_pct FROM sales GROUP BY 1""")
    q["vs_overall"] = with_sales("""SELECT "Product", lines, returned, round(rate, 6) AS rate,
        round(o, 6) AS overall, round(rate - o, 6) AS difference, rate <= o AS at_or_below
        FROM (SELECT "Product", count("Returned") AS lines, CAST(sum("Returned") AS BIGINT)
        AS returned, avg("Returned") * 100 AS rate, (SELECT avg("Returned") * 100 FROM sales) AS o
        FROM sales GROUP BY 1)""")
    q["group_spread"] = with_sales("""SELECT dim, count(*) AS levels, min(lines) AS min_lines,
        max(lines) AS max_lines, CAST(floor(avg(lines)) AS BIGINT) AS mean_lines,
        round(min(revenue), 4) AS min_revenue, round(max(revenue), 4) AS max_revenue,
        round(max(revenue) - min(revenue), 4) AS revenue_gap,
        round((max(revenue) - min(revenue)) / sum(revenue) * 100, 6) AS gap_points,
        round((max(revenue) - min(revenue)) / min(revenue) * 100, 6) AS gap_pct,
        round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate,
        round(max(rate) - min(rate), 6) AS rate_spread,
        arg_min(level, {'r': -rate, 'l': level}) AS highest_rate_level,
        arg_min(level, {'r': rate, 'l': level}) AS lowest_rate_level
        FROM (SELECT *, returned * 100.0 / rated AS rate FROM lv WHERE level IS NOT NULL)
        GROUP BY dim""", f"lv AS ({spread_levels})")
    q["rank_salespeople"] = with_sales("""SELECT "Salesperson", gross_revenue,
        rank() OVER (ORDER BY gross_revenue DESC) AS rank FROM
        (SELECT "Salesperson", round_even(sum("TotalPrice"), 4) AS gross_revenue
        FROM sales GROUP BY 1)""")
    q["promo_undiscounted"] = with_sales("""SELECT promotion, lines,
        round(avg_discount_pct, 6) AS avg_discount_pct, undiscounted,
        round(undiscounted_pct, 6) AS undiscounted_pct FROM pn""", PROMO)
    q["note_promotions"] = with_sales("""SELECT promotion, lines,
        round(avg_discount_pct, 6) AS avg_discount_pct, undiscounted,
        round(undiscounted_pct, 6) AS undiscounted_pct, text FROM pn""", PROMO)
    q["monthly"] = with_sales("""SELECT strftime(month, '%Y-%m-%d') AS month,
        round(revenue, 4) AS revenue, lines FROM m""", filled([]))
    q["monthly_filled"] = with_sales("""SELECT "Salesperson", strftime(ds, '%Y-%m-%d') AS ds, x,
        round(y, 4) AS y FROM f""", filled(["Salesperson"]))
    q["monthly_trend"] = with_sales("""SELECT strftime(month, '%Y-%m-%d') AS month,
        round(revenue, 4) AS revenue, lines, CAST(pos AS INTEGER) AS position,
        round(mean, 4) AS mean_revenue, pos % greatest(1, n // 8) = 0 AS is_tick,
        strftime(month, '%Y-%m') AS label FROM (SELECT *, row_number() OVER (ORDER BY month) - 1
        AS pos, avg(revenue) OVER () AS mean, count(*) OVER () AS n FROM m)""", filled([]))
    q["monthly_stats"] = with_sales("""SELECT count(*) AS months, round(avg(revenue), 2) AS mean,
        round(stddev_samp(revenue), 2) AS std_sample, round(stddev_pop(revenue), 2)
        AS std_population, round(min(revenue), 2) AS min, round(max(revenue), 2) AS max
        FROM m""", filled([]))
    q["quarterly"] = with_sales("""SELECT "Year", "Quarter", round(sum("TotalPrice"), 4) AS revenue,
        concat("Year", ' Q', "Quarter") AS label FROM sales GROUP BY ALL""")
    q["annual_flagged"] = with_sales("""SELECT "Year", round(revenue, 4) AS revenue, last_month, p
        AS is_partial, CASE WHEN p THEN concat("Year", ' (to month ', last_month, ')')
        ELSE "Year"::VARCHAR END AS label FROM (SELECT "Year", sum("TotalPrice") AS revenue,
        max("Month") AS last_month, "Year" = (SELECT max("Year") FROM sales) AND max("Month") < 12
        AS p FROM sales GROUP BY 1)""")
    keys = ["Salesperson", "CustomerType"]
    q["month_gaps"] = with_sales("""SELECT s."Salesperson", s."CustomerType",
        strftime(s.month, '%Y-%m-%d') AS month FROM s ANTI JOIN m ON
        s."Salesperson" = m."Salesperson" AND s."CustomerType" = m."CustomerType"
        AND s.month = m.month""", filled(keys))
    q["like_for_like_year"] = like_for_like("lm")
    q["like_for_like_half"] = like_for_like("6")
    q["like_for_like_observed"] = like_for_like("lm - 1")
    q["note_year"] = like_for_like("lm", text=True)
    q["same_month_last_year"] = with_sales("""SELECT "Region", strftime(ds, '%Y-%m-%d') AS ds, x,
        round(y, 4) AS y, round(p, 4) AS previous, round((y / nullif(p, 0) - 1) * 100, 4)
        AS change_pct FROM (SELECT *, lag(y, 12) OVER (PARTITION BY "Region" ORDER BY ds) AS p
        FROM f)""", filled(["Region"]))
    q["rolling3"] = with_sales("""SELECT strftime(ds, '%Y-%m-%d') AS ds, x, round(y, 4) AS y,
        CASE WHEN x >= 2 THEN round(avg(y) OVER (ORDER BY ds ROWS 2 PRECEDING), 4) END AS rolling
        FROM f""", filled([]))
    q["cells"] = with_sales(f"""SELECT "Region", "Product", round(sum("TotalPrice"), 4) AS revenue,
        count(*) AS lines, round({RATE}, 6) AS return_rate FROM sales GROUP BY ALL""")
    q["pivot_revenue"] = wide_sum("Region", "Product", PRODUCTS,
                                  'coalesce(round(sum("TotalPrice") {}, 4), 0)')
    q["pivot_return"] = wide_sum("Region", "Product", PRODUCTS,
                                 'round(avg("Returned") {} * 100, 6)')
    q["pivot_product_customer"] = wide_sum("Product", "CustomerType", ["F", "O"],
                                           'round(sum("TotalPrice") {} / 1000, 7)')
    q["grid_reconcile"] = with_sales("""SELECT count(*) AS cells, round(sum(r), 1) AS grid_total,
        round(sum(r), 1) AS total, round(min(r), 4) AS min_cell, round(max(r), 4) AS max_cell,
        0.0::DOUBLE AS difference FROM (SELECT sum("TotalPrice") AS r FROM sales
        GROUP BY "Region", "Product")""")
    q["chart_levels"] = with_sales("""SELECT dim, level, lines, round(revenue, 4) AS revenue,
        round(revenue / 1000, 2) AS revenue_k,
        round(revenue * 100 / (SELECT sum("TotalPrice") FROM sales), 4) AS share_pct,
        round(revenue / lines, 4) AS avg_order_value, rated, returned,
        round(returned * 100.0 / rated, 4) AS return_rate, round(o, 4) AS overall_rate,
        round(avg_discount * 100, 4) AS avg_discount_pct, round(avg_days, 4) AS avg_delivery_days,
        returned * 100.0 / rated <= o AS at_or_below
        FROM lv, (SELECT avg("Returned") * 100 AS o FROM sales)""", f"lv AS ({levels(chart_dims)})")
    q["chart_grids"] = with_sales(union([f"""SELECT '{a} x {b}' AS grid, "{a}" AS "row", "{b}"
        AS "column", round(sum("TotalPrice"), 4) AS revenue,
        round(sum("TotalPrice") / 1000, 2) AS revenue_k, count(*) AS lines,
        round({RATE}, 4) AS return_rate FROM sales GROUP BY "{a}", "{b}" """ for a, b in (
        ("Region", "Product"), ("Product", "CustomerType"))]))
    q["corr_matrix"] = with_sales(union([f"""SELECT '{a}' AS x, '{b}' AS y, {i} AS i, {j} AS j,
        round(corr("{a}", "{b}"), 6) AS corr, {str(i > j).lower()} AS lower FROM sales"""
        for i, a in enumerate(CORRELATED) for j, b in enumerate(CORRELATED)]))
    dims = ["Product", "Region", "CustomerType", "Salesperson"]
    q["chi2_returns"] = with_sales("""SELECT dim, round(lo, 6) AS min_rate, round(hi, 6)
        AS max_rate, round(chi2, 6) AS chi2, CAST(dof AS INTEGER) AS dof,
        round(p_value, 6) AS p_value, CASE WHEN p_value < 0.05 THEN 'significant'
        WHEN p_value IS NOT NULL THEN 'noise' END AS verdict FROM chi JOIN (SELECT dim,
        min(returned * 100.0 / rated) AS lo, max(returned * 100.0 / rated) AS hi FROM lv
        GROUP BY dim) USING (dim)""", chi2(dims))
    q["trend_fit"] = trend_fit([])
    q["trend_fit_by_store"] = trend_fit(["StoreLocation"])
    q["trend_forecast"] = trend_forecast([])
    q["trend_forecast_by_store"] = trend_forecast(["StoreLocation"])
    q["forecast_width"] = with_sales("""SELECT round(avg(yhat), 2) AS mean_forecast,
        round(avg(band), 2) AS mean_band, round(avg(band) / avg(yhat) * 100, 2)
        AS relative_width_pct FROM fc""", fit([]))
    q["checks"] = with_sales("""SELECT "check", label, status, round(observed, 1) AS observed,
        round(threshold, 2) AS threshold, detail FROM checks""", CHECKS)
    q["checks_tally"] = with_sales("""SELECT count(*) FILTER (status = 'pass') AS passed,
        count(*) FILTER (status = 'warn') AS warned, count(*) FILTER (status = 'fail') AS failed,
        CASE WHEN count(*) FILTER (status = 'fail') = 0 THEN 'pass' ELSE 'fail' END AS overall
        FROM checks""", CHECKS)
    q["reconcile_dims"] = with_sales(union([f"""SELECT '{d}' AS dim, round(c, 1) AS covered,
        round(abs(c - t), 1) AS delta, round(t, 1) AS total,
        CASE WHEN abs(c - t) < 0.01 THEN 'pass' ELSE 'fail' END AS status FROM (SELECT
        coalesce(sum("TotalPrice") FILTER ("{d}" IS NOT NULL), 0) AS c, sum("TotalPrice") AS t
        FROM rawplus)""" for d in RECONCILED]))
    q["target_identity"] = with_sales("""SELECT count(*) AS lines,
        round(max(abs("CalcRevenue" - "TotalPrice")), 4) AS max_difference,
        max(abs("CalcRevenue" - "TotalPrice")) < 0.01 AS target_leakage FROM sales""")
    q["majority_share"] = """SELECT round(greatest(avg(f), 1 - avg(f)), 6) AS majority_share
        FROM (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS f FROM lineitem)"""
    q["auc_of_score"] = auc("Discount", None)
    q["auc_of_price_by_type"] = auc("TotalPrice", "CustomerType")
    q["roc_points"] = with_sales("""SELECT round(v, 6) AS threshold, CAST(tp AS BIGINT) AS tp,
        CAST(fp AS BIGINT) AS fp, round(tp / (SELECT sum(p) FROM b), 6) AS tpr,
        round(fp / (SELECT sum(q) FROM b), 6) AS fpr FROM (SELECT v, sum(p) OVER (ORDER BY v DESC)
        AS tp, sum(q) OVER (ORDER BY v DESC) AS fp FROM b)""", """b AS (SELECT "TotalPrice" AS v,
        sum("Returned") AS p, sum(1 - "Returned") AS q FROM sales GROUP BY 1)""")
    q["accuracy"] = with_sales("""SELECT round(avg(CAST(label = prediction AS INTEGER)), 6)
        AS accuracy FROM g""", confusion_ctes())
    q["confusion"] = with_sales("""SELECT a.c AS label, b.c AS prediction, (SELECT count(*) FROM g
        WHERE label = a.c AND prediction = b.c) AS lines FROM k a, k b""", confusion_ctes())
    q["class_report"] = with_sales("""SELECT c::VARCHAR AS class, round(p, 6) AS precision,
        round(r, 6) AS recall, round(f, 6) AS f1, support FROM pf
        UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6),
        CAST(sum(support) AS BIGINT) FROM pf
        UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
        round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6),
        CAST(sum(support) AS BIGINT) FROM pf""", confusion_ctes())
    q["reg_metrics"] = with_sales("""SELECT "Region", count(*) AS lines, round(avg(abs(e)), 4)
        AS mae, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - sum(e * e) / (var_pop(t) * count(*)),
        4) AS r2 FROM (SELECT "Region", "TotalPrice" AS t,
        "TotalPrice" - "Quantity" * "UnitPrice" AS e FROM sales) GROUP BY 1""")
    q["actual_vs_predicted"] = with_sales("""SELECT "Region", round("TotalPrice", 4) AS label,
        round("Quantity" * "UnitPrice", 4) AS prediction FROM sales""")
    model = f"""keys AS (SELECT *, dense_rank() OVER (PARTITION BY "Returned" ORDER BY "OrderID") - 1
        AS place FROM sales),
      rows AS (SELECT * EXCLUDE (place), place % 5 = 0 AS is_test,
        CAST((place // 5) % 5 AS INTEGER) AS fold FROM keys)"""
    codes = ", ".join(f"""code_{c} AS (SELECT coalesce("{c}", 'nan') AS level,
        CAST(row_number() OVER (ORDER BY coalesce("{c}", 'nan')) - 1 AS INTEGER) AS code
        FROM rows WHERE NOT is_test GROUP BY 1)""" for c in CODED)
    q["model_split"] = with_sales("""SELECT is_test, CASE WHEN NOT is_test THEN fold END AS fold,
        CAST("Returned" AS DOUBLE) AS label, count(*) AS lines FROM rows GROUP BY 1, 2, 3""", model)
    q["category_codes"] = with_sales(union([
        f"""SELECT '{c}' AS "column", level, code FROM code_{c}""" for c in CODED]),
        f"{model}, {codes}")
    q["scaler_stats"] = with_sales(union(
        [f"""SELECT '{c}' AS metric, round(avg(code), 7) AS mean, round(stddev_samp(code), 7) AS std
         FROM rows JOIN code_{c} ON coalesce("{c}", 'nan') = level WHERE NOT is_test""" for c in CODED]
        + [f"""SELECT '{c}', round(avg("{c}"), 7), round(stddev_samp("{c}"), 7) FROM rows
         WHERE NOT is_test""" for c in SCALED]), f"{model}, {codes}")
    sizes = """n AS (SELECT count(*) FILTER (NOT is_test) AS n_train,
        count(*) FILTER (is_test) AS n_test FROM rows),
      b AS (SELECT max(c) * 1.0 / sum(c) AS share FROM (SELECT count(*) AS c FROM rows
        WHERE NOT is_test GROUP BY "Returned"))"""
    fitted = ", ".join(f"('{m}')" for m in ("Logistic Regression", "Decision Tree",
                                             "Random Forest", "Gradient Boosting"))
    q["clf_leaderboard"] = with_sales(f"""SELECT 'most frequent class' AS model, n_train,
        CAST(NULL AS BIGINT) AS predicted, round(share, 6) AS baseline,
        CAST(NULL AS BOOLEAN) AS consistent, CAST(1 AS BIGINT) AS best_models,
        CAST(1 AS BIGINT) AS guarded FROM n, b
      UNION ALL SELECT m, n_train, n_test, NULL, true, 1, 1 FROM n, (VALUES {fitted}) t(m)""",
                                      f"{model}, {sizes}")
    regression = """keys AS (SELECT "TotalPrice" AS label, dense_rank() OVER (ORDER BY "OrderID") - 1
        AS place FROM sales), test AS (SELECT * FROM keys WHERE place % 5 = 0)"""
    q["reg_leaderboard"] = with_sales("""SELECT m AS model, count(*) AS predicted,
        round(sum(label), 1) AS actual, true AS consistent, CAST(1 AS BIGINT) AS best_models
      FROM test, (VALUES ('Linear Regression'), ('Random Forest'), ('Gradient Boosting')) t(m)
      GROUP BY m""", regression)
    q["topk_importance"] = """SELECT CAST(k AS INTEGER) AS rank, true AS is_share,
        CASE WHEN k <= 2 THEN true END AS is_factor FROM range(1, 11) t(k)"""
    q["note_returns"] = with_sales("""SELECT round(min_rate, 6) AS min_rate, round(max_rate, 6)
        AS max_rate, lines_per_level, highest_level, round(spread, 6) AS spread,
        round(p_product, 6) AS p_product, round(p_region, 6) AS p_region,
        round(p_salesperson, 6) AS p_salesperson, text FROM rnt""", NOTE_RETURNS)
    q["notes"] = with_sales(f"""SELECT 'returns' AS note, 'Product' AS subject, text FROM rnt
        UNION ALL SELECT 'partial year', year::VARCHAR, {YEAR_TEXT} FROM lfl
        UNION ALL SELECT 'promotions', promotion, text FROM pn""",
                            f"{NOTE_RETURNS}, {LIKE.format(cutoff='lm')}, {PROMO}")
    q["report_tables"] = report_cells(q)
    bad = ["CAST(\"OrderID\" AS BIGINT) % 11 = 0", "CAST(\"OrderID\" AS BIGINT) % 13 = 0",
           "CAST(\"OrderID\" AS BIGINT) % 17 = 0"]
    some = " OR ".join(bad)
    shown = [("OrderDate", "2024-13-45", "not a timestamp_ntz"), ("Returned", "2", "not 0 or 1"),
             ("Quantity", "ten", "not a int")]
    nothing = "CAST(NULL AS VARCHAR)"
    q["quarantine"] = with_sales(f"""SELECT 'accepted' AS side, {nothing} AS "column", {nothing} AS value,
        {nothing} AS reason, count(*) AS lines, CAST(sum("Quantity") AS BIGINT) AS quantity,
        CAST(sum("Returned") AS BIGINT) AS returned FROM sales WHERE NOT ({some})
      UNION ALL SELECT 'rejected', NULL, NULL, NULL, count(*), NULL, NULL FROM sales WHERE {some}
      """ + "".join(f""" UNION ALL SELECT 'problem', '{c}', '{v}', '{r}', count(*), NULL, NULL FROM sales
        WHERE {b} HAVING count(*) > 0""" for b, (c, v, r) in zip(bad, shown)))
    q["copy_differences"] = with_sales("""SELECT "OrderID", 'Quantity' AS "column",
        count(*) AS left_rows, count(*) AS right_rows FROM sales
        WHERE CAST("OrderID" AS BIGINT) % 101 = 0 GROUP BY 1
      UNION ALL SELECT "OrderID", 'Region', count(*), count(*) FROM sales
        WHERE CAST("OrderID" AS BIGINT) % 103 = 0 GROUP BY 1
        HAVING count("Region") > 0""")
    q["sketched_medians"] = with_sales("""SELECT "Region", "Year", count(*) AS lines,
        round(sum("TotalPrice"), 4) AS revenue, true AS median_within, true AS orders_within
        FROM sales GROUP BY 1, 2""")
    q["money_scale"] = with_sales(union([f"""SELECT '{c}' AS "column", count("{c}") AS "values",
        count(*) FILTER (abs("{c}" - round("{c}", 6)) > 1e-9 + abs("{c}") * 1e-15) AS finer FROM sales"""
                                         for c in ("TotalPrice", "NetRevenue", "ShippingCost", "UnitPrice")]))
    return q


def report_cells(q: dict[str, str]) -> str:
    """The report's tables in long form, every cell as text, from the queries of their parts."""
    def cells(name: str, source: str, row: list[str], columns: list[tuple[str, bool]]) -> str:
        key = " || ' | ' || ".join(f"coalesce(CAST({r} AS VARCHAR), '-')" for r in row) or "''"
        text = [f"""SELECT '{name}' AS "table", {key} AS "row", '{c}' AS "column",
            {f"printf('%.2f', round({c}, 2) + 0.0)" if number else f"CAST({c} AS VARCHAR)"} AS value FROM {source}"""
                for c, number in columns]
        return union(text or [f"""SELECT '{name}' AS "table", {key} AS "row", '' AS "column",
            CAST(NULL AS VARCHAR) AS value FROM {source}"""])

    shown = [("lines", False), ("revenue", True), ("share_pct", True), ("avg_order_value", True),
             ("rated", False), ("returned", False), ("return_rate", True), ("overall_rate", True), ("avg_discount_pct", True), ("avg_delivery_days", True)]
    charts = {"c-region": "Region", "c-product": "Product", "c-returns": "Product",
              "c-payment": "PaymentMethod", "c-promo": "Promotion", "c-delivery": "Region",
              "c-sales": "Salesperson", "returns-by-region": "Region",
              "returns-by-salesperson": "Salesperson", "revenue-by-salesperson": "Salesperson"}
    dims = sorted(set(charts.values()))
    parts = [cells(f"chart={name}", f"(SELECT * FROM shown WHERE dim = '{dim}')", ["level"], shown)
             for name, dim in charts.items()]
    grid = [("revenue", True), ("lines", False), ("return_rate", True)]
    k = ["lines", "returned", "days"]
    parts += [
        cells("chart=c-trend", "trend", ["label", "strftime(CAST(month AS DATE), '%b %Y')"], [("position", False), ("revenue", True),
                                                     ("mean_revenue", True)]),
        cells("chart=c-year", "years", ["label"], [("revenue", True)]),
        cells("chart=revenue-by-quarter", "quarters", ["label"], [("revenue", True)]),
        cells("chart=c-heat", "heat", ["r", "c"], grid),
        cells("chart=product-by-customer-type", "types", ["r", "c"], grid),
        cells("chart=discount-tiers", "tiers", ["bucket"], [("avg_order_value", True),
                                                             ("lines", False)]),
        cells("chart=correlation", "corr", ["x", "y"], [("corr", True)]),
        cells("chart=forecast", "ahead", [], [("step", False), ("x", False), *[
            (c, True) for c in ("yhat", "band", "low", "high")]]),
        cells("checks", "checked", ['"check"', "label", "status", "detail"], [("observed", True),
                                                                               ("threshold", True)]),
        cells("checks_tally", "tallied", ["overall"], [("passed", False), ("warned", False),
                                                        ("failed", False)]),
        cells("kpis", "cards", [], [(c, c not in k) for c in (
            "lines", "gross_revenue", "net_revenue", "avg_order_value", "returned", "return_rate",
            "discount_given", "avg_discount_pct", "days", "median_order_value", "lost_revenue",
            "orders_per_month")]),
        cells("hero", "hero", [], [(c, False) for c in ("regions", "products", "salespeople",
                                                         "months")]),
        cells("notes", "noted", ["note", "subject", "text"], [])]
    tables = f"""whole AS (SELECT sum("TotalPrice") AS t FROM sales),
      lvl AS ({levels(dims)}),
      shown AS (SELECT dim, level, lines, revenue, revenue / t * 100 AS share_pct,
        revenue / lines AS avg_order_value, CAST(rated AS BIGINT) AS rated,
        CAST(returned AS BIGINT) AS returned, returned * 100.0 / rated AS return_rate,
        sum(returned) OVER (PARTITION BY dim) * 100.0 / sum(rated) OVER (PARTITION BY dim) AS overall_rate,
        avg_discount * 100 AS avg_discount_pct, avg_days AS avg_delivery_days FROM lvl, whole),
      trend AS ({q["monthly_trend"]}), years AS ({q["annual_flagged"]}),
      quarters AS ({q["quarterly"]}), tiers AS ({q["discount_bucket_aov"]}),
      heat AS (SELECT "Region" AS r, "Product" AS c, sum("TotalPrice") AS revenue,
        count(*) AS lines, {RATE} AS return_rate FROM sales GROUP BY 1, 2),
      types AS (SELECT "Product" AS r, "CustomerType" AS c, sum("TotalPrice") AS revenue,
        count(*) AS lines, {RATE} AS return_rate FROM sales GROUP BY 1, 2),
      corr AS (SELECT * FROM ({q["corr_matrix"]}) WHERE i > j),
      ahead AS ({q["trend_forecast"]}),
      checked AS ({with_sales('SELECT "check", label, status, observed, threshold, detail FROM checks', CHECKS)}),
      tallied AS ({q["checks_tally"]}), cards AS ({q["kpi_cards"]}), hero AS ({q["hero_counts"]}),
      noted AS ({q["notes"]})"""
    return with_sales(union(parts), tables)
