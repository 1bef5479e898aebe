"""DuckDB statements that compute the same results as the named queries, written independently.

Each statement starts from the stored tables. Ties and rounding follow the rules of the operators:
value first, then label; half-up on decimals.
"""
from __future__ import annotations

ORACLE: dict[str, str] = {}


def half_up(value: str, digits: int) -> str:
    """Round the shortest decimal form of a double, so that ties do not hang on its last bit."""
    text = f"CAST(CAST({value} AS DOUBLE) AS VARCHAR)"
    return f"CAST(round(CAST({text} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def cents(value: str) -> str:
    return f"CAST(round({value}, 2) AS DOUBLE)"


# --- views -------------------------------------------------------------------------------------

VIEWS = {
    "sales": """
        SELECT l_orderkey AS order_id, o_orderdate AS order_date, p_name AS product, p_type AS category,
               p_brand AS brand, c_name AS customer, r_name AS region, n_name AS country,
               CAST(l_quantity AS DECIMAL(12,2)) AS quantity, CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price,
               CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
               CAST(CAST(p_retailprice AS DECIMAL(12,2)) * CAST(l_quantity AS DECIMAL(6,2)) AS DECIMAL(18,4)) AS cost
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "ledger": """
        SELECT l_orderkey AS entry_id, l_linenumber AS line_no, l_shipdate AS date,
               CASE WHEN l_returnflag = 'N' THEN 'SALES' WHEN l_returnflag = 'A' THEN 'EXPENSE'
                    WHEN l_linestatus = 'O' THEN 'UDHAAR' ELSE 'REFUND' END AS kind,
               'Item#' || CAST(l_suppkey AS VARCHAR) AS item,
               CAST(l_extendedprice AS DECIMAL(18,4)) AS stated,
               CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,4)) END AS amount
        FROM lineitem""",
    "leads": """
        SELECT c_custkey AS business_id, c_name AS business_name, n_name AS country, r_name AS region,
               CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN ' '
                    ELSE 'https://c' || CAST(c_custkey AS VARCHAR) || '.example' END AS website,
               CASE WHEN c_acctbal < 0 THEN NULL WHEN c_acctbal < 2000 THEN '1-10' WHEN c_acctbal < 4000 THEN '11-50'
                    WHEN c_acctbal < 6000 THEN '51-200' WHEN c_acctbal < 8000 THEN '201-500'
                    ELSE 'Enterprise' END AS employee_range,
               CASE c_custkey % 7 WHEN 0 THEN '$100K-$500K' WHEN 1 THEN '10M-50M' WHEN 2 THEN '50M-100M'
                    WHEN 3 THEN '100M+' WHEN 4 THEN '$1M' WHEN 5 THEN ' ' END AS revenue_range,
               CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS industry
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "customers": """
        SELECT c_name AS customer, n_name AS country, c_mktsegment AS segment,
               min(o_orderdate) AS signup_date, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS spend
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        GROUP BY c_custkey, c_name, n_name, c_mktsegment""",
    "finance": """
        SELECT o_orderkey AS entry_id, o_orderdate AS transaction_date, o_orderpriority AS account,
               o_orderstatus AS category,
               CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS expense,
               CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS income
        FROM orders""",
    "catalog": """
        SELECT p_partkey AS entry_no, ' ' || p_name AS food_name,
               CASE WHEN p_partkey % 11 <> 0 THEN p_type END AS category,
               CASE WHEN p_partkey % 13 = 0 THEN '  ' ELSE p_brand END AS cuisine,
               p_size AS calories, p_retailprice AS price
        FROM part""",
    "dirty": """
        SELECT 'ORD-' || CAST(o_orderkey AS VARCHAR) AS order_ref,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 50 = 1 THEN 'not a date'
                    ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN ' ' ELSE o_orderstatus END AS status,
               o_orderpriority AS priority,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN 'n/a'
                    ELSE CAST(o_totalprice AS VARCHAR) END AS amount,
               CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS total,
               o_custkey AS custkey, 'web' AS channel
        FROM orders""",
    "coerced": """
        SELECT order_ref, TRY_CAST(order_date AS TIMESTAMP) AS order_date, status, priority,
               TRY_CAST(amount AS DOUBLE) AS amount, total, custkey, channel FROM dirty""",
    "repeated": "SELECT l_quantity, l_discount, l_tax, l_returnflag, l_linestatus FROM lineitem",
    "order_lines": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity,
               l_extendedprice AS gross_sales, l_discount AS discount, l_tax AS tax,
               l_returnflag AS return_flag, l_linestatus AS line_status, l_shipdate AS ship_date
        FROM lineitem""",
    "line_amounts": """
        SELECT quantity, gross_sales, gross_sales * (1 - discount) AS net_sales, gross_sales * tax AS tax_amount
        FROM order_lines""",
    "readings": "SELECT event_id, ts, user_id, event_type, value FROM events",
}
NEEDS = {"coerced": ["dirty"], "line_amounts": ["order_lines"]}


def add(name: str, views: str, body: str) -> None:
    """Register a statement on top of the named views."""
    wanted: list[str] = []
    for view in views.split():
        wanted += [v for v in [*NEEDS.get(view, []), view] if v not in wanted]
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in wanted)
    body = body.strip()
    if not ctes:
        ORACLE[name] = body
    elif body.startswith("WITH "):
        ORACLE[name] = f"WITH {ctes}, {body[5:]}"
    else:
        ORACLE[name] = f"WITH {ctes} {body}"


def union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def named_rows(key: str, value: str, pairs: list[tuple[str, str]], source: str) -> str:
    return union([f"SELECT '{n}' AS {key}, CAST({v} AS DOUBLE) AS {value} FROM {source}" for n, v in pairs])


# --- business metrics --------------------------------------------------------------------------

_TOTALS = """t AS (SELECT sum(revenue) AS r, sum(quantity) AS q, sum(cost) AS c, count(*) AS n FROM sales)"""
_MARGIN = "(CAST(r - c AS DOUBLE) / CAST(r AS DOUBLE)) * 100"

add("business_kpis", "sales", f"""WITH {_TOTALS}
    SELECT {cents('r')} AS total_revenue, {cents('q')} AS total_quantity, {cents('c')} AS total_cost,
           CAST(NULL AS DOUBLE) AS total_expenses, {cents('r - c')} AS total_profit,
           {half_up(_MARGIN, 4)} AS gross_margin, {half_up('CAST(r AS DOUBLE) / n', 2)} AS average_order_value,
           n AS transaction_count, n AS sales_transaction_count FROM t""")
add("kpi_cards", "sales", f"WITH {_TOTALS} " + named_rows("label", "value", [
    ("Total Sales", cents("r")), ("Total Quantity", cents("q")), ("Total Profit", cents("r - c")),
    ("Gross Margin", half_up(_MARGIN, 4)), ("Transactions", "n")], "t"))
add("profit_summary", "sales", f"WITH {_TOTALS} " + named_rows("metric", "value", [
    ("total_revenue", cents("r")), ("total_cost_or_expense", cents("c")), ("total_profit", cents("r - c")),
    ("gross_margin_pct", half_up(half_up(_MARGIN, 4), 2))], "t"))
add("business_overview", "sales", f"WITH {_TOTALS} " + named_rows("metric", "value", [
    ("total_revenue", cents("r")), ("total_quantity", cents("q")), ("total_profit", cents("r - c")),
    ("transaction_count", "n")], "t"))

_SIGNED = """t AS (SELECT sum(CASE kind WHEN 'SALES' THEN amount WHEN 'REFUND' THEN -amount ELSE 0 END) AS r,
    sum(CASE WHEN kind = 'EXPENSE' THEN amount ELSE 0 END) AS e,
    count(*) FILTER (WHERE kind = 'SALES') AS s, count(*) AS n FROM ledger)"""
add("average_order_value", "ledger", f"""WITH {_SIGNED}
    SELECT {cents('r')} AS total_revenue, s AS sales_transaction_count,
           {half_up('CAST(r AS DOUBLE) / s', 2)} AS average_order_value FROM t""")
add("revenue_signed", "ledger", f"""WITH {_SIGNED}
    SELECT {cents('r')} AS total_revenue, CAST(NULL AS DOUBLE) AS total_quantity, CAST(NULL AS DOUBLE) AS total_cost,
           {cents('e')} AS total_expenses, {cents('r - e')} AS total_profit,
           {half_up('(CAST(r - e AS DOUBLE) / CAST(r AS DOUBLE)) * 100', 4)} AS gross_margin,
           {half_up('CAST(r AS DOUBLE) / s', 2)} AS average_order_value,
           n AS transaction_count, s AS sales_transaction_count FROM t""")
add("revenue_derived", "sales", f"""
    WITH t AS (SELECT sum(quantity * unit_price) AS r, sum(quantity) AS q, count(*) AS n FROM sales)
    SELECT {cents('r')} AS total_revenue, {cents('q')} AS total_quantity, CAST(NULL AS DOUBLE) AS total_cost,
           CAST(NULL AS DOUBLE) AS total_expenses, CAST(NULL AS DOUBLE) AS total_profit,
           CAST(NULL AS DOUBLE) AS gross_margin, {half_up('CAST(r AS DOUBLE) / n', 2)} AS average_order_value,
           n AS transaction_count, n AS sales_transaction_count FROM t""")

add("revenue_by_date", "sales", f"""SELECT strftime(order_date, '%Y-%m-%d') AS date, {cents('sum(revenue)')} AS revenue
    FROM sales GROUP BY 1""")
add("revenue_by_month", "sales", f"""SELECT strftime(order_date, '%Y-%m') AS period, {cents('sum(revenue)')} AS revenue
    FROM sales GROUP BY 1""")


def ranked(source: str, label: str, value: str, label_name: str, value_name: str, limit: int, order: str = "DESC") -> str:
    return f"""WITH g AS (SELECT {label} AS k, sum({value}) AS v FROM {source} WHERE {label} IS NOT NULL GROUP BY 1),
        top AS (SELECT * FROM g ORDER BY v {order}, k LIMIT {limit})
        SELECT k AS {label_name}, {cents('v')} AS {value_name} FROM top"""


for _name, _label, _out in (("top_products", "product", "product"), ("top_categories", "category", "category"),
                            ("top_customers", "customer", "customer"), ("top_regions", "region", "region")):
    add(_name, "sales", ranked("sales", _label, "revenue", _out, "revenue", 20) + " WHERE v <> 0")
add("top_products_by_quantity", "sales", ranked("sales", "product", "quantity", "product", "quantity", 20) + " WHERE v <> 0")
add("top_categories_by_transactions", "sales", """SELECT category, count(*) AS transaction_count FROM sales
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
add("rank_product_revenue", "sales", ranked("sales", "product", "revenue", "product", "revenue", 10) + " WHERE v <> 0")
add("rank_product_profit", "sales", ranked("sales", "product", "revenue - cost", "product", "profit", 10) + " WHERE v <> 0")
add("rank_region_revenue", "sales", ranked("sales", "country", "revenue", "region", "revenue", 10) + " WHERE v <> 0")
add("expense_by_type", "ledger", f"""
    WITH t AS (SELECT CASE WHEN line_no % 2 = 0 THEN ' ' || lower(kind) || ' ' ELSE kind END AS expense_type,
                      sum(CASE WHEN kind = 'EXPENSE' THEN amount ELSE 0 END) AS v FROM ledger GROUP BY 1)
    SELECT expense_type, {cents('v')} AS expense FROM t WHERE v <> 0""")
add("expense_total", "ledger", f"""SELECT 'expenses' AS expense_type,
    {cents("sum(CASE WHEN kind = 'EXPENSE' THEN amount ELSE 0 END)")} AS expense FROM ledger""")

_LEADERS = """top AS (SELECT product FROM sales GROUP BY 1 ORDER BY sum(revenue) DESC, product LIMIT 5),
    m AS (SELECT strftime(order_date, '%Y-%m') AS period, product, sum(revenue) AS v FROM sales
          WHERE product IN (SELECT product FROM top) GROUP BY 1, 2)"""
_GROWTH = f"""{_LEADERS},
    ends AS (SELECT product,
        coalesce(sum(v) FILTER (WHERE period = (SELECT min(period) FROM m)), 0) AS a,
        coalesce(sum(v) FILTER (WHERE period = (SELECT max(period) FROM m)), 0) AS b FROM m GROUP BY 1),
    g AS (SELECT product, {cents('a')} AS first_period_revenue, {cents('b')} AS last_period_revenue,
        {cents('b - a')} AS absolute_growth,
        {half_up('CASE WHEN a <> 0 THEN CAST(b - a AS DOUBLE) / abs(CAST(a AS DOUBLE)) * 100 END', 2)} AS pct_growth
        FROM ends)"""
add("top_product_monthly", "sales", f"WITH {_LEADERS} SELECT period, product, {cents('v')} AS revenue FROM m WHERE v <> 0")
add("product_growth", "sales", f"WITH {_GROWTH} SELECT * FROM g")
add("growing_products_growth", "sales", f"WITH {_GROWTH} SELECT * FROM g WHERE absolute_growth > 0")
add("declining_products_growth", "sales", f"WITH {_GROWTH} SELECT * FROM g WHERE absolute_growth < 0")
add("growth_table", "sales", f"""WITH {_GROWTH} SELECT * FROM g
    WHERE CASE WHEN EXISTS (SELECT 1 FROM g WHERE absolute_growth > 0) THEN absolute_growth > 0 ELSE absolute_growth < 0 END""")
add("total_sales_overview", "sales", f"""WITH c AS (SELECT category AS k, sum(revenue) AS v FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
    r AS (SELECT region AS k, sum(revenue) AS v FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
    SELECT 'Top category by revenue' AS metric, k AS value, {cents('v')} AS amount FROM c
    UNION ALL SELECT 'Top region by revenue', k, {cents('v')} FROM r""")
add("revenue_share", "sales", f"""WITH g AS (SELECT category, {cents('sum(revenue)')} AS revenue FROM sales GROUP BY 1
        ORDER BY sum(revenue) DESC, category LIMIT 8)
    SELECT category, revenue, {half_up('greatest(revenue, 0) * 100 / (SELECT sum(greatest(revenue, 0)) FROM g)', 1)} AS share_pct FROM g""")
add("analysis_summary", "sales repeated", f"""WITH {_TOTALS},
    d AS (SELECT count(*) AS n FROM (SELECT DISTINCT * FROM repeated)), a AS (SELECT count(*) AS n FROM repeated)
    SELECT 'Rows' AS metric, CAST(n AS DOUBLE) AS value FROM a UNION ALL SELECT 'Columns', 5.0
    UNION ALL SELECT 'Missing Cells', CAST(sum((l_quantity IS NULL)::INT + (l_discount IS NULL)::INT + (l_tax IS NULL)::INT
        + (l_returnflag IS NULL)::INT + (l_linestatus IS NULL)::INT) AS DOUBLE) FROM repeated
    UNION ALL SELECT 'Duplicate Rows', CAST(a.n - d.n AS DOUBLE) FROM a, d UNION ALL """ + named_rows("metric", "value", [
    ("Total Revenue", cents("r")), ("Total Quantity", cents("q")), ("Total Profit", cents("r - c")),
    ("Gross Margin", half_up(_MARGIN, 4))], "t"))

# --- profile and quality -----------------------------------------------------------------------

DIRTY = ["order_ref", "order_date", "status", "priority", "amount", "total", "custkey", "channel"]
DIRTY_TEXT = {"order_ref", "order_date", "status", "priority", "amount", "channel"}
COERCED_TEXT = {"order_ref", "status", "priority", "channel"}


def _missing(column: str, text: set[str]) -> str:
    return f"({column} IS NULL OR trim({column}) = '')" if column in text else f"({column} IS NULL)"


def _facts(view: str, text: set[str]) -> str:
    """Counts per column: rows, missing with and without blanks, filled, distinct with and without blanks."""
    return union([f"""SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
        count(*) FILTER (WHERE {_missing(c, text)}) AS missing, count({c}) AS filled, count(DISTINCT {c}) AS d,
        count(DISTINCT CASE WHEN NOT {_missing(c, text)} THEN {c} END) AS dt FROM {view}""" for c in DIRTY])


_COERCED = f"f AS ({_facts('coerced', COERCED_TEXT)})"
_DIRTY = f"f AS ({_facts('dirty', DIRTY_TEXT)})"
_LABEL = """CASE WHEN dt <= 1 THEN 'constant' WHEN dt <= 0.05 * n THEN 'low' WHEN dt <= 0.25 * n THEN 'medium'
    WHEN dt <= 0.75 * n THEN 'high' ELSE 'very_high' END"""
# A name with an identifier word and mostly distinct or textual values, or nearly unique text.
_IDENTIFIER = """(column_name NOT IN ('amount', 'total', 'custkey') AND d > 0.95 * filled AND filled >= 20)"""

add("column_profile", "coerced", f"""WITH {_COERCED}
    SELECT column_name, CASE column_name WHEN 'amount' THEN 'double' WHEN 'total' THEN 'double' WHEN 'custkey' THEN 'bigint'
               WHEN 'order_date' THEN 'timestamp' ELSE 'string' END AS dtype,
           missing, {half_up('missing * 100.0 / n', 2)} AS missing_pct, d AS distinct_values,
           {half_up('d * 1.0 / n', 4)} AS unique_ratio, d <= 1 AS is_constant, {_IDENTIFIER} AS is_identifier_like,
           {_LABEL} AS cardinality,
           CASE column_name WHEN 'order_ref' THEN 'order_id' WHEN 'order_date' THEN 'order_date' WHEN 'amount' THEN 'sales_amount'
               WHEN 'total' THEN 'sales_amount' WHEN 'custkey' THEN 'unknown' ELSE 'generic_text' END AS role FROM f""")


def per_column(view: str, columns: list[str], outputs: str) -> str:
    """One row per column; ``@`` stands for the column."""
    return union([f"SELECT '{c}' AS column_name, {outputs.replace('@', c)} FROM {view}" for c in columns])


def quantile(column: str, p: float) -> str:
    return f"quantile_cont(CAST({column} AS DOUBLE), {p})"


add("numeric_summary", "coerced", per_column("coerced", ["amount", "total", "custkey"], f"""
    {half_up('min(@)', 4)} AS min, {half_up('max(@)', 4)} AS max, {half_up('avg(@)', 4)} AS mean,
    {half_up(quantile('@', 0.5), 4)} AS median, {half_up('stddev_samp(@)', 4)} AS std"""))
add("skewness", "readings", "WITH s AS (" + per_column("readings", ["value", "user_id"], "skewness(@) AS s") + f""")
    SELECT column_name, {half_up('s', 4)} AS skewness, CASE WHEN abs(s) < 0.5 THEN 'approximately symmetric'
        WHEN s > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS label FROM s""")
add("cardinality", "coerced", f"""WITH {_COERCED} SELECT column_name, dt AS unique_count, {half_up('dt * 1.0 / n', 4)} AS ratio,
    {half_up('d * 100.0 / n', 4)} AS unique_pct, {_LABEL} AS label FROM f""")


def top_values(view: str, columns: list[str], limit: int, value: str = "@", keep: str = "TRUE") -> str:
    pairs = union([f"SELECT '{c}' AS column_name, {value.replace('@', c)} AS value FROM {view}" for c in columns])
    return f"""WITH p AS ({pairs}), c AS (SELECT column_name, value, count(*) AS count FROM p WHERE value IS NOT NULL AND {keep}
        GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS rn FROM c)
        SELECT column_name, value, count FROM r WHERE rn <= {limit}"""


add("categorical_top_values", "dirty", top_values("dirty", ["status", "priority", "channel"], 10, keep="trim(value) <> ''"))
add("suspicious_columns", "coerced", f"""WITH {_COERCED}, t AS (SELECT *, {_LABEL} AS label FROM f
        WHERE column_name IN ('order_ref', 'status', 'priority', 'channel'))
    SELECT column_name, 'identifier_like_or_constant' AS reason, dt AS observed FROM t WHERE dt <= 1 OR {_IDENTIFIER}
    UNION ALL SELECT column_name, 'high_cardinality', dt FROM t WHERE NOT (dt <= 1 OR {_IDENTIFIER}) AND label IN ('high', 'very_high')
    UNION ALL SELECT column_name, 'high_missingness', missing FROM t WHERE missing > 0 AND missing >= 0.3 * n""")
_DUPLICATES = "(SELECT count(*) FROM {v}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {v}))"
add("profile_quality_score", "coerced", f"""WITH {_COERCED}, t AS (SELECT sum(missing) AS m, sum(n) AS cells, max(n) AS n,
        sum((missing >= 0.3 * n)::INT) AS holes, sum(({_LABEL} IN ('high', 'very_high'))::INT) AS many,
        {_DUPLICATES.format(v='coerced')} AS dup FROM f)
    SELECT {half_up('greatest(0, least(100, (1 - m * 1.0 / cells - dup * 1.0 / n - 0.02 * holes - 0.01 * many) * 100))', 1)} AS score,
        CAST(dup AS BIGINT) AS duplicate_rows, CAST(m AS BIGINT) AS total_missing, CAST(cells AS BIGINT) AS total_cells FROM t""")
add("data_quality", "dirty", f"""WITH {_DIRTY}, t AS (SELECT max(n) AS n, count(*) AS c, sum(nulls) AS m, sum(n) AS cells,
        sum((d <= 1)::INT) AS constant, sum((column_name NOT IN ('total', 'custkey') AND d >= 0.7 * n)::INT) AS many,
        {_DUPLICATES.format(v='dirty')} AS dup FROM f),
    p AS (SELECT *, {half_up('m * 100.0 / cells', 4)} AS mp, {half_up('dup * 100.0 / n', 4)} AS dp FROM t)
    SELECT n AS row_count, c AS column_count, CAST(m AS BIGINT) AS missing_cells, mp AS missing_pct,
        CAST(dup AS BIGINT) AS duplicate_rows, dp AS duplicate_pct, CAST(constant AS BIGINT) AS constant_columns,
        CAST(many AS BIGINT) AS high_cardinality_columns,
        {half_up('greatest(0, least(100, 100 - mp - least(25, dp) - 2 * constant - many))', 2)} AS data_quality_score FROM p""")
for _name in ("duplicate_rows", "duplicate_rows_fingerprint"):
    add(_name, "repeated", f"""SELECT count(*) AS total_rows, CAST({_DUPLICATES.format(v='repeated')} AS BIGINT) AS duplicate_rows FROM repeated""")
add("missing_values", "dirty", f"WITH {_DIRTY} SELECT column_name, nulls AS missing FROM f")
add("missing_report", "dirty", f"""WITH {_DIRTY} SELECT column_name, nulls AS missing, {half_up('nulls * 100.0 / n', 2)} AS missing_pct,
    {half_up('nulls * 100.0 / n', 2)} > 30 AS needs_attention FROM f WHERE nulls > 0""")
add("completeness", "dirty", f"""WITH {_DIRTY}, t AS (SELECT max(n) AS n, sum(nulls) AS m, sum(n) AS cells FROM f)
    SELECT n AS total_rows, CAST(8 AS BIGINT) AS total_columns, CAST(m AS BIGINT) AS missing_cells,
    {half_up('100 - m * 100.0 / cells', 2)} AS completeness_pct FROM t""")
add("insight_missing_pct", "dirty", f"""WITH {_DIRTY}, t AS (SELECT sum(nulls) AS m, sum(n) AS cells FROM f),
    p AS (SELECT m, cells, {half_up('m * 100.0 / cells', 1)} AS pct FROM t)
    SELECT CAST(m AS BIGINT) AS missing_cells, CAST(cells AS BIGINT) AS cells, pct AS missing_pct FROM p WHERE pct > 5""")


def bounds(view: str, columns: list[str], skip_flat: bool = False) -> str:
    """CTEs b (bounds per column) and o (outlier counts per column)."""
    b = per_column(view, columns, f"{quantile('@', 0.25)} AS q1, {quantile('@', 0.75)} AS q3")
    o = union([f"""SELECT '{c}' AS column_name, count({c}) AS n,
        count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outliers,
        any_value(q1 - 1.5 * (q3 - q1)) AS lo, any_value(q3 + 1.5 * (q3 - q1)) AS hi, any_value(q3 - q1) AS iqr
        FROM {view}, b WHERE b.column_name = '{c}'""" for c in columns])
    return f"b AS ({b}), o AS ({o})"


add("quality_assessment", "dirty", f"""WITH {_DIRTY}, {bounds('dirty', ['total', 'custkey'])},
    t AS (SELECT sum(nulls) AS m, sum(n) AS cells FROM f)
    SELECT 'missing_pct' AS "check", column_name, {half_up('nulls * 100.0 / n', 1)} AS value FROM f WHERE nulls > 0
    UNION ALL SELECT 'missing_count', column_name, CAST(nulls AS DOUBLE) FROM f WHERE nulls > 0
    UNION ALL SELECT 'total_missing', '', CAST(m AS DOUBLE) FROM t
    UNION ALL SELECT 'duplicate_rows', '', CAST({_DUPLICATES.format(v='dirty')} AS DOUBLE)
    UNION ALL SELECT 'completeness_pct', '', {half_up('(1 - m * 1.0 / cells) * 100', 1)} FROM t
    UNION ALL SELECT 'outliers', column_name, CAST(outliers AS DOUBLE) FROM o WHERE outliers > 0 AND iqr > 0""")
LINE_NUMBERS = ["quantity", "gross_sales", "discount", "tax"]
add("describe_numeric", "order_lines", per_column("order_lines", LINE_NUMBERS, f"""count(@) AS count, {half_up('avg(@)', 6)} AS mean,
    {half_up('stddev_samp(@)', 6)} AS std, {half_up('min(@)', 6)} AS min, {half_up(quantile('@', 0.25), 6)} AS p25,
    {half_up(quantile('@', 0.5), 6)} AS p50, {half_up(quantile('@', 0.75), 6)} AS p75, {half_up('max(@)', 6)} AS max"""))
_CATEGORICAL = ["status", "priority", "channel", "order_date"]
add("categorical_summary", "dirty", f"""WITH top AS ({top_values('dirty', _CATEGORICAL, 1)}),
    d AS ({per_column('dirty', _CATEGORICAL, 'count(DISTINCT @) AS unique_values')})
    SELECT column_name, unique_values, value AS most_common, count AS frequency FROM d JOIN top USING (column_name)""")
add("column_kinds", "dirty", f"""WITH {_DIRTY} SELECT column_name, CASE WHEN column_name IN ('total', 'custkey') THEN 'numeric'
    WHEN column_name = 'order_date' AND (SELECT count(TRY_CAST(order_date AS TIMESTAMP)) >= 0.6 * count(order_date) FROM dirty) THEN 'date'
    WHEN d <= greatest(20, floor(0.2 * n)) THEN 'categorical' ELSE 'text' END AS kind FROM f""")
_NAMED = union([f"SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'Missing') AS value FROM dirty" for c in DIRTY])
add("unique_values", "dirty", f"""WITH {_DIRTY}, p AS ({_NAMED}), c AS (SELECT column_name, value, count(*) AS n FROM p GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn FROM c),
    t AS (SELECT column_name, string_agg(value || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rn) AS top_values
          FROM r WHERE rn <= 5 GROUP BY 1)
    SELECT column_name, d AS unique_values, top_values FROM f JOIN t USING (column_name)""")
add("dataset_warnings", "coerced", f"""WITH {_COERCED}, t AS (SELECT max(n) AS n, sum(missing) AS m, sum(nulls) AS nulls,
        sum((d <= 1)::INT) AS constant, sum(({_LABEL} IN ('high', 'very_high'))::INT) AS many,
        sum((column_name NOT IN ('amount', 'total', 'custkey') AND d >= 0.7 * n)::INT) AS many_text,
        {_DUPLICATES.format(v='coerced')} AS dup FROM f),
    w AS (SELECT 'profile' AS source, 'too_few_rows' AS warning, n < 20 AS holds FROM t
    UNION ALL SELECT 'profile', 'missing_values_present', m > 0 FROM t
    UNION ALL SELECT 'profile', 'duplicate_rows_present', dup > 0 FROM t
    UNION ALL SELECT 'profile', 'high_cardinality_columns', many > 0 FROM t
    UNION ALL SELECT 'quality', 'missing_values_present', nulls > 0 FROM t
    UNION ALL SELECT 'quality', 'duplicate_rows_present', dup > 0 FROM t
    UNION ALL SELECT 'quality', 'constant_columns_present', constant > 0 FROM t
    UNION ALL SELECT 'quality', 'high_cardinality_columns_present', many_text > 0 FROM t
    UNION ALL SELECT 'quality', 'too_few_rows_for_modeling', n < 10 FROM t)
    SELECT source, warning FROM w WHERE holds""")
_SAMPLES = union([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS v FROM dirty WHERE {c} IS NOT NULL GROUP BY 2" for c in DIRTY])
_RANGES = union([f"""SELECT '{c}' AS column_name, count(v) >= greatest(2, floor(0.6 * count(raw))) AS ok, min(v) AS lo, max(v) AS hi,
    avg(v) AS mean, sum(CAST(v AS DECIMAL(28,6))) AS total FROM (SELECT {c} AS raw, TRY_CAST({c} AS DOUBLE) AS v FROM dirty)""" for c in DIRTY])
add("schema_profile", "dirty", f"""WITH {_DIRTY}, s AS ({_SAMPLES}),
    sr AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY v) AS rn FROM s),
    samples AS (SELECT column_name, string_agg(left(v, 120), ' | ' ORDER BY v) AS sample_values FROM sr WHERE rn <= 5 GROUP BY 1),
    ranges AS ({_RANGES})
    SELECT column_name, CASE column_name WHEN 'total' THEN 'double' WHEN 'custkey' THEN 'bigint' ELSE 'string' END AS dtype,
        nulls AS missing_count, d AS unique_count, column_name = 'order_date' AS looks_like_date,
        CASE WHEN ok THEN {half_up('lo', 6)} END AS min, CASE WHEN ok THEN {half_up('hi', 6)} END AS max,
        CASE WHEN ok THEN {half_up('mean', 6)} END AS mean, CASE WHEN ok THEN CAST(total AS DOUBLE) END AS sum, sample_values
    FROM f JOIN ranges USING (column_name) LEFT JOIN samples USING (column_name)""")
add("preview", "finance", "SELECT * FROM finance ORDER BY entry_id LIMIT 10")
add("coerced_types", "dirty", """SELECT order_ref, TRY_CAST(order_date AS TIMESTAMP) AS order_date, status, priority,
    TRY_CAST(amount AS DOUBLE) AS amount, total, custkey, channel FROM dirty""")
add("money_parse", "ledger", f"SELECT entry_id, line_no, {cents('stated')} AS amount_value FROM ledger")
add("dataset_overview", "finance", """SELECT 'Rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM finance
    UNION ALL SELECT 'Columns', '6' UNION ALL SELECT 'Dataset type', 'finance'""")

# --- correlations, outliers, histograms --------------------------------------------------------


def corr_pairs(view: str, columns: list[str]) -> str:
    return union([f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS r FROM {view}"
                  for i, a in enumerate(columns) for b in columns[i + 1:]])


_LINE_PAIRS = f"p AS ({corr_pairs('order_lines', LINE_NUMBERS)})"
AMOUNTS = ["quantity", "gross_sales", "net_sales", "tax_amount"]
_STRONG = f"""p AS ({corr_pairs('line_amounts', AMOUNTS)}),
    s AS (SELECT column_a, column_b, {half_up('r', 6)} AS correlation FROM p WHERE abs({half_up('r', 6)}) >= 0.65)"""
add("correlation_pairs", "order_lines", f"WITH {_LINE_PAIRS} SELECT column_a, column_b, {half_up('r', 6)} AS correlation FROM p")
add("correlation_matrix", "order_lines", f"""WITH {_LINE_PAIRS} SELECT column_a, column_b, {half_up('r', 6)} AS correlation FROM p
    UNION ALL SELECT column_b, column_a, {half_up('r', 6)} FROM p UNION ALL """ + union([f"SELECT '{c}', '{c}', 1.0" for c in LINE_NUMBERS]))
add("correlation_top", "order_lines", f"""WITH {_LINE_PAIRS} SELECT column_a, column_b, {half_up('r', 4)} AS correlation FROM p
    ORDER BY abs(correlation) DESC, 1, 2 LIMIT 20""")
add("correlation_strength", "order_lines", f"""WITH {_LINE_PAIRS}, q AS (SELECT column_a, column_b, {half_up('r', 2)} AS correlation FROM p)
    SELECT *, CASE WHEN abs(correlation) > 0.7 THEN 'strong' WHEN abs(correlation) > 0.4 THEN 'moderate' ELSE 'weak' END AS strength
    FROM q ORDER BY abs(correlation) DESC, 1, 2 LIMIT 20""")
add("strong_correlations", "line_amounts", f"WITH {_STRONG} SELECT * FROM s")
add("driver_columns", "line_amounts", f"WITH {_STRONG} SELECT column_a AS column_name FROM s UNION SELECT column_b FROM s")
_OUT = f"WITH {bounds('readings', ['value', 'user_id'])}"
add("outliers_iqr", "readings", f"{_OUT} SELECT column_name, outliers, {half_up('lo', 6)} AS lower_bound, {half_up('hi', 6)} AS upper_bound FROM o WHERE n >= 4")
add("outliers_any_size", "readings", f"{_OUT} SELECT column_name, outliers FROM o")
add("outliers_pct", "readings", f"""{_OUT} SELECT column_name, outliers, {half_up('outliers * 100.0 / n', 2)} AS outlier_pct,
    {half_up('lo', 2)} AS lower_bound, {half_up('hi', 2)} AS upper_bound FROM o WHERE n >= 4 AND iqr > 0 AND outliers > 0""")
add("outlier_samples", "readings", f"""{_OUT} SELECT event_id, value FROM readings, o
    WHERE o.column_name = 'value' AND (value < lo OR value > hi) ORDER BY event_id LIMIT 10""")
add("capped_outliers", "readings", f"""{_OUT} SELECT event_id, ts, user_id, event_type, least(greatest(value, lo), hi) AS value
    FROM readings, o WHERE o.column_name = 'value'""")
add("histogram_int", "order_lines", """WITH s AS (SELECT CAST(min(quantity) AS BIGINT) AS lo,
        greatest(1, CAST(ceil((max(quantity) - min(quantity)) / 10) AS BIGINT)) AS w FROM order_lines),
    b AS (SELECT lo + CAST(floor((quantity - lo) / w) AS BIGINT) * w AS a, w FROM order_lines, s)
    SELECT CAST(a AS VARCHAR) || '-' || CAST(a + w - 1 AS VARCHAR) AS bin, count(*) AS count FROM b GROUP BY 1""")
add("histogram_calories", "catalog", """WITH s AS (SELECT min(calories) AS lo FROM catalog),
    b AS (SELECT CASE WHEN calories <= lo + 60 THEN 0 ELSE (calories - lo - 1) // 60 END AS k, lo FROM catalog, s)
    SELECT CASE WHEN k = 0 THEN CAST(lo AS VARCHAR) ELSE CAST(lo + 60 * k + 1 AS VARCHAR) END || '-' ||
        CAST(lo + 60 * (k + 1) AS VARCHAR) AS bin, count(*) AS count FROM b GROUP BY 1""")
_SHORT = "regexp_replace(CAST(round(CAST({v} AS DECIMAL(38,12)), 2) AS VARCHAR), '\\.?0+$', '')"
add("histogram_float", "readings", f"""WITH s AS (SELECT min(value) AS lo, max(value) AS hi,
        least(12, greatest(3, CAST(floor(sqrt(count(value))) AS INT))) AS k FROM readings),
    b AS (SELECT least(k - 1, CAST(floor((value - lo) / ((hi - lo) / k)) AS INT)) AS i, lo, hi, k FROM readings, s),
    e AS (SELECT lo + i * ((hi - lo) / k) AS a, CASE WHEN i + 1 = k THEN hi ELSE lo + (i + 1) * ((hi - lo) / k) END AS z FROM b)
    SELECT CASE WHEN a = floor(a) THEN CAST(CAST(a AS BIGINT) AS VARCHAR) ELSE {_SHORT.format(v='a')} END || '-' ||
        CASE WHEN z = floor(z) THEN CAST(CAST(z AS BIGINT) AS VARCHAR) ELSE {_SHORT.format(v='z')} END AS bin, count(*) AS count
    FROM e GROUP BY 1""")
add("histogram_summary", "finance", f"""WITH s AS (SELECT min(income) AS lo, max(income) AS hi,
        CAST(least(20, greatest(5, count(income) // 10)) AS INT) AS k FROM finance),
    c AS (SELECT least(k, 1 + CAST(floor((income - lo) / ((hi - lo) / k)) AS INT)) AS bin_no, count(*) AS n
          FROM finance, s WHERE income IS NOT NULL GROUP BY 1),
    g AS (SELECT CAST(unnest(range(1, k + 1)) AS INT) AS bin_no, lo, hi, k FROM s)
    SELECT bin_no, {half_up('lo + (hi - lo) / k * (bin_no - 1)', 1)} AS low,
        {half_up('CASE WHEN bin_no = k THEN hi ELSE lo + (hi - lo) / k * bin_no END', 1)} AS high, coalesce(n, 0) AS count
    FROM g LEFT JOIN c USING (bin_no)""")

# --- trends ------------------------------------------------------------------------------------


def series(view: str, date: str, columns: list[str], bucket: str) -> str:
    parts = union([f"SELECT '{c}' AS column_name, {bucket.replace('@', date)} AS b, avg({c}) AS v FROM {view} GROUP BY 2" for c in columns])
    return f"s AS ({parts})"


DAY, WEEK, MONTH = "CAST(@ AS DATE)", "CAST(date_trunc('week', @) + INTERVAL 6 DAY AS DATE)", "last_day(@)"
_POINTS = f"SELECT column_name, CAST(b AS VARCHAR) AS bucket, {half_up('v', 6)} AS value FROM s"
_MONTHLY = series("order_lines", "ship_date", LINE_NUMBERS, MONTH)
_EXACT_ORDERS = "(SELECT o_orderdate, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice FROM orders)"
_WEEKLY = series(_EXACT_ORDERS, "o_orderdate", ["o_totalprice"], WEEK)
add("trend_series", "readings", f"WITH {series('readings', 'ts', ['value', 'user_id'], DAY)} {_POINTS}")
add("trend_series_weekly", "", f"WITH {_WEEKLY} {_POINTS}")
add("trend_series_monthly", "order_lines", f"WITH {_MONTHLY} {_POINTS}")
add("trend_slope", "order_lines", f"""WITH {_MONTHLY}, i AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY b) - 1 AS x FROM s),
    f AS (SELECT column_name, count(*) AS buckets, regr_slope(v, x) AS m FROM i GROUP BY 1)
    SELECT column_name, buckets, {half_up('m', 6)} AS slope, CASE WHEN m > 0 THEN 'up' WHEN m < 0 THEN 'down' ELSE 'flat' END AS direction FROM f""")
add("trend_change", "order_lines", f"""WITH {_MONTHLY}, f AS (SELECT column_name, arg_min(v, b) AS a, arg_max(v, b) AS z, stddev_samp(v) AS sd FROM s GROUP BY 1)
    SELECT column_name, {half_up('a', 6)} AS first_value, {half_up('z', 6)} AS last_value, {half_up('z - a', 6)} AS absolute_change,
    {half_up('CASE WHEN a <> 0 THEN (z - a) / abs(a) * 100 END', 6)} AS percent_change, {half_up('sd', 6)} AS volatility FROM f""")
add("trend_anomalies", "order_lines", f"""WITH {_MONTHLY},
    z AS (SELECT *, (v - avg(v) OVER w) / stddev_samp(v) OVER w AS z FROM s WINDOW w AS (PARTITION BY column_name)),
    k AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY b) AS rn FROM z WHERE abs(z) >= 2.5)
    SELECT column_name, CAST(b AS VARCHAR) AS bucket, {half_up('v', 6)} AS value, {half_up('z', 6)} AS z_score FROM k WHERE rn <= 10""")
add("trend_tail", "", f"WITH {_WEEKLY} {_POINTS} ORDER BY bucket DESC LIMIT 100")


def gapfilled(bucket: str, step: str, shown: str) -> str:
    return f"""WITH g AS (SELECT CAST(date_trunc('{bucket}', order_date) AS DATE) AS b, sum(revenue) AS v FROM sales GROUP BY 1),
        spine AS (SELECT CAST(unnest(generate_series((SELECT min(b) FROM g)::TIMESTAMP, (SELECT max(b) FROM g)::TIMESTAMP, INTERVAL {step})) AS DATE) AS b)
        SELECT CAST({shown} AS VARCHAR) AS period, {cents('coalesce(v, 0)')} AS revenue FROM spine LEFT JOIN g USING (b)"""


add("trend_gapfilled_monthly", "sales", gapfilled("month", "1 MONTH", "b"))
add("trend_gapfilled_weekly", "sales", gapfilled("week", "7 DAY", "CAST(b + 6 AS DATE)"))
add("trend_gapfilled_quarterly", "sales", gapfilled("quarter", "3 MONTH", "b"))
add("trend_growth", "sales", f"""WITH g AS (SELECT date_trunc('month', order_date) AS b, sum(revenue) AS v FROM sales GROUP BY 1),
    e AS (SELECT date_diff('month', min(b), max(b)) + 1 AS periods, {cents('arg_min(v, b)')} AS a, {cents('arg_max(v, b)')} AS z FROM g)
    SELECT periods, a AS first_value, z AS last_value, {half_up('CASE WHEN periods >= 2 AND a <> 0 THEN (z - a) / abs(a) * 100 END', 2)} AS growth_pct FROM e""")
add("single_period_warning", "sales", """SELECT count(DISTINCT date_trunc('month', order_date)) AS periods,
    count(DISTINCT date_trunc('month', order_date)) = 1 AS single_period FROM sales""")

# --- rankings ----------------------------------------------------------------------------------

add("tools_top_products", "sales", ranked("sales", "product", "revenue", "product", "revenue", 10))
add("bottom_products", "sales", ranked("sales", "product", "revenue", "product", "revenue", 10, "ASC"))
add("dimension_performance", "sales", ranked("sales", "region", "revenue", "region", "revenue", 10))
add("rank_groups", "sales", ranked("sales", "brand", "revenue", "brand", "revenue", 5, "ASC"))
add("trending_products", "sales", f"""WITH months AS (SELECT DISTINCT date_trunc('month', order_date) AS m FROM sales ORDER BY 1 DESC LIMIT 2),
    g AS (SELECT product, coalesce(sum(revenue) FILTER (WHERE date_trunc('month', order_date) = (SELECT max(m) FROM months)), 0) AS a,
        coalesce(sum(revenue) FILTER (WHERE date_trunc('month', order_date) = (SELECT min(m) FROM months)), 0) AS b
        FROM sales WHERE date_trunc('month', order_date) IN (SELECT m FROM months) GROUP BY 1),
    r AS (SELECT product, {cents('a')} AS recent_revenue, {cents('b')} AS previous_revenue, {half_up(
        'CASE WHEN b <> 0 THEN (CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) / CAST(b AS DOUBLE) * 100 WHEN a <> 0 THEN 100 ELSE 0 END', 1)} AS growth_pct FROM g)
    SELECT * FROM r ORDER BY growth_pct DESC, product LIMIT 10""")
add("revenue_trend_weekly", "sales", f"""SELECT strftime(date_trunc('week', order_date), '%Y-%m-%d') || '/' ||
    strftime(date_trunc('week', order_date) + INTERVAL 6 DAY, '%Y-%m-%d') AS period, {cents('sum(revenue)')} AS revenue FROM sales GROUP BY 1""")
add("revenue_trend_yearly", "sales", f"SELECT strftime(order_date, '%Y') AS period, {cents('sum(revenue)')} AS revenue FROM sales GROUP BY 1")


def _compared(c: str) -> str:
    total = f"sum(CAST({c} AS DECIMAL(18,4)))"
    return f"{half_up(f'CAST({total} AS DOUBLE) / count({c})', 2)} AS {c}_mean, {cents(total)} AS {c}_sum, count({c}) AS {c}_count"


add("compare_groups", "order_lines", f"""SELECT return_flag, {_compared('quantity')}, {_compared('gross_sales')}
    FROM order_lines WHERE return_flag IS NOT NULL GROUP BY 1 ORDER BY count(gross_sales) DESC, 1 LIMIT 20""")
add("insight_best_worst", "sales", f"""WITH g AS (SELECT category AS k, sum(revenue) AS v FROM sales GROUP BY 1),
    t AS (SELECT * FROM g ORDER BY v DESC, k LIMIT 1), w AS (SELECT * FROM g ORDER BY v, k LIMIT 1)
    SELECT t.k AS best_group, {cents('t.v')} AS best_value, w.k AS worst_group, {cents('w.v')} AS worst_value
    FROM t, w WHERE (SELECT count(*) FROM g) >= 2""")
add("insight_recent_growth", "sales", f"""WITH g AS (SELECT date_trunc('month', order_date) AS b, sum(revenue) AS v, count(*) AS n FROM sales GROUP BY 1),
    spine AS (SELECT unnest(generate_series((SELECT min(b) FROM g)::TIMESTAMP, (SELECT max(b) FROM g)::TIMESTAMP, INTERVAL 1 MONTH)) AS b),
    m AS (SELECT row_number() OVER (ORDER BY spine.b) AS i, count(*) OVER () AS k, CAST(coalesce(v, 0) AS DOUBLE) AS v FROM spine LEFT JOIN g USING (b)),
    e AS (SELECT max(k) AS months, avg(v) FILTER (WHERE i > k - 3) AS recent, avg(v) FILTER (WHERE i <= 3) AS older FROM m)
    SELECT months, {half_up('recent', 2)} AS recent_avg, {half_up('older', 2)} AS older_avg, {half_up('(recent - older) / abs(older) * 100', 1)} AS change_pct
    FROM e WHERE months >= 3 AND older <> 0 AND (SELECT sum(n) FROM g) >= 10""")
add("insight_concentration", "sales", f"""WITH g AS (SELECT region, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1),
    t AS (SELECT sum(v) AS top FROM (SELECT v FROM g ORDER BY v DESC, region LIMIT 3)),
    p AS (SELECT (SELECT count(*) FROM g) AS groups, {half_up('top / (SELECT sum(v) FROM g) * 100', 1)} AS top_share_pct FROM t)
    SELECT * FROM p WHERE groups >= 5 AND top_share_pct > 50""")
add("filter_contains", "catalog", "SELECT * FROM catalog WHERE lower(food_name) LIKE '%ring%'")
add("filter_regex", "catalog", "SELECT * FROM catalog WHERE regexp_matches(food_name, '(small|large) r', 'i')")
add("filter_number", "catalog", "SELECT count(*) FILTER (WHERE calories = 24) AS matching_rows, count(*) AS total_rows FROM catalog")
add("filter_shown", "catalog", "SELECT * FROM catalog WHERE lower(food_name) LIKE '%widget%' ORDER BY entry_no LIMIT 20")
add("filter_value_counts", "catalog", """SELECT category AS value, count(*) AS count FROM catalog WHERE category IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")

# --- ledger, leads, customers, finance, catalog ------------------------------------------------

_LEDGER = """t AS (SELECT sum(CASE WHEN kind = 'SALES' THEN amount ELSE 0 END) AS s, sum(CASE WHEN kind = 'EXPENSE' THEN amount ELSE 0 END) AS e,
    sum(CASE WHEN kind = 'UDHAAR' THEN amount ELSE 0 END) AS u, count(*) AS n, count(*) FILTER (WHERE kind = 'SALES') AS sn,
    count(*) FILTER (WHERE kind = 'EXPENSE') AS en, count(*) FILTER (WHERE kind = 'UDHAAR') AS un FROM ledger)"""
add("ledger_summary", "ledger", f"""WITH {_LEDGER} SELECT {cents('s')} AS total_sales, {cents('e')} AS total_expenses, {cents('u')} AS credit_outstanding,
    {cents('s - e')} AS net_profit, CASE WHEN s >= e THEN 'Profit' ELSE 'Loss' END AS profit_status, n AS transaction_count,
    sn AS sales_transaction_count, en AS expense_transaction_count, un AS credit_transaction_count FROM t""")
add("ledger_profit", "ledger", f"WITH {_LEDGER} " + named_rows("metric", "amount", [
    ("sales", cents("s")), ("expenses", cents("e")), ("net_profit", cents("s - e"))], "t"))
_LEDGER_MONTHS = f"""m AS (SELECT strftime(date, '%Y-%m') AS period, {cents('sum(amount)')} AS sales_revenue FROM ledger WHERE kind = 'SALES' GROUP BY 1)"""
add("ledger_revenue_by_month", "ledger", f"WITH {_LEDGER_MONTHS} SELECT * FROM m")
add("ledger_change", "ledger", f"""WITH {_LEDGER_MONTHS}, e AS (SELECT count(*) AS periods, arg_min(sales_revenue, period) AS a, arg_max(sales_revenue, period) AS z FROM m)
    SELECT periods, a AS first_value, z AS last_value, {half_up('CASE WHEN a <> 0 THEN (z - a) / a * 100 ELSE 0 END', 1)} AS change_pct FROM e WHERE periods >= 2""")


def ledger_items(kind: str, label: str, value: str, limit: int | None) -> str:
    last = f" ORDER BY sum(amount) DESC, item LIMIT {limit}" if limit else ""
    return f"SELECT item AS {label}, {cents('sum(amount)')} AS {value} FROM ledger WHERE kind = '{kind}' GROUP BY item{last}"


add("ledger_sales_items", "ledger", ledger_items("SALES", "item", "sales_revenue", 10))
add("ledger_expenses", "ledger", ledger_items("EXPENSE", "item", "total_expense", None))
add("ledger_credit", "ledger", ledger_items("UDHAAR", "customer", "credit_outstanding", 10))
add("ledger_type_totals", "ledger", f"SELECT kind AS transaction_type, {cents('sum(amount)')} AS amount FROM ledger GROUP BY 1")
add("ledger_item_roles", "ledger", """SELECT DISTINCT kind AS transaction_type, CASE kind WHEN 'SALES' THEN 'product_or_item'
    WHEN 'UDHAAR' THEN 'customer' WHEN 'EXPENSE' THEN 'expense_description' ELSE 'transaction_description' END AS item_role FROM ledger""")
add("is_ledger", "ledger", "SELECT TRUE AS has_ledger_columns, count(*) FILTER (WHERE kind IN ('SALES', 'EXPENSE', 'UDHAAR')) > 0 AS is_ledger FROM ledger")
add("ledger_sales_rows", "ledger", "SELECT entry_id, line_no, item, CAST(amount AS DOUBLE) AS amount_value FROM ledger WHERE kind = 'SALES'")


def tier(column: str) -> str:
    def has(*parts: str) -> str:
        return " OR ".join(f"contains(lower({column}), '{p}')" for p in parts)
    return f"""CASE WHEN {column} IS NULL THEN 0 WHEN {has('100m', '201-500', '500', 'enterprise')} THEN 4
        WHEN {has('50m', '51-200', '200')} THEN 3 WHEN {has('10m', '11-50', '50')} THEN 2 WHEN trim({column}) <> '' THEN 1 ELSE 0 END"""


add("lead_score", "leads", f"""SELECT business_name, country, coalesce(industry, '') AS industry,
    CAST({tier('employee_range')} + 2 * {tier('revenue_range')} AS BIGINT) AS lead_score FROM leads ORDER BY 4 DESC, 1, 2, 3 LIMIT 10""")


def counted(view: str, column: str, count: str, label: str = "value", limit: int = 20) -> str:
    return f"SELECT coalesce({column}, 'Unknown') AS {label}, count(*) AS {count} FROM {view} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {limit}"


for _column in ("country", "industry", "employee_range", "revenue_range"):
    add(f"leads_by_{_column}", "leads", counted("leads", _column, "businesses"))
add("leads_top_industry", "leads", counted("leads", "industry", "businesses", "industry", 1))
_NO_SITE = "count(*) FILTER (WHERE website IS NULL OR trim(website) = '')"
add("leads_no_website", "leads", f"SELECT 'missing_websites' AS metric, {_NO_SITE} AS businesses FROM leads")
add("leads_overview", "leads", f"""SELECT 'Business records' AS metric, count(*) AS value FROM leads UNION ALL SELECT 'Columns', 8
    UNION ALL SELECT 'Missing websites', {_NO_SITE} FROM leads""")
add("top_customers_share", "customers", f"""SELECT customer, {cents('spend')} AS total_spend,
    {half_up('CAST(spend AS DOUBLE) * 100 / CAST((SELECT sum(spend) FROM customers) AS DOUBLE)', 1)} AS share_pct
    FROM customers ORDER BY spend DESC, customer LIMIT 10""")
add("customer_segments", "customers", counted("customers", "segment", "customers"))
add("customer_locations", "customers", counted("customers", "country", "customers"))
add("finance_expense", "finance", f"""SELECT account AS category, {cents('sum(coalesce(CAST(expense AS DECIMAL(18,4)), 0))')} AS total_expense
    FROM finance GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
add("finance_income_expense", "finance", "WITH t AS (SELECT sum(CAST(income AS DECIMAL(18,4))) AS i, sum(CAST(expense AS DECIMAL(18,4))) AS e FROM finance) "
    + named_rows("metric", "amount", [("income", cents("i")), ("expense", cents("e")), ("net", cents("i - e"))], "t"))
add("finance_monthly", "finance", f"""SELECT strftime(transaction_date, '%Y-%m') AS period, {cents('sum(CAST(income AS DECIMAL(18,4)))')} AS income
    FROM finance WHERE income IS NOT NULL GROUP BY 1""")
add("catalog_frequency", "catalog", top_values("catalog", ["food_name", "category", "cuisine"], 20, "trim(@)", "value <> ''"))
add("catalog_stats", "catalog", per_column("catalog", ["calories", "price"], f"""{half_up('min(@)', 2)} AS min, {half_up('max(@)', 2)} AS max,
    {half_up('avg(@)', 2)} AS mean, {half_up(quantile('@', 0.5), 2)} AS median"""))

# --- column meaning ----------------------------------------------------------------------------

_DATE_SHAPE = r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"
_RANGE_SHAPE = r"\d+\s*[-–]\s*\d+|\$|m\b|million|k\b|employees?"


def shapes(view: str, columns: list[str], text: set[str]) -> str:
    parts = []
    for c in columns:
        v = f"CAST({c} AS VARCHAR)"
        is_text = "TRUE" if c in text else "FALSE"
        parts.append(f"""SELECT '{c}' AS column_name, {is_text} AS is_text, count({c}) AS n,
            count(*) FILTER (WHERE {is_text} AND regexp_matches({v}, '{_DATE_SHAPE}')) AS shaped,
            count(CASE WHEN {is_text} THEN TRY_CAST({v} AS TIMESTAMP) END) AS dated,
            count(TRY_CAST({v} AS DOUBLE)) AS numbers,
            count(*) FILTER (WHERE {is_text} AND regexp_matches({v}, '{_RANGE_SHAPE}', 'i')) AS ranged FROM {view}""")
    return f"h AS ({union(parts)})"


_NUMERIC_LIKE = "(NOT is_text OR (n > 0 AND numbers >= greatest(2, floor(0.7 * n))))"
_DIRTY_SHAPES = f"WITH {shapes('dirty', DIRTY, DIRTY_TEXT)}"
add("date_like", "dirty", f"""{_DIRTY_SHAPES} SELECT column_name, is_text AND n > 0 AND shaped >= greatest(1, floor(0.5 * n))
    AND dated >= greatest(2, floor(0.55 * n)) AS date_like FROM h""")
add("numeric_like", "dirty", f"{_DIRTY_SHAPES} SELECT column_name, {_NUMERIC_LIKE} AS numeric_like FROM h")
_LEADS = ["business_id", "business_name", "website", "employee_range", "revenue_range", "country", "region", "industry"]
add("range_like", "leads", f"""WITH {shapes('leads', _LEADS, set(_LEADS) - {'business_id'})}
    SELECT column_name, n > 0 AND ranged >= greatest(1, floor(0.4 * n)) AS range_like FROM h""")
add("column_roles", "dirty", f"""{_DIRTY_SHAPES} SELECT column_name, CASE WHEN column_name = 'order_date' THEN 'order_date'
    WHEN column_name IN ('amount', 'total') AND {_NUMERIC_LIKE} THEN 'sales_amount' WHEN is_text THEN 'generic_text' ELSE 'unknown' END AS role FROM h""")
add("semantic_roles", "", """SELECT * FROM (VALUES ('order_id', 'order_id'), ('product_id', 'product'), ('quantity', 'quantity'),
    ('gross_sales', 'gross_sales'), ('discount', 'discount'), ('tax', 'tax'), ('return_flag', 'generic_text'),
    ('line_status', 'generic_text'), ('ship_date', 'transaction_date')) AS r(column_name, role)""")
add("dataset_type", "", "SELECT 'generic_tabular' AS dataset_type, CAST(0.35 AS DOUBLE) AS confidence")
add("dataset_type_scores", "leads", """WITH p AS (SELECT 'business_leads' AS dataset_type, 0.28 + 0.18 + 0.16 + 0.16 + 0.14 + 0.08 AS score
    UNION ALL SELECT k, 0.0 FROM (VALUES ('sales'), ('customer'), ('finance'), ('food_dataset')) AS v(k) UNION ALL SELECT 'generic', 0.05)
    SELECT dataset_type, CAST(score AS DOUBLE) AS score, score = (SELECT max(score) FROM p) AS chosen FROM p""")
add("identifier_like", "dirty", f"""WITH {_DIRTY} SELECT column_name, {half_up('d * 1.0 / filled', 4)} AS distinct_share,
    column_name NOT IN ('total', 'custkey') AND d > 0.95 * filled AND filled >= 20 AS is_identifier_like FROM f""")
add("safe_features", "dirty", f"""WITH {_DIRTY}, r AS (SELECT column_name, CASE WHEN column_name = 'total' THEN 'target' WHEN d <= 1 THEN 'constant'
    WHEN column_name NOT IN ('total', 'custkey') AND d > 0.95 * filled AND filled >= 20 THEN 'identifier'
    WHEN column_name NOT IN ('total', 'custkey') AND d > 50 THEN 'high_cardinality' ELSE '' END AS reason FROM f)
    SELECT column_name, reason = '' AS is_feature, reason FROM r""")

# How well each name suggests a number or a class: string similarity, which SQL does not have.
_NAME_FITS = """f AS (SELECT * FROM (VALUES ('order_id', TRUE, 0.043077, 0.065882), ('product_id', TRUE, 0.070000, 0.062222),
    ('quantity', TRUE, 0.060000, 0.052500), ('gross_sales', TRUE, 0.180000, 0.044211), ('discount', TRUE, 0.080000, 0.065882),
    ('tax', TRUE, 0.070000, 0.062222), ('return_flag', FALSE, 0.046667, 0.052500), ('line_status', FALSE, 0.052500, 0.180000),
    ('ship_date', FALSE, 0.060000, 0.056000)) AS v(column_name, number, reg, cls))"""
_LINE_COLUMNS = ["order_id", "product_id", "quantity", "gross_sales", "discount", "tax", "return_flag", "line_status", "ship_date"]
add("target_suggestions", "order_lines", f"""WITH {_NAME_FITS},
    c AS ({per_column('order_lines', _LINE_COLUMNS, 'count(*) AS n, count(@) AS filled, count(DISTINCT @) AS d')}),
    t AS (SELECT *, CASE WHEN d BETWEEN 2 AND greatest(20, floor(filled * CASE WHEN number THEN 0.2 ELSE 0.4 END)) THEN 'classification'
            WHEN number THEN 'regression' WHEN d >= 2 AND d <= 0.3 * filled THEN 'classification' END AS task_type,
        (column_name IN ('order_id', 'product_id') AND d > 0.65 * filled) OR (NOT number AND d > 0.95 * filled AND filled >= 20) AS identifier
        FROM c JOIN f USING (column_name) WHERE filled >= 10),
    s AS (SELECT *, least(0.12, filled * 0.12 / n) + CASE task_type WHEN 'regression' THEN 0.55 + reg + 0.12
            + CASE WHEN d > 0.7 * filled THEN 0.08 ELSE 0 END - CASE WHEN d < 5 THEN 0.25 ELSE 0 END
        ELSE 0.52 + cls + CASE WHEN d <= greatest(10, floor(filled * 0.25)) THEN 0.12 ELSE 0 END
            + CASE WHEN d <= 0.3 * filled THEN 0.08 ELSE 0 END - CASE WHEN d <= 2 THEN 0.05 ELSE 0 END
            - CASE WHEN number AND d > 20 THEN 0.15 ELSE 0 END END AS raw FROM t WHERE task_type IS NOT NULL AND NOT identifier),
    r AS (SELECT *, {half_up('greatest(0, least(0.99, raw))', 3)} AS confidence FROM s)
    SELECT column_name, task_type, confidence, filled AS non_null_rows, d AS unique_values, confidence >= 0.5 AS safe
    FROM r ORDER BY confidence DESC, filled DESC LIMIT 6""")

# --- sources -----------------------------------------------------------------------------------

add("csv_repair", "", """SELECT CAST(p_partkey AS VARCHAR) AS entry_no,
    CASE WHEN p_partkey % 5 = 3 THEN p_name || ', "boxed"' ELSE p_name END AS name,
    CASE WHEN p_partkey % 5 <> 1 THEN p_brand END AS brand,
    CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || ',extra,more' WHEN 1 THEN NULL WHEN 3 THEN '1'
        ELSE CAST(p_size AS VARCHAR) END AS size FROM part WHERE p_partkey % 17 <> 0""")
add("csv_multiline", "", """SELECT CAST(p_partkey AS VARCHAR) AS entry_no,
    CASE p_partkey % 4 WHEN 0 THEN p_name || chr(10) || '"boxed", second line' || chr(10) || chr(10)
        WHEN 1 THEN p_name || chr(10) || ', third' ELSE p_name END AS name,
    CASE p_partkey % 4 WHEN 1 THEN '5" wide' ELSE p_brand END AS brand FROM part""")
add("numeric_promotion", "", "SELECT p_partkey, p_name, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part")
_REGISTRY = "SELECT o_orderkey AS dataset_id, o_custkey AS user_id, o_orderdate AS created_at FROM orders"
add("recent_datasets", "", f"{_REGISTRY} ORDER BY 3 DESC, 1 DESC LIMIT 50")
add("recent_datasets_of_user", "", f"{_REGISTRY} WHERE o_custkey = 7 ORDER BY 3 DESC, 1 DESC LIMIT 50")
add("report_detail", "", """SELECT o_orderkey AS source, CAST(9 AS INT) AS line_no, strftime(o_orderdate, '%Y-%m-%d') AS date, 'SALES' AS category,
        'Rice, 5kg' AS item, o_totalprice AS amount FROM orders
    UNION ALL SELECT o_orderkey, 10, strftime(o_orderdate, '%Y-%m-%d'), 'EXPENSE', 'Rent', CAST(o_custkey AS DOUBLE) FROM orders""")
add("report_summary", "", """SELECT o_orderkey AS source, 'metadata' AS section, 'report_title' AS key, 'Ledger Report' AS value FROM orders
    UNION ALL SELECT o_orderkey, 'metadata', 'Shop Name', 'Shop ' || CAST(o_custkey AS VARCHAR) FROM orders
    UNION ALL SELECT o_orderkey, 'metadata', 'Generated At', strftime(o_orderdate, '%Y-%m-%d') FROM orders
    UNION ALL SELECT o_orderkey, 'summary', 'Total Sales', 'Rs ' || format('{:,.2f}', o_totalprice) FROM orders
    UNION ALL SELECT o_orderkey, 'summary', 'Profit Status', 'Profit' FROM orders""")

# --- models ------------------------------------------------------------------------------------

add("regression_metrics", "", f"""WITH p AS (SELECT l_extendedprice AS y, l_quantity * 2100.0 AS p FROM lineitem),
    t AS (SELECT count(*) AS n, avg((y - p) * (y - p)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS v FROM p)
    SELECT n, {half_up('sqrt(mse)', 6)} AS rmse, {half_up('mae', 6)} AS mae, {half_up('1 - mse / v', 6)} AS r2 FROM t""")
_PAIRS = "p AS (SELECT CAST(quality AS VARCHAR) AS actual, CAST(toxic AS VARCHAR) AS predicted FROM labels)"
add("classification_metrics", "", f"""WITH {_PAIRS}, l AS (SELECT DISTINCT actual AS label FROM p UNION SELECT predicted FROM p),
    c AS (SELECT label, CAST((SELECT count(*) FROM p WHERE actual = label) AS DOUBLE) AS real,
        CAST((SELECT count(*) FROM p WHERE predicted = label) AS DOUBLE) AS said,
        CAST((SELECT count(*) FROM p WHERE predicted = label AND actual = label) AS DOUBLE) AS hit FROM l),
    r AS (SELECT *, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS pr, CASE WHEN real > 0 THEN hit / real ELSE 0 END AS re FROM c),
    f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM r)
    SELECT CAST(sum(real) AS BIGINT) AS n, {half_up('sum(hit) / sum(real)', 6)} AS accuracy,
        {half_up('sum(pr * real) / sum(real)', 6)} AS precision_weighted, {half_up('sum(re * real) / sum(real)', 6)} AS recall_weighted,
        {half_up('sum(f1 * real) / sum(real)', 6)} AS f1_weighted FROM f""")
add("confusion_matrix", "", f"""WITH {_PAIRS}, l AS (SELECT DISTINCT actual AS label FROM p UNION SELECT predicted FROM p)
    SELECT a.label AS actual, b.label AS predicted, (SELECT count(*) FROM p WHERE p.actual = a.label AND p.predicted = b.label) AS count
    FROM l a, l b""")
add("class_balance", "", f"""WITH {_PAIRS}, c AS (SELECT predicted AS label, count(*) AS count FROM p GROUP BY 1)
    SELECT label, count, {half_up('count * 1.0 / (SELECT sum(count) FROM c)', 6)} AS share,
        (SELECT max(count) * 1.0 / sum(count) >= 0.9 FROM c) AS imbalanced FROM c""")


def _determined(feature: str) -> str:
    return f"""SELECT '{feature}' AS feature, count(*) AS feature_values, {half_up('count(*) FILTER (WHERE d = 1) * 1.0 / count(*)', 6)} AS determined_share,
        count(*) FILTER (WHERE d = 1) >= 0.9 * count(*) AS near_deterministic
        FROM (SELECT {feature}, count(DISTINCT category) AS d FROM catalog WHERE category IS NOT NULL AND {feature} IS NOT NULL GROUP BY 1)"""


add("leakage_determinism", "catalog", union([_determined(f) for f in ("food_name", "entry_no", "cuisine")]))

# --- free-form tools ---------------------------------------------------------------------------

_INCOME = "(SELECT transaction_date AS d, CAST(income AS DECIMAL(18,4)) AS v FROM finance WHERE income IS NOT NULL)"
add("time_series_mean", "finance", f"""SELECT CAST(last_day(d) AS VARCHAR) AS bucket,
    {half_up('CAST(sum(v) AS DOUBLE) / count(v)', 6)} AS value FROM {_INCOME} GROUP BY 1""")
add("time_series_count", "finance", f"""SELECT strftime(date_trunc('week', d) + INTERVAL 6 DAY, '%Y-%m-%d') AS bucket,
    CAST(count(*) AS DOUBLE) AS value FROM {_INCOME} GROUP BY 1""")
_G = "CAST(gross_sales AS DECIMAL(18,4))"
add("group_aggregation", "order_lines", f"""SELECT return_flag, line_status, {cents(f'sum({_G})')} AS gross_sales_sum,
    {half_up(f'CAST(sum({_G}) AS DOUBLE) / count(gross_sales)', 6)} AS gross_sales_mean, count(gross_sales) AS gross_sales_count,
    min(gross_sales) AS gross_sales_min, max(gross_sales) AS gross_sales_max FROM order_lines GROUP BY 1, 2""")
add("scatter_correlation", "order_lines", f"""WITH {bounds('order_lines', ['gross_sales'])}
    SELECT return_flag AS color, count(*) AS points, {half_up('corr(quantity, gross_sales)', 6)} AS correlation,
    count(*) FILTER (WHERE gross_sales < lo OR gross_sales > hi) AS outliers FROM order_lines, o GROUP BY 1""")
add("metric_ratio", "order_lines", f"""SELECT return_flag, {half_up(
    f'CAST(sum({_G}) AS DOUBLE) / CAST(sum(CAST(quantity AS DECIMAL(18,4))) AS DOUBLE)', 6)} AS ratio FROM order_lines GROUP BY 1""")
add("metric_growth", "sales", f"""WITH g AS (SELECT strftime(order_date, '%Y-%m') AS period, CAST(sum(revenue) AS DOUBLE) AS v FROM sales GROUP BY 1),
    l AS (SELECT *, lag(v) OVER (ORDER BY period) AS b FROM g)
    SELECT period, {half_up('v', 2)} AS value, {half_up('CASE WHEN b <> 0 THEN (v - b) / abs(b) * 100 END', 2)} AS growth_pct FROM l""")
add("metric_tiers", "customers", """SELECT customer, country, segment, signup_date, CAST(spend AS DOUBLE) AS spend,
    CASE WHEN spend >= 3000000 THEN 'Gold' WHEN spend >= 1500000 THEN 'Silver' WHEN spend >= 0 THEN 'Bronze' END AS tier FROM customers""")
add("metric_median", "order_lines", f"SELECT {quantile('gross_sales', 0.5)} AS value FROM order_lines")
add("metric_sum", "order_lines", f"SELECT {cents(f'sum({_G})')} AS value FROM order_lines")


def _welch(metric: str) -> str:
    a, b = f"CASE WHEN return_flag = 'A' THEN {metric} END", f"CASE WHEN return_flag = 'R' THEN {metric} END"
    return f"""SELECT '{metric}' AS metric, count({a}) AS n_a, count({b}) AS n_b, avg({a}) AS m_a, avg({b}) AS m_b,
        var_samp({a}) / count({a}) AS e_a, var_samp({b}) / count({b}) AS e_b FROM order_lines"""


add("segments_welch", "order_lines", f"""WITH w AS ({union([_welch('quantity'), _welch('gross_sales')])})
    SELECT metric, n_a, n_b, {half_up('m_a', 6)} AS mean_a, {half_up('m_b', 6)} AS mean_b, {half_up('(m_a - m_b) / sqrt(e_a + e_b)', 6)} AS statistic,
    {half_up('(e_a + e_b) * (e_a + e_b) / (e_a * e_a / (n_a - 1) + e_b * e_b / (n_b - 1))', 4)} AS degrees FROM w""")
add("segments_ranks", "order_lines", """WITH v AS (SELECT gross_sales AS v, return_flag = 'A' AS a FROM order_lines WHERE return_flag IN ('A', 'R')),
    g AS (SELECT v, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE NOT a) AS b FROM v GROUP BY 1),
    c AS (SELECT *, coalesce(sum(b) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
    SELECT CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b, CAST(sum(a * (below + b / 2.0)) AS DOUBLE) AS statistic,
    sum(power(CAST(a + b AS DOUBLE), 3) - (a + b)) AS tie_term FROM c""")
_RETAIL = """retail AS (SELECT l_quantity AS quantity, p_retailprice AS unit_price, p_type AS category,
    CAST(CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS DOUBLE) AS total_sales FROM lineitem JOIN part ON l_partkey = p_partkey),
    wide AS (SELECT *, total_sales - unit_price * quantity AS profit FROM retail)"""


def _line_of(target: str) -> str:
    """Normal equations of two features, solved by determinants."""
    return f"""SELECT '{target}' AS target, var_pop(quantity) AS a, covar_pop(quantity, unit_price) AS b, var_pop(unit_price) AS c, covar_pop(quantity, {target}) AS x,
        covar_pop(unit_price, {target}) AS y, var_pop({target}) AS v, avg({target}) AS m, avg(quantity) AS mq, avg(unit_price) AS mu FROM wide"""


add("linear_targets", "", f"""WITH {_RETAIL}, s AS ({union([_line_of('total_sales'), _line_of('profit')])}),
    w AS (SELECT *, (x * c - y * b) / (a * c - b * b) AS p, (y * a - x * b) / (a * c - b * b) AS q FROM s),
    o AS (SELECT *, (p * x + q * y) / v AS r FROM w)
    SELECT target, 'quantity' AS feature, {half_up('p', 6)} AS coefficient, {half_up('r', 6)} AS r2 FROM o
    UNION ALL SELECT target, 'unit_price', {half_up('q', 6)}, {half_up('r', 6)} FROM o
    UNION ALL SELECT target, 'intercept', {half_up('m - p * mq - q * mu', 6)}, {half_up('r', 6)} FROM o""")
add("metric_targets", "", f"""WITH {_RETAIL}, n AS (SELECT count(profit) AS p, count(quantity) AS q, count(category) AS c, count(total_sales) AS t FROM wide)
    SELECT 'how will profit change' AS question, 'profit' AS target_column, 'regression' AS task_type, p AS filled_rows FROM n
    UNION ALL SELECT 'units next month', 'quantity', 'regression', q FROM n UNION ALL SELECT 'which category is this', 'category', 'classification', c FROM n
    UNION ALL SELECT 'sales next month', 'total_sales', 'regression', t FROM n UNION ALL SELECT 'what next', 'total_sales', 'regression', t FROM n""")
_DATES = """texts AS (SELECT o_orderkey AS order_id, strftime(o_orderdate, '%-d/%-m/%Y') AS day_first, strftime(o_orderdate, '%-m-%-d-%Y') AS month_first,
    strftime(o_orderdate, '%-m/%-m/%Y') AS alike, CASE WHEN o_orderkey % 10 > 0 THEN strftime(o_orderdate, '%d/%m/%y %H:%M') END AS short FROM orders)"""


def _votes(column: str, month: str, day: str) -> str:
    return f"""SELECT '{column}' AS column_name, count(try_strptime({column}, '{month}')) AS month_first, count(try_strptime({column}, '{day}')) AS day_first FROM texts"""


add("date_orders", "", f"""WITH {_DATES}, v AS ({union([_votes('day_first', '%m/%d/%Y', '%d/%m/%Y'), _votes('month_first', '%m-%d-%Y', '%d-%m-%Y'),
    _votes('alike', '%m/%d/%Y', '%d/%m/%Y'), _votes('short', '%m/%d/%y %H:%M', '%d/%m/%y %H:%M')])})
    SELECT *, CASE WHEN month_first = day_first THEN 'either' WHEN day_first > month_first THEN 'day first' ELSE 'month first' END AS date_order FROM v""")
add("written_dates", "", """SELECT o_orderkey AS order_id, CAST(o_orderdate AS TIMESTAMP) AS day_first, CAST(o_orderdate AS TIMESTAMP) AS month_first,
    CAST(make_date(year(o_orderdate), month(o_orderdate), month(o_orderdate)) AS TIMESTAMP) AS alike,
    CASE WHEN o_orderkey % 10 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS short FROM orders""")
_LARGE = """large AS (SELECT CAST(l_linenumber % 3 AS VARCHAR) AS store, l_returnflag, CASE WHEN l_linenumber < 6 THEN CAST(l_extendedprice AS DECIMAL(18,4)) END AS small,
    CASE l_linenumber WHEN 6 THEN l_quantity * pow(2, 50) WHEN 7 THEN pow(2, 1000) END AS rest FROM lineitem)"""


def _large_sum(key: str, name: str, value: str) -> str:
    return f"""WITH {_LARGE} SELECT {key} AS {name}, CASE WHEN sum(rest) IS NULL THEN CAST(round(sum(small), 2) AS DOUBLE)
        ELSE round(coalesce(CAST(sum(small) AS DOUBLE), 0) + sum(rest), 2) END AS {value} FROM large GROUP BY 1"""


add("large_amounts_by_store", "", _large_sum("store", "store", "revenue"))
add("large_amounts_ranked", "", _large_sum("l_returnflag", "l_returnflag", "amount"))
add("json_safe", "", f"""SELECT l_orderkey AS order_id, l_linenumber AS line_no, CASE WHEN l_linenumber < 5 THEN {half_up('l_extendedprice / 7', 6)} END AS ratio FROM lineitem""")
add("report_cells", "", """SELECT l_orderkey AS order_id, l_linenumber AS line_no, CASE l_linenumber WHEN 1 THEN CAST(l_extendedprice AS VARCHAR) WHEN 3 THEN 'n/a' END AS text,
    CASE WHEN l_linenumber = 1 THEN l_extendedprice END AS number FROM lineitem""")
add("coerced_by_roles", "dirty", """SELECT order_ref, TRY_CAST(order_date AS TIMESTAMP) AS order_date, status, priority,
    TRY_CAST(amount AS DOUBLE) AS amount, total, custkey, channel FROM dirty""")
add("semantic_columns", "", """SELECT * FROM (VALUES ('business_id', 'business_id'), ('business_name', 'business_name'), ('country', 'country'), ('employee_range', 'employee_range'),
    ('industry', 'industry'), ('order_id', 'business_id'), ('region', 'region'), ('revenue_range', 'revenue_range'), ('website', 'website')) AS r(role, column_name)""")
add("metric_specs", "", """SELECT * FROM (VALUES ('discount', 'discount', CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)), ('quantity', 'quantity', NULL, NULL),
    ('revenue', 'gross_sales', NULL, NULL), ('tax', 'tax', NULL, NULL)) AS r(metric, column_name, times, type_column)""")
add("detected_columns", "", """SELECT use, CAST(position AS INTEGER) AS position, column_name FROM (VALUES ('date', 0, 'ship_date'), ('id', 0, 'order_id'), ('id', 1, 'product_id'),
    ('numeric', 0, 'order_id'), ('numeric', 1, 'product_id'), ('numeric', 2, 'quantity'), ('numeric', 3, 'gross_sales'), ('numeric', 4, 'discount'), ('numeric', 5, 'tax'),
    ('product', 0, 'product_id'), ('quantity', 0, 'quantity'), ('quantity', 1, 'discount'), ('revenue', 0, 'gross_sales'), ('sales', 0, 'quantity'), ('sales', 1, 'discount'),
    ('target', 0, 'quantity'), ('target', 1, 'gross_sales'), ('target', 2, 'discount'), ('target', 3, 'tax'), ('text', 0, 'return_flag'), ('text', 1, 'line_status')) AS r(use, position, column_name)""")
add("feasible_tasks", "", """SELECT task, count(*) AS rows FROM lineitem, (SELECT unnest(['summary', 'quality', 'trend', 'ranking', 'correlation', 'segments', 'prediction']) AS task) GROUP BY 1""")
add("chosen_target", "", "SELECT 'gross_sales' AS column_name, 'regression' AS task_type, CAST(0.99 AS DOUBLE) AS confidence FROM (SELECT count(*) AS n FROM lineitem) WHERE n >= 10")
add("customer_recommendations", "customers", f"""SELECT 'top_customers' AS topic, customer AS label, {cents('spend')} AS value
    FROM (SELECT * FROM customers ORDER BY spend DESC, customer LIMIT 10)
    UNION ALL SELECT 'distribution', value, CAST(customers AS DOUBLE) FROM ({counted("customers", "segment", "customers")})""")
add("scatter_points", "order_lines", "SELECT quantity, gross_sales, return_flag FROM order_lines WHERE quantity IS NOT NULL AND gross_sales IS NOT NULL")
