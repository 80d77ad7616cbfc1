"""Independent DuckDB SQL for every registered query (the correctness oracle).

Each statement re-derives the retail tables from the star schema with the
same adapter SQL (as CTEs) and computes the figure in plain SQL.
"""

from __future__ import annotations

AS_OF = "1998-06-01"

ADAPTER_CTES = """
f_suppliers AS (
  SELECT s_suppkey AS id, s_name AS name,
         CONCAT('info@', LOWER(REPLACE(s_name, ' ', '')), '.com') AS contact_email,
         '+265 ' || s_suppkey AS phone, 'Nation ' || s_nationkey AS address,
         TIMESTAMP '1990-01-01 00:00:00' + to_minutes(s_suppkey) AS created_at
  FROM supplier),
f_employees AS (
  SELECT c_custkey AS id, c_name AS name, LOWER(c_name) AS username,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'owner'
              WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'cashier' END AS role,
         c_acctbal < 0 AS must_change_password,
         TIMESTAMP '1990-01-01 00:00:00' + to_minutes(c_custkey) AS created_at,
         TIMESTAMP '1990-01-01 00:00:00' + to_minutes(c_custkey * 2) AS updated_at
  FROM customer),
f_products AS (
  SELECT p.p_partkey AS id, p.p_name AS name, p.p_type AS category,
         CAST(p.p_size - 1 AS INT) AS quantity, CAST(p.p_retailprice AS DECIMAL(10,2)) AS price,
         CASE WHEN p.p_partkey % 17 = 0 THEN NULL ELSE m.sk END AS supplier_id,
         TIMESTAMP '1990-01-01 00:00:00' + to_minutes(p.p_partkey) AS created_at,
         TIMESTAMP '1990-01-01 00:00:00' + to_minutes(p.p_partkey * 2) AS updated_at
  FROM part p LEFT JOIN (SELECT l_partkey, MIN(l_suppkey) AS sk FROM lineitem GROUP BY l_partkey) m
    ON p.p_partkey = m.l_partkey),
f_lines AS (
  SELECT *, CAST(l_orderkey * 1000 + ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY
           l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice,
           l_discount, l_tax, l_returnflag, l_linestatus) AS BIGINT) AS line_id
  FROM lineitem),
f_sales AS (
  SELECT line_id AS id, l_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price, CAST(l_quantity AS INT) AS quantity,
         CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(l_quantity AS INT) AS DECIMAL(10,2)) AS total_amount,
         CAST(l_shipdate AS DATE) AS sale_date, l_shipdate AS sale_timestamp,
         CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS cashier_id
  FROM f_lines JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
f_sale_requests AS (
  SELECT line_id AS request_id,
         CASE WHEN l_orderkey % 97 = 0 THEN CAST(-1 AS BIGINT) ELSE l_partkey END AS product_id,
         CAST(l_quantity AS INT) % 12 AS quantity, l_shipdate AS ts, CAST(NULL AS BIGINT) AS cashier_id
  FROM f_lines),
f_sale_feed AS (
  SELECT event_id AS request_id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
         CAST(event_id % 5 + 1 AS INT) AS quantity, user_id AS cashier_id
  FROM events WHERE event_type = 'purchase'),
f_product_changes AS (
  SELECT p_partkey AS request_id,
         CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 41 = 0 THEN 'PATCH'
              WHEN p_partkey % 5 = 0 THEN 'DELETE' WHEN p_partkey % 5 = 1 THEN 'INSERT' ELSE 'UPDATE' END AS op,
         CASE WHEN p_partkey % 5 = 1 THEN NULL WHEN p_partkey % 19 = 0 THEN 10000000 + p_partkey
              ELSE (p_partkey * 7) % 251 END AS id,
         CASE WHEN p_partkey % 11 = 0 THEN ' ' ELSE CONCAT(p_name, ' v2') END AS name,
         p_type AS category, CAST(p_size AS INT) AS quantity,
         CAST(p_retailprice + 1 AS DECIMAL(10,2)) AS price,
         CASE WHEN p_partkey % 13 = 0 THEN '' WHEN p_partkey % 43 = 0 THEN repeat('long ', 25) ELSE CONCAT('New Vendor ', CAST(p_partkey % 7 AS VARCHAR)) END AS supplier,
         CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CONCAT('v', CAST(p_partkey AS VARCHAR), '@x.com') END AS supplier_contact
  FROM part),
f_employee_changes AS (
  SELECT c_custkey AS request_id,
         CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN 'PATCH'
              WHEN c_custkey % 4 = 0 THEN 'DELETE' WHEN c_custkey % 4 = 1 THEN 'INSERT' ELSE 'UPDATE' END AS op,
         CASE WHEN c_custkey % 4 = 1 THEN NULL ELSE (c_custkey * 3) % 401 END AS id,
         CASE WHEN c_custkey % 29 = 0 THEN '' ELSE CONCAT(c_name, ' v2') END AS name,
         CASE WHEN c_custkey % 6 = 1 THEN LOWER(c_name)
              WHEN c_custkey % 10 = 5 THEN CONCAT('new', CAST(c_custkey % 40 AS VARCHAR))
              ELSE CONCAT('u', CAST(c_custkey AS VARCHAR)) END AS username,
         CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'admin' END AS role
  FROM customer)"""


def mt(x: str) -> str:
    """Money text in SQL."""
    return f"('M' || CAST(CAST(ROUND({x}, 2) AS DECIMAL(38,2)) AS VARCHAR))"


def lv(q: str, p: str) -> str:
    """quantity × price as DECIMAL(20,2)."""
    return f"CAST(CAST({q} AS DECIMAL(10,0)) * {p} AS DECIMAL(20,2))"


FALLBACK = "COALESCE(total_amount, unit_price * CAST(quantity AS DECIMAL(10,0)))"
MS = "DECIMAL(38,2)"


def with_adapters(body: str, extra_ctes: str = "", recursive: bool = False) -> str:
    head = "WITH RECURSIVE" if recursive else "WITH"
    extra = f",\n{extra_ctes}" if extra_ctes else ""
    return f"{head}{ADAPTER_CTES}{extra}\n{body}"


INV_VIEW = f"""
inv AS (
  SELECT p.id, p.name, p.category, p.quantity, p.price, {lv('p.quantity', 'p.price')} AS stock_value,
         s.name AS supplier_name, s.contact_email AS supplier_contact,
         CASE WHEN p.quantity = 0 THEN 'OUT OF STOCK' WHEN p.quantity < 10 THEN 'LOW STOCK'
              ELSE 'OK' END AS stock_status
  FROM f_products p LEFT JOIN f_suppliers s ON p.supplier_id = s.id)"""

PLIST = """
plist AS (
  SELECT p.id, p.name, p.category, p.quantity, p.price, s.name AS supplier,
         s.contact_email AS "supplierContact"
  FROM f_products p LEFT JOIN f_suppliers s ON p.supplier_id = s.id)"""

SALES_COLS = ('id, product_id AS "productId", product_name AS "productName", category, '
              'unit_price AS amount, quantity, total_amount, sale_date AS date, '
              'sale_timestamp AS timestamp')


def _dash(x: str) -> str:
    return f"COALESCE(NULLIF({x}, ''), '-')"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    A = with_adapters
    # scans
    q["scan_products"] = A("SELECT * FROM f_products")
    q["scan_sales"] = A("SELECT * FROM f_sales ORDER BY sale_timestamp DESC, id DESC")
    q["scan_suppliers"] = A("SELECT * FROM f_suppliers")
    q["scan_employees"] = A("SELECT * FROM f_employees")
    # listings
    q["sales_list"] = A(f"SELECT {SALES_COLS} FROM f_sales")
    q["product_list"] = A("SELECT * FROM plist", PLIST)
    q["supplier_list"] = A("SELECT * FROM f_suppliers")
    q["employee_roster"] = A('SELECT id, name, username, role, must_change_password AS "mustChangePassword" '
                             "FROM f_employees")
    q["employee_roster_labels"] = A(
        "SELECT id, name, username, CASE WHEN role = 'admin' THEN 'Admin' WHEN role = 'owner' "
        "THEN 'Owner' ELSE 'Cashier' END AS role_label, CASE WHEN COALESCE(must_change_password, false) "
        "THEN 'Password required' ELSE 'Active' END AS status FROM f_employees")
    q["supplier_per_product"] = A(
        f"SELECT id, name, {_dash('supplier')} AS supplier, {_dash('\"supplierContact\"')} AS contact, "
        f"{mt('price')} AS price_text FROM plist", PLIST)
    q["sellable_products"] = A(
        f"SELECT id, name || ' - ' || {mt('price')} || ' (Stock: ' || CAST(quantity AS VARCHAR) || ')' "
        f"AS label, price, quantity = 0 AS disabled FROM f_products")
    q["sale_quote"] = A(
        f"SELECT r.request_id, r.product_id, r.quantity, "
        f"{mt(f'CASE WHEN p.id IS NOT NULL AND p.quantity <> 0 THEN {lv('COALESCE(r.quantity, 0)', 'p.price')} ELSE CAST(0 AS DECIMAL(20,2)) END')} AS quote "
        f"FROM f_sale_requests r LEFT JOIN f_products p ON r.product_id = p.id")
    q["inventory_value_lines"] = A(
        f"SELECT id, name, category, quantity, {mt('price')} AS price_text, "
        f"{mt(lv('quantity', 'price'))} AS value_text FROM f_products")
    q["inventory_status_lines"] = A(
        f"SELECT id, name, category, {mt('price')} AS price_text, quantity, {_dash('supplier')} AS supplier "
        f"FROM plist", PLIST)
    q["lookup_by_key"] = A("SELECT * FROM f_products WHERE id IN (SELECT product_id FROM f_sale_requests)")
    q["supplier_ids_by_name"] = A(
        "SELECT n.supplier, s.id AS supplier_id FROM (SELECT DISTINCT supplier FROM f_product_changes "
        "WHERE supplier IS NOT NULL) n LEFT JOIN f_suppliers s ON n.supplier = s.name")
    q["low_stock_items"] = A("SELECT * FROM plist WHERE quantity > 0 AND quantity < 10", PLIST)
    q["out_of_stock_items"] = A("SELECT * FROM plist WHERE quantity = 0", PLIST)
    q["stock_alerts"] = A("SELECT * FROM inv WHERE stock_status <> 'OK'", INV_VIEW)
    q["stock_with_status"] = A("SELECT * FROM inv WHERE stock_status = 'LOW STOCK'", INV_VIEW)
    q["stock_with_status_out"] = A("SELECT * FROM inv WHERE stock_status = 'OUT OF STOCK'", INV_VIEW)
    q["quantity_below"] = A("SELECT * FROM f_products WHERE quantity < 10")
    q["sales_on_date"] = A(f"SELECT * FROM f_sales WHERE sale_date = DATE '{AS_OF}'")
    q["sales_on_date_list"] = A(f"SELECT {SALES_COLS} FROM f_sales WHERE sale_date = DATE '{AS_OF}'")
    q["sales_clock_list"] = A(
        f"SELECT id, strftime(sale_timestamp, '%-I:%M:%S %p') AS time, product_name AS \"productName\", "
        f"category, quantity, {mt('unit_price')} AS unit_price_text, {mt(FALLBACK)} AS total_text "
        f"FROM f_sales WHERE sale_date = DATE '{AS_OF}'")
    q["recent_transactions"] = A(
        f"SELECT id, product_name AS \"productName\", category, quantity, {mt(FALLBACK)} AS amount_text, "
        f"sale_date AS date FROM f_sales ORDER BY sale_timestamp DESC, id DESC LIMIT 8")
    # joins
    q["inventory_with_supplier"] = A("SELECT * FROM inv", INV_VIEW)
    q["sales_report"] = A(
        "SELECT s.id, s.product_name, s.category, s.unit_price, s.quantity, s.total_amount, s.sale_date, "
        "s.sale_timestamp, e.name AS cashier_name, e.username AS cashier_username "
        "FROM f_sales s LEFT JOIN f_employees e ON s.cashier_id = e.id")
    q["products_by_supplier"] = A(
        "SELECT s.name AS supplier, string_agg(p.name, ',' ORDER BY p.category, p.name, p.id) AS products "
        "FROM f_products p JOIN f_suppliers s ON p.supplier_id = s.id GROUP BY s.name")
    q["supplier_products"] = A(
        "SELECT s.name AS supplier, string_agg(p.name, ', ' ORDER BY p.category, p.name, p.id) AS products "
        "FROM f_suppliers s LEFT JOIN f_products p ON p.supplier_id = s.id GROUP BY s.name")
    # aggregates
    q["revenue_by_category"] = A(
        f"SELECT category, CAST(SUM(quantity) AS BIGINT) AS total_units_sold, "
        f"CAST(SUM(total_amount) AS {MS}) AS total_revenue FROM f_sales GROUP BY category")
    q["revenue_by_product"] = A(
        f"SELECT product_name, category, CAST(SUM(quantity) AS BIGINT) AS total_units_sold, "
        f"CAST(SUM(total_amount) AS {MS}) AS total_revenue FROM f_sales GROUP BY product_name, category")
    q["total_revenue"] = A(f"SELECT CAST(SUM(total_amount) AS {MS}) AS total_revenue FROM f_sales")
    q["revenue_totals"] = A(f"SELECT CAST(SUM(total_amount) AS {MS}) AS total_revenue, "
                            f"COUNT(*) AS total_orders FROM f_sales")
    q["inventory_by_category"] = A(
        f"SELECT category, CAST(SUM(quantity) AS BIGINT) AS total_units, "
        f"CAST(SUM({lv('quantity', 'price')}) AS {MS}) AS value FROM f_products GROUP BY category")
    q["category_sales"] = A(
        f"SELECT category, revenue, {mt('revenue')} AS revenue_text FROM (SELECT category, "
        f"COALESCE(CAST(SUM({FALLBACK}) AS {MS}), 0) AS revenue FROM f_sales GROUP BY category)")
    q["product_sales"] = A(
        f"SELECT product_name, revenue, {mt('revenue')} AS revenue_text FROM (SELECT product_name, "
        f"COALESCE(CAST(SUM({FALLBACK}) AS {MS}), 0) AS revenue FROM f_sales GROUP BY product_name)")
    q["category_units"] = A("SELECT category, CAST(SUM(quantity) AS BIGINT) AS units FROM f_products "
                            "GROUP BY category")
    avg = ("CASE WHEN n = 0 THEN CAST(0 AS DECIMAL(38,2)) ELSE CAST(CAST(SIGN(c) * "
           "((ABS(c) * 2 + n) // (2 * n)) AS DECIMAL(38,0)) / 100 AS DECIMAL(38,2)) END")
    q["sales_statement"] = A(
        f"SELECT total_sales, total_revenue, average_sale, {mt('total_revenue')} AS revenue_text, "
        f"{mt('average_sale')} AS average_text FROM (SELECT n AS total_sales, r AS total_revenue, "
        f"{avg} AS average_sale FROM (SELECT n, r, CAST(r * 100 AS HUGEINT) AS c FROM ("
        f"SELECT COUNT(*) AS n, COALESCE(CAST(SUM({FALLBACK}) AS {MS}), 0) AS r FROM f_sales)))")
    q["inventory_statement"] = A(
        f"SELECT total_products, total_units, total_value, low_stock_items, out_of_stock_items, "
        f"{mt('total_value')} AS total_value_text FROM (SELECT COUNT(*) AS total_products, "
        f"COALESCE(CAST(SUM(quantity) AS BIGINT), 0) AS total_units, "
        f"COALESCE(CAST(SUM({lv('quantity', 'price')}) AS {MS}), 0) AS total_value, "
        f"COUNT(*) FILTER (WHERE quantity > 0 AND quantity < 10) AS low_stock_items, "
        f"COUNT(*) FILTER (WHERE quantity = 0) AS out_of_stock_items FROM f_products)")
    q["owner_sales_kpis"] = A(
        f"SELECT total_revenue, total_orders, {mt('total_revenue')} AS revenue_text FROM ("
        f"SELECT COALESCE(CAST(SUM({FALLBACK}) AS {MS}), 0) AS total_revenue, COUNT(*) AS total_orders "
        f"FROM f_sales)")
    q["owner_inventory_kpis"] = A(
        f"SELECT total_products, total_units, inventory_value, {mt('inventory_value')} AS value_text FROM ("
        f"SELECT COUNT(*) AS total_products, COALESCE(CAST(SUM(quantity) AS BIGINT), 0) AS total_units, "
        f"COALESCE(CAST(SUM({lv('quantity', 'price')}) AS {MS}), 0) AS inventory_value FROM f_products)")
    q["daily_sales_kpis"] = A(
        f"SELECT revenue, items_sold, transactions, {mt('revenue')} AS revenue_text FROM ("
        f"SELECT COALESCE(CAST(SUM({FALLBACK}) AS {MS}), 0) AS revenue, "
        f"COALESCE(CAST(SUM(quantity) AS BIGINT), 0) AS items_sold, COUNT(*) AS transactions "
        f"FROM f_sales WHERE sale_date = DATE '{AS_OF}')")
    q["cashier_inventory_kpis"] = A(
        "SELECT COUNT(*) AS total_products, COALESCE(CAST(SUM(quantity) AS BIGINT), 0) AS total_units "
        "FROM f_products")
    q["supplier_count"] = A(
        "SELECT CAST(COUNT(DISTINCT supplier) + COALESCE(MAX(CASE WHEN supplier IS NULL THEN 1 ELSE 0 END), 0) "
        "AS BIGINT) AS supplier_count FROM plist", PLIST)
    q["supplier_info"] = A(
        "SELECT supplier, string_agg(name, ', ' ORDER BY category, name, id) AS products FROM plist "
        "GROUP BY supplier", PLIST)
    item = ("'{\"name\":' || CAST(to_json(name) AS VARCHAR) || ',\"category\":' || "
            "CAST(to_json(category) AS VARCHAR) || ',\"price\":' || CAST(price AS VARCHAR) || "
            "',\"quantity\":' || CAST(quantity AS VARCHAR) || '}'")
    q["supplier_detail"] = A(
        f"SELECT supplier, contact, {_dash('contact')} AS contact_text, CAST(n_items AS INT) AS n_items, "
        f"items_json FROM (SELECT supplier, MIN(\"supplierContact\") AS contact, COUNT(*) AS n_items, "
        f"'[' || string_agg({item}, ',' ORDER BY category, name, id) || ']' AS items_json "
        f"FROM plist GROUP BY supplier)", PLIST)
    place = "CAST(ROW_NUMBER() OVER (PARTITION BY s.name ORDER BY p.category, p.name, p.id) AS BIGINT) AS position"
    q["products_by_supplier_items"] = A(
        f"SELECT s.name AS supplier, {place}, p.id, p.name AS product "
        "FROM f_products p JOIN f_suppliers s ON p.supplier_id = s.id")
    q["supplier_products_items"] = A(
        f"SELECT s.name AS supplier, {place}, p.id, p.name AS product "
        "FROM f_suppliers s LEFT JOIN f_products p ON p.supplier_id = s.id")
    q["supplier_info_items"] = A(
        f"SELECT s.name AS supplier, {place}, p.id, p.name AS product "
        "FROM f_products p LEFT JOIN f_suppliers s ON p.supplier_id = s.id")
    q["supplier_detail_items"] = A(
        f"SELECT supplier, {_dash('\"supplierContact\"')} AS contact_text, "
        "CAST(ROW_NUMBER() OVER (PARTITION BY supplier ORDER BY category, name, id) AS BIGINT) AS position, "
        "id, name, category, price, quantity FROM plist", PLIST)
    q["stock_notification_items"] = A(
        "SELECT kind, CAST(ROW_NUMBER() OVER (PARTITION BY kind ORDER BY category, name, id) AS BIGINT) "
        "AS position, id, text FROM (SELECT id, category, name, "
        "CASE WHEN quantity = 0 THEN 'OUT OF STOCK' ELSE 'LOW STOCK' END AS kind, "
        "CASE WHEN quantity = 0 THEN name ELSE name || ' (' || CAST(quantity AS VARCHAR) || ' left)' END AS text "
        "FROM f_products WHERE quantity >= 0 AND quantity < 10)")
    q["alert_badge_count"] = A(
        "SELECT badge_count, NULLIF(CAST(badge_count AS VARCHAR), '0') AS badge_text FROM ("
        "SELECT COUNT(*) FILTER (WHERE (quantity > 0 AND quantity < 10) OR quantity = 0) AS badge_count "
        "FROM f_products)")
    q["stock_notifications"] = A(
        "SELECT 1 AS seq, 'OUT OF STOCK' AS kind, 'OUT OF STOCK: ' || o AS message FROM agg WHERE o IS NOT NULL "
        "UNION ALL SELECT 2, 'LOW STOCK', 'LOW STOCK: ' || l FROM agg WHERE l IS NOT NULL "
        "UNION ALL SELECT 3, 'OK', 'All stock levels are healthy.' FROM agg WHERE o IS NULL AND l IS NULL",
        "cand AS (SELECT id, category, name, CASE WHEN quantity = 0 THEN name END AS o_, "
        "CASE WHEN quantity > 0 THEN name || ' (' || CAST(quantity AS VARCHAR) || ' left)' END AS l_ "
        "FROM f_products WHERE quantity >= 0 AND quantity < 10),\n"
        "agg AS (SELECT string_agg(o_, ', ' ORDER BY category, name, id) AS o, "
        "string_agg(l_, ', ' ORDER BY category, name, id) AS l FROM cand)")
    return q


ORACLE_SQL = build()


def _with_jobs() -> None:
    from stockroom.plans.oracle_jobs import JOB_ORACLE_SQL
    ORACLE_SQL.update(JOB_ORACLE_SQL)


_with_jobs()
