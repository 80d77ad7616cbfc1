"""DuckDB oracles of the change and sale jobs, written independently in SQL."""

from __future__ import annotations

from stockroom.plans.oracle import with_adapters

SUPPLIER_UPSERT = r"""
sreq AS (
  SELECT request_id, supplier AS name,
         COALESCE(NULLIF(supplier_contact, ''),
                  'info@' || regexp_replace(lower(supplier), '\s', '', 'g') || '.com') AS contact
  FROM f_product_changes
  WHERE op IN ('INSERT', 'UPDATE') AND supplier IS NOT NULL AND supplier <> '' AND length(supplier) <= 100
    AND length(COALESCE(NULLIF(supplier_contact, ''),
                        'info@' || regexp_replace(lower(supplier), '\s', '', 'g') || '.com')) <= 100),
per_name AS (
  SELECT name, contact, first_ FROM (
    SELECT name, contact, MIN(request_id) OVER (PARTITION BY name) AS first_,
           ROW_NUMBER() OVER (PARTITION BY name ORDER BY request_id DESC) AS rn FROM sreq)
  WHERE rn = 1),
new_sup AS (
  SELECT s.id, s.name, COALESCE(pn.contact, s.contact_email) AS contact_email, s.phone, s.address, s.created_at
  FROM f_suppliers s LEFT JOIN per_name pn ON pn.name = s.name
  UNION ALL
  SELECT CAST((SELECT COALESCE(MAX(id), 0) FROM f_suppliers) + ROW_NUMBER() OVER (ORDER BY first_) AS BIGINT),
         name, contact, NULL, NULL, NULL
  FROM per_name WHERE name NOT IN (SELECT name FROM f_suppliers))"""

PRODUCT_CHANGES = SUPPLIER_UPSERT + """,
req AS (
  SELECT r.request_id, r.op, r.id, r.name, r.category, r.quantity, r.price,
         CASE WHEN r.supplier IS NOT NULL AND r.supplier <> '' THEN s.id END AS supplier_id,
         COALESCE(r.name IS NOT NULL AND r.category IS NOT NULL AND r.quantity IS NOT NULL
                  AND r.price IS NOT NULL AND length(r.name) <= 150 AND length(r.category) <= 80
                  AND (COALESCE(r.supplier, '') = '' OR length(r.supplier) <= 100
                       AND length(COALESCE(NULLIF(r.supplier_contact, ''), 'info@' || replace(lower(r.supplier), ' ', '') || '.com')) <= 100),
                  false) AS ok
  FROM f_product_changes r LEFT JOIN new_sup s ON r.supplier = s.name),
ins AS (
  SELECT CAST((SELECT COALESCE(MAX(id), 0) FROM f_products) + ROW_NUMBER() OVER (ORDER BY request_id) AS BIGINT)
         AS new_id, * FROM req WHERE op = 'INSERT' AND ok),
uni AS (SELECT id, CAST(NULL AS BIGINT) AS start_ FROM f_products UNION ALL SELECT new_id, request_id FROM ins),
ops AS (
  SELECT o.*, (u.id IS NOT NULL AND (u.start_ IS NULL OR o.request_id > u.start_)) AS live
  FROM req o LEFT JOIN uni u ON o.id = u.id
  WHERE o.op IN ('UPDATE', 'DELETE') AND o.id IS NOT NULL),
fd AS (SELECT id, MIN(request_id) AS del_at FROM ops WHERE live AND op = 'DELETE' GROUP BY id),
res AS (
  SELECT o.*, CASE WHEN NOT o.live THEN 'NO_MATCH'
                   WHEN o.op = 'DELETE' THEN CASE WHEN o.request_id = fd.del_at THEN 'DELETED' ELSE 'NO_MATCH' END
                   WHEN fd.del_at IS NOT NULL AND o.request_id >= fd.del_at THEN 'NO_MATCH'
                   WHEN o.ok THEN 'UPDATED' ELSE 'ERROR' END AS status
  FROM ops o LEFT JOIN fd ON o.id = fd.id),
lu AS (
  SELECT * FROM (SELECT id, name, category, quantity, price, supplier_id,
                        ROW_NUMBER() OVER (PARTITION BY id ORDER BY request_id DESC) AS rn
                 FROM res WHERE status = 'UPDATED') WHERE rn = 1),
cur AS (
  SELECT id, name, category, quantity, price, supplier_id, created_at, updated_at, false AS ins_ FROM f_products
  UNION ALL SELECT new_id, name, category, quantity, price, supplier_id, NULL, NULL, true FROM ins),
new_products AS (
  SELECT c.id,
         CASE WHEN lu.id IS NOT NULL THEN lu.name ELSE c.name END AS name,
         CASE WHEN lu.id IS NOT NULL THEN lu.category ELSE c.category END AS category,
         CASE WHEN lu.id IS NOT NULL THEN lu.quantity ELSE c.quantity END AS quantity,
         CASE WHEN lu.id IS NOT NULL THEN lu.price ELSE c.price END AS price,
         CASE WHEN lu.id IS NOT NULL THEN lu.supplier_id ELSE c.supplier_id END AS supplier_id,
         c.created_at, c.updated_at, (lu.id IS NOT NULL OR c.ins_) AS changed_, c.ins_
  FROM cur c LEFT JOIN lu ON c.id = lu.id
  WHERE c.id NOT IN (SELECT id FROM res WHERE status = 'DELETED'))"""

# Steps through the requests one by one; the state is a map from id to username (of the
# employees that some request names by id or username, the others never matter).
EMPLOYEE_CHANGES = """
ereq AS (
  SELECT *, COALESCE(name IS NOT NULL AND username IS NOT NULL AND length(name) <= 100 AND length(username) <= 50
                     AND role IN ('owner', 'admin', 'cashier'), false) AS ok
  FROM (SELECT request_id, op, id, name, username,
               CASE WHEN op = 'INSERT' THEN COALESCE(NULLIF(role, ''), 'cashier') ELSE role END AS role
        FROM f_employee_changes)),
eseq AS (
  SELECT *, CASE WHEN op = 'INSERT' AND ok
                 THEN CAST((SELECT COALESCE(MAX(id), 0) FROM f_employees)
                           + COUNT(*) FILTER (WHERE op = 'INSERT' AND ok) OVER (ORDER BY request_id) AS BIGINT)
                 WHEN op IN ('UPDATE', 'DELETE') THEN id END AS eid,
         ROW_NUMBER() OVER (ORDER BY request_id) AS seq
  FROM ereq),
estart AS (
  SELECT COALESCE(map_from_entries(list({'key': id, 'value': username})), MAP {}) AS held FROM f_employees
  WHERE id IN (SELECT id FROM ereq) OR username IN (SELECT username FROM ereq)),
estep(seq, status, held) AS (
  SELECT CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), held FROM estart
  UNION ALL
  SELECT seq, status,
         CASE WHEN status IN ('INSERTED', 'UPDATED') THEN map_concat(held, map([eid], [username]))
              WHEN status = 'DELETED' THEN map_from_entries(list_filter(map_entries(held), lambda e: e.key <> eid))
              ELSE held END
  FROM (
    SELECT q.seq, q.eid, q.username, s.held,
           CASE WHEN COALESCE(q.op, '') NOT IN ('INSERT', 'UPDATE', 'DELETE') THEN 'ERROR'
                WHEN q.op <> 'INSERT' AND (q.eid IS NULL OR NOT list_contains(map_keys(s.held), q.eid)) THEN 'NO_MATCH'
                WHEN q.op = 'DELETE' THEN 'DELETED'
                WHEN NOT q.ok THEN 'ERROR'
                WHEN len(list_filter(map_entries(s.held), lambda e: e.value = q.username AND e.key <> q.eid)) > 0
                THEN 'DUPLICATE'
                WHEN q.op = 'INSERT' THEN 'INSERTED' ELSE 'UPDATED' END AS status
    FROM estep s JOIN eseq q ON q.seq = s.seq + 1)),
eres AS (
  SELECT q.request_id, q.op, CASE WHEN q.op = 'INSERT' AND s.status <> 'INSERTED' THEN NULL WHEN q.op = 'INSERT' THEN q.eid
                                  ELSE q.id END AS id,
         q.name, q.username, q.role, s.status
  FROM estep s JOIN eseq q ON q.seq = s.seq),
elu AS (
  SELECT * FROM (SELECT id, name, username, role,
                        ROW_NUMBER() OVER (PARTITION BY id ORDER BY request_id DESC) AS rn
                 FROM eres WHERE status = 'UPDATED') WHERE rn = 1),
ecur AS (
  SELECT id, name, username, role, must_change_password, created_at, updated_at FROM f_employees
  UNION ALL SELECT id, name, username, role, true, NULL, NULL FROM eres WHERE status = 'INSERTED'),
new_employees AS (
  SELECT c.id,
         CASE WHEN l.id IS NOT NULL THEN l.name ELSE c.name END AS name,
         CASE WHEN l.id IS NOT NULL THEN l.username ELSE c.username END AS username,
         CASE WHEN l.id IS NOT NULL THEN l.role ELSE c.role END AS role,
         c.must_change_password, c.created_at, c.updated_at
  FROM ecur c LEFT JOIN elu l ON c.id = l.id
  WHERE c.id NOT IN (SELECT id FROM eres WHERE status = 'DELETED'))"""

SALE_FOLD = """
sj AS (
  SELECT r.request_id, r.product_id, r.quantity, r.ts, r.cashier_id, p.quantity AS stock0,
         p.name AS pname, p.category AS pcat, p.price,
         TRY_CAST(p.price * CAST(r.quantity AS DECIMAL(10,0)) AS DECIMAL(10,2)) AS total,
         ROW_NUMBER() OVER (PARTITION BY r.product_id ORDER BY r.ts, r.request_id) AS seq
  FROM f_sale_requests r JOIN f_products p ON r.product_id = p.id
  WHERE r.quantity IS NOT NULL AND r.quantity >= 1),
fold(product_id, seq, request_id, before_, code, left_) AS (
  SELECT product_id, seq, request_id, stock0,
         CASE WHEN stock0 = 0 THEN 3 WHEN stock0 < quantity THEN 2 WHEN total IS NULL THEN 4 ELSE 1 END,
         CASE WHEN stock0 <> 0 AND stock0 >= quantity AND total IS NOT NULL THEN stock0 - quantity ELSE stock0 END
  FROM sj WHERE seq = 1
  UNION ALL
  SELECT j.product_id, j.seq, j.request_id, f.left_,
         CASE WHEN f.left_ = 0 THEN 3 WHEN f.left_ < j.quantity THEN 2 WHEN j.total IS NULL THEN 4 ELSE 1 END,
         CASE WHEN f.left_ <> 0 AND f.left_ >= j.quantity AND j.total IS NOT NULL
              THEN f.left_ - j.quantity ELSE f.left_ END
  FROM fold f JOIN sj j ON j.product_id = f.product_id AND j.seq = f.seq + 1),
sale_results AS (
  SELECT j.request_id, j.product_id, j.quantity, j.ts, j.cashier_id,
         CASE f.code WHEN 1 THEN 'ACCEPTED' WHEN 2 THEN 'INSUFFICIENT' WHEN 3 THEN 'OUT_OF_STOCK'
                     ELSE 'AMOUNT_OVERFLOW' END AS status,
         CAST(f.before_ AS INT) AS stock_before, CAST(f.left_ AS INT) AS "left",
         CASE f.code
           WHEN 1 THEN 'Sold ' || CAST(j.quantity AS VARCHAR) || ' x ' || j.pname || ' for M'
                       || CAST(CAST(ROUND(j.total, 2) AS DECIMAL(38,2)) AS VARCHAR)
           WHEN 2 THEN 'Only ' || CAST(f.before_ AS VARCHAR) || ' units available.'
           WHEN 3 THEN j.pname || ' is OUT OF STOCK!'
           ELSE 'Out of range value for column ''total_amount''' END AS message,
         CASE WHEN f.code = 1 THEN j.pname END AS product_name,
         CASE WHEN f.code = 1 THEN j.pcat END AS category,
         CASE WHEN f.code = 1 THEN j.price END AS unit_price,
         CASE WHEN f.code = 1 THEN j.total END AS total_amount,
         CASE WHEN f.code = 1 THEN CAST(j.ts AS DATE) END AS sale_date
  FROM sj j JOIN fold f ON j.request_id = f.request_id
  UNION ALL
  SELECT r.request_id, r.product_id, r.quantity, r.ts, r.cashier_id,
         CASE WHEN r.quantity IS NULL OR r.quantity < 1 THEN 'INVALID_QUANTITY' ELSE 'NOT_FOUND' END,
         CAST(NULL AS INT), CAST(NULL AS INT),
         CASE WHEN r.quantity IS NULL OR r.quantity < 1 THEN 'Please select a product and valid quantity'
              ELSE 'Product not found' END,
         NULL, NULL, CAST(NULL AS DECIMAL(10,2)), CAST(NULL AS DECIMAL(10,2)), CAST(NULL AS DATE)
  FROM f_sale_requests r
  WHERE r.quantity IS NULL OR r.quantity < 1 OR r.product_id NOT IN (SELECT id FROM f_products))"""


def build() -> dict[str, str]:
    A = with_adapters
    q: dict[str, str] = {}
    q["upsert_suppliers"] = A("SELECT * FROM new_sup", SUPPLIER_UPSERT)
    q["apply_product_changes"] = A(
        "SELECT id, name, category, quantity, price, supplier_id, created_at, updated_at FROM new_products",
        PRODUCT_CHANGES)
    q["product_change_outcomes"] = A(
        "SELECT request_id, op, new_id AS id, 'INSERTED' AS status FROM ins "
        "UNION ALL SELECT request_id, op, CAST(NULL AS BIGINT), 'ERROR' FROM req WHERE op = 'INSERT' AND NOT ok "
        "UNION ALL SELECT request_id, op, id, status FROM res "
        "UNION ALL SELECT request_id, op, id, 'NO_MATCH' FROM req WHERE op IN ('UPDATE', 'DELETE') AND id IS NULL "
        "UNION ALL SELECT request_id, op, id, 'ERROR' FROM req "
        "WHERE COALESCE(op, '') NOT IN ('INSERT', 'UPDATE', 'DELETE')",
        PRODUCT_CHANGES)
    any_case = """
creq AS (
  SELECT request_id, supplier AS name, lower(supplier) AS k,
         COALESCE(NULLIF(supplier_contact, ''), 'info@' || regexp_replace(lower(supplier), '\\s', '', 'g') || '.com') AS contact
  FROM (SELECT * REPLACE (CASE WHEN request_id % 2 = 0 THEN upper(supplier) WHEN request_id % 3 = 0 THEN lower(supplier)
                               ELSE supplier END AS supplier) FROM f_product_changes)
  WHERE op IN ('INSERT', 'UPDATE') AND supplier <> '' AND length(supplier) <= 100
    AND length(COALESCE(NULLIF(supplier_contact, ''), 'info@' || replace(lower(supplier), ' ', '') || '.com')) <= 100),
cper AS (SELECT k, arg_max(contact, request_id) AS contact, arg_min(name, request_id) AS name, MIN(request_id) AS first_
         FROM creq GROUP BY k)"""
    q["upsert_suppliers_any_case"] = A(
        "SELECT s.id, s.name, COALESCE(p.contact, s.contact_email) AS contact_email, s.phone, s.address, s.created_at "
        "FROM f_suppliers s LEFT JOIN cper p ON p.k = lower(s.name) UNION ALL "
        "SELECT CAST((SELECT COALESCE(MAX(id), 0) FROM f_suppliers) + ROW_NUMBER() OVER (ORDER BY first_) AS BIGINT), "
        "name, contact, NULL, NULL, NULL FROM cper WHERE k NOT IN (SELECT lower(name) FROM f_suppliers)", any_case)
    q["assign_ids"] = A(
        "SELECT request_id, CAST((SELECT MAX(id) FROM f_products) + ROW_NUMBER() OVER (ORDER BY request_id) "
        "AS BIGINT) AS id FROM f_product_changes WHERE op = 'INSERT'")
    q["delete_cascade_null"] = A(
        "SELECT s.id, CASE WHEN d.id IS NOT NULL THEN NULL ELSE s.product_id END AS product_id, s.product_name, "
        "s.category, s.unit_price, s.quantity, s.total_amount, s.sale_date, s.sale_timestamp, s.cashier_id "
        "FROM f_sales s LEFT JOIN (SELECT DISTINCT id FROM res WHERE status = 'DELETED') d ON s.product_id = d.id",
        PRODUCT_CHANGES)
    q["cascade_sales_keys"] = A(
        "SELECT s.id, CASE WHEN s.product_id IN (SELECT id FROM res WHERE status = 'DELETED') THEN NULL ELSE s.product_id "
        "END AS product_id, s.product_name, s.category, s.unit_price, s.quantity, s.total_amount, s.sale_date, "
        "s.sale_timestamp, CASE WHEN s.cashier_id IN (SELECT id FROM eres WHERE status = 'DELETED') THEN NULL "
        "ELSE s.cashier_id END AS cashier_id FROM f_sales s", PRODUCT_CHANGES + "," + EMPLOYEE_CHANGES, recursive=True)
    q["cascade_product_suppliers"] = A(
        "SELECT id, name, category, quantity, price, CASE WHEN supplier_id % 4 = 1 AND supplier_id IN "
        "(SELECT id FROM f_suppliers) THEN NULL ELSE supplier_id END AS supplier_id, created_at, updated_at FROM f_products")
    after = SALE_FOLD.replace("f_products", "new_products")
    q["id_marks_after_changes"] = A(
        "SELECT 'products' AS table_name, CAST((SELECT MAX(id) FROM cur) AS BIGINT) AS last_id "
        "UNION ALL SELECT 'suppliers', CAST((SELECT MAX(id) FROM new_sup) AS BIGINT) "
        "UNION ALL SELECT 'employees', CAST(GREATEST((SELECT MAX(id) FROM f_employees), "
        "(SELECT MAX(eid) FROM eseq WHERE op = 'INSERT')) AS BIGINT) "
        "UNION ALL SELECT 'sales', CAST((SELECT MAX(id) FROM f_sales) + (SELECT COUNT(*) FROM sale_results "
        "WHERE status = 'ACCEPTED') AS BIGINT)", PRODUCT_CHANGES + "," + EMPLOYEE_CHANGES + "," + after, recursive=True)
    q["touch_updated_at"] = A(
        "SELECT id, name, category, quantity, price, supplier_id, "
        "CASE WHEN changed_ THEN TIMESTAMP '1998-06-01 00:00:00' ELSE updated_at END AS updated_at, "
        "CASE WHEN ins_ THEN TIMESTAMP '1998-06-01 00:00:00' ELSE created_at END AS created_at FROM new_products",
        PRODUCT_CHANGES)
    q["apply_employee_changes"] = A("SELECT * FROM new_employees", EMPLOYEE_CHANGES, recursive=True)
    q["employee_change_outcomes"] = A(
        "SELECT request_id, op, id, status, CASE WHEN status = 'DUPLICATE' THEN 'Username already exists' END "
        "AS message FROM eres", EMPLOYEE_CHANGES, recursive=True)
    q["request_outcomes_complete"] = A(
        "SELECT 'product' AS feed, (SELECT COUNT(*) FROM f_product_changes) AS requests, "
        "(SELECT COUNT(*) FROM f_product_changes) AS outcomes, "
        "(SELECT COUNT(DISTINCT request_id) FROM f_product_changes) AS answered "
        "UNION ALL SELECT 'employee', (SELECT COUNT(*) FROM f_employee_changes), "
        "(SELECT COUNT(*) FROM f_employee_changes), (SELECT COUNT(DISTINCT request_id) FROM f_employee_changes)")
    q["validate_products"] = A(
        "SELECT 'products' AS table_name, 'unique_id' AS rule, CAST(id AS VARCHAR) AS row_key, "
        "CAST(n AS VARCHAR) || ' rows' AS detail FROM (SELECT id, COUNT(*) AS n FROM f_products GROUP BY id) WHERE n > 1 "
        "UNION ALL SELECT 'products', 'not_null_' || c, CAST(id AS VARCHAR), NULL FROM ("
        "  SELECT id, 'name' AS c FROM f_products WHERE name IS NULL UNION ALL "
        "  SELECT id, 'category' FROM f_products WHERE category IS NULL UNION ALL "
        "  SELECT id, 'quantity' FROM f_products WHERE quantity IS NULL UNION ALL "
        "  SELECT id, 'price' FROM f_products WHERE price IS NULL UNION ALL "
        "  SELECT id, 'id' FROM f_products WHERE id IS NULL) "
        "UNION ALL SELECT 'products', 'length_name', CAST(id AS VARCHAR), NULL FROM f_products WHERE length(name) > 150 "
        "UNION ALL SELECT 'products', 'length_category', CAST(id AS VARCHAR), NULL FROM f_products "
        "  WHERE length(category) > 80 "
        "UNION ALL SELECT 'products', 'fk_supplier_id', CAST(id AS VARCHAR), CAST(supplier_id AS VARCHAR) "
        "  FROM f_products WHERE supplier_id IS NOT NULL AND supplier_id NOT IN (SELECT id FROM f_suppliers)")
    q["validate_sales_after_changes"] = A(
        "SELECT 'sales' AS table_name, 'unique_id' AS rule, CAST(id AS VARCHAR) AS row_key, "
        "CAST(n AS VARCHAR) || ' rows' AS detail FROM (SELECT id, COUNT(*) AS n FROM f_sales GROUP BY id) WHERE n > 1 "
        "UNION ALL SELECT 'sales', r, CAST(id AS VARCHAR), NULL FROM ("
        "  SELECT id, 'not_null_id' AS r FROM f_sales WHERE id IS NULL UNION ALL "
        "  SELECT id, 'not_null_product_name' FROM f_sales WHERE product_name IS NULL UNION ALL "
        "  SELECT id, 'not_null_category' FROM f_sales WHERE category IS NULL UNION ALL "
        "  SELECT id, 'not_null_unit_price' FROM f_sales WHERE unit_price IS NULL UNION ALL "
        "  SELECT id, 'not_null_quantity' FROM f_sales WHERE quantity IS NULL UNION ALL "
        "  SELECT id, 'not_null_sale_date' FROM f_sales WHERE sale_date IS NULL UNION ALL "
        "  SELECT id, 'generated_total_amount' FROM f_sales WHERE total_amount IS DISTINCT FROM "
        "    TRY_CAST(unit_price * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(10,2))) "
        "UNION ALL SELECT 'sales', 'fk_product_id', CAST(id AS VARCHAR), CAST(product_id AS VARCHAR) FROM f_sales "
        "  WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM new_products) "
        "UNION ALL SELECT 'sales', 'fk_cashier_id', CAST(id AS VARCHAR), CAST(cashier_id AS VARCHAR) FROM f_sales "
        "  WHERE cashier_id IS NOT NULL AND cashier_id NOT IN (SELECT id FROM new_employees)",
        PRODUCT_CHANGES + "," + EMPLOYEE_CHANGES, recursive=True)
    q["validate_employees_after_changes"] = A(
        "SELECT 'employees' AS table_name, 'unique_' || c AS rule, k AS row_key, CAST(n AS VARCHAR) || ' rows' AS detail "
        "FROM (SELECT 'id' AS c, CAST(id AS VARCHAR) AS k, COUNT(*) AS n FROM new_employees GROUP BY id "
        "      UNION ALL SELECT 'username', username, COUNT(*) FROM new_employees "
        "      WHERE username IS NOT NULL GROUP BY username) WHERE n > 1 "
        "UNION ALL SELECT 'employees', 'not_null_' || c, CAST(id AS VARCHAR), NULL FROM ("
        "  SELECT id, 'id' AS c FROM new_employees WHERE id IS NULL UNION ALL "
        "  SELECT id, 'name' FROM new_employees WHERE name IS NULL UNION ALL "
        "  SELECT id, 'username' FROM new_employees WHERE username IS NULL UNION ALL "
        "  SELECT id, 'role' FROM new_employees WHERE role IS NULL) "
        "UNION ALL SELECT 'employees', 'enum_role', CAST(id AS VARCHAR), role FROM new_employees "
        "  WHERE role NOT IN ('owner', 'admin', 'cashier') "
        "UNION ALL SELECT 'employees', 'length_name', CAST(id AS VARCHAR), NULL FROM new_employees WHERE length(name) > 100 "
        "UNION ALL SELECT 'employees', 'length_username', CAST(id AS VARCHAR), NULL FROM new_employees "
        "  WHERE length(username) > 50", EMPLOYEE_CHANGES, recursive=True)
    broken = """
bp0 AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN repeat(name, 20) ELSE name END AS name,
         CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN repeat(category, 20) ELSE category END AS category,
         CASE WHEN id % 31 = 0 THEN NULL WHEN id % 17 = 0 THEN 3000000000 ELSE CAST(quantity AS BIGINT) END AS quantity,
         CAST(CASE WHEN id % 37 = 0 THEN NULL WHEN id % 23 = 0 THEN CAST(price AS DECIMAL(20,2)) + 200000000 ELSE price END AS DECIMAL(20,2)) AS price,
         CASE WHEN id % 29 = 0 THEN supplier_id + 1000000 ELSE supplier_id END AS supplier_id
  FROM f_products),
bp AS (SELECT * FROM bp0 UNION ALL SELECT * FROM bp0 WHERE id % 19 = 0),
bs0 AS (
  SELECT id, CASE WHEN id % 3 = 0 THEN 'Same Name' WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN repeat(name, 9)
                  ELSE name END AS name,
         CASE WHEN id % 2 = 0 THEN repeat(contact_email, 9) ELSE contact_email END AS contact_email,
         CASE WHEN id % 4 = 0 THEN repeat(phone, 9) ELSE phone END AS phone FROM f_suppliers),
bs AS (SELECT * FROM bs0 UNION ALL SELECT * FROM bs0 WHERE id % 6 = 0)"""
    q["validate_broken_products"] = A(
        "SELECT 'products' AS table_name, rule, CAST(id AS VARCHAR) AS row_key, detail FROM ("
        "SELECT 'unique_id' AS rule, id, CAST(COUNT(*) AS VARCHAR) || ' rows' AS detail FROM bp GROUP BY id HAVING COUNT(*) > 1 "
        "UNION ALL SELECT 'not_null_name', id, NULL FROM bp WHERE name IS NULL "
        "UNION ALL SELECT 'not_null_category', id, NULL FROM bp WHERE category IS NULL "
        "UNION ALL SELECT 'not_null_quantity', id, NULL FROM bp WHERE quantity IS NULL "
        "UNION ALL SELECT 'not_null_price', id, NULL FROM bp WHERE price IS NULL "
        "UNION ALL SELECT 'length_name', id, NULL FROM bp WHERE length(name) > 150 "
        "UNION ALL SELECT 'length_category', id, NULL FROM bp WHERE length(category) > 80 "
        "UNION ALL SELECT 'range_quantity', id, CAST(quantity AS VARCHAR) FROM bp WHERE quantity > 2147483647 "
        "UNION ALL SELECT 'range_price', id, CAST(price AS VARCHAR) FROM bp WHERE price > 99999999.99 "
        "UNION ALL SELECT 'fk_supplier_id', id, CAST(supplier_id AS VARCHAR) FROM bp WHERE supplier_id IS NOT NULL "
        "  AND supplier_id NOT IN (SELECT id FROM f_suppliers))", broken)
    q["validate_broken_suppliers"] = A(
        "SELECT 'suppliers' AS table_name, rule, row_key, detail FROM ("
        "SELECT 'unique_id' AS rule, CAST(id AS VARCHAR) AS row_key, CAST(COUNT(*) AS VARCHAR) || ' rows' AS detail FROM bs "
        "GROUP BY id HAVING COUNT(*) > 1 UNION ALL "
        "SELECT 'unique_name' AS rule, name AS row_key, CAST(COUNT(*) AS VARCHAR) || ' rows' AS detail FROM bs "
        "WHERE name IS NOT NULL GROUP BY name HAVING COUNT(*) > 1 "
        "UNION ALL SELECT 'not_null_name', CAST(id AS VARCHAR), NULL FROM bs WHERE name IS NULL "
        "UNION ALL SELECT 'length_name', CAST(id AS VARCHAR), NULL FROM bs WHERE length(name) > 100 "
        "UNION ALL SELECT 'length_contact_email', CAST(id AS VARCHAR), NULL FROM bs WHERE length(contact_email) > 100 "
        "UNION ALL SELECT 'length_phone', CAST(id AS VARCHAR), NULL FROM bs WHERE length(phone) > 30)", broken)
    broken_staff = """
be0 AS (
  SELECT id, CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN repeat(name, 20) ELSE name END AS name,
         CASE WHEN id % 3 = 0 THEN 'same' WHEN id % 11 = 0 THEN repeat(username, 9) WHEN id % 13 = 0 THEN NULL
              ELSE username END AS username,
         CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN 'boss' ELSE role END AS role FROM f_employees),
be AS (SELECT * FROM be0 UNION ALL SELECT * FROM be0 WHERE id % 23 = 0)"""
    q["validate_broken_employees"] = A(
        "SELECT 'employees' AS table_name, rule, row_key, detail FROM ("
        "SELECT 'unique_id' AS rule, CAST(id AS VARCHAR) AS row_key, CAST(COUNT(*) AS VARCHAR) || ' rows' AS detail "
        "FROM be GROUP BY id HAVING COUNT(*) > 1 "
        "UNION ALL SELECT 'unique_username', username, CAST(COUNT(*) AS VARCHAR) || ' rows' FROM be "
        "WHERE username IS NOT NULL GROUP BY username HAVING COUNT(*) > 1 "
        "UNION ALL SELECT 'not_null_name', CAST(id AS VARCHAR), NULL FROM be WHERE name IS NULL "
        "UNION ALL SELECT 'not_null_username', CAST(id AS VARCHAR), NULL FROM be WHERE username IS NULL "
        "UNION ALL SELECT 'not_null_role', CAST(id AS VARCHAR), NULL FROM be WHERE role IS NULL "
        "UNION ALL SELECT 'enum_role', CAST(id AS VARCHAR), role FROM be WHERE role NOT IN ('owner', 'admin', 'cashier') "
        "UNION ALL SELECT 'length_name', CAST(id AS VARCHAR), NULL FROM be WHERE length(name) > 100 "
        "UNION ALL SELECT 'length_username', CAST(id AS VARCHAR), NULL FROM be WHERE length(username) > 50)", broken_staff)
    broken_sold = """
bx0 AS (
  SELECT id, CASE WHEN id % 37 = 0 THEN product_id + 10000000 ELSE product_id END AS product_id,
         CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN repeat(product_name, 40) ELSE product_name END AS product_name,
         CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN repeat(category, 20) ELSE category END AS category,
         CASE WHEN id % 17 = 0 THEN NULL WHEN id % 19 = 0 THEN CAST(unit_price AS DECIMAL(20,2)) + 99999999
              ELSE CAST(unit_price AS DECIMAL(20,2)) END AS unit_price,
         CASE WHEN id % 23 = 0 THEN NULL ELSE quantity END AS quantity,
         CASE WHEN id % 29 = 0 THEN CAST(total_amount AS DECIMAL(20,2)) + 1 ELSE total_amount END AS total_amount,
         CASE WHEN id % 31 = 0 THEN NULL ELSE sale_date END AS sale_date,
         CASE WHEN id % 41 = 0 THEN cashier_id + 10000000 ELSE cashier_id END AS cashier_id FROM f_sales),
bx1 AS (SELECT * FROM bx0 UNION ALL SELECT * FROM bx0 WHERE id % 43 = 0),
bx AS (SELECT *, TRY_CAST(CAST(unit_price AS DECIMAL(20,2)) * CAST(quantity AS DECIMAL(10,0)) AS DECIMAL(10,2)) AS expect FROM bx1)"""
    q["validate_broken_sales"] = A(
        "SELECT 'sales' AS table_name, rule, CAST(id AS VARCHAR) AS row_key, detail FROM ("
        "SELECT 'unique_id' AS rule, id, CAST(COUNT(*) AS VARCHAR) || ' rows' AS detail FROM bx GROUP BY id HAVING COUNT(*) > 1 "
        + "".join(f"UNION ALL SELECT 'not_null_{c}', id, NULL FROM bx WHERE {c} IS NULL "
                  for c in ("product_name", "category", "unit_price", "quantity", "sale_date"))
        + "UNION ALL SELECT 'length_product_name', id, NULL FROM bx WHERE length(product_name) > 150 "
        "UNION ALL SELECT 'length_category', id, NULL FROM bx WHERE length(category) > 80 "
        "UNION ALL SELECT 'range_total_amount', id, NULL FROM bx WHERE unit_price IS NOT NULL AND quantity IS NOT NULL "
        "  AND expect IS NULL "
        "UNION ALL SELECT 'generated_total_amount', id, NULL FROM bx WHERE total_amount IS DISTINCT FROM expect "
        "UNION ALL SELECT 'fk_product_id', id, CAST(product_id AS VARCHAR) FROM bx WHERE product_id IS NOT NULL "
        "  AND product_id NOT IN (SELECT id FROM f_products) "
        "UNION ALL SELECT 'fk_cashier_id', id, CAST(cashier_id AS VARCHAR) FROM bx WHERE cashier_id IS NOT NULL "
        "  AND cashier_id NOT IN (SELECT id FROM f_employees))", broken_sold)
    trim = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
    q["validate_product_requests"] = A(
        "SELECT *, CASE WHEN NOT ok THEN 'Please fill all required fields' END AS reason FROM ("
        f"SELECT request_id, op, id, {trim.format('name')} AS name, {trim.format('category')} AS category, "
        f"quantity, price, {trim.format('supplier')} AS supplier, "
        f"{trim.format('supplier_contact')} AS supplier_contact FROM f_product_changes) t, "
        "LATERAL (SELECT COALESCE(op, '') NOT IN ('INSERT', 'UPDATE') OR (COALESCE(name <> '', false) AND "
        "COALESCE(category <> '', false) AND quantity IS NOT NULL AND price IS NOT NULL AND "
        "COALESCE(supplier <> '', false)) AS ok)")
    # the typed form's numbers are the feed's own again, or missing where no number was typed
    q["validate_typed_product_requests"] = q["validate_product_requests"].replace(
        "quantity, price, regexp_replace(supplier,",
        "CASE WHEN request_id % 6 = 0 OR request_id % 8 = 0 THEN NULL ELSE quantity END AS quantity, "
        "CASE WHEN request_id % 9 = 0 THEN NULL ELSE price END AS price, regexp_replace(supplier,")
    q["validate_employee_requests"] = A(
        "SELECT *, CASE WHEN NOT ok THEN 'Please fill all required fields' END AS reason FROM ("
        f"SELECT request_id, op, id, {trim.format('name')} AS name, {trim.format('username')} AS username, role "
        "FROM f_employee_changes) t, LATERAL (SELECT COALESCE(op, '') NOT IN ('INSERT', 'UPDATE') OR "
        "(COALESCE(name <> '', false) AND COALESCE(username <> '', false)) AS ok)")
    q["validate_sale_requests"] = A(
        "SELECT *, CASE WHEN NOT ok THEN 'Please select a product and valid quantity' END AS reason FROM ("
        "SELECT *, (product_id IS NOT NULL AND product_id <> 0 AND NOT COALESCE(quantity < 1, false)) AS ok "
        "FROM f_sale_requests)")
    q["apply_sale_requests"] = A("SELECT * FROM sale_results", SALE_FOLD, recursive=True)
    q["apply_sale_requests_split_hot"] = q["apply_sale_requests"]
    q["stock_after_sales"] = A(
        "SELECT p.id, p.name, p.category, CAST(p.quantity - COALESCE(s.sold, 0) AS INT) AS quantity, p.price, "
        "p.supplier_id, p.created_at, p.updated_at FROM f_products p LEFT JOIN (SELECT product_id, SUM(quantity) AS sold FROM sale_results "
        "WHERE status = 'ACCEPTED' GROUP BY product_id) s ON p.id = s.product_id", SALE_FOLD, recursive=True)
    q["new_sales_rows"] = A(
        "SELECT CAST((SELECT MAX(id) FROM f_sales) + ROW_NUMBER() OVER (ORDER BY ts, request_id) AS BIGINT) AS id, "
        "product_id, product_name, category, unit_price, quantity, total_amount, sale_date, ts AS sale_timestamp, "
        "cashier_id FROM sale_results WHERE status = 'ACCEPTED'", SALE_FOLD, recursive=True)
    return q


JOB_ORACLE_SQL = build()


def _console() -> dict[str, str]:
    from stockroom.plans.oracle import INV_VIEW, MS, PLIST
    A = with_adapters
    return {
        "adhoc_sql": A(f"SELECT category, CAST(SUM(quantity) AS BIGINT) AS total_units, "
                       f"CAST(SUM(quantity * price) AS {MS}) AS value FROM f_products GROUP BY category"),
        "register_views": A(f"SELECT product_name, category, CAST(SUM(quantity) AS BIGINT) AS total_units_sold, "
                            f"CAST(SUM(total_amount) AS {MS}) AS total_revenue FROM f_sales "
                            f"GROUP BY product_name, category"),
        "result_meta": A("SELECT COUNT(*) AS row_count, 9 AS column_count, "
                         "'id,name,category,quantity,price,stock_value,supplier_name,supplier_contact,stock_status' "
                         "AS columns FROM inv WHERE stock_status = 'LOW STOCK'", INV_VIEW),
        "write_report": A("SELECT * FROM plist", PLIST),
    }


JOB_ORACLE_SQL.update(_console())


def _streams() -> dict[str, str]:
    from stockroom.plans.oracle import MS
    A = with_adapters
    feed_fold = SALE_FOLD.replace("f_sale_requests", "f_sale_feed")
    return {
        "stream_apply_sales": A("SELECT * FROM sale_results", feed_fold, recursive=True),
        "stream_daily_kpis": A(
            f"SELECT sale_date AS day, COALESCE(CAST(SUM(total_amount) AS {MS}), 0) AS revenue, "
            f"CAST(SUM(quantity) AS BIGINT) AS items_sold, COUNT(*) AS transactions FROM f_sales GROUP BY sale_date"),
        # days whose end lies a watermark's day before the latest sale
        "stream_daily_kpis_closed": A(
            f"SELECT sale_date AS day, COALESCE(CAST(SUM(total_amount) AS {MS}), 0) AS revenue, "
            f"CAST(SUM(quantity) AS BIGINT) AS items_sold, COUNT(*) AS transactions FROM f_sales GROUP BY sale_date "
            f"HAVING sale_date + INTERVAL 2 DAY <= (SELECT MAX(sale_timestamp) FROM f_sales)"),
        "stream_revenue_by_category": A(
            f"SELECT category, CAST(SUM(quantity) AS BIGINT) AS total_units_sold, "
            f"CAST(SUM(total_amount) AS {MS}) AS total_revenue FROM f_sales GROUP BY category"),
        "stream_stock_alerts": A(
            "SELECT request_id, product_id, ts, alert, stock_before, \"left\" FROM ("
            "SELECT *, CASE WHEN \"left\" = 0 THEN 'OUT OF STOCK' WHEN \"left\" > 0 AND \"left\" < 10 "
            "AND stock_before >= 10 THEN 'LOW STOCK' END AS alert FROM sale_results WHERE status = 'ACCEPTED') "
            "WHERE alert IS NOT NULL", feed_fold, recursive=True),
    }


JOB_ORACLE_SQL.update(_streams())
