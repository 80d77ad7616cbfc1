"""The console's allow-list: what reads runs, everything else is refused before it runs."""

import os

import pytest

from stockroom.plans.console import ConsoleError, adhoc_sql, result_meta
from stockroom.sources.catalog import register_views

# The quick queries of the console that Spark's parser reads as they are, and Spark's
# form of the one that joins a supplier's product names.
CANNED = """SELECT * FROM employees;
SELECT * FROM products;
SELECT * FROM sales ORDER BY sale_timestamp DESC;
SELECT * FROM suppliers;
SELECT * FROM v_sales_report;
SELECT * FROM v_revenue_by_category;
SELECT * FROM v_revenue_by_product;
SELECT * FROM sales WHERE sale_date = CURDATE();
SELECT SUM(total_amount) AS total_revenue, COUNT(*) AS total_orders FROM sales;
SELECT * FROM v_inventory_with_supplier;
SELECT * FROM v_inventory_with_supplier WHERE stock_status = 'OUT OF STOCK';
SELECT * FROM v_inventory_with_supplier WHERE stock_status = 'LOW STOCK';
SELECT category, SUM(quantity) AS total_units, SUM(quantity * price) AS value FROM products GROUP BY category;
SHOW TABLES;
DESCRIBE products;
DESCRIBE sales;
SELECT s.name AS supplier, LISTAGG(p.name, ', ') WITHIN GROUP (ORDER BY p.name) AS products FROM suppliers s LEFT JOIN products p ON p.supplier_id = s.id GROUP BY s.name;""".split("\n")

READS = CANNED + """WITH a AS (SELECT id FROM products), b(x) AS (SELECT 1) SELECT * FROM a JOIN b ON a.id = b.x
WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT sum(n) FROM r
SELECT category, count(*) FROM products WHERE id IN (SELECT product_id FROM sales) OR EXISTS (SELECT 1 FROM suppliers s WHERE s.id = supplier_id) GROUP BY category WITH ROLLUP HAVING count(*) > 0 ORDER BY 1 LIMIT 5
SELECT name, rank() OVER w, lag(price, 1) OVER (PARTITION BY category ORDER BY id) FROM products WINDOW w AS (ORDER BY price DESC)
SELECT CASE WHEN quantity < 10 THEN 'low' ELSE upper('ok') END, CAST(price AS INT), price * 2 - 1, name LIKE 'W%', quantity BETWEEN 1 AND 3, substring(name FROM 1 FOR 2), extract(YEAR FROM DATE '2020-01-01') FROM products
SELECT transform(array(1, 2), x -> x + 1), filter(array(1, 2), x -> x > 1), named_struct('a', 1).a, map('k', 2)['k']
SELECT * FROM products LATERAL VIEW explode(array(1, 2)) e AS y
SELECT * FROM products, LATERAL (SELECT products.id + 1 AS b)
SELECT * FROM (SELECT category, quantity FROM products) PIVOT (sum(quantity) FOR category IN ('Furniture'))
SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS t(x, y) UNION ALL SELECT id, name FROM products EXCEPT SELECT 1, 'a'
FROM products |> WHERE quantity > 1 |> AGGREGATE count(*) GROUP BY category
EXPLAIN SELECT * FROM products
EXPLAIN DESCRIBE products
DESCRIBE QUERY SELECT 1
SHOW COLUMNS IN products""".split("\n")

# {d}: a folder that must not come into being
REFUSED = """FROM employees SELECT TRANSFORM(id) USING 'mkdir {d}; cat' AS (x)
SELECT TRANSFORM(id) USING 'mkdir {d}; cat' AS (x) FROM employees
SELECT * FROM (SELECT TRANSFORM(id) USING 'mkdir {d}; cat' AS (x) FROM employees)
SELECT * FROM products WHERE id IN (SELECT TRANSFORM(id) USING 'mkdir {d}; cat' AS (x) FROM employees)
WITH a AS (SELECT TRANSFORM(id) USING 'mkdir {d}; cat' AS (x) FROM employees) SELECT * FROM a
EXPLAIN SELECT TRANSFORM(id) USING 'mkdir {d}; cat' AS (x) FROM employees
SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', 'user.home')
SELECT * FROM IDENTIFIER('products')
SELECT reflect('java.lang.System', 'getProperty', 'user.home')
SELECT java_method('java.lang.System', 'getProperty', 'user.home')
SELECT try_reflect('java.lang.System', 'getProperty', 'user.home')
SELECT `Reflect`('java.lang.System', 'getProperty', 'user.home')
SELECT system.builtin.reflect('java.lang.System', 'getProperty', 'user.home')
SELECT rank() OVER w FROM products WINDOW w AS (ORDER BY reflect('java.lang.System', 'getProperty', 'user.home'))
SELECT transform(array(1), x -> reflect('java.lang.System', 'getProperty', 'user.home'))
SELECT sum(id) FILTER (WHERE reflect('java.lang.System', 'getProperty', 'user.home') = 'x') FROM products
SELECT * FROM products ORDER BY reflect('java.lang.System', 'getProperty', 'user.home')
FROM products |> SET name = reflect('java.lang.System', 'getProperty', 'user.home')
SELECT * FROM range(length(reflect('java.lang.System', 'getProperty', 'user.home')))
VALUES (reflect('java.lang.System', 'getProperty', 'user.home'))
SELECT own_function(id) FROM products
SELECT * FROM own_table_function(1)
SELECT * FROM parquet.`{d}`
SELECT * FROM text.`/etc/passwd`
SELECT * FROM `csv`.`/etc/passwd`
DESCRIBE text.`/etc/passwd`
TABLE json.`/etc/passwd`
SELECT * FROM products WITH (path = '/etc/passwd')
SELECT * FROM products VERSION AS OF 1
SELECT * FROM python_worker_logs()
SELECT input_file_name() FROM products
SELECT xpath_string('<a/>', 'a')
WITH a AS (SELECT 1 AS x) INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT * FROM a
FROM products INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT id
INSERT OVERWRITE LOCAL DIRECTORY '{d}' USING parquet SELECT 1
EXPLAIN INSERT OVERWRITE DIRECTORY '{d}' USING parquet SELECT 1
EXPLAIN CREATE TABLE x AS SELECT 1
EXPLAIN ANALYZE TABLE products COMPUTE STATISTICS
DESCRIBE QUERY SELECT TRANSFORM(id) USING 'mkdir {d}' FROM employees
SET spark.sql.ansi.enabled = false
ADD JAR '{d}'
CACHE TABLE products
REFRESH PATH '{d}'
EXECUTE IMMEDIATE 'SELECT 1'
BEGIN SELECT 1; END
CALL system.x()
DROP VIEW products
DROP TABLE products
CREATE TEMPORARY VIEW v USING text OPTIONS (path '/etc/passwd')
DECLARE x INT""".split("\n")


@pytest.fixture
def views(spark, seed):
    register_views(spark, seed)
    return spark


@pytest.mark.parametrize("sql", READS)
def test_reads(views, sql):
    assert adhoc_sql(views, sql).df.collect() is not None


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(views, sql, tmp_path):
    views.udf.register("own_function", lambda x: x)
    folder = str(tmp_path / "out")
    with pytest.raises(Exception) as why:
        adhoc_sql(views, sql.replace("{d}", folder))
    # the statement is refused by the list, or is no statement to Spark's parser
    assert isinstance(why.value, ConsoleError) or "PARSE_SYNTAX_ERROR" in str(why.value)
    assert not os.path.exists(folder)


def test_a_sessions_function_under_a_known_name_is_refused(spark):
    other = spark.newSession()
    other.range(1).createOrReplaceTempView("numbers")
    assert adhoc_sql(other, "SELECT upper('a') FROM numbers").df.count() == 1
    other.udf.register("upper", lambda x: x)
    with pytest.raises(ConsoleError):
        adhoc_sql(other, "SELECT upper('a') FROM numbers")


def test_parameters_and_meta(views):
    bound = adhoc_sql(views, "SELECT * FROM products WHERE quantity < :n", {"n": 10})
    assert bound.df.count() == 4
    assert result_meta(adhoc_sql(views, "SELECT id, name FROM products").df).first()["columns"] == "id,name"


def test_tables_of_the_catalog_can_be_named_in_full(views):
    views.createDataFrame([(1,)], "id int").createOrReplaceGlobalTempView("far_view")
    assert adhoc_sql(views, "SELECT * FROM global_temp.far_view").df.count() == 1
