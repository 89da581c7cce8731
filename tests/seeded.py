"""The three seeded source and target pairs with planted defects."""

from concord.operators.rows import Pair

CUSTOMER_SOURCE = """SELECT CAST(id AS INT) AS CustomerID, n AS CustomerName, CAST(d AS TIMESTAMP_NTZ) AS CreatedDate,
 a AS IsActive, CAST(c AS DECIMAL(19,4)) AS CreditLimit FROM VALUES
 (1, 'Acme Corp', '2024-01-15 10:30:00', true, 5000), (2, 'Jane Roe', '2024-02-20 14:45:00', true, 2500.5),
 (3, 'Globex Inc', '2024-03-10 09:00:00', false, 10000), (4, 'Initech', '2024-04-05 16:20:00', true, 750.25),
 (5, 'Umbrella Corp LLC', '2024-05-12 11:11:11', true, 0), (6, 'Hooli LLC', '2024-06-18 08:08:08', false, NULL)
 AS v(id, n, d, a, c)"""
CUSTOMER_TARGET = """SELECT CAST(id AS INT) AS CUSTOMER_ID, n AS CUSTOMER_NAME, CAST(d AS TIMESTAMP_NTZ) AS CREATED_AT,
 a AS IS_ACTIVE FROM VALUES
 (1, 'Acme Corp', '2024-01-15 10:30:00', true), (2, 'Jane R. Doe', '2024-02-20 14:45:00', true),
 (3, 'Globex Inc', '2024-03-10 09:00:00', false), (5, 'Umbrella Corp LLC', '2024-05-12 11:11:11', true),
 (5, 'Umbrella Corp LLC', '2024-05-12 11:11:11', true), (6, 'Hooli LLC', '2024-06-18 08:08:08', false),
 (7, 'Vandelay', '2024-07-22 13:13:13', true) AS v(id, n, d, a)"""
CUSTOMER_MAPPING = [
    Pair("CustomerID", "CUSTOMER_ID"),
    Pair("CustomerName", "CUSTOMER_NAME"),
    Pair("CreatedDate", "CREATED_AT"),
    Pair("IsActive", "IS_ACTIVE"),
]
ORDERS_SOURCE = """SELECT CAST(i AS INT) AS ORDER_ID, CAST(c AS INT) AS CUSTOMER_ID, CAST(t AS DECIMAL(12,2)) AS ORDER_TOTAL,
 CAST(p AS DOUBLE) AS DISCOUNT_PCT, s AS ORDER_STATUS FROM VALUES (101, 1, 250.00, 0.1, 'SHIPPED'),
 (102, 2, 99.5, NULL, 'SHIPPED'), (103, 3, 10.25, 0.0, 'PENDING'), (104, 1, 75.0, NULL, 'CANCELLED'),
 (105, 2, 42.42, 0.05, 'SHIPPED') AS v(i, c, t, p, s)"""
ORDERS_TARGET = """SELECT CAST(i AS INT) AS ORDER_ID, CAST(c AS INT) AS CUSTOMER_ID, CAST(t AS DECIMAL(10,2)) AS ORDER_TOTAL,
 s AS ORDER_STATUS FROM VALUES (101, 1, 199.99, 'SHIPPED'), (102, 2, 99.5, 'SHIPPED'), (104, 1, 75.0, 'CANCELLED'),
 (105, 2, 42.42, 'SHIPPED') AS v(i, c, t, s)"""
PRODUCTS_SOURCE = """SELECT CAST(i AS INT) AS product_id, s AS sku, d AS description, CAST(p AS DECIMAL(10,2)) AS price,
 k AS in_stock FROM VALUES (1, 'SKU-A', 'a', 9.99, true), (2, 'SKU-B', NULL, 19.99, true), (3, 'SKU-C', 'c', 49.99, false),
 (4, 'SKU-D', 'd', 14.50, true), (5, 'SKU-E', NULL, 89.00, true) AS v(i, s, d, p, k)"""
PRODUCTS_TARGET = """SELECT CAST(i AS INT) AS product_id, s AS sku, CAST(p AS DECIMAL(10,2)) AS price, k AS in_stock FROM VALUES
 (1, 'SKU-1', 9.99, true), (2, 'SKU-B', 19.99, true), (2, 'SKU-B', 19.99, true), (4, 'SKU-4', 14.50, true),
 (5, 'SKU-5', 89.00, true), (6, 'SKU-F', 5.00, true) AS v(i, s, p, k)"""


def pair(spark, name):
    texts = {
        "customer": (CUSTOMER_SOURCE, CUSTOMER_TARGET),
        "orders": (ORDERS_SOURCE, ORDERS_TARGET),
        "products": (PRODUCTS_SOURCE, PRODUCTS_TARGET),
    }
    return tuple(spark.sql(t) for t in texts[name])


def by_key(compared, key):
    """{key: sorted [(category, findings)]} of a row comparison."""
    out = {}
    for r in compared.collect():
        out.setdefault(r[key], []).append((r.category, r.findings))
    return {k: sorted(v) for k, v in out.items()}
