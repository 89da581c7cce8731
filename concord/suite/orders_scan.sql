SELECT o_orderkey, o_custkey, o_totalprice
FROM orders;
