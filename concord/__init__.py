"""Concord: dataset agreement checks as Spark DataFrame jobs."""
