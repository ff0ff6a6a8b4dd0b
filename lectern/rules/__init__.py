"""Audit rules. Each is a query builder: it takes the facts and gives a DataFrame of findings."""
