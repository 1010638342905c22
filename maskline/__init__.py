"""Consistent pseudonymisation of related tables, as Spark jobs."""
