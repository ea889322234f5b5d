"""Bounded chain-event ETL and coverage-aware event queries on PySpark."""
