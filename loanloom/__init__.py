"""Loan-portfolio analytics as PySpark DataFrame jobs."""
