"""Analytical operators: functions from a sales, ledger or series DataFrame to a DataFrame."""
