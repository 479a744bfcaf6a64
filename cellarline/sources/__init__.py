"""Inputs and outputs: the sales fact, the ledger, sheet exports, tables and files."""
