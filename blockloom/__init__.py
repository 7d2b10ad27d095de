"""Blockloom: ledger and fee-market analytics as Spark DataFrame operators."""
