"""Document-to-ledger analytics as composable PySpark operators."""
