"""Two-sided payment ledger reconciliation as Spark DataFrame operators."""
