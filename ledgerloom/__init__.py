"""ledgerloom: cost-ledger analytics as Spark DataFrame operators."""
