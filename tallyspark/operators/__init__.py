"""DataFrame operators on ledgers."""
