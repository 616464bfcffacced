"""ledgerleaf: document intelligence over Spark tables."""
