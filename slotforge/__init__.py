"""Evidence checking, routing and audit of extracted document fields on Spark."""
