"""Evidence and measurement analytics as PySpark DataFrame operators."""
