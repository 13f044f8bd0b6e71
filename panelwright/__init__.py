"""Panel-data analytics as PySpark DataFrame operators."""
