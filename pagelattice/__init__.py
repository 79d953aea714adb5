"""Page-layout and annotation analytics as PySpark DataFrame operators."""
