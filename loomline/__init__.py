"""Market and text analytics on PySpark: DataFrame operators, sources, functions, plans and streams."""
