"""Share-issue analytics as composable PySpark DataFrame operators."""
