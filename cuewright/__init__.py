"""cuewright: timed-text alignment analytics as composable Spark DataFrame operators."""
