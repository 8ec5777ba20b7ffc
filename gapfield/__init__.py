"""Distance fields, contact loads and signal checks as Spark table and stream jobs."""
