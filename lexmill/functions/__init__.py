"""Column functions: everything here builds Spark expressions and stays in the JVM."""
