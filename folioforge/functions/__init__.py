"""Column expressions. Everything here runs inside the JVM; there are no Python UDFs."""
