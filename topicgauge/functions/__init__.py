"""Column builders: text, vector and band expressions that stay inside the JVM."""
