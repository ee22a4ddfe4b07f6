"""Column builders: every function returns a JVM-side expression unless it says otherwise."""
