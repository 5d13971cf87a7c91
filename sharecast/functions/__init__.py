"""Column-expression builders (JVM-side, inside whole-stage codegen)."""
