"""Column-expression helpers (all JVM-side, codegen friendly)."""
