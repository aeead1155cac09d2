"""Column expressions (JVM-side, whole-stage-codegen friendly)."""
