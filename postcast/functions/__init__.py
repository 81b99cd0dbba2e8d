"""Column expressions (all JVM-side, codegen-friendly) used by the operators."""
