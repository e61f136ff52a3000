"""Column expressions: all native, so that they stay in whole-stage code generation."""
