"""Part of the ranking-diagnostics engine."""
