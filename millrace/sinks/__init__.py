"""Writers and write semantics."""
