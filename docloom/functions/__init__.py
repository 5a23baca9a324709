"""Column expressions shared by the operators. No Python UDFs: everything stays in codegen."""
