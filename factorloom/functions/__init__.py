"""Column expressions and small DataFrame kernels shared by the operators."""
