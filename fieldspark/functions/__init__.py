"""Column builders: geometry, orientations, kernels and polynomials as expressions that Spark compiles."""
