"""Column-level functions: special functions, Normal-Inverse-Wishart algebra, random numbers."""
