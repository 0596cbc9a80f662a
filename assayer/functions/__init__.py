"""Column-level building blocks shared by every operator."""
