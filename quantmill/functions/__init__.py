"""Window and guard expressions shared by the operators."""
