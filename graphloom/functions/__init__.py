"""Functions of the engine; see README.md."""
