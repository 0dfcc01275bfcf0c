"""Part of palaver; see the package docstring."""
