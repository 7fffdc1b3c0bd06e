"""Part of the tessera engine; see the package README."""
