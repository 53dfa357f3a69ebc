"""Part of the catalogue engine; see README.md."""
