"""Part of meander; see README.md."""
