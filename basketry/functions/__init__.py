"""Part of the retail analytics library."""
