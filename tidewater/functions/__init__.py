"""See README.md for the operators that live here."""
