"""The queries of the library, by name, with the SQL that gives the same rows."""
