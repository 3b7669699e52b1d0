"""Reading and writing files, catalog tables and JDBC tables."""
