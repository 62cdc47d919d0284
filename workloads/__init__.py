"""The registered queries and, apart from them, the SQL that states their results."""
