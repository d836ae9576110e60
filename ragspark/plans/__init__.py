"""The registered queries over the given tables, each with its SQL where there is one."""
