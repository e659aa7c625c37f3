"""Registered queries over the star-schema tables, each with its SQL oracle where SQL can say it."""
