"""Registered queries: operators run over whole tables, each with an independent SQL statement."""
