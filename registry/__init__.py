"""Registered queries: every operator over the test tables, with the SQL that checks it."""
