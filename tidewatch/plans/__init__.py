"""The query catalogue and the same queries as SQL."""
