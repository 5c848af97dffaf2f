"""Runnable jobs over the library; each module has a function that takes a session, and a command line."""
