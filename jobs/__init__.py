"""Runnable jobs: a function that takes a session and settings, and a command line each."""
