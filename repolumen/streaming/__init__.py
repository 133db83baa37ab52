"""Incremental jobs and time-ordered operators, in stream and batch form."""
