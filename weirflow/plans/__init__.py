"""Command text, macros and the registered queries."""
