"""DataFrame toolkit that turns a table of long legal texts into labelled data."""

__version__ = "0.1.0"
