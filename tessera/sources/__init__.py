"""Readers and writers."""

from .scratch import materialize, scratch, shared_dir
from .tables import read_table

__all__ = ["materialize", "read_table", "scratch", "shared_dir"]
