"""Intermediate tables, as in the rest of the library."""

from strataseek.scratch import clear, delete, discard, fence, materialize, new_path, shared_root

__all__ = ["clear", "delete", "discard", "fence", "materialize", "new_path", "shared_root"]
