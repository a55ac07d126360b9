"""Column functions on k-mers and words."""

from .kspace import KmerSpace, TextKmers

__all__ = ["KmerSpace", "TextKmers"]
