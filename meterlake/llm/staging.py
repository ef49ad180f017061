"""Tables written to the folder that driver and executors share; see :mod:`meterlake.lineage`."""

from meterlake.lineage import cut as staged
from meterlake.lineage import shared_dir

__all__ = ["shared_dir", "staged"]
