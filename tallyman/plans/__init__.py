"""The operators put together into whole jobs."""

from tallyman.plans.fetch import plan_fetch
from tallyman.plans.pack import Packing, pack_archive, pack_tree
from tallyman.plans.pull import Pull, plan_pull
from tallyman.plans.split import Split, split_archives

__all__ = [
    "Packing",
    "Pull",
    "Split",
    "pack_archive",
    "pack_tree",
    "plan_fetch",
    "plan_pull",
    "split_archives",
]
