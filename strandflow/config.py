"""Settings of a run, with the defaults that take effect and their checks."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

MERGE_MODES = ("fast", "mem", "ord", "best")


@dataclass(frozen=True)
class AlignConfig:
    partitions: int = 4
    #: Least length of an alignment; k-mer length (0: three quarters of alen); distance of sampled k-mers of a read (0: chosen so that none is missed).
    alen: int = 20
    bmer: int = 0
    step: int = 0
    nhash: int = 5
    ibits: int = 8
    merge_mode: str = "best"
    max_rec: int = 5
    paired: bool = True
    keep_qual: bool = False
    fallback: str = "last"
    aligner: str = "longest-exact-match"
    #: exact: reads go where a sampled k-mer of theirs is; bloom: where the partition's Bloom filter (ibits, nhash) says so;
    #: minimiser: by the least k-mers of windows of alen bases, of reads and targets alike (a fraction of all k-mers).
    dispatch: str = "exact"

    def __post_init__(self):
        put = lambda name, value: object.__setattr__(self, name, value)
        if self.bmer <= 0:
            put("bmer", 3 * self.alen // 4)
        if self.step <= 0:
            put("step", self.alen - self.bmer + 1)
        if self.alen <= 1:
            raise ValueError("alen must be more than 1")
        if self.bmer > self.alen:
            raise ValueError("bmer must not be more than alen: a match of alen bases would hold no whole k-mer")
        if self.partitions < 1 or self.nhash < 1 or self.ibits < 1 or self.max_rec < 1 or self.step < 1:
            raise ValueError("partitions, nhash, ibits, max_rec and step must be at least 1")
        if self.merge_mode not in MERGE_MODES:
            raise ValueError(f"merge_mode must be one of {', '.join(MERGE_MODES)}")
        if self.fallback not in ("last", "max"):
            raise ValueError("fallback must be last or max")
        if self.dispatch not in ("exact", "bloom", "minimiser"):
            raise ValueError("dispatch must be exact, bloom or minimiser")
        if self.step > self.alen - self.bmer + 1:
            warnings.warn("with this step a match of alen bases can hold no sampled k-mer", stacklevel=3)

    @property
    def window(self) -> int:
        """k-mers of a window of alen bases, whose least ones dispatch goes by; 0 for all k-mers."""
        return self.alen - self.bmer + 1 if self.dispatch == "minimiser" else 0
