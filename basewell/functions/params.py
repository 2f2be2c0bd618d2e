"""Index parameters, validated once."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class IndexParams:
    """c: bases of the key (core); f: flanking bases, half on each side; s: s-mer of the closed-syncmer filter (0: keep every window).

    header_threshold: flanks are kept for keys that occur more often; max_range_size: keys that occur more often are dropped
    (None: no cap); cells_per_body: keys per layout block, a power of two; orient: "core" or "kmer"; layout: "direct" or
    "hash" (no cap, ranges without room for flanks); structural_cap: also drop keys over 65536 / cells_per_body."""

    c: int = 15
    f: int = 16
    s: int = 0
    header_threshold: int = 2
    max_range_size: int | None = None
    cells_per_body: int = 16
    orient: str = "core"
    layout: str = "direct"
    structural_cap: bool = False
    allow_large_c: bool = False

    def __post_init__(self):
        if not 1 <= self.c <= (31 if self.allow_large_c else 15):
            raise ValueError(f"c is {self.c}; 1 to 15 are allowed, up to 31 with allow_large_c")
        if self.f < 0 or self.f % 2 or self.f > 16:
            raise ValueError(f"f is {self.f}; it must be even and at most 16")
        if self.k > 32:
            raise ValueError(f"k = c + f is {self.k}; at most 32 bases fit a word")
        if self.s and not 1 <= self.s <= self.c:
            raise ValueError(f"s is {self.s}; it must be 1 to c")
        if self.cells_per_body < 1 or self.cells_per_body & (self.cells_per_body - 1):
            raise ValueError(f"cells_per_body is {self.cells_per_body}; it must be a power of two")
        if 4**self.c < self.cells_per_body:
            raise ValueError("there must be at least as many keys as cells in a block")
        if self.orient not in ("core", "kmer") or self.layout not in ("direct", "hash"):
            raise ValueError("orient is 'core' or 'kmer', layout 'direct' or 'hash'")

    @property
    def k(self) -> int:
        """Bases of a window."""
        return self.c + self.f

    @property
    def cap(self) -> int | None:
        """The most occurrences that a key may have, if there is such a limit."""
        if self.layout == "hash":
            return None
        limits = [x for x in (self.max_range_size, 65536 // self.cells_per_body if self.structural_cap else None) if x is not None]
        return min(limits, default=None)

    @property
    def block_shift(self) -> int:
        return self.cells_per_body.bit_length() - 1

    @property
    def table_cells(self) -> int:
        """Cells of the direct table: one per key, four per block for its head, and one closing head."""
        return 4**self.c + 4 * (4**self.c >> self.block_shift) + 4

    def as_dict(self) -> dict:
        return asdict(self)
