"""Storage descriptors: where the rows of a table are kept between queries."""

from __future__ import annotations

import os
from dataclasses import dataclass
from urllib.parse import parse_qs, urlsplit

from pyspark import StorageLevel

#: Used where no descriptor is given: memory, 64 MiB.
DEFAULT = "ram:///?size_bytes=67108864"


@dataclass(frozen=True)
class Storage:
    kind: str  # "ram" or "file"
    size_bytes: int | None = None
    path: str | None = None
    direct: bool = False

    @property
    def page_size(self) -> int:
        return 1 if self.kind == "ram" else 4096

    @property
    def in_memory(self) -> bool:
        return self.kind == "ram"

    @property
    def level(self) -> StorageLevel:
        return StorageLevel.MEMORY_AND_DISK if self.in_memory else StorageLevel.DISK_ONLY


def parse_storage(descriptor: str | None = None) -> Storage:
    """ram:///?size_bytes=N, or file:///path?direct=true|false."""
    parts = urlsplit(descriptor or DEFAULT)
    found = parse_qs(parts.query, keep_blank_values=True, strict_parsing=bool(parts.query))
    if twice := [k for k, v in found.items() if len(v) > 1]:
        raise ValueError(f"storage parameter {twice[0]} is given more than once")
    options = {k: v[0] for k, v in found.items()}
    if parts.scheme == "ram":
        if unknown := options.keys() - {"size_bytes"}:
            raise ValueError(f"unknown storage parameter {sorted(unknown)[0]}")
        if not options.get("size_bytes", "").isdigit():
            raise ValueError("ram storage needs size_bytes, a whole number")
        return Storage("ram", size_bytes=int(options["size_bytes"]))
    if parts.scheme == "file":
        if unknown := options.keys() - {"direct"}:
            raise ValueError(f"unknown storage parameter {sorted(unknown)[0]}")
        if options.get("direct", "false") not in ("true", "false"):
            raise ValueError("direct must be true or false")
        if not parts.path:
            raise ValueError("file storage needs a path")
        return Storage("file", path=parts.path, direct=options.get("direct") == "true")
    raise ValueError(f"unknown storage scheme {parts.scheme!r}; ram and file are known")


@dataclass(frozen=True)
class BlockOptions:
    """Sizes of a block store; unset ones follow the machine. Only the checks have a meaning here: Spark manages memory."""

    block_size_bytes: int | None = None
    total_size_bytes: int | None = None

    def resolved(self, cache_bytes: int = 1 << 20) -> BlockOptions:
        for name, value in (("block_size_bytes", self.block_size_bytes), ("total_size_bytes", self.total_size_bytes)):
            if value is not None and value <= 0:
                raise ValueError(f"{name} must be positive")
        block = self.block_size_bytes or int(0.8 * cache_bytes)
        try:
            memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
        except (ValueError, OSError):
            memory = 16 << 30
        total = self.total_size_bytes or memory // 4
        if total < block:
            raise ValueError("total_size_bytes must be at least block_size_bytes")
        return BlockOptions(block, total)
