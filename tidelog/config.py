"""Engine settings: defaults are merged under what a JSON file says, then validated."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Tree:
    max_levels: int = 7
    max_tables_per_level: int = 4
    max_memtables: int = 4
    compaction: str = "size"
    path: str = "tidelog-data"


@dataclass(frozen=True)
class Cache:
    capacity: int = 1000


@dataclass(frozen=True)
class Log:
    segment_blocks: int = 16


@dataclass(frozen=True)
class Run:
    compression: bool = True
    separate_files: bool = True
    sparse_step: int = 10


@dataclass(frozen=True)
class Memtable:
    capacity: int = 1000
    type: str = "btree"


@dataclass(frozen=True)
class Bloom:
    false_positive_rate: float = 0.01


@dataclass(frozen=True)
class Block:
    size: int = 4096
    cache: int = 100


@dataclass(frozen=True)
class Crc:
    size: int = 4


@dataclass(frozen=True)
class Bucket:
    tokens: int = 10
    refill_amount: int = 1
    refill_seconds: int = 20


@dataclass(frozen=True)
class Settings:
    tree: Tree = field(default_factory=Tree)
    cache: Cache = field(default_factory=Cache)
    log: Log = field(default_factory=Log)
    run: Run = field(default_factory=Run)
    memtable: Memtable = field(default_factory=Memtable)
    bloom: Bloom = field(default_factory=Bloom)
    block: Block = field(default_factory=Block)
    crc: Crc = field(default_factory=Crc)
    bucket: Bucket = field(default_factory=Bucket)

    def validated(self) -> Settings:
        positive = {
            "tree.max_levels": self.tree.max_levels, "tree.max_tables_per_level": self.tree.max_tables_per_level, "tree.max_memtables": self.tree.max_memtables,
            "log.segment_blocks": self.log.segment_blocks, "run.sparse_step": self.run.sparse_step, "memtable.capacity": self.memtable.capacity,
            "block.size": self.block.size, "crc.size": self.crc.size, "bucket.tokens": self.bucket.tokens, "bucket.refill_amount": self.bucket.refill_amount, "bucket.refill_seconds": self.bucket.refill_seconds,
        }
        wrong = [f"{k} must be positive" for k, v in positive.items() if v <= 0]
        wrong += [f"{k} must not be negative" for k, v in (("cache.capacity", self.cache.capacity), ("block.cache", self.block.cache)) if v < 0]
        if self.tree.compaction not in ("size", "level", "leveled"):
            wrong.append("tree.compaction must be size, level or leveled")
        if self.memtable.type not in ("btree", "skiplist", "hashmap"):
            wrong.append("memtable.type must be btree, skiplist or hashmap")
        if not 0 < self.bloom.false_positive_rate < 1:
            wrong.append("bloom.false_positive_rate must lie between 0 and 1")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def _merged(base, given: dict):
    known = {f.name for f in fields(base)}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(base, **{k: _merged(getattr(base, k), v) if is_dataclass(getattr(base, k)) else v for k, v in given.items()})


def from_json(text: str) -> Settings:
    return _merged(Settings(), json.loads(text)).validated()


def load(path: str) -> Settings:
    """Settings of a local JSON file; the defaults where there is none."""
    try:
        with open(path) as f:
            return from_json(f.read())
    except FileNotFoundError:
        return Settings()


def save(settings: Settings, path: str) -> None:
    with open(path, "w") as f:
        f.write(settings.validated().to_json())
