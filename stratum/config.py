"""Settings of a site (SNK4), readable from and writable to TOML."""
from __future__ import annotations

import dataclasses
import re
import tomllib


def size_of(text: str) -> int | None:
    """Bytes of '10Gi', '2GB', '500'; None where the text is no size (so that a guard isn't switched off by a slip)."""
    got = re.fullmatch(r"([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([kmgt]?)(i?)b?", text.strip().lower())
    if not got or (got[3] and not got[2]):
        return None
    return int(float(got[1]) * (1024 if got[3] else 1000) ** " kmgt".index(got[2] or " "))


@dataclasses.dataclass(frozen=True)
class Config:
    location_id: str = "local"
    chunking: str = "fixed"
    chunk_size: int = 10 * 2**20
    cdc_min: int = 2**20
    cdc_avg: int = 4 * 2**20
    cdc_max: int = 10 * 2**20
    gc_grace_ms: int = 300_000
    min_free: str = "0"
    max_usage: str = "0"
    page: int = 500

    def __post_init__(self):
        for name in ("min_free", "max_usage"):
            if size_of(getattr(self, name)) is None:
                raise ValueError(f"{name}: no size: {getattr(self, name)!r}")

    @classmethod
    def loads(cls, text: str) -> Config:
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in tomllib.loads(text).items() if k in known})

    def dumps(self) -> str:
        return "".join(f'{k} = {v if isinstance(v, int) else chr(34) + v + chr(34)}\n' for k, v in dataclasses.asdict(self).items())
