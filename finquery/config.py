"""Settings with their usual values; each may come from the environment as ``FINQUERY_<NAME>``."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    max_upload_bytes: int = 50 << 20
    max_pages: int = 60
    render_dpi: int = 180
    max_image_side: int = 1600
    model_timeout_seconds: float = 300.0
    full_page_attempts: int = 2
    types_tried: int = 3
    region_fallback: bool = True
    job_ttl_minutes: int = 60
    event_buffer: int = 500
    subscriber_queue: int = 200

    @classmethod
    def from_environment(cls) -> Settings:
        given = {}
        for f in fields(cls):
            text = os.environ.get(f"FINQUERY_{f.name.upper()}")
            if text is not None:
                given[f.name] = text.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(text)
        return cls(**given)

    def pages_of(self, requested: int | None, total: int) -> int:
        """How many pages are read: what was asked, within 1 and the cap, and no more than there are."""
        if requested is not None and not 1 <= requested <= self.max_pages:
            raise ValueError(f"pages must lie between 1 and {self.max_pages}")
        return min(requested or self.max_pages, total, self.max_pages)
