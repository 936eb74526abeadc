"""Tunable limits of a run. One frozen object is passed down instead of module globals."""

from __future__ import annotations

import re
from dataclasses import dataclass

MEBIBYTE = 1024 * 1024


@dataclass(frozen=True)
class Settings:
    # These limits define which rows count as stored, failed or warned about.
    slug_max_length: int = 80
    max_attempts: int = 4
    max_redirects: int = 5
    image_size_warning: int = 10 * MEBIBYTE
    article_size_warning: int = 50 * MEBIBYTE
    image_count_warning: int = 50

    # One instant for the whole batch, so that a re-run of the job gives the same documents.
    downloaded_at: str = "2026-01-01T00:00:00Z"
    tool: str = "folioforge v0.1.0"

    def __post_init__(self) -> None:
        if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", self.downloaded_at):
            raise ValueError(f"downloaded_at must look like 2026-01-01T00:00:00Z, not {self.downloaded_at!r}")

    @property
    def run_stamp(self) -> str:
        """``downloaded_at`` as ``YYYYMMDD-HHMMSS``, the form used inside slugs."""
        digits = re.sub(r"\D", "", self.downloaded_at)
        return f"{digits[:8]}-{digits[8:]}"
