"""Stands in for a page-view service: months that fail some times, or always, counted in files."""

from __future__ import annotations

from pathlib import Path


def unsteady(month, options):
    """2026-02 answers at the third time, 2026-03 never, 2026-04 refuses."""
    count = Path(options["folder"], f"asked-{month}")
    asked = int(count.read_text()) + 1 if count.exists() else 1
    count.write_text(str(asked))
    if month == "2026-02" and asked < 3:
        return 503, []
    if month in ("2026-03", "2026-04"):
        return (404 if month == "2026-03" else 403), []
    return 200, [{"article": f"A_{month}", "views": 5, "rank": 1}, {"article": "B", "views": 3, "rank": 2}]
