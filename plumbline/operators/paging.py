"""Page metadata."""

from __future__ import annotations

from pydantic import BaseModel


class PaginationInfo(BaseModel):
    total: int
    page: int
    size: int
    pages: int
    previous_page: int | None = None
    next_page: int | None = None


def page_of(total: int, size: int, offset: int) -> PaginationInfo:
    """There is one page at least, and the page is one that there is."""
    pages = max(1, -(-total // size))
    page = min(max(offset // size + 1, 1), pages)
    return PaginationInfo(total=total, page=page, size=size, pages=pages, previous_page=page - 1 if page > 1 else None, next_page=page + 1 if page < pages else None)
