"""Readers and writers."""

from .images import capacity_filter, read_images, split_rejects, validate_images
from .index import MatchIndex, build_index, compact, open_index
from .ledger import (
    bind_claims,
    claim_time,
    read_ledger,
    read_ledger_evolved,
    read_ledger_images,
    register,
)
from .manifests import manifest_lookup, read_manifests
from .pages import list_page, update_pages
from .seals import audit_sealed, month_digests, read_seals, seal

__all__ = [name for name in dir() if not name.startswith("_")]
