"""Column functions: everything here stays inside Catalyst."""

from .binding import chain_hash, commitment_digest, manifest_assertion
from .encoding import (
    account_hash16,
    b64url_decode,
    b64url_encode,
    iso_utc,
    parse_hex_lenient,
    uuid_text,
)
from .hashes import (
    bits_to_hex,
    hamming64,
    hamming_hex,
    hash_distances,
    hex_to_i64,
    i64_to_hex,
    is_hex,
    register_sql_functions,
    trigram_similarity,
    trigrams,
    within_threshold,
)
from .keys import account_public_key, derive_subkey, hmac_sha256, payload_hex
from .signal import (
    adaptive_delta,
    block_energy,
    qim_bit,
    qim_embed,
    sync_ratio,
)

__all__ = [name for name in dir() if not name.startswith("_")]
