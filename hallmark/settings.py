"""Fixed values and tunables shared by the operators."""

from __future__ import annotations

# --- fixed values (they must stay equal for results to stay comparable) -------
HASHES = ("phash", "dhash", "ahash", "whash")
MATCH_THRESHOLDS = {"phash": 8, "dhash": 6, "ahash": 6, "whash": 7}
SEARCH_MAX_DISTANCE = {"phash": 10, "dhash": 8}
SEARCH_LIMIT = 20
SEARCH_LIMIT_RANGE = (1, 50)
DISTANCE_RANGE = (0, 64)
HASH_LENGTH_RANGE = (8, 64)
TRIGRAM_THRESHOLD = 0.3

MIN_IMAGE_SIDE = 128
MAX_IMAGE_SIDE = 4096
MAX_IMAGE_BYTES = 50 * 1024 * 1024

BLOCK = 8
QIM_DELTA = 20.0
DATA_COEFS = ((2, 1), (1, 2), (2, 2), (3, 1))
SYNC_COEF = (4, 1)
SYNC_BLOCKS = 4
PAYLOAD_BYTES = 16
PARITY_BYTES = 32
CODEWORD_BYTES = PAYLOAD_BYTES + PARITY_BYTES
DATA_BLOCKS = CODEWORD_BYTES * 8 // len(DATA_COEFS)
NEEDED_BLOCKS = SYNC_BLOCKS + DATA_BLOCKS
MAX_BYTE_ERRORS = PARITY_BYTES // 2
PSNR_IDENTICAL = 99.0

NONCE_TTL_SECONDS = 600

# --- names that belong to a deployment ------------------------------------------
# Keys are derived under a namespace. Someone who already holds payloads passes
# the namespace those were derived under, and gets the same payloads.
KEY_NAMESPACE = "hallmark/v1/"
GENERATOR_NAME = "hallmark engine"
GENERATOR_VERSION = "1.0.0"
FALLBACK_SCHEME = "hallmark://"
