"""Every operator as a named query over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    account_hash16,
    adaptive_delta,
    b64url_decode,
    b64url_encode,
    block_energy,
    commitment_digest,
    hamming_hex,
    hash_distances,
    iso_utc,
    manifest_assertion,
    parse_hex_lenient,
    qim_bit,
    qim_embed,
    trigram_similarity,
    within_threshold,
)
from ..operators import (
    audit,
    blocks,
    codewords,
    commitments,
    embed,
    fingerprints,
    match,
    search,
    views,
)
from ..session import checkpointed, shared_dir
from ..settings import HASHES
from ..sources import images as image_source
from ..sources import ledger as ledger_source
from ..sources import manifests as manifest_source
from ..sources import pages, seals
from ..sources.index import MatchIndex, build_index
from ..streaming import match_stream, rate_limit_stream, register_stream, replay_stream
from . import derived
from .derived import MASTER

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _named(query: Query) -> Query:
    _QUERIES[query.__name__] = query
    return query


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _flat(view: DataFrame) -> DataFrame:
    nested = {"perceptual_hashes", "c2pa"}
    plain = [c for c in view.columns if c not in nested]
    return view.select(*plain, "perceptual_hashes.*", "c2pa.*")


def _hashes() -> dict[str, Column]:
    return {h: F.col(f"{h}64") for h in HASHES}


def _or_minus_one(name: str) -> Column:
    """Whole numbers without nulls compare the same in every engine."""
    return F.coalesce(F.col(name), F.lit(-1))


def _value(table: DataFrame, ok: int, column: str) -> str:
    return table.filter(F.col("ok") == ok).select(column).first()[0]


# --- ledger, bindings, views ---------------------------------------------------------


@_named
def ledger_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.ledger(spark, sf_dir).select(
        "ok",
        "asset_id",
        "payload_hex",
        "account_public_key",
        "chain_of_custody_hash",
        commitment_digest().alias("digest"),
        account_hash16("account_id").alias("account_hash"),
        *[f"{h}64" for h in HASHES],
    )


@_named
def entry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(views.entry_view(derived.ledger(spark, sf_dir)))


@_named
def public_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(
        views.public_view(
            derived.ledger(spark, sf_dir), derived.ledger_images(spark, sf_dir)
        )
    )


@_named
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = derived.ledger(spark, sf_dir)
    found = views.get_by_id(ledger, _value(ledger, 77, "asset_id"))
    return _flat(views.entry_view(found))


@_named
def get_by_commitment(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = derived.ledger(spark, sf_dir)
    found = views.get_by_commitment(ledger, _value(ledger, 78, "zkp_commitment_hex"))
    return _flat(views.entry_view(found))


@_named
def get_by_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = derived.reregistered(spark, sf_dir)
    found = views.get_by_payload(ledger, _value(ledger, 50, "payload_hex"))
    return _flat(views.entry_view(found))


@_named
def list_for_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = derived.ledger(spark, sf_dir)
    account = ledger.agg(F.min("account_id")).first()[0]
    return _flat(views.entry_view(views.list_for_account(ledger, account, 5, 1)))


@_named
def list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = views.list_all(derived.ledger(spark, sf_dir), limit=50, offset=20)
    return _flat(views.entry_view(page))


def _halves(ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    even = F.col("ok") % 2 == 0
    return ledger.where(even), ledger.where(~even)


def _stored_rows(ledger: DataFrame, path: str) -> None:
    """Append rows to the files of a ledger as they are."""
    month = F.date_format("creation_timestamp", "yyyy-MM")
    rows = ledger.drop("ok").withColumn("created_month", month).hint("rebalance", "created_month")
    rows.write.mode("append").partitionBy("created_month").parquet(f"{path}/rows")


@_named
def list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page in the middle; the directory knows half of the ledger's files."""
    path = f"{shared_dir(spark)}/paged-{uuid.uuid4().hex}"
    even, odd = _halves(derived.ledger(spark, sf_dir))
    _stored_rows(even, path)
    pages.update_pages(spark, path)
    _stored_rows(odd, path)
    return _flat(views.entry_view(pages.list_page(spark, path, limit=50, offset=700)))


@_named
def list_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind the row with the smallest id."""
    ledger = derived.ledger(spark, sf_dir)
    row = ledger.orderBy("asset_id").select("created_at", "asset_id").first()
    page = views.list_after(ledger, F.lit(row.created_at), row.asset_id, 50)
    return _flat(views.entry_view(page))


@_named
def current_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = views.current_version(derived.versions(spark, sf_dir))
    return latest.select("asset_id", iso_utc("updated_at").alias("updated_at"), "notes")


@_named
def register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Register all claims twice; the second time adds nothing."""
    path = _folder(spark, "ledger")
    claims = derived.claims(spark, sf_dir)
    for _ in range(2):
        ledger_source.register(claims.drop("ok"), path, MASTER)
    keys = claims.select("ok", "zkp_commitment_hex")
    return (
        ledger_source.read_ledger(spark, path)
        .join(keys, "zkp_commitment_hex")
        .select(
            "ok",
            "asset_id",
            "payload_hex",
            "account_public_key",
            "chain_of_custody_hash",
            "created_month",
        )
    )


@_named
def read_ledger_evolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files from before and after the image column, read as one table."""
    path = _folder(spark, "evolved")
    ledger = derived.ledger(spark, sf_dir)
    old = ledger.filter(F.col("ok") % 2 == 1).drop("ok")
    new = ledger.filter(F.col("ok") % 2 == 0).withColumn(
        "watermarked_image", F.concat(F.lit("img "), "ok").cast("binary")
    )
    old.write.parquet(path)
    new.drop("ok").write.mode("append").parquet(path)
    return ledger_source.read_ledger_evolved(spark, path).select(
        "asset_id",
        "payload_hex",
        F.col("watermarked_image").cast("string").alias("image_text"),
    )


@_named
def manifest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests kept as a table with the columns of `read_manifests`."""
    ledger = derived.ledger(spark, sf_dir)
    stored = ledger.select(
        F.concat("c2pa_manifest_uuid", F.lit(".c2pa")).alias("manifest_file"),
        F.concat(F.lit("manifest "), "ok").cast("binary").alias("raw_bytes"),
    )
    found = manifest_source.manifest_lookup(ledger, stored)
    return found.select(
        "asset_id", F.col("c2pa_manifest.raw_bytes").cast("string").alias("manifest_text")
    )


@_named
def validate_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("ok")
    asked = derived.ledger(spark, sf_dir).select(
        "ok",
        F.when(ok % 6 == 0, F.col("asset_id"))
        .when(ok % 6 == 1, F.concat(F.lit("no-"), "asset_id"))
        .alias("asset_id"),
        F.when(ok % 5 == 0, None)
        .when(ok % 5 == 1, F.concat(F.lit("zz"), "perceptual_hash_phash"))
        .when(ok % 5 == 2, F.substring("perceptual_hash_phash", 1, 6))
        .otherwise(F.col("perceptual_hash_phash"))
        .alias("phash"),
        F.when(ok % 7 == 0, F.col("perceptual_hash_dhash"))
        .when(ok % 7 == 1, F.repeat("perceptual_hash_dhash", 5))
        .alias("dhash"),
        (ok % 60).cast("int").alias("row_limit"),
        (ok % 70 - 2).cast("int").alias("max_distance"),
    )
    return views.validate_queries(asked).select("ok", "error_code", "searchable")


@_named
def validate_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("o_orderkey")
    sized = derived.table(spark, sf_dir, "orders").select(
        ok.alias("ok"),
        F.when(ok % 9 == 0, -1).otherwise(100 + ok % 4100).cast("int").alias("height"),
        F.when(ok % 9 == 0, -1).otherwise(120 + ok % 300).cast("int").alias("width"),
        F.when(ok % 17 == 0, 0)
        .when(ok % 19 == 0, 60_000_000)
        .otherwise(5000)
        .cast("bigint")
        .alias("file_bytes"),
    )
    return image_source.validate_images(sized).select("ok", "error_code", "error_detail")


@_named
def capacity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("o_orderkey")
    sized = derived.table(spark, sf_dir, "orders").select(
        ok.alias("ok"),
        (20 + ok % 150).cast("int").alias("height"),
        (40 + ok % 90).cast("int").alias("width"),
    )
    return image_source.capacity_filter(sized).select("ok")


# --- scalar functions ---------------------------------------------------------------------


@_named
def hamming_hex_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, d = F.col("perceptual_hash_phash"), F.col("perceptual_hash_dhash")
    a, w = F.col("perceptual_hash_ahash"), F.col("perceptual_hash_whash")
    return derived.ledger(spark, sf_dir).select(
        "ok",
        hamming_hex(p, F.upper(d)).alias("equal_length"),
        hamming_hex(p, F.concat(d, F.lit("00ff00ff"))).alias("longer"),
        hamming_hex(p, F.substring(d, 1, 8)).alias("shorter"),
        hamming_hex(F.concat(p, a), F.concat(d, w)).alias("long_pair"),
    )


@_named
def hash_distances_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _hashes()
    turned = dict(zip(HASHES, (own["dhash"], own["ahash"], own["whash"], own["phash"])))
    return (
        derived.ledger(spark, sf_dir)
        .select("ok", hash_distances(own, turned).alias("d"))
        .select(
            "ok",
            *[F.col(f"d.{h}").alias(h[0]) for h in HASHES],
            within_threshold(F.col("d")).alias("within_any"),
        )
    )


@_named
def trigram_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = trigram_similarity("perceptual_hash_phash", "perceptual_hash_dhash")
    return derived.ledger(spark, sf_dir).select(
        "ok", F.round(score, 6).alias("similarity")
    )


@_named
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, p = F.col("ok"), F.col("perceptual_hash_phash")
    text = F.concat("account_id", F.lit("?>"), "device_signature")
    loose = (
        F.when(ok % 4 == 0, F.concat(F.lit("  0x"), F.upper(p), F.lit(" ")))
        .when(ok % 4 == 1, F.substring(p, 1, 7))
        .when(ok % 4 == 2, F.concat(p, F.lit(" ")))
        .otherwise(F.concat(p, F.lit("xy")))
    )
    return derived.ledger(spark, sf_dir).select(
        "ok",
        b64url_encode(text).alias("encoded"),
        b64url_decode(b64url_encode(text)).cast("string").alias("decoded"),
        F.lower(F.hex(parse_hex_lenient(loose))).alias("parsed"),
    )


@_named
def manifest_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.ledger(spark, sf_dir).select(
        "ok", manifest_assertion().alias("assertion")
    )


@_named
def qim(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("grid8", lambda v: v * 100.0)
    return (
        derived.grids(spark, sf_dir)
        .select("vec_id", scaled.alias("c"))
        .select(
            "vec_id",
            adaptive_delta(block_energy(F.col("c"))).alias("step"),
            F.posexplode("c").alias("i", "v"),
        )
        .select(
            "vec_id",
            "i",
            F.round("step", 6).alias("delta"),
            qim_bit(F.col("v"), F.col("step")).alias("bit"),
            F.round(qim_embed(F.col("v"), F.col("i") % 2, F.col("step")), 6).alias(
                "marked"
            ),
        )
    )


# --- search ------------------------------------------------------------------------------------


def _probe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str, str]:
    ledger = derived.ledger(spark, sf_dir)
    near = derived.suspects(spark, sf_dir).withColumnRenamed("query_id", "ok")
    return ledger, _value(near, 7, "phash"), _value(ledger, 7, "perceptual_hash_dhash")


@_named
def search_phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, phash, _ = _probe(spark, sf_dir)
    hits = search.search_hash(ledger, "phash", phash, max_distance=26)
    return hits.select("asset_id", "distance")


@_named
def search_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, _, dhash = _probe(spark, sf_dir)
    hits = search.search_hash(ledger, "dhash", dhash, max_distance=None)
    return hits.select("asset_id", "distance")


@_named
def search_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, phash, _ = _probe(spark, sf_dir)
    account = _value(ledger, 7, "account_id")
    hits = search.search_hash(ledger, "phash", phash, account, max_distance=40)
    return hits.select("asset_id", "distance")


@_named
def search_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, phash, _ = _probe(spark, sf_dir)
    hits = search.search_trigram(ledger, "phash", phash, max_distance=30)
    return hits.select("asset_id", "distance")


@_named
def search_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger, phash, dhash = _probe(spark, sf_dir)
    hits = search.search_combined(ledger, phash, dhash, limit=10, max_distance=22)
    return hits.select(
        "asset_id",
        *[
            F.col(f"perceptual_distance.{h}").alias(f"{h}_distance")
            for h in ("phash", "dhash", "ahash")
        ],
        "payload_match",
    )


@_named
def radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.radius_join(
        derived.suspects(spark, sf_dir), derived.ledger(spark, sf_dir), max_distance=14
    )


def _index(spark: SparkSession, ledger: DataFrame) -> MatchIndex:
    """Built from two thirds of the ledger; two thirds, half of them known, are appended."""
    index = build_index(ledger.filter("ok % 3 <> 0"), _folder(spark, "indexed"))
    index.append(ledger.filter("ok % 3 <> 1"))
    return index


@_named
def radius_join_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.radius_join_indexed(
        derived.suspects(spark, sf_dir), _index(spark, derived.ledger(spark, sf_dir)), max_distance=14
    )


@_named
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = derived.suspects(spark, sf_dir).drop("account_id")
    return search.search_batch(
        asked, derived.ledger(spark, sf_dir), limit=3, max_distance=16
    )


@_named
def search_trigram_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = derived.suspects(spark, sf_dir).drop("account_id")
    return search.search_trigram_batch(
        asked, derived.ledger(spark, sf_dir), limit=3, max_distance=14
    )


@_named
def nearest_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = derived.ledger(spark, sf_dir).withColumn("idx", F.col("ok"))
    found = search.nearest_match(derived.suspects(spark, sf_dir), candidates)
    return found.withColumn("match_idx", _or_minus_one("match_idx"))


# --- match ----------------------------------------------------------------------------------------


@_named
def match_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("ok")
    asked = derived.ledger(spark, sf_dir).select(
        "ok",
        F.when(ok % 3 != 2, F.col("payload_hex")).alias("payload_hex"),
        F.when(ok % 3 == 0, F.col("account_id")).alias("account_id"),
    )
    found = match.match_payload(asked, derived.reregistered(spark, sf_dir))
    return found.select("ok", F.col("found.asset_id").alias("found_id"))


@_named
def encode_codewords(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = derived.ledger(spark, sf_dir).select("ok", "payload_hex")
    return codewords.encode_codewords(ledger).withColumn(
        "codeword", F.lower(F.hex("codeword"))
    )


@_named
def match_codeword(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codewords.match_codeword(
        derived.codeword_suspects(spark, sf_dir), derived.ledger(spark, sf_dir)
    )
    return found.drop("codeword").withColumn(
        "byte_errors", _or_minus_one("byte_errors")
    )


@_named
def match_codeword_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codewords.match_codeword(
        derived.codeword_suspects(spark, sf_dir), None, index=_index(spark, derived.ledger(spark, sf_dir))
    )
    return found.drop("codeword").withColumn(
        "byte_errors", _or_minus_one("byte_errors")
    )


def _report(found: DataFrame) -> DataFrame:
    return found.select(
        "image_id",
        "status",
        "asset_id",
        "payload_hex",
        F.col("ledger_match.payload_match").alias("payload_match"),
        _or_minus_one("ledger_match.perceptual_distance.phash").alias("phash_distance"),
        F.col("ledger_match.account_id").alias("match_account"),
        F.col("ledger_match.within_threshold").alias("within_threshold"),
        "extraction_status",
    )


@_named
def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report(
        match.lookup(
            derived.mixed_suspects(spark, sf_dir), derived.reregistered(spark, sf_dir)
        )
    )


@_named
def lookup_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = derived.reregistered(spark, sf_dir)
    suspects = derived.mixed_suspects(spark, sf_dir)
    return _report(match.lookup(suspects, ledger, index=_index(spark, ledger)))


@_named
def verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = derived.ledger(spark, sf_dir)
    ok = F.col("ok")
    other = _value(ledger, 3, "asset_id")
    claimed = ledger.select(
        "ok",
        F.when(ok % 5 == 0, F.concat(F.lit("missing-"), "ok"))
        .when(ok % 5 == 1, other)
        .otherwise(F.col("asset_id"))
        .alias("asset_id"),
    )
    suspects = derived.mixed_suspects(spark, sf_dir).join(claimed, "ok")
    return match.verify_read(suspects, ledger).select(
        "image_id",
        "asset_id",
        "verified",
        "status",
        _or_minus_one("perceptual_distance.dhash").alias("dhash_distance"),
    )


def _marked_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = derived.images(spark, sf_dir)
    codes = derived.image_payloads(spark, sf_dir).select("image_id", "codeword")
    marked = blocks.embed_bits(blocks.block_dct(blocks.image_blocks(plain)), codes)
    changed = blocks.write_luminance(plain, blocks.to_pixels(blocks.block_idct(marked)))
    return checkpointed(changed)  # marking and reading back are two jobs


@_named
def extract_and_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark whole images, read them back from their pixels, and look them up."""
    found = match.extract_and_lookup(
        _marked_images(spark, sf_dir), derived.ledger(spark, sf_dir)
    )
    return _report(found).select(
        "image_id", "status", "asset_id", "payload_hex", "payload_match"
    )


@_named
def embed_and_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mark whole images, register them, and verify the stored pixels."""
    path = _folder(spark, "marked")
    ids = derived.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ok"))
    claims = (
        derived.claims(spark, sf_dir)
        .select("ok", "account_id", "device_signature", "creation_timestamp", "zkp_commitment_hex")
        .join(ids, "ok")
        .withColumn("image_id", F.col("ok").cast("string"))
    )
    marked = embed.embed_images(derived.images(spark, sf_dir), claims, MASTER)
    ledger_source.register(marked.drop("image_id", "ok"), path, MASTER)
    ledger = ledger_source.read_ledger(spark, path)
    stored = ledger_source.read_ledger_images(spark, path).join(
        ledger.select("asset_id", "image_width", "image_height"), "asset_id"
    )
    suspects = stored.select(
        F.col("asset_id").alias("image_id"),
        "asset_id",
        F.col("image_height").alias("height"),
        F.col("image_width").alias("width"),
        F.col("watermarked_image").alias("data"),
    )
    checked = match.verify(suspects, ledger).select("asset_id", "verified")
    return ledger.join(checked, "asset_id").select(
        "payload_hex",
        "account_id",
        "image_width",
        "image_height",
        "file_size_bytes",
        (F.col("psnr_db") > 25).alias("clear"),
        "verified",
    )


@_named
def image_psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = derived.images(spark, sf_dir)
    return blocks.image_psnr(plain, _marked_images(spark, sf_dir)).withColumn(
        "psnr_db", F.round("psnr_db", 6)
    )


# --- blocks ------------------------------------------------------------------------------------------


def _moment(values: Column) -> Column:
    return F.aggregate(
        F.transform(values, lambda v, i: v * i), F.lit(0.0), lambda acc, v: acc + v
    ).cast("bigint")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v).cast("bigint")


@_named
def image_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("y")
    return blocks.image_blocks(derived.images(spark, sf_dir)).select(
        "image_id",
        "block_idx",
        _total(y).alias("total"),
        F.get(y, 0).cast("bigint").alias("first_cell"),
        F.get(y, 63).cast("bigint").alias("last_cell"),
        _moment(y).alias("moment"),
    )


def _rounded(features: DataFrame, digits: int = 4) -> DataFrame:
    numbers = [c for c in features.columns if c not in ("image_id", "block_idx")]
    return features.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in numbers})


@_named
def block_dct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        blocks.coef_features(blocks.block_dct(derived.blocks(spark, sf_dir)))
    )


@_named
def block_idct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forth and back: the blocks themselves."""
    back = blocks.block_idct(blocks.block_dct(derived.blocks(spark, sf_dir)))
    near = F.transform("y", lambda v: F.bround(v))
    return back.select(
        "image_id", "block_idx", _total(near).alias("total"), _moment(near).alias("moment")
    )


@_named
def embed_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = derived.image_payloads(spark, sf_dir).select("image_id", "codeword")
    marked = blocks.embed_bits(blocks.block_dct(derived.blocks(spark, sf_dir)), codes)
    return _rounded(blocks.coef_features(marked).drop("energy"))


@_named
def sync_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = blocks.coef_features(blocks.block_dct(derived.blocks(spark, sf_dir)))
    return blocks.sync_gain(features).withColumn("gain", F.round("gain", 6))


@_named
def extract_codewords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extract_codewords(derived.blocks(spark, sf_dir)).withColumn(
        "codeword", F.lower(F.hex("codeword"))
    )


@_named
def psnr(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = derived.blocks(spark, sf_dir)
    shifted = plain.withColumn(
        "y", F.transform("y", lambda v, i: v + (F.col("block_idx") + i) % 3)
    )
    return blocks.psnr(plain, shifted).withColumn("psnr_db", F.round("psnr_db", 6))


@_named
def downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = blocks.downsample(derived.images(spark, sf_dir), {"grid": (8, 8)})
    return cells.select("image_id", F.posexplode("grid").alias("cell", "m")).select(
        "image_id", "cell", F.round("m", 6).alias("mean")
    )


@_named
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thumbnails; those of 128x128 images are the images."""
    small = blocks.preview(derived.images(spark, sf_dir))
    return small.select("image_id", "height", "width", F.md5("data").alias("digest"))


# --- hashes ------------------------------------------------------------------------------------------


@_named
def ahash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = derived.grids(spark, sf_dir)
    return grids.select("vec_id", fingerprints.ahash("grid8").alias("ahash"))


@_named
def dhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = derived.grids(spark, sf_dir)
    return grids.select("vec_id", fingerprints.dhash("grid9").alias("dhash"))


@_named
def whash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = derived.grids(spark, sf_dir)
    return grids.select("vec_id", fingerprints.whash("grid32").alias("whash"))


@_named
def phash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grids = derived.grids(spark, sf_dir)
    return grids.select("vec_id", fingerprints.phash("grid32").alias("phash"))


@_named
def hash_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.hash_images(derived.images(spark, sf_dir)).select(
        "image_id", *HASHES
    )


# --- audits ------------------------------------------------------------------------------------------


@_named
def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_chain(derived.tampered(spark, sf_dir))


@_named
def chain_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.chain_mismatches(derived.tampered(spark, sf_dir)).select(
        "asset_id", "account_id"
    )


@_named
def audit_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the ledger is sealed, the other half comes later: only that is audited."""
    path = f"{shared_dir(spark)}/sealed-{uuid.uuid4().hex}"
    even, odd = _halves(derived.tampered(spark, sf_dir))
    _stored_rows(even, path)
    seals.seal(spark, path, MASTER)
    _stored_rows(odd, path)
    return (
        seals.audit_sealed(spark, path, MASTER)
        .groupBy("created_month", "status")
        .agg(F.sum("n_rows").alias("n_rows"), F.sum("mismatches").alias("mismatches"))
    )


@_named
def rate_limit_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = audit.rate_limit_audit(derived.request_log(spark, sf_dir), 4, "1 hour")
    return marked.select(
        "event_id", "key", iso_utc("window_start").alias("window_start"), "over_limit"
    )


@_named
def challenge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = audit.challenge_audit(derived.challenge_log(spark, sf_dir), MASTER)
    return checked.select(
        "event_id", "malformed", "expired", "mac_valid", "replayed", "uses", "outcome"
    ).withColumn("uses", _or_minus_one("uses"))


@_named
def commit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.col("ok")
    at = (ok % len(derived.OPENINGS)).cast("int")
    values, randoms = (F.array(*[F.lit(str(o[n])) for o in derived.OPENINGS]) for n in (0, 1))
    value = F.when(ok % 10 == 0, F.lit("-1")).otherwise(F.get(values, at))
    random = F.when(ok % 10 == 1, F.lit("0")).otherwise(F.get(randoms, at))
    return commitments.commit_batch(
        derived.ledger(spark, sf_dir).select("ok"), MASTER, value, random
    )


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed rows with wrong openings where `ok % 7` is 0 or 2."""
    ok = F.col("ok")
    long_number = F.concat(
        F.lit("0x"),
        *[F.sha2(F.concat_ws("|", F.lit("r"), F.lit(n), ok).cast("binary"), 256) for n in "0123456"],
    )
    made = commitments.commit_batch(
        derived.ledger(spark, sf_dir), MASTER, randomness=long_number
    )
    return made.withColumns(
        {
            "zkp_opening_value": F.when(ok % 7 == 0, F.lit("12345")).otherwise(
                F.col("zkp_opening_value")
            ),
            "zkp_opening_randomness": F.when(ok % 7 == 2, F.lit("0")).otherwise(
                F.col("zkp_opening_randomness")
            ),
        }
    )


@_named
def verify_commitments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commitments.verify_commitments(_committed(spark, sf_dir), MASTER).select(
        "ok", "opening_valid"
    )


@_named
def verify_commitments_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commitments.verify_commitments_grouped(
        _committed(spark, sf_dir), "device_signature", MASTER
    )


@_named
def find_bad_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = checkpointed(_committed(spark, sf_dir))  # it is read level by level
    found = commitments.find_bad_openings(made, "device_signature", MASTER)
    return found.select("ok", "device_signature")


# --- streams -----------------------------------------------------------------------------------------


def _events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = derived.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to its end into Parquet, and read the outcome."""
    path = _folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


@_named
def rate_limit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _events_stream(spark, sf_dir).select(
        F.col("event_type").alias("key"),
        F.lit("read").alias("route"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    counted = _drained(spark, rate_limit_stream(log, 4, "1 hour"), "windows")
    return counted.select(
        "key", iso_utc("window_start").alias("window_start"), "requests", "over_limit"
    )


def _staged(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    path = _folder(spark, name)
    table.write.parquet(path)
    return spark.readStream.schema(table.schema).parquet(path)


@_named
def replay_first_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _staged(spark, derived.challenge_log(spark, sf_dir), "challenges")
    parsed = audit.parse_challenges(log).filter(F.col("nonce").isNotNull())
    passed = _drained(spark, replay_stream(parsed), "replay")
    return passed.groupBy("account_id", "nonce").agg(F.count("*").alias("passed"))


@_named
def registered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "arrivals")
    claims = _staged(spark, derived.claims(spark, sf_dir).drop("ok"), "claims")
    register_stream(
        claims, f"{path}/ledger", f"{path}/checkpoint", MASTER
    ).awaitTermination()
    return ledger_source.read_ledger(spark, f"{path}/ledger").select(
        "asset_id", "payload_hex", "chain_of_custody_hash"
    )


@_named
def matched_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "matches")
    ledger = derived.ledger(spark, sf_dir)
    suspects = derived.codeword_suspects(spark, sf_dir).join(
        ledger.select(F.col("ok").alias("query_id"), *[f"{h}64" for h in HASHES]),
        "query_id",
    )
    arriving = _staged(
        spark,
        suspects.withColumn("image_id", F.col("query_id").cast("string")),
        "suspects",
    )
    match_stream(
        arriving, ledger, f"{path}/out", f"{path}/checkpoint"
    ).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("image_id", "status", "asset_id")
