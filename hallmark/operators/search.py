"""Hamming-distance search: one query, two hashes, or a whole table of queries."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import partial
from itertools import combinations
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import hamming64, hamming_hex, hex_to_i64, i64_to_hex, is_hex, trigram_similarity
from ..functions.hashes import HEX_PATTERN, trigrams
from ..session import checkpointed, dealt, task_count
from ..settings import SEARCH_LIMIT, SEARCH_MAX_DISTANCE, TRIGRAM_THRESHOLD

from .cells import KEY_BITS, Keep, alike, cell_pairs

if TYPE_CHECKING:
    from ..sources.index import MatchIndex

HASH_BITS = 64
NO_DISTANCE = 10**9
PROBE_COST = 5
BY_COLUMN = -1
#: Radii of the rounds of a search for the nearest, and the parts they look up.
ROUNDS = (3, 7, 11, 15, 19, 23, HASH_BITS)
ROUND_PARTS = 4
#: Candidates from which such searches have a round at the radius where chance alone finds some.
MANY_ROWS = 1 << 20
#: Rows that probes of few queries may meet in a stored index, which is then joined where it lies.
FEW_MET = 1 << 24


# --- one query ---------------------------------------------------------------------


def hash64(table: DataFrame, column: str) -> Column:
    """The bigint twin of a hash column, parsed only where it is not stored."""
    if f"{column}64" in table.columns:
        return F.col(f"{column}64")
    return hex_to_i64(hash_text(table, column))


def hash_text(table: DataFrame, column: str) -> Column:
    stored = f"perceptual_hash_{column}"
    return F.col(stored if stored in table.columns else column)


def _measured(rows: DataFrame, column: str, query_hex: str, max_distance: int | None) -> DataFrame:
    """Add `distance`, and keep rows within `max_distance`.

    Words of 64 bits are compared as bigints, inside generated code. Texts that are no
    such word differ in all digits of the longer one, four bits each, so only the few that are
    left over need more than arithmetic.
    """
    text, word = hash_text(rows, column), HASH_BITS // 4
    near = F.lit(True) if max_distance is None else F.col("distance") <= max_distance
    if len(query_hex) != word:
        return rows.withColumn("distance", hamming_hex(text, F.lit(query_hex))).filter(near)
    whole = rows.withColumn("distance", hamming64(hash64(rows, column), hex_to_i64(F.lit(query_hex))))
    whole = whole.filter(F.col("distance").isNotNull() & near)
    if max_distance is not None and max_distance < 4 * word:
        return whole  # another length is 64 bits away at least
    odd = rows.filter(hash64(rows, column).isNull()).withColumn("distance", hamming_hex(text, F.lit(query_hex)))
    return whole.unionByName(odd.filter(F.col("distance").isNotNull() & near))


def search_hash(
    ledger: DataFrame,
    column: str,
    query_hex: str,
    account: str | None = None,
    limit: int = SEARCH_LIMIT,
    max_distance: int | None = BY_COLUMN,
    trigrams: float | None = None,
) -> DataFrame:
    """The `limit` rows nearest to one hash, nearest first, ties by id.

    Each hash has its own default distance, 10 where none is set.
    `max_distance=None` returns the nearest rows however far. `trigrams` (say
    0.3) first drops rows whose hex text looks different; that loses rows and
    is there for callers who need the answers of a trigram index.
    """
    if max_distance == BY_COLUMN:
        max_distance = SEARCH_MAX_DISTANCE.get(column, 10)
    valid = F.lit(query_hex or "").rlike(HEX_PATTERN)
    rows = ledger.filter(valid)
    if account is not None:
        rows = rows.filter(F.col("account_id") == account)
    if trigrams is not None:
        text = hash_text(ledger, column)
        rows = rows.filter(trigram_similarity(text, F.lit(query_hex)) >= trigrams)
    rows = _measured(rows, column, query_hex or "", max_distance)
    return rows.orderBy("distance", "asset_id").limit(limit)


def search_trigram(
    ledger: DataFrame,
    column: str,
    query_hex: str,
    account: str | None = None,
    limit: int = SEARCH_LIMIT,
    max_distance: int = BY_COLUMN,
    threshold: float = TRIGRAM_THRESHOLD,
) -> DataFrame:
    return search_hash(
        ledger, column, query_hex, account, limit, max_distance, trigrams=threshold
    )


def search_combined(
    ledger: DataFrame,
    phash: str | None,
    dhash: str | None,
    account: str | None = None,
    limit: int = 10,
    max_distance: int | None = BY_COLUMN,
    stub_zeros: bool = True,
) -> DataFrame:
    """pHash hits first, then rows that only dHash found, cut to `limit`.

    The distance of a hash that did not find the row is 0 with `stub_zeros`,
    else null. Both sides hold `limit` rows at most before they meet.
    """
    if not phash and not dhash:
        raise ValueError("give phash, dhash or both")
    by_p = search_hash(ledger, "phash", phash or "", account, limit, max_distance)
    by_d = search_hash(ledger, "dhash", dhash or "", account, limit, max_distance)
    p_hits = by_p.select("asset_id", F.col("distance").alias("phash_distance"))
    d_hits = by_d.select("asset_id", F.col("distance").alias("dhash_distance"))
    merged = p_hits.join(d_hits, "asset_id", "full").withColumn(
        "source_rank", F.when(F.col("phash_distance").isNotNull(), 0).otherwise(1)
    )
    kept = merged.orderBy(
        "source_rank",
        F.coalesce("phash_distance", "dhash_distance"),
        "asset_id",
    ).limit(limit)
    stub = F.lit(0 if stub_zeros else None).cast("int")
    distances = F.struct(
        F.coalesce("phash_distance", stub).alias("phash"),
        F.coalesce("dhash_distance", stub).alias("dhash"),
        stub.alias("ahash"),
        stub.alias("whash"),
    )
    return (
        ledger.join(F.broadcast(kept), "asset_id")  # `limit` rows
        .withColumn("perceptual_distance", distances)
        .withColumn("payload_match", F.lit(False))
        .orderBy(
            "source_rank", F.coalesce("phash_distance", "dhash_distance"), "asset_id"
        )
        .drop("phash_distance", "dhash_distance")
    )


# --- a table of queries --------------------------------------------------------------
#
# Multi-index hashing (Norouzi, Punjani, Fleet, CVPR 2012) with general pigeonhole
# thresholds (Qin et al., ICDE 2018). The word is cut into parts. Two hashes at
# distance <= d differ in at most t_i bits in some part i as long as the t_i + 1 add
# up to d + 1. So the query side lists the keys within t_i bits of each of its parts,
# and an equi-join on (part, key) finds every pair.


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


def _cut(low: int, high: int, pieces: int) -> list[tuple[int, int]]:
    marks = [low + (high - low) * n // pieces for n in range(pieces + 1)]
    return list(zip(marks, marks[1:]))


def _tolerances(pieces: int, distance: int) -> list[int]:
    share, rest = divmod(distance + 1, pieces)
    return [share - 1 + (n < rest) for n in range(pieces)]


def _ball_size(width: int, radius: int) -> int:
    return sum(math.comb(width, r) for r in range(min(radius, width) + 1))


@dataclass(frozen=True)
class _Slice:
    """Bits low..high of the word, to be met within `tolerance` bits."""

    low: int
    high: int
    tolerance: int

    @property
    def mask(self) -> int:
        return _signed(((1 << (self.high - self.low)) - 1) << self.low)

    def differences(self) -> list[int]:
        bits = range(self.low, self.high)
        top = min(self.tolerance, self.high - self.low)
        return [
            _signed(sum(1 << b for b in chosen))
            for r in range(top + 1)
            for chosen in combinations(bits, r)
        ]

    def met(self, difference: Column) -> Column:
        return F.bit_count(difference.bitwiseAND(F.lit(self.mask))) <= self.tolerance


def _slices(bounds: list[tuple[int, int]], distance: int) -> list[_Slice]:
    return [
        _Slice(low, high, t)
        for (low, high), t in zip(bounds, _tolerances(len(bounds), distance))
        if t >= 0
    ]


def choose_parts(target_rows: int, distance: int) -> int:
    """Number of parts with the least work per query for evenly spread hashes.

    A key around a query costs as much as some 5 comparisons of words. One part is
    comparison with every word, for wide radii.
    """

    def work(parts: int) -> float:
        cost = 0.0
        for s in _slices(_cut(0, HASH_BITS, parts), distance):
            width = min(KEY_BITS, s.high - s.low)
            ball = _ball_size(width, s.tolerance)
            cost += ball * (PROBE_COST + target_rows / 2**width)
        return cost

    return min((1, 3, 4, 5, 6, 7, 8, 10, 12, 16), key=work)


def chance_radius(rows: int, hits: float) -> int:
    """Radius within which chance alone brings `hits` of `rows` evenly spread hashes to a query."""
    return next((r for r in range(HASH_BITS) if rows * _ball_size(HASH_BITS, r) >= hits * 2**HASH_BITS), HASH_BITS)


def _entries(slices: list[_Slice], flipped: bool) -> list[dict[str, int]]:
    return [
        {"p": n, "mask": s.mask, "flip": f}
        for n, s in enumerate(slices)
        for f in (s.differences() if flipped else [0])
    ]


def _exploded(rows: DataFrame, word: str, entries: Column, tag: str = "") -> DataFrame:
    """One row per entry, with the entry's bits of `word`, some of them flipped."""
    bits = F.col(word).bitwiseAND(F.col("mask")).bitwiseXOR(F.col("flip"))
    return rows.select(*rows.columns, F.inline(entries)).select(
        *rows.columns, F.col("p").alias(f"part{tag}"), bits.alias(f"key{tag}")
    )


def part_keys(rows: DataFrame, word: str, parts: int) -> DataFrame:
    """Each row once for each of `parts` parts of `word`, with `part` and `key`.

    The keys serve every radius: a smaller one looks at the first parts only.
    """
    slices = [_Slice(low, high, 0) for low, high in _cut(0, HASH_BITS, parts)]
    return _exploded(rows, word, _literal(_entries(slices, flipped=False)))


def hot_limit(target_rows: int, hot_rows: int | None = None) -> int:
    """Rows of a key beyond which it is hot; the floor keeps the list of hot keys, which
    is broadcast, to a few thousand."""
    return max(hot_rows or 4096, target_rows // 1024)


def _literal(entries: list, depth: int = 1) -> Column:
    """Entries as one folded literal, so that loops over them are generated code."""
    kind = "struct<p int, mask bigint, flip bigint>"
    for _ in range(depth):
        kind = f"array<{kind}>"
    return F.from_json(F.lit(json.dumps(entries)), kind)


def _first_met(slices: list[_Slice], difference: Column) -> Column:
    choice = F.lit(None).cast("int")
    for number, s in reversed(list(enumerate(slices))):
        choice = F.when(s.met(difference), number).otherwise(choice)
    return choice


def hash_pairs(
    queries: DataFrame,
    targets: DataFrame | None,
    max_distance: int,
    target_rows: int | None = None,
    hot_rows: int | None = None,
    parts: int | None = None,
    postings: DataFrame | None = None,
    hot: DataFrame | None = None,
    top: int | None = None,
    counted: bool = False,
    keep: Keep | None = None,
) -> DataFrame:
    """All (q, t, distance) with distance <= max_distance; no pair twice.

    Takes tables with one bigint column, `q` and `t`, of distinct hashes. Stored
    `postings` (part, key, t) of as many `parts`, with their `hot` keys, take the place of the targets,
    which are then not read. Pairs meet in cells (`cells.py`), packed and without a row for each probe.
    With `top` most pairs that are not among a query's nearest `top` are left out; ties stay. With
    `keep` so are most pairs that it does not keep.

    Part keys that very many targets share (flat images, one busy source) are
    looked up by a second part as well, so such a group is never compared as a
    whole; nothing is dropped for it. A pair that several parts would find is
    kept by the first of them only, which takes the place of a distinct.
    """
    if postings is None:
        if target_rows is None:
            target_rows = targets.count()
        parts = parts or choose_parts(target_rows, max_distance)
        hot_rows = hot_limit(target_rows, hot_rows)
    bounds = _cut(0, HASH_BITS, parts)
    outer = _slices(bounds, max_distance)
    difference = F.col("q").bitwiseXOR(F.col("t"))
    distance = F.bit_count(difference)

    if postings is None:
        index = _exploded(targets, "t", _literal(_entries(outer, flipped=False)))
    else:
        target_rows = postings.filter("part = 0").count()
        index = postings.filter(F.col("part") < len(outer)).select("t", "part", "key")

    def in_cells(index: DataFrame) -> DataFrame:
        slices = [(s.low, s.high, s.tolerance) for s in outer]
        return cell_pairs(queries, index, slices, max_distance, target_rows, top, counted, keep)

    def met(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        # Merge join: the planner does not see how far a literal list multiplies
        # rows, and would broadcast a side that looks small before it is.
        near = (distance <= max_distance) & (
            F.col("part") == _first_met(outer, difference)
        )
        return (
            left.join(right.hint("merge"), keys)
            .filter(near)
            .select("q", "t", distance.alias("distance"))
        )

    keys, meet = ["part", "key"], in_cells
    if postings is not None:
        balls = [(s.high - s.low, _ball_size(s.high - s.low, s.tolerance)) for s in outer]
        each = sum(ball * (1 + target_rows / 2**width) for width, ball in balls)
        if queries.count() * each <= FEW_MET:
            # a handful of queries: the index is joined by its buckets, without a shuffle
            meet = partial(met, _exploded(queries, "q", _literal(_entries(outer, flipped=True))), keys=keys)
    if parts == 1 or (postings is not None and hot is None) or (postings is None and target_rows <= hot_rows):
        return meet(index)

    # At most target_rows / hot_rows keys per part can be hot, so this table has a
    # few thousand rows whatever the data.
    if hot is None:
        hot = index.groupBy(keys).count().filter(F.col("count") > hot_rows).select(keys)
        hot = checkpointed(hot)
        if hot.isEmpty():
            return meet(index)
    hot = F.broadcast(hot)
    probes = _exploded(dealt(queries), "q", _literal(_entries(outer, flipped=True)))
    finer = math.ceil(3 / (parts - 1))
    inner = [
        _slices(
            [
                piece
                for b in bounds
                if b != (s.low, s.high)
                for piece in _cut(*b, min(finer, b[1] - b[0]))
            ],
            max_distance,
        )
        for s in outer
    ]

    def finer_entries(flipped: bool) -> Column:
        every = _literal([_entries(slices, flipped) for slices in inner], depth=2)
        return F.get(every, F.col("part"))

    hot_index = _exploded(
        index.join(hot, keys, "left_semi"), "t", finer_entries(False), "2"
    )
    hot_probes = _exploded(
        probes.join(hot, keys, "left_semi"), "q", finer_entries(True), "2"
    )
    cold = meet(index.join(hot, keys, "left_anti"))
    within = met(hot_probes, hot_index, [*keys, "part2", "key2"]).distinct()
    return cold.unionByName(within)


def nearest_of_each(pairs: DataFrame, top: int) -> DataFrame:
    """The pairs of each `q` that are as near as its nearest `top`, ties included."""
    rank = F.rank().over(Window.partitionBy("q").orderBy("distance"))
    return pairs.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def nearest_pairs(
    queries: DataFrame, targets: DataFrame, max_distance: int, top: int, target_rows: int, **tuning: int
) -> DataFrame:
    """The pairs of `hash_pairs` that are as near as a query's nearest `top`, ties included.

    In a large table chance brings more and more hashes within a wide radius. So a round looks
    within the radius where chance alone finds a few more than `top`; a query that has as many is
    settled, as what lies further away is no nearer, and only the others go on to the whole radius.
    """
    narrow = chance_radius(target_rows, 2 * top)
    if narrow >= max_distance:
        return nearest_of_each(hash_pairs(queries, targets, max_distance, target_rows, top=top, **tuning), top)
    queries, targets = checkpointed(queries), checkpointed(targets)
    near = checkpointed(nearest_of_each(hash_pairs(queries, targets, narrow, target_rows, top=top, **tuning), top))
    settled = checkpointed(near.groupBy("q").count().filter(F.col("count") >= top).select("q"))
    others = checkpointed(queries.join(settled, "q", "left_anti"))
    wide = nearest_of_each(hash_pairs(others, targets, max_distance, target_rows, top=top, **tuning), top)
    return near.join(settled, "q", "left_semi").unionByName(wide)


def _distinct_hashes(table: DataFrame, column: str, name: str) -> DataFrame:
    return (
        table.select(hash64(table, column).alias(name))
        .filter(F.col(name).isNotNull())
        .distinct()
    )


def radius_join(
    queries: DataFrame,
    ledger: DataFrame,
    column: str = "phash",
    max_distance: int = 10,
    top: int | None = None,
    **tuning: int,
) -> DataFrame:
    """All (query_id, asset_id, distance) within the radius.

    Queries carry `query_id`, the hash, and optionally `account_id`, which then
    limits the query to that account. Copies meet once, as hashes; rows come
    back by equi-joins on the hash. For callers who keep the nearest `top` of a query
    alone, rows of hashes that can not be among them may be left out.
    """
    scoped = "account_id" in queries.columns
    tuning.setdefault("target_rows", ledger.count())  # row counts are in the footers
    hashes = _distinct_hashes(queries, column, "q"), _distinct_hashes(ledger, column, "t")
    if top and not scoped:  # an account's nearest may be anywhere
        pairs = nearest_pairs(*hashes, max_distance, top, **tuning)
    else:
        pairs = hash_pairs(*hashes, max_distance, **tuning)
    wanted = [F.col("account_id").alias("_account")] if scoped else []
    q_rows = queries.select(
        F.col("query_id"), hash64(queries, column).alias("q"), *wanted
    )
    held = [F.col("account_id").alias("_held")] if scoped else []
    t_rows = ledger.select("asset_id", hash64(ledger, column).alias("t"), *held)
    rows = pairs.hint("merge").join(q_rows, "q").join(t_rows.hint("merge"), "t")
    if scoped:
        rows = rows.filter(
            F.col("_account").isNull() | (F.col("_account") == F.col("_held"))
        )
    return rows.select("query_id", "asset_id", "distance")


def radius_join_indexed(
    queries: DataFrame, index: MatchIndex, column: str = "phash", max_distance: int = 10
) -> DataFrame:
    """`radius_join` from the stored index: no column of the ledger is read; of the index
    eight bytes for each posting and share of a cell are shuffled."""
    pairs = indexed_pairs(
        _distinct_hashes(queries, column, "q"), index, column, max_distance
    )
    scoped = "account_id" in queries.columns
    wanted = [F.col("account_id").alias("_account")] if scoped else []
    q_rows = queries.select("query_id", hash64(queries, column).alias("q"), *wanted)
    rows = pairs.join(q_rows, "q").join(index.assets(column).hint("merge"), "t")
    if scoped:
        rows = rows.filter(
            F.col("_account").isNull() | (F.col("_account") == F.col("account_id"))
        )
    return rows.select("query_id", "asset_id", "distance")


def indexed_pairs(
    hashes: DataFrame, index: MatchIndex, column: str, max_distance: int
) -> DataFrame:
    """`hash_pairs` of distinct hashes `q` with those of the index."""
    return hash_pairs(
        hashes,
        None,
        max_distance,
        parts=index.parts,
        postings=index.words(column),
        hot=index.hot(column),
    )


def search_batch(
    queries: DataFrame,
    ledger: DataFrame,
    column: str = "phash",
    limit: int = SEARCH_LIMIT,
    max_distance: int = 10,
    **tuning: int,
) -> DataFrame:
    """`search_hash` for a table of queries: the nearest `limit` rows of each.

    The rank filter becomes a group limit before the shuffle, so a query with
    very many hits sends `limit` rows per task at most.
    """
    hits = radius_join(queries, ledger, column, max_distance, limit, **tuning)
    order = Window.partitionBy("query_id").orderBy("distance", "asset_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= limit
    )


def _gram_ranks(texts: DataFrame, text: str) -> DataFrame:
    """(gram, rank): the grams of distinct hex texts, rare ones first.

    Grams of hex digits and blanks: 17^3 at most, whatever the table.
    """
    counts = texts.select(F.explode(trigrams(text)).alias("gram")).groupBy("gram").count()
    order = Window.orderBy("count", "gram")
    return counts.select("gram", F.row_number().over(order).alias("rank"))


def _gram_prefixes(texts: DataFrame, text: str, ranks: DataFrame, threshold: float, tag: str) -> DataFrame:
    """Each text with its number of grams and the ranks of its rarest ones, one row for each.

    Two texts of similarity t or more share a gram among the rarest n - ceil(t n) + 1 of
    each (Chaudhuri, Ganti, Kaushik, ICDE 2006). Grams that no target has get rank 0.
    """
    grams = texts.select(text, F.explode(trigrams(text)).alias("gram")).join(F.broadcast(ranks), "gram", "left")
    ranked = grams.groupBy(text).agg(F.sort_array(F.collect_list(F.coalesce("rank", F.lit(0)))).alias("ranks"))
    size = F.size("ranks")
    kept = size - F.ceil(size * threshold - 1e-9).cast("int") + 1
    return ranked.select(
        text, size.alias(f"size{tag}"), F.col("ranks").alias(f"ranks{tag}"), F.slice("ranks", F.lit(1), kept).alias(f"prefix{tag}")
    ).select("*", F.explode(F.array_distinct(f"prefix{tag}")).alias("rank"))


def trigram_pairs(
    queries: DataFrame,
    targets: DataFrame,
    threshold: float = TRIGRAM_THRESHOLD,
    max_distance: int | None = None,
) -> DataFrame:
    """All (q, t) of distinct lower-case hex texts with that trigram similarity or more.

    A set-similarity join: inverted lists of the rarest grams, sizes that can reach the
    threshold, then the similarity itself. A pair that several grams bring together is
    kept by the first, which takes the place of a distinct. With `max_distance` pairs of
    64-bit words that are further apart are left out before their grams are compared.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a similarity threshold lies above 0 and up to 1")
    ranks = checkpointed(_gram_ranks(targets, "t"))
    left = _gram_prefixes(queries, "q", ranks, threshold, "_q").filter("rank > 0")
    right = _gram_prefixes(targets, "t", ranks, threshold, "_t")
    fits = F.least("size_q", "size_t") >= F.greatest("size_q", "size_t") * threshold - 1e-9
    first = F.get(F.array_intersect("prefix_q", "prefix_t"), F.lit(0))
    # shared grams by rank: comparing the texts here would cut them into grams for every candidate
    shared = F.size(F.array_intersect("ranks_q", "ranks_t"))
    alike = shared * (1 + threshold) >= (F.col("size_q") + F.col("size_t")) * threshold - 1e-9
    if max_distance is not None:
        left = left.withColumn("q64", _word("q"))
        right = right.withColumn("t64", _word("t"))
        fits = fits & F.coalesce(hamming64("q64", "t64") <= max_distance, F.lit(True))
    # an explicit number of tasks: rows that look few grow into many comparisons
    tasks = task_count(queries.sparkSession)
    return (
        left.repartition(tasks, "rank")
        .join(right.repartition(tasks, "rank").hint("merge"), "rank")
        .filter(fits & (first == F.col("rank")) & alike)
        .select("q", "t")
    )


def _word(text: str) -> Column:
    """The bigint of a text of 16 hex digits."""
    return F.when(F.length(text) == HASH_BITS // 4, hex_to_i64(text))


def _near_words(queries: DataFrame, targets: DataFrame, threshold: float, max_distance: int, rows: int) -> DataFrame:
    """(q, t, distance) of texts of 16 hex digits within a radius and alike: far fewer lie
    within the radius than share a rare gram."""
    q_words = queries.select(_word("q").alias("q")).filter("q IS NOT NULL")
    t_words = targets.select(_word("t").alias("t")).filter("t IS NOT NULL")
    # the kernel drops nearly all pairs, which are within the radius by chance
    keep = partial(alike, threshold=threshold)
    texts = hash_pairs(q_words, t_words, max_distance, rows, keep=keep).select(
        *[F.lower(i64_to_hex(n)).alias(n) for n in "qt"], F.col("distance").cast("int").alias("distance")
    )
    return texts.filter(trigram_similarity(F.col("q"), F.col("t")) >= threshold - 1e-9)


def search_trigram_batch(
    queries: DataFrame,
    ledger: DataFrame,
    column: str = "phash",
    limit: int = SEARCH_LIMIT,
    max_distance: int = BY_COLUMN,
    threshold: float = TRIGRAM_THRESHOLD,
) -> DataFrame:
    """`search_trigram` for a table of queries: the nearest `limit` rows of each that look alike.

    Queries carry `query_id`, the hash, and optionally `account_id`, which then limits the
    query to that account. Texts that are no hex match nothing; copies of a text meet once.
    """
    if max_distance == BY_COLUMN:
        max_distance = SEARCH_MAX_DISTANCE.get(column, 10)
    scoped = "account_id" in queries.columns
    wanted = [F.col("account_id").alias("_account")] if scoped else []
    held = [F.col("account_id").alias("_held")] if scoped else []
    q_rows = queries.select("query_id", F.lower(hash_text(queries, column)).alias("q"), *wanted).filter(is_hex("q"))
    t_rows = ledger.select("asset_id", F.lower(hash_text(ledger, column)).alias("t"), *held).filter(is_hex("t"))
    q_texts, t_texts = q_rows.select("q").distinct(), t_rows.select("t").distinct()
    if max_distance < HASH_BITS:
        near = _near_words(q_texts, t_texts, threshold, max_distance, ledger.count())
        # a word and a text of another length are 64 bits apart at least
        q_texts, t_texts = (x.filter(_word(n).isNull()) for x, n in ((q_texts, "q"), (t_texts, "t")))
    pairs = trigram_pairs(q_texts, t_texts, threshold, max_distance)
    distance = F.coalesce(hamming64(_word("q"), _word("t")), hamming_hex("q", "t"))
    odd = pairs.withColumn("distance", distance).filter(F.col("distance") <= max_distance)
    near = near.unionByName(odd) if max_distance < HASH_BITS else odd
    rows = near.join(q_rows, "q").join(t_rows, "t")
    if scoped:
        rows = rows.filter(F.col("_account").isNull() | (F.col("_account") == F.col("_held")))
    order = Window.partitionBy("query_id").orderBy("distance", "asset_id")
    ranked = rows.select("query_id", "asset_id", "distance").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit)


def nearest_match(
    queries: DataFrame,
    candidates: DataFrame,
    column: str = "phash",
    threshold: int = 10,
    hot_rows: int | None = None,
    met: list[int] | None = None,
) -> DataFrame:
    """(query_id, match_idx, distance) of the nearest candidate, lowest idx on ties.

    Beyond the threshold the index is null and the distance stays. The search goes round by
    round, each with a wider radius. A round meets every candidate within its radius, so a
    query that it finds one for is settled and leaves; the last round compares what is left
    with every candidate. The number of candidates that each round compared with a query is
    added to `met`, if a list is given.
    """
    by_hash = checkpointed(
        candidates.groupBy(hash64(candidates, column).alias("t"))
        .agg(F.min("idx").alias("idx"))
        .filter("t IS NOT NULL")
    )
    keyed = queries.select("query_id", hash64(queries, column).alias("q"))
    found = keyed.filter("q IS NOT NULL").join(
        _nearest(keyed.select("q").distinct(), by_hash, hot_rows, met), "q", "left"
    )
    # hashes that cannot be read match nothing
    rows = found.select("query_id", "best").unionByName(
        keyed.filter("q IS NULL").select("query_id", F.lit(None).cast("struct<distance int, idx bigint>").alias("best"))
    )
    return rows.select(
        "query_id",
        F.when(F.col("best.distance") <= threshold, F.col("best.idx")).alias("match_idx"),
        F.coalesce("best.distance", F.lit(NO_DISTANCE)).alias("distance"),
    )


def _nearest(
    hashes: DataFrame, by_hash: DataFrame, hot_rows: int | None, met: list[int] | None
) -> DataFrame:
    """(q, best) with best the least (distance, idx)."""
    size = by_hash.count()
    nothing = F.lit(None).cast("struct<distance int, idx bigint>")
    open_ = checkpointed(hashes.filter("q IS NOT NULL").select("q", nothing.alias("best")))
    settled = open_.limit(0)
    rounds = {*ROUNDS, chance_radius(size, 8)} if size >= MANY_ROWS else ROUNDS
    for radius in sorted(rounds) if size else []:
        parts = ROUND_PARTS if radius < HASH_BITS else 1
        pairs = hash_pairs(
            open_.select("q"), by_hash.select("t"), radius, size, hot_rows, parts, top=1, counted=met is not None
        )
        seen = Observation()
        if met is not None:
            pairs = pairs.observe(seen, F.sum(F.when(F.col("q").isNull(), F.col("t")).otherwise(0)).alias("n"))
        near = nearest_of_each(pairs.filter("q IS NOT NULL"), 1)
        best = F.min(F.struct("distance", F.col("idx").cast("bigint").alias("idx"))).alias("fresh")
        fresh = near.hint("merge").join(by_hash.hint("merge"), "t").groupBy("q").agg(best)
        # what this round has met is the nearest, as it lies within the round's radius
        looked = checkpointed(open_.select("q").join(fresh, "q", "left").select("q", F.col("fresh").alias("best")))
        if met is not None:
            met.append(seen.get["n"] or 0)
        settled = settled.unionByName(looked.filter("best IS NOT NULL"))
        open_ = looked.filter("best IS NULL")
        if open_.isEmpty():
            break
    return settled
