"""Mixing sources to target weights by Sainte-Lague apportionment, all in the JVM.

Targets: sources in code-point order (null last) get the weights in turn and share ``share``
times all words; a target stops at ``most`` times its source's words, and what is over is shared
again by weight.

Each source is dealt by a seeded hash of id and text into shards of bounded size. The documents of a shard
lie end to end in seeded order and are cut into blocks of ``block`` words. The mix holds a whole
number of blocks: they are given to sources, and then to the shards of a source, by the
highest quotients weight / (2 k - 1). Of a shard's blocks a seeded permutation takes as many
as its quota says, every block at most ``most`` times. Blocks are never made into rows: a
document computes from its place which of its blocks are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossaleaf.llm.common import WHITE, WORD, packed, whole
from glossaleaf.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD_WORDS = 1 << 20

# fixed values: primes above any number of blocks in a shard, so that they divide none
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)


def _hash(parts: list[Column | str], seed: int, start: int = 1) -> Column:
    """60 bits of a seeded digest; SQL engines agree on it."""
    named = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *named))
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, place, source_size, n_rows, target) from rows (source, size).

    Filling by weight to a common level: taken in the order of limit over weight, a source is
    at its limit if that ratio is below the level that the others would then reach. Works on one
    row per source.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("place", F.row_number().over(by_name)).withColumns(
        {
            "weight": F.get(turn, F.pmod(F.col("place") - 1, F.lit(len(weights)))),
            "limit": F.col("source_size") * F.lit(float(most)),
        }
    )
    order = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    everything = Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    filled = ranked.withColumn("level", (total - before) / left)
    reached = F.min(F.when(F.col("limit") / F.col("weight") >= F.col("level"), F.struct(F.col("limit") / F.col("weight"), "place", "level"))).over(everything)
    level = filled.withColumn("common", reached["level"])
    return level.select(
        "source",
        "place",
        "source_size",
        "n_rows",
        F.least("limit", F.coalesce(F.col("common") * F.col("weight"), F.col("limit"))).alias("target"),
    )


def apportion(parties: DataFrame, group: list[str], name: str, weight: str, seats: str) -> DataFrame:
    """Adds ``quota``: the group's seats by the highest quotients weight / (2 k - 1).

    With n parties, the seats that a divisor for n seats fewer gives are certain, and those
    beyond a divisor for n seats more are not reached; only the 3 n or so between are ranked.
    Ties go to the smaller ``name``.
    """
    whole_group = Window.partitionBy(*group)
    sums = parties.withColumns(
        {"_n": F.count("*").over(whole_group), "_all": F.sum(weight).over(whole_group).cast("double")}
    )

    def at(total: Column) -> Column:
        given = F.floor(F.col(weight) * total / F.col("_all") + F.lit(0.5))
        return F.when((F.col("_all") > 0) & (total > 0), given).otherwise(F.lit(0))

    bounds = sums.withColumns({"_sure": at(F.col(seats) - F.col("_n")), "_may": at(F.col(seats) + F.col("_n"))})
    key = [*group, name]
    contested = bounds.filter("_may > _sure").select(
        *key,
        weight,
        F.explode(F.sequence(F.col("_sure") + 1, F.col("_may"))).alias("_k"),
    )
    quotient = F.col(weight) / (2 * F.col("_k") - 1)
    ranked = contested.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), name, "_k")))
    open_seats = bounds.groupBy(*group).agg((F.max(seats) - F.sum("_sure")).alias("_open"))
    won = ranked.join(open_seats, group).filter(F.col("_rank") <= F.col("_open")).groupBy(*key).agg(F.count("*").alias("_won"))
    out = bounds.join(won, key, "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.drop("_n", "_all", "_sure", "_may", "_won")


def _placed(rows: DataFrame, sizes: DataFrame, weights: tuple, share: float, most: int, block: int, shard_words: int, seed: int) -> DataFrame:
    """Rows (doc_id, source, size, digest, ...) with their source's figures, their first word's place in
    their shard (``first_word``) and how often each block they touch is taken (``takes``).
    ``sizes`` has the first four columns of the same rows."""
    target = targets(sizes.select("source", "size"), weights, share, most)
    # empty texts count as a word here, so that they cannot crowd one shard
    shards = F.ceil((F.col("source_size") + F.col("n_rows")) / F.lit(shard_words))
    sources = target.withColumn("n_shards", F.greatest(shards, F.lit(1)))
    named = sources.withColumnRenamed("source", "its_source")
    placed = rows.join(named, rows["source"].eqNullSafe(named["its_source"])).drop("its_source")
    # by id and text: many rows may share an id, or have none
    row = ["doc_id", "digest"]
    placed = placed.withColumn("shard", F.pmod(_hash(row, seed), F.col("n_shards")))
    in_shard = Window.partitionBy("place", "shard")
    before = in_shard.orderBy(_hash(row, seed, 16), "doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("first_word", F.coalesce(F.sum("size").over(before), F.lit(0)))

    total = Window.partitionBy(F.lit(1))
    seats = F.floor(F.sum("target").over(total) / block + F.lit(0.5))
    # all sources are one group, named by the seats they share
    shared = sources.withColumn("seats", seats).withColumn("mix", F.col("seats"))
    by_source = apportion(shared, ["mix"], "place", "target", "seats")
    # the shards' words, by the same rule that deals out the rows
    dealt = sizes.join(named, sizes["source"].eqNullSafe(named["its_source"])).select(
        "place", "size", F.pmod(_hash(row, seed), F.col("n_shards")).alias("shard")
    )
    sums = dealt.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"))
    parties = sums.join(by_source.select("place", F.col("quota").alias("seats")), "place")
    quotas = apportion(parties, ["place"], "shard", "shard_size", "seats")
    quotas = quotas.withColumn("n_blocks", F.ceil(F.col("shard_size") / F.lit(block)))
    quotas = quotas.withColumn("quota", F.least("quota", F.col("n_blocks") * most))
    pick = _hash([F.lit("blocks"), "place", "shard"], seed)
    quotas = quotas.select(
        "place",
        "shard",
        "n_blocks",
        F.expr("quota div greatest(n_blocks, 1)").alias("rounds"),
        F.pmod("quota", F.greatest("n_blocks", F.lit(1))).alias("extra"),
        F.get(F.array(*[F.lit(p).cast("long") for p in PRIMES]), F.pmod(pick, F.lit(len(PRIMES))).cast("int")).alias("step"),
        F.pmod(pick, F.greatest("n_blocks", F.lit(1))).alias("offset"),
    )
    joined = placed.join(quotas, ["place", "shard"])

    def taken(b: Column) -> Column:
        return F.col("rounds") + (F.pmod(b * F.col("step") + F.col("offset"), F.col("n_blocks")) < F.col("extra")).cast("long")

    last = F.floor((F.col("first_word") + F.col("size") - 1) / block)
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first_word") / block), last))
    return joined.withColumn("takes", F.transform(F.coalesce(blocks, F.array().cast("array<long>")), taken))


def _size(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _sizes(docs: DataFrame, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, digest) of every row, counted once and written: it has three readers."""
    rows = docs.select(
        "doc_id", F.col(source).cast("string").alias("source"), _size(whole(text)).alias("size"), F.md5(whole(text)).alias("digest")
    )
    return materialize(rows, "sizes")


def mark(
    docs: DataFrame, text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE,
    most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 0,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    ``taken`` counts the words that the mix takes of it, repeats included. A null text has no
    words; a null source is a source of its own, the last in order. Rows alike in
    doc_id, source and text are interchangeable and share a shard. Other columns of ``docs`` are left out. An empty
    table gives no rows; a very long text is several blocks, of which some may be taken.
    """
    sizes = _sizes(docs, text, source)
    placed = _placed(sizes, sizes, weights, share, most, block, shard_words, seed)
    first, last = F.col("first_word"), F.col("first_word") + F.col("size")
    start = F.floor(first / block)

    def words(n: Column, i: Column) -> Column:
        begin = (start + i) * block
        return n * (F.least(last, begin + block) - F.greatest(first, begin))

    counted = F.aggregate(F.transform("takes", words), F.lit(0).cast("long"), lambda a, n: a + n)
    return placed.select("doc_id", "size", "source_size", "target", counted.alias("taken"))


def mixed_rows(
    docs: DataFrame, text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE,
    most: int = MOST, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = 0,
) -> DataFrame:
    """The rows of the mix, with all columns of ``docs``: a document comes once for each time
    that blocks of it are taken, its text cut to the words of those blocks (whole if all are).
    """
    rows = docs.select(
        packed(docs).alias("row"), "doc_id", F.col(source).cast("string").alias("source"), _size(whole(text)).alias("size"),
        F.md5(whole(text)).alias("digest"),
    )
    placed = _placed(rows, _sizes(docs, text, source), weights, share, most, block, shard_words, seed)
    copies = placed.select(
        "row", "first_word", "takes", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("nth")
    ).filter(F.exists("takes", lambda n: n >= F.col("nth")))
    content = F.col("row")[text]
    pieces = F.regexp_extract_all(content, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    start = F.floor(F.col("first_word") / block)

    def has(_: Column, i: Column) -> Column:
        at = F.floor((F.col("first_word") + i) / block) - start
        return F.get("takes", at.cast("int")) >= F.col("nth")

    cut = F.ltrim(F.array_join(F.filter(pieces, has), ""), F.lit(WHITE))
    wanted = F.when(F.forall("takes", lambda n: n >= F.col("nth")), content).otherwise(cut)
    return copies.select(F.col("row").withField(text, wanted).alias("row")).select("row.*")
