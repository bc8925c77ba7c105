"""Mixing sources to target weights by drawing fixed-length blocks.

1. Every source's documents are laid end to end in a pseudorandom order and cut
   into blocks of ``block`` words (the last may be shorter).
2. Targets: sources in code-point order weigh 1, 2, 3, 1, ...; they share all
   words by weight, none above ``most`` times its own size (water filling).  A
   source needs a whole number of passes over its blocks plus a part of one
   more pass.
3. Each output shard draws its slots' sources from the multinomial of these
   needs; the counts per shard and source are all that is kept of the draw.
   Slots that a source drew beyond its need go to sources that fell short, so
   every need is met exactly.
4. The n-th slot of a source maps to a block through a swap-or-not permutation
   of the block numbers, keyed by source and pass, and blocks are joined to
   documents by number.

No step collects a source into one task: prefix sums run in two levels over
hashed buckets.  Everything is a built-in DataFrame operation, and the order
depends on ids and sizes alone, so reruns agree.

Defined results: null text has size 0 and is never taken; null sources form one
source, last in order; null ids are allowed; identical rows are laid one after
the other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillspan.llm.rows import columns_of, numbered
from rillspan.llm.work import Work

WORD = r"[^\x20\x09-\x0D]+"
ROUNDS = 24
GRID = 4096


def water_fill(sources: DataFrame, most: float) -> DataFrame:
    """Add ``target``: shares of all words by ``weight``, none above ``most`` times ``source_size``.

    Ordered by cap over weight, a source is capped as long as its cap is within
    what the level of the rest would give it.
    """
    cap = F.col("source_size") * F.lit(float(most))
    total = F.sum("source_size").over(Window.partitionBy())
    order = Window.orderBy(cap / F.col("weight"), "source_no")
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    leveled = sources.withColumn("_level", (total - before) / rest)
    level = F.max(F.when(cap > F.col("_level") * F.col("weight"), F.col("_level"))).over(Window.partitionBy())
    return leveled.withColumn("_level", level).withColumn(
        "target", F.least(cap, F.coalesce(F.col("_level") * F.col("weight"), cap))
    ).drop("_level")


def permuted(x: Column, n: Column, source: Column, turn: Column, seed: int, back: bool = False) -> Column:
    """Swap-or-not permutation of 0..n-1; ``back`` inverts it."""
    rounds = list(range(ROUNDS))[:: -1 if back else 1]

    def swap(at: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(F.lit(seed), source, turn, r), n)
        other = F.pmod(key - at, n)
        coin = F.xxhash64(F.lit(seed + 1), source, turn, r, F.greatest(at, other))
        return F.when(coin.bitwiseAND(F.lit(1)) == 1, other).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, rounds)), x.cast("long"), swap)


class Mix:
    """The mix of a table: ``documents()``, ``slots`` (the drawn shards) and ``parts()``."""

    def __init__(
        self,
        df: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        source_col: str = "source",
        row_col: str | None = None,
        block: int = 1024,
        most: int = 3,
        shard_slots: int = 4096,
        bucket_rows: int = 2_000,
        broadcast_rows: int = 50_000,
        seed: int = 20240,
    ):
        self.block, self.seed, self.most, self.bucket_rows = block, seed, most, bucket_rows
        spark = df.sparkSession
        self.work = work = Work(spark, "mixing")
        row = F.col(row_col) if row_col else F.monotonically_increasing_id()
        sized = work.save(
            df.select(
                row.cast("long").alias("row"),
                F.col(id_col).alias("id"),
                F.col(source_col).alias("source"),
                F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            ),
            "sized",
        )
        grouped = sized.groupBy("source").agg(
            F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("filled")
        )
        no = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        numbered = grouped.withColumn("source_no", no).withColumn("weight", F.col("source_no") % 3 + 1)
        size, target = F.col("source_size"), F.col("target")
        want = F.least(F.round(target).cast("long"), size * most)
        n_blocks = F.ceil(size / block).cast("long")
        rest = F.col("want") - F.col("passes") * size
        sources = (
            water_fill(numbered, most)
            .withColumn("want", want)
            .withColumn("n_blocks", n_blocks)
            .withColumn("passes", F.when(size > 0, F.floor(F.col("want") / size)).otherwise(F.lit(0)).cast("long"))
            .withColumn("rest", rest)
            .withColumn("n_slots", F.col("passes") * F.col("n_blocks") + F.when(F.col("rest") > 0, F.least(F.col("n_blocks"), F.ceil(F.col("rest") / block) + 1)).otherwise(F.lit(0)))
            .withColumn("short_at", F.when(F.col("n_blocks") > 0, permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.col("source_no"), F.col("passes"), seed, back=True)))
            .withColumn("short", F.col("n_blocks") * block - size)
            .withColumn("buckets", F.ceil(F.col("filled") / bucket_rows).cast("long"))
        )
        self.sources = work.save(sources, "sources")
        count, slots, self.rows = self.sources.agg(F.count("*"), F.coalesce(F.sum("n_slots"), F.lit(0)), F.coalesce(F.sum("filled"), F.lit(0))).first()
        self._small = F.broadcast if count <= broadcast_rows else (lambda x: x)
        self.docs = self._laid(sized)
        self.slots = self._drawn(slots, shard_slots)

    def _laid(self, sized: DataFrame) -> DataFrame:
        """Documents with words, each at its ``start`` in its source's line."""
        known = self._small(self.sources.withColumnRenamed("source", "_source"))
        docs = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        self.empty = docs.filter("size = 0")
        # an id that very many rows have (null, say) is spread by row number; no other makes a bucket large
        limit = max(self.bucket_rows, -(-self.rows // self.bucket_rows))
        often = sized.groupBy(F.col("source").alias("_of"), F.col("id").alias("_id")).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
        often = F.broadcast(often.select("_of", "_id", F.lit(1).alias("_often")))
        filled = docs.filter("size > 0").join(often, F.col("source").eqNullSafe(F.col("_of")) & F.col("id").eqNullSafe(F.col("_id")), "left")
        h = F.xxhash64(F.lit(self.seed), "id", F.when(F.col("_often").isNotNull(), F.col("row")))
        placed = self.work.save(
            filled.select("row", "id", "source_no", "size", "buckets", h.alias("h"))
            .select("row", "id", "source_no", "size", "h", F.pmod("h", "buckets").alias("bucket")),
            "placed",
        )
        sums = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source_no", "bucket").orderBy("h", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
        return (
            placed.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .join(offsets, ["source_no", "bucket"])
            .select("row", "id", "source_no", "size", (F.col("base") + F.col("_in")).alias("start"))
        )

    def _drawn(self, slots: int, shard_slots: int) -> DataFrame:
        """``shard, source_no, block_no, turn, take`` of every slot of the mix."""
        spark, block, seed = self.work.spark, self.block, self.seed
        order = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.coalesce(F.sum("n_slots").over(order), F.lit(0))
        needs = self.sources.filter("n_slots > 0").select(
            "source_no", "n_slots", (ahead / slots).alias("lo"), ((ahead + F.col("n_slots")) / slots).alias("hi")
        )
        cells = F.sequence(F.floor(F.col("lo") * GRID), F.least(F.floor(F.col("hi") * GRID), F.lit(GRID - 1)))
        cells = needs.select("source_no", "lo", "hi", F.explode(cells).alias("cell"))
        ids = spark.range(-(-slots // shard_slots)).withColumnRenamed("id", "shard")
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "shard", "k"), 11) / F.lit(float(1 << 53))
        draws = (
            ids.select("shard", F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), F.lit(slots) - F.col("shard") * shard_slots).cast("int") - 1)).alias("k"))
            .withColumn("u", u)
            .withColumn("cell", F.floor(F.col("u") * GRID))
            .join(self._small(cells), "cell")
            .filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        )
        counts = self.work.save(draws.groupBy("shard", "source_no").agg(F.count("*").alias("drawn")), "counts")
        upto = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        dealt = counts.withColumn("first", F.coalesce(F.sum("drawn").over(upto), F.lit(0)))
        # what a source drew beyond its need, against what others lack, as intervals of one line
        balance = needs.join(counts.groupBy("source_no").agg(F.sum("drawn").alias("got")), "source_no", "left").select(
            "source_no", "n_slots", F.coalesce("got", F.lit(0)).alias("got")
        )
        balance = self.work.save(
            balance.withColumn("over", F.greatest(F.col("got") - F.col("n_slots"), F.lit(0)))
            .withColumn("lack", F.greatest(F.col("n_slots") - F.col("got"), F.lit(0)))
            .withColumn("over_at", F.coalesce(F.sum("over").over(order), F.lit(0)))
            .withColumn("lack_at", F.coalesce(F.sum("lack").over(order), F.lit(0))),
            "balance",
        )
        over = balance.filter("over > 0").select("source_no", "n_slots", "over_at", (F.col("over_at") + F.col("over")).alias("over_to"))
        lack = balance.filter("lack > 0").select(
            F.col("source_no").alias("to_no"), "got", "lack_at", (F.col("lack_at") + F.col("lack")).alias("lack_to")
        )
        # intervals meet in the grid cell where the later of the two begins
        wide = max(1, -(-balance.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0] // GRID))
        in_cells = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / wide), F.floor((F.col(hi) - 1) / wide)))
        moves = (
            over.withColumn("cell", in_cells("over_at", "over_to"))
            .join(lack.withColumn("cell", in_cells("lack_at", "lack_to")), "cell")
            .filter((F.col("over_at") < F.col("lack_to")) & (F.col("lack_at") < F.col("over_to")))
            .filter(F.col("cell") == F.floor(F.greatest("over_at", "lack_at") / wide))
            .drop("cell")
        )
        slot = dealt.join(self._small(balance.select("source_no", "n_slots")), "source_no").select(
            "shard", "source_no", "n_slots", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("drawn") - 1)).alias("j")
        )
        own = slot.filter("j < n_slots").select("shard", "source_no", "j")
        spare = slot.filter("j >= n_slots").drop("n_slots")
        moved = (
            spare.join(self._small(moves), "source_no")
            .withColumn("x", F.col("over_at") + F.col("j") - F.col("n_slots"))
            .filter("x >= lack_at and x < lack_to")
            .select("shard", F.col("to_no").alias("source_no"), (F.col("got") + F.col("x") - F.col("lack_at")).alias("j"))
        )
        plan = self._small(self.sources.select("source_no", "n_blocks", "passes", "rest", "short_at", "short"))
        at, n = F.col("i"), F.col("n_blocks")
        length = F.lit(block) - F.when(F.col("block_no") == n - 1, F.col("short")).otherwise(F.lit(0))
        before = at * block - F.when(F.col("short_at") < at, F.col("short")).otherwise(F.lit(0))
        take = F.when(F.col("turn") < F.col("passes"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - before)))
        return (
            own.unionByName(moved)
            .join(plan, "source_no")
            .withColumn("turn", F.floor(F.col("j") / n))
            .withColumn("i", F.col("j") % n)
            .withColumn("block_no", permuted(at, n, F.col("source_no"), F.col("turn"), seed))
            .withColumn("length", length)
            .withColumn("take", take)
            .filter("take > 0")
            .select("shard", "source_no", "block_no", "turn", "take", "length")
        )

    def parts(self) -> DataFrame:
        """Per document and block: ``lo, hi`` in the document, times taken ``full`` and up to ``prefix``."""
        block = self.block
        taken = self.slots.groupBy("source_no", "block_no").agg(
            F.sum((F.col("take") == F.col("length")).cast("long")).alias("full"),
            F.max(F.when(F.col("take") < F.col("length"), F.col("take")).otherwise(F.lit(0))).alias("prefix"),
        )
        end = F.col("start") + F.col("size")
        pieces = self.docs.select(
            "*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))).alias("block_no")
        )
        base = F.col("block_no") * block
        joined = pieces.join(taken, ["source_no", "block_no"], "left").withColumns(
            {
                "lo": F.greatest(F.col("start"), base) - F.col("start"),
                "hi": F.least(end, base + block) - F.col("start"),
                "full": F.coalesce("full", F.lit(0)),
                "prefix": F.coalesce("prefix", F.lit(0)),
            }
        )
        cut = F.least(F.col("hi"), base + F.col("prefix") - F.col("start"))
        return joined.withColumn("cut", F.greatest(F.col("lo"), cut)).drop("prefix")

    def documents(self) -> DataFrame:
        """``row, id, size, source_size, target, taken`` for every row of the table."""
        taken = (
            self.parts()
            .groupBy("row", "id", "source_no", "size", "start")
            .agg(F.sum(F.col("full") * (F.col("hi") - F.col("lo")) + F.col("cut") - F.col("lo")).alias("taken"))
            .join(self._small(self.sources.select("source_no", "source_size", "target")), "source_no")
        )
        columns = ["row", "id", "size", "source_size", "target", "taken"]
        return taken.select(columns).unionByName(self.empty.withColumn("taken", F.lit(0).cast("long")).select(columns))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", **options
) -> DataFrame:
    """The mix as documents: every row as often as it is taken whole, then its words taken once more.

    A row's further words, those of the blocks of a last, partial pass, make
    one row whose words are joined by single spaces.  Rows keep their columns;
    ``chars_col`` is set to the new length.  ``docs`` must be a plain scan.
    """
    whole = numbered(docs)
    mix = Mix(columns_of(whole, id=id_col, text=text_col, source=source_col), "id", "text", "source", "row", **options)
    each = mix.parts().groupBy("row").agg(
        F.min("full").alias("copies"), F.array_sort(F.collect_list(F.struct("lo", "hi", "full", "cut"))).alias("pieces")
    )
    # a block is taken at most once more than the document's least taken one
    once = F.filter(
        F.transform("pieces", lambda p: F.struct(p["lo"].alias("lo"), F.when(p["full"] > F.col("copies"), p["hi"]).otherwise(p["cut"]).alias("to"))),
        lambda p: p["to"] > p["lo"],
    )
    plan = each.select("row", "copies", once.alias("once")).filter((F.col("copies") > 0) | (F.size("once") > 0))
    words = F.regexp_extract_all(F.col("doc")[text_col], F.lit(f"({WORD})"))
    cut = F.array_join(F.flatten(F.transform("once", lambda p: F.slice("_words", (p["lo"] + 1).cast("int"), (p["to"] - p["lo"]).cast("int")))), " ")
    joined = whole.join(plan, "row")
    again = joined.filter("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    part = joined.filter(F.size("once") > 0).select("doc", "once", words.alias("_words")).select("doc", cut.alias("said"))
    changed = {text_col: F.col("said")}
    if chars_col and chars_col in docs.columns:
        changed[chars_col] = F.length("said").cast(docs.schema[chars_col].dataType)
    part = part.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))
    return again.select("doc.*").unionByName(part)


def mix_sources(df: DataFrame, **options) -> Mix:
    """Mix a table; see ``Mix`` for the options."""
    return Mix(df, **options)
