"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree over block quotas.

The documents of a source lie on one line of words in a hashed order, cut into blocks.  A source's
target gives its quota of blocks (the line starts again at its end, so a target above the source's size repeats it).
The quotas of all sources are split in two halves of equal size again and again, each time with the
hypergeometric law of drawing without replacement, down to the output shards.  The blocks of a source are permuted by a hash; a
shard draws the next ones of each source and orders what it drew by a hash.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import private_name, with_row_key, written
from quern.operators.ordering import row_rank, running_total

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BLOCK_WORDS = 16_384
# Words of an output shard, about, and levels of the tree that one row is split by at once.
SHARD_WORDS = 1 << 24
_LEVELS_AT_ONCE = 5
# Parts of a shard's order that are written apart.
_SLICES = 8
_HASHES = 1 << 60


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(seed: str, *parts: Column) -> Column:
    """A number below 2**60 from an md5, so that any engine draws the same."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Per source: source, source_no (from 0, by code point, null last), source_size, rows, target.

    Sources share the words of all of them by weight; a target stops at ``repeats`` times its source's
    size and what it leaves goes to the others by weight.  In order of cap / weight, the level at which the
    rest is shared rises as long as sources are capped, so the largest level is the final one.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = Window.orderBy("_ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
        .withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("_weight", F.element_at(cycle, (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * repeats)
        .withColumn("_ratio", F.col("_cap").cast("double") / F.col("_weight").cast("double"))
        .withColumn("_rest", F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_open", F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_level", F.max(F.col("_rest").cast("double") / F.col("_open").cast("double")).over(every))
        .withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight").cast("double")))
        .select("source", F.col("source_no").cast("long").alias("source_no"), "source_size", "rows", "target")
    )


def on_line(sized: DataFrame, targets: DataFrame, seed: str) -> DataFrame:
    """Give each row (doc_id, source, size, row) its place on its source's line: ``line_at``, the words of the rows before it.

    The order is that of a hash of doc_id; rows of one doc_id are next to each other, cut into ranges as all rows are.
    """
    hashed = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
        .withColumn("_hash", _hash(seed, F.col("doc_id")))
        .withColumn("_file", F.col("row.file"))
        .withColumn("_in_file", F.col("row.row"))
    )
    line = running_total(hashed, F.col("size"), "_end", ["source_no"], ["_hash", "doc_id", "size", "_file", "_in_file"])
    return line.withColumn("line_at", F.col("_end") - F.col("size")).drop("_hash", "_file", "_in_file", "_end")


def _hypergeometric(population: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """How many of ``drawn`` items are marked, by the inverse of the distribution, from its mode outwards.

    Weights are relative to the mode's; their sum gives the scale of ``uniform``.
    """
    low = F.greatest(F.lit(0).cast("long"), drawn - (population - marked))
    high = F.least(marked, drawn)
    other = population - marked - drawn
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * (marked + 1) / (population + 2))))

    def double(c: Column) -> Column:
        return c.cast("double")

    def rise(k: Column) -> Column:
        return double(marked - k) * double(drawn - k) / F.greatest(F.lit(1.0), double(k + 1) * double(other + k + 1))

    def fall(k: Column) -> Column:
        return double(k) * double(other + k) / F.greatest(F.lit(1.0), double(marked - k + 1) * double(drawn - k + 1))

    def walk(start: Column, steps: Column, ratio, goal: Column) -> Column:
        """Sum of the weights along ``steps`` and the first step at which it reaches ``goal`` (-1: never)."""

        def step(acc: Column, k: Column) -> Column:
            total = acc["total"] + acc["weight"]
            return F.struct(
                (acc["weight"] * ratio(k)).alias("weight"),
                total.alias("total"),
                F.when((acc["pick"] < 0) & (total >= goal), k).otherwise(acc["pick"]).alias("pick"),
            )

        first = F.struct(start.alias("weight"), F.lit(0.0).alias("total"), F.lit(-1).cast("long").alias("pick"))
        return F.aggregate(steps, first, step)

    def pick(ends: Column) -> Column:
        m, lo, hi = ends["mode"], ends["low"], ends["high"]
        up = F.sequence(m, hi)
        down = F.when(m > lo, F.sequence(m - 1, lo, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
        never = F.lit(float("inf"))
        sums = F.struct(
            walk(F.lit(1.0), up, rise, never)["total"].alias("up"),
            walk(fall(m), down, fall, never)["total"].alias("down"),
        )

        def found(s: Column) -> Column:
            goal = uniform * (s["up"] + s["down"])
            above = walk(F.lit(1.0), up, rise, goal)["pick"]
            below = walk(fall(m), down, fall, goal - s["up"])["pick"]
            return F.when(goal <= s["up"], F.when(above < 0, hi).otherwise(above)).otherwise(
                F.when(below < 0, lo).otherwise(below)
            )

        return _let(sums, found)

    return _let(F.struct(mode.alias("mode"), low.alias("low"), high.alias("high")), pick)


def _halves(node: Column, quotas: Column, seed: str) -> Column:
    """Split a node's quotas: the left half holds half of all blocks, drawn without replacement."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    first = F.struct(
        total.alias("population"),
        F.floor((total + node % 2) / 2).cast("long").alias("draws"),
        F.array().cast("array<long>").alias("left"),
    )

    def step(acc: Column, quota: Column) -> Column:
        uniform = _hash(seed, node, F.size(acc["left"])) / F.lit(float(_HASHES))
        got = _hypergeometric(acc["population"], quota, acc["draws"], uniform)

        def next_state(x: Column) -> Column:
            return F.struct(
                (acc["population"] - quota).alias("population"),
                (acc["draws"] - x).alias("draws"),
                F.concat(acc["left"], F.array(x)).alias("left"),
            )

        return _let(got.cast("long"), next_state)

    return F.aggregate(quotas, first, step)["left"]


def shards_for(targets: DataFrame, shard_words: int = SHARD_WORDS) -> int:
    """The number of shards, a power of two, for what all targets take."""
    words = targets.agg(F.sum(F.floor("target"))).first()[0] or 0
    return 1 << max(0, (-(-words // shard_words) - 1).bit_length())


def shard_quotas(targets: DataFrame, shards: int, block_words: int, seed: str) -> DataFrame:
    """(shard, source_no, blocks): the leaves of the splitting tree."""
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("the number of shards is a power of two")
    quota = F.ceil(F.floor("target") / block_words).cast("long")
    everything = targets.agg(F.sort_array(F.collect_list(F.struct("source_no", quota.alias("quota")))).alias("_all"))

    def split(node: Column) -> Column:
        def both(left: Column) -> Column:
            return F.array(
                F.struct((node["node"] * 2).alias("node"), left.alias("quotas")),
                F.struct(
                    (node["node"] * 2 + 1).alias("node"),
                    F.zip_with(node["quotas"], left, lambda q, x: q - x).alias("quotas"),
                ),
            )

        return _let(_halves(node["node"], node["quotas"], seed), both)

    nodes = everything.select(F.lit(1).cast("long").alias("node"), F.col("_all.quota").alias("quotas"))
    while levels:
        some = min(levels, _LEVELS_AT_ONCE)
        levels -= some
        own = F.array(F.struct("node", "quotas"))
        below = F.aggregate(F.array_repeat(F.lit(0), some), own, lambda found, _: F.flatten(F.transform(found, split)))
        nodes = nodes.select(F.explode(below).alias("_node")).select("_node.node", "_node.quotas")
        if levels:
            # Subtrees are dealt out before they are split further.
            nodes = nodes.repartition("node")
    return nodes.select((F.col("node") - shards).alias("shard"), F.posexplode("quotas").alias("_no", "blocks")).select(
        "shard", F.col("_no").cast("long").alias("source_no"), "blocks"
    )


def shard_blocks(targets: DataFrame, shards: int, block_words: int, seed: str) -> DataFrame:
    """(source_no, block, shard): the output shard of every block that the mix takes.

    A source's blocks are put in the order of a hash, and each shard draws as many of the next ones as its leaf of the tree says.
    """
    line = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (
        shard_quotas(targets, shards, block_words, seed)
        .withColumn("_first", F.coalesce(F.sum("blocks").over(line), F.lit(0)))
        .where("blocks > 0")
        .select("source_no", "shard", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("blocks") - 1)).alias("draw"))
        .withColumn("_hash", _hash(f"{seed} block", F.col("source_no"), F.col("draw")))
    )
    # The draws of a source are as many as its blocks; the block of a draw is the draw's rank by hash.
    ranked = row_rank(written(drawn, "mix-draws"), "_rank", ["source_no"], ["_hash", "draw"])
    return ranked.select("source_no", (F.col("_rank") - 1).alias("block"), "shard")


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, shards: int | None = None,
    block_words: int = BLOCK_WORDS, seed: str = "mix", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """The pieces of the mix: what each row of ``docs`` gives to which shard.

    doc_id, size, source_size, target, row (the key of the row of ``docs``), pass (0 for the first time), at and words
    (the words at .. at + words - 1 of the text, 0 words for a row that gives nothing), shard, place (the order in the
    shard).  Null and empty texts have size 0 and give nothing; null sources are one source, the last; rows
    with one doc_id are rows of their own.  An empty table gives no rows.  Without ``shards`` there are as many as the words to take fill.
    """
    name = private_name(docs)
    return _mix(with_row_key(docs, name), name, weights, repeats, shards, block_words, seed, shard_words)


def _mix(
    keyed: DataFrame, name: str, weights: tuple[int, ...] = WEIGHTS, repeats: int = MAX_REPEATS, shards: int | None = None,
    block_words: int = BLOCK_WORDS, seed: str = "mix", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    # The texts are read once; what follows works on their sizes.
    sized = written(
        keyed.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
            F.col(name).alias("row"),
        ),
        "mix-sizes",
    )
    targets = written(source_targets(sized, weights, repeats), "mix-targets")
    line = on_line(sized, targets, seed)
    whole = F.floor("target").cast("long")
    begin = F.col("line_at") + F.col("_pass") * F.col("source_size")
    passed = (
        line.withColumn("_total", whole)
        .withColumn("_pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats).cast("long"))))
        .withColumn("_begin", begin)
        .withColumn("_end", F.least(F.col("_total"), F.col("_begin") + F.col("size")))
        .where((F.col("_pass") == 0) | (F.col("_end") > F.col("_begin")))
    )
    blocks = F.when(
        F.col("_end") > F.col("_begin"),
        F.sequence(F.floor(F.col("_begin") / block_words), F.floor((F.col("_end") - 1) / block_words)),
    )
    cut = passed.withColumn("block", F.explode_outer(blocks))
    start = F.greatest(F.col("_begin"), F.col("block") * block_words)
    stop = F.least(F.col("_end"), (F.col("block") + 1) * block_words)
    drawn = shard_blocks(targets, shards or shards_for(targets, shard_words), block_words, seed)
    # A piece counts because a shard has drawn its block.
    given = F.col("shard").isNotNull()
    return cut.join(drawn, ["source_no", "block"], "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "row",
        F.col("_pass").alias("pass"),
        F.when(given, start - F.col("_begin")).otherwise(0).cast("long").alias("at"),
        F.when(given, stop - start).otherwise(0).cast("long").alias("words"),
        "shard",
        _hash(f"{seed} place", F.col("doc_id"), F.col("_pass"), F.col("block")).alias("place"),
    )


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (those that hold a piece) of every row of ``docs``."""
    keys = ["row", "doc_id", "size", "source_size", "target"]
    return (
        mix(docs, **options)
        .groupBy(*keys)
        .agg(F.sum("words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
        .drop("row")
    )


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the shards draw them: rows repeat as often as they are taken, the last time cut to the words taken.

    Columns stay.  Every row is taken for itself, rows of one doc_id or text too.  A text that several shards drew from goes whole to that of
    its first words; rows lie in files by shard and, within it, in the drawn order.
    """
    name = private_name(docs)
    keyed = with_row_key(docs, name)
    found = _mix(keyed, name, **options).where("words > 0").groupBy("row", "pass").agg(
        F.sum("words").alias("words"), F.min_by(F.struct("shard", "place"), "at").alias("first"), F.first("size").alias("size")
    )
    taken_name = private_name(docs, "_taken")
    times = F.collect_list(F.struct("words", "size", F.col("first.shard").alias("shard"), F.col("first.place").alias("place")))
    per_row = found.groupBy(F.col("row").alias(name)).agg(times.alias(taken_name))
    met = keyed.join(per_row, name).withColumn(taken_name, F.explode(taken_name))
    one = F.col(taken_name)
    text = F.when(one["words"] < one["size"], first_words(F.col("text"), one["words"])).otherwise(F.col("text"))
    part = [one["shard"], F.floor(one["place"] / F.lit(float(_HASHES)) * _SLICES)]
    return (
        met.withColumn("text", text)
        .repartition(*part)
        .sortWithinPartitions(*part, one["place"])
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )


def _oracle() -> str:
    weights = ", ".join(map(str, WEIGHTS))
    return rf"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents),
named as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as no
  from sized group by source),
weighed as (select *, [{weights}][no % {len(WEIGHTS)} + 1] as w, source_size * {MAX_REPEATS} as cap from named),
levels as (select *, ((sum(source_size) over ())::bigint
    - coalesce((sum(cap) over b)::bigint, 0))::double / ((sum(w) over ())::bigint - coalesce((sum(w) over b)::bigint, 0))::double as lv
  from weighed window b as (order by cap::double / w::double, no rows between unbounded preceding and 1 preceding)),
targets as (select source, source_size, least(cap::double, (max(lv) over ()) * w::double) as target from levels),
line as (select doc_id, s.source, size, source_size, target, coalesce(sum(size) over (partition by s.source
    order by ('0x' || md5('mix|' || coalesce(doc_id::varchar, ''))[:15])::bigint, doc_id, size
    rows between unbounded preceding and 1 preceding)::bigint, 0) as line_at
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
  case when source_size = 0 then 0 else (floor(target)::bigint // source_size) * size
    + greatest(0, least(size, floor(target)::bigint % source_size - line_at)) end::bigint as taken
from line
"""


ORACLE = _oracle()
