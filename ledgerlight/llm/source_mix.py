"""Mixing sources to target weights, with DataFrame functions only.

Texts are measured in words. Every row has a hashed place in its source; the top
bits of it name a block. Whole copies of a source take all its blocks, the last
copy takes blocks in a permuted order up to the target, and the block that the
target cuts is cut at one hashed place; the largest row left out that still fits closes the gap. So each source has an exact quota of
block draws. A binary tree deals the draws out to the shards: each node draws its
left half's composition from the multivariate hypergeometric distribution, one
source after another, and leaves the rest to the right half. A leaf's counts cut
every source's permuted draws into disjoint runs, and shards shuffle locally.

Only tables of (source, block) are gathered and windowed: with about
``rows_per_block`` rows a block they are far smaller than the data, and a source
that holds a third of all rows is a third of the blocks, each of bounded size.

Null texts have size 0; a null source is a source of its own, last in order; rows
with a null id are mixed like others; equal rows are taken together. An empty
input gives no rows. All draws are hashes of ``seed``, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlight.llm.cluster import broadcast_if_small, materialize

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _log_factorial(n: str) -> str:
    """SQL of ln(n!) for n >= 0: Stirling's series at n + 8, less the product between."""
    x = f"({n} + 8D)"
    series = f"(({x} - 0.5D) * ln({x}) - {x} + 0.9189385332046727D + 1D / (12D * {x}) - 1D / (360D * pow({x}, 3)) + 1D / (1260D * pow({x}, 5)))"
    return f"({series} - ln(({n} + 1D) * ({n} + 2D) * ({n} + 3D) * ({n} + 4D) * ({n} + 5D) * ({n} + 6D) * ({n} + 7D)))"


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'({n} - {k})')})"


def _hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL of one hypergeometric draw by inversion, within 12 deviations of its mean."""
    mean = f"({drawn} * ({marked} / greatest({total}, 1D)))"
    spread = f"(12D * sqrt({mean} * (1D - {marked} / greatest({total}, 1D))) + 12D)"
    low = f"cast(greatest(0D, {drawn} - ({total} - {marked}), floor({mean} - {spread})) as bigint)"
    high = f"cast(least({drawn}, {marked}, ceil({mean} + {spread})) as bigint)"
    chance = f"exp({_log_choose(marked, 'cast(k as double)')} + {_log_choose(f'({total} - {marked})', f'({drawn} - k)')} - {_log_choose(total, drawn)})"
    return f"aggregate(sequence({low}, {high}), named_struct('c', 0D, 'k', cast(-1 as bigint)), (a, k) -> if(a.c >= {uniform}, a, named_struct('c', a.c + {chance}, 'k', k)), a -> a.k)"


def split_quotas(quotas: DataFrame, shards: int, seed: int = 42, levels_a_task: int = 8) -> DataFrame:
    """Deals quotas (source_no int from 0, quota long) to ``shards`` (a power of two) leaves.

    One row per leaf and source that gets draws: shard, source_no, start (the source's
    draws in the shards before) and n. A node carries its starts, so that no leaf asks
    the others. The nodes of every ``levels_a_task`` levels are written and dealt
    anew: only the first few hundred come from one task.
    """
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("shards is a power of two")
    root = F.transform(F.array_sort(F.collect_list(F.struct("source_no", "quota"))), lambda x: x["quota"])
    nodes = quotas.agg(root.alias("q")).select(F.lit(1).cast("long").alias("node"), "q", F.transform("q", lambda x: x * 0).alias("s"))
    add = lambda x, y: F.zip_with(x, y, lambda u, v: u + v)
    for level in range(levels):
        if level and level % levels_a_task == 0:
            # A stated number: few rows, much work in each, so none are to be coalesced.
            tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            nodes = materialize(nodes, "mix-nodes").repartition(tasks, "node")
        draw = _hypergeometric("acc.total", "cast(x as double)", "acc.want", f"pmod(xxhash64({seed}L, node, size(acc.left)), 9007199254740992L) / 9007199254740992D")
        step = f"named_struct('draw', {draw})"
        left = F.expr(f"""aggregate(q, named_struct('total', total, 'want', floor(total / 2D) * 1D, 'left', cast(array() as array<bigint>)),
            (acc, x) -> transform(array({step}), s -> named_struct('total', acc.total - x, 'want', acc.want - s.draw, 'left', concat(acc.left, array(s.draw))))[0],
            acc -> acc.left)""")
        total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
        halved = nodes.withColumn("total", total).withColumn("left", left)
        first = F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q"), F.col("s"))
        second = F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q"), add("s", "left").alias("s"))
        nodes = halved.select(F.explode(F.array(first, second)).alias("half")).select("half.*")
    leaf = nodes.select((F.col("node") - shards).cast("int").alias("shard"), F.posexplode(F.arrays_zip("q", "s")).alias("source_no", "of"))
    return leaf.select("shard", "source_no", F.col("of.s").alias("start"), F.col("of.q").alias("n")).filter("n > 0")


def shards_of_draws(leaves: DataFrame) -> DataFrame:
    """One row per draw: source_no, no (its number in the source's permuted order) and shard. As many rows as there are draws."""
    return leaves.select("source_no", "shard", F.explode(F.expr("sequence(start, start + n - 1)")).alias("no"))


def target_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Adds source_no and target to (source, source_size).

    ``weights`` repeat over the sources by code point, null last. The targets add
    up to all words; one that would pass ``max_repeat`` times its source's size
    stops there and the excess is shared again by weight: target = min(cap, level
    x weight) at the one level that adds up. Sources are few next to rows; these
    windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sources.withColumn("source_no", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    held = numbered.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(max_repeat)).withColumn("_at", F.col("_cap") / F.col("_w"))
    every = Window.partitionBy()
    before = Window.orderBy("_at", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    spent = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    level = (F.sum("source_size").over(every) - spent("_cap")) / (F.sum("_w").over(every) - spent("_w"))
    found = held.withColumn("_level", level).withColumn("_own", F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "source_no", "_level")))
    level = F.min("_own").over(every)["_level"]
    return found.withColumn("target", F.least("_cap", level * F.col("_w")).cast("double")).select("source", "source_no", "source_size", "target")


def measure(docs: DataFrame, *, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Adds _source, _size and _place (a hash of the row) to the rows of ``docs``."""
    return docs.withColumns({"_source": F.col(source_col), "_size": words(F.col(text_col)), "_place": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))})


def _running(rows: DataFrame, key: str, order: Column, ties: list[str], value: Column) -> DataFrame:
    """Adds ``sum``, the inclusive running sum of ``value`` within ``key`` in the order of a hash.

    A key's rows are cut into 32 runs by the hash's top bits; each run is summed by
    itself, on top of the runs before, so no key lies in one task.
    """
    dealt = rows.withColumn("_h", order).withColumn("_run", F.expr("shiftright(_h, 59)"))
    runs = dealt.groupBy(key, "_run").agg(F.sum(value).alias("_own"))
    before = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(key, "_run", F.coalesce(F.sum("_own").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(key, "_run").orderBy("_h", *ties).rowsBetween(Window.unboundedPreceding, 0)
    # Dealt by key and run, or the join would take the windows' dealing by key for both sides.
    return dealt.join(runs.repartition(key, "_run").hint("merge"), [key, "_run"]).withColumn("sum", F.col("_before") + F.sum(value).over(own)).drop("_h", "_run", "_before")


def shards_for(total_words: int, words_per_shard: int = 1_000_000) -> int:
    """The least power of two of shards that hold ``words_per_shard`` words at most on average."""
    return 1 << max(0, math.ceil(math.log2(max(1, total_words) / words_per_shard)))


def _block(bits: int) -> Column:
    return F.expr(f"cast(shiftrightunsigned(_place, {64 - bits}) as int)") if bits else F.lit(0)


def plan_mix(measured: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, shards: int | None = None, rows_per_block: int = 2000, seed: int = 42) -> tuple[DataFrame, int]:
    """The table of block draws, and how many bits of the place name a block.

    Columns: _source, _block, source_size, target, draws: array of (copy, shard,
    first, last): the block is taken once for each, from the place ``first`` to
    ``last`` (null: no bound).
    """
    n, total = measured.agg(F.count(F.lit(1)), F.sum("_size")).first()
    shards = shards or shards_for(total or 0)
    bits = max(4, math.ceil(math.log2(max(n, 1) / rows_per_block))) if n > rows_per_block else 4
    placed = measured.select("_source", "_size", "_place", _block(bits).alias("_block"))
    blocks = materialize(placed.groupBy("_source", "_block").agg(F.sum("_size").alias("words")), "mix-blocks")
    sources = target_weights(blocks.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), weights, max_repeat)
    sources = sources.withColumn("full", F.coalesce(F.least(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(max_repeat)), F.lit(0)).cast("int"))
    sources = materialize(sources.withColumn("rest", F.when(F.col("full") >= max_repeat, F.lit(0.0)).otherwise(F.col("target") - F.col("full") * F.col("source_size"))), "mix-sources")
    rows = blocks.join(broadcast_if_small(sources, 100_000), blocks["_source"].eqNullSafe(sources["source"])).drop("source")

    filled = _running(rows, "source_no", F.xxhash64(F.lit(seed), "source_no", "full", "_block"), ["_block"], F.col("words"))
    filled = filled.withColumn("left", F.col("rest") - (F.col("sum") - F.col("words")))
    part = F.when(F.col("left") <= 0, "none").when(F.col("left") >= F.col("words"), "all").otherwise("cut")
    filled = materialize(filled.withColumn("part", part), "mix-order")

    # The one block of a source that its target cuts: the place up to which rows are taken.
    cut = filled.filter("part = 'cut'").select(F.col("_source").alias("s"), F.col("_block").alias("b"), "left", "source_no")
    inside = placed.join(broadcast_if_small(cut, 100_000), placed["_source"].eqNullSafe(F.col("s")) & (placed["_block"] == F.col("b")))
    running = F.sum("_size").over(Window.partitionBy("source_no").orderBy("_place").rangeBetween(Window.unboundedPreceding, 0))
    taken = inside.withColumn("sum", running).filter(F.col("sum") <= F.col("left"))
    last = taken.groupBy("source_no").agg(F.max("_place").alias("last"), F.max("sum").alias("got"))
    last = cut.join(last, "source_no", "left").select("source_no", "last", (F.col("left") - F.coalesce("got", F.lit(0))).alias("gap"))
    filled = materialize(filled.join(broadcast_if_small(last, 100_000), "source_no", "left"), "mix-cut")

    # Of the rows that this copy leaves out, the largest that still fit close the gap. A few of
    # each size class are enough to choose from, and classes are combined before the shuffle.
    spare = filled.filter("gap > 0 and part != 'all'").select(F.col("_source").alias("s"), F.col("_block").alias("b"), "source_no", "full", "part", "last", "gap")
    out = placed.join(broadcast_if_small(spare, 100_000), placed["_source"].eqNullSafe(F.col("s")) & (placed["_block"] == F.col("b")))
    out = out.filter("_size > 0 and _size <= gap and (part = 'none' or last is null or _place > last)")
    classes = out.groupBy("source_no", F.floor(F.log2("_size")).alias("class"), F.pmod("_place", F.lit(8)).alias("turn")).agg(F.max(F.struct("_size", "_place", "_block", "full")).alias("e"), F.max("gap").alias("gap"))
    # Equal rows have one place and are taken together: a choice counts with all its copies.
    chosen = materialize(classes.select("source_no", "gap", "e.*"), "mix-spare")
    copies = out.select("source_no", "_block", "_place", "_size").join(broadcast_if_small(chosen.select("source_no", "_block", "_place"), 100_000), ["source_no", "_block", "_place"], "left_semi")
    copies = copies.groupBy("source_no", "_block", "_place").agg(F.sum("_size").alias("_all"))
    whole = chosen.join(copies, ["source_no", "_block", "_place"]).filter("_all <= gap").select("source_no", "gap", F.struct(F.col("_all").alias("_size"), "_place", "_block", "full").alias("e"))
    choice = whole.groupBy("source_no").agg(F.max("gap").alias("gap"), F.reverse(F.array_sort(F.collect_list("e"))).alias("es"))
    picked = F.expr("aggregate(es, named_struct('left', gap, 'got', filter(es, x -> false)), (t, x) -> if(x._size <= t.left, named_struct('left', t.left - x._size, 'got', concat(t.got, array(x))), t), t -> t.got)")
    extra = choice.select("source_no", F.explode(picked).alias("e"))
    extra = extra.select("source_no", "e._block", F.col("e.full").alias("copy"), F.col("e._place").alias("first"), F.col("e._place").alias("last"))

    copies = F.sequence(F.lit(0), F.col("full"))
    whole = (F.col("copy") < F.col("full")) | (F.col("part") == "all")
    drawn = filled.withColumn("copy", F.explode(copies)).withColumn("whole", whole).filter(F.col("whole") | ((F.col("part") == "cut") & F.col("last").isNotNull()))
    drawn = drawn.select("source_no", "_block", "copy", F.lit(None).cast("long").alias("first"), F.when(~F.col("whole"), F.col("last")).alias("last")).unionByName(extra)
    drawn = _running(drawn, "source_no", F.xxhash64(F.lit(seed + 1), "source_no", "copy", "_block", "first"), ["copy", "_block"], F.lit(1))
    drawn = materialize(drawn.withColumn("no", F.col("sum") - 1).drop("sum"), "mix-draws")
    quotas = sources.join(drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("quota")), "source_no", "left").select("source_no", F.coalesce("quota", F.lit(0)).alias("quota"))
    # Leaves and draws meet by number: a source with most draws is as many keys as it has draws.
    leaves = materialize(split_quotas(quotas, shards, seed), "mix-tree")
    dealt = drawn.join(shards_of_draws(leaves), ["source_no", "no"])
    draws = dealt.groupBy("source_no", "_block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard", "first", "last"))).alias("draws"))
    table = rows.select("_source", "_block", "source_no", "source_size", "target").join(draws, ["source_no", "_block"], "left")
    return materialize(table.select("_source", "_block", "source_size", "target", "draws"), "mix-plan"), bits


def draw(measured: DataFrame, plan: DataFrame, bits: int) -> DataFrame:
    """Adds source_size, target and draws (array of (copy, shard, first, last)) to every row."""
    rows = measured.withColumn("_b", _block(bits))
    plan = broadcast_if_small(plan.select(F.col("_source").alias("_s"), F.col("_block").alias("_pb"), "source_size", "target", F.col("draws").alias("_draws")), 100_000)
    joined = rows.join(plan, (F.col("_b") == F.col("_pb")) & F.col("_source").eqNullSafe(F.col("_s")))
    mine = F.expr("coalesce(filter(_draws, d -> (d.first is null or _place >= d.first) and (d.last is null or _place <= d.last)), array())")
    return joined.withColumn("draws", mine).drop("_s", "_pb", "_b", "_draws")


def mix(docs: DataFrame, *, shards: int | None = None, seed: int = 42, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shard_col: str = "shard", order_col: str = "shard_order") -> DataFrame:
    """The mixed corpus: the rows of ``docs``, repeated as drawn, with shard and a local random order.

    ``shard_col`` and ``order_col`` are added and must be names that ``docs`` has not;
    write the mix with ``.repartition(shard_col).sortWithinPartitions(shard_col,
    order_col)``. Unless stated, the number of shards follows the input (``shards_for``).
    """
    if {shard_col, order_col} & {*docs.columns}:
        raise ValueError(f"{shard_col} and {order_col} are columns of the documents: name others")
    plain = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    measured = measure(docs.toDF(*plain.values()), seed=seed, id_col=plain[id_col], text_col=plain[text_col], source_col=plain[source_col])
    slim = materialize(measured.select("_source", "_size", "_place"), "mix-measured")
    plan, bits = plan_mix(slim, weights=weights, max_repeat=max_repeat, shards=shards, seed=seed)
    drawn = draw(measured, plan, bits).withColumn("_draw", F.explode("draws"))
    kept = [F.col(n).alias(c) for c, n in plain.items()]
    return drawn.select(*kept, F.col("_draw.shard").alias(shard_col), F.xxhash64(F.lit(seed), "_place", "_draw.copy").alias(order_col))


def mixed_words(docs: DataFrame, *, shards: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken, and the shards (sorted) that the tree deals its draws to."""
    measured = measure(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col).select(F.col(id_col).alias("doc_id"), "_source", "_size", "_place")
    measured = materialize(measured, "mix-measured")
    plan, bits = plan_mix(measured, shards=shards, seed=seed)
    return draw(measured, plan, bits).select("doc_id", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * F.size("draws")).cast("long").alias("taken"), F.array_sort(F.transform("draws", lambda d: d["shard"])).alias("shards"))
