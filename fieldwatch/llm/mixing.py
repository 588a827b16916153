"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.llm.common import WORD, stored

#: Documents of one (source, size) cell are ranked in buckets of about this many rows.
BUCKET_ROWS = 512


def water_fill(sources: DataFrame, weights=(3, 1, 2), total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets by weight, each at most `cap` times its source's size, the excess reshared.

    sources: source, source_size, one row each.  Weights repeat along the sources in
    code point order, null last.  Resharing until nobody is above its cap ends where
    every source gets min(cap * size, weight * level) for one common level; sources
    sorted by cap * size / weight fill up in that order, so running sums give the level.
    The windows run over one row per source, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("source_no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    limit = cap * F.col("source_size")
    fill = Window.orderBy("ratio", "source_no")
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("weight", weight)
        .withColumn("ratio", limit / F.col("weight"))
        .withColumn("filled", F.coalesce(F.sum(limit).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("wanted", F.sum("source_size").over(everything) * total_share)
        .withColumn("level", (F.col("wanted") - F.col("filled")) / F.col("open"))
        .withColumn("common", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    )
    share = F.least(limit, F.coalesce(F.col("weight") * F.col("common"), limit))
    return levels.select("source", "source_no", "source_size", share.cast("double").alias("target"))


def _rate(lam, cap):
    """Rate of a document: exponential in its size, cut at the cap."""
    return F.least(F.lit(cap), F.exp(lam * F.col("x")))


def balance(cells: DataFrame, cap: float = 2.0, tolerance: float = 1e-6, most_steps: int = 80) -> DataFrame:
    """Solve the dual of the entropy problem of every source at once.

    cells: source_no, size, n, x (size over the source's mean size), source_size, scale,
    target.  Minimising relative entropy to rate 1 under sum(rate * size) = target and
    rate <= cap gives rate = min(cap, exp(lambda * x)), one lambda per source.  Each step
    is one distributed aggregate of value and slope per source; Newton works on the
    logarithm of the sum and falls back to halving inside a proven bracket.  Between
    steps only one small row per source is stored.  Returns source_no, lam.
    """
    size, target = F.max("source_size"), F.max("target")
    low = F.max("scale") * F.log(F.least(F.lit(1.0), target / size))
    cells = cells.where((F.col("size") > 0) & (F.col("target") > 0) & (F.col("target") < cap * F.col("source_size")))
    start = cells.groupBy("source_no").agg(
        F.lit(0.0).alias("lam"), low.alias("low"), (F.max("scale") * F.log(F.lit(cap))).alias("high"), F.lit(1.0).alias("off")
    )
    state = stored(start, "mix-state")
    for _ in range(most_steps):
        rate = _rate(F.col("lam"), cap)
        mass = F.col("n") * F.col("size")
        sums = (
            cells.join(state, "source_no")
            .groupBy("source_no", "lam", "low", "high")
            .agg(
                F.sum(mass * rate).alias("g"),
                F.sum(F.when(rate < cap, mass * F.col("x") * rate).otherwise(0.0)).alias("slope"),
                F.max("target").alias("target"),
            )
        )
        above = F.col("g") > F.col("target")
        moved = sums.select(
            "source_no",
            "lam",
            F.when(above, F.col("low")).otherwise(F.greatest("low", "lam")).alias("low"),
            F.when(above, F.least("high", "lam")).otherwise(F.col("high")).alias("high"),
            F.abs(F.log(F.col("target") / F.col("g"))).alias("off"),
            (F.col("lam") + F.try_divide(F.log(F.col("target") / F.col("g")) * F.col("g"), "slope")).alias("newton"),
        )
        inside = F.col("newton").between(F.col("low"), F.col("high"))
        step = F.when(F.col("off") <= tolerance, F.col("lam")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(moved.select("source_no", step.alias("lam"), "low", "high", "off"), "mix-state")
        worst = state.agg(F.max(F.when(F.col("high") - F.col("low") > 1e-13 * F.greatest(F.lit(1.0), F.abs("high")), F.col("off")))).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise RuntimeError(f"a source misses its target by a factor of exp({worst}) after {most_steps} steps")
    return state.select("source_no", "lam")


def _whole(cells: DataFrame, cap: float) -> DataFrame:
    """Copies per cell as whole numbers whose tokens stay near each source's target.

    Rounding the running sum of expected copies, largest sizes first, leaves an error
    of at most half of the largest document.  That rest is paid back by one cell of
    each power-of-two size class, from large to small: at most 64 cells per source.
    """
    run = Window.partitionBy("source_no").orderBy(F.col("size").desc())
    ends = F.floor(F.sum(F.col("n") * F.col("rate")).over(run.rowsBetween(Window.unboundedPreceding, 0)) + 0.5)
    cells = cells.withColumn("ends", ends)
    most = F.floor(F.col("n") * cap)
    copies = F.least(most, F.greatest(F.lit(0), F.col("ends") - F.coalesce(F.lag("ends").over(run), F.lit(0))))
    cells = stored(cells.withColumn("copies", copies.cast("long")).drop("ends"), "mix-cells")
    rest = cells.groupBy("source_no").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"))
    room = F.when(F.col("rest") > 0, most - F.col("copies")).otherwise(F.col("copies"))
    classes = (
        cells.where("size > 0")
        .join(rest, "source_no")
        .withColumn("room", room.cast("long"))
        .groupBy("source_no", F.floor(F.log2("size")).alias("class"), "rest")
        .agg(F.max_by(F.struct("size", "room"), F.struct("room", "size")).alias("cell"))
    )
    per_source = classes.groupBy("source_no", "rest").agg(F.sort_array(F.collect_list("cell"), asc=False).alias("from_large"))
    pay = """aggregate(from_large,
        named_struct('left', cast(abs(rest) AS double), 'moves', cast(array() AS array<struct<size:bigint,move:bigint>>)),
        (a, c) -> named_struct(
          'left', a.left - c.size * least(c.room, cast(floor(a.left / c.size) AS bigint)),
          'moves', concat(a.moves, array(named_struct('size', c.size, 'move', least(c.room, cast(floor(a.left / c.size) AS bigint)))))),
        a -> a.moves)"""
    moves = per_source.select("source_no", "rest", F.explode(F.expr(pay)).alias("m")).select(
        "source_no", F.col("m.size").alias("size"), (F.signum("rest") * F.col("m.move")).cast("long").alias("move")
    )
    return (
        cells.join(moves, ["source_no", "size"], "left")
        .withColumn("copies", F.col("copies") + F.coalesce(F.col("move"), F.lit(0)))
        .drop("move")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=(3, 1, 2),
    total_share: float = 1.5,
    cap: float = 2.0,
    row_col: str | None = None,
) -> DataFrame:
    """Copies of each document so that every source's tokens come near its target.

    Returns doc_id, source, size, source_size, target, rate, copies, taken.  A source's
    sum of taken words misses its target by less than its smallest usable document as
    long as small documents have room.  Rates depend on (source, size) only, so Newton
    runs over counted cells.  Inside a cell the documents with the smallest hashes of
    their id get the odd copies: cells are cut into buckets of bounded size, so that a
    cell with a third of all rows is ranked by many tasks, and reruns agree.

    Nulls and corner cases: null or blank text has size 0, gets rate 1 and takes no
    words; a null source is a source of its own, last in order; a source without words
    has target 0; rows that repeat an id are separate documents (`row_col`, a unique key of
    the rows, comes back with each); other columns are ignored, whatever their names; a text
    of any length only counts; an empty table gives no rows.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    if docs.schema[source_col].dataType.simpleString() != "string":
        docs = docs.withColumn(source_col, F.col(source_col).cast("string"))
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *row,
    )
    sizes = stored(sizes, "mix-sizes")
    counted = stored(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    totals = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    targets = stored(water_fill(totals.select("source", "source_size"), weights, total_share, cap), "mix-targets")
    named = targets.withColumnRenamed("source", "target_source").join(
        totals.select(F.col("source").alias("count_source"), "docs"), F.col("target_source").eqNullSafe(F.col("count_source"))
    )
    scale = F.col("source_size") / F.col("docs")
    cells = counted.join(named, F.col("source").eqNullSafe(F.col("target_source"))).select(
        "source", "source_no", "size", "n", "source_size", "target", scale.alias("scale"), F.coalesce(F.try_divide("size", scale), F.lit(0.0)).alias("x")
    )
    cells = stored(cells, "mix-cells")
    solved = balance(cells, cap)
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0)
    rate = rate.when(F.col("target") >= cap * F.col("source_size"), cap).otherwise(_rate(F.col("lam"), cap))
    whole = _whole(cells.join(solved, "source_no", "left").withColumn("rate", rate).drop("lam"), cap)
    plan = stored(
        whole.select(
            F.col("source").alias("cell_source"), F.col("size").alias("cell_size"), "source_no", "source_size", "target", "rate",
            F.expr("copies div n").alias("base"), F.expr("copies % n").alias("odd"),
            F.expr(f"1 + n div {BUCKET_ROWS}").alias("buckets"),
        ),
        "mix-plan",
    )
    same = F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("size") == F.col("cell_size"))
    placed = sizes.join(plan, same).withColumn("hash", F.xxhash64("doc_id"))
    placed = placed.withColumn("bucket", F.pmod("hash", F.col("buckets")))
    cell = ["source_no", "cell_size"]
    before = Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.where("odd > 0")
        .groupBy(*cell, "bucket")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
        .drop("rows")
    )
    order = ["hash", "doc_id", *(["row"] if row else [])]
    ranked = placed.where("odd > 0").withColumn("place", F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy(*order)))
    extra = ranked.join(starts, [*cell, "bucket"]).withColumn("more", (F.col("before") + F.col("place") <= F.col("odd")).cast("long"))
    given = ["row"] if row else []
    keep = ["doc_id", "source", "size", "source_size", "target", "rate", "base", "more", *given]
    both = extra.select(*keep).unionByName(placed.where("odd = 0").withColumn("more", F.lit(0).cast("long")).select(*keep))
    copies = F.col("base") + F.col("more")
    return both.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *given)


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; settings as in mix_sources.

    Rows are numbered and stored first, so rows that repeat an id, or have none, are taken
    each for itself.  Columns of any name pass through; an empty table stays empty.
    """
    names = docs.columns
    work = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {c: f"c{k}" for k, c in enumerate(names)}
    work = stored(work.withColumn("row_no", F.monotonically_increasing_id()), "mix-rows")
    taken = mix_sources(work, at[id_col], at[text_col], at[source_col], row_col="row_no", **settings)
    copies = taken.where("copies > 0").select(F.col("row").alias("row_no"), "copies")
    out = work.join(copies, "row_no").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(at[c]).alias(c) for c in names])
