"""Operator 4: mixing sources to target weights by iterative proportional fitting (native).

Token weights are summed into cells (one per combination of the dimensions);
each round scales the cells to one dimension's target marginal after the other,
until no marginal is off its target by more than ``TOLERANCE`` of all tokens, or
``ROUNDS`` rounds are over (targets that contradict each other). ``rake`` returns
the error that is left.
The fitted weight over the cell's tokens is the rate at which its documents are
taken; rates are scaled so that the largest is 1 and a document stays when the
hash of its id is below its cell's rate. Nothing is taken twice.

With ``spare``, cells of the highest rates that hold at most this share of the
tokens together do not set the scale: they are taken whole, and the others are
raked again around them. The pipeline mixes so; the query ``op4_mixing`` does not.

Cells are grouped before anything is shuffled, so a source that holds a third of
the rows is a row of the cell table like any other. The cells go to the documents
by a join whose strategy Spark picks by their measured size.

Defined results: a null in a dimension is the value ``null``; a null or empty
text weighs one token; equal rows share their fate; an empty table gives no
rows; other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.runtime import stash, table

DIMENSIONS = ("source", "lang", "topic")
#: target share of a value = its natural share to this power, over their sum
SMOOTHING = 0.9
#: rounds at most, and after how many the error is looked at
ROUNDS, STEP = 40, 5
TOLERANCE = 1e-9
#: so many cells are raked in one task without a shuffle; more are dealt by the dimension at hand
SMALL = 1 << 16
#: topic markers looked for in the lower-cased text, in this order (fixed values)
TOPICS = (("legal", "licen"), ("contact", "@"), ("tabular", "|"))


def tokens_of(text: Column) -> Column:
    """Estimated tokens: a quarter of the UTF-8 bytes, one at least."""
    size = F.octet_length(F.coalesce(text.cast("string"), F.lit("")))
    return F.greatest(F.lit(1), F.ceil(size / F.lit(4.0))).cast("bigint")


def topic_of(text: Column) -> Column:
    """The first topic whose marker stands in the text, else ``prose``."""
    low, out = F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("prose")
    for name, mark in reversed(TOPICS):
        out = F.when(F.contains(low, F.lit(mark)), F.lit(name)).otherwise(out)
    return out


def unit_hash(key: Column) -> Column:
    """A hash of the id in [0, 1): the first 13 hex digits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(
    cells: DataFrame, dims: tuple[str, ...], rounds: int, smoothing: float, targets: dict[str, DataFrame] | None, tolerance: float = TOLERANCE
) -> tuple[DataFrame, float]:
    """``cells(*dims, tokens)`` with goals per dimension, their total and the fitted weight ``w``; and the largest error of a marginal as a share of all tokens."""
    total = cells.agg(F.sum("tokens").cast("double")).scalar()
    fitted = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in dims:
        if targets and d in targets:
            goal = targets[d].select(F.col("value").alias(d), F.col("share").alias(f"goal_{d}"))
            fitted = fitted.join(goal, d, "left").withColumn(f"goal_{d}", F.coalesce(f"goal_{d}", F.lit(0.0)))
        else:
            goal = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(smoothing)).alias("p"))
            goal = goal.select(d, (F.col("p") / goal.agg(F.sum("p")).scalar()).alias(f"goal_{d}"))
            fitted = fitted.join(goal, d)
    return _until(stash(fitted.withColumn("total", total), "goals"), dims, rounds, tolerance)


def _until(fitted: DataFrame, dims: tuple[str, ...], rounds: int, tolerance: float, cap: Column | None = None) -> tuple[DataFrame, float]:
    """Rounds until the marginals fit or the cells stand still."""
    done, error = 0, 1.0
    one = (lambda df: df.coalesce(1)) if fitted.count() <= SMALL else (lambda df: df)
    while done < rounds:
        step = min(STEP, rounds - done)
        before, done = F.col("w").alias("was"), done + step
        fitted = stash(_rake(one(fitted.drop("was").select("*", before)), dims, step, cap), "cells")
        off = [fitted.groupBy(d).agg((F.abs(F.sum("w") - F.first(f"goal_{d}") * F.first("total")) / F.first("total")).alias("off")).agg(F.max("off")).scalar() for d in dims]
        still = F.max(F.abs(F.col("w") - F.col("was")) / F.col("total"))
        got = fitted.agg(still.alias("still")).select("still", F.greatest(F.lit(0.0), *off).alias("off")).first()
        error = got["off"] or 0.0
        if min(error, got["still"] or 0.0) <= tolerance:
            break
    return fitted.drop("was"), error


def fit_cells(
    cells: DataFrame, dims: tuple[str, ...], rounds: int, smoothing: float, targets: dict[str, DataFrame] | None, spare: float = 0.0
) -> DataFrame:
    """Rake ``cells(*dims, tokens)``; adds ``rate`` in (0, 1]. See the module on ``spare``."""
    fitted, _ = rake(cells, dims, rounds, smoothing, targets)
    fitted = fitted.withColumn("rate", F.col("w") / F.col("tokens"))
    if not spare:
        return fitted.select(*dims, "tokens", "w", (F.col("rate") / fitted.agg(F.max("rate")).scalar()).alias("rate"))
    scale = _scale(fitted, spare)
    fitted, _ = _until(fitted.withColumn("scale", F.lit(scale)), dims, rounds, TOLERANCE, F.col("tokens") * F.col("scale"))
    taken = F.least(F.col("w") / F.col("tokens") / F.col("scale"), F.lit(1.0))
    return fitted.select(*dims, "tokens", "w", F.when(F.col("scale") > 0, taken).otherwise(F.lit(0.0)).alias("rate"))


def _scale(fitted: DataFrame, spare: float) -> float:
    """The highest rate once the cells with that or more hold over the spared share of the tokens.

    Sums of cells with nearly equal rates come first (their number does not grow
    with the cells); only the cells of the band that crosses the share are sorted.
    """
    band = F.when(F.col("rate") > 0, F.floor(F.log("rate") * 64)).otherwise(F.lit(-(1 << 40)))
    rows = fitted.select("rate", "tokens", band.cast("bigint").alias("band"))
    sums = rows.groupBy("band").agg(F.sum("tokens").alias("n"))
    down = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = F.lit(spare) * fitted.agg(F.max("total")).scalar()
    first = sums.select("band", "n", F.sum("n").over(down).alias("upto")).where(F.col("upto") > over).orderBy(F.desc("band")).first()
    if first is None:
        return 0.0
    inside = Window.orderBy(F.desc("rate")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.where(F.col("band") == first["band"]).select("rate", (F.sum("tokens").over(inside) + F.lit(first["upto"] - first["n"])).alias("upto"))
    return inside.where(F.col("upto") > over).agg(F.max("rate")).first()[0] or 0.0


def _rake(fitted: DataFrame, dims: tuple[str, ...], rounds: int, cap: Column | None = None) -> DataFrame:
    """``w`` scaled to each dimension's goal in turn, and cut to ``cap`` after each round."""
    for _ in range(rounds):
        for d in dims:
            have = F.sum("w").over(Window.partitionBy(d))
            fitted = fitted.withColumn(
                "w", F.when(have > 0, F.col("w") * F.col(f"goal_{d}") * F.col("total") / have).otherwise(F.lit(0.0))
            )
        if cap is not None:
            fitted = fitted.withColumn("w", F.least("w", cap))
    return fitted


def mix(
    docs: DataFrame,
    dims: tuple[str, ...] = DIMENSIONS,
    rounds: int = ROUNDS,
    smoothing: float = SMOOTHING,
    targets: dict[str, DataFrame] | None = None,
    key: str = "doc_id",
    spare: float = 0.0,
) -> DataFrame:
    """``docs`` with their dimensions, ``mix_tokens``, ``mix_rate`` and ``mix_selected``.

    ``targets`` maps a dimension to a table (value, share); without one the
    dimension's natural shares are smoothed. Columns of those names are replaced.
    """
    named = {d: f"mix_{d}" for d in dims}
    own = topic_of(F.col("text")) if "topic" in dims and "topic" not in docs.columns else None
    rows = docs.drop("mix_rate", "mix_selected").withColumns(
        {n: F.coalesce((own if d == "topic" and own is not None else F.col(d)).cast("string"), F.lit("null")) for d, n in named.items()}
        | {"mix_tokens": tokens_of(F.col("text"))}
    )
    cells = rows.groupBy(*named.values()).agg(F.sum("mix_tokens").alias("tokens"))
    cells = stash(cells, "mixcells")
    if targets:
        targets = {named[d]: t for d, t in targets.items()}
    fitted = fit_cells(cells, tuple(named.values()), rounds, smoothing, targets, spare)
    fitted = fitted.select(*named.values(), F.col("rate").alias("mix_rate"))
    return rows.join(fitted, list(named.values())).withColumn("mix_selected", unit_hash(F.col(key)) < F.col("mix_rate"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents with the rate of their cell and whether they are taken."""
    got = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return got.select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("tokens"), F.round("mix_rate", 6).alias("rate"), F.col("mix_selected").alias("selected"),
    )


def _sql() -> str:
    topic = "'prose'"
    for name, mark in reversed(TOPICS):
        topic = f"case when contains(lower(coalesce(text, '')), '{mark}') then '{name}' else {topic} end"
    steps = [
        f"""rows_ as (select doc_id, coalesce(source, 'null') source, coalesce(lang, 'null') lang, {topic} topic,
            greatest(1, ceil(strlen(coalesce(text, '')) / 4.0))::bigint tokens from documents)""",
        "cells as (select source, lang, topic, sum(tokens)::bigint tokens from rows_ group by all)",
    ]
    for d in DIMENSIONS:
        steps.append(
            f"goal_{d} as (select {d}, p / sum(p) over () g_{d} from (select {d}, pow(sum(tokens)::double, {SMOOTHING}) p from cells group by {d}))"
        )
    last = "f_0"
    steps.append(
        "f_0 as materialized (select c.*, tokens::double w, g_source, g_lang, g_topic, (sum(tokens) over ())::double total from cells c"
        " join goal_source using (source) join goal_lang using (lang) join goal_topic using (topic))"
    )
    for k in range(ROUNDS * len(DIMENSIONS)):
        d = DIMENSIONS[k % len(DIMENSIONS)]
        steps.append(
            f"f_{k + 1} as materialized (select * exclude (w), w * g_{d} * total / sum(w) over (partition by {d}) w from {last})"
        )
        last = f"f_{k + 1}"
    # rounds after the tolerance is met change nothing that rounding to six digits shows
    steps.append(f"fit as (select source, lang, topic, (w / tokens) / max(w / tokens) over () rate from {last})")
    return f"""with {", ".join(steps)}
        select doc_id, source, lang, topic, tokens, round(rate, 6) rate,
            (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 13))::bigint / {float(1 << 52)!r}) < rate selected
        from rows_ join fit using (source, lang, topic)"""


ORACLE_SQL = _sql()
