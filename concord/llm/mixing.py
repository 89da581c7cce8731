"""Mixing sources to target weights by iterative proportional fitting.

Token masses are counted for each cell of (source, language, topic). Raking
scales the cells in turn until their sums over each dimension meet the target
shares; the ratio of a cell's raked share to its present share is its weight.
Documents are then sampled with a probability in proportion to that weight,
scaled so that the largest is 1.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import WORD, category, unit_interval
from concord.session import pinned

SEED = "mix-1"
SWEEPS = 50
MAX_CATEGORIES = 1000  # the driver rakes up to so many categories of a dimension
DRIVER_CELLS = 100_000  # and up to so many cells; more are raked as a table, with the same results
MAX_CELLS: int | None = None  # a caller's own ceiling, over which a run is refused
STEADY = 1e-12  # a table whose weights move by no more in a sweep is done
DIMENSIONS = ("source", "lang", "topic")

# Cues of the default topic, tried in this order.
CUES = (
    ("license", ("Licensed under", "Copyright", "All rights reserved")),
    ("contact", ("@",)),
    ("tabular", (" | ",)),
    ("web", ("http://", "https://", "www.")),
)


@dataclass
class Targets:
    """What the marginal shares should become.

    ``shares`` names shares for categories of a dimension (they are scaled to
    sum to one). A dimension without any is tempered: its present shares are
    raised to the power given in ``tempers`` and scaled.
    """

    shares: dict[str, dict[str | None, float]] = field(default_factory=dict)
    tempers: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.8, "topic": 0.9})


def cue_topic(text: Column) -> Column:
    """The first cue found in the text names its topic; "prose" without any, NULL text has none."""
    topic = F.lit("prose")
    for name, cues in reversed(CUES):
        found = F.lit(False)
        for cue in cues:
            found = found | F.contains(text, F.lit(cue))
        topic = F.when(found, name).otherwise(topic)
    return F.when(text.isNull(), None).otherwise(topic)


def rake(mass: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """Scale cell masses until their sums by each code meet the targets, as far as empty cells let them."""
    share = mass / mass.sum()
    for _ in range(sweeps):
        for code, target in zip(codes, targets, strict=True):
            sums = np.bincount(code, share, len(target))
            share = share * np.divide(target, sums, out=np.zeros_like(target), where=sums > 0)[code]
    return share / share.sum()


def cell_weights(cells: DataFrame, targets: Targets, sweeps: int = SWEEPS) -> tuple[DataFrame, bool]:
    """(source, lang, topic, chance) of every cell, and whether they are few.

    ``cells`` has one row for each combination of categories with its tokens.
    Every category keeps its own target. Up to MAX_CATEGORIES categories of each
    dimension and DRIVER_CELLS cells are raked by the driver, others as a table.
    """
    counts = cells.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(d).alias(d) for d in DIMENSIONS]).head()
    if MAX_CELLS is not None and counts["n"] > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells; give targets for coarser categories")
    if counts["n"] <= DRIVER_CELLS and max(counts[d] for d in DIMENSIONS) <= MAX_CATEGORIES:
        schema = "source string, lang string, topic string, chance double"
        return cells.sparkSession.createDataFrame(_raked_by_driver(cells, targets, sweeps), schema), True
    return _raked_as_table(cells, targets, sweeps), False


def _raked_by_driver(cells: DataFrame, targets: Targets, sweeps: int) -> list[tuple]:
    rows = sorted(cells.collect(), key=lambda r: tuple(r[d] for d in DIMENSIONS))  # at most DRIVER_CELLS rows
    live = [r for r in rows if r["tokens"] > 0]
    if not live:
        return [(*[r[d] for d in DIMENSIONS], 1.0) for r in rows]
    mass = np.array([r["tokens"] for r in live], dtype=float)
    codes, wanted = [], []
    for d in DIMENSIONS:
        names = sorted({r[d] for r in live})
        at = {n: i for i, n in enumerate(names)}
        code = np.array([at[r[d]] for r in live])
        codes.append(code)
        wanted.append(_wanted(names, np.bincount(code, mass), targets, d))
    weight = rake(mass, codes, wanted, sweeps) / (mass / mass.sum())
    found = {tuple(r[d] for d in DIMENSIONS): float(w) for r, w in zip(live, weight / weight.max(), strict=True)}
    return [(*k, found.get(k, 1.0)) for k in (tuple(r[d] for d in DIMENSIONS) for r in rows)]


def _raked_as_table(cells: DataFrame, targets: Targets, sweeps: int) -> DataFrame:
    """The same over any number of categories: sums of each dimension are joined back, and each sweep is pinned.

    Sums fold on the map side; where few categories hold many cells, their sums
    are small enough to be broadcast or Spark splits the join.
    """
    live = cells.where("tokens > 0")
    total = live.agg(F.sum("tokens")).head()[0]
    if not total:
        return cells.select(*DIMENSIONS, F.lit(1.0).alias("chance"))
    goals = {d: pinned(_wanted_as_table(live, targets, d)) for d in DIMENSIONS}
    raked = live.select(*DIMENSIONS, "tokens", (F.col("tokens") / F.lit(float(total))).alias("share"))
    for _ in range(sweeps):
        step = raked.withColumn("was", F.col("share"))
        for d in DIMENSIONS:
            sums = step.groupBy(F.col(d).alias("name")).agg(F.sum("share").alias("sum")).join(goals[d], F.col("name") == F.col("goal_name"))
            factors = sums.select("name", F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0).alias("factor"))
            kept = [*DIMENSIONS, "tokens", "was"]
            step = step.join(factors, F.col(d) == F.col("name")).select(*kept, (F.col("share") * F.col("factor")).alias("share"))
        step = pinned(step)
        moved = step.agg(F.max(F.abs(F.col("share") - F.col("was")) / F.nullif(F.greatest("share", "was"), F.lit(0.0)))).head()[0]
        raked = step.select(*DIMENSIONS, "tokens", "share")
        if moved is None or moved <= STEADY:
            break
    ratios = raked.select(*DIMENSIONS, (F.col("share") / F.col("tokens")).alias("ratio"))
    largest = ratios.agg(F.max("ratio")).head()[0]
    chances = ratios.select(*DIMENSIONS, (F.col("ratio") / F.lit(largest)).alias("chance"))
    return pinned(chances.union(cells.where("tokens <= 0").select(*DIMENSIONS, F.lit(1.0).alias("chance"))))


def _wanted_as_table(live: DataFrame, targets: Targets, dimension: str) -> DataFrame:
    """(goal_name, goal): the target share of every category of a dimension."""
    sums = live.groupBy(F.col(dimension).alias("goal_name")).agg(F.sum("tokens").alias("mass"))
    given = {_code(k): v for k, v in targets.shares.get(dimension, {}).items()}
    if given:
        named = live.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], "given_name string, given double")
        sums = sums.join(named, F.col("goal_name") == F.col("given_name"), "left")
        raw = pinned(sums.select("goal_name", F.coalesce("given", F.lit(0.0)).alias("raw")))
    else:
        whole = live.agg(F.sum("tokens")).head()[0]
        share = F.col("mass") / F.lit(float(whole))
        raw = pinned(sums.select("goal_name", F.pow(share, F.lit(targets.tempers.get(dimension, 1.0))).alias("raw")))
    total = raw.agg(F.sum("raw")).head()[0]
    if not total:
        raise ValueError(f"no category of {dimension} has a target share")
    return raw.select("goal_name", (F.col("raw") / F.lit(total)).alias("goal"))


def _code(name: str | None) -> str:
    return "null" if name is None else f"={name}"


def _wanted(names: list[str], mass: np.ndarray, targets: Targets, dimension: str) -> np.ndarray:
    given = {_code(k): v for k, v in targets.shares.get(dimension, {}).items()}
    if given:
        share = np.array([given.get(n, 0.0) for n in names])
        if not share.any():
            raise ValueError(f"no category of {dimension} has a target share")
    else:
        share = (mass / mass.sum()) ** targets.tempers.get(dimension, 1.0)
    return share / share.sum()


def mix(
    docs: DataFrame,
    targets: Targets | None = None,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    topic: Column | None = None,
    seed: str = SEED,
    sweeps: int = SWEEPS,
    prefix: str = "mix_",
) -> DataFrame:
    """Every row of ``docs`` with (tokens, topic, probability, kept), under names led by ``prefix``.

    A row is kept if a number drawn from the seed and its key lies below its
    probability, so repeated rows share one fate and a retry repeats it. NULL
    is a category of its own in each dimension; a NULL text has no tokens and
    NULL as default topic; cells without any token keep all their rows. Named
    targets drop categories that they leave out. An empty table gives no row.
    Columns of these names are replaced.
    """
    targets = targets or Targets()
    own = [f"{prefix}{n}" for n in ("tokens", "topic", "probability", "kept")]
    names = [c for c in docs.columns if c not in own]
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    told = docs.select(*names, tokens.alias(own[0]), (cue_topic(F.col(text)) if topic is None else topic).alias(own[1]))
    keys = {"source": F.col(source), "lang": F.col(lang), "topic": F.col(own[1])}
    coded = [category(v).alias(d) for d, v in keys.items()]
    cells = pinned(told.select(*coded, F.col(own[0]).alias("n")).groupBy(*DIMENSIONS).agg(F.sum("n").alias("tokens")))
    weights, few = cell_weights(cells, targets, sweeps)
    found = weights.select(*[F.col(d).alias(f"__{d}") for d in DIMENSIONS], F.col("chance").alias("__chance"))
    on = F.lit(True)
    for d, v in keys.items():
        on = on & (category(v) == F.col(f"__{d}"))
    drawn = unit_interval(seed, F.col(key))
    joined = told.join(F.broadcast(found) if few else found, on)  # few: at most DRIVER_CELLS rows
    chance = F.col("__chance")
    return joined.select(*names, *own[:2], chance.alias(own[2]), (drawn < chance).alias(own[3]))


def sample(docs: DataFrame, targets: Targets | None = None, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture keeps, with their columns unchanged."""
    return mix(docs, targets, prefix="__mix_", **options).where("__mix_kept").select(*docs.columns)
