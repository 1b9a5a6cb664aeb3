"""Mixing sources to target weights: iterative proportional fitting of sampling probabilities.

Tokens are summed by (source, language, topic). The probabilities of these cells are raked: each margin in turn is scaled
until the expected tokens of its categories meet their targets, no probability above one, until nothing moves. Every
document is then drawn with its cell's probability by a hash of its id, so a draw can be repeated and does not depend on
partitions. Targets come from the margins themselves, tempered, unless they are given.

Every value of a margin is a category of its own, however many there are. Cells counted to at most DRIVER_CELLS are raked as
arrays; more of them stay a Spark table, raked by grouped sums and joins in the same steps.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardscore.operators.settle import broadcast_if, land, settle
from wardscore.operators.tables import q

MARGINS = ("source", "lang", "topic")
# So many cells are raked on the driver; their number is checked.
DRIVER_CELLS = 200_000
# Shares are raised to this power, and this part of all tokens is drawn.
TEMPER, BUDGET = 0.9, 0.7
ROUNDS, TOLERANCE = 500, 1e-10
# Probabilities of cells that stay a table have settled when none moves by more.
TABLE_TOLERANCE = 1e-6
OTHERS, MISSING = "*", "?"

# The first topic with one of its signs in the text; they tell kinds of content, whatever the language.
TOPICS = (
    ("legal", ("License", "license", "Copyright", "copyright", "©")),
    ("secrets", ("token =", "key =", "password", "secret")),
    ("contact", ("@", "http://", "https://", "www.", "+1 (")),
    ("table", ("|",)),
    ("marked", ("#", "*", "<", "{")),
)
PROSE = "prose"


def topic_of(text: Column) -> Column:
    """The topic by the signs of TOPICS, else prose; a null text is prose."""
    found = F.lit(PROSE)
    for name, signs in reversed(TOPICS):
        any_of = F.lit(False)
        for sign in signs:
            any_of = any_of | text.contains(sign)
        found = F.when(any_of, F.lit(name)).otherwise(found)
    return F.coalesce(found, F.lit(PROSE))


def words_in(text: Column) -> Column:
    """Words of a text, runs without ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def reachable(target: np.ndarray, own: np.ndarray, total: float) -> np.ndarray:
    """Tokens wished per category: shares of ``total``, but no more than there are; what is missing goes to the others."""
    full = np.zeros(len(own), bool)
    while True:
        left = total - own[full].sum()
        open_ = np.where(full, 0, target)
        wish = np.where(full, own, open_ * left / max(open_.sum(), 1e-300))
        over = ~full & (wish > own)
        if not over.any():
            return wish
        full |= over


def rake(tokens: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], budget: float) -> np.ndarray:
    """The probability of each cell.

    ``places`` has for each margin the category of every cell, ``targets`` the wished shares of its categories. The expected
    tokens are ``budget`` of all. Of a category with fewer tokens than its target all are taken, others fill in.
    """
    total = tokens.sum() * budget
    sizes = [len(t) for t in targets]
    wishes = [reachable(t, np.bincount(p, tokens, n), total) for p, t, n in zip(places, targets, sizes, strict=True)]
    chance = np.full(len(tokens), float(budget))
    for _ in range(ROUNDS):
        before = chance
        for place, wish, n in zip(places, wishes, sizes, strict=True):
            # Probabilities stop at one; scaling again gives the rest to the other cells.
            for _ in range(50):
                have = np.bincount(place, tokens * chance, n)
                new = np.minimum(1, chance * np.where(have > 0, wish / np.where(have > 0, have, 1), 1)[place])
                still = np.abs(new - chance).max(initial=0) < TOLERANCE
                chance = new
                if still:
                    break
        if np.abs(chance - before).max(initial=0) < TOLERANCE:
            break
    return chance


def _category(column: Column, named: Mapping[str, float] | None) -> Column:
    """A category's label: its value, one label for a missing value, one for values that given targets don't name."""
    own = F.concat(F.lit("="), column)
    own = own if named is None else F.when(column.isin(list(named)), own).otherwise(OTHERS)
    return F.when(column.isNull(), MISSING).otherwise(own)


def goals_of(names: np.ndarray, own: np.ndarray, given: Mapping[str, float] | None, temper: float) -> np.ndarray:
    """The wished share of each category of a margin whose shares are ``own``."""
    goal = own**temper if len(names) else own
    if given is not None:
        goal = np.array([given.get(n[1:], 0.0) if n.startswith("=") else 0.0 for n in names])
        loose = np.array([not n.startswith("=") for n in names])
        goal[loose] = max(0.0, 1 - goal.sum()) * own[loose] / max(own[loose].sum(), 1e-300)
    return goal / max(goal.sum(), 1e-300)


def rake_arrays(rows: list, given: Mapping[str, Mapping[str, float]], temper: float, budget: float) -> np.ndarray:
    """The probabilities of cells given as rows."""
    size = np.array([r["tokens"] for r in rows], float)
    places, goals = [], []
    for margin in MARGINS:
        names, place = np.unique([r[margin] for r in rows], return_inverse=True)
        own = np.bincount(place, size, len(names)) / max(size.sum(), 1)
        places.append(place)
        goals.append(goals_of(names, own, given.get(margin), temper))
    return rake(size, places, goals, budget) if len(rows) else np.zeros(0)


def wish_table(cells: DataFrame, margin: str, given: Mapping[str, float] | None, temper: float, total: float, budget: float) -> DataFrame:
    """Tokens wished per category of a margin: ``goals_of`` and ``reachable`` over a table of categories."""
    names = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("own"))
    if given is None:
        names = names.withColumn("goal", F.pow(F.col("own") / F.lit(total), F.lit(temper)))
    else:
        # As many rows as the caller listed.
        listed = cells.sparkSession.createDataFrame([(f"={k}", float(v)) for k, v in given.items()], f"`{margin}` string, goal double")
        names = settle(names.join(F.broadcast(listed), margin, "left"))
        loose = ~F.col(margin).startswith("=")
        got, rest = names.agg(F.coalesce(F.sum("goal"), F.lit(0.0)), F.coalesce(F.sum(F.when(loose, F.col("own"))), F.lit(0.0))).first()
        left = F.lit(max(0.0, 1 - got) / max(rest, 1e-300)) * F.col("own")
        names = names.withColumn("goal", F.when(loose, left).otherwise(F.col("goal")))
    names = settle(names.withColumn("full", F.lit(False)))
    while True:
        taken, open_ = names.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("own"))), F.lit(0.0)), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("goal")))).first()
        scale = F.lit((total * budget - taken) / max(open_, 1e-300))
        wished = names.withColumn("wish", F.when(F.col("full"), F.col("own")).otherwise(F.col("goal") * scale))
        over = ~F.col("full") & (F.col("wish") > F.col("own"))
        if wished.where(over).isEmpty():
            return settle(wished.select(margin, "wish"))
        names = settle(wished.withColumn("full", F.col("full") | over).drop("wish"))


def rake_table(cells: DataFrame, given: Mapping[str, Mapping[str, float]], temper: float, budget: float) -> DataFrame:
    """``cells`` (source, lang, topic, tokens, one row each) with their ``chance``, as ``rake`` finds it.

    A step is a grouped sum over one margin, its factors joined back, and a checkpoint; only how far the probabilities moved
    comes to the driver. Sums are partial before the shuffle; of a join's hot category the rows are split by adaptive execution.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.withColumn("chance", F.lit(float(budget)))
    wishes = {m: wish_table(cells, m, given.get(m), temper, total, budget) for m in MARGINS}
    now = cells.withColumn("chance", F.lit(float(budget)))
    for _ in range(ROUNDS):
        moved = 0.0
        for margin in MARGINS:
            for _ in range(50):
                have = now.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("chance")).alias("have")).join(wishes[margin], margin)
                factors = have.select(margin, F.when(F.col("have") > 0, F.col("wish") / F.col("have")).otherwise(1.0).alias("factor"))
                scaled = now.join(factors, margin).withColumn("was", F.col("chance")).withColumn("scaled", F.col("chance") * F.col("factor"))
                scaled = settle(scaled.withColumn("chance", F.least(F.lit(1.0), "scaled")))
                step, most = scaled.agg(F.max(F.abs(F.col("chance") - F.col("was"))), F.max("scaled")).first()
                now = scaled.select(*MARGINS, "tokens", "chance")
                moved = max(moved, step)
                # Where no probability was cut to one, the margin is met.
                if most <= 1 or step < TABLE_TOLERANCE:
                    break
        if moved < TABLE_TOLERANCE:
            break
    return now


def mixed(
    docs: DataFrame,
    source: str = "source",
    lang: str = "lang",
    text: str = "text",
    key: str = "doc_id",
    topic: Column | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    temper: float = TEMPER,
    budget: float = BUDGET,
    seed: int = 0,
    name: str = "mix",
) -> DataFrame:
    """Every row of ``docs`` with one more column ``name``: a struct of tokens, topic, weight, probability and sampled.

    weight tells how much more of the cell than of the average token is drawn; probability is the calibrated one, sampled
    the outcome. ``targets`` gives shares by margin ("source", "lang", "topic") and value; a margin without them gets its own
    shares to the power of ``temper``, and ``budget`` is the part of all tokens that is drawn. Every value that ``targets`` names
    keeps its target; the values it does not name share one category, whose target is what the others leave. In a margin without
    targets every value is a category. Null values are a category of their own. Rows of one id share their fate; a document
    without words is drawn like its cell. An empty table gives an empty one. Probabilities of more than DRIVER_CELLS cells have
    settled to TABLE_TOLERANCE.
    """
    spark = docs.sparkSession
    body = docs[q(text)]
    values = {"source": docs[q(source)].cast("string"), "lang": docs[q(lang)].cast("string"), "topic": topic if topic is not None else topic_of(body)}
    tokens = words_in(body)
    cells = docs.select(*[v.alias(k) for k, v in values.items()], tokens.alias("tokens"))
    given = dict(targets or {})
    labels = {m: _category(F.col(m), given.get(m)) for m in MARGINS}
    table = land(cells.groupBy(*[c.alias(m) for m, c in labels.items()]).agg(F.sum("tokens").alias("tokens")), "cells")
    count, letters = table.agg(F.count("*"), F.sum(F.octet_length(F.concat(*MARGINS)))).first()
    if count <= DRIVER_CELLS:
        rows = sorted(table.collect())
        chance = rake_arrays(rows, given, temper, budget)
        known = spark.createDataFrame(
            [(r["source"], r["lang"], r["topic"], float(p)) for r, p in zip(rows, chance, strict=True)],
            "source string, lang string, topic string, chance double",
        )
    else:
        known = rake_table(table, given, temper, budget).select(*MARGINS, "chance")
    cell = free_name("cell", docs.columns)
    share = F.shiftrightunsigned(F.xxhash64(docs[q(key)], F.lit(seed)), 11) / F.lit(2.0**53)
    facts = [_category(values[m], given.get(m)).alias(m) for m in MARGINS]
    facts += [values["topic"].alias("own_topic"), tokens.alias("tokens"), share.alias("share")]
    marked = docs.select("*", F.struct(*facts).alias(cell))
    of = lambda field: marked[cell].getField(field)
    # A table too large to go to every task meets the rows by a shuffle, hot cells split by adaptive execution.
    known = broadcast_if(known, (letters or 0) + 64 * count)
    joined = marked.join(known, [of(m) == known[m] for m in MARGINS])
    mix = F.struct(
        of("tokens").alias("tokens"),
        of("own_topic").alias("topic"),
        (known["chance"] / F.lit(float(budget))).alias("weight"),
        known["chance"].alias("probability"),
        (of("share") < known["chance"]).alias("sampled"),
    )
    return joined.select(*[marked[q(c)] for c in docs.columns], mix.alias(name))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, longer where a column has it already."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, as they are."""
    name = free_name("mix", docs.columns)
    drawn = mixed(docs, name=name, **options)
    return drawn.where(drawn[name].getField("sampled")).select(*[drawn[q(c)] for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its topic, probability and outcome."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mixed(docs).select("doc_id", "source", "lang", "mix.*")
