"""Weighted subsets under a count and a cost condition, exactly, by convolution.

A subset has a probability proportional to the product of its weights, given that it
holds a quota of every stratum and that its whole cost lies in a band. Nothing is
drawn and rejected, so that rare conditions cost no more than common ones.

* Items of one stratum and cost form a class. A class is a tree over the bits of its
  items' hashes; a node's polynomial, the weight of all its subsets by their size, is
  the product of its children's. Nodes are made level by level, bottom up, each from
  its bounded number of children.
* Classes are few: strata times costs. Their polynomials reach the driver, where
  tables of weight by count and cost are convolved, class by class and then stratum
  by stratum.
* A draw goes back down: its cost, what every stratum costs, how many items of every
  class, and then how many below every child of a node, by one join per level.
  Inclusion probabilities go down in the same way, with distributions for draws.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.guards import ContractError, require_no_rows, require_unique
from tidemark.session import checkpointed

# A node has about as many children; the last one's are items.
FAN_BITS = 7


@dataclass
class CostLaw:
    """Tables of weight by count and cost, from the classes of every stratum."""

    quotas: dict
    costs: dict  # stratum -> costs of its classes
    classes: dict  # stratum -> (class, count) weights
    before: dict  # stratum -> (classes + 1, count, cost) weights of the classes before each
    joined: np.ndarray  # (strata + 1, cost) weights of the strata before each

    @property
    def strata(self) -> list:
        return list(self.quotas)

    def weight(self) -> float:
        return float(self.joined[-1].sum())


def _shifted(table: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(table)
    if by < table.shape[-1]:
        out[..., by:] = table[..., :table.shape[-1] - by]
    return out


def _with_class(table: np.ndarray, weights: np.ndarray, cost: int) -> np.ndarray:
    """A (count, cost) table after one more class."""
    out = np.zeros_like(table)
    for taken in range(table.shape[0]):
        moved = _shifted(table, taken * cost) * weights[taken]
        out[taken:] += moved[:table.shape[0] - taken]
    return out


def cost_law(rows: list, quotas: Mapping, low: int, high: int) -> CostLaw:
    """The law of a cost between ``low`` and ``high``, from (stratum, cost, polynomial) rows."""
    costs, classes, before = {}, {}, {}
    joined = np.zeros((len(quotas) + 1, high + 1))
    joined[0, 0] = 1.0
    for i, (stratum, quota) in enumerate(quotas.items()):
        mine = sorted((r[1], r[2]) for r in rows if r[0] == stratum)
        costs[stratum] = [c for c, _ in mine]
        classes[stratum] = np.array([list(p)[:quota + 1] for _, p in mine]).reshape(len(mine), quota + 1)
        table = np.zeros((quota + 1, high + 1))
        table[0, 0] = 1.0
        tables = [table]
        for cost, weights in zip(costs[stratum], classes[stratum]):
            table = _with_class(table, weights, cost)
            tables.append(table)
        before[stratum] = np.array(tables)
        whole = table[quota]
        # Only ratios count; without this many strata would overflow.
        scale = whole.max() or 1.0
        joined[i + 1] = np.convolve(joined[i], whole / scale)[:high + 1]
    joined[-1, :max(0, low)] = 0.0
    if not np.isfinite(joined).all() or joined[-1].sum() <= 0:
        raise ContractError("no subset meets the quotas and the cost band")
    return CostLaw(dict(quotas), costs, classes, before, joined)


def _pick(weights: np.ndarray, source: np.random.Generator) -> int:
    total = np.cumsum(weights)
    return int(min(np.searchsorted(total, source.random() * total[-1], side="right"), len(weights) - 1))


def draw_counts(law: CostLaw, source: np.random.Generator) -> Iterator[tuple[int, int, int]]:
    """(number of the stratum, cost, items) of one draw."""
    left = _pick(law.joined[-1], source)
    for i in reversed(range(len(law.strata))):
        stratum = law.strata[i]
        quota, tables = law.quotas[stratum], law.before[stratum]
        # What this stratum costs, given what it and those before it cost.
        spent = _pick(tables[-1][quota][:left + 1] * law.joined[i][:left + 1][::-1], source)
        count, cost = quota, spent
        for j in reversed(range(len(law.costs[stratum]))):
            if not count:
                break
            price = law.costs[stratum][j]
            ways = np.array([tables[j][count - t, cost - t * price] * law.classes[stratum][j][t] if t * price <= cost else 0.0
                             for t in range(count + 1)])
            taken = _pick(ways, source)
            if taken:
                yield i, price, taken
            count, cost = count - taken, cost - taken * price
        left -= spent


def class_counts(law: CostLaw) -> list[tuple[int, int, list[float]]]:
    """(number of the stratum, cost, probability of every count) of every class."""
    out, strata = [], law.strata
    high = law.joined.shape[1] - 1
    # Weight of the strata behind each, for every cost of those before and itself.
    after = (law.joined[-1] > 0).astype(float)
    behind = [np.zeros(0)] * len(strata)
    for i in reversed(range(len(strata))):
        behind[i] = after
        whole = law.before[strata[i]][-1][law.quotas[strata[i]]]
        after = np.array([float(whole[:high + 1 - c] @ after[c:]) for c in range(high + 1)])
    for i, stratum in enumerate(strata):
        quota, tables = law.quotas[stratum], law.before[stratum]
        rest = np.array([float(law.joined[i][:high + 1 - c] @ behind[i][c:]) for c in range(high + 1)])
        # Weight of the classes behind each, by count and cost of those before it.
        later = np.zeros((quota + 1, high + 1))
        later[quota] = rest
        found = []
        for j in reversed(range(len(law.costs[stratum]))):
            price, weights = law.costs[stratum][j], law.classes[stratum][j]
            chances, earlier = [], np.zeros_like(later)
            for t in range(quota + 1):
                reach = high + 1 - t * price
                if reach <= 0:
                    chances.append(0.0)
                    continue
                next_ = later[t:, t * price:] * weights[t]
                chances.append(float((tables[j][:quota + 1 - t, :reach] * next_).sum()))
                earlier[:quota + 1 - t, :reach] += next_
            total = sum(chances)
            found.append((i, price, [c / total for c in chances]))
            later = earlier
        out += reversed(found)
    return out


def _items(pool: DataFrame, stratum: str, item: str, weight: Column, cost: Column, quotas: Mapping, high: int) -> DataFrame:
    """(s, c, i, w): usable items, weights relative to the largest of their stratum."""
    rows = pool.filter(F.col(stratum).isin(*quotas)).select(
        F.col(stratum).alias("s"), cost.cast("bigint").alias("c"), F.col(item).alias("i"), weight.cast("double").alias("w"))
    rows = rows.filter((F.col("w") > 0) & (F.col("w") < math.inf) & F.col("i").isNotNull())
    require_no_rows(rows.filter("c IS NULL OR c < 0"), "items without a cost")
    require_unique(rows, ["i"], "pool")
    rows = rows.filter(F.col("c") <= high)
    most = rows.groupBy("s").agg(F.max("w").alias("m"))
    return rows.join(most, "s").select("s", "c", "i", (F.col("w") / F.col("m")).alias("w"))


def _product(polynomials: str, size: int) -> Column:
    """The product of a list of polynomials, up to the power ``size``."""
    def times(a: Column, b: Column) -> Column:
        return F.array(*[sum((a[i] * b[k - i] for i in range(1, k + 1)), a[0] * b[k]) for k in range(size + 1)])

    one = F.array(*[F.lit(1.0 if k == 0 else 0.0) for k in range(size + 1)])
    return F.aggregate(F.transform(polynomials, lambda child: child["p"]), one, times)


def _trees(items: DataFrame, size: int) -> list[DataFrame]:
    """Levels of nodes (s, c, node, children[(child, p)], p), from the classes down.

    The last level's children are items. There are as many levels as the largest
    class needs; hashes spread its items evenly.
    """
    largest = items.groupBy("s", "c").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    depth = max(0, math.ceil((math.log2(largest) - FAN_BITS) / FAN_BITS))
    hashed = items.withColumn("h", F.xxhash64("i"))

    def node(level: int) -> Column:
        return F.shiftrightunsigned("h", 64 - FAN_BITS * level) if level else F.lit(0).cast("bigint")

    single = F.array(F.lit(1.0), F.col("w"), *[F.lit(0.0)] * (size - 1))
    rows = hashed.withColumn("node", node(depth)).select("s", "c", "node", F.struct(F.col("i").alias("child"), single.alias("p")).alias("e"))
    levels: list[DataFrame] = []
    for level in reversed(range(depth + 1)):
        made = rows.groupBy("s", "c", "node").agg(F.sort_array(F.collect_list("e")).alias("children"))
        made = checkpointed(made.withColumn("p", _product("children", size)))
        levels.insert(0, made)
        rows = made.select("s", "c", (F.shiftrightunsigned("node", FAN_BITS) if level > 1 else F.lit(0).cast("bigint")).alias("node"),
                           F.struct(F.col("node").alias("child"), "p").alias("e"))
    return levels


def _prepared(
    pool: DataFrame, stratum: str, item: str, weight: Column, cost: Column, quotas: Mapping, low: int, high: int
) -> tuple[CostLaw, list[DataFrame]]:
    if not quotas or min(quotas.values()) < 1 or high < max(low, 0):
        raise ContractError("quotas must be positive and the band must not be empty")
    levels = _trees(_items(pool, stratum, item, weight, cost, quotas, high), max(quotas.values()))
    # One row per stratum and cost.
    rows = [(r["s"], r["c"], r["p"]) for r in levels[0].select("s", "c", "p").collect()]
    return cost_law(rows, quotas, low, high), levels


def _suffixes(polynomials: np.ndarray) -> np.ndarray:
    """The product of the children from each one on."""
    out = np.zeros((len(polynomials) + 1, polynomials.shape[1]))
    out[-1, 0] = 1.0
    for j in reversed(range(len(polynomials))):
        out[j] = np.convolve(out[j + 1], polynomials[j])[:polynomials.shape[1]]
    return out


def _split(children: list[dict], count: int, seed: int) -> list[tuple[object, int]]:
    """How many of ``count`` items lie below each child."""
    source = np.random.default_rng(seed & ((1 << 63) - 1))
    polynomials = np.array([c["p"] for c in children])
    behind, out = _suffixes(polynomials), []
    for j, child in enumerate(children):
        if not count:
            break
        taken = _pick(polynomials[j][:count + 1] * behind[j + 1][count::-1], source)
        if taken:
            out.append((child["child"], taken))
        count -= taken
    return out


def _shares(children: list[dict], chances: list[float]) -> list[tuple[object, list[float]]]:
    """The distribution of the items below each child, given that of the node."""
    polynomials = np.array([c["p"] for c in children])
    size = polynomials.shape[1]
    behind, before = _suffixes(polynomials), np.eye(1, size)[0]
    whole, out = behind[0], []
    given = np.array([chances[k] / whole[k] if k < len(chances) and whole[k] > 0 else 0.0 for k in range(size)])
    for j, child in enumerate(children):
        others = np.convolve(before, behind[j + 1])[:size]
        mine = [float(polynomials[j][t] * (given[t:] @ others[:size - t])) for t in range(size)]
        out.append((child["child"], mine))
        before = np.convolve(before, polynomials[j])[:size]
    return out


def _down(state: DataFrame, levels: list[DataFrame], given: str, kind: T.DataType, split) -> DataFrame:
    """From classes to items: ``given`` of a node is split over its children, level by level."""
    keep = [f for f in state.schema.fields if f.name not in ("node", given)]
    for level, nodes in enumerate(levels):
        child = nodes.schema["children"].dataType.elementType["child"].dataType
        name = "item" if level + 1 == len(levels) else "node"
        schema = T.StructType([*keep, T.StructField(name, child), T.StructField(given, kind)])
        arrow = to_arrow_schema(schema)

        def run(batches: Iterator[pa.RecordBatch], name=name, arrow=arrow) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    out = [{**{f.name: row[f.name] for f in keep}, name: c, given: v} for c, v in split(row)]
                    if out:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)

        state = state.join(nodes.select("s", "c", "node", "children"), ["s", "c", "node"]).mapInArrow(run, schema)
    return state


def conditioned_subsets(
    pool: DataFrame, stratum: str, item: str, weight: Column, cost: Column, quotas: Mapping, low: int, high: int,
    draws: int, seed: int,
) -> DataFrame:
    """Independent subsets: rows (draw, stratum, item), ``quotas`` of every stratum per draw.

    The probability of a subset is proportional to the product of its weights, among
    all that hold the quotas and cost ``low`` to ``high`` in all. ``cost`` is a whole
    number of steps. Items without a positive, finite weight are never drawn. A pool
    that repeats an item, and conditions that no subset meets, fail. Draws depend on
    the seed and their number alone. ``high`` and the quotas bound the driver's tables.
    """
    law, levels = _prepared(pool, stratum, item, weight, cost, quotas, low, high)
    strata = law.strata
    kind = pool.schema[stratum].dataType
    schema = T.StructType([
        T.StructField("draw", T.LongType()), T.StructField("s", kind), T.StructField("c", T.LongType()),
        T.StructField("node", T.LongType()), T.StructField("k", T.LongType())])
    arrow = to_arrow_schema(schema)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"draw": d, "s": strata[i], "c": c, "node": 0, "k": k} for d in batch.column("id").to_pylist()
                    for i, c, k in draw_counts(law, np.random.default_rng([seed, d]))]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def split(row: dict) -> list[tuple[object, int]]:
        return _split(row["children"], row["k"], row["r"])

    state = pool.sparkSession.range(draws).mapInArrow(classes, schema)
    for level, nodes in enumerate(levels):
        marked = state.withColumn("r", F.xxhash64(F.lit(int(seed)), "draw", "s", "c", "node", F.lit(level)))
        state = _down(marked, [nodes], "k", T.LongType(), split).drop("r")
        if level + 1 < len(levels):
            state = state.withColumnRenamed("item", "node")
    return state.select("draw", F.col("s").alias(stratum), F.col("item").alias(item))


def conditioned_inclusion(
    pool: DataFrame, stratum: str, item: str, weight: Column, cost: Column, quotas: Mapping, low: int, high: int,
) -> DataFrame:
    """(stratum, item, probability) that a subset of :func:`conditioned_subsets` holds an item."""
    law, levels = _prepared(pool, stratum, item, weight, cost, quotas, low, high)
    strata, size = law.strata, max(quotas.values()) + 1
    rows = [(strata[i], c, 0, chances + [0.0] * (size - len(chances))) for i, c, chances in class_counts(law)]
    kind = pool.schema[stratum].dataType
    chances = T.ArrayType(T.DoubleType())
    state = pool.sparkSession.createDataFrame(rows, T.StructType([
        T.StructField("s", kind), T.StructField("c", T.LongType()), T.StructField("node", T.LongType()),
        T.StructField("k", chances)]))
    found = _down(state, levels, "k", chances, lambda row: _shares(row["children"], row["k"]))
    return found.select(F.col("s").alias(stratum), F.col("item").alias(item), F.col("k")[1].alias("probability"))
