"""Selling prices, budgets, the best single swap and transfer summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tidemark.functions.numeric import ticks
from tidemark.operators.guards import ContractError, require_no_rows
from tidemark.operators.rules import SquadRules
from tidemark.session import ship

PRICE_SCALE = 10
# Entries of a short list that are tried one by one before the rest is searched.
TRIED = 6
# Members of changed squads that a task values at a time; one squad's option may have more.
VALUED = 1 << 18


def selling_prices(
    squads: DataFrame, prices: DataFrame, squad_id: str = "squad_id",
) -> DataFrame:
    """Sell value of each member in ticks and how it was obtained.

    A stated selling price wins. Otherwise a purchase price gives the purchase
    value plus half of any rise, rounded down to a tick. Otherwise the current
    price stands in. ``squads`` may have ``selling_prices`` and
    ``purchase_prices`` maps keyed by member id.
    """
    def price_map(name: str) -> Column:
        if name in squads.columns:
            return F.col(name)
        return F.lit(None).cast("map<bigint,double>")

    rows = squads.select(
        squad_id, F.explode("player_ids").alias("player_id"),
        price_map("selling_prices").alias("__sell"), price_map("purchase_prices").alias("__buy"),
    ).select(
        squad_id, "player_id",
        F.try_element_at("__sell", F.col("player_id")).alias("__stated"),
        F.try_element_at("__buy", F.col("player_id")).alias("__paid"),
    )
    priced = rows.join(prices.select("player_id", "price"), "player_id", "left")
    now = F.round(F.col("price") * PRICE_SCALE).cast("bigint")
    paid = F.round(F.col("__paid") * PRICE_SCALE).cast("bigint")
    rebuilt = F.when(now <= paid, now).otherwise(
        paid + F.floor((now - paid) / F.lit(2)).cast("bigint"))
    stated = F.round(F.col("__stated") * PRICE_SCALE).cast("bigint")
    return priced.select(
        squad_id, "player_id", now.alias("price_ticks"),
        F.coalesce(stated, rebuilt, now).alias("sell_ticks"),
        F.when(F.col("__stated").isNotNull(), F.lit("stated"))
        .when(F.col("__paid").isNotNull(), F.lit("reconstructed"))
        .otherwise(F.lit("approximated")).alias("basis"),
    )


def budgets(
    squads: DataFrame, sells: DataFrame, rules: SquadRules, squad_id: str = "squad_id",
    explicit: float | None = None,
) -> DataFrame:
    """Money each squad may hold, in price units.

    In order: an explicit amount; the squad's own limit; its selling value plus
    its bank; plus, for squads entered by hand or read from a picture, what the
    current prices leave of the starting budget; else the selling value alone.
    """
    if explicit is not None:
        if explicit <= 0:
            raise ContractError("budget must be positive")
        return squads.select(squad_id, F.lit(float(explicit)).alias("budget"))
    value = sells.groupBy(squad_id).agg(
        (F.sum("sell_ticks") / float(PRICE_SCALE)).alias("__sale"),
        (F.sum("price_ticks") / float(PRICE_SCALE)).alias("__cost"),
    )

    def optional(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in squads.columns else F.lit(None).cast(kind)

    left = F.greatest(F.lit(float(rules.budget)) - F.col("__cost"), F.lit(0.0))
    bank = F.coalesce(
        optional("bank", "double"),
        F.when(optional("source", "string").isin("manual", "screenshot"), left), F.lit(0.0))
    return squads.join(value, squad_id, "left").select(
        squad_id,
        F.coalesce(optional("budget_limit", "double"), F.col("__sale") + bank,
                   F.lit(float(rules.budget))).alias("budget"),
    )


def selectable(pool: DataFrame, holdings: DataFrame | None = None) -> DataFrame:
    """Players that may be picked: not barred (NULL allows), or already held."""
    allowed = F.coalesce(F.col("can_select"), F.lit(True))
    if holdings is None:
        return pool.filter(allowed)
    held = holdings.select("player_id").distinct().withColumn("__held", F.lit(True))
    return pool.join(held, "player_id", "left").filter(
        allowed | F.coalesce("__held", F.lit(False))).drop("__held")


def _blocks_of(tick: Column, levels: int) -> Column:
    """The power-of-two price blocks a tick belongs to, one per level."""
    return F.array(*[
        F.struct(F.lit(level).alias("level"), F.shiftright(tick, level).alias("block"))
        for level in range(levels + 1)
    ])


def _blocks_upto(limit: Column, levels: int) -> Column:
    """Blocks that together cover exactly the ticks ``0..limit``."""
    count = limit + 1
    pieces = []
    for level in range(levels + 1):
        bit = F.shiftright(count, level)
        pieces.append(F.when(
            bit % 2 == 1, F.struct(F.lit(level).alias("level"), (bit - 1).alias("block"))))
    return F.array_compact(F.array(*pieces))


def best_replacements(
    members: DataFrame, pool: DataFrame, max_price: int, max_per_club: int,
    squad_id: str = "squad_id",
) -> DataFrame:
    """For each member, the best affordable same-position player to swap in.

    ``members``: squad_id, player_id, position_id, club_id, limit_ticks (the most
    that may be paid). ``pool``: player_id, position_id, club_id, price_ticks,
    points. Best means most points, then lower id. The newcomer must not be in
    the squad and must not break the club cap.

    Members are not paired with all players of their position. Prices are whole
    ticks; each player enters the power-of-two price blocks that contain its
    price, and a block keeps only its best players. The few blocks that make up
    ``0..limit`` give the short list of a limit. A squad of n players rules out at most
    n players by holding them and ``n // max_per_club`` clubs by the cap, so the best
    ``max_per_club + 1`` players of the best ``n // max_per_club + n + 1`` clubs of a
    block always contain the answer. n is the largest squad's size, counted first:
    short lists lose nothing and no squad is left out.
    """
    sizes = members.groupBy(squad_id).agg(F.count("*").alias("n"))
    squad_size = sizes.agg(F.max("n")).first()[0] or 0
    levels = max(1, int(max_price).bit_length())
    per_club = squad_size + 1 if max_per_club >= squad_size else max_per_club + 1
    clubs = squad_size // max_per_club + squad_size + 1
    require_no_rows(pool.filter((F.col("price_ticks") < 0) | (F.col("price_ticks") > max_price))
                    .select("player_id", "price_ticks"), "prices outside 0..max_price")
    entries = pool.select(
        "position_id", "club_id", F.col("points").cast("double").alias("points"), "player_id",
        F.explode(_blocks_of(F.col("price_ticks").cast("bigint"), levels)).alias("__b"),
    ).select("position_id", "club_id", "points", "player_id", "__b.level", "__b.block")

    def shortlist(rows: DataFrame, cell: list[str]) -> DataFrame:
        in_club = Window.partitionBy(*cell, "club_id").orderBy(
            F.desc("points"), F.asc("player_id"))
        kept = rows.withColumn("__r", F.row_number().over(in_club)).filter(
            F.col("__r") <= per_club)
        lead = Window.partitionBy(*cell, "club_id").orderBy("__r")
        by_lead = Window.partitionBy(*cell).orderBy(
            F.desc("__lead.points"), F.asc("__lead.player_id"))
        ranked = kept.withColumn(
            "__lead", F.first(F.struct("points", "player_id")).over(lead)
        ).withColumn("__c", F.dense_rank().over(by_lead))
        return ranked.filter(F.col("__c") <= clubs).drop("__r", "__lead", "__c")

    blocks = shortlist(entries, ["position_id", "level", "block"])
    packed = members.select(
        squad_id, "player_id", "position_id", "club_id",
        F.least(F.col("limit_ticks").cast("bigint"), F.lit(max_price)).alias("__limit"),
    ).groupBy(squad_id).agg(F.collect_list(F.struct(
        "player_id", "position_id", "club_id", "__limit")).alias("__m"))
    # Clubs at the cap are closed, unless the leaving member opens a place. They are looked
    # for only where members share clubs enough.
    clubs_of = "array_distinct(__m.club_id)"
    taken = "size(filter(__m, m -> m.club_id = c))"

    def clubs_with(holds: str) -> Column:
        return F.expr(f"CASE WHEN size(__m) - size({clubs_of}) + 1 >= {max_per_club} THEN filter({clubs_of}, "
                      f"c -> {taken} {holds} {max_per_club}) ELSE slice(__m.club_id, 1, 0) END")

    limited = packed.select(
        squad_id, F.col("__m.player_id").alias("__held"), clubs_with(">").alias("__over"),
        clubs_with("=").alias("__at_cap"), F.inline("__m"))
    # Each (position, limit) is resolved once, however many members ask for it.
    asked = limited.select("position_id", "__limit").distinct().select(
        "position_id", "__limit",
        F.explode(_blocks_upto(F.col("__limit"), levels)).alias("__b"),
    ).select("position_id", "__limit", "__b.level", "__b.block")
    cheap = asked.join(blocks, ["position_id", "level", "block"]).select(
        "position_id", "__limit", "club_id", "points", "player_id")
    lists = shortlist(cheap, ["position_id", "__limit"]).groupBy("position_id", "__limit").agg(
        F.sort_array(F.collect_list(F.struct(
            "points", (-F.col("player_id")).alias("minus_id"), "club_id")), False).alias("__list"))
    met = limited.join(lists, ["position_id", "__limit"])
    # The best entry that fits is the first of the sorted list, mostly among its first few.
    fits = ("NOT array_contains(__held, -{0}.minus_id) AND NOT array_contains(__over, {0}.club_id) "
            "AND ({0}.club_id = club_id OR NOT array_contains(__at_cap, {0}.club_id))")
    tried = [f"CASE WHEN {fits.format(f'get(__list, {i})')} THEN get(__list, {i}) END"
             for i in range(TRIED)]
    rest = f"get(filter(__list, e -> {fits.format('e')}), 0)"
    pick = F.expr(f"inline(array_compact(array(coalesce({', '.join(tried)}, {rest}))))")
    return met.select(squad_id, "player_id", pick).select(
        squad_id, F.col("player_id").alias("out_id"), (-F.col("minus_id")).alias("in_id"),
        F.col("points").alias("in_points"), F.col("club_id").alias("in_club"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.StructArray]:
    """Sizes of the lists (0 for null) and their entries."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return sizes, lists.flatten()


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values, 0 where null, and which are null."""
    return (column.fill_null(0).to_numpy(zero_copy_only=False),
            column.is_null().to_numpy(zero_copy_only=False))


def option_values(
    sizes: np.ndarray, position: np.ndarray, points: np.ndarray, rules: SquadRules,
    bench_weight: float,
) -> tuple[np.ndarray, np.ndarray]:
    """``w * squad + (1 - w) * line-up + captain`` of the best formation, and if there is one.

    Squads follow each other with ``sizes`` members each (at least one); ``position``
    is the place in ``rules.positions`` or -1. Each formation is valued with the best
    starter of its positions as captain.
    """
    n, kinds = len(sizes), len(rules.positions)
    most = max(p.maximum_starters for p in rules.positions)
    everyone = np.add.reduceat(points, np.cumsum(sizes) - sizes)
    squad = np.repeat(np.arange(n), sizes)
    group = squad * kinds + position
    known = position >= 0
    group, ranked = group[known], points[known]
    order = np.lexsort((-ranked, group))
    group, ranked = group[order], ranked[order]
    counts = np.bincount(group, minlength=n * kinds)
    rank = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    top = np.zeros((n * kinds, most))
    starts = rank < most
    top[group[starts], rank[starts]] = ranked[starts]
    heads = top[:, 0].reshape(n, kinds) if most else np.zeros((n, kinds))
    sums = np.concatenate([np.zeros((n * kinds, 1)), np.cumsum(top, axis=1)], axis=1)
    sums, counts = sums.reshape(n, kinds, most + 1), counts.reshape(n, kinds)
    best, fielded = np.full(n, -np.inf), np.zeros(n, dtype=bool)
    for formation in rules.formations():
        full = (counts >= np.array(formation)).all(axis=1)
        eleven = sum(sums[:, i, c] for i, c in enumerate(formation))
        captain = np.max([heads[:, i] for i, c in enumerate(formation) if c], axis=0)
        value = (1.0 - bench_weight) * eleven + captain
        best = np.where(full, np.maximum(best, value), best)
        fielded |= full
    return bench_weight * everyone + best, fielded


def _valued(
    batches: Iterator[pa.RecordBatch], rules: SquadRules, bench_weight: float, hits: tuple[float, float],
) -> Iterator[pa.RecordBatch]:
    """Every squad with its options' objectives: of no swap first, then of each offer.

    An objective is null if a member has no points or no formation can be fielded.
    """
    for batch in batches:
        m_size, m = _flat(batch.column("__m"))
        o_size, o = _flat(batch.column("__offers"))
        (m_id, m_none), (place, _) = _numbers(m.field("id")), _numbers(m.field("place"))
        points, unknown = _numbers(m.field("points"))
        (gone, kept), (gain, unsure) = _numbers(o.field("out_id")), _numbers(o.field("in_points"))
        m_start, o_start = np.cumsum(m_size) - m_size, np.cumsum(o_size) - o_size
        options = o_size + 1
        squad = np.repeat(np.arange(len(m_size)), options)
        nth = np.arange(len(squad)) - np.repeat(np.cumsum(options) - options, options)
        offer = np.where(nth > 0, o_start[squad] + nth - 1, -1)
        objective, valid = np.zeros(len(squad)), np.zeros(len(squad), dtype=bool)
        ends = np.cumsum(m_size[squad])
        at = 0
        while at < len(squad):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + VALUED, "right")))
            size, swap = m_size[squad[at:stop]], offer[at:stop]
            member = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(
                m_start[squad[at:stop]], size)
            mine = np.repeat(swap, size)
            replaced = np.zeros(len(mine), dtype=bool)
            if len(gone):
                replaced = (mine >= 0) & ~kept[mine] & ~m_none[member] & (m_id[member] == gone[mine])
            after, missing = points[member], unknown[member]
            after[replaced], missing[replaced] = gain[mine[replaced]], unsure[mine[replaced]]
            value, fielded = option_values(size, place[member], after, rules, bench_weight)
            swaps = (swap >= 0) & ~kept[swap] if len(gone) else np.zeros(len(swap), dtype=bool)
            objective[at:stop] = value - np.where(swaps, hits[1], hits[0])
            valid[at:stop] = fielded & ~np.logical_or.reduceat(missing, np.cumsum(size) - size)
            at = stop
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(options)), pa.int32()), pa.array(objective, mask=~valid))
        yield pa.RecordBatch.from_arrays(
            [batch.column("__squad"), batch.column("__offers"), lists], ["__squad", "__offers", "__worth"])


def best_single_swap(
    members: DataFrame, pool: DataFrame, rules: SquadRules, squad_budget: DataFrame,
    max_price: int, squad_id: str = "squad_id", bench_weight: float = 0.1,
    free_transfers: int = 1, hit_cost: float = 4.0,
) -> DataFrame:
    """The best of "no swap" and every legal single swap, per squad.

    Position quotas force a swap within a position, and the value of a squad
    never falls when a member gets more points. So for a given member leaving,
    the best affordable newcomer is the one with most points, and only
    ``squad_size + 1`` options per squad are valued in full.

    ``members``: squad_id, player_id, position_id, club_id, sell_ticks, points.
    ``squad_budget``: squad_id, budget. Returns squad_id, out_id, in_id (both NULL for
    no swap), the objective, and what the squad is worth ``without`` a swap. Options
    that differ by less than 1e-9 tie: no swap first, then the lowest ids.
    """
    money = members.groupBy(squad_id).agg(F.sum("sell_ticks").alias("__held_ticks")).join(
        squad_budget.select(squad_id, ticks(F.round("budget", 1)).alias("__budget")), squad_id)
    spendable = members.join(money, squad_id).withColumn(
        "limit_ticks", F.col("__budget") - F.col("__held_ticks") + F.col("sell_ticks"))
    offers = best_replacements(
        spendable.filter("limit_ticks >= 0"), pool, max_price, rules.max_per_club, squad_id)
    place = F.lit(-1)
    for i, p in reversed(list(enumerate(rules.positions))):
        place = F.when(F.col("position_id") == F.lit(p.position_id), i).otherwise(place)
    packed = members.groupBy(squad_id).agg(F.collect_list(F.struct(
        F.col("player_id").cast("bigint").alias("id"), place.alias("place"),
        F.col("points").cast("double").alias("points"))).alias("__m"))
    choices = offers.groupBy(squad_id).agg(F.collect_list(F.struct(
        F.col("out_id").cast("bigint").alias("out_id"), F.col("in_id").cast("bigint").alias("in_id"),
        "in_points")).alias("__offers"))
    options = packed.join(choices, squad_id, "left").select(
        F.col(squad_id).alias("__squad"), "__m", F.coalesce("__offers", F.array().cast(
            "array<struct<out_id:bigint,in_id:bigint,in_points:double>>")).alias("__offers"))
    hits = tuple(max(count - free_transfers, 0) * float(hit_cost) for count in (0, 1))
    schema = StructType([options.schema["__squad"], options.schema["__offers"],
                         StructField("__worth", ArrayType(DoubleType()))])
    ship(options.sparkSession)
    valued = options.mapInArrow(lambda rows: _valued(rows, rules, bench_weight, hits), schema)
    every = F.expr(
        "filter(transform(__worth, (w, i) -> named_struct('worth', round(w, 9), "
        "'minus_in', coalesce(-get(__offers, i - 1).in_id, 0), "
        "'minus_out', coalesce(-get(__offers, i - 1).out_id, 0), "
        "'out_id', get(__offers, i - 1).out_id, 'in_id', get(__offers, i - 1).in_id, "
        "'objective', w)), o -> o.objective IS NOT NULL)")
    picked = valued.select("__squad", every.alias("__all")).select(
        F.col("__squad").alias(squad_id), F.array_max("__all").alias("__w"), F.array_max(F.expr(
            "transform(filter(__all, o -> o.out_id IS NULL), o -> o.objective)")).alias("without"))
    return picked.filter("__w IS NOT NULL").select(
        squad_id, "__w.out_id", "__w.in_id", "__w.objective", "without")


def transfer_summary(
    changes: DataFrame, players: DataFrame, points: str, before: str = "before_ids",
    after: str = "after_ids", squad_id: str = "squad_id", free_transfers: int = 1,
    hit_cost: float = 4.0, gain: str | None = None,
) -> DataFrame:
    """Players in and out per squad with price and point sums, hit and gains.

    ``changes`` has both id arrays, and optionally the projected gain of the
    whole squad, which differs from the sum over players when the line-up moves.
    """
    moves = changes.select(
        squad_id, F.array_sort(F.array_except(after, before)).alias("transfers_in"),
        F.array_sort(F.array_except(before, after)).alias("transfers_out"),
        *([F.col(gain).alias("__gain")] if gain else []),
    )
    tagged = moves.select(squad_id, F.explode(F.concat(
        F.transform("transfers_in", lambda i: F.struct(i.alias("player_id"), F.lit(1).alias("s"))),
        F.transform("transfers_out", lambda i: F.struct(i.alias("player_id"), F.lit(-1).alias("s"))),
    )).alias("__t")).select(squad_id, "__t.*")
    joined = tagged.join(players.select("player_id", "price", F.col(points).alias("__p")),
                         "player_id", "left")

    def total(column: str, sign: int) -> Column:
        return F.sum(F.when(F.col("s") == sign, F.coalesce(F.col(column), F.lit(0.0)))
                     .otherwise(0.0))

    sums = joined.groupBy(squad_id).agg(
        total("price", 1).alias("incoming_price"), total("price", -1).alias("outgoing_price"),
        total("__p", 1).alias("incoming_points"), total("__p", -1).alias("outgoing_points"))
    out = moves.join(sums, squad_id, "left").fillna(
        0.0, ["incoming_price", "outgoing_price", "incoming_points", "outgoing_points"])
    paid = F.greatest(F.size("transfers_in") - free_transfers, F.lit(0))
    hit = (paid * F.lit(float(hit_cost))).cast("double")
    gross = F.col("__gain") if gain else F.col("incoming_points") - F.col("outgoing_points")
    return out.withColumns({
        "price_difference": F.col("incoming_price") - F.col("outgoing_price"),
        "paid_transfers": paid, "transfer_hit": hit, "gross_gain": gross,
        "net_gain": gross - hit,
    }).drop("__gain")
