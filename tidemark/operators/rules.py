"""Quota rules of a squad game. A rule set is a handful of constants."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from tidemark.operators.guards import ContractError


@dataclass(frozen=True)
class PositionRule:
    position_id: int | str
    short_name: str
    squad_count: int
    minimum_starters: int
    maximum_starters: int


@dataclass(frozen=True)
class SquadRules:
    squad_size: int
    starting_size: int
    budget: float
    max_per_club: int
    positions: tuple[PositionRule, ...]

    def __post_init__(self) -> None:
        if sum(p.squad_count for p in self.positions) != self.squad_size:
            raise ContractError("position quotas do not add up to the squad size")

    @property
    def keepers(self) -> tuple[int | str, ...]:
        """Positions that field exactly one starter."""
        return tuple(p.position_id for p in self.positions
                     if p.minimum_starters == p.maximum_starters == 1)

    def formations(self) -> list[tuple[int, ...]]:
        """Starter counts per position that fill the starting line-up."""
        ranges = [range(p.minimum_starters, p.maximum_starters + 1) for p in self.positions]
        found = [c for c in product(*ranges) if sum(c) == self.starting_size]
        if not found:
            raise ContractError("the position rules permit no formation")
        return found

    @classmethod
    def from_settings(cls, settings: dict, positions: list[dict]) -> "SquadRules":
        """From the ``game_settings`` and ``element_types`` of a payload."""
        def whole(source: dict, name: str) -> int:
            value = source.get(name)
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ContractError(f"{name} must be a positive whole number")
            return value

        spend, scale = settings.get("squad_total_spend"), settings.get("ui_currency_multiplier")
        for value in (spend, scale):
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
                raise ContractError("spend and currency multiplier must be positive numbers")
        return cls(
            squad_size=whole(settings, "squad_squadsize"),
            starting_size=whole(settings, "squad_squadplay"),
            budget=spend / scale,
            max_per_club=whole(settings, "squad_team_limit"),
            positions=tuple(
                PositionRule(whole(p, "id"), str(p["singular_name_short"]),
                             whole(p, "squad_select"), whole(p, "squad_min_play"),
                             whole(p, "squad_max_play"))
                for p in positions
            ),
        )
