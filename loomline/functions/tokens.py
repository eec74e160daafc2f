"""Token counts by characters per token, and budget arithmetic, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters per token by language; generic is used for all others.
CHARS_PER_TOKEN = {"generic": 3.5, "python": 3.2, "javascript": 3.0, "rust": 3.0, "go": 3.1, "json": 2.8, "markdown": 4.0}
#: Tokens that each message takes beside its text.
MESSAGE_OVERHEAD = 5


def estimate(text: Column, chars: float = 3.5) -> Column:
    """At least 1 token for text that isn't blank, 0 for blank or null."""
    blank = text.isNull() | (F.trim(F.regexp_replace(text, r"\s+", " ")) == "")
    return F.when(blank, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / F.lit(chars)))).cast("long")


def of_message(text: Column) -> Column:
    return estimate(text) + MESSAGE_OVERHEAD


def in_fences(text: Column) -> Column:
    """A fourth of the characters of fenced blocks, fences included."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)(```.*?```)"), F.lit(1))
    return F.floor(F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b)) / 4).cast("long")


@dataclass(frozen=True)
class Budget:
    """Options of the budget; windows and sizes in tokens."""

    max_chars: int = 48_000
    max_tokens: int = 12_000
    window: int = 262_144
    window_fraction: float = 0.025
    dynamic: bool = True
    growth_per_turn: int = 800
    code_factor: float = 0.25
    ceiling_fraction: float = 0.25
    growth_cap: int = 1500
    shrink_fraction: float = 0.15
    shrink_least: int = 800

    def static(self) -> int:
        """The budget before calibration."""
        chars = max(1, self.max_chars // 4)
        if not self.dynamic or self.window <= 0:
            return chars if self.max_tokens <= 0 else min(chars, self.max_tokens)
        return max(int(self.window * self.window_fraction), self.max_tokens, chars)


def calibration(backend: Column, estimated: Column) -> Column:
    """backend / estimated within 0.5 and 2; 1 without an estimate."""
    return F.when(estimated > 0, F.greatest(F.lit(0.5), F.least(F.lit(2.0), backend / estimated))).otherwise(F.lit(1.0))


def static_budget(o: Budget, ratio: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.lit(float(o.static())) * ratio)).cast("long")


def adaptive_budget(o: Budget, turns: Column, code_tokens: Column, last: Column, ratio: Column) -> Column:
    """Grows with turns and code up to a fraction of the window, never below the last output."""
    grown = F.lit(o.static()) + o.growth_per_turn * turns + F.floor(o.code_factor * code_tokens)
    capped = F.least(grown, F.lit(int(o.window * o.ceiling_fraction)))
    return F.greatest(F.lit(1), F.bround(F.greatest(capped, F.coalesce(last, F.lit(0))) * ratio)).cast("long")


def growth_limited(o: Budget, budget: Column, last: Column) -> Column:
    return F.when(last.isNull(), budget).otherwise(F.least(budget, last + o.growth_cap)).cast("long")


def shrink_cap(o: Budget, last: Column) -> Column:
    least = max(o.growth_cap, o.shrink_least)
    return F.when(F.coalesce(last, F.lit(0)) <= 0, least).otherwise(F.greatest(F.floor(last * o.shrink_fraction), F.lit(least))).cast("long")


def shrink_floor(o: Budget, last: Column) -> Column:
    return F.when(last.isNotNull(), F.greatest(F.lit(0), last - shrink_cap(o, last))).cast("long")


def sub_cap(budget: Column, fraction: float, floor: int) -> Column:
    return F.greatest(F.lit(floor), F.floor(budget * fraction)).cast("long")


def savings(original: Column, optimised: Column) -> Column:
    return F.greatest(F.lit(0), original - optimised).cast("long")


def kv_estimate(tokens: Column) -> Column:
    """Tokens and their key-value slots, four each, in words; from 10,000 on with a warning."""
    shown = lambda n: F.format_number(n, 0)
    return F.concat(shown(tokens), F.lit(" tokens (~"), shown(tokens * 4), F.lit(" KV slots"), F.when(tokens >= 10_000, " — near context limit)").otherwise(")"))
