"""Deterministic table rules (health score parts, retention base, revenue
splits, account labels, padded ids, truncated shares) as Column functions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from seatwise.functions.rounding import round_half_up

# ---- fixed values -----------------------------------------------------------------
SEGMENTS = ("Enterprise Brand", "Mid-Market Brand", "Emerging Brand",
            "Large Agency", "Boutique Agency", "Solo Agency")
SERVICE_TEAMS = ("Enterprise CS", "Mid-Market CS", "SMB CS", "Agency CS")
DEAL_TYPES = ("new", "renewal", "upsell", "expansion", "downsell")
AGENCY_MARK = "Agency"
PLATFORM_SHARE = Decimal("0.70")
# ------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def activity_score(fraction: Column | str) -> Column:
    """Share of active days on a 0-10 scale, 2 dp."""
    return round_half_up(_col(fraction) * 10, 2)


def percent_active(fraction: Column | str) -> Column:
    """Share of active days as a percentage, 2 dp."""
    return round_half_up(_col(fraction) * 100, 2)


def health_score(activity: Column | str, categories: Column | str, trend: Column | str) -> Column:
    """Activity score + category score + trend score, 2 dp."""
    return round_half_up(_col(activity).cast("double") + _col(categories) + _col(trend), 2)


def gross_retention_base(prior: Column | str, current: Column | str) -> Column:
    """Lesser of prior and current ARR, 2 dp (``least`` skips a null side)."""
    return F.round(F.least(_col(prior), _col(current)), 2)


def platform_share(arr: Column | str, share: Decimal = PLATFORM_SHARE) -> Column:
    """Platform part of ARR, 2 dp (exact decimal half-up)."""
    return F.round(_col(arr) * F.lit(share), 2).cast("decimal(18,2)")


def arr_by_deal_type(deal_type: Column | str, arr: Column | str) -> dict[str, Column]:
    """ARR in the column of the account's deal type, 0 in the other four."""
    zero = F.lit(0).cast("decimal(18,2)")
    return {f"{t}_arr": F.when(_col(deal_type) == t, _col(arr)).otherwise(zero) for t in DEAL_TYPES}


def service_team(segment: Column | str) -> Column:
    """Enterprise / mid-market teams by exact segment, agencies by name, else SMB."""
    s = _col(segment)
    return (F.when(s == SEGMENTS[0], F.lit(SERVICE_TEAMS[0]))
            .when(s == SEGMENTS[1], F.lit(SERVICE_TEAMS[1]))
            .when(s.contains(AGENCY_MARK), F.lit(SERVICE_TEAMS[3]))
            .otherwise(F.lit(SERVICE_TEAMS[2])))


def business_type(segment: Column | str) -> Column:
    """'Agency' when the segment name contains it, else 'Brand'."""
    return F.when(_col(segment).contains(AGENCY_MARK), F.lit("Agency")).otherwise(F.lit("Brand"))


def padded_id(prefix: str, number: Column | str, width: int = 4) -> Column:
    """``prefix`` + zero-padded number, e.g. CUS_0007."""
    return F.format_string(f"{prefix}%0{width}d", _col(number).cast("long"))


def id_number(identifier: Column | str, prefix: str) -> Column:
    """Inverse of ``padded_id``: the number after the prefix."""
    return F.regexp_replace(_col(identifier), f"^{prefix}", "").cast("long")


def truncated_share(count: Column | str, share: Column | str | float) -> Column:
    """int(count x share), floored at 0 (truncates toward zero first)."""
    s = F.lit(share) if isinstance(share, (int, float)) else _col(share)
    return F.greatest(F.lit(0).cast("long"), (_col(count) * s).cast("long"))
