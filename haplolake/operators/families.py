"""Related cells side by side: profiles, patterns, affected haplotypes, events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haplolake.functions.columns import chr_number, order_rank, rounded_even, tokens_other_than
from haplolake.operators.relational import single_values, widen

ROLES = ("A", "B", "c1", "c2")
FAMILY = ("generation", "family", "family_ids", "MN_info", "event", "rupt_time", "chr")
MEASURES = ("cell", "tpm", "var_a", "var_b", "state_a", "state_b", "p1_a", "p1_b", "p2_a", "p2_b")


def family_profile(calls: DataFrame, keys: Sequence[str] = FAMILY, role: str = "relationship", roles: Sequence[str] = ROLES, measures: Sequence[str] = MEASURES) -> DataFrame:
    """One row per family and region with <role>_<measure> columns; a role that occurs twice is an error (DOM33, RS2)."""
    return widen(calls, keys, role, roles, measures)


def _joined(names: Sequence[str]) -> F.Column:
    return F.concat_ws(" ", *(F.col(n).cast("string") for n in names))


def _rounded(roles: Sequence[str], measure: str) -> F.Column:
    return F.concat_ws(" ", *(rounded_even(f"{r}_{measure}").cast("long").cast("string") for r in roles))


def cn_pattern(profile: DataFrame, roles: Sequence[str] = ROLES, measure: str = "tpm", name: str = "cn_pattern") -> DataFrame:
    """Rounded totals of the roles, in order, without gaps for missing ones (DOM34). Totals are copy numbers, as rescale_cn gives them."""
    return profile.withColumn(name, _rounded(roles, measure))


def transcription_pattern(profile: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """pattern_a, pattern_b: states in role order, missing ones left out (DOM35, AG22)."""
    return profile.withColumns({f"pattern_{h}": _joined([f"{r}_state_{h}" for r in roles]) for h in ("a", "b")})


def affected_haplotype(profile: DataFrame, normal: str = "1") -> DataFrame:
    """affected: A or B if only that pattern has other tokens than 1, ``normal`` if neither, the text NA if both (DOM36)."""
    a, b = (F.size(tokens_other_than(F.nullif(F.col(f"pattern_{h}"), F.lit("")), normal)) > 0 for h in ("a", "b"))
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return profile.withColumn("affected", F.when(a & b, "NA").when(a, "A").when(b, "B").otherwise("normal"))


def affected_readout(profile: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """affected_pattern (rounded values of all roles' affected haplotype), and value, state, p1, p2 of the first role's;
    null unless one haplotype is affected (DOM37)."""
    pick = lambda x, y: F.when(F.col("affected") == "A", x).when(F.col("affected") == "B", y)
    one = {f"affected_{n}": pick(F.col(f"{roles[0]}_{m}_a"), F.col(f"{roles[0]}_{m}_b")) for n, m in (("value", "var"), ("state", "state"), ("p1", "p1"), ("p2", "p2"))}
    return profile.withColumns({"affected_pattern": pick(_rounded(roles, "var_a"), _rounded(roles, "var_b")), **one})


def event_columns(keys: Sequence[str] = FAMILY, roles: Sequence[str] = ROLES) -> list[str]:
    """Columns of the event table: family and region, five of each role, patterns, affected haplotype and its readout."""
    each = [f"{r}_{m}" for r in roles for m in ("cell", "tpm", "var_a", "state_a", "var_b", "state_b")]
    return [*keys, *each, "pattern_a", "pattern_b", "affected", "affected_value", "affected_state", "affected_p1", "affected_p2"]


def split_events(profile: DataFrame, columns: Sequence[str] | None = None, order: Sequence[str] = ("generation", "family"), region: str = "chr") -> tuple[DataFrame, DataFrame]:
    """Events, in a fixed column order, sorted by family and then by the region's number; and the normal rows, with all columns (DOM38)."""
    events = profile.filter(F.col("affected") != "normal").orderBy(*(c for c in order if c in profile.columns), chr_number(region), region)
    return events.select(*(columns or event_columns([c for c in FAMILY if c in profile.columns]))), profile.filter(F.col("affected") == "normal")


def uniform_families(profile: DataFrame, by: Sequence[str] = ("family",), label: str = "affected") -> DataFrame:
    """Families that have one label over all regions, whichever it is, with it (DOM39)."""
    return single_values(profile, by, label)


def in_role_order(df: DataFrame, role: str = "relationship", roles: Sequence[str] = ROLES, then: Sequence[str] = ()) -> DataFrame:
    """Sort by role (SO4)."""
    return df.orderBy(order_rank(role, roles), *then)
