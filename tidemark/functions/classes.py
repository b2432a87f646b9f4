"""Fixed classifications of flags, gear, time at sea, risk and names."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Flag states of each group (ISO 3166 alpha-3).
# ---------------------------------------------------------------------------
FLAG_GROUPS = {
    "group1": "ATG BRB CYM LBR VCT VUT".split(),
    "group2": (
        "BHS BHR BLZ BOL BRN KHM CYP GNQ GAB GEO HND KIR MDG MLT MHL PAN PRT KNA WSM SLE LKA TON TZA"
    ).split(),
    "group3": (
        "ALB DZA AGO AIA ARG AUS AZE BGD BEL BMU BRA BGR CPV CMR CAN CHL HKG TWN COL COD CRI HRV CUB "
        "DNK DJI ECU EGY ERI EST ETH FJI FIN FRA GMB DEU GHA GRC GRL GRD GTM GUY ISL IND IDN IRN IRQ "
        "IRL ISR ITA JPN JOR KAZ KEN PRK KOR KWT LAO LVA LBN LBY LTU LUX MYS MDV MRT MUS MEX MNE MAR "
        "MOZ MMR NAM NLD NZL NGA NOR OMN PAK PNG PRY PER PHL POL QAT RUS SAU SEN SYC SGP SVN ZAF ESP "
        "SDN SUR SWE CHE SYR THA TTO TUN TUR TKM UKR ARE GBR USA URY VEN VNM YEM"
    ).split(),
    "china": ["CHN"],
}
FLAG_GROUP_NAMES = (*FLAG_GROUPS, "other")

# Raw gear name -> gear class.
GEAR_CLASSES = {
    "trawlers": "trawlers",
    "trollers": "trollers",
    "driftnets": "driftnets",
    "purse_seines": "purse_seine",
    "tuna_purse_seines": "purse_seine",
    "other_purse_seines": "purse_seine",
    "set_gillnets": "set_gillnet",
    "squid_jigger": "squid_jigger",
    "pole_and_line": "pole_and_line",
    "set_longlines": "set_longline",
    "pots_and_traps": "pots_and_traps",
    "drifting_longlines": "drifting_longline",
}
GEAR_CLASS_NAMES = tuple(dict.fromkeys(GEAR_CLASSES.values()))

# Upper bound in months of 30 days -> bucket name.
TIME_AT_SEA = {1: "less_than_1m", 3: "1_3m", 6: "3_6m", 12: "6_12m"}
TIME_AT_SEA_LONGEST = "12m_and_more"
TIME_AT_SEA_NAMES = (*TIME_AT_SEA.values(), TIME_AT_SEA_LONGEST)

# Patterns of ship names that belong to gear buoys.
GEAR_NAME_PATTERNS = (
    r"(.*)([\s]+[0-9]+%)$",
    r"[0-9]\.[0-9]V",
    r"(.*)[@]+([0-9]+V[0-9]?)$",
    r"BOUY",
    r"NET MARK",
    r"NETMARK",
    r"NETFISHING",
    r"NET FISHING",
    r"^[0-9]*\-[0-9]*$",
)

# Anchorages of two ports that share their label with another port.
HOMONYM_ANCHORAGES = {
    "NEWPORT (OREGON)": (
        "54c1d7b1 54c1d7a5 54c1d7b7 54c1d7af 54c1d7b5 54c1d7b3 "
        "54c1d7ad 54c1d64d 54c1d653 54c1d655 54c1d72f 54906be3"
    ).split(),
    "STONINGTON (MAINE)": ["4cac27cf", "4cac2773"],
}
HOMONYM_PORTS = {"NEWPORT (OREGON)": ["p610"], "STONINGTON (MAINE)": ["p641"]}

# Ports listed twice in the survey under one label.
DUPLICATE_PORTS = "p57 p504 p505 p768 p609 p317 p51 p74 p52 p63 p2 p173".split()

# Score thresholds between the risk classes 0, 1 and 2.
RISK_THRESHOLDS = (0.0, 2.0)


def flag_group(flag: Column, groups: Mapping[str, list[str]] = FLAG_GROUPS) -> Column:
    """Group of a flag state; NULL stays NULL, an unlisted flag is ``other``."""
    branch = F.when(flag.isNull(), F.lit(None).cast("string"))
    for name, members in groups.items():
        branch = branch.when(flag.isin(members), name)
    return branch.otherwise("other")


def gear_class(gear: Column, *, keep_unknown: bool = False) -> Column:
    """Gear class of a raw gear name.

    Unknown names become NULL. ``keep_unknown`` is the light form: only the purse
    seine names are merged, every other name stays as it is.
    """
    if keep_unknown:
        merged = [raw for raw, cls in GEAR_CLASSES.items() if cls == "purse_seine"]
        return F.when(gear.isin(merged), "purse_seine").otherwise(gear)
    branch = F
    for cls in GEAR_CLASS_NAMES:
        branch = branch.when(gear.isin([r for r, c in GEAR_CLASSES.items() if c == cls]), cls)
    return branch


def time_at_sea(hours: Column) -> Column:
    """Bucket of a trip duration in hours; NULL stays NULL."""
    branch = F
    for months, name in TIME_AT_SEA.items():
        branch = branch.when(hours < 24 * 30 * months, name)
    return branch.when(hours.isNotNull(), TIME_AT_SEA_LONGEST)


def is_gear_name(name: Column) -> Column:
    """Does a ship name look like that of a gear buoy? Unanchored, case-sensitive."""
    return name.rlike("|".join(f"(?:{p})" for p in GEAR_NAME_PATTERNS))


def relabel(column: Column, key: Column, labels: Mapping[str, list[str]]) -> Column:
    """Replace ``column`` where ``key`` is listed under a label."""
    branch = F
    for label, keys in labels.items():
        branch = branch.when(key.isin(keys), label)
    return branch.otherwise(column)


def resolved_flag(flag: Column, flag_of_id: Column) -> Column:
    """The registered flag, or the flag coded in the vessel id where it is unknown."""
    return F.when(flag == "UNK", flag_of_id).otherwise(flag)


def risk_score(none: Column, low: Column, med: Column, high: Column) -> Column:
    return low / 3.0 + med * (2.0 / 3.0) + high - none


def risk_class(score: Column) -> Column:
    """Class of a score.

    A mean depends in its last digits on the order of its summands, which differs
    between runs; rounding keeps a score that equals a threshold on one side of it.
    """
    lower, upper = RISK_THRESHOLDS
    score = F.round(score, 9)
    return F.when(score < lower, 0).when(score < upper, 1).otherwise(2)
