"""The ranked feature list and choices of features by it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features by rank, most important first.
RANKED = [
    "T10Y3M_level_zscore_252",
    "VIXCLS_level_zscore_63",
    "NFCI_level_zscore_50",
    "PCEPILFE_yoy_12_zscore_36",
    "CFNAI_level_zscore_36",
    "DGS10_level_zscore_252",
    "VIXCLS_diff_5_zscore_126",
    "T10Y3M_diff_21_zscore_252",
    "CFNAI_diff_1_zscore_36",
    "NFCI_diff_21_zscore_50",
    "PCEPILFE_yoy_12_diff_1_zscore_36",
    "DGS10_diff_21_zscore_252",
    "ICSA_movingaverage_4_pctchange_13_zscore_50",
    "INDPRO_yoy_12_zscore_36",
    "DGS2_level_zscore_252",
    "T10Y3M_diff_5_zscore_126",
    "VIXCLS_movingaverage_21_diff_21_zscore_252",
    "INDPRO_yoy_12_diff_1_zscore_36",
    "DGS10_diff_1_rollingstd_21_zscore_126",
    "ICSA_movingaverage_4_zscore_50",
    "NFCI_diff_5_diff_5_zscore_25",
    "VIXCLS_pctchange_1_rollingstd_21_zscore_126",
    "ICSA_movingaverage_4_pctchange_4_zscore_25",
    "PCEPILFE_pctchange_1_zscore_36",
    "INDPRO_pctchange_3_zscore_36",
]

#: Features by category.
GROUPS = {
    "stress": ["VIXCLS_level_zscore_63", "VIXCLS_diff_5_zscore_126", "NFCI_level_zscore_50", "NFCI_diff_21_zscore_50"],
    "rates": ["DGS2_level_zscore_252", "DGS10_level_zscore_252", "T10Y3M_level_zscore_252", "T10Y3M_diff_21_zscore_252"],
    "inflation": ["PCEPILFE_yoy_12_zscore_36", "PCEPILFE_yoy_12_diff_1_zscore_36"],
    "growth": ["CFNAI_level_zscore_36", "INDPRO_yoy_12_zscore_36"],
    "labor": ["ICSA_movingaverage_4_zscore_50", "ICSA_ma_4_pctchange_13_zscore_50"],
}


def static_groups(names: DataFrame, groups: dict[str, list[str]] = GROUPS) -> DataFrame:
    """(feature, group) of a table of features; those in no group are left out."""
    group = F.create_map(*(F.lit(x) for g, features in groups.items() for f in features for x in (f, g)))
    return names.select("feature", F.try_element_at(group, "feature").alias("group")).filter(F.col("group").isNotNull())


def top_features(n: int = 5, ranked: list[str] = RANKED) -> list[str]:
    """The first n names of the ranking; all of them if there are fewer."""
    return ranked[:n]


def ready_features(wide: DataFrame, names: list[str], n: int = 8, ranked: list[str] = RANKED) -> DataFrame:
    """Rows in which none of all features is missing, with the best n of those in the table, by rank."""
    best = [x for x in ranked if x in names][:n]
    return wide.dropna("any", subset=names).select("date", *best)


def highest(rows: DataFrame, column: str, n: int = 5, *ties: str) -> DataFrame:
    """The n rows with the largest values of a column."""
    return rows.filter(F.col(column).isNotNull()).orderBy(F.desc(column), *ties).limit(n)
