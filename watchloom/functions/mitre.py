"""MITRE technique lookups as literal maps, so tagging needs no join."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from watchloom.functions.columns import as_column
from watchloom.rules.mitre import TECHNIQUES, UNKNOWN_TECHNIQUE, technique_url


def _lookup(key: Column, values: dict[str, str], default: str) -> Column:
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def mitre_tag(df: DataFrame, key: str = "sub_type", url: bool = False) -> DataFrame:
    """Add mitre_id, mitre_name and mitre_tactic (and mitre_url) for a sub-type column."""
    out = df
    for i, name in enumerate(["mitre_id", "mitre_name", "mitre_tactic"]):
        values = {k: v[i] for k, v in TECHNIQUES.items()}
        out = out.withColumn(name, _lookup(F.col(key), values, UNKNOWN_TECHNIQUE[i]))
    if url:
        urls = {k: technique_url(v[0]) for k, v in TECHNIQUES.items()}
        out = out.withColumn("mitre_url", _lookup(F.col(key), urls, ""))
    return out


def fim_mitre_id(change: Column | str, severity: Column | str) -> Column:
    change, critical = as_column(change), as_column(severity) == "critical"
    return (
        F.when((change == "added") & critical, "T1505.003")
        .when(change == "added", "T1074")
        .when((change == "modified") & critical, "T1565.001")
        .when(change == "modified", "T1027")
        .when(change == "deleted", "T1070.004")
    )


def fim_mitre_tactic(change: Column | str, severity: Column | str) -> Column:
    change, critical = as_column(change), as_column(severity) == "critical"
    return (
        F.when((change == "added") & critical, "Persistence")
        .when(change == "added", "Collection")
        .when((change == "modified") & critical, "Impact")
        .otherwise("Defense Evasion")
    )
