"""Declared constraints of the stored tables: not null, text lengths,
references.  Rows that break one are kept apart with the reasons."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """``required``: columns that are never null; ``lengths``: the most code
    points of a text; ``references``: column -> (parent table, its key)."""

    required: tuple[str, ...] = ()
    lengths: dict[str, int] = field(default_factory=dict)
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


# The declared columns of the three tables.
LISTINGS = Rules(
    required=("id", "source", "extracted_at"),
    lengths={"id": 64, "source": 20, "listing_type": 30, "gender_preference": 30, "vibe": 30, "lease_type": 30,
             "available_from": 30, "building_type": 30, "domicile_type": 30, "room_type": 30, "furniture_level": 30,
             "bathroom_type": 30, "laundry_type": 30, "transit_proximity": 30, "neighbourhood": 100},
    references={"scrape_run_id": ("scrape_runs", "id")})
PRICE_HISTORY = Rules(required=("price", "observed_at"), lengths={"listing_id": 64},
                      references={"listing_id": ("listings", "id")})
SCRAPE_RUNS = Rules(required=("id", "started_at", "source"), lengths={"source": 20, "status": 20})


def reasons(rules: Rules, columns: list[str]) -> Column:
    """The broken not-null and length rules of a row, in declared order: an
    array, empty for a good row.  Rules on columns that the frame lacks do not
    count, but for required ones, which every row then breaks."""
    found = [F.when(F.col(c).isNull() if c in columns else F.lit(True), F.lit(f"{c}: null")) for c in rules.required]
    found += [F.when(F.char_length(c) > most, F.lit(f"{c}: over {most}")) for c, most in rules.lengths.items()
              if c in columns]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def checked(df: DataFrame, rules: Rules, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """All rows with ``broken``, the rules that each breaks.

    A reference is looked up where its parent table is given: distinct parent
    keys, left join; a null reference is allowed.  Repeated rows stay repeated.
    """
    out = df.withColumn("broken", reasons(rules, df.columns))
    for column, (table, key) in rules.references.items():
        if column not in df.columns or table not in (parents or {}):
            continue
        keys = parents[table].select(F.col(key).alias("_parent")).where(F.col("_parent").isNotNull()).distinct()
        lost = F.col(column).isNotNull() & F.col("_parent").isNull()
        out = out.join(keys, F.col(column) == F.col("_parent"), "left").withColumn("broken", F.when(
            lost, F.array_append("broken", F.lit(f"{column}: not in {table}"))).otherwise(F.col("broken"))).drop("_parent")
    return out


def accepted(rows: DataFrame) -> DataFrame:
    """Checked rows that break nothing."""
    return rows.where(F.size("broken") == 0).drop("broken")


def rejected(rows: DataFrame) -> DataFrame:
    """Checked rows that break a rule, with ``broken``."""
    return rows.where(F.size("broken") > 0)
