"""Combinations of readings that should not occur together.

A rule is a name, the canonical columns it reads and a predicate over them. All rules are evaluated
in one pass over the rows. A rule whose columns are absent is skipped and listed by ``skipped_rules``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wellspring.functions.nulls import any_of, holds, number
from wellspring.vocabulary import resolve

Read = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    name: str
    columns: tuple[str, ...]
    test: Callable[..., Column]

    def predicate(self, names: dict[str, str]) -> Column:
        cells = [F.col(f"`{names[c]}`") for c in self.columns]
        return holds(self.test(*[x if c.endswith("_type") or c == "phase_operation" else number(x) for c, x in zip(self.columns, cells)]))


def _rule(name: str, columns: str, test: Callable[..., Column]) -> Rule:
    return Rule(name, tuple(columns.split()), test)


# The limits and texts of the twenty rules.
RULES = [
    _rule("R01", "formation_type formation_permeability", lambda f, k: (f == "Shale") & (k > 50)),
    _rule("R02", "formation_type reservoir_temperature", lambda f, t: (f == "Limestone") & (t < 60)),
    _rule("R03", "formation_type clay_content_percent", lambda f, c: (f == "Sandstone") & (c > 60)),
    _rule("R04", "mud_type viscosity", lambda m, v: (m == "Water-based") & (v > 60)),
    _rule("R05", "mud_type mud_ph", lambda m, p: (m == "Oil-based") & (p < 6)),
    _rule("R06", "mud_type mud_weight_in", lambda m, w: (m == "Synthetic") & (w < 7.5)),
    _rule("R07", "viscosity in_rate_flow_mud", lambda v, q: (v > 70) & (q > 150)),
    _rule("R08", "formation_type reservoir_temperature", lambda f, t: (f == "Shale") & (t > 130)),
    _rule("R09", "pressure_annulus pressure_standpipe", lambda a, s: a > s),
    _rule("R10", "pressure_reservoir depth_measured", lambda p, d: (p < 3000) & (d > 3000)),
    _rule("R11", "phase_operation rop", lambda p, r: (p == "Production") & (r > 1)),
    _rule("R12", "phase_operation weight_on_bit", lambda p, w: (p == "Completion") & (w > 5000)),
    _rule("R13", "depth_bit depth_measured", lambda b, d: b > d),
    _rule("R14", "completion_type density_perforation", lambda c, n: (c == "Cased") & (n < 5)),
    _rule("R15", "completion_type density_perforation", lambda c, n: (c == "Open Hole") & (n > 20)),
    _rule("R16", "clay_mineralogy_type mud_ph", lambda c, p: (c == "Montmorillonite") & (p > 10)),
    _rule("R17", "formation_type fractures_presence formation_permeability",
          lambda f, x, k: (f == "Shale") & (x == 1) & (k > 100)),
    _rule("R18", "phase_operation weight_on_bit", lambda p, w: (p == "Production") & (w > 1000)),
    _rule("R19", "fluid_loss_api mud_type", lambda a, m: (m == "Oil-based") & (a > 3.0)),
    _rule("R20", "reservoir_temperature clay_content_percent", lambda t, c: (t > 120) & (c > 50)),
]

# Synonyms a caller may fold into the texts the rules know; the rules themselves match exactly.
MUD_SYNONYMS = {"Inhibitive Water-based": "Water-based", "Synthetic Oil-based": "Synthetic"}
PHASE_SYNONYMS = {"Completed": "Completion"}


def applicable_rules(df: DataFrame, rules: Sequence[Rule] = RULES) -> list[Rule]:
    names = resolve(df)
    return [r for r in rules if all(c in names for c in r.columns)]


def skipped_rules(df: DataFrame, rules: Sequence[Rule] = RULES) -> list[str]:
    usable = {r.name for r in applicable_rules(df, rules)}
    return [r.name for r in rules if r.name not in usable]


def combination_flag(df: DataFrame, rules: Sequence[Rule] = RULES) -> Column:
    names = resolve(df)
    return any_of(r.predicate(names) for r in applicable_rules(df, rules))


def flag_combinations(df: DataFrame, name: str = "Combination_Anomaly", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add one boolean column: any rule fires."""
    return df.withColumn(name, combination_flag(df, rules))


def fired_rules(df: DataFrame, name: str = "fired_rules", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the names of all rules that fire, in rule order."""
    names = resolve(df)
    marks = [F.when(r.predicate(names), F.lit(r.name)) for r in applicable_rules(df, rules)]
    return df.withColumn(name, F.array_compact(F.array(*marks)) if marks else F.array().cast("array<string>"))


def rule_counts(df: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per applicable rule with the number of rows it fires on."""
    names = resolve(df)
    cells = [
        F.struct(F.lit(r.name).alias("rule"), F.count_if(r.predicate(names)).alias("n_fired"))
        for r in applicable_rules(df, rules)
    ]
    if not cells:
        return df.sparkSession.createDataFrame([], "rule string, n_fired bigint")
    return df.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def fold_synonyms(df: DataFrame, column: str, synonyms: dict[str, str]) -> DataFrame:
    folded = F.col(column)
    for spelling, known in synonyms.items():
        folded = F.when(F.col(column) == spelling, F.lit(known)).otherwise(folded)
    return df.withColumn(column, folded)
