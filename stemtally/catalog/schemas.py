"""Histogram schemas: ordered attributes, and queries by name over them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from math import prod

from stemtally.catalog.attributes import ATTRIBUTES, Attribute
from stemtally.operators.tabulate import LinearQuery, tabular_query

# ---- fixed values ---------------------------------------------------------------------------

SCHEMAS = """
DHCP_SCHEMA = RelGQAttr SexAttr AgeAttr HispAttr CenraceAttr
DHCH_SCHEMA = SexAttr HHAgeAttr HHHispAttr RaceAttr HHElderlyAttr HHTenShortAttr HHTypeDHCHAttr
DHCH_SCHEMA_TEN_3LEV = SexAttr HHAgeAttr HHHispAttr RaceAttr HHElderlyAttr HHTenShort3LevAttr HHTypeDHCHAttr
DHCH_SCHEMA_FULLTENURE = SexAttr HHAgeAttr HHHispAttr RaceAttr HHElderlyAttr TenureAttr HHTypeDHCHAttr
custom_ests_and_projections_area_schema = HHGQ_EPAttr SexAttr AgeEPAttr HispAttr Race2010Attr
SCHEMA_DHCH_small_hhtype = SexAttr HHAgeAttr HHHispAttr RaceAttr HHElderlyAttr HHTenShortAttr HHTypeAttr
DHCH_LITE_SCHEMA = HHSexAttr HHHispAttr HHRaceAttr HHSizeAttr HHElderlyAttr HHMultiAttr
H1_SCHEMA = H1Attr
H1_2020_SCHEMA = H1Attr
REDUCED_DHCP_HHGQ_SCHEMA = HHGQPersonSimpleAttr SexAttr AgeAttr HispAttr CenraceAttr CitizenAttr
SF1_SCHEMA = RelAttr SexAttr AgeAttr HispAttr CenraceAttr
HOUSEHOLD2010_SCHEMA = HHSexAttr HHAgeAttr HHHispAttr HHRaceAttr HHSizeAttr HHTypeAttr HHElderlyAttr HHMultiAttr
HOUSEHOLDSMALL_SCHEMA = HHSexAttr HHTypeAttr
HOUSEHOLD2010TENVACS_SCHEMA = HHSexAttr HHAgeAttr HHHispAttr HHRaceAttr HHSizeAttr HHTypeAttr HHElderlyAttr HHMultiAttr Tenure2LevelAttr
1940_SCHEMA = HHGQ1940Attr Sex1940Attr Age1940Attr Hispanic1940Attr Race1940Attr
PL94_SCHEMA = HHGQPersonSimpleAttr VotingAgeAttr HispAttr CenraceAttr
PL94_2020_SCHEMA = HHGQPersonSimpleAttr VotingAgeAttr HispAttr CenraceAttr
PL94_CVAP_SCHEMA = HHGQPersonSimpleAttr VotingAgeAttr HispAttr CenraceAttr CitizenAttr
PL94_P12_SCHEMA = HHGQPersonSimpleAttr SexAttr AgecatAttr HispAttr CenraceAttr
TEN_UNIT_2010_SCHEMA = HHSexAttr HHAgeAttr HHHispAttr HHRaceAttr HHSizeAttr HHTypeAttr HHElderlyAttr HHMultiAttr TenureAttr
UNIT_TABLE_10_SCHEMA = HHGQUnitDemoProductAttr
UNIT_TABLE_10_SCHEMA_TENVACSGQ = TenureVacancyGQAttr
UNIT_TABLE_10_SCHEMA_VACSGQ = VacancyGQAttr
UNIT_TABLE_10_SIMPLE_SCHEMA = HHGQUnitSimpleAttr
UNIT_TABLE_10_SIMPLE_RECODED_SCHEMA = HHGQUnitSimpleRecodedAttr
UNIT_TABLE_10_DHCP_SCHEMA = HHGQAttr
UNIT_TABLE_10_CUSTOM_EP_SCHEMA = HHGQEPUnitAttr
CVAP_SCHEMA = CVAPRace
"""
ALIASES = """
PL94 = PL94_SCHEMA
PL94_CVAP = PL94_CVAP_SCHEMA
PL94_P12 = PL94_P12_SCHEMA
1940 = 1940_SCHEMA
SF1_Person = SF1_SCHEMA
DHCP_HHGQ = REDUCED_DHCP_HHGQ_SCHEMA
Household2010 = HOUSEHOLD2010_SCHEMA
TenUnit2010 = TEN_UNIT_2010_SCHEMA
"""
UNIT_SCHEMAS = """
UNIT_TABLE_10_DHCP_SCHEMA = DHCP_SCHEMA
UNIT_TABLE_10_CUSTOM_EP_SCHEMA = custom_ests_and_projections_area_schema
UNIT_TABLE_10_SCHEMA_TENVACSGQ = DHCH_SCHEMA DHCH_SCHEMA_TEN_3LEV SCHEMA_DHCH_small_hhtype HOUSEHOLDSMALL_SCHEMA HOUSEHOLD2010TENVACS_SCHEMA
UNIT_TABLE_10_SCHEMA_VACSGQ = DHCH_SCHEMA_FULLTENURE
UNIT_TABLE_10_SCHEMA = DHCH_LITE_SCHEMA H1_SCHEMA SF1_SCHEMA HOUSEHOLD2010_SCHEMA TEN_UNIT_2010_SCHEMA
UNIT_TABLE_10_SIMPLE_RECODED_SCHEMA = H1_2020_SCHEMA REDUCED_DHCP_HHGQ_SCHEMA 1940_SCHEMA PL94_SCHEMA PL94_2020_SCHEMA PL94_CVAP_SCHEMA PL94_P12_SCHEMA
CVAP_SCHEMA = CVAP_SCHEMA
"""
CONSTRAINT_SCHEMAS = """
PL94_SCHEMA = DHCP_SCHEMA custom_ests_and_projections_area_schema REDUCED_DHCP_HHGQ_SCHEMA
H1_SCHEMA = DHCH_SCHEMA DHCH_SCHEMA_TEN_3LEV DHCH_SCHEMA_FULLTENURE SCHEMA_DHCH_small_hhtype DHCH_LITE_SCHEMA
"""
CROSS = " * "
BY = " BY "
SPLIT = r"\s*\*\s*"


def _table(text: str) -> dict[str, list[str]]:
    rows = (line.partition(" = ") for line in text.strip().splitlines())
    return {k.strip(): v.split() for k, _, v in rows}


def _inverse(text: str) -> dict[str, str]:
    return {s: k for k, v in _table(text).items() for s in v}


class UnknownQuery(ValueError):
    """A name that is no level, recode or table of the schema."""


def split_name(name: str) -> list[str]:
    return re.split(SPLIT, name.strip())


def same_name(a: str, b: str) -> bool:
    return sorted(split_name(a)) == sorted(split_name(b))


def file_name(name: str) -> str:
    return ".".join(split_name(name))


def query_name(file: str) -> str:
    return CROSS.join(file.split("."))


@dataclass
class Schema:
    """A named list of attributes, with the recodes they define."""

    name: str
    attributes: list[Attribute]
    recodes: dict[str, tuple[int, list[tuple[str, list[int]]]]] = field(default_factory=dict)

    def __post_init__(self):
        if not self.recodes:
            for d, a in enumerate(self.attributes):
                for name, groups in a.recodes.items():
                    self.add_recode(name, d, groups)

    @property
    def dims(self) -> list[str]:
        return [a.name for a in self.attributes]

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(a.size for a in self.attributes)

    @property
    def size(self) -> int:
        return prod(self.shape)

    def add_recode(self, name: str, dim: int, groups, overwrite: bool = False) -> None:
        if name in self.recodes and not overwrite:
            raise ValueError(f"recode {name!r} already exists")
        self.recodes[name] = (dim, [(label, list(levels)) for label, levels in groups])

    def without_recode(self, name: str) -> "Schema":
        return Schema(self.name, self.attributes, {k: v for k, v in self.recodes.items() if k != name})

    def parts(self, name: str) -> list[tuple[int, list[tuple[str, list[int]]]]]:
        """Attribute position and labelled groups of each part of a crossed name, in schema order."""
        bases = split_name(name)
        out = {}
        for b in bases:
            if b in ("total", "detailed") and len(bases) > 1:
                raise UnknownQuery(f"{b!r} cannot be crossed")
            if b in self.dims:
                d = self.dims.index(b)
                groups = [(label, [i]) for i, label in enumerate(self.attributes[d].levels)]
            elif b in self.recodes:
                d, groups = self.recodes[b]
            else:
                raise UnknownQuery(f"{b!r} is not part of schema {self.name}")
            if d in out:
                raise UnknownQuery(f"{name!r} uses attribute {self.dims[d]!r} twice")
            out[d] = groups
        return sorted(out.items())

    def knows(self, name: str) -> bool:
        try:
            self.query(name)
        except UnknownQuery:
            return False
        return True

    def query(self, name: str) -> LinearQuery:
        name = name.strip()
        everything = range(len(self.shape))
        if name == "total":
            return tabular_query(name, self.shape, {}, list(everything))
        if name == "detailed":
            return tabular_query(name, self.shape)
        parts = self.parts(name)
        kept = {d for d, _ in parts}
        grouped = {d: [g for _, g in groups] for d, groups in parts if [g for _, g in groups] != [[i] for i in range(self.shape[d])]}
        return tabular_query(name, self.shape, grouped, [d for d in everything if d not in kept])

    def labels(self, name: str) -> list[list[str]]:
        """Group labels per kept attribute, schema order."""
        if name == "total":
            return [["total"]]
        if name == "detailed":
            return [a.levels for a in self.attributes]
        return [[label for label, _ in groups] for _, groups in self.parts(name)]


@lru_cache(maxsize=None)
def schema(name: str) -> Schema:
    """Schema by current or earlier name."""
    table, alias = _table(SCHEMAS), _table(ALIASES)
    target = alias[name][0] if name in alias else name
    if target not in table:
        raise KeyError(f"unknown schema {name!r}")
    return Schema(target, [ATTRIBUTES[c] for c in table[target]])


def schema_names(aliases: bool = True) -> list[str]:
    return list(_table(SCHEMAS)) + (list(_table(ALIASES)) if aliases else [])


def unit_schema(name: str) -> str | None:
    return _inverse(UNIT_SCHEMAS).get(schema(name).name)


def constraint_schema(name: str) -> str | None:
    return _inverse(CONSTRAINT_SCHEMAS).get(schema(name).name)
