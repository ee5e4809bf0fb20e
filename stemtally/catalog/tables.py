"""Published tables and workloads: which queries make up which table.

The lists are fixed values. Most tables repeat one list for the races A to G,
for Hispanics (H) and for white non-Hispanics (I); those are written once, with
``@`` standing for the group.
"""

from __future__ import annotations

from stemtally.catalog.schemas import schema

# ---- fixed values ---------------------------------------------------------------------------

GROUPS = {
    "person": "whiteAlone blackAlone aianAlone asianAlone nhopiAlone sorAlone tomr hispTotal whiteAlone*notHispTotal",
    "person_dhc": "whiteAlone blackAlone aianAlone asianAlone nhopiAlone sorAlone tomr hispTotal notHispTotal*whiteAlone",
    "unit": "whitealone blackalone aianalone asianalone nhopialone soralone tomr hispTotal notHispTotal*whitealone",
    "household": "isWhiteAlone isBlackAlone isAIANAlone isAsianAlone isNHOPIAlone isSORAlone isTMRaces isHisp isWhiteAlone*isNotHisp",
}

HOUSEHOLD2010 = """
P15 = total, hisp, hisp * hhrace
P18 = total, family, marriedfamily, otherfamily, otherfamily * hhsex, nonfamily, alone, notalone
P19 = isOccupied, size1, size1 * hhsex, size2plus, size2plus * family, size2plus * marriedfamily, size2plus * married_with_children_indicator, size2plus * otherfamily, size2plus * otherfamily * hhsex, size2plus * hhsex * other_with_children_indicator, size2plus * nonfamily, size2plus * nonfamily * hhsex
P20 = total, marriedfamily, married_with_children_indicator, cohabiting, cohabiting_with_children_indicator, hhsex * no_spouse_or_partner, hhsex * alone, hhsex * alone * age_65plus, hhsex * no_spouse_or_partner_levels
P22 = total, family, hhage * family, nonfamily, hhage * nonfamily
P23 = total, presence60, family * presence60, presence60 * marriedfamily, presence60 * otherfamily, presence60 * otherfamily * hhsex, presence60 * nonfamily
P24 = isOccupied, isOccupied * presence60, presence60 * size1, presence60 * size2plus, presence60 * size2plus * family, presence60 * size2plus * nonfamily
P25 = isOccupied, isOccupied * presence65, presence65 * size1, presence65 * size2plus, presence65 * size2plus * family, presence65 * size2plus * nonfamily
P26 = isOccupied, isOccupied * presence75, presence75 * size1, presence75 * size2plus, presence75 * size2plus * family, presence75 * size2plus * nonfamily
P28 = isOccupied, isOccupied * family, family * sizex01, isOccupied * nonfamily, nonfamily * sizex0
P38 = family, marriedfamily, married_with_children_indicator, married_with_children_levels, otherfamily, hhsex * otherfamily, hhsex * other_with_children_indicator, hhsex * other_with_children_levels
P18@household = @, @ * family, @ * marriedfamily, @ * otherfamily, @ * otherfamily * hhsex, @ * nonfamily, @ * alone, @ * notalone
P28@household = isOccupied * @, isOccupied * @ * family, @ * family * sizex01, isOccupied * @ * nonfamily, @ * nonfamily * sizex0
P38@household = @ * family, @ * marriedfamily, @ * married_with_children_indicator, @ * married_with_children_levels, @ * otherfamily, @ * hhsex * otherfamily, @ * hhsex * other_with_children_indicator, @ * hhsex * other_with_children_levels
PCT14 = total, multi
PCT15 = total, couplelevels, oppositelevels, samelevels, hhsex * samelevels
PCT18 = nonfamily, hhsex * nonfamily, hhsex * alone, hhsex * alone * hhover65, hhsex * notalone, hhsex * notalone * hhover65
PCT14@household = @, @ * multi
H6 = isOccupied, isOccupied * hhrace
H7 = isOccupied, isOccupied * hisp, isOccupied * hisp * hhrace
H13 = isOccupied, sizex0
"""

DHCP_HHGQ = """
Geolevel_TVD = total, relgq, sex, age, hispanic, cenrace, cenrace * hispanic, age * sex, numraces, numraces * hispanic, votingage, detailed
prefixquery = prefix_agecats, age
rangequery = range_agecats, age
binarysplitquery = binarysplit_agecats, age
P1 = total
P3 = total, majorRaces
P4 = total, hispanic
P5 = total, hispanic, hispanic * majorRaces
P6 = racecomb
P7 = racecomb, hispanic * racecomb
P12 = total, sex, sex * agecat
P14 = under20yearsTotal, under20yearsTotal * sex, under20years * sex
P16 = hhTotal, hhTotal * votingage
P43 = gqTotal, gqTotal * sex, gqTotal * sex * agecat43, sex * agecat43 * institutionalized, sex * agecat43 * majorGQs
P12@person = @, @ * sex, @ * sex * agecat
PCO1 = gqTotal, gqTotal * sex, gqTotal * sex * agecatPCO1
PCO2 = instTotal, instTotal * sex, instTotal * sex * agecatPCO1
PCO3 = gqCorrectionalTotal, gqCorrectionalTotal * sex, gqCorrectionalTotal * sex * agecatPCO3
PCO4 = gqJuvenileTotal, gqJuvenileTotal * sex, gqJuvenileTotal * sex * agecatPCO4
PCO5 = gqNursingTotal, gqNursingTotal * sex, gqNursingTotal * sex * agecatPCO5
PCO6 = gqOtherInstTotal, gqOtherInstTotal * sex, gqOtherInstTotal * sex * agecatPCO1
PCO7 = noninstTotal, noninstTotal * sex, noninstTotal * sex * agecatPCO7
PCO8 = gqCollegeTotal, gqCollegeTotal * sex, gqCollegeTotal * sex * agecatPCO8
PCO9 = gqMilitaryTotal, gqMilitaryTotal * sex, gqMilitaryTotal * sex * agecatPCO8
PCO10 = gqOtherNoninstTotal, gqOtherNoninstTotal * sex, gqOtherNoninstTotal * sex * agecatPCO7
PCO43@person = @ * gqTotal, @ * gqTotal * sex, @ * gqTotal * sex * agecat43, @ * institutionalized * sex * agecat43, @ * majorGQs * sex * agecat43
PCT12 = total, sex, sex * agecatPCT12
PCT13 = hhTotal, hhTotal * sex, hhTotal * sex * agecat
PCT22 = over17yearsTotal * gqTotal, over17yearsTotal * gqTotal * sex, over17yearsTotal * sex * institutionalized, over17yearsTotal * sex * majorGQs
PCT13@person = @ * hhTotal, @ * hhTotal * sex, @ * hhTotal * sex * agecat
"""

PL94 = """
Geolevel_TVD = total, hhgq, votingage, hispanic, cenrace, majorRaces, numraces, cenrace * hispanic, numraces * hispanic, detailed
P1 = total, numraces, cenrace
P2 = total, hispanic, numraces, cenrace, hispanic * numraces, hispanic * cenrace
P3 = votingage, votingage * numraces, votingage * cenrace
P4 = votingage, votingage * hispanic, votingage * numraces, votingage * cenrace, votingage * hispanic * numraces, votingage * hispanic * cenrace
P42 = household, institutionalized, gqlevels
"""
PL94_P12_TVD = "Geolevel_TVD = total, hhgq, sex, agecat, hispanic, cenrace, majorRaces, numraces, agecat * sex, cenrace * hispanic, numraces * hispanic, votingage, detailed"

# Workload of the person and of the unit tables; PCT10D is kept as it was meant, with its group in every entry
PERSON_WORKLOAD = """
PCT8 = nonvoting, nonvoting * hhinstlevels, nonvoting * hhspchildothgq, childage7lev * hhspchildothgq, childage7lev * hhinstlevels
PCT9 = 65andover, 65andover * hhinstlevels, 65andover * relgq_4_groups, 65andover * relgq8cats * sex, 65andover * relgq8cats
PCT9@person_dhc = 65andover * @, 65andover * hhinstlevels * @, 65andover * relgq_4_groups * @, 65andover * relgq8cats * sex * @, 65andover * relgq8cats * @
PCT12 = total, sex, sex * agepct12
"""
UNIT_WORKLOAD = """
H4 = hhtentotal, hhtenshort_3lev
P19 = hhtentotal, presence65, presence65 * size1_size2plus, presence65 * dhch_pco3_margin3
PCT7 = hhtentotal, family, nonfamily, family_nonfamily_size
PCT7@unit = hhtentotal * @, family * @, nonfamily * @, family_nonfamily_size * @
PCT10 = family, marriedfamily, dhch_hhtype_p12_part1, hhtype_dhch_married_fam_pco11_p1, otherfamily, sex * otherfamily, sex * other_with_children_indicator_2, sex * other_with_children_levels
PCT10@unit = family * @, marriedfamily * @, dhch_hhtype_p12_part1 * @, hhtype_dhch_married_fam_pco11_p1 * @, otherfamily * @, sex * otherfamily * @, sex * other_with_children_indicator_2 * @, sex * other_with_children_levels * @
PCT14 = hhtentotal, multig
PCT14@unit = hhtentotal * @, multig * @
"""
# Marginal histogram used for each family of tables
MARGINALS = """
presence65 * dhch_p19 * hhtenshort_3lev * race * hisp * multig = P19, H4, PCT14
family_nonfamily_size * race * hisp = PCT7
couple_own_child_rel * race * hisp * sex = PCT10
is65andover * relgq9cats_hhinst * sex * race7lev * hispanic = PCT9
hhspchildothgq_hhinst * agepct12 * sex = PCT8, PCT12
"""

# ---- reading --------------------------------------------------------------------------------


def _expand(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in text.strip().splitlines():
        name, _, body = line.partition(" = ")
        queries = [q.strip() for q in body.split(", ")]
        if "@" in name:
            base, kind = name.split("@")
            for letter, group in zip("ABCDEFGHI", GROUPS[kind].split()):
                g = group.replace("*", " * ")
                out[base + letter] = [q.replace("@", g) for q in queries]
        else:
            out[name] = queries
    return out


def tables(schema_name: str) -> dict[str, list[str]]:
    """Table name -> queries of a schema; empty where none are listed."""
    name = schema(schema_name).name
    common = {k: v for k, v in _expand(PL94).items() if k != "Geolevel_TVD"}
    if name == "HOUSEHOLD2010_SCHEMA":
        return _expand(HOUSEHOLD2010)
    if name == "REDUCED_DHCP_HHGQ_SCHEMA":
        return _expand(DHCP_HHGQ)
    if name == "PL94_SCHEMA":
        return _expand(PL94)
    if name == "PL94_P12_SCHEMA":
        return {**_expand(PL94_P12_TVD), **common}
    if name == "PL94_CVAP_SCHEMA":
        by_citizen = {
            f"{k}_CVAP": v + [(f"{q} * citizen" if q != "total" else "citizen") for q in v] for k, v in common.items() if k != "P42"
        }
        return {**common, **by_citizen}
    return {}


def workload(kind: str) -> dict[str, list[str]]:
    """'person' or 'unit' workload: table -> queries in order."""
    return _expand(PERSON_WORKLOAD if kind == "person" else UNIT_WORKLOAD)


def marginals() -> dict[str, list[str]]:
    return {k: v for k, v in _expand(MARGINALS).items()}


WORKLOAD_SCHEMA = {"person": "DHCP_SCHEMA", "unit": "DHCH_SCHEMA_TEN_3LEV"}
