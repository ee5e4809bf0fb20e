import pytest

from stemtally.catalog import attributes as at, frames as fr, schemas as sc, tables as tb
from stemtally.operators import workloads as wl


def test_sizes():
    want = {"PL94_SCHEMA": 2016, "DHCP_SCHEMA": 1227744, "DHCH_SCHEMA": 1052352, "DHCH_SCHEMA_TEN_3LEV": 1578528, "DHCH_SCHEMA_FULLTENURE": 2104704}
    assert {k: sc.schema(k).size for k in want} == want
    assert len(sc.schema_names(False)) == 28 and len(sc.schema_names()) == 36
    assert len(at.ATTRIBUTES) == 42


def test_household_types_are_distinct():
    types = at.household_types()
    assert len(types) == 522 and len({at.household_label(t) for t in types}) == 522
    assert types[0]["MARRIED_OPPOSITE_SEX"] == 1 and types[0]["SIZE"] == 3
    assert at.household_label(types[392]) == "Size 1, not multig, no spouse or partner, living alone, no c"
    couples = dict(at.ATTRIBUTES["HHTypeDHCHAttr"].recodes["type3_couple_with_child"])
    assert couples["Size 3, couple with one child"] == [0, 17, 86, 103, 172, 189, 282, 299]
    four = dict(at.ATTRIBUTES["HHTypeDHCHAttr"].recodes["type4_couple_with_twochildren"])
    assert four["Size 4, couple with two children"] == [34, 120, 206, 316]


def test_races():
    labels = at.ATTRIBUTES["CenraceAttr"].levels
    assert labels[:7] == ["white", "black", "aian", "asian", "nhopi", "sor", "white-black"] and labels[62] == "white-black-aian-asian-nhopi-sor"
    white = dict(at.ATTRIBUTES["CenraceAttr"].recodes["whitecombo"])["White alone or in combination"]
    assert white[:7] == [0, 6, 7, 8, 9, 10, 21] and len(white) == 32


def test_names():
    s = sc.schema("PL94")
    q = s.query("cenrace * votingage")
    assert q.row_shape == (1, 2, 1, 63)
    for bad in ("total * hispanic", "cenrace * majorRaces", "nothing"):
        with pytest.raises(sc.UnknownQuery):
            s.query(bad)
    with pytest.raises(ValueError):
        s.add_recode("majorRaces", 3, [])
    assert "majorRaces" not in s.without_recode("majorRaces").recodes
    assert sc.same_name("a * b", "b*a") and sc.query_name(sc.file_name("a*b")) == "a * b"


def test_tables():
    assert {k: len(tb.tables(k)) for k in ("Household2010", "DHCP_HHGQ", "PL94_CVAP", "PL94_P12", "PL94")} == {
        "Household2010": 53, "DHCP_HHGQ": 54, "PL94_CVAP": 9, "PL94_P12": 6, "PL94": 6}
    person, unit = tb.workload("person"), tb.workload("unit")
    assert (len(person), sum(map(len, person.values())), len(unit), sum(map(len, unit.values()))) == (12, 58, 32, 146)
    assert wl.tables_of_marginal("family_nonfamily_size * race * hisp") == ["PCT7"]


def test_redistricting():
    preds = dict(wl.redistricting_predicates())
    assert len(preds) == 298
    assert preds["P0010001"] == "" and preds["P0010071"] == "cenrace in ('63')"
    assert preds["P0040012"].startswith("voting_age in ('2') and hispanic in ('1') and cenrace in ('07', '08'")
    assert preds["P0050007"] == "hhgq in ('5', '6', '7')"


def test_frames(spark):
    labels = fr.crossed_labels(spark, sc.schema("PL94"), "hispanic * votingage").orderBy("row_ix").collect()
    assert [r.level for r in labels][:2] == ["17 and under BY Not Hispanic or Latino", "17 and under BY Hispanic or Latino"]
    swapped = fr.crossed_labels(spark, sc.schema("PL94"), "hispanic * votingage", order=["hispanic", "votingage"]).orderBy("row_ix").first().level
    assert swapped == "Not Hispanic or Latino BY 17 and under"
    kinds = {(r["class"], r.recode): r.kind for r in fr.recode_kinds(fr.recode_level(spark, ["AgeAttr"]), fr.dim_level(spark)).collect()}
    assert kinds["AgeAttr", "prefix_agecats"] == "overlapping" and kinds["AgeAttr", "voting"] == "subset" and kinds["AgeAttr", "agecat43"] == "partition"
    rows = wl.published_rows(spark, "person")
    assert rows.filter("TABLE = 'PCT12' and QUERY = 'total'").count() == 1
    assert [r.row_num for r in rows.orderBy("row_num").select("row_num").collect()] == list(range(1, rows.count() + 1))
    assert fr.table_queries(spark, "PL94", ["P1", "hispanic", "unknown"]).count() == 4
