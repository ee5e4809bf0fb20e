"""The catalog as DataFrames, and schema questions answered with them."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stemtally.catalog import attributes as at, schemas as sc, tables as tb
from stemtally.operators.tabulate import levels_of


def schema_attributes(spark: SparkSession) -> DataFrame:
    """(schema, pos, attr, class, size, source): one row per attribute of each schema; aliases included."""
    rows = [
        (n, p, a.name, a.cls, a.size, list(a.source))
        for n in sc.schema_names() for p, a in enumerate(sc.schema(n).attributes)
    ]
    return spark.createDataFrame(rows, "schema string, pos int, attr string, class string, size int, source array<string>")


def related_schemas(spark: SparkSession) -> DataFrame:
    """(schema, unit_schema, constraint_schema)."""
    rows = [(n, sc.unit_schema(n), sc.constraint_schema(n)) for n in sc.schema_names()]
    return spark.createDataFrame(rows, "schema string, unit_schema string, constraint_schema string")


def dim_level(spark: SparkSession, classes: Iterable[str] | None = None) -> DataFrame:
    """(class, attr, level_ix, label)."""
    rows = [
        (a.cls, a.name, i, label) for a in at.ATTRIBUTES.values() if classes is None or a.cls in set(classes)
        for i, label in enumerate(a.levels)
    ]
    return spark.createDataFrame(rows, "class string, attr string, level_ix int, label string")


def recode_level(spark: SparkSession, classes: Iterable[str] | None = None) -> DataFrame:
    """(class, attr, recode, group_ix, group_label, level_ix): many-to-many."""
    rows = [
        (a.cls, a.name, r, g, label, levels)
        for a in at.ATTRIBUTES.values() if classes is None or a.cls in set(classes)
        for r, groups in a.recodes.items() for g, (label, levels) in enumerate(groups)
    ]
    df = spark.createDataFrame(rows, "class string, attr string, recode string, group_ix int, group_label string, levels array<int>")
    return df.select("class", "attr", "recode", "group_ix", "group_label", F.explode("levels").alias("level_ix"))


def recode_kinds(recodes: DataFrame, levels: DataFrame) -> DataFrame:
    """(class, recode, kind): 'partition', 'subset' or 'overlapping'."""
    size = levels.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    per = recodes.groupBy("class", "recode").agg(
        F.count(F.lit(1)).alias("pairs"), F.countDistinct("level_ix").alias("covered")
    )
    kind = F.when(F.col("pairs") > F.col("covered"), "overlapping").when(F.col("covered") < F.col("size"), "subset").otherwise("partition")
    return per.join(size, "class").select("class", "recode", kind.alias("kind"))


def with_default_labels(levels: DataFrame) -> DataFrame:
    """Labels, or dim_i for an attribute where some label is missing; (attr, level_ix, label)."""
    whole = levels.groupBy("attr").agg(F.bool_and(F.col("label").isNotNull()).alias("complete"))
    return levels.join(whole, "attr").select(
        "attr", "level_ix", F.when(F.col("complete"), F.col("label")).otherwise(F.concat_ws("_", "attr", "level_ix")).alias("label")
    )


def group_labels(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """Default label of a group: its level labels joined by '.'; groups (recode, group_ix, level_ix)."""
    joined = groups.join(levels.select("level_ix", "label"), "level_ix")
    parts = F.array_sort(F.collect_list(F.struct("level_ix", "label")))  # at most the levels of one attribute
    return joined.groupBy("recode", "group_ix").agg(F.array_join(F.transform(parts, lambda s: s["label"]), ".").alias("group_label"))


def crossed_labels(spark: SparkSession, schema: sc.Schema, name: str, order: list[str] | None = None) -> DataFrame:
    """(query, row_ix, level): labels of every row, attributes joined by ' BY ' in schema (or given) order."""
    labels = schema.labels(name)
    if order is not None:
        kept = [schema.dims[d] for d, _ in schema.parts(name)]
        labels = [labels[kept.index(o)] for o in order if o in kept]
    shape = [len(x) for x in labels]
    n = reduce(lambda a, b: a * b, shape, 1)
    parts = [
        F.get(F.array(*[F.lit(t) for t in texts]), ix) for texts, ix in zip(labels, levels_of(F.col("id"), shape))
    ]
    return spark.range(n).select(F.lit(name).alias("query"), F.col("id").alias("row_ix"), F.concat_ws(sc.BY, *parts).alias("level"))


def resolve(spark: SparkSession, schema: sc.Schema, names: list[str]) -> DataFrame:
    """(name, valid): every part must be a base of the schema, 'total' and 'detailed' only alone, no attribute twice."""
    asked = spark.createDataFrame([(n,) for n in names], "name string")
    bases = [(d, d) for d in schema.dims] + [(r, schema.dims[d]) for r, (d, _) in schema.recodes.items()]
    known = spark.createDataFrame([*bases, ("total", None), ("detailed", None)], "base string, dim string")
    parts = asked.select("name", F.explode(F.split(F.trim("name"), sc.SPLIT)).alias("base"))
    judged = parts.join(known.withColumn("known", F.lit(True)), "base", "left").groupBy("name").agg(
        F.bool_and(F.col("known").isNotNull()).alias("all_known"), F.count(F.lit(1)).alias("n"),
        F.count("dim").alias("with_dim"), F.countDistinct("dim").alias("dims"),
    )
    ok = F.col("all_known") & (F.col("with_dim") == F.col("dims")) & ((F.col("n") == 1) | (F.col("with_dim") == F.col("n")))
    return judged.select("name", ok.alias("valid"))


def nway_names(spark: SparkSession, schema: sc.Schema, ways: list[int], include: list[str] = (), ignore: list[str] = ()) -> DataFrame:
    """(name, ways): all crosses of the given arity, sorted names; the full cross is 'detailed', the empty one 'total'.

    Crosses of two bases over one attribute are left out.
    """
    bases = [(p, d, p) for p, d in enumerate(schema.dims) if d not in ignore]
    bases += [(len(schema.dims) + i, r, d) for i, (r, (d, _)) in enumerate(schema.recodes.items()) if r not in ignore]
    listed = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(b).alias("base"), F.lit(d).alias("dim")) for p, b, d in bases])
    level = spark.range(1).select(
        listed.alias("bases"), F.lit(-1).alias("last"), F.array().cast("array<string>").alias("parts"), F.array().cast("array<int>").alias("dims")
    )
    out = []
    for w in range(max(ways) + 1):
        if w in ways:
            out.append(level.select("parts", F.lit(w).alias("ways")))
        later = F.filter("bases", lambda b: (b["pos"] > F.col("last")) & ~F.array_contains("dims", b["dim"]))
        level = level.select("bases", "parts", "dims", F.inline(later)).select(
            "bases", F.col("pos").alias("last"), F.array_append("parts", F.col("base")).alias("parts"), F.array_append("dims", F.col("dim")).alias("dims")
        )
    crosses = reduce(DataFrame.unionByName, out)
    for i in include:
        crosses = crosses.filter(F.array_contains("parts", i))
    full = F.array(*[F.lit(d) for d in schema.dims])
    name = F.when(F.col("ways") == 0, "total").when(F.col("parts") == full, "detailed").otherwise(F.array_join("parts", sc.CROSS))
    return crosses.select(name.alias("name"), "ways")


def sorted_name(name: str | Column) -> Column:
    """Parts of a crossed name in alphabetical order: equal for equal queries."""
    c = F.col(name) if isinstance(name, str) else name
    return F.array_join(F.array_sort(F.split(F.trim(c), sc.SPLIT)), sc.CROSS)


def to_file_name(name: str | Column) -> Column:
    return F.regexp_replace(name, sc.SPLIT, ".")


def to_query_name(file: str | Column) -> Column:
    return F.regexp_replace(file, r"\.", sc.CROSS)


def table_queries(spark: SparkSession, schema_name: str, names: list[str]) -> DataFrame:
    """Distinct queries of tables; a name that is no table counts as a query, unknown ones vanish. (query)"""
    listed = tb.tables(schema_name)
    s = sc.schema(schema_name)
    rows = [(q,) for n in names for q in (listed[n] if n in listed else [n] if s.knows(n) else [])]
    return spark.createDataFrame(rows, "query string").distinct()


def table_catalog(spark: SparkSession) -> DataFrame:
    """(schema, table, ix, query, valid) of all listed tables."""
    rows = [
        (n, t, i, q, sc.schema(n).knows(q))
        for n in sc.schema_names(aliases=False) for t, qs in tb.tables(n).items() for i, q in enumerate(qs)
    ]
    return spark.createDataFrame(rows, "schema string, table string, ix int, query string, valid boolean")


def recode_case(column: str | Column, groups: list[tuple[str, list[int]]], labels: bool = False) -> Column:
    """Level code -> group number or label as a CASE expression; '-1' outside, the last group wins overlaps."""
    c = F.col(column) if isinstance(column, str) else column
    winner = {}
    for g, (label, levels) in enumerate(groups):
        for i in levels:
            winner[i] = label if labels else str(g)
    out = None
    for i, text in winner.items():
        test = c == F.lit(str(i))
        out = F.when(test, F.lit(text)) if out is None else out.when(test, F.lit(text))
    return F.lit("-1") if out is None else out.otherwise(F.lit("-1"))


def recode_sql(dim: str, groups: list[tuple[str, list[int]]], labels: bool = False) -> str:
    """The same as SQL text."""
    winner = {i: (label if labels else str(g)) for g, (label, levels) in enumerate(groups) for i in levels}
    quoted = {i: t.replace("'", "''") for i, t in winner.items()}
    return "\n".join(["case", *[f"when {dim} = '{i}' then '{t}'" for i, t in quoted.items()], "else '-1' end"])


def replacement_map(groups: DataFrame) -> DataFrame:
    """(recode, replacement): map level -> group label; the last group wins overlaps."""
    last = groups.groupBy("recode", "level_ix").agg(F.max(F.struct("group_ix", "group_label")).alias("g"))
    pair = F.struct(F.col("level_ix").cast("string").alias("k"), F.col("g.group_label").alias("v"))
    return last.groupBy("recode").agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("replacement"))


def enumerate_cells(spark: SparkSession, schema: sc.Schema, mangled: bool = True, flat_index: bool = False) -> DataFrame:
    """Every cell as a row of level numbers (text), generated in parallel."""
    names = [f"{d}_{schema.name}" if mangled else d for d in schema.dims]
    cols = [lv.cast("string").alias(n) for n, lv in zip(names, levels_of(F.col("id"), schema.shape))]
    return spark.range(schema.size).select(*([F.col("id").cast("string").alias("flat_index")] if flat_index else []), *cols)


def level_subset(levels: DataFrame, indices: list[int]) -> DataFrame:
    return levels.filter(F.col("level_ix").isin(indices))


def race_codes(spark: SparkSession, races: tuple[str, ...] = at.RACES) -> DataFrame:
    """(ix, bits, label, n_races): combination codes, fewer races first, then '1' before '0'."""
    k = len(races)
    bits = F.lpad(F.bin(F.col("id")), k, "0")
    marks = F.split(bits, "")
    label = F.array_join(
        F.filter(F.transform(F.array(*[F.lit(r) for r in races]), lambda r, i: F.when(F.get(marks, i) == "1", r)), lambda r: r.isNotNull()), "-"
    )
    from pyspark.sql import Window

    codes = spark.range(1, 2**k).select(bits.alias("bits"), label.alias("label"), F.length(F.replace(bits, F.lit("0"), F.lit(""))).alias("n_races"))
    order = Window.orderBy("n_races", F.col("bits").desc())  # 2^k - 1 rows
    return codes.select(F.row_number().over(order).alias("ix"), "bits", "label", "n_races")


def household_dimension(spark: SparkSession) -> DataFrame:
    """One row per household type: hhtype, the indicator columns, SIZE and the description."""
    types = at.household_types()
    cols = ["hhtype", *types[0], "description"]
    rows = [(i, *t.values(), at.household_label(t)) for i, t in enumerate(types)]
    ddl = ", ".join([f"{c} int" for c in cols[:-1]] + ["description string"])
    return spark.createDataFrame(rows, ddl)


def stacked_unit_level(tenure: Column, vacancy: Column, facility: Column, with_tenure: bool = True) -> Column:
    """Level of the stacked tenure/vacancy/group-quarters attribute from source codes; NULL for unknown facilities.

    Without tenure all occupied units share level 0.
    """
    occupied = 4 if with_tenure else 1
    known = {c: at.facility_level(c) for c in (at.GQ_CODES + " " + at.GQ_CODES_TO_LAST).split()}
    code = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    unit = facility.isin("000", "   ")
    ten, vac = tenure.cast("int"), vacancy.cast("int")
    missing = F.assert_true((ten > 0) | (vac > 0) | ~unit, F.lit("tenure not set for an occupied unit"))
    home = F.when(vac > 0, vac + occupied - 1).otherwise(ten - 1 if with_tenure else F.lit(0))
    level = F.when(unit, home).otherwise(F.try_element_at(code, facility) + occupied + 7 - 1)
    return F.coalesce(missing.cast("int"), level)
