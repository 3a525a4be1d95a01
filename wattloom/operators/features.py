"""Spline features, interactions and the sites that may use them.

A formula is a list of ``Term``. Inputs are the long table (name_input,
transformation, parameter, location, split, ts, value). A block is one term at one
location (or one pair of locations); a feature is (block, idx).

Sites with the same assigned locations share one design, identified by ``sig``.
Each row of a design holds its few non-zero features as an array, so products of
features are formed inside the row and never by a join on time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Periods of the cyclic inputs.
PERIODS = {"hour": 24.0, "week_hour": 168.0, "year_day": 365.0}

EPSILON = 1e-12
KEY = ["name_input", "transformation", "parameter"]
FEATURE = "struct<block:string,idx:int,value:double>"


@dataclass(frozen=True)
class Factor:
    """One input and its basis: a number of intervals, or ``pN`` for powers 1..N."""

    name: str
    nodes: int | str = "p1"
    transformation: str = ""
    parameter: str = ""

    @property
    def period(self) -> float | None:
        return PERIODS.get(self.name) if isinstance(self.nodes, int) else None

    @property
    def power(self) -> int:
        return int(self.nodes[1:]) if isinstance(self.nodes, str) else 0

    @property
    def size(self) -> int:
        if self.power:
            return self.power
        return self.nodes if self.period else self.nodes + 1

    @property
    def key(self) -> str:
        return f"{self.name}:{self.transformation}:{self.parameter}:{self.nodes}"


@dataclass(frozen=True)
class Term:
    """A univariate term (one factor) or an interaction (two), with its penalty.

    With ``wrap``, second differences of a cyclic input go round its period.
    """

    factors: tuple[Factor, ...]
    penalty: str = ""
    alpha: tuple[float, ...] | float = 0.0
    structure: int | None = None
    wrap: bool = False

    @property
    def cyclic(self) -> tuple[bool, ...]:
        return tuple(self.wrap and f.period is not None for f in self.factors)

    @property
    def sizes(self) -> tuple[int, ...]:
        return tuple(f.size for f in self.factors)

    @property
    def size(self) -> int:
        return reduce(lambda a, b: a * b, self.sizes, 1)


def term_name(position: int) -> str:
    return f"t{position:02d}"


def factor_table(spark, formula: Sequence[Term]) -> DataFrame:
    """One row per distinct factor of the formula; its size is that of the formula."""
    factors = list(dict.fromkeys(f for term in formula for f in term.factors))
    rows = [
        (f.key, f.name, f.transformation, f.parameter, f.nodes if isinstance(f.nodes, int) else 0, f.power, f.period, f.size)
        for f in factors
    ]
    schema = (
        "factor string, name_input string, transformation string, parameter string, "
        "intervals int, power int, period double, size int"
    )
    return spark.createDataFrame(rows, schema)


def training_ranges(inputs: DataFrame) -> DataFrame:
    return inputs.filter("split = 'training'").groupBy(*KEY, "location").agg(
        F.min("value").alias("low"), F.max("value").alias("high")
    )


def nodes(inputs: DataFrame, factors: DataFrame) -> DataFrame:
    """Array of nodes per (factor, location), from the training range."""
    ranged = training_ranges(inputs).join(F.broadcast(factors.filter("power = 0")), KEY)
    count = F.col("intervals")
    plain = F.transform(F.sequence(F.lit(-1), count + 1), lambda i: F.col("low") + i / count * (F.col("high") - F.col("low")))
    cyclic = F.transform(F.sequence(F.lit(0), count - 1), lambda i: i / count * F.col("period"))
    return ranged.withColumn("nodes", F.when(F.col("period").isNull(), plain).otherwise(cyclic)).select(
        "factor", "location", "period", "size", "nodes"
    )


def triplets(node_table: DataFrame) -> DataFrame:
    """The three nodes of every basis function, wrapped around for cyclic inputs."""
    def at(offset: int) -> Column:
        return F.get(F.col("nodes"), (F.col("idx") + offset) % F.size("nodes"))

    return node_table.withColumn("idx", F.explode(F.sequence(F.lit(0), F.col("size") - 1))).select(
        "factor", "location", "idx", at(0).alias("left"), at(1).alias("centre"), at(2).alias("right")
    )


def _entries(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[F.struct(i.cast("int").alias("i"), v.cast("double").alias("v")) for i, v in pairs])


def basis(x: Column, low: Column, high: Column, intervals: Column, period: Column, power: Column) -> Column:
    """Non-zero basis functions of ``x`` as an array of (i, v).

    Hats: at most two are non-zero. Left of the training range the first two go
    on as straight lines; right of it the last one falls to zero in one interval.
    A constant training input has unit intervals with every hat on the same nodes.
    """
    step = (high - low) / intervals
    place = (x - low) / step
    left = F.floor(place)
    inside = _entries((left, 1 - (place - left)), (left + 1, place - left))
    before = _entries((F.lit(0), 1 - place), (F.lit(1), place))
    plain = F.when(place < 0, before).otherwise(inside)

    away = x - low
    tent = F.least(away, 2 - away)
    rest = F.transform(F.sequence(F.lit(1), intervals), lambda i: F.struct(
        i.cast("int").alias("i"), F.greatest(tent, F.when(i == 1, F.least(F.lit(0.0), away)).otherwise(0.0)).alias("v")
    ))
    constant = F.concat(_entries((F.lit(0), F.greatest(2 - away, F.lit(0.0)))), rest)

    turn = x / period * intervals
    hour = F.floor(turn)
    share = turn - hour
    around = _entries((F.pmod(hour - 1, intervals), 1 - share), (F.pmod(hour, intervals), share))
    beyond = _entries((intervals - 1, F.greatest(1 - (turn - intervals), F.lit(0.0))))
    cyclic = F.when(turn >= intervals, beyond).otherwise(around)

    powers = F.transform(F.sequence(F.lit(1), power), lambda k: F.struct(
        (k - 1).cast("int").alias("i"), F.pow(x, k).alias("v")
    ))
    chosen = (
        F.when(power > 0, powers)
        .when(period.isNotNull(), cyclic)
        .when(high == low, constant)
        .otherwise(plain)
    )
    last = F.when(period.isNotNull(), intervals - 1).otherwise(intervals)
    return F.filter(chosen, lambda e: (F.abs(e["v"]) > EPSILON) & ((power > 0) | (e["i"] <= last)))


def cells(inputs: DataFrame, factors: DataFrame) -> DataFrame:
    """Basis of every input value: (split, ts, factor, location, basis)."""
    ranges = training_ranges(inputs)
    joined = inputs.filter("value IS NOT NULL").join(F.broadcast(factors), KEY).join(ranges, [*KEY, "location"])
    values = basis(*[F.col(c) for c in ("value", "low", "high", "intervals", "period", "power")])
    return joined.select("split", "ts", "factor", "name_input", "location", "size", values.alias("basis"))


def block_name(position: int, *locations: Column) -> Column:
    return F.concat(F.lit(term_name(position) + "@"), F.concat_ws("|", *locations))


def _product(a: Column, b: Column, combine: str) -> Column:
    """Interaction of two cells as an array of (i, v), left index slowest."""
    width = b["size"]

    def pair(x: Column, y: Column) -> Column:
        value = F.least(x["v"], y["v"]) if combine == "minimum" else x["v"] * y["v"]
        return F.struct((x["i"] * width + y["i"]).cast("int").alias("i"), value.alias("v"))

    sparse = F.flatten(F.transform(a["basis"], lambda x: F.transform(b["basis"], lambda y: pair(x, y))))
    if combine != "minimum":
        return sparse

    def dense(cell: Column) -> Column:
        lookup = F.map_from_entries(cell["basis"])
        return F.transform(F.sequence(F.lit(0), cell["size"] - 1), lambda i: F.struct(
            i.cast("int").alias("i"), F.coalesce(F.element_at(lookup, i.cast("int")), F.lit(0.0)).alias("v")
        ))

    def negative(cell: Column) -> Column:
        return F.exists(cell["basis"], lambda e: e["v"] < 0)

    every = F.flatten(F.transform(dense(a), lambda x: F.transform(dense(b), lambda y: pair(x, y))))
    full = F.filter(every, lambda e: F.abs(e["v"]) > EPSILON)
    return F.when(negative(a) | negative(b), full).otherwise(sparse)


def _term_features(position: int, term: Term, combine: str, columns: Sequence[str] = ("cells", "cells")) -> Column:
    """Features of a term; the cells of its factors are in ``columns``."""
    def of(factor: Factor) -> Column:
        return F.filter(columns[term.factors.index(factor)], lambda c: c["factor"] == factor.key)

    def named(entries: Column, *locations: Column) -> Column:
        return F.transform(entries, lambda e: F.struct(
            block_name(position, *locations).alias("block"), e["i"].alias("idx"), e["v"].alias("value")
        ))

    if len(term.factors) == 1:
        return F.flatten(F.transform(of(term.factors[0]), lambda c: named(c["basis"], c["location"])))
    first, second = term.factors
    return F.flatten(F.flatten(F.transform(of(first), lambda a: F.transform(
        of(second), lambda c: named(_product(a, c, combine), a["location"], c["location"])
    ))))


def signatures(sites: DataFrame, assignment: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(site, sig) and (sig, name_input, location): sites with equal locations share a sig."""
    if assignment is None:
        none = sites.select(F.lit("all").alias("sig"), F.lit("").alias("name_input"), F.lit("").alias("location")).limit(0)
        return sites.select("site", F.lit("all").alias("sig")), none
    owned = assignment.groupBy("site").agg(
        F.array_sort(F.collect_set(F.struct("name_input", "location"))).alias("_owned")
    )
    signed = owned.withColumn("sig", F.sha2(F.to_json("_owned"), 256))
    by_site = sites.join(signed.select("site", "sig"), "site", "left").withColumn("sig", F.coalesce("sig", F.lit("all")))
    rows = signed.dropDuplicates(["sig"]).select("sig", F.explode("_owned").alias("_o"))
    return by_site, rows.select("sig", F.col("_o")["name_input"].alias("name_input"), F.col("_o")["location"].alias("location"))


def design(
    inputs: DataFrame, formula: Sequence[Term], sites: DataFrame, assignment: DataFrame | None = None,
    combine: str = "product",
) -> DataFrame:
    """(sig, split, ts, features): training nodes serve both splits.

    Inputs named in ``assignment`` (site, name_input, location) reach only the
    sites assigned to their location; the others are shared by all.
    """
    spark = inputs.sparkSession
    by_site, owned_locations = signatures(sites, assignment)
    base = cells(inputs, factor_table(spark, formula))
    packed = F.struct("factor", "location", "size", "basis").alias("cell")
    if assignment is None:
        keyed = base.select(F.lit("all").alias("sig"), "split", "ts", packed)
    else:
        owned_names = assignment.select("name_input").distinct()
        shared = base.join(owned_names, "name_input", "left_anti").select("split", "ts", packed)
        owned = base.join(owned_locations, ["name_input", "location"]).select("sig", "split", "ts", packed)
        return _assemble_owned(shared, owned, by_site, formula, combine)
    rows = keyed.groupBy("sig", "split", "ts").agg(F.collect_list("cell").alias("cells"))
    return _features(rows, formula, combine)


def _assemble_owned(shared: DataFrame, owned: DataFrame, by_site: DataFrame, formula, combine: str) -> DataFrame:
    """Shared cells once per time, then attached to every design at that time."""
    common = shared.groupBy("split", "ts").agg(F.collect_list("cell").alias("_shared"))
    own = owned.groupBy("sig", "split", "ts").agg(F.collect_list("cell").alias("_own"))
    rows = own.join(common, ["split", "ts"], "left").select(
        "sig", "split", "ts", F.concat("_own", F.coalesce("_shared", F.array().cast(_cell_type(own)))).alias("cells")
    )
    # sites without any assigned location see the shared inputs alone
    plain = by_site.filter("sig = 'all'").select("sig").distinct()
    alone = common.withColumn("sig", F.lit("all")).join(plain, "sig", "left_semi")
    rows = rows.unionByName(alone.select("sig", "split", "ts", F.col("_shared").alias("cells")))
    return _features(rows, formula, combine)


def _cell_type(own: DataFrame):
    return own.schema["_own"].dataType


def _features(rows: DataFrame, formula: Sequence[Term], combine: str) -> DataFrame:
    parts = [_term_features(i, term, combine) for i, term in enumerate(formula)]
    return rows.select("sig", "split", "ts", F.concat(*parts).alias("features"))


def parts(
    inputs: DataFrame, formula: Sequence[Term], sites: DataFrame, assignment: DataFrame | None = None,
    combine: str = "product",
) -> tuple[DataFrame, DataFrame]:
    """The design cut into units: (unit, split, ts, features) and (sig, unit).

    The features of shared inputs are one unit, named "", whatever the number of sites. Those of
    an input at one location (alone or with shared inputs) are a unit, and those of two assigned
    inputs at two locations that some site has both. A design is the union of its units.
    """
    by_site, places = signatures(sites, assignment)
    base = cells(inputs, factor_table(inputs.sparkSession, formula))
    packed = F.struct("factor", "location", "size", "basis").alias("cell")
    all_sigs = by_site.select("sig").distinct()
    names = {f.name for term in formula for f in term.factors}
    owned = set() if assignment is None else {
        r[0] for r in assignment.select("name_input").distinct().filter(F.col("name_input").isin(*names)).collect()}
    count = [sum(f.name in owned for f in term.factors) for term in formula]
    common = base.filter(~F.col("name_input").isin(*owned) if owned else F.lit(True)).groupBy("split", "ts").agg(
        F.collect_list(packed).alias("cells"))

    def featured(rows: DataFrame, unit: Column, among: int, columns: Sequence[str] = ("cells", "cells")) -> DataFrame:
        found = [_term_features(i, term, combine, columns) for i, term in enumerate(formula) if count[i] == among]
        none = F.array().cast(f"array<{FEATURE}>")
        return rows.select(unit.alias("unit"), "split", "ts", F.concat(*found, none).alias("features")).filter(F.size("features") > 0)

    rows = featured(common, F.lit(""), 0)
    units = all_sigs.select("sig", F.lit("").alias("unit"))
    if not owned:
        return rows, units
    name = F.concat("name_input", F.lit("@"), "location")
    own = base.join(assignment.select("name_input", "location").distinct(), ["name_input", "location"], "left_semi").groupBy(
        "name_input", "location", "split", "ts").agg(F.collect_list(packed).alias("_own")).withColumn("unit", name)
    alone = own.join(common, ["split", "ts"], "left").select(
        "unit", "split", "ts", F.concat("_own", F.coalesce("cells", F.array().cast(_cell_type(own)))).alias("cells"))
    rows = rows.unionByName(featured(alone, F.col("unit"), 1))
    of_sig = places.filter(F.col("name_input").isin(*owned)).select("sig", "name_input", name.alias("unit"))
    units = units.unionByName(of_sig.select("sig", "unit"))
    couples = {tuple(f.name for f in t.factors) for t, n in zip(formula, count, strict=True) if n == 2 and len(t.factors) == 2}
    for one, two in sorted(couples):
        both = F.concat("u1", F.lit("&"), "u2")
        first, second = (of_sig.filter(F.col("name_input") == n).select("sig", F.col("unit").alias(u)) for n, u in ((one, "u1"), (two, "u2")))
        pairs = first.join(second, "sig")
        left, right = (own.select(F.col("unit").alias(u), "split", "ts", F.col("_own").alias(c)) for u, c in (("u1", "_c1"), ("u2", "_c2")))
        met = pairs.select("u1", "u2").distinct().join(left, "u1").join(right, ["u2", "split", "ts"])
        rows = rows.unionByName(featured(met, both, 2, ("_c1", "_c2")))
        units = units.unionByName(pairs.select("sig", both.alias("unit")))
    return rows, units


def coordinates(design_rows: DataFrame) -> DataFrame:
    """Design in coordinate form: one row per non-zero."""
    return design_rows.select(
        *[c for c in design_rows.columns if c != "features"], F.inline("features")
    )


def mirrored(coo: DataFrame, width_left: int, width_right: int) -> DataFrame:
    """The same interaction with its factors swapped."""
    i, j = F.floor(F.col("idx") / width_right), F.col("idx") % width_right
    return coo.withColumn("idx", (j * width_left + i).cast("int"))


def blocks(inputs: DataFrame, formula: Sequence[Term], assignment: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Block table and its mask.

    The first frame is (block, term, size1, size2, size, shared). The second,
    (block, site), lists the sites of the owned blocks only: a shared block
    belongs to every site, which is a flag and not a product with the sites.
    An interaction of two owned inputs keeps the sites they have in common, and
    vanishes if there are none.
    """
    places = inputs.select(*KEY, "location").distinct()
    spark = inputs.sparkSession
    if assignment is None:
        assignment = spark.createDataFrame([], "site string, name_input string, location string")
    owned_names = assignment.select("name_input").distinct().withColumn("_owned", F.lit(True))
    located = places.join(owned_names, "name_input", "left").withColumn("shared", F.col("_owned").isNull())
    table = mask = None
    for position, term in enumerate(formula):
        sides = []
        for n, factor in enumerate(term.factors):
            match = (F.col("name_input") == factor.name) & (F.col("transformation") == factor.transformation) & (F.col("parameter") == factor.parameter)
            side = located.filter(match).select(F.col("location").alias(f"l{n}"), F.col("shared").alias(f"s{n}"))
            users = assignment.filter(F.col("name_input") == factor.name).select("site", F.col("location").alias(f"l{n}"))
            sides.append((side, users))
        sizes = [F.lit(term.sizes[0]).alias("size1"), F.lit(term.sizes[-1] if len(term.sizes) > 1 else 1).alias("size2"), F.lit(term.size).alias("size")]
        if len(sides) == 1:
            (side, users), = sides
            name = block_name(position, F.col("l0"))
            rows = side.select(name.alias("block"), F.lit(position).alias("term"), *sizes, F.col("s0").alias("shared"))
            sites = users.join(side.filter("NOT s0"), "l0", "left_semi").select(name.alias("block"), "site").distinct()
        else:
            (one, users_one), (two, users_two) = sides
            name = block_name(position, F.col("l0"), F.col("l1"))
            every_l0 = F.explode(one.filter("s0").agg(F.collect_set("l0")).scalar())
            every_l1 = F.explode(two.filter("s1").agg(F.collect_set("l1")).scalar())
            both = one.filter("s0").withColumn("l1", every_l1)
            shared_rows = both.select(name.alias("block"), F.lit(position).alias("term"), *sizes, F.lit(True).alias("shared"))
            left = users_one.withColumn("l1", every_l1).select("l0", "l1", "site")
            right = users_two.withColumn("l0", every_l0).select("l0", "l1", "site")
            common = users_one.join(users_two, "site").select("l0", "l1", "site")
            named = left.unionByName(right).unionByName(common)
            named = named.join(one, "l0", "left_semi").join(two, "l1", "left_semi")
            sites = named.select(name.alias("block"), "site").distinct()
            owned_rows = sites.select("block").distinct().select("block", F.lit(position).alias("term"), *sizes, F.lit(False).alias("shared"))
            rows = shared_rows.unionByName(owned_rows)
        table = rows if table is None else table.unionByName(rows)
        mask = sites if mask is None else mask.unionByName(sites)
    return table, mask


def blocks_sharing_a_site(mask: DataFrame) -> DataFrame:
    """Unordered pairs of owned blocks with at least one site in common.

    A site has as many blocks as the formula gives it, so the pairs per site do
    not grow with the data.
    """
    a, b = mask.select("site", F.col("block").alias("block1")), mask.select("site", F.col("block").alias("block2"))
    return a.join(b, "site").filter("block1 <= block2").select("block1", "block2").distinct()


def ownership(table: DataFrame, mask: DataFrame, sites: DataFrame) -> DataFrame:
    """Blocks of all sites and blocks of some, with the number of sites."""
    total = sites.agg(F.countDistinct("site")).scalar()
    counted = mask.groupBy("block").agg(F.countDistinct("site").alias("_n"))
    joined = table.join(counted, "block", "left")
    n = F.when(F.col("shared"), total).otherwise(F.coalesce("_n", F.lit(0)))
    return joined.select("block", n.cast("long").alias("n_sites"), F.when(n == total, "all").otherwise("some").alias("owner"))
