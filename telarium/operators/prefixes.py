"""Longest matching prefixes of texts, paths and addresses in tables of any size.

A table of prefixes has few different lengths. Each distinct text is cut to
those lengths, the cuts are joined to the table by equality, and the longest
hit is kept: no range join, no row with a list of all prefixes. Networks are
prefixes of an address's bits.

Texts are made distinct before the join, so a frequent one is looked up once.
The shortest prefixes, which many texts share, are broadcast as long as they
are ``SENT`` rows together; the others are joined by a shuffle.

Defined cases: a null text finds nothing. Of equal prefixes one is kept. The
empty prefix fits every text. An address or network that is none finds nothing
and is found by nothing; bits beyond a network's length don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.functions.scalars import ip4

#: Prefixes that are broadcast.
SENT = 200_000


def longest(rows: DataFrame, text: Column, table: DataFrame, prefix: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``found``: a struct of the columns of the row of ``table`` whose ``prefix`` is the longest that ``text`` begins with.

    ``by``: columns in which row and prefix must agree too.
    """
    kept = [c for c in table.columns if c not in by]
    known = table.where(F.col(prefix).isNotNull()).groupBy(*by, prefix).agg(*(F.first(c).alias(c) for c in kept if c != prefix))
    known = known.select(*(F.col(c).alias(f"of_{i}") for i, c in enumerate(by)), F.col(prefix).alias("prefix"), F.struct(*kept).alias("found"))
    sizes = known.groupBy(F.length("prefix").alias("size")).agg(F.count("*").alias("n")).orderBy("size").collect()  # as many as there are lengths
    total, near = 0, -1
    for size, n in sizes:
        total += n
        near = size if total <= SENT else near
    names = [f"key_{i}" for i in range(len(by))]
    # the caller's row is one struct, so that none of its columns can be taken for one of these
    base = rows.select(F.struct("*").alias("row"), text.alias("of_text"), *(F.col(c).alias(f"own_{n}") for c, n in zip(by, names, strict=True)))
    probes = base.select(F.col("of_text").alias("text"), *(F.col(f"own_{n}").alias(n) for n in names)).where("text IS NOT NULL").distinct()
    same = [F.col(n).eqNullSafe(F.col(f"of_{i}")) for i, n in enumerate(names)]
    hits = None
    for part, some in ((F.broadcast(known.where(F.length("prefix") <= near)), [s for s, _ in sizes if s <= near]), (known.where(F.length("prefix") > near), [s for s, _ in sizes if s > near])):
        if some:
            lengths = F.filter(F.array(*map(F.lit, some)), lambda n: n <= F.length("text"))
            cuts = probes.withColumn("size", F.explode(lengths)).withColumn("cut", F.expr("left(text, size)"))
            met = cuts.join(part, reduce(lambda a, b: a & b, [F.col("cut") == F.col("prefix"), *same])).select("text", *names, "size", "found")
            hits = met if hits is None else hits.unionAll(met)
    columns = [F.col("row").getField(c).alias(c) for c in rows.columns]
    if hits is None:
        return base.select(*columns, F.lit(None).cast(known.schema["found"].dataType).alias("found"))
    best = hits.groupBy("text", *names).agg(F.max_by("found", "size").alias("found"))
    equal = [F.col(f"own_{n}").eqNullSafe(F.col(n)) for n in names]
    return base.join(best, reduce(lambda a, b: a & b, [F.col("of_text") == F.col("text"), *equal]), "left").select(*columns, "found")


def groups6(address: Column) -> Column:
    """The eight groups of an IPv6 address; null for other text."""
    parts = F.split(F.lower(address), "::", 2)
    side = lambda i: F.filter(F.split(F.coalesce(F.get(parts, F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    groups = F.concat(side(0), F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(side(0)) - F.size(side(1)))), side(1))
    return F.when(F.lower(address).rlike("^[0-9a-f:]*:[0-9a-f:]*$") & (F.size(groups) == 8) & ~F.exists(groups, lambda g: F.length(g) > 4), groups)


def digits6(address: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address; null for other text."""
    return F.array_join(F.transform(groups6(address), lambda g: F.lpad(g, 4, "0")), "")


def bits(address: Column) -> Column:
    """The version of an address and its bits, as text: ``4`` and 32 bits, or ``6`` and 128; null for other text."""
    six = F.array_join(F.transform(groups6(address), lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")
    return F.coalesce(F.concat(F.lit("4"), F.lpad(F.bin(ip4(address)), 32, "0")), F.concat(F.lit("6"), six))


def network_prefixes(networks: DataFrame, network: str) -> DataFrame:
    """``networks`` with ``prefix``: what the ``bits`` of their addresses begin with; null for text that is none."""
    rows = networks.withColumn("bits", bits(F.substring_index(network, "/", 1)))
    whole = F.length("bits") - 1
    size = F.when(F.col(network).contains("/"), F.substring_index(network, "/", -1).try_cast("int")).otherwise(whole)
    return rows.withColumn("prefix", F.when((size >= 0) & (size <= whole), F.left("bits", size + 1))).drop("bits")


def networks_of(rows: DataFrame, address: Column, networks: DataFrame, network: str = "network") -> DataFrame:
    """``rows`` with ``found``: the row of ``networks``, as a struct, of the innermost network that holds the address."""
    table = networks.select(F.struct("*").alias("row"), F.col(network).alias("network"))
    table = network_prefixes(table, "network").select("row", "prefix")
    found = longest(rows, bits(address), table, "prefix")
    return found.withColumn("found", F.col("found.row"))


def dos_paths(rows: DataFrame, path: str, mounts: DataFrame) -> DataFrame:
    """``rows`` with the device at the head of ``path`` replaced by its root, by the ``mounts`` (host, device, root) of the row's host."""
    found = longest(rows, F.col(path), mounts.select("host", "device", "root"), "device", ("host",))
    text = F.when(F.col("found").isNull(), F.col(path)).otherwise(F.concat("found.root", F.expr(f"substring(`{path}`, length(found.device) + 1)")))
    return found.withColumn(path, text).drop("found")
