"""A Merkle manifest of a dataset as a content-addressed graph that is descended by rank digits.

Rows are leaves, ordered inside their group; every two consecutive nodes become their parent until one is left, and
the groups' roots become one root in the same way. The graph is stored as records from digest to children. A record spans
``DIGITS`` levels: it lists the nodes of one aligned subtree level by level, so a forest of n leaves takes
log n / ``DIGITS`` passes. Requests start at the root and go down by the digits of the wanted ranks; each
step looks a digest up among the records and collects the children that were not chosen. The
collected segments, reversed, are the proofs.

Requests that share a prefix travel as one row until they part, so the root is looked up once and no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrane.llm.common import written

#: Levels that one record spans: it lists up to 2 ** DIGITS children and the nodes between.
DIGITS = 8
#: Runs of a group in one partition: so many are broadcast after being counted, more are shuffled.
BROADCAST_RUNS = 100_000

_STEP = "struct<sibling: string, right: boolean>"


@dataclass(frozen=True)
class Forest:
    """One tree a group. ``records[t]`` maps a digest to the nodes below it, for the t-th tier of levels from the leaves."""

    segments: DataFrame  # lowest tier: group, prefix, members (the rows carried along, by rank)
    records: list[DataFrame]  # digest, levels
    roots: DataFrame  # group, total, digest


@dataclass(frozen=True)
class Manifest:
    groups: Forest
    top: Forest  # its leaves are the roots of the groups


def digest_of_fields(columns: Sequence[str], changed: dict[str, Column] | None = None) -> Column:
    """sha256 of the fields: ``-`` for null, else UTF-8 byte count, a colon and the value; ``changed`` values go first."""

    def field(name: str) -> Column:
        value = (changed or {}).get(name, F.col(f"`{name}`")).cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, columns)), 256)


def ranked(leaves: DataFrame) -> DataFrame:
    """Add ``rank`` inside ``group`` (gapless from 0) by ``key`` and ``leaf``, and ``total``, the group's size.

    Rows are sorted by range over the cluster, so a group with most of the rows lies in many partitions; the
    counts of its earlier partitions are added to the places inside one. Equal rows are told apart
    by the place they were written at.
    """
    first = written(leaves.withColumn("__nth", F.monotonically_increasing_id()))
    order = ["group", F.asc_nulls_first("key"), "leaf", "__nth"]
    dealt = first.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(
        dealt.drop("__nth").select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    )
    earlier = W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    counted = placed.groupBy("group", "part").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("rows"))
    runs = written(
        counted.select(
            "group", "part", "low",
            F.coalesce(F.sum("rows").over(earlier), F.lit(0).cast("long")).alias("start"),
            F.sum("rows").over(W.partitionBy("group")).alias("total"),
        )
    )
    known = F.broadcast(runs) if runs.count() <= BROADCAST_RUNS else runs
    return placed.join(known, ["group", "part"]).withColumn("rank", F.col("at") - F.col("low") + F.col("start")).drop("part", "at", "low", "start")


def _levels(tier: int) -> Column:
    """From ``nodes`` (a subtree's children in order) all its levels, the last with one node.

    Below the group's top a subtree rises by all its levels even if it is the last and holds few nodes.
    """
    size = 1 << DIGITS
    at_tier = f"((total - 1) div {size**tier}L + 1)"
    height = f"(case when {at_tier} > {size} then {DIGITS} when {at_tier} = 1 then 0 else length(bin({at_tier} - 1)) end)"
    up = "transform(sequence(0, (size(below) - 1) div 2), i -> sha2(concat(below[2 * i], coalesce(get(below, 2 * i + 1), '')), 256))"
    last = "element_at(made, -1)"
    rise = f"concat(made, transform(array({last}), below -> {up}))"
    steps = f"if({height} = 0, cast(array() as array<int>), sequence(1, {height}))"
    return F.expr(f"aggregate({steps}, array(nodes), (made, _step) -> {rise})")


def forest(leaves: DataFrame, carried: Sequence[str] = ()) -> Forest:
    """Trees over ``leaves`` (``group`` a string and not null, ``key``, ``leaf``); ``carried`` columns come back with the proofs."""
    held = ranked(leaves).withColumn("prefix", F.shiftright("rank", DIGITS))
    member = F.struct("rank", "leaf", *carried)
    lowest = written(held.groupBy("group", "total", "prefix").agg(F.array_sort(F.collect_list(member)).alias("members")))
    largest = lowest.agg(F.max("total")).first()[0] or 1
    nodes = lowest.withColumn("nodes", F.transform("members", lambda m: m["leaf"]))
    records, tier = [], 0
    while True:
        risen = nodes.select("group", "total", "prefix", _levels(tier).alias("levels"))
        risen = written(risen.withColumn("digest", F.expr("element_at(levels, -1)[0]")))
        records.append(risen.where("size(levels) > 1").select("digest", "levels").dropDuplicates(["digest"]))
        tier += 1
        if largest <= 1 << DIGITS * tier:
            return Forest(lowest.select("group", "prefix", "members"), records, risen.select("group", "total", "digest"))
        gathered = F.array_sort(F.collect_list(F.struct("prefix", "digest")))
        parents = risen.groupBy("group", "total", F.shiftright("prefix", DIGITS).alias("parent")).agg(gathered.alias("rows"))
        nodes = parents.select("group", "total", F.col("parent").alias("prefix"), F.transform("rows", lambda r: r["digest"]).alias("nodes"))


def build(df: DataFrame, group: str, key: str, fields: Sequence[str], carried: Sequence[str] = ()) -> Manifest:
    """The manifest of ``df``: leaves digest ``fields``, trees are one a value of ``group`` (null first), by ascending ``key``.

    Nulls in any column are fields of their own (``-``); a null key comes first. Rows with equal keys are ordered by
    their digests, and rows that are equal throughout are leaves of their own. Other columns, whatever their
    names, are left out unless ``carried``. An empty table has a manifest without leaves and without a root.
    """
    named = F.col(f"`{group}`").cast("string")
    leaves = df.select(
        F.when(named.isNull(), "n").otherwise(F.concat(F.lit("s"), named)).alias("group"),  # n sorts before s
        F.col(f"`{key}`").alias("key"),
        digest_of_fields(fields).alias("leaf"),
        *[F.col(f"`{c}`") for c in carried],
    )
    groups = forest(leaves, carried)
    roots = groups.roots.select(F.lit("all").alias("group"), F.col("group").alias("key"), F.col("digest").alias("leaf"), F.col("group").alias("of"))
    return Manifest(groups, forest(roots, ["of"]))


def _descend(found: Forest, requests: DataFrame, kept: Sequence[str], wanted: DataFrame | None) -> DataFrame:
    """Open the records under the ``requests`` (group, prefix, digest, path, ``kept``) down to the wanted leaves.

    Returns ``member`` (the leaf with what was carried) and ``path``, the segments from the root down.
    """
    sibling = "get(nodes, cast(shiftright(digit, j) as int) ^ 1)"
    segment = f"transform(slice(levels, 1, size(levels) - 1), (nodes, j) -> cast(struct({sibling}, (shiftright(digit, j) & 1) = 1) as {_STEP}))"
    for tier in range(len(found.records) - 1, -1, -1):
        opened = requests.join(found.records[tier], "digest", "left")
        # Without a record the digest is the only node here: the tree is lower than this tier.
        opened = opened.withColumn("levels", F.coalesce("levels", F.array(F.array("digest"))))
        if tier == 0:
            opened = opened.join(found.segments, ["group", "prefix"])
        digit = F.explode(F.expr("sequence(0, size(levels[0]) - 1)")).alias("digit")
        opened = opened.select("*", digit)
        child = opened.select(
            "group", *kept, (F.shiftleft("prefix", DIGITS) + F.col("digit")).alias("prefix"), F.expr("levels[0][digit]").alias("digest"),
            F.concat("path", F.array(F.expr(segment))).alias("path"), *([F.expr("members[digit]").alias("member")] if tier == 0 else []),
        )
        if wanted is not None:
            asked = wanted.select("group", F.shiftright("rank", DIGITS * tier).alias("prefix")).distinct()
            child = child.join(asked, ["group", "prefix"], "left_semi")
        requests = child
    return requests.select("group", *kept, "member", "path")


def proofs(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """One row for every leaf, or for each of ``wanted`` (``group``, ``rank``): ``member``, ``subroot``, ``root`` and ``path``.

    ``path`` lists from the leaf up (``sibling``, ``right``): the other node of each pair, null if there is none, and
    whether the path's own node is the right one. A wanted leaf that does not exist gives no row.
    """
    start = [F.lit(0).cast("long").alias("prefix"), F.expr(f"cast(array() as array<array<{_STEP}>>)").alias("path")]
    top = manifest.top.roots.select("group", "digest", F.col("digest").alias("root"), *start)
    reached = _descend(manifest.top, top, ["root"], None)
    requests = reached.select(
        F.col("member.of").alias("group"), "root", F.col("member.leaf").alias("digest"), F.col("member.leaf").alias("subroot"), start[0], "path"
    )
    if wanted is not None:
        requests = requests.join(wanted.select("group").distinct(), "group", "left_semi")
    found = _descend(manifest.groups, requests, ["root", "subroot"], wanted)
    return found.withColumn("path", F.flatten(F.reverse("path")))


def proof_digest(path: str = "path") -> Column:
    """sha256 of all siblings from the leaf up; of nothing if there is none."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["sibling"]), ""), 256)


def folded(leaf: str, path: str = "path") -> Column:
    """The root that a leaf and its siblings give."""
    pair = "case when s.sibling is null then node when s.right then concat(s.sibling, node) else concat(node, s.sibling) end"
    return F.expr(f"aggregate({path}, {leaf}, (node, s) -> sha2({pair}, 256))")


def verify(df: DataFrame, group: str, key: str, fields: Sequence[str], tampered: dict[str, Column]) -> DataFrame:
    """Build the manifest of ``df`` and fold every row's leaf back to the root, with the ``tampered`` columns in the place of its own.

    Returns ``key``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified``, a row each. Edge
    cases are those of ``build``; of an empty table nothing is returned.
    """
    both = df.withColumns({"__key": F.col(f"`{key}`"), "__changed": digest_of_fields(fields, tampered)})
    manifest = build(both, group, key, fields, ["__key", "__changed"])
    found = proofs(manifest).select("*", "member.*")
    rows = found.select(
        F.col("__key").alias(key), "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded("__changed").alias("folded_root")
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
