"""Overlapping groups: seeding and assignment folds, strengths, evidence, proposals, timelines.

Seeding depends on the order of links, so it folds over them. A fold needs the links of one connected
component of the link graph, no more: groups never span components. Components are folded in
parallel; within one, links are bounded by the candidate cap per trace.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from .graph import components

#: Links of one component that a task folds.
MOST_LINKS = 5_000_000
ACTIVE = ("proposed", "supported", "confirmed")


def top_mean(values: Column, k: int = 3) -> Column:
    """Mean of the k largest; 0 for an empty array."""
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.when(F.size(values) > 0, F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).otherwise(F.lit(0.0))


def membership_strength(links: DataFrame, members: DataFrame, prototype: DataFrame | None = None) -> DataFrame:
    """``trace_id, group_id, strength, n_links``: mean of a trace's three best links into a group.

    ``links`` is symmetric (a, b, p). With a prototype probability the two are blended 0.7 to 0.3.
    """
    into = links.join(members.select(F.col("trace_id").alias("b"), "group_id"), "b").groupBy(F.col("a").alias("trace_id"), "group_id")
    out = into.agg(top_mean(F.collect_list("p")).alias("strength"), F.count(F.lit(1)).alias("n_links"))
    if prototype is not None:
        w = S.PROTOTYPE_WEIGHT
        out = out.join(prototype, ["trace_id", "group_id"], "left").withColumn("strength", F.when(F.col("prototype").isNull(), F.col("strength")).otherwise((1 - w) * F.col("strength") + w * F.col("prototype"))).drop("prototype")
    return out.withColumn("strength", F.round("strength", 6))


def best_groups(strengths: DataFrame, rejected: DataFrame | None = None, tau: float = S.TAU_MEMBER, cap: int = S.MAX_MEMBERSHIPS) -> DataFrame:
    """A trace's groups with strength of at least tau, not rejected, the ``cap`` strongest."""
    rows = strengths.where(F.col("strength") >= tau)
    if rejected is not None:
        rows = rows.join(rejected, ["trace_id", "group_id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("strength").desc(), "group_id"))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= cap)


def membership_evidence(links: DataFrame, members: DataFrame) -> DataFrame:
    """Per trace and group: links, sums per evidence class as JSON text, distinct shared indicators.

    ``links``: a, b, p, classes (array), shared_indicators (array).
    """
    into = links.join(members.select(F.col("trace_id").alias("b"), "group_id"), "b").withColumnRenamed("a", "trace_id")
    base = into.groupBy("trace_id", "group_id").agg(F.count(F.lit(1)).alias("n_links"))
    by = into.select("trace_id", "group_id", "p", F.explode("classes").alias("class")).groupBy("trace_id", "group_id", "class").agg(F.round(F.sum("p"), 6).alias("sum"))
    by = by.groupBy("trace_id", "group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("sum")).alias("o"), "class", "sum"))), lambda x: F.concat_ws("=", x["class"], x["sum"].cast("string"))).alias("classes"))
    ind = into.select("trace_id", "group_id", F.explode("shared_indicators").alias("v")).distinct().groupBy("trace_id", "group_id").agg(F.array_sort(F.collect_list("v")).alias("indicators"))
    return base.join(by, ["trace_id", "group_id"], "left").join(ind, ["trace_id", "group_id"], "left")


def _fold(links: pd.DataFrame) -> pd.DataFrame:
    """Seeds and assignments of one component, links in order."""
    members: dict[str, dict[str, tuple[float, str]]] = {}
    of: dict[str, set[str]] = {}
    probs: dict[str, dict[str, float]] = {}
    for row in links.sort_values(["seq", "a", "b"]).itertuples():
        for x, y in ((row.a, row.b), (row.b, row.a)):
            probs.setdefault(x, {})[y] = row.p
            of.setdefault(x, set())
        if row.p >= S.TAU_SEED and row.n_classes >= 2 and not of[row.a] & of[row.b] and max(len(of[row.a]), len(of[row.b])) < S.MAX_MEMBERSHIPS:
            name = f"{min(row.a, row.b)}+{max(row.a, row.b)}"
            if name not in members:
                members[name] = {}
                for x in (row.a, row.b):
                    members[name][x] = (row.p, "supported")
                    of[x].add(name)
        for x in (row.a, row.b):
            _assign(x, members, of, probs)
    return pd.DataFrame([(g, t, s, state) for g, m in members.items() for t, (s, state) in m.items()], columns=["group_id", "trace_id", "strength", "state"])


def _assign(x, members, of, probs) -> None:
    scored = []
    for g in {g for y in probs[x] for g in of[y]} | of[x]:
        near, held = probs[x], members[g]  # the fewer are looked up in the others: a group may be as large as its component
        both = (y for y in held if y in near) if len(held) < len(near) else (y for y in near if y in held)
        ps = sorted((near[y] for y in both if y != x), reverse=True)[:3]
        scored.append((-(sum(ps) / len(ps) if ps else 0.0), g))
    for negative, g in sorted(scored):
        strength = -negative
        state = "supported" if strength >= S.TAU_SEED else "proposed" if strength >= S.TAU_MEMBER else "unsupported"
        if g in of[x]:
            members[g][x] = (strength, state)
            if state == "unsupported":
                of[x].discard(g)
        elif state != "unsupported" and len(of[x]) < S.MAX_MEMBERSHIPS:
            members[g][x] = (strength, state)
            of[x].add(g)


def fold_groups(links: DataFrame) -> DataFrame:
    """``group_id, trace_id, strength, state`` from links ``a, b, p, n_classes, seq`` in their order.

    A link with p of at least 0.8 and two classes of evidence seeds a group unless its ends share
    one or are in three; after each link both ends' memberships are refreshed. A component is folded
    in one task, as each step depends on those before: one of more than ``MOST_LINKS`` raises.
    """
    comp = components(links.select("a", "b"))
    rows = links.join(comp.select(F.col("node").alias("a"), "component"), "a")
    size = F.count(F.lit(1)).over(Window.partitionBy("component"))
    rows = rows.withColumn("component", F.when(size > MOST_LINKS, F.raise_error(F.concat(F.lit("too many links to fold in the component of "), F.col("component").cast("string")))).otherwise(F.col("component")))
    return rows.select("component", "a", "b", "p", "n_classes", "seq").groupBy("component").applyInPandas(lambda pdf: _fold(pdf), "group_id string, trace_id string, strength double, state string")


def seed_groups(links: DataFrame) -> DataFrame:
    """The batch variant: links by descending probability."""
    ranked = links.drop("seq").withColumn("seq", (-F.col("p") * 1e9).cast("long"))
    return fold_groups(ranked)


def batch_assign(links: DataFrame, members: DataFrame, tau: float = S.TAU_MEMBER, cap: int = S.MAX_MEMBERSHIPS) -> DataFrame:
    """Batch assignment: a member without a link counts as 0 among the three best.

    Only pairs of trace and group with some link can reach tau, so the others aren't made: missing
    links fill up to the group's size.
    """
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    into = links.join(members.select(F.col("trace_id").alias("b"), "group_id"), "b").groupBy(F.col("a").alias("trace_id"), "group_id").agg(F.collect_list("p").alias("ps"))
    own = members.select("trace_id", "group_id").withColumn("own", F.lit(1))
    rows = into.join(sizes, "group_id").join(own, ["trace_id", "group_id"], "left").where("own is null")
    best = F.slice(F.sort_array("ps", asc=False), 1, 3)
    rows = rows.withColumn("strength", F.round(F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.least(F.lit(3), F.col("members")), 6))
    held = members.groupBy("trace_id").agg(F.count(F.lit(1)).alias("held"))
    rows = rows.join(held, "trace_id", "left").where(F.col("strength") >= tau)
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy(F.col("strength").desc(), "group_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= cap - F.coalesce("held", F.lit(0))).select("trace_id", "group_id", "strength")


def decide(memberships: DataFrame, decisions: DataFrame, cap: int = S.MAX_MEMBERSHIPS) -> DataFrame:
    """Analysts' confirmed or rejected laid over memberships; a confirmation that passes the cap is refused."""
    rows = memberships.join(decisions.select("trace_id", "group_id", F.col("state").alias("decided")), ["trace_id", "group_id"], "full")
    active = F.sum(F.when(F.coalesce("decided", "state").isin(*ACTIVE), 1).otherwise(0)).over(Window.partitionBy("trace_id"))
    refused = (F.col("decided") == "confirmed") & ~F.coalesce(F.col("state"), F.lit("")).isin(*ACTIVE) & (active > cap)
    return rows.select("trace_id", "group_id", "strength", F.when(refused, F.col("state")).otherwise(F.coalesce("decided", "state")).alias("state"), refused.alias("refused"))


def active(memberships: DataFrame) -> DataFrame:
    return memberships.where(F.col("state").isin(*ACTIVE))


def groups_of(memberships: DataFrame, trace_id) -> DataFrame:
    """Active groups of a trace, the strongest first."""
    return active(memberships).where(F.col("trace_id") == trace_id).select("group_id", "strength", "state").orderBy(F.col("strength").desc(), "group_id")


def shared_groups(memberships: DataFrame, group_id) -> DataFrame:
    """``group_id, shared``: other groups that active members of a group are active in too."""
    m = active(memberships).select("trace_id", "group_id")
    own = m.where(F.col("group_id") == group_id).select("trace_id")
    return m.where(F.col("group_id") != group_id).join(own, "trace_id", "left_semi").groupBy("group_id").agg(F.count(F.lit(1)).alias("shared"))


def merge_proposals(memberships: DataFrame, strong: float = S.STRONG_MEMBER) -> DataFrame:
    """``group_a, group_b, shared, members``: groups with a strong member in common; nothing is merged."""
    m = active(memberships).where(F.col("strength") >= strong).select("trace_id", "group_id")
    pairs = m.toDF("trace_id", "group_a").join(m.toDF("trace_id", "group_b"), "trace_id").where("group_a < group_b")
    return pairs.groupBy("group_a", "group_b").agg(F.count(F.lit(1)).alias("shared"), F.array_join(F.array_sort(F.collect_list(F.col("trace_id").cast("string"))), ",").alias("members"))


def group_timeline(memberships: DataFrame, traces: DataFrame) -> DataFrame:
    """Active members' spans of time in order of start, then id."""
    rows = active(memberships).join(traces.select("trace_id", "start_ts", "end_ts"), "trace_id")
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("start_ts", "trace_id"))
    return rows.select("group_id", place.cast("long").alias("position"), "trace_id", "start_ts", "end_ts")
