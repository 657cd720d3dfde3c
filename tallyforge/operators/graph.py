"""The typed graph: conditions compiled to semi and anti joins, rules, projections and structural checks.

A condition is a dict: {"attr", "eq" | "not" | "in" | "subset_of"}, {"inbound" | "outbound", "min"},
{"not_inbound" | "not_outbound"}, {"via" | "via_inbound", "where"}, {"any_of"}, {"not"}, {"projection"},
{"in_force"}. A list means all of them. All edge counts and neighbour tests of a set of conditions come
from two grouped tables, edges by their source and by their target, joined to the nodes by id."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import subset_of
from tallyforge.session import written

STRICT = ["MUST", "MUST_NOT"]
# The surfaces an edit may touch, and those that a person must approve.
SURFACES = ["system-prompt", "tool-description", "tool-implementation", "middleware", "skill", "subagent-config", "memory"]
HUMAN_APPROVED = ["system-prompt", "tool-description", "middleware", "subagent-config"]
ACCEPTED, IN_FORCE = {"attr": "status", "eq": "accepted"}, {"in_force": True}
MODAL = {"attr": "modality", "in": STRICT}
SUCCESSOR = {"projection": "has_inforce_successor"}

PROJECTIONS: dict[str, list] = {
    "enforced": [{"inbound": "enforces"}],
    "has_inforce_successor": [{"via_inbound": "supersedes", "where": [IN_FORCE, ACCEPTED]}],
    "effective_must": [{"inbound": "enforces"}, IN_FORCE, ACCEPTED, MODAL, {"not": [SUCCESSOR]}],
    "effective_should": [
        {"any_of": [[{"attr": "modality", "in": ["SHOULD", "SHOULD_NOT"]}], [MODAL, {"not_inbound": "enforces"}]]}, ACCEPTED, IN_FORCE, {"not": [SUCCESSOR]},
    ],
    "validated_in": [{"via_inbound": "validates", "where": [{"attr": "split", "eq": "held-in"}, {"attr": "verdict", "in": ["improve", "hold"]}]}],
    "validated_out": [{"via_inbound": "validates", "where": [{"attr": "split", "eq": "held-out"}, {"attr": "verdict", "in": ["improve", "hold"]}]}],
    "improved": [{"via_inbound": "validates", "where": [{"attr": "verdict", "eq": "improve"}]}],
    "effective": [{"any_of": [
        [{"projection": "effective_must"}], [{"projection": "effective_should"}],
        [{"attr": "modality", "eq": "MAY"}, ACCEPTED, IN_FORCE, {"not": [SUCCESSOR]}],
        [{"attr": "kind", "eq": "calibration"}, IN_FORCE, {"not": [SUCCESSOR]}],
        [{"attr": "kind", "eq": "edit"}, ACCEPTED, IN_FORCE, {"projection": "validated_in"}, {"projection": "validated_out"}, {"projection": "improved"}, {"not": [SUCCESSOR]}],
    ]}],
}

EDIT = {"attr": "kind", "eq": "edit"}
RULES: dict[str, list] = {
    "orphan_must": [MODAL, ACCEPTED, {"not_inbound": "enforces"}],
    "orphan_test": [{"attr": "kind", "eq": "conform"}, {"not_outbound": "enforces"}],
    "stale_premise": [ACCEPTED, {"via": "premise", "where": [{"not": [IN_FORCE]}]}],
    "deviation_pressure": [ACCEPTED, {"inbound": "deviates-from", "min": 5}],
    "no_counterexample": [{"attr": "kind", "eq": "clause"}, ACCEPTED, {"not_outbound": "counterexample"}],
    "may_without_interop": [{"attr": "modality", "eq": "MAY"}, ACCEPTED, {"not_outbound": "interop"}],
    "interop_not_must": [{"via": "interop", "where": [{"attr": "modality", "not": "MUST"}]}],
    "status_drift": [{"attr": "status", "not": "superseded"}, {"via_inbound": "supersedes", "where": [IN_FORCE, ACCEPTED]}],
    "pending_successor": [ACCEPTED, {"inbound": "supersedes"}, {"not": [SUCCESSOR]}],
    "premature_superseded": [{"attr": "status", "eq": "superseded"}, {"not": [SUCCESSOR]}],
    "accepted_unvalidated": [EDIT, ACCEPTED, {"any_of": [[{"not": [{"projection": p}]}] for p in ("validated_in", "validated_out", "improved")]}],
    "edit_touches_readonly": [EDIT, {"not": [{"attr": "touches", "subset_of": SURFACES}]}],
    "edit_without_prediction": [EDIT, IN_FORCE, {"not_outbound": "predicts"}],
    "rejected_without_run": [EDIT, {"attr": "status", "eq": "rejected"}, {"not_inbound": "validates"}],
    "propose_only_accepted": [EDIT, ACCEPTED, {"attr": "component", "eq": "tool-implementation"}],
    "accepted_without_approver": [EDIT, ACCEPTED, {"attr": "approval", "eq": "auto"}, {"attr": "component", "in": HUMAN_APPROVED}],
    "pattern_resolved_unfixed": [{"attr": "kind", "eq": "pattern"}, {"attr": "status", "eq": "resolved"}, {"not": [{"via_inbound": "predicts", "where": [ACCEPTED]}]}],
    "predicts_withdrawn": [EDIT, {"attr": "status", "in": ["proposed", "accepted"]}, {"via": "predicts", "where": [{"attr": "status", "eq": "withdrawn"}]}],
    "edit_without_topic": [EDIT, IN_FORCE, {"not_outbound": "about"}],
}


def edge_tests(condition: dict | Iterable) -> list[tuple[str, str, list | None]]:
    """Every edge count (way, name, None) and neighbour test (way, name, where) of a condition, with those of the projections it names."""
    if not isinstance(condition, dict):
        return [t for c in condition for t in edge_tests(c)]
    if "projection" in condition:
        return edge_tests(PROJECTIONS[condition["projection"]])
    if "any_of" in condition:
        return [t for c in condition["any_of"] for t in edge_tests(c)]
    if "not" in condition and "attr" not in condition:
        return edge_tests(condition["not"])
    for way in ("inbound", "outbound"):
        for key in (way, f"not_{way}"):
            if key in condition:
                return [(way, condition[key], None)]
    for way in ("via", "via_inbound"):
        if way in condition:
            return [(way, condition[way], condition["where"])]
    return []


class Graph:
    """nodes: id, kind, status, in_force_from, in_force_until, touches (array) and attribute columns; edges: src, dst, name.

    Without a day every node is taken to be in force and none to have a successor in force: what is left does not change with time."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, day: str | None, conditions: Iterable[dict | list] = ()) -> None:
        d = F.to_date(F.lit(day))
        force = (F.col("in_force_from") <= d) & (F.col("in_force_until").isNull() | (d < F.col("in_force_until")))
        self.nodes = nodes.withColumn("in_force", F.coalesce(force, F.lit(False)) if day else F.lit(True))  # JN-11: half-open validity
        self.edges, self.day = edges, day
        self.made: dict[str, str] = {}
        self.prepare([t for c in conditions for t in edge_tests(c)])

    def prepare(self, tests: list[tuple[str, str, list | None]]) -> None:
        """Adds all counts to the nodes: edges are joined with their far ends' flags and grouped by the near end once each way."""
        tests = [t for i, t in enumerate(tests) if repr(t) not in self.made and repr(t) not in map(repr, tests[:i])]
        if inner := [x for _, _, where in tests if where for x in edge_tests(where)]:
            self.prepare(inner)
        for near, far, counted, tested in (("dst", "src", "inbound", "via_inbound"), ("src", "dst", "outbound", "via")):
            mine = [t for t in tests if t[0] in (counted, tested)]
            if not mine:
                continue
            self.made |= {repr(t): f"_c{len(self.made) + i}" for i, t in enumerate(mine)}
            flagged = [t for t in mine if t[2]]
            rows = self.edges.where(F.col("name").isin(sorted({n for _, n, _ in mine})))
            if flagged:
                flag = {repr(t): f"_f{i}" for i, t in enumerate(flagged)}
                ends = self.nodes.select(F.col("id").alias(far), *(self.compile(t[2]).alias(flag[repr(t)]) for t in flagged))
                rows = rows.join(ends, far, "left")
            hit = lambda t: (F.col("name") == t[1]) & (F.col(flag[repr(t)]) if t[2] else F.lit(True))
            one = rows.groupBy(F.col(near).alias("id")).agg(*(F.count_if(hit(t)).alias(self.made[repr(t)]) for t in mine))
            self.nodes = self.nodes.join(one, "id", "left")

    def count(self, way: str, name: str, where: list | None = None) -> Column:
        if repr((way, name, where)) not in self.made:
            self.prepare([(way, name, where)])
        return F.coalesce(self.made[repr((way, name, where))], F.lit(0))

    def compile(self, condition: dict | Iterable) -> Column:
        if not isinstance(condition, dict):
            return reduce(lambda a, b: a & b, [self.compile(c) for c in condition])
        if "attr" in condition:
            x = F.col(condition["attr"])
            if "subset_of" in condition:
                return subset_of(x, condition["subset_of"])
            if "not" in condition:
                return ~x.eqNullSafe(condition["not"])
            return F.coalesce(x.isin(condition["in"]) if "in" in condition else x == condition["eq"], F.lit(False))
        if "in_force" in condition:
            return F.col("in_force")
        if "projection" in condition:
            return F.lit(False) if condition == SUCCESSOR and not self.day else self.compile(PROJECTIONS[condition["projection"]])
        if "any_of" in condition:
            return reduce(lambda a, b: a | b, [self.compile(c) for c in condition["any_of"]])
        if "not" in condition:
            return ~self.compile(condition["not"])
        for way in ("inbound", "outbound"):
            if way in condition:
                return self.count(way, condition[way]) >= condition.get("min", 1)
            if f"not_{way}" in condition:
                return self.count(way, condition[f"not_{way}"]) == 0
        way = "via" if "via" in condition else "via_inbound"
        return self.count(way, condition[way], condition["where"]) > 0


def findings(nodes: DataFrame, edges: DataFrame, day: str, rules: dict[str, list] = RULES) -> DataFrame:
    """GR-01 to GR-19: id and rule of every finding; every rule is a column of one joined table."""
    g = Graph(nodes, edges, day, rules.values())
    fires = [F.when(g.compile(c), F.lit(name)) for name, c in rules.items()]
    return g.nodes.select("id", F.explode(F.filter(F.array(*fires), lambda r: r.isNotNull())).alias("rule"))


def projections(nodes: DataFrame, edges: DataFrame, day: str, which: dict[str, list] = PROJECTIONS) -> DataFrame:
    """GP-01 to GP-08 as boolean columns; `effective` is the binding set."""
    g = Graph(nodes, edges, day, which.values())
    columns = [g.compile(c).alias(name) for name, c in which.items()]
    return g.nodes.select("id", *columns)


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GS-07: edges whose target or source no node has."""
    ids = nodes.select("id")
    lost = lambda end: edges.join(ids, F.col(end) == F.col("id"), "left_anti").select("src", "dst", "name", F.lit(end).alias("missing"))
    return lost("src").union(lost("dst"))


def too_few_outbound(nodes: DataFrame, edges: DataFrame, name: str, kind: str, least: int = 1) -> DataFrame:
    """GS-06: nodes of a kind with fewer edges of a name than asked."""
    n = edges.where(F.col("name") == name).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return nodes.where(F.col("kind") == kind).join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def not_leaves(edges: DataFrame, name: str, along: str = "supersedes") -> DataFrame:
    """GS-05: edges of a name whose target has been superseded."""
    over = edges.where(F.col("name") == along).select(F.col("dst").alias("id")).distinct()
    return edges.where(F.col("name") == name).join(over, F.col("dst") == F.col("id"), "left_semi").select("src", "dst")


POSITIVE, NEGATIVE = ["MUST", "SHOULD", "MAY"], ["MUST_NOT", "SHOULD_NOT"]


def modality_conflicts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GS-10: topic, id and how many accepted clauses of the topic have the opposed modality without an `excepts` between them.

    Counted, not paired: the opposed clauses of a topic less those that an `excepts` joins to the clause."""
    sign = F.when(F.col("modality").isin(POSITIVE), 1).when(F.col("modality").isin(NEGATIVE), -1)
    clauses = nodes.where((F.col("kind") == "clause") & (F.col("status") == "accepted")).select("id", sign.alias("sign")).where("sign is not null")
    about = edges.where(F.col("name") == "about").select(F.col("src").alias("id"), F.col("dst").alias("topic")).distinct()
    rows = clauses.join(about, "id")
    counts = rows.groupBy("topic", (-F.col("sign")).alias("sign")).agg(F.count("*").alias("against"))
    links = edges.where(F.col("name") == "excepts").select("src", "dst")
    both = links.union(links.select("dst", "src")).distinct()
    x, y = rows.alias("x"), rows.alias("y")
    excused = both.join(x, F.col("src") == F.col("x.id")).join(y, (F.col("dst") == F.col("y.id")) & (F.col("x.topic") == F.col("y.topic")) & (F.col("x.sign") == -F.col("y.sign")))
    excused = excused.groupBy(F.col("x.id").alias("id"), F.col("x.topic").alias("topic")).agg(F.count("*").alias("excused"))
    left = rows.join(counts, ["topic", "sign"]).join(excused, ["id", "topic"], "left")
    return left.select("topic", "id", (F.col("against") - F.coalesce("excused", F.lit(0))).alias("opposed")).where("opposed > 0")


def strict_exceptions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GS-11: `excepts` edges that point at a strict clause."""
    strict = nodes.where(F.col("modality").isin(STRICT)).select(F.col("id").alias("dst"), "modality")
    return edges.where(F.col("name") == "excepts").join(strict, "dst").select("src", "dst", "modality")


def field_faults(nodes: DataFrame, ids: dict[str, str], required: dict[str, list[str]], one_of: dict[str, dict[str, list[str]]]) -> DataFrame:
    """GS-01, GS-02: id and field of ids that do not match their kind's whole pattern, required fields that are null, and values outside a closed list."""
    kind = F.col("kind")
    faults = [F.when((kind == k) & ~F.col("id").rlike(f"^(?:{p})$"), F.lit("id")) for k, p in ids.items()]
    faults += [F.when((kind == k) & F.col(f).isNull(), F.lit(f)) for k, fields in required.items() for f in fields]
    faults += [F.when((kind == k) & ~F.col(f).isin(values), F.lit(f)) for k, fields in one_of.items() for f, values in fields.items()]
    return nodes.select("id", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("field"))


def endpoint_faults(nodes: DataFrame, edges: DataFrame, kinds: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """GS-03: edges whose source or target is of a kind that their name does not allow. kinds: name to source and target kinds."""
    end = lambda side: nodes.select(F.col("id").alias(side), F.col("kind").alias(f"{side}_kind"))
    wrong = reduce(lambda a, b: a | b, ((F.col("name") == n) & ~(F.col("src_kind").isin(s) & F.col("dst_kind").isin(d)) for n, (s, d) in kinds.items()))
    return edges.where(F.col("name").isin([*kinds])).join(end("src"), "src").join(end("dst"), "dst").where(wrong).select("src", "dst", "name", "src_kind", "dst_kind")


def trimmed(links: DataFrame) -> DataFrame:
    """Links on or between cycles: those whose source is reached and whose target goes on, until none is lost."""
    left, n = links, links.count()
    while n:
        kept = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        m = kept.count()
        if m == n:
            break
        left, n = kept, m
    return left


def spread(links: DataFrame) -> DataFrame:
    """id and the greatest id that reaches it (forward reachability of all nodes at once)."""
    now = written(links.select(F.col("src").alias("id")).union(links.select("dst")).distinct().withColumn("colour", F.col("id")))
    changed = 1
    while changed:
        met = links.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("met"))
        after = now.join(met, "id", "left").select("id", F.greatest("colour", "met").alias("colour"), F.coalesce(F.col("met") > F.col("colour"), F.lit(False)).alias("changed"))
        now = written(after)
        changed = now.where("changed").limit(1).count()
        now = now.drop("changed")
    return now


def gathered(links: DataFrame, coloured: DataFrame) -> DataFrame:
    """Of each colour, the nodes that reach the node of its name along its own nodes (backward reachability): that node's component."""
    side = lambda end: coloured.select(F.col("id").alias(end), F.col("colour").alias(f"{end}_colour"))
    inside = written(links.join(side("src"), "src").join(side("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")))
    found = written(coloured.where("id = colour").select("id", "colour"))
    new, n = found, 1
    while n:
        before = inside.join(new.withColumnRenamed("id", "dst"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
        new = written(before.join(found, ["id", "colour"], "left_anti"))
        n = new.count()
        found = written(found.union(new)) if n else found
    return found


def cycles(edges: DataFrame, names: list[str]) -> DataFrame:
    """GS-04: name, component (its least node), id and size of every node on a cycle of edges of one name.

    Strongly connected components: links between no cycles are trimmed off; every node takes the greatest id that reaches it;
    of the nodes of one such id, those that also reach it are its component; and so on without these. A node alone is on a
    cycle only if it has a link to itself. Every step ends in a table in the checkpoint folder. A step looks one link further
    for all nodes at once, so jobs grow with the longest path and not with the graph."""
    links = written(edges.where(F.col("name").isin(names)).select(F.concat_ws(" ", "name", "src").alias("src"), F.concat_ws(" ", "name", "dst").alias("dst")).distinct())
    loops = written(links.where("src = dst").select(F.col("src").alias("id")))
    parts: list[DataFrame] = []
    while True:
        links = trimmed(links)
        if not links.limit(1).count():
            break
        found = gathered(links, spread(links))
        parts.append(found)
        gone = lambda end: found.select(F.col("id").alias(end))  # noqa: E731, B023
        links = written(links.join(gone("src"), "src", "left_anti").join(gone("dst"), "dst", "left_anti"))
    every = reduce(DataFrame.union, parts) if parts else loops.select("id", F.col("id").alias("colour")).limit(0)
    sized = every.groupBy("colour").agg(F.min("id").alias("component"), F.count("*").alias("size"))
    on = every.join(sized, "colour").join(loops.withColumn("_loop", F.lit(True)), "id", "left").where("size > 1 or _loop")
    cut = lambda c: F.substring(c, F.length("_name") + 2, F.length(c))
    return on.withColumn("_name", F.substring_index("id", " ", 1)).select(F.col("_name").alias("name"), cut(F.col("component")).alias("component"), cut(F.col("id")).alias("id"), "size")


FOREVER = "9999-12-31"


def binding_periods(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JN-11, GP-05: id, kind, since and until (half-open) of every period in which a node binds: it is effective but for time, in
    force, and no accepted successor is in force.

    Successors count by the days on which they start, the longest of each: a node has at most a row for each day of the calendar."""
    end = lambda c: F.coalesce(c, F.lit(FOREVER).cast("date"))
    g = Graph(nodes, edges, None, [PROJECTIONS["effective"]])
    own = g.nodes.where(g.compile(PROJECTIONS["effective"])).select("id", "kind", F.col("in_force_from").alias("lo"), end(F.col("in_force_until")).alias("hi")).where("lo < hi")
    accepted = nodes.where("status = 'accepted' and in_force_from is not null").select(F.col("id").alias("src"), F.col("in_force_from").alias("c"), end(F.col("in_force_until")).alias("d"))
    over = edges.where("name = 'supersedes'").select("src", F.col("dst").alias("id")).join(accepted, "src").groupBy("id", "c").agg(F.max("d").alias("d"))
    closed = own.join(over, "id").where("c < hi and d > lo").select("id", "kind", "lo", "c", "d")
    rows = closed.union(own.select("id", "kind", "lo", F.col("hi").alias("c"), F.col("hi").alias("d")))
    before = F.max("d").over(Window.partitionBy("id").orderBy("c", "d").rowsBetween(Window.unboundedPreceding, -1))
    gaps = rows.withColumn("since", F.greatest("lo", F.coalesce(before, "lo"))).where("since < c")
    return gaps.select("id", "kind", "since", F.col("c").alias("until"))


def on_days(periods: DataFrame, days: DataFrame, width: int = 32) -> DataFrame:
    """JN-11: id, kind and day of every period and day in it. days: day. An interval join: both sides are laid into bins of `width`
    days, joined by bin, and compared exactly then; periods are first cut to the days asked for."""
    first, last = days.agg(F.min("day"), F.max("day")).first()
    if first is None:
        return periods.select("id", "kind", F.col("since").alias("day")).limit(0)
    cell = lambda c: F.floor(F.unix_date(c) / width)
    cut = periods.where((F.col("since") <= F.lit(last)) & (F.col("until") > F.lit(first)))
    ends = F.sequence(cell(F.greatest("since", F.lit(first))), cell(F.least(F.date_sub("until", 1), F.lit(last))))
    binned = cut.withColumn("bin", F.explode(ends))
    asked = days.select("day").distinct().withColumn("bin", cell(F.col("day")))
    return binned.join(asked, "bin").where("since <= day and day < until").select("id", "kind", "day")


# Kinds whose documents are only ever added.
APPEND_ONLY = ["calibration", "conform", "edit", "measure", "pattern", "run", "verifier"]


def history_faults(before: DataFrame, after: DataFrame, kinds: list[str] = APPEND_ONLY, movable: tuple[str, ...] = ("status",)) -> DataFrame:
    """GS-09: documents of append-only kinds in an earlier state of the graph that a later one has no more ('gone'), or has with
    another value in a field that is not movable ('changed'). Both states have id, kind and the same fields; ids are unique."""
    fields = sorted(c for c in before.columns if c != "id" and c not in movable)
    state = lambda df, name: df.select("id", F.struct(*fields).alias(name))
    both = state(before.where(F.col("kind").isin(kinds)), "was").join(state(after, "is"), "id", "left")
    fault = F.when(F.col("is").isNull(), "gone").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return both.select("id", F.col("was.kind").alias("kind"), fault.alias("fault")).where("fault is not null")


def missing_heads(documents: DataFrame) -> DataFrame:
    """GS-08: paths of documents without a head. documents: as readers.frontmatter gives them."""
    return documents.where(~F.coalesce("has_frontmatter", F.lit(False))).select("path")
