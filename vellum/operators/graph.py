"""The property graph of a standard: nodes, edges, neighbours, paths. Edges are a multigraph: repeats stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import number_key

# Cues of a dependency and of a reference, and what must come before a constraint.
DEPENDENCY = r"(?iu)(?:в соответствии с|согласно|в порядке, установленном|в порядке, установленным|с учетом)\s+(\d+(?:\.\d+)*)"
REFERENCE = r"(?iu)(?:см\.?|смотри|в разделе|в подразделе|в пункте|раздел(?:е|ом)?|подраздел(?:е|ом)?|пункт(?:е|ом)?)\s+(\d+(?:\.\d+)*)"
BARE = r"(?<![\p{L}\p{N}_])(\d+(?:\.\d+)+)(?![\p{L}\p{N}_])"
BEFORE = [
    ("caption_required", ["reference_required", "required_presence", "numbering", "generic"]),
    ("formatting", ["required_presence", "generic", "reference_required"]),
    ("placement", ["reference_required", "required_presence", "generic"]),
    ("numbering", ["required_presence", "generic"]),
    ("reference_required", ["required_presence", "generic"]),
    ("optional_allowed", ["generic"]),
    ("definition", ["generic"]),
]


def nodes(rules: DataFrame, sections: DataFrame) -> DataFrame:
    """(standard_id, id, name, type) of sections, rules, object types, constraints and keywords."""
    s = sections.select("standard_id", F.col("section_id").alias("id"), F.col("title").alias("name"), F.lit("section").alias("type"))
    r = rules.select("standard_id", F.col("rule_id").alias("id"), F.col("title").alias("name"), F.lit("rule").alias("type"))
    out = s.unionByName(r)
    for kind, prefix in (("object_type", "object_type"), ("constraint_type", "constraint")):
        d = rules.where(F.col(kind) != "generic").select("standard_id", F.col(kind).alias("name")).distinct()
        out = out.unionByName(
            d.select("standard_id", F.concat(F.lit(prefix + "::"), "name").alias("id"), "name", F.lit(prefix).alias("type"))
        )
    if "keywords" in rules.columns:
        k = rules.select("standard_id", F.explode("keywords").alias("name")).distinct()
        out = out.unionByName(
            k.select("standard_id", F.concat(F.lit("keyword::"), "name").alias("id"), "name", F.lit("keyword").alias("type"))
        )
    return out


def _edge(df: DataFrame, source, target, kind: str, **properties) -> DataFrame:
    """Edges with their properties as JSON."""
    own = F.to_json(F.struct(*(c.alias(k) for k, c in properties.items()))) if properties else F.lit("{}")
    return df.select("standard_id", source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), own.alias("properties"))


def chain(df: DataFrame, key: list[str], order: list, id_: str, kind: str) -> DataFrame:
    """Edges from each row to the next of its group."""
    nxt = F.lead(id_).over(W.partitionBy("standard_id", *key).orderBy(*order))
    return _edge(df.withColumn("__next", nxt).where("__next is not null"), F.col(id_), F.col("__next"), kind)


def membership(rules: DataFrame) -> DataFrame:
    """contains, applies_to, covers (one for each rule), constrains and mentions edges."""
    obj, con = F.concat(F.lit("object_type::"), "object_type"), F.concat(F.lit("constraint::"), "constraint_type")
    typed, bound = rules.where("object_type <> 'generic'"), rules.where("constraint_type <> 'generic'")
    out = _edge(rules, F.col("section_id"), F.col("rule_id"), "contains")
    out = out.unionByName(
        _edge(typed, F.col("rule_id"), obj, "applies_to")
    ).unionByName(_edge(typed, F.col("section_id"), obj, "covers")).unionByName(_edge(bound, F.col("rule_id"), con, "constrains"))
    if "keywords" in rules.columns:
        k = rules.select("standard_id", "rule_id", F.explode("keywords").alias("k"))
        out = out.unionByName(_edge(k, F.col("rule_id"), F.concat(F.lit("keyword::"), "k"), "mentions"))
    return out


def rule_chains(rules: DataFrame) -> DataFrame:
    order = [number_key("number"), "ord"]
    a = chain(rules, ["section_id"], order, "rule_id", "rule_follows")
    b = chain(rules.where("object_type <> 'generic'"), ["object_type"], order, "rule_id", "same_object_type")
    c = chain(rules.where("constraint_type <> 'generic'"), ["constraint_type"], order, "rule_id", "same_constraint_type")
    return a.unionByName(b).unionByName(c)


def follows(sections: DataFrame) -> DataFrame:
    """Edges from each section to the next, with its place as the property "order"."""
    by = W.partitionBy("standard_id").orderBy("ord")
    s = sections.withColumn("__next", F.lead("section_id").over(by)).withColumn("__i", F.row_number().over(by) - 1)
    return _edge(s.where("__next is not null"), F.col("section_id"), F.col("__next"), "follows", order=F.col("__i"))


def links(rules: DataFrame) -> DataFrame:
    """depends_on and references edges from the numbers that a rule's title and content cite: to the last rule with the number, else to its section; none to itself."""
    text = F.concat_ws(" ", "title", "content")
    dep, ref, bare = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (DEPENDENCY, REFERENCE, BARE))
    kinds = F.concat(
        F.transform(dep, lambda n: F.struct(n.alias("n"), F.lit("depends_on").alias("type"))),
        F.transform(F.concat(dep, ref, bare), lambda n: F.struct(n.alias("n"), F.lit("references").alias("type"))),
    )
    cited = rules.select("standard_id", "rule_id", F.explode(F.array_distinct(kinds)).alias("x")).select(
        "standard_id", "rule_id", F.col("x.n").alias("n"), F.col("x.type").alias("type"),
    )
    by_number = rules.groupBy("standard_id", F.col("number").alias("n")).agg(F.max_by("rule_id", "ord").alias("to_rule"))
    number = F.col("section_number") if "section_number" in rules.columns else F.regexp_extract("section_id", r"(\d+)$", 1)
    by_section = rules.groupBy("standard_id", number.alias("n")).agg(F.max("section_id").alias("to_section"))
    j = cited.join(by_number, ["standard_id", "n"], "left").join(by_section, ["standard_id", "n"], "left").withColumn(
        "target", F.coalesce("to_rule", "to_section"),
    )
    j = j.where(
        F.col("target").isNotNull() & (F.col("target") != F.col("rule_id"))
    ).dropDuplicates(["standard_id", "rule_id", "target", "type", "n"])
    return j.select(
        "standard_id", F.col("rule_id").alias("source"), "target", "type",
        F.to_json(F.struct(F.col("n").alias("reference_number"))).alias("properties"),
    )


def prerequisites(rules: DataFrame) -> DataFrame:
    """For each rule and each constraint that must come before its own: the latest rule of its object type, in the order of the numbers, with it (an as-of join by windows)."""
    w = W.partitionBy("standard_id", "object_type").orderBy(number_key("number"), "ord").rowsBetween(W.unboundedPreceding, -1)
    wanted = sorted({b for _, bs in BEFORE for b in bs})
    r = rules.where("object_type <> 'generic'")
    for c in wanted:
        r = r.withColumn(f"last_{c}", F.last(F.when(F.col("constraint_type") == c, F.col("rule_id")), True).over(w))
    pick = F.array().cast("array<string>")
    for c, bs in BEFORE:
        pick = F.when(F.col("constraint_type") == c, F.array(*[F.col(f"last_{b}") for b in bs])).otherwise(pick)
    e = r.select("standard_id", "rule_id", "object_type", F.explode(F.array_distinct(F.array_compact(pick))).alias("to"))
    return _edge(e, F.col("rule_id"), F.col("to"), "prerequisite", object_type=F.col("object_type"))


def node(nodes_: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes with given ids; an id without a node gives no row."""
    return nodes_.join(ids.select("id").distinct(), "id", "left_semi")


def nodes_of_type(nodes_: DataFrame, *types: str) -> DataFrame:
    return nodes_.where(F.col("type").isin(*types))


def related_nodes(
    edges: DataFrame, nodes_: DataFrame, start: DataFrame, types: list[str] | None = None,
    neighbor_types: list[str] | None = None,
) -> DataFrame:
    """(id, neighbor): a neighbour shows once for each type and direction of its edges."""
    return related(edges, nodes_, start, types, neighbor_types).select("id", "neighbor")


def ordered_sections(nodes_: DataFrame) -> DataFrame:
    """(standard_id, place, id, name): a standard's sections in their order."""
    by = W.partitionBy("standard_id").orderBy("ord")
    return nodes_of_type(nodes_, "section").select("standard_id", (F.row_number().over(by) - 1).alias("place"), "id", "name")


def line_graph(lines: DataFrame) -> DataFrame:
    """Edges "follows" between neighbouring entries of (standard_id, ord, id), whatever they are."""
    return chain(lines, [], ["ord"], "id", "follows")


def related(
    edges: DataFrame, nodes_: DataFrame, start: DataFrame, types: list[str] | None = None,
    neighbor_types: list[str] | None = None,
) -> DataFrame:
    """(id, neighbor, type, direction) around the start nodes, without repeats; a self loop shows in both directions."""
    e = edges if types is None else edges.where(F.col("type").isin(types))
    out = e.select(F.col("source").alias("id"), F.col("target").alias("neighbor"), "type", F.lit("out").alias("direction"))
    both = out.unionByName(e.select(F.col("target").alias("id"), F.col("source").alias("neighbor"), "type", F.lit("in").alias("direction")))
    j = both.join(start.select("id").distinct(), "id", "left_semi").join(
        nodes_.select(F.col("id").alias("neighbor"), F.col("type").alias("neighbor_type")), "neighbor",
    )
    if neighbor_types is not None:
        j = j.where(F.col("neighbor_type").isin(neighbor_types))
    return j.select("id", "neighbor", "type", "direction").dropDuplicates()


def k_hop(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(start, id) of nodes at most k out-edges away, the start itself included."""
    step = edges.select(F.col("source").alias("id"), F.col("target").alias("to")).distinct()
    seen = start.select(F.col("id").alias("start"), "id").distinct()
    edge_of = seen
    for _ in range(k):
        edge_of = edge_of.join(step, "id").select("start", F.col("to").alias("id")).distinct().join(seen, ["start", "id"], "left_anti")
        seen = seen.unionByName(edge_of)
    return seen


def shortest_paths(edges: DataFrame, start: DataFrame, longest: int | None = None) -> DataFrame:
    """(start, id, path, hops): the shortest directed path, the least of equals by its nodes.

    Each round adds one edge to the paths of nodes reached last, until no new node is reached; longest stops before. A
    round's paths are written, so that plans stay small, and deleted once the next round's are.
    """
    from ..sources.scratch import discard, made, written

    step = edges.select(F.col("source").alias("id"), F.col("target").alias("to")).distinct()
    front = start.select(F.col("id").alias("start"), "id", F.array("id").alias("path")).distinct()
    done, hops, last = front, 0, made()
    while longest is None or hops < longest:
        since = made()
        nxt = front.join(step, "id").select("start", F.col("to").alias("id"), F.array_append("path", F.col("to")).alias("path"))
        front = nxt.groupBy("start", "id").agg(F.min("path").alias("path")).join(done.select("start", "id"), ["start", "id"], "left_anti")
        front = written(front, "paths")
        if not front.head(1):
            break
        done = written(done.unionByName(front), "paths")
        discard(edges.sparkSession, last, since)
        last, hops = since, hops + 1
    return done.select("start", "id", "path", (F.size("path") - 1).alias("hops"))


def _spread(edges: DataFrame, hub: int) -> tuple[DataFrame, DataFrame | None]:
    """edges (id, to, share), a hub's dealt to shares of about `hub` edges, and (id, shares) of the hubs, or None."""
    from ..sources.scratch import written

    step = edges.select(F.col("source").alias("id"), F.col("target").alias("to")).where("id IS NOT NULL AND to IS NOT NULL").distinct()
    hubs = written(step.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("shares")).where("shares > 1"), "hubs")
    if not hubs.head(1):
        return step.withColumn("share", F.lit(0)), None
    share = F.coalesce(F.pmod(F.xxhash64("to"), F.col("shares")).cast("int"), F.lit(0))
    return written(step.join(hubs, "id", "left").select("id", "to", share.alias("share")), "edges"), hubs


def hops_between(edges: DataFrame, pairs: DataFrame, longest: int, hub: int = 1_000_000) -> DataFrame:
    """(source, target, hops) of the pairs that at most `longest` directed edges join, by a search from both ends.

    Each round follows one edge more, forward from the sources or backward from the targets, whichever front is smaller, and only for
    ends with a pair that isn't joined yet; the two balls meet at the least sum of their radii. The out-edges (in-edges) of a node with more
    than `hub` are dealt to shares, and a front that reaches it goes to each. Rounds are written; those that were read are deleted.
    """
    from ..sources.scratch import discard, made, written

    spark = edges.sparkSession
    sides = (_spread(edges, hub), _spread(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), hub))
    left = pairs.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    found = left.where("source = target").withColumn("hops", F.lit(0))
    left = left.where("source <> target")
    ends = ("source", "target")
    seen = [left.select(F.col(e).alias("start"), F.col(e).alias("id"), F.lit(0).alias("hop")).distinct() for e in ends]
    front, size, last = list(seen), [f.count() for f in seen], made()
    for done in range(1, longest + 1):
        n = 0 if size[0] <= size[1] else 1
        if not size[n]:
            break
        since = made()
        step, hubs = sides[n]
        at = front[n].select("start", "id", "hop")
        if hubs is None:
            at = at.withColumn("share", F.lit(0))
        else:
            to = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share")
            at = at.join(hubs, "id", "left").select("start", "id", "hop", to)
        nxt = at.join(step, ["id", "share"]).select("start", F.col("to").alias("id"), (F.col("hop") + 1).alias("hop")).distinct()
        nxt = written(nxt.join(seen[n].select("start", "id"), ["start", "id"], "left_anti"), "front")
        one = nxt.select(F.col("start").alias(ends[n]), "id")
        two = seen[1 - n].select(F.col("start").alias(ends[1 - n]), "id")
        # only through nodes reached just now can a pair be joined that wasn't before, and by this many edges
        met = one.join(left, ends[n]).join(two, [ends[1 - n], "id"]).select(*ends).distinct()
        found = written(found.unionByName(met.withColumn("hops", F.lit(done))), "found")
        left = written(left.join(found, list(ends), "left_anti"), "left")
        for side, e in enumerate(ends):
            open_ = left.select(F.col(e).alias("start")).distinct()
            new = seen[side].unionByName(nxt) if side == n else seen[side]
            seen[side] = written(new.join(open_, "start", "left_semi"), "seen")
            front[side] = written((nxt if side == n else front[side]).join(open_, "start", "left_semi"), "front")
            size[side] = front[side].count()
        discard(spark, last, since)
        last = since
    return found


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends among ids."""
    return edges.join(
        ids.select(F.col("id").alias("source")), "source", "left_semi",
    ).join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def exported(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document for each standard: {"nodes": [...], "edges": [...]}."""
    n = nodes_.groupBy("standard_id").agg(F.sort_array(F.collect_list(F.struct("id", "name", "type"))).alias("nodes"))
    e = edges.groupBy("standard_id").agg(F.sort_array(F.collect_list(F.struct("source", "target", "type"))).alias("edges"))
    return n.join(e, "standard_id", "left").select("standard_id", F.to_json(F.struct("nodes", "edges")).alias("graph"))
