"""Retrieval: seeds, weighted expansion, signals, ranking, and the cross-document index."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import tokens


@dataclass(frozen=True)
class Config:
    """Weights and limits of retrieval."""

    k: int = 5
    context_items: int = 10
    bridge_facts: int = 3
    least_df: int = 2
    most_df: int = 10
    source_documents: int = 5
    facts_each: int = 8
    # Edge weights, bonuses of matched signals, and the edges that lead to supporting nodes.
    object_bonus: float = 1.8
    constraint_bonus: float = 1.0
    keyword_bonus: float = 0.8
    weights: dict = field(
        default_factory=lambda: {
            "depends_on": 2.3,
            "prerequisite": 1.9,
            "references": 1.5,
            "applies_to": 1.4,
            "constrains": 1.4,
            "contains": 1.2,
            "covers": 1.1,
            "same_constraint_type": 1.1,
            "same_object_type": 1.0,
            "rule_follows": 0.8,
            "mentions": 0.6,
        }
    )
    support_types: tuple = ("applies_to", "constrains", "mentions", "contains", "references", "depends_on", "prerequisite")


# What in a question points to an object or constraint; a type without an entry is looked for by its name.
OBJECT_HINTS = {
    "figure": ["рисунок", "рисунка", "рисунке", "иллюстрац", "figure"],
    "table": ["таблица", "таблиц", "table"],
    "formula": ["формул", "уравнен", "formula"],
    "appendix": ["приложени", "appendix"],
    "title_page": ["титульн", "титул"],
    "contents": ["содержание", "оглавление"],
    "references": ["источник", "список литературы", "библиограф"],
    "heading": ["заголов", "подзаголов"],
    "section": ["раздел", "подраздел", "пункт"],
}
CONSTRAINT_HINTS = {
    "caption_required": ["подпись", "наименование", "caption"],
    "required_presence": ["обязател", "должен", "должны", "наличие"],
    "formatting": ["оформлен", "шрифт", "абзац", "интервал", "выравнив"],
    "numbering": ["нумерац", "номер", "обозначен"],
    "reference_required": ["ссылка", "ссылки"],
    "placement": ["располаг", "размещ", "по центру"],
    "sequence": ["порядок", "последовательн"],
    "language_requirement": ["язык", "русск"],
}
#: Parts of a context item's suffix, in their order.
SUFFIX = ("number", "section_title", "object_type", "constraint_type", "entity")


def seed_scores(hits: DataFrame, k: int) -> DataFrame:
    """base: (k + 1 - rank) / k, none below zero."""
    return hits.withColumn("base", F.greatest(F.lit(0.0), (F.lit(k + 1) - F.col("rank")) / F.lit(float(max(k, 1)))))


def weight_of(type_: Column, config: Config) -> Column:
    """A constant table of edge weights as an expression; types without a weight aren't expanded."""
    out = F.lit(None).cast("double")
    for t, w in config.weights.items():
        out = F.when(type_ == t, F.lit(w)).otherwise(out)
    return out


def _around(edges: DataFrame) -> DataFrame:
    """(id, to, type) of the edges out of and into each node; repeats of one direction count once."""
    out = edges.select(F.col("source").alias("id"), F.col("target").alias("to"), "type", F.lit("out").alias("direction"))
    return out.unionByName(
        edges.select(F.col("target").alias("id"), F.col("source").alias("to"), "type", F.lit("in").alias("direction"))
    ).distinct()


def _weighted(edges: DataFrame, nodes: DataFrame, config: Config) -> DataFrame:
    e = _around(edges).withColumn("w", weight_of(F.col("type"), config)).where("w is not null").drop("type", "direction")
    return e.join(nodes.select(F.col("id").alias("to"), F.col("type").alias("to_kind")), "to")


def _gained(df: DataFrame) -> DataFrame:
    return df.groupBy("query_id", "id").agg(
        F.round(F.sum("rule_score"), 6).alias("rule_score"), F.round(F.max("support"), 6).alias("support"),
    )


def expand(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """(query_id, id, rule_score, support) of seeds (query_id, id, base) and what their edges reach; seeds without a node (facts) support themselves."""
    kind = nodes.select("id", F.col("type").alias("kind"))
    own = seeds.join(kind, "id", "left").select(
        "query_id", "id", F.when(F.col("kind") == "rule", 2 * F.col("base")).otherwise(0.0).alias("rule_score"),
        F.col("base").alias("support"), F.col("kind").alias("seed_kind"), "base",
    )
    reach = own.where("seed_kind is not null").join(_weighted(edges, nodes, config), "id")
    more = F.when((F.col("seed_kind") == "rule") & (F.col("to_kind") == "rule"), 1.1).otherwise(1.0)
    far = reach.select(
        "query_id", F.col("to").alias("id"),
        F.when(F.col("to_kind") == "rule", F.col("base") * F.col("w") * more).otherwise(0.0).alias("rule_score"),
        (F.col("base") * F.least("w", F.lit(1.4))).alias("support"),
    )
    return _gained(own.select("query_id", "id", "rule_score", "support").unionByName(far))


def hints(kind: str) -> dict[str, list[str]]:
    return {"object_type": OBJECT_HINTS, "constraint": CONSTRAINT_HINTS}.get(kind, {})


def signals(queries: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(query_id, id, name) of nodes of a kind one of whose hints the lower-cased query holds.

    The hints are cut into words and the words of queries joined to the first word's letters in common, so queries
    meet only nodes whose hint they may hold, and not all nodes.
    """
    table = F.lit(None).cast("array<string>")
    for name, some in hints(kind).items():
        table = F.when(F.col("name") == name, F.array(*map(F.lit, some))).otherwise(table)
    n = nodes.where(F.col("type") == kind).select(
        "id", "name", F.explode(F.coalesce(table, F.array(F.translate("name", "_", " ")))).alias("hint"),
    ).where("hint <> ''")
    # every hint that a query holds shares its first KEY characters (or all) with some place of the query
    n = n.withColumn("key", F.substring(F.lower("hint"), 1, KEY))
    places = F.array_distinct(F.regexp_extract_all("q", F.lit(rf"(?s)(?=(.{{1,{KEY}}}))"), F.lit(1)))
    less = F.flatten(F.transform(places, lambda x: F.array(*(F.substring(x, 1, k) for k in range(1, KEY)))))
    places = F.explode(F.array_distinct(F.concat(places, less)))
    asked = queries.select("query_id", F.lower("query").alias("q"))
    # places go without their query's text, which is joined to those that a hint begins with
    near = asked.select("query_id", places.alias("key")).join(n, "key").select("query_id", "id", "name", "hint").distinct()
    return near.join(asked.hint("merge"), "query_id").where(F.contains("q", "hint")).select("query_id", "id", "name").distinct()


#: Characters of a hint that a query's places are joined by.
KEY = 4


def keyword_matches(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, n): nodes whose name shares words with the query; an equi-join on words, not on pairs."""
    q = queries.select("query_id", F.explode(tokens("query")).alias("w"))
    n = nodes.select("id", F.explode(tokens("name")).alias("w"))
    return q.join(n, "w").groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("n"))


def matched_signals(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, id, name, kind) of the object types, constraints and keywords that a query points to."""
    out = None
    for kind in ("object_type", "constraint"):
        one = signals(queries, nodes, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    words = nodes.where("type = 'keyword'")
    hit = keyword_matches(queries, words).join(words.select("id", "name"), "id").select(
        "query_id", "id", "name", F.lit("keyword").alias("kind"),
    )
    return out.unionByName(hit)


def signal_scores(matched: DataFrame, edges: DataFrame, nodes: DataFrame, config: Config = Config()) -> DataFrame:
    """What matched signals add: the bonus as their own support, and the bonus times the edge's weight for rules next to them."""
    bonus = F.when(F.col("kind") == "object_type", config.object_bonus).when(
        F.col("kind") == "constraint", config.constraint_bonus,
    ).otherwise(config.keyword_bonus)
    m = matched.withColumn("bonus", bonus)
    near = m.join(_weighted(edges, nodes, config).where("to_kind = 'rule'"), "id")
    own = m.select("query_id", "id", F.lit(0.0).alias("rule_score"), F.col("bonus").alias("support"))
    return own.unionByName(
        near.select(
            "query_id", F.col("to").alias("id"), (F.col("bonus") * F.col("w")).alias("rule_score"),
            F.lit(None).cast("double").alias("support"),
        )
    )


def scores(
    queries: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config = Config(),
) -> tuple[DataFrame, DataFrame]:
    """((query_id, id, rule_score, support), matched signals) of a batch of questions."""
    matched = matched_signals(queries, nodes)
    seeds = expand(seed_scores(hits, config.k), edges, nodes, config)
    return _gained(seeds.unionByName(signal_scores(matched, edges, nodes, config))), matched


def ranked_rules(scored: DataFrame, nodes: DataFrame, matched: DataFrame, k: int) -> DataFrame:
    """The k best rules of each query: by an object match, a constraint match, shared keywords, the score; ties by node order."""
    rules = nodes.where("type = 'rule'").select("id", F.col("ord").alias("node_ord"), "object_type", "constraint_type", "keywords")
    r = scored.where("rule_score > 0").join(rules, "id")
    names = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("name")))
    own = matched.groupBy("query_id").agg(
        names("object_type").alias("objects"), names("constraint").alias("constraints"), names("keyword").alias("words"),
    )
    r = r.join(own, "query_id", "left")
    has = lambda names_, c: F.coalesce(F.array_contains(names_, F.col(c)), F.lit(False)).cast("int").desc()
    shared = F.coalesce(F.size(F.array_intersect("words", F.split(F.coalesce("keywords", F.lit("")), ","))), F.lit(0))
    w = W.partitionBy("query_id").orderBy(
        has("objects", "object_type"), has("constraints", "constraint_type"), shared.desc(), F.col("rule_score").desc(),
        "node_ord",
    )
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "id", "rank", F.round("rule_score", 4).alias("score"),
    )


def support_nodes(rules: DataFrame, scored: DataFrame, edges: DataFrame, limit: int, config: Config = Config()) -> DataFrame:
    """Nodes next to a query's ranked rules by the supporting edges, rules among them left out, by support, then id; at most `limit`."""
    e = _around(edges.where(F.col("type").isin(*config.support_types))).select("id", "to").distinct()
    near = rules.select("query_id", "id").join(e, "id").select("query_id", F.col("to").alias("id")).distinct().join(
        rules.select("query_id", "id"), ["query_id", "id"], "left_anti",
    )
    near = near.join(
        scored.select("query_id", "id", "support"), ["query_id", "id"], "left",
    ).withColumn("support", F.coalesce("support", F.lit(0.0)))
    return near.withColumn(
        "rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("support").desc(), "id")),
    ).where(F.col("rank") <= limit).select("query_id", "id", "rank", F.round("support", 4).alias("score"))


def retrieve(queries: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config = Config()) -> DataFrame:
    """Context rows (query_id, id, rank, part, score) for a batch of questions: ranked rules, then supporting nodes."""
    scored, matched = scores(queries, hits, nodes, edges, config)
    rules = ranked_rules(scored, nodes, matched, config.k)
    more = support_nodes(rules, scored, edges, 2 * config.k, config)
    return rules.withColumn("part", F.lit("rule")).unionByName(more.withColumn("part", F.lit("support")))


PARTS = ("rule", "support", "bridge")


def context_items(found: DataFrame, nodes: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Retrieved rows with their place in the context and name, type, content and suffix parts; facts: (id, entity, content, entry_type, sources)."""
    cols = [c for c in SUFFIX if c in nodes.columns]
    n = nodes.select("id", "name", "type", "content", *cols)
    for c in SUFFIX:
        if c not in cols:
            n = n.withColumn(c, F.lit(None).cast("string"))
    n = n.withColumn("sources", F.lit(None).cast("string"))
    if facts is not None:
        name = F.when(
            F.col("entry_type") == "bridging_fact", F.concat(F.lit("Bridge: "), "entity"),
        ).otherwise(F.substring(F.regexp_extract("content", r"(?s)^Q: (.*?)\nA: ", 1), 1, 50))
        none = F.lit(None).cast("string")
        f = facts.select(
            "id", name.alias("name"), F.col("entry_type").alias("type"), "content",
            *(F.when(F.col("entry_type") == "bridging_fact", F.col("entity")).alias(c) if c == "entity" else none.alias(c) for c in SUFFIX),
            "sources",
        )
        n = n.select(f.columns).unionByName(f)
    part = F.array_position(F.array(*map(F.lit, PARTS)), F.col("part"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(part, "rank"))
    return found.join(n, "id").withColumn("place", place)


def context_text(items: DataFrame, limit: int = 10) -> DataFrame:
    """'[TYPE] name (key=value, ...):\\ncontent' of the first items of each query, in order."""
    said = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.col(c))) for c in SUFFIX)))
    suffix = F.when(F.size(said) > 0, F.concat(F.lit(" ("), F.array_join(said, ", "), F.lit(")"))).otherwise("")
    line = F.concat(
        F.lit("["), F.upper("type"), F.lit("] "), F.coalesce("name", F.lit("")), suffix, F.lit(":\n"),
        F.coalesce("content", F.lit("")),
    )
    some = items.where(F.col("place") <= limit).withColumn("line", line)
    return some.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda s: s["line"]), "\n\n").alias("context")
    )


def answer_sources(items: DataFrame, n: int = 5, chars: int = 200) -> DataFrame:
    """The first rules of each query as sources; their content is cut to `chars` characters and marked as cut."""
    rules = items.where((F.col("part") == "rule") & (F.col("rank") <= n))
    return rules.select(
        "query_id", "id", "rank", "name", "type", "score",
        F.concat(F.substring(F.coalesce("content", F.lit("")), 1, chars), F.lit("...")).alias("content"),
    )


def bridge_sources(items: DataFrame, n: int = 3) -> DataFrame:
    """The first bridging facts of each query as sources, with the documents that they unite."""
    facts = items.where("part = 'bridge'").withColumn("nth", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    return facts.where(F.col("nth") <= n).select(
        "query_id", "id", "nth", "entity", "content", F.split("sources", ",").alias("source_documents"),
    )


# Fixed: what a model is asked.
PROMPT = "Контекст:\n{context}\n\nВопрос: {question}\n\nОтвет:"


def prompts(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, prompt): what a model is asked; a question without context gets an empty one."""
    head, middle, end = PROMPT.replace("{question}", "{context}").split("{context}")
    return queries.join(texts, "query_id", "left").select(
        "query_id",
        F.concat(F.lit(head), F.coalesce("context", F.lit("")), F.lit(middle), F.col("query"), F.lit(end)).alias("prompt"),
    )


def retrieve_bridged(queries: DataFrame, hits: DataFrame, nodes: DataFrame, edges: DataFrame, config: Config = Config()) -> DataFrame:
    """retrieve() of the hits that aren't bridging facts among the balanced 2k best, and the bridging facts after them.

    hits: (query_id, id, rank, entry_type) of the 2k nearest entries.
    """
    best = balanced(hits, 2 * config.k, config.bridge_facts)
    kind = hits.select("query_id", "id", "rank", "entry_type")
    best = best.join(kind, ["query_id", "id", "rank"])
    other = best.where(F.coalesce("entry_type", F.lit("")) != "bridging_fact")
    other = other.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("place"))).select("query_id", "id", "rank")
    facts = best.where("entry_type = 'bridging_fact'").select(
        "query_id", "id", F.col("place").alias("rank"), F.lit(None).cast("double").alias("score"),
        F.lit("bridge").alias("part"),
    )
    return retrieve(queries, other, nodes, edges, config).unionByName(facts)


def entity_hits(hits: DataFrame, metadata: DataFrame) -> DataFrame:
    """Hits by the entity that an entry stands for (metadata: id, entity_id); entries without one go, ranks close up."""
    j = hits.join(metadata, "id").where("entity_id is not null and entity_id <> ''")
    return j.select(
        "query_id", F.col("entity_id").alias("id"),
        F.row_number().over(W.partitionBy("query_id").orderBy("rank")).alias("rank"),
    )


def near_hits(hits: DataFrame, edges: DataFrame, k: int = 5, hops: int = 2) -> DataFrame:
    """(query_id, id): the k nearest entries and all nodes at most `hops` out-edges from them."""
    from .graph import k_hop

    top = hits.where(F.col("rank") <= k).select("query_id", "id")
    far = k_hop(edges, top.select("id").distinct(), hops)
    return top.withColumnRenamed("id", "start").join(far, "start").select("query_id", "id").distinct()


# --- the cross-document index ----------------------------------------------------------------------------------------

# Capitalised words, and phrases in quotation marks.
ENTITY = r"(?<![\p{L}\p{N}_])[А-ЯЁA-Z][а-яёa-zA-Z]*(?![\p{L}\p{N}_])"
QUOTED = r"[\"«]([^\"»]+)[\"»]"


def entities(texts: DataFrame, key: str) -> DataFrame:
    """(key, entity): capitalised words and quoted phrases, without repeats."""
    found = F.array_distinct(
        F.concat(F.regexp_extract_all("text", F.lit("(" + ENTITY + ")"), F.lit(1)), F.regexp_extract_all("text", F.lit(QUOTED), F.lit(1)))
    )
    return texts.select(key, F.explode(found).alias("entity"))


def registry(ents: DataFrame, key: str) -> DataFrame:
    """(entity, df): in how many documents an entity occurs."""
    return ents.groupBy("entity").agg(F.count_distinct(key).alias("df"))


def occurrences(ents: DataFrame, key: str) -> DataFrame:
    """(entity, key, aku_id) without repeats: the registry as a relation, whose groups may be of any size; aku_id may be null."""
    aku = F.col("aku_id") if "aku_id" in ents.columns else F.lit(None).cast("string")
    return ents.select("entity", key, aku.alias("aku_id")).distinct()


def bridge_entities(reg: DataFrame, config: Config = Config()) -> DataFrame:
    return reg.where(F.col("df").between(config.least_df, config.most_df))


def bridge_candidates(bridges: DataFrame, ents: DataFrame, key: str, config: Config = Config()) -> DataFrame:
    """The documents that a bridge entity unites: the first of those that name it. df is bounded, so are the groups."""
    j = ents.join(bridges, "entity").withColumn("n", F.row_number().over(W.partitionBy("entity").orderBy(key)))
    return j.where(F.col("n") <= config.source_documents).select("entity", key, "n")


def bridge_akus(bridges: DataFrame, facts: DataFrame, config: Config = Config()) -> DataFrame:
    """(entity, doc_ord, doc_id, aku_ord, id, content): the facts that mention a bridge entity, whatever the case.

    facts: (doc_id, doc_ord, aku_ord, id, content). Of each entity's facts, in their order, the first source_documents *
    facts_each count, and of those the ones of its first source_documents documents, if there are two documents at
    least. An entity without a space lies inside a word, and of a word's facts only the first so many can count, so
    entities meet the words that occur, each word once, and then those facts. A phrase meets the facts of the words that
    hold its longest part and is compared with them. Texts are joined to what is left.
    """
    most, order = config.source_documents * config.facts_each, ("doc_ord", "aku_ord")
    f = facts.select("doc_ord", "doc_id", "aku_ord", "id", "content").distinct().withColumn("t", F.lower("content")).where("t is not null")
    f = f.withColumn("fact", F.xxhash64("doc_ord", "doc_id", "aku_ord", "id", "content"))
    said = f.select(*order, "fact", F.explode(F.array_distinct(F.split("t", r"\s+"))).alias("word"))
    few = said.withColumn("n", F.row_number().over(W.partitionBy("word").orderBy(*order))).where(F.col("n") <= most).drop("n")
    longest = F.array_max(F.transform(F.split("e", r"\s+"), lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    e = bridges.select("entity", F.lower("entity").alias("e")).distinct().withColumn("part", longest).withColumn("phrase", F.col("part") != F.col("e"))
    starts = F.regexp_extract_all("word", F.lit("(?s)(?=(.{1,3}))"), F.lit(1))
    # entities of one and two letters meet the beginnings of all places
    less = F.flatten(F.transform(starts, lambda x: F.array(F.substring(x, 1, 1), F.substring(x, 1, 2))))
    words = few.select("word").distinct().select("word", F.explode(F.array_distinct(F.concat(starts, less))).alias("key"))
    held = words.join(e.withColumn("key", F.substring("part", 1, 3)), "key").where("part <> '' and contains(word, part)").select("entity", "e", "phrase", "word")
    hit = held.where("not phrase").join(few, "word").select("entity", *order, "fact")
    own = [F.col("a." + c).eqNullSafe(F.col("f." + c)) for c in (*order, "fact")]
    maybe = held.where("phrase").join(said, "word").select("entity", "e", *order, "fact").distinct()
    phrase = maybe.alias("a").join(f.alias("f"), own).where("contains(f.t, a.e)").select("a.entity", *("a." + c for c in (*order, "fact")))
    # quoted spaces alone
    space = f.join(e.where("part = ''"), F.expr("contains(t, e)")).select("entity", *order, "fact")
    hit = hit.unionByName(phrase).unionByName(space).distinct()
    first = hit.withColumn("n", F.row_number().over(W.partitionBy("entity").orderBy(*order))).where(F.col("n") <= most)
    first = first.withColumn(
        "d", F.dense_rank().over(W.partitionBy("entity").orderBy("doc_ord")),
    ).withColumn("docs", F.max("d").over(W.partitionBy("entity")))
    kept = first.where((F.col("docs") >= 2) & (F.col("d") <= config.source_documents))
    return kept.alias("a").join(f.alias("f"), own).select("a.entity", "f.doc_ord", "f.doc_id", "f.aku_ord", "f.id", "f.content")


def bridge_prompts(candidates: DataFrame) -> DataFrame:
    """(entity, sections, sources, aku_ids): what a model is told of each entity: its facts below their documents."""
    head = F.concat(F.lit("\n--- Document: "), "doc_id", F.lit(" ---"))
    first = F.row_number().over(W.partitionBy("entity", "doc_ord").orderBy("aku_ord")) == 1
    line = F.concat(F.when(first, F.concat(head, F.lit("\n"))).otherwise(""), F.lit("- "), F.col("content"))
    c = candidates.withColumn("line", line)
    g = c.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("doc_ord", "aku_ord", "doc_id", "id", "line"))).alias("s"))
    join = lambda f, by: F.array_join(f(F.transform("s", lambda x: x[by])), "\n" if by == "line" else ",")
    return g.select(
        "entity", join(lambda x: x, "line").alias("sections"), join(F.array_distinct, "doc_id").alias("sources"),
        join(lambda x: x, "id").alias("aku_ids"),
    )


def bridge_id(entity: Column) -> Column:
    return F.concat(F.lit("bridge:"), entity, F.lit(":"), F.substring(F.md5(entity.cast("binary")), 1, 8))


def bridge_answers(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, entity, content, sources, aku_ids) of a model's answers (entity, response): a JSON array of facts, maybe encoded twice, joined by spaces; others give none."""
    listed = "array<string>"
    once = F.from_json(F.trim("response"), listed)
    # a JSON string that holds the array
    inner = F.get_json_object(F.concat(F.lit('{"x":'), F.col("response"), F.lit("}")), "$.x")
    facts = F.coalesce(once, F.from_json(inner, listed))
    f = asked.join(responses, "entity").withColumn("facts", F.filter(facts, lambda x: x.isNotNull() & (x != ""))).where(F.size("facts") > 0)
    return f.select(bridge_id(F.col("entity")).alias("id"), "entity", F.array_join("facts", " ").alias("content"), "sources", "aku_ids")


def bridge_facts(candidates: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """The rows a model is asked about where there are no facts: an id, the sources in order and their whole texts."""
    j = candidates.join(texts.select(key, F.col("text").alias("part")), key)
    g = j.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("n", key, "part"))).alias("s"))
    return g.select(
        bridge_id(F.col("entity")).alias("id"), "entity",
        F.array_join(F.transform("s", lambda s: s[key].cast("string")), ",").alias("sources"),
        F.array_join(F.transform("s", lambda s: s["part"]), "\n---\n").alias("prompt"),
    )


def akus(responses: DataFrame) -> DataFrame:
    """Question-answer pairs of a model's JSON answers: blank ones go, numbers stay; id, content and entities."""
    body = F.regexp_extract("response", r"(?s)\{.*\}", 0)
    got = F.from_json(body, "struct<akus:array<struct<question:string,answer:string>>>")["akus"]
    p = responses.select("doc_id", F.posexplode(got).alias("i", "x")).select(
        "doc_id", "i", F.trim("x.question").alias("question"), F.trim("x.answer").alias("answer"),
    ).where("question <> '' and answer <> ''")
    return p.select(
        F.concat(F.lit("aku:"), "doc_id", F.lit(":"), "i").alias("id"), "doc_id", "question", "answer",
        F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("content"),
    )


def balanced(hits: DataFrame, k: int, bridges: int) -> DataFrame:
    """From a ranked list the first k entries, of which at most `bridges` are bridging facts."""
    by = W.partitionBy("query_id").orderBy("rank")
    h = hits.withColumn("is_bridge", (F.col("entry_type") == "bridging_fact").cast("int")).withColumn("nth", F.sum("is_bridge").over(by))
    kept = h.where((F.col("is_bridge") == 0) | (F.col("nth") <= bridges))
    return kept.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("query_id", "id", "rank", "place")


def update_registry(old: DataFrame, old_ents: DataFrame, new_ents: DataFrame, key: str) -> DataFrame:
    """The registry after documents were added: only their entities are counted again."""
    touched = new_ents.select("entity").distinct()
    again = registry(old_ents.join(touched, "entity", "left_semi").unionByName(new_ents), key)
    return old.join(touched, "entity", "left_anti").unionByName(again)
