"""Graph construction: signals to nodes and edges, as unions and partial aggregations.

Every rule emits "sightings" (a node or edge seen once, with its place in file order);
one grouped aggregation per kind folds them. All aggregates combine on the map side, so a
node seen in a third of all rows costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from dossier.functions import documents as D
from dossier.functions import text as T

NODE_COLUMNS = ["node_id", "node_type", "label", "source_file", "confidence"]

# What one signal of each kind turns into.
SIGNAL_RULES = {
    "skill": ("Skill", "INDICATES_SKILL", "person", "DEMONSTRATES_SKILL"),
    "technology": ("Technology", "USES_TECH", "repo", "USES_TECH"),
    "aws_service": ("AWSService", "USES_AWS_SERVICE", "repo", "USES_AWS_SERVICE"),
    "pattern": ("Pattern", "DEMONSTRATES_PATTERN", "person", "DEMONSTRATES_PATTERN"),
}

# Of one document, nodes of the first kind strengthen those of the second.
STRENGTHENED = (("skill", "pattern"), ("technology", "aws_service"))


def effective_weight(weight: Column, frequency: Column) -> Column:
    return F.least(F.lit(1.0), weight * (1.0 + 0.1 * F.least(frequency, F.lit(5))))


def _seq(step: int, position: Column) -> Column:
    return F.struct(F.col("source_key"), F.lit(step).alias("step"), position.cast("int").alias("pos"))


def _props(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def signal_table(docs: DataFrame) -> DataFrame:
    """One row per usable signal, with its document's ids and its place within the document."""
    rows = docs.select(
        "source_key", "source_file", "repo_id", "person_id", F.posexplode_outer("expertise_signals").alias("pos", "s")
    )
    return rows.select(
        "source_key", "source_file", "repo_id", "person_id", "pos",
        F.col("s.signal_type").alias("signal_type"), T.strip(F.col("s.value")).alias("value"),
        F.col("s.weight").alias("weight"), F.coalesce("s.frequency", F.lit(1)).alias("frequency"),
    ).where(F.col("value") != "")


def with_document(rows: DataFrame) -> DataFrame:
    """Add the document's id and ``doc_hash``, its hash. Rows that come dealt out by ``doc_hash`` need not be moved to be folded by document."""
    if "doc_hash" in rows.columns:
        return rows
    return rows.withColumn("doc_id", T.stable_id("document", F.col("source_file"))).withColumn("doc_hash", F.xxhash64("doc_id"))


def signal_facts(signals: DataFrame) -> DataFrame:
    """Add node type, node id, document id and effective weight; unknown kinds drop out."""
    kinds = F.create_map(*[x for k, rule in SIGNAL_RULES.items() for x in (F.lit(k), F.lit(rule[0]))])
    return (
        with_document(signals).withColumn("node_type", kinds[F.col("signal_type")])
        .where(F.col("node_type").isNotNull())
        .withColumn("node_id", T.stable_id(F.col("node_type"), F.col("value")))
        .withColumn("effective", effective_weight(F.col("weight"), F.col("frequency")))
    )


def signal_nodes(facts: DataFrame) -> DataFrame:
    return facts.select(
        "node_id", "node_type", F.col("value").alias("label"), "source_file", F.col("effective").alias("confidence"),
        "frequency", _seq(1, F.col("pos")).alias("seq"),
    )


def _rule(kind: Column, position: int) -> Column:
    table = F.create_map(*[x for k, r in SIGNAL_RULES.items() for x in (F.lit(k), F.lit(r[position]))])
    return table[kind]


def _owner(kind: Column) -> Column:
    return F.when(_rule(kind, 2) == "person", F.col("person_id")).otherwise(F.col("repo_id"))


def signal_edges(facts: DataFrame) -> DataFrame:
    """Two edges per signal: from the document, and from the person or the repository."""
    kind = F.col("signal_type")
    ends = F.array(
        F.struct(F.col("doc_id").alias("from_id"), _rule(kind, 1).alias("relationship")),
        F.struct(_owner(kind).alias("from_id"), _rule(kind, 3).alias("relationship")),
    )
    return facts.withColumn("end", F.explode(ends)).select(
        "end.from_id", "end.relationship", F.col("node_id").alias("to_id"), "source_file",
        F.col("effective").alias("weight"), F.lit(1).cast("long").alias("times"), _seq(1, F.col("pos")).alias("seq"),
    )


def document_facts(facts: DataFrame) -> DataFrame:
    """A node once per document, with its first place and weight and how often it was seen. Sums and places are numbers, so nothing is sorted."""
    place = F.coalesce(F.col("pos").cast("int"), F.lit(-1))  # a place that is missing comes first
    return facts.groupBy("doc_hash", "doc_id", "source_key", "source_file", "repo_id", "person_id", "signal_type", "node_id").agg(
        F.count(F.lit(1)).alias("times"), F.min(place).alias("pos"), F.min_by("effective", place).alias("effective")
    )


def document_signal_edges(seen: DataFrame) -> DataFrame:
    """The edges from documents that have an id to the nodes of :func:`document_facts`."""
    # The condition reads a count, so it stays above the fold and the rows below are those of the shared edges, sent once for both.
    named = F.when(F.col("doc_id").isNotNull(), F.col("times")).otherwise(0) > 0
    return seen.where(named).select(
        "doc_hash", F.col("doc_id").alias("from_id"), _rule(F.col("signal_type"), 1).alias("relationship"),
        F.col("node_id").alias("to_id"), "source_file", F.col("effective").alias("weight"), "times", _seq(1, F.col("pos")).alias("seq"),
    )


def shared_signal_edges(seen: DataFrame) -> DataFrame:
    """The edges that documents share, of the nodes of :func:`document_facts`: from persons and repositories, and between nodes.

    A document's distinct nodes stand in one array, and its pairs are made there (see :func:`strengthens_edges`). Edges from
    documents without an id are here too, as they are one.
    """
    node = F.struct("signal_type", "node_id", "times", "pos", "effective")
    docs = seen.groupBy("doc_hash", "doc_id", "source_key", "source_file", "repo_id", "person_id").agg(F.collect_list(node).alias("nodes"))

    def edge(source: Column, relationship: Column, target: Column, weight: Column, times: Column, step: int, n: Column) -> Column:
        return F.struct(
            source.alias("from_id"), relationship.alias("relationship"), target.alias("to_id"), weight.alias("weight"),
            times.alias("times"), F.lit(step).alias("step"), n["pos"].alias("pos"),
        )

    def of_signal(source: Column, position: int, n: Column) -> Column:
        return edge(source, _rule(n["signal_type"], position), n["node_id"], n["effective"], n["times"], 1, n)

    def pairs(first: str, second: str) -> Column:
        others = F.filter("nodes", lambda n: n["signal_type"] == second)
        return F.flatten(F.transform(
            F.filter("nodes", lambda n: n["signal_type"] == first),
            lambda n: F.transform(others, lambda o: edge(
                n["node_id"], F.lit("STRENGTHENS"), o["node_id"], F.lit(0.5), n["times"] * o["times"], 2, n)),
        ))

    owned = F.transform("nodes", lambda n: of_signal(_owner(n["signal_type"]), 3, n))
    named = F.when(F.col("doc_id").isNotNull(), F.slice(owned, 1, 0)).otherwise(
        F.transform("nodes", lambda n: of_signal(F.col("doc_id"), 1, n))
    )
    strong = F.when(F.col("source_key").isNull(), F.slice(owned, 1, 0)).otherwise(
        F.concat(*[pairs(a, b) for a, b in STRENGTHENED])
    )
    return docs.select("source_key", "source_file", F.explode(F.concat(owned, named, strong)).alias("e")).select(
        "e.from_id", "e.relationship", "e.to_id", "source_file", "e.weight", "e.times",
        F.struct("source_key", F.col("e.step").alias("step"), F.col("e.pos").alias("pos")).alias("seq"),
    )


def strengthens_edges(facts: DataFrame) -> DataFrame:
    """Skill to pattern and technology to service edges of each document.

    A node repeated in a document is counted before the join, so the join writes every
    distinct pair once, which is an output edge, and carries how often it was seen.
    """
    seen = facts.groupBy("source_key", "source_file", "signal_type", "node_id").agg(
        F.count(F.lit(1)).alias("times"), F.min("pos").alias("pos")
    )
    side = F.create_map(*[F.lit(x) for x in ("skill", "a", "technology", "b", "pattern", "a", "aws_service", "b")])
    seen = seen.withColumn("pairing", side[F.col("signal_type")])
    left = seen.where(F.col("signal_type").isin("skill", "technology"))
    right = seen.where(F.col("signal_type").isin("pattern", "aws_service")).select(
        "source_key", "pairing", F.col("node_id").alias("to_id"), F.col("times").alias("to_times")
    )
    return left.join(right, ["source_key", "pairing"]).select(
        F.col("node_id").alias("from_id"), F.lit("STRENGTHENS").alias("relationship"), "to_id", "source_file",
        F.lit(0.5).alias("weight"), (F.col("times") * F.col("to_times")).alias("times"),
        _seq(2, F.col("pos")).alias("seq"),
    )


def document_nodes(docs: DataFrame) -> DataFrame:
    props = _props(source_file=F.col("source_file"), file_type=F.col("file_type"), weight=F.col("weight"))
    hashed = F.map_concat(props, _props(text_hash=T.fingerprint(F.col("extracted_text"))))
    return docs.select(
        T.stable_id("document", F.col("source_file")).alias("node_id"), F.lit("Document").alias("node_type"),
        F.col("source_file").alias("label"), "source_file", F.lit(1.0).alias("confidence"),
        F.when(F.coalesce("extracted_text", F.lit("")) != "", hashed).otherwise(props).alias("properties"),
        _seq(0, F.lit(0)).alias("seq"),
    )


def owner_nodes(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Person and repository nodes; they exist before any file is read and are not counted again."""
    docs = docs.select(*by, "person", "person_id", "repo_id").distinct()
    person = docs.select(
        *by,
        F.col("person_id").alias("node_id"), F.lit("Person").alias("node_type"), F.col("person").alias("label"),
        _props(name=F.col("person")).alias("properties"),
    )
    repo = docs.select(
        *by, F.col("repo_id").alias("node_id"), F.lit("Repository").alias("node_type"), F.col("repo_id").alias("label"),
        _props(repo_id=F.col("repo_id")).alias("properties"),
    )
    both = person.unionByName(repo)
    return both.groupBy("node_id", *by).agg(
        F.first("node_type").alias("node_type"), F.first("label").alias("label"),
        F.lit("").alias("source_file"), F.lit(1.0).alias("confidence"), F.first("properties").alias("properties"),
    )


def built_edges(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    start = F.struct(F.lit("").alias("source_key"), F.lit(0).alias("step"), F.lit(0).alias("pos")).alias("seq")
    return docs.select("person_id", "repo_id", *by).distinct().select(
        *by, F.col("person_id").alias("from_id"), F.lit("BUILT").alias("relationship"), F.col("repo_id").alias("to_id"),
        F.lit("").alias("source_file"), F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("times"), start,
    )


def owner_edges(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    contains = docs.select(
        *by, F.col("repo_id").alias("from_id"), F.lit("CONTAINS").alias("relationship"),
        T.stable_id("document", F.col("source_file")).alias("to_id"), "source_file",
        F.col("weight").cast("double").alias("weight"), F.lit(1).cast("long").alias("times"), _seq(0, F.lit(0)).alias("seq"),
    )
    return built_edges(docs, by).unionByName(contains)


def routing_nodes(docs: DataFrame) -> DataFrame:
    """Document-type and chunking-strategy nodes with the last written statistics."""
    stats = F.col("text_stats")
    kind = docs.select(
        T.stable_id("documenttype", F.col("doc_type")).alias("node_id"), F.lit("DocumentType").alias("node_type"),
        F.col("doc_type").alias("label"), F.lit("").alias("source_file"), F.col("type_confidence").alias("confidence"),
        _props(
            label=F.col("doc_type"), avg_heading_count=stats["heading_count"], avg_code_ratio=stats["code_char_ratio"],
            avg_sentence_len=stats["avg_sentence_len"], doc_count=F.lit(1),
        ).alias("properties"),
        _seq(3, F.lit(0)).alias("seq"),
    )
    strategy = docs.select(
        T.stable_id("chunkingstrategy", F.col("chunking_strategy")).alias("node_id"),
        F.lit("ChunkingStrategy").alias("node_type"), F.col("chunking_strategy").alias("label"),
        F.lit("").alias("source_file"), F.lit(1.0).alias("confidence"),
        _props(label=F.col("chunking_strategy")).alias("properties"), _seq(3, F.lit(1)).alias("seq"),
    )
    return kind.unionByName(strategy)


def _routes() -> list[Column]:
    return [
        F.struct(
            F.lit("HAS_TYPE").alias("relationship"), T.stable_id("documenttype", F.col("doc_type")).alias("to_id"),
            F.col("type_confidence").alias("weight"),
        ),
        F.struct(
            F.lit("CHUNKED_WITH").alias("relationship"),
            T.stable_id("chunkingstrategy", F.col("chunking_strategy")).alias("to_id"), F.lit(1.0).alias("weight"),
        ),
    ]


def routing_edges(docs: DataFrame) -> DataFrame:
    doc = T.stable_id("document", F.col("source_file"))
    return docs.withColumn("end", F.explode(F.array(*_routes()))).select(
        doc.alias("from_id"), "end.relationship", "end.to_id", F.lit("").alias("source_file"), "end.weight",
        F.lit(1).cast("long").alias("times"), _seq(3, F.lit(0)).alias("seq"),
    )


def document_edges(docs: DataFrame, routing: bool = True) -> DataFrame:
    """The edges that a document's row gives, in one pass: from its repository, and to its type and chunking strategy."""
    contains = F.struct(
        F.col("repo_id").alias("from_id"), F.lit("CONTAINS").alias("relationship"), F.col("doc_id").alias("to_id"),
        F.col("source_file").alias("source_file"), F.col("weight").cast("double").alias("weight"), _seq(0, F.lit(0)).alias("seq"),
    )
    routes = [
        F.struct(
            F.col("doc_id").alias("from_id"), r["relationship"].alias("relationship"), r["to_id"].alias("to_id"),
            F.lit("").alias("source_file"), r["weight"].cast("double").alias("weight"), _seq(3, F.lit(0)).alias("seq"),
        )
        for r in (_routes() if routing else [])
    ]
    return docs.select("doc_hash", F.explode(F.array(contains, *routes)).alias("e")).select(
        "doc_hash", "e.from_id", "e.relationship", "e.to_id", "e.source_file", "e.weight", F.lit(1).cast("long").alias("times"), "e.seq",
    )


def _grouped(rows: DataFrame, *keys: str) -> GroupedData:
    """Rows by keys. First and last values are folded by sorting; ids start alike, so a hash goes first and sorting compares numbers."""
    return rows.groupBy(F.xxhash64(*keys).alias("key_hash"), *keys)


def _folded(rows: DataFrame, last: list[str], by: Sequence[str] = (), **more: Column) -> DataFrame:
    """First type, label and source; confidence grows by 0.05 per further sighting; ``last`` columns as last seen, and other aggregates."""
    folded = _grouped(rows, "node_id", *by).agg(
        F.min_by(F.struct("node_type", "label", "source_file", "confidence"), F.col("seq")).alias("f"),
        F.max_by(F.struct(*last), F.col("seq")).alias("l"), F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in more.items()],
    )
    return folded.select(
        *by, "node_id", "f.node_type", F.col("f.label").alias("label"), "f.source_file",
        F.least(F.lit(1.0), F.col("f.confidence") + 0.05 * (F.col("n") - 1)).alias("confidence"), F.col("l").alias("last"), *more,
    )


def fold_signal_nodes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per signal node; the property map is built once per node, not per sighting."""
    kind, value, freq = F.col("node_type"), F.col("last.label"), F.col("last.frequency")
    props = (
        F.when(kind == "Skill", _props(category=F.lit("skill"), frequency=freq))
        .when(kind == "Technology", _props(frequency=freq))
        .when(kind == "AWSService", _props(service_name=value, frequency=freq))
        .otherwise(_props(pattern_name=value, frequency=freq))
    )
    return _folded(rows, ["label", "frequency"], by).select(*by, *NODE_COLUMNS, props.alias("properties"))


def fold_nodes(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per node whose sightings carry whole property maps (documents, types, strategies).

    The last map wins; a text hash stays when the last sighting has none.
    """
    seen_hash = F.col("properties")["text_hash"]
    folded = _folded(rows, ["properties"], by, hash=F.max_by(seen_hash, F.when(seen_hash.isNotNull(), F.col("seq"))))
    last = F.map_filter("last.properties", lambda k, v: k != "text_hash")
    props = F.when(F.col("hash").isNull(), last).otherwise(
        F.map_concat(last, F.create_map(F.lit("text_hash"), F.col("hash")))
    )
    return folded.select(*by, *NODE_COLUMNS, props.alias("properties"))


def fold_edges(sightings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First weight and source; weight grows by 0.1 per further sighting. Sightings with a ``doc_hash`` are of documents' own edges and folded by it."""
    keys = ["from_id", "relationship", "to_id", *by]
    grouped = sightings.groupBy("doc_hash", *keys) if "doc_hash" in sightings.columns else _grouped(sightings, *keys)
    folded = grouped.agg(
        F.min_by(F.struct("weight", "source_file"), F.col("seq")).alias("f"), F.sum("times").alias("n")
    )
    return folded.select(
        *by, T.edge_id(F.col("from_id"), F.col("relationship"), F.col("to_id")).alias("edge_id"),
        "from_id", "to_id", "relationship",
        F.least(F.lit(1.0), F.col("f.weight") + 0.1 * (F.col("n") - 1)).alias("weight"), "f.source_file",
    )


def with_owners(docs: DataFrame, person: Column, repo: Column) -> DataFrame:
    return (
        docs.withColumn("person", person)
        .withColumn("person_id", T.stable_id("person", person))
        .withColumn("repo_id", T.stable_id("repository", repo))
    )


def build_graph(docs: DataFrame, signals: DataFrame | None = None, routing: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of documents carrying ``person, person_id, repo_id`` (see :func:`with_owners`).

    Edges from and to documents are folded by document, those that documents share over all of them. Both have kinds or
    ids of their own, but for signals of documents without an id, whose edges are folded with the shared ones.
    """
    docs = with_document(docs)
    facts = signal_facts(signal_table(docs) if signals is None else signals)
    nodes = owner_nodes(docs).unionByName(fold_nodes(document_nodes(docs))).unionByName(fold_signal_nodes(signal_nodes(facts)))
    if routing:
        nodes = nodes.unionByName(fold_nodes(routing_nodes(docs)))
    seen = document_facts(facts)
    shared = built_edges(docs).unionByName(shared_signal_edges(seen))
    own = fold_edges(document_edges(docs, routing)).unionByName(fold_edges(document_signal_edges(seen)))
    return nodes, own.unionByName(fold_edges(shared))


def repository_graphs(docs: DataFrame, signals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of every repository's own graph, by ``repo_prefix``: sightings in other repositories do not count."""
    by = ["repo_prefix"]
    docs = docs.withColumn("repo_prefix", D.repo_prefix(F.col("source_key")))
    facts = signal_facts(signal_table(docs) if signals is None else signals)

    def own(rows: DataFrame) -> DataFrame:
        return rows.withColumn("repo_prefix", D.repo_prefix(F.col("seq.source_key")))

    nodes = (
        owner_nodes(docs, by).unionByName(fold_nodes(own(document_nodes(docs)), by))
        .unionByName(fold_signal_nodes(own(signal_nodes(facts)), by)).unionByName(fold_nodes(own(routing_nodes(docs)), by))
    )
    seen = own(signal_edges(facts).unionByName(strengthens_edges(facts)).unionByName(routing_edges(docs)))
    return nodes, fold_edges(owner_edges(docs, by).unionByName(seen), by)


# -- Aggregated signals -----------------------------------------------------

def aggregate_signals(signals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (type, value): summed frequency, best weight, first source; strongest first."""
    seq = F.struct("source_key", "pos")
    return (
        signals.groupBy(*by, "signal_type", "value")
        .agg(
            F.sum("frequency").alias("frequency"), F.max("weight").alias("weight"),
            F.min_by("source_file", seq).alias("source_file"), F.min(seq).alias("first_seen"),
        )
        .withColumn("strength", F.col("frequency") * F.col("weight"))
    )


# -- Merging into stored graphs ---------------------------------------------

def merge_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by node id: new values overlay stored ones, stored properties not named again stay."""
    o, n = stored.alias("o"), new.alias("n")
    kept = F.map_filter(F.col("o.properties"), lambda k, v: ~F.map_contains_key(F.col("n.properties"), k))
    props = (
        F.when(F.col("n.node_id").isNull(), F.col("o.properties"))
        .when(F.col("o.node_id").isNull(), F.col("n.properties"))
        .otherwise(F.map_concat(kept, F.col("n.properties")))
    )
    names = ["node_type", "label", "source_file", "confidence"]
    return o.join(n, F.col("o.node_id") == F.col("n.node_id"), "full_outer").select(
        F.coalesce("n.node_id", "o.node_id").alias("node_id"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in names], props.alias("properties"),
    )


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends both exist.

    Ends are reduced to distinct ids before they meet the nodes; what comes back is the set
    of missing ids, so a node that many edges share is looked up once.
    """
    ids = edges.select(F.explode(F.array("from_id", "to_id")).alias("node_id")).distinct()
    missing = ids.join(nodes.select("node_id"), "node_id", "left_anti")
    for end in ("from_id", "to_id"):
        edges = edges.join(missing.withColumnRenamed("node_id", end), end, "left_anti")
    return edges


def merge_edges(stored: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Upsert by edge id; a new edge with a missing end is left out; the new weight replaces the old."""
    o, n = stored.alias("o"), drop_dangling(new, nodes).alias("n")
    names = ["edge_id", "from_id", "to_id", "relationship", "weight", "source_file"]
    return o.join(n, F.col("o.edge_id") == F.col("n.edge_id"), "full_outer").select(
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in names]
    )
