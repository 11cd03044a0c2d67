"""Graph pattern queries over ``nodes`` and ``edges``.

"The first few distinct labels" of a group is a ranked cut of distinct rows, never a
collected set: each task keeps only the few smallest labels it sees before the shuffle.
Order among labels is lexicographic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import text as T

LABEL_LIMIT = 10


def first_labels(rows: DataFrame, keys: list[str], label: str, k: int, name: str) -> DataFrame:
    """Up to ``k`` smallest distinct labels per key, as an array column ``name``."""
    order = Window.partitionBy(*keys).orderBy(label)
    cut = (
        rows.where(F.col(label).isNotNull()).select(*keys, label).distinct()
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    )
    return cut.groupBy(*keys).agg(F.array_sort(F.collect_list(label)).alias(name))


def named(nodes: DataFrame, prefix: str, kind: str | None = None) -> DataFrame:
    rows = nodes if kind is None else nodes.where(F.col("node_type") == kind)
    return rows.select(F.col("node_id").alias(f"{prefix}_id"), F.col("label").alias(f"{prefix}_label"))


def linked(edges: DataFrame, relationships: list[str], source: str, target: str) -> DataFrame:
    """Distinct (source, target) ids over one or several relationships."""
    return (
        edges.where(F.col("relationship").isin(relationships))
        .select(F.col("from_id").alias(f"{source}_id"), F.col("to_id").alias(f"{target}_id"))
        .distinct()
    )


def wanted(nodes: DataFrame, kind: str, labels: list[str] | DataFrame, prefix: str) -> DataFrame:
    """Nodes by label, ignoring case: one question's short list, or a ``label`` column for many questions.

    All labels given count; callers cut a question's labels to LABEL_LIMIT.
    """
    if isinstance(labels, DataFrame):
        low = labels.select(F.lower("label").alias("low")).distinct()
        return named(nodes.join(low, F.lower(nodes["label"]) == low["low"], "left_semi"), prefix, kind)
    return named(nodes.where(F.lower("label").isin([x.lower() for x in labels])), prefix, kind)


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>")).alias(name)


def person_technologies(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The first ``k`` technology and service labels over all repositories a person built."""
    built = linked(edges, ["BUILT"], "person", "repo").join(
        nodes.where(F.col("node_type") == "Repository").select(F.col("node_id").alias("repo_id")), "repo_id", "left_semi"
    )
    used = linked(edges, ["USES_TECH", "USES_AWS_SERVICE"], "repo", "tech")
    pairs = built.join(used, "repo_id").select("person_id", "tech_id").distinct()
    rows = pairs.join(named(nodes, "tech"), "tech_id")
    return first_labels(rows, ["person_id"], "tech_label", k, "techs")


def skill_neighbourhood(nodes: DataFrame, edges: DataFrame, labels: list[str] | DataFrame, limit: int | None = 20) -> DataFrame:
    skills = wanted(nodes, "Skill", labels, "skill")
    shown = (
        linked(edges, ["DEMONSTRATES_SKILL"], "person", "skill").join(skills, "skill_id")
        .join(named(nodes, "person", "Person"), "person_id")
    )
    related = (
        linked(edges, ["STRENGTHENS"], "skill", "related").join(skills, "skill_id")
        .join(named(nodes, "related"), "related_id")
    )
    techs = shown.select("skill_label", "person_id").distinct().join(person_technologies(nodes, edges, 5), "person_id")
    out = (
        shown.select(F.col("skill_label").alias("skill")).distinct()
        .join(first_labels(related.withColumnRenamed("skill_label", "skill"), ["skill"], "related_label", 5,
                           "related_entities"), "skill", "left")
        .join(first_labels(techs.select(F.col("skill_label").alias("skill"), F.explode("techs").alias("tech_label")),
                           ["skill"], "tech_label", 5, "co_technologies"), "skill", "left")
        .select("skill", _empty("related_entities"), _empty("co_technologies"))
        .orderBy("skill")
    )
    return out if limit is None else out.limit(limit)


def _first_rows(rows: DataFrame, label: str, order: list[str], labels: list[str] | DataFrame, limit: int | None) -> DataFrame:
    """The first rows in order: of all, or, for many questions, of each label."""
    if limit is None:
        return rows
    if not isinstance(labels, DataFrame):
        return rows.orderBy(*order).limit(limit)
    place = F.row_number().over(Window.partitionBy(F.lower(label)).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= limit).drop("place")


def pattern_evidence(nodes: DataFrame, edges: DataFrame, labels: list[str] | DataFrame, limit: int | None = 30) -> DataFrame:
    """Who shows a pattern, with a few neighbours; rows are cut before neighbours are looked up."""
    patterns = wanted(nodes, "Pattern", labels, "pattern")
    who = nodes.select(
        F.col("node_id").alias("entity_id"), F.col("node_type").alias("entity_type"),
        F.col("label").alias("entity_label"), F.coalesce("source_file", F.lit("")).alias("source_file"),
    )
    keys = ["pattern", "entity_type", "entity_label", "source_file"]
    shown = linked(edges, ["DEMONSTRATES_PATTERN"], "entity", "pattern").join(patterns, "pattern_id")
    rows = shown.join(who, "entity_id").withColumnRenamed("pattern_label", "pattern")
    kept = _first_rows(rows.select(*keys).distinct(), "pattern", keys, labels, limit)
    if limit is not None:
        rows = rows.join(kept, keys, "left_semi")
    around = (
        linked(edges, ["CONTAINS", "INDICATES_SKILL"], "entity", "related")
        .join(rows.select("entity_id").distinct(), "entity_id", "left_semi")
        .join(named(nodes, "related"), "related_id")
    )
    nearby = first_labels(around, ["entity_id"], "related_label", 5, "near")
    # Entities alike in all shown columns share one row, so their first labels are cut again.
    merged = first_labels(
        rows.join(nearby, "entity_id").select(*keys, F.explode("near").alias("related_label")),
        keys, "related_label", 5, "related",
    )
    return kept.join(merged, keys, "left").select(*keys, _empty("related")).orderBy(*keys)


def aws_service_context(nodes: DataFrame, edges: DataFrame, labels: list[str] | DataFrame, limit: int | None = 30) -> DataFrame:
    services = wanted(nodes, "AWSService", labels, "svc")
    uses = linked(edges, ["USES_AWS_SERVICE"], "repo", "svc")
    shown = uses.join(services, "svc_id").join(named(nodes, "repo", "Repository"), "repo_id")
    shown = _first_rows(shown, "svc_label", ["svc_label", "repo_label", "repo_id"], labels, limit)
    mine = shown.select("repo_id").distinct()
    # One label more than shown: without the row's own service five are left.
    others = first_labels(
        uses.join(mine, "repo_id", "left_semi").join(named(nodes, "svc", "AWSService"), "svc_id"),
        ["repo_id"], "svc_label", 6, "svcs",
    )
    techs = first_labels(
        linked(edges, ["USES_TECH"], "repo", "tech").join(mine, "repo_id", "left_semi")
        .join(named(nodes, "tech", "Technology"), "tech_id"),
        ["repo_id"], "tech_label", 5, "co_technologies",
    )
    return (
        shown.join(others, "repo_id", "left").join(techs, "repo_id", "left")
        .select(
            F.col("svc_label").alias("aws_service"), F.col("repo_label").alias("repository"),
            F.slice(F.filter("svcs", lambda x: x != F.col("svc_label")), 1, 5).alias("co_services"),
            _empty("co_technologies"),
        )
        .orderBy("aws_service", "repository")
    )


def person_summary(nodes: DataFrame, edges: DataFrame, limit: int | None = 1) -> DataFrame:
    """Skills, patterns, services and repositories with services; three aggregations, no cross product."""
    people = named(nodes, "person", "Person")

    def shown(relationship: str, kind: str, k: int, name: str) -> DataFrame:
        rows = linked(edges, [relationship], "person", "x").join(named(nodes, "x", kind), "x_id")
        return first_labels(rows, ["person_id"], "x_label", k, name)

    built = linked(edges, ["BUILT"], "person", "repo")
    uses = linked(edges, ["USES_AWS_SERVICE"], "repo", "svc").join(
        nodes.where(F.col("node_type") == "AWSService").select(F.col("node_id").alias("svc_id")), "svc_id", "left_semi"
    )
    serving = built.join(uses.select("repo_id").distinct(), "repo_id", "left_semi")
    services = built.join(uses, "repo_id").select("person_id", "svc_id").distinct().join(named(nodes, "svc"), "svc_id")
    out = (
        people.join(shown("DEMONSTRATES_SKILL", "Skill", 20, "skills"), "person_id", "left")
        .join(shown("DEMONSTRATES_PATTERN", "Pattern", 15, "patterns"), "person_id", "left")
        .join(first_labels(services, ["person_id"], "svc_label", 20, "aws_services"), "person_id", "left")
        .join(serving.groupBy("person_id").agg(F.count(F.lit(1)).alias("repo_count")), "person_id", "left")
        .select(
            F.col("person_label").alias("person"), _empty("skills"), _empty("patterns"), _empty("aws_services"),
            F.coalesce("repo_count", F.lit(0)).cast("long").alias("repo_count"),
        )
        .orderBy("person")
    )
    return out if limit is None else out.limit(limit)


def _count_documents(nodes: DataFrame, edges: DataFrame, relationship: str, kind: str, name: str) -> DataFrame:
    counts = (
        edges.where(F.col("relationship") == relationship).groupBy(F.col("to_id").alias("x_id"))
        .agg(F.count(F.lit(1)).alias("doc_count"))
    )
    rows = counts.join(named(nodes, "x", kind), "x_id")
    return rows.groupBy(F.col("x_label").alias(name)).agg(F.sum("doc_count").alias("doc_count")).orderBy(
        F.desc("doc_count"), name
    )


def document_type_distribution(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _count_documents(nodes, edges, "HAS_TYPE", "DocumentType", "doc_type")


def chunking_strategy_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _count_documents(nodes, edges, "CHUNKED_WITH", "ChunkingStrategy", "strategy")


def top_skills(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    skills = nodes.where(F.col("node_type") == "Skill").select(
        F.col("node_id").alias("skill_id"), F.col("label").alias("skill"),
        F.col("properties")["frequency"].cast("long").alias("frequency"),
    )
    return (
        linked(edges, ["DEMONSTRATES_SKILL"], "person", "skill").join(skills, "skill_id")
        .select("skill", "frequency").orderBy(F.desc_nulls_last("frequency"), "skill").limit(limit)
    )


def repositories_with_pattern(nodes: DataFrame, edges: DataFrame, pattern: str) -> DataFrame:
    return (
        linked(edges, ["DEMONSTRATES_PATTERN"], "repo", "pattern")
        .join(wanted(nodes, "Pattern", [pattern], "pattern"), "pattern_id")
        .join(named(nodes, "repo", "Repository"), "repo_id")
        .select(F.col("repo_label").alias("repository"), F.col("pattern_label").alias("pattern"))
    )


def shared_services(nodes: DataFrame, edges: DataFrame, at_least: int = 2) -> DataFrame:
    """Services used by several repositories; the repository list is the row's content, so it is whole."""
    rows = (
        linked(edges, ["USES_AWS_SERVICE"], "repo", "svc").join(named(nodes, "svc", "AWSService"), "svc_id")
        .join(named(nodes, "repo", "Repository"), "repo_id")
    )
    return (
        rows.groupBy("svc_id", "svc_label").agg(F.count(F.lit(1)).alias("repo_count"))
        .where(F.col("repo_count") >= at_least)
        .join(rows.select("svc_id", "repo_label").distinct(), "svc_id")
        .select(F.col("svc_label").alias("service"), "repo_count", F.col("repo_label").alias("repository"))
    )


def co_occurring(nodes: DataFrame, edges: DataFrame, technology: str, limit: int = 20) -> DataFrame:
    """Skills and technologies of the documents that use a technology."""
    docs = (
        linked(edges, ["USES_TECH"], "doc", "tech").join(wanted(nodes, "Technology", [technology], "tech"), "tech_id")
        .join(named(nodes, "doc", "Document"), "doc_id").select("doc_id").distinct()
    )
    ids = (
        linked(edges, ["USES_TECH", "INDICATES_SKILL"], "doc", "x").join(docs, "doc_id", "left_semi")
        .select("x_id").distinct()
    )
    kinds = nodes.select(F.col("node_id").alias("x_id"), "label", "node_type")
    return (
        ids.join(kinds, "x_id").select(F.col("label").alias("co_occurring_skill"), F.col("node_type").alias("type"))
        .distinct().orderBy("co_occurring_skill", "type").limit(limit)
    )


def strong_document_services(nodes: DataFrame, edges: DataFrame, weight: float = 0.7, limit: int = 20) -> DataFrame:
    docs = nodes.where(
        (F.col("node_type") == "Document") & (F.col("properties")["weight"].cast("double") >= weight)
    ).select(F.col("node_id").alias("doc_id"))
    services = nodes.where(F.col("node_type") == "AWSService").select(
        F.col("node_id").alias("svc_id"), F.col("label").alias("service"),
        F.col("properties")["frequency"].cast("long").alias("frequency"),
    )
    counts = (
        linked(edges, ["USES_AWS_SERVICE"], "doc", "svc").join(docs, "doc_id", "left_semi")
        .groupBy("svc_id").agg(F.count(F.lit(1)).alias("doc_count"))
    )
    return (
        counts.join(services, "svc_id").select("service", "frequency", "doc_count")
        .orderBy(F.desc_nulls_last("frequency"), "service").limit(limit)
    )


def repeated_repository_patterns(nodes: DataFrame, edges: DataFrame, at_least: int = 2) -> DataFrame:
    built = linked(edges, ["BUILT"], "person", "repo").select("repo_id").distinct()
    counts = (
        linked(edges, ["DEMONSTRATES_PATTERN"], "repo", "pattern").join(built, "repo_id", "left_semi")
        .groupBy("pattern_id").agg(F.count(F.lit(1)).alias("repo_count")).where(F.col("repo_count") >= at_least)
    )
    return counts.join(named(nodes, "pattern", "Pattern"), "pattern_id").select(
        F.col("pattern_label").alias("pattern"), "repo_count"
    )


# -- Composition ------------------------------------------------------------

def entity_ids(snippets: DataFrame, text_col: str = "content", key: str = "qid", limit: int = 20) -> DataFrame:
    """Graph ids of the terms found in each question's snippets, at most ``limit`` in id order."""
    text = F.col(text_col)

    def ids_of(kind: str, found: Column) -> Column:
        return F.transform(found, lambda v: T.slug(F.concat(F.lit(f"{kind}_"), v)))

    ids = F.concat(
        ids_of("aws_service", T.find_aws_services(text)), ids_of("technology", T.find_technologies(text)),
        ids_of("pattern", T.find_patterns(text)),
    )
    rows = T.explode_rows(snippets, [key], F.array_distinct(ids), "entity_id").distinct()
    order = Window.partitionBy(key).orderBy("entity_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("place")


def expansion(nodes: DataFrame, edges: DataFrame, skills: list[str], patterns: list[str],
              services: list[str]) -> dict[str, DataFrame]:
    """All context around the terms of one question's evidence (each list holds at most ten)."""
    person = person_summary(nodes, edges)
    around = skill_neighbourhood(nodes, edges, skills)
    evidence = pattern_evidence(nodes, edges, patterns)
    aws = aws_service_context(nodes, edges, services)
    return {
        "person_summary": person,
        "skill_neighbourhood": around,
        "pattern_evidence": evidence,
        "aws_context": aws,
        "inferred_skills": inferred_skills(around, person),
        "repeated_patterns": repeated_patterns(evidence),
        "graph_entities_used": entities_used(around, evidence, aws),
    }


def inferred_skills(around: DataFrame, person: DataFrame, limit: int = 15) -> DataFrame:
    own = person.select(F.explode("skills").alias("skill"))
    return around.select("skill").union(own).where(F.col("skill") != "").distinct().orderBy("skill").limit(limit)


def repeated_patterns(evidence: DataFrame) -> DataFrame:
    counts = evidence.where(F.col("pattern") != "").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= 2).select("pattern")


def entities_used(around: DataFrame, evidence: DataFrame, aws: DataFrame) -> DataFrame:
    names = around.select(F.col("skill").alias("entity")).union(evidence.select("pattern")).union(aws.select("aws_service"))
    return names.where(F.col("entity") != "").distinct()
