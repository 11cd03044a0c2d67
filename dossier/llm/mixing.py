"""Mixing to target weights with soft membership.

A classifier learned from the labels table gives every document a posterior over domains. Every document has a rate, the
expected number of its copies in the mix. A least-squares loss holds the rates' expected tokens by domain against the targets; its
gradient at a document is the sum of its posteriors times the domains' errors. Projected gradient steps in their lazy form sum the
errors up, scale them by the domains' curvature, and cut the rate that follows from the sum at zero, so a rate is always
max(0, 1 - posteriors . sum): of all rates that fit the targets, those that change least. A step needs one pass for ten sums over all documents. A small
pull towards one only settles what the targets leave open; a larger one trades the fit for smaller changes. Only column expressions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import unit_hash
from dossier.session import materialize

#: Domains by label, and their shares of the mix's tokens.
DOMAINS = ("clean", "poor", "toxic")
TARGETS = {"clean": 0.9, "poor": 0.05, "toxic": 0.05}
#: The target total is such that this domain's tokens stay as they are.
ANCHOR = "clean"
#: Labelled rows the classifier is fitted on, chosen by hash; small enough to be sent to every task.
FIT_ROWS = 20_000
#: Buckets of word endings.
BUCKETS = 1 << 11
#: Signs that are cut from a word's end.
SIGNS = ".,;:!?"
#: Texts that every bucket is given, dealt to the domains by their shares, so that rare words say nothing.
SMOOTHING = 20.0
#: A word is evidence for a domain whose texts hold it so many times as often as all texts do, by so many standard deviations.
#: Smaller lifts go with the language or the length of texts, and would add up over a long one.
MIN_LIFT = 3.0
MIN_DEVIATIONS = 8.0
MIN_TEXTS = 20
#: Smaller weights of endings are left out, for the same reason.
LEAST_WEIGHT = 0.3
#: Words of a text depend on each other; their evidence counts this much.
EVIDENCE_WEIGHT = 0.7
#: Below one, so that documents of the anchor domain with a little less than its mean rate stay.
SCALE = 0.9
#: Pull of the rates towards one where the mix is fitted, and where documents are taken or left by it: those of the
#: anchor domain are to stay even if the classifier is unsure.
PULL, CAREFUL_PULL = 1e-6, 0.02
#: Passes over the documents, and the error in times a target at which they end.
MAX_STEPS, TOLERANCE = 40, 1e-4


def domain_of(quality: Column, toxic: Column) -> Column:
    """Toxic documents are a domain of their own; else the quality label decides; null without a label."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "clean").when(quality == 0, "poor")


def _words(text: Column) -> Column:
    """Words between white space; a null or empty text has one empty word."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")


def _word_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """A row per word of a text, with the word's hash and the bucket of the signs at its end; the empty word has neither."""
    words = rows.select(*keep, F.explode("words").alias("word"))
    # Only signs count as endings; letters would tell the language.
    sign = lambda c: c.between(33, 47) | c.between(58, 64) | c.between(91, 96) | c.between(123, 126)
    last, before = F.substring("word", -1, 1), F.substring("word", -2, 2)
    ending = F.when(~sign(F.ascii(last)), "letter").when(sign(F.ascii(before)), before).otherwise(last)
    bare = F.when(F.col("word") != "", F.xxhash64(F.lower(F.rtrim("word", F.lit(SIGNS)))))
    return words.select(*keep, bare.alias("word"), F.when(F.col("word") != "", F.pmod(F.hash(ending), F.lit(BUCKETS))).alias("ending"))


@dataclass(frozen=True)
class Classifier:
    """Evidence words (hash, log lift per domain), weights per bucket of endings (log lifts), log shares of the domains among
    texts that hold an evidence word (True) and texts that hold none.

    A word needs MIN_TEXTS texts of the bounded sample to be evidence, which bounds the evidence's rows.
    """

    evidence: DataFrame
    ending: dict[str, list[float]]
    prior: dict[bool, dict[str, float]]


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Classifier:
    """Counts by domain over a bounded, documented sample of labelled rows."""
    known = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("domain is not null and doc_id is not null")
    sample = F.broadcast(known.orderBy(unit_hash(F.col("doc_id")), "doc_id").limit(fit_rows))
    rows = materialize(docs.select("doc_id", "text").join(sample, "doc_id"))
    docs_of = {d: 1.0 for d in DOMAINS} | {r["domain"]: r["count"] + 1.0 for r in rows.groupBy("domain").count().collect()}
    share = {d: n / sum(docs_of.values()) for d, n in docs_of.items()}
    seen = _word_rows(rows.select("doc_id", "domain", _words(F.col("text")).alias("words")), "doc_id", "domain").where("word is not null")
    held = seen.select("doc_id", "domain", "word").distinct().groupBy("word").agg(
        F.count(F.lit(1)).alias("texts"), *[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in DOMAINS],
    ).where(F.col("texts") >= MIN_TEXTS)
    lift = {d: (F.col(d) + SMOOTHING * share[d]) / ((F.col("texts") + SMOOTHING) * share[d]) for d in DOMAINS}
    clear = {d: (lift[d] >= MIN_LIFT) & (F.col(d) - F.col("texts") * share[d] >= MIN_DEVIATIONS * F.sqrt(F.col("texts") * share[d])) for d in DOMAINS}
    some = F.lit(False)
    for d in DOMAINS:
        some = some | clear[d]
    evidence = materialize(held.where(some).select(F.col("word"), *[F.when(clear[d], F.log(lift[d])).otherwise(0.0).alias(f"w_{d}") for d in DOMAINS]))
    counts = {d: [SMOOTHING * share[d]] * BUCKETS for d in DOMAINS}
    for r in seen.groupBy("domain", "ending").count().collect():  # at most one row per domain and bucket
        counts[r["domain"]][r["ending"]] += r["count"]
    totals, whole = {d: sum(counts[d]) for d in DOMAINS}, [sum(x) for x in zip(*counts.values())]
    ending = {d: [log(n / totals[d] * sum(whole) / all_) for n, all_ in zip(counts[d], whole)] for d in DOMAINS}
    ending = {d: [x if abs(x) >= LEAST_WEIGHT else 0.0 for x in row] for d, row in ending.items()}
    holding = seen.join(F.broadcast(evidence.select("word")), "word", "left_semi").select("doc_id").distinct().withColumn("holds", F.lit(True))
    parts = {True: {d: share[d] for d in DOMAINS}, False: {d: share[d] for d in DOMAINS}}
    for r in rows.select("doc_id", "domain").join(holding, "doc_id", "left").groupBy("domain", F.coalesce("holds", F.lit(False)).alias("holds")).count().collect():
        parts[r["holds"]][r["domain"]] += r["count"]
    return Classifier(evidence, ending, {h: {d: log(n / sum(x.values())) for d, n in x.items()} for h, x in parts.items()})


def _constant(values: list[float]) -> Column:
    """An array constant; one text literal is folded once and is quicker to send than thousands of numbers."""
    return F.split(F.lit(",".join(f"{v:.5f}" for v in values)), ",").cast("array<float>")


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """row, doc_id, n_tokens, and p_<domain> for every domain."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", _words(F.col("text")).alias("words"))
    rows = rows.withColumn("n_tokens", F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words")).cast("long"))
    words = _word_rows(rows, "row", "doc_id", "n_tokens").join(F.broadcast(model.evidence), "word", "left")
    weight = lambda d: F.coalesce(F.col(f"w_{d}"), F.lit(0.0)) + F.coalesce(F.get(_constant(model.ending[d]), F.col("ending")), F.lit(0.0))
    sums = words.groupBy("row", "doc_id", "n_tokens").agg(
        F.count(f"w_{DOMAINS[0]}").alias("held"), *[F.sum(weight(d).cast("double")).alias(d) for d in DOMAINS],
    )
    prior = lambda d: F.when(F.col("held") > 0, F.lit(model.prior[True][d])).otherwise(F.lit(model.prior[False][d]))
    scores = {d: F.col(d) * EVIDENCE_WEIGHT + prior(d) for d in DOMAINS}
    top = F.greatest(*scores.values())
    total = sum((F.exp(s - top) for s in scores.values()), F.lit(0.0))
    return sums.select("row", "doc_id", "n_tokens", *[(F.exp(s - top) / total).alias(f"p_{d}") for d, s in scores.items()])


def _rate(total: list[float]) -> Column:
    """The rate that follows from the summed steps: against them, and cut at zero."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p_{d}") * total[i] for i, d in enumerate(DOMAINS)), F.lit(0.0)))


def _solve(rows: list[list[float]], right: list[float]) -> list[float]:
    """Elimination with the largest pivot; the matrix is positive definite and has one row per domain."""
    rows = [[*r, x] for r, x in zip(rows, right)]
    for i in range(len(rows)):
        j = max(range(i, len(rows)), key=lambda k: abs(rows[k][i]))
        rows[i], rows[j] = rows[j], rows[i]
        rows[i] = [x / rows[i][i] for x in rows[i]]
        rows = [r if k == i else [x - r[i] * y for x, y in zip(r, rows[i])] for k, r in enumerate(rows)]
    return [r[-1] for r in rows]


def _fitted(table: DataFrame, goal: dict[str, float], wanted: list[str], pull: float) -> list[float]:
    """The summed steps at which the domains' tokens meet their goals, or come as near as nonnegative rates and the pull let them."""
    n, p, goals = F.col("n_tokens"), [F.col(f"p_{d}") for d in DOMAINS], [goal[d] for d in DOMAINS]
    pairs = [(i, j) for i in range(len(DOMAINS)) for j in range(i, len(DOMAINS))]

    def errors(total: list[float]) -> tuple[list[float], list[list[float]], float]:
        """Errors in tokens, curvature, and the value that every step must lessen."""
        r = _rate(total)
        row = table.select(n, *p, r.alias("r")).agg(
            *[F.sum(n * p[i] * F.col("r")).alias(f"m{i}") for i in range(len(DOMAINS))], F.sum(n * F.col("r") * F.col("r")).alias("square"),
            *[F.sum(F.when(F.col("r") > 0, n * p[i] * p[j]).otherwise(0.0)).alias(f"c{i}{j}") for i, j in pairs],
        ).first().asDict()
        error = [pull * total[i] * goals[i] - row[f"m{i}"] + goals[i] if d in wanted else 0.0 for i, d in enumerate(DOMAINS)]
        bend = [[row[f"c{min(i, j)}{max(i, j)}"] + (i == j) * (pull * goals[i] + 1e-9 * goals[i]) for j in range(len(DOMAINS))] for i in range(len(DOMAINS))]
        return error, bend, row["square"] / 2 + sum(goals[i] * total[i] * (1 + pull * total[i] / 2) for i in range(len(DOMAINS)))

    total = [0.0] * len(DOMAINS)
    error, bend, value = errors(total)
    passes = 1
    while passes < MAX_STEPS and max(abs(e) / g for e, g in zip(error, goals)) > TOLERANCE:
        step, size = _solve(bend, [-e for e in error]), 1.0
        down = sum(e * s for e, s in zip(error, step))
        while passes < MAX_STEPS:
            tried = [t + size * s for t, s in zip(total, step)]
            new = errors(tried)
            passes += 1
            if new[2] <= value + 1e-4 * size * down:
                total, (error, bend, value) = tried, new
                break
            size /= 4
        else:
            break
    return total


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str | None = ANCHOR, fit_rows: int = FIT_ROWS, pull: float = PULL) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_<domain>, rate (expected copies, not negative).

    Tokens are separated by white space. A null or empty text has no tokens, the labels' shares as its posterior, and a rate like
    any other. Without labels all posteriors are equal. Domains without tokens keep their target unmet. Repeated rows
    give repeated rows, an empty table an empty result, extra columns are ignored.
    """
    table = materialize(posteriors(docs, train(docs, labels, fit_rows)))
    n, p = F.col("n_tokens"), {d: F.col(f"p_{d}") for d in DOMAINS}
    have = table.agg(*[F.coalesce(F.sum(n * p[d]), F.lit(0.0)).alias(d) for d in DOMAINS]).first().asDict()
    share = {d: targets[d] / sum(targets.values()) for d in DOMAINS}
    total = have[anchor] / share[anchor] if anchor and have[anchor] else sum(have.values())
    goal = {d: max(share[d] * total, 1e-9) for d in DOMAINS}
    wanted = [d for d in DOMAINS if have[d] > 0]
    sums = _fitted(table, goal, wanted, pull) if wanted else [0.0] * len(DOMAINS)
    return table.select("doc_id", "n_tokens", *[f"p_{d}" for d in DOMAINS], _rate(sums).alias("rate"))


def shares(mixture: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """domain, target, share: of the expected tokens of a mixture; the share is null where it has no tokens."""
    n = F.col("n_tokens") * F.col("rate")
    sums = mixture.agg(*[F.sum(n * F.col(f"p_{d}")).alias(d) for d in DOMAINS])
    whole = sum((F.col(d) for d in DOMAINS), F.lit(0.0))
    rows = F.array(*[
        F.struct(F.lit(d).alias("domain"), F.lit(targets[d] / sum(targets.values())).alias("target"), (F.col(d) / F.nullif(whole, F.lit(0.0))).alias("share")) for d in DOMAINS
    ])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, anchor: str = ANCHOR) -> DataFrame:
    """The documents that the mix takes; none is repeated.

    Rates are fitted with CAREFUL_PULL, so that documents of the anchor domain stay near one where the classifier is unsure. Shares depend on the ratios of rates alone, so rates are scaled by SCALE times the anchor domain's mean rate, and a document
    stays with that probability (one at most) by the hash of its id.
    """
    found = materialize(mix(docs, labels, targets, anchor, pull=CAREFUL_PULL))
    weight = F.col("n_tokens") * F.col(f"p_{anchor}")
    mean = found.agg((F.sum(weight * F.col("rate")) / F.sum(weight)).alias("mean")).first()["mean"] or 1.0
    out = found.where(unit_hash(F.col("doc_id"), F.lit("mix")) >= F.col("rate") / (SCALE * mean)).select("doc_id").where("doc_id is not null").distinct()
    return docs.join(out, "doc_id", "left_anti").select(docs.columns)
