"""Text columns and chunkers against small independent derivations."""

import random
import re
import textwrap

from pyspark.sql import functions as F

from dossier import constants as K
from dossier.functions import documents as D
from dossier.functions import questions as Q
from dossier.functions import text as T
from dossier.operators import chunking as C
from dossier.operators import extraction as X


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t")).alias("x")).first()["x"]


def test_white_space_is_pythons():
    assert sorted(K.WHITESPACE) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_word_patterns_split_like_python(spark):
    for text in ["", "  a\tb\x1cc\x85d\xa0e　f ", "x", "a ​ b"]:
        assert one(spark, text, T.words) == text.split()


def test_finders(spark):
    assert one(spark, "C++ and C++11 Go", T.find_technologies) == ["C++", "Go"]
    assert one(spark, "AWS  lambda, amazon route 53 and AWS Unknown", T.find_aws_services) == ["AWS  lambda", "amazon route 53"]
    assert one(spark, "Event-driven xRAG RAG", T.find_patterns) == ["Event-driven", "RAG"]


def test_grouped_terms_find_what_the_list_finds(spark):
    rng = random.Random(3)
    terms = [t.replace("\\", "") for t in (K.TECHNOLOGY_TERMS + "|" + K.PATTERN_TERMS).split("|")]
    pool = terms + ["é", "x_Go", "go", "Javax", "REST-ful", "nodeXjs"]
    texts = [" ".join(rng.choice(pool) for _ in range(40)) for _ in range(400)]
    found = [T.find_all(F.col("t"), p).alias(n) for n, p in (("a", T.TECHNOLOGY), ("b", T.PATTERN))]
    for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", *found).collect():
        for got, listed in ((r.a, K.TECHNOLOGY_TERMS), (r.b, K.PATTERN_TERMS)):
            assert got == [m.group(0) for m in re.finditer(rf"\b({listed})\b", texts[r.i], re.IGNORECASE)]


def test_substring_frequency(spark):
    assert one(spark, "gogogo", lambda c: T.occurrences(F.lower(c), F.lit("go"))) == 3


def test_ids(spark):
    assert one(spark, "a--b", lambda c: T.stable_id("Pattern", c)) == "pattern_a__b"
    assert one(spark, "a--b", T.slug) == "a_b"


def test_shorten_like_textwrap(spark):
    rng = random.Random(1)
    words = ["foo", "bar-baz", "well-known-thing", "a--b", "x", "word's", "é-tude-two", "9-lives", "l" * 90, "m" * 310]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 90]))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", T.shorten(F.col("t")).alias("s"))
    assert all(r.s == textwrap.shorten(lines[r.i], 300) for r in rows.collect())
    # Runs of dashes of any length are one break.
    lines = ["ab " * at + "cd" + "-" * n + "ef " * 200 for n in (2, 40, 41, 45, 60, 290, 400) for at in (0, 70, 80, 90, 97)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").select("i", T.shorten(F.col("t")).alias("s"))
    assert all(r.s == textwrap.shorten(lines[r.i], 300) for r in rows.collect())


def test_markdown(spark):
    text = "# A\n<!-- x\ny -->\n![i](p.png)\nSee [Docs](http://x).\n\n\n\n```py\n1\n```\n```\n \n```\n"
    assert one(spark, text, T.clean_markdown) == "# A\n\nSee Docs.\n\n```py\n1\n```\n```\n \n```"
    assert [tuple(b) for b in one(spark, text, T.code_blocks)] == [("py", "1")]


def test_yaml_key_test_spans_lines(spark):
    stats = one(spark, "Note:\n\nfoo", D.text_stats)
    assert stats.has_yaml_keys and stats.word_count == 2
    assert one(spark, "", D.text_stats).word_count == 0


def test_source_weight_takes_first_key(spark):
    assert one(spark, "decoder.py", D.source_weight) == 0.6
    for strategy, want in [("keyword_boosted", 0.85), ("graph_first", 0.2), ("hybrid", 0.6), ("semantic_search", 0.4)]:
        assert one(spark, "a.DOCX", lambda c, s=strategy: D.source_weight(c, F.lit(s))) == want


def test_window_counts(spark):
    for n, want in [(0, 0), (1, 1), (256, 1), (257, 2), (487, 2), (488, 3)]:
        got = one(spark, " ".join(f"w{i}" for i in range(n)), lambda c: C.windows(T.words(c), 256, 25))
        assert len(got) == want
        assert {w for c in got for w in c.split()} == {f"w{i}" for i in range(n)}


def test_hierarchical(spark):
    for n, shape in [(300, [False]), (301, [False, True, True])]:
        got = one(spark, " ".join(f"w{i}" for i in range(n)), C.hierarchical_chunks)
        assert [c.is_child for c in got] == shape
        assert all(c.parent_content == got[0].content for c in got[1:])


def test_sentence_windows(spark):
    short, middle, long = "A" + "b" * 48 + ".", "C" + "d" * 298 + ".", "E" + "f" * 598 + "."
    cases = {  # a window takes sentences until it has 512 characters, and the next begins with its last one
        " ".join([short] * 3): [f"{short} {short} {short}", short],
        " ".join([middle] * 3): [f"{middle} {middle}", f"{middle} {middle}", middle],
        " ".join([long] * 3): [long, long, long],
        f"{long} {short}": [long, short],
        f"{short} {long} {short}": [f"{short} {long}", f"{long}", short],
        "One! Two? three. Four": ["One! Two? three. Four", "Four"],
        "": [],
    }
    for text, want in cases.items():
        assert [c.content for c in one(spark, text, C.sentence_chunks)] == want


def test_unknown_strategy_is_fixed_512_and_blank_has_no_chunks(spark):
    rows = spark.createDataFrame([("a b", "other"), ("  ", "sentence"), (None, "hierarchical")], "t string, s string")
    got = rows.select(C.chunk_array(F.col("t"), F.col("s")).alias("c")).collect()
    assert [[c.content for c in r.c] for r in got] == [["a b"], [], []]


ARROW = re.compile(X.ARROW, re.MULTILINE)


def plain_relations(text):
    out = []
    for m in ARROW.finditer(text):
        a, b = (m.group(g).strip().strip('"') for g in (1, 2))
        if len(a) > 1 and len(b) > 1:
            label = (m.group(3) or "").strip()
            out.append(f"{a} → {b}" + (f" [{label}]" if label else ""))
    return out


def test_relations_match_plain_search(spark):
    rng = random.Random(5)
    pieces = ["User", '"Web App"', "<x>", "-->", "->", "..", "--", "<-", " : asks", "\n", "\n\n", " ", "a-b", ":", '"', "long text here"]
    texts = ["".join(rng.choice(pieces) for _ in range(25)) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", X.diagram_relations(F.col("t")).alias("r"))
    assert all(r.r == plain_relations(texts[r.i]) for r in rows.collect())


def test_questions(spark):
    assert one(spark, "How well do you know Go?", Q.classify_by_pattern) == "skill_depth"
    assert one(spark, "experience at Acme", Q.classify_by_pattern) == "project"
    assert one(spark, "What is it?", Q.classify_by_pattern) == "general"
    assert one(spark, "What now?", Q.is_time_sensitive)
    assert not one(spark, "What is known?", Q.is_time_sensitive)
    assert one(spark, "The S3 in-use of a-b and Go", Q.keywords) == ["in-use", "a-b"]
    pair = lambda a, b: one(spark, a, lambda c: Q.jaccard(Q.prefix_words(c), Q.prefix_words(F.lit(b))))
    assert pair("a b c", "a b d") == 0.5
    assert pair(" ", "a") == 0.0


def test_extraction_kinds(spark):
    rows = spark.createDataFrame([
        ("raw/r/repo-signals.yaml", "skills:\n  - Python\n  - name: Go\npatterns: [serverless]\nn: {a: [1, 2]}\n"),
        ("raw/r/bad.yaml", "a: [1\n b: }"),
        ("raw/r/list.yml", "- a\n- b"),
        ("raw/r/x.puml", '@startuml\n!include <awslib/Compute/My-Fn>\nactor User\nUser --> Web : go\nAWS Lambda\n@enduml'),
        ("raw/r/t.rst", "hello\n\n\n\nRust"),
    ], "source_key string, content string").withColumn("repo_prefix", F.lit("raw/r/"))
    got = {r.source_file: r for r in X.extract(rows).collect()}
    manifest = got["repo-signals.yaml"]
    assert manifest.extracted_text.splitlines() == [
        "skills[0]: Python", "skills[1].name: Go", "patterns[0]: serverless", "n.a[0]: 1", "n.a[1]: 2"]
    assert [(s.signal_type, s.value) for s in manifest.expertise_signals][:3] == [
        ("skill", "Python"), ("skill", "Go"), ("pattern", "serverless")]
    assert manifest.weight == 0.7
    assert got["bad.yaml"].expertise_signals == [] and got["bad.yaml"].extracted_text == "a: [1\n b: }"
    assert got["list.yml"].summary == "YAML config: list.yml. Keys: list."
    services = [s.value for s in got["x.puml"].expertise_signals if s.signal_type == "aws_service"]
    assert services == ["AWS Lambda", "AWS My Fn", "AWS Lambda"]
    assert "User → Web [go]" in got["x.puml"].extracted_text
    assert got["t.rst"].extracted_text == "hello\n\nRust"
