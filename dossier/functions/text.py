"""Text columns: cleaning, finders, identifiers. Pure Column to Column, all JVM side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import constants as K

# Python's white space: the Unicode property and the four separator controls.
SPACE = r"[\s\x1c-\x1f]"
NON_SPACE = r"(?U)[\S&&[^\x1c-\x1f]]++"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def any_term(terms: str) -> tuple[str, str]:
    """A term list as a pattern that tries only terms sharing the next letter, and those letters.

    Terms keep their order within a letter, and terms with other letters cannot match at the
    same place, so the pattern finds what the plain list finds.
    """
    groups: dict[str, list[str]] = {}
    for term in terms.split("|"):
        groups.setdefault(term[:1].lower(), []).append(term[1:])
    if "(" in terms or not all(letter.isalpha() for letter in groups):
        return terms, ""
    letters = "".join(groups)
    return "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in groups.items()), f"[{letters}{letters.upper()}]"


def term_pattern(terms: str) -> str:
    """A finder for a list of terms (alternatives separated by ``|``), whole words, any case."""
    body, letters = any_term(terms)
    return rf"(?U)\b(?={letters})(?i:({body}))\b" if letters else rf"(?iU)\b({body})\b"


AWS_SERVICE = rf"(?U)\b(?=[aA])(?i:(Amazon|AWS)\s+({any_term(K.AWS_SERVICE_TERMS)[0]}))\b"
TECHNOLOGY = term_pattern(K.TECHNOLOGY_TERMS)
PATTERN = term_pattern(K.PATTERN_TERMS)

SIGNAL_TYPE = "struct<signal_type:string,value:string,source_file:string,weight:double,frequency:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; lambdas would otherwise recompute it per element."""
    return F.transform(F.array(value), body)[0]


def explode_rows(df: DataFrame, keep: list[str], items: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per item. The outer form stops the optimizer from computing the items twice,
    once only to test that there are any."""
    if position is None:
        rows = df.select(*keep, F.explode_outer(items).alias(name))
    else:
        rows = df.select(*keep, F.posexplode_outer(items).alias(position, name))
    return rows.where(F.col(name).isNotNull())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(K.WHITESPACE))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    return find_all(text, NON_SPACE)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(NON_SPACE))


def squeeze_newlines(text: Column) -> Column:
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


# -- Markdown ---------------------------------------------------------------

def clean_markdown(text: Column) -> Column:
    text = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    text = F.regexp_replace(text, r"(?d)!\[.*?\]\(.*?\)", "")
    text = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return squeeze_newlines(text)


def headings(text: Column) -> Column:
    return find_all(text, r"(?dmU)^#{1,4}\s+(.+)$", 1)


def code_blocks(text: Column) -> Column:
    fence = r"(?sU)```(\w*)\n(.*?)```"
    pairs = F.arrays_zip(find_all(text, fence, 1).alias("lang"), find_all(text, fence, 2).alias("code"))
    cleaned = F.transform(
        pairs,
        lambda b: F.struct(
            F.when(b["lang"] == "", "text").otherwise(F.lower(b["lang"])).alias("lang"),
            strip(b["code"]).alias("code"),
        ),
    )
    return F.filter(cleaned, lambda b: b["code"] != "")


def shorten(line: Column, width: int = 300) -> Column:
    """Collapse white space; past ``width`` keep the longest run of whole words plus a mark.

    A word may also break after a hyphen between letters or around a run of dashes.
    """
    letter, punct = r"[^\d\W]", r"[\w!\"'&.,?]"
    breaks = (
        rf"(?= )|(?<={letter}{letter}-|{letter}-{letter}-)(?={letter}-?{letter})"
        rf"|(?<={punct})(?=-{{2,}}\w)"
    )

    def cut(one_space: Column) -> Column:
        before = F.regexp_extract(one_space, rf"(?U)^(.{{1,{width - 6}}})(?:{breaks})", 1)
        # A break after a run of dashes of any length; one more character shows what follows it.
        after = F.regexp_extract(F.substring(one_space, 1, width - 5), rf"(?U)^(.*{punct}-{{2,}})(?=\w)", 1)
        head = F.when(F.length(after) > F.length(before), after).otherwise(before)
        short = F.when(head == "", F.lit("[...]")).otherwise(F.concat(head, F.lit(" [...]")))
        return F.when(F.length(one_space) <= width, one_space).otherwise(short)

    return let(strip(F.regexp_replace(line, f"(?U){SPACE}+", " ")), cut)


def markdown_summary(raw: Column, cleaned: Column, source_file: Column) -> Column:
    return markdown_summary_of(headings(raw), cleaned, source_file)


def markdown_summary_of(heads: Column, cleaned: Column, source_file: Column) -> Column:
    """The summary from headings already found. The first line of prose is found once, then shortened."""
    lines = F.transform(F.split(cleaned, "\n"), strip)
    first = F.filter(lines, lambda x: (x != "") & ~x.startswith("#"))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("File: "), source_file),
        let(F.slice(heads, 1, 5), lambda h: F.when(F.size(h) > 0, F.concat(F.lit("Sections: "), F.array_join(h, ", ")))),
        let(F.get(first, F.lit(0)), lambda line: F.when(line.isNotNull(), shorten(line))),
    )


# -- Finders and signals ----------------------------------------------------

def found(text: Column, pattern: str) -> Column:
    """Distinct surface forms, ordered by first occurrence."""
    return F.array_distinct(find_all(text, pattern))


def find_aws_services(text: Column) -> Column:
    return found(text, AWS_SERVICE)


def find_technologies(text: Column) -> Column:
    return found(text, TECHNOLOGY)


def find_patterns(text: Column) -> Column:
    return found(text, PATTERN)


def occurrences(lower_text: Column, value: Column) -> Column:
    """Non-overlapping substring count, ignoring case. Lengths in bytes need no pass over the text."""
    low = F.lower(value)
    rest = F.octet_length(F.replace(lower_text, low, F.lit("")))
    return ((F.octet_length(lower_text) - rest) / F.octet_length(low)).cast("int")


def signal_rows(values: Column, kind: str, lower_text: Column, source_file: Column, weight: Column) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(
            F.lit(kind).alias("signal_type"),
            v.alias("value"),
            source_file.alias("source_file"),
            weight.cast("double").alias("weight"),
            occurrences(lower_text, v).alias("frequency"),
        ),
    )


def bare_signals(values: Column, kind: str) -> Column:
    """Bare signals of one kind, enough for classification."""
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("signal_type"), v.alias("value")))


def build_signals(text: Column, source_file: Column, weight: Column, patterns: dict[str, str] | None = None) -> Column:
    patterns = patterns or {"aws_service": AWS_SERVICE, "technology": TECHNOLOGY, "pattern": PATTERN}
    return let(
        F.struct(text.alias("text"), F.lower(text).alias("low")),
        lambda x: F.concat(
            *[signal_rows(found(x["text"], p), kind, x["low"], source_file, weight) for kind, p in patterns.items()]
        ),
    )


# -- Identifiers ------------------------------------------------------------

def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def stable_id(node_type: Column | str, label: Column) -> Column:
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    normal = F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9]", "_"), F.lit("_"))
    return F.concat(F.lower(kind), F.lit("_"), normal)


def edge_id(from_id: Column, relationship: Column, to_id: Column) -> Column:
    return F.concat(from_id, F.lit("__"), F.lower(relationship), F.lit("__"), to_id)


def fingerprint(text: Column) -> Column:
    return F.md5(F.substring(text, 1, 500).cast("binary"))
