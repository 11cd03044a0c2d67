"""Policy screen: denied phrases and kinds of sensitive data in a text, as columns.

A kind is found by its layout where that is telling, else by the word that names it. Patterns use no look-around, so that the
same ones run on other engines.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import text as T
from dossier.functions.questions import denied_phrase

_START, _END = r"(?:^|[^A-Za-z0-9])", r"(?:[^A-Za-z0-9]|$)"


def _whole(body: str) -> str:
    return f"{_START}(?:{body}){_END}"


def _named(name: str, body: str) -> str:
    return _whole(rf"(?i:{name})[ \t]*(?:number|no\.?|#)?[ \t]*(?:is|:|=)?[ \t]*(?:{body})")


#: Kinds that stop a text (fixed names), and how they look.
SENSITIVE = {
    "ADDRESS": _whole(r"[0-9]{1,5} (?:[A-Z][a-z]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)"),
    "AGE": _whole(r"(?i:aged?[ \t]*:?)[ \t]*[0-9]{1,3}|[0-9]{1,3}[ -](?i:years?[ -]old)"),
    "AWS_ACCESS_KEY": _whole(r"(?:AKIA|ASIA)[0-9A-Z]{16}"),
    "AWS_SECRET_KEY": _whole(r"(?i:secret[ _-]?(?:access[ _-]?)?key)[ \t]*[:=][ \t]*[A-Za-z0-9/+]{40}"),
    "CREDIT_DEBIT_CARD_CVV": _named(r"cvv2?|cvc2?|security code", r"[0-9]{3,4}"),
    "CREDIT_DEBIT_CARD_EXPIRY": _whole(r"(?i:exp(?:iry|ires|iration)?(?: date)?)[ \t]*[:=]?[ \t]*(?:0[1-9]|1[0-2])/(?:20)?[0-9]{2}"),
    "CREDIT_DEBIT_CARD_NUMBER": _whole(r"[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}"),
    "DRIVER_ID": _named(r"driver'?s? licen[cs]e", r"[A-Z0-9]{6,14}"),
    "IP_ADDRESS": _whole(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"),
    "LICENSE_PLATE": _named(r"licen[cs]e plate|number plate", r"[A-Z0-9-]{4,8}"),
    "MAC_ADDRESS": _whole(r"(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}"),
    "PASSWORD": _whole(r"(?i:password|passwd|pwd)[ \t]*(?:is|:|=)[ \t]*[^ \t\n]{4,}"),
    "PIN": _named(r"pin(?: code)?", r"[0-9]{4,6}"),
    "USERNAME": _whole(r"(?i:user ?name|login)[ \t]*[:=][ \t]*[A-Za-z0-9._-]{3,}"),
    "US_BANK_ACCOUNT_NUMBER": _named(r"(?:bank )?account", r"[0-9]{8,17}"),
    "US_BANK_ROUTING_NUMBER": _named(r"routing", r"[0-9]{9}"),
    "US_INDIVIDUAL_TAX_IDENTIFICATION_NUMBER": _whole(r"9[0-9]{2}-[5-9][0-9]-[0-9]{4}"),
    "US_PASSPORT_NUMBER": _named(r"passport", r"[A-Z]?[0-9]{8,9}"),
    "US_SOCIAL_SECURITY_NUMBER": _whole(r"[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}"),
    "VEHICLE_IDENTIFICATION_NUMBER": _named(r"vin|vehicle identification", r"[A-HJ-NPR-Z0-9]{17}"),
}
#: What a text of a kind cannot lack: a digit or not, words or marks one of which it holds in lower case, and how a find may start.
CLUES = {
    "ADDRESS": (True, (), "0-9"), "AGE": (True, (), "aA0-9"), "AWS_ACCESS_KEY": (False, ("akia", "asia"), "A"),
    "AWS_SECRET_KEY": (False, ("secret",), "sS"), "CREDIT_DEBIT_CARD_CVV": (True, ("cvv", "cvc", "security code"), "cCsS"),
    "CREDIT_DEBIT_CARD_EXPIRY": (True, ("exp",), "eE"), "CREDIT_DEBIT_CARD_NUMBER": (True, (), "3-6"),
    "DRIVER_ID": (False, ("driver",), "dD"), "IP_ADDRESS": (True, (".",), "0-9"), "LICENSE_PLATE": (False, ("plate",), "lLnN"),
    "MAC_ADDRESS": (False, (":", "-"), "0-9A-Fa-f"), "PASSWORD": (False, ("password", "passwd", "pwd"), "pP"), "PIN": (True, ("pin",), "pP"),
    "USERNAME": (False, ("username", "user name", "login"), "uUlL"), "US_BANK_ACCOUNT_NUMBER": (True, ("account",), "bBaA"),
    "US_BANK_ROUTING_NUMBER": (True, ("routing",), "rR"), "US_INDIVIDUAL_TAX_IDENTIFICATION_NUMBER": (True, ("-",), "9"),
    "US_PASSPORT_NUMBER": (True, ("passport",), "pP"), "US_SOCIAL_SECURITY_NUMBER": (True, ("-",), "0-8"),
    "VEHICLE_IDENTIFICATION_NUMBER": (False, ("vin", "vehicle identification"), "vV"),
}
#: Profile addresses are taken out of a text, which may pass (fixed value).
PROFILE_URL = r"https?://(www\.)?linkedin\.com/in/[a-zA-Z0-9\-]+/?"
PROFILE_MARK = "{profile-url}"


def _finder(kind: str) -> str:
    """A pattern that finds a kind where the one in ``SENSITIVE`` does, but is tried only at characters a find may start with."""
    body = SENSITIVE[kind].removeprefix(_START).removesuffix(_END)
    return f"(?=[{CLUES[kind][2]}])(?<![A-Za-z0-9]){body}(?![A-Za-z0-9])"


def sensitive_kinds(text: Column) -> Column:
    """Kinds of sensitive data in a text, sorted; none in a null text. A pattern runs only on texts with its kind's clues."""

    def tests(seen: Column) -> Column:
        found = []
        for kind, (digit, marks, _) in CLUES.items():
            hit = text.rlike(_finder(kind))
            if marks:
                hit = functools.reduce(lambda a, b: a | b, [F.contains(seen["low"], F.lit(m)) for m in marks]) & hit
            found.append(F.when(seen["digit"] & hit if digit else hit, F.lit(kind)))
        return F.array_compact(F.array(*found))

    found = T.let(F.struct(F.lower(text).alias("low"), text.rlike("[0-9]").alias("digit")), tests)
    return F.coalesce(found, F.array().cast("array<string>"))


def without_profiles(text: Column) -> Column:
    return F.regexp_replace(text, PROFILE_URL, PROFILE_MARK)


def screened(rows: DataFrame, text: str = "question") -> tuple[DataFrame, DataFrame]:
    """Rows that may pass, profile addresses taken out, and those that may not, with ``reasons``."""
    reasons = F.array_compact(F.concat(F.array(F.when(denied_phrase(F.col(text)).isNotNull(), F.lit("DENIED_PHRASE"))), sensitive_kinds(F.col(text))))
    judged = rows.withColumn("reasons", reasons)
    passing = judged.where(F.size("reasons") == 0).withColumn(text, without_profiles(F.col(text)))
    return passing.drop("reasons"), judged.where(F.size("reasons") > 0)
