"""Personal data replaced by surrogates: keyed, consistent with the type, one per entity.

Entities are found by one expression per type. What an entity names is its core: a phone's or card's digits, an address of mail in
lower case, a secret without its label; of a name the given and the family name are cores of their own, without the title. Every
distinct core of the whole table gets a surrogate of its own type and script, drawn from a keyed hash of type and core and of a
round number. Cores whose surrogate is taken, or is itself a core of the corpus, draw again, so
that different cores stay different and equal ones equal, however they are written. Those that are still open after the draws
are numbered, and the number is spelt into a longer surrogate of the same type: more syllables in a
name, more digits elsewhere. The way each entity is written is then laid over its core's surrogate. Only column expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.session import materialize

DEFAULT_KEY = "surrogates-1"
#: Draws until a name, an address of mail or a secret, whose lengths are free, grows by its number.
ROUNDS = 4
#: Draws until the other types grow; their formats have 100 million values and more, so draws go on finding free ones.
FIXED_ROUNDS = 32
#: Entities in one task while open ones are numbered.
NUMBERED_AT_ONCE = 100_000

_LOCAL = r"[\p{L}\p{M}\p{N}._%+\-]"
_LABEL = r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*+[=:]\s*+[\x22']?+"
#: Beginnings of keys that services hand out.
_PREFIX = (
    r"(?:(?:AKIA|ASIA)(?=[0-9A-Z]{16})|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk-(?:proj-|ant-)?|[srp]k_(?:live|test)_|AIza|npm_|hf_|SG\.)"
)
_BLOCK_END = r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY-----"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Entity types in order of preference where two begin at the same place, and their layouts. An entity starts at a
#: word's start, and possessive or short bounded runs keep the search linear in long runs of letters or digits.
LAYOUTS = {
    "secret": (
        rf"{_LABEL}[\p{{L}}\p{{N}}+/_\-]{{16,}}+",
        # A private key with its end line, or its lines of base64 where the text breaks off.
        rf"-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY-----(?:[^\-]*+(?:-(?!----)[^\-]*+)*+{_BLOCK_END}|(?:\s++[A-Za-z0-9+/=]{{16,}}+)++)",
        rf"(?<![\p{{L}}\p{{N}}_\-]){_PREFIX}[A-Za-z0-9_\-.]{{15,}}+",
        r"(?<![\p{L}\p{N}_\-])eyJ[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+\.[A-Za-z0-9_\-]{10,}+",
    ),
    "email": (rf"(?<!{_LOCAL})(?>{_LOCAL}++)@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)+",),
    "ip": (
        r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
        # Eight groups, or fewer with a gap and a figure (code has names like std::add).
        rf"(?<![\p{{L}}\p{{N}}:.])(?:{_HEX}:){{7}}{_HEX}(?![\p{{L}}\p{{N}}:])",
        rf"(?<![\p{{L}}\p{{N}}:.])(?=[A-Fa-f:]{{0,39}}\d)(?!(?:[0-9A-Fa-f]{{0,4}}:){{9}}){_HEX}(?::{_HEX}){{0,6}}::(?:{_HEX}(?::{_HEX}){{0,6}})?(?![\p{{L}}\p{{N}}:]|\.\d)",
    ),
    "ssn": (r"(?<![\p{L}\p{N}\-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\p{L}\p{N}]|-\d)",),
    "phone": (
        r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .\-]?+\(?\d{2,4}\)?[ .\-]?\d{3}[ .\-]\d{4}(?!\d)",
        # Any grouping after a country code.
        r"(?<![\p{L}\p{N}+])(?:\+|00)[1-9](?:[ .\-/]?\(?\d\)?){7,14}(?!\d)",
        # National: three, three and four digits; then with a trunk 0.
        r"(?<![\p{L}\p{N}+.\-])(?:1[ .\-])?(?:\(\d{3}\) ?\d{3}[ .\-]?|\d{3}[.\-]\d{3}[.\-]|\d{3} \d{3}[ \-])\d{4}(?![\p{L}\p{N}]|[ .\-]\d)",
        r"(?<![\p{L}\p{N}+.\-])\(?0\d(?:\) ?|[ .\-])\d{2}(?:[ .\-]\d{2}){3}(?![\p{L}\p{N}]|[ .\-]\d)",
        r"(?<![\p{L}\p{N}+.\-])\(?0\d{2,4}(?:\) ?|[ \-/])\d{3,4}[ \-]?\d{3,4}(?![\p{L}\p{N}]|[ .\-]\d)",
    ),
    "iban": (r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",),
    "card": (
        r"(?<![\p{L}\p{N}])\d{4}(?:[ \-]\d{4}){3}[ \-]\d{3}(?![\p{L}\p{N}]|[ \-]\d)",
        r"(?<![\p{L}\p{N}])\d{4}(?:[ \-]?\d{4}){3}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}])[2-6]\d{12,18}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}\-])3\d{3}[ \-]\d{6}[ \-]\d{4,5}(?![\p{L}\p{N}]|[ \-]\d)",
        r"(?<![\p{L}\p{N}\-])[2-6]\d{3}(?:[ \-]\d{4}){2,3}[ \-]\d{1,2}(?![\p{L}\p{N}]|[ \-]\d)",
    ),
    "name": (
        r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Señor|Señora|Sr|Sra|Г-н|Г-жа)\.?+ "
        # Scripts without capital letters do not show where a second part ends, so it is one part there.
        r"(?:\p{Lu}[\p{L}'\-]++(?: \p{Lu}[\p{L}'\-]++)?|\p{Lo}[\p{L}\p{M}'\-]*+)",
    ),
}
PATTERNS = {kind: "|".join(f"(?:{p})" for p in layouts) for kind, layouts in LAYOUTS.items()}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these cannot hold an entity; the cheap test goes first.
HINT = (
    r"@|\d\.\d|\d{4}|\d \(|\+\d|0\d\)?[ .\-]?\d|[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:|[A-Z]{2}\d\d|(?i:token|secret|passw|key)|"
    r"gh[pousr]_|github_pat_|glpat-|xox|[srp]k[\-_]|AIza|AKIA|ASIA|npm_|hf_|SG\.|eyJ|"
    r"(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Señora?|Sra?|Г-н|Г-жа)\.? "
)

#: Given and family names by gender and script (made up; any names of the gender serve).
NAMES = {
    ("m", "latin"): ("Alan", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marc", "Nils", "Oskar", "Paul"),
    ("f", "latin"): ("Anna", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helga", "Irene", "Julia", "Karla", "Laura", "Maria", "Nina", "Olga", "Paula"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"),
    ("f", "cyrillic"): ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Клара"),
}
FAMILY = {
    "latin": ("Abend", "Berger", "Calder", "Dorn", "Eckert", "Falk", "Gruber", "Hagen", "Iversen", "Jansen", "Keller", "Lindner", "Moreau", "Novak", "Olsen", "Petit"),
    "cyrillic": ("Дорн", "Кац", "Лист", "Мельник", "Ткач", "Франк", "Чиж", "Шульц"),
}
FEMALE_TITLE = r"^(?:Mrs|Ms|Frau|Madame|Señora|Sra|Г-жа)\b"


def type_of(entity: Column) -> Column:
    """The first type that the whole entity fits; null for card numbers and IBANs whose check digits are wrong."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        here = entity.rlike(f"^(?:{pattern})$")
        if name == "iban":
            # A wrong one with a card number in fours is replaced nevertheless.
            here = here & ((_mod_97(entity) == 1) | entity.rlike(r"(?:\d{4} ?){4}"))
        if name == "card":
            fours = entity.rlike(r"^\d{4}(?:[ \-]?\d{4}){3}(?:[ \-]\d{3})?$")
            here = here & (fours | (_check_digit(F.substr(entity, F.lit(1), F.length(entity) - 1)) == F.right(entity, F.lit(1))))
        out = F.when(here, F.lit(name)).otherwise(out)
    return out


def _draw(seed: Column, place: Column, span: int) -> Column:
    """A keyed number below `span` for one place of the entity."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", seed, place.cast("string")), 256), 1, 15), 16, 10).cast("long"), F.lit(span)).cast("int")


def _character(c: Column, at: Column, seed: Column, hexadecimal: Column) -> Column:
    """Another character of the same class and script; signs, spaces and accents stay."""
    pick = lambda letters: F.substr(F.lit(letters), _draw(seed, at, len(letters)) + 1, F.lit(1))
    return (
        F.when(c.rlike(r"\d"), pick("0123456789"))
        .when(hexadecimal & c.rlike("[a-f]"), pick("abcdef")).when(hexadecimal & c.rlike("[A-F]"), pick("ABCDEF"))
        .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c.rlike(r"[\p{IsCyrillic}&&\p{Ll}]"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
        .when(c.rlike(r"[\p{IsCyrillic}&&\p{Lu}]"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
        .when(c.rlike(r"[\p{IsLatin}&&\p{Ll}]"), pick("éèêçñóíüöäß")).when(c.rlike(r"[\p{IsLatin}&&\p{Lu}]"), pick("ÉÈÊÇÑÓÍÜÖÄ"))
        .otherwise(c)
    )


def _scrambled(value: Column, seed: Column, hexadecimal: Column) -> Column:
    characters = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(characters, lambda c, i: _character(c, i, seed, hexadecimal)), "")


def _check_digit(digits: Column) -> Column:
    """The last digit that makes a card number's weighted digit sum a multiple of ten."""
    doubled = lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int")
    figures = F.reverse(F.filter(F.split(digits, ""), lambda c: c.rlike(r"\d")))
    total = F.aggregate(F.transform(figures, doubled), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10)).cast("string")


def _mod_97(iban: Column) -> Column:
    """An IBAN's remainder by 97, its first four characters last and letters as numbers from 10."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike(r"\d"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: ((a * F.when(value(c) > 9, F.lit(100)).otherwise(F.lit(10)) + value(c)) % 97).cast("int")
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c.rlike("[A-Z0-9]")), F.lit(0), step)


def _pick(names: tuple[str, ...], seed: Column, place: int) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), _draw(seed, F.lit(place), len(names)) + 1)


def _spelt(names: tuple[str, ...], number: Column, width: int) -> Column:
    """`width` family parts that spell a number; no part begins another, so different numbers give different words."""
    base = len(names)
    digits = [F.pmod(F.floor(number / F.lit(base**i)).cast("long"), F.lit(base)).cast("int") + 1 for i in range(width)]
    return F.lower(F.concat(*[F.element_at(F.array(*[F.lit(n) for n in names]), d) for d in digits]))


def _places(n: int, base: int) -> int:
    """Digits to the base that numbers below n need."""
    out = 1
    while base**out < n:
        out += 1
    return out


def _value(entity: Column) -> tuple[Column, Column, Column]:
    """Label, value and end of a secret."""
    label = F.regexp_extract(entity, rf"^(?:{_LABEL}|-----BEGIN [A-Z0-9 ]{{0,40}}PRIVATE KEY-----|{_PREFIX}|eyJ)", 0)
    end = F.regexp_extract(entity, rf"\s*{_BLOCK_END}$", 0)
    return label, F.substr(entity, F.length(label) + 1, F.length(entity) - F.length(label) - F.length(end)), end


def cores_of(kind: Column, entity: Column) -> Column:
    """An entity's cores as (kind, core): of a name its family name and, where it has two parts, its given name."""
    person = F.regexp_replace(entity, r"^\S+ ", "")
    parts = F.split(person, " ")
    script = F.when(person.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    gender = F.when(entity.rlike(FEMALE_TITLE), F.lit("f")).otherwise(F.lit("m"))
    core = lambda k, c: F.struct(k.alias("kind"), c.alias("core"))
    family = core(F.concat_ws("-", F.lit("family"), script), F.lower(F.element_at(parts, -1)))
    given = core(F.concat_ws("-", F.lit("given"), gender, script), F.lower(F.element_at(parts, 1)))
    plus = F.when(entity.rlike(r"^(?:\+|00)"), F.lit("+")).otherwise(F.lit(""))
    figures = F.regexp_replace(F.regexp_replace(entity, "^00", ""), r"[^0-9]", "")
    flat = F.when(kind == "phone", F.concat(plus, figures)).when(kind.isin("card", "iban"), F.regexp_replace(entity, r"[ \-]", "")) \
        .when(kind.isin("email", "ip"), F.lower(entity)).when(kind == "secret", _value(entity)[1]).otherwise(entity)
    return F.when(kind == "name", F.when(F.size(parts) > 1, F.array(family, given)).otherwise(F.array(family))).otherwise(F.array(core(kind, flat)))


def written_as(kind: Column, entity: Column, found: Column) -> Column:
    """The surrogates of an entity's cores, written as the entity is."""
    new = F.element_at(found, 1)
    title = F.regexp_extract(entity, r"^\S+ ", 0)
    person = F.concat(title, F.when(F.size(found) > 1, F.concat(F.element_at(found, 2), F.lit(" "), new)).otherwise(new))
    label, _, end = _value(entity)
    upper = lambda c: c != F.lower(c)
    letters = F.zip_with(F.split(new, ""), F.split(entity, ""), lambda n, c: F.when(upper(c), F.upper(n)).otherwise(n))
    mail = F.when(F.length(new) == F.length(entity), F.array_join(letters, "")).otherwise(new)
    # Figures and letters stand in for those of the entity one by one; what is left of a grown surrogate follows.
    zeros = F.regexp_extract(entity, "^00(?=[1-9])", 0)
    zeros = F.when(kind == "phone", zeros).otherwise(F.lit(""))
    bare = F.regexp_replace(new, r"\+", "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    step = lambda a, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct(F.concat(a["text"], F.substr(bare, a["at"] + 1, F.lit(1))).alias("text"), (a["at"] + 1).alias("at"))) \
        .otherwise(F.struct(F.concat(a["text"], c).alias("text"), a["at"].alias("at")))
    laid = F.aggregate(F.filter(F.split(F.substr(entity, F.length(zeros) + 1), ""), lambda c: c != ""), start, step, lambda a: F.concat(zeros, a["text"], F.substr(bare, a["at"] + 1)))
    return F.when(kind == "name", person).when(kind == "secret", F.concat(label, new, end)).when(kind == "email", mail) \
        .when(kind == "ip", F.when(entity.rlike("[A-F]"), F.upper(new)).otherwise(new)).when(kind == "ssn", new).otherwise(laid)


def surrogate_of(kind: Column, core: Column, seed: Column, number: Column | None = None, numbers: int = 0, longer: int = 0) -> Column:
    """A replacement of a core of the same type and script; for given names of the same gender.

    With a number below `numbers` the replacement is longer: a name by the parts that spell the number and
    `longer` drawn ones, all else by its digits. Different numbers give different replacements.
    """
    figures = F.lit("") if number is None else F.lpad(number.cast("string"), _places(numbers, 10) + longer, "0")

    def grown(drawn: Column, names: tuple[str, ...]) -> Column:
        if number is None:
            return drawn
        return F.concat(drawn, _spelt(names, number, _places(numbers, len(names))), *[F.lower(_pick(names, seed, 3 + i)) for i in range(longer)])

    secret = F.concat(_scrambled(core, seed, core.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")), figures)
    none = F.lit(False)
    local, host = F.substring_index(core, "@", 1), F.substring_index(core, "@", -1)
    suffix = F.regexp_extract(host, r"\.[^.]+$", 0)
    reserved = F.regexp_extract(host, r"(?:^|\.)(example\.(?:com|org|net))$", 1)
    kept = F.when(reserved != "", F.concat(F.lit("."), reserved)).otherwise(suffix)
    name = F.substr(host, F.lit(1), F.length(host) - F.length(kept))
    email = F.concat(_scrambled(local, seed, none), figures, F.lit("@"), _scrambled(F.when(name == "", host).otherwise(name), F.concat(seed, F.lit("h")), none), F.when(name == "", F.lit("")).otherwise(kept))
    ip = F.array_join(F.transform(F.split(core, r"\."), lambda c, i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    ip = F.when(F.instr(core, ":") > 0, _scrambled(core, seed, F.lit(True))).otherwise(ip)
    # Area, group and number of a social security number are never zero.
    ssn = F.concat_ws("-", *[F.lpad((_draw(seed, F.lit(i), span) + 1).cast("string"), width, "0") for i, (span, width) in enumerate(((665, 3), (99, 2), (9999, 4)))])
    bank = F.concat(F.substr(core, F.lit(1), F.lit(2)), F.lit("00"), _scrambled(F.substr(core, F.lit(5)), seed, none))
    iban = F.concat(F.substr(core, F.lit(1), F.lit(2)), F.lpad((98 - _mod_97(bank)).cast("string"), 2, "0"), F.substr(bank, F.lit(5)))
    # The country stays: one figure for +1 and +7, else two; of a national number the trunk 0.
    country = F.regexp_extract(core, r"^(?:\+[17]|\+\d\d|0)", 0)
    phone = F.concat(country, _scrambled(F.substr(core, F.length(country) + 1), seed, none))
    body = _scrambled(F.substr(core, F.lit(1), F.length(core) - 1), seed, none)
    card = F.concat(body, _check_digit(body))
    out = F.when(kind == "secret", secret).when(kind == "email", email)
    for script, families in FAMILY.items():
        out = out.when(kind == f"family-{script}", grown(F.concat(_pick(families, seed, 1), F.lower(_pick(families, seed, 2))), families))
        for gender in ("m", "f"):
            out = out.when(kind == f"given-{gender}-{script}", grown(_pick(NAMES[gender, script], seed, 0), families))
    return out.otherwise(F.concat(F.when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "iban", iban).otherwise(card), figures))


def _numbered(open_: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Open cores with a number that no other core of their kind has, and a bound of the numbers.

    Large kinds are dealt over salts: a task counts its own cores, and the salt is the number's last digit.
    """
    salts = max(1, -(-open_.count() // NUMBERED_AT_ONCE))
    order = F.sha2(F.concat_ws("|", F.lit(key), "kind", "core"), 256)
    rows = open_.withColumn("order", order).withColumn("salt", F.pmod(F.xxhash64("order"), F.lit(salts)))
    place = F.row_number().over(Window.partitionBy("kind", "salt").orderBy("order", "core"))
    rows = materialize(rows.select("core", "kind", ((place - 1) * F.lit(salts) + F.col("salt")).cast("long").alias("number")))
    return rows, 1 + rows.agg(F.max("number")).first()[0]


def _taken(drawn: DataFrame, known: DataFrame, done: DataFrame | None) -> DataFrame:
    """The drawn surrogates that are no core and not given away, each for the smallest core that drew it."""
    match = F.lower("surrogate").alias("match")
    free = drawn.withColumn("match", match).join(known, "match", "left_anti")
    free = free.join(done.select(match).distinct(), "match", "left_anti") if done is not None else free
    first = free.groupBy("match").agg(F.min(F.struct("core", "kind", "surrogate")).alias("e")).select("e.core", "e.kind", "e.surrogate")
    return materialize(first)


def _core_surrogates(cores: DataFrame, key: str) -> DataFrame:
    """(core, kind) to (core, kind, surrogate): one to one, and no surrogate is a core of the table, whatever its case."""
    open_ = materialize(cores.select("core", "kind").distinct())
    known = open_.select(F.lower("core").alias("match")).distinct()
    free_length = F.col("kind").isin("email", "secret") | F.col("kind").startswith("family") | F.col("kind").startswith("given")
    done = grow = None
    for round_ in range(FIXED_ROUNDS):
        if round_ == ROUNDS:
            grow, open_ = open_.where(free_length), open_.where(~free_length)
        if open_.isEmpty():
            break
        seed = F.concat_ws("|", F.lit(key), F.col("kind"), F.col("core"), F.lit(str(round_)))
        first = _taken(open_.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("core"), seed)), known, done)
        done = first if done is None else materialize(done.unionByName(first))
        open_ = materialize(open_.join(first, ["core", "kind"], "left_anti"))
    open_ = open_ if grow is None else materialize(open_.unionByName(grow))
    if open_.isEmpty():
        return open_.withColumn("surrogate", F.lit("")) if done is None else done
    # Every further round makes the surrogates longer, until they are longer than any that is taken.
    open_, numbers = _numbered(open_, key)
    longer = 0
    while not open_.isEmpty():
        seed = F.concat_ws("|", F.lit(key), F.col("kind"), F.col("core"), F.lit(str(FIXED_ROUNDS + longer)))
        new = surrogate_of(F.col("kind"), F.col("core"), seed, F.col("number"), numbers, longer)
        first = _taken(open_.withColumn("surrogate", new), known, done)
        done = materialize(done.unionByName(first)) if done is not None else first
        open_ = materialize(open_.join(first, ["core", "kind"], "left_anti"))
        longer += 1
    return done


def surrogates(entities: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(entity, kind) to (entity, kind, surrogate).

    Entities with the same core get the same surrogate, each written its own way; different cores get different ones, and none is a core
    of the table. Names, mail addresses and secrets without a free surrogate after the draws get longer ones of their type, numbered within
    their kind, and so do the others where their format has no free value left.
    """
    parts = materialize(entities.select("entity", "kind").distinct().select(
        "entity", "kind", F.posexplode(cores_of(F.col("kind"), F.col("entity"))).alias("part", "c"),
    ).select("entity", "kind", "part", F.col("c.kind").alias("core_kind"), F.col("c.core").alias("core")))
    given = _core_surrogates(parts.select("core", F.col("core_kind").alias("kind")), key).withColumnRenamed("kind", "core_kind")
    whole = parts.join(given, ["core", "core_kind"]).groupBy("entity", "kind").agg(F.array_sort(F.collect_list(F.struct("part", "surrogate"))).alias("found"))
    return materialize(whole.select("entity", "kind", written_as(F.col("kind"), F.col("entity"), F.col("found.surrogate")).alias("surrogate")))


def replace_entities(docs: DataFrame, key: str = DEFAULT_KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text with surrogates, n_entities, kinds (sorted, comma-joined).

    Null texts stay null with no entities; texts without entities come back unchanged. Entities of a type with equal cores get equal
    surrogates in all documents, written as each of them is: names with or without title or given name, phones and cards in any grouping,
    addresses of mail in any case. Repeated rows give repeated rows; an empty table gives an empty
    result; extra columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # Texts are searched once: what is found is written beside them, for the texts with and without entities alike.
    rows = materialize(rows.withColumn("found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("row", F.monotonically_increasing_id()))
    touched = rows.where(F.size("found") > 0)
    plain = rows.where(F.size("found") == 0).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    # What fails its check digits has no type and stays as it is.
    at = materialize(touched.select("row", F.posexplode("found").alias("at", "entity")).withColumn("kind", type_of(F.col("entity"))))
    names = surrogates(at.where("kind is not null"), key)
    named = at.join(names, ["entity", "kind"]).unionByName(at.where("kind is null").withColumn("surrogate", F.col("entity")))
    given = named.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("at", "surrogate", "kind"))).alias("given"),
    )
    # The pieces between the entities, in turn with the surrogates.
    gaps = F.split("text", ANY, -1)
    text = F.array_join(F.flatten(F.zip_with(
        gaps, F.transform("given", lambda g: g["surrogate"]), lambda gap, s: F.array(gap, F.coalesce(s, F.lit("")))),
    ), "")
    changed = touched.join(given, "row").select(
        "doc_id", text.alias("text"), F.size(F.array_compact(F.transform("given", lambda g: g["kind"]))).cast("long").alias("n_entities"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.transform("given", lambda g: g["kind"])))), ",").alias("kinds"),
    )
    return plain.unionByName(changed)
