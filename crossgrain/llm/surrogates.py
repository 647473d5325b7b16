"""Surrogates for personal data, with DataFrame functions alone.

Detected entities are replaced by keyed surrogates of their own type and format:

- e-mail addresses keep their separators, letter case, digits' places and top
  level domain; addresses of one domain stay addresses of one domain;
- telephone numbers keep sign, country code, brackets and spacing: international
  ones (a plus sign and 8 to 15 digits in any groups), 3-3-4 digits, and five pairs
  that begin with 0; other national forms and bare digits are not told from numbers;
- card numbers (16 digits in fours, 15 as 4-6-5) keep their issuer digit, grouping
  and a valid check digit;
- IBANs with a valid check keep country, letters' and digits' places and grouping,
  and a valid check;
- IPv4 and IPv6 addresses stay addresses, their parts of the same length;
- US social security numbers keep their grouping;
- names after forms of address (Mr, Frau Dr., Señora, г-н, MRS, ...) get names of the
  same gender and script, word for word, with the same hyphens, apostrophes and
  capitals (a word all in capitals stays so, inner ones go); so does a name of
  two or more words that the same text repeats without the form of address. A name has up
  to three words (``McDonald``, ``O'Brien``, ``Anna-Lena``, the third not all in capitals) with
  initials and particles (``von``, ``de la``) before them; particles stay, initials are turned
  within their alphabet. Capitals that follow a name without a sign between are taken for part of it.
  A word's gender is that of
  the forms of address it follows as a first name anywhere in the corpus; none,
  where they disagree or there are none. Other untitled names stay.

An entity is its normal form (an address in lower case, a number's digits, a name's
word in lower case, accents composed), so all its mentions in all documents get the same surrogate,
whatever their format. Distinct entities get distinct surrogates: all candidates
are compared, and an entity whose candidate is taken, by an earlier entity or as a
real entity of the corpus, draws again; each round is a join over the entities that
are left. From round ``WIDER`` on, draws of formats with few members are longer
(octets and groups of any length, more letters, telephones of more digits). Cards and security numbers
cannot grow: it is an error if after ``most_rounds`` any of them is without a surrogate, which takes
nearly all of their 10^8 and more numbers as real entities.
Surrogates come from SHA-256 over the key, the type, the entity and the round. The
key is the caller's secret: who has it can tell which entity a surrogate stands for.

The patterns run over a text to see if it has an entity, and only texts that have
one are taken apart and written aside. Mentions are keyed by the text's hash, so copies are worked on once; a text is
joined to its replacements and put together again by position. Texts or entities
that a large part of the rows share are dealt to many tasks (``spread_join``).

Defined cases: a null text stays null; an empty text and one without entities
stay as they are; equal rows get equal texts; all columns of ``docs`` are kept,
in order, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import secrets
import unicodedata
from collections.abc import Callable
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crossgrain.llm.common import as_row, named, read_table, spread, spread_join, written

#: Patterns by type. A mention is given the first type whose pattern it is whole.
_LETTER = r"\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}"
EMAIL = rf"(?<![{_LETTER}0-9._%+\-])[{_LETTER}0-9._%+\-]++@[{_LETTER}0-9][{_LETTER}0-9.\-]*\.[{_LETTER}]{{2,24}}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IPV6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{4}:|(?:[0-9A-Fa-f]{1,4}:){2,6})(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])"
CARD = r"(?<!\d)(?<!\d\.)(?:(?:\d{4}[ \-]?){3}\d{4}|3[47]\d{2}[ \-]?\d{6}[ \-]?\d{5})(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
IPV4 = r"(?<!\d)(?<!\d\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
PHONE = r"(?<![\w+])(?<!\d\.)(?:\+\d{1,3}(?:[ .\-/]?\(?\d{1,5}\)?){2,6}|(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}|0\d(?:[ .\-]\d{2}){4})(?!\d)"

#: Country codes of telephones by their first digits, fixed values: one or two digits, and three else.
COUNTRY_CODE = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"

#: Forms of address by gender, fixed values; those of no gender have names of either. All of them in capitals too.
ADDRESS = {
    "m": ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Signora", "г-жа", "госпожа"),
    "n": ("Dr", "Dra", "Prof", "Professor", "Doctor", "Professeur", "Docteur", "Profesor"),
}
#: What may follow another form of address, fixed values.
DEGREES = ("med", "phil", "rer", "nat", "jur", "iur", "h.c", "Dipl.-Ing", "Ing")
#: Words of a name that are no one's own, fixed values.
PARTICLES = ("de", "del", "della", "der", "den", "des", "di", "da", "do", "dos", "du", "la", "las", "los", "le", "van", "von", "vom", "zu", "zur", "ten", "ter", "bin", "ibn", "al", "el", "y")
_SAID = {t for ts in ADDRESS.values() for t in ts}
_SAID |= {t.upper() for t in _SAID} | {t.capitalize() for t in _SAID}


def _any_of(words: tuple[str, ...] | set[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in sorted(words, key=lambda w: (-len(w), w)))


#: The accented letters of both scripts, decomposed to composed.
COMPOSED = {unicodedata.normalize("NFD", chr(c)): chr(c) for c in (*range(0xC0, 0x17F), *range(0x400, 0x460)) if len(unicodedata.normalize("NFD", chr(c))) == 2}
#: The alphabets within which initials are turned.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "áàâäãåçéèêëíìîïñóòôöõúùûüý", "абвгдежзиклмнопрстуфхцчшщэюя")

_TITLES = _any_of(_SAID)
_INITIALS = "".join(sorted({t[0] for t in _SAID}))
_CHAIN = rf"(?:{_TITLES})\.?(?:,? (?:l[ae] )?(?:(?:{_TITLES})\.?|(?:{_any_of(DEGREES)})\.)){{0,5}} "
_END = r"(?![\p{L}\p{M}\p{N}])"
_WORD = rf"(?!(?:{_TITLES}){_END})(?:[DLOdl]['’])?\p{{Lu}}[\p{{L}}\p{{M}}]++(?:['’]\p{{Lu}}[\p{{L}}\p{{M}}]++|-\p{{L}}[\p{{L}}\p{{M}}]++){{0,3}}"
_LEAD = rf"(?:\p{{Lu}}\p{{M}}?\.[ \-]?|\p{{Lu}} (?=\p{{Lu}})|(?:{_any_of(PARTICLES)}) ){{0,4}}"
_THIRD = r"(?=\p{Lu}\p{M}?[\p{Ll}'’.])"
_BODY = rf"{_LEAD}{_WORD}(?: {_LEAD}{_WORD})?(?: {_LEAD}{_THIRD}{_WORD})?"
NAME = rf"(?=[{_INITIALS}])(?<![\p{{L}}\p{{M}}\p{{N}}]){_CHAIN}{_BODY}{_END}"
PATTERNS = {"email": EMAIL, "iban": IBAN, "ip6": IPV6, "card": CARD, "ssn": SSN, "ip": IPV4, "phone": PHONE, "name": NAME}
_NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("card", "ssn", "ip", "phone"))
#: All of them; what can only begin with a digit, a sign or a bracket is tried only there.
ANY = rf"(?:{EMAIL})|(?:(?=[A-Z]{{2}}\d){IBAN})|(?:(?=[0-9A-Fa-f]{{1,4}}:){IPV6})|(?=[\d+(])(?:{_NUMBERS})|(?:{NAME})"
#: A cheap sign that a text may hold any of them.
HINT = rf"@|\d[ .\-/]?\(?\d|[0-9A-Fa-f]:|(?=[{_INITIALS}])(?:{_TITLES})(?:\.|,)?+,? "

#: The round from which draws of formats with few members are longer.
WIDER = 8

#: Syllables of surrogate names by script, and endings by script and gender; fixed values.
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fa", "ga", "ka", "la", "le", "li", "lo", "ma", "me", "mi", "na", "ne", "ni", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "ti", "va", "ve", "vi", "za", "zo", "zu"),
    "cyrillic": ("ба", "бе", "да", "до", "фа", "га", "ка", "ла", "ле", "ли", "ло", "ма", "ме", "ми", "на", "не", "ни", "ра", "ре", "ри", "ро", "са", "се", "та", "те", "ти", "ва", "ве", "ви", "за", "зо", "зу"),
}
ENDINGS = {
    "latin": {"m": ("n", "s", "r", "rd"), "f": ("na", "lla", "ra", "ia"), "n": ("n", "na", "s", "ra")},
    "cyrillic": {"m": ("н", "с", "р", "в"), "f": ("на", "лла", "ра", "ва"), "n": ("н", "на", "с", "ра")},
}


def composed(text: Column) -> Column:
    """Letters and their combining accents as one character, where there is one."""
    known = F.create_map(*map(F.lit, chain.from_iterable(COMPOSED.items())))
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"\P{M}\p{M}*|\p{M}"), F.lit(0)), lambda c: F.when(F.length(c) > 1, F.coalesce(F.try_element_at(known, c), c)).otherwise(c))
    return F.when(text.rlike(r"\p{M}"), F.array_join(parts, "")).otherwise(text)


def _chain(mention: Column) -> Column:
    """The forms of address before a name, with the space after them; empty if there are none."""
    return F.regexp_extract(mention, rf"^{_CHAIN}", 0)


def _body(mention: Column) -> Column:
    return F.substring(mention, F.length(_chain(mention)) + 1, F.length(mention))


def kind_of(mention: Column) -> Column:
    """The type of a whole mention; null for a number that its type's check or length rules out."""
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    out = F.when(mention.contains("@"), "email").when(mention.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{8,}$"), F.when(_remainder(F.replace(mention, F.lit(" "), F.lit(""))) == 1, "iban"))
    out = out.when(mention.rlike(r"^[0-9A-Fa-f]+:[0-9A-Fa-f:]+$"), "ip6")
    out = out.when(mention.rlike(rf"^(?:{CARD})$"), "card").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(mention.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip")
    out = out.when(mention.startswith("+"), F.when(digits.between(8, 15), "phone"))
    return out.when(mention.rlike(r"^[\d(]"), "phone").otherwise("name")


def gender_of(mention: Column) -> Column:
    """Of the forms of address; ``n`` where none has a gender."""
    said = F.split(F.lower(_chain(mention)), "[ .,]+")
    of = lambda g: F.arrays_overlap(said, F.array(*(F.lit(t.lower()) for t in ADDRESS[g])))
    return F.when(of("m"), "m").when(of("f"), "f").otherwise("n")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def words_of(kind: Column, mention: Column) -> Column:
    """(kind, word, given, entity) of what is replaced in a mention: a name's words, an address's mailbox and domain, or itself."""
    own = lambda k, word, given, entity: F.struct(k.alias("kind"), word.alias("word"), given.alias("given"), entity.alias("entity"))
    mention = composed(mention)
    low, no = F.lower(mention), F.lit(False)
    body = _body(mention)
    parts, between = F.regexp_extract_all(body, F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), F.regexp_extract_all(body, F.lit(r"[^\p{L}\p{M}]+"), F.lit(0))

    def one(w: Column, i: Column) -> Column:
        elided = F.coalesce(F.try_element_at(between, i + 1).rlike("^['’]"), F.lit(False)) & (F.length(w) == 1)
        kept = elided | w.isin(*PARTICLES)
        return own(F.when(kept, "particle").when(F.length(w) == 1, "initial").otherwise("name"), w, (i == 0) & body.contains(" "), F.lower(w))

    name = F.transform(parts, one)
    mail = F.array(own(F.lit("mailbox"), F.split_part(mention, F.lit("@"), F.lit(1)), no, low), own(F.lit("domain"), F.split_part(mention, F.lit("@"), F.lit(2)), no, F.split_part(low, F.lit("@"), F.lit(2))))
    return F.when(kind == "name", name).when(kind == "email", mail).otherwise(F.array(own(kind, mention, no, normal_form(kind, mention))))


def normal_form(kind: Column, mention: Column) -> Column:
    """A number's digits (a telephone's without country code or leading 0), an address as it is."""
    digits = F.regexp_replace(mention, r"\D", "")
    number = F.when(mention.startswith("+"), F.regexp_replace(digits, rf"^(?:{COUNTRY_CODE})", "")).otherwise(F.regexp_replace(digits, "^0", ""))
    out = F.when(kind == "phone", number).when(kind == "ip", mention).when(kind == "ip6", F.lower(mention))
    return out.when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).otherwise(digits)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, although ``use`` names it in a loop."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _draws(key: str, kind: Column, entity: Column, turn: Column) -> Column:
    """64 numbers from 0 to 65535: four SHA-256 digests of key, type, entity and round."""
    said = lambda part: F.sha2(F.concat_ws("\u001f", F.lit(key), kind, entity, turn.cast("string"), F.lit(part)), 256)
    digest = F.concat(said("a"), said("b"), said("c"), said("d"))
    return _once(digest, lambda d: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(d, i * 4 + 1, F.lit(4)), 16, 10).cast("int")))


def _at(draws: Column, i: Column) -> Column:
    return F.element_at(draws, (F.pmod(i, F.lit(64)) + 1).cast("int"))


def _digits(draws: Column, entity: Column, keep: int = 0) -> Column:
    """Digits for digits, from the ``keep``-th on; the first of the rest is zero only if it was."""

    def one(c: Column, i: Column) -> Column:
        own = _at(draws, i)
        return F.when((i < keep) | ((i == keep) & (c == "0")), c).when(i == keep, (own % 9 + 1).cast("string")).otherwise((own % 10).cast("string"))

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _luhn(number: Column) -> Column:
    """A number and its check digit."""
    digits = F.transform(F.split(number, ""), lambda c: c.cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when((F.size(digits) - i) % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d)
    return F.concat(number, ((10 - total % 10) % 10).cast("string"))


def _remainder(iban: Column) -> Column:
    """An IBAN modulo 97, its first four characters last and letters as 10 to 35."""
    chars = F.split(F.concat(F.substring(iban, 5, F.lit(40)), F.left(iban, F.lit(4))), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def _iban(draws: Column, entity: Column) -> Column:
    """Letters for letters and digits for digits after the check, which is made anew."""
    body = _alike(draws, F.substring(entity, 5, F.lit(40)))
    country = F.left(entity, F.lit(2))
    check = 98 - _remainder(F.concat(country, F.lit("00"), body))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _alike(draws: Column, text: Column) -> Column:
    """Letters for letters, digits for digits."""
    latin, accented, cyrillic = ALPHABETS
    letters = {latin: "[a-z]", latin.upper(): "[A-Z]", accented: r"\p{IsLatin}", cyrillic: r"\p{IsCyrillic}"}

    def one(c: Column, i: Column) -> Column:
        own = _at(draws, i) + i
        out = F.when(c.rlike("[0-9]"), (own % 10).cast("string"))
        for known, pattern in letters.items():
            out = out.when(c.rlike(pattern), F.substring(F.lit(known), (own % len(known) + 1).cast("int"), F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _longer(draws: Column, entity: Column, turn: Column) -> Column:
    """Digits for digits, and more of them behind from round ``WIDER`` on."""
    more = F.when(turn < WIDER, "").otherwise(F.repeat(F.lit("1"), F.least(turn - WIDER + 1, F.lit(8))))
    return _digits(draws, F.concat(entity, more))


def _hex(draws: Column, entity: Column, turn: Column) -> Column:
    """Hexadecimal digits for such, none of them 0; groups of four from round ``WIDER`` on."""
    known = F.lit("123456789abcdef")
    entity = F.when(turn < WIDER, entity).otherwise(F.regexp_replace(entity, "[0-9a-f]+", "ffff"))
    return F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c == ":", c).otherwise(F.substring(known, ((_at(draws, i) + i) % 15 + 1).cast("int"), F.lit(1)))), "")


def _octets(draws: Column, entity: Column, turn: Column) -> Column:
    """Octets of as many digits, from 1 to 223 in the first place and to 255 in the others; of any number from round ``WIDER`` on."""

    def one(o: Column, i: Column) -> Column:
        own, n = _at(draws, i), F.when(turn < WIDER, F.length(o)).otherwise(0)
        top = F.when(i == 0, F.lit(223)).otherwise(F.lit(255))
        return F.when(n == 0, own % top + 1).when(n == 1, own % 9 + 1).when(n == 2, own % 90 + 10).otherwise(own % (top - 99) + 100).cast("string")

    return F.array_join(F.transform(F.split(entity, r"\."), one), ".")


def _more(draws: Column, turn: Column) -> Column:
    """Letters that a word gains from round ``WIDER`` on."""
    more = F.sequence(F.lit(1), F.greatest(turn - WIDER + 1, F.lit(1)))
    return F.when(turn < WIDER, "").otherwise(F.array_join(F.transform(more, lambda i: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (_at(draws, i + 30) % 26 + 1).cast("int"), F.lit(1))), ""))


def _mailbox(draws: Column, entity: Column, turn: Column) -> Column:
    """What stands before the sign, beside the entity's own domain, within which it is to be distinct."""
    return F.concat(_alike(draws, F.split_part(entity, F.lit("@"), F.lit(1))), _more(draws, turn), F.lit("@"), F.split_part(entity, F.lit("@"), F.lit(2)))


def _domain(draws: Column, entity: Column, turn: Column) -> Column:
    """The last label stays."""
    head, last = F.regexp_extract(entity, r"^(.*)(\.[^.]+)$", 1), F.regexp_extract(entity, r"^(.*)(\.[^.]+)$", 2)
    return F.concat(_alike(draws, head), _more(draws, turn), last)


def _name(draws: Column, gender: Column, script: Column, turn: Column) -> Column:
    """Two or more syllables of the script and an ending of the gender; later rounds have longer names."""
    out = None
    for s, syllables in SYLLABLES.items():
        known = F.array(*map(F.lit, syllables))
        body = F.transform(F.sequence(F.lit(0), F.lit(1) + F.least(turn, F.lit(20))), lambda i: F.element_at(known, (_at(draws, i) % len(syllables) + 1).cast("int")))  # noqa: B023
        for g, endings in ENDINGS[s].items():
            end = F.element_at(F.array(*map(F.lit, endings)), (_at(draws, F.lit(40)) % len(endings) + 1).cast("int"))
            name = F.concat(F.array_join(body, ""), end)
            hit = (script == s) & (gender == g)
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def candidate(key: str, kind: Column, entity: Column, gender: Column, script: Column, turn: Column) -> Column:
    """The surrogate's normal form that an entity draws in a round."""
    return _once(_draws(key, kind, entity, turn), lambda draws: _drawn(draws, kind, entity, gender, script, turn))


def _drawn(draws: Column, kind: Column, entity: Column, gender: Column, script: Column, turn: Column) -> Column:
    out = F.when(kind == "mailbox", _mailbox(draws, entity, turn)).when(kind == "domain", _domain(draws, entity, turn))
    out = out.when(kind == "card", _luhn(F.left(_digits(draws, entity, 1), F.length(entity) - 1))).when(kind == "iban", _iban(draws, entity))
    out = out.when(kind == "ip", _octets(draws, entity, turn)).when(kind == "ip6", _hex(draws, entity, turn)).when(kind == "name", _name(draws, gender, script, turn))
    out = out.when(kind == "phone", _longer(draws, entity, turn))
    return out.otherwise(_digits(draws, entity))


def surrogates(entities: DataFrame, *, key: str, most_rounds: int = 40) -> DataFrame:
    """(kind, gender, entity, surrogate) for distinct ``entities(kind, gender, entity)``, one to one within a type.

    Every round draws for the entities without a surrogate. A draw stands if no
    standing surrogate and no entity of the type equals it; of equal draws the
    first entity's stands.
    """
    spark = entities.sparkSession
    script = script_of(F.col("entity"))
    left = written(entities.repartition(spread(spark), "kind", "entity"), "entities")
    real = left.select("kind", F.col("entity").alias("drawn")).distinct()
    given: DataFrame | None = None
    for turn in range(most_rounds):
        drawn = left.withColumn("drawn", candidate(key, F.col("kind"), F.col("entity"), F.col("gender"), script, F.lit(turn)))
        taken = real if given is None else real.union(given.select("kind", F.col("surrogate").alias("drawn")))
        free = drawn.join(taken, ["kind", "drawn"], "left_anti")
        first = free.groupBy("kind", "drawn").agg(F.min(F.struct("entity", "gender")).alias("own"))
        now = first.select("kind", "own.gender", "own.entity", F.col("drawn").alias("surrogate"))
        given = written(now if given is None else given.union(now), "surrogates")
        left = written(left.join(given, ["kind", "gender", "entity"], "left_anti"), "entities")
        if left.isEmpty():
            return given
    raise ValueError(f"no distinct surrogates left after {most_rounds} rounds for the types {sorted(r.kind for r in left.select('kind').distinct().collect())}")


def rendered(kind: Column, word: Column, entity: Column, surrogate: Column) -> Column:
    """A surrogate in the format of the word it stands for."""
    chars = F.split(word, "")
    n = F.length(F.regexp_replace(word, r"\D", ""))
    # numbers: the surrogate's digits into the word's places, counted from the right; what is beyond stays (country codes), what is left over comes last
    place = F.transform(chars, lambda c, i: F.length(F.regexp_replace(F.array_join(F.slice(chars, F.lit(1), i + 1), ""), r"\D", "")) - n + F.length(entity))
    digits = F.array_join(F.zip_with(chars, place, lambda c, p: F.when(c.rlike(r"\d") & (p > 0), F.substring(surrogate, p, F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.when(kind == "phone", F.substring(surrogate, F.length(entity) + 1, F.length(surrogate))).otherwise(""))
    # words: the word's capitals
    own = F.when(kind == "mailbox", F.split_part(surrogate, F.lit("@"), F.lit(1))).otherwise(surrogate)
    cased = F.array_join(F.zip_with(F.split(own, ""), chars, lambda s, c: F.when(c.rlike(r"\p{Lu}"), F.upper(s)).otherwise(F.coalesce(s, F.lit("")))), "")
    written_as = F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(surrogate)).when(word.rlike(r"^\p{Ll}"), surrogate).otherwise(F.initcap(surrogate))
    turned = F.when(F.upper(word) == word, F.upper(surrogate)).otherwise(surrogate)
    # an IBAN: its characters with the word's spaces
    at = F.transform(chars, lambda c, i: F.length(F.replace(F.array_join(F.slice(chars, F.lit(1), i + 1), ""), F.lit(" "), F.lit(""))))
    spaced = F.array_join(F.zip_with(chars, at, lambda c, p: F.when(c == " ", c).otherwise(F.substring(surrogate, p, F.lit(1)))), "")
    return F.when(kind == "ip", surrogate).when(kind.isin("mailbox", "domain", "ip6"), cased).when(kind == "name", written_as).when(kind == "initial", turned).when(kind == "particle", word).when(kind == "iban", spaced).otherwise(digits)


def initial(key: str, entity: Column) -> Column:
    """The letter as many places on in its alphabet as the key says, never itself; letters of no alphabet stay."""
    places = {a: int(hashlib.sha256(f"{key}\x1finitial\x1f{a}".encode()).hexdigest(), 16) % (len(a) - 1) + 1 for a in ALPHABETS}
    return F.translate(entity, "".join(ALPHABETS), "".join(a[n:] + a[:n] for a, n in places.items()))


def genders(words: DataFrame) -> DataFrame:
    """(entity, gender) of name words: the one gender of the forms of address that they follow as first names."""
    sure = F.when(F.col("given") & F.col("gender").isin("m", "f"), F.col("gender"))
    return words.where("kind = 'name'").groupBy("entity").agg(F.when(F.min(sure) == F.max(sure), F.min(sure)).otherwise("n").alias("gender"))


def holds_any(text: Column) -> Column:
    return F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))


def own_pattern(mentions: Column) -> Column:
    """``ANY``, and the names of two or more words that a text says after a form of address."""
    full = F.array_distinct(F.transform(F.filter(mentions, lambda m: (_chain(m) != "") & _body(m).contains(" ")), _body))
    # the longest first; dots of initials are no signs of the pattern
    full = F.transform(F.array_sort(F.transform(full, lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), lambda x: F.regexp_replace(x["m"], r"\.", r"\\."))
    return F.when(F.size(full) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{M}\p{N}])(?:"), F.array_join(full, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))).otherwise(ANY)


def pseudonymized(docs: DataFrame, *, key: str, text_col: str = "text", counts_col: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text_col`` replaced; ``counts_col`` adds the number of mentions."""
    rows = docs.select(as_row(docs), named(text_col).alias("text"))
    hit = rows.where(holds_any(F.col("text"))).withColumn("pattern", own_pattern(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    hit = hit.select("row", F.regexp_extract_all("text", "pattern", F.lit(0)).alias("mentions"), F.split("text", F.col("pattern")).alias("gaps"), F.sha2(F.encode("text", "utf-8"), 256).alias("digest"))
    hit = written(hit, "mentions")
    said = hit.groupBy("digest").agg(F.first("mentions").alias("mentions")).select("digest", F.posexplode("mentions").alias("at", "mention"))
    said = said.withColumn("kind", kind_of(F.col("mention"))).withColumn("gender", F.when(F.col("kind") == "name", gender_of(F.col("mention"))))
    words = said.where("kind is not null").select("digest", "at", "gender", "mention", F.posexplode(words_of(F.col("kind"), F.col("mention"))).alias("part", "w"))
    words = written(words.select("digest", "at", "part", "mention", "gender", "w.*"), "words")
    named_as = genders(words)
    entities = words.select("kind", "entity").distinct().join(named_as, "entity", "left").select("kind", F.when(F.col("kind") == "name", F.col("gender")).otherwise("").alias("gender"), "entity")
    own = F.col("kind").isin("initial", "particle")
    table = surrogates(entities.where(~own), key=key).select("kind", "entity", "surrogate")
    table = table.union(entities.where(own).select("kind", "entity", F.when(F.col("kind") == "initial", initial(key, F.col("entity"))).otherwise(F.col("entity"))))
    new = spread_join(words, table, ["kind", "entity"]).withColumn("new", rendered(F.col("kind"), F.col("word"), F.col("entity"), F.col("surrogate")))
    new = new.groupBy("digest", "at").agg(F.first("mention").alias("mention"), F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("part", "new"))).alias("parts"))
    between = F.regexp_extract_all(_body(F.col("mention")), F.lit(r"[^\p{L}\p{M}]+"), F.lit(0))
    name = F.concat(_chain(F.col("mention")), F.array_join(F.zip_with("parts.new", between, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), ""))
    whole = F.when(F.col("kind").isin("mailbox", "domain"), F.array_join("parts.new", "@")).when(F.col("kind").isin("name", "initial", "particle"), name).otherwise(F.array_join("parts.new", ""))
    new = new.select("digest", "at", whole.alias("new")).groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("new"))
    new = written(new, "replacements")
    done = spread_join(hit, hit.select("digest").distinct().join(new, "digest", "left"), ["digest"])
    said_at = F.transform("mentions", lambda m, i: F.coalesce(F.try_element_at("new", i), m))
    pieces = F.zip_with("gaps", said_at, lambda g, x: F.concat(g, F.coalesce(x, F.lit(""))))
    done = done.select("row", F.array_join(pieces, "").alias("text"), F.coalesce(F.size("new"), F.lit(0)).alias("n"))
    same = rows.where(~holds_any(F.col("text"))).select("row", "text", F.lit(0).alias("n"))
    cell = lambda c: F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
    return done.union(same).select(*map(cell, docs.columns), *([F.greatest("n", F.lit(0)).cast("long").alias(counts_col)] if counts_col else []))


def entities_left(text: Column) -> Column:
    """How many mentions a text holds."""
    return reduce(lambda a, b: a + b, [F.regexp_count(text, F.lit(p)) for p in PATTERNS.values()])


def secret_key(spark: SparkSession) -> str:
    """The session's ``spark.crossgrain.surrogate.key``; where it has none, one drawn for this run alone, whose surrogates nobody can trace."""
    return spark.conf.get("spark.crossgrain.surrogate.key", None) or secrets.token_hex(32)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymized(docs, key=secret_key(spark), counts_col="n_entities")
