"""PII surrogates: each detected entity becomes another of its kind, the same one everywhere.

Built-in functions only. Lines without any sign of personal data, nearly all, are passed by
after one cheap scan; in the others one expression finds the mentions. Each mention names
its entity (kind, canonical form), of which a keyed hash draws the surrogate in the
mention's own format: digits for digits, letters for letters in their case, separators as
they stand. Formatting variants of one entity share its canonical form and so its surrogate.

A person is found behind a title. From then on the words of the name are that document's
names: they are replaced wherever they stand in it with a capital, with a title or without.
A given name's sex is that of any titled mention in the document, else of the corpus where
that is one only, so that every mention of a person gets the same names.

Distinctness is checked over the whole corpus before any text is rewritten: the table of
distinct entities draws its surrogates, and entities whose surrogate another one has
already, or is itself an entity of the corpus, draw again until none is left; formats with
too little room for that get longer surrogates from LONGER_FROM on. Only those that had to
draw again, or whose sex the corpus told, are joined to the documents that mention them;
for all others the expression alone gives the surrogate.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.storage import Scratch, spare_name

# --- Fixed values: patterns of what counts as personal, and stocks of replacement names ---
EMAIL = r"[\w+-][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
CLOUD_KEY = r"(?:AKIA|ASIA)[A-Z0-9]{16}"
SECRET_NAMES = "password|passwd|secret|token|api_key|apikey"
SECRET = r"(?=[_-]*[A-Za-z0-9])[A-Za-z0-9_-]{8,}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IPV6 = r"(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})"
PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{1,4}[ /-]\d{5,8}|0\d(?:[ .-]\d{2}){4})"
CARD_CUES = "card|visa|mastercard|amex|karte|kreditkarte|carte|tarjeta"
CARD = rf"(?:(?i:{CARD_CUES})(?: (?i:number|no\.?|nr\.?))?[ :#]{{1,3}})?(?:\d{{13,19}}|\d{{4}}(?:[ -]\d{{4}}){{3}})"
SSN = r"\d{3}-\d{2}-\d{4}"
ADDRESS_TYPES = "Street|Avenue|Road|Lane|Boulevard|Drive|Court|Square"
ADDRESS_ENDS = "straße|strasse|weg|platz|allee|gasse"
ADDRESS = rf"(?:\d{{1,5}} (?:\p{{Lu}}\p{{L}}+ ){{1,3}}(?:{ADDRESS_TYPES})|\p{{Lu}}\p{{L}}*(?:{ADDRESS_ENDS}) \d{{1,4}}[a-z]?)"
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|Don|Г-н|Господин|Κύριος"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Señorita|Г-жа|Госпожа|Κυρία"
OTHER_TITLES = "Dr|Prof"
GIVEN = {
    ("latin", "m"): "Adam Albert Anton Bruno Carl Daniel David Emil Felix Frank Georg Henry Hugo Ivan Jakob Jonas Karl Leo Luis Marco Martin Max Oscar Otto Paul Peter Robert Simon Thomas Victor",
    ("latin", "f"): "Alice Anna Berta Carla Clara Diana Elena Emma Eva Flora Greta Hanna Ida Irene Jana Julia Laura Lena Lisa Maria Marta Nina Nora Olga Paula Rosa Sara Sofia Teresa Vera",
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Сергей Фёдор",
    ("cyrillic", "f"): "Алина Анна Вера Галина Дарья Елена Жанна Инна Ксения Лариса Мария Нина Ольга Раиса Софья Юлия",
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Κώστας Λεωνίδας Μιχάλης Νίκος Πέτρος Σπύρος Φίλιππος",
    ("greek", "f"): "Αγγελική Άννα Βασιλική Ελένη Ειρήνη Ζωή Κατερίνα Μαρία Σοφία Χριστίνα",
}
SYLLABLES = {
    "latin": "bar ben bor dal den dor fal fen gar gol hal hen kar kel lam len lor mar mel mor nar nel nor pal per ran rel sal ser tal ter var",
    "cyrillic": "бар вен гор дал ден кар кел лам лен мар мел мор нар пал рел тер",
    "greek": "βαρ γορ δαλ καρ κελ λαμ λεν μαρ μελ μορ ναρ παλ ρελ σαλ ταλ τερ",
}
#: From this attempt on, kinds whose format may leave too few surrogates get longer ones.
LONGER_FROM = 10
# --- End of fixed values ---


def _in_capitals_too(titles: str) -> str:
    return f"{titles}|{titles.upper()}"


MALE, FEMALE = _in_capitals_too(MALE_TITLES), _in_capitals_too(FEMALE_TITLES)
TITLE = rf"(?:{MALE}|{FEMALE}|{_in_capitals_too(OTHER_TITLES)})\.? "
PERSON = rf"{TITLE}(?:\p{{Lu}}\. ?){{0,2}}\p{{Lu}}[\p{{L}}\p{{M}}'’-]+(?: \p{{Lu}}[\p{{L}}\p{{M}}'’-]+){{0,2}}"
#: (kind, what must not stand before, pattern, what must not stand after); a mention's kind is the first whose pattern it matches.
KINDS = [
    ("email", r"(?<![\w.+-])", EMAIL, ""),
    ("cloud_key", r"(?<![A-Za-z0-9])", CLOUD_KEY, r"(?![A-Za-z0-9])"),
    ("secret", rf"(?<=(?i:{SECRET_NAMES})[ ]{{0,2}}[=:][ ]{{0,2}}[\"']?)", SECRET, ""),
    ("iban", r"(?<![A-Za-z0-9])", IBAN, r"(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])", IPV4, r"(?!\.?\w)"),
    ("ip6", r"(?<![\w:.])", IPV6, r"(?![\w:.])"),
    ("ssn", r"(?<![\w-])", SSN, r"(?![\w-])"),
    ("phone", r"(?<![\w+.-])", PHONE, r"(?![\w-])"),
    ("card", r"(?<![\w-])", CARD, r"(?![\w-])"),
    ("address", r"(?<![\p{L}\d])", ADDRESS, r"(?![\p{L}\d])"),
    ("person", r"(?<![\p{L}\d])", PERSON, ""),
]
MENTION = "|".join(before + pattern + after for _, before, pattern, after in KINDS)
#: Every kind of mention implies one of these signs, so the long expression is not tried on lines without any.
HINT = (
    rf"(?=[@0-9:=A{''.join(sorted({t[0] for t in TITLE[3:].split('|')}))}])(?:@|\d(?:\d|\.\d| \p{{Lu}})|\d(?<=(?:{ADDRESS_ENDS}) \d)|:(?<=[0-9A-Fa-f]:)[0-9A-Fa-f:]"
    rf"|A(?:KIA|SIA)|[=:](?<=(?i:{SECRET_NAMES}) {{0,2}}[=:])|{TITLE}\p{{Lu}})"
)
_COUNTRY = r"^\+\d{1,3}(?=[ (.-])"
#: A text cut into words and what is between them.
_WORDS = r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"
#: Texts whose entities were drawn again are joined by a broadcast up to so many.
FEW_TEXTS = 50_000


@cache
def _process_key() -> str:
    return secrets.token_hex(16)


def session_key(spark: SparkSession) -> str:
    """The key that the session names in spark.sievelake.pii.key; without one, a random key of this process, with which nobody can link its surrogates later."""
    return spark.conf.get("spark.sievelake.pii.key", None) or _process_key()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _card_digits(mention: Column) -> Column:
    return F.regexp_replace(mention, r"\D", "")


def kind_of(mention: Column) -> Column:
    """The kind, or 'none' of numbers that neither a cue nor their check digit makes a card's."""
    out = F.when(F.lit(False), "")
    for kind, _, pattern, _ in KINDS:
        if kind == "card":
            real = mention.rlike(r"^\D") | (mention.rlike(r"^(?:[3-6]|2[2-7])") & (_luhn_sum(_card_digits(mention)) % 10 == 0))
            out = out.when(mention.rlike(f"^(?:{pattern})$"), F.when(real, kind).otherwise("none"))
        elif kind != "secret":
            out = out.when(mention.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("secret")


def _canonical(mention: Column, kind: Column) -> Column:
    digits = F.regexp_replace(F.regexp_replace(mention, _COUNTRY, ""), r"\D", "")
    return (
        F.when(kind.isin("email", "ip6", "address"), F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(_is_name(kind), F.lower(mention))
        .otherwise(mention)
    )


def _sex(mention: Column) -> Column:
    title = F.regexp_extract(mention, r"^([^ .]+)", 1)
    return F.when(title.rlike(f"^(?:{MALE})$"), "m").when(title.rlike(f"^(?:{FEMALE})$"), "f").otherwise("u")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _names(mentions: Column) -> Column:
    """map<name in small letters, kind> of the words of a document's persons; one-letter words are no names."""

    def words(name: Column) -> Column:
        return F.filter(F.regexp_extract_all(F.lower(name), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), lambda w: F.length(w) > 1)

    def of_person(m: Column) -> Column:
        name = F.regexp_replace(m["written"], rf"^{TITLE}", "")
        alone = ~name.contains(" ")
        given = F.when(alone, F.array().cast("array<string>")).otherwise(words(F.regexp_replace(name, r" [^ ]+$", "")))
        return F.struct(_sex(m["written"]).alias("sex"), given.alias("given"), words(F.regexp_extract(name, r"[^ ]+$", 0)).alias("family"))

    def united(persons: Column) -> Column:
        given = F.array_distinct(F.flatten(persons["given"]))
        family = F.array_except(F.flatten(persons["family"]), given)

        def kind(g: Column) -> Column:
            sexes = F.array_distinct(F.filter(persons, lambda p: F.array_contains(p["given"], g) & (p["sex"] != "u"))["sex"])
            return F.concat(F.lit("given_"), F.when(F.size(sexes) == 1, sexes[0]).otherwise("u"))

        return F.map_from_arrays(F.concat(given, family), F.concat(F.transform(given, kind), F.transform(family, lambda _: F.lit("family"))))

    return _let(F.transform(mentions, of_person), united)


def _piece(written: Column, kind: Column | str | None) -> Column:
    kind = F.lit(kind).cast("string") if kind is None or isinstance(kind, str) else kind
    return F.struct(written.alias("written"), kind.alias("kind"))


def pieces_of(text: Column) -> Column:
    """array<struct<written, kind>> of a text with a hint, else null: mentions and names with their kind, what is between them with none."""

    def mentions(line: Column) -> Column:
        return F.transform(F.regexp_extract_all(line, F.lit(MENTION), F.lit(0)), lambda m: _piece(m, kind_of(m)))

    def of_line(line: Column) -> Column:
        def around(gap: Column, m: Column) -> Column:
            return F.array(_piece(gap, "none"), F.coalesce(m, _piece(F.lit(""), "none")))

        whole = F.array(_piece(line, "none"))
        return F.when(line.rlike(HINT), F.flatten(F.zip_with(F.split(line, MENTION, -1), mentions(line), around))).otherwise(whole)

    def of_names(parts: Column, names: Column) -> Column:
        def word(w: Column) -> Column:
            return _piece(w, F.when(w.rlike(r"^\p{Lu}"), F.try_element_at(names, F.lower(w))))

        def cut(part: Column) -> Column:
            person, none = part["kind"] == "person", part["kind"] == "none"
            title = F.when(person, F.regexp_extract(part["written"], rf"^{TITLE}", 0)).otherwise("")
            name = F.substring(part["written"], F.length(title) + 1, F.length(part["written"]))
            words = F.concat(F.array(_piece(title, None)), F.transform(F.regexp_extract_all(name, F.lit(_WORDS), F.lit(0)), word))
            alone = F.array(_piece(part["written"], F.when(~none, part["kind"])))
            return F.when((person | none) & (F.size(names) > 0), words).otherwise(alone)

        return F.filter(F.flatten(F.transform(parts, cut)), lambda p: p["written"] != "")

    # A line keeps the newline before it, so that the pieces make up the whole text.
    lines = F.transform(F.split(text, "\n", -1), lambda line, i: F.concat(F.when(i > 0, "\n").otherwise(""), line))

    def read(parts: Column) -> Column:
        return _let(_names(F.filter(parts, lambda p: p["kind"] == "person")), lambda names: of_names(parts, names))

    return F.when(text.rlike(HINT), _let(F.flatten(F.transform(lines, of_line)), read))


def entities_of(pieces: Column) -> Column:
    """array<struct<kind, canonical>> of the distinct entities among pieces."""
    found = F.filter(pieces, lambda p: p["kind"].isNotNull())
    return F.array_distinct(F.transform(found, lambda p: F.struct(p["kind"].alias("kind"), _canonical(p["written"], p["kind"]).alias("canonical"))))


def mentions_in(pieces: Column) -> Column:
    """How many mentions there are; names that follow each other are one."""

    def counts(p: Column, i: Column) -> Column:
        joined = (i > 1) & F.get(pieces, i - 1)["written"].isin(" ", "-", "'", "’") & _is_name(F.get(pieces, i - 2)["kind"])
        return p["kind"].isNotNull() & ~F.coalesce(_is_name(p["kind"]) & joined, F.lit(False))

    return F.size(F.filter(pieces, counts))


def _is_name(kind: Column) -> Column:
    return kind.startswith("given_") | (kind == "family")


def _draw(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that the key, the entity and the attempt decide."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string")), 512)


def _byte(draw: Column, i: Column | int) -> Column:
    at = (F.lit(i) if isinstance(i, int) else i) % 64
    return F.conv(F.substring(draw, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(stock: Column, number: Column) -> Column:
    return F.element_at(stock, (number % F.size(stock) + 1).cast("int"))


def _reshaped(text: Column, draw: Column, hexadecimal: Column) -> Column:
    """Digits for digits and letters for letters, drawn by their number from the right; other characters stay."""

    def step(acc: Column, c: Column) -> Column:
        span = F.when(hexadecimal, 6).otherwise(26)
        first = F.when(c.rlike("[a-z]"), 97).otherwise(65)
        drawn = _let(_byte(draw, acc["k"]), lambda byte: F.when(c.rlike("[0-9]"), (byte % 10).cast("string")).otherwise(F.char(first + byte % span)))
        new = F.when(c.rlike("[0-9A-Za-z]"), drawn).otherwise(c)
        moved = (c.rlike("[0-9A-Za-z]")).cast("int")
        return F.struct(F.concat(new, acc["out"]).alias("out"), (acc["k"] + moved).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    return F.aggregate(F.reverse(F.split(text, "")), start, step)["out"]


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, its last digit counted once."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * (F.lit(1) + acc["k"] % 2)
        return F.struct((acc["sum"] + F.when(d > 9, d - 9).otherwise(d)).alias("sum"), (acc["k"] + 1).alias("k"))

    return F.aggregate(F.reverse(F.split(digits, "")), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k")), step)["sum"]


def _checked(drawn: Column, old: Column, draw: Column) -> Column:
    """A drawn card number whose check digit is right exactly if the old number's was."""
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (F.lit(10) - _luhn_sum(F.concat(F.regexp_replace(body, r"\D", ""), F.lit("0"))) % 10) % 10
    valid = _luhn_sum(_card_digits(old)) % 10 == 0
    wrong = (check + 1 + _byte(draw, 60) % 9) % 10
    return F.concat(body, F.when(valid, check).otherwise(wrong).cast("string"))


def _in_case_of(new: Column, old: Column) -> Column:
    return F.when((F.length(old) > 1) & (old == F.upper(old)), F.upper(new)).when(old == F.lower(old), F.lower(new)).otherwise(F.initcap(new))


def _name(word: Column, kind: Column, draw: Column, attempt: Column) -> Column:
    """A given name from the stock of the script and sex, or a family name of three syllables of the script."""
    script = _script(word)
    stock, syllables = F.when(F.lit(False), F.array(F.lit(""))), F.when(F.lit(False), F.array(F.lit("")))
    for (of, sex), names in GIVEN.items():
        stock = stock.when((script == of) & (kind == f"given_{sex}"), F.split(F.lit(names), " "))
    for of, parts in SYLLABLES.items():
        both = f"{GIVEN[of, 'm']} {GIVEN[of, 'f']}"
        stock = stock.when((script == of) & (kind == "given_u"), F.split(F.lit(both), " "))
        syllables = syllables.when(script == of, F.split(F.lit(parts), " "))
    number = F.conv(F.substring(draw, 1, 6), 16, 10).cast("long")
    # Names get longer where draws are often taken, so that there are always enough of them.
    first, count = F.when(kind == "family", "").otherwise(_pick(stock, number)), F.when(kind == "family", 3).otherwise(0)
    count = count + F.when(attempt > 3, 3).otherwise(0) + F.when(attempt > 9, 3).otherwise(0)

    def sounded(syllables: Column) -> Column:
        picked = F.transform(F.filter(F.sequence(F.lit(1), F.lit(9)), lambda i: i <= count), lambda i: _pick(syllables, _byte(draw, i + 2)))
        return F.concat(first, F.array_join(picked, ""))

    return _in_case_of(_let(syllables, sounded), word)


def _address(written: Column, number: Column, name: Column) -> Column:
    """The number in its format, another street name, the same type of street."""
    number = F.regexp_replace(number, "^0", "9")
    before = F.concat(number, F.lit(" "), name, F.lit(" "), F.regexp_extract(written, r"[^ ]+$", 0))
    after = F.concat(name, F.regexp_extract(written, rf"({ADDRESS_ENDS}) ", 1), F.lit(" "), number, F.regexp_extract(written, r"[a-z]?$", 0))
    return F.when(written.rlike(r"^\d"), before).otherwise(after)


def surrogate_of_entity(key: str, kind: Column, written: Column, canonical: Column, attempt: Column) -> Column:
    """The replacement of an entity in the format in which it is written."""

    def reshaped(e: Column) -> Column:
        """With what stays before, and the drawn form of what changes by sign."""
        kind, written = e["kind"], e["written"]
        stays = (
            F.when(kind == "cloud_key", F.substring(written, 1, 4))
            .when(kind == "iban", F.substring(written, 1, 2))
            .when(kind == "phone", F.regexp_extract(written, _COUNTRY, 0))
            .when(kind == "card", F.regexp_extract(written, r"^\D*\d", 0))  # a cue, and the brand's first digit
            .otherwise("")
        )
        changes = F.when(kind == "email", F.substring_index(written, "@", 1)).when(kind == "address", F.regexp_extract(written, r"\d+", 0)).otherwise(written)
        hexadecimal = (kind == "ip6") | ((kind == "secret") & written.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
        given = F.when(kind == "address", F.lit("Ab")).otherwise(written)
        name = F.when(_is_name(kind) | (kind == "address"), _name(given, F.when(kind == "address", "family").otherwise(kind), e["draw"], e["attempt"]))
        body = F.substring(changes, F.length(stays) + 1, F.length(changes))
        new = F.when(~_is_name(kind) & (kind != "ip"), _reshaped(body, e["draw"], hexadecimal))
        return F.struct(e["kind"].alias("kind"), written.alias("written"), e["attempt"].alias("attempt"), e["draw"].alias("draw"), stays.alias("stays"), new.alias("new"), name.alias("name"))

    def made(e: Column) -> Column:
        kind, written, draw = e["kind"], e["written"], e["draw"]
        domain = F.concat(*(F.char(F.lit(97) + _byte(draw, 40 + i) % 26) for i in range(8)), F.lit(".example"))
        ip = F.concat_ws(".", *((_byte(draw, i) % 254 + 1).cast("string") for i in range(4)))
        # Eight numbers more where draws are often taken, so that there are always enough of them.
        more = F.concat(*((_byte(draw, 48 + i) % 10).cast("string") for i in range(8)))
        more = F.when((e["attempt"] >= LONGER_FROM) & kind.isin("ip", "phone", "ssn", "secret"), F.concat(F.when(kind == "ip", ".").otherwise(""), more)).otherwise("")
        number = F.regexp_extract(F.concat(e["stays"], e["new"]), r"\d.*$", 0)
        return (
            F.when(_is_name(kind), e["name"])
            .when(kind == "email", F.concat(e["new"], F.lit("@"), domain))
            .when(kind == "ip", F.concat(ip, more))
            .when(kind == "card", F.concat(F.regexp_extract(written, r"^\D*", 0), _checked(number, written, draw)))
            .when(kind == "address", _address(written, e["new"], e["name"]))
            .otherwise(F.concat(e["stays"], e["new"], more))
        )

    draw = _draw(key, kind, canonical, attempt).alias("draw")
    drawn = F.struct(kind.alias("kind"), written.alias("written"), attempt.alias("attempt"), draw)
    return _let(drawn, lambda e: _let(reshaped(e), made))


def _class(kind: Column) -> Column:
    """Within what surrogates are kept apart: given names of any sex are one class."""
    return F.when(kind.startswith("given_"), "given").otherwise(kind)


def draw_again(mentioned: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canonical, attempt) of the entities whose first draw was taken; mentioned holds distinct (kind, canonical)."""

    def drawn(df: DataFrame) -> DataFrame:
        made = surrogate_of_entity(key, F.col("kind"), F.col("canonical"), F.col("canonical"), F.col("attempt"))
        # Emails and secrets are compared as canonical forms are; names without their case.
        return df.withColumn("made", F.when(F.col("kind") == "secret", made).otherwise(F.lower(made))).withColumn("class", _class(F.col("kind")))

    entities = scratch.save(drawn(mentioned.withColumn("attempt", F.lit(0))), "entities")
    canonical = F.when(F.col("kind") == "secret", F.col("canonical")).otherwise(F.lower("canonical"))
    originals = mentioned.select(_class(F.col("kind")).alias("class"), canonical.alias("made"))
    while True:
        order = Window.partitionBy("class", "made").orderBy("attempt", "canonical", "kind")
        crowded = entities.groupBy("class", "made").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        late = entities.join(crowded.select("class", "made"), ["class", "made"]).withColumn("rank", F.row_number().over(order)).where("rank > 1")
        real = entities.join(originals, ["class", "made"], "left_semi")
        losers = late.select("kind", "canonical").union(real.select("kind", "canonical")).distinct().withColumn("again", F.lit(1))
        losers = scratch.save(losers, "losers")
        if losers.isEmpty():
            scratch.drop("losers")
            return entities.where("attempt > 0").select("kind", "canonical", "attempt")
        raised = entities.join(losers, ["kind", "canonical"], "left")
        raised = raised.select("kind", "canonical", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
        entities = scratch.save(drawn(raised), "entities")


def _overrides(mentioned: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """(kind, canonical, told, attempt): entities that draw again, or whose sex (in told) other documents tell."""
    sexed = mentioned.where(F.col("kind").isin("given_m", "given_f")).groupBy("canonical").agg(F.min("kind").alias("told"), F.max("kind").alias("other"))
    sexed = sexed.where("told = other").select(F.lit("given_u").alias("kind"), "canonical", "told")
    known = mentioned.join(sexed, ["kind", "canonical"], "left").select("kind", "canonical", F.coalesce("told", "kind").alias("told"))
    known = scratch.save(known, "known")
    again = draw_again(known.select(F.col("told").alias("kind"), "canonical").distinct(), key, scratch)
    joined = known.join(again.withColumnRenamed("kind", "told"), ["told", "canonical"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    return scratch.save(joined.where("told <> kind or attempt > 0").select("kind", "canonical", "told", "attempt"), "overrides")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs (doc_id, text, any others) with personal data replaced, and n_pii, the mentions of each text, beside it.

    Found are e-mail addresses, IP addresses, phone numbers, social-security numbers, IBANs,
    cloud keys, values assigned to passwords, secrets and tokens, street addresses, card
    numbers (behind a cue or with a card's first digits and check digit), and persons
    introduced by a title, with all further mentions of their names in the same text (words
    with a capital right behind a name are taken as part of it). Equal entities get equal surrogates in all documents
    and spellings, different entities of one kind different ones, none of which is itself
    an entity of that kind in docs. A person's sex follows from the titles, the script from
    the name. The key decides all draws; whoever has it can link surrogates, so it has no
    default. A null text stays null with n_pii 0; an empty text or table stays empty. Texts
    of any length are read whole, line by line. Equal texts, so repeated rows, stay equal.
    A column n_pii in docs is replaced; any other column keeps its name and values.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rest = docs.drop("n_pii")
    name = spare_name(rest.columns, "__text")
    held = docs.where(F.col("text").rlike(HINT)).select(F.sha2("text", 256).alias(name), pieces_of(F.col("text")).alias("pieces"))
    held = scratch.save(held.select(name, entities_of(F.col("pieces")).alias("entities")).where(F.size("entities") > 0), "held")
    each = held.select(name, F.explode("entities").alias("e")).select(name, "e.*")
    overrides = _overrides(each.select("kind", "canonical").distinct(), key, scratch)

    if overrides.isEmpty():
        source, told = rest, None
    else:
        entry = F.struct(F.concat_ws("\x1f", "kind", "canonical").alias("k"), F.struct("told", "attempt").alias("v"))
        told = spare_name(rest.columns, "__told")
        few = each.distinct().join(overrides, ["kind", "canonical"]).groupBy(name).agg(F.map_from_entries(F.collect_set(entry)).alias(told))
        few = scratch.save(few, "few")
        named = rest.withColumn(name, F.when(F.col("text").rlike(HINT), F.sha2("text", 256)))
        if few.count() <= FEW_TEXTS:
            source = named.join(F.broadcast(few), name, "left").drop(name)
        else:  # texts without a hint are not shuffled
            joined = named.where(F.col(name).isNotNull()).join(few.hint("merge"), name, "left").drop(name)
            source = joined.unionByName(rest.where(F.coalesce(~F.col("text").rlike(HINT), F.lit(True))), allowMissingColumns=True)
    scratch.drop("held", "entities", "known", "overrides")

    def replaced(piece: Column) -> Column:
        canonical = _canonical(piece["written"], piece["kind"])
        plain = F.struct(piece["kind"].alias("told"), F.lit(0).alias("attempt"))
        other = plain if told is None else F.coalesce(F.try_element_at(F.col(told), F.concat_ws("\x1f", piece["kind"], canonical)), plain)
        drawn = F.struct(piece["written"].alias("written"), canonical.alias("canonical"), other.alias("other"))
        made = _let(drawn, lambda e: surrogate_of_entity(key, e["other"]["told"], e["written"], e["canonical"], e["other"]["attempt"]))
        return F.when(piece["kind"].isNull(), piece["written"]).otherwise(made)

    pieces = spare_name(source.columns, "__pieces")
    read = source.withColumn(pieces, pieces_of(F.col("text")))
    text = F.when(F.col(pieces).isNotNull(), F.array_join(F.transform(F.col(pieces), replaced), "")).otherwise(F.col("text"))
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in rest.columns]
    return read.select(*columns, F.when(F.col(pieces).isNotNull(), mentions_in(F.col(pieces))).otherwise(F.lit(0)).cast("long").alias("n_pii"))
