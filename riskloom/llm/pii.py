"""PII surrogates: keyed, type-consistent replacements (DataFrame functions only).

Entities are e-mail addresses, phone numbers, IPv4 addresses, card and account
numbers (13 to 19 digits), social security numbers, IBANs, and persons named after one
or more titles: all capitalised words that follow, with particles ("de la") and initials
between them. Particles stay, initials are exchanged by a keyed shift of the alphabet.
Surface forms are reduced to parts with a canonical form (case, blanks and
separators go; a person's given names and surname, the last word, are parts of their own), so that all
mentions of an entity get one surrogate, rendered in the mention's own format:
separators, letter case, digits per digit, a valid Luhn digit where there was one, a
name of the same gender (from the title) and script.

A surrogate is drawn from a keyed SHA-256 of (kind, canonical form, attempt).
Distinctness is checked, not assumed: a draw that equals a real entity of the input,
or that an entity with precedence has drawn too, is repeated with the next attempt
until no collision is left. The table of entities is distinct before any join; a value
that fills a third of the documents is one row of it.

Defined results: NULL text stays NULL; texts without entities stay as they are;
repeated rows get equal results, one each; an empty table gives an empty result; other
columns of the documents are kept as they are.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fresh, load, row_key, saved

KEY = "surrogates-1"
ROUNDS = 40

# title (without full stop) -> gender
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Señor": "m", "Sr": "m", "Monsieur": "m", "Господин": "m", "Κύριος": "m",
    "Sir": "m", "Lord": "m", "Signor": "m", "Доктор": "n", "Профессор": "n", "Dr": "n", "Doctor": "n", "Prof": "n", "Professor": "n", "Mx": "n",
    "Lady": "f", "Dame": "f", "Signora": "f", "Doña": "f", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Sra": "f", "Madame": "f", "Mme": "f", "Госпожа": "f", "Κυρία": "f",
}
_TITLE = "|".join(sorted(TITLES, key=lambda t: (-len(t), t)))
_TITLES = rf"(?:(?:{_TITLE})\.? )++"
PARTICLES = "af al bin da de del della den der di do dos du el ibn la las le los ten ter van von vom zu zum zur".split()
_BETWEEN = rf"(?:{'|'.join(PARTICLES)}|\p{{Lu}}\.)"
_NAME = rf"(?!(?:{_TITLE})(?!\p{{L}}))\p{{Lu}}[\p{{L}}'’-]++"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
# possessive, so that a run of any number of names needs no stack
PERSON = rf"(?<!\p{{L}}){_TITLES}(?:{_BETWEEN} )*+{_NAME}(?:(?: {_BETWEEN})*+ {_NAME})*+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = (
    r"\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
)
CARD = r"(?<![\dA-Za-z])(?:\d[ -]?){12,18}\d(?![\dA-Za-z])"
ENTITY = "|".join((EMAIL, PERSON, IBAN, IP, SSN, PHONE, CARD))
# no entity without a digit or one of the titles
_MAY = f"[0-9@]|{_TITLE}"

# Syllables for names, per script; endings per gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa ga ha ka la le lo ma mi mo na ne no pa ra re ri ro sa se ta te to va ve wi".split(),
    "cyrillic": "ба бе бо ва ве га да де до за ка ла ле ли ма ми мо на не но па ра ре ри ро са се та те то фа ха".split(),
    "greek": "βα βε γα δα δε ζα θα κα κε λα λε λι μα με μι να νε νι πα πε ρα ρε ρι ρο σα σε τα τε το φα φε χα".split(),
}
ENDINGS = {
    ("latin", "m"): "n", ("latin", "f"): "na", ("latin", "s"): "r", ("cyrillic", "m"): "н", ("cyrillic", "f"): "на",
    ("latin", "n"): "l", ("cyrillic", "n"): "л", ("greek", "n"): "λ", ("cyrillic", "s"): "к", ("greek", "m"): "ς", ("greek", "f"): "να", ("greek", "s"): "ς",
}

ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
_ASCII = "abcdefghijklmnopqrstuvwxyz"


def _hex_int(digest: Column, at: Column, n: int = 4) -> Column:
    return F.conv(F.substr(digest, at, F.lit(n)), 16, 10).cast("int")


def _char_at(letters: str, index: Column) -> Column:
    return F.substr(F.lit(letters), index + 1, F.lit(1))


def kind_of(surface: Column) -> Column:
    return (
        F.when(surface.contains("@"), "email")
        .when(surface.rlike(f"^(?:{PERSON})$"), "person")
        .when(surface.rlike("^[A-Z]{2}"), "iban")
        .when(surface.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(surface.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]\d{4}$"), "phone")
        .otherwise("card")
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _tokens(person: Column) -> Column:
    """The words of a person's name without titles."""
    return F.split(F.regexp_replace(person, f"^{_TITLES}", ""), " ")


def _is_name(token: Column) -> Column:
    return ~token.rlike(f"^{_BETWEEN}$")


def initial_of(token: Column, key: str = KEY) -> Column:
    """An initial under a keyed shift of its alphabet: distinct letters stay distinct, none stays itself."""
    shifted = ""
    for letters in ALPHABETS:
        by = 1 + int(hashlib.sha256(f"{key}|initials".encode()).hexdigest(), 16) % (len(letters) - 1)
        shifted += letters[by:] + letters[:by]
    return F.translate(token, "".join(ALPHABETS), shifted)


def parts_of(surface: Column, kind: Column) -> Column:
    """Array of (kind, canon) of a surface form; of a person one for each word of the name."""
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    title = F.regexp_extract(surface, f"^({_TITLE})", 1)
    genders = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    tokens = _tokens(surface)
    last = F.element_at(tokens, -1)  # always a name
    surname = part(F.concat(F.lit("name_s_"), _script(last)), F.lower(last))
    gender = genders[title]

    def before(t):  # particles and initials have no kind
        return part(F.when(_is_name(t), F.concat(F.lit("name_"), gender, F.lit("_"), _script(t))), F.lower(t))

    person = F.concat(F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - 1), before), F.array(surname))
    return (
        F.when(kind == "person", person)
        .when(kind == "email", F.array(part(kind, F.lower(surface))))
        .when(kind == "ip", F.array(part(kind, surface)))
        .otherwise(F.array(part(kind, F.regexp_replace(surface, "[^0-9A-Z]", ""))))
    )


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits (0 modulo 10 if valid)."""
    rows = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i")))
    doubled = F.transform(
        F.filter(rows, lambda r: r["d"].isNotNull()),
        lambda r: F.when(r["i"] % 2 == 0, r["d"]).when(r["d"] > 4, r["d"] * 2 - 9).otherwise(r["d"] * 2),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def draw(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate's canonical form at this attempt."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt), 256)
    chars = F.filter(F.split(canon, ""), lambda c: c != "")

    def like(c, i):
        n = _hex_int(digest, F.pmod(i * 3, F.lit(60)) + 1) + i
        letter = _char_at(_ASCII, F.pmod(n, F.lit(26)))
        return (
            F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string"))
            .when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike(r"\p{L}"), letter).otherwise(c)
        )

    same_shape = F.array_join(F.transform(chars, like), "")
    n = F.length(canon)
    # cards: first digit stays, the last makes the number valid if it was
    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(same_shape, F.lit(2), n - 2))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(canon), F.lit(10)) == 0, F.concat(body, check)).otherwise(F.concat(body, F.substr(same_shape, n, F.lit(1))))
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.substr(same_shape, F.lit(3)))
    phone = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(same_shape, F.lit(2)))
    ip = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + F.pmod(_hex_int(digest, i * 4 + 1), F.lit(254))).cast("string")), ".")
    local = F.substring_index(same_shape, "@", 1)
    more = F.when(attempt > 2, F.substr(digest, F.lit(50), F.lit(8))).otherwise("")
    top = F.substring_index(canon, ".", -1)
    domain = F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: _char_at(_ASCII, F.pmod(_hex_int(digest, i * 4 + 20), F.lit(26)))), ""),
        F.lit(".example."), F.when(top.isin("com", "net", "org"), top).otherwise("com"),
    )
    email = F.concat(local, more, F.lit("@"), domain)
    name = F.lit(None).cast("string")
    count = F.least(F.lit(14), F.lit(3) + F.floor(attempt / 2).cast("int"))
    tables = {script: F.array(*[F.lit(s) for s in syllables]) for script, syllables in SYLLABLES.items()}
    word = lambda t: F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(t, F.pmod(_hex_int(digest, i * 4 + 1), F.lit(32))))
    for (script, gender), ending in ENDINGS.items():
        made = F.array_join(word(tables[script]), "")
        name = F.when(kind == f"name_{gender}_{script}", F.concat(made, F.lit(ending))).otherwise(name)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "iban", iban).when(kind == "phone", phone)
        .when(kind == "ssn", same_shape).when(kind == "card", card).otherwise(name)
    )


def surrogates(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """kind, canon, surrogate for distinct (kind, canon); surrogates are distinct and no real entity."""
    real = saved(entities.select("kind", "canon").distinct(), "pii-entities")
    settled, open_ = None, real
    for attempt in range(rounds):
        drawn = open_.withColumn("surrogate", draw(F.col("kind"), F.col("canon"), F.lit(attempt), key)).withColumn("late", F.lit(1))
        pool = drawn if settled is None else drawn.union(settled.withColumn("late", F.lit(0)))
        owner = pool.groupBy("kind", "surrogate").agg(F.min(F.struct("late", F.xxhash64("canon").alias("h"), "canon")).alias("o"))
        taken = real.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("is_real"))
        judged = drawn.join(owner, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        fine = (F.col("o.canon") == F.col("canon")) & (F.col("o.late") == 1) & F.col("is_real").isNull()
        judged = saved(judged.select("kind", "canon", "surrogate", fine.alias("fine")), "pii-draws")
        good = judged.filter("fine").select("kind", "canon", "surrogate")
        settled = good if settled is None else settled.union(good)
        open_ = judged.filter("NOT fine").select("kind", "canon")
        if open_.isEmpty():
            return settled
    raise RuntimeError(f"{rounds} rounds left entities without a distinct surrogate")


def render(surface: Column, kind: Column, made: Column, key: str = KEY) -> Column:
    """The surrogate (array of its parts) in the format of the surface form."""
    first = F.element_at(made, 1)
    places = F.transform(F.split(surface, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    refill = F.array_join(
        F.transform(
            places,
            lambda p: F.when(
                p["c"].rlike("[0-9A-Z]"),
                F.substr(first, F.length(F.regexp_replace(F.substr(surface, F.lit(1), p["i"]), "[^0-9A-Z]", "")) + 1, F.lit(1)),
            ).otherwise(p["c"]),
        ),
        "",
    )
    title = F.regexp_extract(surface, f"^({_TITLES})", 1)
    pairs = F.arrays_zip(_tokens(surface).alias("t"), F.transform(made, lambda m: F.initcap(m)).alias("m"))

    def renamed(p):
        cased = F.when((p["t"] == F.upper(p["t"])) & (F.length(p["t"]) > 1), F.upper(p["m"])).otherwise(p["m"])
        return F.when(p["m"].isNotNull(), cased).when(p["t"].endswith("."), initial_of(p["t"], key)).otherwise(p["t"])

    names = F.array_join(F.transform(pairs, renamed), " ")
    return (
        F.when(kind == "person", F.concat(title, names))
        .when(kind == "email", F.when(surface == F.upper(surface), F.upper(first)).otherwise(first))
        .when(kind == "ip", first)
        .otherwise(refill)
    )


def replace(docs: DataFrame, key: str = KEY, id_column: str = "doc_id", text_column: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity replaced; ``count`` names a column for their number."""
    found, ident, made = fresh(docs, "_pii_found", "_pii_row", "_pii_new")
    text = F.col(text_column)
    none = F.array().cast("array<string>")
    spotted = docs.withColumn(found, F.when(text.rlike(_MAY), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))))
    some = F.size(F.coalesce(found, none)) > 0
    dirty = saved(spotted.filter(some).withColumn(ident, row_key(id_column, text_column)), "pii-documents")
    clean = spotted.filter(~some).drop(found)
    surfaces = dirty.select(F.explode(found).alias("surface")).distinct().withColumn("kind", kind_of(F.col("surface")))
    parts = saved(surfaces.select("surface", "kind", F.posexplode(parts_of(F.col("surface"), F.col("kind"))).alias("i", "part")), "pii-parts")
    known = surrogates(parts.filter("part.kind IS NOT NULL").select("part.kind", "part.canon"), key)
    whole = (
        parts.select("surface", F.col("kind").alias("k"), "i", "part.kind", "part.canon").join(known, ["kind", "canon"], "left")
        .groupBy("surface", "k").agg(F.array_sort(F.collect_list(F.struct("i", "surrogate"))).alias("made"))
    )
    table = saved(whole.select("surface", render(F.col("surface"), F.col("k"), F.col("made.surrogate"), key).alias("new")), "pii-surrogates")
    places = dirty.select(ident, F.posexplode(found).alias("i", "surface")).join(table, "surface")
    news = places.groupBy(ident).agg(F.array_sort(F.collect_set(F.struct("i", "new"))).alias(made))
    both = dirty.join(news, ident)
    pieces = F.split(text, ENTITY, -1)
    rebuilt = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("p"), F.col(f"{made}.new").alias("n")), lambda z: F.concat(z["p"], z["n"])), ""), F.element_at(pieces, -1))
    out = both.withColumn(text_column, rebuilt)
    if count:
        out = out.withColumn(count, F.size(found).cast("long"))
        clean = clean.withColumn(count, F.lit(0).cast("long"))
    names = [*docs.columns, *([count] if count else [])]
    return out.select(*names).union(clean.select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    return replace(load(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")
