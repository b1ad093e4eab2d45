"""Personal data replaced by keyed surrogates, in DataFrame expressions alone.

Entities are found by one pattern, typed, and brought to a canonical form (lower-case mail, digits of a phone or card,
name without its title). Each distinct canonical entity gets one surrogate, drawn from SHA-256 of the key, its type and
itself, so that all its mentions stay one person's. Surrogates keep the type and the format: digits stay digits, letters
stay letters of their case and script, cards keep issuer and check digit, accounts get right check digits, phones keep
their country code and punctuation, names their title's gender. Sixteen digits without a card's check digit stay. A surrogate that another entity has too, or that is itself an entity of the corpus, is drawn again
until none is, so distinct entities stay distinct. A mention is then written in the format in which it stood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written

#: Titles before a name, by gender.
TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Sr Signor господин г-н",
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Señorita Sra Signora госпожа г-жа",
    "n": "Dr Prof Professor Doctor Docteur Doktor",
}
#: Given names, by gender and script.
GIVEN = {
    "m-latin": "Adam Alan Albert Carl David Edgar Felix Hugo Ivan Jonas Karl Leo Martin Oscar Paul Peter Robert Simon Thomas Victor",
    "f-latin": "Ada Alice Anna Clara Diana Elena Emma Eva Helen Irene Julia Laura Lena Maria Nora Olga Paula Rosa Sara Vera",
    "n-latin": "Alex Ariel Chris Dana Jamie Jordan Kim Lee Max Morgan Noel Pat Robin Rowan Sam Sasha Sidney Taylor Terry Toni",
    "m-cyrillic": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел Роман Семён Фёдор",
    "f-cyrillic": "Алла Анна Вера Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Юлия",
    "n-cyrillic": "Саша Женя Валя Слава Шура",
}
#: Syllables of surnames, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga ge ha hel ka kel la le lin lo ma mar mel mi mo na nel no ra ren ri ro sa sel ta tel to va ver vin wa zel",
    "cyrillic": "ба бе во га да де жа за ка ко ла ле ли ма ме ми на не но па пе ра ре ро са се си та те то ца чи ша",
}
_ENDING = {"latin": "son", "cyrillic": "ов"}
#: Words that announce a name without a title.
CUES = ("my name is", "My name is", "Name:")
#: The letters of each script, small.
LETTERS = {"IsLatin": "abcdefghijklmnopqrstuvwxyz", "IsCyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "IsGreek": "αβγδεζηθικλμνξοπρστυφχψω"}
_TITLES = [t for ts in TITLES.values() for t in ts.split()]
_TITLE = "|".join([*_TITLES, *CUES])
_CAPITAL_TITLE = "|".join(dict.fromkeys(t.upper() for t in _TITLES))
_INITIALS = "".join(sorted({t[0] for t in f"{_TITLE}|{_CAPITAL_TITLE}".split("|")}))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A capital and what follows it, inner capitals included: O'Brien, Smith-Jones, McDonald.
_NAME_WORD = r"\p{Lu}(?:['’-]?\p{L})+"
#: Kind -> pattern; earlier ones win. Each opens with what its first characters must be, which rules out most places at once.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}",
    "secret": r"(?=[AaPpSsTt])\b(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?(?=[+/_-]*+[A-Za-z0-9])[A-Za-z0-9+/_-]{8,}+",
    "access_key": r"(?=A[KS]IA)(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z]{2}\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "card": r"(?=\d)(?<![\d.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d-])",
    "phone": r"(?=[+(\d])(?:(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<![\d.-])0\d{2,4}[ /]\d{5,8}(?![\d-]))",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": rf"(?=[{_INITIALS}])(?<![\p{{L}}\p{{N}}])(?:(?:{_TITLE})\.? {_NAME_WORD}(?: (?!(?:{_TITLE})(?!\p{{L}})){_NAME_WORD})*|(?:{_CAPITAL_TITLE})\.? {_NAME_WORD}(?: {_NAME_WORD})?)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Draws in the plain forms; later ones take freer forms, and after the second number longer ones, which never run short.
_PLAIN_DRAWS, _FREE_DRAWS = 3, 6


def _may_have_any(x):
    """False only for texts that no pattern can match: without @, digit, = or :, and title."""
    out = F.contains(x, F.lit("@")) | F.contains(x, F.lit("=")) | F.contains(x, F.lit(":")) | x.rlike("[0-9]") | F.contains(x, F.lit("AKIA")) | F.contains(x, F.lit("ASIA"))
    for title in f"{_TITLE}|{_CAPITAL_TITLE}".split("|"):
        out = out | F.contains(x, F.lit(title))
    return out


def _kind(e):
    """The entity's kind: the first pattern that fits all of it."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(e.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return F.when((out == "card") & ~_luhn(_digits(e)), F.lit(None).cast("string")).otherwise(out)


def _luhn(digits):
    """Whether the check digit is right: other 16 digits are a number, not a card."""

    def add(total, i):
        d = F.substr(digits, i, F.lit(1)).try_cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _digits(x):
    return F.regexp_replace(x, "[^0-9]", "")


def _lead(kind, e):
    """What stays in front of the replaced part: the name of a secret, a title, a key's or an account's prefix."""
    return (
        F.when(kind == "secret", F.regexp_extract(e, r"\A([A-Za-z_-]+\s*[=:]\s*[\"']?)", 1))
        .when(kind == "name", F.regexp_extract(e, rf"\A((?:{_TITLE}|{_CAPITAL_TITLE})\.? )", 1))
        .when(kind == "access_key", F.substring(e, 1, 4))
        .when(kind == "iban", F.substring(e, 1, 2))
        .when(kind == "phone", F.regexp_extract(e, r"\A(\+\d{1,3}(?=[ .(-]))", 1))
        .otherwise(F.lit(""))
    )


def _gender(lead):
    title = F.upper(F.regexp_replace(lead, r"[. ]+\z", ""))
    out = F.lit("n")
    for g, titles in TITLES.items():
        out = F.when(title.isin(*(t.upper() for t in titles.split())), F.lit(g)).otherwise(out)
    return out


def _canonical(kind, lead, rest):
    """What mentions of one entity share."""
    return (
        F.when(kind == "email", F.lower(rest))
        .when(kind.isin("card", "ssn"), _digits(rest))
        .when(kind == "phone", F.concat_ws(" ", _digits(lead), _digits(rest)))
        .when(kind == "iban", F.concat(lead, F.replace(rest, F.lit(" "), F.lit(""))))
        .when(kind == "name", F.concat_ws(":", _gender(lead), F.lower(rest)))
        .otherwise(rest)
    )


def _noise(key: str, *parts):
    """128 hex digits that depend on the key and the parts."""
    base = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.concat(F.sha2(F.concat(base, F.lit("|0")), 256), F.sha2(F.concat(base, F.lit("|1")), 256))


def _number(noise, i):
    """The i-th number under 65,536 of the noise."""
    return F.conv(F.substr(noise, (i * 4) % 125 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(options: str, n):
    words = F.array(*[F.lit(w) for w in options.split()])
    return F.get(words, n % len(options.split()))


def _letter(alphabet: str, n):
    return F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _chars(x):
    return F.filter(F.split(x, ""), lambda c: c != "")


def _like(x, noise):
    """x with digits for digits and letters for letters of the same case and script; hexadecimal stays hexadecimal."""
    hexadecimal = x.rlike(r"\A(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}\z")

    def swap(c, i):
        n = _number(noise, i)
        out = F.when(hexadecimal, _letter("0123456789abcdef", n)).when(c.rlike("[0-9]"), _letter("0123456789", n))
        for script, letters in LETTERS.items():
            own = c.rlike(rf"\p{{{script}}}")
            out = out.when(own & c.rlike(r"\p{Lu}"), _letter(letters.upper(), n)).when(own & c.rlike(r"\p{L}"), _letter(letters, n))
        return out.when(c.rlike(r"\p{L}"), _letter(LETTERS["IsLatin"], n)).otherwise(c)

    return F.array_join(F.transform(_chars(x), swap), "")


def _any_like(x, noise, alphabet: str):
    """As many characters of the alphabet as x has."""
    return F.array_join(F.transform(_chars(x), lambda c, i: _letter(alphabet, _number(noise, i))), "")


def _with_check_digit(digits):
    """digits with its last one set so that the Luhn sum is right."""
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, i, F.lit(1)).try_cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n - 1), F.lit(0), add)
    return F.concat(F.substr(digits, F.lit(1), n - 1), ((10 - total % 10) % 10).cast("string"))


def _iban(country, bban):
    """An account number whose check digits are right (ISO 7064, modulo 97)."""

    def add(rest, c):
        n = F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(n > 9, F.lit(100)).otherwise(F.lit(10)) + n) % 97

    rest = F.aggregate(_chars(F.concat(bban, country, F.lit("00"))), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), bban)


def _name(canonical, key: str, attempt):
    """A given name of the gender and script if there was one, and a surname; each depends on its own word.

    After the plain draws surnames are longer and depend on the whole name.
    """
    gender, words = F.substring(canonical, 1, 1), F.split(F.substring_index(canonical, ":", -1), " ")

    whole = _noise(key, F.lit("whole name"), canonical, attempt)

    def word(w, i):
        noise = _noise(key, F.lit("name"), w, attempt)
        out = F.lit("")
        for script, syllables in SYLLABLES.items():
            surname = F.concat(*[_pick(syllables, _number(noise, F.lit(k))) for k in range(1, 4)])
            longer = F.concat(*[_pick(syllables, _number(whole, F.lit(k))) for k in range(6)])
            surname = F.concat(surname, F.when(attempt >= _PLAIN_DRAWS, longer).otherwise(F.lit("")), F.lit(_ENDING[script]))
            given = F.when(gender == "m", _pick(GIVEN[f"m-{script}"], _number(noise, F.lit(0))))
            given = given.when(gender == "f", _pick(GIVEN[f"f-{script}"], _number(noise, F.lit(0)))).otherwise(_pick(GIVEN[f"n-{script}"], _number(noise, F.lit(0))))
            own = F.when((i == 0) & (F.size(words) > 1), given).otherwise(F.initcap(surname))
            mine = w.rlike(r"\p{IsCyrillic}") if script == "cyrillic" else ~w.rlike(r"\p{IsCyrillic}")
            out = F.when(mine, own).otherwise(out)
        return out

    return F.array_join(F.transform(words, word), " ")


def _surrogate(kind, canonical, attempt, key: str):
    """The canonical surrogate of a canonical entity at a draw."""
    noise = _noise(key, kind, canonical, attempt)
    user, domain = F.substring_index(canonical, "@", 1), F.substring_index(canonical, "@", -1)
    sub = F.regexp_extract(domain, r"\A(.*\.)?[^.]+\.[^.]+\z", 1)
    label = F.when(attempt >= _PLAIN_DRAWS, F.concat(F.substr(noise, F.lit(113), F.lit(16)), F.lit("."))).otherwise(F.lit(""))
    mail = F.concat(_like(F.concat(user, F.lit("@"), sub), noise), label, F.lit("example."), F.substring_index(domain, ".", -1))
    free, longer = attempt >= _PLAIN_DRAWS, attempt >= _FREE_DRAWS
    if_longer = lambda x: F.when(longer, x).otherwise(F.lit(""))
    some_digits = F.lpad(F.conv(F.substr(noise, F.lit(97), F.lit(7)), 16, 10), 9, "0")
    card = _with_check_digit(F.concat(F.substring(canonical, 1, 1), _like(F.substr(canonical, F.lit(2)), noise), if_longer(F.substr(some_digits, F.lit(1), F.lit(3)))))
    octets = F.transform(F.split(canonical, r"\."), lambda o, i: (_number(noise, i) % 254 + 1).cast("string"))
    groups = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substr(noise, i * 4 + 1, F.lit(4)))
    address = F.when(longer, F.concat(F.lit("2001:db8:"), F.array_join(groups, ":"))).otherwise(F.array_join(octets, "."))
    country, local = F.substring_index(canonical, " ", 1), F.substring_index(canonical, " ", -1)
    bban = F.when(free, _any_like(F.substr(canonical, F.lit(5)), noise, "0123456789")).otherwise(_like(F.substr(canonical, F.lit(5)), noise))
    secret = F.when(free, _any_like(canonical, noise, LETTERS["IsLatin"] + "0123456789")).otherwise(_like(canonical, noise))
    token = F.when(free, _any_like(canonical, noise, LETTERS["IsLatin"].upper() + "0123456789")).otherwise(_like(canonical, noise))
    return (
        F.when(kind == "email", mail)
        .when(kind == "card", card)
        .when(kind == "ipv4", address)
        .when(kind == "phone", F.concat_ws(" ", country, F.concat(_like(local, noise), if_longer(some_digits))))
        .when(kind == "iban", _iban(F.substring(canonical, 1, 2), F.concat(bban, if_longer(some_digits))))
        .when(kind == "name", F.concat(F.substring(canonical, 1, 2), _name(canonical, key, attempt)))
        .when(kind == "secret", F.concat(secret, if_longer(F.substr(noise, F.lit(113), F.lit(16)))))
        .when(kind == "access_key", F.concat(token, if_longer(F.upper(F.substr(noise, F.lit(113), F.lit(16))))))
        .otherwise(F.concat(_like(canonical, noise), if_longer(some_digits)))
    )


def _written_like(kind, lead, rest, surrogate):
    """The canonical surrogate in the format of a mention."""
    flat = F.when(kind == "phone", F.substring_index(surrogate, " ", -1)).when(kind == "iban", F.substr(surrogate, F.lit(3))).otherwise(surrogate)
    slots = F.when(kind == "iban", F.lit("[0-9A-Z]")).otherwise(F.lit("[0-9]"))

    def place(c, i):
        before = F.length(F.regexp_replace(F.substr(rest, F.lit(1), i + 1), F.when(kind == "iban", F.lit("[^0-9A-Z]")).otherwise(F.lit("[^0-9]")), F.lit("")))
        return F.when(F.regexp_like(c, slots), F.substr(flat, before, F.lit(1))).otherwise(c)

    whole = F.length(F.regexp_replace(rest, F.when(kind == "iban", F.lit("[^0-9A-Z]")).otherwise(F.lit("[^0-9]")), F.lit("")))
    laid = F.when(F.length(flat) == whole, F.array_join(F.transform(_chars(rest), place), "")).otherwise(flat)
    cased = F.array_join(F.zip_with(_chars(surrogate), _chars(rest), lambda s, r: F.when(r.rlike(r"\p{Lu}"), F.upper(s)).otherwise(s)), "")
    mail = F.when(F.length(surrogate) == F.length(rest), cased).otherwise(surrogate)
    plain = F.substring_index(surrogate, ":", -1)
    name = F.when((F.upper(rest) == rest) & (F.length(rest) > 2), F.upper(plain)).otherwise(plain)
    return F.concat(lead, F.when(kind.isin("phone", "card", "ssn", "iban"), laid).when(kind == "email", mail).when(kind == "name", name).otherwise(flat))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, canonical) -> with surrogate: keyed, distinct for each kind, and no entity of the corpus.

    Of entities that draw the same surrogate the least keeps it and the others draw again: after _PLAIN_DRAWS draws in
    freer forms (other characters of the kind), after _FREE_DRAWS in longer ones, of which there are enough for any
    corpus, so that the draws end whatever the entities are.
    """
    n = shuffle_partitions(entities.sparkSession)
    drawn = entities.withColumn("attempt", F.lit(0))
    while True:
        spread = drawn.repartition(n)  # a draw costs many hashes: not all in one task
        drawn = written(spread.withColumn("surrogate", _surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key)), "surrogates")
        held = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("holder"), F.count("*").alias("n"))
        shared = held.where("n > 1").select("kind", "surrogate", "holder")
        real = held.join(entities.select("kind", F.col("canonical").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "surrogate", F.lit("").alias("holder"))
        taken = written(shared.union(real).groupBy("kind", "surrogate").agg(F.min("holder").alias("holder")), "collisions")
        if taken.isEmpty():
            return drawn.select("kind", "canonical", "surrogate")
        checked = drawn.join(taken, ["kind", "surrogate"], "left")
        again = F.col("holder").isNotNull() & (F.col("holder") != F.col("canonical"))
        drawn = checked.select("kind", "canonical", (F.col("attempt") + again.cast("int")).alias("attempt"))


def _without_titles(piece, known):
    """piece with the names of known (old, new), met without their title, replaced: whole names first, then last words."""
    longest = F.array_sort(known, lambda a, b: F.when(F.length(a["old"]) != F.length(b["old"]), F.length(b["old"]) - F.length(a["old"])).when(a < b, -1).when(a > b, 1).otherwise(0))

    def replace(text, name):
        # a name word has letters, apostrophes and hyphens only, so it stands for itself in a pattern
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), name["old"], F.lit(r"(?![\p{L}\p{N}])"))
        return F.when(F.contains(text, name["old"]), F.regexp_replace(text, pattern, name["new"])).otherwise(text)

    return F.when(F.size(known) > 0, F.aggregate(longest, piece, replace)).otherwise(piece)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its entities replaced, plus n_entities; such a column of docs is replaced, the others stay as they are.

    Null text stays null with 0 entities; text without entities is unchanged; whole texts are searched. Repeated rows
    get equal surrogates. An empty table gives an empty result. Nothing of the mapping is returned.
    """
    rows = docs.drop("n_entities")
    has = F.col(text_col).isNotNull() & _may_have_any(F.col(text_col)) & F.col(text_col).rlike(ANY)
    clean = rows.where(~has).withColumn("n_entities", F.lit(0).cast("long"))
    found = F.regexp_extract_all(F.col(text_col), F.lit(ANY), F.lit(0))
    hits = rows.where(has).withColumn("__rid", F.monotonically_increasing_id()).withColumn("__found", found)
    hits = written(hits, "texts_with_entities")
    each = hits.select("__rid", F.posexplode("__found").alias("at", "e")).withColumn("kind", _kind(F.col("e"))).withColumn("lead", _lead(F.col("kind"), F.col("e")))
    each = each.withColumn("rest", F.expr("substr(e, length(lead) + 1)"))
    each = written(each.withColumn("canonical", _canonical(F.col("kind"), F.col("lead"), F.col("rest"))), "mentions")
    named = surrogates(each.where("kind is not null").groupBy("kind", "canonical").agg(F.count("*").alias("n")).drop("n"), key)
    mentions = each.join(named, ["kind", "canonical"], "left")
    # what looks like an entity and isn't one (a number without a card's check digit) stays
    new = F.coalesce(_written_like(F.col("kind"), F.col("lead"), F.col("rest"), F.col("surrogate")), F.col("e"))
    whole = F.struct(F.col("rest").alias("old"), F.substring_index("surrogate", ":", -1).alias("new"))
    last = F.struct(F.substring_index("rest", " ", -1).alias("old"), F.substring_index("surrogate", " ", -1).alias("new"))
    last = F.struct(last["old"].alias("old"), F.substring_index(last["new"], ":", -1).alias("new"))
    known = F.when(F.col("kind") == "name", F.array(whole, last))
    by_doc = mentions.select("__rid", "at", new.alias("new"), known.alias("known"), F.col("surrogate").isNotNull().alias("real")).groupBy("__rid")
    by_doc = by_doc.agg(F.count_if("real").alias("__real"), F.array_sort(F.collect_list(F.struct("at", "new"))).alias("__new"), F.array_distinct(F.flatten(F.collect_list("known"))).alias("__known"))
    pieces = F.transform(F.split(F.col(text_col), ANY, -1), lambda p: _without_titles(p, F.col("__known")))
    joined = F.zip_with(pieces, F.col("__new.new"), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    done = hits.join(by_doc, "__rid").withColumn(text_col, F.array_join(joined, "")).withColumn("n_entities", F.col("__real").cast("long"))
    return clean.unionByName(done.select(*rows.columns, "n_entities"))


def op3_pii_surrogates(docs: DataFrame, key: str = "replace this key") -> DataFrame:
    """doc_id, text with surrogates and n_entities, a row per row; nulls, ties, empty tables and the like as `pseudonymise` says."""
    return pseudonymise(docs.select("doc_id", "text"), key)
