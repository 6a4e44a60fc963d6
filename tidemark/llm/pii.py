"""Personal data replaced by surrogates, with DataFrame functions only."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import read, stored

#: What is taken for an entity, tried in this order at each place. Names are those that a title introduces.
TITLE = r"(?:Mrs?|Ms|Miss|Sir|Dr|Prof|Herrn?|Frau|Señora?|Sra?|Monsieur|Madame|Mme|Г-н|Г-жа)\.?"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?)++",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d\-])(?:\d{4}[ \-]){3}\d{4}(?![\d\-])|(?<!\d)\d{13,19}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?\d{3,4}|\d{3}[ .\-]\d{3})[ .\-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){3,4}(?!\d)",
    "name": rf"(?<!\p{{L}}){TITLE} \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must contain somewhere for any entity of these types to be in it; a repeated group in a pattern is possessive,
#: since the engine takes a stack frame for each repetition of one that can be tried again.
HINTS = {
    ("email",): lambda t: t.contains("@"),
    ("ip", "ipv6", "iban", "card", "ssn", "phone"): lambda t: t.rlike("[0-9]"),
    ("secret",): lambda t: t.rlike("[0-9]|[a-f]{32}") | reduce(lambda a, b: a | b, [t.contains(x) for x in ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-")]),
    ("name",): lambda t: reduce(lambda a, b: a | b, [t.contains(x) for x in ("Mr", "Ms", "Miss", "Sir", "Dr", "Prof", "Herr", "Frau", "Señor", "Sr", "Monsieur", "Madame", "Mme", "Г-")]),
}

FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Г-жа)\b"

NEUTRAL = r"^(?:Dr|Prof)\b"

#: Given names by script and gender, and family names by script.
GIVEN = {
    ("latin", "f"): ["Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hilda", "Ines", "Julia", "Karin", "Lydia", "Marta", "Nora", "Olga", "Paula"],
    ("latin", "m"): ["Albin", "Boris", "Conrad", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Linus", "Martin", "Niklas", "Oskar", "Paul"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Лев"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Κλειώ", "Μαρία", "Νίκη", "Σοφία"],
    ("greek", "m"): ["Αντώνης", "Γιάννης", "Δημήτρης", "Ηλίας", "Κώστας", "Μάνος", "Νίκος", "Πέτρος"],
}
FAMILY = {
    "latin": ["Abel", "Berger", "Castell", "Dorn", "Ebner", "Falk", "Gruber", "Hartl", "Imhof", "Jansen", "Keller", "Lorenz", "Maurer", "Norden", "Olsen", "Peters"],
    "cyrillic": ["Белов", "Волков", "Громов", "Дронов", "Ершов", "Жуков", "Зуев", "Котов"],
    "greek": ["Βλάχος", "Γαλάνης", "Δήμου", "Καράς", "Λάμπρου", "Μάνου", "Νικολάου", "Ράλλης"],
}
#: Letters that spell the number of a surrogate name which lists alone can't tell apart.
SYLLABLES = {"latin": ["ba", "de", "fi", "go", "ku", "la", "me", "ni", "po", "ru", "sa", "te", "vi", "wo", "xu", "za"], "cyrillic": ["ба", "де", "фи", "го", "ку", "ла", "ме", "ни", "по", "ру", "са", "те", "ви", "во", "ху", "за"], "greek": ["βα", "γε", "δι", "ζο", "κα", "λε", "μι", "νο", "πα", "ρε", "σι", "το", "φα", "χε", "ψι", "ρο"]}

ROUNDS = 24


#: Exceptions that travel to the tasks within the plan; more are joined.
MOST_INLINE = 500
SEPARATORS = r"[ .()\-]"


def kind(entity: Column) -> Column:
    """The first pattern that the whole entity matches; what matches none is a name without its title."""
    return reduce(lambda rest, x: F.when(entity.rlike(f"^(?:{x[1]})$"), x[0]).otherwise(rest), reversed(PATTERNS.items()), F.lit("name"))


def _numeric(type_: Column) -> Column:
    return type_.isin("card", "iban", "phone", "ssn")


def canonical(entity: Column, type_: Column) -> Column:
    """What is one entity: addresses whatever their case, numbers whatever their separators."""
    return F.when(type_.isin("email", "ipv6"), F.lower(entity)).when(_numeric(type_), F.regexp_replace(entity, SEPARATORS, "")).otherwise(entity)


def _written(entity: Column, type_: Column, replacement: Column) -> Column:
    """The canonical replacement with the separators of entity."""
    upto = lambda i: F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), SEPARATORS, ""))
    spaced = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(SEPARATORS), c).otherwise(F.substr(replacement, upto(i), F.lit(1)))), "")
    return F.when(_numeric(type_) & entity.rlike(SEPARATORS), spaced).otherwise(replacement)


def _draw(key: str, *what: Column | str) -> Column:
    """64 keyed pseudo-random bits as hex digits; keyed twice, as SHA-256 in HMAC is."""
    text = F.concat_ws("\x1f", *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in what])
    return F.sha2(F.concat(F.lit(key + "\x1eo"), F.sha2(F.concat(F.lit(key + "\x1ei"), text), 256)), 256)


def _number(digest: Column, at: int, digits: int = 12) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def _bare(entity: Column) -> Column:
    """The words of a name without its title."""
    return F.split(F.regexp_replace(entity, rf"^{TITLE} ", ""), " ")


def _family(entity: Column) -> Column:
    return F.element_at(_bare(entity), -1)


def _given(entity: Column, names: Column) -> Column:
    """f, m or n (not told), by the title of the name or of one in the text that ends so, and the given name; null if there is
    none."""
    bare = F.array_join(_bare(entity), " ")
    titled = lambda titles: entity.rlike(titles) | F.exists(names, lambda x: x.endswith(F.concat(F.lit(" "), bare)) & x.rlike(titles))
    told = F.exists(F.concat(names, F.array(entity)), lambda x: (x == entity) & x.rlike(f"^{TITLE} ") & ~x.rlike(NEUTRAL) | x.endswith(F.concat(F.lit(" "), bare)) & ~x.rlike(NEUTRAL))
    gender = F.when(titled(FEMALE), "f ").when(told, "m ").otherwise("n ")
    return F.when(F.size(_bare(entity)) > 1, F.concat(gender, F.element_at(_bare(entity), 1)))


def _parts(entity: Column, type_: Column, names: Column) -> Column:
    """(type, entity) of what has a surrogate of its own: of a name the family name and the given name."""
    part = lambda t, e: F.struct(t.alias("type"), e.alias("entity"))
    named = F.filter(F.array(part(F.lit("family"), _family(entity)), part(F.lit("given"), _given(entity, names))), lambda x: x["entity"].isNotNull())
    return F.when(type_ == "name", named).otherwise(F.array(part(type_, canonical(entity, type_))))


def _titled(text: Column) -> Column:
    """The distinct names in a text that a title introduces."""
    found = F.when(HINTS[("name",)](text), F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def _hinted(text: Column) -> Column:
    """ANY without the types that text holds no hint of; null if there is no hint at all."""
    parts = [F.when(hint(text), "|".join(f"(?:{PATTERNS[t]})" for t in PATTERNS if t in types)) for types, hint in HINTS.items()]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws("|", *parts))


def _pattern(text: Column, names: Column) -> Column:
    """The pattern of what is an entity in text, null if nothing can be: _hinted, and the family names of these names wherever
    they stand, with a given name of theirs before or without."""
    either = lambda x: F.array_join(F.array_distinct(x), "|")
    givens = F.transform(F.filter(names, lambda x: F.size(_bare(x)) > 1), lambda x: F.element_at(_bare(x), 1))
    before = F.when(F.size(givens) > 0, F.concat(F.lit("(?:(?:"), either(givens), F.lit(") )?"))).otherwise("")
    mention = F.concat(F.lit(ANY + r"|(?<!\p{L})"), before, F.lit("(?:"), either(F.transform(names, _family)), F.lit(r")(?!\p{L})"))
    return F.when(F.size(names) > 0, mention).otherwise(_hinted(text))


def draws(entity: Column, type_: Column, attempt: Column, key: str) -> Column:
    """128 hex digits fixed by key, type, entity and attempt."""
    return F.concat(_draw(key, type_, entity, attempt), _draw(key, "more", type_, entity, attempt))


def _same_shape(entity: Column, stream: Column) -> Column:
    """Each digit by a digit, each letter by a letter of its case, hex letters by hex letters; all else stays."""
    hexadecimal = entity.rlike("^[0-9a-f]{32,64}$")

    def one(c: Column, i: Column) -> Column:
        r = F.conv(F.substr(stream, F.pmod(i * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int") + i
        return (
            F.when(hexadecimal, F.substr(F.lit("0123456789abcdef"), F.pmod(r, F.lit(16)) + 1, F.lit(1)))
            .when(c.between("0", "9"), F.substr(F.lit("0123456789"), F.pmod(r, F.lit(10)) + 1, F.lit(1)))
            .when(c.between("a", "z"), F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(r, F.lit(26)) + 1, F.lit(1)))
            .when(c.between("A", "Z"), F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.pmod(r, F.lit(26)) + 1, F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def surrogate(entity: Column, type_: Column, digest: Column, attempt: Column) -> Column:
    """A replacement of a canonical entity, fixed by its draws: of the same type, gender, script and format.

    A mail address stands in a domain reserved for examples, an IP address in a block that is never routed or kept for documents; a card number
    keeps its length and whether its check digit is right, a phone number its zone, a secret its alphabet and known
    prefix, a bank account its country, a name its script. A given name is preceded by f, m or n,
    for its gender, and a space.
    """
    shaped = _same_shape(entity, digest)
    n = [_number(digest, 1 + 12 * i) for i in range(5)]

    def pick(names: list[str], x: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), F.pmod(x, F.lit(len(names))).cast("int") + 1)

    local = F.concat_ws(".", F.lower(pick(GIVEN["latin", "f"] + GIVEN["latin", "m"], n[0])), F.lower(pick(FAMILY["latin"], n[1])))
    email = F.concat(local, F.pmod(n[2], F.lit(10**9)).cast("string"), F.lit("@"), F.when(F.pmod(n[3], F.lit(2)) == 0, "example.org").otherwise("example.net"))
    ip = F.concat_ws(".", F.element_at(F.array(*[F.lit(str(x)) for x in (10, *range(240, 255))]), F.pmod(n[3], F.lit(16)).cast("int") + 1), *[F.pmod(x, F.lit(256)).cast("string") for x in n[:3]])
    kept = F.length(F.regexp_extract(entity, r"^(?:AKIA|gh[pousr]_|sk-|\+\d)?", 0))
    prefixed = F.concat(F.substr(entity, F.lit(1), kept), F.substr(shaped, kept + 1))
    iban = F.concat(F.substring(entity, 1, 2), F.substr(shaped, F.lit(3)))

    groups = [F.lower(F.conv(F.pmod(F.shiftright(x, 16 * i), F.lit(65536)).cast("string"), 10, 16)) for x in n[:2] for i in range(3)]
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *groups)
    cyrillic, greek = entity.rlike(r"\p{IsCyrillic}"), entity.rlike(r"\p{IsGreek}")

    def named(script: str) -> Column:
        more = F.concat_ws("", *[F.element_at(F.array(*map(F.lit, SYLLABLES[script])), F.pmod(F.shiftright(n[4], 4 * i), F.lit(16)).cast("int") + 1) for i in range(5)])
        both = GIVEN[script, "f"] + GIVEN[script, "m"]
        given = F.concat(F.substring(entity, 1, 2), F.when(entity.startswith("f "), pick(GIVEN[script, "f"], n[0])).when(entity.startswith("m "), pick(GIVEN[script, "m"], n[0])).otherwise(pick(both, n[0])))
        return F.concat(F.when(type_ == "family", pick(FAMILY[script], n[1])).otherwise(given), F.when(attempt > 0, more).otherwise(""))

    return (
        F.when(type_ == "email", email)
        .when(type_ == "ip", ip)
        .when(type_ == "ipv6", ipv6)
        .when(type_.isin("secret", "phone"), prefixed)
        .when(type_ == "iban", iban)
        .when(type_ == "card", _checked(entity, shaped))
        .when(type_.isin("family", "given"), F.when(cyrillic, named("cyrillic")).when(greek, named("greek")).otherwise(named("latin")))
        .otherwise(shaped)
    )


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.when(c.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda total, x: total + x) % 10


def _checked(entity: Column, shaped: Column) -> Column:
    """shaped with its last digit set so that it passes the check of card numbers just if entity does."""
    own = F.regexp_replace(entity, r"\D", "")
    head = F.substr(shaped, F.lit(1), F.length(shaped) - 1)
    fits = F.pmod(-_luhn(F.concat(F.regexp_replace(head, r"\D", ""), F.lit("0"))), F.lit(10))
    last = F.substr(shaped, F.length(shaped), F.lit(1)).cast("int")
    other = F.when(last == fits, (last + 1) % 10).otherwise(last)
    return F.concat(head, F.when(_luhn(own) == 0, fits).otherwise(other).cast("string"))


def dictionary(found: DataFrame, key: str) -> DataFrame:
    """(type, entity, surrogate, attempt) for the distinct rows of found(type, entity): no surrogate twice, none an entity.

    Of entities that draw the same surrogate the first by byte order keeps it, unless it is an entity of the text; the
    others draw again until none collides. Each round aggregates by surrogate; only entities still open are drawn again.
    """
    every = stored(found.distinct(), "entities")
    open_, done = every, None
    for attempt in range(ROUNDS):
        digest = open_.withColumn("digest", draws(F.col("entity"), F.col("type"), F.lit(attempt), key))
        drawn = stored(digest.select("type", "entity", surrogate(F.col("entity"), F.col("type"), F.col("digest"), F.lit(attempt)).alias("surrogate")), "drawn")
        taken = every.select("type", F.col("entity").alias("surrogate"))
        if done is not None:
            taken = taken.union(done.select("type", "surrogate"))
        first = drawn.groupBy("type", "surrogate").agg(F.min("entity").alias("entity")).join(taken, ["type", "surrogate"], "left_anti")
        good = stored(first.select("type", "entity", "surrogate", F.lit(attempt).alias("attempt")), "good")
        done = good if done is None else done.union(good)
        open_ = stored(drawn.join(good, ["type", "entity"], "left_anti").select("type", "entity"), "open")
        if not open_.take(1):
            return done
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds: their format leaves too few, of types {[r.type for r in open_.select('type').distinct().collect()]}")


_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key in spark.tidemark.pii.key, which whoever can read may compute surrogates with; where that is unset a random one,
    the same as long as the application runs and then lost."""
    return spark.conf.get("spark.tidemark.pii.key", None) or _keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def redact(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with text replaced and n_entities added, the number of replacements.

    An entity is a match of PATTERNS, or a family name that a title introduces elsewhere in the text, with a given name so
    introduced or without. Titles stay; family names have surrogates of their own, and given names by gender. The same entity (addresses whatever their case, numbers whatever their separators)
    has the same surrogate wherever it stands; different ones have different surrogates. All else in a text stays.

    A text is searched for a type only if it holds what all entities of the type do (HINTS). Without a key, see session_key.
    A surrogate is a function of key and entity, so texts are rewritten where they are read, without a shuffle. Entities
    whose first draw collided are exceptions: up to MOST_INLINE travel with the plan; more are joined to their texts.

    A null text stays null with n_entities 0; an empty text stays empty. Repeated rows are replaced alike; an empty table
    gives no rows; other columns stay, but one named n_entities is replaced.
    """
    key = key or session_key(docs.sparkSession)
    docs = docs.withColumn("~titled", _titled(F.col("text"))).withColumn("~pattern", _pattern(F.col("text"), F.col("~titled")))
    pattern = F.col("~pattern")
    found = F.coalesce(F.when(pattern.isNotNull(), F.regexp_extract_all("text", pattern, F.lit(0))), F.array().cast("array<string>"))
    parts = F.explode(_parts(F.col("e"), kind(F.col("e")), F.col("~titled"))).alias("x")
    names = dictionary(docs.select("~titled", F.explode(found).alias("e")).select(parts).select("x.type", "x.entity"), key)
    again = stored(names.where("attempt > 0"), "exceptions")
    few = again.take(MOST_INLINE + 1)
    base, exceptions = docs.drop("n_entities").withColumn("~found", found), None
    if len(few) > MOST_INLINE:
        at = docs.select(F.sha2("text", 256).alias("~text"), "~titled", F.explode(found).alias("e")).select("~text", parts)
        at = at.select("~text", "x.type", "x.entity").distinct()
        maps = at.join(again, ["type", "entity"]).groupBy("~text").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\x1f", "type", "entity"), "surrogate"))).alias("~names"))
        base = base.withColumn("~text", F.sha2("text", 256)).join(stored(maps, "exceptions-by-text"), "~text", "left")
        exceptions = F.coalesce("~names", F.create_map().cast("map<string,string>"))
    elif few:
        exceptions = F.create_map(*[F.lit(x) for r in few for x in (f"{r.type}\x1f{r.entity}", r.surrogate)])

    def chosen(x: Column) -> Column:
        drawn = surrogate(x["entity"], x["type"], x["digest"], F.lit(0))
        return drawn if exceptions is None else F.coalesce(F.try_element_at(exceptions, F.concat_ws("\x1f", x["type"], x["entity"])), drawn)

    def put(x: Column) -> Column:
        name = F.concat_ws(" ", F.regexp_substr(x["e"], F.lit(rf"^{TITLE}(?= )")), F.substr(F.try_element_at(x["new"], F.lit(2)), F.lit(3)), F.element_at(x["new"], 1))
        return F.when(x["type"] == "name", name).otherwise(_written(x["e"], x["type"], F.element_at(x["new"], 1)))

    steps = (
        lambda e: F.struct(e.alias("e"), kind(e).alias("type")),
        lambda x: F.struct(x["e"].alias("e"), x["type"].alias("type"), _parts(x["e"], x["type"], F.col("~titled")).alias("parts")),
        lambda x: F.struct(x["e"].alias("e"), x["type"].alias("type"), F.transform(x["parts"], lambda y: F.struct(y["type"].alias("type"), y["entity"].alias("entity"), draws(y["entity"], y["type"], F.lit(0), key).alias("digest"))).alias("parts")),
        lambda x: F.struct(x["e"].alias("e"), x["type"].alias("type"), F.transform(x["parts"], chosen).alias("new")),
        put,
    )
    new = reduce(F.transform, steps, F.col("~found"))
    whole = F.array_join(F.zip_with(F.split("text", pattern, -1), F.concat(new, F.array(F.lit(""))), lambda between, put: F.concat(between, put)), "")
    text = F.when(F.size("~found") > 0, whole).otherwise(F.col("text"))
    out = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_entities", "~titled", "~pattern")]
    return base.select(*out, F.size("~found").cast("long").alias("n_entities"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")
