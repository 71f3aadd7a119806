"""Personal data replaced by keyed surrogates of the same type, format, script and gender.

Detection is one pattern. Every distinct entity, in a normal form that unites its
spellings, gets one surrogate from a keyed SHA-256, so an entity has the same surrogate
wherever it occurs and none of it can be told without the key. Surrogates are checked over
the whole corpus: no two entities of a type share one, and none equals an entity that
occurs. Entities that fail are drawn again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuelens.llm.staging import apart, staged

KEY = "surrogates"
ADDED = ("n_entities", "entities")

# Forms of address by gender, in the languages of the texts.
MALE_TITLES = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Signora", "Госпожа", "Κυρία"]
OTHER_TITLES = ["Dr", "Prof"]

# What surrogate names are put together from, by script.
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "do", "fe", "ga", "ka", "ke", "la", "le", "li", "ma", "mo", "na", "no", "ra", "re", "ri", "ro", "sa", "so", "ta", "te", "to", "va", "vi", "wa", "ya", "za"],
    "cyrillic": ["ба", "бо", "ва", "го", "да", "до", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "но", "ра", "ре", "ро", "са", "со", "та", "то", "фа", "хо"],
    "greek": ["βα", "γα", "δο", "ζα", "θε", "κα", "κο", "λα", "λε", "μα", "μι", "να", "νο", "πα", "ρα", "ρο", "σα", "σο", "τα", "το", "φα", "χα"],
}
ENDINGS = {
    ("latin", "m"): ["n", "rd", "s", "ck"],
    ("latin", "f"): ["ia", "ina", "elle", "ette"],
    ("latin", "x"): ["n", "l", "m", "r"],
    ("cyrillic", "m"): ["н", "р", "м", "слав"],
    ("cyrillic", "f"): ["ия", "ина", "ана", "ея"],
    ("cyrillic", "x"): ["в", "к", "нко", "н"],
    ("greek", "m"): ["ος", "ης", "ας", "ων"],
    ("greek", "f"): ["ια", "ινη", "ανη", "ω"],
    ("greek", "x"): ["ου", "ιδη", "ακη", "η"],
}

# The patterns of the entity types.
PATTERNS = {
    "email": r"[\p{L}\p{N}](?:[\p{L}\p{N}._%+-]{0,62}[\p{L}\p{N}_%+-])?@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d-])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?:(?=[0-9a-f]*[a-f])(?=[0-9a-f]*\d)[0-9a-f]{16,}|(?:AKIA|ASIA)[A-Z0-9]{12,}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9-]{16,})(?![\p{L}\p{N}])",
    "person": r"(?<![\p{L}\p{N}])(?:"
    + "|".join(OTHER_TITLES + FEMALE_TITLES + MALE_TITLES)
    + r")\.?(?: (?:Dr|Prof)\.?)? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}",
}
#: A text without any of these has no entity; spares most texts the full pattern.
HINT = r"[\d@]|(?:AKIA|ASIA)[A-Z]{12}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z-]{16}|" + "|".join(rf"{t}\.? " for t in OTHER_TITLES + FEMALE_TITLES + MALE_TITLES)
DETECT = "|".join(PATTERNS.values())


def kind_of(raw: Column) -> Column:
    """Type of a detected string: the first pattern, in order, that it matches whole."""
    out = None
    for kind, pattern in PATTERNS.items():
        test = raw.rlike(rf"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def _normal(kind: Column, raw: Column) -> Column:
    """What all spellings of an entity have in common."""
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(raw, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when(kind == "ip", F.regexp_replace(raw, r"(?<=^|\.)0+(?=\d)", ""))
        .when(kind.startswith("name"), F.lower(raw))
        .otherwise(raw)
    )


def _units(kind: Column, raw: Column) -> Column:
    """(kind, raw, sex) pieces of a detected string; kind is null for what stays.

    Persons are replaced name by name, so a surname alone agrees with the full name.
    A form of address says the sex of given names, 1 or -1; other names have 0.
    """
    words = F.split(raw, " ")
    male, female = (F.array(*[F.lit(t) for t in titles]) for titles in (MALE_TITLES, FEMALE_TITLES))
    title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
    sex = F.when(F.array_contains(male, title), 1).when(F.array_contains(female, title), -1).otherwise(0)
    titles = F.array(*[F.lit(t) for t in OTHER_TITLES + MALE_TITLES + FEMALE_TITLES])

    def word(w: Column, i: Column) -> Column:
        script = F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")
        last = i == F.size(words) - 1
        name = F.when(~F.array_contains(titles, F.regexp_replace(w, r"\.$", "")), F.concat(F.lit("name:"), script))
        return F.struct(name.alias("kind"), w.alias("raw"), F.when(last, 0).otherwise(sex).alias("sex"))

    whole = F.struct(kind.alias("kind"), raw.alias("raw"), F.lit(0).alias("sex"))
    return F.when(kind == "person", F.transform(words, word)).otherwise(F.array(whole))


def _number(key: str, i: Column, bound: Column | int) -> Column:
    """The i-th keyed pseudo-random number of an entity, below ``bound``."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm", "tries", i.cast("string")), 256), 1, 12), 16, 10).cast("long"), F.lit(bound))


def _like(text: Column, key: str, keep: int = 0) -> Column:
    """``text`` with every letter and digit after the first ``keep`` characters drawn anew."""
    lower, upper = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def pick(c: Column, i: Column) -> Column:
        letter = F.substr(F.when(c.rlike(r"^\p{Lu}$"), upper).otherwise(lower), (_number(key, i, 26) + 1).cast("int"), F.lit(1))
        return (
            F.when(i < keep, c)
            .when(c.rlike("^[0-9]$"), _number(key, i, 10).cast("string"))
            .when(c.rlike(r"^\p{L}$"), letter)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), pick), "")


def _luhn(digits: Column) -> Column:
    """Check digit that completes ``digits``."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return (10 - total % 10) % 10


def _surrogate(key: str) -> Column:
    """Normal form of the surrogate of the entity (kind, norm) at its ``tries``-th draw."""
    norm, kind = F.col("norm"), F.col("kind")
    octets = F.concat_ws(".", (_number(key, F.lit(0), 16) + 240).cast("string"), *[_number(key, F.lit(i), 256).cast("string") for i in (1, 2, 3)])
    domain = F.regexp_extract(norm, "@(.*)$", 1)
    email = F.concat(_like(F.regexp_extract(norm, "^(.*)@", 1), key), F.lit("@"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 1, 16), F.lit(".example"))
    drawn = _like(norm, key, keep=1)
    body = F.expr("substring(norm, 1, length(norm) - 1)")
    shift = F.pmod(F.substr(norm, F.length(norm), F.lit(1)).cast("int") - _luhn(body), F.lit(10))
    new_body = F.substr(drawn, F.lit(1), F.length(norm) - 1)
    card = F.concat(new_body, ((_luhn(new_body) + shift) % 10).cast("string"))
    hexed = F.substr(F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), "kind", "norm", "tries", F.lit(i)), 256) for i in range(4)]), F.lit(1), F.length(norm))

    def syllable(script: str, i: Column) -> Column:
        parts = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        return F.element_at(parts, (_number(key, i, len(SYLLABLES[script])) + 1).cast("int"))

    def name_in(script: str, endings: list[str]) -> Column:
        more = F.transform(F.sequence(F.lit(10), F.col("tries") + 10), lambda i: syllable(script, i))
        tail = F.element_at(F.array(*[F.lit(s) for s in endings]), (_number(key, F.lit(9), len(endings)) + 1).cast("int"))
        return F.concat(*[syllable(script, F.lit(i)) for i in range(3)], F.array_join(more, ""), tail)

    name = F.lit(None).cast("string")
    for (script, gender), endings in ENDINGS.items():
        name = F.when((kind == f"name:{script}") & (F.col("gender") == gender), name_in(script, endings)).otherwise(name)
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substr(_like(norm, key), F.lit(2))))
        .when(kind == "phone", drawn)
        .when(kind == "iban", _like(norm, key, keep=2))
        .when(kind.startswith("name"), name)
        .when((kind == "secret") & norm.rlike("^[0-9a-f]{16,256}$"), hexed)
        .otherwise(_like(norm, key, keep=4))
    )


def _shaped(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the spelling of the original: its separators and capitals."""

    def digit(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(raw, F.lit(1), i), "[^0-9A-Z]", ""))
        return F.when(c.rlike("^[0-9A-Z]$"), F.substr(made, before + 1, F.lit(1))).otherwise(c)

    spread = F.array_join(F.transform(F.split(raw, ""), digit), "")
    capital = F.when(F.upper(raw) == raw, F.upper(made)).otherwise(F.concat(F.upper(F.substr(made, F.lit(1), F.lit(1))), F.substr(made, F.lit(2))))
    email = F.when(F.upper(raw) == raw, F.upper(made)).otherwise(made)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), spread)
        .when(kind.startswith("name"), capital)
        .when(kind == "email", email)
        .otherwise(made)
    )


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, made) for the distinct ``entities(kind, norm)``, with ``sex`` if it is known.

    ``made`` is unique within a kind and no entity of the kind equals it. All names of a
    script are one kind, so a name keeps its surrogate as given name and surname and
    after every form of address; its gender is that of most of its forms of address,
    none if they are even. Each round draws again for those that fail, all but the least
    of those that collide, with equi-joins on the narrow entity table; only the number
    of failures reaches the driver. A kind whose forms are too few for its entities
    stops with an error. Entities are hashed over the shuffle partitions before a draw.
    """
    spark = entities.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sex = F.sum("sex") if "sex" in entities.columns else F.lit(0)
    gender = F.when(sex > 0, "m").when(sex < 0, "f").otherwise("x").alias("gender")
    columns = ["kind", "norm", "gender", "tries"]

    def drawn(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts, "kind", "norm").withColumn("made", _surrogate(key))

    now = staged(drawn(entities.groupBy("kind", "norm").agg(gender).withColumn("tries", F.lit(0))))
    known = now.select("kind", "norm")
    for _ in range(64):
        taken = now.groupBy("kind", "made").agg(F.min("norm").alias("owner"))
        real = known.select("kind", F.col("norm").alias("made"), F.lit(True).alias("real"))
        judged = now.join(taken, ["kind", "made"]).join(real, ["kind", "made"], "left")
        judged = staged(judged.select(*columns, "made", (F.col("real").isNotNull() | (F.col("norm") != F.col("owner"))).alias("bad")))
        if judged.where("bad").isEmpty():
            return judged.select("kind", "norm", "made")
        again = drawn(judged.where("bad").withColumn("tries", F.col("tries") + 1).select(*columns))
        now = staged(judged.where("not bad").select(*columns, "made").unionByName(again.select(*columns, "made")))
    raise ValueError("a kind of entity has too few surrogates")


def pseudonymise(docs: DataFrame, key: str = "doc_id", text: str = "text", secret: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, ``n_entities`` and ``entities``.

    ``entities`` lists (kind, surrogate) in the order of the text. Kinds: email, ip,
    phone, ssn, card, iban, secret, person (after a form of address). Emails keep the
    shape of their local part and get a reserved domain; IPs move to a reserved block;
    cards keep their first digit and stay as (in)valid as they were; phones keep the
    first digit of the country code; all numbers keep their separators; names keep
    script, gender and capitals, and one name has one surrogate after every title.

    Defined cases: null and empty texts stay as they are with no entity. Repeated
    rows get the same text. Rows with one key and different texts are told apart by the
    text's hash; a null key is a key like others. Added columns replace input columns
    of the same name; the others pass through.

    Scale: only strings that were detected leave the documents. Each entity is drawn
    once however often it occurs, and mentions meet surrogates in a join with one row
    per entity on one side, which AQE may split. Texts without an entity skip the
    last join.
    """
    others = apart(docs, ADDED)
    hash_ = F.xxhash64(text)
    matches = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(DETECT), F.lit(0)))
    found = (
        docs.select(F.struct(F.col(key).alias("k"), hash_.alias("t")).alias("id"), matches.alias("m"))
        .where(F.size("m") > 0)
        .dropDuplicates(["id"])
        .select("id", F.posexplode("m").alias("at", "whole"))
    )
    told = found.withColumn("type", kind_of(F.col("whole")))
    pieces = staged(
        told.select("id", "at", "type", F.posexplode(_units(F.col("type"), F.col("whole"))).alias("part", "u"))
        .select("id", "at", "type", "part", "u.kind", "u.raw", "u.sex")
        .withColumn("norm", _normal(F.col("kind"), F.col("raw")))
    )
    made = surrogates(pieces.where("kind is not null").select("kind", "norm", "sex"), secret)
    joined = pieces.join(made, ["kind", "norm"], "left").withColumn("new", F.when(F.col("made").isNull(), F.col("raw")).otherwise(_shaped(F.col("kind"), F.col("raw"), F.col("made"))))
    wholes = joined.groupBy("id", "at", "type").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "new"))), lambda p: p["new"]), " ").alias("surrogate")
    )
    by_doc = wholes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("at", "type", "surrogate"))).alias("__e")).select(
        F.col("id.k").alias("__k"), F.col("id.t").alias("__t"), "__e"
    )
    gaps = F.split(F.col(text), DETECT, -1)
    filled = F.concat(
        F.element_at(F.col("__g"), 1),
        F.array_join(F.transform(F.col("__e"), lambda e, i: F.concat(e["surrogate"], F.element_at(F.col("__g"), (i + 2).cast("int")))), ""),
    )
    return (
        docs.select(*others, hash_.alias("__h"))
        .join(by_doc, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__h") == F.col("__t")), "left")
        .withColumn("__g", F.when(F.col("__e").isNotNull(), gaps))
        .select(
            *[F.when(F.col("__e").isNotNull(), filled).otherwise(F.col(text)).alias(text) if c == text else c for c in others],
            F.coalesce(F.size("__e"), F.lit(0)).cast("long").alias("n_entities"),
            F.transform(F.coalesce("__e", F.array().cast("array<struct<at:int,type:string,surrogate:string>>")), lambda e: F.struct(e["type"].alias("kind"), e["surrogate"].alias("surrogate"))).alias("entities"),
        )
    )
