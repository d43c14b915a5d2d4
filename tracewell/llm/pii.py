"""PII surrogates, with DataFrame operations only.

Detected entities are replaced by surrogates of their kind and format. A surrogate is a keyed hash of the entity's
canonical form spelt in the mention's own shape: digits for digits, letters for letters of the same script and case,
punctuation as it was, and names that keep their title and with it their gender. So equal entities, however they are
punctuated, get equal surrogates wherever they occur, with no table to look up. Distinctness is checked on the table of
distinct entities: where two share a surrogate, or a surrogate is itself an entity of the corpus, all but the first
get another attempt, until there is no collision. Only those exceptions are joined back to documents.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import settled

TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")}
# fixed values: given names by gender and script, and syllables of family names
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helena Irma Julia Karin Laura Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Зоя Ирина Кира".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta te to va ve vo".split(), "cyrillic": "ба бе да де ка ке ла ле ма ме на не ра ре са се".split()}
LETTERS = {"[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\p{IsCyrillic}&&\p{Ll}]": "абвгдежзиклмнопрстуфхцчшэюя", r"[\p{IsCyrillic}&&\p{Lu}]": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", r"[\p{IsGreek}&&\p{Ll}]": "αβγδεζηθικλμνξοπρστυφχψω", r"[\p{IsGreek}&&\p{Lu}]": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"\p{IsHan}": "安白成大东方高国海和家金开乐林明南平青山", r"\p{Lu}": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}

_titles = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-]++(?:\.[\p{L}\p{N}_%+-]++)*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "hex": r"\b[0-9a-f]{32,128}\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\w.])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w])",
    "name": rf"\b(?:{_titles})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
ENTITY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Documents without any of these hold no entity.
HINT = rf"[0-9@]|\b(?:{_titles})\.? \p{{Lu}}"
ATTEMPTS = 40


def kind_of(e: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(e.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def canonical(e: Column, kind: Column) -> Column:
    """What mentions of one entity have in common."""
    digits = F.regexp_replace(e, r"\D", "")
    national = F.substring(digits, -10, 10)  # a number with and without its country is one
    return (
        F.when(kind == "phone", F.concat(F.lit("phone "), national))
        .when(kind.isin("card", "ssn"), F.concat(kind, F.lit(" "), digits))
        .when(kind == "name", F.concat(F.lit("name "), F.regexp_replace(e, rf"^(?:{_titles})\.? ", "")))
        .otherwise(F.concat(kind, F.lit(" "), F.lower(e)))
    )


def byte(h: Column, i: Column) -> Column:
    """The i-th byte of a hash in hexadecimal."""
    return F.conv(F.substr(h, i % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(choices: str | list[str], n: Column) -> Column:
    if isinstance(choices, str):
        return F.substr(F.lit(choices), n % len(choices) + 1, F.lit(1))
    return F.element_at(F.array(*[F.lit(c) for c in choices]), (n % len(choices) + 1).cast("int"))


def spelt(part: Column, h: Column, digits: str = "0123456789", hex_only: Column | None = None) -> Column:
    """part, from its end, with each letter and digit replaced by one of its kind that the hash picks."""

    def step(acc: Column, c: Column) -> Column:
        n = byte(h, acc["j"])
        new = F.when(c.rlike(r"^\d$"), pick(digits, n))
        for pattern, letters in LETTERS.items():
            new = new.when(c.rlike(f"^{pattern}$"), pick(letters, n))
        if hex_only is not None:
            new = F.when(hex_only, pick("0123456789abcdef", n)).otherwise(new)
        return F.struct(F.concat(F.coalesce(new, c), acc["out"]).alias("out"), (acc["j"] + F.when(new.isNull(), 0).otherwise(1)).alias("j"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("j"))
    return F.aggregate(F.reverse(F.filter(F.split(part, ""), lambda c: c != "")), start, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """Check digit of a string of digits."""

    def step(acc: Column, c: Column) -> Column:
        d = c.cast("int") * F.when(acc["j"] % 2 == 0, 2).otherwise(1)
        return F.struct((acc["sum"] + F.floor(d / 10).cast("int") + d % 10).alias("sum"), (acc["j"] + 1).alias("j"))

    total = F.aggregate(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("j")), step, lambda acc: acc["sum"])
    return ((10 - total % 10) % 10).cast("string")


def surrogate(e: Column, key: str, attempt: Column) -> Column:
    """The replacement of one mention."""
    kind = kind_of(e)
    h = F.sha2(F.concat_ws("\x1f", F.lit(key), canonical(e, kind), attempt.cast("string")), 512)
    title = F.regexp_extract(e, rf"^((?:{_titles})\.? )", 1)
    gender = F.when(F.regexp_replace(title, r"\.? $", "").isin(*TITLES["f"]), "f").otherwise("m")
    names = {}
    for script, syllables in SYLLABLES.items():
        family = F.initcap(F.concat(*[pick(syllables, byte(h, F.lit(i))) for i in range(4, 8)]))
        given = F.when(gender == "f", pick(GIVEN["f", script], byte(h, F.lit(9)))).otherwise(pick(GIVEN["m", script], byte(h, F.lit(9))))
        two = F.regexp_replace(e, rf"^(?:{_titles})\.? ", "").contains(" ")
        names[script] = F.concat(title, F.when(two, F.concat(given, F.lit(" "))).otherwise(F.lit("")), family)
    digits = F.regexp_replace(e, r"\D", "")
    octets = F.array_join(F.transform(F.split(e, r"\."), lambda _, i: (byte(h, i) % 254 + 1).cast("string")), ".")
    # a card keeps its first digit and ends in a check digit that fits
    inner = spelt(F.substr(digits, F.lit(2), F.length(digits) - 2), h)
    number = F.concat(F.substring(digits, 1, 1), inner)
    number = F.concat(number, luhn(number))
    shaped = F.aggregate(
        F.filter(F.split(e, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("j")),
        lambda acc, c: F.struct(
            F.concat(acc["out"], F.when(c.rlike(r"^\d$"), F.substr(number, acc["j"], F.lit(1))).otherwise(c)).alias("out"), (acc["j"] + F.when(c.rlike(r"^\d$"), 1).otherwise(0)).alias("j")
        ),
        lambda acc: acc["out"],
    )
    country = F.regexp_extract(e, r"^(\+\d{1,3}(?=[ .(-])|\d{1,3}(?=[ .-]?\())", 1)
    top = F.regexp_extract(e, r"(\.[^.@]+)$", 1)
    return (
        F.when(kind == "email", F.concat(spelt(F.substr(e, F.lit(1), F.length(e) - F.length(top)), h), top))
        .when(kind == "key", F.concat(F.substring(e, 1, 4), spelt(F.substr(e, F.lit(5)), h)))
        .when(kind == "hex", spelt(e, h, hex_only=F.lit(True)))
        .when(kind == "ip", octets)
        .when(kind == "phone", F.concat(country, spelt(F.substr(e, F.length(country) + 1), h)))
        .when(kind == "card", shaped)
        .when(kind == "name", F.when(e.rlike(r"\p{IsCyrillic}"), names["cyrillic"]).otherwise(names["latin"]))
        .otherwise(spelt(e, h))
    )


def pseudonymized(docs: DataFrame, key: str = "surrogates", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with every entity of KINDS in the text replaced, and n_entities (which replaces such a column).

    Mentions are replaced alike if their canonical forms are equal: phone numbers by their last ten digits, cards and
    social security numbers by their digits, names without their title, others in lower case. Entities that differ get
    surrogates that differ, and no surrogate is an entity of the input. Null text stays null, with 0 entities; rows that
    repeat an id are treated each; an empty table gives an empty result; other columns pass unchanged.
    """
    docs = docs.drop("n_entities")
    source = F.col(text).cast("string")
    mentions = lambda: F.when(source.rlike(HINT), F.regexp_extract_all(source, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    own = docs.select(F.xxhash64(F.col(id_col), source).alias("__row"), F.explode(F.array_distinct(mentions())).alias("e"))
    found = settled(own.withColumn("kind", kind_of(F.col("e"))).withColumn("entity", canonical(F.col("e"), F.col("kind"))).select("__row", "e", "entity"))
    # dealt by number: there are far fewer entities than mentions, and adaptive execution would take them for one task's work
    tasks = max(24, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    entities = settled(found.groupBy("entity").agg(F.min("e").alias("e")).withColumn("attempt", F.lit(0)).repartition(tasks, "entity"))
    known = entities.select(F.col("entity").alias("made"))
    state = entities
    for _ in range(ATTEMPTS):
        state = settled(state.withColumn("s", surrogate(F.col("e"), key, F.col("attempt"))).withColumn("made", canonical(F.col("s"), kind_of(F.col("e")))))
        firsts = state.groupBy("made").agg(F.min("entity").alias("first"), F.count("*").alias("n"))
        clash = firsts.filter("n > 1").select("made", "first").unionByName(firsts.join(known, "made", "left_semi").select("made", F.lit(None).cast("string").alias("first")))
        clash = settled(clash.groupBy("made").agg(F.when(F.count("*") == F.count("first"), F.min("first")).alias("first")))
        if clash.isEmpty():
            break
        marked = clash.withColumn("clashes", F.lit(True)).select("made", "first", "clashes")
        again = state.join(marked, "made", "left")
        state = again.select("entity", "e", (F.col("attempt") + F.when(F.col("clashes") & (F.col("first").isNull() | (F.col("first") != F.col("entity"))), 1).otherwise(0)).alias("attempt")).repartition(tasks, "entity")
    else:
        raise RuntimeError("surrogates still collide")
    retried = settled(state.filter("attempt > 0").select("entity", "attempt"))
    out = docs.withColumn("__e", mentions())
    if retried.isEmpty():
        out = out.withColumn("__tries", F.lit(None).cast("map<string,int>"))
    else:
        tries = found.join(retried, "entity").groupBy("__row").agg(F.map_from_entries(F.collect_set(F.struct("e", "attempt"))).alias("__tries"))
        out = out.withColumn("__row", F.xxhash64(F.col(id_col), source)).join(tries, "__row", "left").drop("__row")
    attempt = lambda e: F.coalesce(F.element_at(F.col("__tries"), e), F.lit(0))
    new = F.transform(F.col("__e"), lambda e: surrogate(e, key, attempt(e)))
    joined = F.array_join(F.zip_with(F.split(source, ENTITY, -1), new, lambda gap, s: F.concat(gap, F.coalesce(s, F.lit("")))), "")
    out = out.withColumn("n_entities", F.coalesce(F.size("__e"), F.lit(0)).cast("long")).withColumn(text, F.when(F.size("__e") > 0, joined).otherwise(source))
    out = out.withColumn("n_entities", F.greatest(F.col("n_entities"), F.lit(0)).cast("long"))
    return out.drop("__e", "__tries")
