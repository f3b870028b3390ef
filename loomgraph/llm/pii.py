"""Surrogates for personal data (op6), by DataFrame functions only.

Entities are found by one pattern and replaced by keyed surrogates of the same kind: the same value gets the same surrogate
everywhere, different values get different ones. A value is keyed in a canonical form (mail addresses in small letters; phone and
card numbers as digits, phones without their country code), so its spellings go together, and the surrogate is put into the
spelling found. Letters, digits and hexadecimal digits are enciphered in place by a Feistel network (every other character is
shifted by a keyed hash of the others, in turns), which keeps length, case, signs and kind and maps the values of one form one to
one. Fixed parts stay: a phone's country code, the end of a mail domain, a key's prefix, a card's first digit. Long numbers are
cards only with a right check digit, and get one; an IPv4 address stays one.

A name after a title is replaced word by word in its script, so a name, its short form and its other titles go together. The
first names have the gender that the name is known for, whatever the title; others get names that tell none.

One-to-one holds by construction but for names and mail addresses that come out as they were. Names' words and addresses are
checked over all documents: a surrogate that two of them share, or that is itself one of them, is drawn again under another key,
from a space that grows with each try, until none is left. All spellings of a value share the outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PRE, materialise, sized, table

_EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_IP = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)"
_SSN = r"\d{3}-\d{2}-\d{4}(?!-?\d)"
_CARD = r"(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7})(?!\d)"
_PHONE = r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![.-]?\d)"
_KEY = r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[opsur]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
_HEX = r"[0-9a-f]{32,128}(?![A-Za-z0-9])"
_FEMALE, _MALE, _ANY = r"(?:Mrs|Ms|Miss|Frau|Mme|Madame|Sra|Señora)\.?", r"(?:Mr|Mister|Herr|Monsieur|Sr|Señor)\.?", r"(?:Dr|Prof)\."
_WORD = r"[\p{Lu}\p{Lt}\p{Lo}][\p{L}\p{M}'-]*+"
_NAME = rf"(?:{_FEMALE}|{_MALE}|{_ANY}) {_WORD}(?: {_WORD}){{0,2}}"
KINDS = {"email": _EMAIL, "ip": _IP, "ssn": _SSN, "card": _CARD, "phone": _PHONE, "key": _KEY, "hex": _HEX, "name": _NAME}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"
# First names that are known for a gender; syllables of surrogate names by script, and endings of first names.
KNOWN_FIRST = {
    "f": "Ada Alice Amy Anna Barbara Clara Edith Elizabeth Emily Emma Eva Flora Grace Greta Hannah Helen Irma Jane Julia Karin Laura Linda Lisa Lucy Lydia Maria Marta Mary Nora Olivia Patricia Rosa Ruth Sandra Sarah Sofia Susan Анна Вера Дарья Елена Зоя Ирина Мария Нина Ольга Άννα Ελένη Μαρία Σοφία",
    "m": "Adam Alan Bruno Carl Charles Daniel David Edward Emil Felix Frank Georg George Henry Hugo Ivan Jack James John Jonas Joseph Karl Leo Mark Martin Max Michael Oliver Oscar Paul Peter Richard Robert Simon Thomas Victor Walter William Антон Борис Виктор Иван Олег Павел Сергей Γιώργος Νίκος Πέτρος",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se ta te to va",
    "cyrillic": "ба ве го да жи зе ки ло ма не по ра со ти ву хо",
    "greek": "βα γε δο ζα θε κα λι μο νε πα ρι σο τα φε χο ψα",
    "han": "安 白 晨 德 恩 方 光 海 和 佳 嘉 杰 静 可 乐 林 明 宁 平 青 如 思 天 文 新 雅 一 永 雨 子",
    "hangul": "가 나 다 라 마 바 사 아 자 하 고 노 도 로 모 보 소 오 조 호",
    "kana": "か き く さ し た ち な に の は ひ ま み も や ら り わ と",
    "arabic": "با تا جا دا را سا شا طا فا كا لا ما نا ها وا يا",
    "hebrew": "בא גל דן הר זו טל יע כר לי מו נע סה פר צו קד רם",
    "devanagari": "का गा जा ता दा ना पा बा मा या रा ला वा शा सा हा",
}
ENDINGS = {"latin": {"f": "lia", "m": "rus", "n": "ly"}, "cyrillic": {"f": "ла", "m": "рис", "n": "ли"}, "greek": {"f": "λα", "m": "ρος", "n": "λι"}}
SCRIPTS = {"cyrillic": "IsCyrillic", "greek": "IsGreek", "han": "IsHan", "hangul": "IsHangul", "kana": "IsHiragana}\\p{IsKatakana", "arabic": "IsArabic", "hebrew": "IsHebrew", "devanagari": "IsDevanagari"}


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shift(c: Column, k: Column, hexadecimal: bool) -> Column:
    def turn(first: str, n: int) -> Column:
        return F.char(F.lit(ord(first)) + (F.ascii(c) - ord(first) + k) % n)

    if hexadecimal:
        digits = "0123456789abcdef"
        return F.substr(F.lit(digits), (F.instr(F.lit(digits), c) - 1 + k) % 16 + 1, F.lit(1))
    out = F.when(c.between("0", "9"), turn("0", 10)).when(c.between("a", "z"), turn("a", 26)).when(c.between("A", "Z"), turn("A", 26))
    return out.otherwise(c)


def encipher(text: Column, key: Column, hexadecimal: bool = False) -> Column:
    """Letters and digits of `text` enciphered one to one among the texts of its form, under `key`. One sign alone is shifted."""

    def step(acc: Column, r: Column) -> Column:
        others = F.array_join(F.filter(acc, lambda _, i: i % 2 != r % 2), "")
        h = F.sha2(F.concat(key, F.lit("|"), r.cast("string"), F.lit("|"), others), 256)
        return _let(h, lambda hh: F.transform(acc, lambda c, i: F.when(i % 2 == r % 2, _shift(c, _byte(hh, i), hexadecimal)).otherwise(c)))

    rounds = F.array(*[F.lit(i) for i in range(6)])
    return F.array_join(F.aggregate(rounds, F.split(text, ""), step), "")


def _address(ip: Column, key: Column) -> Column:
    parts = F.split(ip, r"\.")
    start = F.struct(
        (parts[0].cast("int") * 256 + parts[1].cast("int")).alias("a"), (parts[2].cast("int") * 256 + parts[3].cast("int")).alias("b")
    )

    def step(acc: Column, r: Column) -> Column:
        h = F.conv(F.left(F.sha2(F.concat(key, r.cast("string"), F.lit("|"), acc["b"].cast("string")), 256), F.lit(4)), 16, 10).cast("int")
        return F.struct(acc["b"].alias("a"), acc["a"].bitwiseXOR(h).alias("b"))

    def text(x: Column) -> Column:
        octets = [F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256]
        return F.concat_ws(".", *[o.cast("string") for o in octets])

    return _let(F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, step), text)


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    marks = F.transform(
        F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int")
    )
    return (F.lit(10) - F.aggregate(marks, F.lit(0), lambda a, x: a + x) % 10) % 10


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def is_card(e: Column) -> Column:
    """Whether the last digit is the check digit of those before it."""
    return _let(digits_of(e), lambda d: _luhn(F.left(d, F.length(d) - 1)) == F.right(d, F.lit(1)).cast("int"))


def woven(digits: Column, form: Column) -> Column:
    """form with its digits replaced, in turn, by these."""
    before = lambda i: F.length(digits_of(F.substr(form, F.lit(1), i)))
    return F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c.between("0", "9"), F.substr(digits, before(i) + 1, F.lit(1))).otherwise(c)), "")


def _card(card: Column, key: Column) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.left(d, F.lit(1)), encipher(F.substr(d, F.lit(2), F.length(d) - 2), key))
        return _let(body, lambda n: F.concat(n, _luhn(n).cast("string")))

    return _let(digits_of(card), lambda d: _let(new(d), lambda n: woven(n, card)))


def _phone(phone: Column, key: Column) -> Column:
    # the country code stays: what stands before a sign, or the 1 of a number with eleven digits
    split = r"^(\+1(?=[ .(-]|\d{10}$)|\+\d{1,3}(?=[ .(-])|\+\d|)(.*)$"
    code, rest = F.regexp_extract(phone, split, 1), F.regexp_extract(phone, split, 2)
    return F.concat(code, _let(encipher(digits_of(rest), key), lambda d: woven(d, rest)))


def _mail(mail: Column, key: Column, attempt: Column) -> Column:
    """By the small letters, in the capitals found; tries after the second put letters before the address, more with each."""
    split = r"^(.*)(\.[A-Za-z]{2,})$"
    part, end = F.regexp_extract(mail, split, 1), F.regexp_extract(mail, split, 2)
    more = F.translate(F.left(F.sha2(F.concat(key, F.lower(mail)), 256), F.least(F.lit(40), F.greatest(F.lit(0), attempt - 1) * 2)), "0123456789", "ghijklmnop")
    same = F.zip_with(F.split(encipher(F.lower(part), key), ""), F.split(part, ""), lambda e, c: F.when(c.between("A", "Z"), F.upper(e)).otherwise(e))
    return F.concat(more, F.array_join(same, ""), end)


def _script(w: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, block in SCRIPTS.items():
        out = out.when(w.rlike(rf"[\p{{{block}}}]"), name)
    return out.otherwise("latin")


def name_word(w: Column, role: Column, secret: str, attempt: Column) -> Column:
    """The surrogate of a word of a name: role 'first' (an ending tells the gender that the word is known for) or 'family'."""
    known = F.create_map(*[x for g, names in KNOWN_FIRST.items() for n in names.split() for x in (F.lit(n), F.lit(g))])
    gender = F.coalesce(F.element_at(known, w), F.lit("n"))
    number = F.conv(F.left(F.sha2(F.concat(F.lit(f"{secret}|name|"), role, F.lit("|"), attempt.cast("string"), F.lit("|"), w), 256), F.lit(15)), 16, 10).cast("long")
    lists = F.create_map(*[x for k, v in SYLLABLES.items() for x in (F.lit(k), F.split(F.lit(v), " "))])
    ends = F.create_map(*[x for k, v in ENDINGS.items() for g, e in v.items() for x in (F.lit(k + g), F.lit(e))])

    def make(script: Column) -> Column:
        count = F.when(script.isin("latin", "cyrillic", "greek"), F.when(role == "family", 4).otherwise(3)).otherwise(2) + attempt

        def spell(x: Column) -> Column:
            parts = F.element_at(lists, script)
            step = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.element_at(parts, (F.pmod(F.xxhash64(x, i), F.size(parts)) + 1).cast("int")))
            return F.concat(F.array_join(step, ""), F.when(role == "first", F.coalesce(F.element_at(ends, F.concat(script, gender)), F.lit(""))).otherwise(F.lit("")))

        return F.initcap(_let(number, spell))

    return _let(_script(w), make)


def _name_words(name: Column) -> Column:
    """array<struct<role, unit>> of the words after the title: the last one is the family name."""
    words = F.split(F.substr(name, F.length(F.substring_index(name, " ", 1)) + 2), " ")
    return _let(words, lambda ws: F.transform(ws, lambda w, i: F.struct(F.when(i + 1 == F.size(ws), "family").otherwise("first").alias("role"), w.alias("unit"))))


def _is(e: Column, kind: str) -> Column:
    return e.rlike(f"^(?:{KINDS[kind]})$")


def surrogate(e: Column, secret: str, attempts: Column | None = None) -> Column:
    """The surrogate of an entity found by PATTERN; attempts: map of `role|unit` to the try that counts, where not the first."""
    key = lambda kind: F.lit(f"{secret}|{kind}")
    tries = (lambda role, unit: F.coalesce(F.element_at(attempts, F.concat(role, F.lit("|"), unit)), F.lit(0))) if attempts is not None else (lambda role, unit: F.lit(0))
    prefix = r"^(AKIA|ASIA|gh[opsur]_|sk-)(.*)$"
    part = lambda i: F.regexp_extract(e, prefix, i)
    mail = _let(tries(F.lit("mail"), F.lower(e)), lambda n: _mail(e, F.concat(key("mail|"), n.cast("string")), n))
    name = F.concat(F.substring_index(e, " ", 1), F.lit(" "), F.array_join(F.transform(_name_words(e), lambda x: name_word(x["unit"], x["role"], secret, tries(x["role"], x["unit"]))), " "))
    return (
        F.when(F.contains(e, F.lit("@")), mail)
        .when(_is(e, "ip"), _address(e, key("ip")))
        .when(_is(e, "ssn"), encipher(e, key("ssn")))
        .when(_is(e, "card"), F.when(is_card(e), _card(e, key("card"))).otherwise(e))
        .when(_is(e, "key"), F.concat(part(1), encipher(part(2), key("key"))))
        .when(_is(e, "hex"), encipher(e, key("hex"), True))
        .when(_is(e, "name"), name)
        .otherwise(_phone(e, key("phone")))
    )


def units(entities: DataFrame) -> DataFrame:
    """(key, role, unit) of what is checked for collisions: mail addresses in small letters and the words of names."""
    e = F.col("entity")
    of = F.when(F.contains(e, F.lit("@")), F.array(F.struct(F.lit("mail").alias("role"), F.lower(e).alias("unit")))).when(_is(e, "name"), _name_words(e))
    return entities.select("key", F.explode(of).alias("x")).select("key", "x.*")


def repaired(found: DataFrame, secret: str) -> DataFrame:
    """(role, unit, attempt) of the units whose first surrogate was another's too, is itself a unit found, or is the unit."""

    def drawn(df: DataFrame) -> DataFrame:
        unit, n = F.col("unit"), F.col("attempt")
        mail = _mail(unit, F.concat(F.lit(f"{secret}|mail|"), n.cast("string")), n)
        return df.withColumn("surrogate", F.when(F.col("role") == "mail", mail).otherwise(name_word(unit, F.col("role"), secret, n)))

    now = materialise(drawn(found.select("role", "unit").distinct().withColumn("attempt", F.lit(0))), "units")
    while True:
        twice = now.groupBy("role", "surrogate").agg(F.min("unit").alias("first"), F.count("*").alias("n")).filter("n > 1")
        shared = now.join(twice, ["role", "surrogate"]).filter("unit <> first").select("role", "unit")
        real = now.join(now.select("role", F.col("unit").alias("surrogate")), ["role", "surrogate"], "left_semi").select("role", "unit")
        bad = materialise(shared.union(real).distinct().withColumn("again", F.lit(True)), "collisions")
        n = bad.count()
        if not n:
            return now.filter("attempt > 0").select("role", "unit", "attempt")
        joined = now.join(sized(bad, n, 80), ["role", "unit"], "left")
        kept = joined.filter("again is null").select("role", "unit", "attempt", "surrogate")
        more = drawn(joined.filter("again").select("role", "unit", (F.col("attempt") + 1).alias("attempt")))
        now = materialise(kept.unionByName(more), "units")


def pseudonymise(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with surrogates in `text`, plus n_entities (int). Null texts stay null, with 0; texts without entities stay as they are.

    One value has one surrogate in all rows, whatever their keys; keys may be null or repeated; other columns stay. Collisions
    are looked for over all rows; where one was found, the rows that hold it (by key) get its repaired surrogate. Names are found
    after titles only. Addresses, numbers and keys are mapped one to one, so none of them is drawn again; one may by chance be
    its own surrogate, as rarely as its form has values.
    """
    if "n_entities" in docs.columns:
        raise ValueError("docs already has n_entities")
    found = F.coalesce(F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    rows = materialise(units(docs.select(F.col(key).alias("key"), F.explode(F.array_distinct(found)).alias("entity"))), "found")
    fixed = repaired(rows, secret)
    n = fixed.count()
    own = docs.withColumn(f"{PRE}e", found)
    if n:
        pair = F.struct(F.concat("role", F.lit("|"), "unit"), "attempt")
        by_row = rows.join(sized(fixed, n, 100), ["role", "unit"]).groupBy("key").agg(F.map_from_entries(F.collect_set(pair)).alias(f"{PRE}m"))
        by_row = materialise(by_row.withColumnRenamed("key", f"{PRE}k"), "fixes")
        own = own.join(sized(by_row, by_row.count(), 400), F.col(key).eqNullSafe(F.col(f"{PRE}k")), "left").drop(f"{PRE}k")
        plain = lambda e: surrogate(e, secret)
        new = lambda e: F.when(F.col(f"{PRE}m").isNull(), plain(e)).otherwise(surrogate(e, secret, F.col(f"{PRE}m")))
    else:
        new = lambda e: surrogate(e, secret)
    gaps = F.split(F.col(text), PATTERN)
    joined = F.array_join(F.concat(F.zip_with(F.slice(gaps, 1, F.size(f"{PRE}e")), f"{PRE}e", lambda g, e: F.concat(g, new(e))), F.array(F.element_at(gaps, -1))), "")
    out = F.when(F.size(f"{PRE}e") > 0, joined).otherwise(F.col(text))
    real = F.filter(f"{PRE}e", lambda e: ~_is(e, "card") | is_card(e))
    return own.withColumn("n_entities", F.size(real)).withColumn(text, out).select(*docs.columns, "n_entities")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, "loomgraph-surrogates")
