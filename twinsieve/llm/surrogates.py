"""Personal data replaced by keyed surrogates, in DataFrame operations alone.

Found are e-mail addresses, telephone numbers, IP addresses, payment card, social
security and bank account numbers, access keys, assigned secrets (token = "...") and
names behind a title. A match is taken apart into parts that may return elsewhere: the
local part and the domain of an address, the digits of a number, each name.

Every distinct part (kind, normal form) gets one surrogate, a function of the key, the
kind and the part alone: the same part gets the same surrogate in every text, however it
is written. Surrogates are of the part's kind: digits for digits and letters for letters
of either case, hexadecimal stays hexadecimal, octets stay octets, a card number keeps
its first digit and whether its check digit is right, names keep script, case and the
gender that the title gives. Candidates are checked for collisions: no two parts of a
kind share a surrogate, and no surrogate is itself a part found in the table. A part that
collides tries again with the next number; the least part keeps the surrogate it shares.
Local parts, domains, secrets and telephone numbers that still collide after eight attempts
get longer, a character every four attempts, as short ones have few values; names do too.

Defined cases: null text stays null, empty text empty; texts without a match pass
unchanged; repeated rows and rows with null ids are treated like others; an empty table
gives no rows. Other columns pass through, whatever their names. Names that no title goes
before anywhere in their text are not recognised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tune

#: Titles, with the gender that they give.
TITLES = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "κύριος", "κύριο"],
    "f": ["Mrs", "Ms", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа", "κυρία"],
    "n": ["Dr", "Prof"],
}
_TITLE = "|".join(sorted((t for own in TITLES.values() for t in own), key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Kind -> pattern, tried in this order.
PATTERNS = {
    "secret": r"""\b(?i:password|passwd|token|secret|api[_-]?key)["']?\s{0,2}[=:]\s{0,2}["']?[A-Za-z0-9_/+-]{8,}""",
    "email": r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]*[A-Za-z0-9])+",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z]{4})?(?: ?\d{4}){2,6}(?: ?\d{1,3})?\b",
    "key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}[.-]\d{3}[.-]\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "ip": rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b",
    "ip6": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b",
    "card": r"\b(?:\d{4}[ -]){3}\d{1,7}\b|\b[3-6]\d{12,18}\b",
    "name": rf"\b(?U:\b)(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Sounds that names are made of, by script: first sounds, vowels, and endings by gender or for families.
SOUNDS = {
    "latin": ("b d f g h j k l m n p r s t v w".split(), "a e i o u".split(), {"m": "n s rd k rt l".split(), "f": "na lia ra sa ne tta".split(), "n": "n s ra l ne m".split(), "family": "man son er ley dt ner".split()}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а е и о у".split(), {"m": "н р й с л м".split(), "f": "на ля ра са ня та".split(), "n": "н р й ля ра с".split(), "family": "ко ук ец ых дзе ян".split()}),
    "greek": ("β γ δ ζ θ κ λ μ ν ξ π ρ σ τ φ χ".split(), "α ε η ι ο".split(), {"m": "ος ης ας ων ις ιος".split(), "f": "να λια ρα σα νη τα".split(), "n": "ος να ης ρα ας τα".split(), "family": "ίδης άκης όπουλος ίου άτος έας".split()}),
}
ATTEMPTS = 40


def kind_of(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def parts_of(kind: Column, match: Column) -> Column:
    """A match as an array of (kind, as written, normal form); null kinds stay as they are."""

    def part(name: Column | None, written: Column, normal: Column | None = None) -> Column:
        name = F.lit(None).cast("string") if name is None else name
        return F.struct(name.alias("kind"), written.alias("written"), F.coalesce(normal, written).alias("normal") if normal is not None else written.alias("normal"))

    digits = F.regexp_replace(match, r"[^0-9]", "")
    value = F.regexp_extract(match, r"[A-Za-z0-9_/+-]{8,}$", 0)
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    title = F.regexp_extract(match, rf"^(?:{_TITLE})\.?", 0)
    gender = F.lit("n")
    for g in ("m", "f"):
        gender = F.when(F.rtrim(F.regexp_replace(title, r"\.$", "")).isin(TITLES[g]), g).otherwise(gender)
    names = F.split(match.substr(F.length(title) + 2, F.length(match)), " ")

    def of_name(name: Column, k: Column) -> Column:
        script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        role = F.when(k == F.size(names) - 1, "family").otherwise(gender)
        return F.array(part(None, F.lit(" ")), part(F.concat(F.lit("name-"), script, F.lit("-"), role), name, F.lower(name)))

    return (
        F.when(kind == "email", F.array(part(F.lit("local"), local, F.lower(local)), part(None, F.lit("@")), part(F.lit("domain"), domain, F.lower(domain))))
        .when(kind == "secret", F.array(part(None, match.substr(F.lit(1), F.length(match) - F.length(value))), part(F.lit("secret"), value)))
        .when(kind == "name", F.concat(F.array(part(None, title)), F.flatten(F.transform(names, of_name))))
        .when(kind.isin("phone", "card", "ssn"), F.array(part(kind, match, digits)))
        .when(kind == "iban", F.array(part(kind, match, F.regexp_replace(match, " ", ""))))
        .when(kind == "ip6", F.array(part(kind, match, F.lower(match))))
        .otherwise(F.array(part(kind, match)))
    )


def _luhn(digits: Column, n: Column, start: int) -> Column:
    """Sum of the check of card numbers, over the digits from the start-th from the right."""

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, double).otherwise(d)

    return F.aggregate(F.sequence(F.lit(start), n), F.lit(0), add)


def surrogate(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """The attempt-th candidate for a part: a function of key, kind, part and attempt."""
    n = F.length(normal)
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(16)) + ATTEMPTS // 4) / 64).cast("int")), lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, normal, attempt.cast("string"), b.cast("string")), 512)), "")
    byte = lambda i: F.conv(stream.substr(2 * i + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda chars, i: F.lit(chars).substr(1 + byte(i) % len(chars), F.lit(1))
    hexadecimal = normal.rlike("^[0-9a-f:]+$") & kind.isin("secret", "ip6")

    def shaped(i: Column) -> Column:
        c = normal.substr(i + 1, F.lit(1))
        return (
            F.when((c == "0") | ((c >= "1") & (c <= "9") & (i > 0)), pick("0123456789", i))
            .when((c >= "1") & (c <= "9"), pick("123456789", i))
            .when((c >= "a") & (c <= "z"), F.when(hexadecimal, pick("abcdef", i)).otherwise(pick("abcdefghijklmnopqrstuvwxyz", i)))
            .when((c >= "A") & (c <= "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
            .otherwise(c)
        )

    plain = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), shaped), "")
    # what says of which sort a value is stays: the first digit of a card, the country of an account, the prefix of a key, the last label of a domain
    lead = F.when(kind == "card", 1).when(kind == "iban", 2).when(kind == "key", 4).otherwise(0)
    made = F.concat(normal.substr(F.lit(1), lead), plain.substr(lead + 1, n))
    tail = F.when(kind == "domain", F.length(F.substring_index(normal, ".", -1)) + 1).otherwise(0)
    longer = F.greatest(F.floor(attempt / 4).cast("int") - 1, F.lit(0))
    extra = lambda i: F.when(kind == "phone", pick("0123456789", i)).when(hexadecimal, pick("0123456789abcdef", i)).otherwise(pick("abcdefghijklmnopqrstuvwxyz0123456789", i))
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(longer, F.lit(1))), lambda k: extra(n + k - 1)), "")
    more = F.when(kind.isin("local", "domain", "secret", "phone") & (longer > 0), more).otherwise("")
    made = F.concat(made.substr(F.lit(1), n - tail), more, normal.substr(n - tail + 1, tail))
    body = made.substr(F.lit(1), n - 1)
    check = F.pmod(_luhn(normal, n, 1) - _luhn(F.concat(body, F.lit("0")), n, 2), F.lit(10)).cast("string")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (1 + byte(i) % 254).cast("string")), ".")

    def syllables(sounds: Column) -> Column:
        """Two, and one more for every eight attempts."""
        count = F.sequence(F.lit(0), 1 + F.floor(attempt / 8).cast("int"))
        return F.array_join(F.transform(count, lambda i: F.get(sounds, byte(i) % F.size(sounds))), "")

    out = F.when(kind == "card", F.concat(body, check)).when(kind == "ip", octets)
    for script, (first, vowels, endings) in SOUNDS.items():
        sounds = F.array(*[F.lit(a + b) for a in first for b in vowels])
        for role, last in endings.items():
            name = F.initcap(F.concat(syllables(sounds), F.get(F.array(*map(F.lit, last)), byte(F.lit(15)) % len(last))))
            out = out.when(kind == f"name-{script}-{role}", name)
    return out.otherwise(made)


def written_as(kind: Column, written: Column, made: Column) -> Column:
    """A surrogate in the format of the part: separators of numbers, capitals of names."""
    spaced = kind.isin("phone", "card", "ssn", "iban")

    def fill(state: Column, c: Column) -> Column:
        takes = c.rlike("[0-9A-Za-z]")
        return F.struct(F.when(takes, state["i"] + 1).otherwise(state["i"]).alias("i"), F.concat(state["out"], F.when(takes, made.substr(state["i"], F.lit(1))).otherwise(c)).alias("out"))

    filled = F.aggregate(F.filter(F.split(written, ""), lambda c: c != ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), fill)
    filled = F.concat(filled["out"], made.substr(filled["i"], F.length(made)))
    shout = kind.startswith("name-") & (F.length(written) > 1) & (written == F.upper(written))
    return F.when(kind.isNull(), written).when(spaced, filled).when(shout, F.upper(made)).otherwise(made)


def assign(parts: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """Distinct parts(kind, normal) -> (kind, normal, made), one to one within each kind and apart from all parts."""
    waiting, settled = parts, None
    for attempt in range(ATTEMPTS):
        made = waiting.withColumn("made", surrogate(key, F.col("kind"), F.col("normal"), F.lit(attempt)))
        taken = parts.select("kind", F.col("normal").alias("made")) if settled is None else parts.select("kind", F.col("normal").alias("made")).unionByName(settled.select("kind", "made"))
        free = made.join(taken.distinct().withColumn("taken", F.lit(True)), ["kind", "made"], "left")
        nth = F.row_number().over(Window.partitionBy("kind", "made", "taken").orderBy("normal"))
        free = scratch.write(free.withColumn("ok", F.col("taken").isNull() & (nth == 1)).select("kind", "normal", "made", "ok"))
        good = free.where("ok").drop("ok")
        settled = good if settled is None else settled.unionByName(good)
        waiting = free.where("not ok").select("kind", "normal")
        if waiting.isEmpty():
            return settled
    raise RuntimeError(f"parts still collide after {ATTEMPTS} attempts")


def _again(piece: Column, names: Column) -> Column:
    """Text between matches, with the names found in the document replaced as whole words."""
    edge = F.lit(r"(?<![\p{L}\p{N}_])\Q")
    return F.aggregate(names, piece, lambda t, n: F.regexp_replace(t, F.concat(edge, n["written"], F.lit(r"\E(?![\p{L}\p{N}_])")), n["to"]))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, and _entities: how many matches were replaced.

    A name that was found behind a title is also replaced where it stands without one in
    the same text; that adds nothing to _entities. A column of docs called _entities is
    replaced.
    """
    spark = tune(docs.sparkSession)
    scratch = Scratch(spark)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    text = F.col("text")
    holds = F.coalesce(text.rlike(PATTERN), F.lit(False))
    hit = rows.where(holds).withColumn("nth", F.monotonically_increasing_id()).withColumn("found", F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    hit = scratch.write(hit)

    found = hit.select("nth", F.posexplode("found").alias("at", "match"))
    matches = found.select("match").distinct().withColumn("kind", kind_of(F.col("match")))
    matches = scratch.write(matches.select("match", F.posexplode(parts_of(F.col("kind"), F.col("match"))).alias("k", "part")).select("match", "k", "part.*"))
    made = assign(matches.where("kind is not null").select("kind", "normal").distinct(), key, scratch)
    whole = matches.join(made, ["kind", "normal"], "left").select("match", F.struct("k", "kind", "written", written_as(F.col("kind"), F.col("written"), F.col("made")).alias("to")).alias("p"))
    whole = whole.groupBy("match").agg(F.array_sort(F.collect_list("p")).alias("p"))
    names = F.transform(F.filter("p", lambda p: p["kind"].startswith("name-")), lambda p: F.struct(p["written"].alias("written"), p["to"].alias("to")))
    whole = whole.select("match", F.array_join(F.transform("p", lambda p: p["to"]), "").alias("to"), names.alias("names"))
    swapped = found.join(whole, "match").groupBy("nth").agg(F.array_sort(F.collect_list(F.struct("at", "to"))).alias("to"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
    between = F.split(text, PATTERN, -1)
    joined = F.array_join(F.zip_with(between, F.col("to"), lambda a, b: F.concat(F.when(F.size("names") > 0, _again(a, F.col("names"))).otherwise(a), F.coalesce(b["to"], F.lit("")))), "")
    done = hit.join(swapped, "nth").select(F.col("row").withField(text_col, joined).alias("row"), F.size("to").cast("long").alias("n"))
    both = rows.where(~holds).select("row", F.lit(0).cast("long").alias("n")).unionByName(done)
    return both.select(*(F.col("row")[c].alias(c) for c in docs.columns if c != "_entities"), F.col("n").alias("_entities"))
