"""Keyed surrogates for personal data, with DataFrame and SQL functions only.

Detected entities are taken apart into atoms (an address into its local part and
domain, a person into title, given name and surname) and every distinct atom of
the whole corpus gets one surrogate: drawn from a keyed hash of its type and
normal form, of the same type, script, gender and format.

Coreference: equal atoms get equal surrogates wherever they stand, in any case
or spacing.  Distinctness: a draw that another atom of its type has, or that is
itself an atom of the corpus, is refused and the atom draws again with the next
attempt, until every atom has a surrogate of its own.  After some refused draws
the format gives way: values get one character longer with each attempt, so that
their space outgrows any number of atoms.

Only the distinct atoms take part in drawing.  Texts without an entity are never
shuffled; those with one meet their surrogates by a hash of the row.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.plans.joins import cut_lineage

KEY = "set a key of your own"
# Draws in the length of the original; later ones are longer.
SAME_LENGTH = 8

# Forms of address and given names by gender.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sir", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Lady", "Госпожа", "Κυρία"],
    "x": ["Dr", "Prof", "Mx"],
}
GIVEN = {
    "m": ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles",
          "Daniel", "Matthew", "Peter", "Hans", "Klaus", "Jürgen", "Pierre", "Jacques", "François",
          "José", "Carlos", "Miguel", "Javier", "Иван", "Сергей", "Дмитрий", "Александр", "Γιώργος", "Νίκος"],
    "f": ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah",
          "Karen", "Emily", "Sabine", "Ursula", "Brigitte", "Françoise", "Camille", "Amélie", "María",
          "Carmen", "Lucía", "Isabel", "Анна", "Мария", "Ольга", "Наталья", "Ελένη", "Μαρία"],
}
# Syllables and endings of surrogate names by script.
SYLLABLES = {
    "latin": "ba be bi bo ca da de do fa fe ga ge ha he jo ka ke ko la le li lo lu ma me mi mo na ne ni no pa pe ra re ri ro sa se so ta te ti to va ve vi wa za".split(),
    "cyrillic": "ба бо ва ве го да ди жа за зо ка ко ла ле ли лу ма ми на не по ра ре са се та то фа".split(),
    "greek": "βα γα δα δη κα κο λα λε μα μη να νι πα ρα ρο σα σο τα τη φα".split(),
}
ENDINGS = {
    "latin": {"m": ["rt", "n", "rd", "s"], "f": ["na", "lla", "ria", "tte"], "x": ["r", "ne", "l", "m"], "s": ["son", "ler", "mann", "dez", "rand"]},
    "cyrillic": {"m": ["н", "р", "й", "слав"], "f": ["на", "рия", "са", "ля"], "x": ["ня", "ша"], "s": ["нов", "лин", "ров", "шев"]},
    "greek": {"m": ["νος", "λης", "ρος"], "f": ["νη", "λια", "ρα"], "x": ["νι", "λι"], "s": ["δης", "πουλος", "κης"]},
}
DIGITS = "0123456789"
LETTERS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω",
}

_NAME = r"\p{Lu}[\p{L}'’-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}_%+-]*+(?:\.[\p{L}\p{N}_%+-]++)*+@(?:[\p{L}\p{N}][\p{L}\p{N}-]*+\.)+\p{L}{2,}",
    "secret": r"(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16})(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<!\d\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "card": r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "person": (
        "(?:(?:" + "|".join(t for ts in TITLES.values() for t in ts) + rf")\.? {_NAME}(?: {_NAME}){{0,2}}"
        "|(?:" + "|".join(g for gs in GIVEN.values() for g in gs) + rf")(?: {_NAME}){{1,2}})"
    ),
}
_PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)"
ENTITY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(PATTERNS.values()) + ")|" + _PHONE


def _kind(m: Column) -> Column:
    """Type of a match: the first pattern that is all of it."""
    kind = F.when(m.contains("@"), "email")
    for name in ("secret", "iban", "ip", "card", "ssn"):
        kind = kind.when(m.rlike(f"^(?:{PATTERNS[name]})$"), name)
    return kind.when(m.rlike(r"^[+(\d]"), "phone").otherwise("person")


def _script(value: Column) -> Column:
    return (
        F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic")
        .when(value.rlike(r"\p{IsGreek}"), "greek")
        .otherwise("latin")
    )


def _gender(words: Column) -> Column:
    """Gender of a person's words, from the given name, else from the title."""
    found = F.lit(None).cast("string")
    for table in (GIVEN, TITLES):
        one = F.lit(None).cast("string")
        for gender in ("m", "f"):
            known = F.array(*map(F.lit, table.get(gender, [])))
            bare = F.transform(words, lambda w: F.rtrim(F.regexp_replace(w, r"\.$", "")))
            one = F.coalesce(one, F.when(F.arrays_overlap(bare, known), gender))
        found = F.coalesce(found, one)
    return F.coalesce(found, F.lit("x"))


def _atoms(match: Column) -> Column:
    """Atoms (kind, class, original) of a match, in order."""
    kind = _kind(match)
    words = F.split(match, " ")
    titles = F.array(*[F.lit(t) for ts in TITLES.values() for t in ts])
    title = F.array_contains(titles, F.regexp_replace(words[0], r"\.$", ""))
    plain = F.lit("").alias("class")

    def atom(k: Column | str, c: Column, o: Column) -> Column:
        k = F.lit(k) if isinstance(k, str) else k
        return F.struct(k.alias("kind"), c.alias("class"), o.alias("original"))

    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    mail = F.array(atom("local", F.lower(domain), local), atom("domain", plain, domain))
    names = F.when(title, F.slice(words, 2, F.size(words))).otherwise(words)
    gender = _gender(words)
    parts = F.transform(
        names,
        lambda w, i: atom(
            F.when((i == F.size(names) - 1) & (title | (i > 0)), "surname").otherwise("given"),
            F.concat_ws("/", _script(w), F.when((i == F.size(names) - 1) & (title | (i > 0)), "s").otherwise(gender)),
            w,
        ),
    )
    head = F.when(title, F.array(atom("title", plain, words[0]))).otherwise(F.slice(parts, 1, 0))
    return (
        F.when(kind == "email", mail)
        .when(kind == "person", F.concat(head, parts))
        .otherwise(F.array(atom(kind, plain, match)))
    )


def _normal(kind: Column, original: Column) -> Column:
    """Normal form, equal for all spellings of one atom."""
    digits = F.regexp_replace(original, r"\D", "")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.regexp_extract(original, r"^(\+\d{1,3}|)", 1), F.lit("/"), digits))
        .when(kind == "iban", F.regexp_replace(original, " ", ""))
        .when(kind.isin("title", "secret", "ip"), original)
        .otherwise(F.lower(original))
    )


# -- draws


def _draw(stream: Column, i: Column | int, n: int) -> Column:
    """Number below ``n`` from the i-th four hexadecimal digits of a stream."""
    at = (F.lit(i) if isinstance(i, int) else i) % 120 * 4 + 1
    return (F.conv(F.substring(stream, at, 4), 16, 10).cast("int") % n).cast("int")


def _pick(stream: Column, i, choices: list[str]) -> Column:
    return F.array(*map(F.lit, choices))[_draw(stream, i, len(choices))]


def _spelled(value: Column, stream: Column) -> Column:
    """A value with every digit and letter replaced by one of its kind."""

    def one(c: Column, i: Column) -> Column:
        latin = _pick(stream, i, list(LETTERS["latin"]))
        lower = (
            F.when(c.rlike(r"\p{IsCyrillic}"), _pick(stream, i, list(LETTERS["cyrillic"])))
            .when(c.rlike(r"\p{IsGreek}"), _pick(stream, i, list(LETTERS["greek"])))
            .otherwise(latin)
        )
        return (
            F.when(c.rlike(r"^[0-9]$"), _pick(stream, i, list(DIGITS)))
            .when(c.rlike(r"^\p{Lu}$"), F.upper(lower))
            .when(c.rlike(r"^[\p{L}\p{N}]$"), lower)
            .otherwise(c)
        )

    chars = F.split(value, "")
    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """Check sum of digits that stand before a check digit."""
    each = F.reverse(F.split(digits, ""))
    return F.aggregate(
        F.transform(
            each,
            lambda d, i: F.when(i % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")).cast("int"),
        ),
        F.lit(0),
        lambda s, x: s + x,
    )


def _more(stream: Column, attempt: int) -> Column:
    """Characters that a value is longer by in this attempt: digits after a digit, else letters."""
    def one(j: int) -> Column:
        i, script = F.length("normal") + j, _script(F.col("normal"))
        letter = _pick(stream, i, list(LETTERS["latin"]))
        for name in ("cyrillic", "greek"):
            letter = F.when(script == name, _pick(stream, i, list(LETTERS[name]))).otherwise(letter)
        last = F.when(F.col("kind") == "domain", F.regexp_replace("normal", r"\.[^.]*$", "")).otherwise(F.col("normal"))
        digit = F.col("kind").isin("card", "ssn", "phone", "iban") | last.rlike("[0-9]$")
        return F.when(digit, _pick(stream, i, list(DIGITS))).otherwise(letter)

    return F.concat(F.lit(""), *[one(j) for j in range(attempt - SAME_LENGTH + 1)])


def _card(digits: Column, stream: Column, more: Column) -> Column:
    """The same issuer digit and length but for ``more``; passes the check sum if the original does."""
    drawn = F.concat(F.substring(digits, 1, 1), F.expr("substring(_spelt, 2, length(_spelt) - 2)"), more)
    check = (10 - _luhn(drawn) % 10) % 10
    head = F.expr("substring(normal, 1, length(normal) - 1)")
    valid = (10 - _luhn(head) % 10) % 10 == F.substring(digits, -1, 1).cast("int")
    other = (check + 1 + _draw(stream, 119, 9)) % 10
    return F.concat(drawn, F.when(valid, check).otherwise(other).cast("string"))


def _ip(value: Column, stream: Column, attempt: int) -> Column:
    """An address of the private range for a private one, else a public one.

    Later attempts are public for all, and then longer than an address.
    """
    private = value.rlike(r"^(?:10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
    public = F.array(*[F.lit(n) for n in range(1, 224) if n not in (10, 127, 172, 192)])
    first = F.when(private & F.lit(attempt < SAME_LENGTH), F.lit(10)).otherwise(public[_draw(stream, 0, 219)])
    more = [_draw(stream, 4 + j, 256) for j in range(attempt - 2 * SAME_LENGTH + 1)]
    return F.concat_ws(".", first, _draw(stream, 1, 256), _draw(stream, 2, 256), _draw(stream, 3, 254) + 1, *more)


def _name(kind: Column, group: Column, stream: Column, attempt: int) -> Column:
    """A pronounceable name of the script and gender, longer with every third attempt."""
    out = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        for gender, endings in ENDINGS[script].items():
            count = (3 if gender == "s" else 2) + attempt // 3
            parts = [_pick(stream, i, syllables) for i in range(count)]
            drawn = F.concat(*parts, _pick(stream, 100, endings))
            out = F.coalesce(out, F.when(group == f"{script}/{gender}", drawn))
    # A feminine Slavic surname keeps its ending.
    feminine = (kind == "surname") & F.col("normal").rlike("[ое]ва$|ина$") & out.rlike("[вн]$")
    return F.when(feminine, F.concat(out, F.lit("а"))).otherwise(out)


def _proposals(atoms: DataFrame, key: str, attempt: int) -> DataFrame:
    """``atoms`` with the surrogate that each draws in this attempt."""
    seed = F.concat_ws("\u0001", F.lit(key), "kind", "class", "normal", F.lit(str(attempt)))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\u0001{i}")), 512) for i in range(4)])
    kind, normal, stream_col = F.col("kind"), F.col("normal"), F.col("_stream")
    rows = atoms.withColumn("_stream", stream).withColumn("_spelt", _spelled(normal, stream_col))
    long_stream = F.repeat(stream_col, (F.floor(F.length(normal) / 512) + 1 + attempt).cast("int"))
    code = F.length(F.regexp_extract(normal, r"^\+?(\d*)/", 1))
    number = F.substring_index("_spelt", "/", -1)
    real = F.substring_index("normal", "/", -1)
    tail = F.regexp_extract(normal, r"\.[^.]*$", 0)
    more = _more(stream_col, attempt)
    size = F.length(normal) + max(0, attempt - SAME_LENGTH + 1)
    drawn = (
        F.when(kind == "title", normal)
        .when(kind.isin("given", "surname"), _name(kind, F.col("class"), stream_col, attempt))
        .when(kind == "domain", F.concat(F.expr("substring(_spelt, 1, length(_spelt) - length(regexp_extract(normal, '\\\\.[^.]*$', 0)))"), more, tail))
        .when(kind == "ip", _ip(normal, stream_col, attempt))
        .when(kind == "card", _card(normal, stream_col, more))
        .when(kind == "phone", F.concat(F.substring_index("normal", "/", 1), F.lit("/"), real.substr(F.lit(1), code), number.substr(code + 1, F.length(number)), more))
        .when(kind == "iban", F.concat(F.substring(normal, 1, 2), F.expr("substring(_spelt, 3)"), more))
        .when((kind == "secret") & normal.rlike("^[0-9a-f]+$"), long_stream.substr(F.lit(1), size))
        .when((kind == "secret") & normal.rlike("^[0-9A-F]+$"), F.upper(long_stream.substr(F.lit(1), size)))
        .when(kind == "secret", F.concat(F.substring(normal, 1, 4), F.expr("substring(_spelt, 5)"), more))
        .otherwise(F.concat("_spelt", more))
    )
    return rows.withColumn("surrogate", drawn).drop("_stream", "_spelt")


def draw_surrogates(atoms: DataFrame, key: str) -> DataFrame:
    """(kind, class, normal, surrogate): a surrogate of its own for every distinct atom.

    ``atoms`` is (kind, class, normal), distinct and stored.  Surrogates of local
    parts are distinct within their domain, all others within their kind.
    """
    id_cols = ["kind", "class", "normal"]
    space = F.when(F.col("kind") == "local", F.col("class")).otherwise("")
    titles = atoms.where("kind = 'title'").withColumn("surrogate", F.col("normal"))
    pending = atoms.where("kind <> 'title'")
    real = pending.select("kind", space.alias("space"), F.col("normal").alias("surrogate"))
    done = [titles]
    for attempt in count():  # ends: the space of draws grows with the attempts
        drawn = _proposals(pending, key, attempt).withColumn("space", space)
        free = drawn.join(real, ["kind", "space", "surrogate"], "left_anti")
        for earlier in done[1:]:
            taken = earlier.select("kind", space.alias("space"), "surrogate")
            free = free.join(taken, ["kind", "space", "surrogate"], "left_anti")
        first = free.groupBy("kind", "space", "surrogate").agg(
            F.min(F.struct("normal", "class")).alias("first")
        )
        won = cut_lineage(
            first.select("kind", "first.class", "first.normal", "surrogate").select(*id_cols, "surrogate"),
            "surrogates",
        )
        done.append(won)
        pending = cut_lineage(pending.join(won, id_cols, "left_anti"), "atoms")
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, [d.select(*id_cols, "surrogate") for d in done])


def _shown(kind: Column, original: Column, surrogate: Column) -> Column:
    """A surrogate in the spelling of the original: its case, separators and blanks."""
    bare = F.when(kind == "phone", F.substring_index(surrogate, "/", -1)).otherwise(surrogate)
    alnum = r"[^\p{L}\p{N}]"

    def place(c: Column, i: Column) -> Column:
        nth = F.length(F.regexp_replace(original.substr(F.lit(1), i + 1), alnum, ""))
        return F.when(c.rlike(alnum), c).otherwise(bare.substr(nth, F.lit(1)))

    size = F.length(F.regexp_replace(original, alnum, ""))
    spaced = F.concat(
        F.array_join(F.transform(F.split(original, ""), place), ""), bare.substr(size + 1, F.length(bare))
    )
    title = F.concat(F.upper(F.substring(bare, 1, 1)), F.expr("substring(surrogate, 2)"))
    upper = (original == F.upper(original)) & (F.length(original) > 1)
    return (
        F.when(kind.isin("phone", "card", "ssn", "iban"), spaced)
        .when(kind.isin("given", "surname"), F.when(upper, F.upper(bare)).otherwise(title))
        .when(kind.isin("local", "domain") & (original == F.upper(original)) & (original != F.lower(original)), F.upper(bare))
        .otherwise(bare)
    )


def pseudonymize(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: str = KEY
) -> DataFrame:
    """``docs`` with surrogates for the personal data in their texts, and n_entities.

    Equal atoms have equal surrogates in all documents; different ones of a type
    differ.  All columns come back, the text replaced; a column n_entities in
    ``docs`` is replaced.  Null texts stay null and empty ones empty, both with
    n_entities 0; texts of any length are searched whole.  A null id is a value like
    any other; repeated rows come back as often as they stand; an empty table gives no
    rows.
    """
    held = [c for c in docs.columns if c != "n_entities"]
    spare = next(p for k in range(len(held) + 1) if not any(c.startswith(p := f"_s{k}") for c in held))
    text = F.col(f"`{text_col}`")
    base = docs.select(*[F.col(f"`{c}`") for c in held])
    found = F.coalesce(text.rlike(ENTITY), F.lit(False))
    clean = base.where(~found).withColumn("n_entities", F.lit(0).cast("long"))
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("\u0001"))
    keys = [F.xxhash64(F.lit(n), name, text).alias(f"{spare}{n}") for n in ("a", "b")]
    dirty = base.where(found)
    matches = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))

    atoms = (
        dirty.select(*[k.alias(n) for k, n in zip(keys, ("k1", "k2"), strict=True)], F.posexplode(matches).alias("pos", "match"))
        .select("k1", "k2", "pos", _atoms(F.col("match")).alias("atoms"))
        .select("k1", "k2", "pos", F.size("atoms").alias("parts"), F.posexplode("atoms").alias("sub", "atom"))
        .select("k1", "k2", "pos", "parts", "sub", "atom.kind", "atom.class", "atom.original")
        .withColumn("normal", _normal(F.col("kind"), F.col("original")))
    )
    atoms = cut_lineage(atoms, "atoms")
    distinct = cut_lineage(atoms.select("kind", "class", "normal").distinct(), "atoms")
    known = draw_surrogates(distinct, key)
    shown = atoms.join(known, ["kind", "class", "normal"]).select(
        "k1", "k2", "pos", "sub",
        F.when(F.col("kind") == "domain", "@").when(F.col("sub") > 0, " ").otherwise("").alias("glue"),
        _shown(F.col("kind"), F.col("original"), F.col("surrogate")).alias("piece"),
        (F.col("sub") == F.col("parts") - 1).alias("last"),
    )
    # Rows alike in id and text give the same pieces, so a set holds each once.
    pieces = F.array_sort(F.collect_set(F.struct("pos", "sub", "glue", "piece", "last")))
    replaced = shown.groupBy("k1", "k2").agg(pieces.alias("pieces")).select(
        F.col("k1").alias(f"{spare}a"), F.col("k2").alias(f"{spare}b"),
        F.col("pieces").alias(f"{spare}p"),
    )
    joined = dirty.select("*", *keys).join(replaced, [f"{spare}a", f"{spare}b"])
    joined = joined.withColumn(f"{spare}t", F.split(text, ENTITY, -1))
    between, parts = F.col(f"{spare}t"), F.col(f"{spare}p")
    tail = lambda p: F.when(p["last"], F.element_at(between, p["pos"] + 2)).otherwise("")
    written = F.transform(parts, lambda p: F.concat(p["glue"], p["piece"], tail(p)))
    whole = F.concat(between[0], F.array_join(written, ""))
    changed = joined.select(
        *[whole.alias(c) if c == text_col else F.col(f"`{c}`") for c in held],
        (F.size(between) - 1).cast("long").alias("n_entities"),
    )
    return clean.unionByName(changed)

