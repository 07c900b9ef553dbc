"""Surrogates for personal data, in DataFrame functions only.

Detected: mail addresses, IPv4 and IPv6 addresses, phone, card, account and social-security numbers,
access keys, secrets after ``password=`` and the like, and names after a title. A number of a card's
shape whose check digit is wrong is no card and stays. Not detected: names without a title or in
scripts without capitals, street addresses, dates.

An entity is replaced by a surrogate drawn from a keyed hash of its normal form, so every mention of
it, in whatever spelling, gets the same one; whoever has the key can draw it again, so the caller
gives it and keeps it. A surrogate keeps type and format: digits become digits and letters letters of
the same case, separators, country code, mail top-level domain and card check digit stay valid,
addresses stay within reserved ranges and domains, names keep script (Latin, Greek, Cyrillic), capitals
and gender, and a surname stays one surname whatever first name goes with it.

A first name's gender is that of its title. After a title without one (``Dr``) it is the one that the
document shows for this name elsewhere, else the one that the corpus shows more often, so
``Dr Anna Petrova`` and ``Ms Anna Petrova`` are one; only a name that has both in the corpus has two
surrogates, one of each. A single word after a title is a surname, unless the document has it as a
first name. Where a document names someone with a title, its other mentions of the name's words get
the same surrogates; they are not counted.

Collision check: all distinct normal forms are drawn together; of those with one surrogate the
smallest keeps it, the rest, and any whose surrogate is itself an entity of the corpus, draw
again until none is left, and from the third draw on also longer ones (letters, digits or octets
more by draw), so that there is one for every form. So distinct entities stay distinct (all names
among each other, first or last), and no surrogate names someone real.

Only documents with entities are kept aside (a table in the shared folder) and joined; all others
pass untouched. What says that a text may have an entity (``hint``) is cheap, so the two passes over
the corpus run the patterns of the entities on few texts. A hot entity has one row on its side of
the join, and adaptive execution splits the other.

Defined cases: null text stays null, empty text stays empty; a null doc_id is kept; repeated rows
give equal texts; other columns pass unchanged, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import keep, table

#: The key of the query and the pipeline where the session's spark.hushframe.surrogateKey gives none:
#: it is public, so such surrogates can be linked to what they stand for.
OPEN_KEY = "surrogates"

# Shapes of entities. Runs are possessive and begin at a border, so that a long text
# without blanks costs one pass.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IP = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])"
IP6 = r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{1,4}){0,5}|(?=[0-9A-Fa-f:]*[0-9])[0-9A-Fa-f]{1,4}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Za-z:])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9A-Za-z])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])"
ACCESS = r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])"
SOCIAL = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
SECRET = r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}[\"']?)(?=[+/_.-]*+[A-Za-z0-9])[A-Za-z0-9+/_.-]{7,}[A-Za-z0-9+/_-]"
FEMALE, MALE, ANY = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "г-жа", "κυρία", "κα"), ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κύριος", "κος"), ("Dr", "Prof")
WORD = r"\p{Lu}(?:\.(?= \p{Lu})|[\p{L}\p{M}]*+(?:(?:-(?=\p{L})|['’](?=\p{Lu}))[\p{L}\p{M}]++){0,50}+(?<=[\p{L}\p{M}'’-][\p{L}\p{M}]))"
NAME = r"(?<![\p{L}\p{N}])(?:" + "|".join((*FEMALE, *MALE, *ANY)) + r")\.? (?:" + WORD + r"(?: (?:(?:van|von|de|der|den|del|della|di|da|la|le|bin) ){0,3}+" + WORD + r"){0,50}+)(?![\p{L}\p{N}])"
ENTITY = "|".join(f"(?:{p})" for p in (MAIL, ACCESS, SECRET, IP, IP6, CARD, SOCIAL, IBAN, PHONE, NAME))
#: A text without any of these has no entity: what numbers, secrets and names look like at the least,
#: and what stands in every mail address and access key.
NUMBER = r"[0-9](?:[0-9]{2}|\.[0-9])|\+[0-9]|[A-Z]{2}[0-9]{2}|:[0-9A-Fa-f:]"
ASSIGNED = r"(?=[pstaPSTA])(?i:password|passwd|pwd|secret|token|api_?key)\s{0,2}[=:]"
TITLE = "(?=[" + "".join(sorted({t[0] for t in (*FEMALE, *MALE, *ANY)})) + "])(?:" + "|".join((*FEMALE, *MALE, *ANY)) + r")\.? \p{Lu}"
PARTS = ("@", "AKIA", "ASIA", "sk-", "xox", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")

# Syllables for names, which are built by rule; later draws have more letters.
LATIN = ("ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mi na ne no pa pe ra re ri ro sa se so ta te to va ve vi", "n", "a")
CYRILLIC = ("ба бе бо да де до га го ка ке ла ле ло ма ме ми на не но па пе ра ре ри ро са се со та те то ва ве ви", "н", "а")
GREEK = ("βα βε βο δα δε δο φα φε γα γο θα θε κα κε κο λα λε λο μα με μι να νε νο πα πε ρα ρε ρι ρο σα σε σο τα τε το", "ν", "α")
#: Letters of the scripts that later draws add.
MORE = {"latin": "abcdefghijklmnop", "cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}
#: Top-level domains that the reserved name "example" has.
RESERVED = ("com", "org", "net")


def _number(c: Column, at, size: int = 7) -> Column:
    return F.conv(F.substring(c, at, F.lit(size)), 16, 10).cast("long")


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", *parts).cast("binary"), 256)


def _spell(text: Column, h: Column) -> Column:
    """Each ASCII letter or digit by another of its kind, drawn from ``h`` and the place."""
    chars = F.split(text, "")
    pick = lambda i, n: F.pmod(F.crc32(F.concat(h, i.cast("string")).cast("binary")), F.lit(n)).cast("int") + 1

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.rlike("^[0-9]$"), (pick(i, 10) - 1).cast("string"))
            .when(c.rlike("^[a-z]$"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), pick(i, 26), F.lit(1)))
            .when(c.rlike("^[A-Z]$"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), pick(i, 26), F.lit(1)))
            .otherwise(c)
        )

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a row of digits, the last one weighing one."""
    n = F.char_length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.pmod(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add), F.lit(10))


def _name(h: Column, part: Column, script: Column, letters: Column) -> Column:
    def build(kind, of: str) -> Column:
        syllables = F.split(F.lit(kind[0]), " ")
        n = len(kind[0].split(" "))
        at = lambda k: F.get(syllables, F.pmod(_number(h, k), F.lit(n)).cast("int"))
        base = F.concat(at(1), at(9), at(17), F.translate(letters, MORE["latin"], MORE[of]))
        return F.initcap(F.when(part == "female", F.concat(base, F.lit(kind[1] + kind[2]))).when(part == "male", F.concat(base, F.lit(kind[1]))).otherwise(F.concat(base, at(25))))

    return F.when(script == "cyrillic", build(CYRILLIC, "cyrillic")).when(script == "greek", build(GREEK, "greek")).otherwise(build(LATIN, "latin"))


def _surrogate(kind: Column, form: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form; the third draw and later ones are longer by two each."""
    more = F.least(F.greatest(attempt - 1, F.lit(0)) * 2, F.lit(64))

    def made(h: Column) -> Column:
        drawn = _digest(h)
        letters = F.substring(F.translate(drawn, "0123456789", "ghijklmnop"), F.lit(1), more)
        digits = F.substring(F.translate(drawn, "abcdef", "012345"), F.lit(1), more)
        local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
        labels = F.split(domain, r"\.")
        top = F.element_at(labels, -1)
        sub = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))
        mail = F.concat(
            _spell(local, h), letters, F.lit("@"),
            F.array_join(F.concat(F.transform(sub, lambda x: _spell(x, h)), F.array(F.lit("example"), F.when(top.isin(*RESERVED), top).otherwise("org"))), "."),
        )
        octet = lambda k: F.pmod(_number(h, k), F.lit(256)).cast("string")
        ip = F.concat(F.concat_ws(".", F.lit("10"), octet(1), octet(9), octet(17)), F.regexp_replace(digits, "([0-9])", ".$1"))
        groups = F.regexp_replace(F.substring(drawn, F.lit(33), F.lit(24)), "([0-9a-f]{4})", ":$1")
        ip6 = F.concat(F.lit("2001:db8"), groups)
        spelled = _spell(form, h)
        body = F.concat(F.substring(form, 1, 1), F.substring(spelled, 2, 14))
        check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        card = F.when(_luhn(form) == 0, F.concat(body, check)).otherwise(F.concat(body, F.substring(spelled, 16, 1)))
        plain = F.regexp_extract(form, r"^(\+[0-9]{1,3} )?", 0)
        rest = F.substring(form, F.char_length(plain) + 1, F.lit(64))
        lead = (F.pmod(_number(h, 33), F.lit(8)) + 2).cast("string")
        phone = F.concat(plain, lead, F.substring(_spell(rest, h), 2, 64), digits)
        access = F.concat(F.substring(form, 1, 4), F.substring(_spell(form, h), F.lit(5), F.char_length(form)), F.when(F.upper(form) == form, F.upper(letters)).otherwise(letters))
        social = F.concat(spelled, digits)
        secret = F.when(form.rlike("^[0-9a-f]+$"), F.substring(F.repeat(F.concat(h, _digest(h)), F.ceil(F.char_length(form) / 128).cast("int")), F.lit(1), F.char_length(form))).otherwise(_spell(form, h))
        secret = F.concat(secret, F.substring(drawn, F.lit(1), more))
        part, script = F.substring_index(kind, ":", -1), F.when(form.rlike(r"\p{IsCyrillic}"), "cyrillic").when(form.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        return (
            F.when(kind == "mail", mail).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind.isin("access", "iban"), access).when(kind == "social", social).when(kind == "secret", secret).otherwise(_name(h, part, script, letters))
        )

    return _let(_digest(F.lit(key), kind, form, attempt.cast("string")), made)


def _no_card(entity: Column) -> Column:
    """Whether this is a number of a card's shape with a wrong check digit."""
    return F.coalesce(F.when(entity.rlike(f"^(?:{CARD})$"), _luhn(F.regexp_replace(entity, "[^0-9]", "")) != 0), F.lit(False))


def _mentions(entity: Column) -> Column:
    """What an entity's text is made of: array of (kind, normal form, text) — one, or a name's words;
    kind "none" for what only looks like an entity."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    title, words = F.regexp_extract(entity, r"^(\S+?)\.? ", 1), F.split(F.regexp_replace(entity, r"^\S+ ", ""), " ")
    first = F.when(title.isin(*FEMALE), "name:female").when(title.isin(*MALE), "name:male").otherwise("name:any")
    pair = lambda k, f, said=entity: F.struct(k.alias("kind"), f.alias("form"), said.alias("said"))
    country = F.regexp_extract(entity, r"^(\+[0-9]{1,3})[ .(-]", 1)
    national = F.substring(digits, F.greatest(F.char_length(country), F.lit(1)), F.lit(64))
    phone = F.when(country != "", F.concat(country, F.lit(" "), national)).otherwise(digits)
    names = F.transform(words, lambda w, i: pair(F.when(i < F.size(words) - 1, first).otherwise("name:last"), F.lower(w), w))
    return (
        F.when(whole(SECRET), F.array(pair(F.lit("secret"), F.regexp_extract(entity, r"([A-Za-z0-9+/_.-]+)$", 1))))
        .when(entity.contains("@"), F.array(pair(F.lit("mail"), F.lower(entity))))
        .when(whole(ACCESS), F.array(pair(F.lit("access"), entity)))
        .when(whole(IP), F.array(pair(F.lit("ip"), entity)))
        .when(whole(IP6), F.array(pair(F.lit("ip6"), F.lower(entity))))
        .when(_no_card(entity), F.array(pair(F.lit("none"), entity)))
        .when(whole(CARD), F.array(pair(F.lit("card"), digits)))
        .when(whole(SOCIAL), F.array(pair(F.lit("social"), digits)))
        .when(whole(IBAN), F.array(pair(F.lit("iban"), F.replace(entity, F.lit(" "), F.lit("")))))
        .when(whole(PHONE), F.array(pair(F.lit("phone"), phone)))
        .otherwise(names)
    )


def _capitals(said: Column, surrogate: Column) -> Column:
    return F.when((F.char_length(said) > 1) & (F.upper(said) == said), F.upper(surrogate)).otherwise(surrogate)


def _lay(entity: Column, kind: Column, parts: Column) -> Column:
    """The surrogate in the format of the mention. parts: (said, surrogate) of the entity's parts."""
    drawn = F.transform(parts, lambda z: z["surrogate"])
    one = F.get(drawn, F.lit(0))
    upper = (F.upper(entity) == entity) & (F.lower(entity) != entity)
    digits = F.regexp_replace(one, "[^0-9]", "")
    zero = F.struct(F.lit(0).alias("n"), F.lit("").alias("out"))
    fill = F.aggregate(
        F.split(entity, ""), zero,
        lambda a, c: F.struct((a["n"] + c.rlike("^[0-9]$").cast("int")).alias("n"), F.concat(a["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, a["n"] + 1, F.lit(1))).otherwise(c)).alias("out")),
        lambda a: F.concat(a["out"], F.substring(digits, a["n"] + 1, F.lit(64))),
    )
    tail = F.regexp_extract(entity, r"([A-Za-z0-9+/_.-]+)$", 1)
    prefix = F.substring(entity, F.lit(1), F.char_length(entity) - F.char_length(tail))
    return (
        F.when(kind.isin("card", "phone", "social"), fill)
        .when(kind == "iban", F.when(entity.contains(" "), F.rtrim(F.regexp_replace(one, "(.{4})", "$1 "))).otherwise(one))
        .when(kind == "mail", F.when(upper, F.upper(one)).otherwise(one))
        .when(kind == "secret", F.concat(prefix, one))
        .when(kind.startswith("name"), F.concat(F.regexp_extract(entity, r"^\S+ ", 0), F.array_join(F.transform(parts, lambda z: _capitals(z["said"], z["surrogate"])), " ")))
        .otherwise(one)
    )


def draw(forms: DataFrame, key: str) -> DataFrame:
    """kind, form, surrogate of distinct (kind, form): no two of a family of kinds (what stands before
    the colon) alike, none a form of the family itself."""
    family = F.substring_index("kind", ":", 1)
    own = forms.select("kind", "form", family.alias("family"))
    left = own.withColumn("attempt", F.lit(0))
    done = None
    while True:
        drawn = left.withColumn("surrogate", _surrogate(F.col("kind"), F.col("form"), F.col("attempt"), key)).withColumn("plain", F.when(F.col("family") == "name", F.lower("surrogate")).otherwise(F.col("surrogate")))
        least = drawn.groupBy("family", "plain").agg(F.min(F.struct("form", "kind")).alias("winner"))
        real = own.select("family", F.col("form").alias("plain")).distinct().withColumn("real", F.lit(True))
        judged = drawn.join(least, ["family", "plain"]).join(real, ["family", "plain"], "left")
        if done is not None:
            judged = judged.join(done.select("family", "plain", F.lit(True).alias("taken")), ["family", "plain"], "left")
        free = (F.col("winner") == F.struct("form", "kind")) & F.col("real").isNull() & (F.col("taken").isNull() if done is not None else F.lit(True))
        judged = keep(judged.select("kind", "form", "family", "attempt", "surrogate", "plain", free.alias("ok")), "surrogates")
        good = judged.where("ok").drop("attempt", "ok")
        done = good if done is None else done.unionByName(good)
        left = judged.where("not ok").select("kind", "form", "family", (F.col("attempt") + 1).alias("attempt"))
        if not left.head(1):
            return done.select("kind", "form", "surrogate")


def _with_gender(parts: DataFrame) -> DataFrame:
    """First names of no known gender get the one of the document, else the corpus."""
    is_first = F.col("kind").isin("name:female", "name:male", "name:any")
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    here = parts.where(is_first).groupBy("at", "form").agg(count("name:female").alias("f"), count("name:male").alias("m"))
    all_f, all_m = F.sum("f"), F.sum("m")
    everywhere = here.groupBy("form").agg(F.when(all_f > all_m, "female").when(all_m > 0, "male").otherwise("any").alias("mostly"))
    known = here.join(everywhere, "form").select(
        "at", "form", F.concat(F.lit("name:"), F.when((F.col("f") > 0) & (F.col("m") == 0), "female").when((F.col("m") > 0) & (F.col("f") == 0), "male").otherwise(F.col("mostly"))).alias("known")
    )
    lone = (F.col("kind") == "name:last") & (F.col("m") == 1)
    return parts.join(known, ["at", "form"], "left").withColumn("kind", F.when(F.col("known").isNotNull() & ((F.col("kind") == "name:any") | lone), F.col("known")).otherwise(F.col("kind"))).drop("known")


def hint(text: Column) -> Column:
    """Whether a text may have an entity."""
    # a single class of characters is searched far faster than the patterns that need one of it
    found = (text.rlike("[0-9+:]") & text.rlike(NUMBER)) | (text.rlike("[=:]") & text.rlike(ASSIGNED)) | text.rlike(TITLE)
    for part in PARTS:
        found = text.contains(part) | found
    return F.coalesce(found, F.lit(False))


def replace_pii(docs: DataFrame, key: str, out: str = "n_entities") -> DataFrame:
    """The rows of ``docs`` with entities of ``text`` replaced by surrogates under a key, plus their
    number as ``out``. A column ``n_chars`` counts the new text."""
    if not key:
        raise ValueError("surrogates need a key")
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    wrapped = docs.select(row.alias("row"), F.col("text").alias("text"))
    looks = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    entities = F.when(hint(F.col("text")), _let(looks, lambda found: F.when(F.exists(found, lambda e: ~_no_card(e)), found)))
    once = F.explode(F.filter(F.array(entities), lambda e: e.isNotNull()))  # a filter and a column would each look
    found = wrapped.select("*", once.alias("entities")).withColumn("at", F.monotonically_increasing_id())
    found = keep(found, "entities")
    mention = keep(
        found.select("at", F.posexplode("entities").alias("pos", "entity")).select("at", "pos", "entity", _mentions(F.col("entity")).alias("parts")),
        "mentions",
    )
    parts = mention.select("at", "pos", "entity", F.size("parts").alias("m"), F.posexplode("parts").alias("k", "p")).select("at", "pos", "entity", "m", "k", "p.*")
    parts = keep(_with_gender(parts), "parts")
    surrogates = draw(parts.where("kind <> 'none'").select("kind", "form").distinct(), key)
    drawn = parts.join(surrogates, ["kind", "form"], "left").withColumn("surrogate", F.coalesce("surrogate", "entity")).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("pos", "k", "m", "kind", "form", "entity", "surrogate", "said"))).alias("all"))
    # the parts of a mention lie next to each other; a mention's own are those with its position
    laid = F.filter(
        F.transform("all", lambda x, i: F.when(x["k"] == 0, _lay(x["entity"], x["kind"], F.slice("all", i + 1, x["m"])))),
        lambda z: z.isNotNull(),
    )
    # names of the document, the longer ones first, which may be mentioned without a title as well
    named = F.filter("all", lambda x: x["kind"].startswith("name") & x["said"].rlike(r"^\p{Lu}.*\p{L}$"))
    named = F.array_sort(F.array_distinct(F.transform(named, lambda x: F.struct((-F.char_length(x["said"])).alias("size"), x["said"].alias("said"), _capitals(x["said"], x["surrogate"]).alias("surrogate")))))
    n = F.size(F.filter("all", lambda x: (x["k"] == 0) & (x["kind"] != "none")))
    drawn = drawn.select("at", laid.alias("new"), n.alias("n"), named.alias("named"))
    bare = lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), x["said"], F.lit(r"\E(?![\p{L}\p{N}])")), x["surrogate"])
    between = F.transform(F.split("text", ENTITY, -1), lambda t: F.when(F.size("named") > 0, F.aggregate("named", t, bare)).otherwise(t))
    joined = F.array_join(F.transform(between, lambda t, i: F.concat(t, F.coalesce(F.get(F.col("new"), i), F.lit("")))), "")
    changed = found.join(drawn, "at").select("row", joined.alias("text"), "n")
    same = wrapped.where(entities.isNull()).select("row", "text", F.lit(0).alias("n"))
    both = changed.unionByName(same)
    kinds = dict(docs.dtypes)
    kept = [F.col("text") if c == "text" else F.when(F.col("n") > 0, F.char_length("text").cast(kinds[c])).otherwise(F.col("row")[c]).alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in columns]
    return both.select(*kept, F.col("n").cast("long").alias(out))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.hushframe.surrogateKey", None) or OPEN_KEY


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark))
