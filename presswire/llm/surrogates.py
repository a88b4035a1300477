"""Surrogates for personal data: keyed, type-consistent replacements, distinct and coreferent over the corpus.

DataFrame functions only.  A text's entities are cut out and put back inside its row; only the distinct
entities travel, to be checked for collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswire.llm.common import stored, tune

KEY = "presswire"
#: Draws in an entity's own shape; later ones have more room.  Draws in all, which only a full address space needs.
MOST_ATTEMPTS = 64
LAST_ATTEMPT = 512

# --- fixed values: own word lists -----------------------------------------------
TITLES = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sir", "господин"),
          "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Lady", "госпожа")}
GIVEN = {
    "m-latin": "Adam Bruno Carlos Daniel Edward Felix George Henry Ivan Jack Karl Louis Martin Nicolas Oscar Paul "
               "Ralph Simon Thomas Victor Walter James John Robert Michael William David Peter Hans Jean".split(),
    "f-latin": "Alice Bella Clara Diana Emma Frances Grace Helen Irene Julia Karen Laura Marie Nora Olivia Paula "
               "Rosa Sarah Teresa Vera Wendy Mary Anna Linda Susan Elizabeth Jennifer Petra Ines Lucia".split(),
    "m-cyrillic": "Андрей Борис Виктор Григорий Дмитрий Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Сергей".split(),
    "f-cyrillic": "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Надежда Ольга Полина Софья".split(),
}
SYLLABLES = {"latin": "ba ben bor cal dan del dor fen gar hal hol jor kel lan lor mar men nor pel ran rel sal sen "
                      "tal ter ton val ven wil wor".split(),
             "cyrillic": "бар бел вор гал дан дол зар кал кор лен лор мар мел нор пел рад сал сор тал тур".split()}
# ---------------------------------------------------------------------------------

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
_TITLED = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + ")"
_KNOWN = "(?:" + "|".join(n for ns in GIVEN.values() for n in ns) + ")"
#: What is taken for personal data (Java regular expressions), tried in this order.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)++[A-Za-z]{2,}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"
             r"|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])|(?<![0-9+])\+[0-9]{8,15}(?![0-9])"
             r"|(?<![0-9+.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9+.-])[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": rf"(?<![\p{{L}}]){_TITLED}\.? {_WORD}(?: {_WORD})?|(?<![\p{{L}}]){_KNOWN} {_WORD}",
}
#: First characters of names, so that other places are passed over at once.
_INITIALS = "[" + "".join(sorted({w[0] for words in (*TITLES.values(), *GIVEN.values()) for w in words})) + "]"
NAME = f"(?={_INITIALS})(?:{KINDS['name']})"
ANY = "|".join([f"(?:{KINDS['email']})", "(?=[0-9+(])(?:" + "|".join(
    f"(?:{KINDS[k]})" for k in ("ip", "ssn", "phone", "card")) + ")", NAME])


def _kind(match: Column) -> Column:
    """The kind of a match of ANY: the first whose pattern covers it."""
    out = None
    for kind, p in KINDS.items():
        hit = F.regexp_like(match, F.lit(f"^(?:{p})$"))
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    return out.otherwise(F.lit("card"))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _script(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"\p{IsCyrillic}")), F.lit("cyrillic")).otherwise(F.lit("latin"))


def _gender_of_given(c: Column) -> Column:
    low = F.lower(c)
    women = [n.lower() for k, ns in GIVEN.items() if k[0] == "f" for n in ns]
    men = [n.lower() for k, ns in GIVEN.items() if k[0] == "m" for n in ns]
    return F.when(low.isin(women), F.lit("f")).when(low.isin(men), F.lit("m"))


def atoms(kind: Column, match: Column) -> Column:
    """The parts of a match that are replaced: array of (type, norm, text).

    Type carries what the surrogate must match (country, gender, script); norm is what mentions of one
    entity have in common: lower case, or digits without the writing.
    """
    def atom(type_, norm, text):
        return F.struct(type_.alias("type"), norm.alias("norm"), text.alias("text"))

    country = F.regexp_extract(match, r"^\+([0-9]{1,3})(?![0-9])", 1)
    rest = F.call_function("substr", match, F.when(F.length(country) > 0, F.length(country) + 2).otherwise(1))
    phone = F.array(atom(F.concat(F.lit("phone"), country), _digits(rest), match))
    titled = F.regexp_extract(match, rf"^({_TITLED}\.?) ", 1)
    names = F.split(F.when(titled != "", F.call_function("substr", match, F.length(titled) + 2)).otherwise(match), " ")
    title_gender = F.when(F.regexp_replace(titled, r"\.$", "").isin(list(TITLES["f"])), F.lit("f")).when(titled != "", F.lit("m"))
    given, family = F.element_at(names, 1), F.element_at(names, -1)
    gender = F.coalesce(_gender_of_given(given), title_gender, F.lit("m"))
    person = F.when(F.size(names) > 1, F.array(
        atom(F.concat_ws("-", F.lit("given"), gender, _script(given)), F.lower(given), given),
        atom(F.concat_ws("-", F.lit("family"), _script(family)), F.lower(family), family))).otherwise(
        F.array(atom(F.concat_ws("-", F.lit("family"), _script(family)), F.lower(family), family)))
    return (F.when(kind == "name", person).when(kind == "phone", phone)
            .when(kind.isin("card", "ssn"), F.array(atom(kind, _digits(match), match)))
            .otherwise(F.array(atom(kind, F.lower(match), match))))


# --- surrogates of distinct entities -----------------------------------------------

def _stream(key: str, *parts) -> Column:
    """256 hex digits that follow from the key and the parts."""
    seed = F.concat_ws("|", F.lit(key), *parts)
    return F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(4)])


def _byte(stream: Column, i) -> Column:
    at = F.pmod(i, F.lit(128)) if isinstance(i, Column) else F.lit(i % 128)
    return F.conv(F.call_function("substr", stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _like(norm: Column, stream: Column) -> Column:
    """Character by character: a digit for a digit, a letter for a letter, the rest as it is."""
    letters, numbers = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("0123456789")

    def one(c, i):
        b = _byte(stream, i)
        return (F.when(F.regexp_like(c, F.lit("[0-9]")), F.call_function("substr", numbers, b % 10 + 1, F.lit(1)))
                .when(F.regexp_like(c, F.lit("[a-z]")), F.call_function("substr", letters, b % 26 + 1, F.lit(1))).otherwise(c))
    return F.array_join(F.transform(F.split(norm, ""), one), "")


def _check_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, its last digit taken once."""
    def part(c, i):
        d = c.cast("int")
        return F.when(F.pmod(i, F.lit(2)) == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    return F.aggregate(F.transform(F.filter(F.reverse(F.split(digits, "")), lambda c: c != ""), part), F.lit(0), lambda a, x: a + x)


def _pick(words, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words)) + 1)


def surrogate(type_: Column, norm: Column, attempt: Column, key: str, narrow: int = MOST_ATTEMPTS) -> Column:
    """The candidate replacement of an entity's norm; another attempt gives another one.

    From attempt ``narrow`` on, a small space of values grows with each attempt: the local part of an e-mail
    gets more letters and a number more digits; a private address may be any of 10.*, and after as many
    attempts again any address.
    """
    over = F.greatest(attempt - (narrow - 1), F.lit(0))
    s = _stream(key, type_, norm, attempt.cast("string"))
    body = _like(norm, s)
    low = lambda d, least: F.concat(((_byte(s, 100) % (10 - least)) + least).cast("string"), F.call_function("substr", d, F.lit(2)))
    # e-mail: names of one domain stay together, its ending stays
    at = F.instr(norm, "@")
    domain = F.call_function("substr", norm, at + 1)
    ending = F.concat(F.lit("."), F.element_at(F.split(domain, r"\."), -1))
    host = F.call_function("substr", domain, F.lit(1), F.length(domain) - F.length(ending))
    letters, digits = (_like(F.repeat(F.lit(c), over), _stream(key, F.lit("more"), type_, norm, attempt.cast("string"))) for c in "a0")
    email = F.concat(F.call_function("substr", body, F.lit(1), at - 1), letters, F.lit("@"), _like(host, _stream(key, F.lit("domain"), domain)), ending)
    # addresses: private ranges stay private
    octets = F.split(norm, r"\.")
    own = F.when(norm.startswith("10.") | norm.startswith("127."), 1).when(norm.startswith("192.168."), 2).when(
        F.regexp_like(norm, F.lit(r"^172\.(1[6-9]|2[0-9]|3[01])\.")), 2).otherwise(0)
    octets = F.when((over > 0) & (own == 2), F.array(*[F.lit(x) for x in ("10", "0", "0", "0")])).otherwise(octets)
    own = F.when(over > narrow, 0).when((over > 0) & (own == 2), 1).otherwise(own)
    fresh = F.transform(octets, lambda c, i: F.when(i < own, c).when(i == 0, (F.lit(11) + _byte(s, i) % 110).cast("string")).otherwise(
        _byte(s, i).cast("string")))
    # cards: first digit, length and validity stay
    front = F.concat(F.call_function("substr", norm, F.lit(1), F.lit(1)), F.call_function("substr", body, F.lit(2), F.length(norm) - 2))
    right = F.pmod(F.lit(10) - F.pmod(_check_sum(F.concat(front, F.lit("0"))), F.lit(10)), F.lit(10))
    last = F.when(F.pmod(_check_sum(norm), F.lit(10)) == 0, right).otherwise(F.pmod(right + 1 + _byte(s, 101) % 9, F.lit(10)))
    card = F.concat(front, last.cast("string"))
    # names: gender and script from the type; later attempts add syllables, so there is always room
    def family(script):
        syl = SYLLABLES[script]
        parts = F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: _pick(syl, _byte(s, i * 2) * 256 + _byte(s, i * 2 + 1)))
        return F.array_join(parts, "")

    out = (F.when(type_ == "email", email).when(type_ == "ip", F.array_join(fresh, ".")).when(type_ == "card", card)
           .when(type_ == "ssn", F.concat(low(body, 1), digits)).when(type_.startswith("phone"), F.concat(low(body, 2), digits)))
    for script in SYLLABLES:
        out = out.when(type_ == f"family-{script}", family(script))
        for g in "mf":
            names = [n.lower() for n in GIVEN[f"{g}-{script}"]]
            first = _pick(names, _byte(s, 0) * 256 + _byte(s, 1))
            # the list is short: a given name goes on with syllables once it has collided
            more = F.when(attempt == 0, F.lit("")).otherwise(family(script))
            out = out.when(type_ == f"given-{g}-{script}", F.concat(first, more))
    return out


def mapping(entities: DataFrame, key: str = KEY, most_attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """type, norm, surrogate for the distinct entities (type, norm): one to one within a type.

    Each round draws candidates for the entities still open; a candidate that is a real entity of
    the corpus, is given already, or is drawn by a smaller norm too, is drawn anew.  Rounds are stored.
    After ``most_attempts`` draws the candidates have more room each time, so that the rest ends as well.
    """
    entities = stored(entities.select("type", "norm").distinct(), "op2")
    taken, open_ = None, entities
    for attempt in range(max(LAST_ATTEMPT, 4 * most_attempts)):
        drawn = stored(open_.withColumn("surrogate", surrogate(F.col("type"), F.col("norm"), F.lit(attempt), key, most_attempts)), "op2")
        first = drawn.groupBy("type", "surrogate").agg(F.min("norm").alias("norm"))
        real = entities.select("type", F.col("norm").alias("surrogate"))
        fine = first.join(real, ["type", "surrogate"], "left_anti")
        if taken is not None:
            fine = fine.join(taken.select("type", "surrogate"), ["type", "surrogate"], "left_anti")
        fine = stored(fine.select("type", "norm", "surrogate"), "op2")
        taken = fine if taken is None else taken.union(fine)
        open_ = stored(drawn.select("type", "norm").join(fine, ["type", "norm"], "left_anti"), "op2")
        if open_.isEmpty():
            return taken
    raise RuntimeError("more distinct entities of a type than it has values")


def _written(text: Column, norm: Column, type_: Column) -> Column:
    """The surrogate norm in the writing of the mention: its separators, or its letter case."""
    def digit(c, i):
        return F.when(F.regexp_like(c, F.lit("[0-9]")), F.lit(1)).otherwise(F.lit(0))

    cc = F.length(F.regexp_extract(type_, r"^phone([0-9]+)$", 1))  # digits of the country code stay
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    marks = F.transform(chars, digit)

    def put(c, i):
        nth = F.aggregate(F.slice(marks, F.lit(1), i + 1), F.lit(0), lambda a, x: a + x)
        return F.when(F.element_at(marks, i + 1) == 0, c).when(nth <= cc, c).otherwise(
            F.call_function("substr", norm, nth - cc, F.lit(1)))

    numbers = F.array_join(F.transform(chars, put), "")
    # digits beyond those of the mention come last
    count = F.aggregate(marks, F.lit(0), lambda a, x: a + x)
    numbers = F.concat(numbers, F.call_function("substr", norm, count - cc + 1))
    cased = (F.when((text == F.upper(text)) & (F.length(text) > 1), F.upper(norm))
             .when(text.substr(1, 1) != F.lower(text.substr(1, 1)), F.concat(F.upper(norm.substr(1, 1)), F.call_function("substr", norm, F.lit(2))))
             .otherwise(norm))
    return (F.when(type_.startswith("phone") | type_.isin("card", "ssn"), numbers).when(type_ == "ip", norm).otherwise(cased))


def replace_private(docs: DataFrame, key: str = KEY) -> DataFrame:
    """The documents with every detected entity replaced, and the counts n_email, n_ip, n_ssn, n_phone, n_card, n_name.

    One entity has one surrogate everywhere (also across ways of writing it, and across the parts of a
    name), two entities of a type never share one, and none equals a real entity of the corpus.
    Texts are replaced as wholes by content, so repeated rows and rows without a doc_id need no key; texts
    without entities, empty and null texts come back unchanged with counts 0.  An empty table gives
    no rows.  All columns are kept; a column that is called like a count is replaced.
    """
    tune(docs.sparkSession)
    counts = [f"n_{k}" for k in KINDS]
    docs = docs.drop(*counts)
    # cheap tests first: without a digit or an @ only a name can be there
    maybe = F.col("text").contains("@") | F.regexp_like("text", F.lit("[0-9]")) | F.regexp_like("text", F.lit(NAME))
    has = F.coalesce(maybe & F.regexp_like(F.col("text"), F.lit(ANY)), F.lit(False))
    hit = stored(docs.where(has).withColumn("_id", F.sha2(F.col("text"), 256)), "op2")
    found = F.regexp_extract_all("text", F.lit(ANY), 0)
    mentions = (hit.groupBy("_id").agg(F.first("text").alias("text")).select("_id", found.alias("_m"))
                .select("_id", F.posexplode("_m").alias("nth", "match"))
                .withColumn("kind", _kind(F.col("match"))))
    mentions = stored(mentions.select("_id", "nth", "kind", "match", F.posexplode(atoms(F.col("kind"), F.col("match"))).alias("part", "a"))
                      .select("_id", "nth", "kind", "match", "part", "a.type", "a.norm", "a.text"), "op2")
    table = mapping(mentions, key)
    done = mentions.join(table, ["type", "norm"]).withColumn("new", _written(F.col("text"), F.col("surrogate"), F.col("type")))
    # a name's parts go back behind its title
    per_match = done.groupBy("_id", "nth").agg(
        F.first("kind").alias("kind"), F.first("match").alias("match"),
        F.array_sort(F.collect_list(F.struct("part", "text", "new"))).alias("parts"))
    old = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    new = F.array_join(F.transform("parts", lambda p: p["new"]), " ")
    head = F.call_function("substr", F.col("match"), F.lit(1), F.length("match") - F.length(old))
    per_text = (per_match.select("_id", "nth", "kind", F.concat(head, new).alias("new")).groupBy("_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("nth", "new"))), lambda x: x["new"]).alias("_new"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]))
    text = F.array_join(F.zip_with(F.split("text", ANY, -1), F.concat("_new", F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    names = docs.columns
    changed = hit.join(per_text, "_id").withColumn("text", text)
    same = docs.where(~has)
    for c in counts:
        same = same.withColumn(c, F.lit(0).cast("long"))
    return changed.select(*names, *counts).unionByName(same.select(*names, *counts))
