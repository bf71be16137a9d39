"""Surrogates for personal data, in DataFrame and SQL operations only.

Detected entities get keyed replacements of their own kind: e-mail addresses, phone
numbers, payment cards (Luhn), IBANs (mod 97), social security numbers, IPv4
addresses, secrets, and persons. A replacement keeps format, case and script; cards and
IBANs stay valid, phones keep the country, e-mails the top-level domain, persons their
title, the gender of known given names, and the script.

Coreference: an entity has one normal form over the whole corpus (lower-case e-mail,
digits of a phone with its country), and all its mentions share a surrogate, each laid
out as the mention was. A person is replaced name by name, given names and surname
each by its own surrogate, so that "Mr Smith", "Mr. Smith" and "John Smith" stay one
family name. An e-mail address is not tied to the person that it names.

Distinctness: known given names are permuted within their gender and script; all other
surrogates are drawn from HMAC-SHA256 of key, kind, normal form and attempt. An entity
whose surrogate another one holds, of any kind, or that is itself a real entity of the
corpus, takes the next attempt. The first ``SAME_LENGTH`` attempts are as long as the
entity, later ones longer by ``LONGER``; the last carries 64 drawn characters, which no
two entities share, so that there are never more than ``SAME_LENGTH + len(LONGER)``
rounds, however full the space of short entities is.

Detection limits: persons are found after a title, by a known given name, after words
that introduce a name (``INTRODUCTIONS``), and before an e-mail address in brackets;
other names, and names in scripts without case, stay. Numbers that fail their checksum
and bare words that no keyword introduces are left alone. No pattern has an upper
length, but where its format has one (IBAN, card, phone).

Texts are matched once; the mentions are carried along in a table of the shared folder.
Texts without an entity never leave their partition afterwards.

Defined cases: a null text stays null, an empty one empty; equal texts get equal
replacements whatever their ids; repeated rows are rewritten each; a very long text is
matched whole; an empty table gives an empty table; other columns are carried along,
whatever their names.
"""

from __future__ import annotations

import hashlib
import hmac
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from .common import cut, fresh, written

# Titles, words that introduce a name, and given names by gender and script.
TITLES = ["Mr", "Sir", "Lord", "Herr", "Señor", "Sr", "Don", "Monsieur", "Signor", "Господин", "Mrs", "Ms", "Miss", "Lady", "Frau", "Señora", "Sra", "Señorita", "Doña", "Madame", "Mme", "Mademoiselle", "Mlle", "Signora", "Госпожа", "Dr", "Prof", "Professor", "Rev"]
INTRODUCTIONS = ["my name is", "name:", "author:", "signed:", "contact:", "attn:", "ich heiße", "mein Name ist", "Kontakt:", "je m'appelle", "mon nom est", "nom:", "me llamo", "mi nombre es", "nombre:"]
GIVEN = {
    ("M", "latin"): ["James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Hans", "Klaus", "Jürgen", "Pierre", "Jean", "Luis", "Carlos", "Javier"],
    ("F", "latin"): ["Mary", "Anna", "Elizabeth", "Sarah", "Laura", "Emma", "Julia", "Claire", "Marie", "Camille", "Ursula", "Heike", "María", "Carmen", "Lucía", "Sofía"],
    ("M", "cyrillic"): ["Иван", "Пётр", "Сергей", "Дмитрий", "Николай", "Павел", "Олег", "Юрий"],
    ("F", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Вера", "Юлия"],
    ("M", "greek"): ["Γιώργος", "Νίκος", "Δημήτρης", "Κώστας"],
    ("F", "greek"): ["Μαρία", "Ελένη", "Άννα", "Σοφία"],
}
#: Syllables of made names; three at least, so that no known given name arises.
SYLLABLES = {
    "latin": ["ba", "be", "do", "fa", "ga", "ha", "ka", "la", "ma", "na", "pa", "ra", "sa", "ta", "va", "win"],
    "cyrillic": ["ба", "ве", "до", "за", "ка", "ла", "ма", "на", "па", "ра", "са", "та", "фо", "ха", "ше", "ров"],
    "greek": ["βα", "γε", "δο", "ζα", "κα", "λα", "μα", "να", "πα", "ρα", "σα", "τα", "φο", "χα", "ψε", "δης"],
}
#: Attempts at a surrogate as long as the entity, and the characters that each later one adds.
SAME_LENGTH, LONGER = 3, (4, 12, 64)
#: Alphabets in which characters are replaced by others of the same class.
ALPHABETS = {"[0-9]": "123456789", "[a-z]": "abcdefghijklmnopqrstuvwxyz", "[A-Z]": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[\\p{IsCyrillic}]": "абвгдежзиклмнопрстуфхцчшэюя", r"[\\p{IsGreek}]": "αβγδεζηθικλμνξοπρστυφχψω", r"[\\p{L}]": "áéíóúñçäöüàèêîôû"}
#: Copies of a text are matched up in this many groups, so that none is one task's.
SALTS = 1024
#: Share of all mentions from which an entity's surrogate is broadcast: at most 1,024 rows.
HEAVY = 1 / 1024


def _any(names: list[str]) -> str:
    return "|".join(sorted(names, key=len, reverse=True))


_LOCAL, _LABEL = r"[\p{L}\p{N}._%+\-]", r"[\p{L}\p{N}\-]"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}++(?:[\-'’]?\p{Lu}\p{Ll}++){0,2}"
_TITLE = rf"(?:{_any(TITLES)})\.? "
_GIVEN = _any([n for ns in GIVEN.values() for n in ns])
_INTRODUCTION = rf"(?<=(?i:{_any(INTRODUCTIONS)}) {{1,2}})"
_VALUE = r"[^\s\"'<>,;]{8,}+"
_PASSWORD = r"(?i:passwords?|passwd|pwd|passphrase|api[_\-]?key|access[_\-]?key|client[_\-]?secret) {0,2}"
#: What stands before the value of an assigned secret, from the sign of equality on.
_ASSIGNED = rf"[=:](?:(?<={_PASSWORD}[=:]) {{0,2}}[\"']?+(?={_VALUE})|(?<=(?i:secret|token) {{0,2}}=) {{0,2}}[\"']?+(?={_VALUE})|(?<=(?i:secret|token) {{0,2}}:)(?:[\"']?+| {{1,2}}[\"']| {{1,2}}(?=[^\s\"']{{0,40}}\d))(?={_VALUE}))"
_PEM = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: What an entity of each kind looks like behind a character that is neither letter nor digit; each begins with what it may start with.
PATTERNS = {
    "EMAIL": rf"(?<![._%+\-]){_LOCAL}++@(?={_LABEL}[\p{{L}}\p{{N}}\-.]*?\.\p{{L}}{{2,63}}+(?![\p{{L}}\p{{N}}])){_LABEL}++(?:\.(?={_LABEL}){_LABEL}++)++",
    "SECRET": r"(?=[0-9a-gsxA-F])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{22,}+|glpat-[A-Za-z0-9_\-]{20,}+|xox[abeoprs]-[A-Za-z0-9\-]{10,}+|AIza[0-9A-Za-z_\-]{35}|sk-[A-Za-z0-9_\-]{20,}+|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]++|[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![A-Za-z0-9])",
    "IBAN": r"(?=[A-Z])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "IPV4": rf"(?=\d)(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "PHONE": r"(?=[+(\d])(?:(?<!\+)\+\d{1,3}(?:[ .\-]?\(\d{1,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}|(?:[ \-]\d{2,4}){2,4}|(?:\.\d{2,4}){2,4}|\d{7,12})(?!\.?\d)|(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?![\d\-]))",
    "SSN": r"(?=\d)(?<!-)\d{3}-\d{2}-\d{4}(?![\d\-])",
    "CARD": r"(?=\d)(?:\d{13,19}|\d{4}([ \-])\d{4}\1\d{4}\1\d{4}|\d{4}([ \-])\d{6}\2\d{5})(?!\d)",
    "PERSON": rf"(?=\p{{Lu}})(?:{_TITLE}{_NAME}(?: {_NAME}){{0,2}}|(?:{_GIVEN}) {_NAME}|{_NAME}(?: {_NAME}){{1,2}}(?= {{0,2}}[<(]{_LOCAL}{{1,64}}+@)|(?<=[:a-zß] {{1,2}}){_INTRODUCTION}{_NAME}(?: {_NAME}){{1,2}})",
}
PATTERN = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(PATTERNS.values())})|{_ASSIGNED}{_VALUE}|{_PEM}[A-Za-z0-9+/=\s]++"


def sql_text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def names_array(names: list[str]) -> str:
    return f"array({', '.join(map(sql_text, names))})"


def chars(x: str) -> str:
    return f"filter(split({x}, ''), c -> c <> '')"


def script(x: str) -> str:
    return f"CASE WHEN {x} RLIKE '[\\\\p{{IsCyrillic}}]' THEN 'cyrillic' WHEN {x} RLIKE '[\\\\p{{IsGreek}}]' THEN 'greek' ELSE 'latin' END"


def mod97(x: str) -> str:
    """The IBAN remainder of a packed IBAN."""
    moved = f"concat(substring({x}, 5), substring({x}, 1, 4))"
    return f"aggregate({chars(moved)}, 0, (a, c) -> IF(c RLIKE '[0-9]', (a * 10 + int(c)) % 97, (a * 100 + ascii(c) - 55) % 97))"


def kind(x: str) -> str:
    """SQL for the kind of a mention without keyword, null for numbers that fail their check."""
    digits, packed = f"regexp_replace({x}, '[^0-9]', '')", f"regexp_replace({x}, ' ', '')"
    whole = {k: f"{x} RLIKE {sql_text('^(?:' + p + ')$')}" for k, p in PATTERNS.items() if k != "CARD"}
    return f"""CASE WHEN {x} LIKE '%@%' THEN 'EMAIL' WHEN {whole['IPV4']} THEN 'IPV4' WHEN {x} RLIKE {sql_text('^[^0-9]*$')} AND {x} LIKE '% %' THEN 'PERSON'
        WHEN {whole['SSN']} THEN 'SSN' WHEN {x} RLIKE '^[0-9]{{4}}[0-9 -]*$' AND length({digits}) BETWEEN 13 AND 19 THEN IF(luhn_check({digits}), 'CARD', NULL)
        WHEN {whole['PHONE']} THEN IF(length({digits}) BETWEEN 7 AND 15, 'PHONE', NULL)
        WHEN {whole['IBAN']} AND {mod97(packed)} = 1 THEN 'IBAN' WHEN {whole['SECRET']} THEN 'SECRET' END"""


def pieces(x: str) -> str:
    """SQL for the parts of a mention: array of (keep, text that stays before it; kind, null if none; raw, what is replaced)."""

    def one(keep: str, k: str, raw: str) -> str:
        return f"array(named_struct('keep', {keep}, 'kind', {k}, 'raw', {raw}))"

    before = f"regexp_extract({x}, {sql_text(r'^(?:[=:] {0,2}["' + chr(39) + ']?|' + _PEM + ')')}, 0)"
    lead = f"regexp_extract({x}, {sql_text('^(?:' + _TITLE + ')?')}, 0)"
    person = f"""transform(array(named_struct('lead', {lead}, 'names', split(substring({x}, length({lead}) + 1), ' '))), p -> transform(p.names, (n, i) ->
        named_struct('keep', IF(i = 0, p.lead, ' '), 'kind', IF(i = size(p.names) - 1 AND (i > 0 OR p.lead <> ''), 'SURNAME', 'GIVEN'), 'raw', n)))[0]"""
    return f"""transform(array({before}), b -> CASE WHEN b <> '' THEN {one('b', "'SECRET'", f"substring({x}, length(b) + 1)")} ELSE
        transform(array({kind(x)}), k -> CASE WHEN k IS NULL THEN {one(x, "CAST(NULL AS STRING)", "''")} WHEN k = 'PERSON' THEN {person} ELSE {one("''", 'k', x)} END)[0] END)[0]"""


def normal(k: str, x: str) -> str:
    """SQL for the normal form of a piece."""
    phone = f"regexp_replace({x}, '[^0-9+]', '')"
    return f"""CASE WHEN {k} IN ('EMAIL', 'GIVEN', 'SURNAME') THEN lower({x}) WHEN {k} = 'PHONE' THEN IF({x} LIKE '+%', {phone}, concat('+1', {phone}))
        WHEN {k} IN ('CARD', 'SSN') THEN regexp_replace({x}, '[^0-9]', '') WHEN {k} = 'IBAN' THEN regexp_replace({x}, ' ', '') ELSE {x} END"""


def keyed(key: str, message: str) -> str:
    """SQL for HMAC-SHA256 of a text, in hex."""
    k = key.encode("utf-8")
    k = (hashlib.sha256(k).digest() if len(k) > 64 else k).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in k).hex() for pad in (0x36, 0x5C))
    return f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', encode({message}, 'UTF-8')), 256))), 256)"


def stream(key: str, *parts: str) -> str:
    """SQL for 256 hex digits drawn from the key and the parts."""
    return f"concat({', '.join(keyed(key, f'''concat_ws('|', {', '.join(parts)}, '{i}')''') for i in range(4))})"


def draw(h: str, i: str, n: str) -> str:
    """SQL for a number below n from place i of stream h."""
    return f"int(conv(substring({h}, ({i} * 4) % 252 + 1, 4), 16, 10)) % {n}"


def swapped(x: str, h: str, keep: str, hexadecimal: str = "false") -> str:
    """SQL for x with each character after the first ``keep`` replaced by one of its class."""
    cases = " ".join(f"WHEN c RLIKE '{p}' THEN substring('{a}', {draw(h, 'i', str(len(a)))} + 1, 1)" for p, a in ALPHABETS.items())
    low, up = (f"WHEN {hexadecimal} AND c RLIKE '[{a[0]}-{a[-1]}]' THEN substring('{a}', {draw(h, 'i', '6')} + 1, 1)" for a in ("abcdef", "ABCDEF"))
    return f"array_join(transform({chars(x)}, (c, i) -> CASE WHEN i < {keep} THEN c {low} {up} {cases} ELSE c END), '')"


def permuted_names(key: str) -> dict[str, str]:
    """Each known given name (lower case) and its surrogate: one keyed cycle through each list."""
    out: dict[str, str] = {}
    for group, names in GIVEN.items():
        order = [n.lower() for n in names]
        random.Random(hmac.new(key.encode("utf-8"), repr(group).encode("utf-8"), "sha256").digest()).shuffle(order)
        out |= zip(order, order[1:] + order[:1])
    return out


def surrogate(key: str, k: str, n: str, attempt: str) -> str:
    """SQL for the normal form of an entity's surrogate; column ``h`` is its stream."""
    h = "h"
    at = f"instr({n}, '@')"
    local, domain = f"substring({n}, 1, {at} - 1)", f"substring({n}, {at} + 1)"
    top = f"regexp_extract({n}, '([.][^.]+)$', 1)"
    host = f"substring({domain}, 1, length({domain}) - length({top}))"
    # Later attempts are longer.
    extra = f"element_at(array(0, {', '.join(map(str, LONGER))}), greatest(0, {attempt} - {SAME_LENGTH} + 1) + 1)"
    longer = swapped(f"repeat('1', {extra})", stream(key, "'longer'", k, n, attempt), "0")
    email = f"concat({swapped(local, h, '0')}, {longer}, '@', {swapped(host, stream(key, sql_text('domain'), domain), '0')}, {top})"
    country = f"IF({n} RLIKE '^[+][17]', 2, 3)"
    body = f"concat({swapped(f'substring({n}, 1, length({n}) - 1)', h, '1')}, {longer})"
    card = f"transform(array({body}), b -> element_at(filter(transform(sequence(0, 9), d -> concat(b, d)), s -> luhn_check(s)), 1))[0]"
    rest = f"concat({swapped(f'substring({n}, 5)', h, '0')}, {longer})"
    iban = f"transform(array({rest}), b -> concat(substring({n}, 1, 2), lpad(98 - {mod97(f'concat(substring({n}, 1, 2), {chr(39)}00{chr(39)}, b)')}, 2, '0'), b))[0]"
    ip = f"concat_ws('.', 11 + {draw(h, '0', '115')}, {draw(h, '1', '256')}, {draw(h, '2', '256')}, 1 + {draw(h, '3', '254')})"
    ip = f"IF({extra} = 0, {ip}, concat('2001:db8:', substring({h}, 1, {extra})))"  # beyond IPv4, documentation addresses
    prefix = f"CASE WHEN {n} RLIKE '^(?:A[KS]IA|AIza|gh._|xox.-)' THEN 4 WHEN {n} LIKE 'sk-%' OR {n} LIKE 'eyJ%' THEN 3 WHEN {n} LIKE 'github_pat_%' THEN 11 WHEN {n} LIKE 'glpat-%' THEN 6 ELSE 0 END"
    secret = f"concat({swapped(n, h, prefix, f'({n} RLIKE {chr(39)}^[0-9a-f]+${chr(39)} OR {n} RLIKE {chr(39)}^[0-9A-F]+${chr(39)})')}, {longer})"
    syllables = "CASE " + " ".join(f"WHEN p.s = '{s}' THEN {names_array(v)}" for s, v in SYLLABLES.items()) + " END"
    made = f"transform(array({syllables}), a -> array_join(transform(sequence(1, IF({k} = 'GIVEN', 3, 4) + {extra}), j -> concat(IF(p.hyphen AND j = 3, '-', ''), a[{draw(h, 'j', '16')}])), ''))[0]"
    name = f"transform(array(named_struct('s', {script(n)}, 'hyphen', {n} LIKE '%-%')), p -> {made})[0]"
    digits, phone = f"concat({swapped(n, h, '0')}, {longer})", f"concat({swapped(n, h, country)}, {longer})"
    return f"CASE {k} WHEN 'EMAIL' THEN {email} WHEN 'PHONE' THEN {phone} WHEN 'CARD' THEN {card} WHEN 'IBAN' THEN {iban} WHEN 'IPV4' THEN {ip} WHEN 'GIVEN' THEN {name} WHEN 'SURNAME' THEN {name} WHEN 'SSN' THEN {digits} ELSE {secret} END"


def laid_out(k: str, x: str, s: str) -> str:
    """SQL for surrogate s in the layout (case, separators) of piece x."""
    cased = f"array_join(zip_with({chars(x)}, {chars(s)}, (c, d) -> IF(c <> lower(c), upper(d), coalesce(d, ''))), '')"
    used = "[^0-9+]"
    own = f"IF({k} = 'PHONE' AND NOT {x} LIKE '+%', substring({s}, 3), {s})"
    packed = f"array_join(transform({chars(x)}, (c, i) -> IF(c RLIKE '[ ().-]', c, substring(o, 1 + length(regexp_replace(substring({x}, 1, i), IF({k} = 'IBAN', ' ', '{used}'), '')), 1))), '')"
    rest = f"substring(o, 1 + length(IF({k} = 'IBAN', regexp_replace({x}, ' ', ''), regexp_replace({x}, '{used}', ''))))"  # of a surrogate that had to be longer
    packed = f"transform(array({own}), o -> concat({packed}, {rest}))[0]"
    named = f"array_join(transform(split({s}, '-'), w -> initcap(w)), '-')"
    return f"CASE WHEN {k} = 'EMAIL' THEN {cased} WHEN {k} IN ('GIVEN', 'SURNAME') THEN {named} WHEN {k} IN ('PHONE', 'CARD', 'SSN', 'IBAN') THEN {packed} ELSE {s} END"


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, surrogate) of distinct entities (kind, normal); no two made surrogates equal, none a real entity."""
    known = permuted_names(key)
    listed = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = cut(entities.select("kind", "normal", F.when(F.col("kind") == "GIVEN", F.try_element_at(listed, F.col("normal"))).alias("surrogate")))
    real = found.select(F.col("normal").alias("surrogate"), F.lit(0).alias("rank"), F.lit("").alias("kind"), F.lit("").alias("normal")).distinct()
    done, open_ = found.where("surrogate IS NOT NULL"), found.where("surrogate IS NULL").select("kind", "normal")
    for attempt in range(SAME_LENGTH + len(LONGER)):
        made = open_.withColumn("attempt", F.lit(attempt)).withColumn("h", F.expr(stream(key, "kind", "normal", "attempt"))).withColumn("surrogate", F.expr(surrogate(key, "kind", "normal", "attempt")))
        made = cut(made.select("kind", "normal", "surrogate"))
        taken = real.unionByName(done.select("surrogate", F.lit(0).alias("rank"), F.lit("").alias("kind"), F.lit("").alias("normal")))
        # The first claim of a surrogate stands; a real entity or an earlier surrogate comes before all.
        claims = taken.unionByName(made.select("surrogate", F.lit(1).alias("rank"), "kind", "normal"))
        best = claims.groupBy("surrogate").agg(F.min(F.struct("rank", "kind", "normal")).alias("best"))
        judged = made.join(best, "surrogate").withColumn("ok", F.col("best.rank").eqNullSafe(1) & (F.col("best.kind") == F.col("kind")) & (F.col("best.normal") == F.col("normal")))
        judged = cut(judged.select("kind", "normal", "surrogate", "ok"))
        done = done.unionByName(judged.where("ok").drop("ok"))
        open_ = judged.where("NOT ok").select("kind", "normal")
        if open_.isEmpty():
            return done
    raise AssertionError("64 drawn characters collide")


def replaced(docs: DataFrame, key: str, text: str = "text", ident: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with its text rewritten, and the name of an added column: the kinds replaced, in text order."""
    if not key:
        raise ValueError("surrogates need a secret key")
    found, hashed, salt, parts, kinds = (fresh(docs, x) for x in ("found", "text_hash", "salt", "parts", "kinds"))
    void = [f.name for f in docs.schema.fields if isinstance(f.dataType, NullType)]  # Parquet has no such type
    rows, _ = written(docs.drop(*void).withColumn(found, mentions(F.col(text))))
    hit = F.coalesce(F.size(found), F.lit(0)) > 0
    marked = rows.where(hit).withColumns({hashed: F.sha2(F.col(text).cast("binary"), 256), salt: F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int")})
    each = marked.select(F.col(hashed).alias("hashed"), F.col(salt).alias("salt"), F.col(found).alias("found")).groupBy("hashed", "salt").agg(F.first("found").alias("found"))
    each = each.select("hashed", "salt", F.posexplode("found").alias("place", "mention"))
    each = each.select("hashed", "salt", "place", F.posexplode(F.expr(pieces("mention"))).alias("u", "piece")).select("hashed", "salt", "place", "u", "piece.*")
    each = cut(each.withColumn("normal", F.expr(normal("kind", "raw"))))
    entities = cut(each.where("kind IS NOT NULL").groupBy("kind", "normal").agg(F.count(F.lit(1)).alias("n")))
    table = surrogates(entities, key)
    least = (entities.agg(F.sum("n")).first()[0] or 0) * HEAVY
    heavy = table.join(entities.where(F.col("n") >= max(2, least)).drop("n"), ["kind", "normal"]).withColumnRenamed("surrogate", "common")
    each = each.join(F.broadcast(heavy), ["kind", "normal"], "left")
    usual = each.where("kind IS NOT NULL AND common IS NULL").join(table, ["kind", "normal"])
    settled = each.where("kind IS NULL OR common IS NOT NULL").withColumn("surrogate", F.col("common"))
    new = F.when(F.col("kind").isNull(), F.col("keep")).otherwise(F.concat("keep", F.expr(laid_out("kind", "raw", "surrogate"))))
    each = usual.unionByName(settled).select("hashed", "salt", "place", "u", new.alias("new"), F.when(F.col("kind").isin("GIVEN", "SURNAME"), "PERSON").otherwise(F.col("kind")).alias("kind"))
    whole = each.groupBy("hashed", "salt").agg(F.array_sort(F.collect_list(F.struct("place", "u", "new", "kind"))).alias(parts))
    joined = marked.join(whole.withColumnsRenamed({"hashed": hashed, "salt": salt}), [hashed, salt])
    gaps = fresh(joined, "gaps")
    joined = joined.withColumn(gaps, F.split(F.col(text), PATTERN, -1))
    filled = F.transform(parts, lambda x: F.concat(F.when(x.u == 0, F.element_at(F.col(gaps), x.place + 1)).otherwise(F.lit("")), x.new))
    rewritten = joined.withColumn(text, F.concat(F.array_join(filled, ""), F.element_at(F.col(gaps), -1)))
    rewritten = rewritten.withColumn(kinds, F.transform(F.filter(parts, lambda x: (x.u == 0) & x.kind.isNotNull()), lambda x: x.kind))
    others = rows.where(~hit).withColumn(kinds, F.array().cast("array<string>"))
    columns = [F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in [*docs.columns, kinds]]
    return others.select(columns).unionByName(rewritten.select(columns)), kinds


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Per document doc_id, text with surrogates, n_entities and the kinds in text order."""
    out, kinds = replaced(docs.select("doc_id", "text"), key)
    return out.select("doc_id", "text", F.size(kinds).cast("long").alias("n_entities"), F.col(kinds).alias("kinds"))


def rewrite(docs: DataFrame, key: str) -> DataFrame:
    """All documents with surrogates in their texts, with the columns of ``docs``."""
    out, kinds = replaced(docs, key)
    return out.drop(kinds).select(*[F.col(f"`{c}`") for c in docs.columns])
