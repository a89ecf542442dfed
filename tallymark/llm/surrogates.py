"""Personal data replaced by keyed surrogates of the same type."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.session import stored

ROWS = 256

# Titles by the gender they tell; given names by script and gender; syllables of invented family names.
TITLES = {
    "m": "Mr|Sir|Herr|Monsieur|M|Señor|Sr|Don|Signor|Господин|Κύριος", "f": "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|Signora|Госпожа|Κυρία",
    "n": "Dr|Prof|Professor|Доктор|Δρ"}
GIVEN = {
    ("latin", "m"): "Adam Bruno Caspar David Emil Felix Gustav Hugo Ivan Jonas Karl Leon Martin Nils Oskar Paul Rafael Simon Tomas Viktor".split(),
    ("latin", "f"): "Ada Berta Clara Diana Elena Frida Greta Hanna Ida Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tilda Vera".split(),
    ("latin", "n"): "Alex Robin Kim Sam Jean Andrea Chris Dominique Sasha Noel".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Лариса Мария Нина".split(),
    ("cyrillic", "n"): "Саша Женя Валя".split(),
    ("greek", "m"): "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Λεωνίδας Μάριος Νίκος".split(),
    ("greek", "f"): "Άννα Βασιλική Δήμητρα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("greek", "n"): "Αλέξ Δανάη".split()}
SYLLABLES = {
    "latin": "ba be bo da de do fa ga go ka ke ko la le lo ma me mo na ne no pa ra re ro sa se so ta te to va ve vo za zo".split(),
    "cyrillic": "ба бе во га да до жа за ка ко ла ле ма мо на но па ра ро са со та то фа ха ша".split(),
    "greek": "βα γα δε ζα θα κα κο λα λο μα μο να νο πα ρα ρο σα σο τα το φα χα".split()}
ALPHABET = {"lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "hex": "0123456789abcdef"}

NAME = r"\p{Lu}[\p{L}'’-]+"
# Every kind of entity is one named group; where two could match, the one that comes first does.
DATA = regex.compile(
    r"(?P<email>(?<![\w.+-])[\w.%+-]+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?(?:\.[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?)+)"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<secret>(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[A-Z0-9]{16}|(?:sk|pk|ghp|gho|xox[abp])[-_][\w-]{16,})(?!\w))"
    r"|(?P<card>(?<![\w+.])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?![\w-]))")
_TITLE = rf"(?:{'|'.join(TITLES.values())})(?!\w)"
# A run of titles, and one or two names that are no titles themselves.
NAMED = regex.compile(rf"(?<!\w)(?P<titles>(?:{_TITLE}\.? +)+)(?P<name>(?!{_TITLE}){NAME}(?: (?!{_TITLE}){NAME})?)")
PREFIX = re.compile(r"(?:AKIA|ASIA|(?:sk|pk|ghp|gho|xox[abp])[-_])")
# Names that are plain words too. One that begins a sentence and is followed by a small letter is the word.
WORDS = frozenset(
    "april art august bill black brown bush chase cook dean drew faith field frank gene grace grant green guy hill hope hunter jack joy june king lance "
    "long mark mason may miles norm page pat penny pierce price ray rich rob rock rose rusty sky stone sue summer violet wade white will wood young".split())
OPENS = regex.compile(r"(?:^|[.!?…]['\"”’)]*\s+|\n\s*)$")
# What may be a later mention of a name, and the parts of a word.
CAPITAL = regex.compile(r"(?<!\w)\p{Lu}[\p{L}'’-]*")
PART = regex.compile(r"[^'’-]+")
POSSESSIVE = regex.compile(r"(?:['’][sS]|['’-]+)$")
# All data has an "@", an ASCII digit or a key's prefix, all names a title: only words around such a place are looked at.
PLACE = re.compile(r"[@0-9]|\b(?:AKIA|ASIA|sk[-_]|pk[-_]|gh[po][-_]|xox[abp][-_])|(?P<title>\b(?:" + "|".join(TITLES.values()) + r")\b)")
AROUND = re.compile(r"\S*(?: (?:[^\s0-9]*[0-9]\S*|[A-Z0-9]{1,4}\b))*")


class Found(NamedTuple):
    kind: str
    normal: str  # equal for all mentions of one entity
    start: int
    end: int
    gender: str = ""  # of a given name, where a title of this mention tells it


def script_of(word: str) -> str:
    first = next((c for c in word if c.isalpha()), "a")
    return "cyrillic" if "Ѐ" <= first <= "ԯ" else "greek" if "Ͱ" <= first <= "Ͽ" or "ἀ" <= first <= "῾" else "latin"


def find(text: str) -> list[Found]:
    """Entities of a text from left to right. A name is found by its titles; given and family name are apart.

    Capitalised words of the text that a found name is written with are found too, with or without a title, but for
    ``WORDS`` where they read as plain words. A name that never follows a title, or that is written in lower case, is not
    found; nor are IPv6 addresses, dates of birth, and phone numbers without a country or area code in one of the usual
    writings. A long number is a card only if its check digit is right.
    """
    out, names, end = [], {}, 0
    for place in PLACE.finditer(text):
        at = place.start()
        if at < end:
            continue
        if place.lastgroup:
            m = NAMED.match(text, at)
            if m:
                out += names_in(m)
                end = m.end()
                for f in names_in(m):
                    names.setdefault(f.normal, f.kind)
            continue
        while at > end and not text[at - 1].isspace():
            at -= 1
        end = AROUND.match(text, at).end()
        out += [d for m in DATA.finditer(text, at, end) if (d := data_in(m)).kind != "card" or luhn(d.normal) == 0]
    return with_mentions(text, out, names) if names else out


def with_mentions(text: str, found: list[Found], names: dict[str, str]) -> list[Found]:
    """``found`` with the other mentions of ``names`` (kind by normal form), in order. A mention may be part of a word."""
    longest = max(len(PART.findall(x)) for x in names)
    out, k = [], 0
    for word in CAPITAL.finditer(text):
        parts = [m.span() for m in PART.finditer(text, word.start(), word.end())]
        i = 0
        while i < len(parts):
            at = parts[i][0]
            step = 1
            for n in range(min(longest, len(parts) - i), 0, -1):
                end = parts[i + n - 1][1]
                normal = text[at:end].casefold()
                if normal in names and text[at].isupper() and not regex.match(r"\w", text[end:end + 1]) and not plain_word(text, at, end, normal):
                    while k < len(found) and found[k].end <= at:
                        out.append(found[k])
                        k += 1
                    if k == len(found) or end <= found[k].start:
                        out.append(Found(names[normal], normal, at, end))
                    step = n
                    break
            i += step
    return out + found[k:]


def plain_word(text: str, at: int, end: int, normal: str) -> bool:
    """Whether a name that is a word too begins a sentence and goes on in small letters, as a word would."""
    return normal in WORDS and text[end:end + 1] == " " and text[end + 1:end + 2].islower() and bool(OPENS.search(text, max(0, at - 8), at))


def names_in(m) -> list[Found]:
    told = {g for t in re.findall(r"\w+", m["titles"]) for g in "mf" if t in TITLES[g].split("|")}
    gender = told.pop() if len(told) == 1 else ""
    words = [(w.start() + m.start("name"), POSSESSIVE.sub("", w.group())) for w in re.finditer("[^ ]+", m["name"])]
    return [Found(f"{'given' if i < len(words) - 1 else 'family'}-{script_of(w)}", w.casefold(), at, at + len(w), gender if i < len(words) - 1 else "")
            for i, (at, w) in enumerate(words)]


def data_in(m) -> Found:
    kind, span = m.lastgroup, m.group()
    if kind == "email" or kind == "secret" and regex.fullmatch("[0-9a-fA-F]+", span):
        normal = span.lower()
    elif kind in ("ip", "secret"):
        normal = span
    else:
        normal = regex.sub(r"[^\p{L}\p{N}+]", "", span)
    return Found(kind, normal, m.start(), m.end())


class Stream:
    """Draws from HMAC-SHA256 under a key: a function of the entity and the attempt only."""

    def __init__(self, key: bytes, *name: str):
        self.key, self.name, self.block, self.left = key, "\x00".join(name), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, f"{self.name}\x00{self.block}".encode(), hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value * n >> 32


def luhn(digits: str) -> int:
    double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10


def iban_check(normal: str) -> int:
    """The remainder of an IBAN in normal form; 1 where its check digits are right."""
    return int("".join(str(int(c, 36)) for c in normal[4:] + normal[:4])) % 97


def surrogate(key: bytes, kind: str, normal: str, attempt: int, gender: str = "") -> str:
    """A replacement in normal form. Letters stay letters and digits digits; every eighth attempt adds a character.

    Prefixes that tell the kind of a key stay, and right check digits of cards and IBANs stay right.
    """
    draw = Stream(key, kind, normal, str(attempt))
    extra = attempt // 8
    role, _, rest = kind.partition("-")
    if role == "ip":
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if role == "family":
        syllables = SYLLABLES[rest]
        return "".join(syllables[draw.below(len(syllables))] for _ in range(3 + extra))
    if role == "given":
        names = GIVEN[rest, gender or "n"]
        more = "".join(SYLLABLES[rest][draw.below(len(SYLLABLES[rest]))] for _ in range((attempt + 1) // 2))
        return names[draw.below(len(names))].casefold() + more
    letters = ALPHABET["hex"] if regex.fullmatch("[0-9a-f]{32,}", normal) else None
    keep = {"email": normal.rfind(".") if "@" in normal else len(normal), "iban": None, "phone": None}.get(role)
    prefix = len(PREFIX.match(normal).group()) if role == "secret" and PREFIX.match(normal) else 0
    out = []
    for i, c in enumerate(normal):
        if keep is not None and i >= keep or i < prefix or role == "iban" and i < 2 or role == "phone" and i < 2 and normal[0] in "+0":
            out.append(c)
        elif letters:
            out.append(letters[draw.below(16)])
        elif c.isdigit():
            out.append(ALPHABET["digit"][draw.below(10) if i else 1 + draw.below(9)])
        elif c.isalpha():
            new = ALPHABET["lower"][draw.below(26)]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    made = "".join(out)
    if role == "card":
        made = made[:-1] + str(next(d for d in range(10) if (luhn(made[:-1] + str(d)) == 0) == (luhn(normal) == 0)))
    if role == "iban" and iban_check(normal) == 1:
        made += "".join(ALPHABET["digit"][draw.below(10)] for _ in range(extra))
        return made[:2] + f"{98 - iban_check(made[:2] + '00' + made[4:]):02d}" + made[4:]
    if extra and role == "email":
        return "".join(ALPHABET["lower"][draw.below(26)] for _ in range(extra)) + made
    return made + "".join(ALPHABET["digit"][draw.below(10)] for _ in range(extra))


def rendered(kind: str, original: str, new: str) -> str:
    """A surrogate in the writing of a mention: its separators, and its case letter by letter or as a whole."""
    if kind.startswith(("given", "family")):
        return new.upper() if original.isupper() and len(original) > 1 else new[:1].upper() + new[1:]
    if kind == "ip":
        return new
    left, out = list(new), []
    for i, c in enumerate(original):
        kept = c.isalnum() or kind == "email" or kind == "secret" or c == "+"
        if kept and left:
            c2 = left.pop(0)
            out.append(c2.upper() if c.isupper() else c2)
        elif not kept:
            out.append(c)
    tail = "".join(left)
    return "".join(out) + (tail.upper() if original.isupper() else tail)


FOUND = "array<struct<kind:string,normal:string,start:int,end:int,gender:string>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("normal", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("gender", pa.string())]))


def _detect(text_col: str, kept: list[str], wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = [find(x.as_py() or "") for x in part[text_col]]
                which = pa.array([i for i, f in enumerate(found) if bool(f) == wanted], pa.int64())
                lists = pa.array([[f._asdict() for f in x] for x in found], _FOUND).take(which)
                yield pa.RecordBatch.from_arrays([*[part[c].take(which) for c in kept], lists], [*kept, "_s_found"])
    return run


def _made(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch[c].to_pylist() for c in ("kind", "normal", "gender")]
            new = [surrogate(key, k, n, attempt, g) for k, n, g in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch["kind"], batch["normal"], batch["gender"], pa.array(new, pa.string())], ["kind", "normal", "gender", "new"])
    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, new) for distinct (kind, normal, gender): no two of a kind share a surrogate, and none is a real value.

    Each round draws for what is still open. A value goes to a real entity or an earlier winner first, then to the
    smallest of those that drew it; the others draw again. Rounds shrink fast, and the alphabet grows with attempts.
    """
    real = entities.select("kind", F.col("normal").alias("new"), F.lit(0).alias("late"), F.lit("").alias("normal"))
    pending, done, attempt = entities, None, 0
    while True:
        drawn = stored(pending.mapInArrow(_made(key, attempt), "kind string, normal string, gender string, new string"), "drawn")
        claims = real.unionByName(drawn.drop("gender").withColumn("late", F.lit(1)))
        if done is not None:
            claims = claims.unionByName(done.select("kind", "new", F.lit(0).alias("late"), F.lit("").alias("normal")))
        winners = claims.groupBy("kind", "new").agg(F.min(F.struct("late", "normal")).alias("w")).where("w.late = 1").select(
            "kind", "new", F.col("w.normal").alias("normal"))
        won = stored(winners.join(drawn, ["kind", "new", "normal"], "left_semi").select("kind", "normal", "new"), "surrogates")
        done = won if done is None else done.unionByName(won)
        pending = stored(drawn.join(won, ["kind", "normal"], "left_anti").select("kind", "normal", "gender"), "pending")
        if pending.isEmpty():
            return done
        attempt += 1


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every entity in the text replaced, plus ``n_replaced`` and ``replaced`` (kind, start, end, surrogate).

    Mentions of one entity get one surrogate in the whole table, distinct entities distinct ones, under ``key`` alone;
    gender (of a given name: what its titles in the whole table agree on, else none), script, key prefixes, separators, case, valid check digits and lengths are kept. ``start`` and ``end``
    are code points of the new text. People are found by a title; the other capitalised mentions of the names found so in a
    text are replaced too. Names without any title in a text are out of reach. Only texts that hold an entity are written and shuffled. Null and empty texts stay
    as they are, with no replacements. Repeated rows and null ids are kept; other columns too, except that input columns
    with the names of results are replaced.
    """
    kept = [c for c in docs.columns if c not in ("n_replaced", "replaced")]
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept)
    spans = "array<struct<kind:string,start:int,end:int,surrogate:string>>"
    plain = docs.select(*kept).mapInArrow(_detect(text_col, kept, False), f"{schema}, _s_found {FOUND}").drop("_s_found").select(
        *kept, F.lit(0).alias("n_replaced"), F.array().cast(spans).alias("replaced"))
    found = stored(docs.select(*kept).mapInArrow(_detect(text_col, kept, True), f"{schema}, _s_found {FOUND}").withColumn(
        "_s_row", F.xxhash64(text_col)), "entities")
    mentions = found.select(F.col(id_col).alias("_s_id"), F.col("_s_row").alias("_s_key"), F.explode("_s_found").alias("e")).select(
        "_s_id", "_s_key", "e.kind", "e.normal", "e.gender").distinct()
    told = F.collect_set(F.nullif("gender", F.lit("")))  # two values at most
    table = assign(mentions.groupBy("kind", "normal").agg(told.alias("told")).select(
        "kind", "normal", F.when(F.size("told") == 1, F.get("told", F.lit(0))).otherwise("").alias("gender")), key)
    per_row = mentions.drop("gender").distinct().join(table, ["kind", "normal"]).groupBy("_s_id", "_s_key").agg(
        F.collect_list(F.struct("kind", "normal", "new")).alias("_s_new"))
    joined = found.join(per_row, F.col(id_col).eqNullSafe(F.col("_s_id")) & (F.col("_s_row") == F.col("_s_key"))).select(
        *kept, "_s_found", "_s_new")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts, lists = [], []
                for text, found_, new in zip(part[text_col].to_pylist(), part["_s_found"].to_pylist(), part["_s_new"].to_pylist()):
                    known = {(n["kind"], n["normal"]): n["new"] for n in new}
                    out, made, last, length = [], [], 0, 0
                    for f in found_:
                        shown = rendered(f["kind"], text[f["start"]:f["end"]], known[f["kind"], f["normal"]])
                        length += f["start"] - last
                        out += [text[last:f["start"]], shown]
                        made.append({"kind": f["kind"], "start": length, "end": length + len(shown), "surrogate": shown})
                        last, length = f["end"], length + len(shown)
                    texts.append("".join(out) + text[last:])
                    lists.append(made)
                values = {text_col: pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_arrays(
                    [*[values.get(c, part[c]) for c in kept], pa.array([len(x) for x in lists], pa.int32()), pa.array(lists, kind_of)],
                    [*kept, "n_replaced", "replaced"])

    return plain.unionByName(joined.mapInArrow(render, f"{schema}, n_replaced int, replaced {spans}"))
