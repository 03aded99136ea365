"""Personal data: detected entities get keyed surrogates of the same type, gender, script and format.

A surrogate is a keyed hash (HMAC-SHA-256 of type, canonical form and attempt) written in the entity's own shape:
digits stay digits with their separators, check digits are made right, names keep gender, script and case.
Equal entities have equal surrogates in the whole corpus; names are replaced part by part, so "Ms Smith" follows
"Anna Smith", and so do "Anna" and "Smith" alone, once the text has named her; mail domains are entities of their own.
The table of distinct entities is checked for surrogates that collide with each other or with a real entity; the
losers take the next attempt until none is left.  Documents are rewritten in place: an entity's attempt is 0 unless the
(small) table of later attempts, joined by the hash of the text, says otherwise.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tesselar.llm.common import fresh, slices, stored

#: The setting that holds the key; Spark redacts settings of such names.
KEY_SETTING = "spark.tesselar.pii.secret"
#: For tests and demonstrations, used where neither the caller nor the setting gives a key.
DEMO_KEY = b"a demonstration key"

# Titles and given names by gender (m, f, or - for any).
TITLES = {
    "m": "Mr Herr Señor Sr Don Monsieur Sir господин Κύριος".split(),
    "f": "Mrs Ms Miss Frau Señora Sra Doña Madame Mme Mlle госпожа Κυρία".split(),
    "-": "Dr Prof Professor Doctor Docteur Professeur Profesor Doktor".split(),
}
GIVEN = {
    "m": """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Hans Peter Klaus Jürgen
    Wolfgang Juan Carlos José Miguel Pedro Jean Pierre Michel François Jacques Иван Сергей Дмитрий Νίκος Γιώργος
    Christopher Anthony Steven Andrew Kevin Brian George Edward Paul Stefan Markus Andreas Uwe Dieter Luis Javier Alejandro Luc
    Olivier Nicolas Mohammed Ahmed Ali Omar Raj Arjun Rahul Hiroshi Kenji Giovanni Marco Luca Piotr Алексей Андрей""".split(),
    "f": """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Anna Maria Ursula Monika Petra
    Sabine María Carmen Isabel Lucía Marie Nathalie Isabelle Sylvie Анна Мария Елена Μαρία Ελένη
    Margaret Lisa Nancy Betty Sandra Ashley Kimberly Donna Michelle Carol Amanda Laura Angela Claudia Andrea Katrin Heike Ana
    Elena Sofía Camille Chloé Fatima Aisha Priya Ananya Yuki Giulia Chiara Agnieszka Ольга Наталья Татьяна""".split(),
}
# Syllables and gendered endings that names of each script are made of.
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve wa we za ze".split(), {"m": "n r s l rt".split(), "f": "na ra la lia nne".split(), "-": "n r s l mann".split()}),
    "cyrillic": ("ба бе бо ва ве во га го да де до за зе ка ки ко ла ле ли ло ма ме ми мо на не ни но па по ра ре ри ро са се си та те ти то".split(), {"m": "н р с л й".split(), "f": "на ра ла ня ся".split(), "-": "нко рук лик".split()}),
    "greek": ("βα βε βο γα γε δα δε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο σα σε σι τα τε τι το".split(), {"m": "νος ρος λης".split(), "f": "να ρα λη".split(), "-": "δης κος ρας".split()}),
}

# Words that come before a surname's capital, and phrases that a person's name follows.
PARTICLES = "van von der den de del della la le di da du dos bin ibn al ter".split()
CUES = ["my name is", "name:", "i am called", "signed by", "written by", "contact:", "sincerely,", "regards,", "mit freundlichen grüßen,", "ich heiße", "me llamo", "je m'appelle"]

_NAME = r"[^\W\d_](?:[^\W\d_]|[-'’](?=[^\W\d_]))+"
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(sorted({x for gs in GIVEN.values() for g in gs for x in (g, g.upper())}, key=len, reverse=True))
_FIRST = "(?=[" + "".join(sorted({x[0] for x in (_TITLE + "|" + _GIVEN).split("|")})) + "])"
_SURNAME = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_NAME}"
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "secret": r"(?i:(?<![A-Za-z])(?:token|secret|api[ _-]?key|access[ _-]?key|password|passwd|pwd)\s*[=:]\s*[\"']?)(?P<secret_value>[A-Za-z0-9_+/=-]{12,})",
    "key": r"(?<![A-Za-z0-9])(?:A[KS]IA(?=[0-9A-Z]{16}(?![A-Za-z0-9]))|[spr]k_(?:live|test)_(?=[A-Za-z0-9]{10})|gh[pousr]_(?=[A-Za-z0-9]{20})|xox[abprs]-(?=[A-Za-z0-9-]{10})|AIza(?=[\w-]{35})|eyJ(?=[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}))(?P<key_value>[\w-]+(?:\.[\w-]+\.[\w-]+)?)",
    "passport": r"(?i:(?<!\w)passport(?:\s+(?:no\.?|nr\.?|number))?\s*[:#]?\s*)(?P<passport_value>[A-Z]{0,2}\d{6,9})(?!\w)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?[\w])",
    "ipv6": r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\w)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\w|\.\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.+/-])\(?0\d{2,4}\)?[ /-]\d{3,4}[ -]?\d{3,5}(?![\w-]|[./]\d)",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "person": rf"(?<!\w){_FIRST}(?:(?P<title>(?:{_TITLE})\.?) (?P<names>(?:{_NAME} ){{0,2}}{_SURNAME})|(?P<given>{_GIVEN}) (?P<rest>{_SURNAME}))",
    "cued": rf"(?<!\w)(?i:{'|'.join(CUES)})\s+(?P<cued_names>{_NAME} {_SURNAME})",
}
#: Patterns that are searched for only in texts with one of these, in lower case, or with colons enough for an IPv6 address.
RARE = {"key": ["akia", "asia", "k_live_", "k_test_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "aiza", "eyj"], "passport": ["passport"], "ipv6": [":::"], "cued": CUES}
ENTITY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
COMMON = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items() if k not in RARE))
#: No entity lacks one of these; most texts without any are passed over at once.
_HINT = re.compile(rf"[@=:]|\+\d|\d(?:[ -]?\d){{2}}|[A-Z]{{2}}\d{{2}}|\d\.\d|(?<!\w){_FIRST}(?:{_TITLE}|{_GIVEN})(?!\w)")


class Entity(NamedTuple):
    start: int
    end: int
    type: str
    canonical: str


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10


def _issued(digits: str) -> bool:
    """Whether a card number has an issuer's prefix and length."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (
        (digits[0] == "4" and n in (13, 16, 19)) or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720)) or (n == 15 and two in (34, 37))
        or (n in (14, 16) and two in (30, 36, 38, 39)) or (16 <= n <= 19 and (four == 6011 or two in (35, 62, 64, 65))) or (12 <= n <= 19 and two in (50, 56, 57, 58, 67))
    )


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _script(text: str) -> str:
    kind = unicodedata.name(text[0], "").split(" ")[0].lower()
    return kind if kind in SYLLABLES else "latin"


def _gender(given: str) -> str:
    """The gender of a given name by itself, so that a person has one surrogate whatever the title."""
    listed = next((g for g, names in GIVEN.items() if given.capitalize() in names), None)
    return listed or ("f" if given[-1] in "aáаяαηή" else "-")


def _persons(m: re.Match, at: str) -> Iterator[Entity]:
    """The names of a match, given names by gender and the surname; only capitalized words count."""
    start = m.start(next(k for k in ("names", "given", "cued_names") if m.re.groupindex.get(k) and m[k]))
    names = []
    for word in re.finditer(_NAME, at[start : m.end()]):
        if word[0] in PARTICLES and word.end() < m.end() - start:
            continue
        if not word[0][0].isupper():
            break
        names.append((start + word.start(), start + word.end(), word[0]))
    if not names or (not m["title"] and len(names) < 2):
        return
    for lo, hi, name in names[:-1]:
        folded = name.casefold()
        yield Entity(lo, hi, "given." + _gender(folded), folded)
    lo, hi, name = names[-1]
    yield Entity(lo, hi, "surname", name.casefold())


def _mentions(text: str, found: list[Entity]) -> list[Entity]:
    """Further mentions of parts of the names in found: capitalized words, unless the text has the word in lower case too."""
    parts: dict[str, str] = {}
    for e in found:
        if e.type == "surname" or e.type.startswith("given."):
            parts.setdefault(text[e.start : e.end].casefold(), e.type)
    forms = {f: p for p in parts for f in (p[0].upper() + p[1:], p.upper(), p.title()) if f != p}
    forms |= {text[e.start : e.end]: text[e.start : e.end].casefold() for e in found if text[e.start : e.end].casefold() in parts}
    if not forms:
        return []
    whole = lambda ws: re.compile(rf"(?<![\w'’-])(?:{'|'.join(sorted(map(re.escape, ws), key=len, reverse=True))})(?![\w-])")
    common = set(whole(parts).findall(text))
    taken = {(e.start, e.end) for e in found}
    spans = sorted(taken)
    more = []
    for m in whole(forms).finditer(text):
        k = bisect.bisect_right(spans, (m.start(), len(text)))
        if forms[m[0]] in common or (k and spans[k - 1][1] > m.start()) or (k < len(spans) and spans[k][0] < m.end()):
            continue
        more.append(Entity(m.start(), m.end(), parts[forms[m[0]]], forms[m[0]]))
    return more


def _ipv6(raw: str) -> str | None:
    """The full form of an address, but none for what only looks like one (times, names with colons)."""
    if not any(map(str.isdigit, raw)):
        return None
    try:
        return ipaddress.IPv6Address(raw).exploded
    except ValueError:
        return None


def entities(text: str | None) -> list[Entity]:
    """The entities of a text in order.  A mail address is two: its local part, of the type "mail@" and domain, and its domain."""
    if not text:
        return []
    low = text.lower()
    rare = text.count(":") > 2 or any(x in low for xs in RARE.values() for x in xs)
    if not rare and not _HINT.search(text):
        return []
    pattern, kinds = (ENTITY, PATTERNS) if rare else (COMMON, [k for k in PATTERNS if k not in RARE])
    found: list[Entity] = []
    at, named = 0, False
    while m := pattern.search(text, at):
        at = m.end()
        raw = m[0]
        kind = next(k for k in kinds if m[k] is not None)
        digits = re.sub(r"\D", "", raw)
        if kind in ("person", "cued"):
            people = list(_persons(m, text))
            found += people
            named = named or bool(people)
            if not people:  # a name may begin inside
                at = m.start() + 1
        elif kind == "email":
            end = m.end() - (len(raw) - len(raw.rstrip(".-")))
            cut = text.index("@", m.start())
            domain = text[cut + 1 : end].lower()
            found += [Entity(m.start(), cut, "mail@" + domain, text[m.start() : cut].lower()), Entity(cut + 1, end, "domain", domain)]
        elif kind in ("secret", "key", "passport"):
            value = m[kind + "_value"]
            if re.search(r"\d", value):
                found.append(Entity(m.start(kind + "_value"), m.end(kind + "_value"), kind, value))
        elif kind == "ip":
            if all(int(x) < 256 for x in raw.split(".")):
                found.append(Entity(m.start(), m.end(), kind, ".".join(str(int(x)) for x in raw.split("."))))
        elif kind == "ipv6":
            if full := _ipv6(raw):
                found.append(Entity(m.start(), m.end(), kind, full))
        elif kind == "iban":
            if 15 <= len(plain := raw.replace(" ", "")) <= 34 and _mod97(plain) == 1:
                found.append(Entity(m.start(), m.end(), kind, plain))
        elif kind == "card":
            if len(digits) <= 19 and _issued(digits) and luhn(digits) == 0:
                found.append(Entity(m.start(), m.end(), kind, digits))
        elif kind == "ssn" or 7 <= len(digits) <= 15:
            found.append(Entity(m.start(), m.end(), kind, ("+" if raw[0] == "+" else "") + digits))
        else:  # too few or too many digits for a phone number: another entity may begin in them
            at = m.start() + 1
    return sorted(found + _mentions(text, found)) if named else found


class _Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str) -> None:
        self.key, self.seed, self.n, self.left = key, "\0".join(parts).encode("utf-8", "replace"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 8:
            self.left = hmac.new(self.key, self.seed + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        value, self.left = int.from_bytes(self.left[:8], "big"), self.left[8:]
        return value % n

    def like(self, c: str) -> str:
        """A character of the class of c."""
        if c.isdigit():
            return str(self.below(10))
        if "a" <= c.lower() <= "z":
            new = chr(97 + self.below(26))
            return new.upper() if c.isupper() else new
        return c


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The canonical form of an entity's surrogate."""
    d = _Draw(key, kind, canonical, str(attempt))
    if kind.startswith("mail@"):
        return "".join(d.like(c) if c.isascii() else chr(97 + d.below(26)) for c in canonical) + "".join(str(d.below(10)) for _ in range(attempt))
    if kind == "domain":
        return "".join(chr(97 + d.below(26)) for _ in range(max(4, len(canonical.split(".")[0])) + attempt)) + ".example"
    if kind == "secret":
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canonical):
            new = "".join("0123456789abcdef"[d.below(16)] for _ in canonical)
            return new.upper() if canonical.upper() == canonical else new
        return "".join(d.like(c) for c in canonical)
    if kind in ("key", "passport"):
        return "".join(d.like(c) for c in canonical)
    if kind == "ipv6":
        return ipaddress.IPv6Address((0x20010DB8 << 96) + d.below(1 << 48) * (1 << 48) + d.below(1 << 48)).exploded
    if kind == "ip":
        first = int(canonical.split(".")[0])
        private = {10: "10", 127: "127"}.get(first) or ("192.168" if canonical.startswith("192.168.") else None)
        if private and attempt:  # a range that fills up goes on in a wider one
            private = "10" if attempt < 8 else None
        head = private.split(".") if private else [str(11 + d.below(112))]
        return ".".join([*head, *(str(d.below(256)) for _ in range(3 - len(head))), str(1 + d.below(254))])
    if kind == "ssn":
        return str(900 + d.below(100)) + f"{d.below(10**6):06d}"
    if kind == "card":
        keep = 1 if canonical[0] == "4" else 4
        body = canonical[:keep] + "".join(str(d.below(10)) for _ in canonical[keep:-1])
        return body + str(-luhn(body + "0") % 10)
    if kind == "iban":
        body = "".join(d.like(c) for c in canonical[4:])
        return canonical[:2] + f"{98 - _mod97(canonical[:2] + '00' + body):02d}" + body
    if kind == "phone":
        code = re.match(r"\+(1|7|[2-9]\d)?|0", canonical)
        head = code[0] if code else ""
        rest = canonical[len(head) :]
        return head + "".join(str(2 + d.below(8)) if k == 0 else str(d.below(10)) for k, _ in enumerate(rest))
    syllables, endings = SYLLABLES[_script(canonical)]
    gender = kind.partition(".")[2] or "-"
    n = 2 + min(attempt, 4)
    return "".join(syllables[d.below(len(syllables))] for _ in range(n)) + endings[gender][d.below(len(endings[gender]))]


def _written(new: str, raw: str, kind: str) -> str:
    """A surrogate's canonical form in the shape of the entity it replaces."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(new.lstrip("+"))
        return "".join(next(chars) if c.isalnum() else c for c in raw)
    if kind in ("domain", "surname") or kind.startswith(("given.", "mail@")):
        if raw.isupper() and (len(raw) > 1 or not kind.startswith("mail@")):
            return new.upper()
        return new if kind.startswith(("domain", "mail@")) else new[0].upper() + new[1:]
    if kind == "ipv6":
        new = new if len(raw) == len(new) else ipaddress.IPv6Address(new).compressed
        return new.upper() if raw.isupper() else new
    return new


def replaced(text: str | None, attempts: dict[tuple[str, str], int], key: bytes) -> tuple[str | None, int]:
    """The text with surrogates, and how many entities it had."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for e in found:
        new = surrogate(e.type, e.canonical, attempts.get((e.type, e.canonical), 0), key)
        out += [text[at : e.start], _written(new, text[e.start : e.end], e.type)]
        at = e.end
    return "".join(out) + text[at:], sum(e.type != "domain" for e in found)


def _with_surrogates(table: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(*x, key) for x in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], ["type", "canonical", "attempt", "new"])

    return table.select("type", "canonical", "attempt").mapInArrow(run, "type string, canonical string, attempt int, new string")


def settled_attempts(found: DataFrame, key: bytes, limit: int = 50) -> DataFrame:
    """(type, canonical, attempt) of each distinct entity such that no two surrogates of a type, and no surrogate
    and real entity, are equal."""
    table = stored(found.select("type", "canonical").distinct().withColumn("attempt", F.lit(0)), "entities")
    for _ in range(limit):
        tried = stored(_with_surrogates(table, key), "surrogates")
        first = tried.groupBy("type", "new").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n")).where("n > 1")
        real = tried.select("type", F.col("canonical").alias("new"), F.lit(True).alias("real"))
        losers = tried.join(first, ["type", "new"], "left").join(real, ["type", "new"], "left")
        losers = losers.where("real OR (n > 1 AND (first.canonical != canonical))").select("type", "canonical", F.lit(1).alias("more"))
        losers = stored(losers, "collisions")
        if losers.isEmpty():
            return table
        table = stored(table.join(losers, ["type", "canonical"], "left").select("type", "canonical", (F.col("attempt") + F.coalesce("more", F.lit(0))).cast("int").alias("attempt")), "entities")
    raise ValueError("surrogates still collide; use a longer name space")


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """docs with text_col rewritten and a column n_entities (long) added last; all other columns as they are
    (but for one of that name).  The key is key, or that of the session's KEY_SETTING, or DEMO_KEY.

    A null text stays null with no entities, texts without entities stay as they are; rows with null ids and
    repeated rows are treated like any other, as ids play no part; an empty table gives no rows.
    """
    spark = docs.sparkSession
    key = key or (spark.conf.get(KEY_SETTING, None) or "").encode() or DEMO_KEY
    docs = docs.drop("n_entities")
    text = docs.select(F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(h, *e) for h, t in zip(*(c.to_pylist() for c in b.columns)) for e in sorted({(e.type, e.canonical) for e in entities(t)})]
            types = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["h", "type", "canonical"])

    found = stored(text.mapInArrow(detect, "h long, type string, canonical string"), "entity-mentions")
    later = stored(settled_attempts(found, key).where("attempt > 0"), "later-attempts")
    place, lists = docs.columns.index(text_col), len(docs.columns)
    wide = docs
    if not later.isEmpty():  # as a rule few texts; a small table of them is broadcast by its size
        h, tries = fresh(docs, "h"), fresh(docs, "tries")
        by_text = found.join(later, ["type", "canonical"]).groupBy(F.col("h").alias(h)).agg(F.collect_set(F.struct("type", "canonical", "attempt")).alias(tries))
        by_text = stored(by_text, "texts-of-later-attempts")
        wide = docs.withColumn(h, F.xxhash64(F.col(text_col))).join(by_text, h, "left").select(*docs.columns, tries)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            more = b.column(lists).to_pylist() if b.num_columns > lists else [None] * b.num_rows
            done = [replaced(t, {(a["type"], a["canonical"]): a["attempt"] for a in m or ()}, key) for t, m in zip(b.column(place).to_pylist(), more)]
            columns = b.columns[:lists]
            columns[place] = pa.array([t for t, _ in done], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n in done], pa.int64())], [*b.schema.names[:lists], "n_entities"])

    return wide.mapInArrow(rewrite, StructType([*docs.schema.fields, StructField("n_entities", LongType())]))
