"""PII surrogates: detected entities get keyed, type-consistent replacements.

A mention is reduced to the entity behind it: a phone number, card or IBAN to its digits and letters,
an e-mail address to small letters, a person's name to given name and surname apart. The surrogate
is drawn for the entity and written in the form of the mention, so that mentions of one entity agree
however they are spaced, and "Mrs. Anna Schmidt", "Anna Schmidt" and "Mrs. Schmidt" remain one
person. Surrogates of all distinct entities are checked against each other and against the real
entities; those that collide are drawn again.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut, fresh

#: Given names that are known with their gender.
GIVEN = {
    ("latin", "f"): "Aisha Alice Amina Anna Carla Chiara Clara Elena Emma Eva Fatima Giulia Hannah Ines Ingrid Julia Laura Lena Leila Lucia Maria Marie Mei Nina Olivia Paula Priya Sarah Sofia Susan Yuki".split(),
    ("latin", "m"): "Adam Ahmed Carlos David Daniel Diego Erik Felix Giovanni Hiroshi Hugo Ivan James John Jonas Leon Louis Lucas Marco Martin Michael Mohammed Omar Oscar Pablo Paul Peter Raj Robert Thomas Wei".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
_GENDER = {n: k for k, names in GIVEN.items() for n in names}
_TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sr": "m",
    "Sra": "f", "Signor": "m", "Signora": "f", "Don": "m", "Doña": "f", "господин": "m", "Господин": "m", "госпожа": "f", "Госпожа": "f",
}
_TITLES |= {t.upper(): g for t, g in _TITLES.items()}
#: Words after which a capitalised name stands.
_CONTEXT = ["name is", "Name is", "name:", "Name:", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут"]
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*[^\W_]"
_CYRILLIC = re.compile("[А-яЁё]")
_SURNAME = "(?:ов|ев|ёв|ин|ын|ский|цкий|ова|ева|ёва|ина|ына|ская|цкая)"
_FATHER = "(?:ович|евич|ич|овна|евна|ична)"
#: Parts of invented names.
_SYLLABLES = {"latin": [c + v for c in "bdfgklmnprstvz" for v in "aeiou"], "cyrillic": [c + v for c in "бвгдзклмнпрстф" for v in "аеиоу"]}
_ENDS = {("latin", "f"): ["na", "lia", "ra"], ("latin", "m"): ["no", "rus", "mir"], ("latin", "n"): ["el", "is"], ("cyrillic", "f"): ["на", "ла", "ра"], ("cyrillic", "m"): ["мир", "слав", "дан"], ("cyrillic", "n"): ["ель"]}
_TAIL = {("latin", "n"): ["son", "ley", "mann", "ert", "ini", "ard", "ez", "ton"], ("cyrillic", "m"): ["ов", "ев", "ин", "ский"], ("cyrillic", "f"): ["ова", "ева", "ина", "ская"]}
NUMBERED = re.compile(
    r"(?P<email>(?<![A-Za-z0-9À-ÿ._%+\-])[A-Za-z0-9À-ÿ._%+\-]++@[A-Za-z0-9À-ÿ\-]+(?:\.[A-Za-z0-9À-ÿ\-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<secret>\b(?:[0-9a-f]{32,}|(?:sk|pk|ghp|AKIA)[-_]?[A-Za-z0-9]{16,})\b)"
    r"|(?P<ip6>(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::|[0-9A-Fa-f]{1,4})(?::?[0-9A-Fa-f]{1,4}){0,6}(?![\w:]))"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ ]?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|0\d{1,4}/\d{5,9}|0\d{2,3} \d{3} \d{2} \d{2})(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\w))"
)
NAMED = re.compile(
    rf"\b(?P<title>{'|'.join(_TITLES)})\.? (?P<titled>{_NAME}(?: {_NAME})?)"
    rf"|\b(?:{'|'.join(_CONTEXT)}) (?P<told>{_NAME} {_NAME})"
    rf"|\b(?P<last>[А-ЯЁ][а-яё]+{_SURNAME}) (?P<first>{'|'.join(GIVEN['cyrillic', 'f'] + GIVEN['cyrillic', 'm'])})\b(?: (?P<father>[А-ЯЁ][а-яё]+{_FATHER})\b)?"
    rf"|\b(?P<person>(?:{'|'.join(_GENDER)})(?: [А-ЯЁ][а-яё]+{_FATHER}\b)? {_NAME})"
)
_TOKEN = re.compile(_NAME)
_POSSESSIVE = re.compile("['’]s$")
_STARTS = {*_TITLES, *(t + "." for t in _TITLES), *_GENDER, *(c.split()[-1] for c in _CONTEXT)}
_DIGIT_OR_AT = re.compile("[0-9@]+")
#: More than the longest mention of a kind that may hold spaces.
_LONGEST = 64
_SPACE = re.compile(r"\s")
_VERSION = re.compile(r"(?i)\b(?:v|ver|version|release|build)\.?\s*$")

Entity = tuple[str, str, int, int]  # kind, entity, span of the mention


def canonical(kind: str, mention: str) -> str:
    """The entity behind a mention of a kind other than names."""
    if kind == "email":
        return mention.lower()
    if kind in ("phone", "card", "iban"):
        return "".join(c for c in mention if c.isalnum() or c == "+")
    return ipaddress.IPv6Address(mention).exploded if kind == "ip6" else mention


def _address6(mention: str) -> bool:
    try:
        ipaddress.IPv6Address(mention)
    except ValueError:
        return False
    return any(len(g) == 4 for g in mention.split(":"))


def _person(text: str, a: int, b: int, gender: str = "n") -> Iterator[Entity]:
    """Given names and surname of a full name at a span; one word alone is a surname unless it is a known given name."""
    words = list(_TOKEN.finditer(text, a, b))
    for k, m in enumerate(words):
        name = _POSSESSIVE.sub("", m[0])
        if k + 1 < len(words) or (k == 0 and name in _GENDER):
            father = k > 0 and re.fullmatch(f".+{_FATHER}", name)
            own = _GENDER[name][1] if name in _GENDER else gender
            yield ("father" if father else "given"), (name if father else f"{own}:{name}"), m.start(), m.start() + len(name)
        else:
            yield "surname", name, m.start(), m.start() + len(name)


def _numbered_parts(text: str) -> Iterator[tuple[int, int]]:
    """Spans of whole words that hold a digit or an @, joined where these are at most _LONGEST apart.

    Every mention that NUMBERED can find starts in one of them. They are apart from each other, so a
    text is read once however long its words are and however dense its numbers.
    """
    begin = end = last = -1
    for hit in _DIGIT_OR_AT.finditer(text):
        at = hit.start()
        if begin >= 0 and at > last + _LONGEST and at > end:
            space = _SPACE.search(text, last)
            end = space.start() if space else len(text)
        if begin < 0 or (at > last + _LONGEST and at > end):
            if begin >= 0:
                yield begin, end
            begin = max(end, text.rfind(" ", max(end, 0), at), text.rfind("\n", max(end, 0), at)) + 1
        last = hit.end()
        end = max(end, last)
    if begin >= 0:
        space = _SPACE.search(text, last)
        yield begin, space.start() if space else len(text)


def entities(text: str) -> Iterator[Entity]:
    """Kind, entity and span of each mention of a text, in order and apart from each other.

    All kinds but names hold a digit or an @, so only the words around those are matched; names are
    looked for where a title, a given name or a word of introduction is among the words. A name that
    was found once is found again wherever it stands alone in the same text.
    """
    found: list[Entity] = []
    for begin, end in _numbered_parts(text):
        for m in NUMBERED.finditer(text, begin, min(len(text), end + _LONGEST)):
            if m.start() >= end:
                break
            kind = m.lastgroup
            if (kind == "ip6" and not _address6(m[0])) or (kind == "ip" and _VERSION.search(text, max(0, m.start() - 12), m.start())):
                continue
            found.append((kind, canonical(kind, m[0]), m.start(), m.end()))
    words = set(text.split())
    if not _STARTS.isdisjoint(words) or not _STARTS.isdisjoint({w.lstrip("\"'([{<«„“‚‘-–—.,;:") for w in words if not w[0].isalnum()}):
        names: list[Entity] = []
        for m in NAMED.finditer(text):
            if m["title"]:
                names += _person(text, *m.span("titled"), _TITLES[m["title"]])
            elif m["last"]:
                names.append(("surname", m["last"], *m.span("last")))
                names.append(("given", f"{_GENDER[m['first']][1]}:{m['first']}", *m.span("first")))
                if m["father"]:
                    names.append(("father", m["father"], *m.span("father")))
            else:
                names += _person(text, *m.span("told" if m["told"] else "person"))
        known = {text[a:b]: (kind, entity) for kind, entity, a, b in names}
        if known:
            alone = ((m.start(), _POSSESSIVE.sub("", m[0])) for m in _TOKEN.finditer(text))
            names += [(*known[name], at, at + len(name)) for at, name in alone if name in known]
        # A name that was found by its form comes before one that was found again.
        found += names
        found.sort(key=lambda e: e[2])
    end = 0
    for e in found:
        if e[2] >= end:
            yield e
            end = e[3]


def _stream(key: bytes, kind: str, entity: str, attempt: int) -> Iterator[int]:
    n = 0
    while True:
        yield from hmac.digest(key, f"{kind}\0{entity}\0{attempt}\0{n}".encode(), hashlib.sha256)
        n += 1


def _letters(value: str, draw: Iterator[int]) -> str:
    """The same pattern of letters, digits and marks, with other letters and digits."""
    out = []
    for c in value:
        r = next(draw)
        if c.isdigit():
            out.append("0123456789"[r % 10])
        elif "a" <= c <= "z" or "à" <= c <= "ÿ":
            out.append(chr(97 + r % 26))
        elif "A" <= c <= "Z" or "À" <= c <= "Þ":
            out.append(chr(65 + r % 26))
        elif "а" <= c <= "я":
            out.append(chr(0x430 + r % 32))
        elif "А" <= c <= "Я":
            out.append(chr(0x410 + r % 32))
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    return sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _country_code(digits: str) -> int:
    """Length of the country code at the start of an international number."""
    if digits[:1] in ("1", "7"):
        return 1
    two = digits[:2]
    return 2 if two in "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split() else 3


@lru_cache(64)
def _swapped(key: bytes, script: str, gender: str) -> dict[str, str]:
    """Each known given name's replacement: the next in a keyed order, so none stays and no two meet."""
    order = sorted(GIVEN[script, gender], key=lambda n: hmac.digest(key, n.encode(), hashlib.sha256))
    return dict(zip(order, [*order[1:], order[0]], strict=True))


def _invented(script: str, draw: Iterator[int], syllables: int, ends: list[str]) -> str:
    pick = lambda x: x[(next(draw) << 8 | next(draw)) % len(x)]
    return ("".join(pick(_SYLLABLES[script]) for _ in range(syllables)) + pick(ends)).capitalize()


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity: the same for every mention, another for another attempt."""
    draw = _stream(key, kind, entity, attempt)
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{_letters(local, draw)}@{_letters(host, draw)}.{top}"
    if kind == "ip":
        return ".".join(str(1 + next(draw) % 254) for _ in range(4))
    if kind == "ip6":
        group = lambda g: "0000" if int(g, 16) == 0 else format(int(g, 16) and _same_width(len(g.lstrip("0")), next(draw) << 8 | next(draw)), "x").zfill(4)
        return ":".join(group(g) for g in entity.split(":"))
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", entity):
            return "".join("0123456789abcdef"[next(draw) % 16] for _ in entity)
        return entity[:2] + _letters(entity[2:], draw)
    if kind == "iban":
        made = entity[:2] + "00" + _letters(entity[4:], draw)
        return f"{made[:2]}{98 - _mod97(made):02d}{made[4:]}"
    if kind == "card":
        made = _letters(entity, draw)
        if _luhn(entity) == 0:  # a valid number stays valid
            return next(made[:-1] + last for last in "0123456789" if _luhn(made[:-1] + last) == 0)
        return made
    if kind == "phone":
        head = 1 + _country_code(entity[1:]) if entity.startswith("+") else 0
        return entity[:head] + _letters(entity[head:], draw)
    script = "cyrillic" if _CYRILLIC.search(entity) else "latin"
    if kind == "given":
        gender, _, name = entity.partition(":")
        if _GENDER.get(name) == (script, gender):
            return _swapped(key, script, gender)[name]
        while (made := _invented(script, draw, 2, _ENDS[script, gender])) in _GENDER:
            pass
        return made
    if kind == "father":
        return _invented(script, draw, 2, ["рович", "нович"] if entity.endswith("ч") else ["ровна", "новна"])
    if kind == "surname":
        gender = "n" if script == "latin" else "f" if entity.endswith(("а", "я")) else "m"
        return "".join(p if p in "-'’" else _invented(script, draw, 3, _TAIL[script, gender]) for p in re.split("([-'’])", entity) if p)
    return _letters(entity, draw)


def _same_width(width: int, drawn: int) -> int:
    low = 16 ** (width - 1)
    return low + drawn % (16**width - low)


def rendered(kind: str, mention: str, made: str) -> str:
    """The surrogate in the form of a mention: its case, its spaces and marks."""
    if kind == "email" and len(made) == len(mention):
        return "".join(c.upper() if m.isupper() else c for c, m in zip(made, mention, strict=True))
    if kind in ("phone", "card", "iban"):
        own = iter(c for c in made if c.isalnum())
        return "".join(next(own) if c.isalnum() else c for c in mention)
    if kind == "ip6":
        left, _, right = mention.partition("::")
        groups, own = [g for g in left.split(":") if g], made.split(":")
        after = [g for g in right.split(":") if g]
        show = lambda gs, at: ":".join(own[at + i].lstrip("0").rjust(len(g), "0") if int(g, 16) else g for i, g in enumerate(gs))
        text = show(groups, 0) + ("::" if "::" in mention else "") + show(after, 8 - len(after))
        return text.upper() if mention.upper() == mention else text
    if kind in ("given", "surname", "father") and len(mention) > 1 and mention.isupper():
        return made.upper()
    return made


def found_entities(docs: DataFrame) -> DataFrame:
    """kind, value of every distinct entity of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list({e[:2] for x in batch.column(0) if x.is_valid for e in entities(x.as_py())})
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "value"])

    return fresh(docs, "text").mapInArrow(run, "kind string, value string").distinct()


def _draw(rows: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, value, attempt = (batch.column(c).to_pylist() for c in range(3))
            made = [surrogate(k, v, key, a) for k, v, a in zip(kind, value, attempt, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.string())], names=["kind", "value", "attempt", "made"])

    return rows.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, made string")


def drawn_again(docs: DataFrame, key: bytes, rounds: int = 64) -> DataFrame:
    """kind, value, made for the entities whose first surrogate is taken, after collision checks.

    A surrogate is taken if a smaller entity of the kind has it too or if it is a real entity. Each
    round draws again only what collides; a drawing that is settled is never changed. Known given
    names are exchanged among themselves, so that each stands for another real one.
    """
    real = cut(found_entities(docs), "entities")
    every = cut(_draw(real.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(rounds):
        first = every.groupBy("kind", "made").agg(F.min(F.struct("attempt", "value")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        taken = every.join(first, ["kind", "made"]).where("struct(attempt, value) <> owner").select("kind", "value", "attempt")
        clash = every.where("kind <> 'given'").join(real.select("kind", F.col("value").alias("made")), ["kind", "made"], "left_semi").select("kind", "value", "attempt")
        again = cut(taken.union(clash).distinct(), "again")
        if again.isEmpty():
            break
        moved = _draw(again.withColumn("attempt", F.expr("attempt + 1")), key)
        every = cut(every.join(again, ["kind", "value"], "left_anti").select("kind", "value", "attempt", "made").union(moved), "surrogates", instead_of=every)
    else:
        raise RuntimeError("surrogates still collide: a format has too few values for its entities")
    return every.where("attempt > 0").select("kind", "value", "made")


def replace_pii(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and n_entities, the number of spans replaced.

    A given name and a surname are two spans. Null texts stay null with 0 entities; empty texts stay
    empty; texts of any length are read whole. Every other column and every row is kept, repeated
    rows too, which are changed alike; a column that is called n_entities already is replaced. An
    empty table gives an empty result.
    """
    plain = docs.select("doc_id", F.col(text).alias("text"))
    again = cut(drawn_again(plain, key), "drawn_again")
    columns = [c for c in docs.columns if c != "n_entities"]
    packed = docs.select(F.struct(*columns).alias("row"))

    def rewrite(values: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for t, other in values:
            out = []
            for x, o in zip(t, other, strict=True):
                if not x.is_valid:
                    out.append({"text": None, "n": 0})
                    continue
                s, known = x.as_py(), dict(o.as_py() or [])
                parts, at, n = [], 0, 0
                for kind, entity, a, b in entities(s):
                    parts += [s[at:a], rendered(kind, s[a:b], known.get(f"{kind}\0{entity}") or surrogate(kind, entity, key))]
                    at, n = b, n + 1
                out.append({"text": "".join([*parts, s[at:]]), "n": n})
            yield pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int64())]))

    changed = F.arrow_udf(rewrite, "struct<text: string, n: bigint>")
    if again.isEmpty():
        rows = packed.withColumn("other", F.expr("cast(null as map<string, string>)"))
    else:
        mentions = _mentions(plain).join(again, ["kind", "value"]).groupBy("_id").agg(F.expr("map_from_entries(collect_set(struct(concat(kind, '\\u0000', value), made)))").alias("other"))
        rows = packed.join(mentions, F.col("row.doc_id").eqNullSafe(F.col("_id")), "left").select("row", "other")
    rows = rows.withColumn("new", changed(F.col(f"row.{text}"), F.col("other")))
    return rows.select(*[F.col("new.text").alias(text) if c == text else F.col(f"row.{c}") for c in columns], F.col("new.n").alias("n_entities"))


def _mentions(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, v) for i, x in enumerate(batch.column(1)) if x.is_valid for k, v in {e[:2] for e in entities(x.as_py())}]
            i, k, v = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i, pa.int64())), pa.array(k, pa.string()), pa.array(v, pa.string())], names=["_id", "kind", "value"])

    return docs.select("doc_id", "text").mapInArrow(run, f"_id {docs.schema['doc_id'].dataType.simpleString()}, kind string, value string")
