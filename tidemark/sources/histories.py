"""Readers of point histories: a delimited text feed in the JVM, and HTML pages by a state machine on Arrow batches."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

#: Fixed values of the feed: what parts records, fields, and a field's key from its value.
RECORD, FIELD, VALUE = "~", "¬", "÷"
_SET = r"(?i)(?:set|сет)\s*(\d+)|(\d+)\s*[-–]?\s*(?:й\s*)?(?:set|сет)"
_TIE = r"(?i)tie[\s-]*break|тай[\s-]*брейк"


def set_number(title: Column) -> Column:
    first, second = F.regexp_extract(title, _SET, 1), F.regexp_extract(title, _SET, 2)
    return F.when(first != "", first).when(second != "", second).cast("int")


def feed_records(payloads: DataFrame) -> DataFrame:
    """doc, seq, fields (a map) of every record of ``payload``; the last of doubled keys counts, and what has no key is left out."""
    records = F.filter(F.split("payload", RECORD), lambda r: r != "")
    rows = payloads.select("doc", F.posexplode(records).alias("seq", "record"))
    pairs = F.filter(F.transform(F.split("record", FIELD), lambda c: F.struct(F.substring_index(c, VALUE, 1).alias("k"), F.when(F.instr(c, VALUE) > 1, F.substring(c, F.instr(c, VALUE) + F.lit(1), F.length(c))).alias("v"))), lambda p: p["v"].isNotNull())
    # From the last pair to the first, so that of doubled keys the last one stays.
    once = F.aggregate(F.reverse(pairs), F.array().cast("array<struct<k: string, v: string>>"), lambda out, p: F.when(F.exists(out, lambda o: o["k"] == p["k"]), out).otherwise(F.array_append(out, p)))
    return rows.select("doc", "seq", F.map_from_entries(once).alias("fields"))


_FIELDS = ["HA", "HB", "HC", "HD", "HE", "HF", "HG", "HN", "HK", "HL"]


def feed_fields(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """doc, seq and the value of each of ``keys`` of every record, null where it is not there; the last of doubled keys counts."""
    records = F.filter(F.split("payload", RECORD), lambda r: r != "")
    rows = payloads.select("doc", F.posexplode(records).alias("seq", "record"))
    fields = F.reverse(F.split("record", FIELD))
    own = lambda k: F.get(F.filter(F.col("_fields"), lambda c: F.startswith(c, F.lit(k + VALUE))), F.lit(0))
    return rows.select("doc", "seq", fields.alias("_fields")).select("doc", "seq", *[F.substring(own(k), len(k + VALUE) + 1, 1 << 30).alias(k) for k in keys])


def feed_games(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The games of feeds (doc, payload), and gaps (doc, seq, set_no, what): records that are no game, tie-breaks without points, feeds without a set.

    A title gives the set of the records after it. Records before any title are passed over. Null
    and empty payloads are feeds without a set.
    """
    # Only the fields that are read below, and each feed is taken apart once, however many readers its games have.
    rows = feed_fields(payloads, _FIELDS)
    f = F.col
    tie_title = f("HB").isNotNull() & f("HB").rlike(_TIE)
    here = Window.partitionBy("doc").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    titled = F.when(tie_title, F.coalesce(set_number(f("HB")), set_number(f("HA")))).when(f("HA").isNotNull(), set_number(f("HA")))
    # A title without a number ends the set; a tie-break's goes on with the set before it.
    rows = rows.withColumns({"title": F.when(tie_title, 2).when(f("HA").isNotNull(), 1), "own": F.when(f("HA").isNotNull() & ~tie_title, F.coalesce(titled, F.lit(-1))).when(tie_title, titled)})
    rows = rows.withColumns({"set_no": F.nullif(F.last("own", True).over(here), F.lit(-1)), "section": F.last("title", True).over(here)})
    whole = lambda k: F.when(f(k).rlike(r"^\s*[+-]?\d{1,9}\s*$"), F.trim(f(k)).cast("int"))
    rows = rows.withColumns({"a": whole("HC"), "b": whole("HE"), "tie": F.col("section") == 2})
    points = F.filter(F.transform(F.split(F.coalesce(f("HL"), F.lit("")), ","), lambda p: F.trim(F.substring_index(p, "|", 1))), lambda p: p != "")
    game = F.col("set_no").isNotNull() & f("HC").isNotNull() & f("HE").isNotNull()
    rows = rows.withColumns({"states": F.when(game, points), "game": game})
    result = ~F.col("tie") & (F.size("states") == 0) & f("HD").isNotNull() & f("HF").isNotNull() & (F.least("a", "b") == 6) & (F.greatest("a", "b") == 7)
    side = lambda c: F.when(c == "1", 0).when(c == "2", 1)
    rows = cut(rows.select(
        "doc", "seq", "set_no", "tie", "a", "b", side(F.coalesce(f("HG"), f("HN"))).alias("server"), "states", F.coalesce(f("HK").isin("1", "2"), F.lit(False)).alias("closed"),
        side(f("HK")).alias("told"), F.lit(None).cast("int").alias("marker"), "game", (F.col("game") & F.coalesce(result, F.lit(False))).alias("result"),
    ), "feeds")
    games = rows.where("game")
    ok = games.where("a is not null and b is not null and not result")
    out = ok.drop("game", "result")
    named = lambda rows, reason: rows.select("doc", "seq", "set_no", F.lit(reason).alias("what"))
    gaps = named(games.where("a is null or b is null"), "invalid_game_score")
    played = ok.where("tie").select("doc", "set_no").distinct()
    gaps = gaps.union(named(games.where("result and a is not null and b is not null").join(played, ["doc", "set_no"], "left_anti"), "tiebreak_point_sequence_missing"))
    # A feed's records without a set do not count; a feed without any record is in no row, so feeds are told apart by their payloads.
    with_set = rows.where("set_no is not null").select("doc").distinct()
    bare = payloads.select("doc").distinct().join(with_set, "doc", "left_anti")
    return out, gaps.union(named(bare.select("doc", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("int").alias("set_no")), "point_by_point_feed_missing"))


#: Pages whose games are held as Python objects at a time.
PAGES = 64
#: What is told of a game of a page.
_GAME = {"seq": pa.int32(), "set_no": pa.int32(), "tie": pa.bool_(), "a": pa.int32(), "b": pa.int32(), "server": pa.int32(), "states": pa.list_(pa.string()), "closed": pa.bool_(), "told": pa.int32(), "marker": pa.int32()}
_GAME_SQL = "seq int, set_no int, tie boolean, a int, b int, server int, states array<string>, closed boolean, told int, marker int"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What stands between < and > in a plain tag: lower case, no reference in an attribute, no element whose text is not markup but a title.
_PLAIN = re.compile(r"""/?(?!(?:script|style|textarea|iframe|xmp|noembed|noframes|noscript|plaintext)\b)([a-z][a-z0-9]*)((?:[ \n\t]+[a-z][a-z0-9-]*(?:="[^"<>&]*"|=[A-Za-z0-9_.-]+)?)*)[ \n\t]*""")
_TAG = re.compile("<([^<>]*)>")
_ROWS = re.compile(r'(?=<[a-z]+ class="(?:matchHistoryRow|sectionHeader)[ "])')
_ATTRIBUTE = re.compile(r"""[ \n\t]([a-z][a-z0-9-]*)(?:="([^"]*)"|=([A-Za-z0-9_.-]+))?""")


@lru_cache(4096)
def _plain(kind: type[Reader], text: str) -> tuple | None:
    """Of a plain tag whether it opens, its name and what it tells a reader; None for any other."""
    m = _PLAIN.fullmatch(text)
    if not m or (text[0] == "/" and len(m[1]) + 1 != len(text)):
        return None
    own = {k: a or b for k, a, b in _ATTRIBUTE.findall(m[2])}
    return text[0] != "/", m[1], kind.sense(m[1], own, own.get("class", "").split())


class Reader(HTMLParser):
    """A reader of a page's nodes: ``_open`` gets each start tag with what ``sense`` makes of its attributes and classes.

    Open elements stand on a stack with the part they play; those that ``sense`` makes nothing of play none.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.open: Counter[str] = Counter()  # tags on the stack

    @staticmethod
    def sense(tag: str, own: dict[str, str], classes: list[str]):
        return own, classes

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = {k: v or "" for k, v in attrs}
        self._open(tag, self.sense(tag, own, own.get("class", "").split()))

    def fed_plain(self, html: str) -> bool:
        """Read a page of plain tags and text as ``feed`` does, only faster; False where it holds anything else."""
        before, *pieces = _TAG.split(html)
        if html.count("<") != len(pieces) // 2:
            return False
        if before:
            self.handle_data(unescape(before))
        title, kind, start, end, data, stack, count = False, type(self), self._open, self.handle_endtag, self.handle_data, self.stack, self.open
        for tag, text in zip(pieces[::2], pieces[1::2], strict=True):
            own = _plain(kind, tag)
            if own is None or (title and tag != "/title"):
                return False
            opens, name, told = own
            title = opens and name == "title"
            if opens and (told or name in _VOID):
                start(name, told)
            elif opens:
                stack.append((name, ""))
                count[name] = count.get(name, 0) + 1
            elif stack and stack[-1] == (name, ""):
                stack.pop()
                count[name] -= 1
            else:
                end(name)
            if text:
                data(unescape(text) if "&" in text else text)
        return not title


def read(kind: type[Reader], html: str) -> Reader:
    """A reader that was fed the page, by the general parser only where that is needed."""
    own = kind()
    if not own.fed_plain(html):
        own = kind()
        own.feed(html)
    return own


class _Page(Reader):
    """Reads a page's nodes once and keeps what games are made of.

    Open elements stand on a stack with the part they play: a section's title, a row, its score box, the
    list of a game's points, one point, its result. Text goes to the nearest part that wants it.
    """

    def __init__(self):
        super().__init__()
        self.parts: list[str] = []  # parts on the stack, the nearest last
        self.games: list[dict] = []
        self.titles = 0
        self.set_no, self.tie = None, False
        self.title: list[str] = []
        self.row: dict | None = None
        self.owner: dict | None = None  # the row that a list of points would belong to

    def fed_plain(self, html: str) -> bool:
        """Rows of equal markup tell equal games, so of rows that stand by themselves each markup is read once (of the latest some thousands)."""
        for piece in _ROWS.split(html):
            if self.titles and self.row is None and self.owner is None and not self.parts:
                end, games = _alone(piece, self.tie)
                self.games += [g | {"seq": k, "set_no": self.set_no} for k, g in enumerate(games, len(self.games))]
                piece = piece[end:]
            if piece and not super().fed_plain(piece):
                return False
        return True

    @staticmethod
    def sense(tag: str, own: dict[str, str], classes: list[str]) -> dict:
        """Which parts the element may play, wherever it stands."""
        has = set(classes)
        out = {"title": "sectionHeader" in has, "row": "matchHistoryRow" in has, "points": "matchHistoryRow__fifteens" in has, "box": "matchHistoryRow__scoreBox" in has, "sup": tag == "sup", "score": tag == "span"}
        out |= {"point": "matchHistoryRow__fifteen" in has, "end": "matchHistoryRow__gameResult" in has, "tie": own.get("data-testid") == "wcl-pointByPointScore"}
        out = {k: True for k, v in out.items() if v}
        if "matchHistoryRow__servis" in has and "matchHistoryRow__highlight" in has:
            out["serves"] = [k for k, c in enumerate(("matchHistoryRow__home", "matchHistoryRow__away")) if c in has][:1]
        if "tie" in out:
            out["mark"] = own.get("data-winning") == "true"
        return out

    def _open(self, tag: str, told: dict) -> None:
        part = ""
        if told:
            if "title" in told:
                part, self.title, self.owner = "title", [], None
            elif "row" in told and self.titles:
                part, self.row = "row", {"scores": [], "sup": False, "serves": [], "ties": [], "marks": []}
            elif "points" in told and self.owner is not None:
                part = "points"
            elif self.row is not None:
                if "serves" in told:
                    self.row["serves"] += told["serves"]
                if "tie" in told:
                    part = "tie"
                    self.row["ties"].append("")
                    self.row["marks"].append(told["mark"])
                elif "box" in told:
                    part = "box"
                elif self.within("box"):
                    self.row["sup"] |= "sup" in told
                    if "score" in told:
                        part = "score"
                        self.row["scores"].append("")
            elif self.owner is not None and self.within("points"):
                if "point" in told:
                    part = "point"
                    self.owner["states"].append("")
                elif "end" in told:
                    self.owner["closed"] = True
        if tag in _VOID:
            self.ended(part)
            return
        self.stack.append((tag, part))
        self.open[tag] = self.open.get(tag, 0) + 1
        if part:
            self.parts.append(part)

    def within(self, part: str) -> bool:
        return part in self.parts[-4:]  # parts are nested four deep at the most

    def handle_endtag(self, tag: str) -> None:
        n = self.open
        while n.get(tag):  # what was left open inside ends with it
            last, part = self.stack.pop()
            n[last] -= 1
            if part:
                self.parts.pop()
                self.ended(part)
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        part = self.parts[-1] if self.parts else ""
        if not part:
            return
        into = None  # text of a part whose row has been read already belongs to none
        if part == "title":
            self.title.append(data)
        elif part in ("tie", "score"):
            into = self.row and self.row["ties" if part == "tie" else "scores"]
        elif part == "point" and self.stack[-1][1] == "point":  # not the text of a badge in it
            into = self.owner and self.owner["states"]
        if into:
            into[-1] += data

    def ended(self, part: str) -> None:
        if part == "title":
            text = " ".join("".join(self.title).split())
            m = re.search(_SET, text)
            self.set_no = int(m.group(1) or m.group(2)) if m else None
            self.tie, self.titles = bool(re.search(_TIE, text)), self.titles + 1
        elif part == "row":
            self.end_row()
        elif part == "points":
            self.owner = None

    def end_row(self) -> None:
        row, self.row, self.owner = self.row, None, None
        if row is None:  # rows in a row: the inner one has been read
            return
        server = row["serves"][0] if len(row["serves"]) == 1 else None
        game = {"seq": len(self.games), "set_no": self.set_no, "server": server, "states": [], "closed": False, "told": None, "marker": None}
        digits = [re.sub(r"\D", "", t) for t in row["ties"][:2]]
        if self.tie and len(row["ties"]) >= 2:
            if all(digits):
                marks = [k for k, m in enumerate(row["marks"][:2]) if m]
                self.games.append(game | {"tie": True, "a": int(digits[0][:9]), "b": int(digits[1][:9]), "marker": marks[0] if marks else None})
            return
        found = [re.search(r"\d{1,9}", t) for t in row["scores"]]
        if len(found) == 2 and not row["sup"] and all(found):
            self.owner = game | {"tie": False, "a": int(found[0][0]), "b": int(found[1][0])}
            self.games.append(self.owner)

    def finished(self) -> list[dict]:
        self.close()
        for part in reversed(self.parts):
            self.ended(part)
        return [g | {"states": [s for s in g["states"] if s.strip()]} for g in self.games]


@lru_cache(8192)
def _alone(html: str, tie: bool) -> tuple[int, list[dict]]:
    """How much of some markup after a title is whole by itself, and its games: every element in it ends in it, and no end tag in it is another's."""
    own = _Page()
    own.titles, own.tie = 1, tie
    before, *pieces = _TAG.split(html)
    at, out = len(before), (0, [])
    for tag, text in zip(pieces[::2], pieces[1::2], strict=True):
        plain = _plain(_Page, tag)
        if "<" in before or plain is None or plain[1] == "title" or not (plain[0] or own.open[plain[1]]):
            break
        own._open(*plain[1:]) if plain[0] else own.handle_endtag(plain[1])
        own.handle_data(unescape(text))
        if own.titles > 1 or "<" in text:
            break
        at += len(tag) + 2 + len(text)
        if not own.stack and own.row is None and own.owner is None:
            out = (at, list(own.games))
    return out


def page_games(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The games of pages (doc, html), and a gap for each page without a section; null and empty pages are such."""
    kind = pages.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(k, PAGES) for batch in batches for k in range(0, batch.num_rows, PAGES))
        for batch in parts:
            games, at = [], []
            for k, html in enumerate(batch.column(1).to_pylist()):
                page = read(_Page, html or "")
                own = page.finished()
                own = own if page.titles else [{}]
                games += own
                at += [k] * len(own)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([g.get(c) for g in games], of) for c, of in _GAME.items())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", *_GAME])

    # Pages are read once, however many readers their games have; a page without a section is a row without a game.
    rows = cut(pages.select("doc", "html").mapInArrow(run, f"doc {kind}, {_GAME_SQL}"), "pages")
    bare = rows.where("seq is null").select("doc", "seq", "set_no", F.lit("point_by_point_markup_missing").alias("what"))
    return rows.where("seq is not null"), bare
