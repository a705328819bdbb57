"""Result tables of HTML pages: two rows a match, whose header rows carry the event."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .histories import _VOID, Reader, read

#: Pages whose rows are held as Python objects at a time.
PAGES = 64
#: What is told of a match's row; of its opponent's the same.
_ROW = {"text": pa.string(), "notes": pa.string(), "match": pa.string(), "players": pa.list_(pa.string()), "names": pa.list_(pa.string()), "result": pa.string(), "results": pa.int32(), "sets": pa.list_(pa.string()), "time": pa.string()}
_ROW_SQL = {pa.string(): "string", pa.int32(): "int", pa.list_(pa.string()): "array<string>"}
#: Words of a match that was not played out, and of tours, the first that occurs.
REJECTED = ["walkover", "w/o", "retired", "abandoned", "cancelled", "canceled"]
TOURS = [("challenger", ["challenger"]), ("itf", ["itf", "future"]), ("wta", ["wta", "women"]), ("atp", ["atp", "men"])]
GENDERS = [("w", ["wta", "women", "female", "itf-w"]), ("m", ["atp", "men", "challenger", "itf-m"])]


class _Table(Reader):
    """The rows of all tables of class ``result``: links, cells by their class, and all text, in one pass."""

    def __init__(self):
        super().__init__()
        self.tables = 0
        self.rows: list[list[dict]] = []
        self.row: dict | None = None
        self.link: dict | None = None
        self.cell: dict | None = None
        self.sup = 0
        self.title: list[str] = []

    def _open(self, tag: str, told: tuple[dict[str, str], list[str]]) -> None:
        own, classes = told
        part = ""
        if tag == "table" and "result" in classes:
            part, self.tables = "table", self.tables + 1
            self.rows.append([])
        elif tag == "tr" and self.tables:
            if self.row is not None:  # rows and cells need no end of their own
                self._close_row()
            part, self.row = "row", {"head": "head" in classes, "text": [], "notes": [], "links": [], "cells": []}
        elif self.row is not None:
            self.row["notes"] += [own[k] for k in ("title", "alt") if k in own]
            if tag == "a":
                self.link = {"href": own.get("href", ""), "text": []}
                self.row["links"].append(self.link)
                part = "link"
            elif tag in ("td", "th"):
                self.cell = {"classes": classes, "text": [], "sup": []}
                self.row["cells"].append(self.cell)
                part = "cell"
            elif tag == "sup":
                part, self.sup = "sup", self.sup + 1
        elif tag == "title":
            part = "title"
        if tag not in _VOID:
            self.stack.append((tag, part))
            self.open[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        while self.open[tag]:
            last, part = self.stack.pop()
            self.open[last] -= 1
            if part == "row":
                self._close_row()
            elif part == "table":
                self._close_row()
                self.tables -= 1
            elif part == "link":
                self.link = None
            elif part == "cell":
                self.cell = None
            elif part == "sup":
                self.sup -= 1
            if last == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.open["title"] and self.row is None:
            self.title.append(data)
        if self.row is None:
            return
        self.row["text"].append(data)
        if self.link is not None:
            self.link["text"].append(data)
        if self.cell is not None:
            self.cell["sup" if self.sup else "text"].append(data)

    def _close_row(self) -> None:
        row, self.row, self.link, self.cell = self.row, None, None, None
        if row is not None and self.rows:
            self.rows[-1].append(row)

    def finished(self) -> tuple[str, list[list[dict]]]:
        self.close()
        self._close_row()
        return _squeezed(self.title), [[_told(r) for r in t] for t in self.rows]


def _squeezed(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _told(row: dict) -> dict:
    players = [(m[1], _squeezed(link["text"])) for link in row["links"] if (m := re.match(r"(?:https?://[^/]+)?/player/([^?#]*?)/*(?:[?#].*)?$", link["href"])) and m[1]]
    matches = [link["href"] for link in row["links"] if "match-detail" in link["href"]]
    number = re.search(r"[?&]id=(\d+)", matches[0]) if matches else None
    cells = lambda c: [x for x in row["cells"] if c in x["classes"]]
    sets = []
    for cell in cells("score"):
        base, high = _squeezed(cell["text"]), _squeezed(cell["sup"])
        text = f"{base}({high})" if high else base
        if re.fullmatch(r"\d+(?:\(\d+\))?", text):
            sets.append(text)
    first = next((link for link in row["links"] if "/" in link["href"]), {"href": "", "text": []})
    results, times = cells("result"), cells("time")
    return {
        "head": row["head"], "text": _squeezed([f" {t} " for t in row["text"]]), "notes": " ".join(row["notes"]), "href": first["href"], "label": _squeezed(first["text"]),
        "match": (number[1] if number else "") if matches else None, "players": [p for p, _ in players], "names": [n for _, n in players], "result": _squeezed(results[0]["text"]) if results else "",
        "results": len(results), "sets": sets, "time": _squeezed(times[0]["text"]) if times else None,
    }


def _rows_of(html: str) -> list[list[dict]]:
    return read(_Table, html).finished()[1]


def _pairs(tables: list[list[dict]]) -> list[dict]:
    """Rows of a match and its opponent's, under the last header of their table."""
    out = []
    for rows in tables:
        head, k = None, 0
        while k < len(rows):
            row = rows[k]
            if row["head"]:
                head = row
            elif row["match"] is not None and len(row["players"]) == 1 and k + 1 < len(rows):
                out.append({"event": head and head["label"], "address": head and head["href"], "one": row, "two": rows[k + 1]})
                k += 1
            k += 1
    return out


def _first_of(text: Column, kinds: list[tuple[str, list[str]]]) -> Column:
    out = None
    for name, words in kinds:
        there = F.lit(False)
        for w in words:
            there = there | F.contains(text, F.lit(w))
        out = F.when(there, name) if out is None else out.when(there, name)
    return out


def result_rows(pages: DataFrame) -> DataFrame:
    """doc, match_id, event, tour, gender, time, winner_id, loser_id, winner, loser, score, best_of, reason of pages (doc, html).

    A row for each pair of a match; ``reason`` is null where it counts, else the first thing that
    keeps it out, and nothing is told of its outcome. Of a match id that counts twice on a page the
    first row does, the others are ``repeated``. Null and empty pages have no rows.
    """
    kind = pages.schema["doc"].dataType.simpleString()
    fields = [(side, c) for side in ("one", "two") for c in _ROW]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (batch.slice(k, PAGES) for batch in batches for k in range(0, batch.num_rows, PAGES))
        for batch in parts:
            found = [_pairs(_rows_of(html.as_py() or "")) for html in batch.column(1)]
            pairs = [p for own in found for p in own]
            doc = batch.column(0).take(pa.array([k for k, own in enumerate(found) for _ in own], pa.int64()))
            columns = [doc, pa.array([k for own in found for k in range(len(own))], pa.int32()), *(pa.array([p[c] for p in pairs], pa.string()) for c in ("event", "address"))]
            columns += [pa.array([p[side][c] for p in pairs], _ROW[c]) for side, c in fields]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "k", "event", "address", *(f"{side}_{c}" for side, c in fields)])

    told = ", ".join(f"{side}_{c} {_ROW_SQL[_ROW[c]]}" for side, c in fields)
    m = pages.select("doc", "html").mapInArrow(run, f"doc {kind}, k int, event string, address string, {told}")
    context = F.lower(F.concat_ws(" ", F.coalesce("address", F.lit("")), F.coalesce("event", F.lit(""))))
    told = F.lower(F.concat_ws(" ", "one_text", "two_text", "one_notes", "two_notes"))
    number = lambda side: F.when((F.col(f"{side}_results") == 1) & F.col(f"{side}_result").rlike(r"^\d{1,2}$"), F.col(f"{side}_result").cast("int"))
    m = m.withColumns({"tour": F.coalesce(_first_of(context, TOURS), F.lit("unknown")), "gender": F.coalesce(_first_of(context, GENDERS), F.lit("unknown")), "a": number("one"), "b": number("two")})
    bad = F.lit(False)
    for w in REJECTED:
        bad = bad | F.contains(told, F.lit(w))
    n, o = F.size("one_sets"), F.size("two_sets")
    reason = (
        F.when(F.size("two_players") != 1, "opponent_unknown").when(bad, "not_played_out").when(F.col("one_match") == "", "match_id_missing").when(F.col("a").isNull() | F.col("b").isNull(), "result_missing")
        .when((F.col("a") == F.col("b")) | (F.greatest("a", "b") < 2), "not_decided").when((n < 2) | (n != o), "sets_missing").when((F.col("tour") == "unknown") | (F.col("gender") == "unknown"), "event_unknown")
    )
    m = m.withColumn("reason", reason)
    won = F.col("a") > F.col("b")
    known = lambda x: F.when(F.col("reason").isNull(), x)
    side = lambda f, winner: known(F.when(won == winner, F.get(F.col(f"one_{f}"), F.lit(0))).otherwise(F.get(F.col(f"two_{f}"), F.lit(0))))
    score = F.array_join(F.zip_with(F.when(won, F.col("one_sets")).otherwise(F.col("two_sets")), F.when(won, F.col("two_sets")).otherwise(F.col("one_sets")), lambda x, y: F.concat(x, F.lit("-"), y)), " ")
    told = {
        "winner_id": side("players", True), "loser_id": side("players", False), "winner": side("names", True), "loser": side("names", False), "score": known(score),
        "best_of": known(F.when(F.greatest("a", "b") >= 3, 5).otherwise(3)),
    }
    m = m.select("doc", "k", F.nullif(F.col("one_match"), F.lit("")).alias("match_id"), "event", "tour", "gender", F.col("one_time").alias("time"), *(x.alias(c) for c, x in told.items()), "reason")
    # A window, not a join of the rows with their firsts: pages are read once, and only what is told is shuffled.
    first = F.min(F.when(F.col("reason").isNull(), F.col("k"))).over(Window.partitionBy("doc", "match_id"))
    m = m.withColumn("again", F.coalesce(F.col("reason").isNull() & F.col("doc").isNotNull() & (F.col("k") != first), F.lit(False)))
    return m.select(
        "doc", "match_id", "event", "tour", "gender", "time", *(F.when(~F.col("again"), F.col(c)).alias(c) for c in told), F.when(F.col("again"), "repeated").otherwise(F.col("reason")).alias("reason")
    )
