"""Feeds and pages with every gap, broken nodes and very long inputs."""

import time

from pyspark.sql import functions as F

from tidemark.operators.points import point_events
from tidemark.sources.histories import _Page, feed_games, feed_records, page_games
from tidemark.sources.merging import upsert
from tidemark.sources.results import _Table, result_rows


def feed(spark, *payloads):
    rows = spark.createDataFrame(list(enumerate(payloads)), "doc long, payload string")
    games, gaps = feed_games(rows)
    found = [(r.doc, r.set_no, r.i, r.before, r.after, r.server, r.winner, r.what) for r in point_events(games, False).orderBy("doc", "seq", "i").collect()]
    return found, {(r.doc, r.set_no, r.what) for r in gaps.collect()}


def test_feed_gaps(spark):
    found, gaps = feed(
        spark,
        "~HA÷Set 1¬~HC÷1¬HE÷0¬HL÷15:0, 30:0|B1 ,40:0¬HK÷1¬~HC÷x¬HE÷1¬~HC÷1¬HE÷1¬HK÷2¬~HC÷2¬HE÷1¬HL÷15:0,zz,40:15¬~broken~÷novalue¬HD÷",
        "", None, "~HC÷1¬HE÷0¬HL÷15:0¬",
        "HA÷1 set¬~HD÷1¬HF÷2¬HC÷7¬HE÷6¬~HA÷Finished¬~HC÷1¬HE÷0¬HL÷15:0¬",
        "HB÷Tie-break set 2¬~HC÷1¬HE÷0¬HN÷2¬~HC÷1¬HE÷0¬HL÷2:0, 2:x, 2:2¬~HA÷Set 3¬~HC÷1¬HE÷0¬HL÷0:15¬HK÷1¬HK÷2¬",
    )
    assert gaps == {(0, 1, "invalid_game_score"), (1, None, "point_by_point_feed_missing"), (2, None, "point_by_point_feed_missing"), (3, None, "point_by_point_feed_missing"), (4, 1, "tiebreak_point_sequence_missing")}
    assert sorted(map(str, (f for f in found if f[0] == 0))) == sorted(map(str, [
        (0, 1, None, None, None, None, None, "point_sequence_missing"), (0, 1, None, None, None, None, None, "unrecognized_feed_point"), (0, 1, 0, "0:0", "15:0", None, 0, "confirmed"), (0, 1, 1, "15:0", "30:0", None, 0, "confirmed"),
        (0, 1, 2, "30:0", "40:0", None, 0, "confirmed"), (0, 1, 3, "40:0", "1:0", None, 0, "terminal_from_game_result"), (0, 1, 0, "0:0", "15:0", None, 0, "confirmed"), (0, 1, 1, "15:0", "40:15", None, None, "ambiguous"),
    ]))
    tie = [f for f in found if f[0] == 5 and f[1] == 2]
    assert (5, 2, 0, "0:0", "1:0", 1, 0, "confirmed") in tie and (5, 2, 1, "1:0", "2:0", None, 0, "confirmed") in tie and (5, 2, 3, "2:0", "2:2", None, None, "ambiguous") in tie
    assert {f[-1] for f in tie} == {"confirmed", "ambiguous", "invalid_tiebreak_point_score", "invalid_or_unanchored_tiebreak_transition"}
    assert [f[-1] for f in found if f[1] == 3] == ["ambiguous_terminal_point", "confirmed"]


def test_feed_records_keep_the_last_of_doubled_keys(spark):
    rows = feed_records(spark.createDataFrame([(1, "a÷1¬a÷2¬b÷x÷y¬c¬÷z¬~~k÷")], "doc int, payload string")).collect()
    assert [(r.seq, r.fields) for r in rows] == [(0, {"a": "2", "b": "x÷y"}), (1, {"k": ""})]


HEAD = '<h2 class="sectionHeader">Set 1</h2>'


def game(a, b, points, result=True, serve="", box=None):
    spans = box or f"<span>{a}</span><span>{b}</span>"
    cells = "".join(f'<div class="matchHistoryRow__fifteen">{p}</div>' for p in points)
    end = '<i class="matchHistoryRow__gameResult"></i>' if result else ""
    return f'<div class="matchHistoryRow">{serve}<div class="matchHistoryRow__scoreBox">{spans}</div></div><div class="matchHistoryRow__fifteens">{cells}{end}</div>'


def page(spark, *htmls):
    games, gaps = page_games(spark.createDataFrame(list(enumerate(htmls)), "doc long, html string"))
    return games, [tuple(r) for r in point_events(games, True).select("doc", "set_no", "what").collect()], {r.doc for r in gaps.collect()}


def test_page_gaps_and_broken_nodes(spark):
    good = game(1, 0, ["15:0", "30:0", "40:0"])
    games, found, bare = page(
        spark, "<div>" + HEAD + good + "</div>", "", None, "<p>no section " + good, HEAD + game(1, 0, ["15:0"], False), HEAD + game(2, 0, ["15:0", "30:0", "40:0"]), HEAD + game(1, 0, []),
        HEAD + game(6, 7, ["15:0"], box="<span>6<sup>4</sup></span><span>7</span>"), HEAD + game(1, 0, ["15:0<b>30:0</b>", "junk", "30:0", "40:0"]), "<div" * 3 + HEAD + good[:200],
        '<h2 class="sectionHeader">Tie break set 2</h2><div class="matchHistoryRow"><b data-testid="wcl-pointByPointScore" data-winning="false">1</b><b data-testid="wcl-pointByPointScore">0</b></div>',
        HEAD + game(1, 0, ["15:0"], serve='<i class="matchHistoryRow__servis matchHistoryRow__highlight matchHistoryRow__away"></i>'),
    )
    of = lambda k: sorted(w for d, _, w in found if d == k)
    assert of(0) == ["confirmed"] * 3 + ["terminal_from_game_result"] and {1, 2, 3} <= bare
    assert of(4) == ["confirmed", "game_result_missing"]
    assert of(5) == ["ambiguous_terminal_point", "confirmed", "confirmed", "confirmed", "game_score_transition_missing_or_invalid"]
    assert of(6) == ["point_sequence_missing"] and of(7) == []
    assert of(8) == of(0), "badges and junk are passed over"
    assert of(10) == ["ambiguous", "invalid_or_unanchored_tiebreak_transition"]
    assert [r.server for r in games.collect() if r.doc == 11] == [1]


def test_pages_are_read_in_linear_time():
    for unit in ("<div>", "</p><b>", "<div class=matchHistoryRow>", game(1, 0, ["15:0"]), "x" * 50, "<"):
        took = []
        for n in (30_000, 300_000):
            own = _Page()
            began = time.process_time()
            own.feed(HEAD + unit * (n // len(unit)))
            own.finished()
            took.append(time.process_time() - began)
        assert took[1] < 40 * took[0] + 0.3, unit


def test_plain_pages_are_read_as_by_the_general_parser(monkeypatch):
    import random
    import re
    from html.parser import HTMLParser

    from tidemark.sources.histories import read

    def general(html):
        own = _Page()
        HTMLParser.feed(own, html)
        return own.finished(), own.titles

    told = lambda html: (lambda own: (own.finished(), own.titles))(read(_Page, html))
    tie = '<h2 class="sectionHeader">Tie break &amp; set 1</h2>' + "".join(f'<div class="matchHistoryRow"><b data-testid="wcl-pointByPointScore" data-winning="true">{k}</b><b data-testid="wcl-pointByPointScore">0</b></div>' for k in range(3))
    whole = HEAD + "<div>" + game(1, 0, ["15:0", "30:0<b>x</b>", "40:0"]) * 3 + game(2, 0, [], False) + "<p>" + game(2, 1, ["0:15<br>"]) + "</div>" + tie + "<footer>40:0</footer>"
    bits = ["</div>", "<div>", "<br>", "<span>", "</span>", "<sup>", "</title>", "<title>", HEAD, '<div class="matchHistoryRow">', '<div class="matchHistoryRow__fifteens">', "&lt", "<!-- x -->", "<script>", ">", "x", '<img class="matchHistoryRow">', "</p>"]
    rng = random.Random(5)
    for k in range(600):
        parts = re.findall(r"<[^<>]*>|[^<>]+", whole)[rng.randrange(40) if k % 2 else 0 :]
        for _ in range(rng.choice([0, 1, 2, 5])):
            at = rng.randrange(len(parts) + 1)
            parts[at : at + rng.choice([0, 0, 1, 3])] = [rng.choice(bits)]
        html = (HEAD if k % 3 else "") + "".join(parts)
        assert told(html) == general(html), html
    want = general(whole)
    assert len(want[0]) == 8 and want[1] == 2
    monkeypatch.setattr(HTMLParser, "feed", None)  # a plain page needs no general parser
    assert told(whole) == want


def test_text_of_a_row_within_a_score_stops_no_page(spark):
    odd = '<div class="matchHistoryRow"><div class="matchHistoryRow__scoreBox"><span><div class="matchHistoryRow"></div>5</span></div></div>'
    games, found, bare = page(spark, HEAD + odd + game(1, 0, ["15:0", "30:0", "40:0"]), '<p class="sectionHeader">Set 1')
    assert [r.a for r in games.collect()] == [1] and not bare and len(found) == 4


def match(k, a, b, one="ann-1", two="bea-2", sets=(("6", "4"), ("6", "4")), more="", id_="?id="):
    link = lambda p: f'<td><a href="/player/{p}/">{p}</a>'
    cells = lambda i: "".join(f'<td class="score x">{s[i]}</td>' for s in sets)
    return f'<tr><td class="time">9:00</td>{link(one)}</td><td class="result">{a}</td>{cells(0)}<td><a href="/match-detail/{id_}{k}">i</a>{more}</tr><tr>{link(two)}<td class=result>{b}</td>{cells(1)}</tr>'


def test_result_tables(spark):
    head = '<tr class="x head"><td><a href="/rome-wta/">Rome</a></td></tr>'
    table = lambda *rows: "<table class='result small'>" + "".join(rows) + "</table>"
    pages = [
        table(head, match(1, 2, 0), match(1, 0, 2), match(2, 1, 2, sets=(("7<sup>7</sup>", "6<sup>5</sup>"), ("3", "6"), ("4", "6")))),
        table(head, match(3, 2, 0, more="<img alt='Walkover'>"), match(4, 1, 1), match(5, 2, "-"), match(6, 2, 0, sets=(("6", "4"),)), match("", 2, 0), match(7, 2, 0, two='c-3/">x</a><a href="/player/d-4')),
        table(match(8, 2, 0)), "<table>" + head + match(9, 2, 0) + "</table>", None, "", table(head, match(10, 3, 1, sets=(("6", "4"),) * 4))[:-8] + "<tr><td>open", table(head, match(11, 2, 0).split("</tr>")[0]),
        table(head, match(12, 2, 0, one='x">two</a><a href="/player/y')),
    ]
    got = result_rows(spark.createDataFrame(list(enumerate(pages)), "doc int, html string")).collect()
    of = lambda d: sorted((r.match_id or "", r.winner_id or "", r.score or "", r.reason or "") for r in got if r.doc == d)
    assert of(0) == [("1", "", "", "repeated"), ("1", "ann-1", "6-4 6-4", ""), ("2", "bea-2", "6(5)-7(7) 6-3 6-4", "")]
    assert of(1) == [("", "", "", "match_id_missing"), ("3", "", "", "not_played_out"), ("4", "", "", "not_decided"), ("5", "", "", "result_missing"), ("6", "", "", "sets_missing"), ("7", "", "", "opponent_unknown")]
    assert of(2) == [("8", "", "", "event_unknown")] and of(3) == of(4) == of(5) == of(7) == of(8) == []
    assert [(r.best_of, r.event, r.tour, r.gender) for r in got if r.doc == 6] == [(5, "Rome", "wta", "w")]


def test_result_tables_are_read_in_linear_time():
    for unit in (match(1, 2, 0), "<tr><td>", "<a href='/player/x'>", "<table class=result>"):
        took = []
        for n in (30_000, 300_000):
            own = _Table()
            began = time.process_time()
            own.feed("<table class=result>" + unit * (n // len(unit)))
            own.finished()
            took.append(time.process_time() - began)
        assert took[1] < 40 * took[0] + 0.3, unit[:20]


def test_merges_rewrite_only_what_changed(spark, tmp_path):
    path, kind = f"{tmp_path}/seasons", "id long, v string, season int, at int"
    rows = lambda *r: spark.createDataFrame(list(r), kind)
    files = lambda: {p: p.stat().st_mtime_ns for p in tmp_path.glob("seasons/*/*.parquet")}
    table = lambda: {r.id: (r.v, r.season) for r in spark.read.schema(kind).parquet(path).collect()}
    assert upsert(path, rows(*[(k, "a", 2000 + k % 4, 1) for k in range(40)], (1, "late", 2001, 2)), ["id"], "season", "at") == {"inserted": 40, "updated": 0, "partitions": 4}
    assert table()[1] == ("late", 2001) and len(table()) == 40
    before = files()
    change = rows((4, "b", 2000, 3), (100, "new", 2000, 3), (8, "a", 2000, 1))
    assert upsert(path, change, ["id"], "season", "at") == {"inserted": 1, "updated": 1, "partitions": 1}
    after = files()
    kept = [p for p in before if after.get(p) == before[p]]
    assert {p.parent.name for p in kept} == {"season=2001", "season=2002", "season=2003"} and table()[4] == ("b", 2000) and len(table()) == 41
    assert upsert(path, change, ["id"], "season", "at") == {"inserted": 0, "updated": 0, "partitions": 0} and files() == after
    everything = rows(*[(k, "moved", 2009, 5) for k in range(3, 40, 4)])
    assert upsert(path, everything, ["id"], "season", "at") == {"inserted": 0, "updated": 10, "partitions": 2}
    assert not (tmp_path / "seasons/season=2003").exists() and len(table()) == 41 and table()[3] == ("moved", 2009)
    # A run that put one of two partitions in place and stopped: the key stands twice, and the next run mends it.
    spark.createDataFrame([(3, "a", 1)], "id long, v string, at int").coalesce(1).write.parquet(f"{path}/season=2003")
    assert upsert(path, everything, ["id"], "season", "at")["partitions"] == 2 and table()[3] == ("moved", 2009) and spark.read.parquet(path).count() == 41
    assert upsert(path, everything.limit(0), ["id"], "season", "at")["partitions"] == 0


def test_looked_up_points_are_those_of_the_rules(spark):
    from tidemark.operators.points import _CODES, _WON, point_code, point_pair, point_winner

    pairs = [(*x, *y, w) for (x, y), w in zip(((x, y) for x in _CODES for y in _CODES), _WON, strict=True)]
    df = spark.createDataFrame(pairs, "a int, b int, c int, d int, w int")
    want = point_winner(F.struct("a", "b"), F.struct(F.col("c").alias("a"), F.col("d").alias("b")))
    assert df.where(~want.cast("int").eqNullSafe(F.col("w"))).count() == 0
    texts = [(t,) for t in ("0:0", "A:40", "40:AD", "ad:40", " 15 - 30 x", "115:0", "", "x", "40:A", None)]
    got = spark.createDataFrame(texts, "t string").select(point_code(F.col("t")).alias("c"), point_pair(F.col("t")).alias("p")).collect()
    assert [r.c for r in got] == [None if r.p is None else 5 * r.p.a + r.p.b for r in got] and [r.c for r in got][1:4] == [23, 19, 23]


def test_feeds_and_pages_are_read_once(spark):
    games, _ = feed_games(spark.createDataFrame([(1, "HA÷Set 1¬~HC÷1¬HE÷0¬HL÷15:0¬HK÷1¬")], "doc int, payload string"))
    assert "ArrayTransform" not in (plan := games._jdf.queryExecution().optimizedPlan().toString()) and "split" not in plan
    games, _ = page_games(spark.createDataFrame([(1, "<p>")], "doc int, html string"))
    assert "MapInArrow" not in games._jdf.queryExecution().optimizedPlan().toString()


def test_result_pages_are_read_once_and_plain_ones_as_the_parser_reads_them(spark, sf):
    from tidemark.plans.histories import result_pages
    from tidemark.sources.results import _rows_of

    plan = result_rows(result_pages(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    row = '<table class="result"><tr class="bott"><td class=first title="x">a &amp; b</td><td><a href="/player/ann-1/">Ann</a></td><td><a href="/match-detail/?id=7">i</a></td></tr><tr><td><a href="/player/bea/">Bea</a><sup>5</sup></table>'
    plain = [row, "x &lt; y" + row + "tail &am", "<title>t</title>" + row, row.replace("<tr>", "<tr hidden>\n"), "<p>1 > 0</p>" + row]
    other = [row.replace("/ann-1/", "/ann&amp;1/"), "<!-- <tr> -->" + row, "<TITLE>t</TITLE>" + row, "<script>'<tr>'</script>" + row, "<title>a <b>c</title>" + row, row + "<br/>", "a < b" + row, row[:-3]]
    for page, kind in [(p, True) for p in plain] + [(p, False) for p in other]:
        want = _Table()
        want.feed(page)
        assert _Table().fed_plain(page) is kind and _rows_of(page) == want.finished()[1], page
