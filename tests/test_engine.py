"""Operators on the cases of FIXTURES.md, plain loops as oracles, and the oracle SQL of every registered query."""

import http.server
import json
import os
import random
import threading
import time
from datetime import datetime, timezone

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline import cli
from loomline.functions import columns as fn
from loomline.functions import formatting as fmt
from loomline.operators import asking, engagement, grams, insights, listing, models, paging, pruned, recurrence, search, sessionize, similarity, turns
from loomline.operators.scope import Days, Scope, day_cutoff, instant_cutoff
from loomline.plans import analyze, api, brief, library
from loomline.plans import requests as rq
from loomline.schema import struct
from loomline.sources import config, line_ranges, providers, store, transcripts
from tests import stand_ins

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df, columns):
    return sorted(map(str, df[columns].astype(object).where(df[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query(spark, duck, name):
    mine = library.QUERIES[name](spark, SF).toPandas()
    if name in library.ORACLE_SQL:
        theirs = duck.execute(library.ORACLE_SQL[name]).df()
        assert sorted(mine.columns) == sorted(theirs.columns)
        assert plain(mine, sorted(mine.columns)) == plain(theirs, sorted(mine.columns))
    else:
        assert len(mine)


# the shared seed of FIXTURES 4


@pytest.fixture(scope="module")
def seed(spark):
    episodes = spark.createDataFrame(
        [(1, "2026-07-14", "/project-a", "session-1", 1, 10, ""), (2, "2026-07-15", "/project-a", "session-1", 11, 20, "run"), (3, "2026-07-15", "/project-b", "session-2", 1, 5, "run"), (4, "2026-07-16", "/project-a", "session-3", 1, 15, "run")], struct("episodes")
    )
    row = lambda i, e, c, s, f: (i, e, c, f"Insight {i}", f"line {i}", s, None, None, f"2026-07-1{3 + e}T00:00:00.000Z", f)
    found = spark.createDataFrame(
        [row(1, 1, "architecture_decisions", 0.9, "judgment"), row(2, 2, "architecture_decisions", 0.8, "toil"), row(3, 2, "friction_audit", 0.7, "overhead"), row(4, 3, "architecture_decisions", 0.6, "toil"), row(5, 4, "friction_audit", 0.95, "judgment")], struct("insights")
    )
    return found, episodes


def test_effort_and_scopes(seed):
    b = insights.effort_breakdown(*seed, Days("2026-07-14", "2026-07-16")).first()
    assert (b["toil"], b["judgment"], b["overhead"], b["total"], b["toil_ratio"]) == (2, 2, 1, 5, 0.4)
    none = insights.effort_breakdown(*seed, Days("2020-01-01")).first()
    assert none["total"] == 0 and none["judgment_ratio"] == 0
    assert insights.insight_count(*seed, Days("2026-07-15"), Scope(label="")).first()[0] == 0
    assert insights.insight_count(*seed, Days("2026-07-14"), Scope(label="")).first()[0] == 1
    assert [r["id"] for r in insights.top_insights(*seed, Days("2026-07-14", "2026-07-16"), 2, 1).collect()] == [1, 2]
    assert [r["date"] for r in insights.category_trend(*seed, "2026-07-16", 1).collect()] == ["2026-07-15", "2026-07-15", "2026-07-16"]


def test_search_branches(seed):
    rows = search.search(*seed, "SESSION", 20).collect()
    assert [r["kind"] for r in rows] == ["session"] * 3 and search.search(*seed, "  ", 5).count() == 0
    assert search.search(*seed, "insight _", 3).count() == 1
    assert search.search(*seed, "project", 20).filter("kind = 'project'").count() == 2


def test_engagement_ratio_and_burst(spark):
    episodes = spark.createDataFrame([(1, "2026-07-14", "p", "s", 1, 9, ""), (2, "2026-07-15", "p", "s", 10, 19, "")], struct("episodes"))
    t = spark.createDataFrame(
        [(1, 1, 1, "deliberative", None, "", ""), (2, 1, 2, "directive", False, "ran tests", ""), (3, 1, 3, "directive", None, "told agent", ""), (4, 2, 11, "corrective", None, "", ""), (5, 2, 12, "directive", True, "", ""), (6, 2, 13, "acknowledgment", None, "", ""), (7, 2, 14, "odd", None, "", "")],
        struct("engagement_turns"),
    )
    one, two = engagement.engagement_trend(t, episodes, "2026-07-16", 5).collect()
    assert (one["engagement_ratio"], one["longest_directive_burst"], one["total"]) == (0.5, 2, 3)
    assert two["engagement_ratio"] is None and (two["total"], two["directive"], two["acknowledgment"]) == (2, 1, 1)
    whole = engagement.engagement_breakdown(t, episodes, Days("2026-07-14", "2026-07-15")).first()
    assert (whole["total"], whole["longest_directive_burst"]) == (5, 2)
    assert engagement.engagement_breakdown(t, episodes, Days("2000-01-01")).first()["total"] == 0
    flagged = engagement.flagged_directives(t, episodes, Days("2026-07-14"))
    assert [r["id"] for r in flagged.collect()] == [3, 2]
    assert {r["theme"] for r in engagement.directive_themes(flagged).collect()} == {"manual-testing", "procedural-instruction"}


def test_burst_over_ranges_equals_a_loop(spark):
    rnd = random.Random(2)
    rows = [(i, 1, i, "directive" if rnd.random() < 0.8 else "corrective", rnd.random() < 0.1, "r", "d", "p", "s", i * 30000) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, episode_id long, human_line_number int, classification string, directive_necessary boolean, reason string, date string, project_dir string, session_id string, start_line long")
    best = run = 0
    for r in rows:
        run = run + 1 if r[3] == "directive" and not r[4] else 0
        best = max(best, run)
    assert engagement.longest_burst(df).first()[0] == best


# sessions


def at(minute, second=0):
    return datetime(2026, 7, 14, 10 + minute // 60, minute % 60, second)


def parts(spark, rows, gap=25):
    df = spark.createDataFrame([("p", "s", i + 1, t, t.strftime("%Y-%m-%d"), c, 100) for i, (t, c) in enumerate(rows)], "project_dir string, session_id string, line_number int, ts timestamp, date string, is_compact boolean, chars int")
    return [r["part"] for r in sessionize.sessionize(df, gap).orderBy("line_number").collect()]


def test_gaps_and_compaction(spark):
    assert parts(spark, [(at(0), False), (at(25), False)]) == [0, 0]
    assert parts(spark, [(at(0), False), (at(26), False)]) == [0, 1]
    assert parts(spark, [(at(0), False), (at(10), False)], 5) == [0, 1]
    assert parts(spark, [(at(0), False), (at(1), False), (at(2), True), (at(3), False)]) == [0, 0, 1, 1]
    assert parts(spark, [(at(0), True), (at(1), False)]) == [0, 0]
    assert parts(spark, [(at(30), False), (at(0), False)]) == [0, 0]


def test_long_sessions_are_cut_into_stretches(spark, monkeypatch):
    rows = [(at(i), i % 3 == 0) for i in range(20)]
    whole = parts(spark, rows)
    monkeypatch.setattr(sessionize, "STRETCH", 4)
    assert parts(spark, rows) == whole and whole[-1] == 6


def halves(chars, budget):
    """The piece of each line, by recursion."""

    def cut(first, stop):
        if stop - first <= 1 or -(-sum(chars[first:stop]) // 4) <= budget:
            return [(first, stop)]
        middle = first + (stop - first) // 2
        return cut(first, middle) + cut(middle, stop)

    return [k for k, (i, j) in enumerate(cut(0, len(chars))) for _ in range(i, j)]


def test_budget_halving(spark):
    rnd = random.Random(7)
    found = {"even": [1000] * 1000, "one": [10**9], "fits": [4, 4], "none": [], "heavy": [1] * 50 + [10**6] + [1] * 77, **{f"r{k}": [rnd.choice([0, 5, 900, 40_000, 900_000]) for _ in range(rnd.randint(1, 130))] for k in range(12)}}
    rows = [("p", name, "d", 0, 10 * i, n) for name, chars in found.items() for i, n in enumerate(chars)]
    lines = spark.createDataFrame(rows, "project_dir string, session_id string, date string, part int, line_number int, chars long")
    for budget in (2, 100_000):
        got = {}
        for r in sessionize.split_by_budget(lines, budget).orderBy("line_number").collect():
            got.setdefault(r["session_id"], []).append(r["piece"])
        assert got == {name: halves(chars, budget) for name, chars in found.items() if chars}
    plan = sessionize.split_by_budget(lines, 2)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


# turns


def loop_pairs(rows):
    out, start, saw, texts, tool = [], None, False, [], False
    for ln, kind, text, used in rows:
        if kind == "H":
            if start is not None and saw:
                out.append((start, "\n".join(texts), tool, ln, text))
            start, texts, tool = None, [], False
        else:
            start = ln if start is None else start
            if text:
                texts.append(text)
            if kind == "A":
                saw, tool = True, tool or used
    return out


def test_turn_pairs_equal_a_loop(spark):
    rnd = random.Random(8)
    groups = [[(i, rnd.choice("HAI"), rnd.choice(["", "x", "why?", "Options: a"]), rnd.random() < 0.3) for i in range(rnd.randint(0, 9))] for _ in range(60)]
    rows = [(g, ln, text, kind == "H", kind == "A", used) for g, ls in enumerate(groups) for ln, kind, text, used in ls]
    df = spark.createDataFrame(rows, "g int, line_number int, text string, is_human boolean, is_agent boolean, used_tool boolean")
    got = {}
    for r in turns.turn_pairs(df, ["g"]).orderBy("g", "human_line_number").collect():
        got.setdefault(r["g"], []).append((r["agent_line_start"], r["agent_turn_text"], r["agent_had_tool_access"], r["human_line_number"], r["human_turn_text"]))
    assert got == {g: p for g, ls in enumerate(groups) if (p := loop_pairs(ls))}


def test_text_rules(spark):
    cases = [("okok", True), ("Looks good, thanks!", True), ("", False), ("yes please", False), ("ok " * 15, False), ("Approved.", True), (" ok ", True)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(fn.is_acknowledgment(F.col("t"))).collect()] == [v for _, v in cases]
    cases = [("why? ", True), ("a\nb?\nc", True), ("options: a", True), ("no", False), ("Choice : x", True)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(fn.asked_question(F.col("t"))).collect()] == [v for _, v in cases]
    cases = [("```x", True), ("$ git status", True), ("git", False), ("please\n  npm install", True), ("gitx y", False)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(fn.directive_hint(F.col("t"))).collect()] == [v for _, v in cases]
    cases = [("/tmp/x", True), ("/private/var/folders/a/T/b", True), ("-private-var-folders-q-T-z", True), ("/home/tmp/", False), ("-tmp-a", True)]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(fn.is_temp_path(F.col("t"))).collect()] == [v for _, v in cases]


def test_relative_time(spark):
    df = spark.sql("SELECT timestamp'2026-01-02 00:00:00' n, explode(array(timestamp'2026-01-01 23:59:40', timestamp'2026-01-01 23:30:00', timestamp'2026-01-01 20:00:00', timestamp'2025-12-30 00:00:00', null)) t")
    assert [r[0] for r in df.select(fn.relative_time(F.col("t"), F.col("n"))).collect()] == ["just now", "30m ago", "4h ago", "3d ago", "—"]


# vectors and chains


def test_cosine_and_dedupe(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 0.0]), ([], [1.0]), ([1.0, 2.0], [1.0]), ([1.0], [1.0, 9.0])]
    df = spark.createDataFrame(pairs, "a array<double>, b array<double>")
    assert [r[0] for r in df.select(similarity.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, 0.0, None, 1.0]
    assert similarity.leaders([0, 1], [2, 4], [[1, 0], [0.99, 0.01]], 0.9) == [1]
    assert similarity.leaders([0, 1], [2, 4], [[1, 0], [0, 1]], 0.9) == [0, 1]
    assert similarity.leaders([0, 1], [2, 4], [None, None], 0.9) == [0, 1]
    assert similarity.leaders([0, 1, 2], [2, 5, 5], [[1, 0]] * 3, 0.9) == [1]
    assert len(similarity.leaders([0, 1], [1, 1], [[1, 0, 0], [1, 0.39, 0]], 0.95)) == 2


def test_nearest_earlier_ties_and_lengths(spark):
    new = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [1.0])], "new_id long, embedding array<double>")
    past = spark.createDataFrame([(7, "2026-01-01", [2.0, 0.0]), (8, "2026-01-02", [1.0, 0.0]), (9, "2026-01-03", [0.0, 1.0]), (10, "2026-01-04", None)], "past_id long, created_at string, embedding array<double>")
    assert sorted((r["new_id"], r["past_id"]) for r in similarity.nearest_earlier(new, past, 0.9).collect()) == [(1, 8), (4, 8)]
    assert similarity.nearest_earlier(new, past.limit(0), 0.9).count() == similarity.nearest_earlier(new.limit(0), past, 0.9).count() == 0


def test_nearest_earlier_by_blocks_equals_the_broadcast(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    new = rows.select(F.col("vec_id").alias("new_id"), F.col("vec_id").alias("batch"), "embedding")
    past = rows.select(F.col("vec_id").alias("past_id"), F.col("vec_id").alias("batch"), F.lit("2024").alias("created_at"), "embedding")
    links = lambda: sorted((r["new_id"], r["past_id"], round(r["similarity"], 9)) for r in similarity.nearest_earlier(new, past, 0.35, "batch").collect())
    monkeypatch.setattr(similarity, "BLOCK", 64)
    sent = links()
    monkeypatch.setattr(similarity, "LITTLE", 0)
    assert sent and links() == sent


def chains(spark, rows, as_of="2026-07-16", days=30, **scope):
    episodes = spark.createDataFrame([(i, d, "p", "s", i, i, "") for i, d, _ in rows], struct("episodes"))
    found = spark.createDataFrame([(i, i, "bug_fix", f"t{i}", "", 1.0, None, p, f"{d}T00:00:00.000Z", "toil") for i, d, p in rows], struct("insights"))
    return [(r["root_id"], r["chain_length"], r["first_date"], r["last_date"]) for r in recurrence.recurrence_chains(found, episodes, as_of, days, Scope(**scope)).collect()]


def test_recurrence_graphs(spark):
    assert chains(spark, [(1, "2026-07-10", None), (2, "2026-07-12", None)]) == []
    assert chains(spark, [(1, "2026-07-10", None), (2, "2026-07-12", 1), (3, "2026-07-15", 2)]) == [(1, 3, "2026-07-10", "2026-07-15")]
    assert chains(spark, [(1, "2026-07-10", 2), (2, "2026-07-12", 1), (3, "2026-07-15", 2)]) == []
    assert chains(spark, [(1, "2026-07-10", 99)]) == []
    assert chains(spark, [(1, "2026-07-10", 99), (2, "2026-07-12", 99)]) == [(99, 2, "2026-07-10", "2026-07-12")]
    assert chains(spark, [(1, "2020-01-01", None), (2, "2026-07-12", 1)]) == [(1, 2, "2020-01-01", "2026-07-12")]
    assert chains(spark, [(1, "2026-07-10", None), (2, "2026-07-12", 1), (3, "2026-07-13", 1)])[0][:2] == (1, 3)


# ingest to brief


def write_session(root, project, session, lines):
    os.makedirs(f"{root}/{project}", exist_ok=True)
    with open(f"{root}/{project}/{session}.jsonl", "a", encoding="utf-8") as f:
        f.writelines((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in lines)


def user(text, minute, **more):
    return {"type": "user", "timestamp": f"2026-07-14T10:{minute:02d}:00Z", "message": {"content": text}, **more}


def agent(text, minute, tool=False):
    blocks = [{"type": "text", "text": text}] + ([{"type": "tool_use", "name": "Bash", "input": {"command": "ls"}}] if tool else [])
    return {"type": "assistant", "timestamp": f"2026-07-14T10:{minute:02d}:00Z", "message": {"content": blocks}}


def test_scan_rules(spark, tmp_path):
    root = str(tmp_path)
    write_session(root, "proj", "one", [{"type": "system"}, user("hi", 1, cwd="/a"), "", "{bad", "null", "3", '"s"', "[1]", {"type": "mystery"}, agent("yo", 2, True), {"type": "ai-title", "aiTitle": "T", "cwd": ""}])
    lines = transcripts.parse_lines(transcripts.all_lines(spark, root), "2026-07-14T00:00:00Z")
    got = {r["line_number"]: r["status"] for r in lines.collect()}
    assert got == {1: "noise", 2: "kept", 3: "blank", 4: "malformed", 5: "malformed", 6: "malformed", 7: "malformed", 8: "malformed", 9: "unknown", 10: "kept", 11: "noise"}
    assert [r["has_tool_use"] for r in lines.filter("status = 'kept'").orderBy("line_number").collect()] == [False, True]
    assert transcripts.max_lines(lines).first()["max_line"] == 11
    meta = transcripts.session_metadata(transcripts.all_lines(spark, root)).first()
    assert (meta["cwd"], meta["title"]) == ("/a", "T")
    text = lines.filter("line_number = 10").select(fn.render_content(F.col("raw"))).first()[0]
    assert text == 'yo\n[tool_use: Bash] {"command":"ls"}'
    assert transcripts.list_session_files(spark, root + "/none").count() == 0 and transcripts.all_lines(spark, root + "/none").count() == 0


def test_message_shapes(spark):
    raws = [
        {"message": {"content": "plain"}}, {"message": "text"}, {}, {"message": {"content": ""}}, {"message": {"content": [{"type": "text", "text": ""}]}},
        {"message": {"content": [{"type": "tool_result", "content": "r"}]}}, {"message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}]}},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in raws], "t string").select(F.parse_json("t").alias("raw"))
    got = [(r[0], r[1]) for r in df.select(fn.render_content(F.col("raw")), fn.has_text(F.col("raw"))).collect()]
    assert got == [("plain", True), ("", False), ("", False), ("", False), ("", True), ("[tool_result] r", False), ("[tool_result] a b", False)]
    flags = spark.createDataFrame([('{"isMeta": true}',), ('{"isMeta": "true"}',), ('{"isMeta": 1}',), ("{}",)], "t string").select(fn.flag_is_true(F.parse_json("t"), "isMeta"))
    assert [r[0] for r in flags.collect()] == [True, False, False, False]


def test_analyze_incrementally_and_write_a_brief(spark, tmp_path):
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    now = datetime(2026, 7, 15, tzinfo=timezone.utc)
    write_session(root, "proj", "one", [agent("What now?", 1), user("Please refactor the storage layer now", 2), agent("done", 3, True), user("git push everything to origin", 4), agent("ok", 40), user("thanks", 41)])
    dry = analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r1", dry_run=True)
    assert (dry.sessions, dry.episodes, dry.insights, s.read("episodes").count()) == (1, 2, 0, 0)
    first = analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r1")
    assert (first.sessions, first.episodes, first.dates) == (1, 2, ["2026-07-14"]) and first.insights == 2
    assert {(r["human_line_number"], r["classification"]) for r in s.read("engagement_turns").collect()} == {(2, "deliberative"), (4, "directive"), (6, "acknowledgment")}
    assert s.read("sessions").first()["last_line"] == 6 and s.read("insight_embeddings").count() == 2
    os.utime(f"{root}/proj/one.jsonl")
    write_session(root, "proj", "one", [{"type": "system"}])
    again = analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r2")
    assert (again.sessions, again.episodes) == (1, 0) and s.read("sessions").first()["last_line"] == 7
    write_session(root, "proj", "one", [user("Please refactor the storage layer now", 50)])
    third = analyze.analyze(s, root, datetime(2026, 7, 16, tzinfo=timezone.utc), use=stand_ins.all_of(), label="r3")
    assert third.episodes == 1 and s.read("insights").filter("recurrence_of IS NOT NULL").count() == 1
    ids = [r["id"] for r in s.read("episodes").orderBy("id").collect()]
    assert ids == [1, 2, 3]
    path = brief.write_brief(s.tables(), "2026-07-14", str(tmp_path / "briefs"), lambda items, effort: "A day.")
    text = open(path, encoding="utf-8").read()
    assert text.startswith("# Daily Brief — 2026-07-14\n\nA day.\n") and "## Effort Breakdown" in text and "also seen on 2026-07-14" in text and "## By Project" not in text
    assert brief.list_briefs(str(tmp_path / "briefs")) == ["2026-07-14"] and brief.read_brief(str(tmp_path / "briefs"), "2026-07-13") is None
    assert s.relabel_run("proj", "one", "r1", "better") == 2 and s.relabel_run("proj", "one", "r1", "x") == 0
    assert analyze.derive_run(s, "proj", "one", "better", stand_ins.deriver, now) == 1
    assert api.ask("session-runs", s.tables(), {"project": "proj", "session": "one"}, "2026-07-16").filter("label = 'better'").first()["derived_count"] == 1
    files = transcripts.list_session_files(spark, root)
    tables = {**s.tables(), "files": files}
    rows, totals = api.sessions_page(tables, {"project": "proj", "q": "ONE", "analyzed": "true"})
    assert [r["session_id"] for r in rows.collect()] == ["one"] and totals.first()["total_pages"] == 1
    assert api.ask("session-projects", tables, {}, "2026-07-16").first()["analyzed_count"] == 1


def test_jobs(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    now = lambda: datetime(2026, 7, 15, tzinfo=timezone.utc)
    assert analyze.run_job(s, "j1", "k", lambda: '{"n": 1}', now) == "done" and s.job("j1")["result"] == '{"n": 1}'

    def fails():
        raise RuntimeError("no")

    assert analyze.run_job(s, "j2", "k", fails, now) == "failed" and s.job("j2")["error"] == "no"
    s.put_job({"id": "j3", "kind": "k", "status": "running", "updated_at": "2020"})
    assert s.evict_jobs("2027") == 2 and s.job("j3")["status"] == "running" and s.job("j1") is None


# models


def test_bisection_and_isolation(spark):
    def cut(items):
        if len(items) > 25:
            raise models.Truncated
        return [{"n": i["n"]} for i in items]

    assert len(models.bisect(cut, [{"n": i} for i in range(90)], 20)) == 90
    with pytest.raises(models.Truncated):
        models.bisect(lambda items: (_ for _ in ()).throw(models.Truncated()), [{}] * 8, 4)
    lines = spark.createDataFrame([(k, i, "user", t) for k in ("a", "b") for i, t in enumerate(["good text", "odd"])], "episode_key string, line_number int, type string, text string")

    def extractor(items):
        if items[0]["text"] == "good text" and len(items) == 2 and items[0]["line_number"] == 0:
            return [{"category": "bug_fix", "text": "x"}, {"category": "nope", "text": "y"}, "junk"]
        raise ValueError

    assert models.generate_candidates(lines, extractor).count() == 2
    many = spark.createDataFrame([("e", i, "bug_fix", f"t{i}", "day") for i in range(90)], "episode_key string, pos int, category string, text string, batch_day string")
    batched = models.scoring_batches(many)
    assert sorted(r["count"] for r in batched.groupBy("batch").count().collect()) == [10, 40, 40]

    def scorer(items):
        return [{"index": i, "significance_score": 2, "effort_class": "bad" if any(c["text"] == "t85" for c in items) else "toil"} for i in range(len(items))]

    assert models.score_candidates(batched, scorer).count() == 80


def test_derived_ids_are_checked(spark):
    items = spark.createDataFrame([("r", 1, "bug_fix", "t", "c")], "label string, id long, category string, text string, created_at string")
    answer = [{"insight_type": "pattern", "text": "a", "evidence_insight_ids": [1]}, {"insight_type": "pattern", "text": "b", "evidence_insight_ids": [2]}, {"insight_type": "pattern", "text": "c"}]
    assert {r["text"] for r in models.derive_insights(items, lambda _: answer).collect()} == {"a", "c"}
    assert models.derive_insights(items, lambda _: 1 / 0).count() == 0


# small rules


def test_formats_and_parameters():
    assert fmt.fixed(0.25) == "0.3" and fmt.fixed(0.35) == "0.3" and fmt.percent(0.125) == "13%"
    assert fmt.preset_range("7d", "2026-07-15") == ("2026-07-09", "2026-07-15") and fmt.elapsed_days("2026-07-10", "2026-07-15") == 5
    assert fmt.run_label(datetime(2026, 7, 15, 1, 2, 3)) == "run-20260715T010203Z"
    b = {"total": 4, "engagement_ratio": 2.0, "deliberative": 1, "corrective": 2, "longest_directive_burst": 3}
    assert len(fmt.engagement_summary(b, ("manual-testing", 2))) == 4 and fmt.engagement_summary({**b, "total": 0}) == []
    assert rq.parse_days({"fromDate": "2026-01-01", "toDate": "2026-01-02", "date": "x"}) == Days("2026-01-01", "2026-01-02")
    for bad in ({"date": "2026-02-30"}, {"fromDate": "2026-01-01"}, {"fromDate": "2026-01-02", "toDate": "2026-01-01"}, {}):
        with pytest.raises(ValueError):
            rq.parse_days(bad)
    assert rq.parse_search_limit("500") == 20 and rq.parse_positive(None, 7) == 7
    with pytest.raises(ValueError):
        rq.parse_positive("0", 1)
    now = datetime(2026, 7, 15, 6, 0, tzinfo=timezone.utc)
    assert instant_cutoff(now, 7) == "2026-07-08T06:00:00.000Z" and day_cutoff(now, 7) == "2026-07-08"


def test_config():
    c = config.load_config({"LOOMLINE_IDLE_GAP_MINUTES": "40", "LOOMLINE_DEDUPE_THRESHOLD": "2", "LOOMLINE_EMBEDDING_PATH": "x", "LOOMLINE_EMBEDDING_HEADERS": '{"a": "b"}'}, history_days=3)
    assert (c.idle_gap_minutes, c.dedupe_threshold, c.embedding_path, c.embedding_headers, c.history_days) == (40, 0.95, "/v1/embeddings", {"a": "b"}, 3)


def test_listing_pages(spark):
    files = spark.createDataFrame([("p", f"s{i}", f"m{i % 3}", f"Title {i}") for i in range(5)], "project_dir string, session_id string, mtime string, title string")
    analyzed = spark.createDataFrame([("p", "s1", 4)], "project_dir string, session_id string, count long")
    rows = listing.session_listing(files, analyzed, "p")
    page, totals = listing.page_of(rows, "mtime", True, 1, 2)
    assert [r["session_id"] for r in page.collect()] == ["s2", "s1"] and tuple(totals.first()) == (5, 3)
    assert [r["session_id"] for r in listing.page_of(rows, "analyzed", True, 1, 1)[0].collect()] == ["s1"]
    assert listing.filter_listing(rows, False, "title 3").count() == 1


def test_streamed_sessions_equal_the_batch(spark, tmp_path):
    from loomline.streaming.sessions import assign_parts

    rows = [("p", s, i + 1, at(m), at(m).strftime("%Y-%m-%d"), c) for s in ("a", "b") for i, (m, c) in enumerate([(0, False), (20, False), (50, False), (51, True), (52, False), (90, False)])]
    df = spark.createDataFrame(rows, "project_dir string, session_id string, line_number int, ts timestamp, date string, is_compact boolean")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = assign_parts(stream).writeStream.format("memory").queryName("parts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["project_dir", "session_id", "line_number", "part"]
    assert sorted(map(tuple, spark.table("parts").select(key).collect())) == sorted(map(tuple, sessionize.sessionize(df).select(key).collect()))


def test_recurrence_covers_all_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    unit = np.array([r["embedding"] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids, similar = np.array([r["vec_id"] for r in rows]), unit @ unit.T
    kept = {r["id"]: r["place"] for r in library.QUERIES["e3_greedy_dedupe"](spark, SF).collect()}
    got = {r["id"]: (r["place"], r["recurrence_of"]) for r in library.QUERIES["e4_recurrence"](spark, SF).collect()}
    assert {k: place for k, (place, _) in got.items()} == kept
    for i, key in enumerate(ids):
        if key in kept:
            s = np.where(ids // 256 < key // 256, similar[i], 0)
            assert got[key][1] == (ids[s.argmax()] if s.max() >= 0.35 else None)
    assert any(link is not None and link % 5 == 0 for _, link in got.values())


# the queries without SQL, over whole tables


def test_dedupe_query_equals_a_loop(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect())
    expected = []
    for batch in sorted({i // 256 for i, _ in rows}):
        held = [(i, np.array(v, float)) for i, v in rows if i // 256 == batch]
        taken, place = set(), 0
        for i, v in held:
            if i in taken:
                continue
            near = [(j, w) for j, w in held if j >= i and j not in taken and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.35]
            taken |= {j for j, _ in near} | {i}
            best = max([i, *[j for j, _ in near]], key=lambda j: (j % 17, -j))
            expected.append((best, batch, float(best % 17), place))
            place += 1
    got = library.QUERIES["e3_greedy_dedupe"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)


def test_dedupe_keeps_ids_beside_a_null_id(spark):
    df = spark.createDataFrame([(2**60 + 1, 0, 1, 1.0, [1.0, 0.0]), (None, 1, 1, 1.0, [0.0, 1.0]), (5, 2, 1, 1.0, None)], "id long, pos int, batch int, significance_score double, embedding array<double>")
    assert {(r["id"], r["place"]) for r in similarity.greedy_dedupe(df, "batch").collect()} == {(2**60 + 1, 0), (None, 1), (5, 2)}


def test_budget_query_equals_a_loop(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id", "event_type", F.length("props").alias("n")).collect()
    expected = []
    for user in {e["user_id"] for e in events}:
        mine = sorted((e for e in events if e["user_id"] == user), key=lambda e: (e["ts"], e["event_id"]))
        parts, last = {}, {}
        for k, e in enumerate(mine):
            day = e["ts"].strftime("%Y-%m-%d")
            if day not in last:
                part = 0
            else:
                before = last[day]
                gap = (e["ts"] - mine[before]["ts"]).total_seconds() > 1440 * 60
                boundary = before + 1 < len(mine) and mine[before + 1]["event_type"] == "error"
                part = parts[day][-1][0] + (gap or boundary)
            parts.setdefault(day, []).append((part, k + 1, e["n"] or 0))
            last[day] = k

        def cut(lines):
            if len(lines) <= 1 or -(-sum(n for _, n in lines) // 4) <= 12:
                return [lines]
            return cut(lines[: len(lines) // 2]) + cut(lines[len(lines) // 2 :])

        for day, lines in parts.items():
            for part in sorted({x[0] for x in lines}):
                for piece, held in enumerate(cut([(k, n) for q, k, n in lines if q == part])):
                    expected.append((user, day, part, piece, held[0][0], held[-1][0], len(held)))
    got = [tuple(r) for r in library.QUERIES["e7_budget_split"](spark, SF).select("user_id", "date", "part", "piece", "start_line", "end_line", "n_lines").collect()]
    assert sorted(got) == sorted(expected)


# bursts over hot days, flags, deep chains


def test_bursts_by_day_equal_a_loop(spark):
    rnd = random.Random(4)
    day = lambda i: "d0" if i % 3 else f"d{i % 7}"
    rows = [(i, 1, i % 50, "directive" if rnd.random() < 0.85 else "corrective", rnd.random() < 0.1, "r", day(i), "p", f"s{i % 9}", i % 40) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, episode_id long, human_line_number int, classification string, directive_necessary boolean, reason string, date string, project_dir string, session_id string, start_line long").repartition(5)

    def longest(held):
        best = run = 0
        for r in sorted(held, key=lambda r: (r[9], r[2], r[7], r[8], r[0])):
            run = run + 1 if r[3] == "directive" and not r[4] else 0
            best = max(best, run)
        return best

    assert engagement.longest_burst(df).first()[0] == longest(rows)
    got = {r["date"]: r["longest_directive_burst"] for r in engagement.longest_burst(df, ["date"]).collect()}
    assert got == {d: longest([r for r in rows if r[6] == d]) for d in {r[6] for r in rows}}


def test_flags_come_with_the_breakdown(spark):
    episodes = spark.createDataFrame([(1, "2026-07-14", "p", "s", 1, 9, ""), (2, "2026-07-15", "p", "s", 10, 19, "")], struct("episodes"))
    t = spark.createDataFrame([(i, 1 + i % 2, i, "directive", False, f"r{i}", f"c{i}") for i in range(14)] + [(20, 2, 20, "corrective", None, "", "")], struct("engagement_turns"))
    one = engagement.breakdown_with_flags(t, episodes, Days("2026-07-14", "2026-07-15")).first()
    assert one["total"] == 15 and [f["human_line_number"] for f in one["flagged_directives"]] == [13, 11, 9, 7, 5]
    trend = engagement.trend_with_flags(t, episodes, "2026-07-16", 5).collect()
    assert [[f["reason"] for f in r["flagged_directives"]] for r in trend] == [["r12", "r10", "r8", "r6", "r4"], ["r13", "r11", "r9", "r7", "r5"]]
    none = engagement.breakdown_with_flags(t, episodes, Days("2000-01-01")).first()
    assert none["total"] == 0 and none["flagged_directives"] == []


def test_chains_have_no_depth_limit(spark):
    n = 5000
    rows = [(i, "2026-07-10", i - 1 if i > 1 else None) for i in range(1, n + 1)] + [(n + 1, "2026-07-10", n + 2), (n + 2, "2026-07-10", n + 1), (n + 3, "2026-07-10", n + 2)]
    assert chains(spark, rows) == [(1, n, "2026-07-10", "2026-07-10")]


# reading while files grow, models that answer badly, what changes the store


def test_lines_appended_during_a_run_are_read_next_time(spark, tmp_path):
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    write_session(root, "proj {a}*", "one", [user("Please refactor the storage layer now", 1), agent("ok", 2)])
    write_session(root, "proj {a}*", "two", [user("Something else to do here today", 1)])
    now = datetime(2026, 7, 15, tzinfo=timezone.utc)
    seen = transcripts.scan_new_lines(spark, root, s.read("sessions"), "2026-07-15T00:00:00.000Z")
    write_session(root, "proj {a}*", "one", [user("A line that came while the models ran", 3)])
    assert {(r["session_id"], r["max_line"]) for r in seen.seen.collect()} == {("one", 2), ("two", 1)} and seen.new.count() == 3
    real = stand_ins.extractor

    def slow(items):
        if any("storage" in x["text"] for x in items):
            write_session(root, "proj {a}*", "one", [user("Another line that came during the run", 4)])
        return real(items)

    first = analyze.analyze(s, root, now, use=stand_ins.all_of(extractor=slow), label="r1")
    cursor = {r["session_id"]: r["last_line"] for r in s.read("sessions").collect()}
    assert first.episodes == 2 and cursor == {"one": 3, "two": 1}
    os.utime(f"{root}/proj {{a}}*/one.jsonl", (2_000_000_000, 2_000_000_000))
    again = analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r2")
    assert (again.sessions, again.episodes) == (1, 1) and s.read("episodes").filter("label = 'r2'").first()["start_line"] == 4


def of_day(d, text):
    return {"type": "user", "timestamp": f"2026-07-{d}T10:00:00Z", "message": {"content": text}}


def failing_on(word):
    """An extractor that takes the task down with it at a word."""

    class Crash(BaseException):
        pass

    usual = stand_ins.extractor

    def extract(lines):
        if any(word in x["text"] for x in lines):
            raise Crash(word)
        return usual(lines)

    return extract


def test_a_session_that_fails_leaves_all_others_committed(spark, tmp_path):
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    now = datetime(2026, 7, 18, tzinfo=timezone.utc)
    write_session(root, "proj", "one", [agent("What now?", 1), of_day(14, "Please refactor the storage layer now"), of_day(15, "This bad text breaks the extractor"), of_day(16, "A later day of the same session here")])
    for name in ("two", "three", "four", "five"):
        write_session(root, "proj", name, [of_day(14, f"Something else to do here today {name}"), of_day(15, f"And something more to do that day {name}")])
    checks = str(tmp_path / "checks")
    first = analyze.analyze(s, root, now, use=stand_ins.all_of(extractor=failing_on("bad")), label="r1", spot_checks=checks)
    assert (first.sessions, first.failed, first.episodes, first.insights) == (4, 1, 11, 9) and first.dates == ["2026-07-14", "2026-07-15", "2026-07-16"]
    assert {(r["session_id"], r["last_line"], r["last_run_at"] is None) for r in s.read("sessions").collect()} == {("one", 2, True), *((n, 2, False) for n in ("two", "three", "four", "five"))}
    done = sorted((r["session_id"], r["date"][-2:]) for r in s.read("episodes").collect())
    assert done == sorted([("one", "14"), *((n, d) for n in ("two", "three", "four", "five") for d in ("14", "15"))])
    sample = "\n".join(r["value"] for r in spark.read.text(checks).collect())
    assert "### Human line 2 — deliberative\n**Agent turn:** What now?" in sample and "**Reason:** by rule" in sample and "label `r1`" in sample
    again = analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r2")  # nothing changed on disk, but one session is not at its end
    assert (again.sessions, again.failed, again.episodes) == (1, 0, 2) and s.read("sessions").filter("last_line = 4").count() == 1
    assert s.read("episodes").count() == 11 and s.read("episodes").select("id").distinct().count() == 11


@pytest.mark.parametrize(
    ("lines", "islands", "last", "missing"),
    [
        # lines 1 to 3 of a day that fails, line 4 of the day before
        ([of_day(15, "This bad text breaks the extractor"), of_day(15, "second line of the failing day"), of_day(15, "third line of the failing day"), of_day(14, "the only line of the earlier day")], [(4, 4)], 0, [1, 2, 3]),
        # a cursor that the second day would take back
        ([of_day(15, "first line of the second day here"), of_day(15, "second line of the second day here"), of_day(16, "This bad text breaks the extractor"), of_day(14, "the only line of the earliest day")], [(4, 4)], 2, [3]),
    ],
)
def test_lines_of_a_failed_day_are_found_again_and_no_others(spark, tmp_path, lines, islands, last, missing):
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    now = datetime(2026, 7, 18, tzinfo=timezone.utc)
    write_session(root, "proj", "one", lines)
    first = analyze.analyze(s, root, now, use=stand_ins.all_of(extractor=failing_on("bad")), label="r1")
    row = s.read("sessions").first()
    assert first.failed == 1 and ([tuple(i) for i in row["islands"]], row["last_line"]) == (islands, last)
    write_session(root, "proj", "one", [of_day(17, "a line that came after the failure")])
    found = transcripts.scan_new_lines(spark, root, s.read("sessions"), "2026-07-18T00:00:00.000Z")
    assert sorted(r["line_number"] for r in found.new.collect()) == [*missing, 5]
    assert analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r2").failed == 0
    covered = sorted(n for r in s.read("episodes").collect() for n in range(r["start_line"], r["end_line"] + 1))
    assert covered == [1, 2, 3, 4, 5]
    row = s.read("sessions").first()
    assert (row["last_line"], row["read_line"], row["islands"], row["read_offset"]) == (5, 5, [], os.path.getsize(f"{root}/proj/one.jsonl"))


def test_what_an_incremental_run_reads_follows_what_was_appended(spark, tmp_path, monkeypatch):
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    now = datetime(2026, 7, 18, tzinfo=timezone.utc)
    write_session(root, "proj", "one", [of_day(14, "Please refactor the storage layer now")])
    small = os.path.getsize(f"{root}/proj/one.jsonl")
    analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r1")
    write_session(root, "proj", "one", [{"type": "system", "text": "x" * 100} for _ in range(small * 1000 // 120)])  # grown a thousandfold
    monkeypatch.setattr(line_ranges, "RANGE_BYTES", 20_000)  # in many ranges
    grown = analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r2")
    size = os.path.getsize(f"{root}/proj/one.jsonl")
    assert grown.episodes == 0 and s.read("sessions").first()["read_offset"] == size > 500 * small
    write_session(root, "proj", "one", [of_day(15, "One line more is all that is read now")])
    added = os.path.getsize(f"{root}/proj/one.jsonl") - size
    found = transcripts.scan_new_lines(spark, root, s.read("sessions"), "2026-07-18T00:00:00.000Z")
    assert found.seen.first()["bytes_read"] == added
    assert [r["line_number"] for r in found.new.collect()] == [s.read("sessions").first()["last_line"] + 1]
    assert analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r3").episodes == 1


def test_lines_without_an_end(spark, tmp_path):
    """A last line without an end counts if it can be read, and is read again if it can't; what follows has the right numbers."""
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    now = datetime(2026, 7, 18, tzinfo=timezone.utc)
    path = f"{root}/proj/one.jsonl"
    os.makedirs(f"{root}/proj")
    first, second, third = (json.dumps(of_day(14, f"Please refactor the storage layer now {k}")) for k in range(3))

    def grow(text):
        with open(path, "a", encoding="utf-8", newline="") as f:
            f.write(text)
        return analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r").episodes, s.read("sessions").first()

    episodes, row = grow(first)
    assert episodes == 1 and (row["last_line"], row["read_line"], row["read_offset"], [tuple(i) for i in row["islands"]]) == (1, 0, 0, [(1, 1)])
    episodes, row = grow("\r\n" + second[:20])
    assert episodes == 0 and (row["last_line"], row["read_line"]) == (1, 1)
    episodes, row = grow(second[20:] + "\r" + third + "\n")
    assert episodes == 1 and (row["last_line"], row["read_line"], row["islands"]) == (3, 3, [])
    assert sorted((r["start_line"], r["end_line"]) for r in s.read("episodes").collect()) == [(1, 1), (2, 3)]


def test_cursors_of_older_stores_and_shortened_files(spark, tmp_path):
    root = str(tmp_path)
    write_session(root, "proj", "one", [of_day(14, "one"), of_day(14, "two"), of_day(14, "three")])
    row = lambda *end: spark.createDataFrame([("proj", "one", 2, "2020-01-01T00:00:00.000Z", *end)], struct("sessions"))
    for cursor in (row(None, None, None), row(10**9, 2, [])):
        assert [r["line_number"] for r in transcripts.scan_new_lines(spark, root, cursor, "2026-07-18T00:00:00.000Z").new.collect()] == [3]
        assert transcripts.scan_new_lines(spark, root, cursor, "2026-07-18T00:00:00.000Z", force=True).new.count() == 3


def test_ranges_give_each_line_once():
    rnd = random.Random(4)
    for _ in range(500):
        data = "".join(rnd.choices(["a", "bb", "\n", "\r", "\r\n", "ccccccc", "é"], k=rnd.randint(0, 25))).encode()
        ends = list(np.cumsum([0, *map(len, data.splitlines(keepends=True))]).tolist())
        first, found, wanted = rnd.choice(ends), [], []
        at = first
        for line in data[first:].splitlines(keepends=True):
            wanted.append((at, at + len(line), line.rstrip(b"\r\n") if line[-1:] in b"\r\n" else line))
            at += len(line)
        for task in line_ranges.cut_ranges([("f", first, len(data))], rnd.randint(1, 9)):
            for _, low, start, stop, last, _ in task.ranges:
                found += line_ranges.lines_of_range(line_ranges._Bytes(pa.BufferReader(data)), low, start, stop, last)
        assert found == wanted, data


def test_added_rows_come_to_their_table(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/store")
    rows = lambda k: spark.createDataFrame([(k, f"2026-07-{k}", "p", "s", 1, 1, "")], struct("episodes"))
    for k in range(11, 16):
        s.commit({}, {"episodes": rows(k)})
    rows(30).withColumn("commit", F.lit(5)).write.mode("append").partitionBy("commit").parquet(f"{tmp_path}/store/episodes")  # a commit that was never finished
    assert sorted(r["id"] for r in s.read("episodes").collect()) == list(range(11, 16))
    s.compact("episodes")
    assert sorted(r["id"] for r in s.read("episodes").collect()) == list(range(11, 16)) and len(s._shown("episodes")) == 1
    s.commit({"episodes": rows(20)})
    assert [r["id"] for r in store.Store(spark, f"{tmp_path}/store").read("episodes").collect()] == [20]
    cursor = lambda name, line: spark.createDataFrame([("p", name, line, None, 0, line, [])], struct("sessions"))
    for name, line in (("a", 3), ("b", 4), ("a", 9)):
        s.commit({}, {"sessions": cursor(name, line)})
    assert sorted((r["session_id"], r["last_line"]) for r in s.read("sessions").collect()) == [("a", 9), ("b", 4)]


def test_known_questions_are_not_asked_again(spark, tmp_path, monkeypatch):
    """Each call leaves a file; a run that fails, its retries and a forced run ask nothing twice, but for what was lost with its slice."""
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    now, calls = datetime(2026, 7, 18, tzinfo=timezone.utc), str(tmp_path / "calls")
    os.makedirs(calls)
    for name in ("one", "two", "three"):
        write_session(root, "proj", name, [agent(f"What now {name}?", 1), of_day(14, f"Please refactor the storage layer of {name}"), of_day(15, f"And something more to do that day {name}")])

    def counted(kind, model):
        def call(items):
            with open(f"{calls}/{kind}-{os.getpid()}-{time.time_ns()}", "x"):
                return model(items)

        return call

    usual = {"extractor": stand_ins.extractor, "scorer": stand_ins.scorer, "classifier": stand_ins.classifier, "embedder": stand_ins.embedder}
    told = stand_ins.all_of(**{k: counted(k, m) for k, m in usual.items()})
    real = analyze.similarity.apply_recurrence

    def breaks(items, *more):
        if items.filter("text LIKE '%two%'").count():
            raise RuntimeError("no links for two")
        return real(items, *more)

    monkeypatch.setattr(analyze.similarity, "apply_recurrence", breaks)
    first = analyze.analyze(s, root, now, use=told, label="r1")
    assert (first.failed, first.sessions) == (1, 2)
    asked = lambda: {k: len([f for f in os.listdir(calls) if f.startswith(k)]) for k in usual}
    # 6 episodes with a batch for each of their days, all asked in the first attempt; classifying came after what failed
    before = asked()
    assert before["extractor"] == before["scorer"] == before["embedder"] == 6
    monkeypatch.setattr(analyze.similarity, "apply_recurrence", real)
    assert analyze.analyze(s, root, now, use=told, label="r2").failed == 0
    after = asked()
    assert {k: after[k] for k in ("extractor", "scorer", "embedder")} == {k: before[k] for k in ("extractor", "scorer", "embedder")} and after["classifier"] > before["classifier"]
    assert analyze.analyze(s, root, now, use=told, label="r3", force=True).episodes == 6 and asked() == after
    newer = config.Config(model_version="2")
    assert analyze.analyze(s, root, now, newer, told, label="r4", force=True).episodes == 6 and asked()["extractor"] == 12


def test_calls_at_once_are_bounded_and_slices_are_kept(spark, tmp_path, monkeypatch):
    log = str(tmp_path)

    def slow(item):
        begin = time.time()
        time.sleep(0.05)
        with open(f"{log}/{item['n']}", "w") as f:
            f.write(f"{begin} {time.time()}")
        if item["n"] == 13:
            raise ValueError
        return item["n"] * 2

    questions = spark.createDataFrame([(i, json.dumps({"n": i % 40})) for i in range(60)], "pos int, question string").repartition(8)
    got = {r["pos"]: r["answer"] for r in asking.ask(questions, slow, "k", asking.Asking(3)).collect()}
    assert got == {i: None if i % 40 == 13 else str(i % 40 * 2) for i in range(60)}
    spans = [tuple(map(float, open(f"{log}/{f}").read().split())) for f in os.listdir(log)]
    assert len(spans) == 40 and max(sum(a <= t < b for a, b in spans) for t, _ in spans) <= 3

    class Crash(BaseException):
        pass

    def crashes(item):
        if item["n"] == 13:
            raise Crash
        return item["n"]

    kept = []
    monkeypatch.setattr(asking, "SLICE", 10)
    with pytest.raises(Exception, match="Crash"):
        asking.ask(questions, crashes, "k", asking.Asking(2, keep=lambda df: kept.extend(df.collect())))
    assert 20 <= len(kept) < 40  # all slices but the one that crashed
    odd = asking.ask(questions.limit(1).withColumn("question", F.lit(None).cast("string")), slow, "k", asking.Asking())
    assert odd.first()["answer"] is None and asking.ask(questions.limit(0), slow, "k", asking.Asking()).count() == 0


def test_invalid_scores_fail_their_batch(spark):
    many = spark.createDataFrame([("e", i, "bug_fix", f"t{i}", "day") for i in range(2)], "episode_key string, pos int, category string, text string, batch_day string")
    batched, right = models.scoring_batches(many), {"index": 0, "significance_score": 1.5, "effort_class": "toil"}
    for odd in ([{**right, "significance_score": float("nan")}], [{**right, "significance_score": True}], [right, right], [{**right, "index": False}], [{**right, "index": 1.0}], [{**right, "index": 2}], [{**right, "index": "0"}], [right, None], None, "x", {}):
        assert models.score_candidates(batched, lambda _, odd=odd: odd).count() == 0
    got = models.score_candidates(batched, lambda _: [{**right, "index": 1}, right]).collect()
    assert sorted((r["pos"], r["significance_score"], r["text"]) for r in got) == [(0, 1.5, "t0"), (1, 1.5, "t1")]


def test_malformed_vectors_are_null(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(7)] + [(7, None)], "id int, text string")
    odd = {"t0": [1, 2.5], "t1": ["no number"], "t2": [float("nan")], "t3": [True], "t4": None, "t5": [], "t6": "12"}
    got = {r["id"]: r["embedding"] for r in similarity.embed(rows, lambda texts: [odd[t] for t in texts]).collect()}
    assert got == {0: [1.0, 2.5], **dict.fromkeys(range(1, 8))}
    assert similarity.embed(rows, lambda texts: texts * 2).filter("embedding IS NOT NULL").count() == 0


def test_vectors_over_http(monkeypatch, caplog):
    seen = []

    class Answers(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers["X-Key"], self.headers["X-More"]))
            raw = {"good": b'{"data": [{"embedding": [1, 2]}]}', "odd": b'{"data": []}', "text": b"no json"}.get(body["input"])
            self.send_response(200 if raw else 500)
            self.end_headers()
            self.wfile.write(raw or b"")

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = config.load_config({"L_EMBEDDING_URL": f"http://127.0.0.1:{server.server_port}/", "L_EMBEDDING_PATH": "/v", "L_EMBEDDING_KEY": "k", "L_EMBEDDING_AUTH_HEADER": "X-Key", "L_EMBEDDING_AUTH_SCHEME": "Token", "L_EMBEDDING_HEADERS": '{"X-More": "m"}', "L_EMBEDDING_MODEL": "small"}, "L_")
    embed = providers.embedder_of(c)
    assert embed(["good", "odd", "text", "bad", "bad"]) == [[1, 2], None, None, None, None]
    assert seen[0] == ("/v", {"model": "small", "input": "good"}, "Token k", "m")
    assert len([r for r in caplog.records if "request" in r.getMessage()]) == 1  # told once
    server.shutdown()
    server.server_close()
    assert embed(["good"]) == [None] and providers.embedder_of(config.Config()) is None


def clustered(n, of, batches, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(of, 16))
    return [(i, i * batches // n, i, float(i % 17), (centers[rng.integers(of)] + 0.12 * rng.normal(size=16)).tolist()) for i in range(n)]


VECTORS = "id long, batch int, pos long, significance_score double, embedding array<double>"


def test_deep_pages_sort_little(spark, monkeypatch):
    monkeypatch.setattr(paging, "DEEP", 0)
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 5).alias("score"))  # hot ties, and nulls
    order = [F.desc("score"), F.col("id")]
    plain = [r["id"] for r in rows.orderBy(*order).collect()]
    for offset in (0, 17, 10_000, 19_990, 30_000):
        assert [r["id"] for r in paging.page(rows, order, offset, 20).collect()] == plain[offset : offset + 20]
    held, before = paging._of_page(paging._ranged(rows, order), 10_000, 20)
    assert held.count() < 500 and before <= 10_000
    listed = rows.select(F.lit("p").alias("project_dir"), F.lpad(F.col("id").cast("string"), 6, "0").alias("session_id"), F.lit(None).cast("string").alias("title"))
    assert [r["session_id"] for r in listing.page_of(listed, "title", True, 400, 20)[0].collect()] == [f"{i:06d}" for i in range(7980, 8000)]


def test_search_by_trigrams_equals_a_scan(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choices("abC é_%\\", k=rnd.randint(0, 12))) for _ in range(400)] + ["", None, "ab", "Needle in a haystack", "needle%in_a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    index = spark.createDataFrame(grams.postings(rows, "id").collect(), "gram string, id long")
    for query in ("abc", "ABC", "a_c", "b%C a", "é", "", "needle in", "NEEDLE%A_", "abcabcabcabc", "a\\b", "c é%%ab"):
        wanted = sorted(r["id"] for r in rows.filter(fn.like_folded(F.col("text"), query)).collect())
        assert sorted(r["id"] for r in grams.matching(rows, "id", "text", query, index, "id").collect()) == wanted, query
    # rows that LIKE looks at
    assert grams.candidates(index, "id", "needle in").count() == 1 and grams.candidates(index, "id", "ab") is None
    assert grams.candidates(index, "id", "abc").count() < 40


def test_search_uses_the_index_of_the_store(spark, tmp_path):
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    now = datetime(2026, 7, 15, tzinfo=timezone.utc)
    old = spark.createDataFrame([(1, 1, "bug_fix", "An older insight on storage", "", 1.0, None, None, "2026-07-01T00:00:00.000Z", "toil")], struct("insights"))
    s.commit({}, {"insights": old, "episodes": spark.createDataFrame([(1, "2026-07-01", "proj", "zero", 1, 2, "")], struct("episodes"))})
    write_session(root, "proj", "one", [agent("What now?", 1), user("Please refactor the storage layer now", 2)])
    assert "insight_grams" not in s.tables() and api.ask("search", s.tables(), {"q": "storage"}, "2026-07-16").count() == 1
    analyze.analyze(s, root, now, use=stand_ins.all_of(), label="r1")
    found = api.ask("search", s.tables(), {"q": "STOR_GE"}, "2026-07-16").collect()
    assert sorted(r["text"] for r in found) == ["An older insight on storage", "Please refactor the storage layer now"]
    assert grams.candidates(s.read("insight_grams"), "insight_id", "storage layer").count() == 1


def test_pruned_search_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LITTLE", 0)
    n = 4000
    rows = clustered(n, 40, 10, 1)
    df = spark.createDataFrame([*rows, (n, 9, 0, 0.0, None), (n + 1, 9, 0, 0.0, [0.0] * 16), (n + 2, 9, 0, 0.0, [])], VECTORS)
    new, past = df.select(F.col("id").alias("new_id"), "batch", "embedding"), df.select(F.col("id").alias("past_id"), F.lit("x").alias("created_at"), "batch", "embedding")
    unit = np.array([r[4] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    similar, batch = unit @ unit.T, np.array([r[1] for r in rows])
    similar[~(batch[None, :] < batch[:, None])] = 0
    best = np.round(similar, 12).argmax(1)
    wanted = {i: int(best[i]) for i in range(n) if similar[i, best[i]] >= 0.9}
    assert {r["new_id"]: r["past_id"] for r in similarity.nearest_earlier(new, past, 0.9, "batch").collect()} == wanted
    assert similarity.pairs_compared(new, past, 0.9, "batch") < 0.3 * n * n * 0.45
    assert similarity.nearest_earlier(new, past.limit(0), 0.9).count() == similarity.nearest_earlier(new.limit(0), past, 0.9).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [1.0])], "new_id long, embedding array<double>")
    older = spark.createDataFrame([(7, "2026-01-01", [2.0, 0.0]), (8, "2026-01-02", [1.0, 0.0]), (9, "2026-01-03", [0.0, 1.0]), (10, "2026-01-04", None)], "past_id long, created_at string, embedding array<double>")
    assert sorted((r["new_id"], r["past_id"]) for r in similarity.nearest_earlier(mixed, older, 0.9).collect()) == [(1, 8), (4, 8)]


def test_pruned_search_deals_vectors_to_few_shares(spark, monkeypatch):
    """Vectors that rule out nothing go to a fixed number of shares, however many they are; ties, limits and null batches are those of all pairs."""
    monkeypatch.setattr(similarity, "LITTLE", 0)
    n = 9000
    rnd = np.random.default_rng(5)
    vectors = rnd.normal(size=(n, 8)).round(1)
    vectors[n // 2 :: 3] = vectors[0]  # a large group of copies
    rows = [(i, None if i % 500 == 7 else i // 256, v) for i, v in enumerate(vectors.tolist())]
    df = spark.createDataFrame(rows, "new_id long, batch long, embedding array<double>")
    past = df.withColumnRenamed("new_id", "past_id").withColumn("created_at", F.lit("x"))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    batch = np.array([np.nan if b is None else b for _, b, _ in rows])
    similar = unit @ unit.T
    similar[~(batch[None, :] < batch[:, None]) | (similar < 0.35)] = 0
    best = np.round(similar, 12).argmax(1)
    wanted = {i: int(best[i]) for i in range(n) if similar[i, best[i]] > 0}
    assert {r["new_id"]: r["past_id"] for r in similarity.nearest_earlier(df, past, 0.35, "batch").collect()} == wanted
    placed = similarity._placed(df, "new_id", "batch", 1), similarity._placed(past, "past_id", "batch", 0, "created_at")
    # one row for each share and part that met
    assert pruned.search(*placed, 0.35).filter("compared IS NOT NULL").count() <= 64


def test_recurrence_query_deals_vectors_to_few_shares(spark, monkeypatch, tmp_path):
    """e4_recurrence with more survivors than are sent to all tasks: links of all pairs, from a number of meetings that doesn't grow with the table."""
    met, search = [], pruned.search
    monkeypatch.setattr(pruned, "search", lambda *given: met.append(search(*given)) or met[-1])
    n = 10_000
    vectors = np.random.default_rng(8).normal(size=(n, 64)).astype(np.float32)
    vectors[n // 2 :: 7] = vectors[3]
    spark.createDataFrame(list(enumerate(vectors.tolist())), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["id"]: r["recurrence_of"] for r in library.QUERIES["e4_recurrence"](spark, str(tmp_path)).collect()}
    assert len(got) > similarity.LITTLE
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1, keepdims=True)
    kept, batch = np.array(sorted(got)), np.arange(n) // 256
    similar = unit[kept] @ unit.T
    similar[~(batch[None, :] < batch[kept][:, None]) | (similar < 0.35)] = 0
    best = np.round(similar, 12).argmax(1)
    assert got == {int(i): int(k) if similar[at, k] else None for at, (i, k) in enumerate(zip(kept, best))}
    assert [m.filter("compared IS NOT NULL").count() <= 64 for m in met] == [True]


def test_leaders_in_rounds_equal_the_loop(spark):
    """A batch of 100,000, of which 30,000 are one vector; and small batches and items without a vector beside it."""
    n = 100_000
    rows = clustered(n, 600, 1, 2)
    rows = [(i, b, p, s, rows[7][4] if i % 10 < 3 else v) for i, b, p, s, v in rows]
    rows = [(i, b, p, s, None if i % 1000 == 5 else v) for i, b, p, s, v in rows] + [(n + i, 5, -i, 1.0, [1.0, float(i)]) for i in range(3)] + [(n + 9, None, 0, 1.0, [1.0])]
    loop = lambda some: [(some[k][0], place) for place, k in enumerate(similarity.leaders([r[2] for r in some], [r[3] for r in some], [r[4] for r in some], 0.95))]
    wanted = sorted(loop(rows[:n]) + loop(rows[n : n + 3]) + loop(rows[n + 3 :]))
    got = similarity.greedy_dedupe(spark.createDataFrame(rows, VECTORS).repartition(8), "batch", 0.95)
    assert got.columns == ["id", "batch", "pos", "significance_score", "embedding", "place"]
    assert sorted((r["id"], r["place"]) for r in got.select("id", "place").collect()) == wanted


def test_leaders_over_several_rounds(spark, monkeypatch):
    for name in ("LOCAL", "HEAD", "CHUNK"):
        monkeypatch.setattr(similarity, name, {"LOCAL": 10, "HEAD": 40, "CHUNK": 8}[name])
    rows = clustered(900, 150, 3, 3)
    wanted = []
    for batch in range(3):
        some = [r for r in rows if r[1] == batch]
        wanted += [(some[k][0], place) for place, k in enumerate(similarity.leaders([r[2] for r in some], [r[3] for r in some], [r[4] for r in some], 0.95))]
    got = similarity.greedy_dedupe(spark.createDataFrame(rows, VECTORS), "batch", 0.95).collect()
    assert sorted((r["id"], r["place"]) for r in got) == sorted(wanted)


def test_malformed_answers_yield_nothing(spark):
    items = spark.createDataFrame([("r", 1, "bug_fix", "t", "c")], "label string, id long, category string, text string, created_at string")
    good = {"insight_type": "pattern", "text": "a", "evidence_insight_ids": [1]}
    for odd in (None, 3, "x", [None], [[]], [{}], [{"insight_type": 1, "text": "a"}], [{**good, "evidence_insight_ids": 3}], [{**good, "evidence_insight_ids": [[1]]}], [{**good, "text": None}]):
        assert models.derive_insights(items, lambda _, odd=odd: odd).count() == 0
    assert models.derive_insights(items, lambda _: [None, good, {}]).count() == 1
    pairs = spark.createDataFrame([(1, 2, "agent", "please look again", False)], "episode_id long, human_line_number int, agent_turn_text string, human_turn_text string, agent_asked_question boolean")
    right = {"human_line_number": 2, "classification": "corrective"}
    for odd in (None, 7, [None], [{**right, "human_line_number": [2]}], [{**right, "classification": ["corrective"]}], [{**right, "directive_necessary": "yes"}]):
        assert models.classify_turns(pairs, lambda _, odd=odd: odd).count() == 0
    assert models.classify_turns(pairs, lambda _: [{}, right]).count() == 1


def test_what_changes_the_store(spark, tmp_path):
    root, s = str(tmp_path / "logs"), store.Store(spark, str(tmp_path / "store"))
    write_session(root, "proj", "one", [agent("What now?", 1), user("Please refactor the storage layer now", 2)])
    now = lambda: datetime(2026, 7, 15, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        api.send("sessions/analyze", s, {"project": "proj", "session": "one"}, now)
    with pytest.raises(KeyError):
        api.send("other", s, {}, now)
    use = stand_ins.all_of(deriver=stand_ins.deriver)
    done = api.send("sessions/analyze", s, {"project": "proj", "session": "one", "label": "r1"}, now, use, root, "j1")
    job = json.loads(api.ask("jobs", s.tables(), {"id": "j1"}, "2026-07-15").first()["result"])
    assert done == {"id": "j1", "status": "done"} and (job["insights"], job["derived"]) == (1, 1)
    assert api.send("labels", s, {"project": "proj", "session": "one", "from": "r1", "to": "r2"}, now) == {"updated": 1}
    assert api.send("derive-insights", s, {"project": "proj", "session": "one", "label": "r2"}, now, use, job_id="j2")["status"] == "done"
    tables = {**s.tables(), **api.file_tables(spark, root)}
    assert api.ask("session-projects", tables, {}, "2026-07-15").first()["session_count"] == 1
    assert [r["session_id"] for r in api.ask("sessions-all", tables, {"project": "proj"}, "2026-07-15").collect()] == ["one"]
    assert api.briefs(str(tmp_path / "none")) == []
    with pytest.raises(SystemExit):
        cli.models_of(None)


def test_grams_take_a_text_apart_once(spark):
    """Folding the whole text for each of its trigrams took minutes for a text of this length."""
    rnd = np.random.default_rng(3)
    letters = ["A", "b", "Z", "é", "日", "😀", "İ", "%", " "]
    long = "".join(letters[i] for i in rnd.integers(0, len(letters), 60_000))
    texts = [long, None, "", "ab", "AbC", "😀A😀", "aaaa"]
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s or "")
    wanted = sorted((g, i) for i, t in enumerate(texts) for f in [fold(t)] for g in {f[k : k + 3] for k in range(len(f) - 2)})
    began = time.time()
    got = [tuple(r) for r in grams.postings(spark.createDataFrame(list(enumerate(texts)), "id long, text string").coalesce(1), "id").collect()]
    assert time.time() - began < 40
    assert sorted(got) == wanted
    assert [g for g, _ in got] == [g for g, _ in wanted]
