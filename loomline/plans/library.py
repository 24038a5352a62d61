"""The registered queries over the driver tables, each with its oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import columns as fn
from loomline.operators import engagement, grams, insights, listing, recurrence, search, sessionize, similarity, turns
from loomline.operators.scope import Days, Scope
from loomline.plans import bindings as b
from loomline.plans.bindings import sql
from loomline.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

YEAR = Days("1998-01-01", "1998-12-31")
DAY = Days("1998-07-15")
WINDOW = 730
SCOPE = Scope(project_dir="p3")
EVENT_DAYS = Days("2024-01-05", "2024-01-20")
IN_YEAR = "date BETWEEN '1998-01-01' AND '1998-12-31'"
IN_WINDOW = "date >= strftime(DATE '2001-08-01' - INTERVAL 730 DAY, '%Y-%m-%d')"
IN_EVENTS = "date BETWEEN '2024-01-05' AND '2024-01-20'"
IN_EVENT_WINDOW = "date >= strftime(DATE '2024-01-31' - INTERVAL 20 DAY, '%Y-%m-%d')"
EFFORT = "count(*) FILTER (effort_class = 'toil') AS toil, count(*) FILTER (effort_class = 'judgment') AS judgment, count(*) FILTER (effort_class = 'overhead') AS overhead"
RATIOS = "coalesce(toil / nullif(total, 0), 0)::DOUBLE AS toil_ratio, coalesce(judgment / nullif(total, 0), 0)::DOUBLE AS judgment_ratio, coalesce(overhead / nullif(total, 0), 0)::DOUBLE AS overhead_ratio"
ITEM = "id, episode_id, category, text, evidence_ref, significance_score, verified_by_git, recurrence_of, created_at, effort_class, date, project_dir, session_id, label"
ITEM_COLUMNS = ITEM.split(", ")
#: ids that may be null are shown as text
ITEM_SQL = ITEM.replace("recurrence_of", "recurrence_of::VARCHAR AS recurrence_of")
TURN = "id, episode_id, human_line_number, reason, date, project_dir, session_id, start_line"
TURN_ORDER = "start_line, human_line_number, project_dir, session_id, id"


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _shown() -> list[Column]:
    return [F.col(c).cast("string").alias(c) if c == "recurrence_of" else F.col(c) for c in ITEM_COLUMNS]


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return b.insights(spark, sf_dir), b.episodes(spark, sf_dir)


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return b.turns(spark, sf_dir), b.event_episodes(spark, sf_dir)


@register("g1_category_trend", sql(f"SELECT date, category, count(*) AS count FROM placed WHERE {IN_WINDOW} AND project_dir = 'p3' GROUP BY ALL", "placed"))
def g1(spark, sf):
    return insights.category_trend(*_both(spark, sf), b.AS_OF, WINDOW, SCOPE)


@register("g2_insight_count", sql(f"SELECT count(*) AS count FROM placed WHERE {IN_YEAR}", "placed"))
def g2(spark, sf):
    return insights.insight_count(*_both(spark, sf), YEAR)


@register("g3_cross_project", sql(f"SELECT project_dir, count(*) AS insight_count FROM placed WHERE {IN_YEAR} GROUP BY 1", "placed"))
def g3(spark, sf):
    return insights.cross_project(*_both(spark, sf), YEAR)


@register("g4_project_effort", sql(f", c AS (SELECT project_dir, {EFFORT} FROM placed WHERE date = '1998-07-15' GROUP BY 1), t AS (SELECT *, toil + judgment + overhead AS total FROM c) SELECT *, {RATIOS} FROM t", "placed"))
def g4(spark, sf):
    return insights.project_effort(*_both(spark, sf), DAY)


@register("g5_effort_breakdown", sql(f", c AS (SELECT {EFFORT} FROM placed WHERE {IN_YEAR}), t AS (SELECT *, toil + judgment + overhead AS total FROM c) SELECT *, {RATIOS} FROM t", "placed"))
def g5(spark, sf):
    return insights.effort_breakdown(*_both(spark, sf), YEAR)


@register("g6_effort_trend", sql(f", c AS (SELECT date, {EFFORT} FROM placed WHERE {IN_WINDOW} GROUP BY 1), t AS (SELECT *, toil + judgment + overhead AS total FROM c) SELECT *, {RATIOS} FROM t", "placed"))
def g6(spark, sf):
    return insights.effort_trend(*_both(spark, sf), b.AS_OF, WINDOW)


@register("g7_effort_by_category", sql(f", c AS (SELECT category, {EFFORT} FROM placed WHERE {IN_YEAR} GROUP BY 1) SELECT *, toil + judgment + overhead AS total FROM c", "placed"))
def g7(spark, sf):
    return insights.effort_by_category(*_both(spark, sf), YEAR)


@register("g8_labels", sql("SELECT label, count(*) AS count FROM placed GROUP BY 1", "placed"))
def g8(spark, sf):
    return insights.labels(*_both(spark, sf))


@register("g9_projects", sql("SELECT project_dir, count(*) AS count FROM placed GROUP BY 1", "placed"))
def g9(spark, sf):
    return insights.projects(*_both(spark, sf))


@register("g10_sessions", sql("SELECT project_dir, session_id, count(*) AS count FROM placed GROUP BY ALL", "placed"))
def g10(spark, sf):
    return insights.sessions(*_both(spark, sf))


@register(
    "g11_session_runs",
    sql(
        """, r AS (SELECT label, count(*) AS insight_count, max(created_at) AS latest_created_at FROM placed WHERE project_dir = 'p4' AND session_id = 's4' GROUP BY 1),
    d AS (SELECT label, count(*) AS n FROM derived WHERE project_dir = 'p4' AND session_id = 's4' GROUP BY 1)
    SELECT r.*, coalesce(d.n, 0) AS derived_count FROM r LEFT JOIN d USING (label)""",
        "placed",
        "derived",
    ),
)
def g11(spark, sf):
    return insights.session_runs(*_both(spark, sf), b.derived(spark, sf), "p4", "s4")


@register("g12_insight_dates", sql("SELECT DISTINCT date FROM placed", "placed"))
def g12(spark, sf):
    return insights.insight_dates(*_both(spark, sf))


_COUNTS = """count(*) FILTER (u) AS du, count(*) FILTER (classification = 'directive' AND NOT u) AS dn, count(*) FILTER (classification = 'deliberative') AS deliberative,
    count(*) FILTER (classification = 'corrective') AS corrective, count(*) FILTER (classification = 'acknowledgment') AS acknowledgment"""
_SHOWN = """du + dn AS directive, dn AS directive_necessary, du AS directive_unnecessary, deliberative, corrective, acknowledgment, du + dn + deliberative + corrective AS total,
    ((deliberative + corrective) / nullif(du, 0))::DOUBLE AS engagement_ratio, coalesce(n, 0)::BIGINT AS longest_directive_burst"""
_U = "classification = 'directive' AND NOT coalesce(directive_necessary, false)"


@register(
    "g13_engagement_breakdown",
    sql(
        f""", t AS (SELECT *, {_U} AS u FROM placed_turns WHERE {IN_EVENTS}), c AS (SELECT {_COUNTS} FROM t),
    i AS (SELECT u, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER (ORDER BY {TURN_ORDER}) AS k FROM t),
    m AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM i WHERE u GROUP BY k)) SELECT {_SHOWN} FROM c, m""",
        "placed_turns",
    ),
)
def g13(spark, sf):
    return engagement.engagement_breakdown(*_turns(spark, sf), EVENT_DAYS)


@register(
    "g14_engagement_trend",
    sql(
        f""", t AS (SELECT *, {_U} AS u FROM placed_turns WHERE {IN_EVENT_WINDOW}), c AS (SELECT date, {_COUNTS} FROM t GROUP BY 1),
    i AS (SELECT date, u, sum(CASE WHEN u THEN 0 ELSE 1 END) OVER (PARTITION BY date ORDER BY {TURN_ORDER}) AS k FROM t),
    m AS (SELECT date, max(n) AS n FROM (SELECT date, count(*) AS n FROM i WHERE u GROUP BY date, k) GROUP BY 1) SELECT date, {_SHOWN} FROM c LEFT JOIN m USING (date)""",
        "placed_turns",
    ),
)
def g14(spark, sf):
    return engagement.engagement_trend(*_turns(spark, sf), b.EVENTS_AS_OF, 20)


@register("w3_flagged_directives", sql(f"SELECT {TURN} FROM placed_turns WHERE {IN_EVENTS} AND {_U} ORDER BY start_line DESC, human_line_number DESC, project_dir DESC, session_id DESC, id DESC LIMIT 5", "placed_turns"))
def w3(spark, sf):
    return engagement.flagged_directives(*_turns(spark, sf), EVENT_DAYS).select(*TURN.split(", "))


@register(
    "w3_flagged_by_date",
    sql(
        f"""SELECT {TURN}, place FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY start_line DESC, human_line_number DESC, project_dir DESC, session_id DESC, id DESC) AS place
    FROM placed_turns WHERE {IN_EVENT_WINDOW} AND {_U}) WHERE place <= 5""",
        "placed_turns",
    ),
)
def w3_by_date(spark, sf):
    return engagement.flagged_by_date(*_turns(spark, sf), b.EVENTS_AS_OF, 20).select(*TURN.split(", "), "place")


@register(
    "g16_directive_themes",
    sql(
        f""", t AS (SELECT *, CASE WHEN reason ILIKE '%manually ran%' THEN 'manual-testing' WHEN reason ILIKE '%code review%' THEN 'manual-code-review' WHEN reason ILIKE '%already%doing%' THEN 'redundant-order'
        WHEN reason ILIKE '%told agent%' THEN 'procedural-instruction' ELSE 'other' END AS theme FROM placed_turns WHERE {IN_EVENTS} AND {_U}),
    n AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY {TURN_ORDER}) AS k FROM t)
    SELECT theme, count(*) AS count, string_agg(human_line_number::VARCHAR, ',' ORDER BY k) FILTER (k <= 3) AS example_lines FROM n GROUP BY 1""",
        "placed_turns",
    ),
)
def g16(spark, sf):
    t, e = _turns(spark, sf)
    rows = insights.with_episodes(t, e).filter(EVENT_DAYS.condition() & engagement._unnecessary())
    found = engagement.directive_themes(rows)
    return found.select("theme", "count", F.array_join(F.transform("examples", lambda x: x["human_line_number"].cast("string")), ",").alias("example_lines"))


@register("t1_top_insights", sql(f"SELECT {ITEM_SQL} FROM placed WHERE {IN_YEAR} ORDER BY significance_score DESC, id LIMIT 25 OFFSET 10", "placed"))
def t1(spark, sf):
    return insights.top_insights(*_both(spark, sf), YEAR, 25, 10).select(*_shown())


@register(
    "t2_search",
    sql(
        """, p AS (SELECT DISTINCT project_dir FROM episodes WHERE project_dir LIKE '%5%' ORDER BY 1 LIMIT 7),
    s AS (SELECT DISTINCT project_dir, session_id FROM episodes WHERE session_id LIKE '%5%' ORDER BY 1, 2 LIMIT 7),
    i AS (SELECT project_dir, session_id, id, text FROM placed WHERE lower(text) LIKE '%5%' ORDER BY significance_score DESC, id LIMIT 7),
    a AS (SELECT 0 AS branch, 'project' AS kind, project_dir, NULL AS session_id, NULL::BIGINT AS insight_id, NULL AS text FROM p
      UNION ALL SELECT 1, 'session', project_dir, session_id, NULL, NULL FROM s UNION ALL SELECT 2, 'insight', project_dir, session_id, id, text FROM i)
    SELECT * REPLACE (insight_id::VARCHAR AS insight_id) FROM (SELECT * FROM a ORDER BY branch, project_dir, session_id, insight_id LIMIT 20)""",
        "placed",
    ),
)
def t2(spark, sf):
    return search.search(*_both(spark, sf), " 5 ", 20).withColumn("insight_id", F.col("insight_id").cast("string"))


@register("t2_search_text", sql("SELECT doc_id, lang, source FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%rights re_erved%'").replace("WITH \n", ""))
def t2_text(spark, sf):
    return b.table(spark, sf, "documents").filter(fn.like_folded(F.col("text"), "Rights RE_erved")).select("doc_id", "lang", "source")


@register("t2_search_indexed", sql(f"SELECT {ITEM_SQL} FROM placed WHERE lower(text) LIKE '%tem 12_ o%'", "placed"))
def t2_indexed(spark, sf):
    """Insights by a pattern, through posting lists that are written first."""
    i, e = _both(spark, sf)
    index = written(grams.postings(i, "id"))
    return insights.with_episodes(grams.matching(i, "id", "text", "Tem 12_ O", index, "id"), e).select(*_shown())


@register(
    "t3_session_page",
    sql(
        """, a AS (SELECT project_dir, session_id, count(*) AS run_count FROM placed GROUP BY ALL), f AS (SELECT project_dir, session_id, max(date) AS mtime FROM episodes WHERE project_dir = 'p3' GROUP BY ALL)
    SELECT f.*, coalesce(run_count, 0) AS run_count, run_count IS NOT NULL AS analyzed FROM f LEFT JOIN a USING (project_dir, session_id) ORDER BY mtime DESC, session_id LIMIT 20 OFFSET 20""",
        "placed",
    ),
)
def t3(spark, sf):
    i, e = _both(spark, sf)
    files = e.groupBy("project_dir", "session_id").agg(F.max("date").alias("mtime"))
    rows = listing.session_listing(files, insights.sessions(i, e, "p3"), "p3")
    return listing.page_of(rows, "mtime", True, 2, 20)[0]


@register(
    "g15_session_projects",
    sql(
        """, s AS (SELECT DISTINCT project_dir, session_id FROM episodes), a AS (SELECT DISTINCT project_dir, session_id FROM placed)
    SELECT project_dir, NULL::VARCHAR AS cwd, count(*) AS session_count, (SELECT count(*) FROM a WHERE a.project_dir = s.project_dir) AS analyzed_count FROM s GROUP BY 1""",
        "placed",
    ),
)
def g15(spark, sf):
    i, e = _both(spark, sf)
    files = e.select("project_dir", "session_id").distinct()
    return listing.session_projects(files, insights.sessions(i, e), files.withColumn("cwd", F.lit(None).cast("string")))


@register("t4_work_items", sql(f"SELECT {ITEM_SQL} FROM placed WHERE project_dir = 'p4' AND session_id = 's4' AND label = '1-URGENT'", "placed"))
def t4(spark, sf):
    return insights.work_items(*_both(spark, sf), "p4", "s4", "1-URGENT").select(*_shown())


@register("t5_derived_of_run", sql("SELECT id, project_dir, session_id, label, insight_type, text, evidence_insight_ids[1] AS first_evidence, created_at FROM derived WHERE project_dir = 'p4' AND session_id = 's4'", "derived"))
def t5(spark, sf):
    found = insights.derived_of_run(b.derived(spark, sf), "p4", "s4")
    return found.withColumn("first_evidence", F.col("evidence_insight_ids")[0]).drop("evidence_insight_ids")


@register("t6_recent_insights", sql("SELECT id, created_at, text FROM insights WHERE created_at >= '2001-06-01T00:00:00.000Z'", "insights"))
def t6(spark, sf):
    return insights.recent_insights(b.insights(spark, sf), "2001-06-01T00:00:00.000Z").select("id", "created_at", "text")


@register("t7_brief_insights", sql(f"SELECT {', '.join('p.' + c for c in ITEM_SQL.split(', '))}, q.date AS recurrence_date FROM placed p LEFT JOIN placed q ON p.recurrence_of = q.id WHERE p.date = '1998-07-15'", "placed"))
def t7(spark, sf):
    return insights.brief_insights(*_both(spark, sf), "1998-07-15").select(*_shown(), "recurrence_date")


@register("g17_by_category", sql("SELECT id, category, significance_score, list_position(['" + "', '".join(b.CATEGORIES) + "'], category)::BIGINT AS category_place FROM placed WHERE date = '1998-07-15'", "placed"))
def g17(spark, sf):
    i, e = _both(spark, sf)
    return insights.by_category(insights.with_episodes(i, e).filter(DAY.condition())).select("id", "category", "significance_score", "category_place")


@register("k5_relabel", sql("SELECT id, CASE WHEN hit THEN 'renamed' ELSE label END AS label, hit AS relabeled FROM (SELECT *, project_dir = 'p4' AND session_id = 's4' AND label = '1-URGENT' AS hit FROM episodes)", "episodes"))
def k5(spark, sf):
    return insights.relabel(b.episodes(spark, sf), "p4", "s4", "1-URGENT", "renamed").select("id", "label", "relabeled")


@register("g19_day_end_lines", sql("SELECT project_dir, session_id, date, max(end_line) AS end_line FROM episodes GROUP BY ALL", "episodes"))
def g19(spark, sf):
    return b.episodes(spark, sf).groupBy("project_dir", "session_id", "date").agg(F.max("end_line").alias("end_line"))


@register("g20_summary", sql("SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT episode_id) AS episodes, count(*) AS insights, count(DISTINCT date) AS dates FROM placed", "placed"))
def g20(spark, sf):
    rows = insights.with_episodes(*_both(spark, sf))
    return rows.agg(F.countDistinct("session_id").alias("sessions"), F.countDistinct("episode_id").alias("episodes"), F.count("*").alias("insights"), F.countDistinct("date").alias("dates"))


def _w1(minutes: int) -> str:
    return sql(
        f""", nb AS (SELECT *, lead(is_compact, 1, false) OVER (PARTITION BY user_id ORDER BY ln) AS nb FROM timed),
    nw AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL {minutes} MINUTE, false) OR coalesce(lag(nb) OVER w, false) AS nw FROM nb WINDOW w AS (PARTITION BY user_id, date ORDER BY ln)),
    ep AS (SELECT *, sum(nw::INT) OVER (PARTITION BY user_id, date ORDER BY ln) AS part FROM nw)
    SELECT user_id, date, part::BIGINT AS part, min(ln)::INT AS start_line, max(ln)::INT AS end_line, count(*) AS n_lines FROM ep GROUP BY ALL""",
        "timed",
    )


def _episodes(spark: SparkSession, sf: str, minutes: int) -> DataFrame:
    lines = sessionize.sessionize(b.timed_lines(spark, sf), minutes, ["user_id"])
    return sessionize.episodes(lines.withColumn("piece", F.lit(0)), ["user_id"]).drop("piece")


@register("w1_episodes", _w1(25))
def w1(spark, sf):
    return _episodes(spark, sf, 25)


@register("w1_episodes_long_gap", _w1(360))
def w1_long(spark, sf):
    return _episodes(spark, sf, 360)


@register("e7_budget_split")
def e7(spark, sf):
    lines = sessionize.sessionize(b.timed_lines(spark, sf), 1440, ["user_id"])
    return sessionize.episodes(sessionize.split_by_budget(lines, 12, ["user_id"]), ["user_id"])


@register(
    "w6_turn_pairs",
    sql(
        """, c AS (SELECT *, coalesce(sum(h::INT) OVER (PARTITION BY conv_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cl, max(a) OVER (PARTITION BY conv_id ORDER BY ln) AS saw FROM lines),
    g AS (SELECT conv_id, cl, min(ln) FILTER (NOT h) AS agent_line_start, coalesce(string_agg(text, chr(10) ORDER BY ln) FILTER (NOT h AND text <> ''), '') AS agent_turn_text, coalesce(bool_or(tool) FILTER (a), false) AS agent_had_tool_access,
      max(ln) FILTER (h) AS human_line_number, max(text) FILTER (h) AS human_turn_text, coalesce(max(saw) FILTER (h), false) AS ok FROM c GROUP BY conv_id, cl)
    SELECT conv_id, agent_line_start, agent_turn_text, agent_had_tool_access, human_line_number, human_turn_text,
      regexp_matches(trim(agent_turn_text), '(?im)\\?\\s*$|^\\s*(?:options?|choices?)\\s*:') AS agent_asked_question
    FROM g WHERE human_line_number IS NOT NULL AND agent_line_start IS NOT NULL AND ok""",
        "lines",
    ),
)
def w6(spark, sf):
    return turns.turn_pairs(b.transcript_lines(spark, sf), ["conv_id"])


@register(
    "x6_acknowledgments",
    "SELECT conv_id, turn, regexp_matches(trim(text), '(?i)^(?:(?:yes|yep|yeah|ok|okay|sure|sounds good|looks good|lgtm|great|thanks|thank you|perfect|continue|go ahead|do it|proceed|approved?|good|nice|cool)[.,!\\s]*)+$') AND len(regexp_split_to_array(trim(text), '\\s+')) < 15 AS is_acknowledgment, contains(text, '```') OR regexp_matches(text, '(?im)^\\s*[$#]?\\s*(?:npm|git|curl|cd|ls|cat|grep|sed|awk|python3?|node|rm|mkdir)\\s') AS directive_hint FROM conversations WHERE text IS NOT NULL",
)
def x6(spark, sf):
    c = b.table(spark, sf, "conversations").filter("text IS NOT NULL")
    return c.select("conv_id", "turn", fn.is_acknowledgment(F.col("text")).alias("is_acknowledgment"), fn.directive_hint(F.col("text")).alias("directive_hint"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


@register("e1_cosine", f"SELECT a.vec_id AS id, b.vec_id AS other, round({_COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def e1(spark, sf):
    v = b.vectors(spark, sf)
    other = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("embedding").alias("w"))
    return v.join(other, "id").select("id", "other", F.round(fn_cosine(F.col("embedding"), F.col("w")), 6).alias("similarity"))


def fn_cosine(a: Column, w: Column) -> Column:
    return similarity.cosine(a, w)


@register(
    "j8_nearest_earlier",
    f"""WITH s AS (SELECT a.vec_id AS new_id, b.vec_id AS past_id, {_COS} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND b.vec_id < a.vec_id)
    SELECT new_id, past_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(sim, 12) DESC, past_id) AS k FROM s WHERE sim >= 0.35) WHERE k = 1""",
)
def j8(spark, sf):
    """The query set (ids divisible by 20) against all rows of lesser ids."""
    v = b.vectors(spark, sf).select("embedding", F.col("id").alias("new_id"), F.col("id").alias("batch"))
    past = v.withColumnRenamed("new_id", "past_id").withColumn("created_at", F.lit("2024"))
    found = similarity.nearest_earlier(v.filter("new_id % 20 = 0"), past, 0.35, "batch")
    return found.withColumn("similarity", F.round("similarity", 6))


@register(
    "j8_nearest_earlier_batches",
    f"""WITH s AS (SELECT a.vec_id AS new_id, b.vec_id AS past_id, {_COS} AS sim FROM embeddings a JOIN embeddings b ON b.vec_id // 256 < a.vec_id // 256)
    SELECT new_id, past_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY round(sim, 12) DESC, past_id) AS k FROM s WHERE sim >= 0.35) WHERE k = 1""",
)
def j8_batches(spark, sf):
    v = b.vectors(spark, sf)
    past = v.select(F.col("id").alias("past_id"), F.lit("2024").alias("created_at"), "batch", "embedding")
    found = similarity.nearest_earlier(v.select(F.col("id").alias("new_id"), "batch", "embedding"), past, 0.35, "batch")
    return found.withColumn("similarity", F.round("similarity", 6))


@register("e3_greedy_dedupe")
def e3(spark, sf):
    return similarity.greedy_dedupe(b.vectors(spark, sf), "batch", 0.35).select("id", "batch", "significance_score", "place")


@register("e4_recurrence")
def e4(spark, sf):
    v = b.vectors(spark, sf)
    past = v.select(F.col("id").alias("past_id"), F.lit("2024").alias("created_at"), "batch", "embedding")
    return similarity.apply_recurrence(v, past, "batch", 0.35, 0.35, earlier_batches=True).select("id", "batch", "place", "recurrence_of")


_WALK = """, walk AS (SELECT id AS start, id AS cur, [id] AS path, false AS looped FROM placed WHERE date >= strftime(DATE '2001-08-01' - INTERVAL 730 DAY, '%Y-%m-%d') AND project_dir = 'p3'
    UNION ALL SELECT w.start, i.recurrence_of, list_append(w.path, i.recurrence_of), list_contains(w.path, i.recurrence_of) FROM walk w JOIN insights i ON i.id = w.cur WHERE i.recurrence_of IS NOT NULL AND NOT w.looped),
    full_ AS (SELECT start, arg_max(cur, len(path)) AS root_id, arg_max(path, len(path)) AS path FROM walk GROUP BY 1 HAVING NOT bool_or(looped)),
    m AS (SELECT DISTINCT root_id, unnest(path) AS id FROM full_), f AS (SELECT root_id, p.id, p.text, p.date, p.created_at FROM m JOIN placed p USING (id)),
    k AS (SELECT root_id, count(*) AS chain_length FROM f GROUP BY 1 HAVING count(*) > 1)"""


@register("e5_chain_members", sql(_WALK + " SELECT f.*, chain_length FROM f JOIN k USING (root_id)", "placed", recursive=True))
def e5_members(spark, sf):
    return recurrence.chain_members(*_both(spark, sf), b.AS_OF, WINDOW, SCOPE)


@register("e5_recurrence_chains", sql(_WALK + " SELECT root_id, count(*) AS chain_length, arg_min(text, {'c': created_at, 'i': id}) AS first_text, arg_min(date, {'c': created_at, 'i': id}) AS first_date, arg_max(date, {'c': created_at, 'i': id}) AS last_date FROM f SEMI JOIN k USING (root_id) GROUP BY 1", "placed", recursive=True))
def e5(spark, sf):
    return recurrence.recurrence_chains(*_both(spark, sf), b.AS_OF, WINDOW, SCOPE)
