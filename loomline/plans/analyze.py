"""The write path: new lines to episodes, insights and turns, in one commit; what fails is narrowed down to its sessions and days."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.formatting import run_label
from loomline.operators import models, sessionize, similarity, turns
from loomline.operators.asking import Asking
from loomline.operators.grams import postings
from loomline.operators.insights import recent_embeddings
from loomline.operators.scope import day_cutoff
from loomline.sources.config import Config
from loomline.sources.scratch import written
from loomline.sources.store import Store, pack_vector, with_ids
from loomline.sources.transcripts import cursors, scan_new_lines, unknown_types

SESSION = ["project_dir", "session_id"]
KEYS = [*SESSION, "date", "part", "piece"]


@dataclass
class Models:
    """The models of a run; without an embedder nothing is linked to earlier insights, without a deriver none are derived."""

    extractor: models.Model
    scorer: models.Model
    classifier: models.Model
    embedder: Callable | None = None
    deriver: models.Model | None = None


@dataclass
class Summary:
    """`sessions` were analyzed to their end, `failed` were not."""

    sessions: int
    episodes: int
    insights: int
    dates: list[str]
    label: str
    failed: int = 0


def analyze(store: Store, root: str, now: datetime, config: Config = Config(), use: Models | None = None, label: str | None = None, force: bool = False, project: str | None = None, session: str | None = None, dry_run: bool = False, spot_checks: str | None = None) -> Summary:
    """Analyzes what is new under root and commits it.

    Episodes, insights, vectors, turns and cursors become visible together or not
    at all. Usually one commit holds the whole run. If it fails, the sessions are
    halved by a hash until what fails is one session; all others are committed. That
    session is then tried day by day, in order, and stops at the day that fails. Its
    cursor tells exactly which lines are done, so the next run reads those of that day
    and of later ones, changed or not, and no line twice. A dry run stops before the
    models. Rows whose episode is unknown cannot arise: all hang on episodes of the
    same run. With `spot_checks`, a folder, a sample of the turns is added to the texts
    there. Lines of an unknown type are warned of.
    """
    if use is None and not dry_run:
        raise ValueError("an analysis needs models")
    label = label or run_label(now)
    stamp = now.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    scan = scan_new_lines(store.spark, root, store.read("sessions"), stamp, force, project, session)
    for row in unknown_types(scan.lines).groupBy("type").agg(F.sum("n_lines").alias("n")).orderBy("type").limit(20).collect():
        logging.warning("%s lines of the unknown type %s were passed over", row["n"], row["type"])
    pieces, found = sessionize.chunk(sessionize.prepare_lines(scan.new, config.timezone), config.idle_gap_minutes)
    last = store.read("episodes").agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first()["m"]
    found = written(with_ids(found, last, *KEYS).withColumn("label", F.lit(label)))
    dates = [r["date"] for r in found.select("date").distinct().orderBy("date").collect()]
    n_sessions, n_episodes = scan.seen.count(), found.count()
    if dry_run:
        return Summary(n_sessions, n_episodes, 0, dates, label)
    lines = written(turns.classify_lines(pieces).drop("raw").join(found.select(F.col("id").alias("episode_id"), *KEYS), KEYS))
    marks = sessionize.prepare_lines(scan.lines.join(scan.seen.select(*SESSION), SESSION, "left_semi"), config.timezone)
    # a line that ends with the file and can't be read may have been cut off: it is read again
    cut_off = ~F.col("closed") & (F.col("status") == "malformed")
    waits = (F.col("status") == "kept") & ~F.col("done") & F.col("date").isNotNull()
    marks = written(marks.select(*SESSION, "line_number", "at", "next_at", "closed", "done", cut_off.alias("cut_off"), F.when(waits, F.col("date")).alias("day")))
    run = _Run(store, use, config, now, stamp, label, spot_checks, found, lines, marks)
    run.settle(written(scan.seen.select(*SESSION)))
    return Summary(n_sessions - run.failed, n_episodes, run.insights, dates, label, run.failed)


class _Run:
    """A run past its scan: commits sessions, all of them or those that can be."""

    def __init__(self, store: Store, use: Models, config: Config, now: datetime, stamp: str, label: str, spot_checks: str | None, found: DataFrame, lines: DataFrame, marks: DataFrame) -> None:
        self.store, self.use, self.config, self.now, self.stamp, self.label, self.spot_checks = store, use, config, now, stamp, label, spot_checks
        self.found, self.lines, self.marks = found, lines, marks
        self.insights = self.failed = 0

    def settle(self, sessions: DataFrame, bit: int = 0) -> None:
        """Commits these sessions, or halves of them down to the ones that fail."""
        try:
            self._commit(sessions, None)
        except Exception:  # noqa: BLE001  the failure is narrowed down
            n = sessions.count()
            logging.exception("%s sessions failed together", n)
            if n > 1:
                side = F.shiftright(F.xxhash64(*SESSION), bit).bitwiseAND(F.lit(1)) == 1
                for half in (written(sessions.filter(side)), written(sessions.filter(~side))):
                    if not half.isEmpty():
                        self.settle(half, bit + 1)
            elif n:
                self._by_days(sessions)

    def _by_days(self, session: DataFrame) -> None:
        """One session's days in order, each in a commit of its own, up to the one that fails."""
        days = [r["date"] for r in self.found.join(session, SESSION, "left_semi").select("date").distinct().orderBy("date").collect()]
        for k, day in enumerate(days):
            try:
                self._commit(session, days[: k + 1])
            except Exception:  # noqa: BLE001  the session stops here
                logging.exception("%s failed", day)
                self.failed += 1
                return

    def _commit(self, sessions: DataFrame, days: list[str] | None) -> None:
        """K3: one commit of these sessions' episodes and of what comes of their lines; with `days`, of the last of these days, the others being done."""
        store, some = self.store, self.found.join(sessions, SESSION, "left_semi")
        some = written(some if days is None else some.filter(F.col("date") == days[-1]))
        lines = self.lines.join(some.select(F.col("id").alias("episode_id")), "episode_id", "left_semi")
        waiting = F.lit(False) if days is None else F.coalesce(~F.col("day").isin(days), F.lit(False))
        marks = self.marks.join(sessions, SESSION, "left_semi").withColumn("done", ~F.col("cut_off") & ~waiting)
        whole = days is None or self.marks.join(sessions, SESSION, "left_semi").filter(waiting).isEmpty()
        stands = written(cursors(marks, self.stamp if whole else None))
        insights, vectors = _insights(store, lines, some.select(F.col("id").alias("episode_id"), *KEYS), self.use, self.config, self.now, self.stamp)
        pairs = turns.turn_pairs(lines, ["episode_id"])
        engaged = written(store.next_ids("engagement_turns", models.classify_turns(pairs, self.use.classifier, _asking(store, self.config, self.config.engagement_calls)).withColumn("created_at", F.lit(self.stamp)), "episode_id", "human_line_number"))
        n = insights.count()
        # the first commit that indexes texts indexes those before it as well
        texts = insights.select("id", "text") if store.has("insight_grams") else store.read("insights").select("id", "text").unionByName(insights.select("id", "text"))
        grams = postings(texts.withColumnRenamed("id", "insight_id"), "insight_id")
        store.commit({}, {"sessions": stands, "insight_grams": grams, "episodes": some, "insights": insights, "insight_embeddings": vectors, "engagement_turns": engaged})
        self.insights += n
        try:
            if self.spot_checks:
                turns.append_spot_checks(turns.spot_check_sample(pairs, engaged), self.spot_checks, self.label, self.stamp)
        except Exception:  # noqa: BLE001  what is committed stays, also without its sample
            logging.exception("no sample was written to %s", self.spot_checks)


def _insights(store: Store, lines: DataFrame, ids: DataFrame, use: Models, config: Config, now: datetime, stamp: str) -> tuple[DataFrame, DataFrame]:
    """(insights, vectors) of a run's lines, with ids."""
    keyed = lines.withColumn("episode_key", F.col("episode_id").cast("string"))
    candidates = models.generate_candidates(keyed, use.extractor, _asking(store, config, config.extract_calls))
    days = ids.select(F.col("episode_id").cast("string").alias("episode_key"), "episode_id", F.concat_ws("/", "project_dir", "session_id", "date").alias("batch_day"))
    scored = models.score_candidates(models.scoring_batches(candidates.join(days, "episode_key")), use.scorer, _asking(store, config, config.score_calls)).drop("recurrence_of")
    if use.embedder is not None:
        scored = similarity.embed(scored, use.embedder, how=_asking(store, config, config.embedding_calls))
    else:
        scored = scored.withColumn("embedding", F.lit(None).cast("array<double>"))
    placed = written(store.next_ids("insights", scored, "episode_id", "pos").withColumn("pos", F.col("id")))
    recent = recent_embeddings(store.read("insight_embeddings"), store.read("insights"), day_cutoff(now, config.history_days))
    past = recent.select(F.col("insight_id").alias("past_id"), F.col("insight_created_at").alias("created_at"), "embedding")
    linked = similarity.apply_recurrence(placed, past, "batch_day", config.dedupe_threshold, config.recurrence_threshold, use.embedder is not None)
    linked = written(linked.withColumn("created_at", F.lit(stamp)).withColumn("verified_by_git", F.lit(None).cast("boolean")))
    vectors = linked.filter("embedding IS NOT NULL").select(F.col("id").alias("insight_id"), pack_vector("embedding").alias("embedding"), F.lit("injected").alias("model"), "created_at")
    return linked, vectors


def _asking(store: Store, config: Config, calls: int) -> Asking:
    """Answers are remembered in the store, by themselves: they stay when the commit that they are for fails."""
    return Asking(calls, config.model_version, lambda: store.read("answers"), lambda found: store.commit({}, {"answers": found}))


def derive_run(store: Store, project_dir: str, session_id: str, label: str, model: models.Model, now: datetime) -> int:
    """M6, K4: derives insights of one run and appends them; how many."""
    from loomline.operators.insights import work_items

    items = work_items(store.read("insights"), store.read("episodes"), project_dir, session_id, label)
    stamp = now.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    found = models.derive_insights(items, model).withColumns({"project_dir": F.lit(project_dir), "session_id": F.lit(session_id), "created_at": F.lit(stamp)})
    found = written(found)
    n = found.count()
    if n:
        store.append_derived(found)
    return n


def run_job(store: Store, job_id: str, kind: str, work: Callable[[], str], now: Callable[[], datetime]) -> str:
    """K6, K7: runs work as a job row goes queued, running, done or failed; finished jobs older than a day are dropped."""
    at = lambda: now().strftime("%Y-%m-%dT%H:%M:%S.000Z")
    base = {"id": job_id, "kind": kind, "created_at": at()}
    store.evict_jobs((now() - timedelta(hours=24)).strftime("%Y-%m-%dT%H:%M:%S.000Z"))
    for status in ("queued", "running"):
        store.put_job({**base, "status": status, "updated_at": at()})
    try:
        result = work()
    except Exception as e:  # noqa: BLE001  the job row tells
        store.put_job({**base, "status": "failed", "error": str(e), "updated_at": at()})
        return "failed"
    store.put_job({**base, "status": "done", "result": result, "updated_at": at()})
    return "done"
