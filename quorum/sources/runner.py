"""Runs the sources that are due: of each the landed days that its cursor asks for, all events in one append, all tables by upsert.

Files are landed under {root}/{folder}/day=yyyy-MM-dd/. A run lists the days' names, decides which it takes, and gives
the readers just these folders, so files of other days aren't even listed. The state, (source, cursor, run_on), is published
after what was read is stored; a run that dies in between is repeated, and as appends and upserts may be repeated it adds
nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import civic
from ..operators import eventlog as log
from ..schemas import KEYS, TABLES
from ..streaming.cursors import HORIZON_DAYS
from . import ratings, readers

Paths = list[str]
Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Source:
    """How a kind of landed files is read, and when.

    read gives events, or rows of the table that is named. It is due after cadence_days, and if the tables that it needs
    are there. overlap_days behind the cursor are read again, as facts may be late; with a horizon the cursor doesn't pass a
    day that is missing and younger than that.
    """

    name: str
    read: Callable[[SparkSession, Paths, Tables], DataFrame]
    folder: str = ""
    table: str | None = None
    needs: tuple[str, ...] = ()
    cadence_days: int = 1
    overlap_days: int = 0
    horizon_days: int | None = None

    @property
    def at(self) -> str:
        return self.folder or self.name


def lis_index(legislators: DataFrame) -> DataFrame:
    return legislators.select(F.get_json_object("ids", "$.lis").alias("lis"), F.col("bioguide_id").alias("bioguide"), "last_name", "state")


def _new_texts(spark: SparkSession, paths: Paths, tables: Tables) -> DataFrame:
    held = tables.get("bill_text", spark.createDataFrame([], "bill_id string, version_code string"))
    none = spark.createDataFrame([], "slot string, last_modified timestamp")
    bodies = paths[0].rsplit("/", 1)[0] + "/bodies"
    return readers.listed_texts(readers.text_listing(spark, paths), bodies, held, none)[0]


SOURCES = {s.name: s for s in (
    Source("congress_rollcalls", lambda s, p, t: readers.house_votes(s, p)),
    Source("senate_rollcalls", lambda s, p, t: readers.senate_votes(s, p, lis_index(t["legislators"])), needs=("legislators",)),
    Source("govinfo_billstatus", lambda s, p, t: readers.bill_status(s, p)[1]),
    Source("govinfo_billstatus.bills", lambda s, p, t: readers.bill_status(s, p)[0], folder="govinfo_billstatus", table="bills"),
    Source("congress_bills", lambda s, p, t: readers.bill_parts(s, p), overlap_days=4),
    Source("congress_bill_actions", lambda s, p, t: readers.bill_parts(s, p), needs=("bills",)),
    Source("congress_amendments", lambda s, p, t: readers.amendments(s, p), overlap_days=4),
    Source("congress_committee_meetings", lambda s, p, t: readers.committee_meetings(s, p)),
    Source("congress_bill_summaries", lambda s, p, t: readers.bill_summaries(s, p), table="bill_summaries", overlap_days=4),
    Source("govinfo_crec", lambda s, p, t: readers.floor_speeches(s, p), horizon_days=HORIZON_DAYS),
    Source("govinfo_bill_text", _new_texts, table="bill_text"),
    Source("lda_senate", lambda s, p, t: readers.lobbying_filings(s, p)[1]),
    Source("lda_senate.filings", lambda s, p, t: readers.lobbying_filings(s, p)[0], folder="lda_senate", table="lda_filings"),
    Source("legislators", lambda s, p, t: readers.legislators(s, p), table="legislators"),
    Source("committees", lambda s, p, t: readers.committees(s, p), table="committees"),
    Source("committee_assignments", lambda s, p, t: readers.committee_members(s, p), table="committee_assignments"),
    Source("legislator_social", lambda s, p, t: readers.social_handles(s, p), table="legislator_social"),
    Source("funding_totals", lambda s, p, t: readers.funding_totals(s, p, t["fec_id_resolutions"]), table="funding_totals", needs=("fec_id_resolutions",)),
    Source("district_pvi", lambda s, p, t: ratings.district_ratings(s, p, civic.CONGRESS), table="district_pvi"),
)}


@dataclass(frozen=True)
class Run:
    """What a run takes of a source: these days' folders; then its cursor is at cursor. why says what keeps it from running."""

    source: Source
    paths: tuple[str, ...]
    cursor: date | None
    why: str = ""


def landed_days(spark: SparkSession, folder: str) -> list[date]:
    """The days that have a folder, by their names alone."""
    fs, at = log._files(spark, folder)
    if not fs.exists(at(folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at(folder))]
    return sorted(date.fromisoformat(n[4:]) for n in names if n.startswith("day="))


def planned(source: Source, days: list[date], state: tuple[date | None, date | None], tables: set[str], today: date, root: str) -> Run:
    """One source's run from the days landed and its state (cursor, day of its last run)."""
    cursor, run_on = state
    missing = [t for t in source.needs if t not in tables]
    if missing:
        return Run(source, (), cursor, "needs " + ", ".join(missing))
    if run_on is not None and (today - run_on).days < source.cadence_days:
        return Run(source, (), cursor, "not due")
    days = [d for d in days if d <= today]
    upto = max([*days, *([cursor] if cursor else [])], default=None)
    if source.horizon_days is not None and (cursor or days):
        last = cursor or days[0] - timedelta(days=1)
        young = max(last, today - timedelta(days=source.horizon_days))
        gap = next((d for d in (young + timedelta(days=k + 1) for k in range((today - young).days)) if d not in set(days)), None)
        upto = max(last, gap - timedelta(days=1)) if gap else today
    take = [d for d in days if upto and d <= upto and (cursor is None or d > cursor - timedelta(days=source.overlap_days))]
    return Run(source, tuple(f"{root}/{source.at}/day={d}" for d in take), upto)


def run(spark: SparkSession, root: str, store: str, today: date, sources: dict[str, Source] = SOURCES) -> dict[str, str]:
    """Runs what is due under store (events, tables, state); for each source what came of it, and under "events" how many were new."""
    fs, at = log._files(spark, store)
    there = lambda path: fs.exists(at(f"{path}/CURRENT"))
    state = {r.source: (r.cursor, r.run_on) for r in log.current(spark, f"{store}/state").collect()} if there(f"{store}/state") else {}  # a row for each source
    tables = {t: log.current(spark, f"{store}/{t}") for t in TABLES if there(f"{store}/{t}")}
    runs = [planned(s, landed_days(spark, f"{root}/{s.at}"), state.get(s.name, (None, None)), set(tables), today, root) for s in sources.values()]
    out, events = {}, []
    for r in runs:
        out[r.source.name] = r.why or f"{len(r.paths)} days"
        if not r.paths:
            continue
        rows = r.source.read(spark, list(r.paths), tables)
        if r.source.table is None:
            events.append(rows)
            continue
        name = f"{store}/{r.source.table}"
        held = log.current(spark, name) if there(name) else spark.createDataFrame([], rows.schema)
        log.publish(log.upserted(held, rows, KEYS[r.source.table], []), name)
    out["events"] = str(log.append_events(reduce(DataFrame.unionByName, events), f"{store}/log")) if events else "0"
    done = {r.source.name: (r.cursor, today) for r in runs if not r.why}
    rows = [(name, *v) for name, v in (state | done).items()]
    log.publish(spark.createDataFrame(rows, "source string, cursor date, run_on date"), f"{store}/state")
    return out
