"""URL filters: rules of hosts and paths and globs, packed into the masks of one Shift-And automaton that reads every URL once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, prefix
from .words import text_bytes

_ONE = np.uint64(1)
#: Words of state that are held at once; more URLs are taken in several runs.
STATE = 1 << 21


@dataclass(frozen=True)
class HostRule:
    """Fits host and all its subdomains where the path starts with path; of those that fit the longest wins."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> list[str]:
        return [f"{quoted(self.name)}**", f"*.{quoted(self.name)}**"]


@dataclass(frozen=True)
class GlobRule:
    """Fits a canonical URL as a whole: * is any run without / and ?, ** any run, a backslash takes the next character as it is."""

    verdict: str
    glob: str


RULES = (HostRule("block", "net"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"))

#: Read where no rule of hosts fits; the first that fits decides.
GLOBS = tuple(GlobRule("allow", g) for g in ("*.gov/**", "*.edu/**", "*.museum/**")) + tuple(
    GlobRule("block", g)
    for g in (
        "*casino**", "*poker**", "*lottery**", "*bets.**", "*-bets**", "*pills**", "*pharma-**", "*adult**", "*porn**", "*xxx**", "*spam**", "*warez**",
        "ads.**", "*.ads.**", "ads-*.**", "*.ads-*.**", "*doubleclick.**", "**/login**", "**/cart/**", "**/checkout/**", "**/wp-admin/**", "**?*replytocom=**", "**?*sessionid=**",
        "**.zip", "**.exe", "**.apk", "**.iso", "**.mp4",
    )
)


def quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("*", "\\*")


class Automaton:
    """Globs as bits of one state: a bit for each beginning of each glob, the empty one included, in words of 64.

    A byte moves the state one bit on, where it is the next literal (the table of steps), and leaves a bit where it is
    if a wildcard follows there (the table of stays). The last bit of a glob says that it fits. Globs lie side by side;
    what a shift takes from one into the next falls on its first bit, which no byte steps to.
    """

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parsed(g) for g in globs]
        bits = sum(len(literal) + 1 for literal, _ in parsed)
        words = max(1, -(-bits // 64))
        steps, stays = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64)
        self.start, self.ends, at = np.zeros(words, np.uint64), [], 0
        for literal, wild in parsed:
            self.start[at >> 6] |= _ONE << np.uint64(at & 63)
            for k in range(len(literal) + 1):
                w, bit = (at + k) >> 6, _ONE << np.uint64((at + k) & 63)
                if k:
                    steps[literal[k - 1], w] |= bit
                if k in wild:
                    stays[:, w] |= bit
                    if wild[k] == "*":
                        for c in b"/?":
                            stays[c, w] &= ~bit
            at += len(literal) + 1
            self.ends.append(at - 1)
        self.steps, self.stays = steps, stays

    @staticmethod
    def _parsed(glob: str) -> tuple[bytes, dict[int, str]]:
        """The literal bytes, and the wildcard after so many of them."""
        data, literal, wild, i = glob.encode(), bytearray(), {}, 0
        while i < len(data):
            if data[i : i + 1] == b"*":
                run = len(data[i:]) - len(data[i:].lstrip(b"*"))
                wild[len(literal)] = "**" if run > 1 or wild.get(len(literal)) == "**" else "*"
                i += run
                continue
            i += data[i : i + 1] == b"\\" and i + 1 < len(data)
            literal.append(data[i])
            i += 1
        return bytes(literal), wild

    def fits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """For each row of bytes and each glob whether it fits. All rows move on by a byte at a time, the longest first, so those that have ended drop off."""
        size = off[1:] - off[:-1]
        order = np.argsort(-size, kind="stable")
        at, size = off[:-1][order], size[order]
        state = np.repeat(self.start[None], len(size), 0)
        left = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # rows longer than k bytes
        for k, m in enumerate(left.tolist()):
            c, s = data[at[:m] + k], state[:m]
            moved = s << _ONE
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:m] = (moved & self.steps[c]) | (s & self.stays[c])
        ends = np.array(self.ends, np.int64)
        found = np.empty((len(size), len(ends)), bool)
        found[order] = (state[:, ends >> 6] >> (ends & 63).astype(np.uint64)) & _ONE
        return found

    def first(self, texts: pa.Array) -> pa.Array:
        """For each text the number of the first glob that fits, or null."""
        data, off = text_bytes(texts)
        out, run = np.full(len(off) - 1, -1, np.int32), max(1, STATE // (self.start.size + len(self.ends)))
        for i in range(0, len(out), run):
            found = self.fits(data, off[i : i + run + 1])
            if found.size:
                out[i : i + run] = np.where(found.any(1), found.argmax(1), -1)
        return pa.array(out, mask=out < 0)


def host_and_rest(url: Column) -> tuple[Column, Column]:
    """The host of a URL (after the first :// up to / ? # or the end), A-Z lower-cased, and what follows it; both empty for a null or without ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), F.substr(rest, F.length(host) + 1)


def judged(pages: DataFrame, url: str = "url", rules: Sequence[HostRule] = RULES, globs: Sequence[GlobRule] = GLOBS, default: str = "allow", pre: str | None = None) -> DataFrame:
    """pages, and with the prefix pre (or common.prefix(pages) and u_): host, path, rule, pattern, verdict.

    The canonical URL is host, path and query, without scheme and fragment. The rules of hosts are globs, too, the longer
    before the shorter (of equal length the first given), and go before all others, of which the first given that fits
    decides; where none fits the verdict is default. Only the canonical URL goes to Python. A null or empty URL or one
    without :// has an empty host and path and is read as an empty string; repeated rows are judged alike, none depends on
    another; no rules at all give default. A very long URL costs a step a byte and no memory beyond itself.
    """
    pre = pre or prefix(pages) + "u_"
    ordered = sorted(rules, key=lambda r: -len(r.name))
    packed = [(g, r) for r in ordered for g in r.globs()] + [(g.glob, g) for g in globs]
    automaton = Automaton([g for g, _ in packed])

    @F.arrow_udf("int")
    def fitting(urls: pa.Array) -> pa.Array:
        return automaton.first(urls)

    host, rest = host_and_rest(F.col(url))
    query = F.regexp_extract(pre + "rest", r"^[^?#]*(\?[^#]*)?", 1)
    names = F.array(*[F.lit(r.name if isinstance(r, HostRule) else None).cast("string") for _, r in packed], F.lit(None).cast("string"))
    texts = F.array(*[F.lit(r.glob if isinstance(r, GlobRule) else None).cast("string") for _, r in packed], F.lit(None).cast("string"))
    verdicts = F.array(*[F.lit(r.verdict) for _, r in packed], F.lit(default))
    df = pages.withColumns({pre + "host": host, pre + "rest": rest})
    df = df.withColumns({pre + "path": F.regexp_extract(pre + "rest", r"^[^?#]*", 0), pre + "query": query})
    df = df.withColumn(pre + "n", fitting(F.concat(pre + "host", pre + "path", pre + "query")))
    n = F.col(pre + "n")
    return df.select(*pages.columns, pre + "host", pre + "path", F.get(names, n).alias(pre + "rule"), F.get(texts, n).alias(pre + "pattern"), F.coalesce(F.get(verdicts, n), F.lit(default)).alias(pre + "verdict"))


def allowed_pages(pages: DataFrame, url: str = "url", **options) -> DataFrame:
    """The rows of pages whose verdict is allow, with the columns of pages."""
    pre = prefix(pages) + "u_"
    return judged(pages, url, pre=pre, **options).filter(F.col(pre + "verdict") == "allow").select(*pages.columns)


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), pre="__u_")
    return rows.select("page_id", *[F.col("__u_" + c).alias(c) for c in ("host", "path", "rule", "verdict", "pattern")])


OP12_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*(\?[^#]*)', 1) AS query FROM h),
j AS (SELECT page_id, host, path, host || path || query AS u, CASE
    WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
g AS (SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(host, '\.gov$') AND path <> '' THEN '*.gov/**' WHEN regexp_matches(host, '\.edu$') AND path <> '' THEN '*.edu/**' WHEN regexp_matches(host, '\.museum$') AND path <> '' THEN '*.museum/**'
    WHEN contains(host, 'casino') THEN '*casino**' WHEN contains(host, 'poker') THEN '*poker**' WHEN contains(host, 'lottery') THEN '*lottery**' WHEN contains(host, 'bets.') THEN '*bets.**' WHEN contains(host, '-bets') THEN '*-bets**'
    WHEN contains(host, 'pills') THEN '*pills**' WHEN contains(host, 'pharma-') THEN '*pharma-**' WHEN contains(host, 'adult') THEN '*adult**' WHEN contains(host, 'porn') THEN '*porn**' WHEN contains(host, 'xxx') THEN '*xxx**'
    WHEN contains(host, 'spam') THEN '*spam**' WHEN contains(host, 'warez') THEN '*warez**' WHEN starts_with(host, 'ads.') THEN 'ads.**' WHEN contains(host, '.ads.') THEN '*.ads.**' WHEN regexp_matches(host, '^ads-.*\.') THEN 'ads-*.**'
    WHEN regexp_matches(host, '\.ads-.*\.') THEN '*.ads-*.**' WHEN contains(host, 'doubleclick.') THEN '*doubleclick.**' WHEN contains(u, '/login') THEN '**/login**' WHEN contains(u, '/cart/') THEN '**/cart/**'
    WHEN contains(u, '/checkout/') THEN '**/checkout/**' WHEN contains(u, '/wp-admin/') THEN '**/wp-admin/**' WHEN regexp_matches(u, '\?[^/?]*replytocom=') THEN '**?*replytocom=**' WHEN regexp_matches(u, '\?[^/?]*sessionid=') THEN '**?*sessionid=**'
    WHEN suffix(u, '.zip') THEN '**.zip' WHEN suffix(u, '.exe') THEN '**.exe' WHEN suffix(u, '.apk') THEN '**.apk' WHEN suffix(u, '.iso') THEN '**.iso' WHEN suffix(u, '.mp4') THEN '**.mp4' END AS pattern FROM j)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN pattern IS NULL OR pattern IN ('*.gov/**', '*.edu/**', '*.museum/**') THEN 'allow' ELSE 'block' END AS verdict, pattern FROM g"""
