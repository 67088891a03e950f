"""Cleaning HTML, cutting texts into sections, packing sections, comparing versions."""

from __future__ import annotations

import difflib
import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from ..operators import results

# Elements whose content is no text, those that begin a line, entities by name, and lines that are page furniture.
SILENT = ("script", "style", "head", "title")
BLOCKS = ("p", "div", "br", "li", "ul", "ol", "tr", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "section")
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "sect": "§", "para": "¶", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•", "amp": "&"}
FURNITURE = (r"\d+", r"(?i)page\s+\d+", r"(?i)\[?\s*congressional bills.*", r"(?i)\[?h(r|j|con|res)\s+\d+.*")
SPACES = r"[ \t\r\f\x0B\x{a0}]+"

#: What is replaced, in this order, and by what: comments, silent elements to their end or the text's, blocks, all other tags.
MARKUP = (
    (r"(?s)<!--.*?(?:-->|\z)", ""),
    *[(rf"(?is)<{x}\b[^>]*>.*?(?:</{x}\s*>|\z)", "") for x in SILENT],
    (rf"(?i)</?(?:{'|'.join(BLOCKS)})\b[^>]*>", "\n"),
    (r"<[A-Za-z/!?][^>]*>", ""),
)

_DIFF = StructType().add("html", StringType()).add("added", IntegerType()).add("removed", IntegerType()).add("unchanged", IntegerType())


def unescaped(text: Column) -> Column:
    """The text with its entities, numeric ones and those of ENTITIES, as characters."""

    def number(x, i):
        code = F.regexp_extract(x, r"^([0-9]{1,6}|[xX][0-9A-Fa-f]{1,6});", 1)
        hexed = F.when(F.lower(code).startswith("x"), F.substring(code, 2, 9)).otherwise(F.conv(code, 10, 16))
        char = F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
        return F.when(i == 0, x).when(code != "", F.concat(char, F.regexp_replace(x, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), x))

    bound = lambda t: F.when(t.contains("&#"), F.array_join(F.transform(F.split(t, "&#"), number), "")).otherwise(t)
    out = F.get(F.transform(F.array(text), bound), F.lit(0))  # bound by a lambda, so what makes the text runs once
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def text_lines(raw: Column, furniture: bool = False) -> Column:
    """The lines of an HTML page: blanks collapsed, one empty line at most between others, none at the ends; with furniture, without the lines of a printed page."""
    text = F.coalesce(raw, F.lit(""))
    for pattern, by in MARKUP:
        text = F.regexp_replace(text, pattern, by)
    lines = F.transform(F.split(unescaped(text), "\n"), lambda x: F.btrim(F.regexp_replace(x, SPACES, " ")))
    if furniture:
        lines = F.filter(lines, lambda x: ~x.rlike("^(?:" + "|".join(FURNITURE) + ")$"))
    # runs of empty lines are shortened in the joined text: a lambda that looks at the line before would make all lines anew for each
    return F.btrim(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), F.lit("\n"))


def unified(a: str | None, b: str | None, context: int = 3) -> dict:
    """A unified difference of two texts as HTML lines, and how many lines were added, removed and shown unchanged."""
    old, new = (a or "").split("\n"), (b or "").split("\n")
    counts, out = {"+": 0, "-": 0, " ": 0}, []
    for line in list(difflib.unified_diff(old, new, n=context, lineterm=""))[2:]:
        kind = {"+": "add", "-": "del", " ": "same"}.get(line[:1], "hunk")
        if kind != "hunk":
            counts[line[0]] += 1
        out.append(f'<span class="{kind}">{html.escape(line)}</span>')
    return {"html": "\n".join(out) or '<span class="none">no difference</span>', "added": counts["+"], "removed": counts["-"], "unchanged": counts[" "]}


@F.pandas_udf(_DIFF)
def diff(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([unified(x, y) for x, y in zip(a, b, strict=True)], columns=["html", "added", "removed", "unchanged"])


def sections(text: Column, heading: str) -> Column:
    """The parts of a text that begin with lines that match heading; a text with fewer than two headings is one part."""
    marked = F.split(F.regexp_replace(text, f"(?m)^(?={heading})", "\x00"), "\x00")
    parts = F.filter(marked, lambda x: F.trim(x) != "")
    return F.when(F.regexp_count(text, F.lit(f"(?m)^{heading}")) >= 2, parts).otherwise(F.array(text))


def packed_in_order(sizes: Column, budget: int) -> Column:
    """The number, from 0, of the chunk of each size, filled in order: a size that no longer fits begins the next."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("chunk"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        fits = (s["used"] + x <= budget) | (s["used"] == 0)
        chunk = F.when(fits, s["chunk"]).otherwise(s["chunk"] + 1)
        return F.struct((F.when(fits, s["used"]).otherwise(F.lit(0).cast("long")) + x).alias("used"), chunk.alias("chunk"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(sizes, start, step)["out"]


def last_two(docs: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, from, to, old, new): the places and texts of each key's last version and of the one before it; its only one has nothing before it."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), F.desc(text)))  # each task keeps two rows a key before any are dealt
    last = docs.select(key, order, text, place.alias("__place")).filter("__place <= 2")
    version = lambda k: F.max(F.when(F.col("__place") == k, F.struct(order, text)))
    last = last.groupBy(key).agg(version(1).alias("to"), version(2).alias("before"))
    return last.select(key, F.col("before")[order].alias("from"), F.col("to")[order].alias("to"), F.col("before")[text].alias("old"), F.col("to")[text].alias("new"))


def version_changes(docs: DataFrame, key: str, order: str, text: str, store: str | None = None, now: Column | None = None) -> DataFrame:
    """(key, from, to, html, added, removed, unchanged): each key's last version against the one before it; its only one against nothing.

    With a store (a path) a pair of texts is compared once, whatever keys and versions have it, and its result kept by both digests.
    """
    pairs = last_two(docs, key, order, text)
    if store is None:
        return pairs.select(key, "from", "to", diff(F.col("old"), F.col("new")).alias("d")).select(key, "from", "to", "d.*")
    digests = ["from_digest", "to_digest"]
    asked = pairs.withColumns({d: F.sha2(F.coalesce(c, F.lit("")), 256) for d, c in zip(digests, ("old", "new"), strict=True)})
    compared = lambda rows: rows.select(*digests, diff(F.col("old"), F.col("new")).alias("d")).select(*digests, "d.*")
    found = results.computed(asked, digests, store, compared, F.current_timestamp() if now is None else now)
    return found.select(key, "from", "to", "html", "added", "removed", "unchanged")
