"""Several values packed in one field: dictionary-guided segmentation.

A field such as ``N12-0, "PX 7;b-1" | N3`` holds values under inconsistent
delimiters, partly quoted. Segmentation is a best path over the field:

* a multi-pattern automaton (Aho-Corasick) finds every occurrence of a known
  whole value as it is written; one that stands between boundaries is an edge
  that may run across delimiters and so protects them;
* a closed pair of quotes is one edge, whatever it holds;
* a longest run of value characters is one edge; other characters separate.

Dynamic programming takes the cover with the fewest values and, among those,
the fewest characters lost to separators. Every field goes through it. Where
all known edges equal edges of the grammar (quotes and runs) there is one cover
and nothing to decide; a known form that runs across delimiters competes with
the runs it covers and wins, as it is one value instead of several.

The dictionary decides nothing that the grammar decides: a value it does not
hold is covered by the quote and run edges. It comes from the fields themselves
(``harvest``: values quoted somewhere) or from any table of values. Up to
MOST_CHARACTERS it is broadcast as one automaton; beyond, the fields' spans are
joined with it by shuffle (``known_spans``), which gives the same edges.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslake.operators.versions import distinct_rows, has_conflicts

#: Inside quotes: other characters, a doubled quote, a quote after a backslash, or a lone backslash.
_INNER = {q: rf"(?:[^{q}\\]++|{q}{q}|\\{q}|\\(?!{q}))*+" for q in "\"'"}
_UNIT = re.compile(rf"\"(?P<dq>{_INNER['"']})\"|'(?P<sq>{_INNER["'"]})'|(?P<run>[A-Za-z0-9_-]++)")
_WRAP = re.compile(rf"\"({_INNER['"']})\"")
_VALUE_CHARACTERS = re.compile(r"[A-Za-z0-9_-]")
_DELIMITER = re.compile(r"[^A-Za-z0-9_-]")
_PLAIN_QUOTE = {q: re.compile(rf"[{q}\\]{q}") for q in "\"'"}


def _unwrapped(field: str) -> str:
    """Without the one pair of double quotes that encloses the entire field, if there is one."""
    whole = _WRAP.fullmatch(field.strip())
    return whole.group(1).replace('""', '"') if whole else field


def _glued(text: str, at: int) -> bool:
    """Does the place lie inside a run of value characters?"""
    return bool(0 < at < len(text) and _VALUE_CHARACTERS.match(text[at - 1]) and _VALUE_CHARACTERS.match(text[at]))


def _unit_value(m: re.Match) -> str:
    kind = m.lastgroup
    if kind == "run":
        return m.group("run")
    quote = '"' if kind == "dq" else "'"
    return _PLAIN_QUOTE[quote].sub(quote, m.group(kind)).strip()


class Segmenter:
    """Splits fields into values. ``known`` maps written forms to the values they stand for."""

    def __init__(self, known: Mapping[str, str] | None = None):
        self.automaton = None
        if known:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for written, value in known.items():
                if written:
                    self.automaton.add_word(written, (len(written), value))
            self.automaton.make_automaton()

    def _known_edges(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, value) of the known forms that stand between boundaries."""
        if self.automaton is None or not len(self.automaton):
            return []
        out = []
        for last, (size, value) in self.automaton.iter(text):
            start, end = last + 1 - size, last + 1
            if not _glued(text, start) and not _glued(text, end):
                out.append((start, end, value))
        return out

    def split(self, field: str | None, edges: list[tuple[int, int, str]] | None = None) -> list[str]:
        """Values in order. NULL, blank and delimiter-only fields hold none; empty values don't count.

        ``edges`` are known forms of the unwrapped field found elsewhere, instead of by the automaton.
        """
        if not field:
            return []
        text = _unwrapped(field)
        units = {m.start(): (m.end(), _unit_value(m)) for m in _UNIT.finditer(text)}
        known: dict[int, list[tuple[int, str]]] = {}
        for start, end, value in self._known_edges(text) if edges is None else edges:
            if units.get(start) != (end, value):
                known.setdefault(start, []).append((end, value))
        if not known:  # every known edge is one of the grammar's, whose chain is then the only cover
            return [value for _, value in units.values() if value]
        return self._best_cover(text, known)

    @staticmethod
    def _best_cover(text: str, known: dict[int, list[tuple[int, str]]]) -> list[str]:
        """Forward dynamic programming over the reachable boundaries of ``text``.

        A boundary is reached only along legal edges, so a known form that
        begins inside a quotation or a run is never entered.
        """
        size = len(text)
        starts = sorted(known)
        # boundary -> (values so far, characters lost, previous boundary, value of the edge)
        reached: dict[int, tuple[int, int, int, str]] = {0: (0, 0, -1, "")}
        open_boundaries = [0]
        while open_boundaries:
            at = heapq.heappop(open_boundaries)
            if at == size:
                break
            cost, lost, *_ = reached[at]
            unit = _UNIT.match(text, at)
            # A known form in quotes is whole only if its last quote closes here.
            edges = [e for e in known.get(at, ()) if text[at] not in "\"'" or (unit and unit.end() == e[0])]
            if unit:
                edges.append((unit.end(), _unit_value(unit)))
            else:  # separators up to the next unit or known form
                ahead = _UNIT.search(text, at + 1)
                next_known = bisect_right(starts, at)
                end = min(ahead.start() if ahead else size, starts[next_known] if next_known < len(starts) else size)
                edges.append((end, ""))
            for end, value in edges:
                new = (cost + bool(value), lost + (0 if value else end - at), at, value)
                old = reached.get(end)
                if old is None:
                    heapq.heappush(open_boundaries, end)
                if old is None or new[:2] < old[:2]:
                    reached[end] = new
        out, at = [], size
        while at > 0:
            *_, previous, value = reached[at]
            if value:
                out.append(value)
            at = previous
        return out[::-1]


#: Characters of all known forms that are broadcast as one automaton at most.
MOST_CHARACTERS = 16_000_000


def harvest(df: DataFrame, fields: list[str], bare: bool = False) -> DataFrame:
    """(written, value): the values with delimiters inside that are quoted in any row of the fields.

    ``written`` keeps the quotes, or with ``bare`` leaves them off, so that the
    value is known wherever it stands without quotes.
    """

    @F.pandas_udf("array<struct<written:string,value:string>>")
    def quoted(column: pd.Series) -> pd.Series:
        def one(field: str | None) -> list[tuple[str, str]]:
            units = [m for m in _UNIT.finditer(_unwrapped(field)) if m.lastgroup != "run"] if field else []
            found = [(m.group(), _unit_value(m)) for m in units]
            return [(v if bare else w, v) for w, v in found if _DELIMITER.search(v)]

        return column.map(one)

    texts = df.select(F.explode(F.array(*fields)).alias("t")).filter(F.col("t").contains('"') | F.col("t").contains("'"))
    return texts.select(F.explode(quoted("t")).alias("q")).select("q.*").distinct()


def known_spans(long: DataFrame, known: DataFrame) -> DataFrame:
    """``long`` (_id, text) with ``_edges``: the known forms in the unwrapped text, found by a join on the spans between boundaries.

    Spans are as long as the longest known form at most, and only those that begin
    with the first two characters of one are made, so that a field gives few.
    """
    longest = known.agg(F.max(F.length("written"))).first()[0] or 0
    heads = frozenset(r.h for r in known.select(F.substring("written", 1, 2).alias("h")).distinct().limit(70_000).collect())  # two characters: bounded by the alphabet

    @F.pandas_udf("array<struct<start:int,end:int,written:string>>")
    def spans(column: pd.Series) -> pd.Series:
        def one(field: str) -> list[tuple[int, int, str]]:
            text = _unwrapped(field)
            free = [i for i in range(len(text) + 1) if not _glued(text, i)]
            out = []
            for k, i in enumerate(free):
                if len(heads) >= 70_000 or text[i : i + 2] in heads or text[i : i + 1] in heads:
                    for j in free[k + 1 :]:
                        if j - i > longest:
                            break
                        out.append((i, j, text[i:j]))
            return out

        return column.map(one)

    made = long.select("_id", F.explode(spans("text")).alias("s")).select("_id", "s.*")
    hits = made.join(known, "written").groupBy("_id").agg(F.collect_list(F.struct("start", "end", "value")).alias("_edges"))
    return long.join(hits, "_id", "left")


def split_packed(df: DataFrame, key: str, fields: list[str], known: DataFrame | Mapping[str, str] | None = None, most_characters: int = MOST_CHARACTERS) -> DataFrame:
    """One row per packed value: (key, packed_field, item_position, item_value).

    ``known`` holds (written, value) of the dictionary. Positions count from 0
    within the field. NULL and blank fields give no row; a NULL key stays NULL;
    repeated rows count once, and where one key comes with different contents
    the rows of all of them are united. Other columns of ``df`` are ignored,
    whatever they are called. Fields of any length are read whole.
    """
    rows = distinct_rows(df, [key, *fields])
    long = rows.select(
        F.col(key).alias("_key"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in fields])).alias("_f"),
    ).filter("_f.text IS NOT NULL")
    if isinstance(known, DataFrame):
        forms = known.filter("written <> ''").select("written", "value").distinct()
        size = forms.agg(F.sum(F.length("written") + F.length("value"))).first()[0] or 0
    else:
        forms, size = None, 0
    if size <= most_characters:
        table = {r.written: r.value for r in forms.collect()} if forms is not None else dict(known or {})
        held = df.sparkSession.sparkContext.broadcast(table)

        @F.pandas_udf("array<string>")
        def segments(column: pd.Series) -> pd.Series:
            return column.map(_segmenter(held).split)

        split = long.select("_key", "_f.field", segments("_f.text").alias("_values"))
    else:
        numbered = long.select("_key", "_f.field", F.col("_f.text").alias("text")).withColumn("_id", F.xxhash64("_key", "field", "text"))
        numbered = numbered.withColumn("_id", F.struct("_id", F.hash("text"), F.length("text"), "_key", "field"))

        @F.pandas_udf("array<string>")
        def covered(column: pd.Series, edges: pd.Series) -> pd.Series:
            segmenter = Segmenter()
            return pd.Series([segmenter.split(t, [] if e is None else [(x["start"], x["end"], x["value"]) for x in e]) for t, e in zip(column, edges)], dtype=object)

        split = known_spans(numbered, forms).select("_key", "field", covered("text", "_edges").alias("_values"))
    out = split.select(F.col("_key").alias(key), F.col("field").alias("packed_field"), F.posexplode("_values").alias("item_position", "item_value"))
    out = out.withColumn("item_position", F.col("item_position").cast("bigint"))
    return out.distinct() if has_conflicts(df, [key], fields) else out


_SEGMENTERS: dict[int, Segmenter] = {}


def _segmenter(held) -> Segmenter:
    """One automaton per broadcast dictionary and worker."""
    if held._path not in _SEGMENTERS:
        _SEGMENTERS.clear()
        _SEGMENTERS[held._path] = Segmenter(held.value)
    return _SEGMENTERS[held._path]
