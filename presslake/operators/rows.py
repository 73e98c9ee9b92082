r"""Rows that fail to parse, split from the valid ones with a reason.

For each schema an anchored regular expression for the whole line is
generated from its field patterns. Lines it matches (and whose dates exist) are
valid. Only the others pass through incremental prefix patterns, generated from
the same field patterns: first those of the fields' structure, then those of
their values. Prefix k demands one field more than prefix k - 1, so the first
that fails names the first broken field, and that field the reason.

All patterns are linear: alternatives exclude each other by their first
character, and every repetition is possessive, so lines of any length and with
any number of quotes are read without backtracking or deep recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as text libraries split on it (fixed values).
WHITE = r"\t\n\u000B\u000C\r\u001C-\u001F \u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BLANK = WHITE.removeprefix(r"\t")
QUOTED = r'"(?:[^"]++|"")*+"(?=\t|\z)'
PLAIN = r'(?!")[^\t]*+'
FIELD = f"(?:{QUOTED}|{PLAIN})"
STRUCTURE = rf"^{FIELD}(?:\t{FIELD})*+\z"
#: Value patterns, for a trimmed value.
NEWS_ID = r"N[0-9]++"
NOT_EMPTY = r"(?s).++"
TOKENS = rf"[{WHITE}]*+(?:N[0-9]++(?:-[01])?+(?:[{WHITE}]++|\z))*+"
BLANK_TOKENS = rf"[{BLANK}]*+(?:N[0-9]++(?:-[01])?+(?:[{BLANK}]++|(?=\t|\z)))*+"
QUOTED_TOKENS = rf"[{WHITE}]*+(?:N[0-9]++(?:-[01])?+(?:[{WHITE}]++|(?=\")))*+"
US_TIME = r"([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}) ([0-9]{1,2}):([0-9]{2}):([0-9]{2}) ([AaPp])[Mm]"
ISO_TIME = r"([0-9]{4})-([0-9]{2})-([0-9]{2})[ T]([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.([0-9]+))?(Z|[+-][0-9]{2}:?[0-9]{2})?"


@dataclass(frozen=True)
class Feed:
    """The columns of a tab-separated feed and the patterns of those that are checked."""

    name: str
    columns: tuple[str, ...]
    ids: dict[str, str]
    timestamp: str | None = None
    tokens: str | None = None

    def field_pattern(self, column: str) -> str:
        """The pattern of a valid field as it is written, up to the tab or the end of the line; a date need not exist."""
        if column == self.tokens:
            plain, quoted = BLANK_TOKENS, QUOTED_TOKENS
        elif self.ids.get(column) == NEWS_ID:
            plain, quoted = rf"[{BLANK}]*+{NEWS_ID}[{BLANK}]*+", rf"[{WHITE}]*+{NEWS_ID}[{WHITE}]*+"
        elif column in self.ids:
            plain, quoted = rf"[{BLANK}]*+[^{WHITE}][^\t]*+", rf'[{WHITE}]*+(?:[^{WHITE}"]|"")(?:[^"]++|"")*+'
        else:
            return rf"{FIELD}(?=\t|\z)"
        return rf'(?:"{quoted}"(?=\t|\z)|(?!"){plain}(?=\t|\z))'

    def whole_row(self) -> str:
        """The anchored pattern of a valid line, but for the existence of its date."""
        return "^" + r"\t".join(self.field_pattern(c) for c in self.columns) + r"\z"

    def value_prefixes(self) -> list[str]:
        """Prefix k: the first k fields are valid."""
        parts = [self.field_pattern(c) for c in self.columns]
        return ["^" + r"\t".join(parts[: k + 1]) for k in range(len(parts))]

    def structure_prefixes(self) -> list[str]:
        """Prefix k: the first k fields are there, and if quoted, closed before a tab or the end."""
        return [rf"^{FIELD}(?=\t|\z)(?:\t{FIELD}(?=\t|\z)){{{k}}}" for k in range(len(self.columns))]


NEWS = Feed(
    "news",
    ("news_id", "category", "subcategory", "title", "abstract", "url", "title_entities", "abstract_entities"),
    {"news_id": NEWS_ID},
)
BEHAVIORS = Feed(
    "behaviors",
    ("impression_id", "user_id", "timestamp", "history", "impressions"),
    {"impression_id": NOT_EMPTY, "user_id": NOT_EMPTY},
    "timestamp",
    "impressions",
)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[{WHITE}]++|[{WHITE}]++\z", "")


def fields_of(line: Column) -> Column:
    """The raw fields of a structurally sound line, as an array."""
    return F.transform(
        F.regexp_extract_all(F.concat(F.lit("\t"), line), F.lit(rf"\t{FIELD}"), F.lit(0)),
        lambda x: F.substring(x, F.lit(2), F.length(x)),
    )


def unquoted(field: Column) -> Column:
    inner = F.replace(F.substring(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


def parsed_timestamp(value: Column) -> Column:
    """The instant (timestamp) that a trimmed value names, NULL if its form, date, time or offset is not real.

    Times without an offset are UTC; fractions beyond microseconds are cut.
    """
    # Both forms are brought to: year, month, day, hour, minute, second, A or P, fraction, offset.
    parts = F.when(value.rlike(rf"^{US_TIME}\z"), F.regexp_replace(value, rf"^{US_TIME}\z", "$3,$1,$2,$4,$5,$6,$7,,")).when(
        value.rlike(rf"^{ISO_TIME}\z"), F.regexp_replace(value, rf"^{ISO_TIME}\z", "$1,$2,$3,$4,$5,$6,,$7,$8")
    )

    def let(c: Column, f) -> Column:
        """``f`` of ``c``, which is evaluated once."""
        return F.get(F.transform(F.array(c), f), 0)

    def instant(p: Column) -> Column:
        n = [F.get(p, i).cast("int") for i in range(6)]
        half = F.upper(F.get(p, 6))
        fraction = F.substring(F.rpad(F.get(p, 7), 6, "0"), 1, 6).cast("bigint")
        digits, back = F.replace(F.substring(F.get(p, 8), 2, 6), F.lit(":"), F.lit("")), F.get(p, 8).startswith("-")
        offset = F.when(F.get(p, 8).isin("", "Z"), F.lit("0000")).otherwise(digits)
        return F.struct(*[x.alias(k) for x, k in zip([*n, half, fraction, offset, back], ("y", "mo", "d", "h", "mi", "s", "half", "us", "off", "back"))])

    def micros(t: Column) -> Column:
        y, mo, d, mi, s = (t[k] for k in ("y", "mo", "d", "mi", "s"))
        oh, om = F.substring(t["off"], 1, 2).cast("int"), F.substring(t["off"], 3, 2).cast("int")
        h = F.when(t["half"] == "", t["h"]).when(t["h"].between(1, 12), t["h"] % 12 + F.when(t["half"] == "P", 12).otherwise(0)).otherwise(-1)
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = F.when(mo.isin(4, 6, 9, 11), 30).when(mo == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
        real = (y >= 1) & mo.between(1, 12) & (d >= 1) & (d <= days) & h.between(0, 23) & (mi <= 59) & (s <= 59) & (oh <= 23) & (om <= 59)
        # Days since 1970 of the proleptic Gregorian calendar, with the year starting in March.
        m = F.when(mo > 2, mo - 3).otherwise(mo + 9)
        yy = F.when(mo > 2, y).otherwise(y - 1)
        day = 365 * yy + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) + F.floor((153 * m + 2) / 5) + d - 1 - 719468
        minutes = (oh * 60 + om) * F.when(t["back"], -1).otherwise(1)
        seconds = day.cast("bigint") * 86400 + h * 3600 + (mi - minutes) * 60 + s
        return F.when(real, F.timestamp_micros(seconds * 1000000 + t["us"]))

    return let(F.split(parts, ",", -1), lambda p: let(F.when(p.isNotNull(), instant(p)), micros))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once a row: what is read of them, filters included, isn't pushed below an explosion."""
    names = {f"_once_{k}": c for k, c in columns.items()}
    wide = df.drop(*columns).withColumn("_once", F.explode(F.array(F.struct(*[c.alias(k) for k, c in names.items()]))))
    return wide.withColumns({k: F.col(f"_once._once_{k}") for k in columns}).drop("_once")


#: The name of what is broken after the last column.
BEYOND = "(beyond the last column)"


def parse_lines(df: DataFrame, feed: Feed, line: str = "line") -> DataFrame:
    """``df`` with the feed's trimmed columns in struct ``fields``, ``parsed_at`` (timestamp), ``reason`` and ``first_broken_field`` (NULL: valid).

    Reasons, the first that holds: ``quote``, ``columns``, ``id``,
    ``timestamp``, ``impressions``. A NULL line counts as an empty one. The
    fields are NULL where the reason is quote or columns.
    """
    text = F.coalesce(F.col(line), F.lit(""))
    whole = _once(df, _text=text, _whole=text.rlike(feed.whole_row()))
    sound = F.col("_whole") | F.col("_text").rlike(STRUCTURE)
    split = _once(whole, _fields=F.when(sound, fields_of(F.col("_text"))))
    n = len(feed.columns)
    named = F.struct(*[trimmed(unquoted(F.get(F.col("_fields"), i))).alias(c) for i, c in enumerate(feed.columns)])
    out = _once(split, _sound=F.col("_fields").isNotNull(), fields=F.when(F.coalesce(F.size("_fields") == n, F.lit(False)), named))
    out = _once(out, parsed_at=parsed_timestamp(F.col(f"fields.{feed.timestamp}")) if feed.timestamp else F.lit(None).cast("timestamp"))

    def first_failing(prefixes: list[str], otherwise: Column, checks: dict[str, Column] | None = None) -> Column:
        """The column of the first prefix that the line doesn't match; ``checks`` holds a further condition of a column."""
        chain = F.when(F.lit(False), "")
        for c, prefix in zip(feed.columns, prefixes):
            fails = ~F.col("_text").rlike(prefix)
            chain = chain.when(fails | checks[c] if checks and c in checks else fails, c)
        return chain.otherwise(otherwise)

    dates = {feed.timestamp: F.col("parsed_at").isNull()} if feed.timestamp else {}
    of_values = F.when(F.col("_whole"), F.when(dates[feed.timestamp], feed.timestamp) if dates else F.lit(None)).otherwise(
        first_failing(feed.value_prefixes(), F.lit(None).cast("string"), dates)
    )
    missing = F.coalesce(F.get(F.array(*[F.lit(c) for c in feed.columns]), F.size("_fields")), F.lit(BEYOND))
    broken = (
        F.when(~F.col("_sound"), first_failing(feed.structure_prefixes(), F.lit(BEYOND)))
        .when(F.col("fields").isNull(), missing)
        .otherwise(of_values)
    )
    out = _once(out, first_broken_field=broken)
    field = F.col("first_broken_field")
    reason = F.when(~F.col("_sound"), "quote").when(F.col("fields").isNull(), "columns").when(field.isin(*feed.ids), "id")
    for c, name in ((feed.timestamp, "timestamp"), (feed.tokens, "impressions")):
        if c:
            reason = reason.when(field == c, name)
    return _once(out, reason=reason).drop("_text", "_whole", "_sound", "_fields")


def failures(df: DataFrame, feed: Feed, keys: list[str], broken_field: bool = False) -> DataFrame:
    """The failing lines: (feed, keys, reason), and with ``broken_field`` the first broken field. Repeated rows count once; an empty table gives none."""
    bad = parse_lines(df.select(*keys, "line"), feed).filter("reason IS NOT NULL")
    more = ["first_broken_field"] if broken_field else []
    return bad.select(F.lit(feed.name).alias("feed"), *keys, "reason", *more).distinct()


def tokens_of(text: Column) -> Column:
    """The white-space separated tokens of a text."""
    return F.filter(F.split(text, f"[{WHITE}]+"), lambda x: x != "")


def typed_news(df: DataFrame, keys: list[str]) -> DataFrame:
    """The valid lines of a news feed as typed rows; repeated rows count once."""
    good = parse_lines(df.select(*keys, "line"), NEWS).filter("reason IS NULL")
    return good.select(*keys, "fields.*").distinct()


def typed_behaviors(df: DataFrame, keys: list[str]) -> DataFrame:
    """The valid lines of a behavior feed as typed rows: ids, timestamp, history array, candidate array."""
    good = parse_lines(df.select(*keys, "line"), BEHAVIORS).filter("reason IS NULL")
    candidates = F.transform(
        tokens_of(F.col("fields.impressions")),
        lambda t, i: F.struct(
            i.cast("int").alias("position"),
            F.regexp_extract(t, r"^(N[0-9]+)", 1).alias("news_id"),
            F.regexp_extract(t, r"-([01])\z", 1).try_cast("tinyint").alias("clicked"),
        ),
    )
    return good.select(
        *keys,
        F.col("fields.impression_id").alias("impression_id"),
        F.col("fields.user_id").alias("user_id"),
        F.col("parsed_at").alias("timestamp"),
        tokens_of(F.col("fields.history")).alias("history"),
        candidates.alias("impressions"),
    ).distinct()
