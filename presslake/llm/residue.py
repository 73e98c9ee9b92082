r"""Template residue, filler, error pages and script notices.

A text is cut into messages (lines and sentences). Numbers, addresses, dates and
identifiers are masked, and the exact hashes of all masked messages are counted
over all documents and sources. Only then are messages judged:

* a message that recurs in several documents and sources is residue if it holds
  a keyword or a phrase of a notice, an error or filler;
* a recurring message without one is residue by the company it keeps: if in at
  most of the documents that hold it the rest is hollow, that is mostly
  recurring messages and to a good part residue. So sentences that no list knows
  are found, and house phrases of ordinary articles are not;
* in a message that doesn't recur only the words of a complete phrase count.

Filler is recognised by a test of its own, as its sentences rarely recur: words
typed along the rows of a keyboard, one or two words again and again, or the
well-known pseudo-Latin, whatever words a document mixes with it, as long as they
come without any function word of a language. A document is a case if more than
half of its words, page menus not counted, are residue, or if it holds a
placeholder that is not merely quoted.

The texts are read once; of every message its hash, its number of words and what
the rules say of it are written, and all counting is done on these. Messages of a
document are combined before any shuffle, counts before theirs, so a message in a
third of all documents is no hot key; verdicts are broadcast only while they are
few, beyond that only those on the most frequent messages are, and the others are
joined by shuffle. Recurring messages are joined once and then stand with their
documents, where the rounds read them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslake.session import StagedTable, cut

# --- Fixed values: what placeholders, notices, error pages, filler and menus look like. ---

_NAME = r"[A-Za-z][A-Za-z0-9_. -]*"
#: Forms of unfilled placeholders in template languages and newsroom copy.
PLACEHOLDERS = (
    rf"\{{\{{\s*{_NAME}[^{{}}\n]{{0,60}}\}}\}}",  # {{name}}, {{ name | filter }}
    rf"\{{%\s*{_NAME}[^%\n]{{0,60}}%\}}",  # {% block name %}
    rf"<%=?\s*{_NAME}[^%\n]{{0,60}}%>",  # <%= name %>
    r"[$#]\{[A-Za-z_][^{}\n]{0,60}\}",  # ${name}, #{name}
    r"\[\[[A-Za-z_][^\[\]\n]{0,60}\]\]",  # [[name]]
    r"<<[A-Za-z_][^<>\n]{0,60}>>",  # <<name>>
    r"%\([A-Za-z_][^()\n]{0,60}\)[sd]",  # %(name)s
    r"%[A-Z][A-Z_.]{2,}%",  # %NAME%
    r"(?<![\w%])%s\s\w{1,4}\s%d\b",  # %s in %d
    r"\[(?:[Ii]nsert|INSERT|[Yy]our|YOUR)\s[^\[\]\n]{1,60}\]",  # [insert name], [Your name]
    r"\[[A-Z][A-Z_. ]*\sHERE\]",  # [NAME HERE]
    r"\b__[A-Z][A-Z_.]*[A-Z]__\b",  # __NAME__
    r"@@[A-Za-z_.]+@@",  # @@name@@
    r"(?<![\w{$#])\{(?:[a-z][a-z_.]*|[0-9])\}(?!\})",  # {name}, {0}
    r"<[a-z_.-]+-goes-here>",  # <name-goes-here>
    r"\bXX[A-Z][A-Z_.]+XX\b",  # XXNAMEXX
    r"\bTK\sTK\b",  # TK TK name TK
    r":[a-z_.]+:_placeholder\b",  # :name:_placeholder
)
#: Phrases of notices, error pages and filler in general use; accents may be broken, so any one or two characters stand for them.
PHRASES = (
    r"(?:please |you need to )?(?:enable|turn on|activate|allow) (?:javascript|js|scripts?)(?: in your browser)?(?: and reload)?(?: the page)?",
    r"(?:bitte )?aktivieren sie javascript(?: in ihrem browser)?",
    r"(?:veuillez )?activer javascript(?: dans votre navigateur)?",
    r"activ[ea] javascript(?: en su navegador)?",
    r"(?:java)?script(?:s|ing)? (?:is|are) (?:disabled|switched off|turned off|off)(?: in your browser)?",
    r"this (?:site|page|app) (?:needs|requires) (?:java)?scripts?",
    r"(?:to continue|for full access|and reload the page)",
    r"checking your browser[^.\n]{0,30}",
    r"\bnoscript\b",
    r"\bloading\.\.\.",
    r"\b(?:http |error |status )?[45]\d\d (?:bad request|unauthorized|forbidden|not found|gone|internal server error|bad gateway|service unavailable|gateway timeout)",
    r"\b(?:http|error|status)(?: code)?[ :-]+[45]\d\d\b",
    r"\b(?:internal server error|bad gateway|service unavailable|gateway timeout|access denied|application error|fatal error|page (?:unavailable|not found)|not found|forbidden|gone)\b",
    r"(?:sorry, )?something went wrong",
    r"\boops!?",
    r"page introuvable",
    r"p.{1,3}gina no encontrada",
    r"seite nicht gefunden",
    r"(?:page|article|resource|file)[^.\n]{0,25} (?:could not be (?:located|found)|was not found|no longer exists)(?: on this server)?",
    r"you do not have permission to (?:access|view)[^.\n]{0,20}",
    r"uncaught exception in \S+ on line \d+",
    r"traceback \(most recent call last\):?",
    r"file \"[^\"\n]{1,80}\", line \d+, in \w+",
    r"\b(?:key|type|value|name|index|attribute)error: '?\w+'?",
    r"\brequest id:? \S*\d\S*",
    r"[a-z.]*exception at [\w.]+\(\w+\.java:\d+\)",
    r"\bat [\w.<>]+ \(\w+\.\w+:\d+(?::\d+)?\)",
    r"(?:dies ist ein )?blindtext",
    r"texto de relleno",
    r"aqu.{1,3} va el texto",
    r"texte de remplissage",
    r"(?:sample|dummy|placeholder) (?:paragraph|text|copy|sentence)",
    r"(?:story|text|copy) (?:goes here|to follow)",
    r"your text here",
    r"lorem ipsum",
)
#: Words that make a recurring message a notice, an error or filler as a whole.
KEYWORDS = r"\b(?:javascript|scripts?|scripting|noscript|js|error|exception|traceback|forbidden|unavailable|gateway|timeout|permission|denied|not found|encontrada|introuvable|nicht gefunden|serve(?:r|ur)|servidor|browser|blocker|dummy|placeholder|blindtext|relleno|remplissage|sample|loading)\b"
#: The words of the well-known pseudo-Latin passage that are hardly words of another language.
LATIN = frozenset(
    "lorem ipsum dolor amet consectetur adipiscing elit eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum "
    "fugiat nulla pariatur excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum".split()
)
#: Words that stand for a text.
STAND_INS = frozenset("blah xxx foo bar baz test".split())
#: Rows of keyboards; a word typed along them is made of three neighbours or more at a time.
KEYBOARD_ROWS = ("qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "zxcvbnm", "yxcvbnm")
#: Function words; a sentence of these languages hardly goes without one.
FUNCTION_WORDS = frozenset(
    (
        "the a an and or but of to in on at for with by from as is are was were be been it its this that these those he she they we you his her their our not no has have had will would who which what when where there than then if so "
        "der die das den dem des ein eine einen einem einer und oder aber von zu zum zur im in am an auf mit bei nach aus als ist sind war waren wird wurde hat haben nicht kein es er sie wir ihr sich auch "
        "el la los las un una unos unas y o pero de del en al por para con sin es son era fue ha han no se su sus lo que como "
        "le la les un une des et ou mais de du en au aux par pour avec sans est sont \u00e9tait a ont ne pas se sa son ses il elle nous que qui dans sur"
    ).split()
)
#: Every match of a phrase or a keyword holds one of these strings, stack frames apart; a test derives this from the patterns.
SIGNS = (
    "script|js|error|exception|traceback|forbidden|unavailable|gateway|timeout|permission|denied|not found|encontrada|introuvable|nicht gefunden"
    "|server|serveur|servidor|browser|blocker|dummy|placeholder|blindtext|relleno|remplissage|sample|loading"
    "|\", line|request id|to continue|for full access|and reload the page|bad request|unauthorized|gone|http|status|something went wrong|oops|could not be located|could not be found|no longer exists"
    "|va el texto|goes here|to follow|your text here|lorem ipsum"
).split("|")
_FRAME = r"\(\w+\.\w+:\d"
#: Page menus.
MENU_WORDS = (
    "menu|search|home|news|sport|contact|go back|log ?in|sign in|subscribe|skip to content|back to the front page|share this story"
    "|about(?: us)?|next|previous|top stories"
)
MENU = rf"^(?:{MENU_WORDS}|(?:home|news|sport|contact|go back)(?:\s*[|·/]\s*[\w ]{{1,20}}){{1,8}})$"
#: A recurring message occurs at least so often, in two documents and two sources at least.
MIN_OCCURRENCES = 3
#: Words that a keyword makes a notice with it at most; sentences of reprinted articles recur as well, but are longer.
WORDS_PER_KEYWORD = 8
#: Share of the documents that hold a message unknown to the rules which must be hollow beside it.
HOLLOW_SHARE = 0.6
#: A document is hollow beside a message if of its other words more than half recur and at least this share is residue.
HOLLOW_RESIDUE = 0.25
#: Share of known pseudo-Latin among the words of sentences without function words that makes them all filler.
LATIN_SHARE = 0.1
#: Rounds in which messages are judged by their company.
ROUNDS = 2
#: Verdicts on messages that are broadcast at most.
MOST_BROADCAST = 100_000
#: Of more verdicts, those on a larger part than 1 / HOT_SHARE of all their messages are broadcast and the others joined by shuffle.
HOT_SHARE = 512

_PLACEHOLDER = "(?:" + "|".join(PLACEHOLDERS) + ")"
_PHRASE = re.compile("(?:" + "|".join(PHRASES) + ")")
_KEYWORD = re.compile(KEYWORDS)
_MENU = re.compile(MENU)
_MENU_TAIL = re.compile(rf"(?:^| )(?:{MENU_WORDS})(?:\s*[|·/]\s*(?:{MENU_WORDS}))*\s*[.]?$")
_FRAMES = re.compile(_FRAME)
_WORD = re.compile(r"[^\W_]+")
_CUT = re.compile(r"[\r\n]+|(?<=[.!?\u2026])\s+|\s+[\u2013\u2014-]\s+")
_TAGS = r"(?i)</?(?:p|b|i|u|em|strong|span|div|br|li|ul|ol|h[1-6]|a|td|tr|table)(?:\s[^<>]*)?/?>"
_TAG = re.compile(_TAGS)
#: What is masked: tokens with a digit (numbers, dates, times, identifiers), addresses and paths.
_MASKED = re.compile(r"\d|://|@|^www\.|^/\w+/")
_MASKABLE = re.compile(r"[\d@/.]")
_RUNS = sorted({row[i:j] for row in KEYBOARD_ROWS for i in range(len(row)) for j in range(i + 3, len(row) + 1)}, key=lambda r: (-len(r), r))
_TYPED = re.compile(f"(?:{'|'.join(_RUNS)})+")


def _signs() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for sign in SIGNS:
        automaton.add_word(sign, sign)
    automaton.make_automaton()
    return automaton


def has_placeholder(text: Column) -> Column:
    """Does the text hold an unfilled placeholder? One that is quoted with at most two words beside it is a subject, not a case."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.contains("<"), F.regexp_replace(text, _TAGS, "\n")).otherwise(text)
    decoded = plain
    for entity, character in (("&quot;|&#34;", '"'), ("&#39;|&apos;|&rsquo;|&lsquo;", "'"), ("&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        decoded = F.regexp_replace(decoded, entity, character)
    plain = F.when(plain.contains("&"), decoded).otherwise(plain)
    quoted = rf"[\"\u201c\u201d\u201e\u00ab](?:\w+\s){{0,2}}{_PLACEHOLDER}(?:\s\w+){{0,2}}[\"\u201c\u201d\u00bb]"
    possible = text.rlike(r"[{%<@\[&]|__|XX|TK|_placeholder")
    return possible & plain.rlike(_PLACEHOLDER) & F.regexp_replace(plain, quoted, " ").rlike(_PLACEHOLDER)


def messages(text: str | None) -> list[str]:
    """The lines and sentences of a text without markup, lower-cased, blanks made one, without empty ones."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("\n", text)
    if "&" in text:
        text = html.unescape(text)
    return [m for part in _CUT.split(text.lower()) if (m := " ".join(part.split()).lstrip("-\u2013\u2014 "))]


def pieces(message: str) -> list[tuple[str, bool]]:
    """A message cut where a phrase begins or ends, as texts often lose their line ends; with each piece whether it is a phrase. A menu at the end goes."""
    out, at = [], 0
    tail = _MENU_TAIL.search(message)
    end = tail.start() if tail else len(message)
    for x in _PHRASE.finditer(message, 0, end):
        out += [(message[at : x.start()], False), (x.group(), True)]
        at = x.end()
    out.append((message[at:end], False))
    return [(p, phrase) for part, phrase in out if (p := part.strip(" -|,;:"))]


def masked(message: str) -> str:
    """Numbers, dates, identifiers, addresses and paths replaced by one character each."""
    if not _MASKABLE.search(message):
        return message
    return " ".join(["\x01" if not t.isalpha() and _MASKED.search(t) else t for t in message.split(" ")])


@lru_cache(1 << 16)
def _typed(word: str) -> bool:
    """Is the word typed along the rows of a keyboard?"""
    return _TYPED.fullmatch(word) is not None


def is_filler(words: list[str]) -> bool:
    """One or two words again and again, words typed along the keyboard, or mostly the known pseudo-Latin."""
    n = len(words)
    if n >= 6 and len(set(words)) <= 2:
        return True
    if not LATIN.isdisjoint(words):
        latin = sum(w in LATIN for w in words)
        if latin > 1 and latin * 10 >= n * 6:
            return True
    if n < 2:
        return False
    typed = fail = 0
    for w in words:
        if _typed(w):
            typed += 1
        elif w not in STAND_INS and not w.isdigit():
            fail += 1
            if fail * 10 > n * 4:
                return False
    return typed > 0 or fail == 0 and not STAND_INS.isdisjoint(words)


def judged(text: str, signs: ahocorasick.Automaton) -> tuple[int, dict[str, list[int]]]:
    """(words without menus, masked message -> [words, words of phrases or filler, is there a phrase or a keyword])."""
    total, found = 0, {}
    free: list[tuple[str, int]] = []
    n_free = n_latin = 0
    lowered = text.lower()
    # Entities may stand for the letters of a sign, blanks may be many; else a text without any sign has no message with one.
    possible = "&" in lowered or next(signs.iter(" ".join(lowered.split())), None) is not None or ("(" in lowered and _FRAMES.search(lowered) is not None)
    for m in messages(text):
        words = _WORD.findall(m)
        n = len(words)
        if not n or (len(m) < 80 and _MENU.match(m)):
            continue
        signed = possible and (next(signs.iter(m), None) is not None or ("(" in m and _FRAMES.search(m) is not None))
        parts = pieces(m) if signed and not is_filler(words) else [(m, False)]
        for part, phrase in parts:
            own = words if part is m else _WORD.findall(part)
            n = len(own)
            if not n:
                continue
            total += n
            filler = is_filler(own)
            certain = n if phrase or filler else 0
            name = masked(part)
            if not certain and n > 2 and FUNCTION_WORDS.isdisjoint(own):
                free.append((name, n))
                n_free += n
            if (filler or not certain) and not LATIN.isdisjoint(own) and (filler or FUNCTION_WORDS.isdisjoint(own)):
                n_latin += sum(w in LATIN for w in own)
            entry = found.setdefault(name, [0, 0, 0])
            entry[0] += n
            entry[1] += certain
            entry[2] |= certain > 0 or (signed and len(_KEYWORD.findall(part)) * WORDS_PER_KEYWORD >= n)
    if n_latin > 1 and n_latin >= LATIN_SHARE * n_free:
        for name, n in free:
            found[name][1] += n
            found[name][2] = 1
    return total, found


_MESSAGE = pa.struct([("h", pa.int64()), ("w", pa.int32()), ("c", pa.int32()), ("s", pa.bool_())])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (k, src, template, t) with the text replaced by what is known of its messages."""
    signs = _signs()
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            totals, versions, offsets, hashes, sizes, certain, sign = [], [], [0], [], [], [], []
            for t in part.column(3):
                text = t.as_py()
                total, found = judged(text, signs)
                totals.append(total)
                versions.append(xxhash.xxh64_intdigest(text))
                for name, (w, c, s) in found.items():
                    hashes.append(xxhash.xxh64_intdigest(name))
                    sizes.append(w)
                    certain.append(c)
                    sign.append(bool(s))
                offsets.append(len(hashes))
            signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            flat = pa.StructArray.from_arrays([signed(hashes), pa.array(sizes, pa.int32()), pa.array(certain, pa.int32()), pa.array(sign, pa.bool_())], fields=list(_MESSAGE))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)
            columns = [part.column(0), part.column(1), part.column(2), pa.array(totals, pa.int32()), signed(versions), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "src", "template", "n_words", "v", "m"])


def _with_verdicts(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` left-joined by h with ``verdicts`` (h, n and others); ``rows`` keep their own n if they have one."""
    given = verdicts.drop("n") if "n" in rows.columns else verdicts
    if verdicts.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(given), "h", "left")
    held = verdicts.agg(F.sum("n")).first()[0]
    hot = verdicts.filter(F.col("n") * HOT_SHARE > held).select("h")
    often = rows.join(F.broadcast(given.join(F.broadcast(hot), "h")), "h")
    seldom = rows.join(F.broadcast(hot), "h", "left_anti").join(given.join(F.broadcast(hot), "h", "left_anti"), "h", "left")
    return often.unionByName(seldom)


def recurring_messages(rows: DataFrame) -> DataFrame:
    """(h, n, s): messages that recur over documents and sources, how often they occur, and whether a rule holds for them."""
    counts = rows.groupBy("h").agg(
        F.count(F.lit(1)).alias("n"), F.max("s").alias("s"), F.min("src").alias("a"), F.max("src").alias("b"), F.min("k").alias("k0"), F.max("k").alias("k1")
    )
    return counts.filter(f"n >= {MIN_OCCURRENCES} AND a < b AND k0 < k1").select("h", "n", "s")


def residue_documents(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", by_recurrence: list | None = None) -> DataFrame:
    """(key, has_placeholder, n_words, n_residue) of the documents that are cases; one row per key.

    NULL and empty texts are no cases, NULL keys give no row. A NULL source
    counts as one source. Repeated rows count once. Texts are read whole.
    ``by_recurrence`` receives how many documents are cases by their messages,
    and how many of them the phrases and filler alone would not have made one.
    """
    docs = df.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.col(text).alias("t")).filter(
        F.col("k").isNotNull() & F.col("t").isNotNull() & (F.col("t") != "")
    )
    kind = docs.schema["k"].dataType.simpleString()
    schema = f"k {kind}, src string, template boolean, n_words int, v bigint, m array<struct<h:bigint,w:int,c:int,s:boolean>>"
    staged = StagedTable(docs.select("k", "src", has_placeholder(F.col("t")).alias("template"), "t").mapInArrow(_judge, schema))
    certain = F.aggregate("m.c", F.lit(0).cast("bigint"), lambda total, c: total + c).alias("certain")
    texts = staged.read().select("k", "src", "v", "n_words", certain, "m")
    recurring = StagedTable(recurring_messages(texts.select("k", "src", F.inline("m"))))

    each = F.collect_set(F.struct("h", "n", "w", "c", "s"))

    def by_document(found: DataFrame, copies: Column) -> StagedTable:
        """One row per document and version that holds recurring messages, with these; ``copies`` says how often it is delivered."""
        return StagedTable(found.groupBy("k", "v").agg(F.max("n_words").alias("n_words"), F.max("certain").alias("certain"), copies.alias("copies"), each.alias("m")))

    # Only recurring messages are shuffled to their documents; of the others a document keeps the sum of the certain words.
    flat = texts.select("k", "v", "n_words", "certain", F.inline("m")).drop("s")
    documents = by_document(_with_verdicts(flat, recurring.read()).filter("n IS NOT NULL"), F.count(F.lit(1)) / F.size(each))
    residue = F.col("certain") + F.aggregate("m", F.lit(0).cast("bigint"), lambda total, x: total + F.when(x.s, x.w - x.c).otherwise(0))
    recurs = F.aggregate("m.w", F.lit(0).cast("bigint"), lambda total, w: total + w)

    # At first the recurring messages for which a rule holds are residue; in each round those in whose company documents are hollow join them.
    for _ in range(ROUNDS):
        hosts = documents.read().select("*", residue.alias("residue"), recurs.alias("recurs")).filter("residue > 0")
        beside = hosts.select("n_words", "copies", "residue", "recurs", F.inline("m")).filter("NOT s")
        others = F.col("n_words") - F.col("w")
        hollow = ((F.col("recurs") - F.col("w")) * 2 > others) & (F.col("residue") >= others * HOLLOW_RESIDUE)
        counts = beside.filter(hollow).groupBy("h", "n").agg(F.sum("copies").alias("g"))
        company = cut(counts.filter(f"g >= {MIN_OCCURRENCES} AND g >= n * {HOLLOW_SHARE}").select("h", "n", F.lit(True).alias("g_")))
        if company.isEmpty():
            break
        told = _with_verdicts(documents.read().select("k", "v", "n_words", "certain", "copies", F.inline("m")), company)
        before, documents = documents, by_document(told.withColumn("s", F.col("s") | F.coalesce("g_", F.lit(False))), F.max("copies"))
        before.drop()

    # Where no message recurs the certain words are all the residue; elsewhere they are less than it, so that the larger of both holds.
    scored = documents.read().select("k", "n_words", "certain", residue.alias("residue"))
    final = scored.union(texts.select("k", "n_words", "certain", "certain")).filter("residue * 2 > n_words")
    if by_recurrence is not None:
        by_recurrence.extend(final.agg(F.count_distinct("k"), F.count_distinct(F.when(F.expr("certain * 2 <= n_words"), F.col("k")))).first())
    cases = final.groupBy("k").agg(F.max("n_words").cast("bigint").alias("n_words"), F.max("residue").cast("bigint").alias("n_residue"))
    templates = staged.read().filter("template").select("k").distinct().withColumn("template", F.lit(True))
    out = templates.join(cases, "k", "full_outer")
    return out.select(F.col("k").alias(key), F.coalesce("template", F.lit(False)).alias("has_placeholder"), "n_words", "n_residue")


def without(df: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The corpus without the found documents; rows with a NULL key stay."""
    return df.join(found.select(key), key, "left_anti")


__all__ = ["residue_documents", "recurring_messages", "without", "has_placeholder", "messages", "masked", "judged", "is_filler"]
