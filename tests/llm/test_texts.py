import numpy as np
import pandas as pd
import pytest

from presslake.llm import leakage, packing, residue

# --- packing ---


def check(packed, sizes, capacities):
    by = {}
    for r in packed:
        by.setdefault(r.spec_id, []).append(r)
    for spec, capacity in capacities.items():
        rows = by[spec]
        assert {r.doc_id for r in rows} == set(sizes)
        fills = {}
        for r in rows:
            fills[r.container_id] = fills.get(r.container_id, 0) + r.piece_tokens
        assert max(fills.values()) <= capacity
        for d, n in sizes.items():
            own = sorted((r.piece, r.piece_tokens) for r in rows if r.doc_id == d)
            assert sum(t for _, t in own) == n and [p for p, _ in own] == list(range(len(own)))
            assert len(own) == max(1, -(-n // capacity))
        yield spec, sum(fills.values()) / (capacity * len(fills))


def test_packing_conserves_and_fills(spark):
    rng = np.random.default_rng(1)
    sizes = {k: int(n) for k, n in enumerate(rng.integers(0, 300, 3000))} | {3000: 0, 3001: 1000, 3002: 100, 3003: 99}
    docs = spark.createDataFrame([(k, n, "x") for k, n in sizes.items()] + [(3001, 1000, "y"), (None, 5, "x")], "doc_id bigint, n_tokens bigint, container string")
    specs = spark.createDataFrame([(1, "a", 100), (2, "b", 1000), (2, "b", 1000), (3, "c", None), (4, "d", 0)], "spec_id bigint, spec_name string, capacity_tokens bigint")
    for block in (40_000, 300):
        used = dict(check(packing.pack(docs, "doc_id", specs, block_items=block).collect(), sizes, {1: 100, 2: 1000}))
        assert used[1] > 0.9 and used[2] > 0.98
    assert packing.pack(docs.limit(0), "doc_id", specs).count() == 0
    assert packing.pack(docs, "doc_id", specs.limit(0)).count() == 0


def test_sum_of_squares_by_brute_force():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 21, 400)
    place, fill = packing.sum_of_squares(sizes, 20)
    levels, open_ = [0] * 21, {}
    for i, s in enumerate(sizes.tolist()):
        def cost(h):
            now = levels.copy()
            if h:
                now[h] -= 1
            if h + s < 20:
                now[h + s] += 1
            return sum(x * x for x in now)

        options = [h for h in range(0, 20 - s + 1) if h == 0 or levels[h]]
        best = min(options, key=lambda h: (cost(h), -h))
        before = open_.get(place[i], 0)
        assert before == best
        if best:
            levels[best] -= 1
        open_[place[i]] = best + s
        if best + s < 20:
            levels[best + s] += 1
    assert fill.sum() == sizes.sum()


def test_tokens(spark):
    text = "Hello, world! " * 20_000
    assert packing.count_tokens(None) == packing.count_tokens("") == 0
    assert packing.count_tokens(text) == len(packing._encoding(None).encode_ordinary(text))
    df = spark.createDataFrame([(1, "a b", 3), (2, None, 4)], "doc_id bigint, text string, n_tokens int")
    assert {r.doc_id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text").collect()} == {1: 2, 2: 0}


def test_token_counts_of_long_texts_are_exact(monkeypatch):
    whole = lambda t: len(packing._encoding(None).encode_ordinary(t))
    rng = np.random.default_rng(6)
    pieces = ["word", " a", "  b", "\n", " ½", "½ ", " 12", "!?", " été", "'s", "x" * 300, "_ _", "\t", "日本", " ", "a b c"]
    monkeypatch.setattr(packing, "PIECE", 40)
    for _ in range(60):
        text = "".join(pieces[int(k)] for k in rng.integers(0, len(pieces), 200))
        assert packing.count_tokens(text) == whole(text)
    blankless = "abc,def;" * 20_000
    assert packing.count_tokens(blankless) == whole(blankless)


def test_blocks_stay_bounded(spark, monkeypatch):
    """Items of more than half the capacity share no container: no round may gather them in one block."""
    seen = []
    inner = packing._pack_blocks
    monkeypatch.setattr(packing, "_pack_blocks", lambda items, blocks, first: seen.append((items.count(), sum(blocks.values()))) or inner(items, blocks, first))
    specs = spark.createDataFrame([(1, 100)], "spec_id bigint, capacity_tokens bigint")
    docs = spark.range(900).selectExpr("id AS doc_id", "60 + id % 7 AS n_tokens")
    packed = packing.pack(docs, "doc_id", specs, block_items=100)
    assert packed.select("container_id").distinct().count() == 900 and packed.count() == 900
    assert all(items <= blocks * 100 for items, blocks in seen)
    docs = spark.range(900).selectExpr("id AS doc_id", "10 + id % 37 AS n_tokens")
    sizes = {r.doc_id: r.n_tokens for r in docs.collect()}
    ((_, used),) = check(packing.pack(docs, "doc_id", specs, block_items=100).collect(), sizes, {1: 100})
    assert used > 0.97 and all(items <= blocks * 100 for items, blocks in seen)


# --- leakage ---

ITEM = "In the year 8304 Draubroom drained wexunuquist meadows around Velumarsh to plant 4 rows of été quoordovash"
SHAPES = [
    ITEM.upper(),
    "x " + ITEM.replace(" ", "\n,  ") + " y",
    ITEM.replace("a", "&#97;").replace("é", "&eacute;"),
    ITEM.replace("Drau", "Dr­a​u").replace("é", "é"),
    "<p>" + ITEM.replace("drained", "<b>dra</b>ined") + "</p>",
    "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM),
    " ".join(ITEM.split()[3:13]),
]
NOT = [" ".join(ITEM.split()[3:12]), " ".join(ITEM.split()[:9] + ["x"] + ITEM.split()[9:]), "", None, "short"]


@pytest.mark.parametrize("shape", SHAPES)
def test_words_ignore_form(shape):
    a = leakage.words(ITEM)
    assert "-".join(a).find("-".join(a[3:13])) >= 0 and "-".join(a[3:13]) in "-".join(leakage.words(shape))


def test_leaks(spark):
    docs = spark.createDataFrame([(k, t, "z", 1) for k, t in enumerate(SHAPES + NOT)] + [(0, SHAPES[0], "z", 1), (None, ITEM, "z", 1)], "doc_id bigint, text string, k string, i int")
    items = spark.createDataFrame([(7, ITEM), (7, ITEM), (8, "too short"), (9, None)], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id) for r in leakage.leaks(docs, items).collect()) == [(k, 7) for k in range(len(SHAPES))]
    assert leakage.leaks(docs.limit(0), items).count() == 0 and leakage.leaks(docs, items.limit(0)).count() == 0


def test_long_texts_lose_no_window(spark, monkeypatch):
    filler = ["w%d" % (k % 977) for k in range(2000)]
    docs = [(k, " ".join(filler[:cut] + ITEM.split() + filler[cut:])) for k, cut in enumerate(range(85, 130))]
    monkeypatch.setattr(leakage, "CHUNK_WORDS", 100)
    import pyarrow as pa

    walk = [leakage.Walk(10, 0, 30)]
    queries = leakage._Queries([(7, leakage.words(ITEM))], 10, 0, walk)
    batch = pa.RecordBatch.from_arrays([pa.array([k for k, _ in docs], pa.int64()), pa.array([t for _, t in docs])], names=["k", "t"])
    assert {k for b in leakage._scan(iter([batch]), queries) for k in b.column(0).to_pylist()} == set(range(len(docs)))


def test_edits_reach_the_recall(spark):
    rng = np.random.default_rng(4)
    items, docs = [], []
    for k in range(150):
        ws = [f"w{int(x)}" for x in rng.integers(0, 10**6, 12)]
        at = int(rng.integers(12))
        edited = ws[:at] + [["new"], ["new", ws[at]], []][k % 3] + ws[at + 1 :]
        items.append((k, " ".join(ws)))
        docs.append((k, " ".join(["a b c", *edited, *(f"t{i}" for i in range(5))])))
    want = leakage.brute_force(pd.DataFrame(docs), pd.DataFrame(items), 12, 1)
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), window=12, edits=1)
    got = {(r.doc_id, r.item_id) for r in got.collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) > 50


def planted_edits(n):
    """Items of twelve words, and documents that hold them with one word replaced, inserted or deleted inside, at any place of the document."""
    rng = np.random.default_rng(8)
    items, docs = [], []
    for k in range(n):
        ws = [f"w{int(x)}" for x in rng.integers(0, 10**6, 12)]
        at = 1 + int(rng.integers(10))
        edited = ws[:at] + [["new"], ["new", ws[at]], []][k % 3] + ws[at + 1 :]
        around = [["a", "b"], []][k % 2], [["c", "d", "e"], []][k // 2 % 2]
        items.append((k, " ".join(ws)))
        docs.append((k, " ".join([*around[0], *edited, *around[1]])))
    return docs, items


def test_items_above_the_broadcast_size_are_joined(spark, monkeypatch):
    docs, items = planted_edits(60)
    docs += [(1000 + k, "noise " + text) for k, text in items] + [(2000, None), (2001, "short")]
    frames = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items + [(7, items[7][1])], "item_id bigint, text string")
    want = {e: sorted(map(tuple, leakage.leaks(*frames, window=12, edits=e).collect())) for e in (0, 1)}
    assert (1007, 7) in want[0] and len(want[1]) > 100
    monkeypatch.setattr(leakage, "MOST_CHARACTERS", 10)
    for e in (0, 1):
        assert sorted(map(tuple, leakage.leaks(*frames, window=12, edits=e).collect())) == want[e]


def test_every_kind_of_edit_is_found(spark):
    docs, items = planted_edits(150)
    found = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), window=12, edits=1)
    found = {(r.doc_id, r.item_id) for r in found.collect()}
    assert found <= {(k, k) for k in range(150)}
    per_kind = [sum((k, k) in found for k in range(kind, 150, 3)) for kind in range(3)]
    print("found of 50 replaced, inserted, deleted:", per_kind)
    assert sum(per_kind) >= 0.9 * 150 and min(per_kind) >= 40


def test_edited_passages_by_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(400):
        item, ws = ([str(x) for x in rng.integers(0, 3, n)] for n in (5, int(rng.integers(0, 9))))
        for most in range(3):
            wanted = any(leakage.within_edits(ws[:n], item, most) for n in range(len(ws) + 1))
            assert leakage.begins_within(ws, 0, len(ws), item, most) == wanted


def test_edits_cross_no_text_end(spark):
    ws = [f"w{k}" for k in range(12)]
    docs = spark.createDataFrame([(1, " ".join(ws[:6])), (2, " ".join(ws[6:])), (3, " ".join(ws[1:])), (4, " ".join(ws[2:]))], "doc_id bigint, text string").coalesce(1)
    items = spark.createDataFrame([(7, " ".join(ws))], "item_id bigint, text string")
    assert {r.doc_id for r in leakage.leaks(docs, items, window=12, edits=1).collect()} <= {3}


# --- residue ---

CASES = [
    "Dear {{first_name}},\nthe council met on Monday and agreed on the plan for the year.",
    "By [INSERT AUTHOR HERE]",
    "The fair ${city} opened on Monday.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit.",
    "Menu\nSearch\nError 404\nThe page you asked for could not be located on this server.",
    "<p>Please enable JavaScript to continue.</p>",
    "asdf asdf qwer asdf hjkl asdf",
    "blah " * 40,
    "Texto de relleno. Aquí va el texto.",
]
FINE = [
    "The council met on Monday and agreed on the plan. Please enable JavaScript to see the chart. The vote was close.",
    'A sign reading "%TEAM_NAME%" hung over the market until the owner took it down.',
    "The set {1, 2, 3} and its cousins [sic] filled the board at 100% of the price.",
    "Courses in JavaScript at the town hall filled up in 21 minutes, the organisers said on Friday.",
    "Printers once set lorem ipsum by hand, the curator explains in the new booklet of the museum.",
    "Menu\nSearch\nThe fair opened on Monday.",
    " \n ",
]


def test_residue(spark):
    schema = "doc_id bigint, text string, source string, k string, h int"
    rows = [(k, t, "s", "x", 1) for k, t in enumerate(CASES + FINE)] + [(90, None, "s", "x", 1), (91, "", None, "x", 1), (0, CASES[0], "s", "x", 1), (None, CASES[0], "s", "x", 1)]
    df = spark.createDataFrame(rows, schema)
    found = residue.residue_documents(df)
    assert sorted(r.doc_id for r in found.collect()) == list(range(len(CASES)))
    assert residue.without(df, found).count() == len(FINE) + 3
    assert residue.residue_documents(df.limit(0)).count() == 0


def test_recurring_messages_count_whole(spark):
    text = "Our servers are having an unusual server error day, order 66f today."
    rows = [(k, text.replace("66f", f"{k}f"), "abc"[k % 3]) for k in range(6)] + [(10, "One server error was reported by the clerk of the town on Friday.", "a")]
    found = residue.residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(6))


UNTRIGGERED = [
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.",
    "Lorem ipsum dolor sit amet. Duis aute irure reprehenderit voluptate velit esse cillum. The fair opened on Monday at noon again.",
    "Story to follow.",
    "401 Unauthorized",
    "'Not found'",
    "For full access",
    "at app.main (main.js:12:4)",
    "To\tcontinue",
    "Home | News | Sport | Contact\nSubscribe\nSkip to content\nBack to the front page\nShare this story\nTop stories\nspam spam spam spam spam spam",
]


def test_residue_without_known_words(spark):
    rows = [(k, t, "s") for k, t in enumerate(UNTRIGGERED)] + [(90, "The fair opened on Monday and the mayor spoke at noon.", "s")]
    found = residue.residue_documents(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))
    assert sorted(r.doc_id for r in found.collect()) == list(range(len(UNTRIGGERED)))


def spelled(parsed):
    """Texts that a parsed pattern matches: every branch, optional parts present and absent, one character of a class."""
    out = [""]
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            more = [chr(value)]
        elif op == "IN":
            kind, first = value[0]
            more = [chr(first) if str(kind) == "LITERAL" else chr(first[0]) if str(kind) == "RANGE" else "4" if "DIGIT" in str(first) else "x"]
        elif op in ("ANY", "NOT_LITERAL"):
            more = ["x"]
        elif op == "BRANCH":
            more = [x for b in value[1] for x in spelled(b)]
        elif op == "SUBPATTERN":
            more = spelled(value[3])
        elif op == "MAX_REPEAT":
            low, _, body = value
            more = [x * n for x in spelled(body) for n in {low, max(low, 1)}]
        else:
            assert op == "AT", op
            more = [""]
        out = [a + b for a in out for b in dict.fromkeys(more)]
    return out


def test_every_rule_is_reachable():
    import re

    for pattern in (*residue.PHRASES, residue.KEYWORDS):
        texts = spelled(re._parser.parse(pattern))
        assert any(re.search(pattern, t) for t in texts)
        assert [t for t in texts if not any(s in t for s in residue.SIGNS) and not re.search(residue._FRAME, t)] == []


def test_messages_that_no_rule_knows_are_found_by_their_company(spark):
    """Sentences of no list recur beside errors: they are residue. House phrases and reprinted articles recur as well and are none."""
    heads = ["Error 502", "Page not found", "Bad Gateway", "Something went wrong"]
    unknown = ["The kettle of this desk has boiled over, kindly come back after tea.", "Wir holen gerade neue Kreide, bis gleich."]
    rows = []
    for k in range(40):
        rows.append((k, f"{heads[k % 4]}\n{unknown[k % 2]}\nTicket {k}", "abc"[k % 3]))
    for k in range(40):
        rows.append((100 + k, f"The mayor of town {chr(97 + k % 26)}{k} opened the fair at noon and spoke of number {k}. Read on in our letter. Ticket {k}", "abc"[k % 3]))
    article = "The new server at the inn carried nine plates at once, as the cook had hoped. Every browser of old books found the shop closed on the day of the fair. The crowd went home by the last tram of the night."
    for k in range(12):
        rows.append((200 + k, article, "abc"[k % 3]))
    only = []
    found = residue.residue_documents(spark.createDataFrame(rows + rows[:3], "doc_id bigint, text string, source string"), by_recurrence=only)
    assert sorted(r.doc_id for r in found.collect()) == list(range(40))
    assert only[0] == 40 and only[1] > 30  # the phrases alone hold less than half of the words


def test_verdicts_above_the_broadcast_size_are_joined(spark, monkeypatch):
    heads = ["Error 502", "Page not found", "Bad Gateway", "Something went wrong"]
    rows = [(k, f"{heads[k % 4]}\nThe kettle of this desk has boiled over, kindly come back after tea.\nTicket {k}", "abc"[k % 3]) for k in range(40)]
    rows += [(100 + k, f"The mayor of {chr(97 + k % 26) * (2 + k // 26)}ville opened the fair and spoke at length of the bridge. Read on in our letter. {heads[k % 2]}", "abc"[k % 3]) for k in range(40)]
    rows += rows[:3] + [(0, "Another version of the text that says nothing.", "a"), (7, CASES[0], None), (200, "\n", "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    few, many = [], []
    expected = sorted(map(tuple, residue.residue_documents(df, by_recurrence=few).collect()))
    monkeypatch.setattr(residue, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, residue.residue_documents(df, by_recurrence=many).collect())) == expected
    assert [r[0] for r in expected] == list(range(40)) and few == many


def test_masks_and_filler():
    assert residue.masked("error 404 at 12:30 see /srv/app/x.php or www.a.example, id 66f") == residue.masked("error 500 at 1:05 see /srv/app/y.php or www.b.example, id 0a1")
    assert residue.masked("error in the bill") == "error in the bill"
    for words in ("asdf jkl qwertz", "spam spam spam spam spam spam", "lorem dolor amet velit nova"):
        assert residue.is_filler(words.split())
    for words in ("were you there", "the quiet type", "404 12", "wer hat das"):
        assert not residue.is_filler(words.split())
